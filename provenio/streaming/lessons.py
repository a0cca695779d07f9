"""The memory of lessons as a stream: of each document and field the newest lesson, kept as state.

A lesson replaces what is known of its document and field if it was taught later, or at the same time under a larger id; one that
arrives late, or again, changes nothing. So the state is that of a batch upsert in whatever order lessons arrive. The state is one
row for each document and field, in the state store. Lessons without a document, a field or a time are not lessons.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenio.sources.files import keep_latest

KEY = ("doc_id", "field_id")
LESSON = "lesson_id string, value string, quote string, page int, created_at timestamp"
HELD = LESSON.replace("timestamp", "long")  # microseconds, whatever the session's time zone
NEWEST = f"doc_id string, field_id string, {HELD}"
_FIELDS = [c.split()[0] for c in LESSON.split(", ")]


class Newest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        age = lambda x: (x[_FIELDS.index("created_at")], x[_FIELDS.index("lesson_id")])
        held = tuple(self.state.get()) if self.state.exists() else None
        best = max((tuple(r[c] for c in _FIELDS) for r in rows), key=age, default=None)
        if best is not None and (held is None or age(best) > age(held)):
            self.state.update(best)
            yield Row(**dict(zip(KEY, key, strict=True)), **dict(zip(_FIELDS, best, strict=True)))

    def close(self) -> None:
        pass


def _sound(lessons: DataFrame) -> DataFrame:
    rows = lessons.select(*[F.col(c).cast("string") for c in KEY], *[F.col(c.split()[0]).cast(c.split()[1]) for c in LESSON.split(", ")])
    return rows.where(" and ".join(f"{c} is not null" for c in (*KEY, "created_at", "lesson_id")))


def newest_stream(lessons: DataFrame) -> DataFrame:
    """The changes of the memory, as a stream in update mode: the last one of a document and field is what it holds.

    Needs RocksDB as the state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = _sound(lessons).withColumn("created_at", F.unix_micros("created_at"))
    found = rows.groupBy(*KEY).transformWithState(Newest(), NEWEST, "Update", "None")
    return found.withColumn("created_at", F.timestamp_micros("created_at"))


def newest(lessons: DataFrame) -> DataFrame:
    """The same from a table."""
    return keep_latest(_sound(lessons).withColumn("_age", F.struct("created_at", "lesson_id")), list(KEY), "_age").drop("_age")
