"""A persistent inverted index: segments that documents are added to without a rebuild, and the k best by score bounds.

A folder holds segments and a manifest. A segment has two tables: `postings`, blocks of at most BLOCK entries (keys, times,
lengths) of a term, in order of falling weight, partitioned by a hash of the term; and `documents`, the terms of each document,
partitioned by a hash of its key. A hot term is dealt into slices of SLICE entries first, so that no task sorts a whole list, and
a folder is written by several tasks, of PART entries each or so.
The manifest names the segments of a version with their document counts; a version is written last and once, so that a
segment of a failed or repeated task is never seen, and of two writers at a time one fails. Merging writes one segment in place
of all and a version that names it alone; readers of older versions still find theirs.

Search: blocks have the highest count and the shortest length of their entries, which bound what one can score under
any corpus size. The best blocks of a query are read first, and the kth partial score found is a threshold. Terms of
which all bounds together stay under a part of it are left closed, as are blocks that cannot reach it with all other terms' bounds. What
is still possible after the open blocks, by the kth of what they gave, is scored from its own terms in `documents`. The result is that of reading all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenio.operators.retrieval import FLOOR, K1, B
from provenio.session import staged

BLOCK, SLICE = 256, 1 << 16
#: Folders that the terms and the documents of a segment are dealt into.
FOLDERS = 16
#: Entries that one task writes into a folder, some.
PART = 1 << 18
#: Blocks that a query reads first.
FIRST = 8
#: Of the threshold, what the terms that stay closed may give; the less, the fewer documents are looked up, for more entries read.
CLOSED = 0.25
_SLACK = 1e-8


def weight(tf: Column, length: Column, mean: Column) -> Column:
    """What BM25 gives for a term besides its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _folder(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FOLDERS)).cast("int")


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(column), 16), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """An index at a path; keys are 64-bit numbers."""

    spark: SparkSession
    path: str

    # -- Versions.

    def segments(self) -> tuple[int, list]:
        """(version, rows (segment, n, total)) of the latest version."""
        try:
            found = self.spark.read.schema("segment string, n long, total long, version int").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []  # no version was written yet
        version = found.agg(F.max("version")).first()[0]
        return version, sorted(found.where(F.col("version") == version).select("segment", "n", "total").collect())  # one row a segment

    def _publish(self, version: int, segments: list) -> None:
        rows = self.spark.createDataFrame([tuple(s) for s in segments], "segment string, n long, total long")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")

    # -- Writing.

    def _write(self, counts: DataFrame, segment: str) -> tuple[str, int, int]:
        """A segment of rows (key, term, tf, len)."""
        place = f"{self.path}/segments/{segment}"
        counts = staged(counts)
        parts = -(-counts.count() // (FOLDERS * PART)) or 1  # tasks of a folder
        hot = counts.groupBy("term").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).where("slices > 1")  # one in SLICE rows at most
        sliced = counts.join(F.broadcast(hot), "term", "left").withColumn("slice", F.pmod(F.xxhash64("key"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
        # dealt out once, as it is written: what is grouped below names the columns it is dealt by
        dealt = sliced.withColumns({"folder": _folder("term"), "part": _part("term", parts)}).repartition("folder", "slice", "part")
        list_ = ("term", "slice", "folder", "part")
        best = Window.partitionBy(*list_).orderBy(F.desc(F.col("tf") / (F.col("tf") + F.lit(K1) * F.col("len") / 200)), "key")
        block = F.floor((F.row_number().over(best) - 1) / BLOCK).cast("int")
        blocks = dealt.withColumn("block", block).groupBy(*list_, "block").agg(
            F.count("*").alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest"), F.collect_list(F.struct("key", "tf", "len")).alias("entries"),
        )
        blocks.sortWithinPartitions("folder", "term", "slice", "block").drop("part").write.mode("overwrite").partitionBy("folder").parquet(f"{place}/postings")
        dealt = counts.withColumns({"folder": _folder("key"), "part": _part("key", parts)}).repartition("folder", "part")
        docs = dealt.groupBy("key", "folder", "part").agg(F.max("len").alias("len"), F.collect_list(F.struct("term", "tf")).alias("terms"))  # of one document
        docs.sortWithinPartitions("folder", "key").drop("part").write.mode("overwrite").partitionBy("folder").parquet(f"{place}/documents")
        n, total = counts.groupBy("key").agg(F.max("len").alias("len")).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return segment, n, total

    def append(self, counts: DataFrame, segment: str | None = None) -> None:
        """Add documents as rows (key, term, tf, len); keys that the index has are the caller's to leave out.

        segment: a name of the batch; a batch that is in the index already is not added again.
        """
        version, own = self.segments()
        segment = segment or uuid.uuid4().hex
        if any(s[0] == segment for s in own):
            return
        self._publish(version + 1, [*own, self._write(counts, segment)])

    def merge(self) -> None:
        """One segment in place of all."""
        version, own = self.segments()
        if len(own) < 2:
            return
        rows = self.documents().select("key", "len", F.explode("terms").alias("t")).select("key", "t.term", "t.tf", "len")
        self._publish(version + 1, [self._write(rows, uuid.uuid4().hex)])

    # -- Reading.

    def _table(self, name: str) -> DataFrame:
        paths = [f"{self.path}/segments/{s[0]}/{name}" for s in self.segments()[1] if s[1]]
        out = [self.spark.read.parquet(p) for p in paths]
        first = out[0]
        for more in out[1:]:
            first = first.unionByName(more)
        return first

    def postings(self) -> DataFrame:
        return self._table("postings")

    def documents(self) -> DataFrame:
        return self._table("documents")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Rows (query_id, key, score, rank): the k best by BM25 with a score above 0 for queries (query_id, term).

        Repeated terms count again; equal scores (to nine places) go by key. Steps that others read are written when this is called.
        """
        return self.explained(queries, k)[0]

    def explained(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(the result of search, rows (query_id, opened, entries): how many entries of how many a query's terms have were opened)."""
        n, total = (sum(s[i] for s in self.segments()[1]) for i in (1, 2))
        asked = staged(queries.groupBy("query_id", "term").agg(F.count("*").alias("times")))
        if not n:
            none = asked.limit(0).select("query_id", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
            return none, asked.limit(0).select("query_id", F.lit(0).alias("opened"), F.lit(0).alias("entries"))
        mean = F.lit(total / n)
        folders = [r[0] for r in asked.select(_folder("term").alias("f")).distinct().collect()]  # FOLDERS at most
        postings = self.postings().where(F.col("folder").isin(folders))
        heads = staged(postings.drop("entries", "folder").join(asked.select("term").distinct(), "term", "left_semi"))  # the entries stay closed
        raw = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = heads.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.when(raw > 0, raw).otherwise(FLOOR * F.ln(F.lit(2.0))).alias("idf"))
        weighed = staged(asked.join(idf, "term").withColumn("w", F.col("times") * F.col("idf")).select("query_id", "term", "w"))
        bounds = heads.join(weighed, "term").withColumn("bound", F.col("w") * weight(F.col("most"), F.col("shortest"), mean))
        bounds = staged(bounds.select("query_id", "term", "slice", "block", "n", "most", "shortest", "w", "bound"))

        def parts(blocks: DataFrame) -> DataFrame:
            """Rows (query_id, key, part) of the entries of blocks (query_id, w, entries)."""
            rows = blocks.select("query_id", "w", F.explode("entries").alias("e"))
            return rows.select("query_id", F.col("e.key").alias("key"), (F.col("w") * weight(F.col("e.tf"), F.col("e.len"), mean)).alias("part"))

        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "slice", "block")
        own = bounds.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= FIRST).select("query_id", "term", "slice", "block", "w").distinct()
        first = parts(postings.join(staged(own), ["term", "slice", "block"]))  # slices of one number in several segments open together
        partial = first.groupBy("query_id", "key").agg(F.sum("part").alias("least"))
        kth = Window.partitionBy("query_id").orderBy(F.desc("least"))
        reached = partial.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") == k).select("query_id", (F.col("least") - _SLACK).alias("reached"))
        of_term = bounds.groupBy("query_id", "term").agg(F.max("bound").alias("top"))
        upward = Window.partitionBy("query_id").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy("query_id")
        terms = of_term.withColumns({"up_to": F.sum("top").over(upward), "all": F.sum("top").over(every)}).join(reached, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))
        terms = staged(terms.withColumn("open", F.col("up_to") >= CLOSED * F.col("reached")))
        needed = bounds.join(terms.where("open").select("query_id", "term", "top", "all", "reached"), ["query_id", "term"])
        needed = needed.where(F.col("bound") + F.col("all") - F.col("top") >= F.col("reached"))
        closed = terms.groupBy("query_id", "reached").agg(F.coalesce(F.sum(F.when(~F.col("open"), F.col("top"))), F.lit(0.0)).alias("closed"))
        # a block that stays closed may hold one more part of a document that others open, so that its bound counts too
        shut = bounds.join(terms.where("open").select("query_id", "term", "top", "all", "reached"), ["query_id", "term"]).where(F.col("bound") + F.col("all") - F.col("top") < F.col("reached"))
        shut = shut.groupBy("query_id", "term").agg(F.max("bound").alias("shut")).groupBy("query_id").agg(F.sum("shut").alias("shut"))
        limit = closed.join(shut, "query_id", "left").select("query_id", "reached", (F.col("closed") + F.coalesce("shut", F.lit(0.0))).alias("more"))
        # the same rule for the blocks themselves, where they are read: which of them a query needs follows from what it has of each term
        asks = staged(weighed.join(terms.where("open").select("query_id", "term", (F.col("all") - F.col("top")).alias("others"), "reached"), ["query_id", "term"]))
        read_now = postings.join(asks, "term").where(F.col("w") * weight(F.col("most"), F.col("shortest"), mean) + F.col("others") >= F.col("reached"))
        seen = parts(read_now).groupBy("query_id", "key").agg(F.sum("part").alias("part")).join(limit, "query_id")
        seen = staged(seen.where(F.col("part") + F.col("more") >= F.col("reached")).select("query_id", "key", "part", "more"))
        # what was read is nearly the score, so that its kth is a far higher threshold than that of the first blocks
        nearly = Window.partitionBy("query_id").orderBy(F.desc("part"))
        kth_part = seen.withColumn("nth", F.row_number().over(nearly)).where(F.col("nth") == k).select("query_id", (F.col("part") - _SLACK).alias("now"))
        left = seen.join(kth_part, "query_id", "left").where(F.col("part") + F.col("more") >= F.coalesce("now", F.lit(0.0)))
        left = staged(left.select("query_id", "key"))
        keys = [r[0] for r in left.select(_folder("key").alias("f")).distinct().collect()]  # FOLDERS at most
        docs = self.documents().where(F.col("folder").isin(keys)).select("key", "len", "terms")
        opened_up = lambda x, *by: x.select(*by, "key", "len", F.explode("terms").alias("t")).select(*by, "key", "len", "t.*")
        entries = bounds.agg(F.sum("n")).first()[0] or 0
        if left.count() * total <= 4 * n * entries:  # rows that are looked up where they are, against all entries of the queries' terms, which are moved
            each = opened_up(left.join(docs, "key"), "query_id").join(weighed, ["query_id", "term"])
        else:  # a document's terms once for all queries
            each = opened_up(docs.join(left.select("key").distinct(), "key", "left_semi")).join(weighed, "term").join(left, ["query_id", "key"], "left_semi")
        scored = each.groupBy("query_id", "key").agg(F.sum(F.col("w") * weight(F.col("tf"), F.col("len"), mean)).alias("score")).where("score > 0")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "key", "score", "rank")
        read = needed.groupBy("query_id").agg(F.sum("n").alias("opened"))
        told = bounds.groupBy("query_id").agg(F.sum("n").alias("entries")).join(read, "query_id", "left").select("query_id", F.coalesce("opened", F.lit(0)).alias("opened"), "entries")
        return ranked, told
