import datetime
import random

from provenio.sources.pages import register
from provenio.sources.store import answered, answered_once, append, delete_documents, documents, latest, replace_documents
from provenio.streaming import lessons
from provenio.streaming.traces import accepted_once, append_stream, hourly

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(source))
    stream = hourly(spark.readStream.schema(events.schema).parquet(str(source)), "2 hours")
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hours").count() == hourly(events).count()


def test_files_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a.pdf", b"%PDF-1", day), ("b.pdf", b"%PDF-1", day), ("c.gif", b"GIF", day), ("d.pdf", b"%PDF-2", day)]
    files = spark.createDataFrame(rows, "name string, content binary, arrived_at timestamp")
    files.write.parquet(str(tmp_path / "in"))
    stream = accepted_once(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")))
    query = append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_store(spark, tmp_path):
    rows = lambda v, t: spark.createDataFrame([("d", "m", v, t)], "doc_id string, mode string, v int, created_at int")
    for v in (1, 2):
        append(rows(v, v), str(tmp_path / "facts"), "doc_id")
    assert [r.v for r in latest(spark, str(tmp_path / "facts"), ["doc_id", "mode"]).collect()] == [2]
    prompts = spark.createDataFrame([(1, "s", "u"), (2, "s", "u"), (3, "s", "w")], "prompt_id int, system string, user string")
    cache = spark.createDataFrame([], "key string, answer string")
    got = answered(prompts, cache, lambda: lambda s, u: s + u).orderBy("prompt_id").collect()
    assert [r.answer for r in got] == ["su", "su", "sw"]


class Counting:
    """A provider that leaves a line for each prompt that it is asked."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        def ask(system, user):
            with open(self.path, "a") as f:
                f.write(user + "\n")
            return system + user

        return ask


def test_answers_are_asked_once(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "s", "u"), (2, "s", "u"), (3, "s", "w"), (4, "s", None)], "prompt_id int, system string, user string")
    log = tmp_path / "asked"
    got = answered_once(prompts, str(tmp_path / "cache"), Counting(str(log)), wave=1)
    for _ in range(2):  # two actions, and a restart
        assert sorted((r.prompt_id, r.answer) for r in got.collect()) == [(1, "su"), (2, "su"), (3, "sw"), (4, None)]
    got = answered_once(prompts.union(spark.createDataFrame([(5, "s", "x")], prompts.schema)), str(tmp_path / "cache"), Counting(str(log)))
    assert {r.prompt_id: r.answer for r in got.collect()}[5] == "sx"
    assert sorted(log.read_text().split()) == ["u", "w", "x"]


def test_replaced_and_deleted_documents(spark, tmp_path):
    path, lines = str(tmp_path / "docs"), str(tmp_path / "lines")
    rows = lambda *x: spark.createDataFrame(x, "doc_id long, v string")
    held = lambda p: sorted(((r.doc_id, r.v) for r in documents(spark, p).collect()), key=str)
    replace_documents(rows(*((i, "a") for i in range(200)), (None, "a")), path)
    replace_documents(rows(*((i % 200, str(i)) for i in range(400))), lines)
    untouched = {f for f in (tmp_path / "docs").rglob("*.parquet")}
    for _ in range(2):
        replace_documents(rows((3, "b"), (3, "c"), (None, "b"), (999, "n")), path)
    assert held(path) == sorted([*((i, "a") for i in range(200) if i != 3), (3, "b"), (3, "c"), (None, "b"), (999, "n")], key=str)
    assert len(untouched & {f for f in (tmp_path / "docs").rglob("*.parquet")}) >= 60  # the other folders
    delete_documents(spark.createDataFrame([(i,) for i in range(200)], "doc_id long"), path, lines)
    delete_documents(spark.createDataFrame([(7,)], "doc_id long"), path, lines)
    assert held(path) == [(999, "n"), (None, "b")] and held(lines) == []
    replace_documents(rows((7, "again")), lines)
    assert held(lines) == [(7, "again")]


def test_pages_of_files_batch_and_stream(spark, tmp_path):
    register(spark)
    folder = tmp_path / "in"
    assert spark.read.format("document_pages").option("path", str(folder)).load().count() == 0
    folder.mkdir()
    for i in range(7):
        (folder / f"{i:02}.txt").write_text("eins\nzwei\n" if i else "")
    (folder / "_ignored").write_text("x")
    read = spark.read.format("document_pages").option("path", f"file://{folder}").option("files", "3").load()
    assert read.rdd.getNumPartitions() == 3 and read.count() == 12
    assert {(r.page_no, r.text) for r in read.collect()} == {(1, "eins"), (2, "zwei")} and read.select("doc_id").distinct().count() == 1
    other = spark.read.format("document_pages").option("path", str(folder)).option("reader", "tests.test_streams:whole").load()
    assert other.count() == 7 and {r.method for r in other.collect()} == {"whole"}
    stream = spark.readStream.format("document_pages").option("path", str(folder)).load()

    def run():
        query = append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 12
    (folder / "99.txt").write_text("drei")
    assert run() == 13 == run()


def whole(content):
    return [(content.decode(), "whole", 0.5)]


def test_newest_lessons_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"d{rng.randint(0, 3)}", f"f{rng.randint(0, 2)}", f"l{i}", str(i), "q", 1, day + datetime.timedelta(hours=rng.randint(0, 9))) for i in range(60)]
    rows += [rows[3], (None, "f", "x", "v", "q", 1, day), ("d", "f", "x", "v", "q", 1, None)]
    schema = "doc_id string, field_id string, lesson_id string, value string, quote string, page int, created_at timestamp"
    want = {(r.doc_id, r.field_id): (r.lesson_id, r.value) for r in lessons.newest(spark.createDataFrame(rows, schema)).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for turn in range(2):
            rng.shuffle(rows)
            source, seen = tmp_path / f"in{turn}", {}

            def keep(batch, _, seen=seen):
                seen.update({(r.doc_id, r.field_id): (r.lesson_id, r.value) for r in batch.collect()})

            for part in range(3):
                spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(source))
                stream = lessons.newest_stream(spark.readStream.schema(schema).parquet(str(source)))
                query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / f"ck{turn}")).start()
                query.processAllAvailable()
                query.stop()
            assert seen == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
