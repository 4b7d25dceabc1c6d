from pyspark.sql import functions as F

from vellum.sources.folder import registered
from vellum.sources.loaders import Registry, read_json, read_text
from vellum.streaming.incremental import entity_stream


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_directory(spark, tmp_path):
    put(tmp_path / "a" / "one.txt", "текст")
    put(tmp_path / "two.md", "intro\n# A\nbody\n# B\n\n# C\nc")
    put(tmp_path / "three.json", '[{"text": "x", "id": "k", "lang": "ru"}, {"text": ""}, {"text": "y"}]')
    put(tmp_path / "four.xyz", "no")
    got = {r.doc_id: r.text for r in Registry().load_directory(spark, str(tmp_path)).select("doc_id", "text").collect()}
    assert got == {"one": "текст", "two_section_0": "intro", "two_section_1": "body", "two_section_2": "c", "k": "x", "three_2": "y"}


def test_json_options_and_encoding(spark, tmp_path):
    put(tmp_path / "d.json", '{"body": "z", "key": "7", "lang": "ru"}')
    r = read_json(spark, str(tmp_path / "d.json"), "body", "key", ("lang",)).first()
    assert (r.doc_id, r.text, r.lang) == ("7", "z", "ru")
    put(tmp_path / "old" / "c.txt", "привет", "cp1251")
    assert read_text(spark, str(tmp_path / "old"), "windows-1251").first().text == "привет"


def test_registered_reader(spark, tmp_path):
    put(tmp_path / "x.log", "l1")
    g = Registry()
    g.register(".log", lambda s, p: read_text(s, p).withColumn("text", F.upper("text")))
    assert g.load(spark, str(tmp_path / "x.log")).first().text == "L1"


def test_stream_of_entities(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha beta Gamma"), (2, "Gamma")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    entity_stream(s, "doc_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(
        (r.doc_id, r.entity) for r in spark.read.parquet(str(tmp_path / "out")).collect()
    ) == [(1, "Alpha"), (1, "Gamma"), (2, "Gamma")]


def backwards(content):
    return content.decode()[::-1], None


def test_mixed_folder(spark, tmp_path):
    for n in range(20):
        put(tmp_path / f"d{n % 3}" / f"{n}.txt", f"text {n}")
    put(tmp_path / "x.html", "<p>")
    put(tmp_path / "y.LOG", "abc")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "bad.docx").write_bytes(b"x")
    put(tmp_path / "_part", "no")
    read = registered(spark).read.format("mixed_folder").option("splitBytes", 30).option("reader.log", "tests.test_sources:backwards").load(str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert len(rows) == 24 and rows["3.txt"].text == "text 3" and rows["y.LOG"].text == "cba"
    assert rows["bad.md"].error and rows["bad.docx"].error and rows["bad.md"].text is None
    some = read.where("suffix IN ('.txt', '.log') AND size > 3")
    assert some.count() == 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "suffix" not in plan.split("Filter", 1)[1].split("\n")[0]  # the size is left to Spark, the suffix isn't
    assert read.rdd.getNumPartitions() > 3
    assert read.where("suffix = '.none'").count() == 0


def test_mixed_folder_as_a_stream(spark, tmp_path):
    put(tmp_path / "in" / "a.txt", "one")
    s = lambda: registered(spark).readStream.format("mixed_folder").option("suffixes", ".txt").load(str(tmp_path / "in"))
    go = lambda: s().select("path", "text").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    go()
    put(tmp_path / "in" / "b.txt", "two")
    put(tmp_path / "in" / "c.md", "no")
    go()
    assert sorted(r.text for r in spark.read.schema("path string, text string").parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_registry_in_keyed_state(spark, tmp_path):
    """Bridges at two documents, retracted at eleven; repeated documents and a second run of a batch change nothing."""
    from vellum.streaming import incremental as I

    r = [(i, "Alpha " + ("Beta " if i < 2 else "") + ("Gamma" if i < 10 else "")) for i in range(12)]
    for n, rows in enumerate((r[:1], r[1:6], r[:3], r[6:])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    s = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    I.registry_stream(s, "doc_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    e = spark.read.parquet(str(tmp_path / "out"))
    assert {(x.entity, x.df) for x in I.registry_now(e).collect()} == {("Alpha", 12), ("Beta", 2), ("Gamma", 10)}
    assert {(x.entity, x.df) for x in I.bridges_now(e).collect()} == {("Beta", 2), ("Gamma", 10)}
    assert [x.event for x in e.where("entity = 'Alpha' and event is not null").orderBy("batch").collect()] == ["bridge", "retracted"]


def test_streamed_documents_keep_their_partitions(spark, tmp_path, monkeypatch):
    """No task writes or reads a whole folder of documents."""
    from vellum.plans import engine_queries as E

    rows = [(i, ('Alpha', 'Beta', 'Gamma')[i % 3] + ' text') for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(E, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = {r.entity: r.df for r in E._registry_streamed(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"Alpha": 14, "Beta": 13, "Gamma": 13}
    assert len(spark.read.parquet(f"{tmp_path}/stream/in/0").inputFiles()) > 1
