from pyspark.sql import functions as F

from vellum.functions.text import sentences
from vellum.operators import parse
from vellum.plans import engine
from vellum.plans.sql import register, views

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_table_functions_equal_the_operators(spark):
    register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, " a. b!  c"), (-4, "fx\r\n\r\ny\n \nz\f f")], "doc_id long, text string"),
    )
    docs.createOrReplaceTempView("vellum_docs")
    got = spark.sql("SELECT d.doc_id, s.* FROM vellum_docs d, LATERAL vellum_sentences(d.text) s")
    same(got, docs.select("doc_id", F.posexplode(sentences("text")).alias("ord", "sentence")))
    same(spark.sql("SELECT d.doc_id, b.* FROM vellum_docs d, LATERAL vellum_blocks(d.text) b"), parse.blocks(docs, "doc_id"))
    same(spark.sql("SELECT d.doc_id, c.chunk, c.piece FROM vellum_docs d, LATERAL vellum_chunks(d.text, 800, 100) c"), parse.fixed_chunks(docs, "doc_id").select("doc_id", "chunk", "piece"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Python" not in plan


def test_a_corpus_as_views(spark):
    c = engine.parse_texts(spark.createDataFrame([(1, "1 Раз\n\nслова\n\nРисунок 1 — Вид"), (2, "текст")], "doc_id long, text string"))
    assert set(views(c, "c_")) == {"c_docs", "c_sections", "c_paragraphs", "c_figures", "c_tables"}
    rows = spark.sql("SELECT s.title, f.caption FROM c_sections s JOIN c_figures f USING (doc_id)").collect()
    assert [tuple(r) for r in rows] == [("Раз", "Рисунок 1 — Вид")]
