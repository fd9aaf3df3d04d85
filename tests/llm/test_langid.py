"""Language identification: held-out accuracy, rejection and odd rows."""

from pyspark.sql import functions as F

from sightline.llm.langid import identify
from sightline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op7_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300)
    odd = [(-1, None, "en"), (-2, "", None), (-3, "123 ²³ ### \n", "de"), (None, "The and of", "en"), (-4, "漢字かな" * 400, None), (-5, "ЖЩЪЫ " * 400, "en"), (-6, "a", None), (-6, "a", None), (-7, "the and of " * 30_000, None)]
    extra = spark.createDataFrame([(*r, "clash") for r in odd], "doc_id long, text string, lang string, score string")
    both = docs.withColumn("score", F.lit("clash")).unionByName(extra)
    got = identify(both, is_training=F.col("doc_id") >= 0)
    assert got.columns == ["doc_id", "lang", "lang_pred", "score", "rejected"]
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is None or r.doc_id < 0}
    assert got.count() == 300 + len(odd)
    for k in (-1, -2, -3):
        assert (rows[k].lang_pred, rows[k].score, rows[k].rejected) == ("und", 0.0, True)
    assert rows[-4].rejected and rows[-5].rejected and rows[-4].lang_pred != "und"
    assert rows[None].lang_pred == "en" and rows[-7].lang_pred == "en" and rows[-6].lang_pred != "und"


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in identify(docs, F.lit(True)).collect()] == [("und", 0.0, True)]
    assert identify(docs.limit(0), F.lit(True)).collect() == []
