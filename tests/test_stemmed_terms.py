from pyspark.sql import functions as F

from loomvault.functions import stemming, text
from loomvault.plans import queries

TEXTS = [("en", "The running foxes were running"), ("de", "Die Häuser und die Hunde"), (None, "der Hund und das Haus ist nicht"), ("", "the running of the foxes"), (None, "nothing known"), ("fr", "les maisons"), ("en", None), (None, ""), (None, "le the der la of und")]


def test_languages_are_told_alike(spark):
    rows = spark.createDataFrame(TEXTS, "lang string, text string").select(text.naive_tokens(F.col("text")).alias("t")).filter("t is not null")
    for r in rows.select("t", stemming.detected(F.col("t")).alias("lang")).collect():
        assert r["lang"] == stemming.detect(r["t"]), r["t"]


def test_words_are_counted_before_they_go_to_python(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TEXTS)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["stemmed_terms"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :]
    assert "Aggregate" in below and plan.count("ArrowEvalPython") == 1
    want = docs.select("lang", F.explode(stemming.stem_tokens(F.col("text"), F.col("lang"))).alias("term")).groupBy("lang", "term").count()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
