from loomvault.sources import projection


def test_paths_stay_unique_beyond_six_digits(spark, tmp_path):
    ids = [7, 100000, 999999, *range(1000000, 1000010), 12345678]
    spark.createDataFrame([(i, "text", "en", "src") for i in ids], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    paths = {r["doc_id"]: r["path"] for r in projection.vault(spark, str(tmp_path)).select("doc_id", "path").collect()}
    assert paths == {i: f"src/en/doc{i:06d}.md" for i in ids}
