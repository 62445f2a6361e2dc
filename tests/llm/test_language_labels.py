from promptquarry.llm import language_id


def test_frequent_labels_stay_among_many_rare_ones(spark):
    rows = [(f"rare text {i}", f"x{i}") for i in range(4200)] + [(f"plain text {i}", "en") for i in range(1000)]
    got = {r["l"]: r["count"] for r in language_id.sampled(spark.createDataFrame(rows, "t string, l string"), 400).groupBy("l").count().collect()}
    assert len(got) == 4201 and 300 < got["en"] < 500


def test_empty_partitions_and_any_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"some words of number {i}", "en", "web") for i in range(20)], "doc_id long, text string, lang string, source string")
    wide = rows.coalesce(1).unionByName(rows.limit(0)).withColumns({c: F.lit("own") for c in ("k", "h", "hs", "s", "sp", "c", "m", "n", "own", "all", "l", "t")})
    got = language_id.identify(language_id.document_evidence(wide))
    assert got.count() == 20 and got.columns[:-2] == wide.columns and got.filter("hs = 'own'").count() == 20
    assert language_id.identify(language_id.document_evidence(rows.filter("doc_id < 0"))).count() == 0
