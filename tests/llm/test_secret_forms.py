import random
import string

from pyspark.sql import functions as F

from promptquarry.llm import secrets


def test_random_letters_are_secrets_and_words_are_not(spark):
    r = random.Random(5)
    keys = ["".join(r.choices(string.ascii_letters, k=k)) for k in (20, 24, 32, 40) for _ in range(50)]
    keys += ["".join(r.choices(string.ascii_letters, k=32)) + "42" for _ in range(50)]
    names = ["quarterly_report_generator_settings", "MAX_RETRY_COUNT_FOR_UPLOADS", "Some-Kebab-Title-Of-Words", "path/to/some/module/file_name", "release-candidate-build-2024", "-" * 30, "=" * 20 + "Heading"]
    df = spark.createDataFrame([(v,) for v in keys + names], "v string").select("v", secrets.is_secret(F.col("v")).alias("s"))
    got = {r["v"]: r["s"] for r in df.collect()}
    assert sum(got[k] for k in keys) >= 0.95 * len(keys)
    assert not any(got[n] for n in names)
