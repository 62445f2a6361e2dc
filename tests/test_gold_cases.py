"""Gold cases take their texts without a shuffle by project."""

from promptquarry.operators import evaluation


def test_gold_cases_shuffle_no_texts_by_project(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, f"text {i}") for i in range(30)], "prompt_id long, project_id long, content string")
    rows.write.parquet(str(tmp_path / "prompts"))
    pairs = spark.createDataFrame([(i, "manual" if i % 2 else "llm", i, "files", "which?") for i in range(30)], "pair_id long, extraction_method string, originating_prompt_id long, clarification_kind string, clarification_text string")
    # as derived from the prompts, projects are an aggregate
    projects = rows.select("project_id").distinct().selectExpr("project_id", "IF(project_id = 1, 'own-tool', 'other') AS name", "CAST(NULL AS STRING) AS cwd")
    cases = evaluation.gold_cases(pairs, spark.read.parquet(str(tmp_path / "prompts")), projects)
    assert sorted(r["case_id"] for r in cases.collect()) == [i for i in range(30) if i % 2 and i % 3 != 1]
    assert "hashpartitioning(project_id" not in cases._jdf.queryExecution().executedPlan().toString()
