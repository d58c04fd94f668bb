"""Tables that Spark sizes far too low are not broadcast."""

from prospectra.llm import simhash


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(200).selectExpr("xxhash64(id) fp").union(spark.range(200).selectExpr("xxhash64(id) ^ 5 fp")).write.parquet(str(tmp_path / "fp"))
    edges = simhash.link_fingerprints(spark.read.parquet(str(tmp_path / "fp")))
    assert joins(edges) == (0, 2)  # the cells of small keys and those of large ones
    assert {tuple(sorted(r)) for r in edges.collect()} == {tuple(sorted(r)) for r in spark.range(200).selectExpr("xxhash64(id) a", "xxhash64(id) ^ 5 b").collect()}


def test_the_near_duplicates_of_the_pipeline_have_no_broadcast_keys(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    seen, link = [], simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda distinct: [seen.append(joins(link(distinct))), link(distinct)][1])
    docs = spark.range(40).selectExpr("id doc_id", "concat('some words of document number ', id % 30) text")
    docs.write.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    assert 0 < kept.count() <= 30 and seen == [(0, 2)]
