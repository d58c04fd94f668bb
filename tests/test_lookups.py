"""Lookup tables in versions and by measured size; hiring signals of hand-written pages."""

import pytest
from pyspark.sql import functions as F

from prospectra.operators import hiring
from prospectra.sources import lookups


def test_versions_and_keys(spark, tmp_path):
    folder = str(tmp_path)
    schema = "code string, state string, city string"
    lookups.write_lookup(spark.createDataFrame([("305", "FL", "Miami")], schema), folder, "areas", 1)
    lookups.write_lookup(spark.createDataFrame([("305", "FL", "Miami Beach"), ("305", "FL", "Key West"), (None, "X", "X"), ("212", "NY", "New York")], schema), folder, "areas", 3)
    read = lambda v=None: sorted(tuple(r) for r in lookups.read_lookup_table(spark, folder, "areas", "code", v).collect())
    assert read(1) == read(2) == [("305", "FL", "Miami")]
    assert read() == read(9) == [("212", "NY", "New York"), ("305", "FL", "Key West")]
    with pytest.raises(ValueError, match="no version of areas"):
        read(0)
    lookups.write_lookup(spark.createDataFrame([("1", "A", "B")], schema), folder, "areas", 3)
    assert read() == [("1", "A", "B")]
    spark.createDataFrame([("7", "x;y")], "id string, name string").coalesce(1).write.option("header", True).csv(f"{folder}/index/version=1")
    assert [r.name for r in lookups.read_lookup_table(spark, folder, "index", "id", kind="csv", header="true").collect()] == ["x;y"]


def test_size_decides_the_join(spark):
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(50)] + [(99, None)], "id int, key string")
    table = spark.createDataFrame([(f"k{i}", "v" * 100) for i in range(5)], "key string, value string")
    assert 5 * 102 <= lookups.measured_bytes(table) <= 5 * 130
    small, large = lookups.look_up(rows, table, "key"), lookups.look_up(rows, table, "key", limit=100)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small) and "strategy=merge" in plan(large).lower().replace(" ", "")
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.count() == 51
    assert lookups.measured_bytes(table.where("false")) == 0


def test_places_of_phones(spark):
    areas = spark.createDataFrame([("305", "FL", "Miami"), ("212", "NY", None)], "area_code string, state string, city string")
    rows = spark.createDataFrame([(1, "+1 (305) 555-0199"), (2, "212.555.0100"), (3, "9995550100"), (4, "555-0100"), (5, None), (6, "2-305-555-0199")], "id int, phone string")
    got = {r.id: r for r in lookups.locate_phones(rows, areas).collect()}
    assert got[1].phone_forms.asDict() == {"e164": "+13055550199", "national": "(305) 555-0199", "dashed": "305-555-0199", "digits": "3055550199", "dotted": "305.555.0199", "compact": "305 555 0199", "area_code": "305"}
    assert [(got[i].state, got[i].city) for i in range(1, 7)] == [("FL", "Miami"), ("NY", ""), ("", ""), (None, None), (None, None), (None, None)]


def test_hiring_signals(spark):
    html = (
        "<script src='https://boards.greenhouse.io/embed.js'></script><iframe src=https://x.Breezy.HR/y></iframe><a href='https://jobs.lever.co/a'>Apply</a><a href=/team>We have openings</a><a href=/careers>Careers</a><a href=/jobs/4>4</a>"
        "<p>React or ReactJS? Frontend Engineer wanted; Kubernetes.</p><script>laravel</script>"
    )
    pages = spark.createDataFrame([(1, "u", html, "t"), (2, "u", "<p>greenhouse.io and a wordpresser</p>", "t"), (3, "u", None, "t"), (4, "u", "", "t")], "page_id int, url string, html string, type string")
    got = {r.type: r for r in hiring.hiring_signals(pages).collect()}
    assert {t: (r.page_id, r.confidence) for t, r in got.items()} == {"hiring_ats_detected": (1, 0.95), "career_page_detected": (1, 0.90), "hiring_skill_match": (1, 0.85)}
    assert got["hiring_ats_detected"].detail.ats_platforms == ["breezy", "greenhouse", "lever"]
    assert [tuple(x) for x in got["career_page_detected"].detail.career_links] == [("Apply", "https://jobs.lever.co/a"), ("We have openings", "/team"), ("Careers", "/careers")]
    assert [tuple(x) for x in got["hiring_skill_match"].detail.matched_skills] == [("angular", 1, "Frontend Engineer"), ("react", 3, "React"), ("devops", 1, "Kubernetes")]
    rows = hiring.hiring_skills(hiring.hiring_signals(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10))).withColumn("company_id", F.lit(7)))
    assert sorted(tuple(r) for r in rows.collect()) == [(7, "angular", 2, "Frontend Engineer"), (7, "devops", 2, "Kubernetes"), (7, "react", 6, "React")]
