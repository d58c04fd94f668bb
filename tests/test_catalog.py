"""Every query of the catalog that has SQL gives the rows of that SQL on the smallest tables, and not a constant."""

import duckdb
import pandas as pd
import pytest

from prospectra.plans import catalog, catalog_flow, catalog_leads, catalog_pages, catalog_parts, catalog_rest, catalog_site, catalog_sources, catalog_staging, catalog_streams  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Queries whose result is one row or may be empty on so few rows.
FEW = {"retry_counts", "run_summary", "key_subpages", "outreach_ready_count", "page_contacts", "extract_emails"}


#: Queries that aggregate or break ties, run on ten times the rows too: the smallest tables have few ties.
LARGER_FOLDER = "/root/testdata/sf0.01"
LARGER = [
    "classify_probe", "conversion_metrics", "assemble_audit", "stage_anomalies", "alert_cooldown", "bounce_actions", "ingest_candidates", "stage_messages", "best_website", "link_health", "site_contacts", "find_company_by_name",
    "attach_bounce_context", "outreach_eligible",
]


def connected(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(FOLDER)


@pytest.fixture(scope="module")
def larger_duck():
    return connected(LARGER_FOLDER)


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return None
        if isinstance(x, bool) or str(type(x)).find("bool") >= 0:
            return str(bool(x))
        try:
            return f"{float(x):.6f}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    return sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    if name not in FEW:
        assert len(set(rows(got))) > 1


@pytest.mark.parametrize("name", LARGER)
def test_matches_sql_on_more_rows(spark, larger_duck, name):
    assert rows(catalog.QUERIES[name](spark, LARGER_FOLDER).toPandas()) == rows(larger_duck.sql(catalog.ORACLE[name]).df())


def test_no_query_without_operator():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
