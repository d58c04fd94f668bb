"""Queries on texts that Java's patterns read otherwise than the SQL does."""

import duckdb

from prospectra.operators import page_parts
from prospectra.plans import catalog, catalog_parts  # noqa: F401  the second adds to the first


def both(spark, name, folder):
    """Rows of the query and of its SQL over the tables of a folder."""
    got = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
    con.execute(f"create table want as {catalog.ORACLE[name]}")
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from want").fetchall()
    return sorted(map(str, map(tuple, got.select(*columns).collect()))), sorted(map(str, want))


def test_replies_with_letters_and_spaces_outside_ascii(spark, tmp_path):
    texts = ["éyes", "yesé", "é yes é", "passé", "no\x0bthanks", "no thanks", "no \t\f\r\nthanks", "İNTERESTED", "K oḱ", "٣sure", "unsubscribe‍", "_yes", "yes1", "ΣOK", "", None]
    spark.createDataFrame([(i, 7, "user", t) for i, t in enumerate(texts)] + [(50, 1, None, "x"), (51, 2, "é", "yes")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = both(spark, "classify_reply", tmp_path)
    assert got == want and len({r.split(", ", 1)[0] for r in got}) > 3


def test_contacts_go_by_place_and_sentences_end(spark, tmp_path):
    htmls = [
        "<title>Text first b.09@mail5.example.</title>", "<h1>Cut olkdi.18@mail8.</h1><p>That is all</p>", "<title>x a.1@mail4.example.co</title>", "<p>c.2@mail4.examp</p>", "<p>f@g.org. Yes</p>",
        "", "<p>z@z.org</p>", "<h1>l@m.org</h1>",
    ]
    spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, "site_contacts", tmp_path)
    assert got == want and len(got) > 7


def test_addresses_written_out_in_a_sentence():
    html = "mail <a href='mailto:x@y.org'>me@here.org</a> or bob @ site . com, Jo [at] a[dot]org; at q@mail8. That, ann(at)b.net<script type='application/ld+json'>{\"email\": \"data@d.org\"}</script>end@e.org"
    got = [(kind, address) for _, kind, address, _ in page_parts.PageAddresses().eval(html)]
    assert got == [
        ("mailto", "x@y.org"), ("text", "me@here.org"), ("written_out", "me@here.org"), ("written_out", "bob@site.com"), ("written_out", "Jo@a.org"), ("written_out", "ann@b.net"), ("data", "data@d.org"), ("text", "end@e.org"),
        ("written_out", "end@e.org"),
    ]
    assert not list(page_parts.PageAddresses().eval(None)) and not list(page_parts.PageAddresses().eval(""))
