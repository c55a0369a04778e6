"""URL filters: rules by hand, and reputation against the SQL oracle."""

import random

import duckdb
import pytest

from memlake.llm import url_filter as u

PAGES = [
    (1, "http://EXAMPLE.net/en/x?y"), (2, "https://a.example.net/de/"), (3, "https://net"), (4, "http://foonet/"), (5, "http://x.org/fr/a#b"), (6, "http://example.com/de/1"),
    (7, "example.com/de/1"), (8, None), (9, ""), (10, "a://b://c/d"), (11, "http://example.com/DE/1"), (12, "http://u:p@Shop.Co.UK:80/q"), (13, "http://"), (14, "http://?q"), (None, "http://a.b.c/"),
]


@pytest.fixture
def frames(spark):
    r = random.Random(1)
    bad = {"bad.example.com": 0.97, "www.good.org": 0.02, "shop.co.uk": 0.9, "x.mixed.io": 0.5}
    rows, labels = list(PAGES), []
    for i in range(20, 900):
        h = r.choice(list(bad))
        rows.append((i, f"https://{h}/p{i}"))
        if r.random() < 0.6:
            labels.append((i, int(r.random() > bad[h]), None))
    rows += [rows[-1], (2000, "http://new.bad.example.com/"), (2001, "http://unseen.zzz/")]
    labels += [(20, 0, 0), (20, 1, 1), (None, 0, 0), (99999, 0, 1), (21, None, None)]
    return rows, labels


def test_against_oracle(spark, frames, tmp_path):
    rows, labels = frames
    spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = u.op7_url_filter(spark, str(tmp_path))
    got = sorted((tuple(x) for x in out.collect()), key=str)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(u.ORACLE).fetchall(), key=str)
    by = {x[0]: x for x in got}
    assert by[1][1:] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert by[2][3:] == ("net/", "block") and by[3][3] is None and by[4][3] is None
    assert by[5][3:] == ("org/fr/", "allow") and by[6][3:] == ("example.com/de/", "block")
    assert by[7][1:4] == ("", "", None) and by[8][1:] == ("", "", None, "allow")
    assert by[10][1:3] == ("b:", "//c/d") and by[11][3] is None
    assert by[12][1] == "u:p@shop.co.uk:80" and by[12][4] == "block"
    hosts = {x[1]: x[4] for x in got}
    assert hosts["bad.example.com"] == "block" and hosts["www.good.org"] == "allow"


def test_empty_tables(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert u.filter_urls(pages, none).where("rule is null and verdict = 'block'").count() == 0
    assert u.filter_urls(pages.limit(0), none).count() == 0


def test_native_plan(spark, frames):
    rows, labels = frames
    out = u.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("doc_id page_id", "1 - quality bad"))
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
