"""URL filters against SQL and against PageRank by hand."""

import random
from fractions import Fraction

import duckdb
import pytest

from heatgraph.llm import urls


def made(seed: int = 3, n: int = 400):
    rng = random.Random(seed)
    hosts = [f"{a}{i}.{d}" for i in range(8) for a in ("", "www.") for d in ("example.org", "x.com", "y.net", "de", "EXAMPLE.Org")] + ["example.org", "org", "com", "notorg", "x.net:80"]
    rows = []
    for i in range(n):
        url = f"http://{rng.choice(hosts)}{rng.choice(['/fr/1', '/de/x', '/es/1', '/en/12', '/en/2', '', '/', '?q', '#t/fr/'])}"
        url = None if i % 50 == 0 else "nothing" if i % 50 == 1 else url
        links = " ".join(f"<a {rng.choice(['href', 'HREF '])}={rng.choice([chr(34), chr(39), ''])}{rng.choice(['http://', '//', 'https://', '/'])}{rng.choice(hosts)}/a>" for _ in range(rng.randint(0, 3)))
        rows.append((i // 2, url, None if i % 70 == 0 else links))
    for k in range(6):
        rows += [(1000 + k, f"http://bad{k}.com/de/1", None), (1100 + k, f"http://farm{k}.net/a", f"<a href=http://bad{k}.com/de/1>")]
    return rows


def rows_of(found):
    return sorted(tuple("" if x is None else x for x in (r.page_id, r.host, r.path, r.rule, r.verdict)) for r in found.collect())


SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize("source", ["given", "made"])
def test_sql(spark, sf, source, tmp_path):
    path = f"{sf}/pages.parquet"
    if source == "made":
        path = str(tmp_path / "pages.parquet")
        spark.createDataFrame(made(), SCHEMA).toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}'")
    want = sorted(tuple("" if x is None else x for x in r) for r in con.execute(f"select page_id, host, path, rule, verdict from ({urls.sql()})").fetchall())
    got = rows_of(urls.judged_urls(spark.read.parquet(path)))
    assert got == want
    if source == "made":
        assert {r[4] for r in got if not r[3]} == {"allow", "block"}


def test_rules_by_join_are_those_by_row(spark):
    pages = urls.parted(spark.createDataFrame(made(5), SCHEMA))
    few = urls.ruled(pages, urls.RULES)
    many = urls.ruled(pages, spark.createDataFrame(urls.RULES, "verdict string, host string, path string"))
    key = lambda r: tuple("" if x is None else x for x in (r.page_id, r._host, r._path, r._rule, r._said))
    assert sorted(map(key, few.collect())) == sorted(map(key, many.collect()))
    assert urls.ruled(pages, []).where("_rule is not null or _said is not null").isEmpty()


def test_masses_by_hand(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 3), ("e", "d", 1)]
    start = {("allow", "a"): urls.UNIT, ("block", "c"): urls.UNIT // 2}
    rounds = 12
    got = {(r.kind, r.host): r.mass for r in urls.spread(spark.createDataFrame([(k, h, m) for (k, h), m in start.items()], "kind string, host string, mass bigint"), spark.createDataFrame(edges, "src string, dst string, n bigint"), rounds).collect()}
    for kind, ways in (("allow", edges), ("block", [(b, a, n) for a, b, n in edges])):
        now = {h: Fraction(m) for (k, h), m in start.items() if k == kind}
        for _ in range(rounds):
            after = {h: Fraction(m) for (k, h), m in start.items() if k == kind}
            for a, b, n in ways:
                total = sum(x for u, _, x in ways if u == a)
                after[b] = after.get(b, Fraction(0)) + now.get(a, Fraction(0)) * n * Fraction(urls.DAMPING, 100) / total
            now = after
        for host, mass in now.items():
            assert abs(got.get((kind, host), 0) - mass) < 100  # shares are rounded down


def test_links_decide_for_hosts_without_rules(spark):
    good, bad = "http://ok.org/", "http://bad.com/de/1"
    rows = [(1, good, '<a href="http://friend.net/x">'), (2, bad, None), (3, "http://farm.net/a", '<a href="http://bad.com/de/1"><a href="//bad.com/">'), (4, "http://friend.net/x", None), (5, "http://alone.net/", "<a href='/x'>"), (6, "http://near.net/", "<a href=http://farm.net>")]
    got = {r.page_id: r.verdict for r in urls.judged_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}


def test_odd_tables(spark):
    schema = "page_id string, url string, html string, _host string, host int, verdict string"
    assert urls.judged_urls(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None, None, "x", 1, "y"), ("k", "://", "", "", 2, ""), ("k", "://", "", "", 2, ""), ("m", "http://A.ORG/é?x=://b", None, None, None, None)]
    assert rows_of(urls.judged_urls(spark.createDataFrame(rows, schema))) == [("", "", "", "", "allow"), ("k", "", "", "", "allow"), ("k", "", "", "", "allow"), ("m", "a.org", "/é", "org/", "allow")]
