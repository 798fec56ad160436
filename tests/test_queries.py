"""Every query against its SQL, and the whole reading against the row-by-row engine."""

import duckdb
import pytest

from veilscan.functions import document
from veilscan.operators import scan
from veilscan.plans import catalogue, expected, injection

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {table} as from '{DIR}/{table}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([r[i] for i in order] for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.ORACLES[name])
    w = rows_of([d[0] for d in want.description], want.fetchall())
    g = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert g[0] == w[0]
    assert g[1] == w[1], [(a, b) for a, b in zip(g[1], w[1]) if a != b][:3] or (len(g[1]), len(w[1]))
    assert g[1]


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_scan_is_the_row_by_row_reading(spark):
    texts = {r.doc_id: r.text for r in injection.injected(spark, DIR).collect()}
    got = {}
    for r in scan.findings(injection.injected(spark, DIR)).collect():
        got.setdefault(r.doc_id, []).append((r.rank, r.id, r.severity, r["count"], r.positions, r.decoded))
    for key, text in texts.items():
        want = [(i, f.id, f.severity, f.count, f.positions, f.decoded) for i, f in enumerate(document.Reading(text).findings)]
        assert sorted(got.get(key, [])) == want
    stats = {r.doc_id: r for r in catalogue.QUERIES["scan_verdicts"](spark, DIR).collect()}
    for key, text in texts.items():
        s = document.Reading(text).stats()
        assert all(stats[key]["n_findings" if k == "findings" else k] == v for k, v in s.items())
        assert stats[key].severity == document.Reading(text).severity


def test_each_class_is_found(spark):
    """The classes without an expected finding have none, and every detector has a class."""
    found = {(r.doc_id % injection.CLASSES, r.id) for r in scan.findings(injection.injected(spark, DIR)).select("doc_id", "id").distinct().collect()}
    assert found == {(k, f.id) for k, fs in expected.FINDINGS.items() for f in fs}
    assert {k for k in range(injection.CLASSES)} - {k for k, _ in found} == {0, 19, 31, 35, 36}
    assert len({id_ for _, id_ in found}) == 26
