"""Registered queries return a row for the whole of their tables."""

import duckdb
from pyspark.sql import functions as F

from linkquarry.functions.strings import difference
from linkquarry.plans import queries
from linkquarry.plans.views import VIEWS

SF = "/root/testdata/sf0.01"


def _rows(name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    return con.execute(f"SELECT * FROM ({VIEWS[name]})").df().astype(object)


def test_every_difference_is_classified(spark):
    rows = _rows("codec_results")
    got = {r.ordinal: r.label for r in queries.QUERIES["classify_difference"](spark, SF).collect()}
    actual = [a if isinstance(a, str) else None for a in rows.actual]
    assert got == {o: difference(e, a) for o, e, a in zip(rows.ordinal, rows.expected, actual, strict=True)}
    assert {o % 9 for o in got} == set(range(9))
    assert all(got[o] == "exact" for o in got if o % 9 in (0, 5, 6, 8)) and all(got[o] is None for o in got if o % 9 == 4)


def test_every_candidate_is_packed(spark, monkeypatch):
    urls = sorted({u.encode() for u in _rows("web_urls").url})
    want, at = {}, 0
    for u in urls:
        want[u.decode()] = at
        at += len(u)
    for size in (queries.PACK_BYTES, 700):  # one pack, and offsets that run on over many
        monkeypatch.setattr(queries, "PACK_BYTES", size)
        got = queries.QUERIES["pack_offsets"](spark, SF).orderBy(F.col("start_byte")).collect()
        assert len(got) == len(want) and {r.url: r.start_byte for r in got} == want
