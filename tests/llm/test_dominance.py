"""Dominance counts against a plain double loop and SQL, over small partitions that split nodes."""

from __future__ import annotations

import datetime as dt
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import dominance
from tests.conftest import DATA
from tests.llm.conftest import same


def brute(rows):
    """(n, w) of each (slot, level, weight)."""
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    out = []
    for s, v, _ in rows:
        above = [w for s2, v2, w in known if s is not None and v is not None and s2 < s and v2 > v]
        out.append((None, None) if s is None or v is None else (len(above), sum(above)))
    return out


def made(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, slot long, level long, weight long")
        return {r.k: (r.n_above, r.w_above) for r in dominance.counted(df, "slot", "level", F.col("weight")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("partitions", [1, 3, 23])
def test_equals_loop(spark, partitions):
    rnd = random.Random(partitions)
    rows = [(rnd.choice([None, -5, rnd.randint(-40, 90)]), rnd.choice([None, 7, rnd.randint(-30, 30)]), rnd.randint(1, 5)) for _ in range(500)]
    # A third of all rows is one point, and as many share a slot or a level.
    rows += [(11, 3, 2)] * 250 + [(11, rnd.randint(-30, 30), 1) for _ in range(100)] + [(rnd.randint(-40, 90), 3, 4) for _ in range(100)]
    got = made(spark, rows, partitions)
    assert [got[k] for k in range(len(rows))] == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 3, 1), (4, None, 1)], [(4, 9, 3)], [(4, 9, 3), (5, 8, 2)], [(2**37, -(2**62), 1), (-(2**37), 2**62, 5), (0, 0, 2)]])
def test_few_rows(spark, rows):
    got = made(spark, rows, 2)
    assert [got[k] for k in range(len(rows))] == brute(rows)


def test_asked_nodes_cover_smaller_places(spark):
    bits = 5
    rows = spark.range(1 << bits).select("id", F.inline(dominance.dyadic(F.col("id"), bits)).alias("node", "asked")).collect()
    held = {}
    for r in rows:
        if not r.asked:
            held.setdefault(r.node, []).append(r.id)
    for at in range(1 << bits):
        assert sorted(x for r in rows if r.id == at and r.asked for x in held[r.node]) == list(range(at))


def sales(folder, rows):
    names = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority", "point", "n_sales", "own"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.timestamp("us"), pa.timestamp("us"), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    columns = [[r[0] for r in rows], [1] * len(rows), ["open"] * len(rows), [r[1] for r in rows], [r[2] for r in rows], [None] * len(rows), *([[3] * len(rows)] * 4)]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), folder / "sales.parquet")
    return str(folder)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_op13_equals_sql_in_any_zone(spark, tmp_path, zone):
    import duckdb

    rnd = random.Random(3)
    start = dt.datetime(2024, 3, 10, 1, 0)
    rows = [(k, rnd.choice([None, 10.005, round(rnd.uniform(-5, 300), 2)]), rnd.choice([None, start + dt.timedelta(seconds=rnd.randint(-9000, 9000), microseconds=rnd.randint(0, 999_999))])) for k in range(300)]
    rows += [(7, 10.005, start)] * 120 + [(None, 20.0, start), (-3, 1.0, dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)), (99, 0.145, dt.datetime(1970, 1, 1))]
    folder = sales(tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sales AS SELECT * FROM '{folder}/sales.parquet'")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        same(dominance.op13_dominance_counting(spark, folder), con, dominance.ORACLE)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_op13_odd_totals_and_none(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, float("nan"), at), (2, float("inf"), at), (3, float("-inf"), at), (4, 1.0, at + dt.timedelta(minutes=1))]
    found = {r.sale_id: (r.level, r.n_sales) for r in dominance.op13_dominance_counting(spark, sales(tmp_path, rows)).collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (None, None), 4: (100, 0)}
    (tmp_path / "none").mkdir()
    assert dominance.op13_dominance_counting(spark, sales(tmp_path / "none", [])).count() == 0


def test_op13_on_the_tables(spark):
    found = dominance.op13_dominance_counting(spark, DATA).toPandas()
    rows = pq.read_table(f"{DATA}/sales.parquet").to_pylist()
    assert len(found) == len(rows)
    epoch = dt.datetime(1970, 1, 1)
    points = []
    for r in rows:
        slot = None if r["sold_at"] is None else (r["sold_at"] - epoch) // dt.timedelta(minutes=1)
        level = None if r["total"] is None else int(__import__("math").floor(100 * r["total"] + 0.5))
        points.append((slot, level, 1 + zlib.crc32(str(r["sale_id"]).encode()) % 5))
    got = {r.sale_id: (r.n_sales, r.n_rows) for r in found.itertuples()}
    for r, want in list(zip(rows, brute(points[:]), strict=True)) if len(rows) < 3000 else []:
        have = got[r["sale_id"]]
        assert tuple(None if x != x else int(x) for x in have) == want
