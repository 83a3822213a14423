import random
from datetime import datetime, timedelta

import pytest

from quillmill.llm import funnels, queries
from quillmill.llm.funnels import FUNNELS

CLICKS = "client_id long, kind string, ts timestamp_ntz"
START = datetime(2024, 1, 1)


def brute(rows):
    """Row by row, as the contract says it."""
    own = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    out = {}
    for f in FUNNELS:
        for client in {c for c, _, _ in own}:
            mine = sorted((t, k) for c, k, t in own if c == client)
            counts, times = [0] * 4, [[] for _ in range(4)]
            for start, kind in mine:
                if kind != f.steps[0]:
                    continue
                counts[0] += 1
                before = start
                for s, want in enumerate(f.steps[1:], 1):
                    after = [t for t, k in mine if k == want and t > before]
                    if not after or after[0] - before > timedelta(minutes=15) or any(k in f.excluded and before < t <= after[0] for t, k in mine):
                        break
                    counts[s] += 1
                    times[s].append((after[0] - before) // timedelta(microseconds=1))
                    before = after[0]
            if counts[0]:
                deepest = max(s + 1 for s in range(4) if counts[s])
                out[f.name, client] = (*counts, deepest, *(sorted(t)[-(-len(t) // 2) - 1] if t else None for t in times[1:]))
    same = {}
    for (name, _), x in out.items():
        same[name, x[4]] = same.get((name, x[4]), 0) + 1
    return sorted((*k, *x, same[k[0], x[4]]) for k, x in out.items())


def found(df):
    return sorted(tuple(r[c] for c in ("funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth")) for r in df.collect())


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/clicks.parquet").select("client_id", "kind", "ts").collect()]
    same(found(queries.op12_funnels(spark, "/root/testdata/sf0.001")), brute(rows))


@pytest.mark.parametrize("rows_each, gap", [(7, 200), (7, 2_000), (40, 400), (500_000, 400)])
def test_ranges_within_one_client(spark, rows_each, gap, monkeypatch):
    """A hot client cut into ranges of a few rows, at gaps where a funnel spans many of them; ties in time are many."""
    monkeypatch.setattr(funnels, "ROWS", rows_each)
    rng, rows = random.Random(rows_each * gap), []
    for client, n in ((7, 700), (1, 40), (9, 40), (8, 1)):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 0, 1, gap // 2, gap])
            rows.append((client, rng.choices(["view", "click", "purchase", "signup", "error", None, "other"], [9, 9, 5, 3, 1, 1, 2])[0], START + timedelta(seconds=at)))
    rows += rows[::3] + [(None, "view", START), (1, "view", None)]
    clicks = spark.createDataFrame(rows, CLICKS).selectExpr("*", "1 AS part", "true AS own", "2 AS client", "3 AS took")
    same(found(funnels.report(clicks)), brute(rows))


def test_bounds(spark):
    """15 minutes are within, a microsecond more is not; an excluded row counts at the next step's time but not at the last one's."""
    m = lambda x, us=0: START + timedelta(minutes=x, microseconds=us)
    rows = [(1, "view", m(0)), (1, "click", m(15)), (2, "view", m(0)), (2, "click", m(15, 1)), (3, "view", m(0)), (3, "error", m(0)), (3, "click", m(1)), (4, "view", m(0)), (4, "error", m(1)), (4, "click", m(1)), (5, "view", m(0)), (5, "click", m(0))]
    got = {r.client_id: (r.n1, r.n2, r.t2) for r in funnels.report(spark.createDataFrame(rows, CLICKS)).filter("funnel = 'A'").collect()}
    assert got == {1: (1, 1, 900_000_000), 2: (1, 0, None), 3: (1, 1, 60_000_000), 4: (1, 0, None), 5: (1, 0, None)}


def test_no_rows_and_zoned_times(spark):
    assert funnels.report(spark.createDataFrame([], CLICKS)).collect() == []
    assert funnels.report(spark.createDataFrame([(1, "error", START)], CLICKS)).collect() == []
    rows = [(1, "view", START), (1, "click", START + timedelta(seconds=1))]
    zoned = spark.createDataFrame(rows, CLICKS).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("ts").cast("timestamp"))
    same(found(funnels.report(zoned)), brute(rows))


def test_halo_stays_small():
    """However many rows follow, a range takes over a bounded number of them."""
    import numpy as np

    rng = np.random.default_rng(1)
    ts, kind = np.sort(rng.integers(0, 10**9, 300_000)), rng.integers(0, 5, 300_000)
    assert len(funnels.first_rows(ts, kind, 5, 3)) <= 5 + 25 + 125


def test_medians_by_two_levels(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(funnels, "LOW", 4)
    rows = [(k, rng.choice([5, rng.randrange(900), 17]), rng.randrange(1, 4)) for k in range(30) for _ in range(rng.randrange(1, 60))]
    got = {r.k: r.median for r in funnels.medians(spark.createDataFrame(rows, "k int, took long, n long"), ["k"]).collect()}
    for k in range(30):
        all_ = sorted(t for key, t, n in rows if key == k for _ in range(n))
        assert got[k] == all_[-(-len(all_) // 2) - 1]
