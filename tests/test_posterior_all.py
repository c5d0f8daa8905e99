"""Queries over all users, sessions and cells against brute force."""

import math
import random
from collections import defaultdict

from lodepath.plans.all_queries import QUERIES
from lodepath.plans.common import events
from lodepath.plans.grid_queries import cells


def test_posterior_of_all_users(spark, sf_dir):
    got = {(r.oid, r.pid): (r.ll, r.p) for r in QUERIES["fingerprint_posterior_all"](spark, sf_dir).collect()}
    seen = defaultdict(lambda: defaultdict(list))
    for r in events(spark, sf_dir).select("user_id", "k", "value").collect():
        seen[r.user_id][r.k % 20].append(-r.value / 5)
    want = {}
    for a, o in seen.items():
        for b, r in seen.items():
            both = o.keys() & r.keys()
            if both:
                z = [max(min(r[t]) - sum(o[t]) / len(o[t]), sum(o[t]) / len(o[t]) - max(r[t]), 0) / 6 for t in both]
                want[a, b] = sum(-0.5 * x * x for x in z) - 0.5 * (len(r) - len(both)) - 0.25 * (len(o) - len(both))
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k], abs_tol=2e-6) for k in want)
    assert all(abs(sum(got[k][1] for k in want if k[0] == a) - 1) < 1e-3 for a in list(seen)[:5])


def test_grids_of_all_cells(spark, sf_dir):
    every = {(r.row, r.col) for r in cells(spark, sf_dir).select("row", "col").distinct().collect()}
    assert {(r.row, r.col) for r in QUERIES["grid_blur_all"](spark, sf_dir).collect()} == every
    healed = {(r.row, r.col): r.n for r in QUERIES["grid_heal_all"](spark, sf_dir).where("action in ('keep', 'merge', 'conflict')").collect()}
    want = {(r.row, r.col): r["count"] for r in cells(spark, sf_dir).where("session < 2").groupBy("row", "col").count().collect()}
    assert healed == want


def test_blocks_give_what_the_joined_rows_give(spark):
    """Blocks of both sides, tags that are null or known to one side only, readings that are null; against the join of rows."""
    from lodepath.operators import radio

    rng = random.Random(6)
    o = [(f"o{k}", t, rng.choice([None, -40.0, rng.uniform(-90, -30)])) for k in range(40) for t in rng.sample([None, *range(12)], 6)] + [("alone", 99, -50.0)]
    r = [(k, t, rng.choice([None, -80.0]), rng.choice([None, -50.0, rng.uniform(-50, -40)])) for k in range(50) for t in rng.sample([None, *range(3, 20)], 5)]
    o, r = spark.createDataFrame(o, "o string, t int, rssi double"), spark.createDataFrame(r, "q bigint, t int, low double, high double")
    got = radio.posteriors(o, r, "o", "q", "t", 0.5, 0.25, block=16)
    plain = radio.log_likelihood(o, r, "o", "q", "t", 0.5, 0.25)
    a = {(x.o, x.q): round(x.ll, 9) for x in plain.collect()}
    top = {}
    for (k, _), v in a.items():
        top[k] = top.get(k, 0.0) + math.exp(v)
    rows = got.toDF("o", "place", "ll", "share").collect()
    assert {(x.o, x.place): round(x.ll, 9) for x in rows} == a and len(rows) == len(a) > 500
    assert all(abs(x.share - math.exp(x.ll) / top[x.o]) < 1e-9 for x in rows)
