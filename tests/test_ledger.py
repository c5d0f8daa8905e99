"""State folded from a stream that is stopped at any place is that of one run."""

import math
import random

import pytest

from lodepath.streaming import ledger as lg

ROWS = "session string, x double, y double, value double, tag string, rssi double"


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.uniform(0, 500), rng.uniform(0, 300), rng.choice([None, rng.gauss(40, 9)]), rng.choice([None, "t1", "t2"]), rng.uniform(-90, 5)) for _ in range(n)]


@pytest.mark.parametrize("stop", ["grid", "tags", "sessions"])
def test_resumed_state_is_that_of_one_run(spark, tmp_path, stop):
    src, parts = str(tmp_path / "in"), [rows_of(k) for k in range(4)]
    for p in parts:
        spark.createDataFrame(p, ROWS).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
    state = lg.Ledger(spark, str(tmp_path / "state"))
    folds = lg.map_state(50.0)
    fail = {"at": 2}

    def broken(df):
        fail["at"] -= 1
        if fail["at"] == 0:
            raise RuntimeError("stopped")
        return folds[stop][1](df)

    with pytest.raises(Exception):
        lg.run(stream(), state, str(tmp_path / "cp"), folds | {stop: (folds[stop][0], broken)})
    lg.run(stream(), state, str(tmp_path / "cp"), folds)
    whole = spark.createDataFrame([r for p in parts for r in p], ROWS)
    want = {(r.row, r.col): r for r in folds["grid"][0](whole).collect()}
    got = {(r.row, r.col): r for r in state.table("grid").collect()}
    assert got.keys() == want.keys() and all(got[k].n == w.n and math.isclose(got[k].mean_value, w.mean_value) and math.isclose(got[k].m2_value, w.m2_value, abs_tol=1e-6) for k, w in want.items())
    tags = {r.tag: r for r in folds["tags"][0](whole).collect()}
    assert all(r.n == tags[r.tag].n and math.isclose(r.wx, tags[r.tag].wx) for r in state.table("tags").collect()) and len(tags) == 2
    assert {r.session for r in state.table("sessions").collect()} == {"a", "b"}
    assert len(state.versions("grid")) == 2  # the last, and the one before
    lg.run(stream(), state, str(tmp_path / "cp"), folds)
    assert {(r.row, r.col): r.n for r in state.table("grid").collect()} == {k: w.n for k, w in want.items()}
