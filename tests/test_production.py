"""Levels of sessions against dense least squares; the production job against known levels, and resumed after a stop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodepath.operators import production as pr


def test_conjugate_gradients_equal_dense_least_squares(spark):
    rng = random.Random(1)
    nodes, edges = [], []
    for comp, size in enumerate([1, 2, 9, 14]):
        names = [100 * comp + i for i in range(size)]
        nodes += [(v, comp, v == names[0]) for v in names]
        edges += [(a, b, rng.uniform(-20, 20), rng.uniform(0.1, 30)) for i, b in enumerate(names) for a in rng.sample(names[:i], min(i, 3))]
    got = {r.v: r.x for r in pr.conjugate_gradients(spark.createDataFrame(edges, "a int, b int, med double, w double").repartition(3), spark.createDataFrame(nodes, "v int, component int, fixed boolean")).collect()}
    free = [v for v, _, fixed in nodes if not fixed]
    m, y = np.zeros((len(edges), len(free))), np.zeros(len(edges))
    for k, (a, b, med, w) in enumerate(edges):
        y[k] = w * med
        for v, sign in ((a, -w), (b, w)):
            if v in free:
                m[k, free.index(v)] += sign
    want = dict(zip(free, np.linalg.lstsq(m, y, rcond=None)[0], strict=True))
    assert got.keys() == {v for v, *_ in nodes}
    assert all(abs(x - want.get(v, 0.0)) < 1e-6 for v, x in got.items())


def walks(seed=3):
    """Sessions over one field with levels of their own, one over other ground, one with a bad stretch, one bad throughout."""
    rng = random.Random(seed)
    field = {}
    rows = []
    levels = {"a": 0.0, "b": 8.0, "c": -6.0, "d": 12.0, "far": 3.0, "bad": 1.0}
    for name, level in levels.items():
        x, y = 0.0, 0.0
        for k in range(600):
            x, y = (25 * k % 1000) + rng.uniform(0, 10), 50 * (25 * k // 1000 % 8) + rng.uniform(0, 40)
            at = (x + (9e5 if name == "far" else 0), y)
            true = field.setdefault((at[0] // 50, at[1] // 50), rng.uniform(20, 70))
            off = 60 if name == "c" and 200 <= k < 230 else rng.choice([-40, 40]) if name == "bad" else 0
            rows.append((name, 1000 + 200 * k, *at, true + level + off + rng.gauss(0, 0.05)))
    return rows + [(None, 1, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0, 1.0), ("b", 5, 1.0, None, 1.0)], levels


def test_production_job_and_resuming(spark, tmp_path, monkeypatch):
    rows, levels = walks()
    df = spark.createDataFrame(rows, "session string, t long, x double, y double, value double").repartition(4)
    folder = str(tmp_path / "job")
    with monkeypatch.context() as m:  # stopped while it checks the sessions
        m.setattr(pr.fusion, "quality_gate", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pr.production(spark, df, folder, "walks-1")
    out, manifest = pr.production(spark, df, folder, "walks-1")
    assert [s["resumed"] for s in manifest] == [True] * 3 + [False] * (len(manifest) - 3)
    assert {r.session for r in out["verdicts"].where("not kept").collect()} == {"bad"}
    assert [r.session for r in out["excluded"].collect()] == ["far"]
    got = {r.session: r.offset for r in out["offsets"].where("component = 0").collect()}
    assert got.keys() == {"a", "b", "c", "d"}
    assert all(abs((got[s] - got["a"]) - (levels[s] - levels["a"])) < 0.05 for s in got)
    assert out["field"].count() > 100 and out["field"].where("m2 / n > 1").count() == 0  # no bad stretch is left in it
    again, manifest2 = pr.production(spark, df, folder, "walks-1")
    assert all(s["resumed"] for s in manifest2) and again["field"].exceptAll(out["field"]).count() == 0
    _, other = pr.production(spark, df.where("session <> 'bad'"), folder, "walks-2")
    assert not any(s["resumed"] for s in other)


def test_sessions_that_share_nothing(spark):
    cells = spark.createDataFrame([(s, r, 0, float(s)) for s in range(3) for r in range(10 * s, 10 * s + 5 + s)], "session int, row int, col int, mean double")
    got = {r.session: (r.component, r.offset) for r in pr.solved_offsets(cells, "session", ["row", "col"], "mean").collect()}
    assert got == {2: (0, 0.0), 1: (1, 0.0), 0: (2, 0.0)}
    weak = spark.createDataFrame([(s, r, 0, s * 5.0 + r) for s, rs in ((0, range(40)), (1, range(15, 40)), (2, range(36, 60))) for r in rs], "session int, row int, col int, mean double")
    got = {r.session: (r.component, round(r.offset, 6)) for r in pr.solved_offsets(weak, "session", ["row", "col"], "mean").collect()}
    assert got == {0: (0, 0.0), 1: (0, 5.0), 2: (0, 10.0)}
    assert pr.solved_offsets(weak.where(F.lit(False)), "session", ["row", "col"], "mean").count() == 0
