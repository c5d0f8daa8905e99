"""Sequential kernels over events (no SQL, or SQL only for what they reduce to)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodepath.kernels import location as loc
from lodepath.kernels import motion as mo
from lodepath.kernels.base import replay
from lodepath.operators import sequences
from lodepath.plans.common import EV, events, r6, shared_folder, table
from lodepath.plans.registry import query

DAY = 86_400_000


def ship(spark):
    """Lets workers on this host import the package."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, env.get("PYTHONPATH", "")]).rstrip(os.pathsep)


def single(spark, d):
    ship(spark)
    return events(spark, d).groupBy("user_id", "t").agg(F.max("value").alias("value"), F.max("k").alias("k"))


@query("stream_quality", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS value FROM ev GROUP BY ALL), w AS (SELECT user_id, (t - min(t) OVER (PARTITION BY user_id)) // {DAY} AS win, value FROM one), f AS (SELECT user_id, win, count(*) AS n, avg(CAST(value < 250 AS INT)) AS score FROM w GROUP BY ALL), s AS (SELECT user_id, unnest(range(0, m + 1)) AS win FROM (SELECT user_id, max(win) AS m FROM f GROUP BY user_id))
SELECT user_id, win, coalesce(n, 0) AS n, round(score, 6) AS score FROM s LEFT JOIN f USING (user_id, win)""")
def stream_quality(spark, d):
    """Windows since the first row; empty windows are there. The machine of the same name gives the same in a stream."""
    s = single(spark, d).withColumn("good", F.col("value") < 250)
    return sequences.tumbling_quality(s, ["user_id"], "t", "good", DAY).select("user_id", "win", "n", r6("score").alias("score"))


@query("odometry_moves")
def odometry_moves(spark, d):
    s = single(spark, d).select("user_id", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return replay(s, "user_id", ["t"], mo.Odometry, "user_id bigint, t bigint, dx double, dy double")


@query("bias_tracker", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS value FROM ev GROUP BY ALL), s AS (SELECT user_id, t // 86400 // 1000 AS sec, avg(value) AS m FROM one GROUP BY ALL), w AS (SELECT user_id, sec, list_sort(list(m) OVER (PARTITION BY user_id ORDER BY sec ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS v FROM s)
SELECT user_id, sec, round(v[len(v) // 2 + 1], 6) AS bias FROM w WHERE len(v) >= 5""")
def bias_tracker(spark, d):
    """Seconds are days here; the last ten with rows are kept."""
    s = single(spark, d).withColumn("t", F.floor(F.col("t") / 86400))
    return sequences.recent_bias(s, ["user_id"], "t", "value", keep=10).select("user_id", "sec", r6("bias").alias("bias"))


@query("step_lengths")
def step_lengths(spark, d):
    s = single(spark, d).select("user_id", "t", (F.col("value") / 30).alias("a"))
    return replay(s, "user_id", ["t"], mo.Steps, "user_id bigint, t bigint, length double, cadence double")


@query("dead_reckoning")
def dead_reckoning(spark, d):
    k = F.when(F.col("k") % 10 == 0, "fix").otherwise("move")
    s = single(spark, d).select("user_id", "t", k.alias("kind"), F.when(k == "fix", F.col("value")).otherwise(F.col("value") / 100).alias("a"), F.when(k == "fix", F.col("k").cast("double")).otherwise((F.col("k") - 50) / 100).alias("b"), F.lit(50.0).alias("c"))
    return replay(s, "user_id", ["t"], mo.DeadReckoning, "user_id bigint, t bigint, x double, y double, heading double, accepted boolean")


@query("floor_changes")
def floor_changes(spark, d):
    s = single(spark, d).select("user_id", F.floor(F.col("t") / 60000).alias("t"), (F.col("value") / 50).alias("altitude"), F.col("k").alias("steps"))
    return replay(s, "user_id", ["t"], mo.Floors, "user_id bigint, t bigint, floors int, mode string")


@query("radio_window", f"""WITH {EV}, one AS (SELECT user_id, t, max(value) AS value, max(k) AS k FROM ev GROUP BY ALL), s AS (SELECT user_id, t // 86400 AS t, k % 5 AS tag, -value / 5 AS rssi FROM one),
n AS (SELECT user_id, t, tag, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1499 PRECEDING AND CURRENT ROW) AS a, avg(rssi) OVER s AS ms, count(*) OVER s AS ns, avg(rssi) OVER l AS ml, count(*) OVER l AS nl FROM s
  WINDOW s AS (PARTITION BY user_id, tag ORDER BY t RANGE BETWEEN 1499 PRECEDING AND CURRENT ROW), l AS (PARTITION BY user_id, tag ORDER BY t RANGE BETWEEN 2999 PRECEDING AND CURRENT ROW))
SELECT user_id, t, tag, round(CASE WHEN a < 3 THEN ml ELSE ms END, 6) AS mean, CASE WHEN a < 3 THEN nl ELSE ns END AS n FROM n""")
def radio_window(spark, d):
    s = single(spark, d).select("user_id", F.floor(F.col("t") / 86400).alias("t"), (F.col("k") % 5).alias("tag"), (-F.col("value") / 5).alias("rssi"))
    return sequences.tag_window(s, ["user_id"], "t", "tag", "rssi").select("user_id", "t", "tag", r6("mean").alias("mean"), "n")


@query("magnetic_trust")
def magnetic_trust(spark, d):
    s = single(spark, d).select("user_id", F.floor(F.col("t") / 86400).alias("t"), F.col("value").alias("bias"))
    return replay(s, "user_id", ["t", "bias"], lambda: mo.Trust(400.0), "user_id bigint, t bigint, trust double")


@query("particle_filter")
def particle_filter(spark, d):
    grid = np.fromfunction(lambda r, c: 40 + 10 * np.sin(r / 2.0) + 8 * np.cos(c / 3.0), (12, 12))
    s = single(spark, d).select("user_id", "t", (F.col("value") - 250).alias("dx"), (F.col("k") - 50).cast("double").alias("dy"), F.lit(45.0).alias("b"))
    return replay(s, "user_id", ["t"], lambda: loc.Particles(grid, 100.0, (600.0, 600.0), 200), "user_id bigint, t bigint, x double, y double, spread double, converged boolean")


@query("viterbi")
def viterbi(spark, d):
    near = {p: [q for q in (p - 1, p + 1) if 0 <= q < 10] for p in range(10)}

    class Frames(loc.Viterbi):
        def step(self, row):
            scores = {p: -abs(row.value - 50 * p) / 25 for p in range(10)}
            return super().step(type("Row", (), {"t": row.t, "scores": scores}))

    return replay(single(spark, d), "user_id", ["t"], lambda: Frames(near), "user_id bigint, t bigint, point int, p double")


@query("astar")
def astar(spark, d):
    """A route for each pair of nations over a ring with chords, by a task for each batch of requests; the graph has a fixed size."""
    ship(spark)
    nodes = {i: (float(np.cos(i) * 100), float(np.sin(i) * 100)) for i in range(25)}
    edges: dict = {i: {} for i in nodes}
    for i in nodes:
        for j in ((i + 1) % 25, (i * 7 + 3) % 25):
            if i != j:
                edges[i][j] = edges[j][i] = float(np.hypot(nodes[i][0] - nodes[j][0], nodes[i][1] - nodes[j][1]))

    def run(it):
        for pdf in it:
            out = []
            for s, g in zip(pdf["s"], pdf["g"], strict=True):
                r = loc.astar(nodes, edges, int(s), int(g), 10.0)
                out.append((s, g, len(r[0]), r[1]) if r else (s, g, 0, None))
            yield pd.DataFrame(out, columns=["s", "g", "hops", "cost"])

    o = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("s"), (F.col("o_orderkey") % 25).alias("g")).where("s <> g").distinct()
    return o.mapInPandas(run, "s bigint, g bigint, hops int, cost double")


@query("tap_synchronisation")
def tap_synchronisation(spark, d):
    """Two channels of a session as two devices: tap groups, then offset and drift where they agree."""
    ship(spark)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        ta, tb = ([x for g in loc.tap_groups(sorted(rows["t"][rows["event_type"] == kind].astype(float)), DAY / 24, DAY) for x in g] for kind in ("click", "view"))
        r = loc.tap_sync(ta, tb, 1e12) if len(ta) == len(tb) else None
        return pd.DataFrame([(key[0], len(ta), len(tb), *(r or (None, None, None)))], columns=["user_id", "taps_a", "taps_b", "offset", "drift", "residual"]).astype({"offset": float, "drift": float, "residual": float})

    both = events(spark, d).where("event_type in ('click', 'view')").select("user_id", "t", "event_type")
    return both.groupBy("user_id").applyInPandas(run, "user_id bigint, taps_a int, taps_b int, offset double, drift double, residual double")


@query("stream_rates", f"WITH {EV} SELECT event_type, CAST(floor(t / 86400000.0) AS BIGINT) AS day, count(*) AS n, round(sum(value), 2) AS total FROM ev GROUP BY ALL")
def stream_rates(spark, d):
    """A file stream of events through a watermark and tumbling days, run to its end; the update rows' last state is the result."""
    import uuid

    from lodepath.streaming.jobs import run_to_end

    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = s.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", "10 seconds")
    agg = t.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    out = run_to_end(agg, "complete", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("event_type", F.floor(F.unix_millis(F.col("window.start")) / DAY).alias("day"), "n", F.round("v", 2).alias("total"))
