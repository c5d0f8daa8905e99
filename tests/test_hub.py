"""The telemetry hub against a plain one, over several batches and restarts."""

import datetime as dt
import json
import random

import pytest

pytest.importorskip("google.protobuf")  # Spark's own stateful processors need it

from lodepath.streaming import hub as hb  # noqa: E402

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def plain_hub(messages, end):
    """Chunks and snapshots of one hub; messages: (ms, device, [(type, body)])."""
    last, recent, waiting, due, out = {}, [], [], None, []

    def flush(at):
        nonlocal waiting
        by = {}
        for d, line in waiting:
            by.setdefault(d, []).append(line)
        waiting = []
        out.extend(("chunk", d, at, tuple(v)) for d, v in by.items())

    for now, device, rows in messages:
        if due is not None and due <= now:
            flush(due)
            due = None
        for kind, body in rows:
            if kind == "view":
                out.append(("snapshot", device, now, tuple(sorted(json.dumps({"type": k, "device": d, "body": v}, sort_keys=True) for (k, d), v in last.items()) + recent)))
            elif kind == "log":
                recent = (recent + [body])[-500:]
                waiting.append((device, body))
            elif kind in ("hello", "state"):
                last[kind, device] = body
        if len(waiting) >= 200:
            flush(now)
        elif waiting and due is None:
            due = now + 30_000
    if due is not None and due <= end:
        flush(due)
    return out


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_hub_over_batches_and_restarts(spark, tmp_path, store):
    rng = random.Random(5)
    per_hub, now, n = {"h1": [], "h2": []}, 0, 0
    for k in range(260):
        now += rng.choice([10, 200, 3000, 40_000 if k % 50 == 0 else 500])
        hub, device = rng.choice(["h1", "h1", "h2"]), rng.choice(["dev/1", "d2", "d3"])
        rows = [("view", "")] if k % 60 == 59 else [(rng.choice(["log", "log", "log", "state", "hello", "odd"]), f"b{n + i}") for i in range(rng.choice([1, 2, 90 if k % 40 == 7 else 5]))]
        n += len(rows)
        per_hub[hub].append((now, device, rows))
    last = now + 200_000
    for hub in per_hub:  # the clock goes on
        per_hub[hub] += [(last, "v", [("view", "")]), (last + 100_000, "v", [("odd", "x")])]
    flat = sorted((t, h, d, rows) for h, ms in per_hub.items() for t, d, rows in ms)
    table = [(h, d, k, i, START + dt.timedelta(milliseconds=t), kind, body) for k, (t, h, d, rows) in enumerate(flat) for i, (kind, body) in enumerate(rows)]
    src, logs, state = str(tmp_path / "in"), str(tmp_path / "logs"), str(tmp_path / "state")
    schema = hb.MESSAGE
    seen = []
    cuts = [0, len(table) // 3, len(table) // 3 + 7, len(table)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):  # each a run of the query that ends, and the next one takes over
        spark.createDataFrame(table[lo:hi], schema).coalesce(1).write.mode("append").parquet(src)
        q = hb.hub_stream(spark.readStream.schema(schema).parquet(src), "1 seconds")
        done = q.writeStream.foreachBatch(lambda b, k: seen.extend(b.collect())).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()
        done.awaitTermination()
    got = {h: sorted((r.kind, r.device, r.at - int(START.timestamp() * 1000), tuple(r.lines)) for r in seen if r.hub == h and r.kind in ("chunk", "snapshot")) for h in per_hub}
    want = {h: sorted(plain_hub(ms, last + 90_000)) for h, ms in per_hub.items()}
    assert got == want
    assert sum(len(x[3]) for v in want.values() for x in v if x[0] == "chunk") > 300
    q = hb.write_logs(hb.hub_stream(spark.readStream.schema(schema).parquet(src), "1 seconds"), logs, str(tmp_path / "state2")).trigger(availableNow=True).start()
    q.awaitTermination()
    files = spark.read.text(logs).collect()
    lines = sorted(x for v in want.values() for c in v if c[0] == "chunk" for x in c[3])
    assert sorted(r.value for r in files) == lines and {r.device for r in files} <= {"dev_1", "d2", "d3"}


def test_requeued():
    assert hb.requeued([3, 4], [1, 2], 10) == [1, 2, 3, 4] and hb.requeued([3, 4], [1, 2], 3) == [2, 3, 4]
