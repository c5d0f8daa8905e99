"""The telemetry hub as a stateful stream: what it knows of each device, its recent log lines, and log files by device.

One hub is one key. Its state is kept by Spark (lists, maps and a timer in the state store), so a stream that is stopped goes on where it
was and no line is lost or written twice. Time is the server's receipt time `recv`, so results don't depend on how messages fall
into batches: an alarm that was due before a message fires before it; the timer fires alarms behind the last message.

A message is one or more rows of the same (hub, device, message): devices send batches after they were away.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Lines kept for viewers, lines over all devices that are written at once, and how long fewer wait.
RECENT, FLUSH_LINES, FLUSH_MS = 500, 200, 30_000
MESSAGE = "hub string, device string, message bigint, seq int, recv timestamp, type string, body string"
OUT = "kind string, hub string, device string, at bigint, lines array<string>"


class Hub(StatefulProcessor):
    """Rows of OUT: `chunk` is a file's lines of a device; `hello`, `state` and `log` go on to viewers; `snapshot` answers a `view`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "line string")
        self.pending = handle.getListState("pending", "device string, line string")
        self.last = handle.getMapState("last", "type string, device string", "body string")
        self.alarm = handle.getValueState("alarm", "due bigint")

    def _load(self) -> None:
        self.lines = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        self.waiting = [(r[0], r[1]) for r in self.pending.get()] if self.pending.exists() else []
        self.due = self.alarm.get()[0] if self.alarm.exists() else None

    def _store(self) -> None:
        for state, rows in ((self.recent, [(x,) for x in self.lines]), (self.pending, self.waiting)):
            state.put(rows) if rows else state.clear()
        self.alarm.update((self.due,)) if self.due is not None else self.alarm.clear()

    def _flush(self, at: int) -> list[tuple]:
        by: dict[str, list[str]] = {}
        for device, line in self.waiting:
            by.setdefault(device, []).append(line)
        self.waiting = []
        return [("chunk", device, at, lines) for device, lines in by.items()]

    def _message(self, now: int, device: str, rows: list[tuple[str, str]]) -> list[tuple]:
        out = []
        if self.due is not None and self.due <= now:  # the alarm rang before this message
            out += self._flush(self.due)
            self.due = None
        for kind, body in rows:
            if kind == "view":
                known = [json.dumps({"type": k[0], "device": k[1], "body": v[0]}, sort_keys=True) for k, v in self.last.iterator()] if self.last.exists() else []
                out.append(("snapshot", device, now, sorted(known) + self.lines))
                continue
            if kind in ("hello", "state"):
                self.last.updateValue((kind, device), (body,))
            elif kind == "log":
                self.lines = [*self.lines, body][-RECENT:]
                self.waiting.append((device, body))
            out.append((kind, device, now, [body]))
        if len(self.waiting) >= FLUSH_LINES:
            out += self._flush(now)
        elif self.waiting and self.due is None:
            self.due = now + FLUSH_MS
            self.handle.registerTimer(self.due)
        return out

    def _frame(self, hub: str, rows: list[tuple]) -> Iterator:
        import pandas as pd

        if rows:
            yield pd.DataFrame([(kind, hub, device, at, lines) for kind, device, at, lines in rows], columns=["kind", "hub", "device", "at", "lines"])

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        self._load()
        pdf = pd.concat(list(rows)).sort_values(["recv", "device", "message", "seq"], kind="stable")
        out = []
        for (recv, device, _), some in pdf.groupby(["recv", "device", "message"], sort=True):
            out += self._message(int(recv.timestamp() * 1000), device, list(zip(some["type"], some["body"], strict=True)))
        self._store()
        yield from self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        out = []
        if self.due is not None and self.due <= expiredTimerInfo.getExpiryTimeInMs():
            out, self.due = self._flush(self.due), None
            self._store()
        yield from self._frame(key[0], out)


def hub_stream(messages: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """OUT rows of a stream of MESSAGE rows; messages that come later than `lateness` behind the newest of all hubs are dropped.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    m = messages.where("hub is not null and device is not null and recv is not null").withWatermark("recv", lateness)
    return m.groupBy("hub").transformWithStateInPandas(Hub(), OUT, "append", "eventTime")


def write_logs(out: DataFrame, folder: str, checkpoint: str):
    """A query that writes chunks as JSON lines: logs by hub, day and device (names made safe), a folder of its own for each batch.

    A batch that is run again replaces its own folder, so each line is in the files once."""

    def keep(batch: DataFrame, k: int) -> None:
        chunk = batch.where("kind = 'chunk'").select(F.from_unixtime(F.floor(F.col("at") / 1000), "yyyy-MM-dd").alias("day"), F.regexp_replace("device", r"[^A-Za-z0-9._\-]", "_").alias("device"), "hub", F.explode("lines").alias("value"))
        chunk.write.mode("overwrite").partitionBy("hub", "day", "device").text(f"{folder}/batch={k}")

    return out.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)


def requeued(queue: list, batch: list, most: int) -> list:
    """A sender's queue after a batch could not be sent: it goes back in front; what exceeds the bound is lost at the old end."""
    return [*batch, *queue][-most:]
