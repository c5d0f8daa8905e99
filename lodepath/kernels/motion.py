"""Motion kernels: steps, dead reckoning, floors, odometry, freezing, trust, radio smoothing, quality windows."""

from __future__ import annotations

import math
from collections import deque
from statistics import median

import numpy as np

from lodepath.kernels.base import Machine


class Steps(Machine):
    """Steps from acceleration norms: a peak over the rolling mean after a valley, at least 250 ms apart; length after Weinberg.

    Rows: t, a (norm, m/s^2). Gives (t, length_m, cadence_hz)."""

    def __init__(self, least: float = 0.8, gap_ms: int = 250, window: int = 50, k: float = 0.48, tau: float = 0.06):
        self.least, self.gap, self.k, self.tau = least, gap_ms, k, tau
        self.ring: deque = deque(maxlen=window)
        self.t = self.smooth = self.last = None
        self.low = self.high = 0.0
        self.rising = False

    def step(self, row) -> list[tuple]:
        dt = 0.0 if self.t is None else (row.t - self.t) / 1000
        a = row.a if self.smooth is None or dt <= 0 or dt > 1 else self.smooth + dt / (self.tau + dt) * (row.a - self.smooth)
        self.t = row.t
        self.ring.append(a)
        v = a - sum(self.ring) / len(self.ring)
        before, self.smooth = self.smooth, a
        out = []
        limit = max(self.least, 0.5 * float(np.std(self.ring)))
        if v > limit:
            self.high, self.rising = max(self.high, v), True
        elif self.rising and before is not None and v < 0:
            if self.last is None or row.t - self.last >= self.gap:
                cadence = 0.0 if self.last is None or row.t - self.last > 2000 else 1000 / (row.t - self.last)
                out.append((row.t, self.k * max(self.high - self.low, 0.0) ** 0.25, cadence))
                self.last = row.t
            self.high, self.low, self.rising = 0.0, v, False
        else:
            self.low = min(self.low, v)
        return out


class DeadReckoning(Machine):
    """A filter of (x, y, heading) with moves and position fixes; a fix outside the gate is refused, too many in a row reset to it.

    Rows: t, kind (move: a = length, b = turn; fix: a, b = position, c = deviation). Gives (t, x, y, heading, accepted)."""

    GATE = 9.21  # chi-square, two degrees of freedom, 99 %

    def __init__(self, refusals: int = 5, length_share: float = 0.1, turn_sd: float = 0.05):
        self.x, self.p = np.zeros(3), np.diag([1e4, 1e4, 1.0])
        self.refusals, self.share, self.turn_sd, self.refused = refusals, length_share, turn_sd, 0

    def step(self, row) -> list[tuple]:
        ok = True
        if row.kind == "move":
            self.x[2] = math.remainder(self.x[2] + row.b, 2 * math.pi)
            s, c = math.sin(self.x[2]), math.cos(self.x[2])
            self.x[:2] += row.a * np.array([s, c])
            f = np.array([[1, 0, row.a * c], [0, 1, -row.a * s], [0, 0, 1.0]])
            g = np.array([[s, 0], [c, 0], [0, 1.0]])
            self.p = f @ self.p @ f.T + g @ np.diag([(self.share * row.a) ** 2, self.turn_sd**2]) @ g.T
        else:
            h = np.eye(2, 3)
            r = np.array([row.a, row.b]) - self.x[:2]
            s = h @ self.p @ h.T + row.c**2 * np.eye(2)
            ok = bool(r @ np.linalg.solve(s, r) <= self.GATE)
            self.refused = 0 if ok else self.refused + 1
            if ok:
                k = self.p @ h.T @ np.linalg.inv(s)
                self.x = self.x + k @ r
                self.p = (np.eye(3) - k @ h) @ self.p
            elif self.refused >= self.refusals:
                self.x[:2], self.refused, ok = (row.a, row.b), 0, True
                self.p[:2] = self.p[:, :2] = 0
                self.p[0, 0] = self.p[1, 1] = row.c**2
        return [(row.t, float(self.x[0]), float(self.x[1]), float(self.x[2]), ok)]


class Floors(Machine):
    """Floor changes from altitude: a segment of vertical motion is counted when it ends, in whole floors, with its mode.

    Rows: t, altitude (m), steps (cumulative). Gives (t, floors, mode). Rows not newer than the last are dropped."""

    def __init__(self, floor_m: float = 3.5, tau: float = 1.0, start: float = 0.12, stop: float = 0.06, rest_ms: int = 2500):
        self.floor, self.tau, self.start, self.stop, self.rest = floor_m, tau, start, stop, rest_ms
        self.t = self.alt = None
        self.rate, self.base, self.since, self.begun, self.steps0, self.top = 0.0, None, None, None, 0, 0.0

    def step(self, row) -> list[tuple]:
        if self.t is not None and row.t <= self.t:
            return []
        if self.t is None:
            self.t, self.alt, self.base = row.t, row.altitude, row.altitude
            return []
        dt = (row.t - self.t) / 1000
        self.t = row.t
        before = self.alt
        self.alt += dt / (self.tau + dt) * (row.altitude - self.alt)
        self.rate += dt / (self.tau + dt) * ((self.alt - before) / dt - self.rate)
        if self.begun is None:
            if abs(self.rate) >= self.start:
                self.begun, self.steps0, self.top, self.since = row.t, row.steps, abs(self.rate), None
            else:
                self.base += dt / (20 + dt) * (self.alt - self.base)
            return []
        self.top = max(self.top, abs(self.rate))
        if abs(self.rate) >= self.stop:
            self.since = None
            return []
        self.since = row.t if self.since is None else self.since
        if row.t - self.since < self.rest:
            return []
        moved, steps = self.alt - self.base, row.steps - self.steps0
        n = round(moved / self.floor)
        mode = "stairs" if steps >= 4 * abs(n) else "elevator" if self.top >= 0.6 else "escalator"
        self.begun, self.base = None, self.alt
        return [(row.t, int(n), mode)] if n else []


class Odometry(Machine):
    """Moves of at least `every` cm from a stream of positions; a jump of 300 cm or more is left out. Rows: t, x, y. Gives (t, dx, dy)."""

    def __init__(self, every: float = 20.0, jump: float = 300.0):
        self.every, self.jump, self.at, self.dx, self.dy, self.path = every, jump, None, 0.0, 0.0, 0.0

    def step(self, row) -> list[tuple]:
        out = []
        if self.at is not None:
            dx, dy = row.x - self.at[0], row.y - self.at[1]
            d = math.hypot(dx, dy)
            if d < self.jump:
                self.dx, self.dy, self.path = self.dx + dx, self.dy + dy, self.path + d
        self.at = (row.x, row.y)
        if self.path >= self.every:
            out.append((row.t, self.dx, self.dy))
            self.dx = self.dy = self.path = 0.0
        return out


class Freeze(Machine):
    """Holds moves back after 20 s without steps; three steps release them all. Rows: t, dx, dy, steps. Gives (t, dx, dy, frozen)."""

    def __init__(self, still_ms: int = 20_000, release: int = 3, most: int = 600):
        self.still, self.release, self.held = still_ms, release, deque(maxlen=most)
        self.steps = self.last = None
        self.frozen = False
        self.at_freeze = 0

    def step(self, row) -> list[tuple]:
        if self.steps is None or row.steps > self.steps:
            self.last = row.t
        self.steps = row.steps
        if not self.frozen and row.t - self.last >= self.still:
            self.frozen, self.at_freeze = True, row.steps
        if self.frozen and row.steps - self.at_freeze >= self.release:
            out = [(t, dx, dy, False) for t, dx, dy in self.held] + [(row.t, row.dx, row.dy, False)]
            self.held.clear()
            self.frozen = False
            return out
        if self.frozen:
            self.held.append((row.t, row.dx, row.dy))
            return [(row.t, 0.0, 0.0, True)]
        return [(row.t, row.dx, row.dy, False)]


class Trust(Machine):
    """Distrust of the magnetometer after a recalibration jump of its bias: 0 for 3 s, then a ramp of 1.5 s to 1. Rows: t, bias. Gives (t, trust)."""

    def __init__(self, jump: float = 2.0, history_ms: int = 1500, cool_ms: int = 3000, ramp_ms: int = 1500):
        self.jump, self.history, self.cool, self.ramp = jump, history_ms, cool_ms, ramp_ms
        self.past: deque = deque()
        self.hit = None

    def step(self, row) -> list[tuple]:
        while self.past and row.t - self.past[0][0] > self.history:
            self.past.popleft()
        if self.past and abs(row.bias - self.past[0][1]) > self.jump:
            self.hit = row.t
            self.past.clear()
        self.past.append((row.t, row.bias))
        trust = 1.0 if self.hit is None else min(1.0, max(0.0, (row.t - self.hit - self.cool) / self.ramp))
        return [(row.t, trust)]


class Bias(Machine):
    """The upper median of the last 180 seconds' means, from 5 on. Rows: t, value. Gives (second, bias)."""

    def __init__(self, keep: int = 180, least: int = 5):
        self.means: deque = deque(maxlen=keep)
        self.least, self.sec, self.sum, self.n = least, None, 0.0, 0

    def step(self, row) -> list[tuple]:
        sec, out = row.t // 1000, []
        if self.sec is not None and sec > self.sec:
            out = self.end()
            self.sum, self.n = 0.0, 0
        if self.sec is None or sec >= self.sec:
            self.sec = sec
            self.sum, self.n = self.sum + row.value, self.n + 1
        return out

    def end(self) -> list[tuple]:
        if not self.n:
            return []
        self.means.append(self.sum / self.n)
        v = sorted(self.means)
        return [(self.sec, v[len(v) // 2])] if len(v) >= self.least else []


class RadioWindow(Machine):
    """Mean strength by tag over (now - 1.5 s, now], widened to 3 s under three readings. Rows: t, tag, rssi. Gives (t, tag, mean, n)."""

    def __init__(self, short: int = 1500, long: int = 3000, least: int = 3):
        self.short, self.long, self.least, self.buf = short, long, least, []

    def step(self, row) -> list[tuple]:
        self.buf = [r for r in self.buf if r[0] > row.t - self.long] + [(row.t, row.tag, row.rssi)]
        near = [r for r in self.buf if r[0] > row.t - self.short]
        use = near if len(near) >= self.least else self.buf
        mine = [r[2] for r in use if r[1] == row.tag]
        return [(row.t, row.tag, sum(mine) / len(mine), len(mine))]


class TagFinder(Machine):
    """A smoothed strength, its trend over some seconds and how near the tag is. Rows: t, rssi. Gives (t, smooth, trend, zone)."""

    def __init__(self):
        self.smooth, self.past = None, deque()

    def step(self, row) -> list[tuple]:
        self.smooth = row.rssi if self.smooth is None else 0.6 * self.smooth + 0.4 * row.rssi
        while self.past and row.t - self.past[0][0] > 6000:
            self.past.popleft()
        old = [s for t, s in self.past if row.t - t > 2500]
        d = self.smooth - old[-1] if old else 0.0
        self.past.append((row.t, self.smooth))
        zone = "here" if self.smooth >= -55 else "near" if self.smooth >= -67 else "far" if self.smooth >= -80 else "away"
        return [(row.t, self.smooth, "nearer" if d >= 3 else "farther" if d <= -3 else "same", zone)]


class ColdStart(Machine):
    """A position seeded by the first fix; fixes far from it are held, and when enough agree in a row they seed anew. Rows: t, x, y. Gives (t, x, y, seeded)."""

    def __init__(self, far: float = 1500.0, needed: int = 3):
        self.far, self.needed, self.at, self.held = far, needed, None, []

    def step(self, row) -> list[tuple]:
        if self.at is None or math.dist(self.at, (row.x, row.y)) <= self.far:
            new = self.at is None
            self.at, self.held = (row.x, row.y), []
            return [(row.t, row.x, row.y, new)]
        self.held = [h for h in self.held if math.dist(h, (row.x, row.y)) <= self.far] + [(row.x, row.y)]
        if len(self.held) < self.needed:
            return []
        self.at, self.held = (row.x, row.y), []
        return [(row.t, row.x, row.y, True)]


class Carry(Machine):
    """How a phone is carried, by rules on a window's tilt and swing, with hysteresis. Rows: t, tilt (rad), swing (m/s^2 deviation). Gives (t, mode)."""

    def __init__(self, span_ms: int = 5000, hold: int = 3):
        self.span, self.hold, self.buf, self.mode, self.cand, self.k, self.t = span_ms, hold, deque(), "unknown", None, 0, None

    def step(self, row) -> list[tuple]:
        if self.t is not None and not 0 < row.t - self.t <= 1000:
            self.buf.clear()
        self.t = row.t
        self.buf.append((row.t, row.tilt, row.swing))
        while row.t - self.buf[0][0] > self.span:
            self.buf.popleft()
        tilt, swing = median(b[1] for b in self.buf), median(b[2] for b in self.buf)
        now = "swing" if swing > 4 else "screen" if tilt < 0.9 and swing < 1.5 else "ear" if tilt < 1.4 and swing < 2.5 else "pocket"
        if now == self.mode:
            self.cand, self.k = None, 0
        else:
            self.k = self.k + 1 if now == self.cand else 1
            self.cand = now
            if self.k >= self.hold:
                self.mode, self.cand, self.k = now, None, 0
        return [(row.t, self.mode)]


class QualityWindows(Machine):
    """Tumbling windows since a key's first row, empty ones included, scored by share of good rows; the mean of the last six and a stop flag.

    Rows: t, good (bool). Gives (window, n, score, recent, stop): stop after `streak` windows under `least`."""

    def __init__(self, size: int = 10_000, least: float = 0.5, streak: int = 3, keep: int = 6):
        self.size, self.least, self.streak = size, least, streak
        self.t0, self.w, self.n, self.good, self.bad = None, 0, 0, 0, 0
        self.recent: deque = deque(maxlen=keep)

    def _close(self) -> tuple:
        score = self.good / self.n if self.n else None
        if score is not None:
            self.recent.append(score)
            self.bad = self.bad + 1 if score < self.least else 0
        mean = sum(self.recent) / len(self.recent) if self.recent else None
        out = (self.w, self.n, score, mean, self.bad >= self.streak)
        self.w, self.n, self.good = self.w + 1, 0, 0
        return out

    def step(self, row) -> list[tuple]:
        if self.t0 is None:
            self.t0 = row.t
        out = []
        while (row.t - self.t0) // self.size > self.w:
            out.append(self._close())
        self.n, self.good = self.n + 1, self.good + bool(row.good)
        return out

    def end(self) -> list[tuple]:
        return [self._close()] if self.t0 is not None else []
