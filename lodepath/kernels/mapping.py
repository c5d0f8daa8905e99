"""Mapping kernels: Gaussian-process filling, grid registration, scan alignment, connectors, route hints, radio cross-checks."""

from __future__ import annotations

import math

import numpy as np

from lodepath.kernels.base import Machine


def gp_fill(cells: np.ndarray, values: np.ndarray, targets: np.ndarray, length: float = 100.0, near: int = 12, noise: float = 0.5, radius: float = 150.0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) at targets from each one's nearest cells by a squared-exponential process about their mean; NaN beyond the radius."""
    out, dev = np.full(len(targets), np.nan), np.full(len(targets), np.nan)
    for i, t in enumerate(targets):
        d = np.hypot(*(cells - t).T)
        at = np.argsort(d, kind="stable")[:near]
        if not len(at) or d[at[0]] > radius:
            continue
        x, y = cells[at], values[at]
        var = max(float(y.var()), 1e-6)
        k = var * np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2) / length**2) + noise**2 * np.eye(len(at))
        ks = var * np.exp(-0.5 * d[at] ** 2 / length**2)
        out[i] = y.mean() + ks @ np.linalg.solve(k, y - y.mean())
        dev[i] = math.sqrt(max(var - ks @ np.linalg.solve(k, ks), 0.0))
    return out, dev


def register(points: np.ndarray, values: np.ndarray, sample, shift: float = 200.0, turn: float = math.radians(8), step: float = 50.0, turns: int = 9) -> tuple[float, float, float, float]:
    """(theta, dx, dy, error) of the rigid motion about the points' mean that fits a reference field best: a grid search, then half steps."""
    c = points.mean(0)

    def error(p):
        s, k = math.sin(p[0]), math.cos(p[0])
        v = sample((points - c) @ np.array([[k, s], [-s, k]]) + c + p[1:])
        ok = ~np.isnan(v)
        return float(np.mean((v[ok] - values[ok]) ** 2)) if ok.sum() >= 0.5 * len(v) else math.inf

    grid = [(a, x, y) for a in np.linspace(-turn, turn, turns) for x in np.arange(-shift, shift + 1, step) for y in np.arange(-shift, shift + 1, step)]
    best = min(grid, key=lambda p: (error(p), sum(map(abs, p))))
    size = np.array([turn / (turns - 1), step / 2, step / 2])
    while size[1] > 1:
        tries = [tuple(np.clip(np.array(best) + d * size, [-turn, -shift, -shift], [turn, shift, shift])) for d in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]]
        new = min(tries, key=error)
        if new == best or error(new) >= error(best):
            size = size / 2
        best = new
    return (*map(float, best), error(best))


def icp(moving: np.ndarray, walls: np.ndarray, start: tuple[float, float, float], rounds: int = 20, turn: float = math.radians(3), near: float = 60.0) -> tuple[float, float, float, float]:
    """(theta, tx, ty, overlap): point-to-line refinement of a scan's wall points on walls (ax, ay, bx, by); the turn changes by at most so much."""
    p = np.array(start, float)
    a, d = walls[:, :2], walls[:, 2:] - walls[:, :2]
    n = np.stack([-d[:, 1], d[:, 0]], 1) / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)

    def nearest(q):
        t = np.clip(np.einsum("nmi,mi->nm", q[:, None] - a, d) / np.maximum((d * d).sum(1), 1e-9), 0, 1)
        foot = a + t[..., None] * d
        d2 = ((q[:, None] - foot) ** 2).sum(2)
        w = d2.argmin(1)
        return foot[np.arange(len(q)), w], n[w], np.sqrt(d2[np.arange(len(q)), w])

    def put(p):
        s, c = math.sin(p[0]), math.cos(p[0])
        return moving @ np.array([[c, s], [-s, c]]) + p[1:]

    for _ in range(rounds):
        q = put(p)
        foot, nn, dist = nearest(q)
        ok = dist <= near
        if ok.sum() < 3:
            break
        r = ((q - foot) * nn).sum(1)[ok]
        o = q - p[1:]
        j = np.stack([(np.stack([-o[:, 1], o[:, 0]], 1) * nn).sum(1), nn[:, 0], nn[:, 1]], 1)[ok]
        move = np.linalg.solve(j.T @ j + 1e-6 * np.eye(3), j.T @ r)
        p = p - move
        p[0] = np.clip(p[0], start[0] - turn, start[0] + turn)
        if np.abs(move).max() < 1e-6:
            break
    return (*map(float, p), float((nearest(put(p))[2] <= near / 3).mean()))


def align_scans(points: np.ndarray, doors_a: np.ndarray, doors_b: np.ndarray, walls: np.ndarray, ambiguous: float = 0.85) -> tuple[tuple, bool] | None:
    """The best of four quarter turns x door pairs after icp(), and whether another place scores nearly as well."""
    found = []
    for k in range(4):
        th = k * math.pi / 2
        s, c = math.sin(th), math.cos(th)
        for a in doors_a:
            for b in doors_b:
                at = b - np.array([c * a[0] - s * a[1], s * a[0] + c * a[1]])
                found.append(icp(points, walls, (th, *at)))
    found.sort(key=lambda f: -f[3])
    if not found:
        return None
    best = found[0]
    rival = next((f for f in found[1:] if math.dist(f[1:3], best[1:3]) > 100 or abs(math.remainder(f[0] - best[0], 2 * math.pi)) > 0.2), None)
    return best, bool(rival and rival[3] >= ambiguous * best[3])


def connectors(rows: list[tuple[str, str, int, float, float]], near: float = 8.0) -> dict[str, int]:
    """Groups of connectors (id, category, floor, x, y) across floors: by category, each joins the nearest free one of the floor below within reach."""
    group, k = {}, 0
    for cat in sorted({r[1] for r in rows}):
        mine = sorted((r for r in rows if r[1] == cat), key=lambda r: (r[2], r[0]))
        for r in mine:
            used = {group[o[0]] for o in mine if o[2] == r[2] and o[0] in group}
            below = [(math.dist(r[3:], o[3:]), o[0]) for o in mine if o[2] < r[2] and group[o[0]] not in used]
            d = min(below, default=(math.inf, ""))
            if d[0] < near:
                group[r[0]] = group[d[1]]
            else:
                group[r[0]], k = k, k + 1
    return group


def turns(path: list[tuple[float, float]], straight: float = math.radians(20)) -> list[tuple[int, str]]:
    """(index, left or right) of a route's turns; y grows downward and heading 0 is +y."""
    out = []
    for i in range(1, len(path) - 1):
        a = math.atan2(path[i][0] - path[i - 1][0], path[i][1] - path[i - 1][1])
        b = math.atan2(path[i + 1][0] - path[i][0], path[i + 1][1] - path[i][1])
        t = math.remainder(b - a, 2 * math.pi)
        if abs(t) > straight:
            out.append((i, "left" if t > 0 else "right"))
    return out


def simplify(path: list[tuple[float, float]], tolerance: float = 10.0) -> list[tuple[float, float]]:
    """A route without points that lie within a tolerance of the line between those kept."""
    if len(path) < 3:
        return list(path)
    a, b = np.array(path[0], float), np.array(path[-1], float)
    p, d = np.array(path[1:-1], float) - a, b - a
    t = np.clip(p @ d / max(d @ d, 1e-12), 0, 1)
    far = np.hypot(*(p - t[:, None] * d).T)
    i = int(far.argmax())
    if far[i] <= tolerance:
        return [path[0], path[-1]]
    return simplify(path[: i + 2], tolerance)[:-1] + simplify(path[i + 1 :], tolerance)


def corridor_similarity(a: np.ndarray, b: np.ndarray, length: int) -> float:
    """The least root mean square difference of demeaned windows of two profiles, either way round."""
    def win(v):
        w = np.lib.stride_tricks.sliding_window_view(v, length)
        return w - w.mean(1, keepdims=True)

    if len(a) < length or len(b) < length:
        return math.inf
    x, best = win(a), math.inf
    for y in (win(b), win(b[::-1])):
        best = min(best, float(np.sqrt(((x[:, None] - y[None]) ** 2).mean(2)).min()))
    return best


class RadioCheck(Machine):
    """Cross-check of a track by radio fixes: disagreement in a row blocks, then declares the track lost. Rows: t, x, y, rx, ry (null if unknown). Gives (t, state)."""

    def __init__(self, far: float = 1500.0, block: int = 3, lost: int = 6, clear: int = 2):
        self.far, self.block, self.lost, self.clear, self.bad, self.good = far, block, lost, clear, 0, 0

    def step(self, row) -> list[tuple]:
        if row.rx is None or row.rx != row.rx:
            return [(row.t, "unknown")]
        if math.hypot(row.x - row.rx, row.y - row.ry) > self.far:
            self.bad, self.good = self.bad + 1, 0
        else:
            self.good += 1
            if self.good >= self.clear:
                self.bad = 0
        return [(row.t, "lost" if self.bad >= self.lost else "blocked" if self.bad >= self.block else "far" if self.bad else "agreed")]


class CorridorLock(Machine):
    """A heading correction towards a corridor's axis while the last 8 m are straight. Rows: t, x, y. Gives (t, axis, correction); axes in radians."""

    def __init__(self, axes: list[float], span: float = 800.0, straight: float = 0.97, most: float = 0.1, gate: float = math.radians(15)):
        self.axes, self.span, self.straight, self.most, self.gate = axes, span, straight, most, gate
        self.pts: list[tuple[float, float]] = []
        self.axis = None

    def step(self, row) -> list[tuple]:
        self.pts.append((row.x, row.y))
        while len(self.pts) > 2 and sum(math.dist(a, b) for a, b in zip(self.pts[1:], self.pts[2:], strict=False)) > self.span:
            self.pts.pop(0)
        p = np.array(self.pts)
        if len(p) < 5:
            return [(row.t, None, 0.0)]
        w, v = np.linalg.eigh(np.cov((p - p.mean(0)).T))
        if w[1] <= 0 or math.sqrt(max(w[1] - w[0], 0) / w[1]) < self.straight:
            return [(row.t, None, 0.0)]
        head = math.atan2(v[0, 1], v[1, 1])
        off = lambda a: (a - head + math.pi / 2) % math.pi - math.pi / 2
        if self.axis is None or abs(off(self.axis)) > self.gate:
            self.axis = min(self.axes, key=lambda a: abs(off(a)), default=None)
        if self.axis is None or abs(off(self.axis)) > self.gate:
            self.axis = None
            return [(row.t, None, 0.0)]
        return [(row.t, self.axis, float(np.clip(off(self.axis), -self.most, self.most)))]
