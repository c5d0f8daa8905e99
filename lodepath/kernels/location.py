"""Location kernels: particle filter on a field map, Viterbi over a point graph, routes, alignment solvers."""

from __future__ import annotations

import heapq
import math

import numpy as np

from lodepath.kernels.base import Machine


class Particles(Machine):
    """A particle filter over a field grid: moves with heading bias and step scale, observed every `every` cm of path.

    grid: rows x cols x 1 values, NaN where unknown. Rows: t, dx, dy, b. Gives (t, x, y, spread, converged)."""

    def __init__(self, grid: np.ndarray, cell: float, start: tuple[float, float] | None = None, n: int = 1500, cold: int = 6000, every: float = 50.0, sd: float = 2.0, nu: float = 4.0, seed: int = 1):
        self.grid, self.cell, self.every, self.sd, self.nu = grid, cell, every, sd, nu
        self.rng = np.random.default_rng(seed)
        self.n, h, w = n, grid.shape[0] * cell, grid.shape[1] * cell
        m = n if start else cold
        self.xy = self.rng.normal(start, 50.0, (m, 2)) if start else self.rng.random((m, 2)) * (w, h)
        self.turn, self.scale = self.rng.normal(0, 0.1 if start else math.pi, m), self.rng.normal(1, 0.05, m)
        self.logw, self.path, self.converged = np.zeros(m), 0.0, bool(start)

    def _field(self) -> np.ndarray:
        c = np.floor(self.xy / self.cell).astype(int)
        ok = (c >= 0).all(1) & (c[:, 0] < self.grid.shape[1]) & (c[:, 1] < self.grid.shape[0])
        out = np.full(len(c), np.nan)
        out[ok] = self.grid[c[ok, 1], c[ok, 0]]
        return out

    def step(self, row) -> list[tuple]:
        s, c = np.sin(self.turn), np.cos(self.turn)
        move = np.stack([c * row.dx - s * row.dy, s * row.dx + c * row.dy], 1) * self.scale[:, None]
        d = math.hypot(row.dx, row.dy)
        self.xy = self.xy + move + self.rng.normal(0, 0.05 * d + 1e-9, self.xy.shape)
        self.turn = self.turn + self.rng.normal(0, 0.01, len(self.turn))
        self.path += d
        if self.path < self.every:
            return []
        self.path = 0.0
        f = self._field()
        z = np.where(np.isnan(f), 4.0, (f - row.b) / self.sd)
        self.logw += -0.5 * (self.nu + 1) * np.log1p(z * z / self.nu)
        w = np.exp(self.logw - self.logw.max())
        w /= w.sum()
        mean = w @ self.xy
        for radius in (1000.0, 500.0, 300.0):  # mean shift towards the heaviest cluster
            near = ((self.xy - mean) ** 2).sum(1) < radius * radius
            if w[near].sum() > 0:
                mean = w[near] @ self.xy[near] / w[near].sum()
        spread = float(np.sqrt(w @ ((self.xy - mean) ** 2).sum(1)))
        self.converged = spread < (500 if self.converged else 250)
        if 1 / (w * w).sum() < 0.5 * len(w) or len(w) != self.n:
            at = np.searchsorted(np.cumsum(w), (self.rng.random() + np.arange(self.n)) / self.n)
            at = np.minimum(at, len(w) - 1)
            self.xy = self.xy[at] + self.rng.normal(0, 8.0, (self.n, 2))
            self.turn, self.scale, self.logw = self.turn[at] + self.rng.normal(0, 0.02, self.n), self.scale[at] + self.rng.normal(0, 0.005, self.n), np.zeros(self.n)
            fresh = self.rng.random(self.n) < 0.01
            self.xy[fresh] = mean + self.rng.normal(0, 300, (int(fresh.sum()), 2))
        return [(row.t, float(mean[0]), float(mean[1]), spread, bool(self.converged))]


class Viterbi(Machine):
    """The likeliest point of a neighbour graph, online. Rows: t, scores (dict point -> log likelihood). Gives (t, point, p).

    Moves go to a point itself and its neighbours; any other costs `jump`. After `bad` frames whose best is under
    `floor` it starts anew. Time steps are clamped to 0.2-5 s and relax the cost of moving."""

    def __init__(self, neighbours: dict, jump: float = -8.0, stay: float = -0.2, floor: float = -30.0, bad: int = 3):
        self.near, self.jump, self.stay, self.floor, self.limit = neighbours, jump, stay, floor, bad
        self.delta, self.t, self.bad = None, None, 0

    def step(self, row) -> list[tuple]:
        best = max(row.scores.values())
        self.bad = self.bad + 1 if best < self.floor else 0
        if self.bad >= self.limit:
            self.delta, self.bad = None, 0
        if self.delta is None:
            self.delta = dict(row.scores)
        else:
            dt = min(5.0, max(0.2, (row.t - self.t) / 1000))
            top = max(self.delta.values()) + self.jump / dt**0.5
            new = {}
            for p, s in row.scores.items():
                via = [self.delta.get(p, -math.inf) + self.stay] + [self.delta.get(q, -math.inf) - 1.0 / dt for q in self.near.get(p, ())]
                new[p] = s + max(top, *via)
            high = max(new.values())
            self.delta = {p: v - high for p, v in new.items()}
        self.t = row.t
        high = max(self.delta.values())
        z = sum(math.exp(v - high) for v in self.delta.values())
        p = min(k for k, v in self.delta.items() if v == high)
        return [(row.t, p, 1 / z)]


def astar(nodes: dict, edges: dict, start, goal, turn: float = 0.0) -> tuple[list, float] | None:
    """The cheapest route over states (node, predecessor), each change of direction over 30 degrees costing `turn`; ties by node names."""
    h = lambda n: math.dist(nodes[n], nodes[goal])
    heap, seen = [(h(start), 0.0, [start])], {}
    while heap:
        _, g, path = heapq.heappop(heap)
        n, before = path[-1], path[-2] if len(path) > 1 else None
        if n == goal:
            return path, g
        if seen.get((n, before), math.inf) <= g:
            continue
        seen[n, before] = g
        for m in sorted(edges.get(n, ())):
            cost = edges[n][m]
            if before is not None:
                a = math.atan2(nodes[n][0] - nodes[before][0], nodes[n][1] - nodes[before][1])
                b = math.atan2(nodes[m][0] - nodes[n][0], nodes[m][1] - nodes[n][1])
                cost += turn * (abs(math.remainder(b - a, 2 * math.pi)) > math.pi / 6)
            if seen.get((m, n), math.inf) > g + cost:
                heapq.heappush(heap, (g + cost + h(m), g + cost, [*path, m]))
    return None


def visit_order(dist: np.ndarray, start: int = 0, passes: int = 50) -> list[int]:
    """Nearest neighbour, then 2-opt, for a path from `start` over all targets."""
    left, order = set(range(len(dist))) - {start}, [start]
    while left:
        nxt = min(left, key=lambda j: (dist[order[-1], j], j))
        order.append(nxt)
        left.remove(nxt)
    for _ in range(passes):
        better = False
        for i in range(1, len(order) - 1):
            for j in range(i + 1, len(order)):
                a, b, c = order[i - 1], order[i], order[j]
                d = order[j + 1] if j + 1 < len(order) else None
                gain = dist[a, b] + (dist[c, d] if d is not None else 0) - dist[a, c] - (dist[b, d] if d is not None else 0)
                if gain > 1e-9:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return order


def grid_route(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]] | None:
    """A* over eight neighbours without cutting corners, straightened where the line of sight is free."""
    best, heap = {start: 0.0}, [(math.dist(start, goal), start, None)]
    back = {}
    while heap:
        _, n, p = heapq.heappop(heap)
        if n in back:
            continue
        back[n] = p
        if n == goal:
            break
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                r, c = n[0] + dr, n[1] + dc
                if (dr or dc) and 0 <= r < free.shape[0] and 0 <= c < free.shape[1] and free[r, c] and free[n[0], c] and free[r, n[1]]:
                    g = best[n] + math.hypot(dr, dc)
                    if g < best.get((r, c), math.inf):
                        best[r, c] = g
                        heapq.heappush(heap, (g + math.dist((r, c), goal), (r, c), n))
    if goal not in back:
        return None
    path = [goal]
    while back[path[-1]] is not None:
        path.append(back[path[-1]])
    path.reverse()

    def clear(a, b):
        k = max(abs(b[0] - a[0]), abs(b[1] - a[1])) * 2
        return all(free[round(a[0] + (b[0] - a[0]) * i / k), round(a[1] + (b[1] - a[1]) * i / k)] for i in range(k + 1)) if k else True

    out, i = [path[0]], 0
    while i < len(path) - 1:
        j = len(path) - 1
        while j > i + 1 and not clear(path[i], path[j]):
            j -= 1
        out.append(path[j])
        i = j
    return out


def tap_groups(times: list[float], low: float = 200, high: float = 1200) -> list[list[float]]:
    """Runs of exactly three taps with gaps within [low, high] ms."""
    runs, now = [], times[:1]
    for a, b in zip(times, times[1:], strict=False):
        if low <= b - a <= high:
            now.append(b)
        else:
            runs.append(now)
            now = [b]
    runs.append(now)
    return [r for r in runs if len(r) == 3]


def tap_sync(a: list[float], b: list[float], most: float = 20.0) -> tuple[float, float, float] | None:
    """(offset ms at a's first tap, drift ppm, residual) that takes a's taps to b's; None if they don't agree within `most`."""
    if len(a) != len(b) or len(a) < 3:
        return None
    x, d = np.array(a, float), np.array(b, float) - np.array(a, float)
    m = np.stack([np.ones_like(x), (x - x[0]) / 1e6], 1)
    sol = np.linalg.lstsq(m, d, rcond=None)[0]
    worst = float(np.abs(m @ sol - d).max())
    return (float(sol[0]), float(sol[1]), worst) if worst <= most else None


def suppress(peaks: list[tuple[float, float]], apart: float) -> list[tuple[float, float]]:
    """Peaks (time, height) at least `apart`; of nearer ones the higher stays."""
    out: list[tuple[float, float]] = []
    for p in sorted(peaks):
        if out and p[0] - out[-1][0] < apart:
            if p[1] > out[-1][1]:
                out[-1] = p
        else:
            out.append(p)
    return out


def best_lag(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """The lag of y against x, within +-most samples, of the greatest correlation."""
    x, y = x - x.mean(), y - y.mean()
    score = {k: float(x[max(0, -k) : len(x) - max(0, k)] @ y[max(0, k) : len(y) - max(0, -k)]) for k in range(-most, most + 1)}
    return max(score, key=lambda k: (score[k], -abs(k)))


def snap(points: np.ndarray, segments: np.ndarray, rounds: int = 6, turn: float = 0.17, shift: float = 250.0) -> tuple[float, float, float]:
    """(theta, tx, ty) that moves points onto their nearest segments (Gauss-Newton, clamped), about the points' mean."""
    c = points.mean(0)
    p = np.zeros(3)
    for _ in range(rounds):
        s, k = math.sin(p[0]), math.cos(p[0])
        q = (points - c) @ np.array([[k, s], [-s, k]]) + c + p[1:]
        a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
        t = np.clip(np.einsum("nmi,mi->nm", q[:, None] - a, d) / np.maximum((d * d).sum(1), 1e-9), 0, 1)
        foot = a + t[..., None] * d
        best = ((q[:, None] - foot) ** 2).sum(2).argmin(1)
        n = np.stack([-d[best, 1], d[best, 0]], 1) / np.maximum(np.linalg.norm(d[best], axis=1, keepdims=True), 1e-9)
        r = ((q - foot[np.arange(len(q)), best]) * n).sum(1)
        j = np.stack([(np.stack([-(q - c - p[1:])[:, 1], (q - c - p[1:])[:, 0]], 1) * n).sum(1), n[:, 0], n[:, 1]], 1)
        p = p - np.linalg.solve(j.T @ j + np.diag([1e3, 1e-2, 1e-2]), j.T @ r)
        p = np.clip(p, [-turn, -shift, -shift], [turn, shift, shift])
    return tuple(map(float, p))


def tag_correction(knots: np.ndarray, t: np.ndarray, offset: np.ndarray, scale: float = 300.0, stiff: float = 4.0, rounds: int = 10) -> np.ndarray:
    """Corrections at knots from observed offsets at times t: a smooth line through them, Cauchy weights, solved again and again."""
    at = np.clip(np.searchsorted(knots, t) - 1, 0, len(knots) - 2)
    w1 = np.clip((t - knots[at]) / (knots[at + 1] - knots[at]), 0, 1)
    a = np.zeros((len(t), len(knots)))
    a[np.arange(len(t)), at], a[np.arange(len(t)), at + 1] = 1 - w1, w1
    smooth = np.diff(np.eye(len(knots)), axis=0)
    sol = np.zeros((len(knots), 2))
    for _ in range(rounds):
        r = np.linalg.norm(a @ sol - offset, axis=1)
        w = 1 / (1 + (r / scale) ** 2)
        m = a.T @ (w[:, None] * a) + stiff * smooth.T @ smooth + 1e-6 * np.eye(len(knots))
        sol = np.linalg.solve(m, a.T @ (w[:, None] * offset))
    return sol


def clock_offset(t_a: np.ndarray, xy_a: np.ndarray, t_b: np.ndarray, xy_b: np.ndarray, most: int = 5000, least: int = 1000, good: float = 20.0) -> int:
    """Milliseconds by which clock b lags a, searched coarsely then finely; 0 unless it is at least a second and then fits within `good` cm."""

    def error(k: int) -> float:
        x = np.stack([np.interp(t_b + k, t_a, xy_a[:, i]) for i in (0, 1)], 1)
        return float(np.median(np.hypot(*(x - xy_b).T)))

    k = min(range(-most, most + 1, 250), key=lambda v: (error(v), abs(v)))
    k = min(range(k - 250, k + 251, 10), key=lambda v: (error(v), abs(v)))
    return k if abs(k) >= least and error(k) <= good else 0
