import math

import numpy as np

from lodepath.kernels import mapping as mp


def field(p):
    return 40 + 8 * np.sin(p[:, 0] / 150) + 6 * np.cos(p[:, 1] / 120)


def test_gp_beats_the_mean_at_held_out_cells():
    g = np.array([(x, y) for x in range(0, 1000, 50) for y in range(0, 1000, 50)], float)
    out = np.random.default_rng(0).random(len(g)) < 0.2
    m, s = mp.gp_fill(g[~out], field(g[~out]), g[out])
    assert np.nanmedian(np.abs(m - field(g[out]))) < 0.5 and np.nanmin(s) >= 0
    assert np.isnan(mp.gp_fill(g, field(g), np.array([[5000.0, 5000.0]]))[0]).all()


def test_registration_finds_a_motion():
    p = np.random.default_rng(1).random((200, 2)) * 900
    c, th, move = p.mean(0), 0.05, np.array([60.0, -90.0])
    s, k = math.sin(th), math.cos(th)
    t, dx, dy, e = mp.register(p, field((p - c) @ np.array([[k, s], [-s, k]]) + c + move), field)
    assert abs(t - th) < 0.03 and abs(dx - 60) < 20 and abs(dy + 90) < 20 and e < 0.5


def test_icp_puts_a_room_on_its_walls():
    walls = np.array([[0, 0, 600, 0], [600, 0, 600, 400], [600, 400, 0, 400], [0, 400, 0, 0]], float)
    p = np.concatenate([np.linspace(w[:2], w[2:], 40) for w in walls])
    th, tx, ty, overlap = mp.icp(p, walls, (0.02, 15.0, -20.0))
    assert abs(th) < 0.01 and abs(tx) < 3 and abs(ty) < 3 and overlap > 0.95
    best, unsure = mp.align_scans(p, np.array([[300.0, 0.0]]), np.array([[300.0, 0.0]]), walls)
    assert best[3] > 0.95


def test_connectors_routes_and_checks():
    g = mp.connectors([("a", "lift", 0, 0, 0), ("b", "lift", 1, 1, 1), ("c", "lift", 1, 20, 0), ("d", "stairs", 0, 0, 0)])
    assert g["a"] == g["b"] != g["c"] and len(set(g.values())) == 3
    assert mp.turns([(0, 0), (0, 10), (10, 10), (10, 0)]) == [(1, "left"), (2, "left")]
    assert mp.simplify([(0, 0), (50, 1), (100, 0), (100, 80)]) == [(0, 0), (100, 0), (100, 80)]
    a = np.sin(np.arange(40) / 3)
    assert mp.corridor_similarity(a, a[::-1], 10) < 1e-9 and mp.corridor_similarity(a[:5], a, 10) == math.inf
    row = lambda t, r: type("R", (), {"t": t, "x": 0.0, "y": 0.0, "rx": r, "ry": 0.0})
    m = mp.RadioCheck()
    assert [m.step(row(i, r))[0][1] for i, r in enumerate([None, 0.0, 9999.0, 9999.0, 9999.0, 0.0, 0.0])] == ["unknown", "agreed", "far", "far", "blocked", "blocked", "agreed"]
    k = mp.CorridorLock([0.0])
    out = [k.step(type("R", (), {"t": i, "x": i * 2.0, "y": i * 50.0}))[0] for i in range(20)]
    assert out[-1][1] == 0.0 and abs(out[-1][2] + math.atan2(2, 50)) < 1e-6
