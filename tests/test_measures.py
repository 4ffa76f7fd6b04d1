"""Known values, a naive recurrence, and invariants of the pair measures."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tempora.kernels import dtw, measures
from tempora.settings import DistanceSettings as S

A, B = [0, 0, 1, 2, 1, 0, 1, 0, 0], [0, 1, 2, 0, 0, 0, 0, 0, 0]
C, D = [0, 0, 2, 1, 1, 0, 0], [0, 1, 1, 1, 0, 0, 0]


def one(a, b, **settings) -> float:
    return float(dtw.distances([a], [b], S(**settings))[0])


def naive(a, b, s: S) -> float:
    n, m = len(a), len(b)
    table = np.full((n + 1, m + 1), np.inf)
    p = s.psi4
    table[0, : min(p[2], m) + 1] = 0
    table[: min(p[0], n) + 1, 0] = 0
    pen = s.to_cost(s.penalty)
    for i in range(n):
        lo, hi = (0, m) if not s.window else (max(0, i - max(0, n - m) - s.window + 1), min(m, i + max(0, m - n) + s.window))
        for j in range(lo, hi):
            d = (a[i] - b[j]) ** 2 if s.squared else abs(a[i] - b[j])
            if s.max_step is None or d <= s.to_cost(s.max_step):
                table[i + 1, j + 1] = d + min(table[i, j], table[i, j + 1] + pen, table[i + 1, j] + pen)
    v = min(table[n, max(0, m - p[3]) :].min(), table[max(0, n - p[1]) :, m].min())
    if s.max_dist is not None and v > s.to_cost(s.max_dist) or s.max_length_diff is not None and abs(n - m) > s.max_length_diff:
        v = np.inf
    return math.sqrt(v) if s.squared else float(v)


def test_known_distances():
    assert one(A, B) == pytest.approx(math.sqrt(2))
    assert one(A, B, inner="euclidean") == 2
    assert dtw.euclidean(A, B, S()) == pytest.approx(2.8284271247461903)
    assert one(C, D, max_dist=1.1) == 1 and one(C, D, max_dist=0.1) == math.inf
    assert one(C, D, max_step=1.1) == 1 and one(C, D, max_step=0.1) == math.inf
    x = np.arange(0, 20, 0.5)
    assert one(np.sin(x), np.sin(x - 1), psi=2) == 0
    assert one([0, 1], [0, 0], psi=(0, 1, 0, 0)) == 0 and one([0, 1], [0, 0], psi=(0, 0, 0, 1)) == 1
    assert dtw.envelope_bound(np.array([1, 2, 1, 3.0]), np.array([3, 4, 3, 0.0]), S(window=2)) == pytest.approx(2.23606797749979)


@pytest.mark.parametrize("seed", range(60))
def test_against_the_plain_recurrence(seed):
    r = np.random.default_rng(seed)
    a = [r.integers(0, 5, r.integers(1, 9)).astype(float) for _ in range(12)]
    b = [r.integers(0, 5, r.integers(1, 9)).astype(float) for _ in range(12)]
    s = S(window=r.choice([None, 1, 2, 4]), penalty=float(r.choice([0, 0.5])), psi=tuple(int(z) for z in r.integers(0, 3, 4)) if r.random() < 0.5 else 0, inner=str(r.choice(["squared euclidean", "euclidean"])), max_step=r.choice([None, 2.5]), max_dist=r.choice([None, 3.0]), max_length_diff=r.choice([None, 2]))
    assert np.allclose(dtw.distances(a, b, s), [naive(x, y, s) for x, y in zip(a, b, strict=True)])


def test_bounds_and_symmetry():
    r = np.random.default_rng(1)
    for _ in range(40):
        a, b = r.normal(size=20).cumsum(), r.normal(size=20).cumsum()
        d = one(a, b, window=4)
        assert dtw.envelope_bound(a, b, S(window=4)) <= d + 1e-9 <= dtw.euclidean(a, b, S()) + 2e-9
        assert d == pytest.approx(one(b, a, window=4)) and one(a, a) == 0 and one(a, b) <= d + 1e-9


def test_paths_cost_their_distance_and_divided_paths_too(monkeypatch):
    r = np.random.default_rng(2)
    for penalty in (0.0, 0.3):
        s = S(penalty=penalty)
        for _ in range(10):
            a, b = r.normal(size=30).cumsum(), r.normal(size=37).cumsum()
            d, (path,) = dtw.warped([a], [b], s)
            steps = np.diff(path, axis=0)
            assert path[0].tolist() == [0, 0] and path[-1].tolist() == [29, 36]
            assert set(map(tuple, steps.tolist())) <= {(1, 1), (0, 1), (1, 0)}
            assert dtw.path_distance(a, b, path, s) == pytest.approx(d[0])
            monkeypatch.setattr(dtw, "TABLE_CELLS", 60)
            assert dtw.path_distance(a, b, dtw.divided_path(a, b, s), s) == pytest.approx(d[0])
            monkeypatch.undo()


def test_vectors_dependent():
    a = np.array([[0, 0], [0, 1], [2, 1], [0, 0.0]])
    b = np.array([[0, 0], [2, 1], [0, 1], [0, 0.5]])
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    t = np.full((5, 5), np.inf)
    t[0, 0] = 0
    for i in range(4):
        for j in range(4):
            t[i + 1, j + 1] = cost[i, j] + min(t[i, j], t[i, j + 1], t[i + 1, j])
    assert dtw.distances([a], [b], S())[0] == pytest.approx(math.sqrt(t[4, 4]))


@pytest.mark.parametrize(("a", "b", "score"), [("GATTACA", "GCATGCU", 0), ("AB", "AB", 2), ("", "AB", -2), ("A", "B", -1)])
def test_alignment(a, b, score):
    found = measures.global_alignment(a, b)
    assert found["score"] == score
    assert "".join(x for x in found["first"] if x != "-") == a and "".join(x for x in found["second"] if x != "-") == b


def test_substitution_scores_are_looked_up_both_ways():
    cost = measures.substitution({("A", "B"): 3.0}, gap=2.0)
    assert cost("B", "A") == (-3.0, 2.0) and cost("A", "B") == (-3.0, 2.0) and cost("C", "C")[0] == 0


def test_move_split_merge():
    assert measures.move_split_merge([1, 2, 3], [1, 2, 3]) == 0
    assert measures.move_split_merge([1, 2, 3], [1, 2, 4]) == 1
    assert measures.move_split_merge([1, 2], [1, 1, 2], 0.1) == pytest.approx(0.1)
    assert measures.move_split_merge([1, 5, 2], [1, 2], 0.1) == measures.move_split_merge([1, 2], [1, 5, 2], 0.1)


def test_neutral_weights_are_plain_warping():
    knots = np.tile([math.inf, math.inf, 0, 0, 0, 0, math.inf, math.inf], (len(A), 1))
    assert measures.weighted_distance(A, B, knots) == pytest.approx(one(A, B))
    dead = np.tile([math.inf, 6, 5, 5, 5, 5, 6, math.inf], (len(A), 1))
    assert measures.weighted_distance(A, B, dead) == 0


def test_sampled_paths_are_valid():
    path = dtw.sampled_path(A, B, S(), 1.0, 3)
    assert path[0].tolist() == [0, 0] or 0 in path[0].tolist()
    assert path[-1].tolist() == [8, 8]


def test_settings_survive_json():
    s = S(window=3, psi=(1, 2, 3, 4), penalty=0.5)
    assert S.from_json(s.to_json()) == s
    with pytest.raises(ValueError):
        S(inner="cosine")


def test_batches_are_the_pairs_one_by_one():
    rng = np.random.default_rng(3)
    some = [rng.normal(size=int(n)).round(1) for n in rng.integers(0, 9, 25)]
    pairs = [(a, b) for a in some for b in some]
    first, second = zip(*pairs, strict=True)
    assert np.allclose(measures.split_merge_all(first, second, 0.1), [measures.move_split_merge(a, b, 0.1) for a, b in pairs])
    knots = np.array([4, 1.5, 0.6, 0.1, 0.2, 0.5, 2, 5.0])
    whole = [(a, b) for a, b in pairs if len(a) and len(b)]
    held = [[np.concatenate([x[:, None], np.tile(knots, (len(x), 1))], 1) for x in side] for side in zip(*whole, strict=True)]
    for window in (None, 3):
        both = [min(measures.weighted_distance(x, y, np.tile(knots, (len(x), 1)), window) for x, y in ((a, b), (b, a))) for a, b in whole]
        assert np.allclose(measures.weighted_all(*held, window), both)


@pytest.mark.parametrize("options", [{}, {"window": 4}, {"psi": (1, 2, 3, 1)}, {"penalty": 0.3}, {"inner": "euclidean"}, {"window": 6, "window_type": "slanted"}, {"max_length_diff": 3}])
def test_limits_give_up_only_what_is_beyond(options):
    rng = np.random.default_rng(4)
    some = [rng.normal(size=int(n)) for n in rng.integers(5, 25, 30)]
    p, q = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30), indexing="ij"))
    full = dtw.distances_among(some, p, q, S(**options))
    assert np.array_equal(full, dtw.distances([some[k] for k in p], [some[k] for k in q], S(**options)))
    limit = float(np.quantile(full[np.isfinite(full)], 0.1))
    assert np.array_equal(dtw.distances_among(some, p, q, S(**options, max_dist=limit)), np.where(full <= limit, full, np.inf))


def test_envelopes_of_a_batch():
    rng = np.random.default_rng(5)
    some = [rng.normal(size=int(n)) for n in rng.integers(1, 20, 30)]
    for s in (S(window=3), S(), S(window=2, inner="euclidean")):
        assert np.allclose(dtw.envelope_bounds(some[0], some, s), [dtw.envelope_bound(some[0], x, s) for x in some])
