"""Matches, knees, filters, symbols, explanations, trees and linkage on small inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tempora.kernels import explain, filters, subsequence, symbols, tree
from tempora.operators import cluster
from tempora.settings import ConcurrenceSettings


def test_smoothing_known_values():
    series = np.diff(np.array([0.1, 0.3, 0.2, 0.1] * 3))
    want = [0.02217, 0.010307, 0.002632, 0.001504, 0.001629, -0.000457, -0.001698, -0.001238, -0.004681, -0.014869, -0.026607]
    assert np.allclose(filters.smoothed(series, 0.1), want, atol=1e-6)


def test_subsequence_segments():
    a = subsequence.Alignment([1.0, 2, 0], [1.0, 0, 1, 2, 1, 0, 2, 0, 3, 0, 0])
    found = list(a.matches(k=3))
    assert [[m.begin, m.end] for m in found] == [[2, 4], [5, 7], [0, 1]]
    assert found[0].path == ((0, 2), (1, 3), (2, 4))


LONGER = [1.0, 0, 1, 2, 1, 0, 2, 0, 3, 0, 0, 5, 6, *[0.0] * 10]


@pytest.mark.parametrize("stop", [{"max_range_factor": 1.2}, {"knee_alpha": 0.3}])
def test_matches_that_overlap_are_passed_over(stop):
    found = subsequence.Alignment([1.0, 2, 0], LONGER).matches(k=None, **stop)
    assert [[m.begin, m.end] for m in found] == [[2, 4], [5, 7], [0, 1], [4, 5]]


def test_no_point_ends_two_matches():
    r = np.random.default_rng(3)
    for overlap in (0, 2):
        a = subsequence.Alignment(r.normal(size=8), r.normal(size=200).cumsum())
        taken: set[int] = set()
        for m in a.matches(k=20, overlap=overlap):
            steps = m.end - m.begin
            own = set(range(m.idx + 1 - steps + min(overlap, steps - 1), m.idx + 1))
            assert not own & taken
            taken |= own


def test_subsequence_stops_by_range_or_knee():
    a = subsequence.Alignment([1.0, 2, 0], [1.0, 0, 1, 2, 1, 0, 2, 0, 3, 0, 0, 0, 0, 0, 9, 9, 9])
    assert len(list(a.matches(k=None, max_range_factor=2))) < len(list(a.matches(k=None)))


def test_knee_stops_after_a_jump():
    k = subsequence.Knee(0.3)
    assert [k.stop(v) for v in (1.0, 1.2, 1.1, 1.2, 1.1, 9.0)] == [False] * 5 + [True]


def test_concurrences_find_a_repeated_pattern():
    v = np.zeros(60)
    bump = 3 * np.sin(np.linspace(0, np.pi, 10))
    v[5:15] += bump
    v[40:50] += bump
    v += np.random.default_rng(0).normal(0, 0.01, 60)
    s = subsequence.ConcurrenceSettings(gamma=4.0, tau=0.5, delta=-1.0, delta_factor=0.5, only_triu=True)
    paths = list(subsequence.Concurrences(v, None, s).matches(k=12, min_length=8))
    assert any(abs((j - i) - 35) <= 2 for p in paths for i, j in p[len(p) // 2 : len(p) // 2 + 1])


def test_estimated_settings():
    s = subsequence.concurrence_settings([1.0, 3.0], 1.0, "std")
    assert s.gamma == 1 and s.tau == pytest.approx(math.exp(-1)) and s.delta == pytest.approx(-2 * s.tau)
    assert s.with_penalty_in_series(0.5).penalty_in_series == pytest.approx(0.5)


def test_neighbours():
    n = subsequence.Neighbours([3, 1, 2])
    assert n.below(2) == 1 and n.below(2, equal=True) == 2 and n.above(3) is None
    n.remove(2)
    assert n.above(1) == 3


def test_cover_paints_matches_and_leaves_the_rest():
    v = [0.0] * 6 + [1, 2, 3, 2, 1] + [0.0] * 6 + [5, 5, 5, 5]
    codes = symbols.cover(v, [[1.0, 2, 3, 2, 1]], max_range_factor=1.5)
    assert (codes[6:11] == 0).all() and (codes[17:] == 1).all()


def test_hangover_keeps_long_runs():
    codes = [0] * 7 + [1] * 2 + [0] * 8 + [2] * 9 + [1]
    assert symbols.hangover(codes, 4) == [(1, 0, 7), (3, 17, 26)]


def test_votes_follow_the_window():
    table = np.array([[0.0, 9, 0, 0], [9, 0.0, 9, 9]])
    assert symbols.by_least(table).tolist() == [0, 1, 0, 0]
    assert symbols.by_vote(table, 3).tolist()[0] == 0


@pytest.mark.parametrize("split", list(explain.Split))
@pytest.mark.parametrize("tolerance", [t for t in explain.Tolerance if t is not explain.Tolerance.MEAN_INDEX])
def test_explanations_keep_ends_and_order(split, tolerance):
    x = np.linspace(0, 6, 60)
    e = explain.Explanation(np.sin(x), np.sin(x * 1.1 - 0.5), tolerance, split=split)
    assert e.segments[0].s_p == 0 and e.segments[-1].e_p == len(e.path) - 1
    assert all(a.e_p == b.s_p for a, b in zip(e.segments[:-1], e.segments[1:], strict=True))
    if tolerance is explain.Tolerance.MAX_FACTOR:
        assert e.distance_straight() <= e.distance() * math.sqrt(2) + 1e-9


def test_no_mean_index():
    with pytest.raises(NotImplementedError):
        explain.Explanation([0.0, 1], [0.0, 1], explain.Tolerance.MEAN_INDEX)


def test_line_cells_touch_both_ends_once_a_step():
    for end in ((5, 2), (2, 5), (4, 4), (0, 3), (3, 0)):
        cells = explain.line_cells((0, 0), end)
        assert cells[0] == (0, 0) and cells[-1] == end and len(cells) == max(end) + 1
        assert all(0 <= b[0] - a[0] <= 1 and 0 <= b[1] - a[1] <= 1 for a, b in zip(cells[:-1], cells[1:], strict=True))


def test_split_gain_and_tree():
    v, t = np.array([1.0, 2, 3, 4, 5, 6, 7, 8]), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    gain, threshold = tree.best_split(v, t)
    assert threshold == 4.5 and gain == pytest.approx(math.log(2))
    grown = tree.fit(np.stack([v, v * 0], 1), t)
    assert grown.used == {0} and grown.depth == 1 and grown.leaf_entropy() == 0


def test_learned_weights_punish_what_separates():
    r = np.random.default_rng(3)
    proto = np.zeros(12)
    must = [r.normal(0, 0.05, 12) for _ in range(8)]
    cannot = [m + np.where(np.arange(12) == 6, 2.0, 0) for m in must]
    knots, importance = tree.learned_weights(proto, must + cannot, [1] * 8 + [0] * 8)
    assert importance.sum() > 0 and np.isfinite(knots[importance.sum(1) > 0]).any()


def test_linkage_and_agglomeration_rows():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]])
    for method in ("single", "complete", "average", "weighted"):
        rows = cluster.linkage(d, method)
        assert rows[:, 2].tolist() == [1, 2, 9] and rows[-1, 3] == 4
    assert cluster.tree_of([(0, 1, 1.0, 2), (2, 3, 2.0, 2), (0, 2, 9.0, 4)], 4)[-1] == (2, 4, 5, 9.0, 4)
    assert "2 -> 0" in cluster.to_dot(cluster.tree_of([(0, 1, 1.0, 2)], 2), 2)


def test_distances_of_match_sets():
    settings = ConcurrenceSettings(gamma=1.0, tau=0.5, delta=-1.0, delta_factor=0.5, penalty=0.0)
    c = subsequence.Concurrences([0.0, 1.0, 2.0, 9.0], [0.0, 1.0, 3.0, 5.0, 5.0], settings)
    paths = [[(0, 0), (1, 1), (2, 2)]]
    assert c.distance(paths) == 1.0
    # one of four and two of five points are missed: two times the penalty, and 1 + 9 / 4 as the factor
    assert c.distance(paths, compensated=True) == pytest.approx(np.sqrt(1 + (1 + 9 * 0.25) * 2))
    assert c.distance(paths, compensated=True, penalty=3.0, max_factor=None) == pytest.approx(np.sqrt(7))
    assert c.similarities()[0, 1] == -1.0 and c.similarities()[1, 1] == 1.0
    assert c.part(slice(1, 3), slice(0, 2)).shape == (2, 2) and (c.part(positive=True) >= 0).all()


def test_hooks_choose_by_weight():
    weights = {0: 1.0, 1: 1.0, 2: 5.0}
    keep = cluster.weight_hook(weights, {0: 9, 1: 4, 2: 9})
    assert keep(0, 1, 0.5) == 1 and weights[1] == 2.0
    assert keep(1, 2, 0.7) == 2 and weights[2] == 7.0
    assert cluster.order_hook({0: 1, 1: 1, 2: 5, 3: 5})([(0, 1), (0, 2), (1, 3)]) == (0, 2)


def by_cell(a, b, s):
    """Accumulated affinities, a cell at a time."""
    pad = 2 if s.steps == "typeIII" else 1
    out = np.zeros((len(a) + pad, len(b) + pad))
    for i in range(len(a)):
        for j in range(len(b)):
            r, c = i + pad, j + pad
            if (s.only_triu and j < i) or (s.window and not i - max(0, len(a) - len(b)) - s.window < j < i + max(0, len(b) - len(a)) + s.window):
                out[r, c] = -np.inf
                continue
            alike = np.exp(-s.gamma * (a[i] - b[j]) ** 2)
            sides = {"typeI": [out[r - 1, c], out[r, c - 1]], "typeIII": [out[r - 1, c - 2], out[r - 2, c - 1]], "diagonal": []}[s.steps]
            best = max(0.0, out[r - 1, c - 1], *(x - s.penalty for x in sides))
            out[r, c] = max(0.0, s.delta + s.delta_factor * best if alike < s.tau else alike + best)
    return out


@pytest.mark.parametrize("steps", ["typeI", "typeIII", "diagonal"])
def test_concurrences_of_a_batch_are_those_of_each_series(steps, monkeypatch):
    r = np.random.default_rng(4)
    values = [np.round(r.normal(size=n), 1) for n in r.integers(1, 25, 20).tolist() * 2]
    for window in (None, 3):
        s = ConcurrenceSettings(gamma=1.0, tau=0.4, delta=-0.8, delta_factor=0.9, penalty=0.04, window=window, only_triu=True, steps=steps)
        for v in values:
            assert np.allclose(subsequence.Concurrences(v, None, s).table, by_cell(v, v, s), rtol=1e-12)
        assert np.allclose(subsequence.Concurrences(values[0], values[1], s).table, by_cell(values[0], values[1], s), rtol=1e-12)
        monkeypatch.setattr(subsequence, "BATCH_CELLS", 1500)
        for options in ((None, 1, None), (3, 5, None), (None, 2, 0.3)):
            k, least, knee = options
            found = dict(subsequence.concurrences_among(values, [s] * len(values), *options))
            assert found.keys() == set(range(len(values)))
            assert all([[*map(tuple, p.tolist())] for p in found[n]] == list(subsequence.Concurrences(v, None, s).matches(k, least, 0, knee)) for n, v in enumerate(values))


def test_a_cell_is_traced_once(monkeypatch):
    c = subsequence.Concurrences(np.sin(np.arange(80.0) / 3), None, subsequence.ConcurrenceSettings(gamma=1.0, tau=0.4, delta=-0.8, delta_factor=0.9, penalty=0.04))
    steps, trace = [], c.trace
    monkeypatch.setattr(c, "trace", lambda *a: steps.append(trace(*a)) or steps[-1])
    cells, found = int(c.open.sum()), list(c.matches())
    assert found and sum(map(len, steps)) <= 2 * cells
