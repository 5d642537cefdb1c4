"""The Parzen search against densities computed by hand, and its pruning."""

import math

import numpy as np
import pytest

from pricefold.operators import search as S


def mixture(points, widths, low, high, x):
    """Cut-off normals of equal weight by numerical integration."""
    grid = np.linspace(low, high, 20_001)
    total = 0.0
    for c, w in zip(points, widths):
        bell = lambda t: np.exp(-((t - c) / w) ** 2 / 2)                                   # noqa: B023, E731
        area = float(((bell(grid[1:]) + bell(grid[:-1])) / 2 * np.diff(grid)).sum())
        total += float(bell(x)) / area
    return total / len(points)


def test_density_equals_the_mixture_by_hand():
    p = S.Parzen.of([0.2, 0.3, 0.9], 0.0, 1.0)
    assert p.centres == (0.2, 0.3, 0.5, 0.9)
    # neighbours: 0 and 0.3; 0.2 and 0.5; the range; 0.5 and 1
    assert p.widths == pytest.approx((0.2, 0.2, 1.0, 0.4))
    for x in (0.0, 0.25, 0.6, 1.0):
        assert p.density(x) == pytest.approx(mixture(p.centres, p.widths, 0.0, 1.0, x), rel=1e-5)
    assert S.Parzen.of([], 0.0, 2.0).widths == (2.0,)
    assert min(S.Parzen.of([0.5 + k * 1e-6 for k in range(300)], 0.0, 1.0).widths) == pytest.approx(0.01)


def trials(n=12):
    out = [S.Trial(k, {"a": 0.05 + 0.07 * k, "n": 2 + k}, [abs(0.4 - (0.05 + 0.07 * k))]) for k in range(n)]
    return out


def test_proposal_has_the_largest_ratio_by_hand():
    space, done = {"a": S.Range(0.0, 1.0), "n": S.Range(1, 20, whole=True)}, trials()
    got = S.propose(space, done, 12, seed=5)
    best = sorted(done, key=lambda t: t.value)[:2]                       # ceil(0.1 * 12)
    rest = [t for t in done if t not in best]
    assert S.split_trials(done) == (best, sorted(rest, key=lambda t: t.value))
    for name, low, high in (("a", 0.0, 1.0), ("n", 0.5, 20.5)):
        good, bad = (S.Parzen.of([t.params[name] for t in ts], low, high) for ts in (best, rest))
        tries = [good.sample(S.draw(5, 12, name, k, "a"), S.draw(5, 12, name, k, "b")) for k in range(S.CANDIDATES)]
        ratio = [math.log(mixture(good.centres, good.widths, low, high, x)) - math.log(mixture(bad.centres, bad.widths, low, high, x)) for x in tries]
        x = tries[int(np.argmax(ratio))]
        assert got[name] == pytest.approx(x if name == "a" else round(x))


def test_the_first_trials_are_spread_and_samples_stay_inside():
    space = {"r": S.Range(0.01, 1.0, log=True)}
    first = [S.propose(space, trials(3)[:0], k, 1)["r"] for k in range(400)]
    assert 0.01 <= min(first) < 0.012 and 0.8 < max(first) <= 1.0 and 0.4 < np.mean(np.array(first) < 0.1) < 0.6
    p = S.Parzen.of([0.0, 1.0], 0.0, 1.0)
    draws = [p.sample(S.draw(k, 1), S.draw(k, 2)) for k in range(500)]
    assert min(draws) >= 0 and max(draws) <= 1


def test_median_pruning():
    done = [S.Trial(k, {}, [1.0 + k, 2.0 + k, 3.0 + k]) for k in range(5)]
    assert not S.pruned(done, [9.0])                                     # the first fold is never enough
    assert S.pruned(done, [9.0, 4.5]) and not S.pruned(done, [9.0, 4.0]) and not S.pruned(done[:4], [9.0, 9.0])


def test_search_finds_the_low_and_prunes():
    calls = []

    def score(p, k):
        calls.append(k)
        return (math.log10(p["r"]) + 1.5) ** 2 + (p["n"] - 7) ** 2 / 50 + 0.01 * k
    space = {"r": S.Range(0.001, 1.0, log=True), "n": S.Range(1, 20, whole=True)}
    out = S.search(space, score, folds=4, trials=50)
    best = S.best_trial(out)
    assert [t.number for t in out] == list(range(50)) and best.value == min(t.value for t in out if len(t.scores) == 4)
    assert best.value < 0.12 and any(t.pruned for t in out) and len(calls) == sum(len(t.scores) for t in out) < 200
    late = np.mean([t.value for t in out[25:]])
    assert late < np.mean([t.value for t in out[:10]])
    assert [t.params for t in S.search(space, score, folds=4, trials=12)] == [t.params for t in out[:12]]


def test_folds_that_pruning_cannot_spare_run_side_by_side():
    import threading
    start, second = threading.Barrier(20), threading.Barrier(10)             # 5 trials: all 4 folds at first, then the first 2

    def score(p, k):
        if not start.broken and len(seen) < 20:
            seen.append(k)
            start.wait(20)
        elif k < 2:
            second.wait(20)
        calls.append(k)
        return p["r"] + 0.01 * k
    seen, calls = [], []
    out = S.search({"r": S.Range(0.0, 1.0)}, score, folds=4, trials=10)
    assert sorted(seen) == sorted([0, 1, 2, 3] * 5) and len(calls) == sum(len(t.scores) for t in out)
    assert S.sure_folds([], 4) == 4 and S.sure_folds(out[:5], 4) == 2
    assert S.sure_folds([S.Trial(k, {}, [1.0]) for k in range(9)], 4) == 4
