"""Parameter search (CV-4): a tree-structured Parzen estimator with median pruning on partial folds.

Trials are a small table (parameters, the running score after each fold, whether they were pruned).  A proposal needs that
table alone: the best trials and the rest each give a density per parameter, a mixture of normals around their values and a
wide one over the whole range, cut off at its ends; of ``CANDIDATES`` draws from the density of the good ones the one of the
largest density ratio is taken.  Trials are proposed ``batch`` at a time and fitted side by side, each a Spark job of its own;
the draws are hashes of (seed, trial, parameter, draw), so a search can be repeated.
"""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import NormalDist, median

CANDIDATES, STARTUP, STARTUP_PRUNING, WARMUP_FOLDS = 24, 10, 5, 1


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    @property
    def ends(self) -> tuple[float, float]:
        half = 0.5 if self.whole else 0.0
        return self.inner(self.low - half), self.inner(self.high + half)

    def outer(self, u: float):
        x = math.exp(u) if self.log else u
        return int(min(self.high, max(self.low, round(x)))) if self.whole else min(self.high, max(self.low, x))


@dataclass
class Trial:
    number: int
    params: dict
    scores: list = field(default_factory=list)          # mean score after each fold that was run
    pruned: bool = False

    @property
    def value(self) -> float:
        return self.scores[-1]


def draw(*key) -> float:
    """A repeatable number in (0, 1)."""
    return (int.from_bytes(hashlib.sha256(":".join(map(str, key)).encode()).digest()[:8], "big") + 0.5) / 2 ** 64


@dataclass(frozen=True)
class Parzen:
    """Mixture of normals of equal weight, cut off at the ends: one per value and one for the whole range."""
    centres: tuple
    widths: tuple
    low: float
    high: float

    @staticmethod
    def of(values: list[float], low: float, high: float) -> Parzen:
        """A value's width is its larger distance to a neighbour (the ends count as neighbours), at least the range over
        ``min(100, n + 2)`` and at most the range."""
        span = high - low
        points = sorted([(v, False) for v in values] + [((low + high) / 2, True)])
        widths = []
        for i, (v, prior) in enumerate(points):
            near = max(v - (points[i - 1][0] if i else low), (points[i + 1][0] if i + 1 < len(points) else high) - v)
            widths.append(span if prior else min(span, max(near, span / min(100, len(values) + 2))))
        return Parzen(tuple(v for v, _ in points), tuple(widths), low, high)

    def _mass(self, c: float, w: float) -> float:
        d = NormalDist(c, w)
        return max(d.cdf(self.high) - d.cdf(self.low), 1e-300)

    def density(self, x: float) -> float:
        return sum(NormalDist(c, w).pdf(x) / self._mass(c, w) for c, w in zip(self.centres, self.widths)) / len(self.centres)

    def sample(self, pick: float, u: float) -> float:
        k = min(int(pick * len(self.centres)), len(self.centres) - 1)
        d = NormalDist(self.centres[k], self.widths[k])
        a, b = d.cdf(self.low), d.cdf(self.high)
        return min(self.high, max(self.low, d.inv_cdf(min(1 - 1e-12, max(1e-12, a + u * (b - a))))))


def split_trials(trials: list[Trial]) -> tuple[list[Trial], list[Trial]]:
    """The best tenth (at most 25) and the rest; a trial of more folds comes before a pruned one."""
    order = sorted(trials, key=lambda t: (-len(t.scores), t.value, t.number))
    good = min(25, math.ceil(0.1 * len(order)))
    return order[:good], order[good:]


def propose(space: dict[str, Range], trials: list[Trial], number: int, seed: int, running: list[dict] = ()) -> dict:
    """Parameters of the next trial; ``running`` (proposed, not yet scored) count among the rest, which keeps a batch apart."""
    done = [t for t in trials if t.scores]
    out = {}
    good, rest = split_trials(done) if len(done) >= STARTUP else ([], [])
    for name, r in space.items():
        low, high = r.ends
        if not good:
            out[name] = r.outer(low + draw(seed, number, name) * (high - low))
            continue
        best = Parzen.of([r.inner(t.params[name]) for t in good], low, high)
        other = Parzen.of([r.inner(p[name]) for p in [t.params for t in rest] + list(running)], low, high)
        tries = [best.sample(draw(seed, number, name, k, "a"), draw(seed, number, name, k, "b")) for k in range(CANDIDATES)]
        out[name] = r.outer(max(tries, key=lambda x: math.log(best.density(x)) - math.log(other.density(x))))
    return out


def pruned(trials: list[Trial], scores: list[float]) -> bool:
    """Is the running score worse than the median of the other trials' after as many folds?"""
    fold = len(scores)
    others = [t.scores[fold - 1] for t in trials if len(t.scores) >= fold]
    return fold > WARMUP_FOLDS and len(others) >= STARTUP_PRUNING and scores[-1] > median(others)


def sure_folds(done: list[Trial], folds: int) -> int:
    """As many first folds are run in any case, whatever their scores are."""
    return next((k for k in range(WARMUP_FOLDS + 1, folds) if sum(len(t.scores) >= k for t in done) >= STARTUP_PRUNING), folds)


def search(space: dict[str, Range], score, folds: int, trials: int = 50, batch: int = 5, seed: int = 42) -> list[Trial]:
    """``score(params, fold)`` -> a number to be made small.  Trials of a batch run side by side; so do the first folds, those
    that pruning cannot spare, and then fold after fold."""
    done: list[Trial] = []
    with ThreadPoolExecutor(max_workers=batch * folds) as pool:
        while len(done) < trials:
            live: list[Trial] = []
            for _ in range(min(batch, trials - len(done))):
                number = len(done) + len(live)
                live.append(Trial(number, propose(space, done, number, seed, [t.params for t in live])))
            group, sums = list(live), {t.number: 0.0 for t in live}
            sure = sure_folds(done, folds)
            for some in [range(sure), *([k] for k in range(sure, folds))]:
                scored = {(t.number, k): pool.submit(score, t.params, k) for k in some for t in live}
                for k in some:
                    for t in live:
                        sums[t.number] += scored[t.number, k].result()
                        t.scores.append(sums[t.number] / (k + 1))
                for t in live:
                    t.pruned = len(t.scores) < folds and pruned(done, t.scores)
                live = [t for t in live if not t.pruned]
            done += group
    return done


def best_trial(trials: list[Trial]) -> Trial:
    return split_trials(trials)[0][0]
