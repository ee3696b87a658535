"""Where to look next in a search over the price of cost, from supporting lines.

The best payoff ``f(lam) = max(prize - lam * cost)`` over subtrees is convex and piecewise linear in ``lam``; a solved
value gives one of its lines.  Between two solved values with lines ``(prize, cost)`` nothing but these two lines can
lie beyond the point where they cross: a further line, if there is one, is above them there.  So the crossing is what
is solved next, and where its solution is on both lines the interval holds no other support.  A search ends when it
has a hit, or when no interval is left that could hold one; "unreachable" is then proven and not a matter of
tolerance.

With several trees (``g > 1``) the payoff is not a maximum over all choices and the lines prove nothing; an interval
is then halved until its ends cannot be told apart.

A rule gets the ``points`` solved so far, ``{lam: (size, cost, prize)}``, and returns the values to solve next, or a
verdict: the chosen values as ``(side, lam)``, whether the wish is met, and whether the search has ended by itself.
Both kinds of search, in a task and by rounds over large problems, ask the same rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

Points = dict[float, tuple[int, float, float]]
Answer = tuple[list[float], list[tuple[int, float]], bool, bool]  # to solve, chosen, met, ended

_SAME = 1e-9  # relative distance of values of lambda, or of costs, that counts as none


@dataclass
class Limits:
    """What a rule knows of a problem: total prize, least positive, least and largest edge cost (0 edges: infinity, 0)."""

    total: float
    positive: float
    least: float
    most: float
    nodes: int
    exact: bool  # one tree: lines prove what lies between them

    @property
    def cap(self) -> float:
        """Beyond this price no edge with a cost is paid for."""
        return 2.0 * self.total / self.positive if self.total > 0 and math.isfinite(self.positive) else 0.0


def limits_of(prize: np.ndarray, cost: np.ndarray, exact: bool) -> Limits:
    paid = cost[cost > 0]
    return Limits(float(prize.sum()), float(paid.min()) if len(paid) else math.inf, float(cost.min()) if len(cost) else math.inf,
                  float(cost.max()) if len(cost) else 0.0, len(prize), exact)


def _start(limits: Limits) -> list[float]:
    return [0.0, limits.cap] if limits.cap > 0 else [0.0]


def _crossing(points: Points, low: float, high: float, exact: bool) -> float | None:
    """Price to solve between two neighbours, or None if nothing lies between them."""
    (_, cost_low, prize_low), (_, cost_high, prize_high) = points[low], points[high]
    if high - low <= _SAME * high:
        return None
    gap = cost_low - cost_high
    if gap > _SAME * max(cost_low, cost_high, 0.0):
        at = (prize_low - prize_high) / gap
        if low * (1 + _SAME) < at < high * (1 - _SAME) and at > 0:
            return at
    return None if exact else (low + high) / 2


def _around(low: float, at: float, high: float, count: int) -> list[float]:
    """The crossing, and ``count - 1`` more values that narrow its interval in the same round."""
    more = [at * 2.0 ** k for i in range(1, count) for k in (i, -i)] if high > 4 * max(low, at / 16) else [
        low + (high - low) * (k + 1) / (count + 1) for k in range(count)]
    return [at, *[x for x in more if low * (1 + _SAME) < x < high * (1 - _SAME)][:count - 1]]


def _pairs(points: Points) -> list[tuple[float, float]]:
    order = sorted(points)
    return list(zip(order, order[1:]))


def size_band(points: Points, limits: Limits, low: int, high: int, per_round: int, last: bool) -> Answer:
    """A support of ``low`` to ``high`` nodes; the largest such one solved, then the smallest price.

    If there is none: the smallest price seen with at most ``high`` nodes, else the largest price.
    """
    high = max(min(high, max(limits.nodes - 1, 1)), 0)
    if not points:
        return _start(limits), [], False, False
    hits = [lam for lam, p in points.items() if low <= p[0] <= high]
    if hits:
        return [], [(0, min(hits, key=lambda lam: (-points[lam][0], lam)))], True, True
    ask: list[tuple[bool, float, list[float]]] = []
    for a, b in _pairs(points):
        straddles = points[a][0] > high and points[b][0] < low
        if not (straddles or (limits.exact and _can_hold(points[b][1], points[a][1], limits, low, high))):
            continue
        at = _crossing(points, a, b, limits.exact)
        if at is not None:
            ask.append((not straddles, a, _around(a, at, b, per_round) if straddles else [at]))
    fallback = [lam for lam, p in points.items() if p[0] <= high]
    choice = min(fallback) if fallback else max(points)
    if ask and not last:
        return [lam for _, _, lams in sorted(ask)[:per_round] for lam in lams], [], False, False
    return [], [(0, choice)], False, not ask


def _can_hold(cost_low: float, cost_high: float, limits: Limits, low: int, high: int) -> bool:
    """Whether a tree that costs between the two can have ``low`` to ``high`` nodes."""
    fewest = 1 + (cost_low / limits.most if limits.most > 0 else 0.0)
    most = 1 + (cost_high / limits.least if limits.least > 0 else math.inf)
    return fewest <= high + 1e-6 and most >= low - 1e-6


def cost_head(points: Points, limits: Limits, bound: float, per_round: int, last: bool) -> Answer:
    """Neighbouring supports on both sides of a cost: side 0 within the bound, side 1 beyond it."""
    if not points:
        return _start(limits), [], False, False
    if points[0.0][1] <= bound:
        return [], [(0, 0.0)], True, True
    between = [(a, b) for a, b in _pairs(points) if points[a][1] > bound >= points[b][1]]
    if not between:
        return [], [(1, max(points))], False, True
    a, b = between[-1]
    at = _crossing(points, a, b, limits.exact)
    if at is not None and not last:
        return _around(a, at, b, per_round), [], False, False
    return [], [(0, b), (1, a)], True, at is None


def cost_tail(points: Points, limits: Limits, low: float, high: float, per_round: int, last: bool) -> Answer:
    """A support that costs ``low`` to ``high``, or less if it misses no prize; else the dearest one below the band."""
    if not points:
        return _start(limits), [], False, False
    whole = points[0.0][1] <= low and points[0.0][2] >= limits.total * (1 - _SAME)
    hits = [lam for lam, p in points.items() if low <= p[1] <= high] + ([0.0] if whole else [])
    if hits:
        return [], [(0, min(hits))], True, True
    between = [(a, b) for a, b in _pairs(points) if points[a][1] > high and points[b][1] < low]
    below = [lam for lam, p in points.items() if p[1] < low]
    choice = min(below) if below else max(points)
    at = _crossing(points, *between[-1], limits.exact) if between else None
    if at is not None and not last:
        return _around(*(between[-1][0], at, between[-1][1]), per_round), [], False, False
    return [], [(0, choice)], False, at is None
