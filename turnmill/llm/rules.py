"""Ordered rule lists by incremental reduced-error pruning.

Classes are learned from the rarest to the most frequent; each rule is grown on
two thirds of the rows not yet covered, condition by condition by information
gain, and pruned back on the last third; learning of a class ends with the first
rule that is right less often than ``precision``.  The default class takes the rest.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold
Rule = tuple[str, list[Condition]]


def matrix(rows: list[list[float]], columns: list[int]) -> np.ndarray:
    return np.array([[row[c] for c in columns] for row in rows], float)


def _holds(x: np.ndarray, names: list[str], conditions: list[Condition]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, sign, at in conditions:
        column = x[:, names.index(name)]
        ok &= column <= at if sign == "<=" else column > at
    return ok


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, Condition | None]:
    """The condition of most information gain; among equals the widest margin, then the first."""
    p, n = y.sum(), (~y).sum()
    before = np.log2(p / (p + n))
    best: tuple[float, float, Condition | None] = (0.0, 0.0, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        value, hit = x[order, j], y[order]
        edge = np.flatnonzero(value[1:] != value[:-1])
        if not len(edge):
            continue
        below_p, below_n = np.cumsum(hit)[edge], np.cumsum(~hit)[edge]
        spread = value[-1] - value[0]
        for sign, pos, neg in (("<=", below_p, below_n), (">", p - below_p, n - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), 0.0)
            k = int(np.argmax(np.round(gain, 9)))
            margin = (value[edge[k] + 1] - value[edge[k]]) / spread
            if (round(float(gain[k]), 9), margin) > best[:2]:
                best = (round(float(gain[k]), 9), margin, (name, sign, float(value[edge[k]] + value[edge[k] + 1]) / 2))
    return best[0], best[2]


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int) -> list[Condition]:
    conditions: list[Condition] = []
    while y.any() and not y.all() and len(conditions) < most:
        gain, condition = _best_condition(x, y, names)
        if condition is None or gain <= 0:
            break
        conditions.append(condition)
        ok = _holds(x, names, [condition])
        x, y = x[ok], y[ok]
    return conditions


def _prune(x: np.ndarray, y: np.ndarray, names: list[str], conditions: list[Condition]) -> list[Condition]:
    def worth(some: list[Condition]) -> float:
        ok = _holds(x, names, some)
        return ((ok & y).sum() + (~ok & ~y).sum()) / max(1, len(y))  # rows told right

    best = conditions
    for k in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:k]) >= worth(best):
            best = conditions[:k]
    return best


def induce(x: np.ndarray, labels: list[str], names: list[str], default: str, order: list[str] | None = None, seed: int = 0, most_conditions: int = 4, most_rules: int = 8, precision: float = 0.9) -> list[Rule]:
    """The rule list for ``labels`` over the columns ``names`` of ``x``."""
    y = np.array(labels)
    rng = np.random.default_rng(seed)
    count = Counter(labels)
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    for label in order or sorted((c for c in count if c != default), key=lambda c: (count[c], c)):
        for _ in range(most_rules):
            rows = np.flatnonzero(left)
            hit = y[rows] == label
            if hit.sum() < 3:
                break
            shuffled = rng.permutation(len(rows))
            grow, prune = shuffled[: 2 * len(rows) // 3], shuffled[2 * len(rows) // 3 :]
            conditions = _grow(x[rows[grow]], hit[grow], names, most_conditions)
            if not conditions:
                break
            conditions = _prune(x[rows[prune]], hit[prune], names, conditions)
            covered = _holds(x[rows], names, conditions)
            right = hit[covered]
            if not len(right) or right.mean() < precision:
                break
            rules.append((label, conditions))
            left[rows[covered]] = False
    return rules


def to_sql(rules: list[Rule], default: str) -> str:
    whens = " ".join(f"WHEN {' AND '.join(f'{n} {s} {v!r}D' for n, s, v in cs)} THEN '{label}'" for label, cs in rules)
    return f"CASE {whens} ELSE '{default}' END" if whens else f"'{default}'"


def predict(rules: list[Rule], x: np.ndarray, names: list[str], default: str) -> list[str]:
    out = np.full(len(x), default, object)
    for label, conditions in reversed(rules):
        out[_holds(x, names, conditions)] = label
    return out.tolist()
