"""Ordered rule lists, induced by incremental reduced-error pruning and applied as SQL CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Thresholds tried per feature: half of them quantiles of the training rows, half evenly spaced over their range.
BINS = 64
SEED = 42


@dataclass
class Rule:
    """If all conditions (feature, ``<=`` or ``>``, threshold) hold, the class applies."""

    kind: str
    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def sql(self) -> str:
        return " AND ".join(f"{f} {op} {t!r}D" for f, op, t in self.conditions) or "true"


def _grow(codes: np.ndarray, positive: np.ndarray, most: int) -> list[tuple[int, str, int]]:
    """Conditions (feature, op, bin), each with the highest gain of information on the rows that the ones before leave."""
    rows = np.arange(len(codes))
    found: list[tuple[int, str, int]] = []
    while len(found) < most:
        own = positive[rows]
        p, n = int(own.sum()), int((~own).sum())
        if not p or not n:
            break
        base = np.log2(p / (p + n))
        best, choice = 0.0, None
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            ps, ns = np.bincount(c[own], minlength=BINS + 1), np.bincount(c[~own], minlength=BINS + 1)
            for op, pc, nc in (("<=", ps.cumsum(), ns.cumsum()), (">", p - ps.cumsum(), n - ns.cumsum())):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pc > 0, pc * (np.log2(np.maximum(pc, 1) / np.maximum(pc + nc, 1)) - base), 0)
                top = np.flatnonzero(gain >= gain.max() - 1e-9)
                k = int(top[len(top) // 2])  # of equal thresholds the middle one, farthest from either side
                if gain[k] > best + 1e-9:
                    best, choice = float(gain[k]), (f, op, k)
        if choice is None:
            break
        found.append(choice)
        rows = rows[_holds(codes[rows], [choice])]
    return found


def _holds(codes: np.ndarray, conditions: list[tuple[int, str, int]]) -> np.ndarray:
    held = np.ones(len(codes), bool)
    for f, op, k in conditions:
        held &= codes[:, f] <= k if op == "<=" else codes[:, f] > k
    return held


def _prune(codes: np.ndarray, positive: np.ndarray, conditions: list[tuple[int, str, int]]) -> tuple[list[tuple[int, str, int]], float, int]:
    """The beginning of the rule with the greatest share of hits less misses on the pruning rows, the share of hits among those it covers, and their number."""
    best, kept, accuracy, covered = -np.inf, conditions, 0.0, 0
    held = np.ones(len(codes), bool)
    for i in range(len(conditions)):
        held &= _holds(codes, [conditions[i]])
        p, n = int((held & positive).sum()), int((held & ~positive).sum())
        if (p - n) / max(1, p + n) > best:
            best, kept, accuracy, covered = (p - n) / max(1, p + n), conditions[: i + 1], p / max(1, p + n), p + n
    return kept, accuracy, covered


def induce(x: np.ndarray, y: np.ndarray, features: list[str], order: list[str], most_conditions: int = 8, most_rules: int = 30, patience: int = 5, tries: int = 8, seed: int = SEED) -> list[Rule]:
    """Rules for the classes in ``order``, each class against all after it; rows that no rule holds for are of the last class.

    Each rule is grown on two thirds of the rows left and cut back on the third, and counts if more than half of what it covers there is of its class. Of ``tries`` splits
    the rule with the most hits less misses on all rows left is taken and its rows go. A class ends when ``patience`` times no split gives a rule. The same rows give the same rules.
    """
    random = np.random.default_rng(seed)
    inner = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    edges = [np.unique(np.concatenate([np.quantile(c, inner), c.min() + (c.max() - c.min()) * inner])) for c in x.T]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    left = np.arange(len(y))
    rules: list[Rule] = []
    for kind in order[:-1]:
        refused = made = 0
        while made < most_rules and refused < patience and (y[left] == kind).any():
            best, chosen = -np.inf, None
            for _ in range(tries):
                mixed = random.permutation(left)
                grow, prune = mixed[: len(mixed) * 2 // 3], mixed[len(mixed) * 2 // 3 :]
                conditions, accuracy, covered = _prune(codes[prune], y[prune] == kind, _grow(codes[grow], y[grow] == kind, most_conditions))
                conditions = [c for c in conditions if c[2] < len(edges[c[0]])]
                if accuracy > 0.5 and covered >= 2 and conditions:
                    hits = y[left[_holds(codes[left], conditions)]] == kind
                    if 2 * int(hits.sum()) - len(hits) > best:
                        best, chosen = 2 * int(hits.sum()) - len(hits), conditions
            if chosen is None:
                refused += 1
                continue
            rules.append(Rule(kind, [(features[f], op, float(edges[f][k])) for f, op, k in chosen]))
            made += 1
            left = left[~_holds(codes[left], chosen)]
    return rules


def case_sql(rules: list[Rule], otherwise: str) -> str:
    """The rule list as a CASE expression over columns with the features' names."""
    if not rules:
        return f"'{otherwise}'"
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.kind}'" for r in rules) + f" ELSE '{otherwise}' END"


def apply_rules(rules: list[Rule], x: np.ndarray, features: list[str], otherwise: str) -> np.ndarray:
    """What the CASE expression gives, for tests and held-out accuracy."""
    out = np.full(len(x), otherwise, object)
    free = np.ones(len(x), bool)
    for r in rules:
        held = free.copy()
        for f, op, t in r.conditions:
            v = x[:, features.index(f)]
            held &= v <= t if op == "<=" else v > t
        out[held] = r.kind
        free &= ~held
    return out
