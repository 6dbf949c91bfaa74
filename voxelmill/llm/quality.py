"""Quality classifier: a sparse rule ensemble.

Small trees are boosted on text statistics; every path from a root to a node gives a
conjunctive rule. A lasso-penalised logistic regression over all rules keeps a few,
and these are compiled into one Spark column expression, which scores any number of
texts without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most, chosen by a hash of the identifier.
TRAINING_ROWS = 10_000
#: Rows with this remainder of crc32(identifier as text) by 3 are never learned from.
HELD_OUT = 1

TREES, DEPTH, BINS, SHRINKAGE = 40, 3, 32, 0.3
#: Rules that hold for a smaller share of rows, or for all but such a share, are left out.
LEAST_SUPPORT = 0.003
PENALTY, STEPS = 0.0008, 400


def _count(text: Column, part: str) -> Column:
    """Occurrences of a string; lengths in bytes need no pass over the text."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are 0 for an empty or null one. Ratios are by words or bytes."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.octet_length(text), F.lit(1))
    words = _count(text, " ") + _count(text, "\n") + 1
    tokens, lines = F.split(text, " "), F.split(text, "\n")
    return {
        "bytes": F.octet_length(text).cast("double"),
        "word_bytes": F.octet_length(text) / words,
        "distinct_words": F.size(F.array_distinct(tokens)) / F.size(tokens).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_words": words / F.size(lines),
        "upper": F.regexp_count(text, F.lit("[A-Z]")) / size,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / size,
        "symbols": F.regexp_count(text, F.lit(r"[!-+/:-@\[-`{-~]")) / size,
        "stops": _count(text, ".") / words,
        "commas": _count(text, ",") / words,
        "bars": _count(text, "|") / words,
        "shouts": _count(text, "!") / words,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): above if greater, else at most."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.parts:
            out = out & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: DataFrame) -> Column:
        """Chance of label 1, from columns named as the statistics are."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, target: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list, values: np.ndarray) -> None:
    """Grow one tree on binned statistics; ``paths`` gets (feature, above, bin) conjunctions, ``values`` the fitted means."""
    values[rows] = target[rows].mean() if len(rows) else 0.0
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-9, None, None)
    total, n = target[rows].sum(), len(rows)
    for f in range(bins.shape[1]):
        count = np.bincount(bins[rows, f], minlength=BINS).cumsum()[:-1]
        left = np.bincount(bins[rows, f], weights=target[rows], minlength=BINS).cumsum()[:-1]
        fits = (count >= 5) & (n - count >= 5)
        gain = np.where(fits, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1.0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] is None:
        return
    _, f, k = best
    above = bins[rows, f] > k
    for side, part in ((False, rows[~above]), (True, rows[above])):
        paths.append((*path, (f, side, k)))
        _tree(bins, target, part, depth - 1, paths[-1], paths, values)


def _lasso(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    n, m = x.shape
    weights, intercept = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vector = np.ones(m) / np.sqrt(max(m, 1))
    for _ in range(20):
        vector = x.T @ (x @ vector)
        norm = np.linalg.norm(vector)
        vector = vector / max(norm, 1e-12)
    step = 1.0 / (0.25 * (norm / n + 1.0))
    at_w, at_b, momentum = weights.copy(), intercept, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ at_w + at_b))) - y
        new = at_w - step * (x.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b = at_b - step * error.mean()
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at_w = new + (momentum - 1) / later * (new - weights)
        at_b = new_b + (momentum - 1) / later * (new_b - intercept)
        weights, intercept, momentum = new, new_b, later
    return intercept, weights


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Fit the ensemble; with one label only, or none, the score is a smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = RuleModel(float(np.log(share / (1 - share))), ())
    if len(y) == 0 or y.min() == y.max():
        return prior
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    paths: list = []
    margin = np.full(len(y), prior.intercept)
    order = np.random.default_rng(0)
    for _ in range(TREES):
        chosen = np.flatnonzero(order.random(len(y)) < 0.6)
        values = np.zeros(len(y))
        before = len(paths)
        _tree(bins, y - 1 / (1 + np.exp(-margin)), chosen, DEPTH, (), paths, values)
        if len(paths) == before:
            break
        # rows left out of the sample follow the leaves as well
        fitted = np.zeros(len(y))
        for path in paths[before:]:
            held = np.all([(bins[:, f] > k) == side for f, side, k in path], axis=0)
            inside = np.intersect1d(np.flatnonzero(held), chosen, assume_unique=True)
            if len(inside):
                fitted[held] = values[inside].mean()
        margin += SHRINKAGE * 4 * fitted
    rules, columns = [], []
    for path in dict.fromkeys(paths):
        held = np.all([(bins[:, f] > k) == side for f, side, k in path], axis=0)
        if LEAST_SUPPORT <= held.mean() <= 1 - LEAST_SUPPORT and all(k < len(edges[f]) for f, _, k in path):
            rules.append(Rule(tuple((names[f], side, float(edges[f][k])) for f, side, k in path)))
            columns.append(held)
    if not rules:
        return prior
    intercept, weights = _lasso(np.column_stack(columns).astype(float), y.astype(float))
    kept = [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return RuleModel(float(intercept), tuple(kept))


def remainder(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training_rows: int = TRAINING_ROWS) -> RuleModel:
    """Learn from labelled rows outside the held-out third.

    The sample of labels, ``training_rows`` at most but for the spread of a hash, is
    joined as a broadcast; only its statistics reach the driver. Null labels and
    labels other than 0 and 1 are left out; a text with several labels counts for each.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != HELD_OUT)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    n = usable.count()
    if n > training_rows:
        usable = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * training_rows / n))
    columns = statistics(F.col("_text"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(usable), "_id").select("_id", "_label", *[c.cast("double").alias(name) for name, c in columns.items()]).collect()
    rows.sort(key=tuple)
    table = np.array([tuple(r)[1:] for r in rows], dtype=float).reshape(len(rows), len(columns) + 1)
    return fit_rules(list(columns), table[:, 1:], table[:, 0])


def with_score(docs: DataFrame, model: RuleModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """Add the score of every whole text. Null texts score as empty ones; all columns stay, and ``into`` must be new."""
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists already; name another with into=")
    stats = docs.select(F.struct("*").alias("_row"), *[c.cast("double").alias(name) for name, c in statistics(F.col(text_col)).items()])
    # made by a generator, so that no filter on the score is moved below the statistics, which it would repeat for every rule
    return stats.select("_row.*", F.explode(F.array(model.score(stats))).alias(into))
