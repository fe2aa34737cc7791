"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of each text are computed by built-in functions. On a bounded sample of labelled rows,
small trees are grown (gradient boosting on random halves of the rows). Every path from a root to a
node is a rule, a conjunction of bounds on statistics. A logistic model with an L1 penalty weighs
the rules; few keep a weight. The score is the logistic function of a sum of CASE expressions, so
scoring a document is one projection and moves nothing.

What is fitted is bounded (``MAX_TRAINING_ROWS`` rows, chosen by a hash of their id); what is scored
is every row.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import let, words_of
from chronoloom.llm.quality_rules import with_counts

#: Labelled rows that are fitted at most. The bound of the training sample.
MAX_TRAINING_ROWS = 20_000
#: Trees, their depth, the rows a leaf holds at least, and the L1 penalty of the rule weights.
TREES, DEPTH, MIN_LEAF, PENALTY = 40, 3, 20, 0.002
#: Score from which a text is predicted to be good.
THRESHOLD = 0.7
SEED = 11


class Rule(NamedTuple):
    """A conjunction: each condition is (statistic, above, bound) for statistic > bound or <= bound."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]


def _ratio(top: str, bottom: str) -> Column:
    return F.col(f"_counts.{top}") / F.greatest(F.col(f"_counts.{bottom}"), F.lit(1))


#: Statistics by name; none looks at anything but the text.
STATISTICS = (
    "words", "mean_word_length", "symbols_per_word", "marks_per_word", "upper_share", "stop_word_share",
    "repeat_share", "duplicate_line_share", "words_per_line", "distinct_word_share", "digit_share",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds ``_stats``, a struct of STATISTICS as doubles; all are 0 for null and empty texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    distinct = let(words_of(F.col("text")), lambda w: F.size(F.array_distinct(w)).cast("double") / F.greatest(F.size(w), F.lit(1)))
    digits = (F.char_length(text) - F.char_length(F.regexp_replace(text, "[0-9]", ""))).cast("double")
    counted = with_counts(docs).withColumn("_distinct", distinct).withColumn("_digits", digits)
    values = {
        "words": F.col("_counts.n_words").cast("double"),
        "mean_word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "stop_word_share": _ratio("n_stop_words", "n_words"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "duplicate_line_share": _ratio("n_dup_lines", "n_lines"),
        "words_per_line": _ratio("n_words", "n_lines"),
        "distinct_word_share": F.col("_distinct"),
        "digit_share": F.col("_digits") / F.greatest(F.col("_counts.word_chars"), F.lit(1)),
    }
    return counted.withColumn("_stats", F.struct(*[values[s].alias(s) for s in STATISTICS])).drop("_counts", "_distinct", "_digits")


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: tuple, depth: int, rules: list, leaves: list) -> None:
    """One regression tree on ``rows``; adds each node's path to ``rules`` and each leaf to ``leaves``."""
    if path:
        rules.append(path)
    best = (1e-9, None)
    if depth and len(rows) >= 2 * MIN_LEAF:
        own = residual[rows]
        total = own.sum()
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            slot = np.searchsorted(cuts[f], x[rows, f], side="left")  # slot k: above k of the cuts
            n = np.cumsum(np.bincount(slot, minlength=len(cuts[f]) + 1))[:-1]
            s = np.cumsum(np.bincount(slot, own, minlength=len(cuts[f]) + 1))[:-1]
            fits = (n >= MIN_LEAF) & (len(rows) - n >= MIN_LEAF)
            if fits.any():
                gain = np.where(fits, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(cuts[f][k])))
    if best[1] is None:
        leaves.append(rows)
        return
    f, bound = best[1]
    above = x[rows, f] > bound
    for side in (False, True):
        _grow(x, residual, rows[above == side], cuts, (*path, (f, side, bound)), depth - 1, rules, leaves)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    held = np.ones(len(x), bool)
    for f, above, bound in path:
        held &= (x[:, f] > bound) == above
    return held


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model, by accelerated proximal gradient."""
    n, k = z.shape
    weights, intercept = np.zeros(k), 0.0
    look_w, look_b, momentum = weights.copy(), 0.0, 1.0
    step = 4.0 / (np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 / n)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(look_b + z @ look_w, -30, 30))) - y
        new_w = look_w - step * (z.T @ error / n)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = look_b - step * error.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look_w, look_b = new_w + (momentum - 1) / after * (new_w - weights), new_b + (momentum - 1) / after * (new_b - intercept)
        weights, intercept, momentum = new_w, new_b, after
    return float(intercept), weights


def fit_rules(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of statistics ``x`` (columns: STATISTICS) and labels ``y`` (0 or 1).

    Without rows the score is 0.5 everywhere; with one label only it is the smoothed share of 1.
    """
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n < 2 * MIN_LEAF or y.min() == y.max():
        return Model(base, ())
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1])) for f in range(x.shape[1])]
    margin, paths = np.full(n, base), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        rows, leaves = np.sort(rng.permutation(n)[: max(2 * MIN_LEAF, n // 2)]), []
        found: list = []
        _grow(x, residual, rows, cuts, (), DEPTH, found, leaves)
        paths += found
        for path in found:
            if not any(p[: len(path)] == path and p != path for p in found):  # a leaf
                held = _holds(x, path)
                if held.any():
                    p = 1 / (1 + np.exp(-margin[held]))
                    margin[held] += 0.3 * np.clip(residual[held].sum() / max((p * (1 - p)).sum(), 1e-3), -4, 4)
    distinct: dict[bytes, tuple] = {}
    for path in sorted(set(paths), key=lambda p: (len(p), p)):
        held = _holds(x, path)
        if MIN_LEAF <= held.sum() <= n - MIN_LEAF:
            distinct.setdefault(held.tobytes(), path)
    if not distinct:
        return Model(base, ())
    chosen = list(distinct.values())
    z = np.column_stack([_holds(x, p) for p in chosen]).astype(float)
    intercept, weights = _lasso_logistic(z, y, PENALTY)
    rules = [Rule(tuple((STATISTICS[f], above, bound) for f, above, bound in p), float(w)) for p, w in zip(chosen, weights) if abs(w) > 1e-4]
    return Model(intercept, tuple(rules))


def compile_model(model: Model) -> Column:
    """The score as one expression over ``_stats``."""
    total = F.lit(model.intercept)
    for rule in model.rules:
        held = None
        for name, above, bound in rule.conditions:
            test = F.col(f"_stats.{name}") > bound if above else F.col(f"_stats.{name}") <= bound
            held = test if held is None else held & test
        total = total + F.when(held, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text leaves 2 modulo 4. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fits ``labels.quality`` on the texts of at most ``max_rows`` labelled rows that are not held out.

    Rows are chosen by a hash of their id; an id with several labels takes the greatest, one with
    several texts the least; null ids and labels are passed over.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows rows of two numbers.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = with_statistics(known).select("doc_id", "_label", *[F.col(f"_stats.{s}").alias(s) for s in STATISTICS]).toPandas().sort_values("doc_id")
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["_label"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` as doc_id, held_out, score (0 to 1) and predicted.

    Null and empty texts have statistics of 0 and a score like any other. Rows are scored one by
    one: repeated rows and null ids change nothing, an empty table stays so, other columns are not
    looked at.
    """
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compile_model(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
