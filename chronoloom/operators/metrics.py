"""Similarity of two texts, row by row, and summaries of scores."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronoloom.functions.stems import stem
from chronoloom.functions.text import tokens


def bleu_score(reference: list[str], candidate: list[str], most: int = 4) -> float:
    """The lesser of precision and recall over the 1- to 4-grams; 0 if either text has no word."""
    if not reference or not candidate:
        return 0.0
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    r, c = grams(reference), grams(candidate)
    return sum((r & c).values()) / max(r.total(), c.total())


@F.pandas_udf(DoubleType())
def google_bleu(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """``bleu_score`` of whitespace tokens. Counting n-grams in arrays of columns would be quadratic."""
    return pd.Series([bleu_score((r or "").split(), (c or "").split()) for r, c in zip(reference, candidate)])


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, one row of the table at a time."""
    empty = F.transform(b, lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        start = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("out"))

        def cell(acc: Column, z: Column) -> Column:
            i = z["i"]
            diagonal = F.when(i == 0, 0).otherwise(F.get(above, i - 1))
            best = F.when(z["y"] == x, diagonal + 1).otherwise(F.greatest(acc["left"], F.get(above, i)))
            return F.struct(best.alias("left"), F.array_append(acc["out"], best).alias("out"))

        return F.aggregate(F.transform(b, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), start, cell, lambda acc: acc["out"])

    return F.coalesce(F.array_max(F.aggregate(a, empty, row)), F.lit(0))


def rouge_l_folded(reference: Column, candidate: Column) -> Column:
    """The F-measure of the longest common subsequence of whitespace tokens, as a fold over columns; for short texts."""
    r, c = tokens(reference), tokens(candidate)
    lcs = longest_common(r, c)
    return F.coalesce(F.try_divide(lcs * 2.0, F.size(r) + F.size(c)), F.lit(0.0))


def _lcs(a: list[str], b: list[str]) -> int:
    """Bit-parallel longest common subsequence."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        same = row & where.get(y, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """The F-measure of the longest common subsequence of whitespace tokens, bit-parallel."""
    out = []
    for r, c in zip(reference, candidate):
        a, b = (r or "").split(), (c or "").split()
        out.append(2.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 0.0)
    return pd.Series(out)


#: The longest character and word n-grams, and the weight of recall.
CHAR_ORDER, WORD_ORDER, RECALL_WEIGHT = 6, 2, 2.0


def chrf_score(reference: str, candidate: str) -> float:
    """chrF++ in percent: the F-measure of character n-grams (without white space) and word n-grams, averaged over orders.

    Orders that neither text has are left out; punctuation at a word's edge is a word of its own.
    """

    def words(text: str) -> list[str]:
        out = []
        for w in text.split():
            if len(w) > 1 and not w[-1].isalnum():
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and not w[0].isalnum():
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    total, orders = 0.0, 0
    for units, most in (((list("".join(reference.split())), list("".join(candidate.split()))), CHAR_ORDER), ((words(reference), words(candidate)), WORD_ORDER)):
        for n in range(1, most + 1):
            r, c = (Counter(tuple(u[i : i + n]) for i in range(len(u) - n + 1)) for u in units)
            if not r and not c:
                continue
            orders += 1
            matched = sum((r & c).values())
            precision, recall = matched / c.total() if c else 0.0, matched / r.total() if r else 0.0
            if precision + recall:
                total += (1 + RECALL_WEIGHT**2) * precision * recall / (RECALL_WEIGHT**2 * precision + recall)
    return 100.0 * total / orders if orders else 0.0


@F.pandas_udf(DoubleType())
def chrf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([chrf_score(r or "", c or "") for r, c in zip(reference, candidate)])


#: METEOR's weight of recall, exponent and factor of the chunk penalty.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def aligned_words(reference: list[str], candidate: list[str], stems: bool = True) -> list[tuple[int, int]]:
    """(place in candidate, place in reference) of matched words, ascending.

    Equal words are matched first, then words of one stem among those left. In each stage the last
    of a word goes with the last of the same on the other side, so equal words never cross.
    """
    left_r, left_c, found = list(range(len(reference))), list(range(len(candidate))), []
    for key in (str, stem) if stems else (str,):
        where: dict[str, list[int]] = {}
        for j in left_r:
            where.setdefault(key(reference[j]), []).append(j)
        pairs = [(i, where[k].pop()) for i in reversed(left_c) if where.get(k := key(candidate[i]))]
        found += pairs
        gone = [{p[s] for p in pairs} for s in (0, 1)]
        left_c, left_r = [i for i in left_c if i not in gone[0]], [j for j in left_r if j not in gone[1]]
    return sorted(found)


def meteor_score(reference: list[str], candidate: list[str], stems: bool = True) -> float:
    """The weighted harmonic mean of precision and recall, less a penalty for the chunks that the matches fall into."""
    pairs = aligned_words(reference, candidate, stems)
    if not pairs:
        return 0.0
    precision, recall = len(pairs) / len(candidate), len(pairs) / len(reference)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    return (1 - GAMMA * (chunks / len(pairs)) ** BETA) * precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)


def _meteor(stems: bool):
    @F.pandas_udf(DoubleType())
    def scored(reference: pd.Series, candidate: pd.Series) -> pd.Series:
        return pd.Series([meteor_score(list(r), list(c), stems) for r, c in zip(reference, candidate)], dtype=float)

    return lambda reference, candidate: scored(tokens(F.lower(reference)), tokens(F.lower(candidate)))


def meteor(reference: Column, candidate: Column) -> Column:
    """METEOR with its exact and stem stages (no thesaurus) over lower-case whitespace tokens."""
    return _meteor(True)(reference, candidate)


def meteor_exact(reference: Column, candidate: Column) -> Column:
    """METEOR with its exact stage alone."""
    return _meteor(False)(reference, candidate)


#: Metrics by name. Others are refused.
METRICS = {"google_bleu": google_bleu, "rouge_l": rouge_l, "rouge_l_folded": rouge_l_folded, "chrf": chrf, "meteor": meteor, "meteor_exact": meteor_exact}


def evaluate(pairs: DataFrame, names: list[str], reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """``pairs`` with one column per metric; null texts count as empty."""
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"no such metric: {', '.join(unknown)}; known are {', '.join(METRICS)}")
    side = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.withColumns({n: METRICS[n](side(reference), side(candidate)) for n in names})


def group_means(scores: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Mean and median of each metric per group; NaN counts as missing."""
    clean = lambda n: F.when(~F.isnan(n), F.col(n))
    return scores.groupBy(*group).agg(*[x for n in names for x in (F.avg(clean(n)).alias(f"{n}_mean"), F.percentile(clean(n), 0.5).alias(f"{n}_median"))])


def null_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, present, missing) of the named columns."""
    counts = rows.agg(*[F.struct(F.lit(n).alias("name"), F.count(n).alias("present"), F.count_if(F.col(n).isNull()).alias("missing")).alias(f"c{i}") for i, n in enumerate(names)])
    return counts.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))


def with_interval_row(means: DataFrame, intervals: DataFrame, label: str, title: str = "interval") -> DataFrame:
    """A table of means with one row more, ``title``, that holds the intervals as 'lower - upper'.

    ``means``: label and a column per metric; ``intervals``: metric, lower, upper.
    """
    names = [c for c in means.columns if c != label]
    told = F.format_string("%.4f - %.4f", "lower", "upper")
    row = intervals.agg(*[F.max(F.when(F.col("metric") == n, told)).alias(n) for n in names]).select(F.lit(title).alias(label), *names)
    return means.select(F.col(label).cast("string").alias(label), *[F.format_string("%.4f", F.col(n).cast("double")).alias(n) for n in names]).unionByName(row)


#: The key under which each metric's library reports its result.
RESULT_KEYS = {"bertscore": "f1", "rouge": "rougeL", "bleu": "bleu", "google_bleu": "google_bleu", "meteor": "meteor", "chrf": "score", "comet": "mean_score", "bleurt": "scores"}


def result_value(results: Column, metric: str) -> Column:
    """A metric's value from the map of what its library reported; an unknown metric is an error."""
    if metric not in RESULT_KEYS:
        raise ValueError(f"no result key is known for {metric!r}")
    return F.try_element_at(results, F.lit(RESULT_KEYS[metric]))


def rank_stats(ranks: DataFrame, model: str = "model_name", rank: str = "model_rank") -> DataFrame:
    """(model, mean, median, std, count) of ranks, numeric or not, best mean first; non-numeric ones count as missing."""
    r = F.col(rank).try_cast("double")
    stats = ranks.groupBy(model).agg(F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.stddev_samp(r).alias("std"), F.count(r).alias("count"))
    return stats.orderBy(F.asc_nulls_last("mean"), model)


def greedy_cosine(left: DataFrame, right: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """(group, precision, recall, f1): each vector's best cosine on the other side, averaged per group.

    Both sides hold few vectors per group (the tokens of one text).
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda a: F.sqrt(dot(a, a))
    a = left.select(group, F.col(item).alias("_i"), F.col(vector).alias("_a"))
    b = right.select(group, F.col(item).alias("_j"), F.col(vector).alias("_b"))
    scored = a.join(b, group).withColumn("_c", dot(F.col("_a"), F.col("_b")) / (norm(F.col("_a")) * norm(F.col("_b"))))
    recall = scored.groupBy(group, "_i").agg(F.max("_c").alias("_m")).groupBy(group).agg(F.avg("_m").alias("recall"))
    precision = scored.groupBy(group, "_j").agg(F.max("_c").alias("_m")).groupBy(group).agg(F.avg("_m").alias("precision"))
    both = recall.join(precision, group)
    return both.withColumn("f1", F.coalesce(F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")), F.lit(0.0)))
