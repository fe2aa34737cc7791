"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule bounds a ratio of two counts of one text, in hundredths. The counts are whole numbers and
a rule is compared crosswise (100 * numerator against bound * denominator), so no rounding decides.
No user function runs and no row moves: the plan is a scan and projections.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD_PATTERN, let, words_of


class Rule(NamedTuple):
    """``low`` <= 100 * numerator / denominator <= ``high``; None leaves a side open."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


#: Fewest words, and the most words (in percent) that repeated three-word windows may cover.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The threshold table. Counts: see COUNTS.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 30),
    Rule("marks_per_word", "n_marks", "n_words", None, 50),
    Rule("upper_share", "n_upper", "word_chars", None, 40),
    Rule("stop_word_share", "n_stop_words", "n_words", 3, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 90),
)

#: Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "a an and are as at be by for from has have he her his in is it its not of on or that the their this to was were which will with "
    "als am auf aus bei das dem den der des die durch ein eine einen einer er es für im ist mit nach nicht noch sich sie sind über um und von vor war wie zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il je la le les leur mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del desde el ella entre era ha hay la las lo los más muy no o para pero por porque que ser sin sobre su sus también te tiene una uno y ya"
).split()

_SYMBOLS = r"[#*$%&|<>]"


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a class, by how much shorter it is without them."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _covered(positions: Column, width: int) -> Column:
    """How many words windows of ``width`` at these ascending positions cover."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def _repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more in the text.

    Windows are compared by a 64-bit hash. If all differ, which a hash set tells, the count is 0;
    else the sorted (hash, position) pairs bring equal ones side by side.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))

    def repeated(pairs: Column) -> Column:
        same = lambda pair, i, step: F.coalesce(F.get(pairs, i + step)["h"] == pair["h"], F.lit(False))
        hit = F.filter(pairs, lambda pair, i: same(pair, i, 1) | (i.__gt__(0) & same(pair, i, -1)))
        return _covered(F.sort_array(F.transform(hit, lambda pair: pair["i"])), width)

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, of_hashes))


def counts_of() -> Column:
    """A struct of every count that the rules name, as one expression.

    One expression, because a filter on it is pushed below the projections, and what it names more
    than once would then be computed more than once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = [form for word in dict.fromkeys(STOP_WORDS) for form in (word, word.capitalize())]
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(*stop))).alias("stop"), _repeat_words(w).alias("repeat"))
    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_PATTERN))
    of_lines = lambda lines: F.struct(
        F.size(lines).alias("n"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"),
        F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).alias("ellipsis"),
        F.size(F.filter(lines, lambda x: x.rlike("^[ \t]*[-*•]"))).alias("bullet"),
    )

    def counts(w: Column, lines: Column) -> Column:
        named = {
            "n_words": w["n"],
            "word_chars": F.char_length(text) - _count(text, r"[\x20\x09-\x0D]"),
            "n_symbols": _count(text, _SYMBOLS),
            "n_marks": _count(text, "[!?]"),
            "n_upper": _count(text, r"\p{Lu}"),
            "n_stop_words": w["stop"],
            "n_repeat_words": w["repeat"],
            "n_lines": lines["n"],
            "n_dup_lines": lines["dup"],
            "n_ellipsis_lines": lines["ellipsis"],
            "n_bullet_lines": lines["bullet"],
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in named.items()])

    return let(let(words_of(F.col("text")), of_words), lambda w: let(let(worded, of_lines), lambda lines: counts(w, lines)))


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the column ``_counts``, a struct of every count that the rules name."""
    return docs.withColumn("_counts", counts_of())


def compile_rules(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row with these counts breaks, as an array."""
    broken = []
    for rule in rules:
        scaled, base = counts[rule.numerator] * 100, counts[rule.denominator]
        tests = [scaled < base * rule.low] if rule.low is not None else []
        tests += [scaled > base * rule.high] if rule.high is not None else []
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        broken.append(F.when(test, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def verdict_of(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts, the broken rules, base_failed and kept."""
    failed = (counts["n_words"] < MIN_WORDS) | (counts["n_repeat_words"] * 100 > counts["n_words"] * MAX_REPEAT_PERCENT)
    broken = compile_rules(counts, rules)
    return F.struct(counts.alias("counts"), broken.alias("broken"), failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row and column of ``docs`` plus ``_verdict``: counts, broken (rule names), base_failed and kept.

    A null or wordless text has counts of zero, fails the base and breaks no ratio rule. Rows are
    judged one by one, so ties, repeated rows and null ids change nothing; an empty table stays so.
    """
    return docs.withColumn("_verdict", let(counts_of(), lambda c: verdict_of(c, rules)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base and every rule, with the columns of ``docs``."""
    # The row itself is one column, so a column of its own named _verdict is kept.
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return judge(rows).where("_verdict.kept").select("row.*")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the result of the registered query."""
    stop = ", ".join(f"'{w}'" for word in dict.fromkeys(STOP_WORDS) for w in (word, word.capitalize()))
    checks = []
    for r in RULES:
        checks += [f"100 * {r.numerator} >= {r.low} * {r.denominator}"] if r.low is not None else []
        checks += [f"100 * {r.numerator} <= {r.high} * {r.denominator}"] if r.high is not None else []
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM win WHERE c > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
             length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop_words,
             coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ls, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet_lines
      FROM w LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept
FROM j"""
