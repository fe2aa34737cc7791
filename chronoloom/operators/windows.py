"""Ordered events packed into windows of a token budget, and other fits of an ordered prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.text import last_tokens, token_count, visit_date
from chronoloom.operators.markup import start_attribute, visit_strings, without_earlier


def pack_starts(sizes: Column, budget: Column | int) -> Column:
    """The places (from 0) at which windows begin: a new one starts when the next size doesn't fit.

    A size above the budget has a window of its own. One pass; only the beginnings are gathered.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("from"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        n = n.cast("long")
        opens = (acc["i"] == 0) | (acc["sum"] + n > budget)
        begun = F.when(opens, F.array_append(acc["out"], acc["i"])).otherwise(acc["out"])
        return F.struct(F.when(opens, n).otherwise(acc["sum"] + n).alias("sum"), (acc["i"] + 1).alias("i"), F.when(opens, acc["i"]).otherwise(acc["from"]).alias("from"), begun.alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def pack(sizes: Column, budget: Column | int) -> Column:
    """The window number of each size in order (see ``pack_starts``)."""
    starts = pack_starts(sizes, budget)
    ends = F.transform(starts, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    return F.flatten(F.transform(ends, lambda e: F.array_repeat(e["k"], F.coalesce(F.get(starts, e["k"] + 1), F.size(sizes)) - e["s"])))


def wrapped(visits: Column) -> Column:
    """Visit texts as one record: an element of their own, each visit on a line."""
    return F.concat(F.lit("<patient>\n"), F.array_join(F.transform(visits, lambda v: F.concat(v, F.lit("\n"))), ""), F.lit("</patient>"))


def _texts(order: Column) -> Column:
    """The group's texts as an array in ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_order"), F.col("text")))), lambda x: x["text"])


def pack_windows(events: DataFrame, budget: int, min_ratio: float = 0.5, tokenizer: str = "whitespace") -> DataFrame:
    """(person_id, window_index, visits, visit_tokens, start_date, end_date, text, tokens, percent_full) from the newest visit back.

    ``events``: person_id, visit (its place in time), visit_date, text. ``visit_tokens`` are those of
    the visits, by which they fit; ``text`` is the window as a record (see ``wrapped``), newest visit
    first, and ``tokens`` and ``percent_full`` measure it, so a full window may be above 100. The last
    window is dropped if its visits hold less than ``min_ratio`` of the budget, unless it is the
    person's only one.
    """
    sized = events.withColumn("n", token_count(F.col("text"), tokenizer).cast("long"))
    newest = Window.partitionBy("person_id").orderBy(F.desc("visit"), F.desc("n"), F.desc("visit_date"), F.desc("text"))
    sized = sized.withColumn("_place", F.row_number().over(newest))
    # Only sizes are gathered per person; the texts join the windows that their visits lie in.
    sizes = F.array_sort(F.collect_list(F.struct("_place", "n")))
    folded = sized.groupBy("person_id").agg(F.transform(sizes, lambda x: x["n"]).alias("v"))
    placed = folded.select("person_id", F.posexplode(pack(F.col("v"), budget)).alias("_at", "window_index")).withColumn("_place", F.col("_at") + 1)
    each = sized.join(placed.drop("_at"), ["person_id", "_place"])
    windows = each.groupBy("person_id", "window_index").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("n").alias("visit_tokens"), F.min("visit_date").alias("start_date"), F.max("visit_date").alias("end_date"), wrapped(_texts(F.col("_place"))).alias("text")
    )
    last = F.max("window_index").over(Window.partitionBy("person_id"))
    kept = windows.withColumn("_last", last).where((F.col("window_index") < F.col("_last")) | (F.col("_last") == 0) | (F.col("visit_tokens") >= F.lit(min_ratio) * budget))
    return measured(kept.drop("_last"), budget, tokenizer)


def measured(windows: DataFrame, budget: int | None, tokenizer: str = "whitespace") -> DataFrame:
    """Adds the tokens of ``text`` and what they are of the budget in percent; 100 without a budget."""
    sized = windows.withColumn("tokens", token_count(F.col("text"), tokenizer).cast("long"))
    return sized.withColumn("percent_full", F.lit(100.0) if budget is None else F.col("tokens") * 100.0 / budget)


def whole_timeline(events: DataFrame, tokenizer: str = "whitespace") -> DataFrame:
    """Each person's visits as one window in order of time, 100 percent full by definition."""
    return last_visits(events, None, tokenizer)


def last_visits(events: DataFrame, n: int | None = 5, tokenizer: str = "whitespace") -> DataFrame:
    """Each person's last n visits (all if None) as one record in order of time, 100 percent full by definition."""
    rows = events
    if n is not None:
        rank = Window.partitionBy("person_id").orderBy(F.desc("visit"))
        rows = events.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n)
    ends = F.min("visit_date").alias("start_date"), F.max("visit_date").alias("end_date")
    one = rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("visits"), *ends, wrapped(_texts(F.col("visit"))).alias("text"))
    return measured(one, None, tokenizer).withColumn("window_index", F.lit(0))


def record_window(timelines: DataFrame, n: int | None = None, tokenizer: str = "whitespace") -> DataFrame:
    """As ``last_visits``, of records (person_id, text): the record itself without its earlier visits, whatever else it holds.

    A record without a visit has null dates.
    """
    visits = visit_strings(F.col("text"))
    kept = F.slice(visits, F.greatest(F.size(visits) - n + 1, F.lit(1)), n) if n is not None else visits
    days = F.filter(F.transform(kept, lambda v: visit_date(start_attribute(v))), lambda d: d.isNotNull())
    cut = timelines.select("person_id", F.size(kept).cast("long").alias("visits"), F.array_min(days).alias("start_date"), F.array_max(days).alias("end_date"), (without_earlier(F.col("text"), n) if n is not None else F.coalesce("text", F.lit(""))).alias("text"))
    return measured(cut, None, tokenizer).withColumn("window_index", F.lit(0))


def context_windows(events: DataFrame, mode: str | int, tokenizer: str = "whitespace") -> DataFrame:
    """Windows by mode: 'full', 'last_five', or a positive token budget."""
    mode = checked_mode(mode)
    if mode == "full":
        return whole_timeline(events, tokenizer)
    return last_visits(events, 5, tokenizer) if mode == "last_five" else pack_windows(events, mode, tokenizer=tokenizer)


def checked_mode(mode: str | int) -> str | int:
    """'full', 'last_five', or a positive number as an integer; anything else is an error."""
    if mode in ("full", "last_five"):
        return mode
    if isinstance(mode, bool) or not str(mode).isdigit() or int(mode) <= 0:
        raise ValueError(f"context mode is 'full', 'last_five' or a positive number, not {mode!r}")
    return int(mode)


def newest_that_fit(events: DataFrame, budget: int, least: int = 3, tokenizer: str = "whitespace") -> DataFrame:
    """Each person's newest visits while their running sum is within the budget: (person_id, visits, tokens, start_date, end_date, text, percent_full).

    Stops at the first overflow; persons with fewer than ``least`` visits, or of whom fewer fit,
    give no row. ``text`` is a record of these visits, newest first; tokens and percent are those of
    the visits. Sizes are not negative, so the prefix is a filter on the running sum.
    """
    newest = Window.partitionBy("person_id").orderBy(F.desc("visit"))
    sized = events.withColumn("n", token_count(F.col("text"), tokenizer).cast("long"))
    summed = sized.withColumn("_sum", F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.min("visit_date").alias("start_date"), F.max("visit_date").alias("end_date")
    fit = summed.where(F.col("_sum") <= budget).groupBy("person_id").agg(F.count(F.lit(1)).alias("visits"), F.max("_sum").alias("tokens"), *ends, wrapped(F.reverse(_texts(F.col("visit")))).alias("text"))
    return fit.where(F.col("visits") >= least).withColumn("percent_full", F.col("tokens") * 100.0 / budget)


def trailing_children(events: DataFrame, budget: int, tokenizer: str = "whitespace") -> DataFrame:
    """The visits of the longest suffix of each person's timeline within the budget, oldest first: (person_id, visit, n, kept_tokens)."""
    newest = Window.partitionBy("person_id").orderBy(F.desc("visit")).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("n", token_count(F.col("text"), tokenizer).cast("long")).withColumn("kept_tokens", F.sum("n").over(newest))
    return summed.where(F.col("kept_tokens") <= budget).select("person_id", "visit", "n", "kept_tokens")


def room(context: Column, generation: Column, template: str, instruction: Column, tokenizer: str = "whitespace") -> Column:
    """The tokens that a record may take beside the answer, the template and the instruction; none or fewer if these fill the context."""
    return context - generation - token_count(F.lit(template), tokenizer) - token_count(instruction, tokenizer)


def tail_truncate(texts: DataFrame, context: int, generation: int, template: str, text: str = "text", instruction: str = "instruction", tokenizer: str = "whitespace", first: str | None = None) -> DataFrame:
    """Adds ``budget`` and ``kept``: the last tokens of a text that fit beside template, instruction and answer; '' if none do.

    With ``first``, a cheaper tokenizer cuts to twice the budget before the exact one counts.
    """
    budget = room(F.lit(context), F.lit(generation), template, F.col(instruction), tokenizer)
    near = last_tokens(F.col(text), F.col("budget") * 2, first) if first else F.col(text)
    return texts.withColumn("budget", budget).withColumn("kept", last_tokens(near, F.col("budget"), tokenizer))
