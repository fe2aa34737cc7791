"""Training rows: token sequences with masked prompts, length buckets, schedules, epoch figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.order import shuffle_key
from chronoloom.functions.text import fill, last_tokens, token_count, tokenizer_named

#: The label of a position that the loss leaves out.
IGNORED = -100


def masked_example(prompt: Column, answer: Column, tokenizer: str = "whitespace") -> Column:
    """A struct of input_ids, labels (prompt positions are IGNORED) and attention_mask."""
    p, a = (tokenizer_named(tokenizer).ids(x) for x in (prompt, answer))
    ids = F.concat(p, a)
    return F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORED), F.size(p)), a).alias("labels"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"))


def training_rows(pairs: DataFrame, template: str, context: int, tokenizer: str = "whitespace") -> DataFrame:
    """Pairs (instruction, input, output) with their masked example; the input keeps the last tokens that fit.

    With a context that leaves no room the input is empty, not the row gone.
    """
    size = lambda c: token_count(c, tokenizer)
    room = F.lit(context) - size(F.lit(template)) - size(F.col("instruction")) - size(F.col("output"))
    cut = pairs.withColumn("_kept", last_tokens(F.coalesce("input", F.lit("")), room, tokenizer))
    prompt = fill(template, instruction=F.col("instruction"), input=F.col("_kept"))
    return cut.withColumn("example", masked_example(prompt, F.coalesce("output", F.lit("")), tokenizer)).drop("_kept")


def length_batches(rows: DataFrame, length: Column, key: str, size: int, replicas: int = 1, drop_last: bool = True, shuffled: bool = False, seed: int = 0) -> DataFrame:
    """(replica, step, batch, place, key): rows of like length in batches of ``size``, dealt evenly to replicas.

    Rows are ordered by length, at random within one; batch b holds those from b * size on. With
    ``drop_last`` an unfilled last batch goes, and so do batches that would give some replicas one
    more than others. Batch b, or the b-th of a random order if ``shuffled``, is step b // replicas of
    replica b % replicas. No task holds more than a part of one length's rows: positions come from
    counts by length and hash range.
    """
    ordered = rows.select(F.col(key), length.cast("long").alias("_length"), shuffle_key(key, seed=seed).alias("_order"))
    # A cell is a hash range of one length; lengths are summed by blocks first, so no window sees all cells.
    cells = ordered.groupBy("_length", F.substring("_order", 1, 2).alias("_cut")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_block", F.shiftright("_length", 8))
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("_block").agg(F.sum("_c").alias("_b")).withColumn("_from", F.coalesce(F.sum("_b").over(before("_block")), F.lit(0))).drop("_b")
    within = Window.partitionBy("_block").orderBy("_length", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(blocks, "_block").withColumn("_start", F.col("_from") + F.coalesce(F.sum("_c").over(within), F.lit(0))).select("_length", "_cut", "_start")
    own = Window.partitionBy("_length", "_cut").orderBy("_order", key)
    placed = ordered.withColumn("_cut", F.substring("_order", 1, 2)).withColumn("_rank", F.row_number().over(own) - 1).join(starts, ["_length", "_cut"]).withColumn("_position", F.col("_start") + F.col("_rank"))
    total = rows.count()
    batches = total // size if drop_last else -(-total // size)
    batches = batches // replicas * replicas if drop_last else batches
    numbered = placed.withColumn("batch", F.floor(F.col("_position") / size).cast("long")).where(F.col("batch") < batches)
    turn = F.col("batch")
    if shuffled:
        from chronoloom.operators.sampling import global_positions

        turns = global_positions(rows.sparkSession.range(batches).select(F.col("id").alias("batch"), shuffle_key("id", seed=f"batch {seed}").alias("_order")), ["_order", "batch"])
        numbered = numbered.join(turns.select("batch", F.col("_position").alias("_turn")), "batch")
        turn = F.col("_turn")
    return numbered.select((turn % replicas).cast("int").alias("replica"), F.floor(turn / replicas).cast("long").alias("step"), "batch", (F.col("_position") % size).cast("int").alias("place"), key)


def learning_rate(step: Column, steps: int | Column, warmup: int, peak: float, least: float = 0.0) -> Column:
    """The rate at a step: a linear rise over ``warmup`` steps, then a cosine decay to ``least`` at ``steps``."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    up = F.lit(peak) * step / max(1, warmup)
    along = (step - warmup) / F.greatest(F.lit(1), steps - warmup)
    down = F.lit(least) + F.lit(peak - least) * (F.cos(F.lit(math.pi) * along) + 1.0) / 2.0
    return F.when(step < warmup, up).otherwise(down)


def scheduled(batches: DataFrame, warmup: int, peak: float, least: float = 0.0) -> DataFrame:
    """``batches`` (``length_batches``) with the rate of each row's step; the last step is that of the longest replica."""
    last = batches.agg(F.coalesce(F.max("step"), F.lit(0)).alias("_last"))
    return batches.crossJoin(F.broadcast(last)).withColumn("rate", learning_rate(F.col("step"), F.col("_last"), warmup, peak, least)).drop("_last")


def epoch_figures(steps: DataFrame) -> DataFrame:
    """(epoch, loss, perplexity) from (epoch, loss): the mean loss and its exponential."""
    return steps.groupBy("epoch").agg(F.avg("loss").alias("loss")).withColumn("perplexity", F.exp("loss"))


def run_figures(epochs: DataFrame) -> DataFrame:
    """Averages of the epochs' figures."""
    return epochs.agg(F.avg("loss").alias("avg_loss"), F.avg("perplexity").alias("avg_perplexity"), F.min("loss").alias("best_loss"))


def throughput(timed: DataFrame, seconds: str = "seconds") -> DataFrame:
    """(samples, total_seconds, seconds_per_sample)."""
    return timed.agg(F.count(F.lit(1)).alias("samples"), F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("seconds_per_sample"))


#: Dataset parameters by name; 'train' reads the training part, any other split the held-out part.
DATASETS = {"default": {"train": 0.8, "held_out": 0.2, "seed": 42}}


def dataset_part(rows: DataFrame, key: str, part: str, name: str = "default") -> DataFrame:
    from chronoloom.operators.sampling import split

    if name not in DATASETS:
        raise ValueError(f"no dataset named {name!r}")
    return split(rows, key, **DATASETS[name]).where(F.col("partition") == ("train" if part == "train" else "test")).drop("partition")
