"""Relevance ranking of a person's visits, and prompts assembled from the most relevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.functions.text import fill, token_count, tokens, visit_time
from chronoloom.operators.ranked import Asked, counted, nearest
from chronoloom.sources.scratch import written

#: BM25 parameters and the share of the mean that stands in for negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25


def _sized(corpus: DataFrame, group: str, doc: str) -> DataFrame:
    return corpus.select(group, doc, tokens(F.col("text")).alias("_t")).withColumn("n_tokens", F.size("_t").cast("long"))


def _weights(asked: DataFrame, df: DataFrame, sizes: DataFrame, group: str, query: str, few=lambda rows: rows) -> DataFrame:
    """(group, query, term, _weight) of the queries' terms: how often a query has the term, times its weight in the group.

    ``df``: group, term, _df of all terms; ``few`` marks what is small beside them.
    """
    raw = df.join(few(sizes.select(group, "_n")), group).withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    floor = raw.groupBy(group).agg((F.avg("_idf") * EPSILON).alias("_floor"))
    times = asked.groupBy(query, group, "term").agg(F.count(F.lit(1)).alias("_times"))
    idf = F.when(F.col("_idf") < 0, F.col("_floor")).otherwise(F.col("_idf"))
    return raw.join(few(times), [group, "term"]).join(few(floor), group).select(group, query, "term", (F.col("_times") * idf).alias("_weight"))


def bm25_hits(corpus: DataFrame, queries: DataFrame, group: str, doc: str, query: str) -> DataFrame:
    """(group, query, doc, n_tokens, score) of the documents of a query's group that hold one of its terms.

    ``corpus``: group, doc, text; ``queries``: query, group, text. Each group is a corpus of its
    own. Terms are whitespace tokens, and case counts. A term in more than half of the documents
    would weigh below zero; it weighs EPSILON times the mean weight of its group's terms instead.
    Only terms that queries use meet the query table. Documents, such as a person's visits, are cut as often as they are read.
    """
    sized = _sized(corpus, group, doc)
    sizes = sized.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg("n_tokens").alias("_mean"))
    asked = queries.select(query, group, F.explode(tokens(F.col("text"))).alias("term"))
    # Term frequencies are needed for the queries' terms only, document frequencies for all.
    used = sized.select(group, doc, "n_tokens", F.explode("_t").alias("term")).join(asked.select(group, "term").distinct(), [group, "term"], "left_semi")
    tf = used.groupBy(group, doc, "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))
    once = sized.select(group, F.explode(F.array_distinct("_t")).alias("term"))
    df = once.groupBy(group, "term").agg(F.count(F.lit(1)).alias("_df"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("_mean"))
    found = tf.join(_weights(asked, df, sizes, group, query).join(sizes, group), [group, "term"])
    return found.groupBy(group, query, doc, "n_tokens").agg(F.sum(F.col("_weight") * F.col("tf") * (K1 + 1) / norm).alias("score"))


def bm25(corpus: DataFrame, queries: DataFrame, group: str, doc: str, query: str) -> DataFrame:
    """(group, query, doc, n_tokens, score) of every document of a query's group; those without a query term score 0.

    For groups of a bounded size, such as a person's visits; see ``best`` and ``fitting`` for others.
    """
    hits = bm25_hits(corpus, queries, group, doc, query)
    every = queries.select(query, group).join(_sized(corpus, group, doc).select(group, doc, "n_tokens"), group)
    return every.join(hits.drop("n_tokens"), [group, query, doc], "left").select(group, query, doc, "n_tokens", F.coalesce("score", F.lit(0.0)).alias("score"))


def _served(corpus: DataFrame, queries: DataFrame, group: str, doc: str, query: str, limit: int, by_tokens: bool, enough, pick) -> DataFrame:
    """What ``pick`` takes of the hits that score above 0 where that is ``enough`` (an aggregate) for a query, else what it takes of all documents of its group.

    The corpus is read to count its terms, then to score its documents where they lie: the queries, which are few beside them, go to
    every task, and a task hands on no more of a query's than can be among its best (see ``ranked``). So neither terms nor hits
    move, and a query meets documents that it doesn't hit only if its hits don't fill its result.
    """
    counts = written(counted(corpus, group, "text"), "terms")
    terms = counts.where("term IS NOT NULL").select(group, "term", F.col("_docs").alias("_df"))
    sizes = counts.where("term IS NULL").select(group, F.col("_docs").alias("_n"), (F.col("_tokens") / F.col("_docs")).alias("_mean"))
    sizes = sizes.join(F.broadcast(queries.select(group).distinct()), group, "left_semi")
    asked = queries.select(query, group, F.explode(tokens(F.col("text"))).alias("term"))
    weights = _weights(asked, terms, sizes, group, query, F.broadcast).toArrow()
    means, kind = sizes.select(group, "_mean").toArrow(), queries.schema[query].dataType

    def picked(of: DataFrame, every: bool) -> DataFrame:
        known = Asked(of.select(query, group).toArrow(), weights, means, group, query)
        near = nearest(corpus, known, group, doc, query, limit, by_tokens, every, K1, B, kind)
        return pick(near).drop("_place")

    near = written(picked(queries, False), "near")
    served = near.groupBy(query).agg(enough.alias("_enough")).where("_enough").select(query)
    lacking = queries.join(served, query, "left_anti")
    if lacking.isEmpty():
        return near
    return near.join(served, query, "left_semi").unionByName(picked(lacking, True))


def best(corpus: DataFrame, queries: DataFrame, group: str, doc: str, query: str, k: int) -> DataFrame:
    """Each query's k best documents of its group with their rank, ties by document."""
    return _served(corpus, queries, group, doc, query, k - 1, False, F.count(F.lit(1)) >= k, lambda near: top_k(near, query, doc, k, "_place"))


def fitting(corpus: DataFrame, queries: DataFrame, group: str, doc: str, query: str, target: int) -> DataFrame:
    """Each query's best documents of its group up to ``target`` tokens, the one that crosses it included."""
    return _served(corpus, queries, group, doc, query, target, True, F.sum("n_tokens") > target, lambda near: _fit(near, query, doc, target, "_place"))


def top_k(ranked: DataFrame, query: str, doc: str, k: int, place: str | None = None) -> DataFrame:
    """Each query's k best documents with their rank, ties by document."""
    return ranked.withColumn("rank", F.row_number().over(_by_rank(query, doc, place))).where(F.col("rank") <= k)


def fit_by_rank(ranked: DataFrame, query: str, doc: str, target: int | Column) -> DataFrame:
    """Each query's best documents up to ``target`` tokens; the one that crosses it is the last kept.

    ``target`` may be a column, as large on each row of a query. A document is kept if those before it do not exceed the target yet. Of documents with tokens the
    first ``target`` + 1 by rank are enough, so each task passes on no more than these.
    """
    return _fit(_nearest(ranked.where("n_tokens > 0"), query, doc, target).unionByName(ranked.where("n_tokens <= 0")), query, doc, target)


def _by_rank(query: str, doc: str, place: str | None = None):
    return Window.partitionBy(query).orderBy(F.desc(place or F.round("score", 9)), doc)


def _nearest(ranked: DataFrame, query: str, doc: str, target: int | Column) -> DataFrame:
    """Of documents that all have tokens, as many by rank as can be within ``target``."""
    return ranked.withColumn("_near", F.row_number().over(_by_rank(query, doc))).where(F.col("_near") <= target + 1).drop("_near")


def _fit(rows: DataFrame, query: str, doc: str, target: int | Column, place: str | None = None) -> DataFrame:
    order = _by_rank(query, doc, place)
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("before", before).where(F.col("before") <= target).drop("before")


#: Fixed value: the pattern of a visit's start attribute.
START = r'start="([\d/]+ [\d:]+ ?[APM]{0,2})"'


def start_time(visit: Column) -> Column:
    """The time in a visit's start attribute; the least timestamp if it has none; null if it can't be read."""
    found = F.regexp_extract(visit, START, 1)
    return F.when(found == "", F.lit("0001-01-01").cast("timestamp")).otherwise(visit_time(F.trim(found)))


def with_readable_time(visits: DataFrame, text: str = "text") -> DataFrame:
    """Visits whose start time can be read, or that have none; others can't be put in order and use up no budget."""
    return visits.where(start_time(F.col(text)).isNotNull())


def in_time(kept: DataFrame, query: str, text: str, place: str) -> DataFrame:
    """(query, context): the kept texts in order of start time, then place."""
    timed = kept.withColumn("_at", start_time(F.col(text)))
    lines = F.array_sort(F.collect_list(F.struct("_at", F.col(place), F.col(text))))
    return timed.groupBy(query).agg(F.array_join(F.transform(lines, lambda x: x[text]), "\n").alias("context"))


def relevant_texts(visits: DataFrame, asked: DataFrame, group: str, query: str, tokenizer: str = "whitespace") -> DataFrame:
    """(query, text): each query's best visits of its group within its budget, in order of time.

    ``visits``: group, visit, text; ``asked``: query, group, text, _budget (above 0). Visits without a
    readable time are passed over; the one that crosses the budget is the last. Relevance goes by
    white-space terms, budgets by ``tokenizer``.
    """
    ranked = bm25(visits, asked.select(query, group, "text"), group, "visit", query)
    sized = with_readable_time(visits).select(group, "visit", token_count(F.col("text"), tokenizer).cast("long").alias("n_tokens"))
    timed = ranked.drop("n_tokens").join(sized, [group, "visit"]).join(asked.select(query, "_budget"), query)
    kept = fit_by_rank(timed, query, "visit", F.col("_budget")).join(visits.select(group, "visit", "text"), [group, "visit"])
    return in_time(kept, query, "text", "visit").select(query, F.col("context").alias("text"))


def prompts(instructions: DataFrame, contexts: DataFrame, query: str, template: str) -> DataFrame:
    """Adds ``prompt``, the template with {context} and {question}; an instruction without a context is an error.

    The check is part of the plan: the job fails when it meets such a row.
    """
    joined = instructions.join(contexts, query, "left")
    held = F.when(F.col("context").isNull(), F.raise_error(F.concat(F.lit("no context for "), F.col(query).cast("string")))).otherwise(F.col("context"))
    return joined.withColumn("prompt", fill(template, context=held, question=F.col("instruction")))
