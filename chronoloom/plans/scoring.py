"""Queries of retrieval, metrics, judging and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import dedup, judge, metrics, retrieval, sampling
from chronoloom.plans.tables import QA_SQL, qa_pairs, table


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _corpus(spark: SparkSession, sf_dir: str) -> dict:
    """Benchmark items, each against all documents."""
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("corpus"), "doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.lit("all").alias("corpus"), "text")
    return {"corpus": docs, "queries": asked, "group": "corpus", "doc": "doc_id", "query": "item_id"}


def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best(**_corpus(spark, sf_dir), k=5).select("item_id", "doc_id", "n_tokens", F.round("score", 6).alias("score"), "rank")


def rag_overshoot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fitting(**_corpus(spark, sf_dir), target=2000).select("item_id", "doc_id", "n_tokens", "rank")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    return pairs.select("pair_id", "person_id", F.col("instruction").alias("reference"), F.col("response").alias("candidate"))


def google_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_answers(spark, sf_dir), ["google_bleu"]).select("pair_id", *_r("google_bleu"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_answers(spark, sf_dir), ["rouge_l"]).select("pair_id", *_r("rouge_l"))


def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_answers(spark, sf_dir), ["chrf"]).select("pair_id", *_r("chrf"))


def meteor_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(_answers(spark, sf_dir), ["meteor_exact"]).select("pair_id", F.round("meteor_exact", 9).alias("meteor_exact"))


def metric_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.evaluate(_answers(spark, sf_dir), ["meteor_exact"]).withColumn("half", (F.col("person_id") % 2).cast("int"))
    return metrics.group_means(scores, ["half"], ["meteor_exact"]).select("half", *_r("meteor_exact_mean", "meteor_exact_median"))


def embedding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 10).cast("long").alias("text_id"))
    left, right = vectors.where("vec_id % 10 < 5"), vectors.where("vec_id % 10 >= 5")
    return metrics.greedy_cosine(left, right, "text_id", "vec_id", "embedding").select("text_id", *_r("precision", "recall", "f1"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a judge's replies: most in their place, every seventh under other names."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("model_name")), "doc_id")
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    usual = F.concat(F.lit('{"correctness": {"score": '), q, F.lit(', "explanation": ""}, "completeness": {"score": "'), t, F.lit('"}}'))
    other = F.concat(F.lit('{"Correct_answer": '), q, F.lit(', "was complete": {"score": '), t, F.lit("}}"))
    reply = F.when(F.col("doc_id") % 7 == 0, other).when(F.col("doc_id") % 11 == 0, F.lit("no json")).otherwise(usual)
    return labels.select(F.col("doc_id").alias("instruction_id"), "model_name", reply.alias("reply")).withColumn("scores", judge.repaired_scores(F.col("reply")))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("instruction_id", "scores.correctness", "scores.completeness")


def judge_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.average_scores(_judged(spark, sf_dir), ["model_name"]).select("model_name", *_r("correctness", "completeness"))


def judge_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = judge.criterion_scores(_judged(spark, sf_dir), "correctness").withColumn("criterion", F.lit("correctness"))
    found = sampling.bootstrap(values, "value", ["criterion"])
    return found.select("criterion", "n", *_r("mean", "lower", "upper", "half_width"))


def head_to_head_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("instruction_id"), F.coalesce("lang", F.lit("")).alias("lang"))
    mark = F.get(F.array(*map(F.lit, ["I say [[A]]", "[[B]] it is", "[[C]]", "[[B]] not [[A]]", "no idea"])), (F.col("instruction_id") % 5).cast("int"))
    replies = docs.select("lang", mark.alias("result"), F.when(F.col("instruction_id") % 3 == 0, "swapped").otherwise("original").alias("order"))
    return judge.win_rates(replies, ["lang"]).select("lang", "win", "loss", "tie", "total", *_r("win_rate", "loss_rate", "tie_rate"))


def head_to_head_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = qa_pairs(spark, sf_dir)
    asked = pairs.select(F.col("person_id").alias("instruction_id")).distinct()
    answers = pairs.select(F.col("person_id").alias("instruction_id"), "pair_id", F.col("response").alias("model_response"))
    numbered = answers.withColumn("position", F.split_part("pair_id", F.lit("-"), F.lit(2)).cast("int"))
    samples = judge.head_to_head_samples(asked, numbered.where("position % 4 = 0"), numbered.where("position % 4 = 2"))
    return samples.select("question_id", F.md5("ans1").alias("ans1"), F.md5("ans2").alias("ans2"), "order")


def rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 13 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("model_rank"))
    return metrics.rank_stats(items.withColumnRenamed("l_returnflag", "model_name")).select("model_name", *_r("mean", "median", "std"), "count")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), "event_type")
    return dedup.keep_first(events, "person_id", ["event_id"])


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person_id"), "event_type")
    return dedup.keep_last(events, "person_id", ["event_id"])


def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person_id"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), "event_type", "event_id")
    return dedup.lookup_last(orders, events, "person_id", "event_type", ["event_id"])


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def annotator_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "toxic")
    return gold.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


QUERIES = {f.__name__: f for f in (
    bm25_top5, rag_overshoot, google_bleu, rouge_l, chrf, meteor_exact, metric_group_means, embedding_match, judge_scores, judge_average, judge_bootstrap, head_to_head_rates,
    head_to_head_samples, rank_stats, dedup_first, dedup_last, lookup_last_wins, resume_antijoin, annotator_filter_join,
)}

_WORDS = r"regexp_extract_all({}, '[^ \t\n\x0B\f\r]+')"
_BM25 = rf"""WITH d AS (SELECT 'all' AS source, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sz AS (SELECT source, count(*) AS n, avg(len(w)) AS mean FROM d GROUP BY source),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
ri AS (SELECT source, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df JOIN sz USING (source)),
fl AS (SELECT source, avg(idf) * 0.25 AS floor FROM ri GROUP BY source),
i AS (SELECT source, term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM ri JOIN fl USING (source)),
q AS (SELECT item_id, 'all' AS source, {_WORDS.format("text")} AS w FROM benchmark),
a AS (SELECT item_id, source, unnest(w) AS term FROM q),
h AS (SELECT item_id, source, d.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.w) / mean))) AS score
      FROM a JOIN i USING (source, term) JOIN tf USING (source, term) JOIN d USING (source, doc_id) JOIN sz USING (source) GROUP BY ALL),
s AS (SELECT item_id, d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, coalesce(score, 0.0) AS score FROM q JOIN d USING (source) LEFT JOIN h USING (item_id, source, doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s)"""


#: The last of a word on one side goes with the last of it on the other; a chunk ends where either side's next match stands elsewhere.
_METEOR = rf"""WITH {QA_SQL},
w AS (SELECT pair_id, person_id, {_WORDS.format("lower(coalesce(instruction, ''))")} AS r, {_WORDS.format("lower(coalesce(response, ''))")} AS c FROM qa),
cr AS (SELECT pair_id, g, i, row_number() OVER (PARTITION BY pair_id, g ORDER BY i DESC) AS k FROM (SELECT pair_id, unnest(r) AS g, generate_subscripts(r, 1) AS i FROM w)),
cc AS (SELECT pair_id, g, i, row_number() OVER (PARTITION BY pair_id, g ORDER BY i DESC) AS k FROM (SELECT pair_id, unnest(c) AS g, generate_subscripts(c, 1) AS i FROM w)),
a AS (SELECT pair_id, cc.i AS i, cr.i AS j FROM cr JOIN cc USING (pair_id, g, k)),
b AS (SELECT pair_id, i = lag(i) OVER o + 1 AND j = lag(j) OVER o + 1 AS joined FROM a WINDOW o AS (PARTITION BY pair_id ORDER BY i)),
m AS (SELECT pair_id, count(*) AS m, count(*) FILTER (coalesce(NOT joined, true)) AS chunks FROM b GROUP BY pair_id),
x AS (SELECT pair_id, person_id, m, chunks, m / len(c)::DOUBLE AS p, m / len(r)::DOUBLE AS rc FROM w LEFT JOIN m USING (pair_id)),
e AS (SELECT pair_id, person_id, coalesce((1 - 0.5 * pow(chunks / m::DOUBLE, 3)) * p * rc / (0.9 * p + 0.1 * rc), 0.0)::DOUBLE AS s FROM x)"""

#: A row of lengths for each word of the reference, from the row before: each is the greatest so far of what a match or none would give.
_ROUGE = rf"""WITH RECURSIVE {QA_SQL},
w AS (SELECT pair_id, {_WORDS.format("coalesce(instruction, '')")} AS r, {_WORDS.format("coalesce(response, '')")} AS c FROM qa),
d AS (SELECT pair_id, r, c, CAST(0 AS BIGINT) AS i, [0 FOR y IN c] AS row FROM w
      UNION ALL
      SELECT pair_id, r, c, i + 1, [list_max(best[:j]) FOR j IN range(1, len(c) + 1)]
      FROM (SELECT *, [CASE WHEN c[j] = r[i + 1] THEN coalesce(row[j - 1], 0) + 1 ELSE row[j] END FOR j IN range(1, len(c) + 1)] AS best FROM d WHERE i < len(r)))
SELECT pair_id, round(coalesce(2.0::DOUBLE * coalesce(row[-1], 0) / nullif(len(r) + len(c), 0), 0.0), 6)::DOUBLE AS rouge_l FROM d WHERE i = len(r)"""

_SPLIT = r"flatten([CASE WHEN length(x) > 1 AND NOT regexp_matches(right(x, 1), '[\p{L}\p{N}]') THEN [left(x, -1), right(x, 1)] WHEN length(x) > 1 AND NOT regexp_matches(left(x, 1), '[\p{L}\p{N}]') THEN [left(x, 1), substr(x, 2)] ELSE [x] END FOR x IN w])"
_CHRF = rf"""WITH {QA_SQL},
t AS (SELECT pair_id, 'r' AS side, {_WORDS.format("coalesce(instruction, '')")} AS w FROM qa UNION ALL SELECT pair_id, 'c', {_WORDS.format("coalesce(response, '')")} FROM qa),
u AS (SELECT pair_id, side, 6 AS most, [x FOR x IN string_split(array_to_string(w, ''), '') IF x <> ''] AS u FROM t UNION ALL SELECT pair_id, side, 2, {_SPLIT} FROM t),
k AS (SELECT *, unnest(range(1, most + 1)) AS k FROM u),
g AS (SELECT pair_id, side, most, k, array_to_string(u[i:i + k - 1], chr(31)) AS g, count(*) AS n FROM (SELECT *, unnest(range(1, len(u) - k + 2)) AS i FROM k) GROUP BY ALL),
m AS (SELECT pair_id, most, k, sum(least(a.n, b.n)) AS m FROM g a JOIN g b USING (pair_id, most, k, g) WHERE a.side = 'r' AND b.side = 'c' GROUP BY ALL),
o AS (SELECT pair_id, most, k, max(CASE WHEN side = 'r' THEN greatest(len(u) - k + 1, 0) END) AS tr, max(CASE WHEN side = 'c' THEN greatest(len(u) - k + 1, 0) END) AS tc FROM k GROUP BY ALL),
p AS (SELECT pair_id, coalesce(m / nullif(tc, 0)::DOUBLE, 0) AS p, coalesce(m / nullif(tr, 0)::DOUBLE, 0) AS r FROM o LEFT JOIN m USING (pair_id, most, k) WHERE tr > 0 OR tc > 0),
s AS (SELECT pair_id, avg(CASE WHEN p + r > 0 THEN 5.0::DOUBLE * p * r / (4.0::DOUBLE * p + r) ELSE 0 END) * 100 AS s FROM p GROUP BY pair_id)
SELECT pair_id, round(coalesce(s, 0.0), 6)::DOUBLE AS chrf FROM qa LEFT JOIN s USING (pair_id)"""

_JUDGED = """WITH j AS (SELECT doc_id, coalesce(source, 'none') AS model_name,
      CASE WHEN doc_id % 7 = 0 OR doc_id % 11 <> 0 THEN CAST(quality AS DOUBLE) END AS correctness, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 <> 0 THEN CAST(toxic AS DOUBLE) END AS completeness
      FROM labels JOIN documents USING (doc_id))"""

ORACLES = {
    "rouge_l": _ROUGE,
    "chrf": _CHRF,
    "bm25_top5": f"{_BM25} SELECT item_id, doc_id, n_tokens, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "rag_overshoot": f"{_BM25}, f AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT item_id, doc_id, n_tokens, rank FROM f WHERE before <= 2000",
    "google_bleu": rf"""WITH {QA_SQL},
w AS (SELECT pair_id, {_WORDS.format("coalesce(instruction, '')")} AS r, {_WORDS.format("coalesce(response, '')")} AS c FROM qa),
k AS (SELECT unnest([1, 2, 3, 4]) AS k),
gr AS (SELECT pair_id, k, array_to_string(r[i:i + k - 1], ' ') AS g, count(*) AS n FROM (SELECT pair_id, r, k, unnest(range(1, len(r) - k + 2)) AS i FROM w, k) GROUP BY ALL),
gc AS (SELECT pair_id, k, array_to_string(c[i:i + k - 1], ' ') AS g, count(*) AS n FROM (SELECT pair_id, c, k, unnest(range(1, len(c) - k + 2)) AS i FROM w, k) GROUP BY ALL),
m AS (SELECT pair_id, sum(least(gr.n, gc.n)) AS m FROM gr JOIN gc USING (pair_id, k, g) GROUP BY pair_id),
t AS (SELECT pair_id, greatest(list_sum([greatest(len(r) - k, 0) for k in range(4)]), list_sum([greatest(len(c) - k, 0) for k in range(4)])) AS t, len(r) = 0 OR len(c) = 0 AS none FROM w)
SELECT pair_id, round(CASE WHEN none THEN 0.0 ELSE coalesce(m, 0) / t::DOUBLE END, 6)::DOUBLE AS google_bleu FROM t LEFT JOIN m USING (pair_id)""",
    "meteor_exact": f"{_METEOR} SELECT pair_id, round(s, 9) AS meteor_exact FROM e",
    "metric_group_means": f"{_METEOR} SELECT CAST(person_id % 2 AS INTEGER) AS half, round(avg(s), 6) AS meteor_exact_mean, round(median(s), 6) AS meteor_exact_median FROM e GROUP BY half",
    "embedding_match": """WITH v AS (SELECT vec_id, CAST(floor(vec_id / 10) AS BIGINT) AS text_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.text_id, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b USING (text_id) WHERE a.vec_id % 10 < 5 AND b.vec_id % 10 >= 5),
r AS (SELECT text_id, avg(m) AS recall FROM (SELECT text_id, i, max(c) AS m FROM s GROUP BY ALL) GROUP BY text_id),
p AS (SELECT text_id, avg(m) AS precision FROM (SELECT text_id, j, max(c) AS m FROM s GROUP BY ALL) GROUP BY text_id)
SELECT text_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(precision * recall * 2 / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM r JOIN p USING (text_id)""",
    "judge_scores": f"{_JUDGED} SELECT doc_id AS instruction_id, correctness, completeness FROM j",
    "judge_average": f"{_JUDGED} SELECT model_name, round(coalesce(avg(correctness), 0), 6) AS correctness, round(coalesce(avg(completeness), 0), 6) AS completeness FROM j GROUP BY model_name",
    "judge_bootstrap": f"""{_JUDGED},
v AS (SELECT correctness AS x, row_number() OVER (ORDER BY correctness) - 1 AS i, count(*) OVER () AS n FROM j WHERE correctness IS NOT NULL),
d AS (SELECT b.range AS b, CAST('0x' || substr(md5('0|' || b.range || '|' || v.i // 4), CAST(1 + 8 * (v.i % 4) AS INTEGER), 8) AS BIGINT) % n AS i FROM v, range(10000) b),
m AS (SELECT b, avg(x) AS m FROM d JOIN v USING (i) GROUP BY b),
q AS (SELECT quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m)
SELECT 'correctness' AS criterion, (SELECT count(*) FROM v) AS n, round((SELECT avg(x) FROM v), 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper, round((upper - lower) / 2, 6) AS half_width FROM q""",
    "head_to_head_rates": """WITH m AS (SELECT coalesce(lang, '') AS lang, doc_id % 5 AS k, doc_id % 3 = 0 AS swapped FROM documents),
v AS (SELECT lang, CASE WHEN k IN (0, 3) THEN CASE WHEN swapped THEN 'loss' ELSE 'win' END WHEN k = 1 THEN CASE WHEN swapped THEN 'win' ELSE 'loss' END WHEN k = 2 THEN 'tie' END AS v FROM m),
c AS (SELECT lang, count(*) FILTER (v = 'win') AS win, count(*) FILTER (v = 'loss') AS loss, count(*) FILTER (v = 'tie') AS tie, count(v) AS total FROM v GROUP BY lang)
SELECT *, round(coalesce(win / nullif(total, 0)::DOUBLE, 0), 6) AS win_rate, round(coalesce(loss / nullif(total, 0)::DOUBLE, 0), 6) AS loss_rate, round(coalesce(tie / nullif(total, 0)::DOUBLE, 0), 6) AS tie_rate FROM c""",
    "head_to_head_samples": f"""WITH {QA_SQL},
n AS (SELECT person_id, response, CAST(split_part(pair_id, '-', 2) AS INTEGER) AS p FROM qa),
a AS (SELECT person_id, arg_min(response, p) AS x FROM n WHERE p % 4 = 0 GROUP BY person_id),
b AS (SELECT person_id, arg_min(response, p) AS y FROM n WHERE p % 4 = 2 GROUP BY person_id)
SELECT person_id || '_original' AS question_id, md5(x) AS ans1, md5(y) AS ans2, 'original' AS "order" FROM a JOIN b USING (person_id)
UNION ALL SELECT person_id || '_swapped', md5(y), md5(x), 'swapped' FROM a JOIN b USING (person_id)""",
    "rank_stats": """WITH r AS (SELECT l_returnflag AS model_name, CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS r FROM lineitem)
SELECT model_name, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_samp(r), 6) AS std, count(r) AS count FROM r GROUP BY model_name""",
    "dedup_first": "SELECT event_id, user_id AS person_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "dedup_last": "SELECT event_id, user_id AS person_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "lookup_last_wins": """WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT o_orderkey, o_custkey AS person_id, event_type FROM orders LEFT JOIN l ON o_custkey = user_id""",
    "resume_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "annotator_filter_join": "SELECT doc_id, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id) WHERE quality = 1",
}
