"""Which of five quality filters removes what, in every order in which they can be applied.

Filters (a text fails if): A under 200 words; B 100 * distinct words < 50 * words; C 100 * capital
letters A-Z > 3 * code points; D it holds one of ``#$%&*|``; E it equals the text of a smaller id.

Method. The words of the corpus are encoded by a dictionary of all distinct words. Documents become rows of a sparse document-term matrix that is kept as CSR shards, one a block
of documents (see ``blocks``): row pointers, word ids, counts. A row's sum is its number of words,
its number of entries that of its distinct words; these two decide A and B. The other flags are
attached, and rows are counted by part, set of failed filters and labels, before any order is looked
at: 120 orders of five steps are then sums over at most 32 sets a part.

A null text is empty; it fails A alone unless a smaller id is as empty. Rows with equal ids and texts
all stay as far as E goes; a null id is never smaller and never larger than another. Labels are taken
by id, of repeated ones the largest; a null id or label is none. An empty table has no part and so no row. Other
columns are not read. A text is cut into words whole, by one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.blocks import BLOCK_ITEMS, BLOCK_ROWS, WIDE_ROWS, BlockNumbers, list_of, looked_up, one_list
from chronoloom.llm.common import write_table

FILTERS = "ABCDE"
#: Fewest words; least percent of distinct words; most percent of capitals.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"


#: What is counted of a text besides its words.
_FACTS = {"n_chars": pa.int64(), "n_capitals": pa.int64(), "n_symbols": pa.int64(), "digest": pa.binary()}
_FACTS_SQL = "struct<n_chars: long, n_capitals: long, n_symbols: long, digest: binary>"
#: Entries of a task's part of the dictionary, on average at most.
PART_ENTRIES = 1 << 20


def text_facts(raw: bytes) -> tuple[int, int, int, bytes]:
    """Code points, capitals A-Z, symbols and SHA-256 of a UTF-8 text."""
    left = lambda gone: len(raw.translate(None, gone))
    return left(bytes(range(0x80, 0xC0))), len(raw) - left(bytes(range(65, 91))), len(raw) - left(SYMBOLS), hashlib.sha256(raw).digest()


class _Shard:
    """Documents of one block by the block's own word numbers."""

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.rows, self.facts, self.columns, self.counts, self.at, self.items = [], [], [], [], [0], 0

    def add(self, row: pa.Array, raw: bytes) -> None:
        words = raw.split()  # of bytes: split() knows just the six ASCII white-space characters
        columns, counts = np.unique(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)), return_counts=True)
        self.rows.append(row)
        self.facts.append(text_facts(raw))
        self.columns.append(columns)
        self.counts.append(counts)
        self.at.append(self.at[-1] + len(columns))
        self.items += len(words)

    def batch(self, number: int) -> pa.RecordBatch:
        """One row; its words stand in order of their hashes, so each part of the dictionary is a slice of them."""
        words = list(self.words)
        order = np.argsort(_hashes(words), kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        together = lambda parts: np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
        facts = pa.StructArray.from_arrays([pa.array([f[i] for f in self.facts], t) for i, t in enumerate(_FACTS.values())], names=list(_FACTS))
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "rows": one_list(pa.concat_arrays(self.rows)),
                "facts": one_list(facts),
                "at": one_list(np.array(self.at, np.int32)),
                "columns": one_list(place[together(self.columns)]),
                "counts": one_list(together(self.counts)),
                "n_words": pa.array([len(words)], pa.int32()),
                "words": pa.array([b" ".join([words[i] for i in order])], pa.binary()),
            }
        )


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _local_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, numbers = _Shard(), BlockNumbers()
    for batch in batches:
        rows, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            shard.add(rows.slice(i, 1), texts[i].as_py() or b"")
            if shard.items >= BLOCK_ITEMS or len(shard.rows) >= BLOCK_ROWS:
                yield shard.batch(numbers.take())
                shard = _Shard()
    if shard.rows:
        yield shard.batch(numbers.take())


def _parts(bits: int):
    """Cuts each block's words into the 2 ** ``bits`` parts of the dictionary, by the upper bits of their hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, line in zip(batch.column(0), batch.column(1)):
                words = line.as_py().split()
                part = (_hashes(words) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                held, first = np.unique(part, return_index=True)
                ends = np.append(first[1:], len(words))
                lines = [b" ".join(words[i:j]) for i, j in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([block.as_py()] * len(held), pa.int64()), pa.array(lines, pa.binary())], names=["part", "block", "words"])

    return cut


def _numbered(bits: int):
    """Numbers the words of each part in order of appearance; rows come sorted by part and block, so a repeated task gives the same numbers."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, defaultdict()
        for batch in batches:
            found = []
            for part, line in zip(batch.column(0).to_pylist(), batch.column(2)):
                if part != at:
                    at, ids = part, defaultdict()
                    ids.default_factory = ids.__len__
                words = line.as_py().split(b" ")
                found.append((np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) << bits) | part)
            cuts = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], names=["part", "block", "ids"])

    return number


def document_terms(rows: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """CSR shards of the document-term matrix: block, rows (the structs of column ``row``), facts (of their texts), at (row pointers), ids (global word ids), counts.

    ``at`` has one place more than ``rows``; ``ids`` and ``counts`` from ``at[i]`` to ``at[i + 1]``
    belong to row i. The dictionary is dealt over the tasks by hash: a part numbers its own words, and
    an id is that number and the part's, so no two words share an id. A word moves once a block.
    """
    of_row = rows.schema[row].dataType.simpleString()
    kind = f"block long, rows array<{of_row}>, facts array<{_FACTS_SQL}>, at array<int>, columns array<int>, counts array<int>, n_words int, words binary"
    local = write_table(rows.select(F.col(row).alias("row"), F.col(text).cast("binary").alias("text")).mapInArrow(_local_shards, kind), "term-shards", **WIDE_ROWS)
    entries = local.agg(F.sum("n_words")).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(entries // PART_ENTRIES, 4 * tasks).bit_length()
    parts = local.where("n_words > 0").select("block", "words").mapInArrow(_parts(bits), "part long, block long, words binary")
    numbered = parts.repartition(tasks, "part").sortWithinPartitions("part", "block").mapInArrow(_numbered(bits), "part long, block long, ids array<long>")
    found = looked_up(local.drop("words", "n_words"), numbered, "part", ["ids"], "found")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, columns = batch.slice(i, 1), list_of(batch.column("columns"), i)
                ids = list_of(b.column("ids"), 0)[columns] if len(columns) else np.zeros(0, np.int64)
                same = {n: b.column(n) for n in ("block", "rows", "facts", "at")}
                yield pa.RecordBatch.from_pydict(same | {"ids": one_list(ids), "counts": b.column("counts")})

    ready = found.select("block", "rows", "facts", "at", "columns", "counts", F.flatten("found.ids").alias("ids"))
    return ready.mapInArrow(encoded, f"block long, rows array<{of_row}>, facts array<{_FACTS_SQL}>, at array<int>, ids array<long>, counts array<int>")


def row_sums(shards: DataFrame) -> DataFrame:
    """(row, facts, n_words, n_distinct): each row of the shards with its sum and its number of entries."""
    of_row = shards.schema["rows"].dataType.elementType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, counts = list_of(batch.column(2), i).astype(np.int64), list_of(batch.column(3), i).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(counts)])[at]
                yield pa.RecordBatch.from_pydict({"row": batch.column(0)[i].values, "facts": batch.column(1)[i].values, "n_words": pa.array(np.diff(total)), "n_distinct": pa.array(np.diff(at))})

    return shards.select("rows", "facts", "at", "counts").mapInArrow(summed, f"row {of_row}, facts {_FACTS_SQL}, n_words long, n_distinct long")


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, part, good, toxic, and whether it fails a, b, c, d, e."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"))
    terms = row_sums(document_terms(docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))))
    judged = terms.select(
        "row.*",
        (F.col("n_words") < MIN_WORDS).alias("a"),
        (F.col("n_distinct") * 100 < F.col("n_words") * MIN_DISTINCT).alias("b"),
        (F.col("facts.n_capitals") * 100 > F.col("facts.n_chars") * MAX_CAPITALS).alias("c"),
        (F.col("facts.n_symbols") > 0).alias("d"),
        F.col("facts.digest").alias("copy"),
    )
    judged = write_table(judged, "filter-flags")
    # One row a text on the right; copies of a hot text are a skewed join, never a group.
    first = judged.groupBy("copy").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    found = judged.join(first, "copy", "left").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return found.select("doc_id", "part", no(F.col("good")).alias("good"), no(F.col("toxic")).alias("toxic"), "a", "b", "c", "d", no(F.col("doc_id") > F.col("first_id")).alias("e"))


def _steps() -> Column:
    """Every step of every order: filter_order, step, the bit of its filter, the bits of those before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for k, i in enumerate(order):
            rows.append(f"named_struct('filter_order', '{name}', 'step', {k + 1}, 'own', {1 << i}, 'before', {sum(1 << j for j in order[:k])})")
    return F.expr(f"array({', '.join(rows)})")


def audit(judged: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, from the flags a to e of ``judged`` (see ``flags``).

    Rows are counted by part, failed filters and labels first, so the orders meet at most 128 rows a part.
    """
    failed = sum((F.col(f.lower()).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    sets = judged.groupBy("part", failed.alias("failed"), "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    at = sets.withColumn("s", F.explode(_steps())).select("*", "s.*")
    own, earlier = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    removed, n = own & ~earlier, F.col("n")
    count = lambda test: F.sum(F.when(test, n).otherwise(0)).cast("long")
    # A row falls to each of its failed filters in an equal share of the orders.
    share = n * F.lit(factorial(len(FILTERS))) / F.bit_count("failed")
    return at.groupBy("part", "filter_order", "step").agg(
        count(~own & ~earlier).alias("kept"),
        count(removed).alias("removed"),
        count(own & earlier).alias("redundant"),
        count(F.col("failed") == F.col("own")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
        F.sum(F.when(own, share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def oracle() -> str:
    """DuckDB SQL for the result of the registered query; every order is walked through, filter by filter."""
    rank = lambda f: f"strpos(filter_order, '{f}')"
    least = ", ".join(f"CASE WHEN {f.lower()} THEN {rank(f)} ELSE 9 END" for f in FILTERS)
    own = " ".join(f"WHEN '{f}' THEN {f.lower()}" for f in FILTERS)
    n_failed = " + ".join(f"CAST({f.lower()} AS INT)" for f in FILTERS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t.doc_id, part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
             len(ws) < {MIN_WORDS} AS a, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) AS b,
             100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MAX_CAPITALS} * length(text) AS c,
             regexp_matches(text, '[{SYMBOLS.decode()}]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
o AS (SELECT f.*, filter_order, least({least}) AS falls FROM f, orders),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, good, toxic, falls, {n_failed} AS n_failed,
             CASE substr(filter_order, step, 1) {own} END AS own FROM o, (SELECT unnest(range(1, 6)) AS step) k),
c AS (SELECT part, filter_order, step, letter, count(*) FILTER (falls > step) AS kept, count(*) FILTER (falls = step) AS removed,
             count(*) FILTER (own AND falls < step) AS redundant, count(*) FILTER (own AND n_failed = 1) AS unique_fails,
             count(*) FILTER (falls = step AND good) AS good_lost, count(*) FILTER (falls = step AND toxic) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c"""
