"""BM25 over a large corpus, by arrays of a portion of its texts: terms are counted and documents scored where they lie.

A task hands on how many of its documents hold each term, then only what can be among a query's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are cut at a time, hits that are held at a time, rows that wait in a task before it hands them on.
BYTES, HITS, ROWS = 8_000_000, 2_000_000, 500_000

_SPACE = np.isin(np.arange(256), [ord(c) for c in " \t\n\x0b\f\r"])


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts, one after the other, as ``functions.text.tokens`` has them, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = solid[heads]
    begins = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(solid, dtype=np.int32)[begins] - 1, np.count_nonzero(solid)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    return tokens, np.diff(np.searchsorted(begins, ends))


def _portions(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        starts = np.append(np.unique((np.cumsum(sizes, dtype=np.int64) - sizes) // BYTES, return_index=True)[1], len(sizes))
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(start, end - start)


def counted(corpus: DataFrame, group: str, text: str) -> DataFrame:
    """(group, term, _docs, _tokens): how many documents of a group hold a term; where the term is null, all of its documents and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, text):
            tokens, size = cut(batch.column(1))
            groups, terms = batch.column(0).dictionary_encode(null_encoding="encode"), tokens.dictionary_encode()
            of, n = groups.indices.to_numpy(), max(len(terms.dictionary), 1)
            # By a sort, since np.unique looks integers up one by one.
            held = np.sort(np.repeat(np.arange(len(size)), size) * n + terms.indices.to_numpy())
            held = held[np.diff(held, prepend=-1) != 0]
            held, docs = np.unique(of[held // n] * n + held % n, return_counts=True)
            whole = np.unique(of)
            own, place = np.concatenate([held // n, whole]), pa.concat_arrays([pa.array(held % n), pa.nulls(len(whole), pa.int64())])
            docs = np.concatenate([docs, np.bincount(of)[whole]])
            sizes = np.concatenate([np.zeros(len(held), np.int64), np.bincount(of, size)[whole].astype(np.int64)])
            made = pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(own)), terms.dictionary.take(place), pa.array(docs), pa.array(sizes)], names=names)
            yield from (made.slice(at, 10_000) for at in range(0, made.num_rows, 10_000))

    names = [group, "term", "_docs", "_tokens"]
    kind = T.StructType([corpus.schema[group], *(T.StructField(name, kind()) for name, kind in zip(names[1:], (T.StringType, T.LongType, T.LongType), strict=True))])
    return corpus.select(group, text).mapInArrow(run, kind).groupBy(group, "term").agg(F.sum("_docs").alias("_docs"), F.sum("_tokens").alias("_tokens"))


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _at(values: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each value among the known ones, -1 for others."""
    return pc.fill_null(pc.index_in(values, known.cast(values.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted keys each wanted key begins, and how often it is there."""
    low = np.searchsorted(keys, wanted, "left")
    return low, np.searchsorted(keys, wanted, "right") - low


def _rows(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of these rows, n from each low."""
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


class Asked:
    """Queries and the weights of their terms as sorted arrays, which go to every task. Both are few beside the corpus.

    ``queries``: query, group; ``weights``: group, query, term, _weight; ``sizes``: group, _mean.
    """

    def __init__(self, queries: pa.Table, weights: pa.Table, sizes: pa.Table, group: str, query: str):
        self.groups, self.queries, self.terms = _column(sizes, group), pc.unique(_column(queries, query)), pc.unique(_column(weights, "term"))
        self.mean = _column(sizes, "_mean").to_numpy(zero_copy_only=False)
        keys, of = _at(_column(queries, group), self.groups), _at(_column(queries, query), self.queries)
        order = np.lexsort([of, keys])
        self.group_keys, self.group_queries = keys[order], of[order]
        keys, of = _at(_column(weights, group), self.groups) * len(self.terms) + _at(_column(weights, "term"), self.terms), _at(_column(weights, query), self.queries)
        order = np.lexsort([of, keys])
        order = order[of[order] >= 0]
        self.term_keys, self.term_queries, self.weights = keys[order], of[order], _column(weights, "_weight").to_numpy(zero_copy_only=False)[order]


def _scores(asked: Asked, batch: pa.RecordBatch, k1: float, b: float, every: bool) -> Iterator[tuple]:
    """(place of the document in the batch, of its group, of the query, n_tokens, score) of the hits, or of every document with each query of its group, as arrays."""
    group = _at(batch.column(0), asked.groups)
    tokens, size = cut(batch.column(2))
    doc, term = np.repeat(np.arange(len(size)), size), _at(tokens, asked.terms)
    used = (term >= 0) & (group[doc] >= 0)
    places, tf = np.unique(doc[used] * max(len(asked.terms), 1) + term[used], return_counts=True)
    doc, term = np.divmod(places, max(len(asked.terms), 1))
    norm = tf + k1 * (1 - b + b * size[doc] / asked.mean[group[doc]])
    low, n = _found(asked.term_keys, group[doc] * len(asked.terms) + term)
    # Documents are dealt into parts by their hits, since queries may share a frequent term.
    grouped = np.flatnonzero(group >= 0)
    first, others = _found(asked.group_keys, group[grouped])
    load = np.bincount(doc, n, len(group)) + (np.bincount(grouped, others, len(group)) if every else 0)
    part = (np.cumsum(load) // HITS).astype(np.int64)
    for p in np.unique(part[load > 0]):
        own = np.flatnonzero(part[doc] == p)
        at, m = _rows(low[own], n[own]), n[own]
        hit_doc, hit_query = np.repeat(doc[own], m), asked.term_queries[at]
        score = asked.weights[at] * np.repeat(tf[own], m) * (k1 + 1) / np.repeat(norm[own], m)
        if every:
            own = np.flatnonzero(part[grouped] == p)
            at, m = _rows(first[own], others[own]), others[own]
            hit_doc, hit_query, score = np.concatenate([hit_doc, np.repeat(grouped[own], m)]), np.concatenate([hit_query, asked.group_queries[at]]), np.concatenate([score, np.zeros(len(at))])
        pairs, place = np.unique(hit_doc * len(asked.queries) + hit_query, return_inverse=True)
        of, query = np.divmod(pairs, len(asked.queries))
        yield of, group[of], query, size[of], np.bincount(place, score, len(pairs))


def _kept(rows: pa.Table, least: np.ndarray, limit: int, by_tokens: bool) -> pa.Table:
    """Of each query's rows those before which no more than ``limit`` documents or tokens rank; raises ``least`` to the place of the last where a query is full."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_query", "ascending"), ("_place", "descending"), ("_doc", "ascending")]))
    query, place = rows.column("_query").to_numpy(), rows.column("_place").to_numpy()
    weight = rows.column("n_tokens").to_numpy() if by_tokens else np.ones(len(query), np.int64)
    before = np.cumsum(weight) - weight
    _, first, n = np.unique(query, return_index=True, return_counts=True)
    before -= np.repeat(before[first], n)
    kept = before <= limit
    last = kept & (before + weight > limit)
    least[query[last]] = np.maximum(least[query[last]], place[last])
    return rows.filter(pa.array(kept))


def _nearest(batches: Iterator[pa.RecordBatch], asked: Asked, names: list[str], limit: int, by_tokens: bool, every: bool, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    least, waiting = np.full(len(asked.queries), -np.inf), None

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [asked.groups.take(_column(rows, "_group")), asked.queries.take(_column(rows, "_query")), *(_column(rows, name) for name in ("_doc", "n_tokens", "score", "_place"))]
        yield from pa.table(columns, names=names).to_batches(10_000)

    for batch in _portions(batches, "text"):
        for of, own, asking, size, score in _scores(asked, batch, k1, b, every):
            place = np.round(score, 9) + 0.0
            near = np.flatnonzero((place >= least[asking]) & (every | (place > 0)))
            rows = pa.table({"_group": own[near], "_query": asking[near], "_doc": batch.column(1).take(pa.array(of[near])), "n_tokens": size[near], "score": score[near], "_place": place[near]})
            waiting = _kept(rows if waiting is None else pa.concat_tables([waiting, rows]), least, limit, by_tokens)
            if waiting.num_rows > ROWS:
                yield from made(waiting)
                waiting = None
    if waiting is not None:
        yield from made(waiting)


def nearest(corpus: DataFrame, asked: Asked, group: str, doc: str, query: str, limit: int, by_tokens: bool, every: bool, k1: float, b: float, query_kind: T.DataType) -> DataFrame:
    """(group, query, doc, n_tokens, score, _place): of each task's documents those that can be among a query's best.

    ``corpus``: group, doc, text. Rank goes by _place, the score at nine digits, then by doc. A document counts while no
    more than ``limit`` tokens (or documents) of its task rank before it; of all documents no fewer do. Without ``every``, only
    hits that score above 0 count.
    """
    names, kinds = [group, query, doc, "n_tokens", "score", "_place"], corpus.schema
    made = [kinds[group], T.StructField(query, query_kind), kinds[doc], T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("_place", T.DoubleType())]
    return corpus.select(group, doc, "text").mapInArrow(lambda batches: _nearest(batches, asked, names, limit, by_tokens, every, k1, b), T.StructType(made))
