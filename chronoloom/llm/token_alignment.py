"""Alignment of two tokenizers over a corpus, with a map of ids of the same bytes as the fast path.

A text, with a space before it, is encoded by A (byte-level BPE) and by B (BPE over pieces with byte
fallback). Offsets where tokens of both end cut the tokens into groups; within a group all pairs of
tokens whose byte ranges overlap are links. Each pair of ids is counted by the documents that hold
it linked, and each link is measured by that count.

Method. ``Vocabularies.same`` maps an A id to the B id of the same bytes, so a group of one A and
one B token is known from its A id alone. Such pairs are counted in vectors as long as A's
vocabulary, one a task, which are summed. Only pairs of irregular groups are shuffled, and these
once a block of documents (see ``blocks``).

Texts are cut where a space follows a character that is no white space. Neither tokenizer joins
across such a place: A's pattern takes a space only before other characters, B has no piece with a
space after another character (checked when the model is read; else texts stay whole). So a chunk,
mostly a word, is encoded and aligned once and remembered, and a document is a list of chunks. A
text with a chunk whose bytes do not come back is encoded as a whole instead.

A null or empty text, and one whose bytes do not come back from A or B, has no tokens: zeros and an
empty digest; its pairs count nowhere. Rows with a null, equal or repeated id are documents of their
own. An empty table gives an empty result; other columns are not read. A text is processed whole by
one task, whose memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.blocks import BLOCK_ITEMS, BLOCK_ROWS, WIDE_ROWS, BlockNumbers, list_of, looked_up, one_list, ranges
from chronoloom.llm.common import write_table

#: Where the vocabulary files of public tokenizers lie, and the two that are aligned.
TOKENIZER_DIR, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of chunks that a task remembers, each chunk counted with CHUNK_COST more.
MEMORY_CHARS, CHUNK_COST = 1 << 27, 300
#: Characters that the leaner library gets at once.
LEAN_CHARS = 1 << 14
#: Characters of texts that are encoded together.
PORTION_CHARS = 1 << 20
#: A pair of ids as one number: the A id above B_BITS bits of the B id.
B_BITS = 20

_CUT, _BLANK_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
#: Fixed value: the pattern that cuts texts before A's merges. It is that of A's file.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of whose classes no library has doubts.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ–—‘-„…€]*")


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the map of A ids to B ids of the same bytes."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        known = self.a.get_vocab()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        self.b_bytes, self.cut, normal = [], True, {}
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
                normal[self.b_bytes[i]] = i
                self.cut &= not re.search("[^▁]▁", piece)
        single = {self.b_bytes[i]: i for i in range(len(self.b_bytes)) if self.b.is_byte(i)}
        same = {**single, **normal}  # a character with a piece of its own is never written by its byte
        self.same = np.array([same.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes)]
        # A's merges in order of its ids are ranks, by which a leaner library gives the same ids.
        model = json.loads(a_json)["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ordered = [known[m] for m in merged] == list(range(256, 256 + len(merged)))
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x}
        self.lean = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A ids; texts of common characters by ranks, others and very long ones by the library of A's file."""
        if self.lean is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        lean, plain = self.lean.encode_ordinary, _PLAIN.fullmatch
        # Of a million blanks in a row the leaner library's pattern makes an overflow.
        found = [lean(t) if len(t) <= LEAN_CHARS and plain(t) else None for t in texts]
        other = [k for k, ids in enumerate(found) if ids is None]
        for k, e in zip(other, self.a.encode_batch([texts[k] for k in other], add_special_tokens=False)):
            found[k] = e.ids
        return found

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """A and B ids of each text, which begins with a space, and whether both give its bytes back."""
        of_a, of_b = self.encode_a(texts), self.b.encode([t[1:] for t in texts], num_threads=1)
        raw = "".join(texts).encode()
        ends = np.cumsum([len(t.encode()) for t in texts])
        back = []
        for ids, table, sizes in zip((of_a, of_b), (self.a_bytes, self.b_bytes), self.sizes):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            own = np.concatenate([[0], np.cumsum(sizes[flat])])[np.cumsum([len(x) for x in ids])]
            back.append(np.array_equal(own, ends) and b"".join(map(table.__getitem__, flat.tolist())) == raw)
        if all(back):
            return of_a, of_b, [True] * len(texts)
        alike = lambda ids, table, text: b"".join([table[i] for i in ids]) == text.encode()
        return of_a, of_b, [alike(a, self.a_bytes, t) and alike(b, self.b_bytes, t) for a, b, t in zip(of_a, of_b, texts)]


class Alignment(NamedTuple):
    """What several texts give: their groups as text, and their links (pair numbers), one text after the other; counts has a row a text."""

    groups: list[str]
    links: np.ndarray
    counts: np.ndarray  # A tokens, B tokens, groups, links


def aligned(vocabularies: Vocabularies, of_a: list[list[int]], of_b: list[list[int]]) -> Alignment:
    """Groups and links of texts whose bytes both tokenizers give back, none of them empty.

    Ends of A tokens and of B tokens are merged: between two neighbours of all ends lies exactly one
    overlap of an A and a B token, a link; ends that both have cut the groups.
    """
    ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in (of_a, of_b)]
    lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b)]
    ends = [np.cumsum(sizes[i]) for sizes, i in zip(vocabularies.sizes, ids)]
    text_ends = ends[0][np.cumsum(lengths[0]) - 1]
    every = np.union1d(*ends)
    at = [np.searchsorted(e, every) for e in ends]
    links = ids[0][at[0]] << B_BITS | ids[1][at[1]]
    cuts = np.intersect1d(*ends, assume_unique=True)
    last = [np.searchsorted(e, cuts) + 1 for e in ends]
    first = [np.concatenate([[0], x[:-1]]) for x in last]
    plain = (last[0] - first[0] == 1) & (last[1] - first[1] == 1)
    a, b = (x.tolist() for x in ids)
    written = [f"{a[i]}|{b[k]}" if one else f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}" for one, i, j, k, m in zip(plain.tolist(), *(x.tolist() for x in (first[0], last[0], first[1], last[1])))]
    group_ends = np.searchsorted(cuts, text_ends, side="right")
    link_ends = np.searchsorted(every, text_ends, side="right")
    groups = [";".join(written[i:j]) for i, j in zip([0, *group_ends[:-1].tolist()], group_ends.tolist())]
    counts = np.column_stack([*lengths, np.diff(group_ends, prepend=0), np.diff(link_ends, prepend=0)])
    return Alignment(groups, links, counts)


class Chunks:
    """Chunks that were aligned before: their counts, groups and links by number. Chunks are known without the space before them."""

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies = vocabularies
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = array("q")  # A tokens, B tokens, groups, links
        self.links, self.starts = array("q"), array("q")
        self.bad: set[int] = set()
        self.cost = 0

    @property
    def full(self) -> bool:
        return self.cost > MEMORY_CHARS

    def _add(self, texts: list[str]) -> list[int]:
        """Numbers of new chunks, which begin with a space."""
        of_a, of_b, good = self.vocabularies.tokens(texts)
        if not all(good):
            of_a, of_b = ([x for x, fine in zip(of, good) if fine] for of in (of_a, of_b))
        start = len(self.groups)
        found = aligned(self.vocabularies, of_a, of_b) if of_a else Alignment([], np.zeros(0, np.int64), np.zeros((0, 4), np.int64))
        numbers = np.cumsum(good) - 1 + start
        self.starts.frombytes((len(self.links) + np.cumsum(found.counts[:, 3]) - found.counts[:, 3]).tobytes())
        self.counts.frombytes(found.counts.astype(np.int64).tobytes())
        self.links.frombytes(found.links.tobytes())
        self.groups += found.groups
        self.cost += sum(map(len, texts)) + len(texts) * CHUNK_COST
        return [n if fine else -1 for n, fine in zip(numbers.tolist(), good)]

    def cut(self, text: str) -> list[str]:
        """The chunks of a space and ``text``, each without the space that it begins with."""
        if not self.vocabularies.cut:
            return [text]
        if text[:1] != " " and not _BLANK_SPACE.search(text):
            return text.split(" ")
        return [c[1:] for c in _CUT.split(" " + text)]

    def numbers(self, texts: list[str | None]) -> list[list[int] | None]:
        """The chunks of each text; None for one without tokens."""
        cut = [self.cut(t) if t else None for t in texts]
        known, found = self.known, []
        new = {c for chunks in cut if chunks for c in chunks if c not in known}
        if new:
            new = list(new)
            known.update(zip(new, self._add([" " + c for c in new])))
        for text, chunks in zip(texts, cut):
            numbers = list(map(known.__getitem__, chunks)) if chunks else None
            if numbers and -1 in numbers:
                numbers = self._add([" " + text])
                numbers = None if numbers == [-1] else numbers
            found.append(numbers)
        return found


class _Block:
    """Documents of one block, and how often each holds each pair."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.docs, self.pairs, self.times, self.items = [], [], [], 0

    def add(self, doc_id: int | None, chunks: Chunks, numbers: list[int] | None) -> None:
        if not numbers:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            return
        counts = np.frombuffer(chunks.counts, np.int64).reshape(-1, 4)
        which, times = np.unique(np.array(numbers), return_counts=True)
        totals = (counts[which] * times[:, None]).sum(axis=0)
        digest = hashlib.sha256(";".join(map(chunks.groups.__getitem__, numbers)).encode()).hexdigest()
        lengths = counts[which, 3]
        at = ranges(np.frombuffer(chunks.starts, np.int64)[which], lengths)
        self.pairs.append(np.frombuffer(chunks.links, np.int64)[at])
        self.times.append(np.repeat(times, lengths))
        self.docs.append(np.full(len(at), len(self.rows)))
        self.rows.append((doc_id, *totals.tolist(), digest))
        self.items += len(at)

    def batch(self, number: int, same: np.ndarray) -> pa.RecordBatch:
        """One row. Items are the irregular pairs, then the A ids that stand for a pair of the same bytes."""
        empty = np.zeros(0, np.int64)
        pairs, which = np.unique(np.concatenate([empty, *self.pairs]), return_inverse=True)
        regular = same[pairs >> B_BITS] == (pairs & ((1 << B_BITS) - 1))
        place = np.empty(len(pairs), np.int64)
        place[~regular], place[regular] = np.arange((~regular).sum()), (~regular).sum() + np.arange(regular.sum())
        key = np.concatenate([empty, *self.docs]) * max(1, len(pairs)) + place[which]
        order = np.argsort(key, kind="stable")
        entries, first = np.unique(key[order], return_index=True)
        times = np.add.reduceat(np.concatenate([empty, *self.times])[order], first) if len(first) else empty
        docs, items = np.divmod(entries, max(1, len(pairs)))
        holders = np.bincount(items, minlength=len(pairs))
        at = np.searchsorted(docs, np.arange(len(self.rows) + 1))
        cut = int((~regular).sum())
        columns = {
            "block": pa.array([number], pa.int64()),
            "rows": one_list(pa.array([dict(zip(_NAMES, r)) for r in self.rows], _ROW)),
            "pairs": one_list(pairs[~regular]),
            "pair_docs": one_list(holders[:cut].astype(np.int64)),
            "same": one_list((pairs[regular] >> B_BITS).astype(np.int32)),
            "same_docs": one_list(holders[cut:].astype(np.int64)),
            "at": one_list(at.astype(np.int32)),
            "items": one_list(items.astype(np.int32)),
            "times": one_list(times.astype(np.int32)),
        }
        return pa.RecordBatch.from_pydict(columns)


_NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_ROW = pa.struct([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in _NAMES])
_ROW_SQL = "struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
_BLOCK_SQL = f"block long, rows array<{_ROW_SQL}>, pairs array<long>, pair_docs array<long>, same array<int>, same_docs array<long>, at array<int>, items array<int>, times array<int>"

#: The aligned chunks of this worker, kept from task to task: (key of the vocabularies, Chunks).
_worker: list = [None, None]


def _chunks(files: tuple[bytes, bytes]) -> Chunks:
    key = tuple(hashlib.sha256(f).digest() for f in files)
    if _worker[0] != key:
        _worker[:] = [key, Chunks(Vocabularies(*files))]
    return _worker[1]


def read_files(directory: str = TOKENIZER_DIR, a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[bytes, bytes]:
    """The two vocabulary files, which tasks get by broadcast (a few MB, whatever the corpus)."""
    return tuple(open(f"{directory}/{name}", "rb").read() for name in (a_file, b_file))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str | None]]]:
    """Rows whose texts are encoded together."""
    rows, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append((doc_id, text.as_py()))
            size += len(rows[-1][1] or "")
            if size > PORTION_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def encode_blocks(docs: DataFrame, files: tuple[bytes, bytes], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Blocks of encoded documents: per document counts and digest, per block its distinct pairs and which document holds which how often."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, numbers, block = _chunks(shared.value), BlockNumbers(), _Block()
        same = chunks.vocabularies.same
        for rows in _portions(batches):
            if chunks.full:
                chunks.clear()
            for (doc_id, _), found in zip(rows, chunks.numbers([text for _, text in rows])):
                block.add(doc_id, chunks, found)
                if block.items >= block_items or len(block.rows) >= BLOCK_ROWS:
                    yield block.batch(numbers.take(), same)
                    block = _Block()
        if block.rows:
            yield block.batch(numbers.take(), same)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoded, _BLOCK_SQL)


def same_byte_counts(blocks: DataFrame, n_ids: int) -> DataFrame:
    """(a_id, documents) for pairs of the same bytes: each task adds its blocks into one vector as long as A's vocabulary."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                total[list_of(batch.column(0), row)] += list_of(batch.column(1), row)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"a_id": pa.array(held.astype(np.int32)), "documents": pa.array(total[held])})

    return blocks.select("same", "same_docs").mapInArrow(added, "a_id int, documents long").groupBy("a_id").agg(F.sum("documents").alias("documents"))


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, pair, here): the irregular pairs of each block and how many of its documents hold them."""
    return blocks.select("block", F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("here"))


def pair_counts(blocks: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(a_id, b_id, documents) for every pair of ids that is linked anywhere."""
    same = vocabularies.same
    shared = blocks.sparkSession.createDataFrame([(int(a), int(same[a])) for a in np.flatnonzero(same >= 0)], "a_id int, b_id int")
    regular = same_byte_counts(blocks, len(same)).join(F.broadcast(shared), "a_id").select("a_id", "b_id", "documents")
    irregular = _pair_rows(blocks).groupBy("pair").agg(F.sum("here").alias("documents"))
    return regular.unionByName(irregular.select(F.shiftright("pair", B_BITS).cast("int").alias("a_id"), F.expr(f"int(pair & {(1 << B_BITS) - 1})").alias("b_id"), "documents"))


def align(docs: DataFrame, files: tuple[bytes, bytes] | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module)."""
    spark: SparkSession = docs.sparkSession
    files = files or read_files()
    same = Vocabularies(*files).same
    blocks = write_table(encode_blocks(docs, files, block_items), "token-blocks", **WIDE_ROWS)
    counts = write_table(_pair_rows(blocks).groupBy("pair").agg(F.sum("here").alias("documents")), "token-pairs")

    # Both vectors are as long as A's vocabulary, whatever the corpus.
    of_same, best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    for a_id, n in same_byte_counts(blocks, len(same)).collect():
        of_same[a_id] = best[a_id] = n
    for a_id, n in counts.groupBy(F.shiftright("pair", B_BITS).cast("int")).agg(F.max("documents")).collect():
        best[a_id] = max(best[a_id], n)
    shared = spark.sparkContext.broadcast((of_same, best))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_same, best = shared.value
        for batch in batches:
            named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                pairs, ids, at, items, times, found = (list_of(named[n], row) for n in ("pairs", "same", "at", "items", "times", "documents"))
                count = np.concatenate([found, of_same[ids]]).astype(np.int64)
                tops = best[np.concatenate([pairs >> B_BITS, ids]).astype(np.int64)]
                times = times.astype(np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * count[items], times * (count == tops)[items])]
                count_sum, n_best = (s[at[1:]] - s[at[:-1]] for s in sums)
                rows = named["rows"][row].values
                columns = {n: rows.field(n) for n in _NAMES}
                yield pa.RecordBatch.from_pydict(columns | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})

    entries = _pair_rows(blocks).select("block", "pair").join(counts, "pair")
    ready = looked_up(blocks.drop("pair_docs", "same_docs"), entries, "pair", ["documents"], "found").withColumn("documents", F.col("found.documents")).drop("found")
    result = ready.mapInArrow(measured, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
