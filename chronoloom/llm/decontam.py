"""Benchmark decontamination with SimHash windows.

Texts are cut to lower-case (A-Z) words and five-word shingles. A window is as long as a benchmark
item: as many shingles as the item has. Every window gets a 64-bit SimHash from its shingles, each
counted as often as it occurs. Items of one length stand in a multi-index: their fingerprints are
cut into eight blocks of eight bits, and each block has a table of the items that lie within two
bits of a value. Of two fingerprints at most ``RADIUS`` = 23 bits apart, one block at least differs
in two bits or fewer, so the union of the eight lookups holds every item within the radius; its
full distance is then checked. What is left is verified by the exact weighted Jaccard similarity
of the two bags of shingles.

At similarity 0.8 the expected distance is about 10 bits with a deviation of 3, so the radius
leaves more than four deviations. Windows without a single shingle of any item have similarity
zero; runs of them are passed over before they are hashed.

The benchmark is a stated query set: it is broadcast in blocks of bounded size, each against all
documents, and the documents never move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import write_table

#: Words in a shingle, and the least similarity, as a fraction.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)
#: Bits in which an item's and a window's fingerprint may differ, blocks, and bits a block may differ in.
RADIUS, BLOCKS, BLOCK_RADIUS = 23, 8, 2
#: UTF-8 bytes of item texts that one broadcast may hold.
BROADCAST_BYTES = 32 << 20
#: Words whose hashes a task remembers.
MEMORY = 1 << 19
#: Windows hashed together.
PORTION = 1 << 14

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEAR = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= BLOCK_RADIUS) for v in range(256)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = total * _MIX + words[k : k + n]
        return _scramble(total)


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def window_prints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of ``size`` shingles that begin at ``starts`` (ascending)."""
    low = int(starts[0])
    sums = np.zeros((int(starts[-1]) + size - low + 1, 64), np.int32)
    np.cumsum(_signs(shingles[low : int(starts[-1]) + size]), axis=0, out=sums[1:])
    at = starts - low
    return np.packbits(sums[at + size] > sums[at], axis=1, bitorder="little").view("<u8").ravel()


class ShingleSet:
    """Which hashes are in a set: a bitmap of their low bits passes a few, a sorted array decides."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.uint64((1 << max(16, min(26, int(len(self.sorted)).bit_length() + 5))) - 1)
        self.low = np.zeros(int(self.mask) + 1, bool)
        self.low[self.sorted & self.mask] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.low[hashes & self.mask])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == hashes[maybe]]


class Items:
    """The benchmark items of one broadcast, by length, with their multi-index."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        words = Words()
        self.classes: dict[tuple[int, int], list[int]] = {}
        self.ids, self.bags, self.prints = [], [], []
        shingle_sets: dict[int, list[np.ndarray]] = {}
        for item_id, text in rows:
            tokens = (text or "").encode().lower().split()
            if not tokens:
                continue
            width = min(SHINGLE_WORDS, len(tokens))
            hashes = shingle_hashes(words.hashes(tokens), width)
            self.classes.setdefault((width, len(hashes)), []).append(len(self.ids))
            self.ids.append(item_id)
            self.bags.append(bag(tokens, 0, len(hashes), width))
            self.prints.append(window_prints(hashes, np.zeros(1, np.int64), len(hashes))[0])
            shingle_sets.setdefault(width, []).append(hashes)
        self.shingles = {w: ShingleSet(np.concatenate(s)) for w, s in shingle_sets.items()}
        self.index = {key: self._tables(members) for key, members in self.classes.items()}

    def _tables(self, members: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The members' fingerprints, and for each (block, value) the range of its list in one array."""
        prints = np.array([self.prints[m] for m in members], dtype="<u8")
        own = prints.view(np.uint8).reshape(-1, BLOCKS)
        lists: list[list[int]] = [[] for _ in range(BLOCKS * 256)]
        for b in range(BLOCKS):
            for i, value in enumerate(own[:, b]):
                for near in _NEAR[value]:
                    lists[b * 256 + near].append(i)
        ends = np.cumsum([0, *map(len, lists)])
        return prints, ends, np.array([i for x in lists for i in x], np.int64)

    def candidates(self, key: tuple[int, int], prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, windows): the windows whose fingerprints lie within the radius of the item's."""
        own, ends, lists = self.index[key]
        slot = (prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS) + np.arange(BLOCKS) * 256).ravel()
        sizes = ends[slot + 1] - ends[slot]
        window = np.repeat(np.arange(len(slot)) // BLOCKS, sizes)
        if not len(window):
            return
        at = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[slot], sizes)
        item = lists[at]
        near = np.bitwise_count(own[item] ^ prints[window]) <= RADIUS
        if not near.any():
            return
        pair = np.unique(item[near] * len(prints) + window[near])
        item, window = pair // len(prints), pair % len(prints)
        for i in np.unique(item):
            yield self.classes[key][i], window[item == i]


def bag(words: list[bytes], start: int, size: int, width: int) -> Counter:
    return Counter(tuple(words[i : i + width]) for i in range(start, start + size))


def _alike(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted Jaccard similarity of two bags as a fraction."""
    both = sum((a & b).values())
    return both, a.total() + b.total() - both


def _best(items: Items, item: int, words: list[bytes], starts: np.ndarray, size: int, width: int) -> tuple[int, int, int] | None:
    """The most similar of the windows at ``starts`` (the first, if several) that reaches the bound: (both, all, start)."""
    goal, best = items.bags[item], None
    for s in starts:
        both, either = _alike(goal, bag(words, int(s), size, width))
        if both * SIMILARITY[1] >= either * SIMILARITY[0] and (best is None or both * best[1] > best[0] * either):
            best = (both, either, int(s))
    return best


def matches(items: Items, words: list[bytes], known: Words) -> Iterator[tuple[int, float, int, int]]:
    """(item_id, similarity, start, length) of each item's best window in a text; positions count words."""
    hashes = known.hashes(words)
    shingles = {w: shingle_hashes(hashes, w) for w in items.shingles}
    marked = {w: items.shingles[w].positions(s) for w, s in shingles.items()}
    marks = {w: np.zeros(len(s) + 1, np.int64) for w, s in shingles.items()}
    for w, sums in marks.items():
        sums[marked[w] + 1] = 1
        np.cumsum(sums, out=sums)
    for width, size in items.classes:
        at, n = marked[width], len(shingles[width])
        if not len(at) or n == 0:
            continue
        window = min(size, n)  # a text shorter than the item is one window
        sums = marks[width]
        starts = np.flatnonzero(sums[window:] > sums[: n - window + 1])  # windows that hold a marked shingle
        best: dict[int, tuple[int, int, int]] = {}
        # Portions are cut at gaps too, so that the sums between far marks are not computed.
        cuts = np.flatnonzero(np.diff(starts) > 4 * window) + 1
        for run in np.split(starts, cuts):
            for k in range(0, len(run), PORTION):
                part = run[k : k + PORTION]
                for item, found in items.candidates((width, size), window_prints(shingles[width], part, window)):
                    hopeful = part[found]
                    # A window shares no more shingles than it has marked ones.
                    hopeful = hopeful[(sums[hopeful + window] - sums[hopeful]) * SIMILARITY[1] >= size * SIMILARITY[0]]
                    got = _best(items, item, words, hopeful, window, width)
                    if got and (item not in best or got[0] * best[item][1] > best[item][0] * got[1]):
                        best[item] = got
        for item, (both, either, start) in best.items():
            yield items.ids[item], both / either, start, window + width - 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each row's best window for each item it holds.

    Null or wordless texts and items match nothing. Items of fewer than five words have one shingle,
    the whole item. Items with equal texts each match; repeated rows of ``docs`` are each reported;
    null ids are reported as null. Other columns are not looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // max(1, broadcast_bytes // 2)))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=str))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = Items(shared.value), Words()
            for batch in batches:
                rows = []
                for doc_id, body in zip(batch.column(0), batch.column(1)):
                    words = (body.as_py() or b"").lower().split()
                    if words and index.ids:
                        rows += [(doc_id.as_py(), *m) for m in matches(index, words, known)]
                if rows:
                    columns = list(zip(*rows))
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
        hits = bodies.mapInArrow(search, "doc_id long, item_id long, similarity double, start_word long, n_words long")
        found = hits if found is None else found.unionByName(hits)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows with a null id are judged by their text too."""
    row_print = F.xxhash64(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.struct("*").alias("row"), row_print.alias("_print"))
    hits = find_contamination(docs.select(row_print.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    # As a table its size is known when the join is planned: if it is small, the documents do not move.
    hits = write_table(hits, "contaminated")
    return keyed.join(hits, F.col("_print") == F.col("_hit"), "left_anti").select("row.*")
