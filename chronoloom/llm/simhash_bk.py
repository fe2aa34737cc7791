"""SimHash near-duplicates, found with BK-trees.

Method. Every text gets a 64-bit fingerprint of its three-word shingles. Two different fingerprints
link if at most ``RADIUS`` bits differ. Of the ``BLOCKS`` blocks of such a pair all but ``RADIUS`` at
least are equal, so each distinct fingerprint is sent to the shard of each choice of so many of its
blocks (20 choices of 3 of 6, each of 32 bits or so: unlike single blocks of 16 bits they stay rare
in a corpus of billions); a shard holds one BK-tree per value of a choice. In a BK-tree the children of a node are keyed by their integer Hamming
distance to it, so a search of radius r that stands at distance d from a node follows only edges
d-r..d+r. Trees are built and searched level by level in numpy, many searches at once.

The shard trees reach the tasks by the shuffle rather than by a driver broadcast: trees of all
documents grow with the corpus, and neither they nor the fingerprints may pass through the driver.
A tree hands on only links that join what it had not joined before (a star per local component), so
a large group of near copies yields as many links as it has fingerprints, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import write_table
from chronoloom.llm.components import connected_components

#: Bits in which two linked fingerprints may differ.
RADIUS = 3
#: Blocks of a fingerprint, of which all but RADIUS must agree.
BLOCKS = 6
#: Words in a shingle.
SHINGLE_WORDS = 3
#: Seed of the shingle hash.
SEED = 42
#: Pairs of (search, node) looked at together; bounds the memory of a task.
FRONTIER = 1 << 20


def fingerprint(body: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text as an unsigned 64-bit integer; zero if it has no word."""
    words = body.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which input each element comes from, and the elements of all ranges [start, stop)."""
    sizes = stops - starts
    source = np.repeat(np.arange(len(starts)), sizes)
    offsets = np.arange(len(source)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return source, starts[source] + offsets


class BKForest:
    """BK-trees, one per group of fingerprints; all are built and searched together."""

    def __init__(self, groups: np.ndarray, prints: np.ndarray):
        """``groups`` ascending; the prints of one group differ from each other."""
        n = len(prints)
        self.prints = prints
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        parent = self.root[waiting]
        edges, children = [], []
        while len(waiting):
            edge = parent * 128 + np.bitwise_count(prints[waiting] ^ prints[parent]).astype(np.int64)
            known, at, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(known)
            children.append(waiting[at])  # the first to come by an edge becomes the child there
            stay = np.ones(len(waiting), bool)
            stay[at] = False
            parent = waiting[at][which][stay]
            waiting = waiting[stay]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges, self.children = self.edges[order], self.children[order]

    def within(self, radius: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (search, found) of prints of one group at most ``radius`` bits apart, in portions."""
        n = len(self.prints)
        todo = [(np.arange(at, min(at + 65536, n)), None) for at in range(0, n, 65536)]
        todo = [(q, self.root[q]) for q, _ in todo]
        while todo:
            searches, nodes = todo.pop()
            if len(searches) > frontier:
                half = len(searches) // 2
                todo += [(searches[:half], nodes[:half]), (searches[half:], nodes[half:])]
                continue
            apart = np.bitwise_count(self.prints[searches] ^ self.prints[nodes]).astype(np.int64)
            found = (apart <= radius) & (searches != nodes)
            if found.any():
                yield searches[found], nodes[found]
            low = np.searchsorted(self.edges, nodes * 128 + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.edges, nodes * 128 + apart + radius, side="right")
            on = high > low
            if on.any():
                # A portion's children may be many times its size: take them in slices.
                searches, low, high = searches[on], low[on], high[on]
                cuts = np.concatenate([[0], np.searchsorted(np.cumsum(high - low), np.arange(frontier, int((high - low).sum()), frontier)), [len(low)]])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b > a:
                        source, at = _ranges(low[a:b], high[a:b])
                        todo.append((searches[a:b][source], self.children[at]))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; labels[x] leads to the least member of the set of x."""
    while len(a):
        a, b = labels[a], labels[b]
        while True:
            la, lb = labels[a], labels[b]
            if (la == a).all() and (lb == b).all():
                break
            a, b = la, lb
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))


def _settled(labels: np.ndarray) -> np.ndarray:
    while True:
        up = labels[labels]
        if (up == labels).all():
            return labels
        labels = up


def tree_links(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (print, least print of its component within its group) of linked prints."""
    order = np.lexsort((prints, groups))
    groups, prints = groups[order], prints[order]
    labels = np.arange(len(prints))
    for a, b in BKForest(groups, prints).within(radius):
        join_labels(labels, a, b)
    labels = _settled(labels)
    linked = labels != np.arange(len(prints))
    return prints[linked], prints[labels[linked]]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    a, b = tree_links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.uint64))
    for at in range(0, len(a), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 65536].view(np.int64)), pa.array(b[at : at + 65536].view(np.int64))], names=["a", "b"])


def block_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> list[Column]:
    """A long for each choice of ``blocks - radius`` blocks; two prints within the radius share one at least."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for i in chosen:
            size = cuts[i + 1] - cuts[i]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, cuts[i]).bitwiseAND((1 << size) - 1))
        keys.append(key)
    return keys


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between the distinct ``fp`` of ``prints`` that join all within the radius."""
    shards = prints.select(F.explode(F.array(*block_keys(F.col("fp")))).alias("block"), "fp").repartition("block")
    return shards.mapInArrow(_shard_links, "a long, b long")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id among all rows whose fingerprints can be reached by links,
    itself included. Null and wordless texts have fingerprint zero, linked like any other. Rows
    with a null doc_id take part and are returned, but are never the least; the id is null if a
    component has no other. Repeated rows come back as often as they came in. Other columns are
    not looked at. An empty table gives an empty result.
    """
    own = write_table(fingerprints(docs), "fingerprints")
    prints = write_table(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    members = connected_components(fingerprint_links(prints), "a", "b")
    linked = prints.join(members, F.col("fp") == F.col("node"))
    least = linked.groupBy("label").agg(F.min("first_doc").alias("least_doc"))
    named = linked.select(F.col("fp").alias("linked_fp"), "label").join(least, "label").select("linked_fp", "least_doc")
    per_print = prints.join(named, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("print"), F.when(F.col("linked_fp").isNull(), F.col("first_doc")).otherwise(F.col("least_doc")).alias("component_id")
    )
    # A table of its own makes both sides of the join plain exchanges, so many copies of one text can be split.
    per_print = write_table(per_print, "print-components")
    return own.join(per_print, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component its least doc_id stays.

    Of rows with that same doc_id one stays, the least. Rows with a null doc_id stay, as no id names them.
    """
    from pyspark.sql.window import Window

    # The row itself is one column, so no name of its own can clash with those beside it.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = near_duplicate_components(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    named = rows.where(F.col("id").isNotNull()).join(kept, F.col("id") == F.col("_kept"), "left_semi")
    # Fixes which of several rows of one id stays: the least by its columns in order.
    rank = Window.partitionBy("id").orderBy("row")
    first = named.withColumn("rank", F.row_number().over(rank)).where("rank = 1")
    return first.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
