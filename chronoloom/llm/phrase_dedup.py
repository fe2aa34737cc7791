"""Removal of passages that occur elsewhere, with automata of the repeated phrases.

A window is ``WINDOW`` consecutive words of one text. Every word goes that is covered by a window
whose words also stand anywhere else, in another document or at another place of the same one.

Method.

1. Candidates. Of the ``ANCHOR``-word runs of a window the one with the least hash, the leftmost of
   equals, is the window's anchor. Equal windows have equal anchors, at places of their own, so a
   window can recur only if its anchor's hash does. Neighbouring windows share anchors: about one
   anchor in twelve words is counted. Equal texts are one text with a multiplicity.
2. Passages. A span is a text's run of windows with one anchor, together at most 58 words. The spans
   of recurring anchors are cut out, equal ones once with the number of times they occur. A span is a
   confirmed passage if it occurs twice or more and no other span has its anchor. Where several do,
   their windows are counted by a 128-bit digest of the words, and two or more occurrences confirm one.
3. Automata. The phrase of a passage is its anchor's words, which all its windows share. Phrases and
   confirmed windows are sharded by anchor; a task compiles a shard's phrases into an Aho-Corasick
   automaton and streams the spans of all documents through it. Around each hit the windows that
   hold the phrase are looked up among the confirmed ones, which gives the words to remove.

A shard with many spans is salted: its phrases are compiled in several tasks. Anchors, spans and
windows are counted with partial sums. What joins on them is a skewed join that adaptive execution
splits, before which a filter of bounded size drops most of what can't match. Texts with a recurring
anchor, and few others, move twice.

A null text has no words. Texts of fewer than ``WINDOW`` words lose nothing. Rows with null, equal or
repeated ids are documents of their own, so a repeated row repeats its passages. Copies lose all.
An empty table gives an empty result; other columns are not read. A text is held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import maybe_among, thinned, write_table

#: Words in a window, and in the run of words that stands for it.
WINDOW, ANCHOR = 35, 12
#: Bytes of texts whose words are hashed together, and windows whose anchors are chosen together.
PORTION_BYTES, PORTION_WINDOWS = 1 << 20, 1 << 22
#: Bytes of distinct spans that a task holds before it hands them on.
SPAN_BYTES = 1 << 25
#: A span as one number: its first word above so many bits of its length, and these above so many bits of the place of its anchor.
LENGTH_BITS, PLACE_BITS = 8, 8
#: Anchors in a shard.
SHARD_ANCHORS = 1 << 15

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A window is chosen by the upper bits of the hashes, and by the place where these are equal.
_PLACE = np.uint64((1 << 24) - 1)
_POWERS = np.multiply.accumulate(np.full(1 << 16, _MIX, np.uint64))


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(line: bytes) -> np.ndarray:
    """A hash of each word of a line of words with one space between them."""
    if not line:
        return np.zeros(0, np.uint64)
    letters = np.frombuffer(line, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(letters == 32) + 1])
    place = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    values = np.where(letters == 32, np.uint64(0), (letters.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFFF])
    return _scramble(np.add.reduceat(values, starts))


def spans_of(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, anchor, place) of the runs of windows with one anchor, from the hashed words of texts that end at ``ends``.

    ``first`` counts words from the first text on; ``length`` is a number of windows; ``place`` is
    that of the anchor's words after ``first``.
    """
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = np.zeros(len(words) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        runs = runs * _MIX + words[k : k + len(runs)]
    runs = _scramble(runs)
    least, width, wanted = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64), 1, WINDOW - ANCHOR + 1
    while width < wanted:
        step = min(width, wanted - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = (least & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = text[: len(at)] == text[WINDOW - 1 :]
    begins = inside.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (text[1 : len(at)] != text[: len(at) - 1])
    first = np.flatnonzero(begins)
    length = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
    return first, length, runs[at[first]], at[first] - first


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Some rows of neighbouring texts: (other columns, line of words, number of words)."""
    rows, size = [], 0
    for batch in batches:
        names = batch.schema.names
        for *other, text in zip(*[batch.column(i) for i in range(len(names) - 1)], batch.column(len(names) - 1)):
            words = (text.as_py() or b"").split()
            line = b" ".join(words)
            rows.append(([x.as_py() for x in other], line, len(words)))
            size += len(line)
            if size >= PORTION_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _portions(batches):
        hashed = word_hashes(b" ".join(line for _, line, n in rows if n))
        ends = np.cumsum([n for _, _, n in rows])
        if len(hashed) <= PORTION_WINDOWS:
            parts = [(0, spans_of(hashed, ends))]
        else:  # a portion with a very long text: pieces that share all but one word of a window
            parts = []
            for low in range(0, len(hashed), PORTION_WINDOWS):
                piece = hashed[low : low + PORTION_WINDOWS + WINDOW - 1]
                parts.append((low, spans_of(piece, np.clip(ends - low, 0, len(piece)))))
        first = np.concatenate([low + p[0] for low, p in parts])
        length, anchor, place = (np.concatenate([p[k] for _, p in parts]) for k in (1, 2, 3))
        text = np.searchsorted(ends, first, side="right")
        cuts = pa.array(np.searchsorted(text, np.arange(len(rows) + 1)).astype(np.int32))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        lists = (anchor.view(np.int64), ((first - starts[text]) << LENGTH_BITS | length) << PLACE_BITS | place)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0][0] for r in rows], pa.int64()),
                pa.array([r[0][1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                *[pa.ListArray.from_arrays(cuts, pa.array(x)) for x in lists],
            ],
            names=["doc_id", "key", "n_words", "whole_sha256", "anchors", "shapes"],
        )


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, list[bytes], list[dict]]]:
    """Key, number of copies, words and spans (first word, last word + 1, anchor, place of the anchor's words) of each text."""
    for batch in batches:
        for key, n, text, spans in zip(*batch.columns):
            cut = []
            for s in spans.as_py():
                first, length = s["shape"] >> LENGTH_BITS + PLACE_BITS, s["shape"] >> PLACE_BITS & (1 << LENGTH_BITS) - 1
                cut.append((first, first + length + WINDOW - 1, s["anchor"], s["shape"] & (1 << PLACE_BITS) - 1))
            yield key.as_py(), n.as_py(), (text.as_py() or b"").split(), cut


def _distinct_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size = 0

    def handed_on() -> pa.RecordBatch:
        rows = [(k, *v) for k, v in held.items()]
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["span", "anchor", "anchor_at", "words", "n"])

    for _, n, words, spans in _cut_spans(batches):
        for first, end, anchor, place in spans:
            line = b" ".join(words[first:end])
            found = held.setdefault(xxhash.xxh3_128_digest(line), [anchor, place, line, 0])
            found[3] += n
            if found[3] == n:
                size += len(line) + 200
        if size > SPAN_BYTES:
            yield handed_on()
            held, size = {}, 0
    if held:
        yield handed_on()


def _placed_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, _, words, spans in _cut_spans(batches):
        digests = [xxhash.xxh3_128_digest(b" ".join(words[s[0] : s[1]])) for s in spans]
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(spans), pa.binary()), pa.array([s[0] for s in spans], pa.int32()), pa.array(digests, pa.binary())], names=["key", "first", "span"])


def _windows(words: list[bytes]) -> list[bytes]:
    """A digest of each window of a span."""
    return [xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])) for i in range(len(words) - WINDOW + 1)]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """Digests as two columns of longs, which are counted without sorting."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, k]) for k in (0, 1)]


def _digest(high: int, low: int) -> bytes:
    return high.to_bytes(8, "little", signed=True) + low.to_bytes(8, "little", signed=True)


def _counted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows, anchors, n = [], [], []
        for anchor, line, times in zip(*[c.to_pylist() for c in batch.columns]):
            found = _windows(line.split(b" "))
            windows += found
            anchors += [anchor] * len(found)
            n += [times] * len(found)
        yield pa.RecordBatch.from_arrays([*_halves(windows), pa.array(anchors, pa.int64()), pa.array(n, pa.int64())], names=["high", "low", "anchor", "n"])


class PhraseAutomaton:
    """Phrases of passages in an Aho-Corasick automaton, and the confirmed windows."""

    def __init__(self):
        import ahocorasick

        self.automaton, self.confirmed, self.ready = ahocorasick.Automaton(), set(), False

    def add(self, phrase: str | None, window: bytes | None) -> None:
        """A phrase, or the digest of a confirmed window, which holds a phrase that is added too."""
        if phrase is not None:
            self.automaton.add_word(f" {phrase} ", phrase.count(" ") + 1)
        if window is not None:
            self.confirmed.add(window)

    def covered(self, line: bytes, whole: bool) -> list[tuple[int, int]]:
        """The word ranges (start, end) of a span that confirmed windows cover; all its windows are, if it is ``whole``ly confirmed."""
        if not len(self.automaton):
            return []
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        words, text, seen = line.split(b" "), f" {line.decode()} ", {}
        counted, at = 0, 0
        for end, n in self.automaton.iter(text):
            counted, at = counted + text.count(" ", at, end), end  # spaces before the phrase's last one: the words up to its end
            for start in range(max(0, counted - WINDOW), min(counted - n, len(words) - WINDOW) + 1):
                if start not in seen:
                    seen[start] = whole or xxhash.xxh3_128_digest(b" ".join(words[start : start + WINDOW])) in self.confirmed
        found: list[tuple[int, int]] = []
        for start in sorted(s for s, hit in seen.items() if hit):
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], start + WINDOW)
            else:
                found.append((start, start + WINDOW))
        return found


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and salt, a shard's phrases and confirmed windows before the spans that are streamed through its automaton."""
    of, automaton = None, None
    for batch in batches:
        spans, starts, ends = [], [], []
        for shard, salt, phrase, high, low, digest, line, whole in zip(*[c.to_pylist() for c in batch.columns]):
            if of != (shard, salt):
                of, automaton = (shard, salt), PhraseAutomaton()
            if digest is None:
                automaton.add(phrase, None if high is None else _digest(high, low))
                continue
            found = automaton.covered(line, whole)
            if found:
                spans.append(digest)
                starts.append([f[0] for f in found])
                ends.append([f[1] for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["span", "starts", "ends"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, covers in zip(*batch.columns):
            words = (text.as_py() or b"").split()
            kept, at = [], 0
            for cover in covers.as_py():  # ascending by first
                for start, end in zip(cover["starts"], cover["ends"]):
                    start, end = start + cover["first"], end + cover["first"]
                    kept += words[at:start] if start > at else []
                    at = max(at, end)
            kept += words[at:]
            rows.append((key.as_py(), len(words) - len(kept), b" ".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "n_removed", "kept"])


#: What a shard's rows hold: a phrase, or the two halves of a confirmed window's digest, or a span.
_STREAMED = {"phrase": "string", "high": "bigint", "low": "bigint", "span": "binary", "words": "binary", "whole": "boolean"}


def _candidates(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """key, n, text, spans: the distinct texts with a recurring anchor, and the spans of such anchors."""
    one = filed.select("key", F.explode(F.arrays_zip("anchors", "shapes")).alias("s")).select("key", F.col("s.anchors").alias("anchor"), F.col("s.shapes").alias("shape"))
    recurring = write_table(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "phrase-recurring")
    near = thinned(one, F.col("anchor"), recurring, F.col("anchor")).join(recurring, "anchor", "left_semi")
    # Copies give the same spans; a task sends each text's on once.
    spans = near.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("shape", "anchor"))).alias("spans"))
    copies = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = write_table(spans.join(copies, "key"), "phrase-wanted")
    bodies = thinned(texts.select("key", "text"), F.col("key"), wanted, F.col("key")).groupBy("key").agg(F.first("text").alias("text"))
    return bodies.join(wanted, "key").select("key", "n", "text", "spans")


def _covers(candidates: DataFrame) -> DataFrame:
    """span, starts, ends: the distinct spans that hold words to remove, and which."""
    spark = candidates.sparkSession
    cut = candidates.mapInArrow(_distinct_spans, "span binary, anchor long, anchor_at int, words binary, n long")
    spans = write_table(cut.groupBy("span").agg(F.first("anchor").alias("anchor"), F.first("anchor_at").alias("anchor_at"), F.first("words").alias("words"), F.sum("n").alias("n")), "phrase-spans")
    phrase = F.array_join(F.slice(F.split(F.col("words").cast("string"), " "), F.col("anchor_at") + 1, ANCHOR), " ")
    anchors = write_table(spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans"), F.min(phrase).alias("phrase"), F.max(phrase).alias("other")), "phrase-anchors")
    # Two phrases of one hash make an anchor count as one of several spans, and both are phrases.
    several = anchors.where("spans > 1")
    flagged = maybe_among(spans, F.col("anchor"), several.select("anchor"), F.col("anchor"), "several")
    windows = flagged.where("several").select("anchor", "words", "n").mapInArrow(_counted_windows, "high long, low long, anchor long, n long")
    confirmed = windows.groupBy("high", "low", "anchor").agg(F.sum("n").alias("n")).where("n > 1")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_spans, n_shards = spans.count(), max(4 * tasks, -(-anchors.count() // SHARD_ANCHORS))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard")
    # As many salts as a shard has times the spans of half an average task; a row a shard, whatever the corpus.
    share = max(1, n_spans // (2 * tasks))
    salts = write_table(anchors.groupBy(shard).agg(F.ceil(F.sum("spans") / F.lit(share)).cast("int").alias("salts")), "phrase-salts")
    each_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    none = lambda kind: F.lit(None).cast(kind)
    rows = lambda df, **own: df.select("shard", *[own.get(c, none(kind)).alias(c) for c, kind in _STREAMED.items()])
    phrases = rows(anchors.select(shard, F.explode(F.array_distinct(F.array("phrase", "other"))).alias("_p")), phrase=F.col("_p"))
    known = rows(confirmed.select(shard, "high", "low"), high=F.col("high"), low=F.col("low"))
    streamed = rows(flagged.select(shard, "span", "words", (~F.col("several") & (F.col("n") > 1)).alias("_whole")), span=F.col("span"), words=F.col("words"), whole=F.col("_whole"))
    told = phrases.unionByName(known).join(salts, "shard").withColumn("salt", each_salt).drop("salts")
    asked = streamed.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("span"), F.col("salts")).cast("int")).drop("salts")
    dealt = told.unionByName(asked).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("span").isNotNull()).select("shard", "salt", *_STREAMED)
    return dealt.mapInArrow(_located, "span binary, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, or null if all do), kept_sha256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.cast("binary").alias("text"))
    filed = write_table(texts.mapInArrow(_anchors, "doc_id long, key binary, n_words long, whole_sha256 string, anchors array<long>, shapes array<long>"), "phrase-filed")
    candidates = write_table(_candidates(texts, filed), "phrase-candidates")
    covers = write_table(_covers(candidates), "phrase-covers")
    placed = candidates.select("key", "n", "text", "spans").mapInArrow(_placed_spans, "key binary, first int, span binary")
    of_text = placed.join(covers, "span").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "starts", "ends"))).alias("covers"))
    kept = candidates.select("key", "text").join(of_text, "key").mapInArrow(_kept, "key binary, n_removed long, kept binary")
    rows = filed.select("doc_id", "key", "n_words", "whole_sha256").join(kept, "key", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.col("kept").cast("string").alias("kept"), F.when(F.col("kept").isNull(), F.col("whole_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL for the result of the registered query."""
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM t WHERE len(ws) >= {WINDOW}),
w AS (SELECT r, i, md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS h FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w),
g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM c WHERE n > 1),
o AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM t),
s AS (SELECT o.r, string_agg(word, ' ' ORDER BY o.k) AS kept FROM o ANTI JOIN g ON o.r = g.r AND o.k = g.k GROUP BY o.r),
d AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(d.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN s ON t.r = s.r LEFT JOIN d ON t.r = d.r"""
