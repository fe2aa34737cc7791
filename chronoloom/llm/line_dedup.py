"""Near-duplicate lines by a segment-partition edit join.

Two different lines link if few enough edits turn one into the other. Lines of fewer than
``WORD_LINE`` words are compared by characters, with as many edits as the rule allows for the shorter
one's length; where both have more words they are compared by words, with edits that grow with the
line: ``word_edits``, two up to 127 words and one more for each doubling. A rule without ``words``
compares all lines by characters. ``long_lines`` allows none below ``MIN_CHARS`` characters and two
from there on; ``all_lines`` allows one for each ``CHARS_AN_EDIT`` characters, two at most, so that no
two words of a few letters are alike. What follows holds for characters and for words alike.

Every line is cut into threshold + 1 segments. Of two lines within the threshold, one segment at
least of the shorter occurs unchanged in the longer, not far from its place. So each line files its
segments under (its length, the segment's number, the segment's text), and asks for the substrings
of its own that could be such a segment of a line of its length or up to threshold shorter; the
multi-match-aware selection of Li, Deng and Feng ("PASS-JOIN", 2011) keeps those few. Only hashes of
these keys move. Each row also carries the line's id (64 bits of hash) and a sketch (how often characters of 16 classes occur, modulo
4); an edit changes two classes by one at most, so pairs whose sketches are too far apart are passed
over where they meet, and a group of lines that share a segment sends on only the pairs that may
link. Candidates' texts are then fetched and verified by a banded bit-parallel edit distance.

Lines made from a template share segments by the thousand. A key that more than ``MANY`` lines hold
gives no pairs: its lines' texts are fetched, dealt in blocks, and every two blocks meet in a task of
their own, which compares all its lines at once and hands on each line's number of links and a star
for what hangs together, not the links. Of several such keys that two lines share, the least counts.

Two different lines may have one id. Such ids are found by counting (every line's id is a column
expression too) and the lines that share one are verified against each other like any other pair.

Lines without a word are no lines here: they are neither filed nor linked.

Equal lines count as one text throughout, so a line that a third of the documents hold files its
segments once per task, and what joins it to its copies is a join that can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD_PATTERN, write_table
from chronoloom.llm.components import connected_components
from chronoloom.llm.phrase_dedup import word_hashes

#: Edits that two linked lines may be apart, and the characters that both need for it by ``long_lines``.
THRESHOLD, MIN_CHARS = 2, 20
#: By ``all_lines``, a line may have one edit for so many characters.
CHARS_AN_EDIT = 8
#: Words from which on lines are compared by words.
WORD_LINE = 24
#: Lines that a task remembers to have filed; forgetting one only files it again.
MEMORY = 1 << 18
#: Bytes of lines whose words are hashed together.
PORTION_BYTES = 1 << 20
#: Lines that file one key from which they are told apart by blocks of their sketches too.
HOT = 512
#: Lines that hold one key from which on they are compared in blocks, and the lines of a block.
MANY, BLOCK = 64, 2048
#: Pairs compared together.
PORTION = 1 << 20
#: Bits of a line's id, and the seed of its hash (that of Spark's xxhash64).
ID_BITS, ID_SEED = 64, 42
#: What a line consists of that has no word.
BLANKS = " \t\n\x0b\x0c\r"
#: Words of 64 bits in the filter of candidate ids; bounds what the driver gathers and sends.
FILTER_WORDS = 1 << 20


def long_lines(length: int) -> int:
    return THRESHOLD if length >= MIN_CHARS else 0


def all_lines(length: int) -> int:
    return min(THRESHOLD, length // CHARS_AN_EDIT)


def word_edits(n_words: int) -> int:
    return max(2, (n_words // 64).bit_length() + 1)


class Rule(NamedTuple):
    """How many edits two lines may be apart, by the shorter one's characters or, if given, by the words of the one with fewer."""

    chars: Callable[[int], int]
    words: Callable[[int], int] | None = None

    def by_words(self, n_words: int) -> bool:
        return self.words is not None and n_words >= WORD_LINE

    def linked(self, x: str, y: str) -> bool:
        own = words_of_line(x), words_of_line(y)
        n = min(map(len, own))
        if self.by_words(n):
            limit = self.words(n)
            return edit_distance_within(*own, limit) <= limit
        limit = self.chars(min(len(x), len(y)))
        return edit_distance_within(x, y, limit) <= limit


#: Every line, short ones by characters and long ones by words.
GROWING = Rule(all_lines, word_edits)


def rule_of(edits: Rule | Callable[[int], int]) -> Rule:
    return edits if isinstance(edits, Rule) else Rule(edits)


def words_of_line(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def _letters_of(words: list[bytes]) -> str:
    """Words as a text of one character each: different words may share one, equal ones never differ."""
    codes = (word_hashes(b" ".join(words)) & np.uint64(0x7FFFF)).astype("<u4") + np.uint32(0x10000)
    return codes.tobytes().decode("utf-32-le")


def segments(length: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(start, length) of the threshold + 1 even segments of a line."""
    parts = threshold + 1
    short, longer = divmod(length, parts)
    sizes = [short] * (parts - longer) + [short + 1] * longer
    starts = [sum(sizes[:i]) for i in range(parts)]
    return list(zip(starts, sizes))


def probes(length: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of every substring that a line of ``length`` asks for."""
    asked = []
    for indexed in range(max(threshold + 1, length - threshold), length + 1):
        shift = length - indexed
        for i, (start, size) in enumerate(segments(indexed, threshold)):
            low = max(0, start - i, start + shift - (threshold - i))
            high = min(length - size, start + i, start + shift + (threshold - i))
            asked += [(indexed, i, at, size) for at in range(low, high + 1)]
    return asked


def sketches(lines: list[str]) -> np.ndarray:
    """Of each line, counts of the characters of 16 classes modulo 4, two bits each."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) & 15
    counts = np.bincount(np.repeat(np.arange(len(lines)) << 4, sizes) + points, minlength=len(lines) << 4).reshape(-1, 16) & 3
    return (counts << np.arange(0, 32, 2)).sum(axis=1).astype(np.uint32)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most the sum over the classes of how far the counts are apart."""
    odd = np.uint64(0x55555555)
    # Per class: a xor b tells 1 or 3 apart (low bit set: distance 1) from 2 (only the high bit: distance 2).
    low = (a ^ b) & odd
    high = ((a ^ b) >> np.uint64(1)) & odd
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def line_id(line: str, bits: int = ID_BITS) -> int:
    """A line's id: the low bits of XXH64 (seed 42), which ``line_id_column`` computes in Spark."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), ID_SEED) & ((1 << bits) - 1)


def line_id_column(line: Column, bits: int = ID_BITS) -> Column:
    """``line_id`` as a signed long."""
    return F.xxhash64(line) if bits == 64 else F.xxhash64(line).bitwiseAND((1 << bits) - 1)


def edit_distance_within(a: str, b: str, limit: int) -> int:
    """The edit distance of two lines if at most ``limit``, else limit + 1.

    Bit-parallel (Myers; Hyyro's banded form): column by column, bit t of a word of 2 * limit + 1
    bits stands for the row that lies t - limit from the diagonal. The value in the band's lowest
    row is followed down the diagonal, then along the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    n = len(b)
    front = 0
    while front < n and a[front] == b[front]:
        front += 1
    back = 0
    while back < n - front and a[len(a) - 1 - back] == b[n - 1 - back]:
        back += 1
    a, b = a[front : len(a) - back], b[front : n - back]
    m, n = len(a), len(b)
    if n == 0 or limit == 0:
        return min(m, limit + 1)
    if m <= limit:
        row = list(range(n + 1))
        for i, x in enumerate(a):
            above, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y)))
        return min(row[n], limit + 1)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * limit + 1
    full = (1 << width) - 1
    up, down, distance = full >> limit << limit, 0, limit
    lowest, last = 1 << (width - 1), 1 << (width - 2)
    for j in range(n):
        first = j - limit
        same = where.get(b[j], 0)
        same = (same >> first if first >= 0 else same << -first) & full
        zero = ((((same & up) + up) ^ up) | same | down) & full
        right_up = (down | ~(zero | up)) & full
        right_down = zero & up
        if j < m - limit:
            distance += not zero & lowest
        else:
            distance += bool(right_up & last) - bool(right_down & last)
            last >>= 1
        if distance > 3 * limit + 1:
            return limit + 1
        up = (right_down | ~((zero >> 1) | right_up)) & full
        down = (zero >> 1) & right_up
    return min(distance, limit + 1)


def _lines(text: str | None, edits: Callable[[int], int]) -> Iterator[str]:
    """The lines with a word that may have an edit at all."""
    return (line for line in (text or "").split("\n") if edits(len(line)) and line.strip(BLANKS))


def _asked(length: int, edits: Callable[[int], int]) -> list[tuple[int, int, int, int]]:
    """``probes`` where lines of different lengths are cut for different numbers of edits."""
    found: list[tuple[int, int, int, int]] = []
    for threshold in {edits(n) for n in range(length - edits(length), length + 1)} - {0}:
        found += [p for p in probes(length, threshold) if edits(p[0]) == threshold]
    return found


def _forms(lines: list[str], bodies: list[bytes], rule: Rule) -> Iterator[tuple[int, str, int, Callable[[int], int]]]:
    """What of the lines is filed: (place, sequence, 1 for words, edits). Lines of few more words than WORD_LINE may be near to shorter ones by characters."""
    if rule.words is None:
        yield from ((k, line, 0, rule.chars) for k, line in enumerate(lines))
        return
    words = [body.split() for body in bodies]
    sizes = list(map(len, words))
    long = [k for k, n in enumerate(sizes) if rule.by_words(n)]
    letters, at = _letters_of([w for k in long for w in words[k]]), 0
    for k in long:
        yield k, letters[at : at + sizes[k]], 1, rule.words
        at += sizes[k]
    for k, n in enumerate(sizes):
        if not rule.by_words(n) or n < WORD_LINE + THRESHOLD:
            yield k, lines[k], 0, rule.chars


def _new_lines(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[list[str], list[bytes]]]:
    """Lines that this task has not met lately, some at a time, and their bytes."""
    known, lines, bodies, size = set(), [], [], 0
    for batch in batches:
        for text in batch.column(0):
            for line in _lines(text.as_py(), rule.chars):
                body = line.encode("utf-8", "surrogatepass")
                own = xxhash.xxh3_128_digest(body)
                if own in known:
                    continue
                if len(known) >= MEMORY:
                    known.clear()
                known.add(own)
                lines.append(line)
                bodies.append(body)
                size += len(body)
            if size > PORTION_BYTES:
                yield lines, bodies
                lines, bodies, size = [], [], 0
    if lines:
        yield lines, bodies


def _filed(batches: Iterator[pa.RecordBatch], edits: Rule | Callable[[int], int] = long_lines, bits: int = ID_BITS) -> Iterator[pa.RecordBatch]:
    """(key, id, sketch): the key's lowest bit tells who files (0) from who asks (1), the next one words (1) from characters (0), the next five the edits."""
    digest, rule, asked = xxhash.xxh3_64_intdigest, rule_of(edits), {}
    for lines, bodies in _new_lines(batches, rule):
        keys, owners, forms, rows, tails = [], [], [], [], []
        for place, form, mode, allowed in _forms(lines, bodies, rule):
            n = len(form)
            if (n, mode) not in asked:
                if len(asked) > 4096:
                    asked.clear()
                index = [(at, at + size, (n << 8 | i) << 1 | mode) for i, (at, size) in enumerate(segments(n, allowed(n)))]
                probe = [(length, at, at + size, (length << 8 | i) << 1 | mode) for length, i, at, size in _asked(n, allowed)]
                tail = [min(31, allowed(n)) << 2 | mode << 1] * len(index) + [min(31, allowed(length)) << 2 | mode << 1 | 1 for length, *_ in probe]
                asked[n, mode] = index + [p[1:] for p in probe], tail
            places, tail = asked[n, mode]
            body = bodies[place]
            if mode == 0 and len(body) == n:  # one byte a character
                keys += [digest(body[s:e], k) for s, e, k in places]
            elif mode:  # four bytes a word
                wide = form.encode("utf-32-le")
                keys += [digest(wide[4 * s : 4 * e], k) for s, e, k in places]
            else:
                keys += [digest(form[s:e].encode("utf-8", "surrogatepass"), k) for s, e, k in places]
            owners.append(place)
            forms.append(form)
            rows.append(len(places))
            tails += tail
        own = np.array([xxhash.xxh64_intdigest(b, ID_SEED) for b in bodies], np.uint64) & np.uint64((1 << bits) - 1)
        columns = [
            ((np.array(keys, np.uint64) & ~np.uint64(127)) | np.array(tails, np.uint64)).view(np.int64),
            np.repeat(own[np.array(owners, np.int64)].view(np.int64), rows),
            np.repeat(sketches(forms).view(np.int32), rows),
        ]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "id", "sketch"])


def candidate_pairs(keys: np.ndarray, ids: np.ndarray, sketches: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a < b) of ids of which one files a key that the other asks for, by sketch not too far apart."""
    order = np.lexsort((sketches, ids, keys))
    keys, ids, sketches = keys[order], ids[order], sketches[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (sketches[1:] != sketches[:-1])
    keys, ids, sketches = keys[fresh], ids[fresh], sketches[fresh]
    asks = (keys & np.uint64(1)).astype(bool)
    filed, asked = (keys[~asks], ids[~asks], sketches[~asks]), (keys[asks] & ~np.uint64(1), ids[asks], sketches[asks])
    low, high = np.searchsorted(filed[0], asked[0]), np.searchsorted(filed[0], asked[0], side="right")
    hot = high - low > HOT
    found = _near_pairs([x[~hot] for x in asked], filed, threshold)
    if hot.any():
        shared = np.isin(filed[0], np.unique(asked[0][hot]))
        found += _near_pairs(_by_block([x[hot] for x in asked], threshold), _by_block([x[shared] for x in filed], threshold), threshold)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _by_block(rows: list[np.ndarray], threshold: int) -> list[np.ndarray]:
    """(key, id, sketch) rows once for each of 2 * threshold + 1 blocks of the sketch, the block mixed into the key; by key.

    Sketches at most 2 * threshold apart differ in no more classes, so one block at least is equal.
    """
    keys, ids, held = rows
    blocks = 2 * threshold + 1
    cuts = [2 * (16 * i // blocks) for i in range(blocks + 1)]
    parts = [(held >> np.uint32(a)).astype(np.uint64) & np.uint64((1 << (b - a)) - 1) | np.uint64(i << 32) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    mixed = np.concatenate([(keys ^ (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) for part in parts])
    order = np.argsort(mixed, kind="stable")
    return [mixed[order], np.tile(ids, blocks)[order], np.tile(held, blocks)[order]]


def _near_pairs(asked, filed, threshold: int) -> list[np.ndarray]:
    """Pairs of different ids that ask for and file one key, by sketch not too far apart; ``filed`` is in order of its keys."""
    low, high = np.searchsorted(filed[0], asked[0]), np.searchsorted(filed[0], asked[0], side="right")
    found: list[np.ndarray] = []
    on = np.flatnonzero(high > low)
    total, at = np.concatenate([[0], np.cumsum(high[on] - low[on])]), 0
    while at < len(on):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PORTION, side="right")) - 1)
        part = on[at:stop]
        sizes = high[part] - low[part]
        asking = np.repeat(part, sizes)
        filing = np.arange(len(asking)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[part], sizes)
        a, b = asked[1][asking], filed[1][filing]
        near = (a != b) & (sketch_distance(asked[2][asking], filed[2][filing]) <= 2 * threshold)
        if near.any():
            found.append(np.unique(np.column_stack([np.minimum(a, b)[near], np.maximum(a, b)[near]]), axis=0))
        at = stop
    return found


def _met(batches: Iterator[pa.RecordBatch], many: int = MANY) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of ids that meet; of keys with more than ``many`` ids the members instead: (key, id), marked as shared."""
    parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
    if not parts:
        return
    keys, ids, held = (np.concatenate([p[k] for p in parts]) for k in range(3))
    keys, ids, held = keys.view(np.uint64), ids.view(np.uint64), held.view(np.uint32)
    plain = keys & ~np.uint64(1)
    order = np.argsort(plain, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], plain[order][1:] != plain[order][:-1]]))
    sizes = np.diff(np.append(begins, len(order)))
    rest = np.ones(len(keys), bool)
    for k in np.flatnonzero(sizes > many).tolist():
        rows = order[begins[k] : begins[k] + sizes[k]]
        own = np.unique(ids[rows])
        if (keys[rows] & np.uint64(1)).all():
            rest[rows] = False  # all ask, nobody files: no two meet here
        elif len(own) > many:
            rest[rows] = False
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), plain[rows[0]]).view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.ones(len(own), bool))], names=["a", "b", "shared"])
    allowed = (keys >> np.uint64(2)) & np.uint64(31)
    for threshold in np.unique(allowed[rest]).tolist():
        own = rest & (allowed == np.uint64(threshold))
        a, b = candidate_pairs(keys[own], ids[own], held[own], threshold)
        for at in range(0, len(a), 65536):
            x, y = a[at : at + 65536].view(np.int64), b[at : at + 65536].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), bool))], names=["a", "b", "shared"])


def _same_band(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of two tables of sequences (padded, with their sizes) are within ``limit`` edits: the banded table, one column of all pairs at a time."""
    width, far = 2 * limit + 1, limit + 1
    n, longest = len(a), int(a_sizes.max(initial=0))
    offsets = np.arange(-limit, limit + 1)
    row = np.where(offsets >= 0, offsets, far).astype(np.int8)[:, None].repeat(n, axis=1)
    found = np.zeros(n, bool)

    def ended(i: int) -> None:
        at = np.flatnonzero(a_sizes == i)
        place = b_sizes[at] - i + limit
        inside = (place >= 0) & (place < width)
        found[at[inside]] = row[place[inside], at[inside]] <= limit

    ended(0)
    # Columns of b at every offset of the band; what lies outside equals nothing.
    other = np.full((b.shape[1] + longest + 2 * limit + 2, n), -2, b.dtype)
    other[limit : limit + b.shape[1]] = b.T
    for i in range(1, longest + 1):
        step = row + (other[i - 1 : i - 1 + width] != a[:, i - 1]).view(np.int8)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        for k, column in enumerate((i + offsets).tolist()):
            if column < 0:
                step[k] = far
            elif column == 0:
                step[k] = min(i, far)
            elif k:
                np.minimum(step[k], step[k - 1] + 1, out=step[k])
        row = np.minimum(step, far)
        ended(i)
    return found


class _Unit:
    """The lines of one or two blocks of a crowded key: which are linked, where this key is the least that both hold."""

    def __init__(self, key: int, lines: list[str], first: np.ndarray, second: np.ndarray, held: list[list[int]], rule: Rule):
        self.key, self.first, self.second, self.rule = key, first, second, rule
        self.mode = key >> 1 & 1
        words = [words_of_line(x) for x in lines] if rule.words else [[]] * len(lines)
        self.n_words = np.fromiter(map(len, words), np.int64, len(lines))
        forms = words if self.mode else lines
        self.sizes = np.fromiter(map(len, forms), np.int64, len(lines))
        self.sketch = sketches([_letters_of(w) for w in words] if self.mode else lines)
        low, high = min(forms), max(forms)
        shortest, front = int(self.sizes.min()), 0
        while front < min(len(low), len(high)) and low[front] == high[front]:
            front += 1
        back = 0
        while back < shortest - front and len({f[-1 - back] for f in forms}) == 1:
            back += 1
        codes: dict = {}
        cores = [[codes.setdefault(u, len(codes)) for u in f[front : len(f) - back]] for f in forms]
        self.core_sizes = self.sizes - front - back
        width = max(1, int(self.core_sizes.max()))
        self.cores = np.full((len(lines), width), -1, np.int16 if len(codes) < 1 << 15 else np.int32)
        for k, c in enumerate(cores):
            self.cores[k, : len(c)] = c
        # Eight units a word, where so few differ; replaced ones are then counted by bits.
        self.packed = None
        if len(codes) < 255:
            table = np.full((len(lines), -(-width // 8) * 8), 255, np.uint8)
            table[:, :width] = self.cores
            self.packed = np.ascontiguousarray(table).view(np.uint64).T.copy()
        sizes = np.unique(self.sizes)
        allowed = rule.words if self.mode else rule.chars
        self.allowed = np.zeros(int(sizes[-1]) + 1, np.int16)
        self.allowed[sizes] = [allowed(int(n)) for n in sizes]
        # Smaller crowded keys of this kind that a line holds.
        smaller = [[k for k in h if k < key and k >> 1 & 1 == self.mode] for h in held]
        self.smaller = np.full((len(lines), max(1, max(map(len, smaller)))), -1, np.int64)
        for k, h in enumerate(smaller):
            self.smaller[k, : len(h)] = h
            self.smaller[k, len(h) :] = -2 - 2 * k  # meets nothing

    def _replaced(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many places pairs of equal size differ."""
        if self.packed is None:
            stride = max(1, (PORTION << 2) // self.cores.shape[1])
            parts = [(self.cores[a[k : k + stride]] != self.cores[b[k : k + stride]]).sum(axis=1) for k in range(0, len(a), stride)]
            return np.concatenate([np.zeros(0, np.int64), *parts])
        total, low = np.zeros(len(a), np.int64), np.uint64(0x7F7F7F7F7F7F7F7F)
        for word in self.packed:
            x = word[a] ^ word[b]
            total += np.bitwise_count(((x & low) + low | x) & ~low)
        return total

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, counted) of linked lines by their places, some at a time; those that a smaller key counts are not counted."""
        left, right = np.flatnonzero(self.first), np.flatnonzero(self.second)
        stride = max(1, PORTION // max(1, len(right)))
        same, odd = bool((self.first & self.second).any()), np.uint32(0x55555555)
        for at in range(0, len(left), stride):
            rows = left[at : at + stride]
            apart = np.abs(self.sizes[rows, None] - self.sizes[right])
            limit = self.allowed[np.minimum(self.sizes[rows, None], self.sizes[right])]
            x = self.sketch[rows, None] ^ self.sketch[right]
            low, high = x & odd, x >> np.uint32(1) & odd
            near = np.bitwise_count(low) + np.uint8(2) * np.bitwise_count(high & ~low)
            keep = near + apart <= 2 * limit
            if same:
                keep &= rows[:, None] < right
            if self.rule.words and not self.mode:
                keep &= np.minimum(self.n_words[rows, None], self.n_words[right]) < WORD_LINE
            i, j = np.nonzero(keep)
            a, b, limit, apart, near = rows[i], right[j], limit[i, j], apart[i, j], near[i, j].astype(np.int16)
            keep = apart <= limit
            found = np.zeros(len(a), bool)
            even = np.flatnonzero(apart == 0)
            found[even] = self._replaced(a[even], b[even]) <= limit[even]
            # Equal sizes beyond that need an insertion and a deletion, which leave less room for replacements.
            left_over = np.flatnonzero(keep & ~found & (near <= 2 * limit - np.where(apart == 0, 2, apart)) & (limit > 0))
            for value in np.unique(limit[left_over]):
                own = left_over[limit[left_over] == value]
                step = max(1, min(1 << 15, (PORTION << 2) // self.cores.shape[1]))
                for k in range(0, len(own), step):
                    p = own[k : k + step]
                    found[p] = _same_band(self.cores[a[p]], self.cores[b[p]], self.core_sizes[a[p]], self.core_sizes[b[p]], int(value))
            a, b = a[found], b[found]
            counted = np.ones(len(a), bool)
            for i in range(self.smaller.shape[1]):
                for j in range(self.smaller.shape[1]):
                    counted &= self.smaller[a, i] != self.smaller[b, j]
            yield a, b, counted


def _compared(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(a, b, n) from rows that come by unit: each line's print with its number of links, and stars (a, b) of what hangs together."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        lines = [r[1] for r in rows]
        prints = [hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in lines]
        blocks = np.array([r[2] for r in rows])
        (key, low, high) = rows[0][0]
        counts, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for a, b, counted in _Unit(key, lines, blocks == low, blocks == high, [r[3] for r in rows], rule).links():
            counts += np.bincount(a[counted], minlength=len(rows)) + np.bincount(b[counted], minlength=len(rows))
            while True:  # the least place that links reach
                before = label.copy()
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                label = label[label]
                if (before == label).all():
                    break
        star, many = np.flatnonzero(label != np.arange(len(rows))), np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([prints[k] for k in star] + [prints[k] for k in many], pa.binary()),
                pa.array([prints[label[k]] for k in star] + [None] * len(many), pa.binary()),
                pa.array([0] * len(star) + counts[many].tolist(), pa.int64()),
            ],
            names=["a", "b", "n"],
        )

    rows: list[tuple] = []
    for batch in batches:
        for key, low, high, block, line, held in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and rows[0][0] != (key, low, high):
                yield told(rows)
                rows = []
            rows.append(((key, low, high), line, block, held))
    if rows:
        yield told(rows)


def _filter_slot(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(38)  # 26 bits: a word and a bit in it
    return mixed >> np.uint64(6), mixed & np.uint64(63)


def _wanted_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, bit = _filter_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])


def _texts_of(docs: DataFrame, ids: DataFrame, edits: Callable[[int], int], bits: int) -> DataFrame:
    """(id, line): the distinct lines whose id is in ``ids``.

    A filter of at most FILTER_WORDS words (8 MB, whatever the corpus) keeps most other lines from
    moving; a semi-join decides.
    """
    words = ids.mapInArrow(_wanted_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(FILTER_WORDS, np.uint64)
    for row in words.toLocalIterator():
        table[row.word] = row.bits % (1 << 64)
    used = np.flatnonzero(table)
    shared = docs.sparkSession.sparkContext.broadcast((used, table[used]))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_WORDS, np.uint64)
        table[shared.value[0]] = shared.value[1]
        for batch in batches:
            lines, own = [], []
            for text in batch.column(0):
                found = list(_lines(text.as_py(), edits))
                lines += found
                own += [line_id(line, bits) for line in found]
            if not own:
                continue
            own = np.array(own, np.uint64)
            word, bit = _filter_slot(own)
            keep = np.flatnonzero(table[word.astype(np.int64)] >> bit & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), pa.array([lines[k] for k in keep], pa.string())], names=["id", "line"])

    return docs.select("text").mapInArrow(wanted, "id long, line string").join(ids, "id", "left_semi").distinct()


def _verified(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for x, y, held_x, held_y in zip(*[c.to_pylist() for c in batch.columns]):
            if x == y:
                continue
            if held_x and held_y:
                mode = rule.by_words(min(len(words_of_line(x)), len(words_of_line(y))))
                if any(k >> 1 & 1 == mode for k in set(held_x).intersection(held_y)):
                    continue  # counted where the lines of a crowded key meet
            if rule.linked(x, y):
                a.append(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest())
                b.append(hashlib.md5(y.encode("utf-8", "surrogatepass")).digest())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _first_places(docs: DataFrame, bits: int) -> DataFrame:
    """(print, first, id) of every different line with a word: its md5, its first place, its id."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    return write_table(_numbered(docs, bits).groupBy("print").agg(F.min(place).alias("first"), F.first("id").alias("id")), "line-firsts")


def line_links(docs: DataFrame, edits: Rule | Callable[[int], int] = long_lines, bits: int = ID_BITS, texts: DataFrame | None = None, many: int = MANY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((a, b), (print, n)): edges between md5s of different lines that connect just what links connect, and each line's number of links.

    Edges are the links themselves but for lines of crowded keys, whose links are counted where they
    meet. ``texts`` may give what ``_first_places`` found; ``bits`` are those of the ids (few bits
    make many lines share one, which changes the work but not the links), and so are ``many`` and
    ``block``, from which number of lines on a key is crowded, and the lines of a block.
    """
    rule = rule_of(edits)
    filed = docs.select("text").mapInArrow(lambda batches: _filed(batches, rule, bits), "key long, id long, sketch int")
    met = write_table(filed.repartition(F.shiftright("key", 1)).mapInArrow(lambda batches: _met(batches, many), "a long, b long, shared boolean"), "line-met")
    same_id = (texts or _first_places(docs, bits)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = write_table(met.where("NOT shared").select("a", "b").distinct().unionByName(same_id.select(F.col("id").alias("a"), F.col("id").alias("b"))), "line-pairs")
    members = met.where("shared").select(F.col("a").alias("key"), F.col("b").alias("id"))
    ids = write_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct(), "line-ids")
    lines = write_table(_texts_of(docs, ids, rule.chars, bits), "line-texts")
    # A line holds few keys; those that many lines hold are gathered by line.
    crowded = members.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("held"))
    told = write_table(lines.join(crowded, "id", "left"), "line-held")
    left, right = (told.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}"), F.col("held").alias(f"held_{k}")) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("line_a", "line_b", "held_a", "held_b")
    checked = both.mapInArrow(lambda batches: _verified(batches, rule), "a binary, b binary")
    links = write_table(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-links")

    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = told.where("held IS NOT NULL").select(F.explode("held").alias("key"), "line", "held").join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "line", "held")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    met_in_blocks = write_table(dealt.mapInArrow(lambda batches: _compared(batches, rule), "a binary, b binary, n long"), "line-blocks")
    counts = links.select(F.explode(F.array("a", "b")).alias("print"), F.lit(1).cast("long").alias("n")).unionByName(met_in_blocks.where("b IS NULL").select(F.col("a").alias("print"), "n"))
    return links.unionByName(met_in_blocks.where("b IS NOT NULL").select("a", "b")), counts.groupBy("print").agg(F.sum("n").alias("n_links"))


def _numbered(docs: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """(doc_id, line_no, print, id) of every line with a word; lines count from 0 in their text."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD_PATTERN)).select("doc_id", "line_no", F.unhex(F.md5("line")).alias("print"), line_id_column(F.col("line"), bits).alias("id"))


def line_classes(docs: DataFrame, edits: Rule | Callable[[int], int] = long_lines, bits: int = ID_BITS, many: int = MANY, block: int = BLOCK) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, n_links, kept) of every line with a word.

    A line's class is all that links reach from its text; it is named by its first line (by doc_id,
    nulls last, then line number), which alone is kept. n_links counts the different texts that the
    line's own text links to. Lines without a word are no lines here: they have no row and no link.
    A null text has none; rows with equal ids are told apart by nothing, so all their equal lines
    share the name (and are kept or not together); other columns are not looked at; an empty table
    gives an empty result.
    """
    texts = _first_places(docs, bits)
    links, ends = line_links(docs, edits, bits, texts, many, block)
    members = connected_components(links, "a", "b")
    near = texts.join(members, F.col("print") == F.col("node")).select("print", "label", "first")
    least = near.groupBy("label").agg(F.min("first").alias("class_first"))
    named = near.join(least, "label").join(ends, "print").select(F.col("print").alias("near_print"), "class_first", "n_links")
    every = texts.join(named, F.col("print") == F.col("near_print"), "left")
    classes = write_table(every.select(F.col("print").alias("text_print"), F.coalesce("class_first", "first").alias("own"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "line-classes")
    # Both sides are plain exchanges, so the copies of a very common line can be split.
    joined = _numbered(docs).join(classes, F.col("print") == F.col("text_print"))
    kept = F.col("doc_id").eqNullSafe(F.col("own.doc_id")) & (F.col("line_no") == F.col("own.line_no"))
    return joined.select("doc_id", "line_no", F.col("own.doc_id").alias("class_doc_id"), F.col("own.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts' lines that are not kept taken out; wordless lines and null texts stay as they are."""
    dropped = line_classes(docs).where(~F.col("kept")).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_dropped"))
    lines = F.split(F.col("text"), "\n", -1)
    left = F.array_join(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("_dropped"), s["i"]))["x"], "\n")
    text = F.when(F.col("_dropped").isNull() | F.col("text").isNull(), F.col("text")).otherwise(left)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))
    return rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(F.col("row").withField("text", text).alias("row")).select("row.*")
