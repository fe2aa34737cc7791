"""Personal data: patterns, and a skip-chain conditional random field that carries their labels on.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their spans are always
reported. A conditional random field then labels the other tokens that hold a digit or an @ (tokens
without either are never personal data of these kinds). Neighbouring tokens are joined in a chain;
tokens anywhere in the document that repeat or resemble each other (the same digits, the same last
seven digits, the same address) are joined by skip edges, each to the latest before it. Numbers may
be written in groups: the digits of neighbouring tokens are read as one, and where seven or more end
alike, the tokens that hold them are joined, however either is spaced; hidden groups of such a number
are labelled as one token. Tokens inside a pattern's span are observed, the rest are hidden; loopy
belief propagation passes messages until they settle. So a number that was given once in full is found
again where it is shortened, and one that a pattern misses because another number stands beside it (a
greedy match of both fails its check, and is not tried again) is found by its tokens' own marks and
by its repeats. Every text with a candidate token is searched, whether a pattern found something or not.

The weights are fitted here, by pseudo-likelihood, on a bounded sample of documents that hold a
likely address or number (``SAMPLE_ROWS`` documents of at most ``SAMPLE_CHARS`` characters; longer
ones are left out of the fit, not of the search). The patterns' spans are their labels. To each
document are added shortened repeats of its spans and repeats beside other numbers (with the label),
and look-alikes that repeat nothing (without).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are fitted on at most, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Examples made of each document.
VARIANTS = 3
#: Rounds of message passing at most, the part of a message that is kept, the change that ends it.
ROUNDS, DAMPING, SETTLED = 30, 0.3, 1e-4
#: A hidden token is reported if the probability of a kind is this high.
CERTAIN = 0.8
#: Messages that are worked out together.
PORTION = 1 << 14
#: Digits in which numbers of several groups must end alike, and those that are compared at most.
GROUPED, LONGEST = 7, 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, and a greedy run never has to give digits back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 if d > 4 else d * 2
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.domain; looks left from each @, so time is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks, by start, then kind."""
    spans = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _unsure(text: str) -> list[tuple[int, int]]:
    """Where a card or phone pattern matched several tokens and its check failed: there may be numbers in it or not."""
    tried = [m.span() for pattern in (_CARD, _PHONE) for m in pattern.finditer(text) if " " in m[0]]
    sure = {(s, e) for k, s, e in base_spans(text)}
    return sorted(set(tried) - sure)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class Site(NamedTuple):
    """A token that may be personal data. ``label``: 0 for none, 1.. for KINDS, None if hidden."""

    index: int
    start: int
    end: int
    token: str
    label: int | None


FEATURES = 18


def _whole_card(token: str) -> bool:
    """Whether the digits of a token alone are those of a card."""
    digits = "".join(_DIGIT.findall(token))
    return 12 <= len(digits) <= 19 and not any(c.isalpha() or c == "." for c in token.strip(".,;:")) and luhn(digits)


def _whole_ip(token: str) -> bool:
    found = _IP.fullmatch(token.strip(".,;:()"))
    return found is not None and all(len(p) <= 3 and int(p) <= 255 for p in found[0].split("."))


def features(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    dots = token.strip(".,;:").count(".")
    return [
        1.0, float("@" in token), float(token[:1] == "+"), float("(" in token or ")" in token), float("-" in token), float(dots == 3), float(dots > 0),
        float(digits == 0), float(1 <= digits <= 2), float(3 <= digits <= 4), float(5 <= digits <= 8), float(9 <= digits <= 11), float(12 <= digits <= 19), float(digits > 19),
        float(any(c.isalpha() for c in token)), float(_whole_card(token)), float(_whole_ip(token)), float(digits > 0 and token[:1] == "+" and digits <= 3),
    ]


def likeness(token: str) -> list[tuple]:
    """Keys under which a token resembles others: its address, or its digits and the last seven of them."""
    if "@" in token:
        return [("@", token.strip(".,;:()<>\"'").lower())]
    digits = "".join(c for c in token if c.isdigit() and c.isascii())
    plain = not any(c.isalpha() for c in token)
    keys = [("=", digits, token.count("."))] if plain and len(digits) >= 6 else []
    return keys + ([("7", digits[-7:])] if plain and len(digits) >= 7 and "." not in token else [])


def sites_of(text: str, spans: list[tuple[str, int, int]]) -> list[Site]:
    """The tokens with a digit or @; those that a span overlaps are observed."""
    found, k = [], 0
    for index, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        if "@" not in token and not _DIGIT.search(token):
            continue
        while k < len(spans) and spans[k][2] <= m.start() and max((s[2] for s in spans[k : k + 4]), default=0) <= m.start():
            k += 1
        label = next((KINDS.index(kind) + 1 for kind, s, e in spans[k : k + 8] if s < m.end() and e > m.start()), None)
        found.append(Site(index, m.start(), m.end(), token, label))
    return found


def _next(site: Site) -> int:
    """The index of the token after it."""
    return site.index + 1 + site.token.count(" ")


def _group(token: str) -> str:
    """The digits of a token that may be one group of a spaced number; else ''."""
    if "." in token.strip(".,;:") or any(c.isalpha() or c == "@" for c in token):
        return ""
    return "".join(c for c in token if c.isdigit() and c.isascii())


def _grouped(sites: list[Site]) -> dict[int, list[int]]:
    """Of a token j the tokens i < j that hold the same digits of a number that ends alike in GROUPED digits or more.

    A run is a number in neighbouring groups, with what may follow it. Each number is followed back
    from the latest one before, in an earlier run if possible. Where both runs go on after the same
    digits, they either agree further or are different numbers.
    """
    runs: list[list[int]] = []
    for j, site in enumerate(sites):
        if not _group(site.token):
            continue
        before = sites[j - 1] if j else None
        if runs and runs[-1][-1] == j - 1 and _next(before) == site.index and before.label == site.label and before.token[-1] not in ".,;:":
            runs[-1].append(j)
        else:
            runs.append([j])
    found: dict[int, list[int]] = {}
    latest: dict[str, tuple[str, list[int], int]] = {}
    for run in runs:
        groups = [_group(sites[j].token) for j in run]
        digits = "".join(groups)
        owners = [j for j, own in zip(run, groups) for _ in own]
        here: dict[str, tuple[str, list[int], int]] = {}
        end = 0
        for own in groups:
            end += len(own)
            if end < GROUPED:
                continue
            key = digits[end - GROUPED : end]
            other = latest.get(key)
            if other and (other[2] == len(other[0]) or end == len(digits)):
                there, whose, last = other
            else:
                there, whose, last = here.get(key, ("", [], 0))
                if last > end - GROUPED:
                    continue  # it overlaps itself
            same: dict[int, list[int]] = {}
            for k in range(1, min(last, end, LONGEST) + 1):
                i, j = whose[last - k], owners[end - k]
                if there[last - k] != digits[end - k] or i >= j:
                    break
                if i not in same.setdefault(j, []):
                    same[j].append(i)
            found |= same
            here[key] = digits, owners, end
        latest.update(here)
    return found


def with_groups_joined(sites: list[Site]) -> list[Site]:
    """The sites, neighbouring hidden groups that hold digits of one earlier number made one site."""
    grouped, found, last = _grouped(sites), [], None
    for j, site in enumerate(sites):
        if site.label is None and j in grouped and last == j - 1 and sites[last].index == site.index - 1 and sites[last].token[-1] not in ".,;:":
            found[-1] = found[-1]._replace(end=site.end, token=f"{found[-1].token} {site.token}")
        else:
            found.append(site)
        last = j if site.label is None and j in grouped else None
    return found


def graph(sites: list[Site], groups: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j), i < j, and their kind: 0 for chain, 1 for skip (without ``groups`` between equal tokens only)."""
    edges, kinds, latest = [], [], {}
    grouped = _grouped(sites) if groups else {}
    for j, site in enumerate(sites):
        if j and _next(sites[j - 1]) == site.index:
            edges.append((j - 1, j))
            kinds.append(0)
        linked = set()
        for key in likeness(site.token):
            i = latest.get(key)
            if i is not None and i not in linked:
                linked.add(i)
                edges.append((i, j))
                kinds.append(1)
            latest[key] = j
        for i in grouped.get(j, ()):
            if i not in linked:
                edges.append((i, j))
                kinds.append(1)
    return np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


class Weights(NamedTuple):
    """unary[label, feature]; pair[0][left, right] for chain edges and pair[1] (symmetric) for skip edges."""

    unary: np.ndarray
    pair: np.ndarray


_LABELS = len(KINDS) + 1


def propagate(weights: Weights, sites: list[Site]) -> np.ndarray:
    """Beliefs [site, label] by damped sum-product message passing on the skip-chain graph."""
    own = np.array([features(s.token) for s in sites]) @ weights.unary.T
    for i, s in enumerate(sites):
        if s.label is not None:
            own[i] = -1e3
            own[i, s.label] = 0
    edges, kinds = graph(sites)
    own -= own.max(axis=1, keepdims=True)
    if not len(edges):
        beliefs = np.exp(own)
        return beliefs / beliefs.sum(axis=1, keepdims=True)
    # Neighbours that also resemble each other share one edge with both potentials, not a loop of two.
    ends, which = np.unique(edges[:, 0] * len(sites) + edges[:, 1], return_inverse=True)
    held = np.zeros(len(ends), np.int64)
    np.bitwise_or.at(held, which, kinds + 1)
    edges, kinds = np.column_stack(np.divmod(ends, len(sites))), held - 1
    pair = np.concatenate([weights.pair, weights.pair.sum(axis=0, keepdims=True)])
    # Each edge carries a message both ways; message e runs source[e] -> target[e].
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    kinds = np.concatenate([kinds, kinds + len(pair)])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])  # along the edges, and against them
    messages = np.zeros((len(source), _LABELS))
    for _ in range(ROUNDS):
        gathered = own.copy()
        np.add.at(gathered, target, messages)
        change, new = 0.0, np.empty_like(messages)
        for at in range(0, len(source), PORTION):  # bounded memory for texts of very many numbers
            part = slice(at, at + PORTION)
            raw = (gathered[source[part]] - messages[back[part]])[:, :, None] + pair[kinds[part]]
            top = raw.max(axis=1, keepdims=True)
            sent = (top + np.log(np.exp(raw - top).sum(axis=1, keepdims=True)))[:, 0, :]
            sent -= sent.max(axis=1, keepdims=True)
            change = max(change, float(np.abs(sent - messages[part]).max()))
            new[part] = DAMPING * messages[part] + (1 - DAMPING) * sent
        messages = new
        if change < SETTLED:
            break
    beliefs = own.copy()
    np.add.at(beliefs, target, messages)
    beliefs = np.exp(beliefs - beliefs.max(axis=1, keepdims=True))
    return beliefs / beliefs.sum(axis=1, keepdims=True)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def all_spans(text: str, weights: Weights | None, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """The patterns' spans and those that the field adds; runs of tokens of one kind are one span, whole cards each one."""
    base = base_spans(text) if base is None else base
    if weights is None:
        return base
    sites = sites_of(text, base)
    if all(s.label is not None for s in sites):
        return base
    sites = with_groups_joined(sites)
    beliefs, added, last = propagate(weights, sites), [], None
    for site, belief in zip(sites, beliefs):
        label = int(belief.argmax())
        if site.label is not None or label == 0 or belief[label] < CERTAIN:
            last = None
            continue
        start, end = _trimmed(text, site.start, site.end)
        if last and last[:2] == (label, site.index) and not _whole_card(site.token) and not _whole_card(last[2]):
            added[-1] = (added[-1][0], added[-1][1], end)
        elif start < end:
            added.append((KINDS[label - 1], start, end))
        last = (label, _next(site), site.token)
    return sorted({*base, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _look_alike(token: str, rng: np.random.Generator) -> str:
    """A token of the same shape with other digits, and nothing that the patterns would call a card or an address."""
    token = "".join(str(rng.integers(10)) if c.isdigit() else c for c in token.strip(".,;:+()"))
    if _whole_card(token):
        at = max(i for i, c in enumerate(token) if c in "0123456789")
        token = token[:at] + str((int(token[at]) + 1) % 10) + token[at + 1 :]
    return f"{token}.{rng.integers(256, 1000)}" if _whole_ip(token) else token


def _example(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[list[Site], list[int]]:
    """Sites and labels of a text to which repeats and look-alikes are added at its end; label -1 if not known."""
    sites = sites_of(text, spans)
    unsure = _unsure(text)
    labels = [s.label or (-1 if any(a < s.end and s.start < b for a, b in unsure) else 0) for s in sites]
    index = (sites[-1].index if sites else 0) + 10

    def add(token: str, label: int, beside: bool = False) -> None:
        nonlocal index
        index += 1 if beside else 10
        sites.append(Site(index, 0, 0, token, None))
        labels.append(label)

    found, joining = [s for s in sites if s.label], bool(rng.integers(2))
    for s in found:
        token = s.token.strip(".,;:+()")
        digits = "".join(_DIGIT.findall(token))
        if len(digits) > GROUPED and not any(c.isalpha() or c in ".@" for c in token):
            end, size = digits[-int(rng.integers(GROUPED, len(digits))) :], int(rng.integers(2, 5))
            # Whole, shortened, or in groups as one site: one repeat each time, as more would bear each other out.
            add([token, end, " ".join(digits[i : i + size] for i in range(0, len(digits), size))][rng.integers(3)], s.label)
            add(_look_alike(end, rng), 0)
        elif likeness(token) and ("@" in token or not joining):
            bare = not any(c in "@." or c.isalpha() for c in token) and rng.integers(2)
            add(digits if bare else token, s.label)
            if bare:
                add(_look_alike(digits, rng), 0)
        if "@" not in s.token:
            other = _look_alike(s.token, rng)
            for _ in range(int(rng.integers(1, 4))):  # what is no personal data is repeated too
                add(other, 0)
    # Whole spans once more, each beside a number that is none: to its left and to its right in turn.
    k = 0
    while k < len(found):
        run = [found[k]]
        while k + len(run) < len(found) and found[k + len(run)].index == run[-1].index + 1 and found[k + len(run)].label == run[0].label:
            run.append(found[k + len(run)])
        k += len(run)
        if len(run) > 1 and joining:  # its digits as one token, and as many others
            digits = "".join("".join(_DIGIT.findall(s.token)) for s in run)
            whole = digits[int(rng.integers(2)) :]
            add(whole, run[0].label if likeness(whole) else 0)
            add(_look_alike(whole, rng), 0)
        if KINDS[run[0].label - 1] != "ip" and rng.integers(2):
            other, kind = ".".join(str(rng.integers(256)) for _ in range(4)), KINDS.index("ip") + 1
        else:
            other, kind = _look_alike("".join(str(rng.integers(10)) for _ in range(rng.choice([2, 8, 16]))), rng), 0
        left = bool(rng.integers(2))
        if left:
            add(other, kind)
        for n, s in enumerate(run):
            token = s.token if rng.integers(2) else _fresh(s.token, s.label, rng)
            add(token, s.label, beside=left or n > 0)
        if not left:
            add(other, kind, beside=True)
    return sites, labels


def _fresh(token: str, label: int, rng: np.random.Generator) -> str:
    """A token of the same kind that repeats nothing."""
    if KINDS[label - 1] != "card" or not _whole_card(token):
        return "".join(str(rng.integers(1, 3)) if c.isdigit() and KINDS[label - 1] == "ip" else str(rng.integers(10)) if c.isdigit() else c for c in token)
    at = [i for i, c in enumerate(token) if c in "0123456789"]
    made = list(token)
    for i in at:
        made[i] = str(rng.integers(10))
    for last in "0123456789":
        made[at[-1]] = last
        if _whole_card("".join(made)):
            break
    return "".join(made)


def fit(texts: list[str], rounds: int = 2000, penalty: float = 1e-5) -> Weights | None:
    """Weights by pseudo-likelihood: each label given its neighbours' is a multinomial logistic model."""
    rng, rows, answers = np.random.default_rng(3), [], []
    for text in texts * VARIANTS:
        sites, labels = _example(text, base_spans(text), rng)
        if not sites:
            continue
        edges, kinds = graph(sites, False)  # of single tokens
        around = np.zeros((len(sites), 3, _LABELS))  # labels to the left, to the right, over skip edges
        for (i, j), kind in zip(edges, kinds):
            if labels[i] >= 0:
                around[j, 2 if kind else 0, labels[i]] += 1
            if labels[j] >= 0:
                around[i, 2 if kind else 1, labels[j]] += 1
        rows += [np.concatenate([features(s.token), a.ravel()]) for s, a, label in zip(sites, around, labels) if label >= 0]
        answers += [label for label in labels if label >= 0]
    if not any(answers):
        return None  # without a single span there is nothing to learn from
    # Features are few small numbers, so most rows are equal: each different one once, with its share.
    different, counts = np.unique(np.column_stack([np.array(rows), answers]), axis=0, return_counts=True)
    x, y, share = different[:, :-1], np.eye(_LABELS)[different[:, -1].astype(int)], (counts / counts.sum())[:, None]
    w = ahead = np.zeros((_LABELS, x.shape[1]))
    left, right, skip = (slice(FEATURES + k * _LABELS, FEATURES + (k + 1) * _LABELS) for k in range(3))
    lipschitz = np.linalg.norm(x * np.sqrt(share), 2) ** 2 + penalty  # twice the bound of a plain logistic model, as slopes add up
    for n in range(rounds):  # Nesterov's accelerated descent
        z = x @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - y) * share).T @ x
        # An edge has one potential, whichever end is asked: the two sides' slopes add up.
        slope[:, right] = slope[:, right] + slope[:, left].T
        slope[:, left] = slope[:, right].T
        slope[:, skip] = slope[:, skip] + slope[:, skip].T
        before, w = w, ahead - (slope + penalty * ahead) / lipschitz
        ahead = w + n / (n + 3) * (w - before)
    return Weights(w[:, :FEATURES], np.stack([w[:, right], w[:, skip]]))  # pair[0] is [left label, right label]


def sample_texts(docs: DataFrame) -> list[str]:
    """The texts of at most SAMPLE_ROWS distinct hashes, the least ones, that hold a likely address or number.

    Texts above SAMPLE_CHARS characters are not among them: they bound what the driver gathers.

    The hashes are chosen first, so that no task gathers texts of the whole corpus.
    """
    likely = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]{12}")
    able = docs.where((F.length("text") <= SAMPLE_CHARS) & likely).select("text", F.xxhash64("text").alias("h"))
    # At most SAMPLE_ROWS longs.
    least = able.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS)
    chosen = able.join(F.broadcast(least), "h", "left_semi").select("text").distinct()
    return sorted(r.text for r in chosen.toLocalIterator())


def find_personal_data(docs: DataFrame, weights: Weights | None = None, fitted: bool = True) -> DataFrame:
    """doc_id, base (the patterns' spans) and spans (with those the field adds), joined as kind:start:end.

    Offsets count code points of the whole text, ends are exclusive. A null or empty text has none.
    Rows are looked at one by one: repeated rows and null ids change nothing, other columns are not
    looked at, an empty table stays so. ``weights`` are fitted on a sample of ``docs`` if not given.
    """
    if weights is None and fitted:
        weights = fit(sample_texts(docs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append([f"{k}:{s}:{e}" for k, s, e in found])
                every.append(joined(all_spans(text, weights, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(every, pa.string())], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, base array<string>, spans string")


def digest(found: DataFrame) -> DataFrame:
    """The registered columns: counts per kind and the hash of the patterns' spans, all spans, and how many they are."""
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    every = F.when(F.col("spans") == "", F.lit(0)).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), "spans", every)
