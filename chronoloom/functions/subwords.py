"""Subword tokenizers: byte-level pair encoding by the ranks of a given vocabulary file.

The file is read on the driver and reaches the tasks with the function (a MB or two, whatever the
data); a worker builds its encoder once. Texts come and go in Arrow batches, of which a small part is held as Python objects.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.portions import each_row, portions

#: Where vocabulary files of public tokenizers lie by default.
DIRECTORY = "/opt/tokenizers"
#: Fixed value: the pattern by which texts are cut before the merges of the default file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoders that this worker has built, by the digest of their file and pattern.
_built: dict[bytes, object] = {}


def encoder(ranks: bytes, pattern: str):
    """The encoder of a rank file: lines of a token in base64 and its rank."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _built:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _built[key] = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})
    return _built[key]


_LONG_RUN = re.compile(r"\s{100000}")


def encode(own, pattern: str, text: str | None) -> list[int]:
    """A text's ids. Runs of very many blanks, which overflow the encoder's own cutting, are cut by another library."""
    if not text:
        return []
    if len(text) < 100_000 or not _LONG_RUN.search(text):
        return own.encode_ordinary(text)
    import regex

    return [i for piece in regex.findall(pattern, text) for i in own._encode_single_piece(piece)]


class Subwords:
    """A tokenizer of a rank file: counts, ids, texts of ids, and the last tokens of a text."""

    def __init__(self, path: str = f"{DIRECTORY}/byte_bpe_50k.tiktoken", pattern: str = PATTERN):
        self.path, self.pattern, self._ranks = path, pattern, b""

    @property
    def ranks(self) -> bytes:
        if not self._ranks:
            with open(self.path, "rb") as file:
                self._ranks = file.read()
        return self._ranks

    def _udf(self, kind: str, of):
        ranks, pattern = self.ranks, self.pattern

        def begun():
            own = encoder(ranks, pattern)
            return lambda x: of(own, lambda t: encode(own, pattern, t), x)

        return each_row(kind, begun)

    def count(self, text: Column) -> Column:
        """The number of tokens; 0 for null."""
        return self._udf("int", lambda own, ids, x: len(ids(x)))(text)

    def counts(self, texts: Column) -> Column:
        """The number of tokens of each text of an array."""
        return self._udf("array<int>", lambda own, ids, xs: None if xs is None else [len(ids(x)) for x in xs])(texts)

    def ids(self, text: Column) -> Column:
        """The ids of a text's tokens; none for null."""
        return self._udf("array<int>", lambda own, ids, x: ids(x))(text)

    def text(self, ids: Column) -> Column:
        """What ids stand for; bytes that are no UTF-8 are replaced. Null stays null."""
        return self._udf("string", lambda own, _, x: None if x is None else own.decode(x))(ids)

    def last(self, text: Column, n: Column) -> Column:
        """The text of the last ``n`` tokens; '' if n is not positive. A character cut in half is replaced."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("string")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            own = encoder(ranks, pattern)
            for texts, sizes in batches:
                at = 0
                for part in portions(texts):
                    numbers = sizes.slice(at, len(part)).to_pylist()
                    at += len(part)
                    yield pa.array([own.decode(encode(own, pattern, x)[-k:]) if x and k > 0 else "" for x, k in zip(part.to_pylist(), numbers)], pa.string())

        return run(text, F.coalesce(n.cast("int"), F.lit(0)))
