"""String, date and JSON scalars as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.subwords import Subwords

#: The patterns under which generated text states pairs, and the groups of instruction and response.
PAIR_PATTERNS = (
    (r"(?:^|\n)(?:[Pp]air \d+[:.]?\s*)?(?:\d+\.?\s*)?[Ii]nstruction:?\s*(.*?)\n+\s*[Rr]esponse:?\s*(.*?)(?=\n(?:[Pp]air \d+[:.]?\s*)?(?:\d+\.?\s*)?[Ii]nstruction|$)", 1, 2),
    (r"(?:^|\n)(?:[Pp]air \d+[:.]?\s*)?(?:\*\*)?[Ii]nstruction ?\d*:?(?:\*\*)?\s*(.*?)\n+\s*(?:\*\*)?[Rr]esponse(?: \d*)?:?(?:\*\*)?\s*(.*?)(?=\n(?:[Pp]air \d+[:.]?\s*)?(?:\*\*)?[Ii]nstruction|$)", 1, 2),
    (r"(?:^|\n)(?:[Pp]air \d+[:.]?\s*)?(?:\d+\.?\s*)?[Qq]uestion:?\s*(.*?)\n+\s*[Aa]nswer:?\s*(.*?)(?=\n(?:[Pp]air \d+[:.]?\s*)?(?:\d+\.?\s*)?[Qq]uestion|$)", 1, 2),
    (r"(?:^|\n)(?:\*\*)?(\d+)\.?\s*[Ii]nstruction:?(?:\*\*)?\s*(.*?)\n+\s*(?:\*\*)?[Rr]esponse(?: \1)?:?(?:\*\*)?\s*(.*?)(?=\n(?:\*\*)?(?:\d+)\.?\s*[Ii]nstruction|$)", 2, 3),
)


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of anything but ASCII white space. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def token_count(text: Column, tokenizer: str = "whitespace") -> Column:
    return tokenizer_named(tokenizer).count(text)


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits, and every other character but white space alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), F.lit(1))


def quarter_tokens(text: Column) -> Column:
    """Pieces of at most four characters of each whitespace token: a cheap upper estimate of subwords."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^ \t\n\x0B\f\r]{1,4})"), F.lit(1))


class Pieces:
    """A tokenizer that cuts a text into an array of strings, without any user function."""

    def __init__(self, cut: Callable[[Column], Column]):
        self.cut = cut

    def count(self, text: Column) -> Column:
        return F.size(self.cut(text))

    def counts(self, texts: Column) -> Column:
        return F.transform(texts, self.count)

    def ids(self, text: Column) -> Column:
        """A stand-in for ids: each token by a hash that every engine can compute."""
        return F.transform(self.cut(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % 32_000).cast("int"))

    def last(self, text: Column, n: Column) -> Column:
        """The last ``n`` tokens joined by blanks; '' if n is not positive."""
        # An array of one struct names the pieces, which are cut once however often they are used.
        held = F.array(F.struct(self.cut(text).alias("own"), n.alias("n")))

        def joined(x: Column) -> Column:
            size = F.least(x["n"], F.size(x["own"]))
            return F.when((x["n"] <= 0) | (F.size(x["own"]) == 0), F.lit("")).otherwise(F.array_join(F.slice(x["own"], -size, size), " "))

        return F.get(F.transform(held, joined), F.lit(0))


#: Tokenizers by name; more can be added, such as Subwords of another vocabulary file.
TOKENIZERS: dict[str, Pieces | Subwords] = {"whitespace": Pieces(tokens), "words": Pieces(word_tokens), "quarters": Pieces(quarter_tokens), "bpe": Subwords()}


def tokenizer_named(name: str) -> Pieces | Subwords:
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer named {name!r}; known are {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name]


def strip(text: Column) -> Column:
    """Without white space at either end, newlines and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_safety_block(text: Column) -> Column:
    """Drops a safety notice up to the next blank line or the end."""
    return F.regexp_replace(text, r"(?s)SAFETY_HAZARD.*?(?=\n\n|\z)", "")


def plain(text: Column) -> Column:
    """Without Markdown asterisks and outer white space."""
    return strip(F.replace(text, F.lit("*"), F.lit("")))


def parse_pairs(text: Column, patterns: tuple = PAIR_PATTERNS) -> Column:
    """Distinct (instruction, response) structs of every pattern in turn, in order of appearance.

    Pairs with an empty side are dropped; a null or unmatched text gives an empty array.
    """
    cleaned = unix_newlines(without_safety_block(F.coalesce(text, F.lit(""))))
    found = []
    for pattern, instruction, response in patterns:
        flagged = F.lit("(?sid)" + pattern)  # d: $ and . know no line end but \n
        sides = F.arrays_zip(F.regexp_extract_all(cleaned, flagged, F.lit(instruction)).alias("q"), F.regexp_extract_all(cleaned, flagged, F.lit(response)).alias("a"))
        found.append(F.transform(sides, lambda p: F.struct(plain(p["q"]).alias("instruction"), plain(p["a"]).alias("response"))))
    return F.array_distinct(F.filter(F.concat(*found), lambda p: (F.length(p["instruction"]) > 0) & (F.length(p["response"]) > 0)))


def fill(template: str, **values: Column) -> Column:
    """A prompt template with {name} replaced, once: braces in a value, other braces and percent signs stay."""
    if not values:
        return F.lit(template)
    pieces = re.split("({(?:" + "|".join(map(re.escape, values)) + ")})", template)
    text = lambda piece, k: F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")) if k % 2 else F.lit(piece)
    return F.concat(*[text(piece, k) for k, piece in enumerate(pieces) if piece])


#: The formats under which visit times are written, tried in this order.
VISIT_FORMATS = ("M/d/yy h:mm a", "M/d/yyyy h:mm a", "M/d/yy H:mm", "M/d/yyyy H:mm")


def visit_time(text: Column) -> Column:
    """The time of a visit's start attribute in the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in VISIT_FORMATS])


def visit_date(text: Column) -> Column:
    """The date part of a visit's start attribute: M/d/yyyy or yyyy-MM-dd, whatever follows."""
    day = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([0-9/-]+)", 1)
    return F.coalesce(F.try_to_timestamp(day, F.lit("M/d/yyyy")), F.try_to_timestamp(day, F.lit("yyyy-M-d"))).cast("date")


def evidence_date(text: Column) -> Column:
    """A date M/d/yyyy and nothing else; null for any other text."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")


def score(value: Column) -> Column:
    """A score that may arrive as a number or a numeric string; else null."""
    return value.try_cast("double")


def context_name(context: Column) -> Column:
    """A context mode as part of a path: numbers as ``context_N``, named modes as they are."""
    return F.when(context.rlike("^[0-9]+$"), F.concat(F.lit("context_"), context)).otherwise(context)


def verdict(reply: Column, swapped: Column | bool = False) -> Column:
    """'win', 'loss' or 'tie' for the first model from a reply with [[A]], [[B]] or [[C]], in that precedence.

    ``swapped`` says that the models changed places. Null if the reply holds none of them.
    """
    swapped = F.lit(swapped) if isinstance(swapped, bool) else swapped
    says = lambda mark: F.contains(reply, F.lit(mark))
    return F.when(says("[[A]]"), F.when(swapped, "loss").otherwise("win")).when(says("[[B]]"), F.when(swapped, "win").otherwise("loss")).when(says("[[C]]"), F.lit("tie"))


def dynamic_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1: compared as numbers if both are, else as times if both are, else as strings; null if either is null."""
    sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
    numbers = left.try_cast("double"), right.try_cast("double")
    times = F.coalesce(left.try_cast("timestamp"), visit_time(left)), F.coalesce(right.try_cast("timestamp"), visit_time(right))
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    return F.when(both(numbers), sign(*numbers)).when(both(times), sign(*times)).otherwise(sign(left, right))


def available_tokens(context: Column, *used: Column, least: int = 100) -> Column:
    """What is left of a context after ``used`` tokens, and no fewer than ``least``."""
    left = context
    for u in used:
        left = left - u
    return F.greatest(left, F.lit(least))


def last_tokens(text: Column, n: Column, tokenizer: str = "whitespace") -> Column:
    """The last n tokens of a text; '' if n is not positive."""
    return tokenizer_named(tokenizer).last(text, n)
