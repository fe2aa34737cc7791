"""Timelines as markup: visits cut out of text, filters on tags and attributes, removal of nodes."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.portions import each_row
from chronoloom.functions.text import dynamic_compare

#: A visit with its events, from markup that need not be well-formed as a whole.
EVENT = "struct<tag: string, attributes: map<string,string>, text: string>"


_VISIT = r"(?s)<visit\b[^>]*?/>|<visit\b.*?</visit>"


def visit_strings(text: Column) -> Column:
    """Every <visit> of a text, verbatim, in order; visits do not nest. Self-closing ones count too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_VISIT), F.lit(0))


def without_earlier(record: Column, n: int) -> Column:
    """A record with all of its visits but the last ``n`` cut out, with the text behind each up to the next tag; the rest stays."""
    visits, between = visit_strings(record), F.split(F.coalesce(record, F.lit("")), _VISIT, -1)

    def part(piece: Column, k: Column) -> Column:
        kept = F.concat(F.coalesce(F.get(visits, k - 1), F.lit("")), piece)
        return F.when(k <= F.size(visits) - n, F.when(k == 0, piece).otherwise(F.regexp_replace(piece, r"^[^<]+", ""))).otherwise(kept)

    return F.array_join(F.transform(between, part), "")


def start_attribute(visit: Column) -> Column:
    return F.nullif(F.regexp_extract(visit, r'^<visit\b[^>]*?\bstart="([^"]*)"', 1), F.lit(""))


def _unescaped(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def events_of(visit: Column) -> Column:
    """The child events of a visit as an array of (tag, attributes, text); elements without children of their own."""
    inner = F.regexp_replace(F.regexp_replace(visit, r"(?s)^<visit\b[^>]*>", ""), r"</visit>$", "")
    raw = F.regexp_extract_all(inner, F.lit(r"(?s)(<[A-Za-z_][\w.-]*(?:\s[^<>]*)?/>|<([A-Za-z_][\w.-]*)\b[^<>]*>[^<]*</\2>)"), F.lit(1))

    def event(x: Column) -> Column:
        head = F.regexp_extract(x, r"(?s)^<[^>]*>", 0)
        keys = F.regexp_extract_all(head, F.lit(r'([\w:.-]+)="[^"]*"'), F.lit(1))
        values = F.transform(F.regexp_extract_all(head, F.lit(r'[\w:.-]+="([^"]*)"'), F.lit(1)), _unescaped)
        body = F.regexp_replace(F.regexp_replace(x, r"(?s)^<[^>]*>", ""), r"(?s)</[^>]*>$", "")
        return F.struct(F.regexp_extract(x, r"^<([A-Za-z_][\w.-]*)", 1).alias("tag"), F.map_from_arrays(keys, values).alias("attributes"), _unescaped(body).alias("text"))

    return F.transform(raw, event)


def tag_test(tag: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a tag begins, whatever its case, with one of ``include`` (any, if empty) and with none of ``exclude``."""
    pattern = lambda names: "^(?:" + "|".join(names) + ")"
    kept = F.lower(tag).rlike(pattern([n.lower() for n in include])) if include else F.lit(True)
    return kept & ~F.lower(tag).rlike(pattern([n.lower() for n in exclude])) if exclude else kept


_COMPARISONS = {"$eq": lambda s: s == 0, "$ne": lambda s: s != 0, "$gte": lambda s: s >= 0, "$gt": lambda s: s > 0, "$lte": lambda s: s <= 0, "$lt": lambda s: s < 0}


def attribute_test(attributes: Column, conditions: dict[str, dict]) -> Column:
    """A filter such as {"value": {"$gte": 5}} compiled into one predicate over a map of attributes.

    A missing attribute does not match. An empty condition only asks that the attribute be there,
    and ends the test. Values are compared as numbers, times or strings, whichever both are. An
    unknown operator matches nothing.
    """
    tests = []
    for name, condition in conditions.items():
        value = F.try_element_at(attributes, F.lit(name))
        tests.append(value.isNotNull())
        if not condition:
            break
        for operator, wanted in condition.items():
            literal = lambda w: F.lit(str(w))
            if operator in _COMPARISONS:
                test = _COMPARISONS[operator](dynamic_compare(value, literal(wanted)))
            elif operator in ("$in", "$nin"):
                same = [dynamic_compare(value, literal(w)) == 0 for w in wanted]
                found = reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in same], F.lit(False))
                test = found if operator == "$in" else ~found
            else:
                test = F.lit(False)
            tests.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


PRESETS = {"all": {}, "codes": {"exclude": ["note"]}, "notes": {"include": ["note"]}}


def filter_visits(visits: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, conditions: dict[str, dict] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Visits with the events that pass; visits without any go; then each person's first or last n.

    ``visits``: person_id, visit, events (array of EVENT).
    """
    kept = F.filter("events", lambda e: tag_test(e["tag"], include, exclude) & (attribute_test(e["attributes"], conditions) if conditions else F.lit(True)))
    left = visits.withColumn("events", kept).where(F.size("events") > 0)
    for n, order in ((first, F.asc("visit")), (last, F.desc("visit"))):
        if n is not None:
            from pyspark.sql.window import Window

            left = left.withColumn("_rank", F.row_number().over(Window.partitionBy("person_id").orderBy(order))).where(F.col("_rank") <= n).drop("_rank")
    return left


def filter_preset(visits: DataFrame, codes_only: bool = False, notes_only: bool = False) -> DataFrame:
    if codes_only and notes_only:
        raise ValueError("codes only and notes only exclude each other")
    return filter_visits(visits, **PRESETS["codes" if codes_only else "notes" if notes_only else "all"])


def _without(source: str | None, tag: re.Pattern, promote: bool) -> str | None:
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError:
        return None
    parents = {child: parent for parent in root.iter() for child in parent}
    for node in [n for n in root.iter() if n is not root and tag.match(n.tag)]:
        parent = parents[node]
        parent.remove(node)
        if promote:
            for child in list(node):
                parent.append(child)
                parents[child] = parent
    return ET.tostring(root, encoding="unicode")


def remove_nodes(text: Column, tag_pattern: str, promote_children: bool = False) -> Column:
    """XML without the nodes whose tag begins with the pattern; their children may move to the end of the parent. Null if malformed."""

    def begun():
        pattern = re.compile(tag_pattern, re.I)
        return lambda t: _without(t, pattern, promote_children)

    return each_row("string", begun)(text)


def _pretty(source: str | None) -> str | None:
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError:
        return None
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def pretty_xml(text: Column) -> Column:
    """Indented XML without a declaration; null if malformed."""
    return each_row("string", lambda: _pretty)(text)


def _root_of(source: str | None) -> str | None:
    try:
        return ET.tostring(ET.fromstring(source or ""), encoding="unicode")
    except ET.ParseError:
        return None


def whole_element(text: Column) -> Column:
    """A document's root element as XML, without declaration, comments and what else surrounds it; null if malformed."""
    return each_row("string", lambda: _root_of)(text)
