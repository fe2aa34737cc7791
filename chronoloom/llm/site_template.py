"""Main text of HTML pages by removal of site templates.

A page is parsed into elements. The hash of an element's subtree covers its tag, its class, id and
role, its text and its children. Spark counts on how many different pages of a host each hash occurs;
subtrees that recur across many pages of that host are template and are deleted. Pages whose own
text is the same are copies of one page, and count once. Markup also says what is
not main text: navigation, headers, footers, asides, forms, scripts, and containers classed as
adverts, notices, comments and the like are left out even where each page's differs. A class tells by
whole names ("reader-comments", "ad-box"), not by parts that name a state ("has-sidebar",
"comments-open"). Neither a class nor a tag nor a role removes what holds all of a page's articles and
half of its text: a form around the whole page, a header or an unclosed menu around the article stay
(of a page without any article, a form around most of its paragraphs). Tables and figures inside an
article are the author's, whatever their class.

What an author wrote may recur too (a shared passage, a copied page). So inside <article> or <main>
only wrappers without words of their own are deleted as template, and only if they are on half of
the host's pages with an article and hold no more than half of its text; never paragraphs, headings,
lists, tables, figures or spans, and the article itself never is. Nowhere is an inline element
deleted out of a sentence.

A page with exactly one outermost <article> or <main> says where its text is: what stands outside
goes. On pages with none or several (teasers, comments), the rules above decide everywhere.

The recurring hashes are a small table. Up to ``BROADCAST_ROWS`` of them are broadcast as two sorted
arrays (16 bytes a row) and pages never move; beyond that they are joined to the pages that hold them.
"""

from __future__ import annotations

import html as html_module
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import write_table

#: A subtree is template if it is on this many pages of its host at least, and on this share of them.
MIN_PAGES, MIN_SHARE = 10, 0.005
#: Inside an article, on this share of the host's pages with an article.
INSIDE_SHARE = 0.5
#: Recurring hashes that are broadcast at most; with their hosts 16 bytes each, 32 MB in all.
BROADCAST_ROWS = 2_000_000

#: Elements whose content is never main text.
SKIPPED = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg object canvas dialog menu audio video map".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Of these, and of these roles, what may be around a whole page by mistake or by a framework's habit.
AROUND = frozenset("nav footer aside form dialog menu header".split())
#: Words of a container's class or id that mark it as something else than main text.
MARKS = frozenset("ad ads adv advert adverts advertisement adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar comment comments respond disqus share sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination pager related recommended widget masthead footer".split())
#: What may follow such a word in a name, and what turns a name into that of a state.
STRUCTURE = frozenset("area bar block body bottom box button buttons card cell column container content form group head header icons inner item items left link links list outer panel post posts right row section slot text title top unit wrap wrapper zone".split())
STATES = frozenset("has is no not with without show hide enable disable".split())
CONTAINERS = frozenset("div section aside ul ol dl table figure form fieldset details center header footer nav menu span".split())
#: Containers that may be template inside an article; in the others stands what an author wrote.
WRAPPERS = CONTAINERS - frozenset("ul ol dl table figure span".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section summary table caption tbody thead tfoot tr td th title ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to the end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
KEPT = frozenset("html body main article".split())
#: Tags that an opening tag closes if they are open (within the nearest container).
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_SCOPE = frozenset("html body article main section div ul ol dl table td th nav aside footer header form blockquote".split())

_BARRIERS = ("article", "main", "body", "html", "td", "th")
#: Elements whose end tag reaches out of these.
_REACHING = KEPT | SKIPPED | {"table", "tr", "tbody", "div", "section"}

_QUOTE_OR_END = re.compile(r"""["'>]""")
_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w")
#: Tells subtrees inside an article from equal ones outside, as they are counted apart.
_INSIDE = 0x9E3779B97F4A7C15


def _names_other(name: str) -> bool:
    """Whether a class or id names something else than main text."""
    parts = _PARTS.findall(name)
    if not parts:
        return False
    return (parts[-1] in MARKS and parts[0] not in STATES) or (parts[0] in MARKS and all(p in STRUCTURE for p in parts[1:]))


class Page:
    """The elements of a page in document order, and the events (open, text, close) between them."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.parts: list[list[str | int]] = []
        #: Opening of element i: i; its closing: ~i; text: the string.
        self.events: list[int | str] = []
        self._open: list[int] = []
        #: By tag, the depths at which it is open.
        self._depths: dict[str, list[int]] = {}
        self._inside: list[bool] | None = None
        self._holders: list[bool] | None = None
        self._parse(source)
        while self._open:
            self._close()

    def _close(self) -> None:
        i = self._open.pop()
        self._depths[self.tags[i]].pop()
        self.events.append(~i)

    def _deepest(self, tags) -> int:
        """The depth of the innermost open element of these tags; -1 if none is open."""
        found = -1
        for tag in tags:
            at = self._depths.get(tag)
            if at and at[-1] > found:
                found = at[-1]
        return found

    def _text(self, text: str) -> None:
        if text:
            text = html_module.unescape(text) if "&" in text else text
            self.events.append(text)
            if self._open and not text.isspace():
                self.parts[self._open[-1]].append(" ".join(text.split()))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close_open(("p",), frozenset(_SCOPE))
        if tag in CLOSED_BY:
            self._close_open(CLOSED_BY[tag], frozenset(_SCOPE - set(CLOSED_BY[tag])))
        i = len(self.tags)
        self.tags.append(tag)
        self.attributes.append({k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {})
        self.parents.append(self._open[-1] if self._open else -1)
        self.parts.append([])
        if self._open:
            self.parts[self._open[-1]].append(i)
        self.events.append(i)
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(i)
        if tag in VOID:
            self._close()

    def _close_open(self, tags: tuple[str, ...], scope: frozenset) -> None:
        depth = self._deepest(tags)
        if depth >= 0 and depth > self._deepest(scope):
            while len(self._open) > depth:
                self._close()

    def _end(self, tag: str) -> None:
        depth = self._deepest((tag,))
        # A stray end tag doesn't reach out of an article, a cell and the like.
        if depth >= 0 and (tag in _REACHING or depth >= self._deepest(_BARRIERS)):
            while len(self._open) > depth:
                self._close()

    def _tag_end(self, source: str, at: int) -> int:
        """Where the tag at ``at`` ends; a > inside quotes doesn't end it, unless the quotes or the tag never end."""
        while True:
            found = _QUOTE_OR_END.search(source, at)
            if not found:
                return -1
            if found[0] == ">":
                return found.start()
            closing = self._next(source, found[0], found.end())
            if closing < 0 or closing > self._last_end:
                return source.find(">", found.end())
            at = closing + 1

    def _next(self, source: str, quote: str, at: int) -> int:
        """The next such quote; looked for once, however many tags ask for it."""
        known = self._quotes[quote]
        if 0 <= known < at:
            known = self._quotes[quote] = source.find(quote, at)
        return known

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        self._quotes, self._last_end = {q: source.find(q) for q in "\"'"}, source.rfind(">")
        while at < n:
            found = _TAG.search(source, at)
            if not found:
                self._text(source[at:])
                return
            here = found.start()
            self._text(source[at:here])
            if found[0] == "<!--":
                stop = source.find("-->", here + 4)
                at = n if stop < 0 else stop + 3
                continue
            stop = self._tag_end(source, here)
            if stop < 0:
                return  # the page is cut off inside a tag
            at = stop + 1
            if found[0][1] in "!?":
                continue
            closing = found[0][1] == "/"
            name = _NAME.match(source, here + 1 + closing)
            tag = name[0].lower()
            if closing:
                self._end(tag)
                continue
            self._start(tag, source[name.end() : stop])
            if tag in RAW and source[stop - 1] != "/":
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                if tag == "title":
                    self._text(source[at : end.start() if end else n])
                at = end.start() if end else n

    def hashes(self) -> list[int]:
        """Each element's subtree hash."""
        found: list[int] = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):  # children come after their parent
            h = xxhash.xxh3_64(self.tags[i])
            for k in ("class", "id", "role"):
                h.update(f"\0{k}={self.attributes[i].get(k, '')}")
            for part in self.parts[i]:
                h.update(b"\1" + found[part].to_bytes(8, "little") if isinstance(part, int) else b"\2" + part.encode("utf-8", "surrogatepass"))
            found[i] = h.intdigest()
        return found

    def inside_main(self) -> list[bool]:
        """Whether each element is an <article> or <main> or inside one."""
        if self._inside is None:
            inside: list[bool] = []
            for i, tag in enumerate(self.tags):
                inside.append(tag in ("article", "main") or (self.parents[i] >= 0 and inside[self.parents[i]]))
            self._inside = inside
        return self._inside

    def scoped(self, inside: list[bool]) -> bool:
        """Whether there is exactly one outermost <article> or <main>, those in marked elements aside."""
        skipped: list[bool] = []
        count = 0
        for i, up in enumerate(self.parents):
            skipped.append((up >= 0 and skipped[up]) or self.marked(i, inside[i]))
            count += inside[i] and not (up >= 0 and inside[up]) and not skipped[i]
        return count == 1

    def holders(self) -> list[bool]:
        """Whether each element holds every <article> and <main> of the page, and half of its text.

        Those in skipped tags count only if there are no others.
        """
        if self._holders is None:
            self._holders = self._holding(SKIPPED)
            if not any(self._holders):
                self._holders = self._holding(SKIPPED - AROUND)
        return self._holders

    def _holding(self, skip: frozenset) -> list[bool]:
        n = len(self.tags)
        skipped, held, sizes, worded, count, total = [False] * n, [0] * n, [0] * n, [0] * n, 0, 0
        for i, (tag, up) in enumerate(zip(self.tags, self.parents)):
            skipped[i] = (up >= 0 and skipped[up]) or tag in skip
            if not skipped[i]:
                held[i] = int(tag in ("article", "main"))
                worded[i] = int(tag in ("p", "h1"))
                sizes[i] = sum(len(p) for p in self.parts[i] if isinstance(p, str))
                count, total = count + held[i], total + sizes[i]
        paragraphs = sum(worded)
        for i in range(n - 1, 0, -1):  # children come after their parent
            if (up := self.parents[i]) >= 0:
                held[up] += held[i]
                sizes[up] += sizes[i]
                worded[up] += worded[i]
        if count or "form" in skip:
            return [0 < count == h and 2 * size >= total for h, size in zip(held, sizes)]
        return [t == "form" and 0 < paragraphs < 2 * w and 2 * size >= total for t, w, size in zip(self.tags, worded, sizes)]

    def marked(self, i: int, inside: bool) -> bool:
        """Whether markup alone says that element i is not main text."""
        tag, own = self.tags[i], self.attributes[i]
        if tag in SKIPPED or own.get("role") in SKIPPED_ROLES or (tag == "header" and not inside):
            return (tag in SKIPPED and tag not in AROUND) or not self.holders()[i]
        up = self.parents[i]
        if not own or not (tag in CONTAINERS or (tag in ("article", "li") and up >= 0 and self.inside_main()[up])):
            return False
        if tag in ("table", "figure") and inside:
            return False
        return any(map(_names_other, f"{own.get('class', '')} {own.get('id', '')}".split())) and not self.holders()[i]

    def deletable(self, inside: list[bool]) -> list[bool]:
        """Whether each element may be deleted as template."""
        n = len(self.tags)
        worded, sizes = [False] * n, [0] * n
        for i in range(n - 1, -1, -1):  # children come after their parent
            for part in self.parts[i]:
                if isinstance(part, int):
                    sizes[i] += sizes[part]
                else:
                    sizes[i] += len(part)
                    worded[i] = worded[i] or _WORD.search(part) is not None
        found: list[bool] = []
        in_sentence, article = [False] * n, [-1] * n  # article: the outermost <article> or <main> around it
        for i, tag in enumerate(self.tags):
            up = self.parents[i]
            if up >= 0:
                in_sentence[i] = tag not in BLOCKS and (worded[up] or in_sentence[up])
                article[i] = article[up]
            if article[i] < 0 and inside[i]:
                article[i] = i
            if inside[i]:
                found.append(tag in WRAPPERS and not worded[i] and 2 * sizes[i] <= sizes[article[i]])
            else:
                found.append(tag not in KEPT and tag not in VOID and not in_sentence[i])
        return found

    def _counted(self, inside: list[bool]) -> list[int]:
        """The hashes that recurrence is told by."""
        return [h ^ _INSIDE if within else h for h, within in zip(self.hashes(), inside)]

    def template_hashes(self) -> dict[int, bool]:
        """The hash of each subtree that may be template, and whether it is inside an article."""
        inside = self.inside_main()
        hashes, deletable = self._counted(inside), self.deletable(inside)
        return {hashes[i]: inside[i] for i in range(len(self.tags)) if self.tags[i] not in RAW and self.parts[i] and deletable[i]}

    def copy_of(self) -> int:
        """A hash of the text before any template is deleted: copies of a page share it, whatever markup is around."""
        return xxhash.xxh3_64_intdigest(self.main_text(frozenset()).encode("utf-8", "surrogatepass"))

    def main_text(self, recurring) -> str:
        """The text of the blocks that are left without elements whose hash is in ``recurring``."""
        inside = self.inside_main()
        hashes, deletable = (self._counted(inside), self.deletable(inside)) if recurring else ([], [])
        scoped, depth_inside = self.scoped(inside), False
        blocks, current, skipping = [], [], 0

        def flush():
            line = " ".join("".join(current).split())
            current.clear()
            if line:
                blocks.append(line)

        for event in self.events:
            if isinstance(event, str):
                if not skipping and (not scoped or depth_inside):
                    current.append(event)
                continue
            i = event if event >= 0 else ~event
            depth_inside = inside[i] if event >= 0 else (self.parents[i] >= 0 and inside[self.parents[i]])
            if event >= 0:
                if skipping or self.marked(i, inside[i]) or (recurring and deletable[i] and hashes[i] in recurring):
                    skipping += 1
            if self.tags[i] in BLOCKS:
                flush()
            elif self.tags[i] == "br" and not skipping:
                current.append(" ")
            if event < 0 and skipping:
                skipping -= 1
        flush()
        return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"host": pa.int64(), "page": pa.int64(), "copy": pa.int64(), "subtree": pa.int64(), "inside": pa.bool_()}
    for batch in batches:
        rows: list[tuple] = []
        for host, page, source in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            parsed = Page(source or "")
            copy = _signed(parsed.copy_of())
            # Without a subtree: the page itself, for the numbers of the host's pages and of those with an article.
            rows += [(host, page, copy, None, within) for within in {False, any(parsed.inside_main())}]
            rows += [(host, page, copy, _signed(h), within) for h, within in parsed.template_hashes().items()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], names=list(kinds))


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (a hash) and page (a hash of url and html: equal pages are treated alike)."""
    source = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", source.alias("html"), F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64(host_of(F.col("url")), source).alias("page"))


def recurring_subtrees(keyed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(recurring, occurrences): (host, subtree) on many different pages of a host; and (host, page, subtree) of all."""
    occurrences = keyed.select("host", "page", "html").mapInArrow(_subtrees, "host long, page long, copy long, subtree long, inside boolean")
    different = occurrences.select("host", "subtree", "inside", "copy").distinct().groupBy("host", "subtree", "inside").agg(F.count(F.lit(1)).alias("n"))
    counted = write_table(different.where((F.col("n") >= min_pages) | F.col("subtree").isNull()), "counted-subtrees")
    sizes = counted.where("subtree IS NULL").select("host", "inside", F.col("n").alias("pages"))
    share = F.when(F.col("inside"), F.lit(max(min_share, INSIDE_SHARE))).otherwise(F.lit(min_share))
    recurring = counted.where("subtree IS NOT NULL").join(sizes, ["host", "inside"]).where(F.col("n") >= F.col("pages") * share)
    return recurring.select("host", "subtree"), occurrences.where("subtree IS NOT NULL").select("host", "page", "subtree")


def _texts(recurring_of):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            texts = []
            for k in range(batch.num_rows):
                texts.append(Page(columns["html"][k].as_py() or "").main_text(recurring_of(columns, k)))
            yield pa.RecordBatch.from_arrays([columns["page_id"], columns["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


class _Broadcast:
    """Looks a page's subtrees up among the broadcast (host, subtree) pairs: two arrays, sorted by both."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, columns, k):
        hosts, subtrees = self.shared.value
        host = columns["host"][k].as_py()
        low, high = np.searchsorted(hosts, host), np.searchsorted(hosts, host, side="right")
        return _Among(subtrees[low:high]) if high > low else frozenset()

    def __reduce__(self):
        return _Broadcast, (self.shared,)


class _Among:
    """Membership in a sorted array of signed hashes."""

    def __init__(self, held: np.ndarray):
        self.held = held

    def __contains__(self, h: int) -> bool:
        h = _signed(h)
        at = int(np.searchsorted(self.held, h))
        return at < len(self.held) and int(self.held[at]) == h


def _sorted_pairs(recurring: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    hosts, subtrees = array("q"), array("q")
    for row in recurring.toLocalIterator():
        hosts.append(row.host)
        subtrees.append(row.subtree)
    hosts, subtrees = np.array(hosts, np.int64), np.array(subtrees, np.int64)
    order = np.lexsort((subtrees, hosts))
    return hosts[order], subtrees[order]


def _joined(columns, k):
    return frozenset(x % (1 << 64) for x in columns["recurring"][k].as_py() or ())


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of ``pages``.

    Blocks are joined by newlines, white space inside a block is one space, character references
    are decoded. A null or empty html gives an empty text. Pages without a host in their URL (null
    included) share one. Repeated rows and copies of a page count once and are all returned; null
    ids are kept. Other columns are not looked at; an empty table gives an empty result. Work is linear
    in a page's length, and depth is not limited (nothing recurses).
    """
    keyed = _keyed(pages)
    recurring, occurrences = recurring_subtrees(keyed, min_pages, min_share)
    recurring = write_table(recurring, "recurring-subtrees")
    kind = "page_id long, url string, text string, n_chars long"
    ready = keyed.withColumn("page_id", F.col("page_id").cast("long"))
    if recurring.count() <= broadcast_rows:
        shared = pages.sparkSession.sparkContext.broadcast(_sorted_pairs(recurring))
        return ready.select("page_id", "url", "html", "host").mapInArrow(_texts(_Broadcast(shared)), kind)
    of_page = occurrences.join(recurring, ["host", "subtree"], "left_semi").groupBy(F.col("page").alias("p")).agg(F.collect_set("subtree").alias("recurring"))
    return ready.join(of_page, F.col("page") == F.col("p"), "left").select("page_id", "url", "html", "recurring").mapInArrow(_texts(_joined), kind)
