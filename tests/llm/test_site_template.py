import random
from html import parser as html_parser

import pytest

from chronoloom.llm import site_template as stp


def text(html, recurring=frozenset()):
    return stp.Page(html).main_text(recurring)


CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a  b\n c</p><p>d</p>", "a b c\nd"),
    ("<article><h1>T</h1><p><b>bold<br><p>next</article><footer>f</footer>", "T\nbold\nnext"),
    ("<nav>n</nav><header>h</header><div class='ad'>x</div><aside>s</aside><p>t</p><form><p>q</p></form>", "t"),
    ('<script>var t="</p>";if(a<b){}</script><style>p{}</style><p>x</p>', "x"),
    ("<article><p>a</p><div class='reader-comments'><p>c</p></div><p>b</p></article><p>outside</p>", "a\nb"),
    ("<p>cut &am", "cut &am"),
    ("<p>cut <a href='x", "cut"),
    ("<p>a<!-- <p>no</p> -->b</p>", "ab"),
    ("<p title='1 > 2'>x</p>", "x"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("<article><p class='notice'>kept</p></article>", "kept"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("&lt;p&gt; &#233; &eacute; &nbsp; x", "<p> é é x"),
    ("<div id=cookie-banner>We use cookies</div><main><div><p>m</p></div></main>", "m"),
    ("</p></div><b>x", "x"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_main_text(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert text("<p>word</p>" * 20_000).count("\n") == 19_999
    assert text("<a href=\"" * 5_000 + "x") is not None


def site(rng, host, n, template):
    words = lambda k: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(k))
    pages = []
    for i in range(n):
        body = [words(12), words(20)]
        html = f"<html><body><div class='top'><p>{template} top</p></div><div>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div><span>{template} bottom</span></div></body></html>"
        pages.append((f"https://{host}/{i}", html, "\n".join(body)))
    return pages


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    rows = site(rng, "a.example", 60, "Site A") + site(rng, "b.example", 30, "Site B") + [(u, h, t) for u, h, t in site(rng, "c.example", 3, "Rare")]
    shared = "the same passage in every article"
    for i in range(40):
        own = f"article {i} of d"
        rows.append((f"https://d.example/{i}", f"<article><div><p>follow us</p></div><p>{own}</p><p>{shared}</p></article>", f"{own}\n{shared}"))
    rows += [(None, None, ""), (None, "", ""), ("no host", "<p>x</p>", "x")]
    want = {i: t for i, (_, _, t) in enumerate(rows)}
    for i, (u, h, t) in enumerate(rows):
        if u and "c.example" in u:  # too few pages to tell a template
            want[i] = f"Rare top\n{t}\nRare bottom"
    pages = spark.createDataFrame([(i, u, h, "clash", 1) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string, text string, host int")
    return pages, want


@pytest.mark.parametrize("broadcast_rows", [stp.BROADCAST_ROWS, 0])
def test_templates_go_by_either_path(case, broadcast_rows):
    pages, want = case
    rows = stp.main_text(pages, broadcast_rows=broadcast_rows).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "https://x.example", "<p>same</p>")] * 3 + [(None, "https://x.example", "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text) for r in stp.main_text(pages).collect()) == [("1", "same")] * 3 + [("None", "y")]
    assert stp.main_text(pages.limit(0)).count() == 0


def texts_of(spark, rows):
    pages = spark.createDataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in stp.main_text(pages).orderBy("page_id").collect()]


def test_copies_of_a_page_are_no_template(spark):
    bare = "<body><h1>Title</h1><div><p>one</p><p>two</p></div></body>"
    copied = "<article><h1>T</h1><div><p>body</p></div><ul><li>a</li></ul><table><tr><td>cell</td></tr></table></article>"
    own = [f"<body><div><p>own text {i}</p></div></body>" for i in range(5)]
    found = texts_of(spark, [bare] * 12 + own + [f"<nav>at {i}</nav><div class='c{i}'>{copied}</div>" for i in range(12)])
    assert found[:17] == ["Title\none\ntwo"] * 12 + [f"own text {i}" for i in range(5)]
    assert found[17:] == ["T\nbody\na\ncell"] * 12


def test_what_recurs_inside_sentences_and_articles_stays(spark):
    rows = [f"<article><p>Page {i} names <span>Acme</span> here</p><div><p>{'shared words ' * 4}</p></div><ul><li>same</li></ul><div>said {'alike'}</div></article>" for i in range(12)]
    rows += [f"<p>Bare {i} has <b>bold</b> words</p>" for i in range(12)]
    rows += [f"<article><p>{'another text ' * 9} {i}</p></article>" for i in range(20)]
    found = texts_of(spark, rows)
    assert found[:12] == [f"Page {i} names Acme here\n{('shared words ' * 4).strip()}\nsame\nsaid alike" for i in range(12)]
    assert found[12:24] == [f"Bare {i} has bold words" for i in range(12)]


@pytest.mark.parametrize("html,want", [
    ("<!DOCTYPE html>\n<html><body><article><p>a</p></article></body></html>", "a"),
    ("\n\n<main><p>m</p></main>", "m"),
    ("stray<article><p>a</p></article>", "a"),
    ("<div><p>the body</p></div><article><p>card 1</p></article><article><p>card 2</p></article>", "the body\ncard 1\ncard 2"),
    ("<div><p>the body</p></div><aside><article><p>card</p></article></aside>", "the body"),
    ("<main><article><p>a</p></article><article><p>b</p></article></main><p>outside</p>", "a\nb"),
])
def test_only_a_single_article_is_the_scope(html, want):
    assert text(html) == want


def test_template_removal_decides_outside_of_several_articles(spark):
    rows = [f"<div><p>Follow us all</p></div><div><p>body {i}</p></div><article><p>card {i}</p></article><article><p>card {i + 1}</p></article>" for i in range(12)]
    assert texts_of(spark, rows) == [f"body {i}\ncard {i}\ncard {i + 1}" for i in range(12)]


@pytest.mark.parametrize("html,want", [
    ('<!doctype html>\n<html><body><article><p>x</p></article></body></html>', "x"),
    ('hello <article><p>x</p></article>', "x"),
    ('<div class="layout has-sidebar"><article><p>x y</p></article></div>', "x y"),
    ('<div class="sidebar"><article><p>all the text there is</p></article></div><p>q</p>', "all the text there is"),
    ('<main><div class="post comments-open"><p>x</p></div></main>', "x"),
    ('<main><div class="post no-comments"><p>x</p></div><div class="ad-box-2">buy</div><div id="comment-list">c</div></main>', "x"),
    ('<div><p>a long body of text</p></div><div class="comments"><article>c 1</article><article>c 2</article></div>', "a long body of text"),
    ('<article><p>x</p><article class="comment"><p>c</p></article><ul><li class="comment">d</li><li>e</li></ul></article>', "x\ne"),
    ('<article class="ad"><p>a lone article is never an advert</p></article>', "a lone article is never an advert"),
    ('<p>a<b class="ad">b</b></p>', "ab"),
])
def test_marks_are_whole_names_and_spare_the_article(html, want):
    assert text(html) == want


def seconds(html):
    import time

    began = time.perf_counter()
    text(html)
    return time.perf_counter() - began


@pytest.mark.parametrize("page", [
    lambda n: "<b>" * n + "</i>" * n,
    lambda n: "<b>" * n + "<hr>" * n,
    lambda n: "<p><section>" + "<b>" * n + "<hr>" * n,
    lambda n: "<article>" + "<b>" * n + "</p>" * n,
    lambda n: "<a x='>" * n + ">",
    lambda n: '<a x="y>' * n,
    lambda n: "<a x='\"'>" * n + '"',
    lambda n: "<a '>" + '<a ">' * n + "'",
    lambda n: "<article class='comment'>" * n,
    lambda n: "<div class='sidebar'>" * n + "<article>x",
])
def test_time_is_linear_in_a_page(page):
    seconds(page(2000))
    assert seconds(page(40_000)) < 40 * max(seconds(page(4_000)), 0.01)


class Outline(html_parser.HTMLParser):
    """An independent parser of well-formed pages: a tree of (tag, class, children), texts as strings."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ("", "", [])
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs).get("class") or "", [])
        self.stack[-1][2].append(node)
        if tag != "br":
            self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def plain_lines(node, gone, inside, lines):
    """Text blocks of a tree without what ``gone(node, inside)`` says."""
    tag, _, children = node
    for child in children:
        if isinstance(child, str):
            lines[-1] += child
            continue
        if gone(child, inside):
            if child[0] != "span":
                lines.append("")
            continue
        if child[0] == "br":
            lines[-1] += " "
        elif child[0] in ("span", "b"):
            plain_lines(child, gone, inside or child[0] == "article", lines)
        else:
            lines.append("")
            plain_lines(child, gone, inside or child[0] == "article", lines)
            lines.append("")
    return lines


def plain_text(node, gone):
    return "\n".join(filter(None, (" ".join(x.split()) for x in plain_lines(node, gone, False, [""]))))


def plain_pages(rows, min_pages, min_share):
    """Recurring subtrees outside articles, counted per host over pages of different text, and the texts without them."""
    marked = lambda node, inside: node[0] in ("nav", "footer", "script") or node[1] == "ad"
    trees = [Outline(h).root for _, h in rows]
    copies = [plain_text(t, marked) for t in trees]
    hosts = [u.split("/")[2] for u, _ in rows]

    def walk(node, inside, in_sentence):
        for child in node[2]:
            if isinstance(child, str):
                continue
            own_inside = inside or child[0] == "article"
            worded = any(isinstance(c, str) and c.strip() for c in node[2])
            sentence = child[0] in ("span", "b", "br") and (worded or in_sentence)
            if not own_inside and child[0] not in ("html", "body", "br") and not sentence and any(not isinstance(c, str) or c.strip() for c in child[2]):
                yield repr(child)
            yield from walk(child, own_inside, sentence)

    seen, pages = {}, {}
    for host, copy, tree in zip(hosts, copies, trees):
        pages.setdefault(host, set()).add(copy)
        for key in walk(tree, False, False):
            seen.setdefault((host, key), set()).add(copy)
    out = []
    for host, tree in zip(hosts, trees):
        many = lambda node: len(seen.get((host, repr(node)), ())) >= max(min_pages, min_share * len(pages[host]))  # noqa: B023, E731
        out.append(plain_text(tree, lambda node, inside: marked(node, inside) or (not inside and node[0] not in ("html", "body", "br") and many(node))))
    return out


@pytest.fixture(scope="module")
def generated():
    rng = random.Random(12)
    words = lambda k: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 7))) for _ in range(k))
    rows = []
    for host in ("one.example", "two.example", "small.example"):
        top, side, rare, foot = words(3), [words(2) for _ in range(4)], words(4), words(5)
        for n in range({"one.example": 60, "two.example": 25, "small.example": 6}[host]):
            menu = "".join(f"<li>{x}</li>" for x in rng.sample(side, 3))
            parts = [f"<div><p>{top}</p></div>", f"<ul>{menu}</ul>", f"<div class='ad'>{words(3)}</div>", f"<div class='body'><h2>{words(2)}</h2>" + "".join(f"<p>{words(8)} <b>{rng.choice(side)}</b> {words(3)}</p>" for _ in range(3)) + "</div>"]
            if rng.random() < 0.15:
                parts.append(f"<section><p>{rare}</p></section>")
            parts.append(f"<section><span>{foot}</span></section><footer>{words(3)}</footer>")
            rows.append((f"https://{host}/{n}", f"<html><body>{''.join(parts)}</body></html>"))
            if rng.random() < 0.1:
                rows += [(f"https://{host}/{n}/copy{k}", rows[-1][1]) for k in range(12)]
    return rows


def test_equals_brute_force_on_generated_sites(spark, generated):
    got = main_texts(spark, generated)
    assert got == plain_pages(generated, stp.MIN_PAGES, stp.MIN_SHARE)
    # Without template removal most pages have another text: the counts decide.
    off = main_texts(spark, generated, min_pages=10**9)
    assert off == plain_pages(generated, 10**9, stp.MIN_SHARE)
    assert sum(a != b for a, b in zip(got, off)) > 0.8 * len(generated)


def main_texts(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in stp.main_text(pages, **options).orderBy("page_id").collect()]


WORDS = "<h1>Title</h1><p>What the author wrote about the river and the town, at length.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm"><div>Menu</div><article>{WORDS}</article><input></form></body>',
        f'<body><div role="form"><article>{WORDS}</article></div></body>',
        f'<body><div role="dialog"><article>{WORDS}</article></div></body>',
        f"<body><header><nav>Menu</nav><article>{WORDS}</article></header></body>",
        f"<body><nav><a>Home</a><article>{WORDS}</article><footer>Imprint</footer></body>",
        f"<body><aside><main>{WORDS}</main></aside></body>",
        f'<body><form id="whole"><div>{WORDS}</div></form><nav>Menu</nav></body>',
    ],
)
def test_what_is_around_the_whole_page_stays(page):
    text = stp.Page(page).main_text(frozenset())
    assert text == "Title\nWhat the author wrote about the river and the town, at length."


def test_tables_of_an_article_are_its_own():
    page = f'<article>{WORDS}<table class="menu"><tr><td>Soup</td><td>3</td></tr></table><figure class="widget"><figcaption>A soup</figcaption></figure><ul class="share"><li>Post it</li></ul></article>'
    assert stp.Page(page).main_text(frozenset()).split("\n")[2:] == ["Soup", "3", "A soup"]


def test_forms_and_asides_beside_the_article_go():
    page = f"<body><form>Search <p>here</p></form><article>{WORDS}</article><aside><article>Teaser</article></aside><dialog>{WORDS}{WORDS}</dialog></body>"
    assert stp.Page(page).main_text(frozenset()).count("\n") == 1
    assert stp.Page("<body><p>One</p><form><p>Name</p></form><p>Two</p></body>").main_text(frozenset()) == "One\nTwo"
