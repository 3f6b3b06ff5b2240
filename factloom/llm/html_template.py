"""HTML main text by equivalence-class template deduction over the pages of a host.

1. A page is cut into tokens: structural elements, named by a hash of their path of tags, classes
   and ids, and text blocks, named by path and text. A token's occurrence vector says how often each
   of the host's pages holds it.
2. Tokens with equal vectors form an equivalence class. Vectors are never gathered: each page adds
   a hash of (page, count) to its token's sum, and equal sums over equal supports stand for equal
   vectors, so a host's pages may lie on any number of machines. Pages of a host with the same text
   in their main slots count as one page: copies of an article are articles, not template.
3. A class is valid if it occurs on at least ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's
   pages and has a structural token; its text tokens are the template's constant texts. At most
   (mean tokens a page) / ``MIN_SHARE`` tokens of a host can be valid, which bounds the template.
4. Structural tokens of valid classes that a page has once are the template's frame. They nest by
   path: a token's parent is the nearest one that encloses it. What a frame element holds besides
   constant texts is a slot, and its mass is the mean number of words outside links in it. From the
   root, the template is followed into an element that holds ``DOMINANT`` of its parent's mass on the
   pages that have it and leaves no varying heading outside: this is the way to the article's slot.
   Layouts with frames of their own each have a way. An article or main element ends it.
5. On each page the text of the innermost element on the way remains, less constant texts and what
   stands in menus, headers, footers, asides, forms and the like. A page of which nothing would
   remain keeps its slots.

Words in classes and ids (advert, comments, related and so on) tell apart what varies like an
article but is none, such as reader comments: they count for containers, never for paragraphs,
headings or list items; inline elements go only as adverts or hidden text. Hosts with too few pages
for a template, pages without a url and pages off every way take the article or main elements, or
else all that is no menu, header, footer, aside or form.

Defined cases: null or empty html gives an empty text; cut-off tags, comments and scripts end at the
page's end and are no text; elements nest to any depth; repeated rows get repeated results; an empty
table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table

MIN_PAGES = 4
MIN_SHARE = 0.1
#: Share of its parent's mass that the way to the article's slot needs.
DOMINANT = 0.8
#: Mean count on its pages up to which an element is one of the frame.
ONCE = 1.2
#: Elements whose content is never text.
RAW = frozenset("script style noscript template iframe svg object textarea title head".split())
#: Elements that hold menus, notices, forms and the like.
ASIDE = frozenset("nav header footer aside form menu dialog button select option fieldset figure audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that starts closes these open ones if they are innermost.
CLOSES = {
    **dict.fromkeys("p div ul ol dl li table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote hr figure address".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "tbody": ("thead", "tr", "td", "th"), "option": ("option",), "body": ("head", "title"),
}
MAIN = frozenset(("article", "main"))
#: Blocks that no class word takes away.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote body html article main".split())
HEADINGS = frozenset(("h1", "h2"))
#: Words in a class, id or role that mark a container as no part of the article, and an inline element as none.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|cookies?|consent|"
    r"notices?|alert|popup|modal|overlay|comments?|respond|reply|replies|discussion|disqus|related|recommend\w*|share|sharing|social|subscribe|newsletter|"
    r"signup|login|search|widget|toolbar|pagination|pager|tags?|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: Inside an article only what readers and advertisers add, and what asks for something, is none of it.
MARKED_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|popup|modal|overlay|comments?|respond|reply|replies|disqus|related|recommend\w*|"
    r"share|sharing|social|subscribe|newsletter|signup|login|hidden)(?:$|[\s_-])",
    re.I,
)
MARKED_INLINE = re.compile(r"(?:^|[\s_-])(?:ads?|adsbygoogle|advert\w*|sponsored|hidden|sr-only|screen-reader-text)(?:$|[\s_-])", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ROLE_MAIN = re.compile(r"(?:^|[\s_-])(?:main|articlebody|article-body|post-content|entry-content)(?:$|[\s_-])", re.I)
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Stands for a token that every page has.
EVERY = 0


class Block(NamedTuple):
    """A text with its innermost element, and that element's place among the page's."""

    path: int
    text: str
    main: bool
    aside: bool
    way: int
    element: int
    linked: int


class Element(NamedTuple):
    path: int
    parent: int
    tag: str
    main: bool
    aside: bool


class _Open(NamedTuple):
    tag: str
    path: int
    main: bool
    aside: bool
    raw: bool
    way: int
    element: int


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) - 2**63


def parse(page: str | None, way: frozenset[int] | set[int] = frozenset()) -> tuple[list[Element], list[Block]]:
    """Structural elements in page order, and the text blocks; a block's ``way`` is how many elements of ``way`` enclose it."""
    source = page or ""
    stack = [_Open("", 1, False, False, False, 0, -1)]
    open_tags: Counter = Counter()
    elements: list[Element] = []
    blocks: list[Block] = []
    held: list[str] = []
    links, skipped, linked = 0, [], 0  # open links, open inline elements that are left out, characters in links
    at, end = 0, len(source)

    def take(text: str) -> None:
        nonlocal linked
        if not skipped:
            held.append(text)
            linked += len(text) if links else 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(held)).split())
        top = stack[-1]
        if text and not top.raw:
            blocks.append(Block(top.path, text, top.main, top.aside, top.way, top.element, min(linked, len(text))))
        held.clear()
        linked = 0

    while at < end:
        found = PIECE.search(source, at)
        if not found:
            take(source[at:])
            break
        take(source[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, closing, attributes = found[2].lower(), found[1], found[3]
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        unseen = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(named.get("style", "")))
        marks = " ".join(named.get(k, "") for k in ("class", "id", "role")).strip()
        if tag in INLINE:
            if tag == "br":
                take(" ")
            elif tag not in VOID:
                links = max(links + (-1 if closing else 1), 0) if tag == "a" else links
                if not closing and (skipped or unseen or (marks and MARKED_INLINE.search(marks))):
                    skipped.append(tag)
                elif closing and tag in skipped:
                    while skipped.pop() != tag:
                        pass
            continue
        skipped.clear()
        flush()
        if closing:
            if open_tags[tag]:
                while True:
                    left = stack.pop().tag
                    open_tags[left] -= 1
                    if left == tag:
                        break
            continue
        while stack[-1].tag in CLOSES.get(tag, ()):
            open_tags[stack.pop().tag] -= 1
        top = stack[-1]
        main = tag in MAIN or bool(ROLE_MAIN.search(" ".join((marks, named.get("itemprop", "")))))
        # The header of an article is part of it; an article inside a sidebar or comment list isn't.
        marked = bool(marks) and not main and tag not in PLAIN and bool((MARKED_INSIDE if top.main else MARKED).search(marks))
        aside = top.aside or unseen or marked or (tag in ASIDE and not (tag in ("header", "figure") and top.main))
        path = _hash(top.path, tag, *sorted(marks.split()))
        elements.append(Element(path, top.path, tag, main and not aside, aside))
        if tag in VOID:
            continue
        if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        stack.append(_Open(tag, path, top.main or (main and not aside), aside, top.raw or tag in RAW, top.way + (path in way), len(elements) - 1))
        open_tags[tag] += 1
    skipped.clear()
    flush()
    return elements, blocks


def text_token(block: Block) -> int:
    return _hash("t", block.path, block.text)


def main_slots(blocks: list[Block]) -> list[Block]:
    """The blocks that may be the page's text: those in an article or main element if there are any."""
    slots = [b for b in blocks if not b.aside]
    return [b for b in slots if b.main] or slots


class Token(NamedTuple):
    """What a page says of one of its tokens; ``held`` and ``heads`` are words outside links and words of headings within."""

    token: int
    structural: bool
    parent: int
    n: int
    held: int
    heads: int
    main: bool
    aside: bool


def page_tokens(page: str | None) -> tuple[int, list[Token]]:
    """A key of what the page's main slots say, and its tokens."""
    elements, blocks = parse(page)
    key = _hash("k", *[b.text for b in main_slots(blocks)])
    above = _parents(elements)
    held, heads = [0] * len(elements), [0] * len(elements)
    texts: dict[int, Token] = {}
    for b in blocks:
        words = 0 if b.aside else round(len(b.text.split()) * (1 - b.linked / len(b.text)))
        head = words if b.element >= 0 and elements[b.element].tag in HEADINGS else 0
        if b.element >= 0:
            held[b.element] += words
            heads[b.element] += head
        token = text_token(b)
        n = texts[token].n + 1 if token in texts else 1
        texts[token] = Token(token, False, b.path, n, n * words, n * head, b.main, b.aside)
    for i in range(len(elements) - 1, -1, -1):
        if above[i] >= 0:
            held[above[i]] += held[i]
            heads[above[i]] += heads[i]
    frames: dict[int, Token] = {}
    for i, e in enumerate(elements):
        old = frames.get(e.path)
        n, words, head = (old.n, old.held, old.heads) if old else (0, 0, 0)
        frames[e.path] = Token(e.path, True, e.parent, n + 1, words + held[i], head + heads[i], e.main, e.aside)
    return key, [*frames.values(), *texts.values()]


def _parents(elements: list[Element]) -> list[int]:
    """Place of every element's parent among the elements; -1 at the top."""
    last: dict[int, int] = {}
    out = []
    for i, e in enumerate(elements):
        out.append(last.get(e.parent, -1))
        last[e.path] = i
    return out


class Frequent(NamedTuple):
    """A token of a host: its support, its summed occurrence vector and its means over the pages that have it."""

    token: int
    structural: bool
    parent: int
    support: int
    vector: int
    n: float
    held: float
    heads: float
    main: bool
    aside: bool


def nest(tokens: list[Frequent]) -> tuple[dict[int, int], set[int]]:
    """The template of a host: each frame element's parent in the frame (0 at the top), and the constant texts."""
    valid = {(t.support, t.vector) for t in tokens if t.structural}
    texts = {t.token for t in tokens if not t.structural and (t.support, t.vector) in valid}
    by_token = {t.token: t for t in tokens if t.structural}
    frame = {t.token for t in by_token.values() if t.n <= ONCE}
    parents = {}
    for token in frame:
        up = by_token[token].parent
        while up in by_token and up not in frame:
            up = by_token[up].parent
        parents[token] = up if up in frame else 0
    return parents, texts


def way_to_article(tokens: list[Frequent]) -> tuple[set[int], set[int]]:
    """Frame elements on the ways to the article's slot, and the constant texts."""
    parents, texts = nest(tokens)
    by_token = {t.token: t for t in tokens if t.structural}
    held, heads = {t: by_token[t].held for t in parents}, {t: by_token[t].heads for t in parents}
    for t in tokens:  # constant texts are no mass: take them from every frame element around them
        if t.token in texts:
            up = t.parent
            while up in by_token:
                if up in parents:
                    share = t.support / by_token[up].support
                    held[up] -= t.held * share
                    heads[up] -= t.heads * share
                up = by_token[up].parent
    inside: dict[int, list[int]] = {}
    for token, parent in parents.items():
        inside.setdefault(parent, []).append(token)
    way: set[int] = set()
    ahead = list(inside.get(0, ()))
    while ahead:
        token = ahead.pop()
        if by_token[token].aside:
            continue
        way.add(token)
        if not by_token[token].main:
            ahead += [
                c for c in inside.get(token, ())
                if held[c] > 0 and held[c] >= DOMINANT * held[token] and heads[token] - heads[c] < 0.5
            ]
    return way, texts


def main_text(page: str | None, way: frozenset[int] | set[int] = frozenset(), texts: frozenset[int] | set[int] = frozenset()) -> str:
    """What remains on the page's way to the article once the template is taken away."""
    _, blocks = parse(page, way)
    slots = [b for b in blocks if not b.aside]
    inner = max((b.way for b in slots), default=0)
    slots = main_slots([b for b in slots if b.way == inner]) if inner else main_slots(slots)
    varying = [b for b in slots if text_token(b) not in texts]
    return "\n".join(b.text for b in (varying or slots))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"//([^/?#]+)", 1))


def occurrence_sums(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, token, structural, parent, support, vector, n, held, heads, main, aside): summed vectors and means.

    The support of ``EVERY`` is the number of the host's pages that differ in their main slots.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        names = ["host", "page_key", "token", "structural", "parent", "n", "held", "heads", "main", "aside"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for owner, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    key, tokens = page_tokens(page)
                    rows.append((owner, key, EVERY, None, 0, 1, 0, 0, False, False))
                    rows += [(owner, key, *t) for t in tokens]
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    named = pages.select(host(F.col("url")).alias("host"), "html").filter("host != ''")
    tokens = named.mapInArrow(work, "host string, page_key long, token long, structural boolean, parent long, n long, held long, heads long, main boolean, aside boolean")
    once = tokens.groupBy("host", "token", "structural", "page_key").agg(
        *[F.max(c).alias(c) for c in ("parent", "n", "held", "heads")], F.bool_or("main").alias("main"), F.bool_or("aside").alias("aside")
    )
    return (
        once.withColumn("mark", F.shiftrightunsigned(F.xxhash64("page_key", "n"), 1))
        .groupBy("host", "token", "structural")
        .agg(
            F.max("parent").alias("parent"), F.count("*").alias("support"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("vector"),
            *[F.avg(c).alias(c) for c in ("n", "held", "heads")], F.bool_or("main").alias("main"), F.bool_or("aside").alias("aside"),
        )
        .filter(F.col("support") >= min_pages)
    )


def templates(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, way, texts): the ways to the article's slot and the constant texts of every host with enough pages."""
    sums = materialise(occurrence_sums(pages, min_pages), "host-tokens")
    sizes = sums.filter("structural is null").select("host", F.col("support").alias("pages"))
    frequent = sums.filter("structural is not null").join(sizes, "host").filter(F.col("support") >= F.col("pages") * min_share)
    # A text that no structural token's class holds can't be template.
    frames = frequent.filter("structural").select("host", "support", "vector").distinct()
    texts = frequent.filter("not structural").join(frames, ["host", "support", "vector"], "left_semi")
    fields = list(Frequent._fields)
    valid = frequent.filter("structural").select("host", *fields).unionByName(texts.select("host", *fields))
    hosts = valid.withColumn("vector", F.col("vector").cast("string")).groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("tokens"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [way_to_article([Frequent(**t) for t in tokens]) for tokens in batch.column(1).to_pylist()]
            ids = [pa.array([sorted(m[k]) for m in made], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ids], names=["host", "way", "texts"])

    return hosts.mapInArrow(work, "host string, way array<long>, texts array<long>")


def extract_main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html)."""
    # Written first: its size is then known, and only a small table is sent to all tasks.
    known = materialise(templates(pages, min_pages=min_pages, min_share=min_share), "host-templates")
    kind = dict(pages.dtypes)["page_id"]
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(known, "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = zip(*[part.column(i).to_pylist() for i in (2, 3, 4)], strict=True)
                texts = [main_text(page, set(way or ()), set(constant or ())) for page, way, constant in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return joined.select("page_id", "url", "html", "way", "texts").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_template(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
