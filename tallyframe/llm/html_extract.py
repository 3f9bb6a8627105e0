"""Main text of web pages by deducing the templates of their hosts.

A page is a sequence of tokens: tags, and on pages without an article whole text blocks. A tag token is a
tag with its class, id and role in the container it stands in, so equal tags with different roles are
different tokens; a text token is a block's words in its container. The occurrence
vector of a token holds how often it occurs on each page of a host; hashes of every (page, count) are added up, so equal vectors
have equal fingerprints, and fingerprints of parts of a host are merged without collecting its
pages. Tokens of a host with equal vectors on enough pages form an
equivalence class. A class is valid on a page where its tag tokens come in
the class's order, again and again; others are ignored there. Classes nest: one whose span lies inside that of
another stands in a slot of it, between two of its tokens.

Text tokens of the template, the same words once on each of many pages, are part of it whatever their markup
says; what remains are the slots, the text after the template's tags. Slots are the same on all pages of a
host, and evidence about them is added up over its pages: how much of their text stands in an article, in
boilerplate and in links. On pages with an article, main slots are those with enough text in one, and
their text is extracted without what its own markup shows to be boilerplate. Pages without an article take the slots that are
neither boilerplate nor mostly links; a slot with little text goes the way of the slot that its class nests in. A
page that has nothing but template text is a copy of others and keeps it. A host's pages with and without an article
have a template each, from their own evidence, so neither layout decides about the other. Repeated words in an
article are never dropped: pages may quote each other.

Names mark boilerplate as whole class tokens or whole ids made of known words only, never as words of a
slug; headings and paragraphs aren't marked by ids. A one-word id inside an article may be the slug of a
heading, so it marks its element only if the host's template has that element on several pages. Of articles,
those inside another and those named as comments can be boilerplate.

Defined results: null and empty pages have an empty text; pages without a host (null or odd urls)
are a host of their own; a host of one page has its page's vectors. Repeated rows are pages. White
space inside a block becomes one space, a line break too, and blocks are joined by an empty line. A tag without an end is text; after a
quote that is never closed, tags end at the next >. Pages are scanned once, so time grows with their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrow, written

#: Percent of a host's pages of one layout that a template token occurs on.
LEAST_PAGES = 30
#: Percent of a slot's text that makes it a main slot.
LEAST_MAIN = 5
#: Percent of a slot's text in links that makes it a menu, on pages without an article.
MOST_LINKS = 50
#: Pages that a text must stand on to be part of a template, and letters a page below which a slot has little text.
LEAST_SAME, THIN = 3, 20
#: Tokens that a task holds before it hands their sums on.
HELD_TOKENS = 200_000

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_NAME = re.compile(r"</?[a-zA-Z]")
#: Elements whose content is no markup, and the ends of them; some of them end a block (fixed values).
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe textarea svg select title".split()}
RAW_BLOCKS = frozenset("title iframe textarea select".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Parts of HTML and names that mark what isn't main text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("html head body main article section nav aside header footer div form ul ol dl table blockquote figure dialog".split())
MAIN = frozenset("article main".split())
BOILERPLATE = frozenset("head nav aside footer form button dialog menu object video audio canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer login menu modal nav navbar navigation "
    "newsletter notice notification pager pagination popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
#: Words that stand beside those of NAMES in names of boilerplate, and names of remarks inside an article.
BESIDE = frozenset(
    "area areas article articles bar block blocks body bottom box button buttons center column container content entry feed fixed form global group header icon icons "
    "inner item items latest left link links list lists main media mobile module more outer page panel post posts primary recent right row secondary section site slot "
    "small sticky story stories tertiary thread top unit wrap wrapper".split()
)
REMARKS = frozenset("notice notification".split())
COMMENTS = frozenset("comment commentlist comments replies respond".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
PAGE = 0


class Segment:
    """Text between two tags."""

    __slots__ = ("text", "token", "block", "main", "off", "link", "asked")

    def __init__(self, text: str, token: int, block: int, main: bool, off: bool, link: bool, asked: tuple | None):
        self.text, self.token, self.block, self.main, self.off, self.link, self.asked = text, token, block, main, off, link, asked


def named(name: str) -> bool:
    """Whether a whole class token or id is a name of boilerplate: known words only, and one of NAMES."""
    words = _WORDS.findall(name)
    return not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words)


def attributes(tag: str, text: str, main: bool) -> tuple[str, bool, bool]:
    """The attributes that tell tokens apart, whether they mark boilerplate, and whether they do if the host agrees."""
    if not text or text.isspace():
        return "", False, False
    kept, marked, asked, comment = [], False, False, False
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("hidden", "aria-hidden", "style"):
            marked |= name == "hidden" or (name == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", "")
            continue
        kept.append(f"{name}={re.sub('[0-9]+', '0', value)}")
        if name == "role":
            marked |= not ROLES.isdisjoint(_WORDS.findall(value))
        elif name == "class":
            remarks = REMARKS if main or tag in PARAGRAPHS else ()
            marks = [c for c in value.split() if named(c) and c not in remarks]
            marked |= bool(marks)
            comment |= any(not COMMENTS.isdisjoint(_WORDS.findall(c)) for c in marks)
        elif tag not in PARAGRAPHS and named(value):
            # In an article, a single word may be the slug of a heading.
            marked |= not main or len(_WORDS.findall(value)) > 1
            asked = True
    whole = tag in ("html", "body", "main") or (tag == "article" and not main and not comment)
    return " ".join(kept), marked and not whole, asked and not marked and not whole


def number(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts))) >> 1 or 1


def markup(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, tag, whether it closes, and attributes of each piece of markup, in one scan; no tag: nothing to see."""
    at, quoted = 0, True
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
        elif html.startswith(("<!", "<?"), start):
            if (end := html.find(">", start)) < 0:
                return
            at = end + 1
            yield start, at, "", False, ""
        elif _NAME.match(html, start):
            found = _TAG.match(html, start) if quoted else None
            if not found:
                if (found := _PLAIN_TAG.match(html, start)) is None:
                    return
                quoted = False
            closing, tag, rest = bool(found[1]), found[2].lower(), found[3]
            at = found.end()
            if tag in RAW and not closing:
                if tag != "svg" or not rest.endswith("/"):
                    end = RAW[tag].search(html, at)
                    at = end.end() if end else len(html)
                yield start, at, tag, False, ""
            else:
                yield start, at, tag, closing, rest.removesuffix("/")


class Open:
    """The open elements of a page."""

    def __init__(self) -> None:
        # Tag, container name, in main, boilerplate, chain of tokens that make it boilerplate if the host agrees.
        self.stack: list[tuple[str, str, bool, bool, tuple | None]] = [("", "", False, False, None)]
        self.places: dict[str, list[int]] = {}
        self.containers = [0]

    def push(self, *element) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        if element[0] in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append(element)

    def close(self, tag: str, inside: bool = False) -> None:
        """End the innermost element of this tag and all in it; ``inside``: not beyond the innermost container."""
        places = self.places.get(tag)
        if not places or (inside and places[-1] < self.containers[-1]):
            return
        depth = places[-1]
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()
        while self.containers[-1] >= depth:
            self.containers.pop()


def parse(html: str) -> tuple[list[int], list[Segment]]:
    """The page's tag tokens in order, and its text segments."""
    tokens: list[int] = []
    segments: list[Segment] = []
    opened = Open()
    links = block = 0
    token = PAGE
    at = 0

    def add(text: str) -> None:
        _, _, main, off, asked = opened.stack[-1]
        segments.append(Segment(text, token, block, main, off, links > 0, asked))

    for start, end, tag, closing, rest in markup(html):
        if start > at:
            add(html[at:start])
        at = end
        if not tag or (tag in RAW and not closing):
            block += tag in RAW_BLOCKS
            continue
        _, container, main, off, asked = opened.stack[-1]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                block += 1
            opened.close(tag)
            token = number("/", tag, container)
        else:
            names, marked, ask = attributes(tag, rest, main)
            token = number(tag, names, container)
            if tag == "a":
                links += 1
            if tag == "br":
                add("\n")
            elif tag == "hr":
                block += 1
            elif tag in INLINE:
                # Only those that hide something, and what stands in them, have to be told apart.
                if marked or opened.places.get(tag):
                    opened.push(tag, container, main, off or marked, asked)
            elif tag not in VOID:
                block += 1
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                    opened.close(tag, inside=True)
                    _, container, main, off, asked = opened.stack[-1]
                inner = f"{container[-80:]}>{tag}.{names}" if tag in CONTAINERS else container
                off = off or marked or tag in BOILERPLATE or (tag == "header" and not main)
                opened.push(tag, inner, main or tag in MAIN or "role=main" in names, off, (token, asked) if ask else asked)
        tokens.append(token)
    if len(html) > at:
        add(html[at:])
    return tokens, segments


def agreed(asked: tuple | None, again: set[int], known: dict) -> bool:
    """Whether the host has one of the chain's tokens on several pages; ``known`` keeps what was found."""
    chain = []
    while asked is not None and id(asked) not in known:
        chain.append(asked)
        asked = asked[1]
    found = asked is not None and known[id(asked)]
    for link in reversed(chain):
        found = known[id(link)] = found or link[0] in again
    return found


def joined(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def text_tokens(segments: list[Segment]) -> dict[int, int]:
    """The token of each block with words outside boilerplate: its words, and the tag they follow. Negative, unlike those of tags."""
    blocks: dict[int, list[Segment]] = {}
    for s in segments:
        if not s.off:
            blocks.setdefault(s.block, []).append(s)
    words = ((block, parts[0].token, joined([s.text for s in parts])) for block, parts in blocks.items())
    return {block: -number("#", token, text) for block, token, text in words if text}


def letters(text: str) -> int:
    return len(text) - text.count(" ")


def has_article(segments: list[Segment]) -> bool:
    """Whether a page has text in an article that isn't boilerplate."""
    return any(s.main and not s.off and not s.text.isspace() for s in segments)


def token_sums(pages: DataFrame) -> DataFrame:
    """By host, layout (with an article or not) and token: pages, occurrences, places, fingerprint, and the text that follows."""
    names = ["host", "article", "token", "pages", "times", "places", "lasts", "print", "chars", "main", "off", "links"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool, int], list[int]] = {}
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * (len(names) - 2)]

        def handed() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                tokens, segments = parse(html or "")
                first: dict[int, int] = {}
                for place, token in enumerate(tokens):
                    first.setdefault(token, place)
                last = {token: place for place, token in enumerate(tokens)}
                counts = Counter(tokens)
                counts[PAGE] = 1
                article = has_article(segments)
                if not article:
                    counts.update(text_tokens(segments).values())
                after: dict[int, list[int]] = {}
                for s in segments:
                    size = letters(s.text)
                    sums = after.setdefault(s.token, [0, 0, 0, 0])
                    sums[0] += size
                    sums[1] += size if s.main and not s.off else 0
                    sums[2] += size if s.off else 0
                    sums[3] += size if s.link else 0
                for token, times in counts.items():
                    v = held.setdefault((host, article, token), [0] * 9)
                    v[0] += 1
                    v[1] += times
                    v[2] += first.get(token, -1) + 1
                    v[3] += last.get(token, -1) + 1
                    v[4] = (v[4] + xxhash.xxh3_64_intdigest(f"{page}|{times}")) % (1 << 63)
                    for i, x in enumerate(after.get(token, ()), 5):
                        v[i] += x
            if len(held) > HELD_TOKENS:
                yield handed()
                held.clear()
        if held:
            yield handed()

    sums = map_arrow(pages.select("host", "page", "html"), task, "host string, article boolean, " + ", ".join(f"{n} long" for n in names[2:]))
    total = [F.sum(n).alias(n) for n in names[3:] if n != "print"]
    return sums.groupBy("host", "article", "token").agg(F.xxhash64(F.sum(F.col("print").cast("decimal(38,0)"))).alias("print"), *total)


def templates(sums: DataFrame) -> DataFrame:
    """For each host, the tokens of its templates with their classes, in order (host, article, plain).

    ``article`` is the template of the pages with an article, ``plain`` that of the others. A token is
    (place, last, token, class, main, thin, again): its class is the fingerprint; ``place`` and ``last`` are where it
    comes first and last on a page, on average; ``main`` if the slot after it holds main text; ``thin`` if
    that has little text; ``again`` if it is on several pages. Texts (negative tokens) must stand once on
    each of ``LEAST_SAME`` pages or more. A template has no more tokens than ``100 / LEAST_PAGES`` pages have.
    """
    pages = sums.where(F.col("token") == PAGE).select("host", "article", F.col("pages").alias("all"))
    usual = sums.join(pages, ["host", "article"]).where(100 * F.col("pages") >= LEAST_PAGES * F.col("all"))
    usual = usual.where((F.col("token") >= 0) | ((F.col("pages") >= LEAST_SAME) & (F.col("times") == F.col("pages"))))
    by_article = 100 * F.col("main") >= LEAST_MAIN * F.greatest("chars", F.lit(1))
    by_text = (100 * F.col("links") < MOST_LINKS * F.greatest("chars", F.lit(1))) & (2 * F.col("off") < F.greatest("chars", F.lit(1)))
    token = F.struct(
        (F.col("places") / F.col("pages")).alias("place"),
        (F.col("lasts") / F.col("pages")).alias("last"),
        "token",
        F.col("print").alias("class"),
        F.when(F.col("article"), by_article).otherwise(by_text).alias("main"),
        (F.col("chars") < THIN * F.col("pages")).alias("thin"),
        (F.col("pages") > 1).alias("again"),
    )
    template = lambda of: F.array_sort(F.collect_list(F.when(of, token)))
    return usual.groupBy("host").agg(template(F.col("article")).alias("article"), template(~F.col("article")).alias("plain"))


def valid_tokens(tokens: list[int], template: dict[int, tuple[int, int]], sizes: dict[int, int]) -> set[int]:
    """The template tokens whose classes come in order on a page.

    ``template`` has each token's class and its rank there. On the page, the tokens of a class must
    run through its ranks again and again.
    """
    due: dict[int, int] = {}
    broken: set[int] = set()
    for token in tokens:
        if (place := template.get(token)) is not None:
            kind, rank = place
            if due.get(kind, 0) != rank:
                broken.add(kind)
            due[kind] = (rank + 1) % sizes[kind]
    return {t for t, (kind, _) in template.items() if kind not in broken}


def nested_verdicts(tokens: list[dict]) -> dict[int, bool]:
    """Whether the slot after each tag token is a main one; ``tokens`` are a template's, in order.

    The span of a class reaches from its first token to its last. A slot with little text goes the way of
    the slot it is nested in: that after the latest earlier token of the narrowest class around its own.
    """
    tags = [t for t in tokens if t["token"] >= 0]
    spans: dict[int, tuple[float, float]] = {}
    members: dict[int, list[dict]] = {}
    for t in tags:
        low, high = spans.get(t["class"], (t["place"], t["last"]))
        spans[t["class"]] = (min(low, t["place"]), max(high, t["last"]))
        members.setdefault(t["class"], []).append(t)
    widths = sorted(spans, key=lambda kind: (spans[kind][1] - spans[kind][0], kind))
    outer: dict[int, int] = {}
    for i, kind in enumerate(widths):
        low, high = spans[kind]
        around = (k for k in widths[i + 1 :] if spans[k][0] < low and high < spans[k][1])
        outer[kind] = next(around, PAGE)
    verdicts = {PAGE: next((t["main"] for t in tags if t["token"] == PAGE), False)}
    for t in tags:
        kind = outer[t["class"]]
        before = [m["token"] for m in members.get(kind, ()) if m["place"] < t["place"]]
        # Earlier tokens have their verdicts already.
        enclosing = verdicts.get(before[-1]) if t["thin"] and before else None
        verdicts[t["token"]] = t["main"] if enclosing is None else enclosing
    return verdicts


def main_text(html: str, with_article: list[dict], plain: list[dict]) -> str:
    """The blocks of a page that stand in the main slots of its host's template for pages of its layout."""
    page, segments = parse(html)
    article = has_article(segments)
    tokens = with_article if article else plain
    template: dict[int, tuple[int, int]] = {}
    sizes: dict[int, int] = {}
    for t in tokens:
        if t["token"] > PAGE:
            rank = sizes.get(t["class"], 0)
            template[t["token"]] = (t["class"], rank)
            sizes[t["class"]] = rank + 1
    valid = valid_tokens(page, template, sizes)
    main = {t["token"]: t["main"] for t in tokens} if article else nested_verdicts(tokens)
    again = {t["token"] for t in tokens if t["again"]}
    same = {t["token"] for t in tokens if t["token"] < 0}
    fixed = {block for block, token in text_tokens(segments).items() if token in same} if same and not article else set()
    slot = PAGE
    known: dict[int, bool] = {}
    blocks: dict[int, list[str]] = {}
    for s in segments:
        # A token outside the template, or of a class that isn't valid here, opens no slot of its own:
        # what follows belongs to the slot before it, as far as the page's markup agrees.
        if s.token in valid or s.token == PAGE:
            slot = s.token
            wanted = main.get(slot, False)
        else:
            wanted = main.get(slot, False) or s.main or (not article and not s.link)
        if wanted and not s.off and (s.main or not article) and not agreed(s.asked, again, known):
            blocks.setdefault(s.block, []).append(s.text)
    texts = {block: text for block, parts in blocks.items() if (text := joined(parts))}
    if not texts.keys() <= fixed:
        texts = {block: text for block, text in texts.items() if block not in fixed}
    return "\n\n".join(texts.values())


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] = ()) -> DataFrame:
    """The kept columns of each page, and its main text."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^\w+://([^/?#]*)", 1))
    # Pages are told apart by their content, so that the vectors don't depend on how rows are dealt.
    page = F.xxhash64(F.col(f"`{url}`"), F.col(f"`{html}`"))
    rows = pages.select(host.alias("host"), page.alias("page"), F.col(f"`{html}`").alias("html"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keep]).alias("row"))
    known = written(templates(written(token_sums(rows), "tokens")), "templates")
    kind = rows.schema["row"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", a or [], p or []) for h, a, p in zip(*(batch.column(c).to_pylist() for c in ("html", "article", "plain")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    found = map_arrow(rows.join(known, "host", "left").select("row", "html", "article", "plain"), task, f"row {kind}, text string")
    return found.select(*[F.col(f"row.`{k}`").alias(k) for k in keep], "text")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length for every page."""
    return extract(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
