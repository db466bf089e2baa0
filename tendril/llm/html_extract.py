"""Main text of web pages: what a site repeats is deleted, the rest is read block by block.

Every block element of a page has two hashes: one of its content (tag, class, text) and one of its place (tags and
classes from the root down to it, numbers of three digits and more blanked). Spark counts both for each host over its different pages, and sums how
much text and how much link text stands at each place. What stands on MIN_PAGES pages and on MIN_SHARE of the host's is
deleted wherever it stands, by three rules:

- Content that recurs. Only headings and prose inside the text's own containers are spared: an article repeats passages too.
- Places that recur and are mostly links (LINKED of their text), though the links differ from page to page.
- Places that recur beside the way down to the main text. That way is made of the places that hold HEAVY of the text of
  their pages, with content that changes from page to page; a light container beside it is a banner, an advert, a footer.

Copies of one page count once: pages are told apart by their whole html. The places of a host with fewer than MIN_PAGES
pages are counted together with those of the other hosts of its parent domain (of two labels at least). Where that has too
few pages too, marks in the page decide instead: `article` or `main` if there is one, and words in class and id (AWAY_WORDS).

Everywhere, what HTML itself says is no text of the page goes (nav, footer, aside, forms, hidden parts, roles), and so do
reader comments by their class, since no count tells prose from prose.

Defined cases: null html is the empty page and its text empty; a null url, or one without `://`, is on the host "";
repeated rows are extracted each; an empty table gives an empty result; broken or cut-off markup is read as far as it
goes; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, dropped, map_columns, stored
from .urls import host_of

MIN_PAGES = 8
MIN_SHARE = 0.02
#: Share of its pages' text from which a place is on the way to the main text, and share of link text of a menu.
HEAVY, LINKED = 0.5, 0.6

# Names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th tr tbody thead tfoot caption figcaption summary".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

# What tags, roles and class or id words say an element is no part of the article.
HIDDEN_TAGS = frozenset("head script style noscript template button select textarea title iframe svg object canvas audio video math".split())
AWAY_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AWAY_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social breadcrumb breadcrumbs related recommended widget form pagination pager masthead toolbar".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: Containers that hold content by themselves: beside the main text they go only if they are menus.
OWN_CONTENT = frozenset("table figure ul ol dl details blockquote".split())
#: Away unless they stand in an article.
OUTER = frozenset(["header"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]{3,}")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    place: int = 0  # hash of the tags and classes down to here
    shown: str = ""  # class, as written
    hidden: bool = False  # never text
    away: bool = False  # no part of the article, by tag, role or attribute
    worded: bool = False  # the same by a word of class or id
    main: bool = False  # article or main
    last: int = 0  # first element after its subtree
    parts: list = field(default_factory=list)
    hash: int = 0
    chars: int = 0
    links: int = 0
    text: bool = False


@dataclass(slots=True)
class Page:
    elements: list[Element]
    blocks: list[tuple[int, str]]  # (element, text) in page order


@dataclass(frozen=True)
class Template:
    """What a site repeats: hashes of content and of places to delete, and the places on the way to the main text."""

    content: frozenset[int] = frozenset()
    places: frozenset[int] = frozenset()
    way: frozenset[int] = frozenset()


def _signed(h: int) -> int:
    return (h ^ 1 << 63) - (1 << 63)


def _described(element: Element, attributes: str, outer: bool) -> None:
    words: set[str] = set()
    tag = element.tag
    element.hidden = tag in HIDDEN_TAGS
    element.main = tag in ("article", "main")
    element.away = tag in AWAY_TAGS or tag in OUTER and outer
    if not attributes:
        return
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "class":
            element.shown = value
        if name in ("class", "id"):
            words.update(_WORD.findall(value.lower()))
        elif name == "role":
            element.away |= value.strip().lower() in AWAY_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            element.hidden = True
    if words and tag not in ("body", "html", "main"):
        element.hidden |= bool(words & COMMENT_WORDS)
        element.worded = bool(words & AWAY_WORDS) and not element.main


def read_page(html: str) -> Page:
    """The block elements of a page, each with the hash of its subtree, and the blocks of text."""
    elements = [Element("", -1)]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    pieces: list[str] = []
    inside = 0  # articles that are open
    linked, linked_chars = False, 0  # whether a link is open, and its text in this block

    def add(text: str) -> None:
        nonlocal linked_chars
        pieces.append(text)
        if linked:
            linked_chars += len(text.strip())

    def end_block() -> None:
        nonlocal linked_chars
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                blocks.append((stack[-1], text))
                element = elements[stack[-1]]
                element.parts.append(text)
                element.chars += len(text)
                element.links += min(len(text), linked_chars)
        linked_chars = 0

    def close() -> None:
        nonlocal inside, linked
        end_block()
        linked = False
        element = elements[stack.pop()]
        element.last = len(elements)
        inside -= element.main
        element.text = any(element.parts) and not element.hidden
        element.hash = _signed(xxhash.xxh3_64_intdigest("\x00".join([element.tag, element.shown, *(str(p) for p in element.parts)]).encode("utf-8", "surrogatepass")))
        if element.text:
            parent = elements[element.parent]
            parent.parts.append(element.hash)
            parent.chars += element.chars
            parent.links += element.links

    def close_to(tags: str, borders: tuple[str, ...]) -> None:
        names = tags.split()
        for k in range(len(stack) - 1, 0, -1):
            tag = elements[stack[k]].tag
            if tag in names:
                while len(stack) > k:
                    close()
                return
            if tag in borders:
                return

    at, size = 0, len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        if token is None:
            add(html[at:])
            break
        if token.start() > at:
            add(html[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in INLINE:
                linked &= tag != "a"
                continue
            end_block()
            close_to(tag, ("td", "th") if tag in ("p", "li") else ())
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}\s*+[^>]*+>", re.I).search(html, at)
            at = shut.end() if shut else size
            if tag not in ("script", "style", "noscript", "template"):
                end_block()
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            linked |= tag == "a"
            continue
        end_block()
        if tag in CLOSES_P:
            close_to("p", ("td", "th", "li", "table", "button"))
        if tag in SIBLINGS:
            close_to(*SIBLINGS[tag])
        if tag in VOID:
            continue
        element = Element(tag, stack[-1])
        _described(element, token[3], not inside)
        element.place = _signed(xxhash.xxh3_64_intdigest(f"{elements[stack[-1]].place} {tag} {_DIGITS.sub('#', element.shown)}".encode("utf-8", "surrogatepass")))
        elements.append(element)
        stack.append(len(elements) - 1)
        inside += element.main
        if token[3].endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
            close()
    while len(stack) > 1:
        close()
    end_block()
    elements[0].last = len(elements)
    return Page(elements, blocks)


#: The root, html and body: never template themselves.
TOP = frozenset(["", "html", "body"])


def content_hashes(page: Page) -> set[int]:
    """Distinct content hashes of the block elements with text."""
    return {e.hash for e in page.elements if e.text and e.tag not in TOP}


def places(page: Page) -> dict[int, tuple[int, bool, bool, int, int, int]]:
    """place -> (place of the parent, whether a generic container, whether right under the body, hash of its content, characters, link characters) of the containers of a page."""
    out: dict[int, tuple[int, bool, bool, int, int, int]] = {}
    for k, e in enumerate(page.elements):
        if k and e.text and e.tag not in PROSE:
            parent = page.elements[e.parent]
            _, _, _, own, chars, links = out.get(e.place, (0, True, True, 0, 0, 0))
            out[e.place] = (parent.place, e.tag not in OWN_CONTENT and e.tag not in TOP, parent.tag in TOP, _signed((own * 31 + e.hash) % (1 << 64)), chars + e.chars, links + e.links)
    return out


def main_text(page: Page, template: Template | None = None, marks: bool = True) -> tuple[str, int]:
    """The text that is left, blocks joined by line feeds, and the number of subtrees deleted as template.

    template: what the site repeats, None where it is not known; then marks in the page decide. Without `marks`, no tag,
    role or word takes anything away but what is never text (HIDDEN_TAGS, hidden parts, comments).
    """
    elements = page.elements
    known = template is not None
    content, at_places, way = (template.content, template.places, template.way) if known else (frozenset(), frozenset(), frozenset())
    gone, held = [False] * len(elements), [False] * len(elements)
    deep = any(e.place in way and e.tag not in TOP for e in elements)
    deleted = 0
    for k in range(1, len(elements)):
        element = elements[k]
        up = held[element.parent]
        repeated = False
        if known and element.text and element.tag not in TOP and element.place not in way:
            repeated = element.place in at_places or element.hash in content and not (up and element.tag in PROSE)
        away = element.hidden or repeated or marks and (element.away or not known and element.worded)
        deleted += repeated and not gone[element.parent]
        gone[k] = gone[element.parent] or away
        # inside the text's own containers: the end of the way down, or an article
        held[k] = not gone[k] and (up or (element.place in way and (not deep or element.tag not in TOP) if way else element.main))
    chosen = [text for k, text in page.blocks if not gone[k]]
    if marks and not known:
        within = [text for k, text in page.blocks if held[k]]
        if within or any(e.main and not gone[k] for k, e in enumerate(elements)):
            chosen = within
    return "\n".join(chosen), deleted


# --- over tables ------------------------------------------------------------------------------------------------


OBSERVED = "host string, page long, hash long, place boolean, parent long, generic boolean, top boolean, own long, chars long, links long, total long"


def observed(pages: DataFrame) -> DataFrame:
    """A row for each content hash and each place of each page; page is a hash of the html."""
    named = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, at = [], []
        for k, html in enumerate(batch.column(2)):
            page = read_page(html.as_py() or "")
            total = page.elements[0].chars
            mine = [(h, False, None, None, None, None, None, None, None) for h in content_hashes(page)]
            mine += [(place, True, *values, total) for place, values in places(page).items()]
            rows += mine
            at += [k] * len(mine)
        columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
        index = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([*(c.take(index) for c in batch.columns[:2]), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in OBSERVED.split(", ")])

    return map_columns(named, named.columns, run, OBSERVED)


def domain_of(host):
    """`*.` and the parent domain of a host, null unless that has two labels."""
    parent = F.regexp_extract(host, r"\A[^.]+\.(.+)\z", 1)
    return F.when(parent.contains("."), F.concat(F.lit("*."), parent))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Stored table (host, known, content, places, way): a row for each host, arrays of hashes.

    A page holds a bounded number of elements, and each array only what min_share of the host's pages have, so a row does
    not grow with the number of pages. Counts are taken over distinct rows of pages, with partial sums, so a host or a
    subtree that a third of all pages share is added up before its counts meet.
    """
    both = lambda df: df.withColumn("site", F.explode(F.array_compact(F.array(F.col("host"), domain_of(F.col("host"))))))
    found = stored(observed(pages), "observed")
    sizes = stored(both(pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page")).distinct()).groupBy("site").agg(F.count("*").alias("pages")), "sites")

    often = lambda df: df.filter(F.col("seen") >= min_pages).join(sizes, "site").filter(F.col("seen") >= min_share * F.col("pages")).drop("pages")
    single = found.filter("not place").select("host", "hash", "page").distinct()
    content = often(single.groupBy(F.col("host").alias("site"), "hash").agg(F.count("*").alias("seen")))
    at = both(found.filter("place").drop("place").distinct()).groupBy("site", "hash").agg(
        F.count("*").alias("seen"),
        F.approx_count_distinct("own").alias("kinds"),
        F.min("parent").alias("parent"),
        F.max("generic").alias("generic"),
        F.max("top").alias("top"),
        *(F.sum(c).alias(c) for c in ("chars", "links", "total")),
    )
    at = stored(often(at).withColumn("heavy", (F.col("chars") >= HEAVY * F.col("total")) & (2 * F.col("kinds") >= F.col("seen"))), "places")
    way = at.filter("heavy")
    forks = way.select("site", "parent").distinct()  # places with a heavy one below: the main text lies further down
    on_way = way.select("site", F.col("hash").alias("parent"))
    beside = at.filter("not heavy and generic").join(on_way, ["site", "parent"], "left_semi")
    beside = beside.filter("top").union(beside.join(forks, ["site", "parent"], "left_semi"))
    menus = at.filter(~F.col("heavy") & (F.col("links") >= LINKED * F.col("chars")))
    gone = beside.select("site", "hash").union(menus.select("site", "hash")).distinct()

    gathered = (
        content.select("site", "hash", F.lit("content").alias("kind"))
        .union(gone.select("site", "hash", F.lit("places")))
        .union(way.select("site", "hash", F.lit("way")))
        .groupBy("site")
        .agg(*(F.collect_set(F.when(F.col("kind") == kind, F.col("hash"))).alias(kind) for kind in ("content", "places", "way")))
    )
    enough = sizes.filter(F.col("pages") >= min_pages).select("site")
    at_site = enough.join(gathered, "site", "left")
    hosts = sizes.filter(~F.col("site").startswith("*.")).select(F.col("site").alias("host"), F.when(F.col("pages") >= min_pages, F.col("site")).otherwise(domain_of(F.col("site"))).alias("site"))
    joined = hosts.join(at_site.withColumn("known", F.lit(True)), "site", "left")
    empty = F.array().cast("array<long>")
    out = stored(joined.select("host", F.coalesce("known", F.lit(False)).alias("known"), *(F.coalesce(c, empty).alias(c) for c in ("content", "places", "way"))), "templates")
    dropped(found, sizes, at)
    return out


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, marks: bool = True) -> DataFrame:
    """page_id, url, text, n_template (subtrees deleted as template) for every row of pages.

    The templates are broadcast if their bytes are few; else Spark's adaptive join splits the pages of a large host.
    """
    templates = site_templates(pages, min_pages, min_share)
    size = templates.select(F.sum(F.length("host") + 8 * (F.size("content") + F.size("places") + F.size("way")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        templates = F.broadcast(templates)
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(templates, "host", "left").select("page_id", "url", "html", "host", "known", "content", "places", "way")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sites: dict[str, Template | None] = {}
        texts, deleted = [], []
        for k, (html, host, known) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if host not in sites:
                sites[host] = Template(*(frozenset(batch.column(c)[k].as_py()) for c in (5, 6, 7))) if known else None
            text, n = main_text(read_page(html.as_py() or ""), sites[host], marks)
            texts.append(text)
            deleted.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(deleted, pa.int64())], names=["page_id", "url", "text", "n_template"])

    return map_columns(named, named.columns, run, "page_id long, url string, text string, n_template long")
