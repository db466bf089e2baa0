"""Text functions of tender data. Columns in, columns out; those named *_udf run Python over Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and what is left of each without them."""
    pairs = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        if letter != letter.lower():
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if bare != letter and len(bare) == 1:
            pairs.append((letter, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accent_table()
_MARKS = "[̀-ͯ]"


def plain(text: Column) -> Column:
    """Lower case without accents; white space and `ß` stay."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, BARE), _MARKS, "")


def squeeze(text: Column, trim: bool = True) -> Column:
    """White space, in runs, becomes one space."""
    one = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(one) if trim else one


def normalize(text: Column) -> Column:
    """Compatibility forms apart, marks dropped, case folded, white space collapsed. Exact, in Python."""
    return _normalize(text)


@F.pandas_udf(T.StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        apart = unicodedata.normalize("NFKD", text)
        return " ".join("".join(c for c in apart if not unicodedata.combining(c)).casefold().split())

    return texts.map(one, na_action="ignore")


def normalize_simple(text: Column) -> Column:
    """As `normalize` for texts without ligatures and `ß`, in built-in functions."""
    return squeeze(plain(text))


def alnum_key(text: Column) -> Column:
    """Capital letters and digits alone, accents dropped."""
    return F.regexp_replace(F.upper(plain(text)), "[^A-Z0-9]", "")


def letters_plain(text: Column) -> Column:
    """`plain`, after `!` between letters is read as `i`."""
    return plain(F.regexp_replace(text, r"(?U)(?<=\p{L})!(?=\p{L})", "i"))


def cell_text(html: Column, entities: bool = True, closed: bool = False) -> Column:
    """Text of a table cell: scripts and tags out, character references read, white space collapsed.

    closed: references without their `;` stay as they are; otherwise they are read as browsers read them.
    """
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), "<[^>]+>", " ")
    return squeeze((_unescape_closed if closed else _unescape)(bare) if entities else bare)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    one = lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])
    return texts.map(lambda text: _CLOSED.sub(one, text), na_action="ignore")


def tidy(text: Column) -> Column:
    """Template junk out: a stray inverted question mark (where no `?` is), articles in brackets, `;` as comma, loose spaces."""
    out = F.when(text.contains("?"), text).otherwise(F.replace(text, F.lit("¿"), F.lit("")))
    out = F.regexp_replace(out, r"(?i)\((el|la|los|las)\)", "")
    out = F.regexp_replace(out, r"\s*;\s*", ", ")
    out = F.regexp_replace(out, r"\s+([,.])", "$1")
    return F.regexp_replace(squeeze(out), r"^[\s,.;:-]+|[\s,;:-]+$", "")


SMALL_WORDS = ("de", "del", "la", "las", "el", "los", "y", "e", "en", "a", "al", "con", "para", "por", "o", "u")


def proper(text: Column, small: tuple[str, ...] = SMALL_WORDS) -> Column:
    """Title case by words; small words stay lower but for the first; parts of hyphenated words are capitalised."""

    def one(word: Column, i: Column) -> Column:
        capital = F.array_join(F.transform(F.split(word, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "-")
        return F.when((i > 0) & word.isin(*small), word).otherwise(capital)

    return F.array_join(F.transform(F.split(squeeze(F.lower(text)), " "), one), " ")


PLACE_PREFIX = r"(?i)^(municipalidad (distrital|provincial|metropolitana)|gobierno regional)( (de|del))? +"


def place(entity: Column) -> Column:
    """An entity's name without its kind, in proper case."""
    return proper(F.regexp_replace(entity, PLACE_PREFIX, ""))


LEAD_IN = r"(?i)^(contrataci[oó]n (de|para) la ejecuci[oó]n (de|del) (la )?obra|ejecuci[oó]n (de|del) (la )?(obra|saldo de obra))\s*[:\-]?\s*"


def work_name(description: Column, extracted: Column | None = None) -> Column:
    """Name of a work: the extracted one, else the description without lead-in and closing code."""
    bare = F.regexp_replace(F.regexp_replace(squeeze(description), LEAD_IN, ""), r"(?i)[\s,;.-]*\(?(con )?CUI\s*(N[°º])?\s*:?\s*\d{7,10}\)?\.?$", "")
    own = F.regexp_replace(bare, "^[\"“”']+|[\"“”']+$", "")
    return F.coalesce(F.nullif(squeeze(extracted), F.lit("")), own) if extracted is not None else own


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w.\-]+", "_")


def without_uuid(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}[_-]?", "")


def join_words(items: Column, last: str = " y ") -> Column:
    """"a, b y c"."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(items, -1)))


def span(first: Column, last: Column) -> Column:
    """"a al b": of the two, what is there, once if they are equal."""
    kept = F.filter(F.array(first, last), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(F.array_distinct(kept), " al "), F.lit(""))


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row: a lambda would compute an expression from outside anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- paged text: pages are divided by form feeds --------------------------------------------------------------------

FEED = "\x0c"


def pages(text: Column) -> Column:
    return F.split(text, FEED)


def page_of(text: Column, offset: Column) -> Column:
    """Page of a 0-based offset, from 1."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit(FEED), F.lit(""))) + 1


def _solid(page: Column) -> Column:
    return F.length(F.regexp_replace(page, r"(?U)\s", ""))


def scanned_share(text: Column, least: int = 80) -> Column:
    """Share of pages with fewer than `least` characters that are not white space."""
    every = pages(text)
    return F.size(F.filter(every, lambda p: _solid(p) < least)) / F.size(every)


def is_scanned(text: Column, share: float = 0.8) -> Column:
    return scanned_share(text) >= share


def image_pages(text: Column, least: int = 400, first: int | None = 150) -> Column:
    """Numbers of pages, among the first (None: among all), that hold little text."""
    looked_at = pages(text) if first is None else F.slice(pages(text), 1, first)
    numbered = F.transform(looked_at, lambda p, i: F.struct((i + 1).alias("n"), _solid(p).alias("solid")))
    return F.transform(F.filter(numbered, lambda x: x["solid"] < least), lambda x: x["n"])


def page_ranges(numbers: Column) -> Column:
    """[1, 2, 3, 7] as "1-3,7"; numbers ascending and distinct."""

    def ranges(n: Column) -> Column:
        starts = F.filter(n, lambda x, i: (i == 0) | (F.get(n, i - 1) != x - 1))
        stops = F.filter(n, lambda x, i: (i == F.size(n) - 1) | (F.get(n, i + 1) != x + 1))
        return F.array_join(F.zip_with(starts, stops, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ",")

    return once(numbers, ranges)


def without_running_lines(text: Column, depth: int = 3, share: float = 0.5, least: int = 3) -> Column:
    """Pages without what runs through a document: lines at the top or foot of pages that come again on a share of them.

    A line's form is its text without case, accents and white space, digits alike. A form runs if it stands among the
    first or last `depth` lines with text on `share` of the pages, `least` at least; from each edge of a page, running and
    empty lines go until another line comes. What stands beside a text, right of a gap of four spaces, on one of those lines
    has a form too and goes by the same rule, the text staying. Documents with fewer pages keep all.

    The forms of all pages are sorted once and folded, so a document of n pages takes n log n steps; at most
    4 * depth / share forms can run.
    """
    gap = r"\S( {4,}\S.*)$"
    form = lambda line: F.regexp_replace(F.regexp_replace(plain(line), r"\s+", ""), "[0-9]+", "#")
    beside = lambda line: F.regexp_extract(line, gap, 1)
    # lines with their forms, which cost most: computed once, and used for what runs and for what goes
    formed = lambda page: F.transform(F.split(page, "\n"), lambda x: F.struct(x.alias("line"), form(x).alias("form"), (F.trim(x) == "").alias("empty")))
    edges = lambda lines: once(F.filter(lines, lambda x: ~x["empty"]), lambda s: F.concat(F.slice(s, 1, depth), F.slice(F.reverse(s), 1, depth)))
    forms = lambda lines: F.array_distinct(F.filter(F.flatten(F.transform(edges(lines), lambda x: F.array(x["form"], form(beside(x["line"]))))), lambda f: f != ""))

    def running(paged: Column, need: Column) -> Column:
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, f: Column) -> Column:
            n = F.when(f == acc["last"], acc["n"] + 1).otherwise(1)
            return once(n, lambda k: F.struct(f.alias("last"), k.alias("n"), F.when(k == need, F.concat(acc["out"], F.array(f))).otherwise(acc["out"]).alias("out")))

        return F.aggregate(F.array_sort(F.flatten(F.transform(paged, forms))), start, step)["out"]

    def cleaned(paged: Column, out: Column) -> Column:
        stays = lambda lines: F.transform(lines, lambda x: ~(x["empty"] | F.array_contains(out, x["form"])))
        ahead = lambda stay: F.coalesce(F.nullif(F.array_position(stay, True), F.lit(0)) - 1, F.size(stay).cast("long")).cast("int")
        # without a line that stays, the page's length goes from the front and nothing is left
        trimmed = lambda lines: once(stays(lines), lambda stay: once(ahead(stay), lambda a: F.slice(lines, a + 1, F.greatest(F.size(lines) - a - ahead(F.reverse(stay)), F.lit(0)))))
        without = lambda line, tail: F.when((tail != "") & F.array_contains(out, form(tail)), F.substring(line, F.lit(1), F.length(line) - F.length(tail))).otherwise(line)
        cut = lambda line: once(beside(line), lambda tail: without(line, tail))
        at_edge = lambda lines: F.transform(lines, lambda x, i: F.when((i < depth) | (i >= F.size(lines) - depth), cut(x["line"])).otherwise(x["line"]))
        return F.array_join(F.transform(paged, lambda lines: F.array_join(once(trimmed(lines), at_edge), "\n")), FEED)

    need = lambda p: F.greatest(F.lit(least), F.ceil(F.size(p) * share).cast("int"))
    clean = lambda paged: once(paged, lambda p: once(running(p, need(p)), lambda out: cleaned(p, out)))
    return once(text, lambda t: once(pages(t), lambda p: F.when(F.size(p) < least, t).otherwise(clean(F.transform(p, formed)))))


def marked_pages(text: Column, most: int = 45_000) -> Column:
    """Each page under its number, cut to a length."""
    return F.substring(F.array_join(F.transform(pages(text), lambda p, i: F.concat(F.lit("[p. "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n"), 1, most)


def cells(line: Column) -> Column:
    """Cells of a layout line, parted by three or more spaces."""
    return F.split(F.trim(line), " {3,}")


# --- words ----------------------------------------------------------------------------------------------------------


def all_words(haystack: Column, query: str) -> Column:
    """Every word of the query occurs in the text, without regard to case and accents."""
    text = plain(haystack)
    out = F.lit(True)
    for word in plain_text(query).split():
        out = out & text.contains(word)
    return out


_HIGH = re.compile(r"[^\x00-\u02ff]")  # below are no marks


def _unless_mark(m: re.Match) -> str:
    return "" if unicodedata.category(m[0]) == "Mn" else m[0]


def plain_text(text: str) -> str:
    """`plain` for one Python string."""
    low = text.lower()
    return low if low.isascii() else _HIGH.sub(_unless_mark, unicodedata.normalize("NFD", low))



def name_words(text: Column, stop: tuple[str, ...] = SMALL_WORDS, first: int = 10) -> Column:
    """The first distinctive words: three letters or more, no small words, each once."""
    found = F.filter(F.split(plain(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
    return F.slice(F.array_distinct(found), 1, first)


def name_share(a: Column, b: Column) -> Column:
    """Share of a's distinctive words that are among b's words; 1 if a has none."""
    wanted, held = name_words(a), F.split(plain(b), "[^a-z0-9]+")
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.filter(wanted, lambda w: F.array_contains(held, w))) / F.size(wanted))


_ROMAN = re.compile(r"^(?=[ivxlc])(x{0,3})(ix|iv|v?i{0,3})$")


def sentence_case(places: tuple[str, ...] = ()):
    """All capitals to sentence case; names of places, roman numbers and initials keep capitals. A pandas UDF of one column."""
    known = {p.lower() for p in places}

    def one(text):
        if text is None or text != text.upper():
            return text
        words = text.lower().split(" ")
        out = []
        for k, word in enumerate(words):
            bare = word.strip("()[],.;:\"'")
            if bare and (_ROMAN.match(bare) or re.fullmatch(r"([a-z]\.)+[a-z]?", word.strip("(),;:"))):
                out.append(word.upper())
            elif k == 0 or bare in known or out and out[-1].endswith("."):
                out.append(re.sub(r"[^\W\d_]", lambda m: m.group().upper(), word, count=1))
            else:
                out.append(word)
        return " ".join(out)

    @F.pandas_udf(T.StringType())
    def sentence(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return sentence
