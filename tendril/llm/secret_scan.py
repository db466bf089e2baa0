"""Secret scan in DataFrame functions alone: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The fixed patterns give the base spans. The models are first-order chains over `[+-z]` (80 code points): one of random
strings, one of ordinary identifiers, each a table of transition counts with smoothing. A run of 16 or more key
characters whose log-likelihood ratio, per transition and in all, reaches the thresholds is a span too, unless it meets
a base span. The models are trained from labelled samples (value, random). `samples` makes them from the base patterns
and the words of all documents, however rare keys are among them.

Positions are code points, the end exclusive. They come from the lengths of what lies between the matches, which
`split` gives, and of the matches: Spark has no function for the positions of all matches. Sums and maxima along them
are folds over pieces of the arrays, so that a text with very many matches takes about n * sqrt(n) small steps.

Defined cases: a null or empty text has no span; repeated rows are scanned each; an empty table gives an empty result;
without samples of both kinds the models are uniform and add nothing; other columns are carried along untouched, whatever their names (`scan` puts them into one struct); very long texts are
scanned whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")

# The base patterns and the least length of what counts in each.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a match of [0-9a-f]+ is a whole run, so the shorter ones may be left out by the pattern
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

KEY = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"

FIRST, SPAN = ord("+"), ord("z") - ord("+") + 1
#: Weight, in transitions a state, of the uniform chain in the model of random strings, and of single characters in that of identifiers.
SMOOTH_RANDOM, SMOOTH_ORDINARY = 40.0, 5.0
LEAST_TOTAL, LEAST_EACH = 12.0, 0.8

MARK = "[secret]"


# --- the models -------------------------------------------------------------------------------------------------


def _characters(token: Column) -> Column:
    return F.slice(F.split(token, ""), 1, F.length(token))


def transitions(token: Column, of) -> Column:
    """of(a, b) for each pair of neighbouring characters; the token has two or more."""
    characters, n = _characters(token), F.length(token) - 1
    return F.zip_with(F.slice(characters, F.lit(1), n), F.slice(characters, F.lit(2), n), of)


def samples(docs: DataFrame) -> DataFrame:
    """(value, random) from base matches (random) and other words (ordinary) of all documents."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    assigned = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)), lambda hit: F.regexp_extract(hit, ASSIGN, 1))
    keys = F.concat(assigned, F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    keys = F.filter(keys, lambda v: F.length(v) >= ASSIGN_LEAST)
    words = F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))
    marked = lambda values, random: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random")))
    return docs.select(F.explode(F.concat(marked(keys, True), marked(words, False))).alias("sample")).select("sample.value", "sample.random")


def fit(labelled: DataFrame) -> np.ndarray:
    """log P(b | a, random) - log P(b | a, ordinary) for every pair, from labelled samples (value, random).

    The transitions are counted by Spark, equal samples once with their number; two tables of SPAN x SPAN counts at most
    come to the driver.
    """
    clean = labelled.filter(F.col("value").rlike("^[+-z]{2,}$") & F.col("random").isNotNull())
    pairs = clean.groupBy("random", "value").agg(F.count("*").alias("n")).select("random", "n", F.explode(transitions(F.col("value"), lambda a, b: (F.ascii(a) - FIRST) * SPAN + F.ascii(b) - FIRST)).alias("pair"))
    counts = np.zeros((2, SPAN * SPAN))
    for row in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        counts[int(row["random"]), row["pair"]] = row["n"]
    if not counts.sum(axis=1).all():
        return np.zeros((SPAN, SPAN))
    ordinary, random = counts.reshape(2, SPAN, SPAN)
    each = lambda table, weight, rest: np.log((table + weight * rest) / (table.sum(axis=1, keepdims=True) + weight))
    # a character that ordinary identifiers seldom have is rare after any other; a key may use any character
    seldom = (ordinary.sum(axis=0) + 0.5) / (ordinary.sum() + 0.5 * SPAN)
    return each(random, SMOOTH_RANDOM, 1 / SPAN) - each(ordinary, SMOOTH_ORDINARY, seldom)


def _constant(model: np.ndarray) -> Column:
    """The table as one constant of the plan (SPAN * SPAN numbers, whatever the input)."""
    return F.expr("cast(split('" + ",".join(f"{v:.3f}" for v in model.ravel()) + "', ',') as array<float>)")


def likelihood_ratio(token: Column, model: np.ndarray) -> Column:
    """Sum over the transitions of a token of key characters."""
    table = _constant(model)
    each = transitions(token, lambda a, b: F.get(table, (F.ascii(a) - FIRST) * SPAN + F.ascii(b) - FIRST))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)


# --- spans ------------------------------------------------------------------------------------------------------


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start, step) -> Column:
    """Exclusive running fold of an array of numbers by an associative step: [start, step(start, v0), ...], one longer than values.

    An array that grows by appending is copied at each step, so the fold works on pieces of about sqrt(n) values: first
    the folds of whole pieces, then those within each piece from there. The work is n * sqrt(n) at most.
    """
    nothing = F.array().cast("array<long>")

    def appended(items: Column, first: Column) -> Column:
        grow = lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, F.struct(first.alias("at"), nothing.alias("out")), grow)

    def pieces(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        count = F.ceil(F.size(v) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * size + 1, size))
        folded = lambda all_: F.transform(all_, lambda x: F.aggregate(x, F.lit(start).cast("long"), step))
        joined = lambda all_: let(appended(folded(all_), F.lit(start).cast("long")), lambda top: F.concat(F.flatten(F.zip_with(all_, top["out"], lambda x, first: appended(x, first)["out"])), F.array(top["at"])))
        return let(cut, joined)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array(F.lit(start).cast("long"))).otherwise(pieces(v)))


def _sum(a: Column, b: Column) -> Column:
    return a + b.cast("long")


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b.cast("long"))


def located(text: Column, patterns: Sequence[str]) -> Column:
    """For each pattern, the array of (start, kind, end, hit) of all its matches; kind is the place among the patterns.

    No pattern may match the empty string.
    """
    nothing = F.array().cast("array<string>")

    def spans(x: Column) -> Column:
        gaps = F.transform(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), lambda gap: F.length(gap))
        both = F.zip_with(x["hits"], gaps, lambda hit, gap: F.struct(gap.alias("before"), (gap + F.length(hit)).alias("upto"), hit.alias("hit")))

        def placed(pieces: Column) -> Column:
            starts = running(F.transform(pieces, lambda b: b["upto"]), 0, _sum)
            span = lambda b, at: F.struct((at + b["before"]).cast("int").alias("start"), x["kind"].alias("kind"), (at + b["upto"]).cast("int").alias("end"), b["hit"].alias("hit"))
            return F.zip_with(pieces, F.slice(starts, F.lit(1), F.size(pieces)), span)

        return let(both, placed)

    def found(pattern: str, kind: int) -> Column:
        hit = text.rlike(pattern)
        return F.struct(F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing).alias("hits"), F.when(hit, F.split(text, pattern, -1)).otherwise(nothing).alias("gaps"), F.lit(kind).alias("kind"))

    return F.transform(F.array(*(found(p, k) for k, p in enumerate(patterns))), spans)


def apart(keys: Column, base: Column) -> Column:
    """The keys that meet no base span. Both are in order; keys do not meet each other.

    In the order of starts, a key meets a base span before it if one of those reaches over its start, and one after it
    if the next one starts before its end: two running folds over the union.
    """
    wide = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["hit"].alias("hit")))
    union = F.array_sort(F.concat(wide(base, 0), wide(keys, 1)))
    far = F.lit(1 << 31).cast("long")

    def kept(u: Column) -> Column:
        reach = running(F.transform(u, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0)), 0, _most)
        # the next base start, by the same fold from the other end
        later = F.reverse(running(F.reverse(F.transform(u, lambda s: F.when(s["own"] == 0, -s["start"].cast("long")).otherwise(-far))), -(1 << 31), _most))
        seen = F.zip_with(F.zip_with(u, F.slice(reach, F.lit(1), F.size(u)), lambda s, r: F.struct(s.alias("s"), r.alias("r"))), F.slice(later, F.lit(2), F.size(u)), lambda x, n: F.struct(x["s"].alias("s"), x["r"].alias("r"), (-n).alias("n")))
        return F.filter(seen, lambda x: (x["s"]["own"] == 1) & (x["r"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"]))

    clear = F.transform(let(union, kept), lambda x: F.struct(x["s"]["start"].alias("start"), F.lit(3).alias("kind"), x["s"]["end"].alias("end"), x["s"]["hit"].alias("hit")))
    return F.when((F.size(keys) == 0) | (F.size(base) == 0), keys).otherwise(clear)


def found_in(text: Column, model: np.ndarray) -> Column:
    """Struct (base, spans) of a text that is not null: arrays of (start, kind, end) in order, kind an index into KINDS."""
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    secret = lambda k: likelihood_ratio(k["hit"], model) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_EACH * (k["end"] - k["start"] - 1))

    def joined(x: Column) -> Column:
        spans = let(F.filter(apart(x["key"], x["base"]), secret), lambda more: F.when(F.size(more) == 0, bare(x["base"])).otherwise(F.array_sort(F.concat(bare(x["base"]), bare(more)))))
        return F.struct(bare(x["base"]).alias("base"), spans.alias("spans"))

    def base_and_key(at: Column) -> Column:
        each = lambda k: F.get(at, F.lit(k))
        assign = F.filter(each(0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= ASSIGN_LEAST)
        access = F.filter(each(1), lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
        return F.struct(F.array_sort(F.concat(assign, access, each(2))).alias("base"), each(3).alias("key"))

    return let(let(located(text, (ASSIGN, ACCESS, HEX, KEY)), base_and_key), joined)


def scan(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """(row, base, spans): row is a struct of all columns of docs, whatever their names."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = docs.select(own, found_in(F.coalesce(F.col(f"`{text}`"), F.lit("")), model).alias("found"))
    return found.select("row", "found.base", "found.spans")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def covered(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with each run of overlapping spans replaced by a mark.

    A substring is found by walking from the start of its string, so the text is first cut into about sqrt(n) parts at
    spans, and those into pieces.
    """

    def joined(x: Column) -> Column:
        # s: (piece of text before, whether a mark follows) as places in the text
        pieces = F.zip_with(x["spans"], F.slice(x["reach"], F.lit(1), F.size(x["spans"])), lambda s, at: F.struct(at.cast("int").alias("from"), F.greatest(at, s["start"].cast("long")).cast("int").alias("to"), (s["start"] >= at).alias("fresh")))

        def parts(p: Column) -> Column:
            size = F.ceil(F.sqrt(F.size(p))).cast("int")
            cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / size).cast("int") - 1), lambda k: F.slice(p, k * size + 1, size))
            first = lambda g: F.get(g, F.lit(0))["from"]
            held = F.transform(cut, lambda g: F.struct(g.alias("g"), first(g).alias("first"), F.substring(text, first(g) + 1, F.element_at(g, -1)["to"] - first(g)).alias("part")))
            one = lambda h: F.array_join(F.transform(h["g"], lambda q: F.when(q["fresh"], F.concat(F.substring(h["part"], q["from"] - h["first"] + 1, q["to"] - q["from"]), F.lit(mark))).otherwise("")), "")
            return F.array_join(F.transform(held, one), "")

        return F.concat(let(pieces, parts), F.substring(text, F.element_at(x["reach"], -1).cast("int") + 1, F.length(text)))

    reach = lambda s: running(F.transform(s, lambda y: y["end"]), 0, _most)
    return F.when(F.size(spans) > 0, let(F.struct(spans.alias("spans"), reach(spans).alias("reach")), joined)).otherwise(text)


def redact(docs: DataFrame, model: np.ndarray, mark: str = MARK) -> DataFrame:
    """docs with each run of overlapping spans of `text` replaced by a mark; n_chars follows where there is such a column.

    Rows keep all their columns; a null text stays null.
    """
    scanned = scan(docs, model).withColumn("found", F.size("spans") > 0)
    clean = scanned.select("row", "found", covered(F.col("row.text"), F.col("spans"), mark).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("found"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return clean.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
