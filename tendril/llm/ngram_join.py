"""N-gram Jaccard self-join by vertical partitioning, and the groups it links.

A document is the set of its word shingles. Two documents link if their sets' Jaccard similarity reaches the
threshold. The steps, all exact for the 64-bit shingle hashes:

1. Equal sets are one class, known by a hash of the set; only classes are compared.
2. A first filter over one document of each class. With the shingles ordered by hash, the k smallest common shingles of
   a linked pair lie among the first n - ceil(t n) + k of both. Counts over those prefixes tell which shingles more than
   one class has; a class with fewer than its k of them has no partner.
3. The classes left over are read in full. Their shingles get a global order, rarest first. A class with under
   ceil(t n) shingles that another has is out. What remains is indexed by the first n - ceil(t n) + 1 in that order.
4. Candidates are classes with a common indexed shingle. Instead of all pairs of such a bucket, each round compares its
   members with a few hubs from the component that has most of them; that component's own members need no comparison,
   since only groups are asked for. At the end every pair of a bucket that is still in two components is compared, so no link between
   different groups is lost; a bucket inside one component costs nothing. Those pairs are looked for among sets of
   like size alone. The join itself drops pairs that cannot reach the threshold, by three exact bounds: the sizes, the
   places of the common shingle (no more can follow than is left of either set), and bitmaps of the sets (their
   differing bits are differing shingles at least).
   Every shingle's rows are counted before they are joined, and those of a common one are dealt over several tasks.
5. Overlaps are counted by vertical partitioning: the global order is cut into fragments at quantiles, each fragment
   counts the partial overlap of a pair by itself, and the partial counts are summed per pair.

Defined cases: a null or empty text has an empty set, no link and its own id as component; repeated rows are in one
class and each get a row; rows without id get the component of their class, null if no row of it has an id; an empty
table gives an empty result; very long texts are read whole; other columns are not read. doc_id names a document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, bounded, dropped, hot_keys, map_columns, shingle_set, spread_join, stored
from .components import connected_components

WIDTH = 5
#: Similarity threshold as a fraction.
THRESHOLD = (4, 5)
FRAGMENTS = 8
#: Hubs of each bucket in each round.
HUB_ROUNDS = (2, 16)
#: Bits of a set's bitmap, a multiple of 64.
BITMAP = 512


def at_least(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """ceil(t n)."""
    return -(-threshold[0] * n // threshold[1])


def extra(n: int) -> int:
    """How many common shingles, besides the first, the first filter asks for."""
    return n // 10


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each bit: of two sets, differing bits <= differing shingles."""
    odd = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n (set size), set_id (hash of the set), need (for the first filter), prefix (the smallest hashes), bits (bitmap), row (a number of the row, once stored)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, needs, prefixes, maps = [], [], [], [], []
        for text in batch.column(1):
            shingles = shingle_set(text.as_py(), width)
            n = len(shingles)
            sizes.append(n)
            maps.append(bitmap(shingles))
            keys.append(int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True))
            needs.append(1 + extra(at_least(n, threshold)))
            prefixes.append(shingles[: n - at_least(n, threshold) + 1 + extra(n)].view(np.int64) if n else np.zeros(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
        values = pa.array(np.concatenate(prefixes))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(needs, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(maps, pa.list_(pa.int64()))], names=["doc_id", "n", "set_id", "need", "prefix", "bits"])

    return map_columns(docs, ["doc_id", "text"], run, "doc_id long, n long, set_id long, need long, prefix array<long>, bits array<long>").withColumn("row", F.monotonically_increasing_id())


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n, shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text.as_py(), width).view(np.int64) for text in batch.column(1)]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], names=["doc_id", "n", "shingles"])

    return map_columns(docs, ["doc_id", "text"], run, "doc_id long, n long, shingles array<long>")


def _ceil(n: str, threshold: tuple[int, int]):
    return F.ceil(F.col(n) * threshold[0] / threshold[1] - 1e-9).cast("long")


def class_heads(sets: DataFrame) -> DataFrame:
    """One row of sets for each class that is not empty: that of the smallest doc_id."""
    named = sets.filter("n > 0 and doc_id is not null")
    heads = stored(named.groupBy("set_id").agg(F.min_by("row", "doc_id").alias("row")).select("row"), "heads")
    return named.join(bounded(heads), "row", "left_semi")


def ordered_shingles(docs: DataFrame, heads: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Stored table (a, n, rank, shingle, df) of the shared shingles of the classes that may have a partner.

    a: the smallest id of the class; rank: place in the document's rarest-first order, counted with the shingles that
    no other class has (they come first).
    """
    shared = lambda df: stored(df.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    held = heads.select("doc_id", "need", F.explode("prefix").alias("shingle"))
    counts = shared(held)
    mixed = spread_join(held, counts.select("shingle"), ["shingle"], hot_keys(counts, ["shingle"], "df"), "doc_id")
    met = mixed.groupBy("doc_id", "need").agg(F.count("*").alias("met")).filter("met >= need")
    chosen = stored(met.select("doc_id"), "chosen")

    full = stored(full_sets(docs.select("doc_id", "text").join(bounded(chosen), "doc_id"), width), "full")
    single = full.select("doc_id", "n", F.explode("shingles").alias("shingle"))
    dfs = shared(single)
    counted = spread_join(single, dfs, ["shingle"], hot_keys(dfs, ["shingle"], "df"), "doc_id")
    gathered = counted.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    gathered = gathered.filter(F.size("shared") >= _ceil("n", threshold))
    placed = gathered.select(F.col("doc_id").alias("a"), "n", F.size("shared").alias("s"), F.posexplode("shared").alias("at", "x"))
    out = stored(placed.select("a", "n", (F.col("n") - F.col("s") + F.col("at")).alias("rank"), F.col("x.shingle").alias("shingle"), F.col("x.df").alias("df")), "ordered")
    dropped(counts, chosen, full, dfs)
    return out


def fragments(ordered: DataFrame, number: int) -> DataFrame:
    """Stored table (a, n, fragment, part): each class's shingles, cut at quantiles of the global order."""
    place = F.least(F.col("df"), F.lit(1 << 22)) * F.lit(1 << 40) + F.shiftrightunsigned("shingle", 24)
    cuts = ordered.select(place.alias("place")).agg(F.percentile_approx("place", [k / number for k in range(1, number)], 1000).alias("cuts")).first()["cuts"] or []
    fragment = sum(((place >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    return stored(ordered.withColumn("fragment", fragment).groupBy("a", "n", "fragment").agg(F.collect_list("shingle").alias("part")), "fragments")


def overlaps(pairs: DataFrame, parts: DataFrame, number: int = FRAGMENTS) -> DataFrame:
    """pairs (a, b) -> a, b, na, nb, overlap: each fragment counts for itself, then the counts are summed."""
    left = parts.select("a", F.col("n").alias("na"), "fragment", F.col("part").alias("part_a"))
    right = parts.select(F.col("a").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("part_b"))
    hub = lambda side: hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), [side])
    partial = spread_join(pairs, left, ["a"], hub("a"), "b")
    partial = spread_join(partial, right, ["b", "fragment"], _of_fragments(hub("b"), number), "a")
    partial = partial.select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("common"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap"))


def _of_fragments(hot: DataFrame | None, number: int) -> DataFrame | None:
    """Hot nodes b as hot keys (b, fragment)."""
    return None if hot is None else hot.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))


def may_link(threshold: tuple[int, int]):
    """Bounds on a pair (n, rank, bits) and (hn, hrank, hbits) that hold for every link, at its first common shingle."""
    up, down = threshold
    both = F.col("n") + F.col("hn")
    sizes = (F.col("n") * up <= F.col("hn") * down) & (F.col("hn") * up <= F.col("n") * down)
    places = F.least(F.col("n") - F.col("rank"), F.col("hn") - F.col("hrank")) * (up + down) >= both * up
    differing = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("hbits", F.lit(k)))) for k in range(BITMAP // 64)), F.lit(0))
    return sizes & places & (differing * (up + down) <= both * (down - up))


@dataclass
class Found:
    """links: (a, b) between classes, enough to join every group; labels: node, component of linked classes."""

    links: DataFrame
    labels: DataFrame | None


def _band(n: str, threshold: tuple[int, int]):
    """Sizes that link are in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(threshold[1] / threshold[0])) + 1e-9).cast("int")


def link(docs: DataFrame, sets: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, n_fragments: int = FRAGMENTS, hub_rounds: tuple[int, ...] = HUB_ROUNDS) -> Found:
    up, down = threshold
    heads = class_heads(sets)
    ordered = ordered_shingles(docs, heads, width, threshold)
    parts = fragments(ordered, n_fragments)
    indexed = ordered.filter(F.col("rank") <= F.col("n") - _ceil("n", threshold)).select("shingle", "a", "n", "rank")
    buckets = stored(indexed.groupBy("shingle").agg(F.count("*").alias("bucket")).filter("bucket > 1"), "buckets")
    met = spread_join(indexed, buckets, ["shingle"], hot_keys(buckets, ["shingle"], "bucket"), "a")
    index = stored(met.join(heads.select(F.col("doc_id").alias("a"), "bits"), "a"), "index")
    dropped(buckets, ordered)
    # a bucket's rows are dealt over this many parts, by a
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("bucket") / HOT_ROWS)))
    repeated = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bucket") / HOT_ROWS) - 1))).drop("bucket")
    other = lambda df: df.select("shingle", "bucket", F.col("a").alias("ha"), F.col("n").alias("hn"), F.col("c").alias("hc"), F.col("rank").alias("hrank"), F.col("bits").alias("hbits"))

    links, labels = None, None
    for hubs in (*hub_rounds, None):
        if labels is None:
            at = index.withColumn("c", F.col("a"))
        else:
            at = index.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("c", F.coalesce("component", "a")).drop("component")
        sizes = at.groupBy("shingle", "bucket", "c").agg(F.count("*").alias("size"))
        major = sizes.groupBy("shingle", "bucket").agg(F.max(F.struct("size", "c"))["c"].alias("major"), F.count("*").alias("groups")).filter("groups > 1").drop("groups")
        mixed = stored(dealt(at).join(repeated(major), ["shingle", "part"]).drop("part"), "mixed")
        if hubs:
            first = Window.partitionBy("shingle").orderBy(F.xxhash64("a", F.lit(hubs)), "a")
            chosen = mixed.filter("c = major").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= hubs)
            met = dealt(mixed.filter("c <> major")).join(repeated(other(chosen)), ["shingle", "part"])
        else:
            near = dealt(mixed).withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + _band("n", threshold))))
            rest = repeated(other(mixed.filter("c <> major"))).withColumn("band", _band("hn", threshold))
            met = near.join(rest, ["shingle", "band", "part"]).filter("c <> hc and (c = major or a < ha)")
        pairs = stored(met.filter(may_link(threshold)).select(F.least("a", "ha").alias("a"), F.greatest("a", "ha").alias("b")).distinct(), "pairs")
        close = overlaps(pairs, parts, n_fragments).filter(F.col("overlap") * (up + down) >= (F.col("na") + F.col("nb")) * up)
        found = stored(close.select("a", "b", "overlap", "na", "nb"), "links")
        dropped(mixed, pairs)
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            if labels is not None:
                dropped(labels)
            labels = connected_components(links)
    dropped(index, parts)
    return Found(links if links is not None else found, labels)


def groups(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    sets = stored(shingle_sets(docs, width, threshold), "sets")
    found = link(docs, sets, width, threshold)
    filled = sets.filter("n > 0").select("doc_id", "n", "set_id")
    classes = filled.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    if found.labels is not None:
        classes = classes.join(found.labels.withColumnRenamed("node", "first"), "first", "left").select("set_id", F.coalesce("component", "first").alias("component_id"), "n")
    else:
        classes = classes.select("set_id", F.col("first").alias("component_id"), "n")
    classes = stored(classes, "classes")
    joined = spread_join(filled, classes.drop("n"), ["set_id"], hot_keys(classes, ["set_id"]), "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.union(sets.filter("n = 0").select("doc_id", "n", "doc_id"))


def representatives(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one document of each group, that of the smallest id; of rows that repeat an id, one."""
    member = stored(groups(docs, width, threshold), "groups")
    gone = stored(member.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    again = stored(member.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "again")
    if again.limit(1).count():
        twice = bounded(again)
        once = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(twice, "doc_id", "left_anti").select(*docs.columns).union(once)
    return kept
