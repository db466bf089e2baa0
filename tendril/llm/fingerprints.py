"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document and two
sketches compare like the sets they stand for, however unequal. The sketch of a union is made from the two sketches. A
set of at most SMALL hashes is kept whole, so two short texts compare exactly; against a longer one it counts with its
hashes below the threshold. What is lost: of n shingles none is below it with chance (1 - 1/SCALE)^n (a third for 4, a
tenth for 8, 1 % for 16), and then a short text looks foreign to every long one.

A fingerprint is the sketch written as text: the kept hashes in ascending order, 16 hexadecimal digits each, joined; a
`=` before them says that the set is whole. A longer set without a hash below the threshold keeps its smallest one, so that
equal texts look equal; with anything else it has nothing in common.

Defined cases: a null or empty text, or one without words, has the empty fingerprint; two empty fingerprints are alike
(1), an empty and another are not (0); repeated rows each have their place in the order of doc_id (ties by text);
null ids come first; a single document is its own next one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shingle_set, slices, stored

WIDTH = 5
#: One hash in so many is kept.
SCALE = 4
#: Sets up to this size are kept whole.
SMALL = 32
#: Rows of documents that one range of ids should have, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4000, 50_000


@dataclass(frozen=True)
class Sketch:
    """Kept hashes, sorted; whole: they are the whole set."""

    kept: np.ndarray
    whole: bool


def sketch(shingles: np.ndarray, scale: int = SCALE) -> Sketch:
    """Of sorted hashes all, if they are few, or else those below the threshold (the smallest one if there is none)."""
    if len(shingles) <= SMALL:
        return Sketch(shingles, True)
    low = below(shingles, scale)
    return Sketch(low if len(low) else shingles[:1], False)


def below(kept: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return kept[: np.searchsorted(kept, np.uint64(2**64 // scale))]


def alike(a: Sketch, b: Sketch, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of two sketches cut to what both speak of."""
    return (a.kept, b.kept) if a.whole == b.whole else (below(a.kept, scale), below(b.kept, scale))


def fingerprint(of: Sketch) -> str:
    return ("=" if of.whole and len(of.kept) else "") + of.kept.astype(">u8").tobytes().hex()


def parsed(text: str) -> Sketch:
    return Sketch(np.frombuffer(bytes.fromhex(text.removeprefix("=")), ">u8").astype(np.uint64), text.startswith("=") or not text)


def merge(a: Sketch, b: Sketch, scale: int = SCALE) -> Sketch:
    """The sketch of the union of two sets."""
    if not len(a.kept) or not len(b.kept):
        return a if len(a.kept) else b
    if a.whole and b.whole:
        return sketch(np.union1d(a.kept, b.kept), scale)
    low = below(np.union1d(a.kept, b.kept), scale)
    return Sketch(low if len(low) else np.minimum(a.kept[:1], b.kept[:1]), False)


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: Sketch, b: Sketch, scale: int = SCALE) -> float:
    """Estimated share of a's set that is in b's."""
    if not len(a.kept) or not len(b.kept):
        return float(not len(a.kept) and not len(b.kept))
    own, other = alike(a, b, scale)
    return common(own, other) / len(own) if len(own) else 0.0


def likeness(a: Sketch, b: Sketch, scale: int = SCALE) -> float:
    """Estimated containment of the smaller set in the larger, 0 to 1."""
    own, other = alike(a, b, scale)
    return containment(*((a, b) if len(own) <= len(other) else (b, a)), scale)


def resemblance(a: Sketch, b: Sketch, scale: int = SCALE) -> float:
    """Estimated Jaccard similarity, 0 to 1."""
    if not len(a.kept) or not len(b.kept):
        return float(len(a.kept) == len(b.kept))
    own, other = alike(a, b, scale)
    both = common(own, other)
    return both / (len(own) + len(other) - both) if len(own) + len(other) else 0.0


def in_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, range, tail) and the number of ranges: documents by ranges of doc_id, each range with the first row of the next one as its tail.

    The cuts are approximate quantiles of the ids, as many as there are rows to part (MOST_RANGES at most); nothing else
    comes to the driver. A whole text moves once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = min(MOST_RANGES, max(1, -(-rows.count() // RANGE_ROWS)))
    cuts = sorted(set(rows.select("doc_id").agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0] or []))
    # place of the id among the cuts: among every sqrt(n)-th of them first, then among those up to the next
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda values: F.expr("cast(split('" + ",".join(map(str, values)) + "', ',') as array<long>)") if values else F.array().cast("array<long>")
    fine, coarse = array(cuts), array(cuts[step - 1 :: step])
    first = lambda bounds: F.array_position(F.transform(bounds, lambda c: F.col("doc_id") < c), F.lit(True)).cast("int")
    block = rows.withColumn("block", F.when(first(coarse) > 0, first(coarse) - 1).otherwise(len(cuts) // step))
    among = first(F.slice(fine, F.col("block") * step + 1, F.lit(step)))
    placed = block.withColumn("range", F.when(F.col("doc_id").isNull(), 0).when(among > 0, F.col("block") * step + among - 1).otherwise(len(cuts))).drop("block")
    heads = placed.groupBy("range").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("at"), "text", "doc_id")).alias("head"))
    heads = stored(heads, "heads")
    # at most MOST_RANGES rows: the head of each range becomes the tail of the one before, that of the first of the last
    before = heads.select("range", F.lag("range").over(Window.orderBy("range")).alias("to"), F.max("range").over(Window.partitionBy(F.lit(0))).alias("last"))
    before = before.select("range", F.coalesce("to", "last").alias("to"))
    tails = heads.join(F.broadcast(before), "range").select("head.doc_id", "head.text", F.col("to").alias("range"), F.lit(1).alias("tail"))
    return placed.select("doc_id", "text", "range", F.lit(0).alias("tail")).union(tails), len(cuts) + 1


@dataclass
class _Read:
    doc_id: int | None
    text: str
    kept: Sketch


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def compare_with_next(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    Edited: the last floor(n/2) code points replaced by the first as many (or all) of the next document by doc_id.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def row(this: _Read, after: _Read) -> tuple:
        half = len(this.text) // 2
        edited = this.text[: len(this.text) - half] + after.text[:half]
        changed = sketch(shingle_set(edited, width), scale)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (this.doc_id, len(this.text), digest, fingerprint(this.kept), fingerprint(changed), likeness(this.kept, changed, scale), likeness(this.kept, after.kept, scale), resemblance(this.kept, changed, scale), resemblance(this.kept, after.kept, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_range, held_tail = None, None, 1
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, text, at, tail in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    now = _Read(doc_id, text, sketch(shingle_set(text, width), scale))
                    if held is not None and not held_tail and held_range == at:
                        out.append(row(held, now))
                    held, held_range, held_tail = now, at, tail
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=names)

    arrow = [pa.field(n, pa.int64() if n in ("doc_id", "n_chars") else pa.float64() if n.startswith(("near", "jaccard")) else pa.string()) for n in names]
    ranged, parts = in_ranges(docs)
    # each range is a task of its own, whatever its hash
    ranged = ranged.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), "text")
    return ranged.select("doc_id", "text", "range", "tail").mapInArrow(run, SCHEMA)
