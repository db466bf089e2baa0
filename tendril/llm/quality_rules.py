"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

Lines are described by counts taken over whole Arrow batches at once; Viterbi decoding labels the lines of each
document; the share of word characters on content lines decides whether the document is kept.

The field is fitted on a bounded sample of the labelled documents in the input (`FIT_DOCS` of each quality label, those
with the smallest hash of their id, cut into windows of `FIT_LINES` lines over their whole texts, of which `FIT_WINDOWS` of
each label are drawn by hash; that bounds what comes to the driver, however long the texts). It is blended with `DEFAULT` by
the number of documents of the scarcer label (`PRIOR_DOCS`). Labels belong to documents, so the lines of bad
documents are labelled in two steps: a logistic model of single lines, then the field on what that model says.

Defined cases: a null or empty text has no words and fails the base rules; lines without a word are in no sequence;
repeated rows are judged each; an empty table gives an empty result; without labels of both kinds `DEFAULT` is used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, mix

FIT_DOCS = 1500
FIT_LINES = 48
#: Windows of each label that the field learns from at most, and so what comes to the driver: 15 MB.
FIT_WINDOWS = 8000
#: As many documents of the scarcer label weigh as much as DEFAULT.
PRIOR_DOCS = 100
MIN_WORDS = 50
KEEP_SHARE = 0.5

FEATURES = ("bias", "upper", "symbols", "bangs", "digits", "pipes", "length", "word_length", "duplicate", "repeated")

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _marks(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


SYMBOLS = _marks(b"#*$%&|<>")
UPPER = _marks(bytes(range(65, 91)))
LETTER = UPPER | _marks(bytes(range(97, 123)))
DIGIT = _marks(b"0123456789")


@dataclass(frozen=True)
class Field:
    """Scores of a line being content rather than boilerplate, and of neighbours having the same label."""

    weights: tuple[float, ...]
    stay_content: float
    stay_other: float


#: Used where labels of one kind are missing: prose is content; capitals, symbols and repetition are not.
DEFAULT = Field((3.0, -5.0, -3.0, -3.0, -2.0, -6.0, 0.0, 0.0, -1.0, -3.0), 0.5, 0.5)


@dataclass
class Lines:
    """What a batch of texts holds. doc: of each line; the lines without a word are left out of `features`."""

    n_docs: int
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    features: np.ndarray


def read_lines(texts: list[str | None]) -> Lines:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = len(raws)
    text = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)  # every text ends with a line feed of ours
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, n)) if n else np.zeros(0, np.int64)
    stops = np.flatnonzero(text == 10)
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    line_doc = np.searchsorted(ends, starts, side="right")

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[stops] - total[starts]

    def per_doc(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n).astype(np.int64)

    solid = ~SPACE[text]
    points = solid & ((text & 0xC0) != 0x80)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    word_at = np.flatnonzero(begins)
    words, chars, symbols = per_line(begins), per_line(points), per_line(SYMBOLS[text])

    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for r in raws for w in r.split()), np.uint64, len(word_at))
    word_doc = np.searchsorted(ends, word_at, side="right")
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        key = mix(mix(mix(hashes[:-2]) ^ hashes[1:-1]) ^ hashes[2:])
        key = mix(key ^ word_doc[:-2].astype(np.uint64))
        whole = word_doc[:-2] == word_doc[2:]
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            covered[order[twice] + k] = True

    duplicate = np.zeros(len(starts), dtype=bool)
    k = 0
    for raw in raws:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if words[k]:
                if line in seen:
                    duplicate[k] = True
                else:
                    seen.add(line)
            k += 1

    word_line = np.searchsorted(stops, word_at, side="right")
    repeated = np.bincount(word_line, weights=covered, minlength=len(starts))
    kept = np.flatnonzero(words > 0)
    each = lambda mask: np.minimum(per_line(mask)[kept] / words[kept], 1.0)  # noqa: E731  of a kind, a word
    letters = per_line(LETTER[text])[kept]
    features = np.column_stack([
        np.ones(len(kept)),
        per_line(UPPER[text])[kept] / np.maximum(letters, 1),
        np.minimum(symbols[kept] / words[kept] / 3, 1.0),
        each(text == 33),
        each(DIGIT[text]),
        np.minimum(2 * each(text == 124), 1.0),
        np.minimum(np.log1p(words[kept]) / 4, 1.5),
        np.clip((chars[kept] / words[kept] - 5) / 5, -1, 2),
        duplicate[kept],
        repeated[kept] / words[kept],
    ]) if len(kept) else np.zeros((0, len(FEATURES)))
    return Lines(n, per_doc(words, line_doc), per_doc(chars, line_doc), per_doc(symbols, line_doc), per_doc(duplicate, line_doc), np.bincount(word_doc, weights=covered, minlength=n).astype(np.int64), line_doc[kept], chars[kept], features)


def viterbi(scores: np.ndarray, field: Field) -> list[bool]:
    """The best labels (True: content) of a sequence of content-against-boilerplate scores.

    With two labels it is enough to carry the lead of the best path that ends in content over the other.
    """
    stay_c, stay_o = field.stay_content, field.stay_other
    lead, back = 0.0, []
    for k, score in enumerate(scores.tolist()):
        if k:
            # into content: from content (lead + stay_c) or from other (0); into other: from other (stay_o) or content (lead)
            from_content, to_other = lead + stay_c >= 0.0, lead >= stay_o
            back.append((from_content, to_other))
            lead = max(lead + stay_c, 0.0) - max(lead, stay_o)
        lead += score
    if not len(scores):
        return []
    out = [lead >= 0.0]
    for from_content, to_other in reversed(back):
        out.append(from_content if out[-1] else to_other)
    return out[::-1]


def content_shares(lines: Lines, field: Field) -> np.ndarray:
    """Share of word characters on content lines, 0 without words."""
    out = np.zeros(lines.n_docs)
    scores = lines.features @ np.array(field.weights)
    bounds = np.searchsorted(lines.doc, np.arange(lines.n_docs + 1))
    for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if b > a:
            labels = np.array(viterbi(scores[a:b], field))
            out[d] = lines.weight[a:b][labels].sum() / lines.weight[a:b].sum()
    return out


# --- fitting ----------------------------------------------------------------------------------------------------


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_field(windows: list[np.ndarray], good: list[bool], rounds: int = 80, rate: float = 0.2, ridge: float = 0.02) -> Field:
    """Maximum conditional likelihood of the field by gradient ascent, all windows side by side."""
    if not windows or all(good) or not any(good):
        return DEFAULT
    x = np.concatenate(windows)
    doc_good = np.repeat(np.array(good, float), [len(w) for w in windows])
    balance = np.where(doc_good > 0, 0.5 / doc_good.mean(), 0.5 / (1 - doc_good.mean()))
    single = _logistic(x, doc_good, balance)
    line_good = np.where(doc_good > 0, 1.0, (x @ single > 0).astype(float))

    longest, f = max(map(len, windows)), x.shape[1]
    grid, mask, target = np.zeros((len(windows), longest, f)), np.zeros((len(windows), longest)), np.zeros((len(windows), longest))
    at = 0
    for k, w in enumerate(windows):
        grid[k, : len(w)], mask[k, : len(w)], target[k, : len(w)] = w, 1, line_good[at : at + len(w)]
        at += len(w)
    theta = np.concatenate([single, [0.5, 0.5]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:] * mask[:, :-1]
    true_c = (both * target[:, 1:] * target[:, :-1]).sum()
    true_o = (both * (1 - target[:, 1:]) * (1 - target[:, :-1])).sum()
    total = mask.sum()
    for t in range(1, rounds + 1):
        s = grid @ theta[:f]
        sc, so = theta[f:]
        # forward and backward log sums for (content, other)
        fc, fo = np.zeros_like(s), np.zeros_like(s)
        fc[:, 0] = s[:, 0]
        for k in range(1, longest):
            c = np.logaddexp(fc[:, k - 1] + sc, fo[:, k - 1]) + s[:, k]
            o = np.logaddexp(fc[:, k - 1], fo[:, k - 1] + so)
            fc[:, k], fo[:, k] = np.where(mask[:, k] > 0, c, fc[:, k - 1]), np.where(mask[:, k] > 0, o, fo[:, k - 1])
        z = np.logaddexp(fc[:, -1], fo[:, -1])
        bc, bo = np.zeros_like(s), np.zeros_like(s)
        for k in range(longest - 2, -1, -1):
            live = mask[:, k + 1] > 0
            bc[:, k] = np.where(live, np.logaddexp(sc + s[:, k + 1] + bc[:, k + 1], bo[:, k + 1]), 0)
            bo[:, k] = np.where(live, np.logaddexp(s[:, k + 1] + bc[:, k + 1], so + bo[:, k + 1]), 0)
        p = np.exp(fc + bc - z[:, None]) * mask
        pc = np.exp(fc[:, :-1] + sc + s[:, 1:] + bc[:, 1:] - z[:, None]) * both
        po = np.exp(fo[:, :-1] + so + bo[:, 1:] - z[:, None]) * both
        slope = np.concatenate([np.einsum("nt,ntf->f", target * mask - p, grid), [true_c - pc.sum(), true_o - po.sum()]]) / total - ridge * theta / 100
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(tuple(theta[:f].tolist()), float(theta[f]), float(theta[f + 1]))


def blended(field: Field, n_scarcer: int) -> Field:
    """The fitted field and DEFAULT, weighed by the documents of the scarcer label against PRIOR_DOCS.

    So a few rows move the verdict a little, and with more the fit takes over.
    """
    own = n_scarcer / (n_scarcer + PRIOR_DOCS)
    mean = lambda a, b: own * a + (1 - own) * b
    return Field(tuple(map(mean, field.weights, DEFAULT.weights)), mean(field.stay_content, DEFAULT.stay_content), mean(field.stay_other, DEFAULT.stay_other))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES, fit_windows: int = FIT_WINDOWS) -> Field:
    """Fit on labelled documents that `docs` has: `fit_docs` of each label at most, and of the windows of their whole texts `fit_windows` of each label, drawn by hash."""
    labelled = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    present = labelled.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for value in (0, 1):
        part = present.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        chosen = part if chosen is None else chosen.union(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = read_lines(batch.column(0).to_pylist())
        bounds = np.searchsorted(lines.doc, np.arange(lines.n_docs + 1))
        every = [(d, k) for d in range(lines.n_docs) for k in range(int(bounds[d]), int(bounds[d + 1]), fit_lines)]
        own = batch.take(pa.array([d for d, _ in every], pa.int64()))
        windows = [lines.features[k : min(k + fit_lines, int(bounds[d + 1]))].astype("<f4").tobytes() for d, k in every]
        return pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array([k - int(bounds[d]) for d, k in every], pa.int64()), pa.array(windows, pa.binary())], names=["quality", "doc_id", "at", "lines"])

    kind = dict(docs.dtypes)["doc_id"]
    every = map_columns(sample, ["text", "quality", "doc_id"], cut, f"quality int, doc_id {kind}, at long, lines binary")
    n_docs = {r["quality"]: r["n"] for r in every.filter("at = 0").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    windows, good = [], []
    for value in (0, 1):
        drawn = every.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id", "at"), "lines").limit(fit_windows)
        for r in drawn.select("lines").collect():
            windows.append(np.frombuffer(r["lines"], "<f4").reshape(-1, len(FEATURES)).astype(float))
            good.append(value == 1)
    return blended(fit_field(windows, good), min(n_docs.get(0, 0), n_docs.get(1, 0)))


# --- judging ----------------------------------------------------------------------------------------------------

VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, field: Field, carry: list[str] | None = None, min_words: int = MIN_WORDS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The columns `carry` (doc_id if not given) and the counts and verdict of each document."""
    carry = carry or ["doc_id"]
    slots = [f"_c{i}" for i in range(len(carry))]
    own = [c.split()[0] for c in VERDICT.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = read_lines(batch.column(len(slots)).to_pylist())
        share = content_shares(lines, field)
        failed = (lines.n_words < min_words) | (100 * lines.n_repeat_words > 50 * lines.n_words)
        found = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, failed, share, ~failed & (share >= keep_share)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(slots)], *map(pa.array, found)], names=[*slots, *own])

    kinds = dict(docs.dtypes)
    named = docs.select(*(F.col(c).alias(s) for c, s in zip(carry, slots, strict=True)), F.col("text").alias("_text"))
    schema = ", ".join([*(f"{s} {kinds[c]}" for s, c in zip(slots, carry, strict=True)), VERDICT])
    out = map_columns(named, named.columns, run, schema)
    return out.select(*(F.col(s).alias(c) for s, c in zip(slots, carry, strict=True)), *own)


def keep(docs: DataFrame, field: Field) -> DataFrame:
    """The documents that pass, with their own columns (whatever their names)."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns), F.col("text"))
    kept = judge(inner, field, [c for c in inner.columns if c != "text"]).filter("kept")
    return kept.select(*(F.col(f"`in_{c}`").alias(c) for c in docs.columns))
