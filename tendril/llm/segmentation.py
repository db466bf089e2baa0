"""SentencePiece encoding and decoding, with distinct sampled segmentations (Gumbel top-k without replacement).

The pieces of a text form a lattice; a segmentation is a path. The vocabulary file is a merge model whose scores are
ranks, so a piece weighs 1 / (2 + rank) and a path the product of its pieces to the power `alpha`, over the sum of all.

A perturbed A-star search finds the k segmentations with the largest log probability plus Gumbel noise, which is a
sample without replacement. A node is a prefix and the choices already taken there; its key is the perturbed value of the
best path below it, so the bound is exact: the root draws Gumbel(0), the best child keeps its parent's key, and all other
children together draw one Gumbel of their joint mass, truncated at that key. The node with the largest key is taken,
and its path drawn to the end. The key left on top after k paths is the threshold for the inclusion probability
1 - exp(-exp(log p - threshold)), given as its logarithm.

No piece leads from a character into a space mark, so lattices are built once for each different word of a slice of
texts, all of them at the same time, and all texts of the slice draw their next pieces side by side. Every draw is a
hash of seed, row key, sample, word and step: a row gets the same samples on any cluster.

Defined cases: a null or empty text has one segmentation, without pieces, with log probability 0; a text with fewer than
k segmentations gives all it has; rows with equal id and text get equal samples; a null id is a key like any other; the
space mark U+2581 in a text is read as a space, as the model does; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns, mix

SAMPLES = 3
ALPHA = 1.0
SEED = 11
SLICE_TEXT = 384 << 10
#: Rows of lattices that a worker keeps from slice to slice, about 115 bytes each, 150 with a larger vocabulary.
KEPT_ROWS = 700_000

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_VOCABULARIES: dict[str, "Vocabulary"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def split(text: str) -> list[str]:
    """Words of a text without the space mark that each begins with."""
    words = text.split(" ")
    if "" in words or MARK in text:
        words = [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
    return words


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _longer(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) ^ (points + np.uint64(1)))


class Vocabulary:
    """Pieces of a model file, found by the hashes of their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.id_kind = np.int16 if size < 1 << 15 else np.int32  # -1 and -2 are no pieces
        self.spelled: list[bytes] = [b""] * size
        self.bytes = np.zeros(256, np.int64)
        pieces: dict[str, tuple[int, float]] = {}
        for i in range(size):
            if self.model.is_byte(i):
                value = int(self.model.id_to_piece(i)[3:5], 16)
                self.bytes[value], self.spelled[i] = i, bytes([value])
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                piece = self.model.id_to_piece(i)
                self.spelled[i] = piece.replace(MARK, " ").encode("utf-8")
                pieces[piece] = (i, -float(np.log(2 + min(-self.model.get_score(i), size))))
        self.spelled_array = pa.array(self.spelled, pa.large_binary())
        self.byte_weight = -float(np.log(2 + size))
        self.longest = max(map(len, pieces))
        self.weights = np.full(size + 2, self.byte_weight)  # by id; the last two are for what is no piece
        for i, log_weight in pieces.values():
            self.weights[i] = log_weight
        #: By length: sorted hashes of prefixes, piece id (-1: a prefix only) and log weight.
        self.levels = []
        for length in range(1, self.longest + 1):
            prefixes = sorted({p[:length] for p in pieces if len(p) >= length})
            hashes = np.zeros(len(prefixes), np.uint64)
            grid = np.array([_points(p) for p in prefixes])
            for k in range(length):
                hashes = _longer(hashes, grid[:, k])
            order = np.argsort(hashes)
            ids = np.array([pieces.get(p, (-1, 0.0))[0] for p in prefixes])[order]
            weights = np.array([pieces.get(p, (-1, -np.inf))[1] for p in prefixes])[order]
            self.levels.append((hashes[order], ids, weights))


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


@dataclass
class Lattice:
    """Lattices of different words, end to end. Row: a position; column: pieces by length - 1; the last row of a word is its end."""

    end: np.ndarray  # of each row: is it a word's end
    ids: np.ndarray  # -1: no piece, -2: the bytes of one character beyond ASCII
    reach: np.ndarray  # chance of the pieces up to a column, given the position; 0 where there is no piece, over 1 at the last one
    mass: np.ndarray  # log mass of the paths from a position to the end
    points: np.ndarray


def lattice(words: list[str], lengths: np.ndarray, known: Vocabulary, alpha: float, into: Lattice) -> np.ndarray:
    """Write the lattices of some words, given without their first mark but with lengths that count it, and give the first row of each. into: rows for all of them."""
    points, is_end, ids, mass, reach = into.points, into.end, into.ids, into.mass, into.reach
    points[:] = _points((MARK + f"\0{MARK}".join([*words, ""]))[:-1])
    ends = np.cumsum(lengths + 1) - 1
    is_end[:] = False
    is_end[ends] = True
    points[ends] = np.uint64(2**32)  # no character; a NUL of a text stays one

    width = known.longest
    ids[:], mass[:], reach[:] = -1, 0.0, 0.0
    flat = ids.reshape(-1)
    alive = np.flatnonzero(~is_end)
    hashes = np.zeros(len(alive), np.uint64)
    rows, columns, weights = [], [], []  # of the pieces
    for k, (prefixes, piece, log_weight) in enumerate(known.levels):
        inside = alive + k < len(points)
        if not inside.all():
            alive, hashes = alive[inside], hashes[inside]
        if not len(alive):
            break
        hashes = _longer(hashes, points.take(alive + k))
        at = np.minimum(np.searchsorted(prefixes, hashes), len(prefixes) - 1)
        hit = prefixes.take(at) == hashes
        if k == 0:
            lost = alive[~hit | (piece[at] < 0)]
            ids[lost, 0] = np.where(points[lost] < 0x80, known.bytes[np.minimum(points[lost], 0x7F).astype(np.int64)], -2)
            rows.append(lost)
            columns.append(np.zeros(len(lost), np.int64))
            weights.append(alpha * known.byte_weight * _byte_count(points[lost]))
        hit = np.flatnonzero(hit)
        alive, hashes, at = alive.take(hit), hashes.take(hit), at.take(hit)
        whole = np.flatnonzero(piece.take(at) >= 0)
        found, at = alive.take(whole), at.take(whole)
        flat[found * width + k] = piece.take(at)
        rows.append(found)
        columns.append(np.full(len(found), k))
        weights.append(alpha * log_weight.take(at))

    # log mass of what follows each position, from the ends back, all words at the same time
    row, column, weight = np.concatenate(rows), np.concatenate(columns), np.concatenate(weights)
    to_end = np.repeat(ends, lengths + 1) - np.arange(len(points))
    cells = row * width + column
    left = to_end.take(row)
    order = np.argsort(cells, kind="stable")  # of runs that are sorted: merged
    left = left.take(order)
    order = order.take(np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable"))
    row, column, weight = row.take(order), column.take(order), weight.take(order)
    firsts = np.flatnonzero(np.diff(row, prepend=-1))
    borders = np.searchsorted(to_end.take(row.take(firsts)), np.arange(1, int(lengths.max(initial=0)) + 2))
    chance = np.zeros(len(row))
    for a, b in zip(borders, borders[1:], strict=False):
        lo, hi = firsts[a], firsts[b] if b < len(firsts) else len(row)
        values = weight[lo:hi] + mass.take(row[lo:hi] + column[lo:hi] + 1)
        groups = firsts[a:b] - lo
        sizes = np.diff(groups, append=hi - lo)
        top = np.maximum.reduceat(values, groups)
        values = np.exp(values - np.repeat(top, sizes))
        total = np.add.reduceat(values, groups)
        mass[row[firsts[a:b]]] = top + np.log(total)
        chance[lo:hi] = values / np.repeat(total, sizes)
    sums = np.cumsum(chance)
    sizes = np.diff(firsts, append=len(row))
    reached = sums - np.repeat(sums[firsts] - chance[firsts], sizes)
    reached[firsts + sizes - 1] = 2.0
    reach.reshape(-1)[row * width + column] = reached
    return ends - lengths


def _byte_count(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)


class Store:
    """Lattices of the words that come again and again, up to KEPT_ROWS rows, followed by those of the slice at hand."""

    def __init__(self, known: Vocabulary, alpha: float):
        self.known, self.alpha = known, alpha
        self.kept: dict[str, int] = {}
        self.rows = 0
        width = known.longest
        self.room = [np.zeros((KEPT_ROWS, *shape), kind) for shape, kind in (((), bool), ((width,), known.id_kind), ((width,), np.float32), ((), np.float64), ((), np.uint64))]

    def of(self, words: dict[str, int]) -> tuple[Lattice, np.ndarray]:
        """The lattices, and the first row of each word. words: in order of their numbers."""
        get = self.kept.get
        places = [get(w, -1) for w in words]
        fresh = [w for w, at in zip(words, places, strict=True) if at < 0]
        starts = np.array(places, np.int64)
        if not fresh:
            return Lattice(*(x[: self.rows] for x in self.room)), starts
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
        size = self.rows + int(lengths.sum()) + len(fresh)
        if size > len(self.room[0]):
            self.room = [np.concatenate((x[: self.rows], np.zeros((size - self.rows + size // 4, *x.shape[1:]), x.dtype))) for x in self.room]
        first = lattice(fresh, lengths, self.known, self.alpha, Lattice(*(x[self.rows : size] for x in self.room)))
        starts[starts < 0] = first + self.rows
        return Lattice(*(x[:size] for x in self.room)), starts

    def keep(self, words: dict[str, int], counts: np.ndarray, starts: np.ndarray, least: int = 2) -> None:
        """Move the lattices of the slice's frequent new words to the kept ones."""
        named = list(words)
        chosen = np.flatnonzero((counts >= least) & (starts >= self.rows))
        sizes = np.fromiter((len(named[k]) + 2 for k in chosen.tolist()), np.int64, len(chosen))
        ends = np.cumsum(sizes)
        fits = int(np.searchsorted(ends, KEPT_ROWS - self.rows, side="right"))
        if not fits:
            return
        chosen, sizes, ends = chosen[:fits], sizes[:fits], ends[:fits]
        rows = np.arange(ends[-1]) + np.repeat(starts.take(chosen) - ends + sizes, sizes)
        for room in self.room:
            room[self.rows : self.rows + len(rows)] = room.take(rows, axis=0)
        self.kept.update(zip(map(named.__getitem__, chosen.tolist()), (self.rows + ends - sizes).tolist(), strict=True))
        self.rows += len(rows)


_STORES: dict[tuple[str, float], Store] = {}


def salted(keys: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    if isinstance(salt, np.ndarray):
        return mix(keys ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))
    return mix(keys ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def uniform(keys: np.ndarray, *salts: int | np.ndarray) -> np.ndarray:
    """In (0, 1), a hash of keys and salts; an array of salts has one for each key."""
    h = keys
    for salt in salts:
        h = salted(h, salt)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel with the location `mass`, truncated at `bound`."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) - np.log(u)))


@dataclass
class Path:
    """The pieces of one segmentation in order: word of the text, row of the lattice, column; log chance of each."""

    word: np.ndarray
    row: np.ndarray
    column: np.ndarray
    log: np.ndarray


def logs(lat: Lattice, rows: np.ndarray, columns: np.ndarray, known: Vocabulary, alpha: float) -> np.ndarray:
    """Log chance of pieces, given their positions."""
    ids = lat.ids.ravel().take(rows * lat.ids.shape[1] + columns)
    weight = alpha * known.weights.take(ids, mode="wrap")
    if (beyond := ids == -2).any():
        weight[beyond] = alpha * known.byte_weight * _byte_count(lat.points[rows[beyond]])
    return np.minimum(weight + lat.mass.take(rows + columns + 1) - lat.mass.take(rows), 0.0)


def draw(lat: Lattice, keys: np.ndarray, words: np.ndarray, rows: np.ndarray, sample: int, known: Vocabulary, alpha: float) -> Path:
    """Ancestral draws from each given row to the end of its word; words: index into keys, ascending."""
    out = []
    active, row, step = words, rows, 0
    keys = salted(keys, sample)
    while True:
        going = np.flatnonzero(~lat.end.take(row))
        active, row = active.take(going), row.take(going)
        if not len(active):
            break
        u = uniform(keys.take(active), step).astype(np.float32)
        column = np.argmax(lat.reach.take(row, axis=0) >= u[:, None], axis=1)  # u is over 0: a column without a piece is never taken
        out.append((active, row, column))
        row = row + column + 1
        step += 1
    if not out:
        return Path(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0))
    word, row, column = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(word, kind="stable")
    word, row, column = word.take(order), row.take(order), column.take(order)
    return Path(word, row, column, logs(lat, row, column, known, alpha))


@dataclass
class Drawn:
    path: Path
    log_prob: float
    perturbed: float
    log_inclusion: float = 0.0


#: No draw of a Gumbel lies further above its location than this (53 bits).
HIGHEST = 37.0


#: Steps whose log mass is below this are looked at only if they could still matter.
NEAR = -60.0


def other_keys(log: np.ndarray, sums: np.ndarray, key: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Keys of the groups of other children at steps of paths: log chance of the step, log mass before it, key of the path."""
    rest = -np.expm1(log)
    rest[rest < 1e-12] = 0.0
    with np.errstate(divide="ignore"):
        return below(sums + np.log(rest), key, u)


def other_child(lat: Lattice, known: Vocabulary, alpha: float, text_keys: np.ndarray, word_row: np.ndarray, bounds: np.ndarray, popped: list[tuple], sample: int) -> tuple[np.ndarray, ...]:
    """Of a node of each text (text, -key, serial, path, step, columns taken there, log mass before it) a column that is not taken: itself, its log chance, and the key of all that are left (-inf: none)."""
    text, key, before = (np.array([x[k] for x in popped]) for k in (0, 1, 6))
    word, row = (np.array([getattr(path, of)[step] for *_, path, step, _, _ in popped]) for of in ("word", "row"))
    free = lat.ids.take(row, axis=0) != -1
    for k, (*_, taken, _) in enumerate(popped):
        free[k, list(taken)] = False
    node, columns = np.nonzero(free)
    log = np.zeros(free.shape)
    log[node, columns] = logs(lat, row.take(node), columns, known, alpha)
    share = np.where(free, np.exp(log), 0.0)
    total = np.cumsum(share, axis=1)
    word_key = text_keys.take(text) ^ mix((word - bounds.take(text)).astype(np.uint64))
    place = row - word_row.take(word)
    count = free.sum(axis=1)
    chosen = np.minimum((free & (total < (uniform(word_key, sample, place, 13) * total[:, -1])[:, None])).sum(axis=1), count - 1)
    column = np.argmax(np.cumsum(free, axis=1) > chosen[:, None], axis=1)
    at = np.arange(len(popped)), column
    left = total[:, -1] - share[at]
    more = (count > 1) & (left > 1e-12)
    value = below(before + np.log(np.where(more, left, 1.0)), -key, uniform(word_key, sample, place, 17))
    return column, log[at], np.where(more, value, -np.inf)


def search(lat: Lattice, known: Vocabulary, alpha: float, keys: np.ndarray, text_keys: np.ndarray, word_row: np.ndarray, bounds: np.ndarray, k: int) -> list[list[Drawn]]:
    """For each text its k segmentations or all. bounds: words bounds[t]..bounds[t + 1] are text t's; word_row: start of each."""
    n = len(text_keys)
    root = -np.log(-np.log(uniform(text_keys, 1)))
    found: list[list[Drawn]] = [[] for _ in range(n)]
    # a node: (-key, serial, path, step, columns taken there, log mass before the step)
    heaps: list[list[tuple]] = [[] for _ in range(n)]
    serial = 0
    jobs = [(t, root[t], None, 0, 0.0) for t in range(n)]  # text, key, prefix, its length, its log mass
    for sample in range(k):
        words, rows = [], []
        for t, _key, prefix, size, _ in jobs:
            lo, hi = bounds[t], bounds[t + 1]
            start = word_row[lo:hi]
            if prefix is not None:
                lo = prefix.word[size - 1]
                start = np.concatenate(([prefix.row[size - 1] + prefix.column[size - 1] + 1], word_row[lo + 1 : hi]))
            words.append(np.arange(lo, hi))
            rows.append(start)
        if not jobs:
            break
        drawn = draw(lat, keys, np.concatenate(words), np.concatenate(rows), sample, known, alpha)
        cut = np.searchsorted(drawn.word, np.array([[bounds[t], bounds[t + 1]] for t, *_ in jobs]).reshape(-1, 2))
        sizes = cut[:, 1] - cut[:, 0]
        sums = np.concatenate(([0.0], np.cumsum(drawn.log)))
        shift = np.array([before for *_, before in jobs]) - sums[cut[:, 0]]
        before_step = sums[:-1] + np.repeat(shift, sizes)
        path_key = np.repeat(np.array([float(key) for _, key, *_ in jobs]), sizes)
        # a draw is known by row key, word and place in the word, whatever else the slice holds
        number = lambda at: uniform(keys[drawn.word[at]] ^ mix((drawn.row[at] - word_row[drawn.word[at]]).astype(np.uint64)), sample, 7)  # noqa: E731, B023
        near = np.flatnonzero(before_step > NEAR)
        near_keys = other_keys(drawn.log[near], before_step[near], path_key[near], number(near))
        near_cut = np.searchsorted(near, cut)
        for (t, key, prefix, size, before), (a, b), (na, nb) in zip(jobs, cut.tolist(), near_cut.tolist(), strict=True):
            path = Path(drawn.word[a:b], drawn.row[a:b], drawn.column[a:b], drawn.log[a:b])
            others = near_keys[na:nb]
            if nb - na < b - a and not (nb - na >= k and np.partition(others, -k)[-k] > before_step[a + nb - na] + HIGHEST):
                others = other_keys(path.log, before_step[a:b], path_key[a:b], number(np.arange(a, b)))
            best = np.argpartition(-others, k)[:k] if len(others) > k else np.arange(len(others))
            whole = path
            if prefix is not None:
                whole = Path(*(np.concatenate((x[:size], y)) for x, y in ((prefix.word, path.word), (prefix.row, path.row), (prefix.column, path.column), (prefix.log, path.log))))
            found[t].append(Drawn(whole, float(before + sums[b] - sums[a]), float(key)))
            for j in best.tolist():
                if others[j] > -np.inf:
                    serial += 1
                    heapq.heappush(heaps[t], (-float(others[j]), serial, whole, size + j, (int(path.column[j]),), float(before_step[a + j])))
        jobs = []
        if sample == k - 1:
            break
        popped = [(t, *heapq.heappop(heap)) for t, heap in enumerate(heaps) if heap]
        if not popped:
            break
        column, chance, value = other_child(lat, known, alpha, text_keys, word_row, bounds, popped, sample)
        for (t, key, _, path, step, taken, before), c, log, left in zip(popped, column.tolist(), chance.tolist(), value.tolist(), strict=True):
            if left > -np.inf:
                serial += 1
                heapq.heappush(heaps[t], (-left, serial, path, step, (*taken, c), before))
            prefix = Path(*(np.concatenate((x[:step], [y])) for x, y in ((path.word, path.word[step]), (path.row, path.row[step]), (path.column, c), (path.log, log))))
            jobs.append((t, -key, prefix, step + 1, before + log))
    for t in range(n):
        threshold = -heaps[t][0][0] if heaps[t] and len(found[t]) == k else -np.inf
        for x in found[t]:
            rate = x.log_prob - threshold
            # log(1 - exp(-e^rate)); of all there are, each is included surely
            x.log_inclusion = 0.0 if np.isneginf(threshold) else float(np.log(-np.expm1(-np.exp(rate)))) if rate > -30 else rate
    return found


def piece_ids(lat: Lattice, path: Path, known: Vocabulary) -> np.ndarray:
    ids = lat.ids.ravel().take(path.row * lat.ids.shape[1] + path.column).astype(np.int64)
    if not len(ids) or ids.min() >= 0:
        return ids
    parts, done = [], 0
    for at in np.flatnonzero(ids < 0).tolist():
        parts += [ids[done:at], known.bytes[list(chr(int(lat.points[path.row[at]])).encode("utf-8", "surrogatepass"))]]
        done = at + 1
    return np.concatenate([*parts, ids[done:]])


def sampled(texts: list[str], row_keys: np.ndarray, known: Vocabulary, k: int, alpha: float) -> list[list[tuple[Drawn, np.ndarray]]]:
    """For each text its samples with their piece ids."""
    words: list[str] = []
    bounds = [0]
    for text in texts:
        if text:
            words += split(text)
        bounds.append(len(words))
    seen = {w: i for i, w in enumerate(dict.fromkeys(words))}
    kinds = list(map(seen.__getitem__, words))
    ends, numbers = np.array(bounds), np.array(kinds, np.int64)
    if (known.path, alpha) not in _STORES:
        _STORES[known.path, alpha] = Store(known, alpha)
    store = _STORES[known.path, alpha]
    counts = np.bincount(numbers, minlength=len(seen))
    lat, starts = store.of(seen)
    place = np.arange(len(kinds)) - np.repeat(ends[:-1], np.diff(ends))
    keys = mix(np.repeat(row_keys, np.diff(ends)) ^ mix(place.astype(np.uint64)))
    word_row = starts.take(numbers)
    out = [[(x, piece_ids(lat, x.path, known)) for x in each] for each in search(lat, known, alpha, keys, row_keys, word_row, ends, k)]
    store.keep(seen, counts, starts)
    return out


# --- over tables ------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, sample int, ids binary, n_pieces long, log_prob double, perturbed double, log_inclusion double"


def sample(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, model: str | None = None, with_text: bool = False) -> DataFrame:
    """Per document and sample (from 1, by falling perturbed value): ids (little-endian unsigned 32-bit) and scores.

    with_text: also the text that the ids decode to, made in the same Python function.
    """
    path, schema = model or default_model(), SCHEMA + ", text string" * with_text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary(path)
        doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        row_keys = mix(np.array([(d if d is not None else -(1 << 63)) & 0xFFFFFFFFFFFFFFFF for d in doc_ids], np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rows = [(d, i + 1, ids.astype("<u4").tobytes(), len(ids), x.log_prob, x.perturbed, x.log_inclusion) for d, each in zip(doc_ids, sampled(texts, row_keys, known, k, alpha), strict=True) for i, (x, ids) in enumerate(each)]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        if with_text:
            columns.append(pa.array(decoded([np.frombuffer(r[2], "<u4") for r in rows], known), pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return map_columns(docs, ["doc_id", "text"], run, schema, SLICE_TEXT)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids: the model's own segmentation."""
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = vocabulary(path).model.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return map_columns(docs, ["doc_id", "text"], run, "doc_id long, ids binary")


def decoded(ids: list[np.ndarray], known: Vocabulary) -> list[str]:
    """The text of each array of ids; the pieces of all of them are looked up together and come end to end."""
    ends = np.cumsum([0, *map(len, ids)])
    if not ends[-1]:
        return [""] * len(ids)
    _, places, pieces = known.spelled_array.take(pa.array(np.concatenate(ids))).buffers()
    edges = np.frombuffer(places, np.int64)[ends].tolist()
    return [str(pieces[a + 1 : b], "utf-8", "replace") if b > a else "" for a, b in zip(edges, edges[1:], strict=False)]


def decode(encoded: DataFrame, carry: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """The columns `carry` and text, from ids (null or empty: the empty text)."""
    path, kinds = model or default_model(), dict(encoded.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary(path)
        texts = pa.array(decoded([np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column(len(carry))], known), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], texts], names=[*carry, "text"])

    return map_columns(encoded, [*carry, "ids"], run, ", ".join([*(f"{c} {kinds[c]}" for c in carry), "text string"]))
