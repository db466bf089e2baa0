"""Best-fit packing of token sequences by bin completion.

The packer never looks at single pieces: it solves the problem on the histogram of piece lengths (at most
`capacity` rows whatever the input), where a filling is used for as many sequences as the counts allow. The
resulting plan is a list of runs "the pieces of length L with ranks lo..hi go to sequences s..., at offset o",
and Spark hands the pieces to the runs by their rank within their length.

Defined cases: a null or empty text is one piece that holds the end token alone; repeated rows are packed
each; very long texts are cut into whole sequences; an empty table gives an empty result. `token_pieces` reads doc_id and
text only; `pack` carries other columns along, whatever their names, and replaces sequence_id and offset.
"""

from __future__ import annotations

import array
import base64
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, stored

CAPACITY = 2048
END_ID = 0
#: Search effort of the branch-and-bound: nodes, and undominated fillings tried at each, the tightest first. Beyond it the best packing
#: found so far is used. None lifts a limit; without both the search is complete, and the packing has the fewest sequences.
MAX_NODES: int | None = 3000
MAX_FILLINGS: int | None = 8
#: Fillings looked at for each one that is tried, in a limited search.
TRIES = 8

_ENCODERS: dict[str, object] = {}


def special_tokens(vocabulary: str) -> dict[str, int]:
    """Strings that are one token wherever they stand in a text, from the .json of that name."""
    named = Path(vocabulary).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(named.read_text(encoding="utf-8"))["added_tokens"]} if named.exists() else {}


def encoder(vocabulary: str):
    """text -> ids. A .tiktoken file holds the same merges as the .json of that name and is several times faster."""
    if vocabulary not in _ENCODERS:
        if vocabulary.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special_tokens(vocabulary))
            _ENCODERS[vocabulary] = lambda text: known.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            known = Tokenizer.from_file(vocabulary)
            _ENCODERS[vocabulary] = lambda text: known.encode(text, add_special_tokens=False).ids
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokens of each document and the end token, cut into pieces of at most `capacity` ids.

    Only longer documents are cut: whole pieces of `capacity` from the end, so the first piece may be shorter.
    ids: little-endian unsigned 32-bit.
    """
    path = vocabulary or default_vocabulary()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path)
        doc_ids, pieces, starts, lengths, ids = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = encode(text.as_py() or "")
            tokens.append(end_id)
            n = len(tokens)
            raw = array.array("I", tokens).tobytes()
            bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                doc_ids.append(doc_id)
                pieces.append(k)
                starts.append(a)
                lengths.append(b - a)
                ids.append(raw[4 * a : 4 * b])
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return map_columns(docs, ["doc_id", "text"], cut, PIECES)


# --- the packing plan -------------------------------------------------------------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: [(filling, number of sequences)]."""
    open_bins: dict[int, list[list]] = {}  # room left -> [[filling, number]]
    rooms: list[int] = []

    def put(room: int, filling: Filling, number: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append([filling, number])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, (), -(-left // (capacity // length)))
                continue
            room = rooms[at]
            filling, number = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            each = room // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            if full:
                put(room - each * length, (*filling, (length, each)), full)
            if rest:
                put(room - rest * length, (*filling, (length, rest)), 1)
            if untouched := number - full - bool(rest):
                put(room, filling, untouched)
            left -= full * each + rest
    return [(filling, number) for bins in open_bins.values() for filling, number in bins if filling]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each k, pieces over capacity - k stand alone, and what the halves leave takes pieces from k on."""
    if not counts:
        return 0
    number = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        number[length] = n
    total = number * np.arange(capacity + 2)
    # sums over the pieces of a length or more
    n_from, t_from = number[::-1].cumsum()[::-1], total[::-1].cumsum()[::-1]
    half = capacity // 2
    k = np.arange(half + 1)
    over = n_from[half + 1]  # pieces over half: each in a sequence of its own
    n2 = over - n_from[capacity - k + 1]
    t2 = t_from[half + 1] - t_from[capacity - k + 1]
    t3 = t_from[k] - t_from[half + 1]
    return int(np.max(over + np.maximum(0, -(-(t3 - (n2 * capacity - t2)) // capacity))))


def fillings(room: int, counts: dict[int, int], lengths: list[int], tries: int | None = None) -> Iterator[Filling]:
    """All undominated fillings of `room` (those among the first `tries` fillings), least waste first; lengths descending.

    Bit t of reach[k] says that lengths[k:] can fill t exactly, so every branch that is walked ends in a filling. A
    filling is dominated if one unused length fits in its waste, or could take the place of some of its pieces without
    loss (Martello and Toth); pairs and single pieces are tried.
    """
    lengths = [k for k in lengths if k <= room and counts[k]]
    ascending = lengths[::-1]
    mask = (1 << room + 1) - 1
    reach = [1]
    for length in ascending:
        bits, left, step = reach[-1], min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            bits |= bits << take * length & mask
            left -= take
            step *= 2
        reach.append(bits)
    reach.reverse()

    def dominated(filling: Filling, slack: int) -> bool:
        used = dict(filling)
        single = [length for length, _ in filling]
        sums = {0, *single}
        sums |= {a + b for i, a in enumerate(single) for b in single[i + 1 :]} | {2 * a for a, n in filling if n > 1}
        for total in sums:
            for k in range(bisect_left(ascending, total), bisect_right(ascending, total + slack)):
                other = ascending[k]
                if counts[other] > used.get(other, 0) and (other > total or other not in used):
                    return True
        return False

    def walk(k: int, total: int, filling: Filling) -> Iterator[Filling]:
        if not total:
            yield filling
            return
        k = max(k, bisect_left(lengths, -total, key=lambda x: -x))
        while k < len(lengths) and reach[k] >> total & 1:
            length = lengths[k]
            for n in range(min(counts[length], total // length), 0, -1):
                if reach[k + 1] >> total - n * length & 1:
                    yield from walk(k + 1, total - n * length, (*filling, (length, n)))
            k += 1

    every = (f for total in range(room, -1, -1) if reach[0] >> total & 1 for f in walk(0, total, ()))
    first, some = (), False
    for k, filling in enumerate(islice(every, tries)):
        first = first if k else filling
        if not dominated(filling, room - sum(length * n for length, n in filling)):
            some = True
            yield filling
    if not some:
        yield first


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> list[tuple[Filling, int]]:
    """Pack a histogram of lengths into as few sequences as the search finds: [(filling, number of sequences)].

    Branch and bound: take the longest length left and try its undominated fillings, least waste first; drop a branch
    whose sequences so far plus the lower bound of the rest do not beat the incumbent. The first incumbent, and the
    completion of nodes on the way, is best-fit decreasing. A limited search uses a filling for as many sequences as the
    counts allow; one without limits uses it once at each node, which leaves out no packing.
    """
    counts = {k: v for k, v in counts.items() if v}
    exact = max_nodes is None and max_fillings is None
    size = lambda plan: sum(n for _, n in plan)
    best = best_fit(counts, capacity)
    fewest = size(best)
    goal = lower_bound(counts, capacity)
    stride = 1 if exact else max(1, len(counts) // 128)  # a limited search completes every so many nodes only
    nodes, used = 0, 0
    left = dict(counts)
    path: list[tuple[Filling, int]] = []  # what `left` lacks of `counts`

    def branches() -> Iterator[tuple[Filling, int]]:
        """(filling, number) to go on with from here; none where the branch ends."""
        nonlocal best, fewest, nodes
        nodes += 1
        if used + lower_bound(left, capacity) >= fewest:
            return iter(())
        if not left or nodes % stride == 0:
            rest = best_fit(left, capacity)
            if used + size(rest) < fewest:
                best, fewest = rest + path, used + size(rest)
        if not left:
            return iter(())
        longest = max(left)
        after = left | {longest: left[longest] - 1}
        found = []
        tries = None if max_fillings is None else TRIES * max_fillings
        for filling in islice(fillings(capacity - longest, after, sorted(left, reverse=True), tries), max_fillings):
            whole = dict(filling)
            whole[longest] = whole.get(longest, 0) + 1
            times = 1 if exact else min(left[k] // n for k, n in whole.items())
            found.append((tuple(sorted(whole.items(), reverse=True)), times))
        return iter(found)

    stack = [branches()]
    while stack and fewest > goal and (max_nodes is None or nodes < max_nodes):
        following = next(stack[-1], None)
        if following is None:
            stack.pop()
            if path:
                filling, times = path.pop()
                used -= times
                for k, n in filling:
                    left[k] = left.get(k, 0) + times * n
            continue
        filling, times = following
        path.append(following)
        used += times
        for k, n in filling:
            left[k] -= times * n
            if not left[k]:
                del left[k]
        stack.append(branches())
    return best


def runs(plan: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces per sequence, first sequence, offset of the first piece)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for filling, number in plan:
        offset = 0
        for length, each in filling:
            lo = taken.get(length, 0)
            taken[length] = lo + number * each
            out.append((length, lo, lo + number * each, each, sequence, offset))
            offset += length * each
        sequence += number
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> DataFrame:
    """Give every piece (columns doc_id, piece, length; others are carried along) sequence_id and offset.

    The plan is made from the histogram of lengths, at most `capacity` rows. It has at most one filling per distinct
    length and branch, each of at most sqrt(2 * capacity) lengths, so its broadcast does not grow with the input.
    Ranks within a length are counted per (length, salt), so that a length which holds a third of all pieces is
    spread over all tasks. Pieces of full length get a sequence each, without a rank.
    """
    spark = pieces.sparkSession
    payload = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*(F.col(f"`{c}`") for c in payload)).alias("row")
    kept = stored(pieces.select(row), "pieces").withColumn("length", F.col("row.length"))
    counted = kept.filter(F.col("length") < capacity).groupBy("length").count().collect()
    plan = runs(bin_completion({r["length"]: r["count"] for r in counted}, capacity, max_nodes, max_fillings))
    slots = F.broadcast(spark.createDataFrame(plan, "slot_length long, lo long, hi long, each long, first long, at long"))
    given = lambda df, sequence, offset: df.select(*(F.col(f"row.`{c}`").alias(c) for c in payload), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    full = given(kept.filter(F.col("length") >= capacity), -1 - F.monotonically_increasing_id(), F.lit(0))
    salts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = kept.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("row.doc_id", "row.piece"), F.lit(salts)))
    offsets = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece")
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("before"))
    placed = ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return given(placed, F.col("first") + F.floor(step / F.col("each")), F.col("at") + step % F.col("each") * F.col("length")).unionByName(full)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """sequence_id, length, ids (array of the packed ids), parts (doc_id, piece, offset, length in order)."""
    placed = pack(token_pieces(docs, capacity, vocabulary), capacity)
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("part"))
    joined = F.aggregate("part", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select(
        "sequence_id",
        F.aggregate("part", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("length"),
        joined.alias("ids"),
        F.transform("part", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts"),
    )
