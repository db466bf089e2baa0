"""Merkle manifest of a dataset: a tree of digests per source, and one over the sources, with a proof for every row.

A leaf is H of a row's fields; every 16 consecutive nodes become their H, until one is left. The trees are cut into blocks
of SPAN = 16^3 aligned leaves. A DuckDB connection in each task works through whole blocks of an Arrow table, level by
level, by ordered `string_agg` and `sha256` (`_Levels`); Spark gives every row its place, deals the blocks over tasks,
stores the roots of the blocks as the leaves of the next round (4096 times fewer) and hands what lies outside of a block,
its siblings further up, back to the block. So no task holds more than a few blocks, however large a source is.

Places come from a range partitioning by (source, doc_id): a row's place is its place in its part plus the number of rows
of its source in the parts before. The sorted rows are stored, so a lost task finds the same places again.

Defined cases: a null field is `-`; null sources form a tree of their own, which comes first; within a source null
doc_ids come first, and rows of the same doc_id are ordered by their leaf (rows that repeat have the same leaf, each is a
leaf of its own); an empty table gives an empty result; a source of one row has its leaf as its root; a null doc_id is not
tampered with; columns other than the five fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, DEPTH = 16, 3
#: Leaves of a block, and rows that a task hands to DuckDB at a time.
SPAN, CHUNK = FANOUT**DEPTH, 4 * FANOUT**DEPTH
TAMPERED = 5


# --- leaves and their places --------------------------------------------------------------------------------------


def _written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(_written(fields[name]) for name in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, altered): altered is the leaf of the tampered row, null where nothing is tampered with."""
    own = {name: F.col(name) for name in FIELDS}
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    chosen = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & F.col("text").isNotNull()
    return docs.select(*FIELDS).select("source", "doc_id", leaf(own).alias("leaf"), F.when(chosen, leaf(own | {"text": lowered})).alias("altered"))


def placed(docs: DataFrame) -> DataFrame:
    """Stored (source, doc_id, leaf, altered, part, at) in the order of (source, doc_id, leaf); `at` is the place in the part."""
    rows = stored(leaves(docs).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    order = ["source", "doc_id", "leaf", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(ranged.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "places")


def positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (grp, pos, total, doc_id, leaf, altered) and the sources (grp, total); grp is the place of the source among all."""
    runs = rows.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    source = Window.partitionBy("source")
    runs = runs.select("*", (F.sum("n").over(source.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(source).alias("total"), F.min("part").over(source).alias("home"))
    # a source starts in one part; its place is that of its start in the part, after the starts in the parts before
    starts = runs.filter("part = home").select("source", "part", F.row_number().over(Window.partitionBy("part").orderBy("first")).alias("place"))
    earlier = starts.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("earlier"))
    grp = starts.join(earlier, "part").select(F.col("source").alias("of"), (F.col("earlier") + F.col("place") - 1).cast("long").alias("grp"))
    runs = stored(runs.join(grp, F.col("source").eqNullSafe(F.col("of"))).select("part", F.col("source").alias("of"), "first", "before", "total", "grp"), "runs")
    measured = runs.agg(F.sum(48 + F.coalesce(F.octet_length("of"), F.lit(0)))).first()[0] or 0
    side = F.broadcast(runs) if measured <= BROADCAST_BYTES else runs
    joined = rows.withColumnRenamed("part", "_part").join(side, (F.col("_part") == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))
    nodes = joined.select("grp", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "total", "doc_id", "leaf", "altered")
    return nodes, runs.select("grp", "total").distinct()


# --- blocks in DuckDB ---------------------------------------------------------------------------------------------


class _Levels:
    """The levels of whole blocks. `node` is an Arrow table with grp, pos, total and digest, further columns as they come."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})

    def load(self, node: pa.Table) -> None:
        """Tables level0.. (grp, pos, block, depth, digest) and run0.. (grp, pos, digests): a run holds the digests of its nodes in order."""
        self.con.register("node", node.drop_columns([c for c in ("lefts", "rights", "subroot") if c in node.column_names]))
        # the reductions that a block of a group of `total` nodes takes
        depth = f"CASE WHEN total <= 1 THEN 0 {' '.join(f'WHEN total <= {FANOUT**k} THEN {k}' for k in range(1, DEPTH))} ELSE {DEPTH} END"
        self.con.execute(f"CREATE OR REPLACE TABLE level0 AS SELECT grp, pos, pos // {SPAN} AS block, total, {depth} AS depth, digest FROM node")
        for k in range(DEPTH):
            self.con.execute(f"CREATE OR REPLACE TABLE run{k} AS SELECT grp, pos // {FANOUT} AS pos, block, total, depth, string_agg(digest, '' ORDER BY pos) AS digests FROM level{k} WHERE depth > {k} GROUP BY ALL")
            self.con.execute(f"CREATE OR REPLACE TABLE level{k + 1} AS SELECT * REPLACE (sha256(digests) AS digests) FROM run{k} UNION ALL SELECT * FROM level{k} WHERE depth <= {k}")
            self.con.execute(f"ALTER TABLE level{k + 1} RENAME digests TO digest")

    def roots(self) -> pa.Table:
        return self.con.sql(f"SELECT grp, block AS pos, (total + {SPAN - 1}) // {SPAN} AS total, digest FROM level{DEPTH}").to_arrow_table()

    #: Each node with what stands left and right of it at each level of its block; null where the block has no such level.
    SIDES = f"""SELECT node.*, {", ".join(f"substr(run{k}.digests, 1, 64 * (node.pos // {FANOUT**k} % {FANOUT})) AS left{k}, substr(run{k}.digests, 64 * (node.pos // {FANOUT**k} % {FANOUT}) + 65) AS right{k}" for k in range(DEPTH))}
        FROM node {" ".join(f"LEFT JOIN run{k} ON run{k}.grp = node.grp AND run{k}.pos = node.pos // {FANOUT ** (k + 1)}" for k in range(DEPTH))}"""

    def sides(self, outer: pa.Table) -> pa.Table:
        """(grp, pos, lefts, rights) of each node, from its own level up to the root of all."""
        self.con.register("outside", outer)
        own = lambda side: f"list_filter([{', '.join(f'{side}{k}' for k in range(DEPTH))}], lambda x: x IS NOT NULL)"
        return self.con.sql(f"SELECT s.grp, s.pos, {own('left')} || o.lefts AS lefts, {own('right')} || o.rights AS rights FROM ({self.SIDES}) s JOIN outside o ON o.grp = s.grp AND o.block = s.block").to_arrow_table()

    def proofs(self, outer: pa.Table, columns: list[str]) -> pa.Table:
        """The columns of each leaf, subroot, the digest of its siblings, and the root that its `shown` digest leads to."""
        self.con.register("outside", outer)
        beyond = pc.max(pc.list_value_length(outer["lefts"])).as_py() or 0
        levels = [(f"left{k}", f"right{k}") for k in range(DEPTH)] + [(f"lefts[{k}]", f"rights[{k}]") for k in range(1, beyond + 1)]
        fold = f"SELECT s.*, o.subroot, o.lefts, o.rights, s.shown AS fold0 FROM ({self.SIDES}) s JOIN outside o ON o.grp = s.grp AND o.block = s.block"
        for k, (left, right) in enumerate(levels):
            fold = f"SELECT *, CASE WHEN {left} IS NULL THEN fold{k} ELSE sha256({left} || fold{k} || {right}) END AS fold{k + 1} FROM ({fold})"
        siblings = " || ".join(f"coalesce({left} || {right}, '')" for left, right in levels)
        return self.con.sql(f"SELECT {', '.join(columns)}, digest, subroot, sha256({siblings}) AS proof, fold{len(levels)} AS folded FROM ({fold})").to_arrow_table()


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (grp, block) as tables that hold whole blocks, of about CHUNK rows."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= CHUNK:
            table = pa.Table.from_batches(waiting).combine_chunks()
            last = table.slice(table.num_rows - 1)
            same = pc.and_(pc.equal(table["grp"], last["grp"][0]), pc.equal(table["block"], last["block"][0]))
            cut = pc.index(same, True).as_py()
            if cut:
                yield table.slice(0, cut)
            waiting = table.slice(cut).to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def _in_blocks(df: DataFrame, work, schema: str) -> DataFrame:
    """work(levels, nodes, outer) over whole blocks; the rows of `outer` are those with pos -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _Levels()
        for table in _whole_blocks(batches):
            inside = pc.greater_equal(table["pos"], 0)
            levels.load(table.filter(inside))
            yield from work(levels, table.filter(pc.invert(inside))).to_batches()

    return df.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(run, schema)


def block_roots(nodes: DataFrame) -> DataFrame:
    """(grp, pos, total, digest): the nodes of the next round. A group of one node stays as it is."""
    keyed = nodes.select("grp", F.floor(F.col("pos") / SPAN).alias("block"), "pos", "total", "digest")
    return _in_blocks(keyed, lambda levels, _: levels.roots(), "grp long, pos long, total long, digest string")


def rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes, then the stored roots of their blocks, and so on until every group is one node; `most` is the size of the largest."""
    found = [nodes]
    while not found[1:] or most > 1:
        found.append(stored(block_roots(found[-1]), "roots"))
        most = -(-most // SPAN)
    return found


def _with_outer(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes, and a row of pos -1 for each block with what is outside of it."""
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / SPAN))
    return keyed.unionByName(outer.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)


def node_sides(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Stored (grp, pos, lefts, rights) of nodes (grp, pos, total, digest), from those of the blocks that they are in."""
    return stored(_in_blocks(_with_outer(nodes, outer), lambda levels, rest: levels.sides(rest), "grp long, pos long, lefts array<string>, rights array<string>"), "sides")


# --- the manifest -------------------------------------------------------------------------------------------------

RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    nodes, sources = positions(placed(docs))
    most, number = sources.agg(F.max("total"), F.count("*")).first()
    if not number:
        return spark.createDataFrame([], f"doc_id {kind}, {RESULT}")
    trees = rounds(nodes.select("grp", "pos", "total", F.col("leaf").alias("digest")), most)
    subroots = trees[-1].select("grp", F.col("digest").alias("subroot"))
    top = rounds(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(number).cast("long").alias("total"), F.col("subroot").alias("digest")), number)
    root = top[-1].first()["digest"]

    nothing = F.array().cast("array<string>")
    sides = top[-1].select("grp", "pos", nothing.alias("lefts"), nothing.alias("rights"))
    for level in reversed(top[:-1]):
        sides = node_sides(level, sides)
    # a source is a node of the upper tree; what is beside it there is outside of its whole tree
    sides = sides.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "lefts", "rights")
    for level in reversed(trees[1:-1]):
        sides = node_sides(level, sides)

    own = nodes.select("grp", "pos", "total", "doc_id", F.col("leaf").alias("digest"), F.coalesce("altered", "leaf").alias("shown"))
    proved = _in_blocks(_with_outer(own, sides.join(subroots, "grp")), lambda levels, rest: levels.proofs(rest, ["doc_id"]), f"doc_id {kind}, digest string, subroot string, proof string, folded string")
    return proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
