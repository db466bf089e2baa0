"""The reading of a document from its files: files with text first, then transcriptions of image pages by a model, then OCR.

Each stage reads only files of documents that the stages before did not settle (an anti join of keys, so their texts leave
before the shuffle's other side meets them), and within a stage a file is read only if none before it held the section:
the files of a document come to a task in order, and reading stops at the first hit. Documents of over BLOCK files are dealt
over several tasks, each of which stops at its own first hit; the earliest of those counts. What a stage found, a row a document,
is stored before the next one reads.

Files have a name, a kind and a text: `text` (what the file itself holds; null where it cannot be opened), `model` and `ocr`
(copies of its image pages; null where the copy failed). Defined cases: a document without files is NO_FILES; one whose
texts are all scans and whose copies are scans too, or missing, is SCANNED; one with files that cannot be opened is
UNOPENED with their names; else the reader's own review stands. Where OCR is not allowed, a document that it could settle is
deferred: it has no hit and holds image pages. How many files of a document are read from OCR is an argument, since OCR takes
minutes a file; where its copies are there already, none of them need be left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import image_pages, is_scanned
from ..sources.stages import stored
from .protocol import Reader, compared, read_one
from .readers import SCANNED

# Reasons for a person to look; files named so come first among those with images.
NO_FILES, UNOPENED = "sin PDF ni DOCX", "ilegible: "
FIRST_NAMED = "BASE"

#: Files of a document that are read from OCR at most, if nothing else is said.
OCR_FILES = 2
#: Files of a document that come to one task.
BLOCK = 64
#: Longest list of files that cannot be opened.
LONGEST = 300


def first_hits(files: DataFrame, reader: Reader, document: str, order: Sequence[str], text: str = "text", given: Sequence[str] = ()) -> DataFrame:
    """(document, the columns of order, record, looked): for each document its first file, in order, that holds the section, and how many were read.

    order: columns of whole numbers, the first of which deals long documents over tasks. Documents without a hit have a
    row with a null record.
    """
    numbers = T.StructType([T.StructField(c, T.LongType()) for c in order])
    record = to_arrow_type(reader.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found, looked = None, None, 0
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], kind), *(pa.array([None if r[1] is None else r[1][0][k] for r in out], pa.int64()) for k in range(len(order)))]
            columns += [pa.array([None if r[1] is None else r[1][1] for r in out], record), pa.array([r[2] for r in out], pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [document, *order, reader.name, "looked"])

        for batch in batches:
            key, at = [batch.column(c).to_pylist() for c in (document, "_block")], [batch.column(c).to_pylist() for c in order]
            texts, beside = batch.column(text), [batch.column(c) for c in given]
            kind = batch.column(document).type
            for k in range(batch.num_rows):
                own = (key[0][k], key[1][k])
                if own != current:
                    if current is not None:
                        out.append((current[0], found, looked))
                    current, found, looked = own, None, 0
                if found is None:
                    looked += 1
                    read = reader.read(texts[k].as_py(), *(c[k].as_py() for c in beside))
                    if read["review"] != reader.missing:
                        found = ([column[k] for column in at], read)
            if out:
                yield flushed()
        if current is not None:
            out.append((current[0], found, looked))
            yield flushed()

    block = F.floor(F.col(order[0]) / BLOCK)
    dealt = files.select(document, *(F.col(c).cast("long").alias(c) for c in order), text, *given, block.alias("_block"))
    dealt = dealt.repartition(document, "_block").sortWithinPartitions(document, "_block", *order)
    schema = T.StructType([files.schema[document], *numbers.fields, T.StructField(reader.name, reader.schema), T.StructField("looked", T.LongType())])
    by_block = dealt.mapInArrow(run, schema)
    hit = F.when(F.col(reader.name).isNotNull(), F.struct(*order))
    return by_block.groupBy(document).agg(*(F.min_by(c, hit).alias(c) for c in order), F.min_by(reader.name, hit).alias(reader.name), F.sum("looked").alias("looked"))


def read_documents(documents: DataFrame, files: DataFrame, reader: Reader, document: str, given: Sequence[str] = (), ocr: bool = True, ocr_files: int | None = OCR_FILES) -> DataFrame:
    """A row a document: its record, the file's name, where it was read from, what a second reading differs in, review, deferred, looked.

    files: (document, file, name, kind, text, error, the values that the reader takes); `file` is a number that orders
    the files of a document. second: the compared fields in which the model's and the OCR reading differ, null where
    there is one reading. ocr_files: files of a document that are read from OCR at most, those named as the bases first;
    None for all of them.
    """
    own = files.filter("kind = 'text'").withColumn("scanned", F.coalesce(is_scanned(F.col("text")), F.lit(False)))
    facts = own.select(document, "file", "name", "error", F.col("text").isNull().alias("unopened"), "scanned", (F.size(image_pages(F.col("text"), first=None)) > 0).alias("images"))

    facts = stored(facts, "file-facts")
    plain = stored(first_hits(own.filter("text is not null and not scanned"), reader, document, ["file"], given=given), "text-hits")
    settled = plain.filter(F.col(reader.name).isNotNull())

    # image pages of what is not settled: files named as the bases first
    ahead = Window.partitionBy(document).orderBy(F.contains(F.upper("name"), F.lit(FIRST_NAMED)).desc(), "file")
    images = facts.filter("images").join(settled.select(document), document, "left_anti").select(document, "file", "name", F.row_number().over(ahead).alias("turn"))
    late = F.when(F.col("kind") == "model", 0).otherwise(1)
    copies = files.filter("kind <> 'text'").drop("name").join(images, [document, "file"]).withColumn("late", late)
    by_ocr = F.lit(ocr) if ocr_files is None else F.lit(ocr) & (F.col("turn") <= ocr_files)
    copies = copies.filter((F.col("late") == 0) | by_ocr)
    copied = stored(first_hits(copies.filter("text is not null"), reader, document, ["turn", "late"], given=given), "copy-hits")
    named = copied.filter(F.col(reader.name).isNotNull()).join(images, [document, "turn"])

    # a model's reading is held against that of the OCR copy of the same file
    rival = files.filter("kind = 'ocr' and text is not null").join(named.filter("late = 0").select(document, "file"), [document, "file"])
    rival = read_one(rival if ocr else rival.filter("false"), reader, given={g: F.col(g) for g in given}, name="_second").select(document, "_second")

    found = settled.select(document, reader.name, F.col("file").cast(facts.schema["file"].dataType).alias("file"), F.lit("text").alias("source"), F.lit(None).cast("array<string>").alias("second"))
    found = found.join(facts.select(document, "file", "name"), [document, "file"])
    second = compared(reader, F.col(reader.name), F.col("_second"))
    seen = named.join(rival, document, "left").select(document, "file", reader.name, F.when(F.col("late") == 0, "model").otherwise("ocr").alias("source"), second.alias("second"), "name")
    found = found.unionByName(seen).drop("file")

    # why there is no reading: a scan of which no copy shows text, files that could not be opened, none at all
    shown = copies.filter(F.col("text").isNotNull() & ~is_scanned(F.col("text"))).select(document, "file").distinct().withColumn("shown", F.lit(True))
    still = facts.join(shown, [document, "file"], "left").select(document, "name", "file", "images", (F.col("scanned") & F.col("shown").isNull()).alias("scan"))
    failed = facts.filter("unopened").select(document, F.lit(0).alias("late"), F.col("file").alias("turn"), "name", "error")
    failed = failed.unionByName(copies.filter("kind = 'ocr' and text is null").select(document, F.lit(1).alias("late"), F.col("turn").cast(facts.schema["file"].dataType), "name", "error"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("late", "turn", F.concat_ws(": ", "name", "error").alias("said")))), lambda x: x["said"])
    failed = failed.groupBy(document).agg(F.array_join(said, "; ").alias("unopened"))
    state = still.groupBy(document).agg(F.min_by(F.when(F.col("scan"), F.col("name")), F.when(F.col("scan"), F.col("file"))).alias("scan_name"), F.bool_or("images").alias("images"))
    looked = plain.select(document, "looked").unionByName(copied.select(document, "looked")).groupBy(document).agg(F.sum("looked").alias("looked"))
    whole = documents.join(found, document, "left").join(state, document, "left").join(failed, document, "left").join(looked, document, "left")
    hit = F.col(reader.name).isNotNull()
    reason = F.when(F.col("scan_name").isNotNull(), SCANNED).when(F.col("unopened").isNotNull(), F.concat(F.lit(UNOPENED), F.substring("unopened", 1, LONGEST))).when(F.col("images").isNull(), NO_FILES).otherwise(reader.missing)
    return whole.select(
        *documents.columns,
        reader.name,
        F.when(hit, F.col("name")).otherwise(F.col("scan_name")).alias("name"),
        "source",
        "second",
        F.when(hit, F.col(reader.name)["review"]).otherwise(reason).alias("review"),
        (~hit & F.coalesce("images", F.lit(False)) & ~F.lit(ocr)).alias("deferred"),
        F.coalesce("looked", F.lit(0)).cast("long").alias("looked"),
    )
