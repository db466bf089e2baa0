"""Saved portal pages and archives as tables: one row of input a file, rows of output by an Arrow-batched function."""

from __future__ import annotations

import io
import posixpath
import re
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_text

_ROW = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</table|</tbody|\Z)", re.S | re.I)
_CELL = re.compile(r"<(t[dh])\b[^>]*>(.*?)(?=<t[dh]\b|</tr|</t[dh]>|\Z)", re.S | re.I)


def cell(html: str) -> str:
    """Text of a cell: scripts and tags out, character references read, white space collapsed."""
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"<script.*?</script>", " ", html, flags=re.S | re.I))).split())


def html_rows(html: str) -> list[list[tuple[str, str]]]:
    """Rows of (kind, text) cells; kind is th or td."""
    return [[(kind.lower(), cell(body)) for kind, body in _CELL.findall(row)] for row in _ROW.findall(html)]


def table_rows(html: str, headers: dict[str, str]) -> list[dict[str, str | None]]:
    """Rows below the row that names all headers (name as shown -> column); a page without them is an error, never null columns."""
    wanted = {plain_text(shown): column for shown, column in headers.items()}
    rows = html_rows(html)
    for k, row in enumerate(rows):
        at = {wanted[plain_text(t)]: i for i, (_, t) in enumerate(row) if plain_text(t) in wanted}
        if len(at) == len(wanted):
            return [{c: r[i][1] or None for c, i in at.items()} for r in rows[k + 1 :] if len(r) > max(at.values()) and r[0][0] == "td"]
    raise ValueError(f"no table with the headers {sorted(headers)}")


def read_tables(files: DataFrame, headers: dict[str, str], html: str = "value", name: str = "path") -> DataFrame:
    """(path, place, columns of `headers`): the rows of the table of each page, in order."""
    columns = list(headers.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, *(r[c] for c in columns)) for p, h in zip(frame[name], frame[html], strict=True) if h is not None for i, r in enumerate(table_rows(h, headers))]
            yield pd.DataFrame(rows, columns=["path", "place", *columns])

    return files.select(name, html).mapInPandas(run, ", ".join(["path string", "place int", *(f"`{c}` string" for c in columns)]))


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


STAGE_HEADERS = {"Etapa": "stage", "Fecha Inicio": "starts", "Fecha Fin": "ends"}
NO_STAGES = "No se encontraron Datos"


def schedule(html: str, empty: str = NO_STAGES) -> list[dict[str, str | int | None]]:
    """Ordered stages. Unnamed or repeated stages are an error, and so is an empty table that does not say it is empty."""
    rows = table_rows(html, STAGE_HEADERS)
    rows = [r for r in rows if r["stage"] != empty]
    names = [r["stage"] for r in rows]
    if None in names or len(set(names)) < len(names):
        raise ValueError("stages must have names of their own")
    if not rows and empty not in html:
        raise ValueError("an empty schedule must say so")
    return [{"place": i, **r} for i, r in enumerate(rows, 1)]


def states(html: Column) -> Column:
    """Item states of a detail page, in listed order."""
    hits = F.regexp_extract_all(html, F.lit(r"(?is)<span[^>]*class=\"estado-item\"[^>]*>(.*?)</span>"), F.lit(1))
    return F.filter(F.transform(hits, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", " "))), lambda x: x != "")


# --- archives ---------------------------------------------------------------------------------------------------

MOST_BYTES, MOST_DEPTH = 5 << 30, 3


def unpacked(content: bytes, inside: str = "", depth: int = 1, most: int = MOST_BYTES) -> Iterator[tuple[str, int, str, str | None]]:
    """(path, size, archive it is in, error) of the members of a ZIP, archives within it included down to MOST_DEPTH."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield inside, len(content), "", "unreadable"
        return
    left = most
    for member in archive.infolist():
        if member.is_dir():
            continue
        path = posixpath.normpath(member.filename.replace("\\", "/"))
        if path.startswith(("/", "../")) or path == ".." or re.match(r"^[A-Za-z]:", path):
            yield member.filename, member.file_size, inside, "outside"
            continue
        left -= member.file_size
        if left < 0:
            yield path, member.file_size, inside, "too large"
            return
        yield path, member.file_size, inside, None
        if path.lower().endswith(".zip"):
            if depth >= MOST_DEPTH:
                yield path, member.file_size, inside, "too deep"
            else:
                yield from unpacked(archive.read(member), path, depth + 1, left)


def read_archives(files: DataFrame) -> DataFrame:
    """(path, member, size, inside, error) from a binaryFile table; of errors, only the file they are in is lost."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in unpacked(content)], columns=["path", "member", "size", "inside", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, inside string, error string")


def docx_text(content: bytes) -> str:
    """Text of a DOCX: ends of paragraphs are line feeds, other tags go, character references stay as they are."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        xml = archive.read("word/document.xml").decode("utf-8")
    return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml))


def with_python(files: DataFrame, column: str, function: Callable[[bytes], str], name: str = "text") -> DataFrame:
    """files with a text made from a binary column."""

    @F.pandas_udf("string")
    def made(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else function(c))

    return files.withColumn(name, made(column))


def toml_records(files: DataFrame) -> DataFrame:
    """(path, json) of whole TOML files, in no order; an unreadable file has a null record."""
    import json

    def read(text: str) -> str | None:
        try:
            return json.dumps(tomllib.loads(text), default=str, ensure_ascii=False)
        except tomllib.TOMLDecodeError:
            return None

    @F.pandas_udf("string")
    def record(texts: pd.Series) -> pd.Series:
        return texts.map(read, na_action="ignore")

    return files.select("path", record("value").alias("json"))
