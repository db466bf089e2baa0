"""Readers as values: a function from a text to a typed record, with its version and the fields that second readings compare.

A reader knows nothing of Spark. `read_all` runs any number of them over a text column in one Arrow pass: a text crosses to
Python once, however many readers look at it, and only records come back. `rows_of` makes a Python table function of a
reader whose record holds an array, to be joined LATERAL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


@dataclass(frozen=True)
class Reader:
    """read(text, *given) gives a dict by `schema`. Its `review` says why a person must look; `missing` that the section is not there.

    version: a new one reads every document again. given: names of the values that `read` takes beside the text.
    compared: fields that two readings of one section are compared by; alike: what of a field is compared.
    """

    name: str
    version: str
    missing: str
    schema: T.StructType
    read: Callable[..., dict]
    given: tuple[str, ...] = ()
    compared: tuple[str, ...] = ()
    alike: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)


#: Texts whose records are Python objects at a time: a whole batch of them would keep the garbage collector busy.
TEXTS = 250

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "array<string>": T.ArrayType(T.StringType())}


def record_type(*fields: str | T.StructField) -> T.StructType:
    """A record's schema from ready fields and lists such as "page int, amount decimal(15,2)" (without a session, which DDL needs)."""
    out: list[T.StructField] = []
    for f in fields:
        if isinstance(f, T.StructField):
            out.append(f)
            continue
        for name, kind in (each.split() for each in f.split(", ")):
            out.append(T.StructField(name, _KINDS[kind] if kind in _KINDS else T.DecimalType(*map(int, kind.removeprefix("decimal(").rstrip(")").split(",")))))
    return T.StructType(out)


#: What a text states against what it should be.
WARNING = record_type("warning string, stated string, expected string")
WARNINGS = T.StructField("warnings", T.ArrayType(WARNING))


def warning(name: str, stated=None, expected=None) -> dict:
    return {"warning": name, "stated": None if stated is None else str(stated), "expected": None if expected is None else str(expected)}


def read_all(df: DataFrame, readers: Sequence[Reader], document: str = "text", given: Mapping[str, Column] | None = None, name: str = "readings") -> DataFrame:
    """df with a struct column: for each reader a struct of its version and its record. given: values that readers take, by name; null where left out."""
    schema = T.StructType([T.StructField(r.name, T.StructType([T.StructField("version", T.StringType()), *r.schema.fields])) for r in readers])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def together(records: list[list[dict]]) -> pa.Array:
        versioned = [[{"version": r.version, **x} for x in own] for r, own in zip(readers, records, strict=True)]
        return pa.StructArray.from_arrays([pa.array(own, kind) for own, kind in zip(versioned, kinds, strict=True)], names=schema.names)

    return df.withColumn(name, _crossing(readers, document, given or {}, schema, together))


def read_one(df: DataFrame, reader: Reader, document: str = "text", given: Mapping[str, Column] | None = None, name: str | None = None) -> DataFrame:
    """df with the record of one reader as a struct column."""
    kind = to_arrow_type(reader.schema)
    return df.withColumn(name or reader.name, _crossing([reader], document, given or {}, reader.schema, lambda records: pa.array(records[0], kind)))


def _crossing(readers: Sequence[Reader], document: str, values: Mapping[str, Column], schema: T.StructType, made: Callable[[list[list[dict]]], pa.Array]) -> Column:
    """One Arrow function of a text and the values that readers take; made: an array by schema from the records of each reader.

    The column is a struct as the function makes it: one that is put together from its fields would have Catalyst call the
    function for each of them.
    """
    wanted = list(dict.fromkeys(g for r in readers for g in r.given if g in values))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *more in batches:
            parts = [read(texts[at : at + TEXTS], [column[at : at + TEXTS] for column in more]) for at in range(0, len(texts), TEXTS)]
            yield pa.concat_arrays(parts) if parts else made([[] for _ in readers])

    def read(texts: pa.Array, more: list[pa.Array]) -> pa.Array:
        beside = {w: column.to_pylist() for w, column in zip(wanted, more, strict=True)}
        nothing = [None] * len(texts)
        values = [(r.read, [beside.get(g, nothing) for g in r.given], []) for r in readers]
        for k, text in enumerate(texts):
            said = text.as_py()
            for of_text, given, out in values:
                out.append(of_text(said, *[v[k] for v in given]))
        return made([out for *_, out in values])

    def single(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run((b,) for b in batches)

    function = _typed(run, tuple[pa.Array, ...]) if wanted else _typed(single, pa.Array)
    return F.arrow_udf(function, schema)(F.col(document), *(values[w] for w in wanted))


def _typed(function: Callable, batch) -> Callable:
    """Arrow functions are told apart by their hints, which must be types, not the words of postponed annotations."""
    function.__annotations__ = {next(iter(function.__annotations__)): Iterator[batch], "return": Iterator[pa.Array]}
    return function


def rows_of(spark: SparkSession, reader: Reader, array: str, name: str):
    """A Python table function of a text, registered for SQL as `name`: the items of an array of the record in order, with their place from 1."""
    item = reader.schema[array].dataType.elementType
    kind = T.StructType([T.StructField("place", T.IntegerType()), *item.fields])
    read, names = reader.read, item.names

    class Rows:
        def eval(self, text: str) -> Iterator[tuple]:
            for place, row in enumerate(read(text)[array] or [], 1):
                yield (place, *(row[n] for n in names))

    function = F.udtf(Rows, returnType=kind)
    spark.udtf.register(name, function)
    return function


def due(documents: DataFrame, readings: DataFrame, readers: Sequence[Reader], key: str) -> DataFrame:
    """(key, reader, version) of the readings that are missing: readings hold (key, reader, version) of those done."""
    each = F.array(*(F.struct(F.lit(r.name).alias("reader"), F.lit(r.version).alias("version")) for r in readers))
    wanted = documents.select(key).distinct().select(key, F.explode(each).alias("r")).select(key, "r.*")
    return wanted.join(readings.select(key, "reader", "version"), [key, "reader", "version"], "left_anti")


def compared(reader: Reader, first: Column, second: Column) -> Column:
    """The compared fields that both readings have and that differ, null where there is no second reading or it lacks the section."""

    def differs(f: str) -> Column:
        like = reader.alike.get(f, lambda c: c)
        empty = (lambda c: F.size(c) == 0) if isinstance(reader.schema[f].dataType, T.ArrayType) else (lambda c: c.cast("string") == "")
        both = first[f].isNotNull() & second[f].isNotNull() & ~empty(first[f]) & ~empty(second[f])
        return F.when(both & (like(first[f]) != like(second[f])), F.lit(f))

    return F.when(second.isNotNull() & ~second["review"].eqNullSafe(reader.missing), F.filter(F.array(*map(differs, reader.compared)), lambda x: x.isNotNull()))
