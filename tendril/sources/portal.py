"""A paged, capped search as a Python data source: one partition a query, ranges halved until each fits under the cap.

The backend is any object with `count(first_day, last_day)` and `page(first_day, last_day, number)`; pages hold rows as
dicts. Rows of a range must be distinct and as many as the search says, or the read fails.

A search form filters by options too: `choices()` of the backend gives, for each select, its options as {code: label}, and
`count` and `page` then take `chosen`, {select: code}. Spark hands filters down (`spark.sql.python.filterPushdown.enabled`):
an equality with a label becomes the option's code, read from the form when the query is planned, without regard to case
and accents, and a comparison of the day narrows the range before it is halved; everything else is given back to Spark.
A label that the form does not have is an error that names those it has. Rows of a search carry the label asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.text import plain_text
from .ranges import halved

PAGE_ROWS, CAP = 15, 499


class Range(InputPartition):
    def __init__(self, first: date, last: date, rows: int):
        super().__init__((first, last, rows))
        self.first, self.last, self.rows = first, last, rows


def resolved(select: str, options: Mapping[str, str], label: str) -> str:
    """The code of an option by its label; an option without a code is the form's empty choice."""
    alike = lambda text: " ".join(plain_text(text).split())
    found = next((code for code, own in options.items() if code and alike(own) == alike(label)), None)
    if found is None:
        raise ValueError(f"{select} {label!r} is no option of the form; it has: {', '.join(own for code, own in options.items() if code)}")
    return found


class SearchReader(DataSourceReader):
    """selects: {column: select of the form}. chosen: {column: label} asked for from the start."""

    def __init__(self, backend, first: date, last: date, columns: list[str], key: str, day: str, selects: Mapping[str, str] | None = None, chosen: Mapping[str, str] | None = None):
        self.backend, self.first, self.last, self.columns, self.key, self.day = backend, first, last, columns, key, day
        self.selects, self.labels, self.codes = dict(selects or {}), {}, {}
        self.choices = backend.choices() if self.selects else {}
        for column, label in (chosen or {}).items():
            self._choose(column, label)

    def _choose(self, column: str, label: str) -> None:
        select = self.selects[column]
        self.codes[select], self.labels[column] = resolved(select, self.choices[select], label), label

    def _asked(self) -> dict:
        return {"chosen": self.codes} if self.codes else {}

    def partitions(self) -> list[Range]:
        if self.first > self.last:
            return []
        found = halved(self.first, self.last, lambda a, b: self.backend.count(a, b, **self._asked()), CAP)
        for first, last, n in found:
            if n >= CAP:
                raise ValueError(f"{first} has {n} rows, more than a search shows")
        return [Range(*r) for r in found if r[2]]

    def read(self, partition: Range):
        if partition is None:  # Spark reads one partition where there is none
            return
        seen = set()
        for number in range(-(-partition.rows // PAGE_ROWS)):
            for row in self.backend.page(partition.first, partition.last, number, **self._asked()):
                if not partition.first <= row[self.day] <= partition.last:
                    raise ValueError(f"{row[self.key]} is outside {partition.first}..{partition.last}")
                if row[self.key] not in seen:
                    seen.add(row[self.key])
                    yield tuple(self.labels.get(c, row.get(c)) for c in self.columns)
        if len(seen) != partition.rows:
            raise ValueError(f"{partition.first}..{partition.last}: {len(seen)} rows read, {partition.rows} stated")


class FormReader(SearchReader):
    """A search by a form. Spark refuses a reader with this method where filters are not handed down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the form can ask; a second label for one select is Spark's to compare."""
        bounds = {GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThanOrEqual: (None, 0), LessThan: (None, -1), EqualTo: (0, 0)}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) is EqualTo and column in self.selects and column not in self.labels and isinstance(f.value, str):
                self._choose(column, f.value)
            elif type(f) in bounds and column == self.day and isinstance(f.value, date):
                after, before = bounds[type(f)]
                self.first = self.first if after is None else max(self.first, f.value + timedelta(days=after))
                self.last = self.last if before is None else min(self.last, f.value + timedelta(days=before))
            else:
                yield f


def document_list(shown: list, total: int, page) -> list:
    """All documents of a tender, whose page shows the first ones and says how many there are; page(first) gives those from there on.

    A portal may answer with the list of another tender that was paged before. So the first page is asked for again, and
    must be what is shown, or the read fails; so it does when there are fewer or more documents than stated.
    """
    found = list(shown)
    if len(found) < total and list(page(0)) != found:
        raise ValueError("the list answered is another tender's")
    while len(found) < total and (more := list(page(len(found)))):
        found += more
    if len(found) != total:
        raise ValueError(f"{len(found)} documents read, {total} stated")
    return found


def search_source(name: str, backend, schema: str, key: str, day: str, selects: Mapping[str, str] | None = None) -> type[DataSource]:
    """A data source class to register: spark.dataSource.register(search_source(...)).

    Options first and last are days; a column of `selects` ({column: select of the form}) as an option is its label.
    """

    columns, kinds, wanted = [c.split()[0] for c in schema.split(", ")], schema, dict(selects or {})

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return kinds

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            days = [datetime.strptime(self.options[o], "%Y-%m-%d").date() for o in ("first", "last")]
            chosen = {c: self.options[c] for c in wanted if self.options.get(c)}
            return (FormReader if wanted else SearchReader)(backend, *days, columns, key, day, wanted, chosen)

    return Search
