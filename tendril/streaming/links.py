"""As-of links over a stream in which earlier tenders may come late.

A tender restarts the latest earlier one of the same key. Tenders do not come in the order of their numbers: the search is
repeated over a range that reaches back, so an earlier one can be found after a later one was linked. The state of a key
is a map from each known number to what it is linked to; it has no watermark, since a late tender of any age must find its
place, so it grows with the known tenders of a key, as the table of tenders itself does.

revise: a late tender takes the place between its neighbours, and the one after it is linked anew. The result, of which the
last row of a number holds, is then that of the batch link over all tenders, whatever the order of arrival. Without it a
link once made stays: a late tender gets the latest earlier one that no link has taken, if any. In both, no tender is
linked to by two.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def link(known: dict[int, int | None], numbers: Sequence[int], excluded: Sequence[int], revise: bool) -> dict[int, int | None]:
    """Adds numbers to the links of a key, and gives those that were made or changed. Numbers that are known already change nothing.

    excluded: numbers that are taken by links made elsewhere.
    """
    out = set(excluded)
    order = sorted(known)
    changed: dict[int, int | None] = {}
    for n in sorted(set(numbers) - known.keys()):
        at = bisect_left(order, n)
        taken = out if revise else out | {p for p in known.values() if p is not None}
        known[n] = next((order[k] for k in range(at - 1, -1, -1) if order[k] not in taken), None)
        if known[n] is not None or revise:
            changed[n] = known[n]
        insort(order, n)
        if revise and n not in out:
            # the next one of all is now linked to the late one; those after it are linked to later ones than this
            for k in range(at + 1, len(order)):
                if known[order[k]] is None or known[order[k]] < n:
                    known[order[k]] = n
                    changed[order[k]] = n
                if order[k] not in out:
                    break
    return changed


class _Links(StatefulProcessor):
    def __init__(self, at: str, revise: bool) -> None:
        self.at, self.revise = at, revise

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.StructType([T.StructField("number", T.LongType())])
        linked = T.StructType([T.StructField("previous", T.LongType()), T.StructField("excluded", T.BooleanType())])
        self.known = handle.getMapState("known", number, linked)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = {n[0]: tuple(v) for n, v in self.known.iterator()} if self.known.exists() else {}
        links = {n: p for n, (p, _) in stored.items()}
        excluded = {n for n, (_, e) in stored.items() if e}
        came: list[int] = []
        for frame in rows:
            came += [int(n) for n in frame[self.at]]
            excluded |= {int(n) for n, e in zip(frame[self.at], frame["excluded"], strict=True) if e and int(n) not in stored}
        changed = link(links, came, excluded, self.revise)
        for n in {*changed, *(n for n in came if n not in stored)}:
            self.known.updateValue((n,), (links[n], n in excluded))
        if changed:
            out = pd.DataFrame([(*key, n, p) for n, p in changed.items()], columns=[*self.names, self.at, "previous"])
            yield out.astype({"previous": "Int64"})

    def close(self) -> None:
        pass


def late_links(stream: DataFrame, key: Sequence[str], at: str, excluded: str | None = None, revise: bool = True) -> DataFrame:
    """(key, at, previous) of every link that is made or changed; null where a tender has no earlier one (with revise only).

    at: the number that orders the tenders of a key; rows without it are left out. excluded: a flag of the rows that
    links made elsewhere have taken. Use with output mode update; repeated rows give nothing.
    """
    rows = stream.filter(F.col(at).isNotNull()).select(*key, F.col(at).cast("long").alias(at), (F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)).alias("excluded"))
    processor = _Links(at, revise)
    processor.names = list(key)
    schema = T.StructType([*(stream.schema[k] for k in key), T.StructField(at, T.LongType()), T.StructField("previous", T.LongType())])
    return rows.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None")


def latest(links: DataFrame, key: Sequence[str], at: str, batch: str) -> DataFrame:
    """The links that hold: of the rows of each number the one of the last batch."""
    return links.groupBy(*key, at).agg(F.max_by("previous", batch).alias("previous")).filter("previous is not null")
