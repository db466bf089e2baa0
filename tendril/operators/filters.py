"""Predicates of tender search, and their three-valued join: yes, no, or not read yet."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_until
from ..functions.text import all_words, plain, plain_text


def hard(predicate: Column) -> Column:
    """A predicate on what is always known: null is no."""
    return F.coalesce(predicate, F.lit(False))


def verdict(predicates: Iterable[Column]) -> Column:
    """`no` if one is false, else `sin_leer` if one is null, else `si`."""
    every = list(predicates)
    none, unread = F.lit(False), F.lit(False)
    for p in every:
        none, unread = none | F.coalesce(~p, F.lit(False)), unread | p.isNull()
    return F.when(none, "no").when(unread, "sin_leer").otherwise("si")


def watched(state: Column, published: Column, now: Column, days: int = 180) -> Column:
    """Open, or stalled and published within so many days."""
    return (state == "abierta") | ((state == "parada") & (published >= now - F.make_interval(days=F.lit(days))))


def closing_within(is_open: Column, limit: Column, now: Column, days: int) -> Column:
    return hard(is_open & (days_until(limit, now) <= days))


def published_within(published: Column, now: Column, days: int) -> Column:
    return hard(days_until(now, published) <= days)


def amount_between(amount: Column, least=None, most=None) -> Column:
    """Null amounts fail as soon as a bound is set."""
    out = F.lit(True)
    if least is not None:
        out = out & (amount >= least)
    if most is not None:
        out = out & (amount <= most)
    return hard(out) if least is not None or most is not None else F.lit(True)


def overlaps_or_empty(places: Column, wanted: Sequence[str]) -> Column:
    """Some place is wanted, or there is none; without regard to case and accents."""
    named = F.array(*(F.lit(plain_text(w)) for w in wanted))
    return (F.coalesce(F.size(places), F.lit(0)) == 0) | F.arrays_overlap(F.transform(places, plain), named)


def flagged(warnings: Column, by_ocr: Column, trusted: bool = False) -> Column:
    """Has warnings that were read from text, not from an image; trusted: of a reading whose warnings hold from images too (factors, whose sums `provenance` has checked)."""
    some = F.coalesce(F.size(warnings), F.lit(0)) > 0
    return some if trusted else some & ~F.coalesce(by_ocr, F.lit(False))


def closes(states: Column, types: Column, phrases: Sequence[str] = ("acta de otorgamiento", "buena pro", "desierto", "contrato")) -> Column:
    """Ends a tender: there are states and none says it is called, or a document type has a result phrase."""
    ended = (F.coalesce(F.size(states), F.lit(0)) > 0) & ~F.exists(states, lambda s: plain(s) == "convocado")
    told = F.exists(types, lambda t: F.array_contains(F.transform(F.array(*map(F.lit, phrases)), lambda p: plain(t).contains(p)), True))
    return hard(ended) | hard(told)


@dataclass(frozen=True)
class Filters:
    """A faceted search. The last three are about what documents say, and so may be unread."""

    words: str = ""
    regions: tuple[str, ...] = ()
    closed_too: bool = False
    closing: int | None = None
    published: int | None = None
    least: str | None = None
    most: str | None = None
    offer_types: tuple[str, ...] = ()
    to_consult: bool = False
    most_experience: str | None = None
    specialty: str | None = None
    position: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def predicates(self, now: Column) -> list[Column]:
        c = lambda name: F.col(self.columns.get(name, name))
        out = []
        if self.words:
            out.append(hard(all_words(F.concat_ws(" ", c("entity"), c("title"), c("description")), self.words)))
        if self.regions:
            out.append(hard(F.arrays_overlap(c("regions"), F.array(*map(F.lit, self.regions)))))
        if not self.closed_too:
            out.append(hard(c("is_open")))
        if self.closing is not None:
            out.append(closing_within(c("is_open"), c("limit"), now, self.closing))
        if self.published is not None:
            out.append(published_within(c("published"), now, self.published))
        if self.least is not None or self.most is not None:
            bound = lambda x: None if x is None else F.lit(x).cast("decimal(15,2)")
            out.append(amount_between(c("amount"), bound(self.least), bound(self.most)))
        if self.offer_types:
            out.append(hard(c("offer_type").isin(*self.offer_types)))
        if self.to_consult:
            out.append(flagged(c("warnings"), c("by_ocr")))
        if self.most_experience is not None:
            out.append(c("experience") <= F.lit(self.most_experience).cast("decimal(15,2)"))
        if self.specialty is not None:
            out.append(plain(c("specialty")) == plain_text(self.specialty))
        if self.position is not None:
            out.append(F.exists(c("positions"), lambda p: plain(p).contains(plain_text(self.position))))
        return out


def listing(df: DataFrame, filters: Filters, now: Column) -> DataFrame:
    """Rows that pass, and those that may once they are read: column verdict is si or sin_leer."""
    return df.withColumn("verdict", verdict(filters.predicates(now))).filter("verdict <> 'no'")
