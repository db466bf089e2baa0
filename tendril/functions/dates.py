"""Dates of tender data. Instants are UTC; days are counted on the calendar of Lima (UTC-5, no summer time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMA = "-05:00"

# Spanish names, Monday and January first.
WEEKDAYS = ("lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre")


def parse_portal(text: Column) -> Column:
    """`dd/MM/yyyy HH:mm` of Lima as an instant; a date alone is its last minute."""
    whole = F.when(F.trim(text).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat(F.trim(text), F.lit(" 23:59"))).otherwise(F.trim(text))
    return F.try_to_timestamp(F.concat(whole, F.lit(" " + LIMA)), F.lit("d/M/yyyy H:mm XXX"))


def lima_date(instant: Column) -> Column:
    """Calendar day in Lima; a timestamp without a zone is taken as UTC."""
    return F.to_date(instant.cast("timestamp_ntz") - F.expr("INTERVAL 5 HOURS"))


def days_until(day: Column, today: Column) -> Column:
    """Calendar days between dates or naive timestamps, not blocks of 24 hours."""
    return F.datediff(F.to_date(day), F.to_date(today)).cast("long")


def closing_bucket(days: Column) -> Column:
    return F.when(days <= 0, "hoy").when(days == 1, "manana").when(days < 7, "semana").when(days.isNotNull(), "despues")


def month_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("month", day))


def days_before(now: Column, days: Column) -> Column:
    return now - F.make_interval(days=days)


def long_date(day: Column) -> Column:
    """`lunes 3 de enero de 2000`."""
    names, months = F.array(*map(F.lit, WEEKDAYS)), F.array(*map(F.lit, MONTHS))
    return F.concat_ws(" ", F.get(names, F.weekday(day)), F.dayofmonth(day), F.lit("de"), F.get(months, F.month(day) - 1), F.lit("de"), F.year(day))


def short_date(day: Column) -> Column:
    """`3 ene.`."""
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.substring(F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1), 1, 3), F.lit("."))


def csv_instant(instant: Column) -> Column:
    """Lima time for a report, null as empty."""
    return F.coalesce(F.date_format(instant.cast("timestamp_ntz") - F.expr("INTERVAL 5 HOURS"), "dd/MM/yyyy HH:mm"), F.lit(""))


def months_of(text: Column) -> Column:
    """"24 meses", "3 años" in months."""
    number = F.regexp_extract(text, r"(?iu)(\d+)\)?\s*(mes|meses|año|años|ano|anos)\b", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?iu)(\d+)\)?\s*(mes|meses|año|años|ano|anos)", 2))
    return F.when(unit.startswith("a"), number * 12).otherwise(number)
