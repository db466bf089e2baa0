"""Queries of the library over the driver's tables, and the same in SQL."""

from __future__ import annotations

from .plans import more, protocol, reading, report, serving, texts, tracked, upkeep

QUERIES = {**report.QUERIES, **tracked.QUERIES, **texts.QUERIES, **reading.QUERIES, **more.QUERIES, **upkeep.QUERIES, **protocol.QUERIES, **serving.QUERIES}
ORACLE_SQL = {**report.ORACLE_SQL, **tracked.ORACLE_SQL, **texts.ORACLE_SQL, **reading.ORACLE_SQL, **more.ORACLE_SQL, **upkeep.ORACLE_SQL, **protocol.ORACLE_SQL, **serving.ORACLE_SQL}
