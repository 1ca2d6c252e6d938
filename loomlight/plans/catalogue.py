"""Every registered query and its SQL, gathered from the modules of the library."""

from __future__ import annotations

from collections.abc import Iterable

from . import code, drivers, kept, scanned, tables

MODULES = (code, tables, scanned, drivers, kept)


def gathered(tables: Iterable[dict]) -> dict:
    """All entries; a name that two modules register is an error."""
    out: dict = {}
    for t in tables:
        if both := out.keys() & t.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= t
    return out


QUERIES = gathered(m.QUERIES for m in MODULES)
ORACLE_SQL = gathered(m.ORACLE_SQL for m in MODULES)
