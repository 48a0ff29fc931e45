"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from eventscope.plans import catalog

ORACLE_SQL: dict[str, str] = dict(catalog.SQL)
