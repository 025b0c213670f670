"""Registered queries of the drawing operators, with the same results in DuckDB's SQL where SQL can express them.

Each runs over whole tables. All tables are derived from the given ones (fixtures.py); no query has an input of its own.
"""

from __future__ import annotations

from . import kit, library, pages, texts

QUERIES = {**kit.QUERIES, **library.QUERIES, **texts.QUERIES, **pages.QUERIES}
SQL = {**kit.SQL, **library.SQL, **texts.SQL, **pages.SQL}
