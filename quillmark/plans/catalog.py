"""Every query of the core by name, with its SQL."""

from __future__ import annotations

from quillmark.plans import bank, edits, pages, store, tables, texts

QUERIES: dict = {**pages.QUERIES, **bank.QUERIES, **texts.QUERIES, **tables.QUERIES, **edits.QUERIES, **store.QUERIES}
SQL: dict[str, str] = {**pages.SQL, **bank.SQL, **texts.SQL, **tables.SQL, **edits.SQL, **store.SQL}
