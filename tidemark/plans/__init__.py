"""Queries over the driver's tables. Importing this package registers them all."""

from . import aligned, audits, chunked, contexts, cued, evidenced, flowed, folded, intervals, jobbed, patched, repaired, reread, retrievals, tables, texts  # noqa: F401
