"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from caseloom.llm import alignment, decontaminate, extract, language, media, neardup, packing, pii, quality, repair, tokens, urls, warc

MODULES = [neardup, decontaminate, media, tokens, warc, urls, extract, language, pii, packing, quality, repair, alignment]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
