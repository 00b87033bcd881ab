"""Every query of the library outside the corpus operators, with the SQL that checks it."""

from __future__ import annotations

from caseloom.functions import fields, passages, text
from caseloom.operators import answers, catalog, folios, furniture, layout, linkage, listings, merge, names, nested, readings, regions, retrieval, sequence, state, store, tables, timeline
from caseloom.plans import calendar, contracts, deadlines, evidence, obligations, validators
from caseloom.streaming import events, joins

MODULES = [retrieval, answers, sequence, merge, linkage, timeline, store, state, layout, listings, catalog, furniture, names, tables, regions, folios, nested, readings, calendar, deadlines, obligations, evidence, validators, contracts, text, fields, passages, events, joins]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
