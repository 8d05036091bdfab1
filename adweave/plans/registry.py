"""All queries of the library proper, and the SQL that checks them."""

from __future__ import annotations

from . import analysis, composites, extras, joining, ordering, pictures, pipelines, records, reporting, rules, scalars, sources, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (reporting, scalars, joining, ordering, pipelines, extras, records, analysis, streams, rules, pictures, sources, composites):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
