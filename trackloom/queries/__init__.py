"""Registered queries over the given tables, each with SQL for the same rows where that exists."""

from trackloom.queries import diagnostics, evidence, experiments, linking, pairs, quality, reports, texts, tracks

_MODULES = (tracks, texts, evidence, linking, pairs, quality, reports, diagnostics, experiments)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
