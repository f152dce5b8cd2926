"""All queries of the engine by name, and for each the SQL that gives the same rows."""

from __future__ import annotations

from . import judging, records, speaking, stores, streams, texts

_MODULES = (speaking, judging, texts, stores, records, streams)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
