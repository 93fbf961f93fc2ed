"""Registered queries, each with the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from quillspark.queries import composition, maintenance, partitions, passing, surface, writing

_MODULES = (partitions, composition, writing, maintenance, passing, surface)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
