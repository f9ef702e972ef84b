"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import bundles, engine, extras, mapping, office, register, scalars, transfers

_PARTS = (office, scalars, engine, register, bundles, transfers, mapping, extras)
QUERIES = {k: v for p in _PARTS for k, v in p.query.queries.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.query.oracle.items()}
