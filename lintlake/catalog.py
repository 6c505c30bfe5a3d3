"""All core queries and their SQL, gathered from the modules of `plans`."""

from __future__ import annotations

from lintlake.plans import corpus, literal, relational, reviews, telemetry

MODULES = [telemetry, corpus, reviews, relational, literal]

QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL: dict = {name: q for m in MODULES for name, q in m.SQL.items()}
