"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from sagekeep.plans import graph, references, text, write

#: ``text`` and ``write`` register their queries with ``graph``.
MODULES = [graph, references, text, write]

QUERIES = {name: query for module in MODULES for name, query in getattr(module, "QUERIES", {}).items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
