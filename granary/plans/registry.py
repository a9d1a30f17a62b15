"""All queries by name, with equivalent SQL where an oracle can run it."""

from __future__ import annotations

from . import primitives, ssb, tpch, workloads

QUERIES = {**tpch.QUERIES, **ssb.QUERIES, **workloads.QUERIES, **primitives.QUERIES}
ORACLE_SQL = {**tpch.ORACLE_SQL, **ssb.ORACLE_SQL, **workloads.ORACLE_SQL, **primitives.ORACLE_SQL}
