"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from lakeweave.plans import linkage, pair_features, reporting

QUERIES: dict = {**linkage.QUERIES, **pair_features.QUERIES, **reporting.QUERIES}
SQL: dict = {**linkage.SQL, **pair_features.SQL, **reporting.SQL}
