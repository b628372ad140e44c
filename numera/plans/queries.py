"""All queries of this package but those of its optional subpackage."""

from __future__ import annotations

from . import algebra_geometry, decompositions, digraphs, extended, grown_models, more, solvers, special_functions, spectra, statistics, structures, suffixes_and_factors, topology, transforms, yet_more  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
