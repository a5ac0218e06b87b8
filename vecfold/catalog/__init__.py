"""Queries over the given tables, one per operator, with SQL equivalents where SQL is feasible."""

from vecfold.catalog import clusters, density, ingest, repeats, samples, trials, vectors  # noqa: F401
from vecfold.catalog.registry import ORACLES, QUERIES  # noqa: F401
