"""Queries that apply the operators to the supplied tables, with SQL twins."""

from . import aggregates, cameras, depth, files, graphs, kernels, lattices, regions, scalars, sequences, surfaces, tracks  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401
