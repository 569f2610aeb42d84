"""Every registered query of the library and its SQL."""

from __future__ import annotations

from .plans import formats, generators, models, oracle, regions


def entry(spark, sf_dir):
    """A trained map, every sample's best neuron, and the quantisation error by neuron."""
    return models.flagship(spark, sf_dir)


def queries() -> dict:
    return {**oracle.QUERIES, **models.QUERIES, **regions.QUERIES, **generators.QUERIES, **formats.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracle.SQL, **models.SQL, **regions.SQL, **generators.SQL, **formats.SQL}
