"""Helpers shared by the plan modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources import fixtures


def r(c, digits: int = 6) -> Column:
    """Round a double for order-free comparison with the oracle."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def C(spark, sf_dir) -> DataFrame:
    return fixtures.catalog_listings(spark, sf_dir)


def D(spark, sf_dir) -> DataFrame:
    return fixtures.document_listings(spark, sf_dir)


def H(spark, sf_dir) -> DataFrame:
    return fixtures.html_listings(spark, sf_dir)


def P(spark, sf_dir) -> DataFrame:
    return fixtures.predictions(spark, sf_dir)


def V(spark, sf_dir) -> DataFrame:
    return fixtures.word_vectors(spark, sf_dir)


def select_named(df: DataFrame, key: str, cols: dict[str, Column]) -> DataFrame:
    return df.select(key, *[c.alias(n) for n, c in cols.items()])
