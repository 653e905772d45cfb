"""Small helpers for text columns and the tables of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; ``sf_dir`` may be any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def boxed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``__row__``, so that an operator's own columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row__"))


def field(name: str) -> Column:
    """A column of a boxed frame."""
    return F.col(f"__row__.`{name}`")


def unboxed(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The given columns again, and new ones, which replace those of the same name in any case."""
    names = {n.lower() for n in new}
    return df.select(*[field(c).alias(c) for c in columns if c.lower() not in names], *[v.alias(n) for n, v in new.items()])


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@contextmanager
def filtered_scans(spark: SparkSession) -> Iterator[None]:
    """Let Spark put its Bloom filter of a join's small side, bounded by its own settings, on scans of any size."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)
