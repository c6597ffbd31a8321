"""From sequences to tokens, adjacent pairs and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<S>"


def tokens(corpus: DataFrame, *keys: str) -> DataFrame:
    """keys, id, pos, sign, len: one row for each sign."""
    return corpus.select(*keys, "id", F.posexplode("signs").alias("pos", "sign"), F.size("signs").alias("len"))


def pairs(corpus: DataFrame, *keys: str) -> DataFrame:
    """keys, id, pos, a, b: adjacent signs, formed inside the row so that only counting shuffles."""
    s = F.col("signs")
    rest = F.greatest(F.size(s) - 1, F.lit(0))
    both = F.zip_with(F.slice(s, 1, rest), F.slice(s, 2, rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return corpus.where(F.size(s) > 1).select(*keys, "id", F.posexplode(both).alias("pos", "p")).select(*keys, "id", "pos", "p.a", "p.b")


def contexts(corpus: DataFrame, order: int, *keys: str) -> DataFrame:
    """keys, id, pos, w and c1..c(order-1), the signs before it (c1 the nearest), padded with START."""
    padded = F.concat(F.array_repeat(F.lit(START), order - 1), F.col("signs")) if order > 1 else F.col("signs")
    exploded = corpus.select(*keys, "id", padded.alias("padded"), F.posexplode("signs").alias("pos", "w"))
    before = [F.element_at("padded", F.col("pos") + order - j).alias(f"c{j}") for j in range(1, order)]
    return exploded.select(*keys, "id", "pos", "w", *before)


def counted(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
