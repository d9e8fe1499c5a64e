"""Balanced folds and row permutations by keyed hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronopanel.operators.scan import row_rank
from chronopanel.schema import SEED


def keyed_hash(keys, seed=SEED) -> Column:
    """Text hash of the row key and a seed; the same on every run and engine."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_rank(df: DataFrame, keys, group=(), seed=SEED, digits=4, name="_rank") -> DataFrame:
    """Shuffled row number per group.

    Hash prefixes are the blocks of the rank: they are even in size whatever the data,
    so one large label spreads over 16 ** digits tasks.
    """
    hashed = df.withColumn("_h", keyed_hash(keys, seed)).withColumn("_hp", F.substring("_h", 1, digits))
    return row_rank(hashed, list(group), "_hp", ["_h", *keys], name).drop("_h", "_hp")


def stratified_folds(df: DataFrame, label: str, keys, folds=5, seed=SEED, name="fold") -> DataFrame:
    """Fold 0..folds-1; per label the fold sizes differ by at most one row."""
    out = hash_rank(df, keys, [label], seed)
    return out.withColumn(name, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def permuted(df: DataFrame, names, keys, seed=SEED) -> DataFrame:
    """Add name__p columns holding the row's values from another row of a shuffled order."""
    ranked = hash_rank(df, keys, seed=seed, name="_a")
    other = hash_rank(df, keys, seed=seed + 1, name="_a").select("_a", *[F.col(c).alias(f"{c}__p") for c in names])
    return ranked.join(other, "_a").drop("_a")
