"""Seeded samples, splits, folds, oversampling and ranks that do not depend on row positions.

Every random choice is a hash of the row key and the seed, so it is the same after a
repartition, a retry or a lost executor. ``keys`` must identify a row. No operator here
sends all rows through one task: ranks are counted per hash bucket, exact-size samples
become a row-local filter behind a cut value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORT_LIMIT = 10_000  # rows of one hash prefix that are sorted to find the cut value
ROWS_PER_BUCKET = 100_000
REPEATED = "the key columns do not identify a row"


def key_hash(keys: Sequence[str | Column], seed: int) -> Column:
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def hash_number(hashed: Column, digits: int = 15) -> Column:
    """Leading hex digits of a hash as a bigint."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")


def in_fraction(keys: Sequence[str], fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of all keys."""
    bound = math.ceil(fraction * 2**32)
    if bound >= 2**32:
        return F.lit(True)
    return F.substring(key_hash(keys, seed), 1, 8) < f"{bound:08x}"


def split(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Train and test part; row-local, so no shuffle and no copy of a key in both parts."""
    chosen = in_fraction(keys, fraction, seed)
    return df.filter(chosen), df.filter(~chosen)


def first_by_hash(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> Column:
    """Row-local predicate that holds for exactly the ``n`` rows first in (hash, keys) order.

    Rows are counted per hash prefix (at most 4,096 counts per round); the prefix in which
    the n-th row lies is refined until a few thousand rows are left. Only the keys are read. If copies of one
    key lie on both sides of the cut, no such predicate exists and ``ValueError`` is raised, whatever the size.
    """
    hashed = key_hash(keys, seed)
    narrow = df.select(*keys, hashed.alias("_hash"))
    prefix, left = "", n
    if n <= 0:
        return F.lit(False)
    while True:
        width = len(prefix) + 3
        counts = (
            narrow.filter(F.col("_hash").startswith(prefix))
            .groupBy(F.substring("_hash", 1, width).alias("part"))
            .count()
            .orderBy("part")
            .collect()
        )
        size = 0
        for part, count in counts:
            if count > left:
                prefix, size = part, count
                break
            left -= count
        else:
            return F.lit(True)  # fewer than n rows in all
        if left == 0:
            return hashed < prefix
        if size <= SORT_LIMIT:
            rows = narrow.filter(F.col("_hash").startswith(prefix)).orderBy("_hash", *keys).limit(left + 1).collect()
            last = rows[left - 1]
            if rows[left] == last:
                raise ValueError(REPEATED)
            here = F.struct(hashed.alias("_hash"), *[F.col(k) for k in keys])
            cut = F.struct(
                F.lit(last["_hash"]).alias("_hash"),
                *[F.lit(last[k]).cast(df.schema[k].dataType).alias(k) for k in keys],
            )
            return here <= cut
        if width > 29:
            raise ValueError(REPEATED)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer)."""
    return df.filter(first_by_hash(df, keys, n, seed))


def sample_keys(df: DataFrame, key: str, percent: float, seed: int) -> DataFrame:
    """``int(rows * percent)`` keys."""
    keys = df.select(key)
    return sample_rows(keys, [key], int(keys.count() * percent), seed)


def split_exact(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Train part of exactly ``round(fraction * rows)`` rows, test part the rest."""
    n = round(fraction * df.select(*keys).count())
    chosen = first_by_hash(df, keys, n, seed)
    return df.filter(chosen), df.filter(~chosen)


def fold_number(keys: Sequence[str], folds: int, seed: int) -> Column:
    """Fold 0..folds-1 of each row."""
    return F.pmod(hash_number(key_hash(keys, seed), 8), F.lit(folds)).cast("int")


def one_per_key(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], seed: int) -> DataFrame:
    """One row per key: the first in hash order of ``row_id``.

    An aggregate instead of a window, so the copies of a hot key are reduced before the shuffle.
    """
    order = F.struct(key_hash(row_id, seed), *[F.col(c) for c in row_id])
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(packed, order).alias("_row")).select("_row.*")


def with_rank(df: DataFrame, keys: Sequence[str], seed: int, rows: int, name: str = "rank") -> DataFrame:
    """Number the rows 1.. in (hash, keys) order.

    A rank is the number of rows in earlier hash buckets plus the place inside the bucket, so
    the work is spread over buckets of about ``ROWS_PER_BUCKET`` rows.
    """
    digits = max(math.ceil(math.log(max(rows, 1) / ROWS_PER_BUCKET, 16)), 1)
    part = F.substring(key_hash(keys, seed), 1, digits)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per bucket of about ROWS_PER_BUCKET rows
        df.select(part.alias("_part"))
        .groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_part").orderBy("_hash", *keys)
    return (
        df.withColumn("_hash", key_hash(keys, seed))
        .withColumn("_part", F.substring("_hash", 1, digits))
        .join(offsets, "_part")
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_hash", "_part", "_offset")
    )


def drawn_rows(df: DataFrame, keys: Sequence[str], n: int, rows: int, seed: int) -> DataFrame:
    """``n`` rows drawn with replacement from the ``rows`` rows of ``df``.

    Keys alone are ranked, draws are counted per rank, and each drawn row is repeated after one join on its keys.
    """
    ranked = with_rank(df.select(*keys), keys, seed, rows, "_rank")
    number = hash_number(key_hash(["id"], seed))
    draws = df.sparkSession.range(n).groupBy((F.pmod(number, F.lit(rows)) + 1).alias("_rank")).agg(F.count("*").alias("_n"))
    copies = draws.join(ranked, "_rank").select(*keys, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
    return df.join(copies, list(keys)).select(*df.columns)


def oversample(
    df: DataFrame, keys: Sequence[str], label: str, value: int, total: int, seed: int, mark: str | None = None
) -> DataFrame:
    """Add copies of rows with ``label == value`` until that class has ``total`` rows.

    All columns are kept. ``mark`` names an optional 0/1 column that tells the copies apart.
    """
    members = df.filter(F.col(label) == value)
    rows = members.select(*keys).count()
    if rows == 0 or total < rows:
        raise ValueError(f"cannot fill a class of {rows} rows up to {total}")
    extra = drawn_rows(members, keys, total - rows, rows, seed)
    if mark:
        df, extra = df.withColumn(mark, F.lit(0)), extra.withColumn(mark, F.lit(1))
    return df.unionByName(extra)


def top_k(df: DataFrame, by: str, tie: str, k: int, ascending: bool = False) -> DataFrame:
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(order, tie).limit(k)


def side_by_side(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Join two short lists (top-k results) on their rank."""

    def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    return ranked(left, left_order).join(ranked(right, right_order), "rank")


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; columns missing on one side become null."""
    return first.unionByName(second, allowMissingColumns=True)
