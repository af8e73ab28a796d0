"""Joins that stay balanced when one key holds a large part of all rows.

Most joins need nothing here: with the settings of ``session.configure`` Spark
measures the shuffled partitions and splits the skewed ones. The two joins of
the raw change table, the largest input, are salted: every key is counted, and a
hot one is split into as many places as its rows need. Tables of a few rows per
repository are joined through copies, and long top lists are ranked in two levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitloom.session import checkpoint

# What one task may get of a key; a key with more rows is split.
HOT_ROWS = 200_000
# Places of null keys, copies for rows of one repository, parts of a long top list.
SPLITS = 32
# Hashes that rows are counted by before their keys; of n rows each has about n / BUCKETS.
BUCKETS = 1 << 16

_SALT, _PLACE = "_salt", "_place"


def _salt_of(columns: Sequence[str], splits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(splits)).cast("int")


def _all_salts(splits: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with more than ``hot_rows`` rows and the places ``_splits`` it needs, as a stored table.

    Both sides of a join must see the same keys, so they are counted once, in
    full, and written. Rows are counted by a hash of the key first, a bounded number of
    counts, and by the key itself where a hash has more than ``hot_rows``.
    """
    bucket = F.xxhash64(*keys).bitwiseAND(F.lit(BUCKETS - 1)).alias("_bucket")
    full = rows.groupBy(bucket).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).select("_bucket")
    # a key with so many rows lies in a bucket with as many; mostly there is none, and no key is shuffled
    few = rows.select(*keys, bucket).join(F.broadcast(checkpoint(full)), "_bucket", "left_semi")
    counts = few.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = counts.where(F.col("_rows") > hot_rows)
    return checkpoint(hot.select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_splits")))


def placed(rows: DataFrame, keys: Sequence[str], spread: Sequence[str] | None = None) -> DataFrame:
    """With a hash of the keys as column ``place``, to join or group by before the keys themselves.

    Rows of one repository then sort by a number and not letter by letter. Rows of a null
    key match nothing and are dealt by the hash of ``spread`` if given.
    """
    key = F.xxhash64(*keys)
    if spread:
        key = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.xxhash64(*spread)).otherwise(key)
    return rows.withColumn("place", key)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread: Sequence[str],
    profile: DataFrame,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join (inner or left) whose hot left keys are split over tasks.

    Left rows of a hot key go, by the hash of ``spread``, to one of as many places
    as hold ``hot_rows`` rows each (``HOT_ROWS`` if not given); the matching right
    rows are copied to all of them. All other keys keep one place. ``profile`` is a
    stored table with the keys of ``left``; its key columns are read once more to
    find the hot ones. Of n rows at most n / ``hot_rows`` keys are hot; Spark
    broadcasts them where their written size allows.
    """
    flags = hot_keys(profile, on, hot_rows or HOT_ROWS)
    # null keys match nothing and are spread like a hot key
    nothing = reduce(or_, [F.col(key).isNull() for key in on])
    places = F.coalesce("_splits", F.when(nothing, SPLITS), F.lit(1))
    salted_left = (
        left.join(flags, list(on), "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(*spread), places).cast("int"))
        .drop("_splits")
    )
    salted_right = (
        right.join(flags, list(on), "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)))
        .drop("_splits")
    )
    # a hash stands first, so that rows are sorted by a number and not letter by letter
    left_rows = placed(salted_left, on, spread).withColumnRenamed("place", _PLACE)
    right_rows = placed(salted_right, on).withColumnRenamed("place", _PLACE)
    return left_rows.join(right_rows, [_PLACE, *on, _SALT], how).drop(_PLACE, _SALT)


def ranked(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, name: str,
    *, spread: Sequence[str], splits: int = SPLITS,
) -> DataFrame:
    """The first ``limit`` rows of every key, ranked from 1 in column ``name``.

    Up to a limit of the session Spark cuts each map task's rows before the shuffle.
    For a higher one there are two levels: each of ``splits`` parts of a key, dealt by
    the hash of ``spread``, is cut to its own first rows, then the parts together, so
    a hot key is sorted by many tasks and the last one holds ``splits * limit`` rows.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    if limit >= int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = Window.partitionBy(*keys, _SALT).orderBy(*order)
        dealt = rows.withColumn(_SALT, _salt_of(spread, splits)).withColumn(name, F.row_number().over(part))
        rows = dealt.where(F.col(name) <= limit).drop(_SALT, name)
    return rows.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= limit)


def per_repo_join(
    left: DataFrame,
    per_repo: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread: Sequence[str],
    splits: int = SPLITS,
) -> DataFrame:
    """Join with a table of a few rows per repository.

    A repository may hold a third of all rows, so the small side is copied
    ``splits`` times and every repository is spread. Spark still broadcasts the
    small side where its measured size allows.
    """
    salted_left = left.withColumn(_SALT, _salt_of(spread, splits))
    copied = per_repo.withColumn(_SALT, _all_salts(splits))
    return salted_left.join(copied, [*on, _SALT], how).drop(_SALT)
