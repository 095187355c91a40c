"""Small plan-shaping helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array_column: str, name: str) -> DataFrame:
    """Explode an array column into ``name``, dropping rows without elements.

    A plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push it below
    the projection that builds the array, which evaluates an expensive array twice. The
    outer form with a null test afterwards gives the same rows and one evaluation.
    Elements must not be null.
    """
    kept = [c for c in df.columns if c != array_column]
    return df.select(*kept, F.explode_outer(array_column).alias(name)).filter(F.col(name).isNotNull())


def emit(df: DataFrame, keep: Sequence[str], candidates: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One output row per candidate ``(condition, struct)`` whose condition holds.

    All conditions read the row once; nothing is filtered below the generator, so
    expensive inputs are not evaluated a second time.
    """
    options = F.array(*[F.struct(cond.alias("hit"), row.alias("row")) for cond, row in candidates])
    return df.select(*keep, F.explode(options).alias("option")).filter("option.hit").select(*keep, "option.row.*")


def with_totals(df: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Attach aggregates over the whole frame (or per group in ``by``) to every row.

    A window over the same keys would put a whole group into one task; this joins the
    few aggregate rows back instead (or reads them as scalar subqueries).
    """
    if by:
        sums = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in totals.items()])
        return df.join(sums, list(by), "inner")
    whole = df.agg(F.struct(*[agg.alias(name) for name, agg in totals.items()]).alias("whole")).scalar()
    return df.select("*", *[whole.getField(name).alias(name) for name in totals])


#: Bits of a filter of keys: so many a key, within these bounds. The most are 2^21 rows of a few bytes.
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def likely_listed(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``big`` whose key is in ``keys``, and by chance some more; nothing is moved.

    The hashes of the keys are folded into a bit array that is broadcast. It has 16 bits a
    key, by the number of keys that the query itself counts, so 6 % of the other rows pass;
    above 2^23 keys it grows no more, and lets more rows through until all pass. Meant for
    narrow rows; for rows with content see ``places.only_listed``.
    """
    wanted = keys.select(*on).distinct()
    count = wanted.agg(F.count("*")).scalar()
    bits = F.least(F.greatest(count * BITS_PER_KEY, F.lit(LEAST_BITS)), F.lit(MOST_BITS))
    bit = F.pmod(F.xxhash64(*on), bits)
    place, flag = F.shiftright(F.col("_bit"), 6), F.expr("shiftleft(1L, cast(_bit % 64 AS int))")
    words = wanted.select(bit.alias("_bit")).select(place.alias("_place"), flag.alias("_flag"))
    words = words.groupBy("_place").agg(F.bit_or("_flag").alias("_flags"))
    near = big.withColumn("_bit", bit).withColumn("_place", place).join(F.broadcast(words), "_place", "inner")
    return near.filter(F.col("_flags").bitwiseAND(flag) != 0).select(*big.columns)


def semi_join_filtered(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``big LEFT SEMI keys`` that moves only rows of ``big`` whose key is very likely listed."""
    return likely_listed(big, keys, on).join(keys.select(*on).distinct(), list(on), "left_semi")


#: Spark limits ranks on the map side up to this rank.
MAP_SIDE_RANK = 1000
_SALTS = 64


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], limit: int, rank: str, salt: str) -> DataFrame:
    """The first ``limit`` rows of each group, numbered in ``rank``.

    Ranks that Spark does not limit before the shuffle are taken twice: of a group's parts,
    dealt out by a hash of ``salt``, and of the rows that are left. No task sorts a whole group.
    """
    if limit > MAP_SIDE_RANK:
        part = F.pmod(F.xxhash64(salt), F.lit(_SALTS))
        near = Window.partitionBy(*by, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn(rank, F.row_number().over(near)).filter(F.col(rank) <= limit).drop("_part", rank)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= limit)
