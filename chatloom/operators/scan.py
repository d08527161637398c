"""Running totals per key that no single task has to carry, however many rows one key holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.scratch import written

#: A running aggregate: the value of a row, and the function that combines values (it must be associative).
Running = tuple[Column, Callable[[Column], Column]]


def running(rows: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, Running], label: str = "scan") -> DataFrame:
    """``rows`` with each of ``totals`` over the key's rows up to and including this one, in ``order``.

    Rows are dealt by ranges of key and order, so that a key with very many rows lies in consecutive parts. Each part has its own running
    aggregate and its total; what a part takes over from those before it is an aggregate over one total for each part of the key,
    never over the key's rows. Rows that agree in key and order are told apart by no column and may come in either order. Null keys are keys.
    """
    by = [*keys, *order]
    placed = written(rows.withColumns({f"_of_{name}": value for name, (value, _) in totals.items()}).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), label)
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", *keys).agg(*(how(f"_of_{name}").alias(f"_of_{name}") for name, (_, how) in totals.items()))
    carried = parts.select("_part", *keys, *(how(f"_of_{name}").over(before).alias(f"_from_{name}") for name, (_, how) in totals.items()))
    # only keys that lie in several parts have something to take over
    carried = carried.where(F.coalesce(*(F.col(f"_from_{name}") for name in totals)).isNotNull()).toDF("_p", *(f"_k{i}" for i in range(len(keys))), *(f"_from_{name}" for name in totals))
    met = (F.col("_part") == F.col("_p"))
    for i, key in enumerate(keys):
        met &= F.col(key).eqNullSafe(F.col(f"_k{i}"))
    local = placed.withColumns({name: how(f"_of_{name}").over(within) for name, (_, how) in totals.items()}).join(carried, met, "left")
    both = lambda name, how: _combined(how, F.col(f"_from_{name}"), F.col(name))
    return local.select(*rows.columns, *(both(name, how).alias(name) for name, (_, how) in totals.items()))


def _combined(how: Callable, before: Column, own: Column) -> Column:
    joined = {F.sum: lambda: before + own, F.bit_xor: lambda: before.bitwiseXOR(own), F.max: lambda: F.greatest(before, own), F.bool_or: lambda: before | own}[how]()
    return F.when(before.isNull(), own).otherwise(joined)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str, label: str = "numbered") -> DataFrame:
    """``rows`` with their places within the key, from 1."""
    return running(rows, keys, order, {name: (F.lit(1).cast("bigint"), F.sum)}, label)
