"""Running sums, predecessors and exact quantiles over ranges (ids A6, A25, V1, V8, V16 of the survey).

A window over a key sorts all rows of the key in one task; without a key, all rows of the table. Here rows are dealt by
range of (key, order), so that a key with half of all rows lies in many tasks. Each task works on its own range; what a
range hands on to the next one (its last key, that key's sums and last value) is one row for each range, and the carries
are added up from these. They are the only rows that reach the driver: as many as there are shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotforge.operators import tables


def carried(frame: DataFrame, key: str | None, order: list[str], sums: list[str] = (), value: str | None = None) -> DataFrame:
    """The rows with ``before_<s>``: the sum of each of ``sums`` over the rows before it in its key, and ``before``: the
    value of the row just before it. Sums are of whole numbers.

    Without a key all rows are one. Rows that tie in ``order`` follow each other in any order, so it should be total.
    Nulls are first, a null key is a key; nulls count as nothing in sums.
    """
    k, v = "__key", "__value"
    # written first, as dealing by range reads its input twice
    rows = tables.cut(frame.withColumns({k: F.lit(0) if key is None else F.col(key), v: F.col(value) if value else F.lit(0), **{f"__s_{s}": F.coalesce(F.col(s), F.lit(0)).cast("long") for s in sums}}))
    parts = tables.cut(rows.repartitionByRange(k, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", k).orderBy(*order)
    ends = parts.groupBy("__part", k).agg(*[F.sum(f"__s_{s}").alias(f"__s_{s}") for s in sums], F.max_by(v, F.struct(*order)).alias(v))
    tail = F.max_by(F.struct(k, v, *[f"__s_{s}" for s in sums]), F.struct(k))
    ends = ends.groupBy("__part").agg(F.min(F.struct(k)).alias("first"), tail.alias("tail")).orderBy("__part").collect()  # a row for each range
    carries, open_ = [], None
    for part, (first,), (last, final, *totals) in ends:
        own = open_ if open_ is not None and open_[0] == first else None
        if own:
            carries.append((part, *own))
            totals = [a + b for a, b in zip(totals, own[2:], strict=True)] if first == last else totals
        open_ = (last, final, *totals)
    types = dict(parts.dtypes)
    schema = f"__part int, __ckey {types[k]}, __cvalue {types[v]}" + "".join(f", __c_{s} long" for s in sums)
    given = frame.sparkSession.createDataFrame(carries, schema).withColumn("__has", F.lit(True))
    joined = parts.join(F.broadcast(given), "__part", "left")
    mine = F.col("__has").isNotNull() & F.col(k).eqNullSafe(F.col("__ckey"))
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    new = {f"before_{s}": F.coalesce(F.sum(f"__s_{s}").over(upto), F.lit(0)) + F.when(mine, F.col(f"__c_{s}")).otherwise(0) for s in sums}
    if value:
        new["before"] = F.when((F.row_number().over(inside) == 1) & mine, F.col("__cvalue")).otherwise(F.lag(v).over(inside))
    return joined.withColumns(new).select(*frame.columns, *new)


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each share): exact quantiles with linear interpolation; nulls are left out.

    Equal values are counted first; running counts tell where each place falls, so no task holds the values of a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    placed = carried(counted, by, [value], ["__n"])
    sizes = counted.groupBy(by).agg(F.sum("__n").alias("n"))
    near = placed.join(sizes.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before___n") <= place) & (place < F.col("before___n") + F.col("__n")), F.col(value)))

    exact = lambda q: (F.col("n") - 1) * F.lit(q)
    picked = near.groupBy(by, "n").agg(*[f(exact(q)).alias(f"__{n}_{i}") for n, q in shares.items() for i, f in enumerate((lambda p: at(F.floor(p)), lambda p: at(F.ceil(p))))])
    out = {n: F.col(f"__{n}_0") + (F.col(f"__{n}_1") - F.col(f"__{n}_0")) * (exact(q) - F.floor(exact(q))) for n, q in shares.items()}
    return picked.select(by, "n", *[c.alias(n) for n, c in out.items()])
