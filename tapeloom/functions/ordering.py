"""Global orders and running aggregates that no single task has to hold.

Rows are cut into buckets along the order; a bucket's rows are windowed on their own, and what comes before a bucket is one row
of a per-bucket aggregate. The only window without a cut goes over bucket rows; at BUCKET rows a bucket, 10^12 rows are
1.5 * 10^7 of them. (A second level of buckets would read the rows once more in every nested use, which costs far more than it saves.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.binary import joined_pieces, sum_pieces

#: Rows per bucket, about, for callers to aim at.
BUCKET = 65_536
_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, bucket: Column, order: list, keys: list[str] | tuple = (), inclusive: bool = True, **aggs: tuple[str, Column]) -> DataFrame:
    """df plus, for each name=(sum|max|min|wrap, column), the aggregate over the rows up to each row (before it, if not
    inclusive). wrap is a sum modulo 2^64.

    bucket must not fall as order rises; buckets should hold some BUCKET rows."""
    keys, wraps = list(keys), [n for n, (f, _) in aggs.items() if f == "wrap"]
    if wraps:
        plain = {n: a for n, a in aggs.items() if n not in wraps}
        parts = {f"{n}_p{k}": ("sum", piece) for n in wraps for k, piece in enumerate(sum_pieces(aggs[n][1].cast("bigint")))}
        out = running(df, bucket, order, keys, inclusive, **plain, **parts)
        return out.withColumns({n: joined_pieces(*(F.col(f"{n}_p{k}") for k in range(3))) for n in wraps}).drop(*parts)
    rows = df.withColumn("_bucket", bucket)
    per = rows.groupBy(*keys, "_bucket").agg(*(_AGG[f](c).alias(f"_{n}") for n, (f, c) in aggs.items()))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_b"), *(_AGG[f](f"_{n}").over(before).alias(f"_before_{n}") for n, (f, _) in aggs.items()))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.join(per, same)
    rows = rows.withColumns({n: _JOIN[f](_AGG[f](c).over(inside), F.col(f"_before_{n}")) for n, (f, c) in aggs.items()})
    return rows.drop("_bucket", "_b", *(f"_k_{k}" for k in keys), *(f"_before_{n}" for n in aggs))


def numbered(df: DataFrame, bucket: Column, order: list, name: str, keys: list[str] | tuple = ()) -> DataFrame:
    """df plus name: 1, 2, ... in order (over everything, or within keys)."""
    return running(df, bucket, order, keys, **{name: ("sum", F.lit(1).cast("bigint"))})
