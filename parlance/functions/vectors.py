"""Vector expressions for single values.  Bulk scoring is in ``operators.vectors``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plus(acc: Column, x: Column) -> Column:
    return acc + x


def dot(a: Column, b: Column) -> Column:
    """Dot product in DOUBLE.  NULL in, NULL out; vectors of different length raise."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), _plus)
    message = F.concat(
        F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")
    )
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.size(a) != F.size(b), F.raise_error(message).cast("double"))
        .otherwise(product)
    )


def norm(vector: Column, order: float | str = 2) -> Column:
    """p-norm; ``"inf"`` and ``"-inf"`` give the largest and smallest absolute value, 0 counts non-zero cells."""
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    if order == "inf":
        return F.array_max(sizes)
    if order == "-inf":
        return F.array_min(sizes)
    if order == 0:
        return F.when(vector.isNotNull(), F.size(F.filter(sizes, lambda x: x != 0))).cast("double")
    if order == 1:
        return F.aggregate(sizes, F.lit(0.0), _plus)
    if order == 2:
        return F.sqrt(F.aggregate(F.transform(sizes, lambda x: x * x), F.lit(0.0), _plus))
    powers = F.transform(sizes, lambda x: F.pow(x, F.lit(float(order))))
    return F.pow(F.aggregate(powers, F.lit(0.0), _plus), F.lit(1.0 / float(order)))


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(
        F.transform(vector, lambda x: x.cast("double"))
    )
