"""Rule-based answer when no model answer can be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import number


def product_or_default(
    factors: Sequence[str] | None, default: float, product_tag: str = "fallback_product",
    default_tag: str = "fallback_median",
) -> tuple[Column, Column]:
    """(value, source): product of the factors when all are present, else the default."""
    if not factors:
        return F.lit(float(default)), F.lit(default_tag)
    value = number(factors[0])
    for f in factors[1:]:
        value = value * number(f)
    return (F.coalesce(value, F.lit(float(default))),
            F.when(value.isNotNull(), F.lit(product_tag)).otherwise(F.lit(default_tag)))


def domain_fallback(
    df: DataFrame, target: str, factors: Sequence[str] | None, default: float,
    value_name: str = "fallback_value", source_name: str = "fallback_source",
) -> DataFrame:
    """Add the fallback value and its source to the rows without a target."""
    tag = "fallback_" + "_x_".join(f.lower() for f in factors or [])
    value, source = product_or_default(factors, default, tag)
    open_row = F.col(target).isNull()
    return df.withColumns({value_name: F.when(open_row, value),
                           source_name: F.when(open_row, source)})
