"""Scenario families of a data set."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_unit, row_hex, row_unit
from ..operators import inject
from ..operators.order import smallest_of_many
from ..session import cut_lineage
from ..sources.tables import rate_percent

# Scenario families and the mechanism each one belongs to.
FAMILIES = {
    "MAR_TARGET": "MAR",
    "MNAR_TARGET": "MNAR",
    "MCAR_TARGET": "MCAR",
    "MCAR_GLOBAL": "MCAR",
}


@dataclass(frozen=True)
class ScenarioSpec:
    """What a data set needs to be given holes."""

    dataset_key: str
    dataset_name: str
    target: str
    mar_driver: str
    keys: tuple[str, ...]
    excluded: tuple[str, ...] = ()

    def holed(self, df: DataFrame, family: str, rate: float, seed: int) -> DataFrame:
        keys = list(self.keys)
        if family == "MAR_TARGET":
            return inject.mar(df, self.mar_driver, self.target, rate, keys, seed)
        if family == "MNAR_TARGET":
            return inject.mnar(df, self.target, rate, keys, seed)
        if family == "MCAR_TARGET":
            return inject.mcar_column(df, rate, self.target, keys, seed)
        if family == "MCAR_GLOBAL":
            return inject.mcar_excluding(df, rate, self.excluded, keys, seed)
        raise ValueError(f"Unknown scenario family '{family}'.")


def scenario_rows(
    df: DataFrame, spec: ScenarioSpec, rates: Sequence[float] = (0.10, 0.15), seed: int = 42,
    families: Sequence[str] = tuple(FAMILIES),
) -> DataFrame:
    """All scenarios in one table: the columns of `df` with holes, `scenario_family` and `rate_pct`.

    The draws of all families stand next to each row of one stored table; a scenario is a predicate on them, so all
    of them come from one scan. They have the same holes as `ScenarioSpec.holed` makes.
    """
    keys, target = list(spec.keys), spec.target
    unknown = [f for f in families if f not in FAMILIES]
    if unknown:
        raise ValueError(f"Unknown scenario family '{unknown[0]}'.")
    drivers = {"MAR_TARGET": spec.mar_driver, "MNAR_TARGET": target}
    if "MAR_TARGET" in families and spec.mar_driver == target:
        raise ValueError("The driver and the target must be different columns.")
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("filled"), *[
        F.count_if(inject.open_cell(d, target)).alias(f) for f, d in drivers.items()]).first()
    staged, wanted = df, {}
    for family, driver in drivers.items():
        if family in families:
            wanted[f"_{family}"] = [min(int(round(r * sizes["n"])), sizes[family]) for r in rates]
            staged = inject.with_ranked_draw(staged, driver, target, keys, seed, sizes[family], f"_{family}")
    if "MCAR_TARGET" in families:
        wanted["_MCAR_TARGET"] = [int(r * sizes["n"]) for r in rates]
        if max(wanted["_MCAR_TARGET"], default=0) > sizes["filled"]:
            raise ValueError(f"Cannot empty {max(wanted['_MCAR_TARGET'])} of {sizes['filled']} filled cells in '{target}'.")
        staged = staged.withColumn("_MCAR_TARGET", F.when(
            F.col(target).isNotNull(), hex_unit(row_hex(seed, keys, target), 1)))
    staged = cut_lineage(staged.withColumn("_t", inject.tie_breaker(target, keys, seed)))
    holes = smallest_of_many(staged, wanted, "_t") if wanted else {}
    slots = []
    for i, rate in enumerate(rates):
        for family in families:
            if family == "MCAR_GLOBAL":
                cells = [F.when(row_unit(seed, keys, c) >= F.lit(rate), F.col(c)).alias(c)
                         if c not in keys and c not in spec.excluded else F.col(c) for c in df.columns]
            else:
                hole = holes[f"_{family}", wanted[f"_{family}"][i]]
                cells = [F.when(~hole, F.col(c)).alias(c) if c == target else F.col(c) for c in df.columns]
            slots.append(F.struct(*cells, F.lit(family).alias("scenario_family"),
                                  F.lit(rate_percent(rate)).alias("rate_pct")))
    return staged.select(F.inline(F.array(*slots)))


def generate_scenarios(
    df: DataFrame, spec: ScenarioSpec, rates: Sequence[float] = (0.10, 0.15), seed: int = 42,
    families: Sequence[str] = tuple(FAMILIES),
) -> Iterator[tuple[str, float, DataFrame]]:
    """(family, rate, holed table) for every family and rate."""
    rows = scenario_rows(df, spec, rates, seed, families)
    for rate in rates:
        for family in families:
            here = (F.col("scenario_family") == family) & (F.col("rate_pct") == rate_percent(rate))
            yield family, rate, rows.where(here).select(*df.columns)


def write_scenarios(df: DataFrame, spec: ScenarioSpec, root: str, rates: Sequence[float] = (0.10, 0.15),
                    seed: int = 42, families: Sequence[str] = tuple(FAMILIES)) -> int:
    """All scenarios in one job; how many there are."""
    rows = scenario_rows(df, spec, rates, seed, families)
    mechanism = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    name = F.concat(F.lit(f"{spec.dataset_key}_"), F.lower("scenario_family"))
    (rows.select(*df.columns, F.element_at(mechanism, F.col("scenario_family")).alias("mechanism"),
                 name.alias("scenario"), "rate_pct")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("mechanism", "scenario", "rate_pct").parquet(root))
    return len(rates) * len(families)
