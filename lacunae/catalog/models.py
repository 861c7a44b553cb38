"""Model imputers: exact results where SQL can fit the model, else facts about every cell.

A fact table says for each column how many cells there are, how many were holes, how many observed
cells were changed, how many holes stayed open, how many fills lie outside the observed values, and
whether the fills are nearer to the truth than the mean. SQL counts the cells and holes itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, inject
from ..operators.dae import DenoisingImputer
from ..operators.forest import MissForest
from ..operators.mice import Mice
from ..operators.registry import IMPUTERS, build_imputer
from ..plans.benchmark import cross_validate
from ..session import store
from .fixtures import LINE_KEYS, LINES, ORDER_KEYS, lines, orders, sql_keep, sql_unit

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_charge"]
_SUM_KEYS = ["l_orderkey"]
_SUMS = ["n_lines", "sum_quantity", "sum_price", "sum_charge"]


def _facts(full, keys, holes, make, columns, scored) -> DataFrame:
    """Facts about `make(keys)` on `full` with a tenth of the `holes` columns emptied.

    Truth and holes are carried in the rows, because the keys of the lines are not quite unique. The table is kept,
    because an imputer reads it many times.
    """
    holed = store(evaluate.with_holes(inject.mcar(
        evaluate.with_truth(full, columns), 0.1, keys, 42, holes), columns), *keys)
    pair = evaluate.as_filled(make([*keys, *evaluate.carried(columns)]).fit_transform(holed), columns)
    numbers = [c for c in columns if full.schema[c].dataType.typeName() != "string"]
    known = pair.agg(*[
        f(evaluate.HOLED + c).alias(f"{name}_{c}") for c in numbers
        for name, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]).first()
    cells = []
    for c in columns:
        truth, hole, fill = (F.col(tag + c) for tag in (evaluate.TRUTH, evaluate.HOLED, evaluate.FILLED))
        outside, gain = F.lit(False), F.lit(None).cast("double")
        if c in numbers:
            outside = (fill < known[f"low_{c}"]) | (fill > known[f"high_{c}"])
        if c in scored:
            gain = F.pow(truth - F.lit(known[f"mean_{c}"]), 2) - F.pow(truth - fill, 2)
        cells.append(F.struct(
            F.lit(c).alias("column_name"), hole.isNull().alias("hole"),
            (hole.isNotNull() & ~fill.eqNullSafe(hole)).alias("changed"),
            (hole.isNull() & fill.isNull()).alias("open"),
            (hole.isNull() & outside).alias("outside"), gain.alias("gain")))
    cell = pair.select(F.inline(F.array(*cells)))
    return cell.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("hole").alias("n_holes"),
        F.count_if("changed").alias("n_changed"), F.count_if("open").alias("n_unfilled"),
        F.count_if("outside").alias("n_outside"),
        (F.sum(F.when(F.col("hole"), F.col("gain"))) > 0).alias("beats_mean"))


def d3_mice_exact(spark, sf):
    """One predictor, so that SQL can run the evidence updates as well."""
    full = lines(spark, sf).select(*LINE_KEYS, "l_extendedprice", "l_charge")
    holed = inject.mcar(full, 0.1, LINE_KEYS, 42, ["l_charge"])
    return Mice(LINE_KEYS).fit_transform(holed)


def d3_mice_facts(spark, sf):
    columns = [*_NUMBERS, "l_returnflag"]
    return _facts(lines(spark, sf), LINE_KEYS, columns, Mice, columns,
                  ["l_charge", "l_extendedprice"]).drop("n_outside")


def d4_posterior_facts(spark, sf):
    def make(keys):
        return Mice(keys, sample_posterior=True, n_imputations=5)

    return _facts(lines(spark, sf), LINE_KEYS, ["l_charge"], make, [*_NUMBERS, "l_returnflag"],
                  ["l_charge"]).drop("n_outside")


def d4_posterior_spread(spark, sf):
    """Single draws scatter: one draw has about twice the squared error of the regression."""
    full = lines(spark, sf).select(*LINE_KEYS, "l_extendedprice", "l_charge")
    holed = inject.mcar(full, 0.1, LINE_KEYS, 42, ["l_charge"])
    plain = Mice(LINE_KEYS).fit_transform(holed).select(*LINE_KEYS, F.col("l_charge").alias("mean"))
    drawn = Mice(LINE_KEYS, sample_posterior=True).fit_transform(holed).select(
        *LINE_KEYS, F.col("l_charge").alias("draw"))
    pair = full.select(*LINE_KEYS, F.col("l_charge").alias("truth")).join(
        holed.where("l_charge is null").select(*LINE_KEYS), LINE_KEYS).join(plain, LINE_KEYS).join(drawn, LINE_KEYS)
    ratio = F.avg(F.pow(F.col("draw") - F.col("truth"), 2)) / F.avg(F.pow(F.col("mean") - F.col("truth"), 2))
    return pair.agg(F.count(F.lit(1)).alias("n_holes"), (F.abs(ratio - 2) < 0.2).alias("scatters"),
                    (F.countDistinct(F.round(F.col("draw") - F.col("mean"), 4)) > F.count(F.lit(1)) / 2)
                    .alias("own_numbers"))


def _order_sums(spark, sf):
    return lines(spark, sf).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").cast("double").alias("sum_quantity"),
        F.sum("l_extendedprice").alias("sum_price"), F.sum("l_charge").alias("sum_charge"))


def d5_forest_facts(spark, sf):
    """All 200 trees at full depth."""
    return _facts(_order_sums(spark, sf), _SUM_KEYS, ["sum_charge"], MissForest, _SUMS, ["sum_charge"])


def d7_denoising_facts(spark, sf):
    full = lines(spark, sf).drop("l_returnflag", "l_linestatus")
    return _facts(full, LINE_KEYS, _NUMBERS, DenoisingImputer, _NUMBERS,
                  ["l_charge", "l_extendedprice"]).drop("n_outside")


def d7_denoising_layers(spark, sf):
    """On a column that is no linear function of the others, bent layers have less error than one layer."""
    full = lines(spark, sf).select(*LINE_KEYS, "l_quantity", "l_extendedprice", F.pow(
        (F.col("l_quantity") - 25.5) / 10, 2).alias("l_bend"))
    scores = []
    staged = evaluate.with_truth(full, ["l_bend"])
    holed = store(evaluate.with_holes(inject.mcar(staged, 0.1, LINE_KEYS, 42, ["l_bend"]), ["l_bend"]), *LINE_KEYS)
    for layers in (1, 2, 3):
        imputer = DenoisingImputer([*LINE_KEYS, *evaluate.carried(["l_bend"])], layers=layers)
        pair = evaluate.as_filled(imputer.fit_transform(holed), ["l_bend"])
        scores.append(evaluate.evaluate_target(pair, "l_bend").select(
            F.lit(layers).alias("layers"), "n_masked_target", "n_unfilled", "mean_rmse"))
    one = scores[0].select(F.col("mean_rmse").alias("of_one"))
    found = reduce(DataFrame.unionByName, scores).join(F.broadcast(one))
    return found.select("layers", "n_masked_target", "n_unfilled", F.when(
        F.col("layers") > 1, F.col("mean_rmse") < 0.5 * F.col("of_one")).alias("halves_the_error"))


def d10_all_imputers_facts(spark, sf):
    """Every registry key with its own settings."""
    full = store(_order_sums(spark, sf), *_SUM_KEYS)
    parts = []
    for key in sorted(IMPUTERS):
        facts = _facts(full, _SUM_KEYS, ["sum_charge"], lambda keys, key=key: build_imputer(key, 42, keys),
                       ["sum_charge"], ["sum_charge"])
        parts.append(facts.select(
            F.lit(key).alias("method_key"), "n_rows", "n_holes", "n_unfilled",
            (F.col("beats_mean") | F.lit(key in ("meanmode", "medianmode"))).alias("good")))
    return reduce(DataFrame.unionByName, parts)


def g7_cross_validate_mean(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", "o_totalprice")
    answers, split = cross_validate(rows, "o_totalprice", ORDER_KEYS, "meanmode", 5)
    scores = evaluate.answer_metrics(answers, ["fold_id"])
    return scores.join(split, "fold_id").select(
        "fold_id", "n_valid", F.round("mean_rmse", 3).alias("mean_rmse"),
        F.round("mean_nrmse", 7).alias("mean_nrmse"), "fallback_rate", "cv_test_size", "cv_train_size")


def g7_cross_validate_facts(spark, sf):
    answers, split = cross_validate(_order_sums(spark, sf), "sum_charge", _SUM_KEYS, "mice", 3)
    scores = evaluate.answer_metrics(answers, ["fold_id"])
    return scores.join(split, "fold_id").agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_valid").alias("n_valid"),
        F.sum("cv_test_size").alias("n_tested"), F.max("fallback_rate").alias("fallback_rate"),
        (F.max("mean_nrmse") < 0.5).alias("good"),
        (F.max("cv_test_size") - F.min("cv_test_size") <= 10).alias("even"))


QUERIES = {f.__name__: f for f in (
    d3_mice_exact, d3_mice_facts, d4_posterior_facts, d4_posterior_spread, d5_forest_facts,
    d7_denoising_facts, d7_denoising_layers, d10_all_imputers_facts, g7_cross_validate_mean, g7_cross_validate_facts)}

_K = ", ".join(LINE_KEYS)
_MARKED = f"""{LINES}, marked AS (SELECT {_K}, l_extendedprice AS x, l_charge AS y,
  {sql_unit(42, LINE_KEYS, "l_charge")} < 0.1::DOUBLE AS hole FROM lines)"""
_SUM_HOLED = f"""{LINES}, sums AS (SELECT l_orderkey, sum(l_charge) AS sum_charge FROM lines GROUP BY 1),
  holed AS (SELECT l_orderkey, {sql_keep(42, _SUM_KEYS, "sum_charge", 0.1)} AS sum_charge FROM sums)"""


def _fact_rows(columns, holes, scored, source, outside=""):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows,
  {f"count(*) - count({c})" if c in holes else "0::BIGINT"} AS n_holes, 0::BIGINT AS n_changed,
  0::BIGINT AS n_unfilled{outside}, {"TRUE" if c in scored else "NULL::BOOLEAN"} AS beats_mean FROM {source}"""
        for c in columns)


_HOLED_NUMBERS = f"""{LINES}, holed AS (SELECT {", ".join(
    f"{sql_keep(42, LINE_KEYS, c, 0.1)} AS {c}" for c in [*_NUMBERS, "l_returnflag"])} FROM lines)"""
_HOLED_CHARGE = f"""{LINES}, holed AS (SELECT {sql_keep(42, LINE_KEYS, "l_charge", 0.1)} AS l_charge FROM lines)"""

SQL = {
    "d3_mice_exact": f"""WITH RECURSIVE {_MARKED},
  m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my FROM marked WHERE NOT hole),
  s AS (SELECT any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS xx,
    sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy FROM marked, m WHERE NOT hole),
  it AS (SELECT -1 AS step, 1.0::DOUBLE AS wp, 1.0::DOUBLE / (yy / n + 2.220446049250313e-16::DOUBLE) AS np,
      xy / (xx + 1.0::DOUBLE / (1.0::DOUBLE / (yy / n + 2.220446049250313e-16::DOUBLE))) AS w, FALSE AS stop FROM s
    UNION ALL
    SELECT step + 1, wp2, (n - eff + 2e-6::DOUBLE) / (err + 2e-6::DOUBLE), w2, step >= 0 AND abs(w2 - w) < 0.001::DOUBLE
    FROM (SELECT *, (eff + 2e-6::DOUBLE) / (w2 * w2 + 2e-6::DOUBLE) AS wp2 FROM (
      SELECT *, greatest(yy - 2 * w2 * xy + w2 * w2 * xx, 0) AS err, np * xx / (wp + np * xx) AS eff FROM (
        SELECT it.*, s.*, xy / (xx + wp / np) AS w2 FROM it, s WHERE NOT stop AND step < 299))))
  , last AS (SELECT xy / (xx + wp / np) AS w, mx, my FROM it, s ORDER BY step DESC LIMIT 1)
  SELECT {_K}, x AS l_extendedprice, CASE WHEN hole THEN my + w * (x - mx) ELSE y END AS l_charge
  FROM marked, last""",
    "d3_mice_facts": f"WITH {_HOLED_NUMBERS} " + _fact_rows(
        [*_NUMBERS, "l_returnflag"], [*_NUMBERS, "l_returnflag"], ["l_charge", "l_extendedprice"], "holed"),
    "d4_posterior_facts": f"WITH {_HOLED_CHARGE} " + _fact_rows(
        [*_NUMBERS, "l_returnflag"], ["l_charge"], ["l_charge"], "holed"),
    "d4_posterior_spread": f"""WITH {_HOLED_CHARGE} SELECT count(*) - count(l_charge) AS n_holes,
  TRUE AS scatters, TRUE AS own_numbers FROM holed""",
    "d5_forest_facts": f"WITH {_SUM_HOLED} " + _fact_rows(
        _SUMS, ["sum_charge"], ["sum_charge"], "holed", ", 0::BIGINT AS n_outside"),
    "d7_denoising_facts": f"WITH {_HOLED_NUMBERS} " + _fact_rows(
        _NUMBERS, _NUMBERS, ["l_charge", "l_extendedprice"], "holed"),
    "d7_denoising_layers": f"""WITH {LINES} SELECT k AS layers,
  count(*) FILTER ({sql_unit(42, LINE_KEYS, "l_bend")} < 0.1::DOUBLE) AS n_masked_target, 0::BIGINT AS n_unfilled,
  CASE WHEN k > 1 THEN TRUE END AS halves_the_error FROM lines, (VALUES (1), (2), (3)) v(k) GROUP BY k""",
    "d10_all_imputers_facts": f"""WITH {_SUM_HOLED} SELECT k AS method_key, count(*) AS n_rows,
  count(*) - count(sum_charge) AS n_holes, 0::BIGINT AS n_unfilled, TRUE AS good
  FROM holed, (VALUES ('dae'), ('meanmode'), ('medianmode'), ('mice'), ('missforest')) v(k) GROUP BY k""",
    "g7_cross_validate_mean": f"""WITH placed AS (SELECT o_orderkey, o_totalprice AS v, row_number() OVER
    (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
  binned AS (SELECT o_orderkey, v, n, greatest(0, (p * 10 + n - 2) // (n - 1) - 1)::INTEGER AS bin FROM placed),
  split AS (SELECT v, n, ((row_number() OVER (PARTITION BY bin ORDER BY
    {sql_unit(42, ORDER_KEYS, "fold")}) - 1) % 5 + 1)::INTEGER AS fold_id FROM binned),
  means AS (SELECT fold_id, count(*) AS c, (SELECT avg(v) FROM split t WHERE t.fold_id <> s.fold_id) AS m
    FROM split s GROUP BY fold_id)
  SELECT fold_id, count(*) AS n_valid, round(sqrt(avg((v - m) ** 2)), 3) AS mean_rmse,
    round(sqrt(avg((v - m) ** 2)) / (stddev_pop(v) + 1e-8::DOUBLE), 7) AS mean_nrmse, 0.0::DOUBLE AS fallback_rate,
    count(*) AS cv_test_size, any_value(n) - count(*) AS cv_train_size
  FROM split JOIN means USING (fold_id) GROUP BY fold_id""",
    "g7_cross_validate_facts": """SELECT 3::BIGINT AS n_folds, count(DISTINCT l_orderkey) AS n_valid,
  count(DISTINCT l_orderkey) AS n_tested, 0.0::DOUBLE AS fallback_rate, TRUE AS good, TRUE AS even FROM lineitem""",
}
