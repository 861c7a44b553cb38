from pyspark.sql import functions as F

from lacunae.operators.order import salted_join


def test_salted_join_is_a_plain_join(numbers):
    rows = numbers.select("k", F.when(F.col("k") % 3 > 0, F.lit("hot")).otherwise(
        F.concat(F.lit("c"), (F.col("k") % 7).cast("string"))).alias("c"))
    table = rows.select("c").distinct().where("c != 'c1'").withColumn("n", F.length("c"))
    for how in ("inner", "left"):
        got = salted_join(rows, table, ["c"], how).select("k", "c", "n").collect()
        assert sorted(got) == sorted(rows.join(table, "c", how).select("k", "c", "n").collect())
