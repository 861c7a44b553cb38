import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lacunae.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def numbers(spark):
    """2000 keyed rows: a uniform value, a value with one hot key, a linear target, a label."""
    from pyspark.sql import functions as F

    from lacunae.functions.hashing import row_normal, row_unit

    df = spark.range(2000).withColumnRenamed("id", "k")
    df = df.select(
        "k", (row_unit(1, ["k"], "x") * 100).alias("x"),
        F.when(row_unit(1, ["k"], "h") < 0.4, 7.0).otherwise(
            F.floor(row_unit(1, ["k"], "v") * 300).cast("double")).alias("hot"),
        row_normal(1, ["k"], "e").alias("e"),
        F.element_at(F.array(*[F.lit(c) for c in "abc"]),
                     (F.col("k") % 3 + 1).cast("int")).alias("label"))
    df = df.withColumn("y", F.col("x") * 2 + F.col("hot") * 0.1 + F.col("e")).drop("e")
    return df
