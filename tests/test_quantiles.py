import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import shared
from skylattice.operators.shared import exact_quantiles

SHARES = {"low": 0.0, "a": 0.05, "mid": 0.5, "b": 0.85, "top": 1.0}


def values(kind, n=3001):
    r = random.Random(len(kind))
    if kind == "plain":
        return [r.gauss(0, 1) for _ in range(n)] + [None, float("nan")]
    if kind == "heavy":
        return [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(n)]
    if kind == "ties":
        return [float(r.choice([0, 0, 0, 1, 2])) for _ in range(n)]
    if kind == "ends":
        return [-1.7e308, 1.7e308, math.inf, -math.inf, 0.0, -0.0] * 500
    return [1.0 + k * 2.0**-52 for k in range(n)]  # neighbours


@pytest.mark.parametrize("kind", ["plain", "heavy", "ties", "ends", "near"])
@pytest.mark.parametrize("few", [4096, 30])
def test_equal_to_spark_percentile(spark, monkeypatch, kind, few):
    monkeypatch.setattr(shared, "FEW", few)
    monkeypatch.setattr(shared, "CELLS", 64)
    df = spark.createDataFrame([(v,) for v in values(kind)], "v double").repartition(3)
    got = exact_quantiles(df, {n: (F.col("v"), s) for n, s in SHARES.items()})
    plain = df.where("v is not null and not isnan(v)")
    want = plain.agg(*[F.percentile("v", s).alias(n) for n, s in SHARES.items()]).first()
    for n in SHARES:
        assert repr(got[n] + 0.0) == repr(want[n] + 0.0)


def test_no_values_and_several_columns(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 10)
    df = spark.range(500).select(F.col("id").cast("double").alias("a"), (F.col("id") * -2).alias("b"), F.lit(None).cast("double").alias("c"))
    assert exact_quantiles(df, {"x": (F.col("a"), 0.5), "y": (F.col("b"), 0.25), "z": (F.col("c"), 0.5)}) == {"x": 249.5, "y": -748.5, "z": None}
    assert exact_quantiles(df.limit(0), {"x": (F.col("a"), 0.5)}) == {"x": None}
