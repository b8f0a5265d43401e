import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from placeforge.llm import mixing as M

from .helpers import documents, empty, hard, words


def test_poisson_inverts_the_distribution(spark):
    points = [(u, m) for m in (0.01, 0.7, 3.0, 60.0, 190.0) for u in (1e-9, 0.03, 0.5, 0.77, 0.999999)]
    rows = spark.createDataFrame(points, "u double, mean double").withColumn("law", M.distribution(F.col("mean"))).select("u", "mean", M.poisson(F.col("u"), F.col("law")).alias("k")).collect()
    for r in rows:
        cdf = lambda k, m=r.mean: sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k + 1))
        assert cdf(r.k) >= r.u - 1e-12 and (r.k == 0 or cdf(r.k - 1) < r.u + 1e-12)


def test_rates_and_large_means(spark):
    df = documents(spark, [words(k, 20) for k in range(600)], sources=["big"] * 599 + ["rare"])
    size = sum(len(words(k, 20)) for k in range(600))
    rates = {r.source: r.rate for r in M.rates(df, {"big": 1.0, "rare": 3.0}).collect()}
    assert abs(rates["rare"] * len(words(599, 20)) / size - 0.75) < 1e-9
    out = Counter(r.source for r in M.mix(df, {"big": 1.0, "rare": 3.0}).collect())
    assert abs(out["rare"] - rates["rare"]) < 6 * math.sqrt(rates["rare"])
    assert abs(out["big"] - 599 * rates["big"]) < 6 * math.sqrt(599 * rates["big"])


def test_same_result_however_it_is_dealt(spark):
    df = documents(spark, [words(k, 20) for k in range(100)], sources=[f"s{k % 3}" for k in range(100)])
    keys = lambda d: sorted((r.doc_id, r.mix_copy, r.mix_order) for r in M.mix(d).collect())
    assert keys(df) == keys(df.repartition(7))


def test_hard_rows(spark):
    df = hard(spark)
    out = M.mix(df, {"a": 1.0, None: 5.0, "c": 0.0}, budget=1e6)
    assert out.columns == [*df.drop("mix_rate", "mix_order").columns, "mix_rate", "mix_count", "mix_copy", "mix_order"]
    rows = out.collect()
    assert {r.source for r in rows} <= {"a", None} and all(1 <= r.mix_copy <= r.mix_count for r in rows)
    assert M.mix(empty(spark)).collect() == []


def test_against_sql(spark, tmp_path):
    documents(spark, [words(k, 5 + k % 40) for k in range(200)], sources=[f"s{k % 5 * (k % 2)}" for k in range(200)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in M.query(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(M.SQL).fetchall())


def test_rows_without_an_id_are_independent(spark):
    df = spark.createDataFrame([(None, "same text", "a")] * 400 + [(None, words(k, 9), "a") for k in range(200)], "doc_id long, text string, source string")
    rows = M.mix(df, budget=float(20 * sum(len(t) for t in ["same text"] * 400 + [words(k, 9) for k in range(200)]))).collect()
    assert len({r.mix_order for r in rows}) == len(rows)
    for own in ([r for r in rows if r.text == "same text"], [r for r in rows if r.text != "same text"]):
        counts = Counter(r.mix_count for r in own if r.mix_copy == 1)
        assert len(counts) > 8 and abs(len(own) / sum(counts.values()) - 20) < 3


def test_clashing_columns_come_back_as_they_were(spark):
    df = hard(spark).withColumns({c: F.lit(f"own {c}") for c in ("mix_source", "mix_rate", "mix_count", "mix_copy", "mix_order", "row", "of", "rate", "chunks", "law", "name", "count", "copy", "order")})
    out = M.remix(df, budget=1e6)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r.mix_source == "own mix_source" and r.mix_order == "own mix_order" and r.law == "own law" for r in rows)
