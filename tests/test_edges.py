"""Inputs at the edges: decimals, nulls, text keys, one class, huge counts, constant columns, files."""

import math

import pytest
from pyspark.sql import functions as F

from churnlens import session
from churnlens.operators import bins as B
from churnlens.operators import clean as C
from churnlens.operators import metrics as M
from churnlens.operators import prepare as X
from churnlens.operators import profile as P
from churnlens.operators.rank import global_cumsum, global_rank
from churnlens.operators.smote import oversample, smote
from churnlens.sources import io


def test_mean_keeps_decimals_and_large_values(spark):
    df = spark.createDataFrame([(0.9, 1e21, 7), (0.95, 12.34, None), (None, 0.66, 8)], "a double, b double, c int")
    s = {r.variable: r for r in P.summary6(df, ["a", "b", "c"], {"b": 2}).collect()}
    assert s["a"].mean == 0.925 and s["c"].mean == 7.5
    assert math.isclose(s["b"].mean, (1e21 + 13) / 3, rel_tol=1e-15)
    d = {r.variable: r.mean for r in P.describe_numeric(df, ["a", "c"]).collect()}
    assert d == {"a": 0.925, "c": 7.5}
    assert X.fit_scaler(df, ["a"]).stats["a"][0] == 0.925


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "text"])
def test_rank_keeps_nulls_nan_and_text(spark, descending, kind):
    if kind == "double":
        rows = [(float(i % 17), i) for i in range(60)] + [(None, i) for i in range(60, 66)] + [(float("nan"), i) for i in range(66, 70)] + [(float("inf"), 70), (float("-inf"), 71)]
    else:
        rows = [(f"CUST-{i * 7919 % 101:03d}é" if i % 3 else f"CUST-{i}", i) for i in range(60)] + [(None, 60), (None, 61), ("", 62)]
    df = spark.createDataFrame(rows, f"x {'double' if kind == 'double' else 'string'}, i int")
    order = [F.col("x").desc() if descending else F.col("x").asc(), F.col("i").desc() if descending else F.col("i").asc()]
    want = [r.i for r in df.coalesce(1).orderBy(*order).collect()]
    got = global_rank(df, ["x", "i"], descending=descending, n_buckets=8).orderBy("rank").collect()
    assert [r.i for r in got] == want and [r["rank"] for r in got] == list(range(1, len(rows) + 1))


def test_cumsum_with_default_buckets(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).cast("double").alias("x"), F.lit(1).alias("w"))
    assert all(r.cum_w == r.x + 1 for r in global_cumsum(df, ["x"], ["w"]).collect())
    assert global_rank(df.where("false"), ["x"]).count() == 0


def test_rows_without_label_stay_in_the_split(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("y"))
    s = X.stratified_split(df, "id", "y").toPandas()
    assert s["is_test"].isin([0, 1]).all() and s["is_test"].sum() == 20 and len(s) == 100


def test_smote_edges(spark):
    rows = [(i, float(i), 1) for i in range(6)] + [(6, 6.0, 0), (7, 8.0, 0)]
    df = spark.createDataFrame(rows, "k long, x double, y int")
    assert smote(df, ["x"], "y", "k", k=1).count() == 4     # class 0 is the smaller one
    assert oversample(df, ["x"], "y", "k", k=1).groupBy("y").count().select("count").distinct().collect()[0][0] == 6
    assert smote(df, ["x"], "y", "k", k=1, minority=1).count() == 0
    with pytest.raises(ValueError):
        smote(df.where("k <> 7"), ["x"], "y", "k")


def test_huge_counts_do_not_overflow(spark, monkeypatch):
    counts = spark.createDataFrame([(0.9, 5_000_000_000, 1_000_000_000), (0.1, 3_000_000_000, 6_000_000_000)], "threshold double, pos long, neg long")
    monkeypatch.setattr(M, "_score_counts", lambda *a: counts)
    p, n = 8e9, 7e9
    assert math.isclose(M.auc(None).first()["auc"], (5e9 * (6e9 + 5e8) + 3e9 * 3e9) / (p * n), rel_tol=1e-12)
    y = M.youden(None).first()
    assert y.threshold == 0.9 and math.isclose(y.j, 5 / 8 - 1 / 7, rel_tol=1e-12)


def test_one_class(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(0.2, label), (0.7, label), (0.7, label)], "score double, label int")
        assert M.auc(df).first()["auc"] is None
        assert M.youden(df).first()["threshold"] == float("inf")
        assert M.roc_curve(df).count() == 3 and M.pr_curve(df).count() == 3 - (label == 0) * 0
        assert M.threshold_metrics(df).count() == 2
    assert P.pos_weight(df.where("label = 0"), "label").first()["pos_weight"] is None
    assert P.balanced_weights(df, "label", "score").where("weight is null").count() == 0


def test_expand_counts_below_first(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0)], "k string, n long")
    assert sorted((r.k, r._i) for r in C.expand_counts(df, "n", first=2).collect()) == [("b", 2), ("b", 3)]


@pytest.mark.parametrize("value", [7.0, 0.0, -3.0, 1e6])
def test_constant_column(spark, value):
    df = spark.createDataFrame([(value,)] * 5, "x double")
    bins = B.cut_n(df, "x", 20).distinct().collect()
    assert len(bins) == 1
    assert (bins[0].x_idx if "x_idx" in bins[0].asDict() else bins[0].bin_idx) == (None if value == 0 else 9)
    h = B.hist_bins(df, "x").collect()
    assert [(r.k, r.center, r.n) for r in h] == [(0, value, 5)]
    s = B.hist_sturges(df, "x").collect()
    assert len(s) == 1 and s[0].lo <= value <= s[0].hi and s[0].n == 5 and s[0].density > 0


def test_csv_as_r_writes_it(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b", 30.5, 1), (2, None, None, 2)], "Customer_ID long, Gender string, Age double, Left int")
    path = io.write_csv(df.coalesce(1), f"file://{tmp_path}/out", versioned=True)
    assert path.endswith("out_1") and io.write_csv(df, f"file://{tmp_path}/out", versioned=True).endswith("out_2")
    text = "".join(p.read_text() for p in (tmp_path / "out_1").glob("part-*"))
    assert text.splitlines() == ["Customer_ID,Gender,Age,Left", "1,a, b,30.5,1", "2,NA,NA,2"]
    back = df.where("Customer_ID = 2")
    again = io.scan_csv(spark, io.write_csv(back, f"file://{tmp_path}/two"), schema=back.schema).first()
    assert (again.Customer_ID, again.Gender, again.Age) == (2, None, None)


def test_resolve_target(spark):
    df = spark.createDataFrame([(1, 0)], "id int, Exited int")
    assert C.resolve_target(df) == "Exited"
    with pytest.raises(ValueError):
        C.resolve_target(df.select("id"))


def test_density_of_a_null_group(spark):
    from churnlens.operators.density import kde
    rows = [(g, float(v)) for g in ("a", None) for v in range(20)] + [("b", None)]
    out = kde(spark.createDataFrame(rows, "g string, x double"), "x", "g").toPandas()
    a, n = (out[m].sort_values("i")["density"].to_numpy() for m in (out["g"] == "a", out["g"].isna()))
    assert len(out) == 2 * 512 and (a == n).all()


def test_below(spark):
    df = spark.createDataFrame([(499.0,), (500.0,), (None,), (float("nan"),)], "s double")
    assert [r.s for r in C.below(df, "s", 500).collect()] == [499.0]


def test_package_is_shipped_whatever_the_store(spark, monkeypatch):
    added = []
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, p: added.append(p))
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: "hdfs://store/shared")
    session.ship_package(spark)
    session.ship_package(spark)
    import zipfile
    assert len(added) == 1 and "churnlens/operators/rank.py" in zipfile.ZipFile(added[0]).namelist()


def test_cluster_must_name_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            @staticmethod
            def get(k, d=None):
                return d

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake)
