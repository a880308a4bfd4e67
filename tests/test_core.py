"""Layer 2: independent NumPy / pandas checks of the custom operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL


@pytest.mark.parametrize("groups", [[], ["l_returnflag"]])
def test_global_rank_is_sorted_permutation(spark, groups):
    from churnlens.operators.rank import global_rank
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                                  "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    pdf = global_rank(li, order, group_cols=groups, out="r").toPandas()
    parts = pdf.groupby(groups) if groups else [((), pdf)]
    for _, g in parts:
        g = g.sort_values("r")
        assert (g["r"].to_numpy() == np.arange(1, len(g) + 1)).all()
        keys = list(g[order].itertuples(index=False, name=None))
        assert keys == sorted(keys)
    assert len(pdf) == li.count()


def test_global_cumsum_descending(spark):
    from churnlens.operators.rank import global_cumsum
    pdf = pd.DataFrame({"x": np.arange(500, dtype=float), "w": np.arange(500) % 7})
    df = spark.createDataFrame(pdf).repartition(5)
    out = global_cumsum(df, ["x"], ["w"], descending=True, n_buckets=16).toPandas().sort_values("x", ascending=False)
    assert (out["cum_w"].to_numpy() == np.cumsum(out["w"].to_numpy())).all()


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_quantiles_match_numpy_and_partitioning(spark, parts):
    from churnlens.operators.quantile import quantiles
    rng = np.random.RandomState(3)
    x = np.round(rng.lognormal(10, 1, 2001), 2)
    x[:700] = 5000.0                                  # a hot value: a third of the rows
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(parts)
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    got = {r["p"]: r["value"] for r in quantiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(x, p * 100), abs=1e-6)


def test_bins_edges(spark):
    from churnlens.operators import bins as B
    pdf = pd.DataFrame({"id": range(6), "x": [0.0, 5.0, 10.0, 14.999, 15.0, 20.0]})
    df = spark.createDataFrame(pdf)
    c = {r["id"]: (r["bin_lo"], r["bin_hi"]) for r in B.cut_width(df, "x", 0, 5).collect()}
    assert c[0] == (0.0, 5.0) and c[1] == (5.0, 10.0) and c[3] == (10.0, 15.0)
    assert c[5] == (None, None)                       # at the last break -> NA, as R's cut
    h = {r["center"]: r["n"] for r in B.hist_width(df, "x", 5).collect()}
    assert h[0.0] == 1 and h[5.0] == 1 and h[10.0] == 1 and h[15.0] == 2 and h[20.0] == 1   # right-closed
    n = B.cut_n(df, "x", 4).select("id", "bin_idx").toPandas().set_index("id")["bin_idx"].to_dict()
    assert n[0] == 0 and n[1] == 0 and n[2] == 1 and n[4] == 2 and n[5] == 3


def test_pretty_breaks(spark):
    from churnlens.operators import bins as B
    # R: pretty(c(350, 854), 11) -> 350, 400, ..., 900 ; pretty(c(0, 1), 5) -> 0, 0.2, ...
    for lo, hi, nd, start, unit in [(350.0, 854.0, 11, 350.0, 50.0), (0.0, 1.0, 5, 0.0, 0.2),
                                    (1.0, 1003.0, 12, 0.0, 100.0)]:
        st = spark.createDataFrame([(lo, hi, nd)], "mn double, mx double, nd int")
        r = B.pretty_breaks(st, "mn", "mx", "nd").first()
        assert r["_start"] == pytest.approx(start) and r["_unit"] == pytest.approx(unit)


def _pair_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_auc_roc_with_ties(spark):
    from churnlens.operators import metrics as M
    rng = np.random.RandomState(0)
    s = rng.randint(0, 20, 400) / 10.0
    y = (rng.rand(400) < 0.3 + 0.02 * s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))
    assert M.auc(df).first()["auc"] == pytest.approx(_pair_auc(s, y), abs=1e-12)
    roc = M.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert roc["threshold"].iloc[0] == math.inf and roc["tpr"].iloc[-1] == 1 and roc["fpr"].iloc[-1] == 1
    yd = M.youden(df).first()
    j = (roc["tpr"] - roc["fpr"]).max()
    assert yd["j"] == pytest.approx(j)
    # monotone transform leaves AUC unchanged
    df2 = df.withColumn("score", F.exp(F.col("score") * 3))
    assert M.auc(df2).first()["auc"] == pytest.approx(_pair_auc(s, y), abs=1e-12)


def test_one_class_and_constant_scores(spark):
    from churnlens.operators import metrics as M
    df = spark.createDataFrame(pd.DataFrame({"score": [0.5] * 10, "label": [0, 1] * 5}))
    assert M.auc(df).first()["auc"] == pytest.approx(0.5)
    yd = M.youden(df).first()
    assert yd["threshold"] == math.inf                 # J never beats 0


def test_knn_topk_bruteforce(spark):
    from churnlens.operators.neighbors import knn_topk
    rng = np.random.RandomState(1)
    b = pd.DataFrame(np.round(rng.randn(300, 3), 2), columns=["a", "b", "c"]).assign(Customer_ID=np.arange(300))
    q = pd.DataFrame(np.round(rng.randn(40, 3), 2), columns=["a", "b", "c"]).assign(Customer_ID=np.arange(1000, 1040))
    for metric in ("euclidean", "manhattan"):
        got = knn_topk(spark.createDataFrame(q), spark.createDataFrame(b), ["a", "b", "c"], k=7, metric=metric,
                       block=64).toPandas()
        for qi, row in q.iterrows():
            diff = b[["a", "b", "c"]].to_numpy() - row[["a", "b", "c"]].to_numpy(dtype=float)
            d = np.sqrt((diff ** 2).sum(1)) if metric == "euclidean" else np.abs(diff).sum(1)
            order = sorted(range(300), key=lambda i: (round(d[i], 9), i))[:7]
            mine = got[got.qid == row.Customer_ID].sort_values("rank")["nid"].tolist()
            assert mine == order


def test_smote_rows_on_segments(spark):
    from churnlens.operators.smote import smote
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame({"Customer_ID": np.arange(200), "x": rng.randn(200), "y": rng.randn(200),
                        "Left": (np.arange(200) < 30).astype(int)})
    df = spark.createDataFrame(pdf)
    syn = smote(df, ["x", "y"], "Left", "Customer_ID", k=5, seed=42).toPandas()
    assert len(syn) == 170 - 30
    src = pdf.set_index("Customer_ID")
    for _, r in syn.iterrows():
        a, b = src.loc[r.src, ["x", "y"]].to_numpy(float), src.loc[r.nbr, ["x", "y"]].to_numpy(float)
        assert src.loc[r.src, "Left"] == 1 and src.loc[r.nbr, "Left"] == 1 and r.src != r.nbr
        assert np.allclose(a + r.gap * (b - a), [r.x, r.y], atol=1e-8)


def test_logit_matches_newton(spark):
    from churnlens.operators.logit import logit_inference
    rng = np.random.RandomState(4)
    X = rng.randn(800, 2)
    y = (rng.rand(800) < 1 / (1 + np.exp(-(0.3 + X @ [1.0, -0.5])))).astype(int)
    pdf = pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "Left": y})
    t = logit_inference(spark.createDataFrame(pdf), ["a", "b"], "Left", scale=False).toPandas().set_index("feature")
    A = np.column_stack([X, np.ones(800)])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ beta))
        H = A.T @ (A * (p * (1 - p))[:, None])
        beta += np.linalg.solve(H, A.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(H)))
    assert t.loc["a", "coefficient"] == pytest.approx(beta[0], abs=1e-6)
    assert t.loc["const", "coefficient"] == pytest.approx(beta[2], abs=1e-6)
    assert t.loc["b", "std_error"] == pytest.approx(se[1], abs=1e-6)


def test_shapley_efficiency(spark):
    from churnlens.operators.explain import shapley
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"Customer_ID": np.arange(20), "a": rng.randn(20), "b": rng.randn(20), "c": rng.randn(20)})
    df = spark.createDataFrame(pdf)

    def score(d):   # a model with an interaction term
        return d.withColumn("margin", 2 * F.col("a") - F.col("b") + F.col("a") * F.col("c"))
    phi = shapley(score, df, df.limit(5), ["a", "b", "c"]).toPandas()
    g = phi.groupby("Customer_ID").agg(s=("phi", "sum"), base=("base_value", "first"), m=("margin", "first"))
    assert np.allclose(g.s + g.base, g.m, atol=1e-9)


def test_kde_integrates_to_one(spark):
    from churnlens.operators.density import kde
    rng = np.random.RandomState(6)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.randn(3000)}))
    d = kde(df, "x").toPandas().sort_values("i")
    assert np.trapezoid(d.density, d.x) == pytest.approx(1.0, abs=2e-3)


def test_split_quotas_and_folds(spark):
    from churnlens.operators.prepare import split_quotas, stratified_folds, stratified_split
    from churnlens.plans.clean_queries import clean
    assert split_quotas({0: 1178, 1: 322}, 0.2) == {0: 236, 1: 64}
    c = clean(spark, SF_SMALL)
    s = stratified_split(c)
    n = c.count()
    assert s.where("is_test = 1").count() == math.ceil(0.2 * n)
    f = stratified_folds(s.where("is_test = 0"), k=5).toPandas()
    assert sorted(f.fold.unique()) == [0, 1, 2, 3, 4]
    sizes = f.groupby(["Left", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_clean_invariants(spark):
    from churnlens.operators import clean as C
    from churnlens.sources.fixtures import churn_raw
    raw = churn_raw(spark, SF_SMALL)
    d = C.dedup(C.drop_missing(C.encode_gender(raw)))
    assert C.missing_report(d).first()["missing_rows"] == 0
    assert C.dup_count(d).first()["n_duplicates"] == 0
    assert C.out_of_range_count(C.keep_range(d, "Score"), "Score").first()["n_out_of_range"] == 0
    g = {r[0] for r in C.encode_gender(raw).select("Gender").distinct().collect()}
    assert g <= {0, 1, None}


def test_expand_counts_hot_group(spark):
    from churnlens.operators.clean import expand_counts
    df = spark.createDataFrame([("hot", 25), ("cold", 3)], "k string, c long")
    out = expand_counts(df, "c", first=2, chunk=4).groupBy("k").count().toPandas().set_index("k")["count"]
    assert out["hot"] == 24 and out["cold"] == 2


def test_csv_reader_null_rules(spark, tmp_path):
    from churnlens.sources.io import RAW_SCHEMA, scan_csv, write_csv
    p = tmp_path / "b.csv"
    p.write_text("Customer_ID,Gender,Age,Tenure,Score,Salary,Balance,Products_in_Use,Left\n"
                 "1,Male,NA,2,600,100.5,0,1,0\n2,,30,,700,NA,10,2,1\n3,Female,40,1,900,5,1,1,0\n")
    df = scan_csv(spark, str(p), RAW_SCHEMA).orderBy("Customer_ID").collect()
    assert df[0]["Age"] is None and df[1]["Gender"] is None and df[1]["Tenure"] is None
    loose = scan_csv(spark, str(p), RAW_SCHEMA, blank_is_missing=False).orderBy("Customer_ID").collect()
    assert loose[1]["Gender"] == "" and loose[0]["Age"] is None
    out = write_csv(spark.read.csv(str(p), header=True), str(tmp_path / "output"), versioned=True)
    assert out.endswith("output_1")


def test_mlp_learns_planted_signal(spark):
    from churnlens.operators import metrics as M
    from churnlens.operators.mlp import mlp_fit
    rng = np.random.RandomState(7)
    X = rng.randn(2000, 3)
    y = ((X[:, 0] - X[:, 1] ** 2 + 0.3 * rng.randn(2000)) > -0.5).astype(int)
    pdf = pd.DataFrame({"Customer_ID": np.arange(2000), "a": X[:, 0], "b": X[:, 1], "c": X[:, 2], "Left": y})
    df = spark.createDataFrame(pdf)
    m = mlp_fit(df, ["a", "b", "c"], "Left", hidden=(16,), activation="tanh", learning_rate=0.01, max_iter=15,
                shards=2)
    assert M.auc(m.transform(df), "prob", "Left").first()["auc"] > 0.85


def test_gbt_beats_constant(spark):
    from churnlens.operators import metrics as M
    from churnlens.operators.trees import gbt_fit, gbt_score, tree_importance
    from churnlens.sources.fixtures import churn_base
    b = churn_base(spark, SF_MID)
    feats = ["Age", "Products_in_Use", "Tenure", "Score"]
    g = b.withColumn("Gender", (F.col("Gender") == "Male").cast("int"))
    m = gbt_fit(g, feats + ["Gender"], "Left_planted", n_estimators=10, seed=17)
    a = M.auc(gbt_score(m, g, feats + ["Gender"]), "prob", "Left_planted").first()["auc"]
    assert a > 0.8
    imp = tree_importance(m, feats + ["Gender"], spark).toPandas()
    assert imp.importance.sum() == pytest.approx(1.0)


def test_branch_stream_matches_batch(spark, tmp_path):
    from churnlens.operators import clean as C
    from churnlens.sources.fixtures import branches
    from churnlens.streaming import clean_stream, write_stream
    b1 = branches(spark, SF_SMALL)[0]
    src = str(tmp_path / "in")
    b1.write.option("header", True).option("nullValue", "NA").csv(src)
    out = str(tmp_path / "out")
    q = write_stream(clean_stream(spark, src, 1), out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = C.keep_range(C.drop_missing(C.encode_gender(b1.withColumn("Source", F.lit(1)))), "Score")
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


@pytest.mark.parametrize("parts", ["1", "200"])
def test_results_independent_of_shuffle_partitions(spark, parts):
    import __spark_entry__ as E
    from tools.check_oracle import digest
    names = ["churn_rate_by_source", "quantiles", "roc_curve", "split_rows", "box_facets"]
    base = {n: digest(*(lambda d: (d.columns, [tuple(r) for r in d.collect()]))(E.queries()[n](spark, SF_SMALL)))[0]
            for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for n in names:
            d = E.queries()[n](spark, SF_SMALL)
            assert digest(d.columns, [tuple(r) for r in d.collect()])[0] == base[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
