"""Queries over the test tables, one or more per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.booster import BoostedClassifier, BoostedRegressor
from sylvan.functions import losses, metrics
from sylvan.operators import binning, bundling, sampling, split
from sylvan.plans.tree import grow

FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: Digits to which results are rounded before they are compared; sums depend on the order of rows in the last ones.
DIGITS = 5
KEY = ("l_orderkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = DIGITS):
    return F.round(c, digits) + F.lit(0.0)


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with y (thousands of price), f (a fixed guess of it), b (returned or not) and features x; y - g, h as for MSE."""
    d = table(spark, sf_dir)
    y, f = F.col("l_extendedprice") / 1000, F.col("l_quantity") * 1.4 + F.col("l_tax")
    d = d.withColumns({"y": y, "f": f, "b": (F.col("l_returnflag") == "R").cast("double"), "s": F.col("l_discount") * 20 - 1, "x": F.array(*(F.col(c) for c in FEATURES))})
    return d.withColumns({"row_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "g": F.col("f") - F.col("y"), "h": F.lit(1.0)})


BASE = """WITH d AS (SELECT *, l_extendedprice / 1000 AS y, l_quantity * 1.4 + l_tax AS f, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b,
    l_discount * 20 - 1 AS s, (l_quantity * 1.4 + l_tax) - l_extendedprice / 1000 AS g, 1.0::DOUBLE AS h FROM lineitem)"""
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (BASE if base else "") + sql
        return f

    return add


def R(sql: str, digits: int = DIGITS) -> str:
    return f"round(({sql})::DOUBLE, {digits}) + 0.0"


SIGMOID = "(1 / (1 + exp(-s)))"
LOSSES = {
    "mse": (losses.MSELoss(), "y", "f", "f - y", "1.0::DOUBLE", "0.5 * (y - f) * (y - f)"),
    "mae": (losses.MAELoss(), "y", "f", "sign(f - y)::DOUBLE", "1.0::DOUBLE", "abs(y - f)"),
    "huber": (losses.HuberLoss(5.0), "y", "f", "CASE WHEN abs(f - y) <= 5 THEN f - y ELSE 5 * sign(f - y) END", "greatest(CASE WHEN abs(f - y) <= 5 THEN 1.0 ELSE 5 / abs(f - y) END, 0.001)", "CASE WHEN abs(y - f) <= 5 THEN 0.5 * (y - f) * (y - f) ELSE 5 * (abs(y - f) - 2.5) END"),
    "quantile": (losses.QuantileLoss(0.8), "y", "f", "CASE WHEN y - f >= 0 THEN -0.8 ELSE 0.2 END", "1.0::DOUBLE", "CASE WHEN y - f >= 0 THEN 0.8 * (y - f) ELSE -0.2 * (y - f) END"),
    "binary": (losses.BinaryCrossEntropyLoss(), "b", "s", f"{SIGMOID} - b", f"{SIGMOID} * (1 - {SIGMOID})", f"-(b * ln({SIGMOID}) + (1 - b) * ln(1 - {SIGMOID}))"),
}


def _loss(name, loss, y, f, g, h, v):
    def gradients(spark, sf_dir):
        a, b = loss.gradient_hessian(F.col(y), F.col(f))
        return sample(spark, sf_dir).select(*KEY, rounded(a).alias("g"), rounded(b).alias("h"), rounded(loss.value(F.col(y), F.col(f))).alias("v"))

    def mean(spark, sf_dir):
        return sample(spark, sf_dir).agg(rounded(F.avg(loss.value(F.col(y), F.col(f)))).alias("loss"))

    gradients.__name__, mean.__name__ = f"loss_{name}_gradients", f"loss_{name}_mean"
    query(f" SELECT l_orderkey, l_linenumber, {R(g)} AS g, {R(h)} AS h, {R(v)} AS v FROM d")(gradients)
    query(f" SELECT {R(f'avg({v})')} AS loss FROM d")(mean)


for _name, _spec in LOSSES.items():
    _loss(_name, *_spec)

RAW = "[l_discount * 10, l_tax * 10, 0.5]"
EXPS = "[exp(l_discount * 10), exp(l_tax * 10), exp(0.5)]"


@query(f""", e AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, {EXPS} AS e FROM d), p AS (SELECT *, e[1] / list_sum(e) AS p0, e[2] / list_sum(e) AS p1, e[3] / list_sum(e) AS p2 FROM e)
    SELECT l_orderkey, l_linenumber, {R('p0 - (c = 0)::INT')} AS g0, {R('p1 - (c = 1)::INT')} AS g1, {R('p2 - (c = 2)::INT')} AS g2, {R('p0 * (1 - p0)')} AS h0,
    {R('-ln(CASE c WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)')} AS v, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS best FROM p""")
def loss_softmax_gradients(spark, sf_dir):
    loss = losses.MultiClassCrossEntropyLoss(3)
    d = sample(spark, sf_dir).withColumn("c", F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")).cast("int") - 1)
    d = d.withColumn("r", F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5)))
    c, r = F.col("c"), F.col("r")
    g, h, p = loss.gradient(c, r), loss.hessian(c, r), losses.softmax(r)
    return d.select(*KEY, *(rounded(F.get(g, F.lit(k))).alias(f"g{k}") for k in range(3)), rounded(F.get(h, F.lit(0))).alias("h0"), rounded(loss.value(c, r)).alias("v"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("best"))


@query(f""" SELECT {R("avg((b = (s > 0)::INT)::INT)")} AS accuracy, {R('avg((y - f) * (y - f))')} AS mse, {R('avg(abs(y - f))')} AS mae, {R('1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*))')} AS r2,
    {R(f"avg(-(b * ln({SIGMOID}) + (1 - b) * ln(1 - {SIGMOID})))")} AS log_loss FROM d""")
def metrics_all(spark, sf_dir):
    y, f, b, s = map(F.col, ("y", "f", "b", "s"))
    return sample(spark, sf_dir).agg(rounded(metrics.accuracy(b, (s > 0).cast("double"))).alias("accuracy"), rounded(metrics.mse(y, f)).alias("mse"), rounded(metrics.mae(y, f)).alias("mae"), rounded(metrics.r2(y, f)).alias("r2"), rounded(metrics.binary_log_loss(b, losses.sigmoid(s))).alias("log_loss"))


@query(" SELECT c, count(*) AS n FROM (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS c FROM d) GROUP BY c")
def label_encoding(spark, sf_dir):
    """The classifier's own encoding of the labels it finds."""
    m = BoostedClassifier()
    d = m._prepare(sample(spark, sf_dir).select((F.ascii("l_returnflag") * 2).cast("double").alias("label")))
    return d.groupBy(F.col("label").cast("long").alias("c")).agg(F.count("*").alias("n"))


EDGES = [[10.5, 20.5, 30.5, 40.5], [0.025, 0.055], [0.015, 0.045, 0.065]]
CODES = [" + ".join(f"(l_{c} > {e})::INT" for e in es) for c, es in zip(("quantity", "discount", "tax"), EDGES, strict=True)]


@query(f", q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM d) SELECT i, {R('q[i + 1]')} AS edge FROM q, (SELECT unnest([0, 1, 2]) AS i)")
def bin_edges_price(spark, sf_dir):
    edges = binning.bin_edges(table(spark, sf_dir).select(F.array("l_extendedprice").alias("x")), 1, 4)[0]
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "i int, edge double").select("i", rounded(F.col("edge")).alias("edge"))


@query(f" SELECT l_orderkey, l_linenumber, {CODES[0]} AS c0, {CODES[1]} AS c1, {CODES[2]} AS c2 FROM d")
def bin_codes(spark, sf_dir):
    d = binning.coded(sample(spark, sf_dir).select(*KEY, "x"), EDGES)
    return d.select(*KEY, *(F.col("codes")[k].cast("int").alias(f"c{k}") for k in range(3)))


LONG = "SELECT 0 AS feature, " + CODES[0] + " AS code, g, h FROM d UNION ALL SELECT 1, " + CODES[1] + ", g, h FROM d UNION ALL SELECT 2, " + CODES[2] + ", g, h FROM d"
HIST = f", l AS ({LONG}), hist AS (SELECT feature, code, sum(g) AS G, sum(h) AS H, count(*) AS n FROM l GROUP BY feature, code)"


def _histogram(spark, sf_dir):
    d = binning.coded(sample(spark, sf_dir).select("x", "g", "h"), EDGES)
    return split.histogram(d.withColumn("node", F.lit(0)), ["node"])


@query(HIST + f" SELECT feature, code, {R('G', 3)} AS sum_g, {R('H', 3)} AS sum_h, n FROM hist")
def gradient_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir).select("feature", F.col("code").cast("int").alias("code"), rounded(F.col("G"), 3).alias("sum_g"), rounded(F.col("H"), 3).alias("sum_h"), "n")


GAIN = "GL * GL / (HL + 1) + (G - GL) * (G - GL) / (H - HL + 1) - G * G / (H + 1 + 1e-10)"


@query(f""", l AS ({LONG}), v AS (SELECT feature, code, sum(g) AS g, sum(h) + 1e-6 AS h, count(*) AS c FROM l GROUP BY feature, code),
    w AS (SELECT feature, code, sum(g) OVER u AS GL, sum(h) OVER u AS HL, sum(c) OVER u AS nl, sum(g) OVER a AS G, sum(h) OVER a AS H, lead(code) OVER (PARTITION BY feature ORDER BY code) AS nx FROM v
      WINDOW u AS (PARTITION BY feature ORDER BY code ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature))
    SELECT feature, code, nl::BIGINT AS n_left, {R(GAIN, 2)} AS gain FROM w WHERE nx IS NOT NULL""")
def gain_table(spark, sf_dir):
    from pyspark.sql import Window as W

    h = _histogram(spark, sf_dir).withColumn("H", F.col("H") + split.BIN_EPS)
    up, whole = W.partitionBy("feature").orderBy("code").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("feature")
    w = h.select("feature", F.col("code").cast("int").alias("code"), F.sum("G").over(up).alias("GL"), F.sum("H").over(up).alias("HL"), F.sum("n").over(up).alias("n_left"), F.sum("G").over(whole).alias("GT"), F.sum("H").over(whole).alias("HT"), F.lead("code").over(W.partitionBy("feature").orderBy("code")).alias("nx"))
    return w.where("nx IS NOT NULL").select("feature", "code", "n_left", rounded(split.gain_column(F.col("GL"), F.col("HL"), F.col("GT"), F.col("HT"), split.Rules(lambda_l2=1.0)), 2).alias("gain"))


@query(f""", l AS (SELECT 0 AS feature, l_quantity AS v, g, h FROM d UNION ALL SELECT 1, l_discount, g, h FROM d UNION ALL SELECT 2, l_tax, g, h FROM d),
    c AS (SELECT feature, v, sum(g) AS g, sum(h) AS h, count(*) AS c FROM l GROUP BY feature, v),
    w AS (SELECT feature, v, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nx, sum(g) OVER u AS GL, sum(h) OVER u AS HL, sum(c) OVER u AS nl, sum(g) OVER a AS G, sum(h) OVER a AS H, sum(c) OVER a AS n FROM c
      WINDOW u AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
    k AS (SELECT *, {GAIN} AS gain FROM w WHERE nx IS NOT NULL AND nl >= 100 AND n - nl >= 100)
    SELECT feature, {R('(v + nx) / 2')} AS threshold, {R('gain', 2)} AS gain, nl::BIGINT AS n_left FROM k ORDER BY gain DESC, feature, v LIMIT 1""")
def best_split_exact(spark, sf_dir):
    d = sample(spark, sf_dir).select(F.lit(0).alias("node"), "x", "g", "h")
    b = split.best_exact(d, ["node"], [0, 1, 2], split.Rules(lambda_l2=1.0, min_data=100))
    return b.select("feature", rounded(F.col("threshold")).alias("threshold"), rounded(F.col("gain"), 2).alias("gain"), F.col("nl").alias("n_left"))


NAN_CODE = "CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE {} END"
SOFT = "(CASE WHEN {0} > 50 THEN {0} - 50 WHEN {0} < -50 THEN {0} + 50 ELSE 0 END)"
SOFT_GAIN = f"{SOFT.format('GL')} * {SOFT.format('GL')} / (greatest(HL, 0.001) + 1) + {SOFT.format('(G - GL)')} * {SOFT.format('(G - GL)')} / (greatest(H - HL, 0.001) + 1) - {SOFT.format('G')} * {SOFT.format('G')} / (greatest(TH, 0.001) + 1 + 1e-10)"


@query(f""", l AS (SELECT 0 AS feature, {NAN_CODE.format(CODES[0])} AS code, g, h FROM d UNION ALL SELECT 1, {CODES[1]}, g, h FROM d UNION ALL SELECT 2, {CODES[2]}, g, h FROM d),
    v AS (SELECT feature, code, sum(g) AS g, sum(h) AS t, sum(h) + CASE WHEN code >= 0 THEN 1e-6 ELSE 0 END AS h, count(*) AS c FROM l GROUP BY feature, code),
    w AS (SELECT feature, code, sum(g) OVER u AS GL, sum(h) OVER u AS HL, sum(c) OVER u AS nl, sum(g) OVER a AS G, sum(h) OVER a AS H, sum(t) OVER a AS TH, sum(c) OVER a AS n, max(code) OVER a AS top FROM v
      WINDOW u AS (PARTITION BY feature ORDER BY code ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
    k AS (SELECT *, {SOFT_GAIN} AS gain FROM w WHERE code >= 0 AND code < top AND nl >= 100 AND n - nl >= 100 AND HL >= 0.001 AND H - HL >= 0.001)
    SELECT feature, (CASE feature WHEN 0 THEN {EDGES[0]}[code + 1] WHEN 1 THEN {EDGES[1]}[code + 1] ELSE {EDGES[2]}[code + 1] END)::DOUBLE AS threshold, {R('gain', 2)} AS gain, nl::BIGINT AS n_left, n::BIGINT AS n FROM k ORDER BY gain DESC, feature, code LIMIT 1""")
def best_split_binned(spark, sf_dir):
    """Missing values in one feature, L1 and L2, least rows: the first split that a tree of two leaves takes."""
    x = F.array(F.when(F.col("l_orderkey") % 7 == 0, float("nan")).otherwise(F.col(FEATURES[0])), *FEATURES[1:])
    d = binning.coded(sample(spark, sf_dir).select(x.alias("x"), F.array("g").alias("g"), F.array("h").alias("h")), EDGES)
    (t,) = grow(d, 1, 3, split.Rules(lambda_l1=50.0, lambda_l2=1.0, min_data=100), edges=EDGES, num_leaves=2)
    root, left = t.nodes[0], t.nodes[t.nodes[0].left]
    out = spark.createDataFrame([(root.feature, float(root.threshold), float(root.gain), left.n_samples, root.n_samples)], "feature int, threshold double, gain double, n_left long, n long")
    return out.withColumn("gain", rounded(F.col("gain"), 2))


def _stump_rounds(y: str, init: str, grad: str, hess: str, rate: float, rounds: int) -> str:
    """Rounds of stumps over l_quantity cut at the edges 10.5 to 40.5, each round's scores out of the last one's."""
    cuts = ", ".join(f"({e}::DOUBLE)" for e in EDGES[0])
    out = f", base AS (SELECT *, {y} AS t FROM d), r0 AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, t, ({init}) AS f FROM base)"
    for k in range(rounds):
        out += f""", g{k} AS (SELECT *, {grad} AS gg, {hess} AS hh FROM r{k}),
        t{k} AS (SELECT e, sum(gg) FILTER (q <= e) AS GL, sum(hh) FILTER (q <= e) AS HL, sum(gg) AS G, sum(hh) AS H, count(*) FILTER (q <= e) AS nl, count(*) AS n,
          count(DISTINCT CASE WHEN q <= 10.5 THEN 0 WHEN q <= 20.5 THEN 1 WHEN q <= 30.5 THEN 2 WHEN q <= 40.5 THEN 3 ELSE 4 END) FILTER (q <= e) AS bl FROM g{k}, (VALUES {cuts}) c(e) GROUP BY e),
        s{k} AS (SELECT * FROM t{k} WHERE nl >= 20 AND n - nl >= 20 ORDER BY GL * GL / (HL + bl * 1e-6 + 1) + (G - GL) * (G - GL) / (H - HL + (5 - bl) * 1e-6 + 1) DESC, e LIMIT 1),
        r{k + 1} AS (SELECT l_orderkey, l_linenumber, q, t, f - {rate} * CASE WHEN q <= e THEN GL / (HL + 1 + 1e-10) ELSE (G - GL) / (H - HL + 1 + 1e-10) END AS f FROM g{k}, s{k})"""
    return out


def _stumps(model, label, spark, sf_dir):
    """A model of stumps on the bins of l_quantity, so that its edges lie between these five values, however rows are spread."""
    d = sample(spark, sf_dir).withColumns({"label": label, "q": binning.code(F.col("l_quantity"), EDGES[0]).cast("double")})
    return model(feature_cols=["q"], num_leaves=2, lambda_l2=1.0, use_histogram=True, learning_rate=0.5), d


@query(_stump_rounds("y", "SELECT avg(y) FROM d", "f - t", "1.0::DOUBLE", 0.5, 3) + f" SELECT l_orderkey, l_linenumber, {R('f', 3)} AS prediction FROM r3")
def regressor_rounds(spark, sf_dir):
    """Three rounds: histograms, gains, leaves, shrinkage and scores all by the library's own path."""
    m, d = _stumps(BoostedRegressor, F.col("y"), spark, sf_dir)
    m.set_params(num_iterations=3).fit(d)
    return m.predict(d).select(*KEY, rounded(F.col("prediction"), 3).alias("prediction"))


@query(_stump_rounds("b", "SELECT ln(avg(b) / (1 - avg(b))) FROM d", "1 / (1 + exp(-f)) - t", "(1 / (1 + exp(-f))) * (1 - 1 / (1 + exp(-f)))", 0.5, 2) + f" SELECT l_orderkey, l_linenumber, {R('1 / (1 + exp(-f))')} AS p, CASE WHEN 1 / (1 + exp(-f)) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM r2")
def classifier_rounds(spark, sf_dir):
    m, d = _stumps(BoostedClassifier, F.col("b"), spark, sf_dir)
    m.set_params(num_iterations=2).fit(d)
    return m.predict(d).select(*KEY, rounded(F.get("probability", F.lit(1))).alias("p"), "prediction")


@query(f" SELECT {R('avg(y)')} AS mean, {R('median(y)')} AS median, {R('quantile_cont(y, 0.8)')} AS q80, {R('ln(avg(b) / (1 - avg(b)))')} AS log_odds, {R('ln(avg((b = 0)::INT))')} AS class_0, {R('ln(avg((b = 1)::INT))')} AS class_1 FROM d")
def initial_scores(spark, sf_dir):
    """What each loss starts from, by Loss.init."""
    d = sample(spark, sf_dir)
    known = [losses.MSELoss().init(d, "y"), losses.MAELoss().init(d, "y"), losses.QuantileLoss(0.8).init(d, "y"), losses.BinaryCrossEntropyLoss().init(d, "b"), *losses.MultiClassCrossEntropyLoss(2).init(d, "b")]
    names = ["mean", "median", "q80", "log_odds", "class_0", "class_1"]
    return spark.createDataFrame([tuple(map(float, known))], ", ".join(f"{n} double" for n in names)).select(*(rounded(F.col(n)).alias(n) for n in names))


@query(f" SELECT {R('-sum(g) / (sum(h) + 1 + 1e-10)')} AS leaf, {R('sum(g) * sum(g) / (sum(h) + 1 + 1e-10)', 2)} AS score FROM d")
def root_leaf(spark, sf_dir):
    g, h = sample(spark, sf_dir).agg(F.sum("g"), F.sum("h")).first()
    r = split.Rules(lambda_l2=1.0)
    return spark.createDataFrame([(split.leaf_value(g, h, r), split.node_score(g, h, r))], "leaf double, score double").select(rounded(F.col("leaf")).alias("leaf"), rounded(F.col("score"), 2).alias("score"))


@query(" SELECT side, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 7 = 0 OR l_tax <= 0.04 THEN 'left' ELSE 'right' END AS side FROM d) GROUP BY side")
def nan_routing(spark, sf_dir):
    from sylvan.plans.tree import Node, Tree

    t = Tree([Node(0, 0, 0.0, 0, 1.0, 0, 0.04, 1, 2), Node(1, 1, 0.0, 0), Node(2, 1, 1.0, 0)])
    d = sample(spark, sf_dir).select(F.array(F.when(F.col("l_orderkey") % 7 == 0, float("nan")).otherwise(F.col("l_tax"))).alias("x"))
    side = F.when(F.expr(t.sql()) == 0, "left").otherwise("right")
    return d.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query(f""", n AS (SELECT floor(count(*) * 0.2)::BIGINT AS top, floor(count(*) * 0.1)::BIGINT AS other FROM d), t AS (SELECT abs(g) AS a, row_number() OVER (ORDER BY abs(g) DESC) AS r FROM d)
    SELECT any_value(top) AS n_top, any_value(other) AS n_other, {R('any_value(other) * 8.0', 2)} AS weight_other, {R('min(a)')} AS least_top FROM t, n WHERE r <= top""")
def goss_sample(spark, sf_dir):
    s = sampling.GOSS(0.2, 0.1, 1).sample(sample(spark, sf_dir).select(F.xxhash64(*KEY, "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"), "g", "h"))
    top = F.col("goss_weight") == 1
    return s.agg(F.count_if(top).alias("n_top"), F.count_if(~top).alias("n_other"), rounded(F.sum(F.when(~top, F.col("goss_weight"))), 2).alias("weight_other"), rounded(F.min(F.when(top, F.abs("g")))).alias("least_top"))


@query(" SELECT floor(count(*) * 0.7)::BIGINT AS bagged, (count(*) - floor(count(*) * 0.2))::BIGINT AS train, floor(count(*) * 0.2)::BIGINT AS test FROM d")
def sample_sizes(spark, sf_dir):
    d = sample(spark, sf_dir).select(F.xxhash64(*KEY, "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"))
    train, test = sampling.train_test_split(d, random_state=3)
    return sampling.bagging(d, 0.7, seed=5).agg(F.count("*").alias("bagged")).crossJoin(train.agg(F.count("*").alias("train"))).crossJoin(test.agg(F.count("*").alias("test")))


ONE_HOT = "[(l_returnflag = 'A')::INT * l_quantity, (l_returnflag = 'N')::INT * l_quantity, (l_returnflag = 'R')::INT * l_quantity]"


@query(f""", m AS (SELECT max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) + 1 AS a, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) + 1 AS n FROM d)
    SELECT l_orderkey, l_linenumber, {R("l_quantity + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN a ELSE a + n END")} AS bundle FROM d, m""")
def feature_bundle(spark, sf_dir):
    d = sample(spark, sf_dir).select(*KEY, F.array(*(F.when(F.col("l_returnflag") == c, F.col("l_quantity")).otherwise(0.0) for c in "ANR")).alias("x"))
    out, _ = bundling.bundle_features(d, 3)
    return out.select(*KEY, rounded(F.col("x")[0]).alias("bundle"))


@query(""" SELECT i, j, count(*) AS n FROM (SELECT l_orderkey, [l_discount, l_tax, (l_returnflag = 'R')::INT::DOUBLE] AS x FROM d), (VALUES (0, 1), (0, 2), (1, 2)) t(i, j) WHERE x[i + 1] <> 0 AND x[j + 1] <> 0 GROUP BY i, j""")
def feature_conflicts(spark, sf_dir):
    d = sample(spark, sf_dir).select(F.array("l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("double")).alias("x"))
    return spark.createDataFrame([(i, j, n) for (i, j), n in bundling.conflicts(d, 3)[1].items()], "i int, j int, n long")


def _train(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir).select(F.xxhash64(*KEY, "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"), *FEATURES, (F.col("l_extendedprice") / 1000).alias("label"), F.col("l_returnflag").alias("flag"))


@query(f""", m AS (SELECT avg(y) AS m FROM d), p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 25.5 THEN 0 ELSE 1 END AS side, y, m FROM d, m),
    v AS (SELECT side, -sum(m - y) / (count(*) + 1e-10) AS v FROM p GROUP BY side) SELECT l_orderkey, l_linenumber, {R('m + 0.5 * v', 3)} AS prediction FROM p JOIN v USING (side)""")
def stump_prediction(spark, sf_dir):
    d = table(spark, sf_dir).select(*KEY, (F.col("l_quantity") > 25.5).cast("double").alias("f_0"), (F.col("l_extendedprice") / 1000).alias("label"))
    m = BoostedRegressor(feature_cols=["f_0"], num_iterations=1, learning_rate=0.5, num_leaves=2).fit(d)
    return m.predict(d).select(*KEY, rounded(F.col("prediction"), 3).alias("prediction"))


@query()
def regressor(spark, sf_dir):
    d = _train(spark, sf_dir)
    m = BoostedRegressor(feature_cols=FEATURES, num_iterations=10, use_histogram=True, num_leaves=15, random_state=1).fit(d)
    return m.predict(d).select("row_id", rounded(F.col("prediction"), 3).alias("prediction"))


@query()
def regressor_goss_early_stop(spark, sf_dir):
    train, test = sampling.train_test_split(_train(spark, sf_dir), random_state=1)
    m = BoostedRegressor(feature_cols=FEATURES, num_iterations=4, learning_rate=0.5, use_histogram=True, num_leaves=7, enable_goss=True, early_stopping_rounds=2, random_state=1).fit(train, eval_set=test)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(m.history_["train_loss"], m.history_["val_loss"], strict=True))], "round int, train_loss double, val_loss double")


@query()
def classifier_binary(spark, sf_dir):
    d = _train(spark, sf_dir).withColumn("label", (F.col("flag") == "N").cast("double"))
    m = BoostedClassifier(feature_cols=FEATURES, num_iterations=3, use_histogram=True, num_leaves=7, random_state=1).fit(d)
    return m.predict_proba(d).select("row_id", rounded(F.col("probability")[1]).alias("p"))


@query()
def classifier_multiclass(spark, sf_dir):
    d = _train(spark, sf_dir).withColumn("label", F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("flag")).cast("double"))
    m = BoostedClassifier(feature_cols=FEATURES, num_iterations=2, use_histogram=True, num_leaves=7, random_state=1).fit(d)
    return m.predict(d).groupBy("prediction").agg(F.count("*").alias("n"))


@query()
def importances(spark, sf_dir):
    m = BoostedRegressor(feature_cols=FEATURES, num_iterations=3, use_histogram=True, num_leaves=7, random_state=1).fit(_train(spark, sf_dir))
    t = m.trees_frame().where("NOT is_leaf").groupBy("feature_idx").agg(F.sum("gain").alias("gain"))
    return t.select("feature_idx", rounded(F.col("gain"), 2).alias("gain"))
