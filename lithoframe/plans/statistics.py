"""Statistics queries: agreement of spectra, guarded moments, robust fits, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.functions import scalars as S
from lithoframe.functions import vectors as V
from lithoframe.operators import moments as M
from lithoframe.operators.quantiles import quantiles, small
from lithoframe.session import cut, written
from lithoframe.plans.base import AXIS, BANDS, LONG, PX, REF, mean_spectrum, pixels, q6, query, r6, table

_ANGLE = "degrees(acos(greatest(least(list_dot_product(v, reference) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(reference, reference))), 1.0), -1.0)))"


def _with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return px.join(mean_spectrum(px, "label"), "label")


@query(
    f"WITH {REF} SELECT label, count(*) AS n, {q6(f'avg({_ANGLE})', 'sam_deg')}, {q6(f'sqrt(sum(list_sum(list_transform(list_zip(v, reference), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) / (count(*) * {BANDS}))', 'rmse')} FROM px JOIN ref USING (label) GROUP BY label"
)
def pixel_statistics(spark, sf_dir):
    """Mean spectral angle and RMSE of each label's spectra against their mean spectrum."""
    a, b = F.col("v"), F.col("reference")
    d = _with_reference(spark, sf_dir).select("label", V.spectral_angle(a, b).alias("angle"), V.square_error(a, b).alias("se"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("angle"), "sam_deg"), r6(F.sqrt(F.sum("se") / (F.count(F.lit(1)) * BANDS)), "rmse"))


@query(f"WITH {REF}, z AS (SELECT lg.band, lg.v AS a, ref.reference[lg.band + 1] AS b FROM lg JOIN ref USING (label)), r AS (SELECT band, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS r FROM z GROUP BY band HAVING count(*) >= 16 AND stddev_pop(a) > 1e-9 AND stddev_pop(b) > 1e-9) SELECT count(*) AS bands, {q6('avg(r)', 'mean_correlation')} FROM r")
def band_correlation_mean(spark, sf_dir):
    """Mean over bands of the correlation with the reference spectrum; bands without spread don't count."""
    d = _with_reference(spark, sf_dir)
    rows = M.band_moments(d, "v", "reference", BANDS)
    ok = rows.where("n >= 16 and sqrt(vx) > 1e-9 and sqrt(vy) > 1e-9")
    return ok.agg(F.count(F.lit(1)).alias("bands"), r6(F.avg(F.col("cxy") / (F.sqrt("vx") * F.sqrt("vy"))), "mean_correlation"))


_LI = "SELECT l_returnflag, l_linestatus, {cols} FROM lineitem GROUP BY l_returnflag, l_linestatus"
_X, _Y = "l_quantity", "l_extendedprice"


@query(_LI.format(cols=f"count(*) AS n, {q6('covar_pop(l_quantity, l_extendedprice) / sqrt(var_pop(l_quantity) * var_pop(l_extendedprice))', 'rho')}, CAST(-1 AS DOUBLE) AS rho_or_minus_one"))
def guarded_correlation(spark, sf_dir):
    """Correlation with guards on support and spread; the second column falls back to -1 on too little support."""
    m = M.pair_moments(F.col(_X), F.col(_Y))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(m["n"].alias("n"), r6(M.correlation(m, 32), "rho"), M.correlation(m, 10**9, -1.0).alias("rho_or_minus_one"))


@query(_LI.format(cols=f"{q6('covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity)', 'slope')}, {q6('avg(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) * avg(l_quantity)', 'intercept')}"))
def least_squares_slope(spark, sf_dir):
    """Centred least-squares slope and intercept of each group."""
    m = M.pair_moments(F.col(_X), F.col(_Y))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(M.slope(m), "slope"), r6(m["my"] - M.slope(m) * m["mx"], "intercept"))


_DET = "WITH m AS (SELECT l_returnflag, count(*) AS n, var_pop(l_discount) AS vx, var_pop(l_tax) AS vy, covar_pop(l_discount, l_tax) AS c FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, n AS pixel_count, "


@query(
    _DET + ", ".join([q6("greatest(least(c / sqrt(vx * vy), 1), -1)", "rho"), q6("c / vx", "beta"), q6("sqrt(vy / vx)", "energy_ratio"), q6("sqrt(vy - c * c / vx) / sqrt(vx)", "residual_ratio"), q6("c * c / (vx * vy)", "aligned_fraction"), q6("sqrt(vx)", "reference_rms"), q6("sqrt(vy)", "candidate_rms"), q6("sqrt(vy - c * c / vx)", "residual_rms")]) + " FROM m"
)
def detail_statistics(spark, sf_dir):
    """Correlation, slope, energy and orthogonal residual of two detail signals from one pass of moments."""
    s = M.detail_statistics(M.pair_moments(F.col("l_discount"), F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[c.alias(k) if k == "pixel_count" else r6(c, k) for k, c in s.items()])


@query(
    "WITH d AS (SELECT o_orderpriority, ln(l_quantity + 0.012) AS a, ln(l_extendedprice + 0.012) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT o_orderpriority, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM d GROUP BY o_orderpriority) "
    f"SELECT o_orderpriority, n AS pixel_count, {q6('c / va', 'alpha')}, {q6('mb - c / va * ma', 'intercept')}, {q6('c / sqrt(va * vb)', 'rho')}, CASE WHEN n < 64 THEN 'insufficient_support' WHEN abs(c / sqrt(va * vb)) >= 0.2 AND abs(c / va) >= 0.05 THEN 'identifiable' ELSE 'weak_cross_modal_relation' END AS status FROM m"
)
def log_relation(spark, sf_dir):
    """Log-log relation of two signals with its support and strength status."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = M.log_relation(F.col(_X), F.col(_Y))
    return d.groupBy("o_orderpriority").agg(*[c.alias(k) if k in ("pixel_count", "status") else r6(c, k) for k, c in s.items()])


def irls_affine(df: DataFrame, by: list[str], x: str, y: str, gain_limits=(0.25, 4.0), offset_limits=(-1.0, 1.0), passes: int = 4) -> DataFrame:
    """Robust gain and offset of y on x for each group: a quartile fit, then reweighted passes with weights 1 / (1 + (r / 2.5 s)^2).

    The rows that count are written once to the shared folder, so each pass reads those and one row a group. A pass is two
    exact medians and five weighted sums; no task holds a group. Groups with fewer than 64 rows keep gain 1 and offset 0.
    """
    g = by
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*g, F.col(x).alias("x"), F.col(y).alias("y"))
    q = quantiles(rows, g, {"xq": F.col("x"), "yq": F.col("y")}, [0.1, 0.25, 0.5, 0.75, 0.9]).withColumnRenamed("n_rows", "n")
    dx = F.col("xq")[3] - F.col("xq")[1]
    gain = S.clip(F.when(F.abs(dx) > 1e-9, (F.col("yq")[3] - F.col("yq")[1]) / F.when(F.abs(dx) > 1e-9, dx)).otherwise(1.0), *gain_limits)
    model = cut(q.withColumn("gain", gain).withColumn("offset", F.col("yq")[2] - F.col("gain") * F.col("xq")[2]))
    groups = model.count()
    inside = (F.col("n") >= 64) & F.col("x").between(F.col("xq")[0], F.col("xq")[4]) & F.col("y").between(F.col("yq")[0], F.col("yq")[4])
    fit, drop = written(rows.join(small(model.select(*g, "xq", "yq", "n"), groups), g).where(inside).select(*g, "x", "y"))
    sizes = tuple(fit.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first())
    now = model.select(*g, "n", "gain", "offset")
    for _ in range(passes):
        r = fit.join(small(now.select(*g, "gain", "offset"), groups), g).withColumn("r", F.col("y") - (F.col("gain") * F.col("x") + F.col("offset")))
        mid = quantiles(r, g, {"mid": F.col("r")}, [0.5], sizes=sizes).select(*g, F.col("mid")[0].alias("mid"))
        away = r.join(small(mid, groups), g)
        scale = quantiles(away, g, {"d": F.abs(F.col("r") - F.col("mid"))}, [0.5], sizes=sizes).select(*g, (1.4826 * F.col("d")[0] + 1e-6).alias("scale"))
        w = r.join(small(scale, groups), g).withColumn("w", 1 / (1 + (F.col("r") / (2.5 * F.col("scale"))) * (F.col("r") / (2.5 * F.col("scale")))))
        s = w.groupBy(*g).agg(F.sum("w").alias("sw"), F.sum(F.expr("w * x")).alias("sx"), F.sum(F.expr("w * y")).alias("sy"), F.sum(F.expr("w * x * x")).alias("sxx"), F.sum(F.expr("w * x * y")).alias("sxy"))
        det = F.expr("sw * sxx - sx * sx")
        new_gain = S.clip(F.expr("sw * sxy - sx * sy") / F.when(F.abs(det) > 1e-10, det), *gain_limits)
        new = s.withColumn("g1", new_gain).withColumn("o1", S.clip((F.col("sy") - F.col("g1") * F.col("sx")) / F.greatest("sw", F.lit(1e-10)), *offset_limits)).select(*g, "g1", "o1")
        now = now.join(new, g, "left").select(*g, "n", F.coalesce("g1", "gain").alias("gain"), F.when(F.col("g1").isNotNull(), F.col("o1")).otherwise(F.col("offset")).alias("offset"))
        now = cut(now)  # one row a group; without it every pass would redo all passes before it
    drop()
    few = F.col("n") < 64
    return now.select(*g, "n", F.when(few, 1.0).otherwise(F.col("gain")).alias("gain"), F.when(few, 0.0).otherwise(S.clip(F.col("offset"), *offset_limits)).alias("offset"))


def _irls_sql(passes: int = 4) -> str:
    s = "WITH d AS (SELECT l_returnflag AS g, l_quantity / 50.0 AS x, l_extendedprice / 100000.0 AS y FROM lineitem), q AS (SELECT g, count(*) AS n, quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) AS xq, quantile_cont(y, [0.1, 0.25, 0.5, 0.75, 0.9]) AS yq FROM d GROUP BY g), "
    s += "m0 AS (SELECT g, gain, yq[3] - gain * xq[3] AS off FROM (SELECT *, greatest(least((yq[4] - yq[2]) / (xq[4] - xq[2]), 4.0), 0.25) AS gain FROM q)), f AS (SELECT d.* FROM d JOIN q USING (g) WHERE x BETWEEN xq[1] AND xq[5] AND y BETWEEN yq[1] AND yq[5]), "
    for k in range(passes):
        s += f"r{k} AS (SELECT f.*, y - (gain * x + off) AS r FROM f JOIN m{k} USING (g)), c{k} AS (SELECT g, median(r) AS mid FROM r{k} GROUP BY g), s{k} AS (SELECT g, 1.4826 * median(abs(r - mid)) + 1e-6 AS sc FROM r{k} JOIN c{k} USING (g) GROUP BY g), w{k} AS (SELECT r{k}.*, 1 / (1 + (r / (2.5 * sc)) * (r / (2.5 * sc))) AS w FROM r{k} JOIN s{k} USING (g)), "
        s += f"t{k} AS (SELECT g, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w{k} GROUP BY g), m{k + 1} AS (SELECT g, gain, greatest(least((sy - gain * sx) / sw, 1.0), -1.0) AS off FROM (SELECT *, greatest(least((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 4.0), 0.25) AS gain FROM t{k})), "
    return s[:-2] + f" SELECT g AS l_returnflag, n, {q6('gain', 'gain')}, {q6('off', 'offset_value')} FROM m{passes} JOIN q USING (g)"


@query(_irls_sql())
def irls_affine_fit(spark, sf_dir):
    """Robust affine calibration by four reweighted passes."""
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"))
    return irls_affine(d, ["l_returnflag"], "x", "y").select("l_returnflag", "n", r6("gain", "gain"), r6("offset", "offset_value"))


@query(_LI.format(cols=f"{q6('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)', 'iqr')}, {q6('(quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25)) / (quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25))', 'quantile_gain')}, {q6('median(l_tax) - (quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25)) / (quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25)) * median(l_discount)', 'quantile_offset')}"))
def quantile_affine(spark, sf_dir):
    """Gain and offset from interquartile ranges and medians."""
    p = [0.25, 0.5, 0.75]
    a = quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"e": F.col("l_extendedprice"), "t": F.col("l_tax"), "d": F.col("l_discount")}, p)
    g = (F.col("t")[2] - F.col("t")[0]) / (F.col("d")[2] - F.col("d")[0])
    return a.select("l_returnflag", "l_linestatus", r6(F.col("e")[2] - F.col("e")[0], "iqr"), r6(g, "quantile_gain"), r6(F.col("t")[1] - g * F.col("d")[1], "quantile_offset"))


@query(
    f"WITH {LONG}, p AS (SELECT band, label % 5 AS fold, v AS y, avg(v) OVER (PARTITION BY band, label) AS yhat, avg(v) OVER (PARTITION BY band) AS base FROM lg), f AS (SELECT band, fold, 1 - sum((y - yhat) * (y - yhat)) / sum((y - base) * (y - base)) AS r2 FROM p GROUP BY band, fold), "
    "a AS (SELECT band, count(*) AS n, 1 - sum((y - yhat) * (y - yhat)) / sum((y - base) * (y - base)) AS r2, sqrt(avg((y - yhat) * (y - yhat))) AS e, covar_pop(y, yhat) / sqrt(var_pop(y) * var_pop(yhat)) AS rho, var_pop(y) AS vy FROM p GROUP BY band) "
    f"SELECT band, n, {q6('any_value(a.r2)', 'pooled_r2')}, {q6('any_value(rho)', 'pooled_rho')}, {q6('any_value(e)', 'rmse')}, {q6('any_value(e / sqrt(vy))', 'nrmse')}, {q6('median(f.r2)', 'fold_median')}, {q6('quantile_cont(f.r2, 0.1)', 'fold_q10')}, {q6('quantile_cont(f.r2, 0.9)', 'fold_q90')}, {q6('avg(CASE WHEN f.r2 > 0 THEN 1.0 ELSE 0.0 END)', 'positive_fraction')} FROM a JOIN f USING (band) GROUP BY band, n"
)
def prediction_by_fold(spark, sf_dir):
    """Pooled and per-fold predictive metrics of every band, the label means being the prediction."""
    px = pixels(spark, sf_dir)
    ref = mean_spectrum(px, "label")
    base = px.agg(F.array(*[F.avg(F.col("v")[k]) for k in range(BANDS)]).alias("base"))
    rows = px.join(ref, "label").select(F.expr("label % 5").alias("fold"), F.posexplode(F.arrays_zip("v", "reference")).alias("band", "p")).select("fold", "band", "p.*")
    means = base.select(F.posexplode("base").alias("band", "base"))  # one row a band
    d = rows.join(F.broadcast(means), "band")
    pm = M.prediction_metrics(F.col("v"), F.col("reference"), F.col("base"))
    pooled = d.groupBy("band").agg(*[c.alias(k) for k, c in pm.items()])
    fold = d.groupBy("band", "fold").agg(pm["r2"].alias("f"))
    per = fold.groupBy("band").agg(F.percentile("f", [0.1, 0.5, 0.9]).alias("q"), F.avg((F.col("f") > 0).cast("double")).alias("pos"))
    return pooled.join(per, "band").select(F.col("band").cast("long").alias("band"), "n", r6("r2", "pooled_r2"), r6("rho", "pooled_rho"), r6("rmse", "rmse"), r6("nrmse", "nrmse"), r6(F.col("q")[1], "fold_median"), r6(F.col("q")[0], "fold_q10"), r6(F.col("q")[2], "fold_q90"), r6("pos", "positive_fraction"))


@query(
    "WITH f AS (SELECT l_linenumber AS fold, regr_slope(l_extendedprice, l_quantity) AS a, regr_slope(l_tax, l_discount) AS b FROM lineitem GROUP BY l_linenumber), p AS (SELECT (f.a * g.a + f.b * g.b) / (sqrt(f.a * f.a + f.b * f.b) * sqrt(g.a * g.a + g.b * g.b)) AS c FROM f JOIN f AS g ON f.fold < g.fold) "
    f"SELECT {q6('median(a)', 'median_slope')}, {q6('quantile_cont(a, 0.1)', 'q10')}, {q6('quantile_cont(a, 0.9)', 'q90')}, {q6('greatest(avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN a < 0 THEN 1.0 ELSE 0.0 END))', 'sign_stability')}, (SELECT {q6('median(c)', 'z').replace(' AS z', '')} FROM p) AS median_cosine FROM f"
)
def mapping_stability(spark, sf_dir):
    """Spread, sign stability and pairwise cosine of mappings fitted on each fold."""
    m1, m2 = M.pair_moments(F.col("l_quantity"), F.col("l_extendedprice")), M.pair_moments(F.col("l_discount"), F.col("l_tax"))
    f = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(M.slope(m1).alias("a"), M.slope(m2).alias("b"))
    # Folds are the distinct line numbers, so both sides are a handful of rows.
    g = f.select(F.col("l_linenumber").alias("m"), F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = f.join(g, F.col("l_linenumber") < F.col("m")).select((F.expr("a * c + b * d") / (F.sqrt(F.expr("a * a + b * b")) * F.sqrt(F.expr("c * c + d * d")))).alias("cos"))
    one = f.agg(F.percentile("a", [0.1, 0.5, 0.9]).alias("q"), F.greatest(F.avg((F.col("a") > 0).cast("double")), F.avg((F.col("a") < 0).cast("double"))).alias("s"))
    two = pairs.agg(F.percentile("cos", 0.5).alias("cos"))
    return one.join(two, F.lit(True)).select(r6(F.col("q")[1], "median_slope"), r6(F.col("q")[0], "q10"), r6(F.col("q")[2], "q90"), r6("s", "sign_stability"), r6("cos", "median_cosine"))


@query(
    "WITH d AS (SELECT l_returnflag, l_extendedprice AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem), c AS (SELECT l_returnflag, feature, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) AS r FROM d GROUP BY l_returnflag, feature) "
    f"SELECT l_returnflag, arg_max(feature, abs(r)) AS feature, {q6('arg_max(r, abs(r))', 'rho')} FROM c GROUP BY l_returnflag"
)
def best_feature_correlation(spark, sf_dir):
    """The feature of strongest correlation with a target, and that correlation with its sign."""
    d = table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax"]
    m = d.groupBy("l_returnflag").agg(*[M.correlation(M.pair_moments(F.col(n), F.col("l_extendedprice")), 3).alias(n) for n in names])
    long = m.select("l_returnflag", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("r")) for n in names])).alias("s")).select("l_returnflag", "s.*")
    return long.groupBy("l_returnflag").agg(F.max_by("feature", F.abs("r")).alias("feature"), r6(F.max_by("r", F.abs("r")), "rho"))


@query(f"SELECT event_type, count(*) AS n, {q6('quantile_cont(value, 0.025)', 'lo')}, {q6('quantile_cont(value, 0.975)', 'hi')}, quantile_cont(value, 0.025) > 0 OR quantile_cont(value, 0.975) < 0 AS excludes_zero FROM events GROUP BY event_type")
def percentile_interval(spark, sf_dir):
    """A central 95 % interval (from four values on), and whether it leaves out zero."""
    known = table(spark, sf_dir, "events").where("value is not null")
    a = quantiles(known, ["event_type"], {"q": F.col("value")}, [0.025, 0.975]).withColumnRenamed("n_rows", "n")
    lo, hi = (F.when(F.col("n") >= 4, F.col("q")[k]) for k in (0, 1))
    return a.select("event_type", "n", r6(lo, "lo"), r6(hi, "hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


@query(f"WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type), d AS (SELECT event_type, abs(value - m) AS e FROM events JOIN m USING (event_type)) SELECT event_type, {q6('avg(e)', 'mean')}, {q6('median(e)', 'median')}, {q6('quantile_cont(e, 0.95)', 'p95')}, {q6('max(e)', 'max')} FROM d GROUP BY event_type")
def error_summary(spark, sf_dir):
    """Mean, median, 95th percentile and maximum of absolute errors."""
    ev = table(spark, sf_dir, "events")
    d = ev.join(ev.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type").withColumn("e", F.abs(F.col("value") - F.col("m")))
    sums = d.groupBy("event_type").agg(F.avg("e").alias("mean"), F.max("e").alias("max"))
    q = quantiles(d, ["event_type"], {"q": F.col("e")}, [0.5, 0.95])
    return sums.join(q, "event_type").select(r6("mean", "mean"), r6(F.col("q")[0], "median"), r6(F.col("q")[1], "p95"), r6("max", "max"), "event_type")


@query(
    "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice < 50000) AS below, count(*) FILTER (o_totalprice > 250000) AS above, min(o_totalprice) AS min_before, max(o_totalprice) AS max_before, min(least(greatest(o_totalprice, 50000.0), 250000.0)) AS min_after, max(least(greatest(o_totalprice, 50000.0), 250000.0)) AS max_after FROM orders GROUP BY o_orderstatus"
)
def clip_accumulator(spark, sf_dir):
    """Counts beyond physical limits and the ranges before and after clipping."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[c.alias(k) for k, c in M.clip_statistics(F.col("o_totalprice"), 50000, 250000).items()])


@query("WITH c AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'unidentifiable' WHEN c_acctbal < 5000 THEN 'weak' ELSE 'identifiable' END AS status FROM customer) SELECT c_mktsegment, status, count(*) AS n FROM c GROUP BY c_mktsegment, status")
def status_counts(spark, sf_dir):
    """How many of each status in a group."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").withColumn("status", F.when(b < 0, "unidentifiable").when(b < 5000, "weak").otherwise("identifiable")).groupBy("c_mktsegment", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH h AS (SELECT event_type, CAST(least(greatest(floor(255 * least(greatest((value - lo) / (hi - lo), 0), 1)), 0), 255) AS BIGINT) AS bin FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type) USING (event_type)), c AS (SELECT event_type, bin, count(*) AS n FROM h GROUP BY event_type, bin), "
    "w AS (SELECT event_type, bin, sum(n) OVER o AS cw, sum(n * bin) OVER o AS cm FROM c WINDOW o AS (PARTITION BY event_type ORDER BY bin)), t AS (SELECT event_type, max(cw) AS tw, max(cm) AS tm FROM w GROUP BY event_type), "
    "s AS (SELECT a.event_type, a.bin AS t1, b.bin AS t2, CAST(a.cm AS DOUBLE) * a.cm / a.cw + CAST(b.cm - a.cm AS DOUBLE) * (b.cm - a.cm) / (b.cw - a.cw) + CAST(tm - b.cm AS DOUBLE) * (tm - b.cm) / (tw - b.cw) AS score FROM w a JOIN w b ON a.event_type = b.event_type AND a.bin < b.bin JOIN t ON t.event_type = a.event_type WHERE b.cw < tw) "
    "SELECT event_type, t1, t2 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(score, 3) DESC, t1, t2) AS k FROM s) WHERE k = 1"
)
def otsu_three_class(spark, sf_dir):
    """Two thresholds that separate three classes best, from a 256-bin histogram of each group."""
    ev = table(spark, sf_dir, "events")
    return three_class_otsu(ev, "event_type", "value")


def three_class_otsu(df: DataFrame, by: str, value: str) -> DataFrame:
    """(group, t1, t2): bins that maximise the between-class variance. Rows are counted into 256 bins first; pairs of bins are all that is joined."""
    lim = df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = (F.col(value) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    c = df.join(lim, by).select(by, S.clip(F.floor(255 * S.clip(x, 0, 1)), 0, 255).cast("long").alias("bin")).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy("bin")
    cum = c.select(by, "bin", F.sum("n").over(w).alias("cw"), F.sum(F.col("n") * F.col("bin")).over(w).alias("cm"))
    tot = cum.groupBy(by).agg(F.max("cw").alias("tw"), F.max("cm").alias("tm"))
    a = cum.select(by, F.col("bin").alias("t1"), F.col("cw").alias("aw"), F.col("cm").alias("am"))
    b = cum.select(by, F.col("bin").alias("t2"), F.col("cw").alias("bw"), F.col("cm").alias("bm"))
    part = lambda m, n: m.cast("double") * m / n
    score = part(F.col("am"), F.col("aw")) + part(F.col("bm") - F.col("am"), F.col("bw") - F.col("aw")) + part(F.col("tm") - F.col("bm"), F.col("tw") - F.col("bw"))
    s = a.join(b, by).where("t1 < t2").join(tot, by).where("bw < tw").withColumn("score", F.round(score, 3))
    return s.groupBy(by).agg(F.min_by(F.struct("t1", "t2"), F.struct((-F.col("score")).alias("s"), "t1", "t2")).alias("t")).select(by, "t.t1", "t.t2")


_G = ["l_quantity / 50.0", "l_discount", "l_tax"]


@query(
    "WITH d AS (SELECT l_linestatus, [1.0, l_quantity / 50.0, l_discount, l_tax] AS f, l_extendedprice / 100000.0 AS y, 1.0 / l_linenumber AS w FROM lineitem), e AS (SELECT l_linestatus, unnest(range(4)) AS i, f, y, w FROM d), g AS (SELECT l_linestatus, i, unnest(range(5)) AS j, f, y, w FROM e) "
    f"SELECT l_linestatus, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {q6('sum(w * f[i + 1] * CASE WHEN j < 4 THEN f[j + 1] ELSE y END)', 'entry')} FROM g GROUP BY l_linestatus, i, j"
)
def weighted_normal_equations(spark, sf_dir):
    """Entries of the weighted Gram matrix and cross products of a regression, one aggregate each."""
    cols = [F.lit(1.0), F.col("l_quantity") / 50.0, F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 100000.0]
    w = 1.0 / F.col("l_linenumber")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(w * cols[i] * cols[j]).alias("s")) for i in range(4) for j in range(5)]).alias("g"))
    return sums.select("l_linestatus", F.explode("g").alias("e")).select("l_linestatus", "e.i", "e.j", r6("e.s", "entry"))


@query(f"WITH p AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, quantile_cont(value, 0.995) AS top FROM events) SELECT event_id, {q6('least(greatest((value - lo) / (CASE WHEN hi <= lo THEN lo + 1e-6 ELSE hi END - lo), 0), 1)', 'stretched')}, CAST(round_even(255 * least(greatest((value - lo) / (CASE WHEN hi <= lo THEN lo + 1e-6 ELSE hi END - lo), 0), 1), 0) AS INTEGER) AS grey, {q6('value / CASE WHEN top > 3 THEN top ELSE 1 END', 'radiometry')} FROM events, p")
def percentile_stretch(spark, sf_dir):
    """Percentile stretch to [0, 1], its 8-bit form, and the radiometric scale."""
    ev = table(spark, sf_dir, "events")
    q = quantiles(ev, [], {"q": F.col("value")}, [0.02, 0.98, 0.995])
    d = ev.join(F.broadcast(q), F.lit(True))  # q is one row
    s = S.stretch(F.col("value"), F.col("q")[0], F.col("q")[1])
    return d.select("event_id", r6(s, "stretched"), S.to_uint8(s).alias("grey"), r6(F.col("value") / F.when(F.col("q")[2] > 3, F.col("q")[2]).otherwise(1.0), "radiometry"))


@query(f"WITH {PX}, i AS (SELECT vec_id, median(u) AS m FROM (SELECT vec_id, unnest(v) AS u FROM px) GROUP BY vec_id), q AS (SELECT quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.985) AS hi FROM i) SELECT vec_id, m > lo AND m < hi AS material FROM i, q")
def material_mask(spark, sf_dir):
    """Pixels whose median intensity lies within the 5th and 98.5th percentile."""
    s = F.array_sort("v")
    d = pixels(spark, sf_dir).select("vec_id", ((s[BANDS // 2 - 1] + s[BANDS // 2]) / 2).alias("m"))
    q = quantiles(d, [], {"q": F.col("m")}, [0.05, 0.985])
    return d.join(F.broadcast(q), F.lit(True)).select("vec_id", ((F.col("m") > F.col("q")[0]) & (F.col("m") < F.col("q")[1])).alias("material"))


@query(f"WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS mid FROM customer), s AS (SELECT c_mktsegment, median(abs(c_acctbal - mid)) AS d FROM c GROUP BY c_mktsegment) SELECT c_custkey, {q6('abs(c_acctbal - mid) / (1.4826 * d + 0.35)', 'z')}, abs(c_acctbal - mid) / (1.4826 * d + 0.35) <= 1.5 AS kept FROM c JOIN s USING (c_mktsegment)")
def robust_z_filter(spark, sf_dir):
    """Robust z scores from medians and median absolute deviations, and who passes."""
    c = table(spark, sf_dir, "customer")
    mid = quantiles(c, ["c_mktsegment"], {"q": F.col("c_acctbal")}, [0.5]).select("c_mktsegment", F.col("q")[0].alias("mid"))
    m = c.join(mid, "c_mktsegment").withColumn("d", F.abs(F.col("c_acctbal") - F.col("mid")))
    s = quantiles(m, ["c_mktsegment"], {"q": F.col("d")}, [0.5]).select("c_mktsegment", (1.4826 * F.col("q")[0] + 0.35).alias("s"))
    z = F.col("d") / F.col("s")
    return m.join(s, "c_mktsegment").select("c_custkey", r6(z, "z"), (z <= 1.5).alias("kept"))


_AX = "axis AS (SELECT unnest(range(64)) AS band, CAST(691 + 29 * unnest(range(64)) AS DOUBLE) AS w)"


@query(f"WITH {_AX}, t AS (SELECT unnest([720.0::DOUBLE, 950.0, 1300.0, 1650.0, 2200.0, 2350.0]) AS target) SELECT target, CAST(band AS INTEGER) AS band, w AS wavelength FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(w - target), band) AS k FROM t, axis) WHERE k = 1")
def band_select_nearest(spark, sf_dir):
    """Nearest band to each target wavelength, the first on ties."""
    t = spark.createDataFrame([(x, V.nearest_index(AXIS, x)) for x in (720.0, 950.0, 1300.0, 1650.0, 2200.0, 2350.0)], "target double, band int")
    return t.withColumn("wavelength", 691.0 + 29.0 * F.col("band"))


@query(f"WITH {_AX}, {LONG}, u AS (SELECT band, stddev_pop(v) AS s FROM lg GROUP BY band), q AS (SELECT quantile_cont(s, 0.97) AS q FROM u) SELECT CAST(band AS INTEGER) AS band_index, w AS wavelength_nm, {q6('s', 'uncertainty')}, s >= q OR (w BETWEEN 1340 AND 1450 OR w BETWEEN 1800 AND 1960) AS is_low_confidence, CASE WHEN w BETWEEN 1340 AND 1450 OR w BETWEEN 1800 AND 1960 THEN 'water_absorption_or_low_snr' WHEN s >= q THEN 'high_noise' ELSE '' END AS reason FROM u JOIN axis USING (band), q")
def band_metadata_flags(spark, sf_dir):
    """Band table with the flags for water absorption and noise."""
    one = pixels(spark, sf_dir).agg(F.array(*[F.stddev_pop(F.col("v")[k]) for k in range(BANDS)]).alias("s"))
    u = one.select(F.posexplode("s").alias("band_index", "s")).withColumn("wavelength_nm", 691.0 + 29.0 * F.col("band_index"))
    q = u.agg(F.percentile("s", 0.97).alias("q"))
    wet = S.water_absorption(F.col("wavelength_nm"))
    return u.join(q, F.lit(True)).select("band_index", "wavelength_nm", r6("s", "uncertainty"), ((F.col("s") >= F.col("q")) | wet).alias("is_low_confidence"), F.when(wet, "water_absorption_or_low_snr").when(F.col("s") >= F.col("q"), "high_noise").otherwise("").alias("reason"))
