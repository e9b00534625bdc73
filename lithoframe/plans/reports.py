"""Report queries: screening, contracts, comparisons, samples, digests and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithoframe.operators import report as R
from lithoframe.operators.quantiles import quantiles, small
from lithoframe.plans.base import BANDS, PX, pixels, q6, query, r6, table
from lithoframe.plans.base import REF
from lithoframe.plans.statistics import _with_reference
from lithoframe.session import cut

_LIMITS = [("avg_quantity", 20.0, 30.0), ("avg_discount", 0.049, None), ("avg_tax", None, 0.05), ("avg_price", 1.0, 1e9)]
_MET = "m AS (SELECT o_orderpriority AS g, 'avg_quantity' AS metric, avg(l_quantity) AS value FROM j GROUP BY 1 UNION ALL SELECT o_orderpriority, 'avg_discount', avg(l_discount) FROM j GROUP BY 1 UNION ALL SELECT o_orderpriority, 'avg_tax', avg(l_tax) FROM j GROUP BY 1)"
_SCREEN = (
    f"WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_MET}, l(metric, minimum, maximum) AS (VALUES " + ", ".join(f"('{m}', {'NULL' if a is None else repr(a)}::DOUBLE, {'NULL' if b is None else repr(b)}::DOUBLE)" for m, a, b in _LIMITS) + "), "
    "c AS (SELECT g.g, l.metric, m.value, minimum, maximum, m.value IS NOT NULL AS evaluated, m.value >= coalesce(minimum, '-infinity'::DOUBLE) AND m.value <= coalesce(maximum, 'infinity'::DOUBLE) AS within_bound FROM (SELECT DISTINCT g FROM m) g CROSS JOIN l LEFT JOIN m ON m.g = g.g AND m.metric = l.metric) "
)


def _checks(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = d.groupBy(F.col("o_orderpriority").alias("g")).agg(F.avg("l_quantity").alias("avg_quantity"), F.avg("l_discount").alias("avg_discount"), F.avg("l_tax").alias("avg_tax"))
    limits = F.broadcast(spark.createDataFrame(_LIMITS, "metric string, minimum double, maximum double"))
    return R.screen(R.long_rows(w, ["g"], ["avg_quantity", "avg_discount", "avg_tax"]), limits, ["g"], ("avg_price",))


@query(_SCREEN + f"SELECT g, metric, {q6('value', 'value')}, minimum, maximum, evaluated, within_bound, metric = 'avg_price' AS optional FROM c")
def screening_checks(spark, sf_dir):
    """Every metric against its limits; a metric that isn't there is not evaluated."""
    return _checks(spark, sf_dir).withColumn("value", r6("value"))


@query(_SCREEN + "SELECT g, count(*) FILTER (metric <> 'avg_price' AND NOT coalesce(within_bound, true)) AS failed, count(*) FILTER (metric <> 'avg_price' AND evaluated) AS evaluated, CASE WHEN count(*) FILTER (metric <> 'avg_price' AND NOT coalesce(within_bound, true)) = 0 THEN 'within_conservative_screening_bounds' ELSE 'outside_conservative_screening_bounds' END AS status FROM c GROUP BY g")
def screening_rollup(spark, sf_dir):
    """Failed and evaluated checks of a group and its status."""
    return R.screening_status(_checks(spark, sf_dir), ["g"])


@query(
    "WITH m AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'dual-product.v1' END AS v, c_custkey % 3 = 0 AS lost, c_custkey % 4 <> 0 AS rmse, c_custkey % 11 <> 0 AS marked FROM customer), "
    "e AS (SELECT run, v, list_concat(CASE WHEN v = 'other' THEN ['unknown contract version'] ELSE [] END, CASE WHEN lost THEN ['unclassified output gain'] ELSE [] END, CASE WHEN NOT rmse THEN ['previews not excluded from RMSE'] ELSE [] END, CASE WHEN NOT marked THEN ['previews not marked as not quantitative'] ELSE [] END) AS errors FROM m) "
    "SELECT run, v IS NOT NULL AS present, CASE WHEN v IS NOT NULL THEN len(errors) = 0 END AS valid, CASE WHEN v IS NULL THEN '' ELSE array_to_string(errors, '; ') END AS errors FROM e"
)
def contract_rules(spark, sf_dir):
    """Product manifests against the rules of their contract; all broken rules are listed."""
    k = F.col("c_custkey")
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    d = table(spark, sf_dir, "customer").select(
        k.alias("run"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, "other").otherwise("dual-product.v1").alias("contract_version"),
        m("cube", "a.dat", "gain", "g.dat").alias("outputs"),
        F.when(k % 3 == 0, m("cube", "a.dat")).otherwise(m("cube", "a.dat", "gain", "g.dat")).alias("scientific"),
        m("rgb", "p.png").alias("previews"), m("rgb", "p.png").alias("visual"),
        F.when(k % 4 == 0, F.array(F.lit("sam"))).otherwise(F.array(F.lit("rmse"), F.lit("sam"))).alias("exclusions"),
        (k % 11 != 0).alias("not_quantitative"),
    )
    return R.contract_errors(d).withColumn("errors", F.array_join("errors", "; "))


@query(
    "WITH s AS (SELECT l_returnflag AS scene, CASE l_linestatus WHEN 'O' THEN 'v7' ELSE 'v6' END AS version, avg(l_discount) AS value FROM lineitem GROUP BY ALL), p AS (SELECT scene, max(value) FILTER (version = 'v7') AS v7, max(value) FILTER (version = 'v6') AS v6 FROM s GROUP BY scene) "
    f"SELECT scene, {q6('v7', 'v7')}, {q6('v6', 'v6')}, {q6('v7 - v6', 'delta_v6')} FROM p"
)
def version_compare(spark, sf_dir):
    """Metrics of versions side by side with their differences."""
    v = F.when(F.col("l_linestatus") == "O", "v7").otherwise("v6")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scene"), v.alias("version")).agg(F.avg("l_discount").alias("value"))
    c = R.compare_versions(m, ["scene"], ["v7", "v6"])
    return c.select("scene", r6("v7", "v7"), r6("v6", "v6"), r6("delta_v6", "delta_v6"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_path_counts(spark, sf_dir):
    """A value read out of JSON by its path."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def sha256_digest(spark, sf_dir):
    """SHA-256 and size of each text's bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query()
def float32_digests(spark, sf_dir):
    """Digest of each spectrum's canonical float32 bytes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", R.float32_digest(F.col("embedding")).alias("digest"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_returnflag, max(l_orderkey) FILTER (k = 1) AS best, max(l_extendedprice) FILTER (k = 1) AS score, " + q6("max(l_extendedprice) FILTER (k = 1) - max(l_extendedprice) FILTER (k = 2)", "margin") + " FROM r GROUP BY l_returnflag")
def topk_with_margin(spark, sf_dir):
    """Best candidate of a group and its margin over the second: two candidates are kept a group, by partial aggregates."""
    # Maxima of numbers only: a maximum of structs makes Spark sort the rows of every task.
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("p"), "l_orderkey")
    one = cut(d.groupBy(F.col("l_returnflag").alias("flag")).agg(F.max("p").alias("top")))
    best = F.col("p").eqNullSafe(F.col("top"))
    met = d.join(small(one, one.count()), F.col("l_returnflag").eqNullSafe(F.col("flag")))
    two = met.groupBy("l_returnflag").agg(F.max("top").alias("score"), F.min(F.when(best, F.col("l_orderkey"))).alias("best"), F.count_if(best).alias("n"), F.max(F.when(~best, F.col("p"))).alias("p"))
    return two.select("l_returnflag", "best", "score", r6(F.col("score") - F.when(F.col("n") > 1, F.col("score")).otherwise(F.col("p")), "margin"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE r IN (SELECT CAST(round_even(unnest(range(100)) * (SELECT any_value(n) - 1 FROM r) / 99.0, 0) AS BIGINT))")
def spaced_subsample(spark, sf_dir):
    """A hundred rows evenly spaced along a key."""
    return R.spaced_sample(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@query()
def hash_sample(spark, sf_dir):
    """A hundred rows by a seeded hash of the key."""
    return R.hash_sample(table(spark, sf_dir, "orders"), "o_orderkey", 100, 17).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def declared_without_output(spark, sf_dir):
    """Declared members that have no counterpart (anti-join)."""
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def planned_existing_conflicts(spark, sf_dir):
    """Planned outputs that exist already (semi-join)."""
    planned = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return R.planned_conflicts(planned, table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("path"))).withColumnRenamed("path", "c_custkey")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size = 50")
def control_point_union(spark, sf_dir):
    """Distinct union of two sets of keys."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")).union(table(spark, sf_dir, "part").where("p_size = 50").select("p_partkey")).distinct()


@query("(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25)")
def mask_intersection(spark, sf_dir):
    """Keys that pass both of two masks."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey"))


@query("SELECT o_orderpriority, count(DISTINCT o_orderstatus) = 1 AS single FROM orders GROUP BY o_orderpriority")
def single_run_check(spark, sf_dir):
    """Whether a group's rows all come from one run."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.count_distinct("o_orderstatus") == 1).alias("single"))


@query("SELECT l_orderkey, coalesce(bool_and(p IS NULL OR l_linenumber > p), true) AS increasing FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM lineitem) GROUP BY l_orderkey")
def strictly_increasing(spark, sf_dir):
    """Whether an axis rises strictly within each group."""
    return R.increasing(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query(
    f"WITH {REF}, z AS (SELECT label, unnest(range({BANDS})) AS band, unnest(v) AS a, unnest(reference) AS b FROM px JOIN ref USING (label)), m AS (SELECT band, avg((a - b) * (a - b)) AS mse, max(a) AS peak, avg(a) AS mean FROM z GROUP BY band) "
    f"SELECT {q6('avg(20 * log10(peak) - 10 * log10(mse))', 'mean_psnr')}, {q6('100.0 / 4 * sqrt(avg(mse / (mean * mean)))', 'ergas')}, {q6('sqrt(avg(mse))', 'rmse')} FROM m"
)
def psnr_ergas(spark, sf_dir):
    """Peak signal-to-noise ratio and relative global error of a candidate cube."""
    d = _with_reference(spark, sf_dir)
    a, b = (lambda k: F.col("v")[k]), (lambda k: F.col("reference")[k])
    one = d.agg(F.array(*[F.struct(F.avg((a(k) - b(k)) ** 2).alias("mse"), F.max(a(k)).alias("peak"), F.avg(a(k)).alias("mean")) for k in range(BANDS)]).alias("m"))
    m = one.select(F.explode("m").alias("m")).select("m.*")
    return m.agg(r6(F.avg(R.psnr(F.col("mse"), F.col("peak"))), "mean_psnr"), r6(25.0 * F.sqrt(F.avg(F.expr("mse / (mean * mean)"))), "ergas"), r6(F.sqrt(F.avg("mse")), "rmse"))


@query(
    f"WITH {PX}, c AS (SELECT label, 'zero' AS candidate, avg(v[1] * v[1]) AS mse FROM px GROUP BY label UNION ALL SELECT label, 'neighbour', avg((v[1] - v[2]) * (v[1] - v[2])) FROM px GROUP BY label UNION ALL SELECT label, 'half', avg(v[1] * v[1] / 4) FROM px GROUP BY label) "
    f"SELECT a.label, a.candidate, {q6('sqrt(a.mse)', 'rmse')}, {q6('100 * (sqrt(b.mse) - sqrt(a.mse)) / sqrt(b.mse)', 'gain_percent')} FROM c a JOIN c b ON a.label = b.label AND b.candidate = 'zero'"
)
def candidate_deltas(spark, sf_dir):
    """Errors of stacked candidates and their gain over a baseline one."""
    v = F.col("v")
    c = pixels(spark, sf_dir).groupBy("label").agg(F.avg(v[0] * v[0]).alias("zero"), F.avg((v[0] - v[1]) ** 2).alias("neighbour"), F.avg(v[0] * v[0] / 4).alias("half"))
    base = F.sqrt("zero")
    rows = c.withColumn("base", base).select("label", "base", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.sqrt(n).alias("e")) for n in ("zero", "neighbour", "half")])).alias("s"))
    return rows.select("label", "s.candidate", r6("s.e", "rmse"), r6(100 * (F.col("base") - F.col("s.e")) / F.col("base"), "gain_percent"))


@query(f"WITH {PX} SELECT vec_id, forall AS scored FROM (SELECT vec_id, y >= 2 AND x >= 2 AND x < 18 AND y <= (SELECT max(y) FROM px) - 2 AND len(list_filter(v, lambda e: e IS NULL)) = 0 AS forall FROM px)")
def evaluation_mask(spark, sf_dir):
    """Pixels known in all bands and off the margin."""
    px = pixels(spark, sf_dir)
    m = px.agg(F.max("y").alias("my"))
    y, x = F.col("y"), F.col("x")
    return px.join(F.broadcast(m), F.lit(True)).select("vec_id", ((y >= 2) & (x >= 2) & (x < 18) & (y <= F.col("my") - 2) & F.forall("v", lambda e: e.isNotNull())).alias("scored"))


@query(
    f"WITH {PX}, s AS (SELECT vec_id, list_sum(v) / 64 AS m, sqrt(list_sum(list_transform(v, lambda e: e * e)) / 64) AS r FROM px), q AS (SELECT quantile_cont(m, [0.18, 0.5, 0.82]) AS q FROM s), t AS (SELECT unnest([0, 1, 2]) AS pick, unnest(q) AS target FROM q), k AS (SELECT pick, vec_id, row_number() OVER (PARTITION BY pick ORDER BY round(r, 9) DESC, vec_id) AS k FROM s, t WHERE abs(m - target) <= 0.01) SELECT pick, vec_id FROM k WHERE k = 1"
)
def representative_spectra(spark, sf_dir):
    """Of the spectra near three brightness quantiles, the most variable one each."""
    from lithoframe.functions import vectors as V

    s = pixels(spark, sf_dir).select("vec_id", (V.total(F.col("v")) / 64).alias("m"), F.sqrt(V.dot(F.col("v"), F.col("v")) / 64).alias("r"))
    t = quantiles(s, [], {"q": F.col("m")}, [0.18, 0.5, 0.82]).select(F.posexplode("q").alias("pick", "target"))
    near = s.join(F.broadcast(t), F.abs(F.col("m") - F.col("target")) <= 0.01)  # three targets
    return near.groupBy("pick").agg(F.min_by("vec_id", F.struct((-F.round("r", 9)).alias("r"), "vec_id")).alias("vec_id"))


@query("WITH w AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM conversations) SELECT conv_id, turn, n, CAST(cumulative AS BIGINT) AS cumulative FROM w")
def cumulative_history(spark, sf_dir):
    """Running total along an ordered history."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.sum(F.length("text").cast("long")).over(w).alias("cumulative"))
