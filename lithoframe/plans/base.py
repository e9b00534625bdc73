"""Registration of queries with their SQL, and the base tables that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The pixel grid of the embeddings: columns of a row, bands, and the wavelength axis.
WIDTH, BANDS = 20, 64
AXIS = [691.0 + 29.0 * k for k in range(BANDS)]


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, x, label, v (array<double>): embeddings as spectra on a grid."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.expr(f"cast(vec_id div {WIDTH} as int)").alias("y"), F.expr(f"cast(vec_id % {WIDTH} as int)").alias("x"), "label", F.transform("embedding", lambda e: e.cast("double")).alias("v")
    )


PX = f"px AS (SELECT vec_id, CAST(vec_id // {WIDTH} AS INTEGER) AS y, CAST(vec_id % {WIDTH} AS INTEGER) AS x, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)"
#: The four broad planes of a pixel: means of a quarter of its bands each, so a plane query reads all of the table.
QUARTER = [f"(list_sum(v[{BANDS // 4 * k + 1}:{BANDS // 4 * (k + 1)}]) / {BANDS // 4})" for k in range(4)]


def quarter(k: int, v: str = "v") -> Column:
    """The mean of the k-th quarter of the bands."""
    n = BANDS // 4
    return F.aggregate(F.slice(v, n * k + 1, n), F.lit(0.0), lambda t, x: t + x) / n


#: One row per pixel and band, bands from 0.
LONG = PX + f", lg AS (SELECT vec_id, y, x, label, unnest(range({BANDS})) AS band, unnest(v) AS v FROM px)"


def mean_spectrum(df: DataFrame, by: str, v: str = "v", bands: int = BANDS) -> DataFrame:
    """Mean spectrum of each group, as one array: one aggregate a band, summed before the shuffle, no rows exploded."""
    return df.groupBy(by).agg(F.array(*[F.avg(F.col(v)[k]) for k in range(bands)]).alias("reference"))


#: The reference spectrum of each label.
REF = LONG + ", ref AS (SELECT label, list(m ORDER BY band) AS reference FROM (SELECT label, band, avg(v) AS m FROM lg GROUP BY label, band) GROUP BY label)"


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def q6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"
