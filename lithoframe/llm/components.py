"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.textarr import small_batches
from lithoframe.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    small_batches(spark)
    at = f"{shared_dir(spark)}/lithoframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what was made of them has been written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (a, b) over longs to (node, root): each node of an edge with the least node it can reach.

    Loops and repeated edges are allowed; an empty table gives an empty result. A step costs two shuffles of the edges
    and writes them once; the number of steps grows with the logarithm of the longest chain. Minima are summed before
    the shuffle, and a node with very many edges is a skewed side of an equi-join, which Spark splits at run time.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # Large star: neighbours above a node move to the least node around it.
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # Small star: a node and its neighbours below move to the least of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, now = now, written(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(old, least, large, low)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def one_row_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, broadcast_rows: int = 1 << 20) -> DataFrame:
    """The rows of docs with one left of each component, the one of least (non-null id, text hash); of equal rows, one.

    ``found`` has (_i, _h, _c) for each row: its id, the xxhash64 of its text, its component's own identity. Rows to leave
    out are broadcast up to ``broadcast_rows`` of them; beyond that the join is shuffled. Columns stay as they are.
    """
    rows = written(found.groupBy("_i", "_h").agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("n")), "rows")
    least = rows.groupBy("_c").agg(F.min(F.struct(F.col("_i").isNull().alias("none"), "_i", "_h")).alias("m"))
    kept = written(least.select(F.col("m._i").alias("_k"), F.col("m._h").alias("_g")), "kept")
    is_kept = F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g"))
    again = written(rows.where("n > 1").join(kept, is_kept, "left_semi").select("_i", "_h"), "again")
    gone = written(rows.join(kept, is_kept, "left_anti").select("_i", "_h").union(again), "gone")
    drop(rows, kept)
    few = gone.count() <= broadcast_rows

    def same(ids: DataFrame):
        return docs[id_col].eqNullSafe(ids["_i"]) & (F.xxhash64(docs[text_col]) == ids["_h"])

    rest = docs.join(F.broadcast(gone) if few else gone, same(gone), "left_anti")
    if again.isEmpty():
        return rest
    return rest.union(docs.join(F.broadcast(again) if few else again, same(again), "left_semi").dropDuplicates([id_col, text_col]))
