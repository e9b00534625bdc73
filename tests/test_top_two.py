"""The best of a group and its margin, from aggregates of numbers: no task sorts its rows, and ties and lone rows count."""

from lithoframe.plans import catalogue


def test_ties_lone_rows_and_plan(spark, tmp_path):
    rows = [("A", 5.0, 9, 1), ("A", 7.0, 4, 2), ("A", 7.0, 3, 5), ("B", 2.0, 8, 1), ("B", 1.5, 2, 1), ("C", 3.0, 6, 1), ("D", None, 1, 1), ("D", 4.0, 2, 1)]
    spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double, l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.queries()["topk_with_margin"](spark, str(tmp_path))
    got = {r.l_returnflag: (r.best, r.score, r.margin) for r in df.collect()}
    assert got == {"A": (3, 7.0, 0.0), "B": (8, 2.0, 0.5), "C": (6, 3.0, None), "D": (2, 4.0, None)}
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
