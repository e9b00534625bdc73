import duckdb
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import warc_revisit as wr

SCHEMA = "id long, ts long, kind string, url string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>"


def test_blocks_are_even_whatever_the_clocks_say(spark, monkeypatch):
    monkeypatch.setattr(wr, "BLOCKS", 64)
    ts = [0, 2**60, -5] + [1_700_000_000 + k for k in range(10_000)]
    df = spark.createDataFrame([(t,) for t in ts], "ts long").select("ts", "ts")
    df = df.toDF("ts", "x")
    sizes = [r.n for r in df.withColumn("b", wr.time_block(df)).groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 50 and max(sizes) < 400
    got = sorted(r.b for r in df.withColumn("b", wr.time_block(df)).orderBy("ts").collect())
    assert got == [r.b for r in df.withColumn("b", wr.time_block(df)).orderBy("ts").collect()]


def test_error_and_partial_responses_are_not_full(spark):
    rows = [(1, 10, "response", "a.example/x", "e1", None, None, None, 200), (2, 20, "response", "a.example/x", "e1", None, None, None, 206), (3, 30, "response", "a.example/x", "e1", None, None, None, 503), (4, 35, "response", "a.example/x", "e1", None, None, None, None), (5, 40, "revisit", "a.example/x", "e1", None, None, None, 304)]
    df = spark.createDataFrame(rows, SCHEMA + ", status int")
    assert [(r.target_id, r.outcome) for r in wr.resolve(df).collect()] == [(1, "validated")]
    assert [(r.target_id, r.outcome) for r in wr.resolve(df.drop("status")).collect()] == [(4, "validated")]


@pytest.mark.parametrize("many", [0, 400])
def test_pages_without_url_have_a_row_as_in_sql(spark, many):
    rows = [(k, None if k % 3 == 0 else f"https://a.example/{k % 5}", f"<p>{k}") for k in range(40)] + [(1000 + k, None, "<p>") for k in range(many)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(str, (tuple(r) for r in wr.resolved_pages(pages).collect())))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    names = "id, url_key, ts, target_id, target_ts, outcome, headers"
    assert got == sorted(map(str, con.sql(f"SELECT {names} FROM ({wr.ORACLE})").fetchall())) and len(got) == 40 + many
