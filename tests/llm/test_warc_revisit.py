import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import warc_revisit as wr

SCHEMA = "id long, ts long, kind string, url string, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, url_key string, block int"


def brute(rows):
    out = []
    for i, ts, kind, url, etag, mod, dig, head, *_ in rows:
        if kind != "revisit" or ts is None or url is None:
            continue
        before = [r for r in rows if r[2] == "response" and r[3] == url and r[1] is not None and r[1] < ts]
        t = max(before, key=lambda r: (r[1], r[0]), default=None)
        if t is None:
            out.append((i, None, "no_response", None))
            continue
        strip = lambda v: v.removeprefix("W/") if v else v
        pair = next(((a, b) for a, b in ((strip(etag), strip(t[4])), (mod, t[5]), (dig, t[6])) if a is not None and b is not None), None)
        how = "unchecked" if pair is None else "validated" if pair[0] == pair[1] else "mismatch"
        h = None
        if how != "mismatch":
            d = {n.lower(): v for n, v in t[7] or []}
            d |= {n.lower(): v for n, v in head or [] if n.lower() in wr.PERMITTED}
            h = tuple(sorted(d.items()))
        out.append((i, t[0], how, h))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [4096, 3, 1])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(wr, "BLOCKS", blocks)
    rng = np.random.default_rng(6)
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    rows = []
    for i in range(700):
        url = pick("hot.example/a", "hot.example/a", "hot.example/a", "b.example/c", f"u{i % 40}.example/z", None)
        head = [(pick("Date", "ETag", "X-A", "vary", "DATE", "Content-Length"), pick("1", "2", "3")) for _ in range(int(rng.integers(0, 5)))]
        rows.append((i, pick(None, *range(60)), pick("response", "revisit", "request"), url, pick(None, "a", "W/a", "b"), pick(None, "x", "y"), pick(None, "p", "q"), pick(None, head, head), "clash", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.id, r.target_id, r.outcome, None if r.headers is None else tuple((h.name, h.value) for h in r.headers)) for r in wr.resolve(df).collect()), key=repr)
    assert got == brute(rows)
    assert wr.resolve(df.limit(0)).count() == 0
    assert wr.resolve(df.union(df).where("kind = 'revisit'")).count() == 2 * len([x for x in rows if x[2] == "revisit" and x[1] is not None and x[3]])


def test_canonical_url(spark):
    same = ["http://WWW.a.example:80/x/?utm_source=q#top", "https://m.a.example/x", "a.example/x/index.html?ref=1", "  https://a.example:443/x.html"]
    other = ["https://a.example/X", "https://a.example/x?page=2", "https://a.example/x?b=1&a=2"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, "https://a.example/x?a=2&b=1", "", None]], "u string")
    got = [r.k for r in df.select(wr.canonical_url(F.col("u")).alias("k")).collect()]
    assert set(got[:4]) == {"a.example/x"} and got[4:7] == ["a.example/X", "a.example/x?page=2", "a.example/x?a=2&b=1"] and got[7] == got[6] and got[8:] == ["", None]
