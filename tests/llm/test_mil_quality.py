import numpy as np
import pytest

from lithoframe.llm import mil_quality as mq


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    good = "the river runs past a mill and over stones into the town where people meet"
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(good.split(), 40 + i % 200))
        bad = i % 3 == 0
        if bad:  # one bad stretch anywhere in the document
            at = int(rng.integers(0, len(words)))
            words[at : at + 12] = [w.upper() + "!!" for w in words[at : at + 12]] or ["X!!"]
        rows.append((i, " ".join(words), "q"))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, quality string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.random((k, mq.DIM)).astype(np.float32) for k in (1, 3, 2)]
    y = np.array([1, 0, 1], np.float32)

    def loss(m):
        out = 0.0
        for b, t in zip(bags, y):
            h, _, _, a = m.forward(b)
            p = np.exp(a - a.max())
            s = 1 / (1 + np.exp(-((p / p.sum()) @ h @ m.c + m.d[0])))
            out -= float(t * np.log(s) + (1 - t) * np.log(1 - s))
        return out

    m = mq.Attention()
    before = loss(m)
    assert loss(m.fit(bags, y, epochs=40)) < 0.2 * before


def test_held_out_accuracy(spark, data):
    docs, labels = data
    model = mq.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = docs.select("doc_id", mq.score("text", model, spark).alias("s")).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([(r.s >= 0.5) == bool(r.quality) for r in got]) > 0.9


def test_blocks_equal_whole(spark, data):
    docs, labels = data
    model = mq.fit(docs, labels)
    b = np.frombuffer(("some words go here THERE!! " * 400).encode(), np.uint8)
    assert model.score(b, block=mq.PASSAGE * 4) == pytest.approx(model.score(b), abs=1e-3)


def test_edges(spark, data):
    docs, labels = data
    model = mq.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (4, "x y " * 500_000)], "doc_id long, text string")
    got = odd.select("doc_id", mq.score("text", model, spark).alias("s")).collect()
    assert len(got) == 5 and all(0 <= r.s <= 1 for r in got)
    by = {r.doc_id: r.s for r in got}
    assert by[1] == by[2]
    assert odd.limit(0).select(mq.score("text", model, spark)).count() == 0
    assert mq.fit(docs, labels.limit(0)).constant == 0.5
    assert mq.fit(docs, labels.where("quality = 1")).constant == 1.0
