import pytest

from lithoframe.llm import simhash_pigeonring as sh

TEXTS = [f"{w} stands alone in a text of its own about {w}s and {w} matters" for w in ("apple", "bridge", "candle", "desert", "engine")]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_different_texts_under_null_and_equal_ids_stay(spark, bound):
    rows = [(None, t, "a") for t in TEXTS[:3]] + [(7, TEXTS[3], "a"), (7, TEXTS[4], "a")]
    rows += [(None, TEXTS[0], "b"), (7, TEXTS[4], "b"), (8, TEXTS[3], "c"), (3, TEXTS[2], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    got = sorted(((r.doc_id, r.text) for r in sh.one_of_each(docs, broadcast_rows=bound).collect()), key=str)
    assert got == sorted([(None, TEXTS[0]), (None, TEXTS[1]), (3, TEXTS[2]), (7, TEXTS[3]), (7, TEXTS[4])], key=str)
