import pytest

from lithoframe.llm import containment


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, bound):
    item = "what is the capital of the country of france"
    rows = [(None, f"so {item} then"), (None, "clean words"), (1, f"and {item}"), (1, "more clean words"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = containment.without_items(docs, items, broadcast_bytes=bound).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("1", "more clean words"), ("2", "None"), ("None", "clean words")]
