"""All eleven registered queries over tables with nulls in every column, repeated rows, clashing columns, and over empty tables."""

import os

import pytest

import corpus_pipeline
from lithoframe.llm import registry
from lithoframe.llm.textarr import table

QUERIES = registry.queries() | {"pipeline": corpus_pipeline.run}
pytestmark = pytest.mark.skipif(not os.path.exists(registry.TOKENIZER), reason="no tokenizer files")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, b int, component_id string, unit string, item_id string"
PAGES = "page_id long, url string, html string, text string, host string, ts string"
LABELS = "doc_id long, quality int, toxic int, text string"
ITEMS = "item_id long, text string, doc_id long"


def write(spark, at, docs, pages, labels, items):
    for name, rows, schema in (("documents", docs, DOCS), ("pages", pages, PAGES), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    x = ("s", 1, "c", "u", "i")
    docs = [(k, f"plain words of text number {k} that go on for a while here", "en" if k % 2 else None, "a", 9, *x) for k in range(40)]
    docs += [(100 + k, f"wörter auf deutsch die hier nummer {k} stehen und bleiben", "de", None, None, *x) for k in range(40)]
    docs += [(None, "a row without id", None, None, None, *[None] * 5), (None, None, None, None, None, *[None] * 5), (200, None, "en", "a", 0, *x), (201, "", "en", "a", 0, *x), (202, "\n \t", "en", "a", 3, *x)]
    docs += [docs[3]] * 3 + [(300, docs[3][1], "en", "a", 9, *x), (301, "long tail " * 60_000 + "token=abcdef1234567", "en", "a", 9, *x), (302, "say one two three four five six seven eight nine ten now", "en", "a", 9, *x), (303, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "en", "a", 9, *x)]
    pages = [(k, f"https://h.example/{k}", f"<html><body><nav>m</nav><article><p>text {k}</p></article></body></html>", "t", "h", "z") for k in range(9)]
    pages += [(None, None, None, None, None, None), (50, None, "<p>x", "t", "h", "z"), (51, "https://h.example/3", None, "t", "h", "z"), pages[2], pages[2]]
    labels = [(k, k % 2, 0, "t") for k in range(60)] + [(None, 1, 0, None), (7, None, None, None), (200, 0, 0, "t"), (5, 1, 0, "t"), (5, 1, 0, "t")]
    items = [(1, "one two three four five six seven eight nine ten", 4), (2, None, None), (None, "one two three four five six seven eight nine ten", 1), (3, "", 2), (1, "one two three four five six seven eight nine ten", 9)]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, pages, labels, items)


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("bare"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, bare, name):
    assert QUERIES[name](spark, bare).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    docs, pages = table(spark, odd, "documents").count(), table(spark, odd, "pages").count()
    many = {"op1_sentencepiece": docs, "op2_language_id": docs, "op4_quartile_digest": docs, "op5_main_text": pages, "op7_secret_scan": docs, "op8_simhash": docs, "op9_quality": docs}
    if name in many:
        assert len(rows) == many[name]
    if name == "op6_contained_items":
        assert sorted((r.doc_id, str(r.item_id)) for r in rows) == [(302, "1"), (302, "None")]
    if name == "op10_license_scan":
        assert sorted((r.doc_id, r.place, r.license) for r in rows) == [(303, 0, "MIT"), (303, 1, "CC-BY-NC-4.0")]
    if name == "op8_simhash":
        assert {r.component_id for r in rows if r.doc_id in (3, 300)} == {3} and {r.fingerprint for r in rows if r.doc_id in (200, 201, 202)} == {"0" * 16}
    if name == "op2_language_id":
        by = {r.doc_id: r for r in rows}
        assert by[200].lang_pred == by[201].lang_pred == by[202].lang_pred == "und" and all(by[k].lang_pred == "de" for k in range(100, 140))
    if name == "pipeline":
        ids = [r.doc_id for r in rows]
        assert ids.count(3) <= 1 and 302 not in ids and 300 not in ids
