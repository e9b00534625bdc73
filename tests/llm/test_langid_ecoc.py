import numpy as np
import pytest

from lithoframe.llm import langid_ecoc as li

SAY = {"aa": "tora mira sona kela pita ", "bb": "ghuz xyrr wott zegg quox ", "cc": "eìn üßer öft jäh ñu çe ", "dd": "μία δύο τρία λόγος "}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = sorted(SAY)[i % 4]
        w = SAY[lang].split()
        rows.append((i, " ".join(rng.choice(w, 12)), lang, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 7, 12):
        m = li.codewords(k)
        far = (m[:, None] != m[None]).sum(2) + np.eye(k, dtype=int) * 99
        assert far.min() >= max(1, m.shape[1] // 4) and m.shape[0] == k


def test_bit_errors_are_corrected():
    code = li.codewords(4)
    m = li.Ecoc(list("abcd"), code, np.eye(7, dtype=np.float32), np.zeros(7, np.float32), np.ones(7))
    for k in range(4):
        for flip in range(7):
            x = code[k].astype(np.float32) * 4
            x[flip] *= -0.5
            assert m.shares(x[None])[0].argmax() == k


def test_held_out_accuracy_and_edges(spark, docs):
    model = li.fit(docs.where("doc_id % 3 <> 1"), "text", "lang", "doc_id")
    got = li.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 240 and np.mean([r.lang == r.lang_pred for r in got if r.doc_id % 3 == 1]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "ghuz " * 300_000), (4, "ghuz " * 300_000), (5, "Ω")], "doc_id long, text string")
    by = {r.doc_id: r for r in li.identify(odd, model).collect()}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0.0 and by[4].lang_pred == "bb"
    assert li.identify(odd, model).count() == 6 and li.identify(odd.limit(0), model).count() == 0


def test_passages_count_by_their_length(spark, docs):
    model = li.fit(docs, "text", "lang", "doc_id")
    mixed = (SAY["aa"] * 90 + SAY["cc"] * 40).encode()
    b = np.frombuffer(mixed, np.uint8)
    assert model.decode(b, 0.1)[0] == "aa" and model.decode(b, 0.1)[1] < 0.95
    assert model.decode(b, 0.1, block=li.WINDOW * 2)[:1] == model.decode(b, 0.1)[:1]
    even = np.frombuffer((SAY["aa"] * 60 + SAY["bb"] * 64).encode(), np.uint8)
    assert model.decode(even, 0.2)[2]


def test_no_labels_and_one_language(spark, docs):
    none = li.fit(docs.where("lang is null"), "text", "lang", "doc_id")
    assert none is None and {r.lang_pred for r in li.identify(docs, none).collect()} == {"und"}
    one = li.fit(docs.where("lang = 'aa'"), "text", "lang", "doc_id")
    assert {(r.lang_pred, r.score) for r in li.identify(docs, one).collect()} == {("aa", 1.0)}
