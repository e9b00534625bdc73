import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import langid_ecoc as li
from lithoframe.llm import mil_quality as mq
from lithoframe.llm import registry

DIR = "/root/testdata/sf0.001"


def test_language_sample_holds_for_one_id_on_very_many_rows(spark):
    docs = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    got = li.sample(docs, "text", "lang", "doc_id", per_lang=200)
    assert 250 < len(got) < 550
    same = docs.withColumn("text", F.lit("the same words on every row"))
    assert len(li.sample(same.where("lang = 'de'"), "text", "lang", "doc_id", per_lang=10**6)) == 1


def test_language_sample_holds_for_many_languages(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    got = li.sample(docs, "text", "lang", "doc_id", fit_bytes=12 << 20)
    assert len({r.l for r in got}) > 250 and sum(len(r.x) for r in got) <= 1.3 * (12 << 20)


def test_quality_sample_holds_for_one_id_on_very_many_rows(spark):
    docs = spark.range(50_000).select(F.when(F.col("id") < 49_900, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).where("doc_id = 1 or doc_id >= 49900")
    got = mq.sample(docs, labels, max_docs=500)
    assert 300 < len(got) < 700
    assert len(mq.sample(docs.withColumn("text", F.lit("same")).where("doc_id = 1"), labels)) == 1


def plain_language(model, text):
    """The decoding of one text in plain Python."""
    b = text.encode()
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    fold = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b]
    windows = max(1, -(-len(b) // li.WINDOW))
    padded, total, weight = [32, *fold, 32], np.zeros(len(model.langs)), 0.0
    counts, letters = np.zeros((windows, li.DIM)), [0] * windows
    for k in range(len(padded)):
        w = min(k // li.WINDOW, windows - 1)
        letters[w] += padded[k] != 32
        g = 0
        for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
            if k + n <= len(padded):
                g = (g << 8) | padded[k + n - 1]
                counts[w, (g * salt & 0xFFFFFFFF) >> (32 - li.BITS)] += 1
    for w in range(windows):
        x = np.sqrt(counts[w])
        z = (x / np.sqrt((x * x).sum())) @ model.w.astype(float) + model.bias
        loss = np.array([sum(math.log1p(math.exp(-z[j] * model.code[k][j])) * model.weight[j] for j in range(len(z))) for k in range(len(model.langs))])
        p = np.exp((loss.min() - loss) * 4 / len(z))
        total += letters[w] * p / p.sum()
        weight += letters[w]
    return model.langs[int(total.argmax())], total.max() / weight


def plain_quality(model, text):
    """The attention of one text in plain Python, passage by passage."""
    h, a = [], []
    for x in mq.encode(np.frombuffer((text or "").encode(), np.uint8)).astype(float):
        v = [max(0.0, float(x @ model.E[:, k]) + float(model.e[k])) for k in range(len(model.e))]
        t = [math.tanh(sum(v[j] * float(model.V[j, k]) for j in range(len(v)))) for k in range(len(model.w))]
        s = [1 / (1 + math.exp(-sum(v[j] * float(model.U[j, k]) for j in range(len(v))))) for k in range(len(model.w))]
        h.append(v)
        a.append(sum(p * q * float(w) for p, q, w in zip(t, s, model.w)))
    e = [math.exp(x - max(a)) for x in a]
    z = [sum(p * v[k] for p, v in zip(e, h)) / sum(e) for k in range(len(model.c))]
    return 1 / (1 + math.exp(-sum(p * float(q) for p, q in zip(z, model.c)) - float(model.d[0])))


def test_queries_against_plain_forward_passes(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = sorted(texts, key=lambda i: len(texts[i] or ""))[:60]
    held = F.pmod(registry.id_text_crc(F.col("doc_id")), F.lit(3)) == 1
    model = li.fit(docs.where(~held), "text", "lang", "doc_id")
    got = {r.doc_id: r for r in registry.op2_language_id(spark, DIR).collect()}
    for i in short:
        lang, score = plain_language(model, texts[i] or "")
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4)
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where(F.pmod(registry.id_text_crc(F.col("doc_id")), F.lit(5)) != 0)
    model = mq.fit(docs, labels)
    got = {r.doc_id: r for r in registry.op9_quality(spark, DIR).collect()}
    for i in short:
        assert got[i].score == pytest.approx(plain_quality(model, texts[i]), abs=1e-4) and got[i].predicted == (got[i].score >= 0.3)
