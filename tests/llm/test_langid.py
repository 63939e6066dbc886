from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.queries import op1_language_id

DATA = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 60):
        code = langid.codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
        assert code.shape[0] == n and set(code.ravel()) <= {-1, 1} and apart.min() >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    found = op1_language_id(spark, DATA)
    assert found.count() == truth.count()
    got = found.where("held_out").join(truth.where("lang IS NOT NULL"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    assert found.where("score < 0 OR score > 1").count() == 0
    assert found.where("held_out != (crc32(cast(doc_id AS string)) % 4 = 2)").count() == 0


def test_predictions_use_the_text_alone(spark, edge):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(langid.training_rows(docs), "text", "lang", F.col("doc_id"))
    found = langid.identify(edge, model).collect()
    assert len(found) == edge.count()
    other = edge.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    again = langid.identify(other, model).collect()
    key = lambda rows, less: sorted(((r.doc_id or less) - less, r.lang_pred, r.score) for r in rows)
    assert key([r for r in found if r.doc_id is not None], 0) == key([r for r in again if r.doc_id is not None], 7)
    undetermined = {r.doc_id for r in found if r.lang_pred == "und"}
    assert undetermined == {0, 1, 2, 3, 8} and all(r.score == 0 for r in found if r.lang_pred == "und")


def test_nothing_to_learn(spark, edge, nothing):
    assert langid.fit(nothing, "text", "lang", F.col("doc_id")) is None
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}
    assert langid.identify(nothing, None).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    texts = pa.array(["abc" * 50, "", "xyz" * 70, None, "q"])
    weights = np.random.default_rng(1).normal(size=(len(langid.ORDERS), langid.BUCKETS, 3)).astype(np.float32)
    model = langid.LanguageModel(["a"], np.ones((1, 3)), weights, np.ones(3))
    whole = model.margins(texts)
    monkeypatch.setattr(langid, "_CHUNK", 64)
    assert np.allclose(whole, model.margins(texts))
    alone = [model.margins(texts.slice(i, 1))[0] for i in range(5)]
    assert np.allclose(whole, alone)


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some text", "en") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.fit(docs, "text", "lang", F.col("doc_id"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()} == {("en", 1.0)}


def many_labels(n, each):
    """Texts of n labels, each of letters of its own mixture, and some without letters."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:8]
        for _ in range(each):
            rows.append((len(rows), " ".join("".join(rng.choice(letters, 5)) for _ in range(80)), f"l{i:03d}"))
    return rows


@pytest.mark.parametrize("broadcast", [1 << 16, 10])
def test_every_label_is_learned(spark, monkeypatch, broadcast):
    monkeypatch.setattr(langid, "BROADCAST_LABELS", broadcast)
    rows = many_labels(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.fit(docs, "text", "lang", F.col("doc_id"))
    assert model.languages == sorted({r[2] for r in rows}) and model.code.shape[0] == 300
    truth = {i: lang for i, _, lang in rows}
    found = langid.identify(docs, model).collect()
    assert len({r.lang_pred for r in found}) > 280
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) > 0.9 * len(found)


def test_memory_does_not_grow_with_the_languages():
    import tracemalloc

    code = langid.codewords(300)
    weights = np.random.default_rng(1).normal(size=(len(langid.ORDERS), langid.BUCKETS, code.shape[1])).astype(np.float32)
    model = langid.LanguageModel([f"l{i}" for i in range(300)], code, weights, np.linspace(0.1, 1, code.shape[1]))
    texts = pa.array([f"some short text {i}" for i in range(10_000)])
    tracemalloc.start()
    margin = model.margins(texts)
    best, score, _ = model.scores(margin)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    loss = np.array([(np.exp(-np.clip(m * code, -8, 8)) * model.bit_weight).sum(axis=1) for m in margin[:200]]) / model.bit_weight.sum()
    assert (best[:200] == loss.argmin(axis=1)).all()
    assert np.allclose(score[:200], 1 / np.exp(-4 * (loss - loss.min(axis=1, keepdims=True))).sum(axis=1))


def test_least_apart():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 2, (1500, 40)) * 2 - 1
    apart = (code[:, None, :8] != code[None, :, :8]).sum(axis=2)[~np.eye(1500, dtype=bool)]
    assert langid.least_apart(code[:, :8]) == apart.min()
    assert langid.codewords(9000).shape == (9000, 132)
