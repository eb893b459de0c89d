import numpy as np

from upkeep.llm import langid

from ..conftest import SF_MID, SF_SMALL

RNG = np.random.default_rng(5)


def test_gradient_by_finite_differences():
    model = langid.train([b"ab cd", b"xy zw"], ["p", "q"], hidden=3, epochs=0)
    model = langid.Model([a.astype(np.float64) for a in model.table], [a.astype(np.float64) for a in model.state],
                         model.out.astype(np.float64), model.bias.astype(np.float64), model.langs)
    x, label = RNG.integers(97, 101, (3, 6)), np.array([0, 1, 0])
    grads, _ = langid._grad(model, x, label)
    for array, grad in zip(model.arrays(), grads):
        for at in [tuple(RNG.integers(0, s) for s in array.shape) for _ in range(6)]:
            at = (97, *at[1:]) if array.shape[0] == 256 else at
            keep, step = array[at], 1e-4
            array[at] = keep + step
            up = langid._grad(model, x, label)[1]
            array[at] = keep - step
            down = langid._grad(model, x, label)[1]
            array[at] = keep
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-4


def test_document_probabilities_pool_every_position():
    model = langid.train([b"ab" * 30, b"xy" * 30], ["p", "q"], epochs=1)
    texts = [b"", b"ab", b"abxy" * 100, b"x" * 97]
    got = langid.document_probs(model, texts)
    for t, p in zip(texts, got):
        x, _ = langid.windows([t])
        want = np.concatenate([langid.position_probs(model, w[None])[:, :, 0] for w in x])[:len(t)] if t else None
        assert np.allclose(p, want.mean(axis=0) if t else 0, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = out.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert right >= 0.9 * n
    assert out.where("score < 0 or score > 1").isEmpty()


def test_no_letter_is_undetermined(spark):
    docs = spark.createDataFrame([(1, None), (2, "12 34 !?"), (3, "the dog")], "doc_id bigint, text string")
    model = langid.train([b"the cat and the dog", b"der Hund und die Katze"] * 4, ["en", "de"] * 4)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert out[1] == out[2] == "und" and out[3] in ("en", "de")
    assert langid.identify(docs.withColumn("lang", docs.text.substr(1, 0)).limit(0)).collect() == []


def test_gibberish_goes_and_texts_stay(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text", "lang")
    clean = [r["text"] for r in docs.where("length(text) > 300 and lang is not null").orderBy("doc_id").collect()]
    planted = ["".join(RNG.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 900)),
               "".join(RNG.choice(list("0123456789abcdef"), 700)), "".join(RNG.permutation(list(clean[0][:2000]))),
               "".join(RNG.choice(list("asdfghjkl qwertyuiop"), 500)),
               "Вчера вечером жители города собрались возле ратуши, потому что мэр объявил о перестройке моста. " * 3,
               "昨天晚上,市民们聚集在市政厅前,因为市长宣布要重建那座古老的桥。" * 4]
    mixed = [a[:250] + " " + b[:250] for a, b in zip(clean[:20], clean[20:40])]
    more = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(planted)]
                                 + [(20_000 + i, t, None) for i, t in enumerate(mixed)], docs.schema)
    left = {r["doc_id"] for r in langid.accepted(docs.unionByName(more)).select("doc_id").collect()}
    assert not {i for i in left if 10_000 <= i < 20_000}
    assert len([i for i in left if i >= 20_000]) == len(mixed)
    ids = {r["doc_id"] for r in docs.where("length(text) > 300 and lang is not null").collect()}
    assert len(ids & left) >= 0.98 * len(ids)
