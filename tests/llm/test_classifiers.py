"""Held-out accuracy of the three classifiers, on the driver's tables and on odd rows."""

import os
import zlib

import numpy as np
import pytest

from robustclust.llm import langid, learning, quality, toxicity

from .conftest import ODD

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


@needs_tables
def test_quality(tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    assert 0.7 < model["prior"] < 0.97
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert learning.area_under_curve(np.array([r["quality"] for r in held]), np.array([r["score"] for r in held])) > 0.97
    assert np.mean([(r["score"] >= 0.7) == r["predicted"] for r in rows]) == 1
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


@needs_tables
def test_toxicity(tables):
    docs, labels = tables
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert learning.area_under_curve(np.array([r["toxic"] for r in held]), np.array([r["score"] for r in held])) > 0.8
    assert all((r["score"] >= 0.3) == r["predicted"] and 0 <= r["score"] <= 1 for r in rows)


@needs_tables
def test_language(tables):
    docs, _ = tables
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_odd_rows(spark, documents):
    docs = documents([*ODD, (30, "123 !!"), (31, "漢字"), (32, "text", None)])
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] * 2, "doc_id long, quality int, toxic int")
    n = docs.count()
    assert quality.score(docs, quality.fit(docs, labels)).count() == n
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(got) == n - 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 30)) and got[31]["lang_pred"] == "en"


def test_empty_tables(spark, documents):
    docs, labels = documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert langid.predict(docs, langid.fit(docs)).count() == 0
    some = documents(ODD)
    assert {r["score"] for r in quality.score(some, quality.fit(some, labels)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(some, toxicity.fit(some, labels)).collect()} == {0.0}
    assert quality.keep_good(some, labels).count() == len(ODD)


def test_codes():
    for n in (2, 3, 4, 6, 9, 20):
        m = langid.code_matrix(n)
        assert m.shape[0] == n and len({tuple(r) for r in m}) == n and (np.abs(m.sum(axis=0)) < n).all()
    assert langid.code_matrix(4).shape == (4, 7)


def test_decoding_corrects_a_wrong_bit():
    codes = langid.code_matrix(4)
    margins = 3.0 * codes[2:3].astype(float)
    margins[0, 1] *= -1
    best, score, lead = langid.decode(margins, codes, np.full(7, 1 / 7))
    assert best[0] == 2 and 0 < score[0] <= 1 and lead[0] > 0


def test_risk_is_not_overfitted():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (300, 2))
    unl = rng.permutation(np.concatenate([rng.normal(1.5, 1, (700, 2)), neg]))
    first = quality.fit_network(pos[:150], unl[:500], None, epochs=20)
    prior = quality.estimate_prior(quality.network(first, pos[150:]), quality.network(first, unl[500:]))
    assert 0.4 < prior < 0.95
    model = quality.fit_network(pos, unl, 0.7, epochs=40)
    assert (quality.network(model, pos) > 0).mean() > 0.9 and (quality.network(model, neg) > 0).mean() < 0.15


def test_gradients_of_the_network():
    """Training separates texts by one word, wherever it stands."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(400):
        w = rng.integers(1, 500, 30).astype(np.int32)
        if i % 4 == 0:
            w[rng.integers(30)] = 777
        texts.append((w, (w % 64).astype(np.int32)))
        y.append(float(i % 4 == 0))
    y = np.array(y, np.float32)
    net = toxicity.Network()
    net.train(texts, y, np.ones(400, np.float32), epochs=6)
    first = np.arange(0, 30 * 401, 30)
    logit = net.logits(np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]), first, net.tables())
    assert learning.area_under_curve(y, logit) > 0.97


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("kind", ["quality", "langid", "toxicity"])
def test_results_do_not_depend_on_partitioning(spark, kind):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")

    def results(n):
        d, t = docs.repartition(n, "n_chars"), labels.repartition(n)
        if kind == "langid":
            out = langid.predict(d, langid.fit(d))
        elif kind == "quality":
            out = quality.score(d, quality.fit(d, t))
        else:
            out = toxicity.score(d, toxicity.fit(d, t))
        return sorted(tuple(r)[:1] + tuple(round(x, 9) if isinstance(x, float) else x for x in tuple(r)[1:]) for r in out.collect())

    first = results(1)
    assert first == results(5) == results(50)


def column_of(texts):
    import pyarrow as pa

    from robustclust.llm.textops import column_bytes

    return column_bytes(pa.array(texts))


TEXTS = [None, "", " ", "One two two THREE!", "a|b #x 12 é漢 \n\nnext line.", "word " * 3000, "x", "same same Same @"]


def test_surface_features_by_hand():
    got = quality.surface_features(*column_of(TEXTS))
    names = list(quality.CLASSES)
    for text, row in zip(TEXTS, got, strict=True):
        raw = (text or "").encode()
        kinds = [sum(quality.CLASSES[n](b) for b in raw) for n in names]
        w = [x for x in __import__("re").split(rb"[ \t-\r]+", raw) if x]
        n = max(len(w), 1)
        low = [x.lower() for x in w]
        mean = sum(map(len, w)) / n
        want = [k / max(len(raw), 1) * 4 for k in kinds]
        want += [np.log1p(len(w)) / 4, np.log1p(len(raw)) / 6, kinds[0] / max(kinds[0] + kinds[1] + kinds[8], 1), mean / 8, min(mean, 30) ** 2 / 200]
        want += [len(set(low)) / n, np.log1p(len(set(low))) / 4, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n]
        want += [sum(65 <= x[0] <= 90 for x in w) / n, sum(quality.CLASSES["mark"](x[-1]) for x in w) / n]
        assert row == pytest.approx(want, abs=1e-5), text


def test_trigram_features_by_hand():
    got = langid.trigram_features(*column_of(TEXTS))
    for text, row in zip(TEXTS, got, strict=True):
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (text or "").encode())
        want = np.zeros(langid.DIMS)
        for i in range(len(raw) - 2):
            want[(int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32) >> (32 - langid.DIM_BITS)] += 1
        assert row == pytest.approx(np.sqrt(want / max(want.sum(), 1)), abs=1e-6), text


def slopes_agree(params, grads, value, picks, eps=1e-5):
    """Each gradient equals the central difference of the loss."""
    for p, g in zip(params, grads, strict=True):
        for at in picks(p):
            old = p[at]
            p[at] = old + eps
            up = value()
            p[at] = old - eps
            down = value()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * eps), rel=2e-3, abs=1e-6)


def some(rng, n=12):
    return lambda p: [tuple(int(rng.integers(k)) for k in p.shape) for _ in range(n)]


@pytest.mark.parametrize("prior", [None, 0.3])
def test_gradient_of_the_risk(prior):
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    params = [rng.normal(0, 0.5, s) for s in ((5, 4), (4,), (4,), (1,))]
    slopes_agree(params, quality.risk(params, pos, unl, prior)[1], lambda: quality.risk(params, pos, unl, prior)[0], some(rng))


def test_risk_is_never_negative_and_steps_back():
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(3, 0.1, (40, 2)), rng.normal(-3, 0.1, (60, 2))
    params = [np.eye(2) * 3, np.zeros(2), np.ones(2) * 5, np.zeros(1)]
    value, grads = quality.risk(params, pos, unl, 0.9)
    assert 0 <= value < 0.01  # the negative part is far below zero and counts as none
    assert (grads[2] * np.tanh(pos.mean() * 3) > 0).all()  # a step against the gradient makes positives' loss rise again


def test_gradient_of_the_bits():
    rng = np.random.default_rng(4)
    x, target = rng.normal(0, 1, (30, 6)), rng.choice((-1.0, 1.0), (30, 3))
    w, b = rng.normal(0, 1, (6, 3)), rng.normal(0, 1, 3)
    slopes_agree([w, b], langid.bit_loss(x, target, w, b)[1], lambda: langid.bit_loss(x, target, w, b)[0], some(rng))


def test_gradient_of_the_convolutions():
    rng = np.random.default_rng(5)
    net = toxicity.Network()
    for name in ("word", "head", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters = [f.astype(float) for f in net.filters]
    net.bias += 0.1
    first = np.array([0, 7, 7, 8, 20])
    word, head = rng.integers(0, 50, 20), rng.integers(0, 20, 20)
    y, weight, kept = np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 0.5]), rng.choice((0.0, 2.0), (2, 20))
    params = [net.word, net.head, *net.filters, net.bias, net.out, net.out_bias]
    value = lambda: net.loss(kept, word, head, first, y, weight)[0]
    used = lambda p: [(int(word[i]), int(rng.integers(p.shape[1]))) for i in range(8)] if p is net.word else some(rng, 6)(p)
    slopes_agree(params, net.loss(kept, word, head, first, y, weight)[1], value, used)


def test_pooled_responses_by_hand():
    """The logit of scoring equals windows slid over each text one by one."""
    rng = np.random.default_rng(6)
    net = toxicity.Network()
    net.bias = rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    first = np.array([0, 0, 1, 3, 12])
    word, head = rng.integers(0, 99, 12), rng.integers(0, 99, 12)
    got = net.logits(word, head, first, net.tables())
    for t, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        x = net.word[word[a:b]] + net.head[head[a:b]]
        pool, c = [], 0
        for k, width in enumerate(toxicity.WIDTHS):
            best = np.zeros(toxicity.FILTERS)
            for i in range(len(x) - width + 1):
                r = net.bias[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] + sum(x[i + j] @ net.filters[c + j] for j in range(width))
                best = np.maximum(best, r)
            pool.append(best)
            c += width
        assert got[t] == pytest.approx(np.concatenate(pool) @ net.out + net.out_bias[0], abs=1e-4)


def test_clashing_columns(spark, documents):
    docs = documents([*ODD, *((100 + i, f"good words number {i} and more of them") for i in range(40)), *((200 + i, "#!| 1 ## $$ " * (i + 1)) for i in range(40))])
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    names = ["score", "predicted", "_scored", "held_out", "trusted", "features", "toxic", "ids", "at", "quality"]
    wide = docs.selectExpr("*", *(f"doc_id * 3 AS `{c}`" for c in names))
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns and all(r[c] == (None if r["doc_id"] is None else 3 * r["doc_id"]) for r in kept.collect() for c in names)
    assert sorted(map(repr, quality.score(wide, quality.fit(wide, labels)).collect())) == sorted(map(repr, quality.score(docs, quality.fit(docs, labels)).collect()))
    assert toxicity.score(wide, toxicity.fit(wide, labels)).columns == ["doc_id", "held_out", "score", "predicted"]
    assert langid.predict(wide, langid.fit(wide)).columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
