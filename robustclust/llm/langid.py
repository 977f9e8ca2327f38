"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a logistic classifier over hashed byte trigrams separates the languages with
1 from those with 0. A text's language is the codeword of least loss, each bit's logistic loss weighted by how well the
bit is predicted on the training rows; a small lead over the runner-up is flagged as ambiguous.

Training reads text and non-null lang of rows whose crc32(doc_id) mod 5 isn't 0: a sample of at most ``limit`` rows in
expectation (a documented bound), equal shares a language.

Defined results: a null text, or one without any letter, is ``und`` with score 0; without training rows all are; equal
losses go to the language that sorts first; identical rows get identical results; an empty table gives no rows; a text of
any length is read whole; extra columns are ignored. Training rows are ordered by their own values, so the model is the
same for every partitioning.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.learning import Adam, first_rows, share_for, sigmoid, unit_hash
from robustclust.llm.session import crc_mod, light_batches
from robustclust.llm.textops import LOWER, byte_table, column_bytes, row_of, text_chunks

DIM_BITS = 11
DIMS = 1 << DIM_BITS
ROWS = 1024
AMBIGUOUS = 0.6
ASCII_LETTER = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
#: letters stay (lower-cased), every other ASCII byte is a space
FOLDED = np.array([LOWER[b] if ASCII_LETTER[b] or b > 127 else 32 for b in range(256)], np.uint8)


def trigram_features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams."""
    n = len(offsets) - 1
    if len(body) < 3:
        return np.zeros((n, DIMS), np.float32)
    low = FOLDED[body].astype(np.uint32)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS)
    row = row_of(offsets)[: len(code)]
    inside = np.arange(len(code)) + 3 <= offsets[1:][row]
    counts = np.bincount((row * DIMS + code)[inside], minlength=n * DIMS).reshape(n, DIMS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def code_matrix(classes: int, seed: int = 3) -> np.ndarray:
    """One row of +1 and -1 a class: all splits for up to 7 classes, else the best of random dense codes."""
    if classes <= 7:
        columns = [c for c in product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns or [(1,) * classes]).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(64):
        m = rng.choice((-1, 1), (classes, bits))
        m[0, np.abs(m.sum(axis=0)) == classes] *= -1
        d = ((m[:, None] != m[None]).sum(axis=2) + bits * np.eye(classes, dtype=int)).min()
        if d > apart:
            best, apart = m, d
    return best


def bit_loss(x: np.ndarray, target: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    """The logistic loss of all bits, with its gradients."""
    margin = target * (x @ w + b)
    slope = -target * sigmoid(-margin).astype(w.dtype) / len(x)
    return float(np.logaddexp(0, -margin).sum() / len(x)), (x.T @ slope, slope.sum(axis=0))


def fit_bits(x: np.ndarray, y: np.ndarray, codes: np.ndarray, steps: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, biases, bit weights of the decoding) of the binary classifiers."""
    target = codes[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    adam = Adam([w, b], 0.05)
    for _ in range(steps):
        _, (to_w, to_b) = bit_loss(x, target, w, b)
        adam.step([to_w + 1e-5 * w, to_b])
    right = ((x @ w + b > 0) == (target > 0)).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.05)
    return w, b, (trust / trust.sum()).astype(np.float32)


def decode(margins: np.ndarray, codes: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, probability, lead over the runner-up) by loss-weighted decoding."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * codes[None], -30, 30))) @ trust * codes.shape[1]
    best = loss.argmin(axis=1)
    chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
    chance /= chance.sum(axis=1, keepdims=True)
    ranked = np.sort(chance, axis=1)
    return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else 0)


def _features(batches):
    for batch in batches:
        body, offsets = column_bytes(batch.column(1))
        rows = [v.tobytes() for _, _, part, off in text_chunks(body, offsets, rows=ROWS) for v in trigram_features(part, off)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "features"])


def fit(docs: DataFrame, limit: int = 6000) -> dict:
    """The model: languages, codes, weights. At most ``limit`` rows are learnt from, in expectation."""
    docs = light_batches(docs)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 5) != 0))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    each = max(1, limit // len(langs))
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, share_for(each, counts[lang]))])
    features = usable.where(unit_hash("doc_id", "text") < shares[F.col("lang")]).select("lang", "text").mapInArrow(_features, "lang string, features binary")
    rows = first_rows(features, 2 * limit, "features", "lang").collect()
    if not rows:
        return {"langs": []}
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in rows])
    y = np.array([langs.index(r["lang"]) for r in rows])
    codes = code_matrix(len(langs))
    w, b, trust = fit_bits(x, y, codes)
    return {"langs": langs, "codes": codes, "w": w, "b": b, "trust": trust}


def predict_texts(model: dict, body: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    if not model["langs"]:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    best, score, lead = decode(trigram_features(body, offsets) @ model["w"] + model["b"], model["codes"], model["trust"])
    out = [model["langs"][k] for k in best]
    letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[body])])
    for d in np.flatnonzero(letters[offsets[1:]] == letters[offsets[:-1]]).tolist():
        text = body[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
        if not any(c.isalpha() for c in text):
            out[d], score[d], lead[d] = "und", 0.0, 0.0
    return out, np.clip(score, 0, 1), lead < AMBIGUOUS


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            body, offsets = column_bytes(batch.column(2))
            langs, scores, doubts = [], [], []
            for _, _, part, off in text_chunks(body, offsets, rows=ROWS):
                a, b, c = predict_texts(shared.value, part, off)
                langs += a
                scores.append(b)
                doubts.append(c)
            cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(cat(scores, np.float64)), pa.array(cat(doubts, bool))],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    ready = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return ready.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean")
