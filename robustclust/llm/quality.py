"""Quality by positive-unlabelled learning: a small network minimises the non-negative unbiased risk.

Trusted positives are rows labelled 1; unlabelled rows are drawn from all documents; the class prior is estimated from
those two samples alone (the best-bin estimator: the least ratio of tail masses, with a confidence margin). The risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss. Inputs are surface statistics of the whole
text. Both samples are bounded (documented parameters); every document is scored.

Defined results: a null text counts as empty and is scored as such; a text of any length is read whole; identical rows
(ties) get identical scores; without positives the score is 0.5 everywhere; an empty table gives no rows; extra columns
are ignored, and ``keep_good`` returns them unchanged whatever their names. Training rows are ordered by their own
values before anything is drawn from them, so the model is the same for every partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.learning import Adam, first_rows, share_for, sigmoid, unit_hash
from robustclust.llm.session import crc_mod, lean, light_batches
from robustclust.llm.textops import LOWER, NOT_SPACE, byte_table, column_bytes, row_of, row_sums, text_chunks, word_hashes, words

THRESHOLD = 0.7
CLASSES = {
    "upper": lambda b: 65 <= b <= 90,
    "lower": lambda b: 97 <= b <= 122,
    "digit": lambda b: 48 <= b <= 57,
    "stop": lambda b: b in b".,;:?'\"()-",
    "bang": lambda b: b in b"!",
    "bar": lambda b: b in b"|",
    "mark": lambda b: b in b"#$%&*+/<=>@[\\]^_`{}~",
    "line": lambda b: b in b"\n\r",
    "wide": lambda b: b > 127,
}
CODE = np.zeros(256, np.uint8)
for _k, _member in enumerate(CLASSES.values()):
    CODE[byte_table(_member)] = _k + 1
FEATURES = len(CLASSES) + 10


def surface_features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics a text; all are shares or logarithms."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = row_of(offsets)
    kinds = np.bincount(row * 16 + CODE[body], minlength=16 * n).reshape(n, 16)[:, 1 : len(CLASSES) + 1]
    starts, ends, first = words(body, offsets, NOT_SPACE)
    count = np.diff(first)
    h = word_hashes(LOWER[body], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    owner = row_of(first)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    key = h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[order]) != 0])[: len(h)]
    distinct = np.bincount(owner[order][new], minlength=n)
    length = (ends - starts).astype(float)
    capital = CODE[body[starts]] == 1 if len(starts) else np.zeros(0, bool)
    last = CODE[body[ends - 1]] if len(starts) else np.zeros(0, np.uint8)
    share = lambda x: row_sums(x.astype(np.int64), first) / np.maximum(count, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 8], 1)
    mean = row_sums(length.astype(np.int64), first) / np.maximum(count, 1)
    return np.column_stack(
        [
            kinds / np.maximum(size, 1)[:, None] * 4,
            np.log1p(count) / 4,
            np.log1p(size) / 6,
            kinds[:, 0] / letters,
            mean / 8,
            np.minimum(mean, 30) ** 2 / 200,
            distinct / np.maximum(count, 1),
            np.log1p(distinct) / 4,
            share(again),
            share(capital),
            share(last == 7),
        ]
    ).astype(np.float32)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled from held-out scores: the most certain of all tail ratios."""
    cuts = np.unique(np.quantile(pos, np.linspace(0.0, 0.98, 99)))
    p = (pos[None] >= cuts[:, None]).mean(axis=1)
    u = (unl[None] >= cuts[:, None]).mean(axis=1)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(unl)) + 1 / np.sqrt(len(pos)))
    best = np.argmin((u + (1 + gamma) * margin) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def risk(params: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The non-negative unbiased risk of a batch of positives and unlabelled rows, and the step's gradients.

    prior None: the loss of plain separation. Where the risk's negative part falls below zero it overfits; the gradients
    then lead back along it instead.
    """
    x = np.concatenate([p, u])
    z = np.tanh(x @ params[0] + params[1])
    g = z @ params[2] + params[3]
    gp, gu = g[: len(p)], g[len(p) :]
    loss = lambda v: np.logaddexp(0, v).mean()
    if prior is None:
        value = (loss(-gp) + loss(gu)) / 2
        slope = np.concatenate([-sigmoid(-gp) / len(p), sigmoid(gu) / len(u)]) / 2
    else:
        negative = loss(gu) - prior * loss(gp)
        value = prior * loss(-gp) + max(0.0, negative)
        on_p, off_p, off_u = -prior * sigmoid(-gp) / len(p), -prior * sigmoid(gp) / len(p), sigmoid(gu) / len(u)
        slope = np.concatenate([on_p + off_p, off_u]) if negative >= 0 else -np.concatenate([off_p, off_u])
    back = slope[:, None] * params[2] * (1 - z * z)
    return float(value), [x.T @ back, back.sum(axis=0), z.T @ slope, slope.sum(keepdims=True)]


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 1, hidden: int = 24, epochs: int = 60, batch: int = 1024) -> list[np.ndarray]:
    """One hidden layer; prior None: plain separation of the two samples (for the estimate of the prior)."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    adam = Adam(params, 0.01)
    steps = max(1, len(unl) // batch)
    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.002
        for _ in range(steps):
            p = pos[rng.integers(0, len(pos), min(batch, len(pos)))]
            u = unl[rng.integers(0, len(unl), min(batch, len(unl)))]
            _, grads = risk(params, p, u, prior)
            adam.step([g + 1e-4 * w if w.ndim == 2 or w is params[2] else g for g, w in zip(grads, params, strict=True)])
    return params


def network(params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ params[0] + params[1]) @ params[2] + params[3]


def _features(batches):
    for batch in batches:
        body, offsets = column_bytes(batch.column(1))
        rows = [v.tobytes() for _, _, part, off in text_chunks(body, offsets) for v in surface_features(part, off)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["trusted", "features"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000) -> dict:
    """Network, scaling and estimated prior; ``positives`` and ``unlabelled`` bound the samples in expectation."""
    docs = light_batches(docs)
    learn = crc_mod("doc_id", 4) != 2
    trusted = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    trusted = first_rows(trusted.where(unit_hash("doc_id") < share_for(positives, trusted.count())), 2 * positives, "doc_id").withColumn("trusted", F.lit(True))
    usable = docs.select("doc_id", "text").where(learn)
    drawn = unit_hash("doc_id", "text", seed=9) < share_for(unlabelled, usable.count())
    # the trusted ids are bounded by the parameter, so they may be broadcast
    chosen = usable.join(F.broadcast(trusted), "doc_id", "left").withColumn("drawn", drawn).where("trusted or drawn")
    role = F.array_compact(F.array(F.when(F.col("trusted"), True), F.when(F.col("drawn"), False)))
    features = chosen.select(F.explode(role).alias("trusted"), "text").mapInArrow(lean(_features), "trusted boolean, features binary")
    rows = first_rows(features, 2 * (positives + unlabelled), "features", "trusted").collect()
    pos = np.array([np.frombuffer(r["features"], np.float32) for r in rows if r["trusted"]], float).reshape(-1, FEATURES)
    unl = np.array([np.frombuffer(r["features"], np.float32) for r in rows if not r["trusted"]], float).reshape(-1, FEATURES)
    if len(pos) < 8 or len(unl) < 8:
        return {"params": None}
    order = np.random.default_rng(2)
    pos, unl = pos[order.permutation(len(pos))], unl[order.permutation(len(unl))]
    mean, spread = unl.mean(axis=0), unl.std(axis=0) + 1e-3
    pos, unl = (pos - mean) / spread, (unl - mean) / spread
    half_p, half_u = len(pos) // 2, len(unl) // 2
    first = fit_network(pos[:half_p], unl[:half_u], None)
    prior = estimate_prior(network(first, pos[half_p:]), network(first, unl[half_u:]))
    return {"params": fit_network(pos, unl, prior), "mean": mean, "spread": spread, "prior": prior}


def score_texts(model: dict, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [np.zeros(0)]
    for _, _, part, off in text_chunks(body, offsets):
        x = surface_features(part, off)
        parts.append(sigmoid(network(model["params"], (x - model["mean"]) / model["spread"])) if model["params"] is not None else np.full(len(x), 0.5))
    return np.concatenate(parts)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = score_texts(shared.value, *column_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return ready.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    model = fit(docs, labels)
    if model["params"] is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = score_texts(shared.value, *column_bytes(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
