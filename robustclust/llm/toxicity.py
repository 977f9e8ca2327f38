"""Toxicity by a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word is embedded as the sum of a hashed word vector and a hashed prefix vector; filters of widths 1 to 3 slide over
the whole text, max pooling keeps each filter's strongest response and a linear layer gives the logit. For scoring, the
filters are multiplied into the embeddings beforehand, so a response is a sum of table rows. Thresholds are calibrated
for the language that a byte-pair model reads from the text itself, and scores shifted so that each threshold is 0.3.

Defined results: a null or empty text has no windows and is scored by the biases alone; a text of any length is read
whole; identical rows (ties) get identical scores; without labelled rows of both classes the score is 0 everywhere; an
empty table gives no rows; extra columns are ignored. The training sample is bounded by documented parameters (rows a
class and words in all), ordered by its own values and dealt to folds by these, so the model is the same for every
partitioning; every document is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.learning import Adam, first_rows, share_for, sigmoid, unit_hash
from robustclust.llm.session import crc_mod, light_batches
from robustclust.llm.textops import ALNUM, LOWER, column_bytes, prefix_hash, row_of, span_hash, text_chunks, words

THRESHOLD = 0.3
WORD_BUCKETS, PREFIX_BUCKETS, PREFIX_BYTES = 1 << 15, 1 << 13, 6
EMBED, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
COLUMNS = [(w, j) for w in WIDTHS for j in range(w)]
LANGUAGE_DIMS = 512


def token_ids(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, prefix buckets, offsets of the texts' words)."""
    low = LOWER[body]
    starts, ends, first = words(low, offsets, ALNUM)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), first
    prefix = prefix_hash(low)
    word = (span_hash(prefix, starts, ends) >> np.uint64(49)).astype(np.int32)
    head = (span_hash(prefix, starts, np.minimum(ends, starts + PREFIX_BYTES)) >> np.uint64(51)).astype(np.int32)
    return word, head, first


def language_features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of hashed byte pairs."""
    n = len(offsets) - 1
    if len(body) < 2:
        return np.zeros((n, LANGUAGE_DIMS), np.float32)
    low = LOWER[body].astype(np.uint32)
    code = (low[:-1] << 8 | low[1:]) * np.uint32(2654435761) >> np.uint32(23)
    row = row_of(offsets)[:-1]
    counts = np.bincount(row * LANGUAGE_DIMS + code, minlength=n * LANGUAGE_DIMS).reshape(n, LANGUAGE_DIMS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def windows_of(first: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of ``width`` words that begins at each word stays inside its text."""
    n = int(first[-1] - first[0])
    ok = np.ones(n, bool)
    if width > 1 and n:
        end = np.repeat(first[1:], np.diff(first)) - first[0]
        ok = np.arange(n) + width <= end
    return ok


def pooled(response: np.ndarray, ok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum over each text's windows, not below 0 (the rectifier); 0 for a text without windows."""
    out = np.zeros((len(first) - 1, response.shape[1]), response.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        response[~ok] = 0
        out[some] = np.maximum(np.maximum.reduceat(response, first[some] - first[0], axis=0), 0)
    return out


class Network:
    """Embeddings, filters and output layer; trained by Adam on batches of texts."""

    drop, l2 = 0.5, 3e-4

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.word = rng.normal(0, 0.1, (WORD_BUCKETS, EMBED)).astype(np.float32)
        self.head = rng.normal(0, 0.1, (PREFIX_BUCKETS, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (EMBED, FILTERS)).astype(np.float32) for _ in COLUMNS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.full(1, -2.0, np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of every bucket to every filter position."""
        f = np.concatenate(self.filters, axis=1)
        return self.word @ f, self.head @ f

    def responses(self, gathered: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, width in enumerate(WIDTHS):
            r = np.tile(self.bias[k * FILTERS : (k + 1) * FILTERS], (len(gathered), 1))
            for c, (w, j) in enumerate(COLUMNS):
                if w == width and len(gathered) > j:
                    r[: len(gathered) - j] += gathered[j:, c * FILTERS : (c + 1) * FILTERS]
            out.append(r)
        return out

    def logits(self, word, head, first, tables) -> np.ndarray:
        gathered = tables[0][word] + tables[1][head]
        pool = [pooled(r, windows_of(first, w), first) for r, w in zip(self.responses(gathered), WIDTHS, strict=True)]
        # row by row, so that a text's score doesn't depend on the texts it is scored with
        return (np.concatenate(pool, axis=1).astype(float) * self.out).sum(axis=1) + self.out_bias[0]

    def train(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int | None = None, batch: int = 48, seed: int = 6) -> None:
        epochs = epochs or int(np.clip(900 * batch // max(1, len(texts)), 8, 40))  # few texts are seen more often
        rng = np.random.default_rng(seed)
        adam = Adam([self.word, self.head, *self.filters, self.bias, self.out, self.out_bias], 0.01)
        for epoch in range(epochs):
            adam.rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                first = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in chosen])])
                if first[-1]:
                    self._step(adam, rng, np.concatenate([texts[i][0] for i in chosen]), np.concatenate([texts[i][1] for i in chosen]), first, y[chosen], weight[chosen])

    def _step(self, adam, rng, word, head, first, y, weight) -> None:
        # words and prefixes that are missing now and then keep the network from learning texts by heart
        kept = (rng.random((2, len(word))) >= self.drop).astype(np.float32) / (1 - self.drop)
        _, (g_word, g_head, *g_filters, g_bias, g_out, g_out_bias) = self.loss(kept, word, head, first, y, weight)
        adam.step([g_word + self.l2 * self.word, g_head + self.l2 * self.head, *(g + 1e-5 * f for g, f in zip(g_filters, self.filters, strict=True)), g_bias, g_out, g_out_bias])

    def loss(self, kept, word, head, first, y, weight) -> tuple[float, list[np.ndarray]]:
        """Weighted logistic loss of a batch and its gradients; ``kept`` scales each word's and each prefix's vector."""
        x = self.word[word] * kept[0][:, None] + self.head[head] * kept[1][:, None]
        responses = self.responses(x @ np.concatenate(self.filters, axis=1))
        pool = [pooled(r, windows_of(first, w), first) for r, w in zip(responses, WIDTHS, strict=True)]
        z = np.concatenate(pool, axis=1)
        logit = z @ self.out + self.out_bias[0]
        slope = ((sigmoid(logit) - y) * weight / len(y)).astype(self.out.dtype)
        back = slope[:, None] * self.out * (z > 0)
        g_word, g_head = np.zeros_like(self.word), np.zeros_like(self.head)
        g_filters = [np.zeros_like(f) for f in self.filters]
        owner = row_of(first)
        for k, (r, p, width) in enumerate(zip(responses, pool, WIDTHS, strict=True)):
            at, col = np.nonzero((r == p[owner]) & (r > 0))
            _, one = np.unique(owner[at].astype(np.int64) * FILTERS + col, return_index=True)  # the first of equal maxima
            at, col = at[one], col[one]
            g = back[owner[at], k * FILTERS + col]
            for c, (w, j) in enumerate(COLUMNS):
                if w == width:
                    np.add.at(g_filters[c].T, col, g[:, None] * x[at + j])
                    to = g[:, None] * self.filters[c].T[col]
                    np.add.at(g_word, word[at + j], to * kept[0][at + j, None])
                    np.add.at(g_head, head[at + j], to * kept[1][at + j, None])
        value = float(((np.logaddexp(0, logit) - y * logit) * weight).sum() / len(y))
        return value, [g_word, g_head, *g_filters, back.sum(axis=0), z.T @ slope, slope.sum(keepdims=True)]


def fit_language(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    adam = Adam([w, b], 0.1)
    for _ in range(steps):
        s = x @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        adam.step([x.T @ p / len(y) + 1e-5 * w, p.mean(axis=0)])
    return w, b


def best_threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit whose cut has the highest F1 (the middle of the gap above it)."""
    order = np.argsort(-logit)
    s, w = logit[order], weight[order]
    hit, miss = np.cumsum(w * (y[order] == 1)), np.cumsum(w * (y[order] == 0))
    f1 = 2 * hit / (hit + miss + hit[-1] + 1e-9)
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k]) - 1e-6


def _tokens(batches):
    for batch in batches:
        body, offsets = column_bytes(batch.column(2))
        ids, langs = [], []
        for _, _, part, off in text_chunks(body, offsets):
            word, head, first = token_ids(part, off)
            ids += [np.stack([word[a:b], head[a:b]]).astype(np.uint16).tobytes() for a, b in zip(first, first[1:], strict=False)]
            langs += [v.tobytes() for v in language_features(part, off)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(langs, pa.binary())], names=["lang", "toxic", "ids", "pairs"])


def _logits(net: Network, texts: list, tables) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum([len(w) for w, _ in texts])])
    return net.logits(np.concatenate([w for w, _ in texts]), np.concatenate([h for _, h in texts]), first, tables)


def fit(docs: DataFrame, labels: DataFrame, each: int = 3000, most_words: int = 4_000_000) -> dict:
    """Network, language model and thresholds from at most ``each`` labelled rows a class, in expectation, and of these from
    whole texts of at most ``most_words`` words (or one longer text)."""
    docs = light_batches(docs)
    known = labels.where((crc_mod("doc_id", 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return {"net": None}
    share = {k: share_for(each, counts[k]) for k in (0, 1)}
    chosen = first_rows(known.where(unit_hash("doc_id") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])), 4 * each, "doc_id")
    # the chosen ids are bounded by the parameter, so they may be broadcast
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "toxic", "text")
    read = texts.mapInArrow(_tokens, "lang string, toxic int, ids binary, pairs binary").withColumn("at", F.xxhash64("ids", "toxic"))
    sizes = read.select("at", F.length("ids").alias("bytes")).orderBy("at").limit(8 * each).collect()
    held = np.cumsum([r["bytes"] // 4 for r in sizes])
    last = sizes[max(0, int(np.searchsorted(held, most_words, "right")) - 1)]["at"] if sizes else 0
    rows = first_rows(read.where(F.col("at") <= last), 8 * each, "ids", "toxic", "lang").collect()
    texts = [tuple(np.frombuffer(r["ids"], np.uint16).reshape(2, -1).astype(np.int32)) for r in rows]
    y = np.array([r["toxic"] for r in rows], np.float32)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0]).astype(np.float32)
    if len(set(y.tolist())) < 2:
        return {"net": None}
    seen = np.zeros(WORD_BUCKETS, int)
    for word, _ in texts:
        seen[np.unique(word)] += 1
    net = Network()
    folds = np.random.default_rng(8).permutation(len(texts)) % 4
    learn = np.flatnonzero(folds != 0)
    rare = seen < 4  # words of a few texts can only be learnt by heart
    texts = [(np.where(rare[w], 0, w), h) for w, h in texts]
    net.train([texts[i] for i in learn], y[learn], weight[learn] / weight[learn].mean())
    tables = net.tables()
    logit = np.concatenate([_logits(net, texts[i : i + 64], tables) for i in range(0, len(texts), 64)])
    langs = sorted({r["lang"] for r in rows if r["lang"] is not None})
    pairs = np.stack([np.frombuffer(r["pairs"], np.float32) for r in rows])
    named = np.array([r["lang"] is not None for r in rows])
    w, b = fit_language(pairs[named], np.array([langs.index(r["lang"]) for r in rows if r["lang"] is not None], int), len(langs)) if langs else (np.zeros((LANGUAGE_DIMS, 1)), np.zeros(1))
    read = (pairs @ w + b).argmax(axis=1)
    held = folds == 0
    overall = best_threshold(logit[held], y[held], weight[held])
    cuts = []
    for k in range(max(1, len(langs))):
        own = held & (read == k)
        enough = (y[own] == 1).sum() >= 12 and (y[own] == 0).sum() >= 12
        cuts.append(best_threshold(logit[own], y[own], weight[own]) if enough else overall)
    return {"net": net, "tables": tables, "rare": rare, "langs": langs, "language": (w.astype(np.float32), b.astype(np.float32)), "cuts": np.array(cuts)}


def score_texts(model: dict, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model["net"] is None:
        return np.zeros(len(offsets) - 1)
    word, head, first = token_ids(body, offsets)
    word = np.where(model["rare"][word], 0, word)
    logit = model["net"].logits(word, head, first, model["tables"])
    w, b = model["language"]
    cut = model["cuts"][(language_features(body, offsets) @ w + b).argmax(axis=1)]
    return sigmoid(logit - cut + np.log(THRESHOLD / (1 - THRESHOLD)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    if model["net"] is not None:
        model = model | {"net": _slim(model["net"])}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            body, offsets = column_bytes(batch.column(2))
            parts = [score_texts(shared.value, part, off) for _, _, part, off in text_chunks(body, offsets, limit=1 << 20)]
            s = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return ready.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def _slim(net: Network) -> Network:
    """What scoring needs of a network: the tables stand for embeddings and filters."""
    out = Network.__new__(Network)
    out.bias, out.out, out.out_bias = net.bias, net.out, net.out_bias
    return out
