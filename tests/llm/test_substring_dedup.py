import hashlib

import numpy as np
import pytest

from robustclust.llm import substring_dedup as sd
from robustclust.llm import suffix_queue

from .conftest import ODD


def brute(docs):
    least = {}
    key = lambda d: (d is None, d or 0)
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(least.get(w, key(d)), key(d))
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < key(d):
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        out.append(repr((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def run(documents, docs, **options):
    rows = sd.dedup_substrings(documents(docs), **options).collect()
    return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in rows)


def shuffled(seed, n=40):
    """Texts cut from common passages, with edits, repeats and short periods."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcé\0"), int(rng.integers(1, 7))))
    passages = [" ".join(word() for _ in range(40)) for _ in range(5)] + ["ab" * 90, "x" * 160]
    out = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            p = passages[int(rng.integers(len(passages)))]
            a = int(rng.integers(0, 40))
            p = p[a : a + int(rng.integers(30, 200))]
            if rng.random() < 0.5 and len(p) > 3:
                k = int(rng.integers(len(p)))
                p = p[:k] + "Q" + p[k + 1 :]
            parts += [p, word()]
        out.append((int(rng.integers(0, n // 2)) if rng.random() < 0.2 else i, "".join(parts)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(documents, seed):
    docs = [*shuffled(seed), *((200 + (i or 0), t) if i is not None else (None, t) for i, t in ODD)]
    assert run(documents, docs) == brute(docs)


@pytest.mark.parametrize("hot", [2, 6, 1 << 16])
def test_small_chunks_and_hot_grams(documents, hot):
    docs = shuffled(5)
    assert run(documents, docs, hot_samples=hot, chunk_bytes=600) == brute(docs)


def tuples_of(docs):
    """Tuples of every sampled position, and for each which of its strings an earlier document has."""
    rows, want = [], []
    least = {}
    for d, t in docs:
        raw = t.encode()
        for i in range(len(raw) - 49):
            least[raw[i : i + 50]] = min(least.get(raw[i : i + 50], d), d)
    for d, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, place, lo, hi, _ = sd.sample(raw, np.array([0, len(raw)]))
        for p, a, b in zip(place, lo, hi, strict=True):
            left, right = np.zeros(sd.REACH, np.uint8), np.zeros(50, np.uint8)
            left[:b], right[: 50 - a] = raw[p - b : p][::-1], raw[p : p + 50 - a]
            rows.append((d, a, b, left, right))
            want.append(sum(1 << x for x in range(a, b + 1) if least[raw[p - x : p - x + 50].tobytes()] < d))
    return np.array(rows, sd.TUPLE), want


@pytest.mark.parametrize("page", [16, 97, 1 << 18])
def test_queue_of_many_times_its_memory(page):
    """A shard of over a hundred pages: runs, streams, queues, marks and open runs go through files."""
    docs = [(d, t) for d, t in shuffled(11, 60) if t]
    docs += [(100 + i, docs[0][1] + "tail" * i) for i in range(40)] + [(500 + i, "the edge of a passage that everybody has, and then " + chr(97 + i) * 20) for i in range(26)]
    tuples, want = tuples_of(docs)
    assert len(tuples) > 1600
    queue = suffix_queue.SuffixQueue(page)
    cuts = np.array_split(np.arange(len(tuples)), 23)
    for c, at in enumerate(cuts):
        queue.push(c, tuples[at])
    got = np.zeros(len(tuples), np.uint64)
    for c, at, marks in queue.marked():
        got[cuts[c][at : at + len(marks)]] = marks
    assert got.tolist() == want


def test_merge_is_in_order_and_files_are_used():
    rng = np.random.default_rng(1)
    t = np.zeros(5000, sd.TUPLE)
    t["right"] = rng.integers(0, 3, (5000, 50))
    queue = suffix_queue.SuffixQueue(500)
    for part in np.array_split(t, 7):
        queue.push(0, part)
    pages = list(queue.merged())
    assert len(queue.runs) >= 10 and max(map(len, pages)) <= 64 * len(queue.runs)
    right = np.concatenate([p["right"] for p in pages])
    assert len(right) == 5000 and (np.sort(right) == right).all()
    assert sorted(np.concatenate([p["number"] for p in pages]).tolist()) == list(range(5000))


def test_columns_and_ids(spark, documents):
    docs = documents(shuffled(3, 12))
    wide = docs.selectExpr("CAST(doc_id AS INT) AS doc_id", "text", "1 AS chunk", "2 AS n_bytes", "3 AS kept", "4 AS shard")
    got = sd.dedup_substrings(wide)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and dict(got.dtypes)["doc_id"] == "int"
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == brute(shuffled(3, 12))
    with pytest.raises(ValueError):
        sd.dedup_substrings(docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("substring")]


def test_every_string_is_sampled_at_one_place():
    rng = np.random.default_rng(6)
    body = rng.integers(97, 100, 4000).astype(np.uint8)
    offsets = np.array([0, 1000, 1000, 1030, 4000])
    row, place, lo, hi, _ = sd.sample(body, offsets)
    seen = {}
    for r, p, a, b in zip(row, place, lo, hi, strict=True):
        for start in range(p - b, p - a + 1):
            assert offsets[r] <= start and start + 50 <= offsets[r + 1]
            assert seen.setdefault(body[start : start + 50].tobytes(), p - start) == p - start
    assert sum(hi - lo + 1) == (1000 - 49) + (2970 - 49)


def test_texts_kept(documents):
    passage = "this passage is longer than fifty bytes, as it has to be here."
    rows = sd.dedup_substrings(documents([(1, passage), (2, f"before {passage} after"), (3, None)]), with_text=True).collect()
    assert next(r["n_removed"] for r in rows if r["doc_id"] == 2) >= len(passage)
    assert sd.dedup_substrings(documents([])).count() == 0
