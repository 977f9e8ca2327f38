import re

import numpy as np
import pytest

from robustclust.llm import components, jaccard

from .conftest import ODD


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k=4, num=85, den=100):
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(repr((d, len(s), least.get(find(i), d) if s else d)) for i, (d, s) in enumerate(sets))


def run(documents, docs, **options):
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.jaccard_groups(documents(docs), **options).collect())


def noisy(seed, bases=12, copies=6, length=(3, 120)):
    """Texts with copies at every distance around the threshold."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = rng.choice(vocabulary, int(rng.integers(*length))).tolist()
        for c in range(copies):
            t = list(base)
            for _ in range(int(rng.integers(0, max(1, len(base) // 20) + 1)) if c else 0):
                t[int(rng.integers(len(t)))] = str(rng.choice(vocabulary))
            out.append(" ".join(t[: len(t) - int(rng.integers(0, 2))]))
    order = rng.permutation(len(out))
    return [(int(i), out[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(documents, seed):
    docs = [*((100 + i, t) for i, t in noisy(seed)), *ODD]
    assert run(documents, docs) == brute(docs)


def test_five_word_shingles_at_other_thresholds(documents):
    docs = noisy(7)
    assert run(documents, docs, k=5, num=80, den=100) == brute(docs, 5, 80, 100)


def test_blocks_of_large_groups(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    docs = noisy(9, bases=2, copies=40, length=(60, 90))
    assert run(documents, docs) == brute(docs)


def test_signatures_lose_no_link():
    rng = np.random.default_rng(2)
    for size in (5, 7, 8, 20, 67, 150, 400):
        for _ in range(20):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            b = a.copy()
            while True:
                c = b.copy()
                c[rng.integers(size)] = rng.integers(0, 2**63)
                common = len(np.intersect1d(a, c))
                if 100 * common < 85 * (2 * size - common):
                    break
                b = c
            sets = [np.unique(a), np.unique(b)]
            if np.array_equal(*sets):
                continue
            sig, who = jaccard.signatures(sets, 85, 100)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_bands_reach_their_neighbours_only():
    ends = jaccard.bands(85, 100, 100_000)
    for low in range(1, 3000):
        high = low * 100 // 85
        assert np.searchsorted(ends, high) - np.searchsorted(ends, low) <= 1


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(documents):
    docs = documents([(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "z y x w v u"), (5, ""), (6, None), (2, "z y x w v u")])
    kept = jaccard.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6] and kept.columns == docs.columns
    assert jaccard.jaccard_groups(documents([])).count() == 0


def test_null_and_repeated_ids_take_no_other_text_along(documents):
    near = [" ".join(f"w{i}" for i in range(60)) + end for end in ("", " x", " y")]
    other = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, near[0]), (None, near[1]), (7, near[2]), (None, other[0]), (7, other[1])]  # the first of three near copies stays
    rows += [(None, t.replace("w", "v")) for t in near] + [(9, t.replace("w", "u")) for t in near] + [(None, None), (None, other[2]), (None, other[2])]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(documents(rows)).collect()]
    assert {(1, near[0]), (None, other[0]), (7, other[1]), (None, None), (None, other[2])} < set(kept)
    assert len(kept) == 7 and sum(t is not None and t[0] == "v" for _, t in kept) == 1 == sum(t is not None and t[0] == "u" for _, t in kept)


def test_star_steps_with_a_hot_node(spark, monkeypatch):
    """Beyond one task's edges: a node of most edges is told to all tasks; the result is that of one task."""
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    rng = np.random.default_rng(5)
    edges = [(0, i) for i in range(1, 400)] + [(int(a), int(b)) for a, b in rng.integers(500, 900, (250, 2))] + [(i, i + 1) for i in range(2000, 2030)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = sorted(components.connected(table).collect())
    assert sorted(components.connected(table, local_edges=0).collect()) == want
    assert sum(r["root"] == 0 for r in want) == 400


def test_blocks_of_signatures():
    rng = np.random.default_rng(1)
    sig, who = rng.integers(0, 2**64, 4000, dtype=np.uint64), np.sort(rng.integers(0, 60_000, 4000)).astype(np.uint16)
    at, blocks = jaccard.packed_blocks(sig, who, 37)
    got = [(b, low, w) for b, block in zip(at.tolist(), blocks, strict=True) for low, w in zip(*(x.tolist() for x in jaccard.unpacked_block(block)), strict=True)]
    assert sorted(got) == sorted(((int(s) >> 32) * 37 >> 32, int(s) & 0xFFFFFFFF, w) for s, w in zip(sig.tolist(), who.tolist(), strict=True))
    assert jaccard.packed_blocks(sig[:0], who[:0], 37)[1] == []


def test_every_subset_of_second_level_partitions_is_a_signature():
    """Two sets that differ in one element share the signatures of the subsets without its partition, in every other partition all."""
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    b = np.unique(np.concatenate([a[1:], a[:1] + np.uint64(1)]))
    sig, who = jaccard.signatures([a, b], 85, 100)
    x, y = set(sig[who == 0].tolist()), set(sig[who == 1].tolist())
    # two elements, in two bands, are in two of three subsets each; others may fall under another bar
    most = 2 * 2 * 2 + 2 * jaccard.PARTS
    assert len(x - y) <= most and len(x) > 3 * most


def test_long_texts_and_batches(documents, monkeypatch):
    """Texts beyond a piece, blocks dealt out within a batch, and copies in several batches."""
    monkeypatch.setattr(jaccard, "BATCH_SIGNATURES", 500)
    monkeypatch.setattr(jaccard, "BATCH_DOCS", 7)
    words = [f"word{i}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-400], *(f"other{i}" for i in range(400))])), (3, " ".join(words[:30_000]))]
    docs += [(10 + i, t) for i, t in enumerate(t for _, t in noisy(4, bases=8, copies=4))]
    got = run(documents, docs)
    assert got == brute(docs)
