import re

import numpy as np
import pytest

from robustclust.llm import mixing

from .conftest import ODD


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("fan_in", [8, 512])
def test_words_taken_meet_the_targets(spark, documents, fan_in):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 80)), "en", ["a", "b", "c", None, "é"][int(min(4, rng.exponential(1)))]) for i in range(900)]
    rows += [(*r, "en", "odd") for r in ODD]
    got = mixing.mix(documents(rows), fan_in=fan_in).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = targets(sizes)
    taken, most = {}, {}
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6, s


def test_reruns_and_partitionings_agree(documents):
    docs = documents([(i, "w " * (i % 17 + 1), "en", "abc"[i % 3]) for i in range(300)])
    first = sorted(mixing.mix(docs, fan_in=16).collect())
    assert first == sorted(mixing.mix(docs.repartition(7), fan_in=16).collect())


def test_repeated_rows_are_rounded_one_by_one(spark, documents):
    rows = [(1, "ten words " * 5, "en", "a")] * 400 + [(2, f"{i} other words", "en", "a") for i in range(50)] + [(i, "w " * 9, "en", "b") for i in range(3, 300)]
    docs = documents(rows)
    got = mixing.mix(docs, fan_in=16).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 10
    out = mixing.apply_mix(docs, fan_in=16).collect()
    for s in "ab":
        assert sum(r["copies"] * size(r["text"]) for r in out if r["source"] == s) == sum(r["copies"] * r["size"] for r in got if r["source"] == s)
    assert sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in got if r["copies"])


def test_clashing_columns(documents):
    docs = documents([(i, "some words here " * (i + 1), "en", "ab"[i % 2]) for i in range(40)])
    names = ["copies", "_id", "_key", "_row", "_copies", "number", "size", "row_key", "target"]
    wide = docs.selectExpr("*", *(f"doc_id * 2 AS `{c}`" for c in names))
    out = mixing.apply_mix(wide)
    assert out.columns == [*wide.columns, "copies_"] and all(r["copies"] == 2 * r["doc_id"] == r["_key"] and r["copies_"] > 0 for r in out.collect())


def test_expected_copies_are_kept():
    frac, sizes = [0.3] * 400, [float(i % 9 + 1) for i in range(400)]
    rng = np.random.default_rng(0)
    total = np.zeros(400)
    for _ in range(200):
        out = mixing.pivotal(frac.copy(), sizes, rng.random(400).tolist())
        assert sum(0 < x < 1 for x in out) <= 1
        assert abs(np.dot(out, sizes) - np.dot(frac, sizes)) < 1e-6
        total += out
    assert abs(total.mean() / 200 - 0.3) < 0.02 and np.abs(total / 200 - 0.3).max() < 0.2


def test_stage_and_empty(documents):
    docs = documents([(i, "some words here " * (i + 1), "en", "ab"[i % 2]) for i in range(40)])
    out = mixing.apply_mix(docs)
    assert set(docs.columns) < set(out.columns) and out.where("copies < 1").count() == 0
    assert mixing.mix(documents([])).count() == 0
