import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from robustclust.llm import decontaminate

from .conftest import ODD


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, size=13, share=20):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


def run(spark, documents, docs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(documents(docs), table, **options).collect()
    return sorted(map(repr, [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows]))


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs far away from here today"), (2, "short item"), (3, None), (4, "..."), (10, "the quick brown fox jumps over the lazy dog and runs far away from home")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, documents, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ITEM_BYTES", -1)
    docs = [*ODD, (20, ITEMS[0][1].upper()), (21, f"filler, {ITEMS[0][1]} filler " * 3), (22, "a short item here " + "w " * 100), (23, "The quick brown fox jumps over the lazy dog and runs far"), (24, "short item short item")]
    assert run(spark, documents, docs, ITEMS) == sorted(map(repr, brute(docs, ITEMS)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab ", max_size=30), min_size=1, max_size=6), st.lists(st.text("ab ", max_size=12), max_size=3))
def test_small_alphabet(spark, documents, texts, items):
    docs, table = list(enumerate(texts)), list(enumerate(items))
    assert run(spark, documents, docs, table, size=3) == sorted(map(repr, brute(docs, table, 3)))


def test_empty_tables_and_stage(spark, documents):
    assert run(spark, documents, [], ITEMS) == []
    assert len(run(spark, documents, ODD, [])) == len(ODD)
    docs = documents([*ODD, (20, ITEMS[0][1])])
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and kept.where("doc_id = 20").count() == 0 and kept.count() == len(ODD)
