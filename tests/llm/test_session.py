import os
import types

import pytest

from robustclust.llm import decontaminate, jaccard, mixing, secret_scan, session, substring_dedup, warc

from .conftest import ODD


def left_in(spark):
    folder = session.shared_dir(spark).removeprefix("file:")
    return {f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.startswith("robustclust-")}


@pytest.mark.parametrize("name", ["op6", "op7", "op8", "op10", "stage2", "stage8"])
def test_operators_leave_their_result_only(spark, documents, name):
    docs = documents([*ODD, *((100 + i, f"some text number {i // 2} that is long enough to be found again, word after word after word") for i in range(20))])
    items = spark.createDataFrame([(1, "some text number 3")], "item_id long, text string")
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 200) for i in range(5)], "page_id long, url string, html string")
    run = {
        "op6": lambda: mixing.mix(docs),
        "op7": lambda: warc.archive_and_index(pages),
        "op8": lambda: jaccard.jaccard_groups(docs),
        "op10": lambda: substring_dedup.dedup_substrings(docs),
        "stage2": lambda: decontaminate.drop_contaminated(docs, items),
        "stage8": lambda: jaccard.keep_one(docs),
    }[name]
    before = left_in(spark)
    first = run()
    assert first.count() > 0 and len(left_in(spark) - before) <= 1
    with session.scratch(spark) as keep:
        kept = keep(run(), "kept")
    assert kept.count() == first.count() and len(left_in(spark) - before) <= 2  # first's result and the kept one
    session.unstaged(kept)
    assert len(left_in(spark) - before) <= 1


def test_nested_scopes_hand_tables_on(spark):
    before = left_in(spark)
    with session.scratch(spark) as outer:
        with session.scratch(spark) as inner:
            session.staged(spark.range(3), "gone")
            kept = inner(spark.range(5), "kept")
        assert kept.count() == 5 and len(left_in(spark) - before) == 1
        out = outer(kept.where("id > 1"), "out")
    assert out.count() == 3 and len(left_in(spark) - before) == 1
    session.unstaged(out)
    assert left_in(spark) == before


def test_a_cluster_needs_a_shared_folder():
    bare = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(bare)


def test_names_that_do_not_clash():
    assert session.free_name(["a", "COPIES", "copies_"], "copies") == "copies__"


@pytest.mark.parametrize("stage", ["jaccard", "decontaminate", "redact"])
def test_stages_return_columns_of_any_name(spark, documents, stage):
    docs = documents([(1, "a passage of words that is long enough here"), (2, "a passage of words that is long enough here"), (None, "token=abcdef12345 and more"), (None, "token=abcdef12345 and more"), (3, "short item")])
    names = ["_row", "_gone", "_id", "_md5", "_key", "set_id", "node", "n_shingles", "component_id", "window", "start", "spans", "w", "text_md5", "bucket"]
    wide = docs.selectExpr("*", *(f"coalesce(doc_id, 9) * 2 AS `{c}`" for c in names))
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    run = {"jaccard": lambda d: jaccard.keep_one(d), "decontaminate": lambda d: decontaminate.drop_contaminated(d, items), "redact": secret_scan.redact}[stage]
    got = run(wide)
    assert got.columns == wide.columns
    assert all(r[c] == 2 * (9 if r["doc_id"] is None else r["doc_id"]) for r in got.collect() for c in names)
    assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, run(docs).collect()))


def test_workers_give_memory_back_after_their_rows(monkeypatch):
    given = []
    monkeypatch.setattr(session, "give_back", lambda least=0.0: given.append(least))

    def doubled(batches):
        for b in batches:
            yield 2 * b

    assert list(session.lean(doubled)([1, 2])) == [2, 4] and given == [0.0]
    assert session.lean(lambda group: group + 1)(4) == 5 and len(given) == 2
    monkeypatch.undo()
    session.give_back()
