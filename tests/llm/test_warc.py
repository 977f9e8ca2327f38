import hashlib
import random

import pytest

from robustclust.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, extra string")


ROWS = [(1, "http://b.org/x", "<p>" + "a" * 200, "e"), (2, "http://www.a.org/y?q=1", "<p>" + "a" * 200, "e"), (3, None, None, "e"), (4, "http://a.org/ z", "", "e"), (5, "http://a.org/y", "short", "e"), (6, "bad", "short", "e"), (7, "http://c", "é\r\n\r\nWARC/1.1\r\n" * 30, "e"), (7, "http://c", "é\r\n\r\nWARC/1.1\r\n" * 30, "e"), (0, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 30, "e")]


def expected(rows):
    least = {}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            least[body] = min(page, least.get(body, page))
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        first = least.get(body)
        again = first is not None and page > first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(repr, out))


def test_round_trip(spark):
    got = warc.archive_and_index(pages(spark, ROWS)).collect()
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == expected(ROWS)
    order = [(r["urlkey"], r["captured"], r["page_id"]) for r in got]
    assert order == sorted(order)


def test_index_points_into_the_archives(spark):
    path = warc.write_archives(pages(spark, ROWS))
    import glob
    import zlib

    for r in warc.capture_index(spark, path).collect():
        raw = zlib.decompress(open(glob.glob(f"{path}/{r['archive']}")[0], "rb").read(), 31)
        headers, _, offset, length = next(warc.parse_records(raw[r["offset"] : r["offset"] + r["length"]]))
        assert offset == 0 and length == r["length"] and headers["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"


def test_dates_are_of_no_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = warc.archive_and_index(pages(spark, [(0, "http://a", "x", ""), (6_000_000, "http://b", "x", "")])).collect()
            assert [r["captured"] for r in got] == ["20240101000000", "20240310104000"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_null_ids_and_common_payloads_beyond_the_broadcast_bound(spark, monkeypatch):
    """Without broadcast a payload that most pages have is dealt over the tasks, and so are the short ones."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", -1)
    common = "<p>" + "c" * 300
    rows = [(i, f"http://h{i % 7}/{i}", common if i % 10 else "", "e") for i in range(6000)] + [(i, "http://z", f"{i // 2}" * 100, "e") for i in range(6000, 6100)]
    got = warc.plan_records(pages(spark, [*rows, (None, "http://n", common, "e"), (None, None, None, None)]))
    found = {r["page_id"]: r["first_id"] for r in got.where("page_id is not null").collect()}
    assert found[1] is None and found[2] == 1 and found[0] is None and found[6001] == 6000
    assert {r["n"]: r["first_id"] for r in got.where("page_id is null").collect()} == {303: 1, 0: None}
    sizes = [len(x) for x in got.select("page_id").rdd.glom().collect()]
    assert max(sizes) < 3500  # not all 5400 rows of one digest
    only = warc.archive_and_index(pages(spark, [(None, "http://n", common, "e")] * 2)).collect()
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in only] == [(None, "response", None)] * 2


def test_long_pages_get_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (100, 1000, 5000))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    import glob

    rows = [(i, f"http://a/{i}", f"{i}" + "y" * n, "e") for i, n in enumerate([10, 500, 4000, 70_000, 20, 900, 0, 4900])]
    path = warc.write_archives(pages(spark, rows))
    assert len({f.rsplit("/", 2)[1] for f in glob.glob(f"{path}/*/*.txt.gz")}) == 4
    got = warc.capture_index(spark, path).collect()
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == expected(rows)


def test_empty_table(spark):
    assert warc.archive_and_index(pages(spark, [])).count() == 0


def test_damaged_archive():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_loser_tree_merges_like_sorting():
    rng = random.Random(1)
    row = lambda: (rng.randint(0, 99), 0, "", "", None, rng.choice("abc"), str(rng.randint(0, 5)), "f", rng.randint(0, 9), 0)
    for k in range(9):
        runs = [sorted((row() for _ in range(rng.randint(0, 30))), key=warc.capture_order) for _ in range(k)]
        merged = list(warc.LoserTree([iter(r) for r in runs]))
        assert [warc.capture_order(x) for x in merged] == sorted(warc.capture_order(x) for r in runs for x in r)
    assert list(warc._spilled(iter([row(), row()])))


def test_merging_spills(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPILL_ROWS", 2)
    import pandas as pd

    columns = [c.split()[0] for c in warc.INDEX.split(", ")]
    rows = [(i, 1, "d", "response", None, "abc"[i % 3], str(i), f"f{i % 2}", i, 1) for i in range(9)]
    frames = [pd.DataFrame(rows[i : i + 3], columns=columns) for i in (6, 0, 3)]
    out = pd.concat(warc._merge(frames))
    assert out["page_id"].tolist() == [0, 3, 6, 1, 4, 7, 2, 5, 8]
