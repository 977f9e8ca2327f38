"""WARC archives with revisit records, and a globally ordered capture index by external merging.

Records are written with the text sink (the record separator of the format is the line separator of the sink), so any
file system that Spark reaches will do and a retried task leaves no partial archive. Reading parses records by their
Content-Length. Each archive gives one run of captures sorted by URL key and timestamp; runs are dealt out by ranges of
(URL key, timestamp, page_id) and each range is merged by a loser tree whose overfull buffers spill to sorted files.

Archives hold records of about one size each, and so few that none exceeds ``ARCHIVE_BYTES`` unless one record does: a
task reads one archive at a time. Runs that a merge spills are files of the task; a lost task is run again from the
staged runs.

Defined results: a null html is an empty payload; a null url becomes ``urn:unknown``; of rows with equal payloads of
100 bytes or more all but those with the smallest page_id are revisits (a null page_id too, if another has one; with
null page_ids only, all are responses); repeated rows are records of their own, those with the smallest page_id all
responses; an html of any length is one record; an empty table gives an empty index; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustclust.llm.components import spread_join
from robustclust.llm.session import buckets_for, new_folder, scratch, staged

LEAST_SHARED_BYTES = 100
#: bytes of the archives, uncompressed, and the most records of one
ARCHIVE_BYTES, RECORDS_PER_FILE = 256 << 20, 4096
#: payload bytes up to which a record goes to the archives of its class; beyond the last, to those of the largest
CLASSES = (64 << 10, 1 << 20, 16 << 20)
#: digests (64 characters each) that may be broadcast, counted before
BROADCAST_DIGESTS = 200_000
ROWS_PER_RANGE = 50_000
SPILL_ROWS = 200_000
#: fixed values of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01 00:00:00"
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, captured string, archive string, offset long, length long"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, n, first_id: first_id is the page a revisit refers to, else null."""
    body = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    shared = known.where(F.col("n") >= LEAST_SHARED_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("copies")).where("copies > 1 and least is not null")
    shared = staged(shared, "warc-shared")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("least"))
    count, rows = shared.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if count <= BROADCAST_DIGESTS:
        joined = known.join(F.broadcast(shared), "digest", "left")
    else:  # a common payload doesn't gather its pages in a task, and short ones travel under no key at all
        joined = spread_join(known, shared, "digest", "copies", "least", rows, "page_id", F.col("n") < LEAST_SHARED_BYTES)
    return joined.select("page_id", "url", "html", "digest", "n", F.when(later & F.col("least").isNotNull() & (F.col("n") >= LEAST_SHARED_BYTES), F.col("least")).alias("first_id"))


def record_text(plan: DataFrame) -> DataFrame:
    crlf = "\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(crlf))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n").cast("string"), F.lit(crlf + crlf))
    again = F.col("first_id").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    # a timestamp without a zone: the text is the same whatever the session's zone is
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)).cast("decimal(18,6)"))
    date = F.concat(F.replace((F.lit(EPOCH).cast("timestamp_ntz") + since).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(crlf),
    )
    return plan.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write the archives; returns their folder."""
    path = path or new_folder(pages.sparkSession, "warc")
    plan = plan_records(pages)
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    least = -1
    for most in (*CLASSES, max(longest, CLASSES[-1])):
        each = max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES // most))
        own = plan.where((F.col("n") > least) & (F.col("n") <= most))
        sink = record_text(own).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", each)
        sink.text(f"{path}/to-{most}" if least < CLASSES[-1] else f"{path}/longer")
        least = most
        if longest <= most:
            break
    return path


def url_key(url: str) -> str:
    """Sort-friendly URL: host labels reversed, then path and query, lower-cased."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:head_end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, raw[start:end], at, end + 4 - at
        at = end + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _runs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in INDEX.split(", ")]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            raw = zlib.decompress(content, 31) if path.endswith(".gz") else bytes(content)
            rows = []
            for headers, block, offset, length in parse_records(raw):
                http, _, payload = block.partition(b"\r\n\r\n")
                again = headers["WARC-Type"] == "revisit"
                n = int(re.search(rb"Content-Length: (\d+)", http)[1]) if again else len(payload)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:") if again else hashlib.sha256(payload).hexdigest()
                captured = re.sub(r"\D", "", headers["WARC-Date"])
                rows.append((_page(headers["WARC-Record-ID"]), n, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), url_key(headers["WARC-Target-URI"]), captured, "/".join(path.rsplit("/", 2)[1:]), offset, length))
            rows.sort(key=capture_order)
            out = pd.DataFrame(rows, columns=columns)
            for c in ("page_id", "refers_to"):
                out[c] = out[c].astype("Int64")
            yield out


def capture_order(row: tuple) -> tuple:
    """URL key, timestamp, then page (null first) and place: a total order."""
    return row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8]


class LoserTree:
    """k-way merge: inner nodes keep the loser of each match, so a new head costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]], key=capture_order):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w][2]
            self.heads[w] = self._next(w)
            node, winner = (w + self.k) // 2, w
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def _spilled(rows: Iterable[tuple]):
    """A sorted run in a temporary file that vanishes when it is closed."""
    file = tempfile.TemporaryFile()
    page = []
    for row in rows:
        page.append(row)
        if len(page) == 4096:
            pickle.dump(page, file)
            page = []
    pickle.dump(page, file)
    file.seek(0)

    def read():
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    return read()


def _merge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in INDEX.split(", ")]
    runs: dict[str, list[tuple]] = {}
    spilled, held = [], 0

    def in_memory():
        for rows in runs.values():
            rows.sort(key=capture_order)  # a no-op on runs that the exchange left in order
        return iter(LoserTree([iter(r) for r in runs.values()]))

    for frame in frames:
        for row in frame[columns].itertuples(index=False, name=None):
            row = tuple(None if x is pd.NA or x != x else x for x in row)
            runs.setdefault(row[7], []).append((None if row[0] is None else int(row[0]), *row[1:4], None if row[4] is None else int(row[4]), *row[5:]))
        held += len(frame)
        if held >= SPILL_ROWS:
            spilled.append(_spilled(in_memory()))
            runs, held = {}, 0
    page = []

    def frame_of(rows):
        out = pd.DataFrame(rows, columns=columns)
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out

    for row in LoserTree([*spilled, in_memory()]):
        page.append(row)
        if len(page) == 8192:
            yield frame_of(page)
            page = []
    if page:
        yield frame_of(page)


def _staged_runs(spark: SparkSession, path: str, keep=staged) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return keep(files.mapInPandas(_runs, INDEX), "warc-runs")


def _merged(runs: DataFrame) -> DataFrame:
    ranges = buckets_for(runs.count(), ROWS_PER_RANGE)
    return runs.repartitionByRange(max(ranges, 8), "urlkey", "captured", "page_id", "offset").mapInPandas(_merge, INDEX)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder and below, globally ordered by URL key and timestamp."""
    return _merged(_staged_runs(spark, path))


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The index of archives of ``pages``; the archives stay where a path is given."""
    with scratch(pages.sparkSession) as keep:
        runs = _staged_runs(pages.sparkSession, write_archives(pages, path), keep)
    return _merged(runs)
