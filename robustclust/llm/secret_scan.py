"""Secret scans through a trigram inverted index.

Each rule's regex is parsed into a Boolean query of trigrams that any match must contain. Documents are indexed in
segments: postings (bitmaps over the segment's documents) are built for the trigrams that some rule asks for, each
query intersects and unites them, and only the candidates are verified with the regex. A rule without mandatory
trigrams scans every document. Segments are independent and bounded in bytes, so nothing is shuffled.

Defined results: a null or empty text has no spans; identical rows get identical results; spans that begin together are
listed in the order of the rules; a text of any length is scanned whole; an empty table gives no rows; extra columns are
ignored, and ``redact`` returns them unchanged whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.session import lean, light_batches
from robustclust.llm.textops import LOWER, column_bytes, text_chunks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: group and least length of a match that counts
    group: int = 0
    least: int = 0
    any_case: bool = False


#: fixed values: the base rules, in their order, then the rules added
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}", 0, 0, True),
    Rule("url", r"[a-z]{2,10}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!$-]{4,64}@"),
)
BASE = ("assign", "access", "hex")
#: sets of alternative strings above this size are closed into the query
MOST_STRINGS = 48

ANY = ("any",)


def _conj(parts) -> tuple:
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _disj(parts) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings_query(strings: set[str]) -> tuple:
    return _disj([_conj([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, tuple]:
    """(all strings the expression can be, or None if not few; the query that its matches fulfil)."""
    exact: set[str] | None = {""}
    query: list[tuple] = []

    def close(then: set[str] | None = None):
        nonlocal exact
        if exact:
            query.append(_strings_query(exact))
        exact = then if then is not None else {""}

    whole = True
    for op, arg in items:
        options: set[str] | None = None
        inner = ANY
        if op is rc.LITERAL:
            options = {chr(arg).lower()}
        elif op is rc.IN and all(x[0] is rc.LITERAL for x in arg) and len(arg) <= 6:
            options = {chr(x[1]).lower() for x in arg}
        elif op is rc.SUBPATTERN:
            options, inner = _walk(arg[-1])
        elif op is rc.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            inner = _disj([q if s is None else _strings_query(s) for s, q in parts])
            options = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, sub = arg
            strings, sub_query = _walk(sub)
            inner = ANY if least == 0 else sub_query if strings is None else _strings_query(strings)
            if strings is not None and most == 1:
                options = strings | ({""} if least == 0 else set())
            elif strings is not None and least == most and len(strings) == 1:
                options = {s * least for s in strings}
        if options is not None and exact is not None and len(exact) * len(options) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in options}
        else:
            whole = False
            close(options if options is not None and len(options) <= MOST_STRINGS else None)
            query.append(inner)
    if whole:
        return exact, _strings_query(exact)
    close()
    return None, _conj(query)


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a regex, over lower-cased text; ("any",) if no trigram is mandatory."""
    return _walk(rp.parse(pattern))[1]


def _codes(query: tuple) -> set[int]:
    if query[0] == "tri":
        a, b, c = query[1].encode("latin-1")
        return {a << 16 | b << 8 | c}
    return set().union(*(_codes(q) for q in query[1])) if query[0] in ("and", "or") else set()


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.regex = [re.compile((f"(?:{r.pattern[:-1]}{{{r.least},}})" if r.kind == "hex" else r.pattern).encode(), re.I if r.any_case else 0) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted(set().union(*map(_codes, self.queries)))
        self.slot = {c: i for i, c in enumerate(wanted)}
        self.need = np.full(1 << 24, -1, np.int16)
        self.need[wanted] = np.arange(len(wanted), dtype=np.int16)

    def postings(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each wanted trigram, which of the segment's documents have it."""
        found = np.zeros((len(self.slot), len(offsets) - 1), bool)
        if len(body) >= 3:
            low = LOWER[body].astype(np.int32)
            slots = self.need[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(slots >= 0)
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[doc + 1]
            found[slots[at[inside]], doc[inside]] = True
        return found

    def _meets(self, query: tuple, found: np.ndarray) -> np.ndarray:
        if query[0] == "any":
            return np.ones(found.shape[1], bool)
        if query[0] == "tri":
            return found[self.slot[next(iter(_codes(query)))]]
        parts = [self._meets(q, found) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def segment(self, body: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each document its spans (start, rule, end) in bytes."""
        found = self.postings(body, offsets)
        raw = body.tobytes()
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regex, self.queries, strict=True)):
            for d in np.flatnonzero(self._meets(query, found)).tolist():
                s, e = int(offsets[d]), int(offsets[d + 1])
                for m in regex.finditer(raw, s, e):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start() - s, k, m.end() - s))
        return out


def _scan(batches, rules=RULES):
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    for batch in batches:
        body, offsets = column_bytes(batch.column(0))
        spans_out, base_out, counts = [], [], [[], [], []]
        for _, _, part, off in text_chunks(body, offsets):
            for d, spans in enumerate(scanner.segment(part, off)):
                if spans:
                    raw = part[off[d] : off[d + 1]]
                    points = np.cumsum((raw & 0xC0) != 0x80) if (raw > 127).any() else None
                    at = lambda x: x if points is None or x == 0 else int(points[x - 1])  # noqa: E731, B023
                    spans = [(at(s), k, at(e)) for s, k, e in sorted(spans)]
                texts = [f"{kinds[k]}:{s}:{e}" for s, k, e in spans]
                base = [t for t, (_, k, _) in zip(texts, spans, strict=True) if k < len(BASE)]
                for k in range(len(BASE)):
                    counts[k].append(sum(x[1] == k for x in spans))
                spans_out.append(",".join(texts))
                base_out.append(hashlib.sha256(",".join(base).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(1, batch.num_columns)), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(spans_out, pa.string())],
            names=[*batch.schema.names[1:], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, comma-joined)."""
    kind = dict(docs.dtypes)["doc_id"]
    return light_batches(docs).select("text", "doc_id").mapInArrow(lean(_scan), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    out, end = [], 0
    for s, e in sorted(spans):
        if s >= end:
            out += [text[end:s], "[SECRET]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def _redact(batches):
    scanner = Scanner()
    for batch in batches:
        k = batch.schema.get_field_index("text")
        column = batch.column(k)
        body, offsets = column_bytes(column)
        changed: dict[int, str] = {}
        for first, _, part, off in text_chunks(body, offsets):
            for d, spans in enumerate(scanner.segment(part, off)):
                if spans:
                    raw = part[off[d] : off[d + 1]].tobytes()
                    changed[first + d] = _mask(raw.decode("latin-1"), [(s, e) for s, _, e in spans]).encode("latin-1").decode("utf-8", "replace")
        if changed:
            values = column.to_pylist()
            for i, t in changed.items():
                values[i] = t
            column = pa.array(values, column.type)
        yield pa.RecordBatch.from_arrays([column if i == k else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``[SECRET]``; ``n_chars`` follows where there is such a column."""
    out = light_batches(docs).mapInArrow(lean(_redact), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
