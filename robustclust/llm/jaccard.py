"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

Sets of hashed word shingles fall into bands of near-equal size. Linked sets of a band (or of it and the one below)
differ in at most k elements. The element domain is dealt into n = k // 2 + 1 + e first-level partitions, so in at least
1 + e of them the two differ in one element at most; each is dealt again into ``PARTS`` second-level partitions, of which
all but one hold the same elements in both. A set's signatures are the hashes of its elements in every subset of all but
one of the second-level partitions of a first-level one, in its own band and the next; subsets of very few elements are
left out as far as they lie in e first-level partitions, which spares the signatures that unrelated sets share. Linked sets
share a signature: no link is lost.

Signatures travel in blocks of bytes dealt by hash. Of up to ``FEW`` sets that share one, the pairs are candidates; more
are searched within their group, of which only a spanning forest leaves. Candidates whose sketches (parities of hashed
counts) differ by more than linked sets can are dropped. The candidates' components are cut into blocks of bounded
size, and every pair of blocks is verified exactly, by counting common elements. Exact copies are one set throughout.
Shingles are identified by 64-bit hashes.

Defined results: a null or word-less text has an empty set, links with nothing and is its own component; identical rows
share a component; a null doc_id is never a component's id unless all its ids are null; of equal ids any row's set may
name the group, as the id is the same; an empty table gives no rows; extra columns are ignored, and ``keep_one`` returns
them unchanged whatever their names; a text of any length is one set.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustclust.llm.components import connected, spread_join
from robustclust.llm.session import BROADCAST_IDS, buckets_for, exists, free_name, freed, lean, light_batches, new_folder, scratch, staged, text_bytes, unstaged
from robustclust.llm.textops import LOWER, NOT_SPACE, U64, column_bytes, cumulative, gram_hashes, mix, row_of, text_chunks, word_hashes, words

#: bytes of text for each signature bucket, bytes of sets in a verified block, and its most rows
TEXT_PER_BUCKET, BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4 << 20, 1024
#: bytes of text that a task works on at once, and that it is handed at once
PIECE_BYTES, BATCH_BYTES = 256 << 10, 4 << 20
#: documents of a batch (their index takes two bytes) and signatures held back until they are dealt out in blocks
BATCH_DOCS, BATCH_SIGNATURES = 60_000, 300_000
#: sets sharing a signature of which all pairs are candidates; bits of the shortest sketch
FEW, LEAST_BITS = 6, 256
#: second-level partitions of a first-level one; rounds in which the buckets of signatures are worked through
PARTS, ROUNDS = 3, 3


def shingle_sets(body: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of a shorter text, the hash of its words."""
    low = LOWER[body]
    starts, ends, first = words(low, offsets, NOT_SPACE)
    h = word_hashes(low, starts, ends)
    grams = gram_hashes(h, k)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(mix(gram_hashes(h[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache
def bands(num: int, den: int, most: int = 1 << 31) -> np.ndarray:
    """Upper ends of the size bands: linked sets are in the same band or in neighbouring ones."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num))
    return np.array(ends, np.int64)


def band_plan(band: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, e, first-level partitions) of bands: links have a difference of at most k; e partitions may lack subsets.

    With n partitions fewer than k // 2 + 1 of them can hold two differences or more, so 1 + e hold one at most.
    """
    top = bands(num, den)[band]
    k = 2 * top * (den - num) // (num + den)
    e = np.where(k >= 4, k // 8 + 1, 0)
    return k, e, k // 2 + 1 + e


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) in all bands that apply."""
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    own = np.searchsorted(bands(num, den), size)
    sig, who = [], []
    spread = mix(values * U64(0xA24BAED4963EE407)) >> U64(32)
    content = mix(values ^ U64(0x9FB21C651E98DF25))
    low, high = (content & U64(0xFFFFFFFF)).astype(float), (content >> U64(32)).astype(float)
    for up in (0, 1):
        band = own + up
        k, e, parts = band_plan(band, num, den)
        use = (k > 0) & (size > 0)
        parts = np.where(use, parts, 0)
        base = cumulative(parts)
        total = int(base[-1])
        if not total:
            continue
        owner = np.repeat(np.arange(len(sets)), size)
        keep = use[owner]
        # both levels at once: the first-level partition and, of its second-level ones, which
        place = (spread * (parts[owner] * PARTS).astype(np.uint64) >> U64(32)).astype(np.int64)
        key = (base[:-1][owner] * PARTS + place)[keep]
        count = np.bincount(key, minlength=total * PARTS).reshape(total, PARTS)
        content_sum = np.bincount(key, low[keep], total * PARTS).astype(np.uint64) + (np.bincount(key, high[keep], total * PARTS).astype(np.uint64) << U64(32))
        content_sum = content_sum.reshape(total, PARTS)
        holder = row_of(base)
        # every subset that leaves one second-level partition out
        inside = count.sum(axis=1, keepdims=True) - count
        subset = content_sum.sum(axis=1, keepdims=True, dtype=np.uint64) - content_sum
        # the highest bar under which the poorest subsets of at most e partitions fall; subsets below it are left out. Of
        # two linked sets that with the higher bar has a partition that counts with all subsets at or above it, and the
        # subset that the two have alike there has as many elements in the other, so both keep it
        poorest, bar = inside.min(axis=1), np.zeros(len(sets), np.int64)
        for t in range(1, 7):
            below = np.bincount(holder[poorest < t], minlength=len(sets))
            bar[below <= e] = t
        chosen = inside >= bar[holder][:, None]
        number = ((np.arange(total) - base[:-1][holder])[:, None] * PARTS + np.arange(PARTS)).astype(np.uint64)
        salt = mix((band[holder].astype(np.uint64) << U64(32))[:, None] + number)
        made = mix(subset + salt + inside.astype(np.uint64) * U64(0x632BE59BD9B4E019))
        sig.append(made[chosen])
        who.append(np.broadcast_to(holder[:, None], chosen.shape)[chosen])
    return (np.concatenate(sig), np.concatenate(who)) if sig else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set's content."""
    parts = np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64), len(s)], np.uint64)
    return int(mix((parts * np.array([1, 3, 0x9E3779B97F4A7C15], np.uint64)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def parity_sketch(s: np.ndarray) -> bytes:
    """About a bit an element: the parities of hashed counts. Sets differ in no fewer elements than their sketches in bits."""
    bits = 1 << max(LEAST_BITS.bit_length() - 1, (max(len(s), 1) - 1).bit_length())
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, as 64-bit words: longer ones are folded, which keeps the bound."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least), np.uint8)
    sizes = np.array([len(x) for x in sketches])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(-1, size)
        while x.shape[1] > least:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        out[at] = x
    return out.view(np.uint64)


def most_difference(a, b, num: int, den: int):
    """The greatest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (den - num) // (num + den)


ROWS = "batch long, idx int, doc_id {kind}, n_shingles long, set_id long, bucket long, block binary"
NAMES = ["batch", "idx", "doc_id", "n_shingles", "set_id", "bucket", "block"]


def packed_blocks(sig: np.ndarray, who: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """(buckets, their blocks): the low halves of signatures, then the steps from one document to the next by bytes."""
    bucket = ((sig >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint32)
    order = np.lexsort((who, bucket))
    low, who, bucket = sig[order].astype(np.uint32), who[order].astype(np.int64), bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    ends = [*first[1:].tolist(), len(sig)][: len(first)]
    step = np.diff(who, prepend=0)
    step[first] = who[first]
    step = step.astype("<u2").view(np.uint8).reshape(-1, 2)
    return bucket[first], [low[a:b].tobytes() + step[a:b].T.tobytes() for a, b in zip(first.tolist(), ends, strict=True)]


def unpacked_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(low halves of signatures, documents) of a block."""
    n = len(block) // 6
    step = np.ascontiguousarray(np.frombuffer(block, np.uint8, offset=4 * n).reshape(2, n).T).view("<u2").ravel()
    return np.frombuffer(block, np.uint32, n), np.cumsum(step, dtype=np.int64)


def _sketch(k: int, num: int, den: int, buckets: int):
    """Rows of two kinds: a document (bucket null, its sketch as block) and, for each batch and bucket, packed signatures."""

    def run(batches):
        no = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        used, held, waiting, seen = 0, [], 0, set()

        def dealt():
            sig, who = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at, blocks = packed_blocks(sig, who, buckets)
            m = len(at)
            zero = np.zeros(m, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, no)), pa.array(zero.astype(np.int32)), pa.nulls(m, kind), pa.array(zero), pa.array(zero), pa.array(at, pa.int64()), pa.array(blocks, pa.binary())], names=NAMES
            )

        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, BATCH_DOCS):
                piece = batch.slice(start, BATCH_DOCS)
                n = piece.num_rows
                if used + n > BATCH_DOCS:
                    if held:
                        yield dealt()
                    no, used, waiting = no + 1, 0, 0
                    seen.clear()
                body, offsets = column_bytes(piece.column(1))
                sizes, ids, sketches = [], [], []
                for first, _, part, off in text_chunks(body, offsets, PIECE_BYTES):
                    sets = shingle_sets(part, off, k)
                    sizes += [len(s) for s in sets]
                    sketches += [parity_sketch(s) for s in sets]
                    own = [set_id(s) for s in sets]
                    ids += own
                    fresh = [i for i, x in enumerate(own) if not (x in seen or seen.add(x))]
                    s, w = signatures([sets[i] for i in fresh], num, den)
                    held.append((s, (np.array([*fresh, 0], np.int64)[w] + first + used).astype(np.uint16)))
                    waiting += len(s)
                    if waiting > BATCH_SIGNATURES:
                        yield dealt()
                        waiting = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, no)),
                        pa.array((np.arange(n) + used).astype(np.int32)),
                        piece.column(0),
                        pa.array(np.array(sizes, np.int64)),
                        pa.array(np.array(ids, np.int64)),
                        pa.nulls(n, pa.int64()),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=NAMES,
                )
                used += n
        if held:
            yield dealt()

    return run


def _shared_signatures(group: pd.DataFrame) -> pd.DataFrame:
    """Within a bucket: the pairs of nodes that share a signature (a, b), or for groups of many sig and node (a)."""
    blocks = [unpacked_block(b) for b in group["block"]]
    node = np.concatenate([(np.int64(b) << 16) + who for b, (_, who) in zip(group["batch"], blocks, strict=True)])
    sig = np.concatenate([low for low, _ in blocks])
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([head, [len(sig)]]))
    pairs = []
    for m in range(2, FEW + 1):
        at = head[size == m]
        pairs += [np.column_stack([node[at + i], node[at + j]]) for i in range(m) for j in range(i + 1, m)]
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    many = np.repeat(size > FEW, size)
    label = sig[many].astype(np.int64) | np.int64(int(group["bucket"].iloc[0]) << 32)
    none = np.full(len(pairs), -1, np.int64)
    return pd.DataFrame({"sig": np.concatenate([none, label]), "a": np.concatenate([pairs[:, 0], node[many]]), "b": np.concatenate([pairs[:, 1], np.full(int(many.sum()), -1, np.int64)])})


def _close_pairs(num: int, den: int):
    def run(frames):
        for f in frames:
            if len(f):
                # linked sets are of similar size, so few pairs need their longer sketch folded more than once
                apart = np.array([np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum() for x, y in zip(f["x"], f["y"], strict=True)])
                f = f[apart <= most_difference(f["na"].to_numpy(), f["nb"].to_numpy(), num, den)]
            yield f[["a", "b"]]

    return run


def forest_of(ids: np.ndarray, n: np.ndarray, sketches: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with close sketches."""
    x, out, left = folded(sketches), [], np.arange(len(ids))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            f = frontier.pop()
            close = np.bitwise_count(x[left] ^ x[f]).sum(axis=1) <= most_difference(n[left], n[f], num, den)
            found = left[close]
            out += [(ids[f], ids[g]) for g in found.tolist()]
            frontier += found.tolist()
            left = left[~close]
    return out


def _forest(num: int, den: int):
    """The forests of the groups (sig, i, j) of a pack."""

    def run(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(["sig", "i", "j", "set_id"], kind="stable")
        sig, i, j, ids, n = (pack[c].to_numpy() for c in ("sig", "i", "j", "set_id", "n"))
        sketches, out = pack["sketch"].tolist(), []
        head = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(ids)], strict=True):
            out += forest_of(ids[a:b], n[a:b], sketches[a:b], num, den)
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def linked_roots(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the first set of its component under the exact link rule."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    values, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = seen[inverse] > 1
    column, owner = np.cumsum(seen > 1)[inverse[shared]] - 1, owner[shared]
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(256, (4 << 20) // m)  # the incidence matrix is built in slices of bounded size
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        slab = np.zeros((m, min(width, int(column[-1]) + 1 - lo)), np.float32)
        slab[owner[a:b], column[a:b] - lo] = 1
        common += slab @ slab.T
    # den * common >= num * union, the union being both sizes less what is common
    root = np.full(m, -1)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i], frontier = i, [i]
        left = np.flatnonzero(root < 0)
        while frontier and len(left):
            f = frontier.pop()
            link = (num + den) * common[f, left].astype(np.int64) >= num * (size[f] + size[left])
            root[left[link]] = i
            frontier += left[link].tolist()
            left = left[~link]
    return root


def _verify(num: int, den: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in group.groupby(["comp", "i", "j"], sort=False):
            block = block.drop_duplicates("set_id").sort_values("set_id")
            sets = [np.frombuffer(x, np.uint64) for x in block["block"]]
            root = linked_roots(sets, num, den)
            ids = block["set_id"].to_numpy()
            out.append(np.column_stack([ids, ids[root]])[root != np.arange(len(root))])
        links = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            body, offsets = column_bytes(batch.column(1))
            sets = [s for _, _, part, off in text_chunks(body, offsets, PIECE_BYTES) for s in shingle_sets(part, off, k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["wanted", "set_id", "block"]
            )

    return run


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows with block_no of blocks, repeated for every pair (i, j) of blocks that theirs belongs to."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("other", other).withColumn("i", F.least("block_no", "other")).withColumn("j", F.greatest("block_no", "other"))


def jaccard_groups(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id for every document; linked: intersection/union >= num/den."""
    with scratch(docs.sparkSession) as keep:
        return keep(_groups(light_batches(docs.select("doc_id", "text"), BATCH_BYTES), k, num, den), "jaccard-groups")


def _staged_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of documents and those of signatures, staged apart, as the latter go early."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "jaccard-rows")
    rows.withColumn("kind", F.when(F.col("bucket").isNull(), 0).otherwise(1)).write.partitionBy("kind").parquet(path)
    out = []
    for kind in (0, 1):
        folder = f"{path}/kind={kind}"
        there = exists(spark, folder)
        out.append(spark.read.schema(rows.schema).parquet(folder) if there else spark.createDataFrame([], rows.schema))
        out[-1]._staged_in = folder
    return out[0], out[1]


def _candidates(rows: DataFrame, blocks: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """node, root: components of the sets that share a signature and whose sketches are close."""
    spark = rows.sparkSession
    filled = rows.where("n_shingles > 0")
    nodes = filled.select((F.shiftleft("batch", 16) + F.col("idx")).alias("node"), "set_id")
    sketches = filled.groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.first("block").alias("sketch"))
    rounds = []
    for r in range(ROUNDS):  # the exchange holds the signatures of a round only
        own = blocks.where((F.col("bucket") >= r * buckets // ROUNDS) & (F.col("bucket") < (r + 1) * buckets // ROUNDS))
        shared = own.select("bucket", "batch", "block").groupBy("bucket").applyInPandas(lean(_shared_signatures), "sig long, a long, b long")
        rounds.append(staged(shared, "jaccard-met"))
        del own, shared
        freed(spark)
    unstaged(blocks)
    met = reduce(DataFrame.union, rounds)
    named = lambda c: nodes.select(F.col("node").alias(c), F.col("set_id").alias(f"s{c}"))
    # a pair shares many signatures: it counts once, before its sets are looked up
    few = met.where("sig < 0").select("a", "b").distinct()
    pairs = few.join(named("a"), "a").join(named("b"), "b").where("sa <> sb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
    pairs = pairs.join(sketches.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
    close = staged(pairs.select("a", "b", "na", "nb", "x", "y").mapInPandas(lean(_close_pairs(num, den)), "a long, b long"), "jaccard-close")
    many = met.where("sig >= 0").join(named("a"), "a").select("sig", F.col("sa").alias("set_id")).distinct()
    sized = many.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count("*").alias("sets"))
    split = many.join(sized.where("sets > 1"), "sig").select("sig", "set_id", "blocks")
    # groups of bounded size often hold the same sets: each such list is searched once
    lists = split.where("blocks = 1").groupBy("sig").agg(F.array_sort(F.collect_set("set_id")).alias("sets")).select("sets").distinct()
    bounded = lists.select(F.xxhash64("sets").alias("sig"), F.explode("sets").alias("set_id"), F.lit(1).alias("blocks"))
    dealt = bounded.union(split.where("blocks > 1")).join(sketches, "set_id").withColumn("block_no", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    spare = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = _block_pairs(dealt).withColumn("pack", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(spare)))
    grouped = packed.select("pack", "sig", "i", "j", "set_id", "n", "sketch").groupBy("pack").applyInPandas(lean(_forest(num, den)), "a long, b long")
    grouped = staged(grouped, "jaccard-grouped")
    for table in rounds:
        unstaged(table)
    freed(spark)
    return connected(close.union(grouped))


def _groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    buckets = buckets_for(text_bytes(docs), TEXT_PER_BUCKET, 64)
    rows, blocks = _staged_rows(docs.mapInArrow(lean(_sketch(k, num, den, buckets)), ROWS.format(kind=kind)))
    candidates = _candidates(rows, blocks, buckets, num, den)

    # one document for each candidate set, and the block that its set goes to
    texts = staged(rows.select("batch", "idx", "doc_id", "n_shingles", "set_id"), "jaccard-texts")
    whole = texts.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = staged(candidates.select(F.col("node").alias("set_id"), F.col("root").alias("comp")).join(whole, "set_id"), "jaccard-members")
    unstaged(rows)
    spans = members.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    dealt = members.join(spans, "comp").withColumn("block_no", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.select(F.col("doc_id").alias("wanted"), F.col("set_id").alias("wanted_set"), "comp", "blocks", "block_no", "n")
    few = members.count() <= BROADCAST_IDS
    wanted = dealt.select("wanted").distinct()
    picked = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["wanted"])).select("wanted", "text")
    sets = picked.mapInArrow(lean(_sets(k)), f"wanted {kind}, set_id long, block binary")
    held = sets.join(dealt, (sets["set_id"] == dealt["wanted_set"]) & sets["wanted"].eqNullSafe(dealt["wanted"])).select("comp", "blocks", "block_no", "set_id", "n", "block")
    spread = _block_pairs(held)
    packs = buckets_for((members.agg(F.sum("n")).first()[0] or 0) * 8, BLOCK_BYTES // 8, 24)
    packed = spread.select(F.pmod(F.xxhash64("comp", "i", "j"), F.lit(packs)).alias("pack"), "comp", "i", "j", "set_id", "block")
    # written before its components are sought, so that no task runs two Python workers at once
    verified = staged(packed.groupBy("pack").applyInPandas(lean(_verify(num, den)), "a long, b long"), "jaccard-verified")
    freed(spark)
    links = connected(verified)

    total = texts.count()
    sets = texts.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    rooted = staged(sets.join(links.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "jaccard-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    by_set = spread_join(rooted, least, "root", "sets", "component_id", total, "set_id").select("set_id", "rows", "component_id")
    out = spread_join(texts.where("n_shingles > 0").withColumn("node", F.shiftleft("batch", 16) + F.col("idx")), by_set, "set_id", "rows", "component_id", total, "node")
    alone = texts.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("set_id"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "set_id", "component_id").union(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """One document of each group of linked documents: that whose id names the group; texts without words all stay.

    Rows alike in doc_id and text are one document, of which one row stays. Where ids repeat, a document is known by its
    doc_id and text together; of a group that of the least id (nulls last) and then the least md5 of the text stays.
    """
    named, row, gone = docs, free_name(docs.columns, "_row"), free_name(docs.columns, "_gone")
    repeats = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
        named = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text.alias("md5")))
    key = row if repeats else "doc_id"
    with scratch(docs.sparkSession) as keep:
        groups = jaccard_groups(named.select(F.col(key).alias("doc_id"), "text"), k, num, den)
        spare = groups.where("n_shingles > 0 and not (doc_id <=> component_id)").select(F.col("doc_id").alias(gone)).distinct()
        spare = keep(spare, "jaccard-gone")
    if spare.count() <= BROADCAST_IDS:
        spare = F.broadcast(spare)
    kept = named.join(spare, named[key].eqNullSafe(spare[gone]), "left_anti")
    return kept.drop(row).dropDuplicates(["doc_id", "text"]) if repeats else kept
