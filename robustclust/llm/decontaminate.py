"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame functions only.

Every window of ``size`` consecutive item words is a set whose tokens are ordered by rarity in the corpus. Containment
needs all tokens, so the necessary prefix is the rarest token alone: a document position holding it fixes where the
window would start; length and positional bounds discard impossible starts; the rest is verified word by word.

Defined results: a null or word-less text has no words and no hits; an item without words has no windows; repeated
item ids are one item, an item without an id hits but isn't counted; identical rows each get the same result; an empty
table gives no rows; a text of any length is read whole; extra columns are ignored, and ``drop_contaminated`` returns
them unchanged whatever their names. Frequent tokens of the shuffled join are split by adaptive skew handling.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustclust.llm.session import BROADCAST_IDS, free_name, scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: bytes of item text up to which windows (13 words each) are broadcast; a larger benchmark is shuffled
BROADCAST_ITEM_BYTES = 2 << 20


def word_array(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, window: the distinct windows of each item."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(size), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, length))).alias("window")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """doc_id, text_md5, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of ``docs``.

    contaminated: at least 1/``share`` of the words lie inside occurrences of item windows.
    """
    item_bytes = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    small = F.broadcast if item_bytes <= BROADCAST_ITEM_BYTES else (lambda df: df)
    owned = item_windows(items, size)
    texts = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), word_array(F.col("text")).alias("w"))

    windows = owned.select("window", F.md5(F.array_join("window", " ").cast("binary")).alias("window_id")).distinct()
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    counts = texts.select(F.explode("w").alias("token")).join(small(vocabulary), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = (
        windows.select("window_id", "window", F.posexplode("window").alias("offset", "token"))
        .join(small(counts), "token", "left")
        .groupBy("window_id", "window")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset")).alias("first"))
        .where(F.col("first.seen") > 0)
    )
    anchors = rarest.select(F.col("first.token").alias("token"), F.col("first.offset").alias("offset"), "window", "window_id")
    start, length = F.col("at") - F.col("offset"), F.size("window")
    if small is F.broadcast:
        fits = (start >= 0) & (start + length <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("window"))
        # the empty token stands after each text's last word and matches the empty window: it carries texts without hits
        empty = docs.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("window"), F.lit("").alias("window_id"))
        probes = texts.select("doc_id", "text_md5", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "token"))
        met = probes.join(F.broadcast(anchors.union(empty)), "token").where((length == 0) | fits)
        found = met.select("doc_id", "text_md5", F.size("w").alias("n_words"), start.alias("start"), length.alias("length"), "window_id")
    else:  # only the words around a position travel, not the whole text; texts without hits come by a union, not by a key
        probes = texts.select("doc_id", "text_md5", "w", F.posexplode("w").alias("at", "token"))
        first = F.greatest(F.col("at") - (size - 1), F.lit(0))
        near = probes.select("doc_id", "text_md5", "token", "at", F.size("w").alias("n_words"), first.alias("first"), F.slice("w", first + 1, 2 * size - 1).alias("near"))
        fits = (start >= 0) & (start + length <= F.col("n_words")) & (F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, length) == F.col("window"))
        hits = near.join(anchors, "token").where(fits).select("doc_id", "text_md5", "n_words", start.alias("start"), length.alias("length"), "window_id")
        found = hits.unionByName(texts.select("doc_id", "text_md5", F.size("w").alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window_id")))
    hit = F.col("length") > 0
    per_text = found.groupBy("doc_id", "text_md5").agg(
        F.max("n_words").alias("n_words"),
        F.sum((~hit).cast("int")).alias("rows"),
        F.collect_set(F.when(hit, F.struct("start", "length"))).alias("spans"),
        F.collect_set(F.when(hit, F.col("window_id"))).alias("windows"),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    owners = owned.select("item_id", F.md5(F.array_join("window", " ").cast("binary")).alias("window_id"))
    listed = (
        per_text.select("doc_id", "text_md5", "n_words", "rows", covered.alias("n_hit"), F.explode_outer("windows").alias("window_id"))
        .join(small(owners), "window_id", "left")
        .groupBy("doc_id", "text_md5")
        .agg(F.first("n_words").alias("n_words"), F.first("rows").alias("rows"), F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    out = listed.select(
        "doc_id",
        "text_md5",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    id_, md5, key = (free_name(docs.columns, name) for name in ("_id", "_md5", "_key"))
    with scratch(docs.sparkSession) as keep:
        judged = decontaminate(docs, items, size, share).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_md5").alias(md5)).distinct()
        judged = keep(judged, "contaminated")
    gone = F.broadcast(judged) if judged.count() <= BROADCAST_IDS else judged
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(judged[id_]) & (keyed[key] == judged[md5]), "left_anti").drop(key)
