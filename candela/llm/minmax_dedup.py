"""Near-duplicate groups by min-max hashing.

Each permutation gives two signature values, the smallest and the largest permuted shingle, so half the hash
evaluations of plain MinHash yield the same number of unbiased values.  Values are banded; documents that share a band
are candidates, and a link stands only when the full shingle sets agree.

Copies of one shingle set, by a cryptographic digest of the whole set, are one class from the start.  Within a band bucket every class is first checked against the
bucket's smallest class, which is linear in the bucket.  Buckets whose members still belong to several components are
then checked completely in blocks of bounded size, so no link between different texts is lost to the choice of leader.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import checkpoint, materialise
from candela.llm.graph import components
from candela.llm.hashing import U64, mix, shingles

BANDS, ROWS = 24, 5
WIDTH = 5
#: A link: 100 * intersection >= LINK * union.
LINK = 85
#: Members of a bucket in one block of the complete check.
BLOCK = 400
#: A bucket with more than this share of all classes, or that many, is dealt out over several tasks; there are few such.
HOT_BUCKET, LEAST_HOT = 1 / 1000, 200
_PERMUTATIONS = BANDS * ROWS // 2
_rng = np.random.default_rng(977)
_XOR = _rng.integers(1, 2**63, _PERMUTATIONS, dtype=np.uint64)[:, None]
_MUL = (_rng.integers(1, 2**63, _PERMUTATIONS, dtype=np.uint64) | U64(1))[:, None]


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation."""
    low = np.full(_PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(_PERMUTATIONS, np.uint64)
    for at in range(0, len(found), 4096):
        values = (found[None, at : at + 4096] ^ _XOR) * _MUL
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_keys(found: np.ndarray) -> np.ndarray:
    values = signature(found).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * U64(0xD6E8FEB86659FD93) + values[:, k])
    return keys.view(np.int64)


def linked(inter, a, b, link: int = LINK):
    return 100 * inter >= link * (a + b - inter)


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                if len(found):
                    rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=20).digest(), band_keys(found)))
                else:
                    rows.append((0, None, None))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_shingles", "whole", "bands"])

    return run


def _confirm(width: int, link: int):
    @F.arrow_udf("boolean")
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, left = [], None, None
        for x, y in zip(a, b, strict=True):  # one pair of texts at a time becomes Python strings
            x, y = x.as_py(), y.as_py()
            if x != last or left is None:
                last, left = x, shingles(x, width)
            right = shingles(y, width)
            out.append(bool(linked(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), link)))
        return pa.array(out, pa.bool_())

    return check


def block_links(labels: list, sides: list, sets: list[np.ndarray], link: int = LINK) -> list[tuple]:
    """Links that join different labels in one block, at most one fewer than its labels.

    ``sides``: with two sides only pairs across them are looked at.
    """
    parent = {x: x for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    words, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    present = np.zeros(len(words), np.int32)
    side, found = np.array(sides), []
    names = np.array(labels)
    common = Counter(labels)
    most = max(common, key=common.get)
    order = sorted(range(len(sets)), key=lambda i: (labels[i] == most, common[labels[i]]))
    done = np.zeros(len(sets), bool)
    for i in order:
        if labels[i] == most:  # all others have met the commonest label's members by now
            break
        done[i] = True
        mates = ~done & (names != labels[i]) & (np.minimum(sizes, sizes[i]) * 100 >= link * np.maximum(sizes, sizes[i]))
        if len(set(sides)) > 1:
            mates &= side != side[i]
        if not mates.any():
            continue
        mine = places[starts[i] : starts[i] + sizes[i]]
        present[mine] = 1
        inter = np.add.reduceat(present[places], starts)
        present[mine] = 0
        for j in np.flatnonzero(mates & linked(inter, sizes, sizes[i], link)):
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((max(a, b), min(a, b)))
    return found


def _blocks(width: int, link: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = block_links(rows["label"].tolist(), rows["side"].tolist(), [shingles(t, width) for t in rows["text"]], link)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _for_each_deal(buckets: DataFrame) -> DataFrame:
    """A row of each bucket for each of the tasks it is dealt out over."""
    return buckets.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))


def near_duplicates(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs(doc_id, text, ...)``.

    Texts that are null, empty or without words have no shingles and are their own component, as are rows without a
    ``doc_id``.  Rows that share a ``doc_id`` are one document and land in one component.  An empty table gives an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, whole binary, bands array<long>"
    marks = materialise(docs.mapInArrow(_signatures(width), schema), "minmax")
    named = marks.where("whole is not null and doc_id is not null")
    classes = materialise(named.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "n_shingles"), "doc_id").alias("b")), "classes")
    spread = classes.select("rep", F.col("b.n_shingles").alias("n"), F.explode("b.bands").alias("key"))
    hot = max(int(classes.count() * HOT_BUCKET), LEAST_HOT)
    buckets = spread.groupBy("key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("leader_n"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = materialise(buckets.withColumn("deals", F.ceil(F.col("m") / hot).cast("int")), "buckets")
    # by the pigeonhole principle at most BANDS / HOT_BUCKET buckets are hot
    crowded = F.broadcast(buckets.where("deals > 1").select("key", "deals"))
    dealt = spread.join(crowded, "key", "left").withColumn("deal", F.when(F.col("deals").isNull(),
        0).otherwise(F.pmod(F.xxhash64("rep"), F.col("deals")).cast("int"))).drop("deals")
    members = materialise(dealt.join(_for_each_deal(buckets), ["key", "deal"]), "members")
    smaller, larger = F.least("n", "leader_n"), F.greatest("n", "leader_n")
    pairs = members.where((F.col("rep") != F.col("leader")) & (smaller * 100 >= larger * link)).select("leader", "rep").distinct()
    texts = docs.where("doc_id is not null")
    left = texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("a"))
    right = texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("b"))
    confirmed = pairs.join(left, "leader").join(right, "rep").where(_confirm(width, link)("a", "b"))
    first = components(confirmed.select(F.col("rep").alias("u"), F.col("leader").alias("v")))
    labelled = members.where("m > 2").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label",
        F.coalesce("label", "rep")).select("key", "deal", "deals", "rep", "label")
    labelled = checkpoint(labelled)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"),
        F.first("deals").alias("deals")).where("lo <> hi")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    mixed = _for_each_deal(mixed.select("key", "deals", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))).drop("deals")
    rest = labelled.join(mixed, ["key", "deal"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("rep", "label", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"))
    blocks = rest.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    found = blocks.groupBy("key", "i", "j").applyInPandas(_blocks(width, link), "u long, v long")
    second = components(found)
    rows = marks.select("doc_id", "n_shingles", "whole").join(classes.select("whole", "rep"), "whole", "left")
    rows = rows.withColumn("rep", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("rep", "doc_id")))
    rows = rows.join(first.select(F.col("node").alias("rep"), F.col("label").alias("l1")), "rep", "left").withColumn("l1", F.coalesce("l1", "rep"))
    rows = rows.join(second.select(F.col("node").alias("l1"), F.col("label").alias("l2")), "l1", "left").withColumn("component_id", F.coalesce("l2", "l1"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest ``doc_id``, once even if its row repeats."""
    marked = checkpoint(near_duplicates(docs, width, link).select("doc_id", "kept"))
    gone = marked.where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = marked.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return out.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
