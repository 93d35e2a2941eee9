"""Removal of every byte that an earlier string of a minimum length covers.

The corpus is cut so that equal strings meet: each window of ``least`` bytes belongs to its minimizer, the byte k-gram of
least hash in it, and the windows of one minimizer that follow one another are one fragment.  Fragments that are equal
whole are settled by 128 bits of hashes, wherever they are, with nothing but hashes moved.  The texts of the others -
several different fragments around one minimizer - meet in groups of bounded size, where threshold-bounded interval
expansion on the group's Burrows-Wheeler transform finds the windows they share.  A minimizer with too many fragments for
one group is split: windows that are equal also agree in what stands around the minimizer, on the side where more of the
window lies, so each side's windows meet by that; as often as need be, until a key is the whole window.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.bwt import boundaries, suffix_order
from candela.llm.common import materialise
from candela.llm.hashing import U64, mix, powers, prefix_sums

LEAST, GRAM = 100, 32
#: Text bytes that feed one hash group and one text group, on average.
HASH_GROUP, TEXT_GROUP = 6_000_000, 1_000_000
#: Different fragments of one key that meet in one transform; keys with more are split.
CROWD = 5_000
_SEGMENT, _FLUSH = 1 << 20, 400_000
_PLACE = U64((1 << 24) - 1)


def fragments(data: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, fragment hash, first window, windows) of the fragments of one text, in order."""
    out = []
    for at in range(0, max(len(data) - least + 1, 0), _SEGMENT):
        part = data[at : at + _SEGMENT + least - 1]
        sums = prefix_sums(part)
        _, down = powers(len(part) + 1)
        grams = len(part) - gram + 1
        hashed = mix((sums[gram:] - sums[:grams]) * down[:grams])
        ranked = (hashed & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        width, windows = least - gram + 1, len(part) - least + 1
        padded = np.full(-(-grams // width) * width, 2**64 - 1, np.uint64)
        padded[:grams] = ranked
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACE
        first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
        count = np.diff(np.concatenate([first, [windows]]))
        end = first + count + least - 1
        whole = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
        out.append((hashed[chosen[first].astype(np.int64)], whole, first + at, count))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_COLUMNS = (np.dtype("<u8"), np.dtype("<u8"), np.dtype("<i8"), np.dtype("<u4"), np.dtype("u1"))


def _join(columns) -> bytes:
    return struct.pack("<q", len(columns[0])) + b"".join(c.astype(t).tobytes() for c, t in zip(columns, _COLUMNS[-len(columns) :], strict=True))


def _split(blob: bytes, width: int) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<q", blob), 8, []
    for t in _COLUMNS[-width:]:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * t.itemsize
    return out


def _firsts(key, frag, doc, lo, n):
    """Columns sorted by fragment and place, whether each row is its fragment's first place, and whether a repeat."""
    order = np.lexsort((lo, doc, frag, key))
    key, frag, doc, lo, n = (c[order] for c in (key, frag, doc, lo, n))
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (frag[1:] != frag[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    repeat = (doc != doc[head]) | (lo != lo[head])
    return (key, frag, doc, lo, n), first, repeat


def _scan(groups: int):
    def run(batches):
        held, size = [], 0

        def flush():
            columns, first, repeat = _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            kept = [c[first] for c in columns]
            place = (mix(kept[0] + kept[1]) % U64(groups)).astype(np.int64)  # a common minimizer's fragments go everywhere
            order = np.argsort(place, kind="stable")
            kept, place = [c[order] for c in kept], place[order]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            rows = [(int(place[a]), True, _join([c[a:b] for c in kept])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            settled = [c[repeat] for c in columns[2:]]
            if len(settled[0]):
                rows.append((int(settled[0][0]) % groups, False, _join(settled)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]),
                pa.array([r[2] for r in rows], pa.binary())], ["part", "open", "blob"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                if len(data) >= LEAST:
                    key, frag, lo, n = fragments(data)
                    held.append((key, frag, np.full(len(key), doc, np.int64), lo, n))
                    size += len(key)
                    if size >= _FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


_MARKS = "first boolean, doc long, lo long, n int, key long"


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """What the hashes of one group say: each different fragment's first place, and the places that repeat it."""
    out = []
    for blob in rows.loc[~rows["open"], "blob"]:
        doc, lo, n = _split(blob, 3)
        out.append(pd.DataFrame({"first": False, "doc": doc, "lo": lo, "n": n, "key": 0}))
    found = [_split(blob, 5) for blob in rows.loc[rows["open"], "blob"]]
    if found:
        (key, _, doc, lo, n), first, repeat = _firsts(*(np.concatenate(x) for x in zip(*found, strict=True)))
        out.append(pd.DataFrame({"first": False, "doc": doc[repeat], "lo": lo[repeat], "n": n[repeat], "key": 0}))
        out.append(pd.DataFrame({"first": True, "doc": doc[first], "lo": lo[first], "n": n[first], "key": key[first].view(np.int64)}))
    return pd.concat(out).astype({"lo": "int64", "n": "int32", "key": "int64"})


def _cut(batches):
    """Fragments' texts with the group where they meet; 0 is for crowded minimizers."""
    for batch in batches:
        part, docs, places, texts = [], [], [], []
        for doc, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer()
            group, lo, n = (spots.values.field(i).to_pylist() for i in range(3))
            part += group
            docs += [doc] * len(group)
            places += lo
            texts += [data[a : a + w + LEAST - 1].to_pybytes() for a, w in zip(lo, n, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()),
            pa.array(texts, pa.binary())], ["part", "doc", "lo", "frag"])


_SIDES = "key long, at int, left int, right int, doc long, lo long, frag binary"


def sides(frag: bytes, at: int, left: int, right: int, least: int = LEAST) -> list[tuple[int, int, int, int, int, bytes]]:
    """(key, at, left, right, shift, sub-fragment) of the two parts of a fragment whose windows share the bytes from ``left`` to ``right`` around ``at``.

    What a window has beyond these lies to their left and right; the larger part's next half of what is beyond joins
    them, and the key is a hash of them all.
    """
    n, beyond, out = len(frag) - least + 1, least - (right - left), []
    more = -(-beyond // 2)
    windows = np.arange(n)
    to_right = windows + least - (at + right) >= at + left - windows
    for chosen, a, b in ((to_right, left, right + more), (~to_right, left - more, right)):
        mine = np.flatnonzero(chosen)
        if len(mine):
            first, last = int(mine[0]), int(mine[-1])
            held = hashlib.blake2b(frag[at + a : at + b], digest_size=8, salt=struct.pack("<hh", a, b)).digest()
            out.append((int.from_bytes(held, "little", signed=True), at - first, a, b, first, frag[first : last + least]))
    return out


def _around(batches):
    """The parts of fragments of crowded minimizers, or of parts that are still crowded."""
    for batch in batches:
        rows = []
        known = "at" in batch.schema.names
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (("doc", "lo", "frag", "at", "left", "right") if known else ("doc", "lo", "frag"))]
        for doc, lo, frag, *rest in zip(*columns, strict=True):
            if not known:
                data = np.frombuffer(frag, np.uint8)
                sums, (_, down), grams = prefix_sums(data), powers(len(data) + 1), len(data) - GRAM + 1
                rest = int(np.argmin(mix((sums[GRAM:] - sums[:grams]) * down[:grams]) & ~_PLACE)), 0, GRAM
            rows += [(key, at, a, b, doc, lo + shift, part) for key, at, a, b, shift, part in sides(frag, *rest)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _SIDES.split(", ")])


def repeated_windows(docs: np.ndarray, places: np.ndarray, texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first window, windows): runs of the fragments' windows that equal a window at an earlier place of the group."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, and 0 is free to separate
    text = np.zeros(len(joined) + len(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(text)) - starts[owner]
    text[inside < sizes[owner]] = joined
    order = suffix_order(text, least)
    marked = boundaries(text, order, least)
    window = (inside + least <= sizes[owner])[order]
    marked[1:] |= ~window[:-1]
    group = np.cumsum(marked)[window]
    if not len(group):
        return (np.zeros(0, np.int64),) * 3
    at = order[window]
    _, rank = np.unique(docs, return_inverse=True)
    place = (rank[owner[at]].astype(np.int64) << 34) + places[owner[at]] + inside[at]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.minimum.reduceat(place, heads)
    late = place > np.repeat(earliest, np.diff(np.concatenate([heads, [len(group)]])))
    hit = np.sort(at[late])
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
    first = hit[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(hit)]]))
    return docs[owner[first]], places[owner[first]] + inside[first], count


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    doc, lo, n = repeated_windows(rows["doc"].to_numpy(), rows["lo"].to_numpy(), rows["frag"].tolist())
    return pd.DataFrame({"doc": doc, "lo": lo, "n": n})


def _groups_of(size: int):
    """The transform a key's fragments meet in, given their bytes in all."""
    return F.pmod(F.xxhash64("key"), F.lit(max(8, -(-size // TEXT_GROUP)))) + 1


def _crowds(crowd: DataFrame) -> DataFrame:
    """(doc, lo, n): windows of crowded minimizers' fragments ``crowd(doc, lo, frag)`` that repeat an earlier one."""
    late, rows = None, crowd.mapInArrow(_around, _SIDES)
    windows = (F.octet_length("frag") - (LEAST - 1)).cast("long").alias("n")
    while True:
        rows = materialise(rows, "sides")
        firsts = rows.groupBy("key", "frag").agg(F.min(F.struct("doc", "lo")).alias("place"), F.first("at").alias("at"), F.first("left").alias("left"),
            F.first("right").alias("right"), F.count(F.lit(1)).alias("n"))
        firsts = materialise(firsts, "first-sides")
        again = rows.join(firsts.where("n > 1").select("key", "frag", "place"), ["key", "frag"]).where("doc <> place.doc or lo <> place.lo").select("doc", "lo", windows)
        counts = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        several = materialise(firsts.join(counts, "key").select("key", "at", "left", "right", "place.doc", "place.lo", "frag", "kinds"), "several-sides")
        few = several.where(F.col("kinds") <= CROWD)
        size = few.agg(F.sum(F.octet_length("frag"))).first()[0] or 0
        met = few.withColumn("part", _groups_of(size)).groupBy("part").applyInPandas(_meet, "doc long, lo long, n long")
        late = again.unionByName(met) if late is None else late.unionByName(again).unionByName(met)
        many = several.where(F.col("kinds") > CROWD)
        if many.isEmpty():
            return late
        rows = many.drop("kinds").mapInArrow(_around, _SIDES)


def removed(size: int, spots: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows of packed spots (first window << 8 | windows)."""
    if not len(spots):
        return []
    lo = np.sort(spots)
    start, end = lo >> 8, (lo >> 8) + (lo & 0xFF) + least - 1
    end = np.minimum(np.maximum.accumulate(end), size)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(lo) - 1]])
    return list(zip(start[first].tolist(), end[last].tolist(), strict=True))


def _report(keep_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode() if text.is_valid else b""
                found = spots.values.to_numpy(zero_copy_only=False) if spots.is_valid else np.zeros(0, np.int64)
                runs, past, kept = removed(len(data), found), 0, []
                for a, b in runs:
                    kept.append(data[past:a])
                    past = b
                rest = b"".join([*kept, data[past:]])
                row = (doc, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest())
                rows.append((*row, rest) if keep_text else row)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``, a row for each row of ``docs(doc_id, text, ...)``.

    A byte goes if a string of ``LEAST`` bytes covers it that also starts earlier: in a document of smaller doc_id, or
    earlier in its own.  Overlaps count, and strings are judged on the input.  Null texts are empty; texts shorter than
    ``LEAST`` stay whole.  Rows that repeat a doc_id must repeat its text and are one document; rows without a doc_id
    stay whole and remove nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.where("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(8, -(-total // HASH_GROUP))
    scanned = named.mapInArrow(_scan(groups), "part int, open boolean, blob binary")
    marks = materialise(scanned.groupBy("part").applyInPandas(_settle, _MARKS), "marks")
    firsts = marks.where("first")
    kinds = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    needed = materialise(firsts.join(kinds, "key").select("doc", "lo", "n", "key", "kinds"), "contested")
    size, most = needed.agg(F.sum(F.col("n") + LEAST), F.max("kinds")).first()
    part = F.when(F.col("kinds") > CROWD, F.lit(0).cast("long")).otherwise(_groups_of(size or 0))
    wanted = needed.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct(part.alias("part"), "lo", "n")).alias("spots"))
    cut = named.join(wanted, "doc_id").select("doc_id", "text", "spots").mapInArrow(_cut, "part long, doc long, lo long, frag binary")
    late = cut.where("part > 0").groupBy("part").applyInPandas(_meet, "doc long, lo long, n long")
    late = late.unionByName(marks.where("not first").select("doc", "lo", F.col("n").cast("long").alias("n")))
    if (most or 0) > CROWD:
        late = late.unionByName(_crowds(cut.where("part = 0").select("doc", "lo", "frag")))
    spot = F.shiftleft("lo", 8) + F.col("n")
    spans = late.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(spot).alias("spots"))
    told = named.join(spans, "doc_id", "left").select("doc_id", "text", "spots")
    told = told.unionByName(rows.where("doc_id is null").withColumn("spots", F.lit(None).cast("array<long>")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return told.mapInArrow(_report(keep_text), schema)
