"""Packing of tokenised documents into sequences of bounded length.

What has to be packed is a multiset of integer lengths up to the capacity, so the instance is fully described by how
often each length occurs: at most ``capacity`` numbers, whatever the corpus holds.  Martello-Toth dominance reduction
fixes sets that provably dominate every alternative, the rest is packed by best fit decreasing, and both work on counts.
The resulting plan - bounded by the capacity as well - is applied on the executors by each piece's rank in its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import materialise

CAPACITY = 1024
END = 2
#: Pre-tokens whose ids a worker remembers within a task, and beyond one: workers go on to other stages with what they hold.
MOST_WORDS, KEPT_WORDS = 300_000, 60_000


class Slot(NamedTuple):
    """Pieces of length ``size`` ranked first_rank .. first_rank + n - 1 go to ``offset`` in n consecutive sequences."""

    size: int
    first_rank: int
    n: int
    first_sequence: int
    offset: int


def dominance_reduction(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take out of ``counts`` all sets that dominate every other set with their largest item; returns (set, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def others(s):
        """Sizes left beside one item s, ascending."""
        return [x for x in sorted(counts) if counts[x] > (x == s)]

    changed = True
    while changed:
        changed = False
        for s in sorted(counts, reverse=True):
            while counts[s] > 0:
                room = capacity - s
                beside = others(s)
                fitting = [x for x in beside if x <= room]
                if not fitting:
                    chosen, times = (s,), counts[s]
                else:
                    k, least = fitting[-1], fitting[0]
                    second = least if counts[least] - (least == s) > 1 else next(iter(fitting[1:]), None)
                    two_fit = second is not None and least + second <= room
                    if k != room and two_fit and _best_sum(fitting, room) > k:
                        break  # a set of smaller items may do better: left to best fit
                    chosen, times = (s, k), counts[s] // 2 if k == s else min(counts[s], counts[k])
                fixed.append((chosen, times))
                for x in chosen:
                    counts[x] -= times
                changed = True
            if counts[s] == 0:
                del counts[s]
    return fixed


def _best_sum(sizes: list[int], room: int) -> int:
    """The largest sum up to ``room`` that any number of items of these sizes can reach."""
    reach, mask = 1, (1 << (room + 1)) - 1
    for s in sizes:
        step = s
        while step <= room:
            reach |= (reach << step) & mask
            step *= 2
    return reach.bit_length() - 1


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: equal bins are handled together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        n = counts[s]
        for room in sorted(r for r in open_bins if r >= s):
            while n and room >= s and open_bins.get(room):
                inside, times = open_bins[room].pop()
                each = min(room // s, -(-n // times))
                whole = min(times, n // each)
                if whole:
                    open_bins[room - each * s].append((inside + (s,) * each, whole))
                    n -= whole * each
                if times > whole:
                    open_bins[room].append((inside, times - whole))
                    if each > n:
                        part = n
                        if part:
                            inside, times = open_bins[room].pop()
                            open_bins[room - part * s].append((inside + (s,) * part, 1))
                            if times > 1:
                                open_bins[room].append((inside, times - 1))
                            n = 0
            if not n:
                break
        each = capacity // s
        if n >= each:
            open_bins[capacity - each * s].append(((s,) * each, n // each))
        if n % each:
            open_bins[capacity - n % each * s].append(((s,) * (n % each), 1))
    return [x for group in open_bins.values() for x in group]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for all pieces, given how many there are of each length."""
    counts = Counter({s: n for s, n in lengths.items() if n})
    sets = [((capacity,), counts.pop(capacity))] if capacity in counts else []
    sets += dominance_reduction(counts, capacity)
    sets += best_fit(counts, capacity)
    ranks, sequence, slots = Counter(), 0, []
    for inside, times in sets:
        offset = 0
        for s in inside:
            slots.append(Slot(s, ranks[s], times, sequence, offset))
            ranks[s] += times
            offset += s
        sequence += times
    return slots


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level BPE writes bytes: printable ones stand for themselves, others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


class Ids(dict):
    """Token ids of pre-tokens as little-endian 32-bit bytes; byte-level BPE never crosses a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens stand for themselves wherever a text has them, so such texts are left to the tokenizer.
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content) or r"(?!)").search
        self.letters = byte_letters()
        letters = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+| ?[^\s{letters}0-9]+|\s+(?!\S)|\s+").findall
        self.unusual = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]").search

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        """A pre-token goes straight to the tokenizer's model, which takes bytes written as characters."""
        out = array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if self.unusual(text) or self.added(text):  # beyond Latin letters, splitting is left to the tokenizer
            return self.encode(text)
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids; the remainder comes first."""
    n = len(ids) // 4
    first = n % capacity or capacity
    cuts = [0, *range(min(first, n), n + 1, capacity)] if n else [0]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _pieces(path: str, capacity: int, end: int):
    tail = end.to_bytes(4, "little")

    def run(batches):
        ids = _ids(path)
        of = ids.of
        for batch in batches:
            out = [(doc, *p) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for p in pieces_of(of(text.as_py() or "") + tail, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if len(ids) > KEPT_WORDS:
            ids.clear()

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone.  Repeated rows are packed as often as they occur.  Pieces of equal
    length are interchangeable; which goes where follows doc_id and piece.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long"
    pieces = materialise(rows.mapInArrow(_pieces(path or tokenizer_path(), capacity, end), schema), "pieces")
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    spark = docs.sparkSession
    # pieces of one length are ranked in as many parts as a part has pieces
    parts = spark.createDataFrame([(s, isqrt(n - 1) + 1) for s, n in lengths.items()] or [(0, 1)], "length long, parts long")
    slots = spark.createDataFrame([tuple(x) for x in plan(lengths, capacity)] or [(0, 0, 0, 0, 0)],
        "length long, first_rank long, n long, first_sequence long, `offset` long")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    by_part = salted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(inside) - 1).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rn"))
    slot = F.broadcast(slots.withColumnRenamed("length", "size"))  # bounded by the capacity
    placed = ranked.join(slot, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
