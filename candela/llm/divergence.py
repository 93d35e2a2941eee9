"""How the sources of a language differ in their words.

Partitions count terms in byte tries, one a language, with counters of each source at the leaves.  A trie travels as its
leaves in the order of their bytes, cut into ranges of prefixes; where the ranges of all partitions meet in one order,
equal leaves add up and the merged trie is traversed without being held whole.  The traversal of a range gives its share
of the distance of each pair of sources and its best terms of each source; the shares are added and the best ranked.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import materialise, utf8
from candela.llm.trie import SourceTrie

#: Documents of a language that a kept term is in, and terms listed of each source.
MIN_DOCS, TOP = 10, 10
#: Entries that a partition counts before its tries are sent on, rows that are sent at once, entries of one range of the merged trie.
HELD, SENT, RANGE_ENTRIES = 400_000, 100_000, 50_000
#: Sources of which one task sums the pairs with all others.
BLOCK = 512
#: Cells of the table of shares that are looked at together.
CELLS = 1 << 19
#: A-Z as a-z, other ASCII as a space.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
LEAVES = "lang string, term binary, source string, n long, docs long"
KEPT = "lang string, range_no long, term binary, source string, n long, first long"
PARTS = "lang string, part string, source string, item string, value long"


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and of anything beyond ASCII in a text's UTF-8, A-Z lower-cased."""
    return text.translate(_TERM).split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the tries of a partition's documents; the empty term stands for the documents themselves."""
    counters: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def leaves() -> Iterator[pa.RecordBatch]:
        tries: dict[str, SourceTrie] = {}
        for (lang, source), (occurrences, documents) in counters.items():
            occurrences[b""] = 0
            tries.setdefault(lang, SourceTrie()).add(source, occurrences, documents)
        counters.clear()
        for lang in sorted(tries):
            words, sources, term, source, n, docs = tries.pop(lang).leaves()
            words, sources = pa.array(words, pa.binary()), pa.array(sources, pa.string())
            for i in range(0, len(term), SENT):
                part = slice(i, i + SENT)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(term[part])), words.take(pa.array(term[part])), sources.take(pa.array(source[part])),
                    pa.array(n[part]), pa.array(docs[part])], [c.split()[0] for c in LEAVES.split(", ")])

    for batch in batches:
        columns = [batch.column(c) for c in ("lang", "source")]
        for lang, source, text in zip(*[c.to_pylist() for c in columns], batch.column("text").cast(pa.binary()), strict=True):
            occurrences, documents = counters.get((lang, source)) or counters.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text.as_py())
            occurrences.update(found)
            documents.update(set(found))
            documents[b""] += 1
        if sum(len(c) for _, c in counters.values()) > HELD:
            yield from leaves()
    yield from leaves()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from those before them."""
    new = np.ones(len(columns[0]), np.bool_)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _changes(column: pa.Array) -> np.ndarray:
    """A number a run of equal values, in order."""
    if len(column) < 2:
        return np.zeros(len(column), np.int64)
    return np.concatenate([[0], np.cumsum(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False))])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal leaves of a stream in the order of lang, term and source, and numbers ranges of those that are kept.

    The rows of the last term of a batch wait for the next one; a term has a row for each source and trie at most.
    """
    task = TaskContext.get().partitionId() << 32
    number, filled, lang_now = 0, 0, None
    waiting: pa.RecordBatch | None = None

    def kept(rows: pa.RecordBatch, of_lang: np.ndarray, of_term: np.ndarray) -> pa.RecordBatch:
        nonlocal number, filled, lang_now
        at = _runs(of_lang, of_term, _changes(rows.column("source")))
        n, docs = (np.add.reduceat(rows.column(c).to_numpy(), at) for c in ("n", "docs"))
        heads = _runs(of_lang[at], of_term[at])
        sizes = np.diff(np.append(heads, len(at)))
        named = pc.binary_length(rows.column("term").take(pa.array(at[heads]))).to_numpy() > 0
        stays = np.flatnonzero((np.add.reduceat(docs, heads) >= MIN_DOCS) & named)
        langs, ranges = rows.column("lang").take(pa.array(at[heads[stays]])).to_pylist(), np.zeros(len(heads), np.int64)
        for i, lang in zip(stays, langs, strict=True):
            if lang != lang_now or filled >= RANGE_ENTRIES:
                number, filled, lang_now = number + 1, 0, lang
            filled += sizes[i]
            ranges[i] = task + number
        first = np.zeros(len(at), np.int64)
        first[heads] = 1
        stay = np.zeros(len(heads), np.bool_)
        stay[stays] = True
        take = np.repeat(stay, sizes)
        rows = rows.take(pa.array(at[take]))
        return pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(np.repeat(ranges, sizes)[take]), rows.column("term"), rows.column("source"), pa.array(n[take]),
            pa.array(first[take])], [c.split()[0] for c in KEPT.split(", ")])

    for batch in batches:
        rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        if rows.num_rows:
            of_lang, of_term = _changes(rows.column("lang")), _changes(rows.column("term"))
            last = int(_runs(of_lang, of_term)[-1])
            waiting = rows.slice(last)
            if last:
                yield kept(rows.slice(0, last), of_lang[:last], of_term[:last])
    if waiting is not None:
        yield kept(waiting, _changes(waiting.column("lang")), _changes(waiting.column("term")))


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), three digits at a time: exact up to totals of 9 * 10**15."""
    whole = np.asarray(total, np.int64) + 2 * kept
    rest, out = np.asarray(count, np.int64) + 2, np.int64(0)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) for numbers from 1 to 10**9 + 1."""
    return (p - q) ** 2 // (p + q)


def _traverse(key: tuple, leaves: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """A range's share of the distances of one block of sources to all after them, and the block's best terms in the range."""
    lang, _, block = key
    groups = groups.sort_values("place", ignore_index=True)
    names, place = groups["source"].to_numpy(object), {s: i for i, s in enumerate(groups["source"])}
    totals, kept, lang_total = groups["total"].to_numpy(np.int64), int(groups["kept_terms"].iloc[0]), int(groups["lang_total"].iloc[0])
    words, at = np.unique(leaves["term"].to_numpy(object), return_inverse=True)  # in the order of their bytes
    of, n = leaves["source"].map(place).to_numpy(np.int64), leaves["n"].to_numpy(np.int64)
    in_lang = np.zeros(len(words), np.int64)
    np.add.at(in_lang, at, n)
    p, q = share(n, totals[of], kept), share(in_lang, lang_total, kept)
    mine = np.flatnonzero(groups["block"].to_numpy(np.int64) == block)
    inside = np.isin(of, mine)
    value = distance(p, q[at])
    better = np.flatnonzero(inside & (n > 0) & (p > q[at]))
    better = better[np.lexsort((at[better], -value[better], of[better]))]
    begins = _runs(of[better])
    rank = np.arange(len(better)) - np.repeat(begins, np.diff(np.append(begins, len(better))))
    best = better[rank < TOP]
    found = pd.DataFrame({"part": "term", "source": names[of[best]], "item": [t.decode("utf-8", "surrogatepass") for t in words[at[best]]], "value": value[best]})
    none = share(np.zeros(len(names), np.int64), totals, kept)
    sums = np.zeros((len(mine), len(names)), np.int64)
    step = max(1, CELLS // max(1, len(names)))
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(0, len(words) + step, step))
    for i in range(len(bounds) - 1):
        rows = order[bounds[i] : bounds[i + 1]]
        table = np.tile(none, (min(step, len(words) - i * step), 1))
        table[at[rows] - i * step, of[rows]] = p[rows]
        for k, s in enumerate(mine):
            sums[k, s + 1 :] += distance(table[:, s : s + 1], table[:, s + 1 :]).sum(0)
    left, right = np.nonzero(np.arange(len(names)) > mine[:, None])
    pairs = pd.DataFrame({"part": "pair", "source": names[mine[left]], "item": names[right], "value": sums[left, right]})
    out = pd.concat([found, pairs], ignore_index=True)
    out.insert(0, "lang", lang)
    return out


def audit_sources(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source's distance to the others of its language, and its terms.

    Part ``pair`` has every other source of the language, the most distant first; part ``term`` the ten terms that the
    source has more of than its language and that differ most, of equal ones the smaller in UTF-8.  Null text, language
    and source are empty, and empty ones are a language and a source like others; sources without terms take part; where
    a language keeps no term all distances are 0.  Repeated rows count each.  An empty table gives no rows; other columns
    are not read.  Texts and terms may be of any length.
    """
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")}
    read = docs.select(blank["lang"].alias("lang"), blank["source"].alias("source"), utf8("text").alias("text"))
    leaves = materialise(read.mapInArrow(_count, LEAVES), "divergence-leaves")
    ordered = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = materialise(ordered.mapInArrow(_merge, KEPT), "divergence-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("kept_terms"))
    occurring = leaves.where(F.octet_length("term") == 0).select("lang", "source").distinct()
    placed = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept_terms"])
    groups = materialise(groups.withColumn("place", placed).withColumn("block", (F.col("place") / BLOCK).cast("int")), "divergence-groups")
    blocks = groups.select("lang", "block").distinct()
    ranges = kept.select("lang", "range_no").distinct().join(blocks, "lang")
    names = ("lang", "range_no", "task_block", "source", "total", "lang_total", "kept_terms", "place", "block")
    theirs = ranges.withColumnRenamed("block", "task_block").join(groups, "lang").select(*names).toDF(*names)  # columns of its own beside the leaves'
    cut = kept.join(blocks.withColumnRenamed("block", "task_block"), "lang").groupBy(*names[:3])
    parts = materialise(cut.cogroup(theirs.groupBy(*names[:3])).applyInPandas(_traverse, PARTS), "divergence-parts")
    upper = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = upper.select("lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"))
    bare = groups.where("kept_terms = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = both.select("lang", "x.source", "x.item", "value").unionByName(zero)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH read AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM read),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, coalesce(sum(n), 0)::HUGEINT AS total, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM read) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM read),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""
