"""How five filters interact: what each removes alone, after others, and on average over all orders.

Every document gets five failure flags; documents are counted by flags and part, and a CUBE over these counts gives, in
the rows whose selected flags are all false, how many documents survive each subset of the filters.  A filter's step in
an order is the difference of two subsets, so all orders come from joins of 32 rows a part.

A: fewer than 100 words.  B: fewer than 80 distinct words a 100.  C: more than 10 capitals a 100 code points.  D: one of
``#$%&*|``.  E: the same text as a document with a smaller doc_id.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import utf8

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PER_100, CAPITALS_PER_100 = 100, 80, 10
_SPACE, _CAPITALS, _SIGNS = r"[\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[#$%&*|]"
_COUNTS = ("kept", "good", "toxic")


def _own_flags(text: Column, words: Column) -> dict[str, Column]:
    """The flags that follow from a document's text alone."""
    n, size = F.size(words), F.length(text)
    capitals = size - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": n < MIN_WORDS,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(DISTINCT_PER_100) * n,
        "C": F.lit(100) * capitals.cast("long") > F.lit(CAPITALS_PER_100) * size,
        "D": F.rlike(text, F.lit(_SIGNS)),
    }


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A, B, C, D, E, kept, good, toxic)``: how many documents have these flags, are of quality 1, are toxic.

    ``part`` is the language; null and the empty string are one part.  A null text is empty.  Rows that repeat a doc_id
    count each, and none of those with a text's smallest doc_id is a copy; rows without a doc_id have no place in the
    order: they are no copies, nor is anything a copy of them, and they have no labels.  Of several labels of a doc_id
    the larger count.

    Texts stay where they are read.  What moves is a digest and a few flags a document, collapsed by document and then
    by text, so that a text with any number of copies is a few rows when its smallest doc_id is sought.
    """
    words = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), utf8("text").alias("text")).withColumn(
        "words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    flags = _own_flags(F.col("text"), F.col("words"))
    # rows without a doc_id are dealt by the task that reads them instead of meeting in one
    read = words.select("doc_id", F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1).alias("slice"), "part",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *[c.alias(k) for k, c in flags.items()])
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id"), F.lit(-1).alias("slice")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = ["part", "digest", *flags, "good", "toxic"]
    rows = read.join(told, ["doc_id", "slice"], "left").na.fill(0, ["good", "toxic"])
    rows = rows.groupBy("doc_id", "slice", *own).agg(F.count(F.lit(1)).alias("n"))  # repeated rows; dealt as the join is
    named = F.col("doc_id").isNotNull()
    texts = rows.groupBy(*own).agg(F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = F.col("named") - F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    told_apart = texts.withColumn("smallest", smallest).select("*", F.explode(F.array(
        F.struct(F.lit(False).alias("E"), (F.col("n") - copies).alias("kept")), F.struct(F.lit(True).alias("E"), copies.alias("kept")))).alias("x"))
    counted = told_apart.select("part", *flags, "x.E", "x.kept", (F.col("x.kept") * F.col("good")).alias("good"), (F.col("x.kept") * F.col("toxic")).alias("toxic"))
    return counted.groupBy("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def survivors(counted: DataFrame) -> DataFrame:
    """``(part, subset, kept, good, toxic)``: what passes all filters of each of the 32 subsets, zeros included.

    ``counted``: the rows of ``patterns``, at most 32 a part.  A row of zeros without any flag for each part lets every
    grouping set have its all-false row.
    """
    zeros = counted.select("part").distinct().select("part", *[F.lit(False).alias(f) for f in FILTERS], *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    cube = counted.unionByName(zeros).cube("part", *FILTERS).agg(F.grouping("part").alias("all_parts"), *[F.sum(c).alias(c) for c in _COUNTS],
        F.concat(*[F.when(F.grouping(f) == 0, f).otherwise("") for f in FILTERS]).alias("subset"))
    passed = cube.where("all_parts = 0")
    for f in FILTERS:
        passed = passed.where(~F.coalesce(F.col(f), F.lit(False)))
    return passed.select("part", "subset", *_COUNTS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step.

    Columns: part, filter_order, step, filter (the one at this step), kept, removed, redundant (fails it, but went
    earlier), unique_fails (fails it alone), good_lost, toxic_lost, shapley (removed by it in all 120 orders together).
    An empty table gives no rows; other columns of ``docs`` and ``labels`` are not read.
    """
    passed = survivors(patterns(docs, labels))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, k + 1, o[k], "".join(sorted(o[:k])), "".join(sorted(o[: k + 1]))) for o in orders for k in range(len(o))]
    table = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before string, after string"))  # 600 rows
    before = passed.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in _COUNTS])
    after = passed.withColumnRenamed("subset", "after")
    met = before.join(table, "before").join(after, ["part", "after"])
    met = met.withColumn("removed", F.col("kept_before") - F.col("kept"))
    same = Window.partitionBy("part", "filter")
    fails, alone = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(same) for k in (1, len(FILTERS)))
    return met.select("part", "filter_order", "step", "filter", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"),
        (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"),
        F.sum("removed").over(same).alias("shapley"))


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                  min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
flags AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS failed
  FROM worded LEFT JOIN labels USING (doc_id)),
grouped AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
fates AS (  -- the step at which documents of these flags go, 6 if never
  SELECT *, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: failed[ascii(o[k]) - 64])), 6) AS gone FROM grouped, orders),
steps AS (
  SELECT part, o, k, o[k] AS f, sum(n) FILTER (gone > k) AS kept, sum(n) FILTER (gone = k) AS removed,
         sum(n) FILTER (gone < k AND failed[ascii(o[k]) - 64]) AS redundant,
         sum(n) FILTER (failed[ascii(o[k]) - 64] AND len(list_filter(failed, lambda x: x)) = 1) AS unique_fails,
         sum(good) FILTER (gone = k) AS good_lost, sum(toxic) FILTER (gone = k) AS toxic_lost
  FROM fates, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY ALL)
SELECT part, o AS filter_order, k::INT AS step, f AS filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM steps
"""
