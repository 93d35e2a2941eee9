"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from a Poisson distribution whose mean is its source's repetition rate.  The
draw inverts the distribution at a uniform number hashed from seed and doc_id, so it needs no state, no coordination
and gives the same answer after a lost executor.  Copies are ordered globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import checkpoint, free_names, utf8

SEED = 17
#: Without explicit targets a source's weight is its size to this power.
TEMPERATURE = 0.5
#: Rate tables up to these bounds are broadcast, larger ones are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_STEPS = 10_000, 1_000_000
_NO_SOURCE = "\x00none"


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None) -> DataFrame:
    """``(source_key, rate, steps)``: mean copies of a document of each source, and the distribution's steps.

    ``weights``: target share of each source (missing sources get none); by default size ** TEMPERATURE.  ``budget``:
    characters wanted in all, by default as many as there are.  ``steps[k]`` is the probability of at most k copies.
    """
    key = F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE))
    sizes = docs.groupBy(key.alias("source_key")).agg(F.sum(F.length(utf8("text"))).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE)))
    else:
        known = [(_NO_SOURCE if k is None else k, float(v)) for k, v in weights.items()]
        table = docs.sparkSession.createDataFrame(known, "source_key string, weight double")
        sizes = sizes.join(table, "source_key", "left").na.fill(0.0, ["weight"])
    sizes = checkpoint(sizes.withColumn("size", F.col("size").cast("double")))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    wanted = F.lit(float(budget)) if budget is not None else F.col("all_size")
    share = F.try_divide(F.col("weight"), F.col("all_weight")) * wanted
    rated = sizes.crossJoin(F.broadcast(total)).withColumn("rate", F.coalesce(F.round(F.try_divide(share, F.col("size")), 9), F.lit(1.0)))  # one row of totals
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    start = F.struct((-F.col("rate")).alias("log"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc, k):
        log = acc["log"] + F.when(F.col("rate") > 0, F.log("rate")).otherwise(F.lit(-1e300)) - F.log(k.cast("double"))
        return F.struct(log.alias("log"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log))).alias("cdf"))

    return checkpoint(rated.select("source_key", "rate", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"]).alias("steps")))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row once per drawn copy, in one global random order, and columns rate, copies, copy, shuffle_key.

    Documents without a source form a source of their own; texts that are null or empty count no characters but are
    drawn like others; sources without any character keep each document at rate 1.  Rows that repeat a doc_id draw the
    same number; rows without a doc_id draw by their text.  Where ``docs`` has a column of one of the four names, the
    added one has an underscore after it.  An empty table gives an empty result.
    """
    table = rates(docs, weights, budget)
    n, steps_in_all = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("steps")), F.lit(0))).first()
    kept = docs.columns
    source, mean, steps, at, rate, copies, copy, order = free_names(kept, "source_key", "source_rate", "source_steps", "uniform", "rate", "copies", "copy", "shuffle_key")
    table = table.toDF(source, mean, steps)
    if n <= BROADCAST_SOURCES and steps_in_all <= BROADCAST_STEPS:
        table = F.broadcast(table)
    key = F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(utf8("text").cast("binary"))))
    taken = docs.withColumn(source, key).join(table, source).withColumn(at, uniform(seed, name))
    taken = taken.withColumn(copies, F.size(F.filter(steps, lambda s: s <= F.col(at))))
    taken = taken.where(F.col(copies) > 0).select(*kept, F.col(mean).alias(rate), copies, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed + 1)), name, F.col(copy).cast("string")).cast("binary"))
    return taken.withColumn(order, shuffled).orderBy(order, "doc_id", copy)


ORACLE_SQL = """
WITH sizes AS (
  SELECT coalesce(source, 'none') AS s, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY 1),
rates AS (
  SELECT s, coalesce(round(pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) * (SELECT sum(size) FROM sizes)
                     / nullif(size, 0), 9), 1.0) AS rate FROM sizes),
steps AS (
  SELECT s, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf
  FROM rates, range(0, 400) AS t(k) WHERE k <= rate + 12 * sqrt(rate) + 20),
drawn AS (
  SELECT doc_id, coalesce(source, 'none') AS s, source,
         ('0x' || substr(md5('17:' || name), 1, 13))::BIGINT / pow(2, 52) AS u, name
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents)),
counted AS (
  SELECT d.doc_id, d.name, d.source, st.rate, count(*) FILTER (WHERE st.cdf <= d.u) AS copies
  FROM (SELECT *, row_number() OVER () AS r FROM drawn) d JOIN steps st ON d.s = st.s GROUP BY d.r, d.doc_id, d.name, d.source, st.rate)
SELECT doc_id, source, rate, copies::INTEGER AS copies, copy::INTEGER AS copy,
       md5('18:' || name || ':' || copy) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy)
"""
