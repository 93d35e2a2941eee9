"""SimHash fingerprints and their near matches, with DataFrame functions only.

Terms are pairs of neighbouring words, weighted by their length; 128 hash bits of each term vote with its weight.  Two
vote counters of 32 bits share one long, so a fingerprint is 64 sums, and all run in generated code.  Permuted block
tables find all fingerprints within a Hamming radius of the queries.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import checkpoint, materialise, utf8

BITS = 128
#: Weights of terms lie between 1 and this.
MOST_WEIGHT = 31
#: A text's terms start at words parted by these characters.
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"
_LANES = 0x0000000100000001
#: Hamming radius of the search, and how many blocks beyond it the bits are cut into: a table leads with so many.
RADIUS, SPARE = 6, 2
#: Documents whose doc_id is divisible by this are queries of the search.
QUERY_STEP = 50
#: A slot of a table with more than this share of all fingerprints is dealt out over several tasks; there are few such.
HOT_SLOT, LEAST_HOT = 1 / 1000, 1000
#: Rows of one fingerprint are dealt over so many parts wherever rows, not fingerprints, are joined.
DEALT = 64
#: doc_ids that share all but so many low bits are put in order together.
NEAR_IDS = 10
#: So many ids are put in order in one task, and so many are broadcast.
FEW_IDS = 50_000


def _terms(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed != "", F.split(trimmed, _SPACES))
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, the ``carried`` long columns and the fingerprint's halves ``hi``, ``lo`` for each row of ``texts``.

    Rows with equal keys must be one text.  Null or empty texts, and texts without words, have the fingerprint of 128
    zero bits.  Vote counters are 32 bits wide, so texts up to 64 million words are exact.
    """
    terms = texts.select(*keys, *carried, F.explode_outer(_terms(F.col(text))).alias("t"))
    weight = F.when(F.col("t").isNull(), 0).otherwise(F.least(F.length("t.a") + F.coalesce(F.length("t.b"), F.lit(0)), F.lit(MOST_WEIGHT)))
    hashed = terms.select(*keys, *carried, weight.cast("long").alias("w"), F.xxhash64("t.a", "t.b").alias("h1")).withColumn("h2", F.xxhash64("h1"))
    lanes = F.lit(_LANES).cast("long")
    votes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(lanes) * F.col("w")).alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("all_w"), *[F.max(c).alias(c) for c in carried], *votes)

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{i}", 32)
            out = out.bitwiseOR((low * 2 > F.col("all_w")).cast("long") * F.lit(1 << i))
            out = out.bitwiseOR(F.shiftleft((high * 2 > F.col("all_w")).cast("long"), i + 32))
        return out

    return summed.select(*keys, *carried, bits("h1").alias("hi"), bits("h2").alias("lo"))


def hexed(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in (hi, lo)]))


def distance(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def following(ids: DataFrame, shift: int = NEAR_IDS) -> DataFrame:
    """``(id, next_id)`` of distinct ids in ascending order; null after the last.

    Ids that share all but ``shift`` low bits are put in order in one task; the groups' first ids are put in order the
    same way with more bits, until few enough are left for one window.
    """
    if ids.count() <= FEW_IDS:
        return ids.withColumn("next_id", F.lead("id").over(Window.orderBy("id")))
    window = Window.partitionBy(F.shiftright("id", shift)).orderBy("id")
    stepped = checkpoint(ids.select("id", F.lead("id").over(window).alias("next_id"), F.row_number().over(window).alias("rn")))
    firsts = following(stepped.where("rn = 1").select("id"), shift + NEAR_IDS)
    beyond = firsts.select(F.shiftright("id", shift).alias("g"), F.col("next_id").alias("beyond"))
    ends = merged(stepped.where("next_id is null").withColumn("g", F.shiftright("id", shift)), beyond, ["g"]).select("id", F.col("beyond").alias("next_id"))
    return stepped.where("next_id is not null").select("id", "next_id").unionByName(ends)


def _blocks(count: int) -> list[tuple[list[Column], list[Column]]]:
    """For each of ``count`` blocks of the bits: its values in the halves it lies in, and whether a difference of prints is zero there."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        values, zero = [], []
        for half, base in (("lo", 0), ("hi", 64)):
            a, b = max(low, base), min(high, base + 64)
            if a < b:
                mask = (1 << (b - a)) - 1
                mask = F.lit(mask if mask < 1 << 63 else -1).cast("long")
                values.append(F.shiftrightunsigned(half, a - base).bitwiseAND(mask))
                zero.append(F.shiftrightunsigned(F.col(half).bitwiseXOR(F.col(f"query_{half}")), a - base).bitwiseAND(mask) == 0)
        out.append((values, zero))
    return out


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the documents, by sorting.

    Spark sizes a table after an explode as if each row gave one, and one read from Parquet by its packed bytes, so it
    would broadcast tables that hold many times its limit.
    """
    return left.join(right.hint("merge"), keys, how)


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """``(query_hi, query_lo, hi, lo, distance)``: all of ``prints`` that differ from a query in 1 to ``radius`` bits.

    Both tables are of columns hi and lo; equal fingerprints count once, so the result has pairs of classes.  The bits
    are cut into ``radius + spare`` blocks.  Within the radius at least ``spare`` blocks agree whole, and the table
    permuted to lead with the first such blocks puts the two side by side: there is a table for each choice of blocks,
    which makes the search exact, and a pair counts in one table only.  Slots that hold many fingerprints are dealt out.
    """
    blocks = _blocks(radius + spare)
    chosen = list(combinations(range(len(blocks)), spare))
    classes = prints.select("hi", "lo").distinct()
    n = classes.count()
    hot = max(int(n * HOT_SLOT), LEAST_HOT)

    def slots(table: DataFrame) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[v for i in blocks_ for v in blocks[i][0]]).alias("slot")) for t, blocks_ in enumerate(chosen)]
        return table.select("hi", "lo", F.explode(F.array(*keys)).alias("s")).select("hi", "lo", "s.t", "s.slot")

    spread = slots(classes)
    # by the pigeonhole principle at most len(chosen) / HOT_SLOT slots are hot
    crowded = F.broadcast(spread.groupBy("slot").count().where(F.col("count") > hot).select("slot", F.ceil(F.col("count") / hot).cast("int").alias("parts")))
    table = spread.join(crowded, "slot", "left").withColumn("part", F.when(F.col("parts").isNull(),
        0).otherwise(F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int"))).drop("parts")
    asked = slots(queries.select("hi", "lo").distinct()).join(crowded, "slot", "left")
    asked = asked.select("slot", "t", F.col("hi").alias("query_hi"), F.col("lo").alias("query_lo"),
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    agreeing = sum((F.when(reduce(and_, zero), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, zero) in enumerate(blocks)), F.lit(0))
    leading = F.array(*[F.lit(sum(1 << i for i in c)) for c in chosen])[F.col("t")]
    below = F.array(*[F.lit((1 << (c[-1] + 1)) - 1) for c in chosen])[F.col("t")]
    bits = distance(F.col("hi"), F.col("lo"), F.col("query_hi"), F.col("query_lo"))
    found = merged(table, asked, ["slot", "t", "part"]).where(bits.between(1, radius) & (agreeing.bitwiseAND(below) == leading))
    return found.select("query_hi", "query_lo", "hi", "lo", bits.alias("distance"))


def with_neighbours(prints: DataFrame, step: int = QUERY_STEP, radius: int = RADIUS) -> DataFrame:
    """``prints(doc_id, hi, lo, ...)`` with class_id, class_size, n_near and nearest_bits.

    A class is all rows of one fingerprint, known by its smallest doc_id.  For rows whose doc_id is divisible by
    ``step``: how many other classes lie within ``radius`` bits, and at what distance the nearest; null for the others.
    """
    dealt = prints.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)))
    parts = dealt.groupBy("hi", "lo", "deal").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") % step == 0).alias("asked"))
    parts = checkpoint(parts)
    classes = parts.groupBy("hi", "lo").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.max("asked").alias("asked"))
    found = near(classes, classes.where("asked"), radius).groupBy(F.col("query_hi").alias("hi"),
        F.col("query_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_near"), F.min("distance").alias("nearest_bits"))
    told = merged(classes, found, ["hi", "lo"], "left").drop("asked")
    by_part = merged(parts.select("hi", "lo", "deal"), told, ["hi", "lo"])
    query = F.coalesce(F.col("doc_id") % step == 0, F.lit(False))
    out = merged(dealt, by_part, ["hi", "lo", "deal"]).drop("deal")
    return out.withColumn("n_near", F.when(query, F.coalesce("n_near", F.lit(0)))).withColumn("nearest_bits", F.when(query, F.col("nearest_bits")))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with g, its group of neighbouring ids, rn, its place there, lead, the next text of the group, and
    beyond, the first text after the group.

    Texts go to their groups by joins alone: a few rows may hold the whole corpus, so none are broadcast for being few.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).withColumn("id",
        F.coalesce("doc_id", F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("text"), 2)))
    group = F.shiftright("id", NEAR_IDS)
    firsts = checkpoint(rows.groupBy(group.alias("g")).agg(F.min("id").alias("id")).select("id"))
    n = firsts.count()
    start = firsts.agg(F.min("id")).first()[0]
    ends = following(firsts).select(F.shiftright("id", NEAR_IDS).alias("g"), F.coalesce("next_id", F.lit(start)).alias("beyond_id"))
    ends = checkpoint(ends)
    wanted = ends.withColumnRenamed("g", "of")
    wanted = F.broadcast(wanted) if n <= FEW_IDS else wanted
    beyond = checkpoint(rows.join(wanted, F.col("id") == F.col("beyond_id")).groupBy(F.col("of").alias("g")).agg(F.min("text").alias("beyond")))
    window = Window.partitionBy("g").orderBy("id", "text")
    near = rows.withColumn("g", group).withColumn("rn", F.row_number().over(window)).withColumn("lead", F.lead("text").over(window))
    return merged(near, beyond, ["g"], "left")


def half_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its half-edited text and of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and those of
    ``with_neighbours``: class_id, class_size, n_near, nearest_bits.  The last floor(n/2) code points give way to the first as many (or all) of the next document in ascending doc_id; the last
    document's next is the first.  Null texts are empty.  Rows that repeat a doc_id are documents of their own in the
    order of their texts; rows without a doc_id come first, by a hash of their texts.  A single document is its own next.
    """
    near = with_next(docs)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    near = near.withColumn("n_chars", size.cast("long")).withColumn("edited",
        F.concat(F.substring("text", F.lit(1), size - half), F.substring(F.coalesce("lead", "beyond"), F.lit(1), half)))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    sha = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")),
        F.struct(F.lit(2).alias("v"), F.when(F.col("lead").isNull(), F.col("beyond")).alias("t")))
    carried = ("doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3")
    told = near.select("g", "rn", "doc_id", "n_chars", *sha, F.explode(versions).alias("x")).select("g", "rn", *carried, "x.v",
        F.col("x.t").alias("text")).where("v < 2 or text is not null")
    prints = fingerprints(told, ["g", "rn", "v"], carried=carried)
    sides = [F.max(F.when(F.col("v") == v, F.col(half))).alias(f"{half}{v}") for v in range(3) for half in ("hi", "lo")]
    whole = prints.groupBy("g", "rn").agg(*[F.max(c).alias(c) for c in carried], *sides)
    order = Window.partitionBy("g").orderBy("rn")
    whole = whole.select("*", *[F.coalesce(F.lead(f"{half}0").over(order), F.col(f"{half}2")).alias(f"next_{half}") for half in ("hi", "lo")])

    def near_to(hi: str, lo: str) -> Column:
        return F.lit(1.0) - distance(F.col("hi0"), F.col("lo0"), F.col(hi), F.col(lo)) / F.lit(float(BITS))

    edited = F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))
    told = whole.select(
        "doc_id", "n_chars", edited.alias("edited_sha256"), hexed(F.col("hi0"), F.col("lo0")).alias("fingerprint"),
        hexed(F.col("hi1"), F.col("lo1")).alias("edited_fingerprint"),
        near_to("hi1", "lo1").alias("near_edited"), near_to("next_hi", "next_lo").alias("near_next"), F.col("hi0").alias("hi"), F.col("lo0").alias("lo"),
    )
    return with_neighbours(materialise(told, "fingerprints")).drop("hi", "lo")
