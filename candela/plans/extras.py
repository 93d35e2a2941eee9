"""Smaller queries: labels, lists, lookups and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, ratio, trailing
from candela.operators import indicators as ta
from candela.operators import screens, store
from candela.plans.oracle import W, full, with_ctes
from candela.plans.registry import query
from candela.sources import bars as src
from candela.sources import parsers

#: Keywords looked for in names, in the order that decides a name's category.
KEYWORDS = ("almond", "blue", "green", "red", "steel", "gold", "ivory")


@query(with_ctes("SELECT symbol, name FROM basics WHERE name NOT LIKE '%ST%'", "basics"))
def universe_list(spark, d):
    return screens.without_st(src.basics(spark, d)).select("symbol", "name")


@query("SELECT r_name || CASE WHEN r_regionkey % 2 = 0 THEN '概念' ELSE '' END AS name, CASE WHEN r_regionkey <> 3 THEN 'R' || r_regionkey END AS code FROM region")
def resolve_names(spark, d):
    """Sector names with and without a suffix, matched to an index that lacks one of them."""
    region = src.table(spark, d, "region")
    wanted = region.select(F.concat("r_name", F.when(F.col("r_regionkey") % 2 == 0, "概念").otherwise("")).alias("name"))
    index = region.where("r_regionkey <> 3").select(F.col("r_name").alias("name"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"))
    return parsers.resolve(wanted, index)


@query("SELECT p_partkey, array_to_string([k FOR k IN " + str(list(KEYWORDS)) + " IF contains(lower(p_name), k)], ',') AS tags FROM part")
def keyword_tags(spark, d):
    words = F.array(*map(F.lit, KEYWORDS))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(F.filter(words, lambda k: F.contains(F.lower("p_name"), k)), ",").alias("tags"))


@query("SELECT p_partkey, coalesce([k FOR k IN " + str(list(KEYWORDS)) + " IF contains(lower(p_name), k)][1], 'other') AS category FROM part")
def first_category(spark, d):
    found = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower("p_name"), k))
    return src.table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("other")).alias("category"))


@query("SELECT o_orderkey, o_custkey, 'first' AS part FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'second' FROM orders "
    "WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def append_dedupe(spark, d):
    """A second list of results added to a first, whose rows stay."""
    orders = src.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return store.insert_ignore(orders.where("o_orderkey % 3 = 0").withColumn("part", F.lit("first")),
        orders.where("o_orderkey % 2 = 0").withColumn("part", F.lit("second")), ["o_orderkey"])


@query(with_ctes("SELECT sector_code, count(*) AS rising, array_to_string(list(name ORDER BY name)[1:3], ',') AS examples FROM members JOIN spot USING "
    "(symbol) WHERE change_rate > 0 GROUP BY sector_code", "members", "spot"))
def rising_examples(spark, d):
    """Rising members of each sector and three of their names; the names of one sector's members are few."""
    joined = src.members(spark, d).select("sector_code", "symbol").join(src.spot(spark, d).select("symbol", "name", "change_rate"), "symbol").where("change_rate > 0")
    return joined.groupBy("sector_code").agg(F.count(F.lit(1)).alias("rising"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 3), ",").alias("examples"))


@query(with_ctes("SELECT symbol, date, round(close, 6) AS close FROM bars JOIN (SELECT symbol, max(date) FILTER (volume < 2) AS bad FROM bars GROUP BY "
    "symbol) USING (symbol) WHERE bad IS NULL OR date > bad", "bars"))
def repaired_bars(spark, d):
    """Bars after each symbol's last bad one."""
    frame = src.bars(spark, d)
    bad = frame.groupBy("symbol").agg(F.max(F.when(F.col("volume") < 2, F.col("date"))).alias("bad"))
    return frame.join(bad, "symbol").where("bad is null or date > bad").select("symbol", "date", F.round("close", 6).alias("close"))


@query(with_ctes(f"SELECT symbol, round(MA20 / nullif(m5, 0) - 1, 6) AS slope20, round(VOL_MA5 / nullif(VOL_MA20, 0), 6) AS vol5_20, round(close / "
    f"nullif(HIGH_60, 0) - 1, 6) AS from_high, round(close / nullif(LOW_60, 0) - 1, 6) AS from_low FROM (SELECT *, lag(MA20, 5) {W} AS m5, row_number() "
    f"OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM ind) WHERE rn = 1", "ind"))
def review_metrics(spark, d):
    frame = ta.native_indicators(src.with_change(src.bars(spark, d))).withColumn("m5", F.lag("MA20", 5).over(by_symbol()))
    last = screens.latest(frame)
    each = {"slope20": ratio(F.col("MA20"), F.col("m5")) - lit(1), "vol5_20": ratio(F.col("VOL_MA5"), F.col("VOL_MA20")),
        "from_high": ratio(F.col("close"), F.col("HIGH_60")) - lit(1), "from_low": ratio(F.col("close"), F.col("LOW_60")) - lit(1)}
    return last.select("symbol", *[F.round(c, 6).alias(k) for k, c in each.items()])


def _top(column: str):
    def run(spark, d):
        return screens.top(src.spot(spark, d), column, 20).select("symbol", "name", F.round(column, 6).alias(column))

    query(with_ctes(f"SELECT symbol, name, round({column}, 6) AS {column} FROM spot ORDER BY {column} DESC NULLS LAST, symbol LIMIT 20", "spot"), f"top_{column}")(run)


for _column in ("change_rate", "volume", "turnover_rate"):
    _top(_column)


@query(with_ctes("SELECT symbol, n >= 0.8::DOUBLE * 250 AND last >= (SELECT max(date) FROM bars) - 7 AS usable FROM (SELECT symbol, count(*) AS n, "
    "max(date) AS last FROM bars GROUP BY symbol)", "bars"))
def usable_history(spark, d):
    """Whether a symbol's bars are enough and fresh enough to be used as they are."""
    frame = src.bars(spark, d)
    covered = store.coverage(frame).crossJoin(F.broadcast(frame.agg(F.max("date").alias("as_of"))))  # one row
    return covered.select("symbol", ((F.col("row_count") >= lit(0.8 * 250)) & (F.col("last_date") >= F.date_sub("as_of", 7))).alias("usable"))


@query(with_ctes("SELECT symbol, (max(date) - 10)::DATE AS fetch_from FROM bars GROUP BY symbol HAVING max(date) < DATE '2001-11-01'", "bars"))
def stale_symbols(spark, d):
    return store.stale_symbols(store.coverage(src.bars(spark, d)), "2001-11-01")


@query(with_ctes("SELECT year(date) AS year, month(date) AS month, count(*) AS n, round(sum(amount), 2) AS amount FROM bars GROUP BY ROLLUP (year(date), "
    "month(date))", "bars"))
def amount_rollup(spark, d):
    frame = src.bars(spark, d).select(F.year("date").alias("year"), F.month("date").alias("month"), "amount")
    return frame.rollup("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(with_ctes(f"SELECT symbol, date, volume > 2 * v5 AS surge, MA5 > MA10 AND MA10 > MA20 AND MA20 > MA60 AS aligned FROM (SELECT "
    f"*, {full(5, 'avg(volume)', 'volume', True)} AS v5 FROM ind) WHERE MA60 IS NOT NULL", "ind"))
def quick_signals(spark, d):
    """Volume above twice the five bars before, and four averages in order."""
    from candela.functions.series import prior

    frame = ta.moving_averages(src.bars(spark, d)).withColumn("v5", F.when(F.count("volume").over(prior(5)) == 5,
        F.avg("volume").over(prior(5)))).where("MA60 is not null")
    return frame.select("symbol", "date", (F.col("volume") > 2 * F.col("v5")).alias("surge"), F.expr("MA5 > MA10 and MA10 > MA20 and MA20 > MA60").alias("aligned"))


@query(with_ctes("SELECT symbol, date, round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), 6) AS mean60, ntile(4) OVER (PARTITION "
    "BY symbol ORDER BY close, date) AS quartile FROM bars", "bars"))
def price_quartiles(spark, d):
    from pyspark.sql import Window

    frame = src.bars(spark, d)
    return frame.select("symbol", "date", F.round(F.avg("close").over(trailing(60)), 6).alias("mean60"),
        F.ntile(4).over(Window.partitionBy("symbol").orderBy("close", "date")).alias("quartile"))


_ASKED = """asked AS (SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN ' BK' || lpad(s_suppkey::VARCHAR, 5, '0') WHEN 1 THEN 'sh' || lpad(s_suppkey::VARCHAR, 5, '0')
   WHEN 2 THEN 'bk' || lpad(s_suppkey::VARCHAR, 5, '0') WHEN 3 THEN 'pLiEr#' || right(s_name, 4) ELSE '#' || right(s_name, 1) || 'z' END AS query FROM supplier
   UNION SELECT right(c_name, 3) FROM customer),
 idx AS (SELECT 'BK' || lpad(s_suppkey::VARCHAR, 5, '0') AS code, replace(s_name, '#00000', '#') AS name FROM supplier)"""


@query(f"""WITH {_ASKED}, told AS (SELECT query, trim(query) AS t, regexp_replace(query, '[^0-9]', '', 'g') AS digits FROM asked),
 tried AS (SELECT query, t, (SELECT min(code) FROM idx WHERE code = t) AS c0, (SELECT min(code) FROM idx WHERE code = digits) AS c1,
   (SELECT min(code) FROM idx WHERE digits <> '' AND NOT starts_with(upper(t), 'BK') AND code = 'BK' || digits) AS c2,
   (SELECT min(code) FROM idx WHERE t <> '' AND contains(lower(name), lower(t))) AS c3 FROM told)
 SELECT query, coalesce(c0, c1, c2, c3) AS code, (SELECT name FROM idx WHERE code = coalesce(c0, c1, c2, c3)) AS name,
   CASE WHEN c0 IS NOT NULL THEN 'code' WHEN c1 IS NOT NULL THEN 'digits' WHEN c2 IS NOT NULL THEN 'prefix' WHEN c3 IS NOT NULL THEN 'name' END AS how FROM tried""")
def resolve_symbols(spark, d):
    """Codes, bare digits and pieces of names, some of them unknown, looked up among suppliers."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    text = F.when(F.col("k") == 0, F.concat(F.lit(" BK"), key)).when(F.col("k") == 1, F.concat(F.lit("sh"), key)).when(F.col("k") == 2, F.concat(F.lit("bk"), key)).when(
        F.col("k") == 3, F.concat(F.lit("pLiEr#"), F.right("s_name", F.lit(4)))).otherwise(F.concat(F.lit("#"), F.right("s_name", F.lit(1)), F.lit("z")))
    supplier = src.table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % 5)
    asked = supplier.select(text.alias("query")).unionByName(src.table(spark, d, "customer").select(F.right("c_name", F.lit(3)).alias("query")))
    index = supplier.select(F.concat(F.lit("BK"), key).alias("code"), F.replace("s_name", F.lit("#00000"), F.lit("#")).alias("name"))
    return parsers.resolve_symbols(asked, index, "BK")
