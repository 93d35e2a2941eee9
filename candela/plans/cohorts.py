"""Queries over cohorts of signals, levels, timeframes, sectors, and what providers and sinks deliver and take."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, rounded
from candela.operators import backtest, levels, research, screens, store, structure
from candela.operators import indicators as ta
from candela.operators import pivots as pv
from candela.plans.analysis import _IMPULSE, _SIX, _box, _box_events, _fold
from candela.plans.oracle import W, cte, full, with_ctes
from candela.plans.oracle import rounded as r
from candela.plans.registry import query
from candela.sources import bars as src
from candela.sources import parsers

_OUTCOMES = (
    "count(*) AS n, "
    + ", ".join(f"avg((ret_{n} > 0)::INT::DOUBLE) AS win_{n}" for n in (5, 10, 20))
    + ", avg(ret_10) AS avg_10, median(ret_10) AS median_10, CASE WHEN count(*) FILTER (ret_10 > 0) >= 2 AND count(*) FILTER (ret_10 <= 0) >= 2 THEN "
    "avg(ret_10) FILTER (ret_10 > 0) / nullif(abs(avg(ret_10) FILTER (ret_10 <= 0)), 0) END AS profit_loss, avg(max_gain_10) AS avg_max_gain_10"
)
_OUTCOME_NAMES = "win_5 win_10 win_20 avg_10 median_10 profit_loss avg_max_gain_10"

cte("phased", ("events_", "pivots"), """
  SELECT e.*, CASE WHEN c.close >= 0.995::DOUBLE * c.top THEN 'breakout_new_high' WHEN c.highs = 1 THEN 'first_pullback' WHEN c.highs = 2 THEN 'second_pullback' ELSE 'later_pullback' END AS wave_phase
  FROM events_ e JOIN (SELECT b.symbol, b.date, b.close, b.top, (SELECT count(*) FROM pivots p WHERE p.symbol = b.symbol AND p.typ = 'H' AND p.confirm <= b.idx AND p.idx >= b.idx - 250) AS highs
    FROM (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 250 PRECEDING) AS top FROM bars) b
    WHERE (b.symbol, b.date) IN (SELECT (symbol, date) FROM events_)) c ON c.symbol = e.symbol AND c.date = e.date""")


def _phased(spark, d):
    frame = src.bars(spark, d)
    return _box_events(spark, d).join(backtest.wave_phase(frame, pv.pivots(frame)), ["symbol", "date"])


@query(with_ctes(f"SELECT pattern, wave_phase, n, {r(_OUTCOME_NAMES)} FROM (SELECT pattern, wave_phase, {_OUTCOMES} FROM phased GROUP BY ALL HAVING "
    f"count(*) >= 10)", "phased"))
def report_wave(spark, d):
    return backtest.wave_report(_phased(spark, d), 10).select("pattern", "wave_phase", "n", *rounded(_OUTCOME_NAMES.split()))


_COHORT = "win_rate_5 win_rate_10 win_rate_20 avg_ret_5 avg_ret_10 avg_ret_20 avg_max_gain_5 avg_max_gain_10 avg_max_gain_20 avg_score"
_COHORT_SQL = (
    "count(*) AS n, count(DISTINCT symbol) AS symbols, "
    + ", ".join(f"avg((ret_{n} > 0)::INT::DOUBLE) * 100 AS win_rate_{n}" for n in (5, 10, 20))
    + ", "
    + ", ".join(f"avg({k}_{n}) AS avg_{k}_{n}" for k in ("ret", "max_gain") for n in (5, 10, 20))
    + ", avg(score) AS avg_score"
)


def _cohort(name: str, keys: tuple[str, ...], source: str, frame, *needs: str, least: int = 1) -> None:
    def run(spark, d):
        return backtest.cohort(frame(spark, d), keys, least).select(*keys, "n", "symbols", *rounded(_COHORT.split()))

    names = ", ".join(keys)
    query(with_ctes(f"SELECT {names}, n, symbols, {r(_COHORT)} FROM (SELECT {names}, {_COHORT_SQL} FROM {source} WHERE ret_5 IS NOT NULL GROUP BY ALL "
        f"HAVING count(*) >= {least})", *needs), name)(run)


def _in_sectors(spark, d):
    return _phased(spark, d).join(src.members(spark, d).select("symbol", "sector_code"), "symbol")


_cohort("cohort_pattern", ("pattern",), "phased", _phased, "phased")
_cohort("cohort_wave", ("wave_phase",), "phased", _phased, "phased")
_cohort("cohort_pattern_wave", ("pattern", "wave_phase"), "phased", _phased, "phased", least=10)
_cohort("cohort_sector_pattern", ("sector_code", "pattern"), "phased JOIN members USING (symbol)", _in_sectors, "phased", "members", least=5)
_cohort("cohort_sector", ("sector_code",), "phased JOIN members USING (symbol)", _in_sectors, "phased", "members")
_cohort("cohort_variant", ("pattern", "variant"), "phased", _phased, "phased")


@query(with_ctes("SELECT pattern, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(max(score), 6) AS high, "
    "round(min(score), 6) AS low FROM box WHERE score IS NOT NULL GROUP BY pattern", "box"))
def summary_scores(spark, d):
    return backtest.score_distribution(_box(spark, d)).select("pattern", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "high", "low")])


@query(with_ctes("SELECT pattern, year(date) AS year, count(*) AS n, round(avg((ret_10 > 0)::INT::DOUBLE) * 100, 6) AS win_rate_10, round(avg(ret_10) * "
    "100, 6) AS avg_ret_10 FROM events_ GROUP BY ALL HAVING count(*) >= 30", "events_"))
def summary_years(spark, d):
    return backtest.yearly_returns(_box_events(spark, d)).select("pattern", "year", "n", F.round("win_rate_10", 6).alias("win_rate_10"),
        F.round("avg_ret_10", 6).alias("avg_ret_10"))


@query(with_ctes("SELECT symbol FROM basics ORDER BY md5('42:' || symbol) LIMIT 20", "basics"))
def sample_symbols(spark, d):
    """The seeded sample: twenty symbols, the same each time."""
    return screens.sample_symbols(src.basics(spark, d), 20)


@query(with_ctes("SELECT symbol, name FROM basics WHERE contains(lower(name), '1') OR contains(symbol::VARCHAR, '1') ORDER BY symbol LIMIT 20", "basics"))
def search_symbols(spark, d):
    return screens.search(src.basics(spark, d), " 1 ").select("symbol", "name")


# levels and timeframes


def _zigzag(spark, d):
    return pv.zigzag(pv.pivots(src.bars(spark, d)))


_LEVELS = "levels_ AS (" + " UNION ALL ".join(f"SELECT symbol, {i} AS ordinal, 'MA{n}' AS name, MA{n} AS value FROM last_ma" for i, n in enumerate(levels.WINDOWS)) + """
 UNION ALL SELECT symbol, CASE WHEN typ = 'H' THEN 100 ELSE 101 END, CASE WHEN typ = 'H' THEN 'previous_high' ELSE 'previous_low' END, arg_max(price, ordinal) FROM line GROUP BY symbol, typ)"""  # fmt: skip
_LAST_MA = f"last_ma AS (SELECT * FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, {', '.join(f'{full(n, chr(97) + "vg(close)", "close")} AS MA{n}' for n in levels.WINDOWS)} FROM bars) WHERE rn = 1)"


@query(
    with_ctes(
        "SELECT symbol, name, round(value, 6) AS value, distance_pct, side, position FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY "
        "abs(distance_pct), ordinal, name) AS position FROM (SELECT *, CASE WHEN distance_pct > 0 THEN 'resistance' ELSE 'support' END AS side "
        "FROM (SELECT l.*, round((value / close - 1) * 100, 2) + 0::DOUBLE AS distance_pct FROM levels_ l JOIN last_ma USING (symbol) WHERE value IS NOT "
        "NULL))) WHERE position <= 6",
        "bars", "pivots", recursive=f"{_fold(0.03)}, {_LAST_MA}, {_LEVELS}",
    )
)
def nearest_levels(spark, d):
    """The six averages and earlier pivots nearest above, and the six at or below, each symbol's price."""
    found = levels.nearest_to_close(levels.own_levels(src.bars(spark, d)))
    return found.select("symbol", "name", F.round("value", 6).alias("value"), (F.col("distance_pct") + lit(0)).alias("distance_pct"), "side", "position")


@query()
def key_levels(spark, d):
    """Nearest levels with the retracements of the last swing and the trend."""
    return levels.key_levels(src.bars(spark, d), _zigzag(spark, d))


@query(
    with_ctes(
        " UNION ALL ".join(f"SELECT '{k}' AS timeframe, symbol, count(*) AS bar_count, max(source_date) AS as_of_date, arg_max(date > source_date, date) "
        f"AS incomplete FROM {t} GROUP BY symbol" for k, t in (("daily", "(SELECT *, date AS source_date FROM bars)"), ("weekly", "weekly"), ("monthly", "monthly"))),
        "bars", "weekly", "monthly",
    )
)
def timeframe_heads(spark, d):
    return structure.timeframe_heads(src.bars(spark, d))


@query()
def multi_timeframe_structure(spark, d):
    return structure.multi_timeframe(src.bars(spark, d))


# sectors


@query(with_ctes("SELECT sector_code, sector_name, sector_type, count(*) AS member_count, count(*) FILTER (change_rate > 0) AS gainer_count, count(*) "
    "FILTER (change_rate < 0) AS loser_count FROM members LEFT JOIN spot USING (symbol) GROUP BY ALL", "members", "spot"))
def sector_overview(spark, d):
    return screens.sector_overview(src.members(spark, d), src.spot(spark, d))


@query(
    with_ctes(
        "SELECT m.sector_code, m.symbol, position, round(turnover_rate, 6) AS turnover_rate, k.rank AS popularity_rank FROM (SELECT sector_code, symbol, "
        "turnover_rate, row_number() OVER (PARTITION BY sector_code ORDER BY coalesce(turnover_rate, -9999) DESC, symbol) AS position "
        "FROM members LEFT JOIN spot USING (symbol)) m LEFT JOIN (SELECT symbol, rank FROM ranks WHERE rank_date = (SELECT max(rank_date) FROM ranks)) k "
        "USING (symbol) WHERE position <= 5",
        "members", "spot", "ranks",
    )
)
def sector_members_ranked(spark, d):
    found = screens.sector_members(src.members(spark, d), src.spot(spark, d), src.ranks(src.bars(spark, d)), "turnover_rate", 5)
    return found.select("sector_code", "symbol", "position", F.round("turnover_rate", 6).alias("turnover_rate"), "popularity_rank")


@query(
    with_ctes(
        "SELECT sector_code, count(*) AS analysed, count(*) FILTER (good) AS good_trend FROM (SELECT sector_code, good, row_number() OVER (PARTITION BY "
        "sector_code ORDER BY symbol) AS position FROM members JOIN (SELECT symbol, coalesce(close > MA20 AND MA20 > before, false) AS good "
        f"FROM (SELECT *, lag(MA20, 5) {W} AS before, count(*) {W} AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM ind) WHERE "
        f"rn = 1 AND n >= 20) USING (symbol)) WHERE position <= 10 GROUP BY sector_code",
        "members", "ind",
    )
)
def sector_cohort(spark, d):
    return research.sector_cohort(src.members(spark, d), ta.moving_averages(src.bars(spark, d)))


_WILDER = f"""d AS (SELECT symbol, date, close, row_number() {W} AS rn, greatest(close - lag(close) {W}, 0) AS g, greatest(lag(close) {W} - close, 0) AS l FROM bars),
 w(symbol, rn, g, l) AS (SELECT symbol, 15, avg(g), avg(l) FROM d WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT d.symbol, d.rn, (w.g * 13 + d.g) / 14, (w.l * 13 + d.l) / 14 FROM w JOIN d ON d.symbol = w.symbol AND d.rn = w.rn + 1),
 wr AS (SELECT symbol, rn, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM w)"""


@query(with_ctes("SELECT symbol, date, round(rsi, 6) AS WILDER_RSI FROM d LEFT JOIN wr USING (symbol, rn)", "bars", recursive=_WILDER))
def wilder_rsi(spark, d):
    return ta.wilder_rsi(src.bars(spark, d)).select("symbol", "date", F.round("WILDER_RSI", 6).alias("WILDER_RSI"))


@query(
    with_ctes(
        f"SELECT i.symbol, i.date, coalesce(MA5 > MA20 AND p5 <= p20, false) AS golden_cross, coalesce(MA5 > MA10 AND MA10 > MA20 AND MA20 > MA60, false) "
        f"AS aligned, coalesce(v5 > 0 AND volume > v5 * 2, false) AS surge, coalesce(rsi < 30, false) AS oversold, coalesce(rsi > 70, false) AS overbought, "
        f"round((i.close / c5 - 1) * 100, 6) AS pct_5, round((i.close / c20 - 1) * 100, 6) AS pct_20 FROM (SELECT *, lag(MA5) {W} AS p5, lag(MA20) {W} AS "
        f"p20, lag(close, 5) {W} AS c5, lag(close, 20) {W} AS c20, {full(5, 'avg(volume)', 'volume', True)} AS v5 FROM ind) i JOIN d USING (symbol, date) "
        f"LEFT JOIN wr USING (symbol, rn)",
        "ind", recursive=_WILDER,
    )
)
def quick_signals_all(spark, d):
    found = screens.quick_signals(ta.wilder_rsi(ta.moving_averages(src.bars(spark, d))))
    return found.withColumn("pct_5", F.round("pct_5", 6)).withColumn("pct_20", F.round("pct_20", 6))


# joins of bars and kept indicators


def _kept_indicators(spark, d):
    """A table of indicators that lacks some bars, as a cache would."""
    return ta.bollinger(ta.moving_averages(src.bars(spark, d))).where("day(date) <> 15").select("symbol", "date", "MA5", "BOLL_MID")


def _joined(name: str, how: str) -> None:
    def run(spark, d):
        return src.bars(spark, d).join(_kept_indicators(spark, d), ["symbol", "date"], how).select("symbol", "date", *rounded(["close", "MA5", "BOLL_MID"]))

    side = "LEFT JOIN" if how == "left" else "JOIN"
    query(with_ctes(f"SELECT b.symbol, b.date, {r('b.close').replace('AS b.close', 'AS close')}, {r('MA5 BOLL_MID')} FROM bars b {side} (SELECT symbol, "
        f"date, MA5, BOLL_MID FROM ind WHERE day(date) <> 15) i USING (symbol, date)", "bars", "ind"), name)(run)


_joined("bars_with_indicators", "left")
_joined("indicators_with_bars", "inner")


@query(with_ctes("SELECT symbol, date, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM "
    "bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') WHERE back <= 100", "bars"))
def clipped_bars(spark, d):
    return store.clip(src.bars(spark, d), "1996-01-01", "1999-12-31", 100).select("symbol", "date", F.round("close", 6).alias("close"))


def _variants(spark, d):
    """Every symbol has forward-adjusted bars, and one in three backward-adjusted ones too."""
    frame = src.bars(spark, d)
    return frame.withColumn("adjust_type", F.lit("qfq")).unionByName(frame.where("symbol % 3 = 0").withColumn("close",
        F.col("close") * 3).withColumn("adjust_type", F.lit("hfq")))


@query(with_ctes("SELECT symbol, date, CASE WHEN symbol % 3 = 0 THEN 'hfq' ELSE 'qfq' END AS adjust_type, round(close * CASE WHEN symbol % 3 = 0 THEN 3 "
    "ELSE 1 END, 6) AS close FROM bars", "bars"))
def adjusted_bars(spark, d):
    return store.adjusted(_variants(spark, d), "hfq").select("symbol", "date", "adjust_type", F.round("close", 6).alias("close"))


@query(with_ctes("SELECT symbol, count(*) AS n, round(avg(close), 6) AS mean FROM bars WHERE close > 80::DOUBLE AND date >= DATE '1998-01-01' GROUP BY symbol", "bars"))
def parametrised_scan(spark, d):
    """A statement with bound parameters over the bars."""
    statement = "SELECT symbol, count(*) AS n, round(avg(close), 6) AS mean FROM {bars} WHERE close > :least AND date >= :since GROUP BY symbol"
    return spark.sql(statement, args={"least": 80.0, "since": datetime.date(1998, 1, 1)}, bars=src.bars(spark, d))


# providers' rows


_FIELDS = ("open", "close", "change_amount", "change_rate", "low", "high", "volume", "amount", "turnover")


def _percent_fields(spark, d):
    frame = src.with_change(src.bars(spark, d)).withColumn("change_amount", F.col("close") - F.lag("close").over(by_symbol())).withColumn("amount",
        F.col("amount") / 10_000)
    text = [F.coalesce(F.concat(F.round(c, 6).cast("string"), F.lit("%" if c in ("change_rate", "turnover") else "")), F.lit("-")) for c in _FIELDS]
    return frame.select("symbol", F.array(F.col("date").cast("string"), *text).alias("fields")).unionByName(frame.limit(0).select("symbol",
        F.array(F.lit("short")).alias("fields")))


@query(
    with_ctes(
        f"SELECT symbol, date, close, round(volume, 5) AS volume, round(round(amount / 10000, 6) * 10000, 3) AS amount, round((high - "
        f"low) / lag(close) {W} * 100, 4) AS amplitude FROM (SELECT symbol, date, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, "
        f"round(volume, 6) AS volume, amount FROM bars)",
        "bars",
    )
)
def percent_rows(spark, d):
    """Bars written as provider rows with per cent signs and amounts in ten thousands, and read back."""
    out = parsers.percent_rows(_percent_fields(spark, d))
    return out.select("symbol", "date", "close", F.round("volume", 5).alias("volume"), F.round("amount", 3).alias("amount"), "amplitude")


@query(with_ctes(f"SELECT symbol, date, round(volume / 100, 6) AS volume, round(turnover * 100, 6) AS turnover, round((close / lag(close) {W} - 1) * 100, "
    f"6) AS change_rate, round(close - lag(close) {W}, 6) AS change_amount, round((high - low) / lag(close) {W} * 100, 6) AS amplitude FROM changed", "changed"))
def frame_rows(spark, d):
    out = parsers.frame_rows(src.with_change(src.bars(spark, d)))
    return out.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("volume", "turnover", "change_rate", "change_amount", "amplitude")])


def _member_texts(spark, d):
    """Suppliers as a provider's members: codes with and without six digits, numbers as text."""
    frame = src.table(spark, d, "supplier")
    code = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))).otherwise(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    settled = F.when(F.col("s_suppkey") % 7 == 0, F.lit("0")).otherwise(F.col("s_suppkey").cast("string"))
    fields = {"trade": F.lit("9.5"), "changepercent": F.lit("1.25%"), "pricechange": F.lit("-"), "volume": (F.col("s_suppkey") * 1000).cast("string"),
        "amount": F.lit("1,000.5"), "turnoverratio": F.lit(""), "high": (F.col("s_suppkey") + 2).cast("string"), "low": F.col("s_suppkey").cast("string")}
    rest = {"open": F.lit("9"), "settlement": settled, "pb": F.lit("1"), "per": F.col("s_acctbal").cast("string")}
    return frame.select(F.lit("BK1").alias("sector_code"), code.alias("code"), F.concat(F.lit(" "), "s_name").alias("name"),
        *[v.alias(k) for k, v in {**fields, **rest}.items()])


@query("SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code, s_name AS stock_name, 1.25::DOUBLE AS change_rate, NULL::DOUBLE AS change_amount, s_suppkey "
    "* 10::DOUBLE AS volume, 1000.5::DOUBLE AS turnover, round(CASE WHEN s_suppkey % 7 <> 0 THEN 2 / s_suppkey::DOUBLE * 100 END, 4) AS amplitude FROM "
    "supplier WHERE s_suppkey % 5 <> 0")
def member_rows(spark, d):
    return parsers.member_rows(_member_texts(spark, d)).select("stock_code", "stock_name", "change_rate", "change_amount", "volume", "turnover", "amplitude")


@query("SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stock_code, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal, 2) END AS latest_price FROM supplier "
    "WHERE s_suppkey % 5 <> 0")
def member_quotes(spark, d):
    """Members with the price of their quote, for those that have one."""
    quotes = src.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("sz"),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code"), F.round("s_acctbal", 2).alias("quoted"))
    found = parsers.enriched(parsers.member_rows(_member_texts(spark, d)).select("stock_code"), quotes, ("quoted",))
    return found.select("stock_code", F.col("quoted").alias("latest_price"))


@query("SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'industry' ELSE 'concept' END AS kind, n_name AS name, 'node_' || min(n_nationkey) AS node FROM nation GROUP BY ALL")
def node_maps(spark, d):
    """Scripts that map node codes to names, read back."""
    nation = src.table(spark, d, "nation").withColumn("kind", F.when(F.col("n_regionkey") % 2 == 0, "industry").otherwise("concept"))
    entry = F.concat(F.lit('"node_'), F.col("n_nationkey").cast("string"), F.lit('": "id, '), "n_name", F.lit(',19"'))
    scripts = nation.groupBy("kind").agg(F.concat(F.lit("var S_Finance = {"), F.array_join(F.array_sort(F.collect_list(entry)), ","),
        F.lit("}")).alias("text"))  # 25 nations
    return parsers.node_maps(scripts)


@query("SELECT 'sh' || lpad(p_partkey::VARCHAR, 6, '0') AS code, p_name AS name, round(p_retailprice, 2) AS price FROM part")
def tilde_quotes(spark, d):
    text = F.format_string('v_sh%s="1~%s~x~%s";', F.lpad(F.col("p_partkey").cast("string"), 6, "0"), "p_name", F.round("p_retailprice", 2).cast("string"))
    out = parsers.tilde_quotes(src.table(spark, d, "part").select(text.alias("text")), {"name": 1, "price": 3})
    return out.withColumn("price", F.round(parsers.number(F.col("price")), 2))


# sinks


@query(
    with_ctes(
        "SELECT 'stocks' AS universe, symbol, date AS signal_date, pattern, 'candidate' AS stage, round(score, 6) AS score, 0 AS confirmed, '{}' AS "
        "fib_levels_json, '[\"' || replace(hit_levels, ', ', '\",\"') || '\"]' AS evidence_json, '{}' AS factors_json, 'v1' AS engine_version FROM box",
        "box",
    )
)
def signal_rows(spark, d):
    """Signals as the signal table keeps them."""
    found = _box(spark, d).withColumn("evidence", F.split("hit_levels", ", "))
    return store.signal_rows(found, "v1").withColumn("score", F.round("score", 6))


def _downloads(spark, d):
    """Corrected bars of one symbol in three from 1999 on, every other one of them in another adjustment."""
    fresh = src.bars(spark, d).where("symbol % 3 = 0 and date >= date'1999-01-01'").withColumn("close", F.col("close") * lit(1.01))
    return fresh.withColumn("adjust_type", F.when(F.col("symbol") % 2 == 0, "hfq").otherwise("qfq"))


@query(
    with_ctes(
        "SELECT symbol, coalesce(fetched, 0) AS fetched, first_date, last_date, row_count, CASE WHEN fetched IS NULL THEN 'empty' WHEN symbol % 2 = 0 THEN "
        "'degraded' WHEN row_count >= 260 THEN 'ready' ELSE 'partial' END AS status FROM (SELECT symbol, nullif(count(*) FILTER (symbol % 3 = 0 AND date "
        ">= DATE '1999-01-01'), 0) AS fetched, "
        "min(date) AS first_date, max(date) AS last_date, count(*) AS row_count FROM bars GROUP BY symbol)",
        "bars",
    )
)
def sync_coverage(spark, d):
    frame = src.bars(spark, d)
    return store.merged_coverage(frame, _downloads(spark, d), frame.select("symbol").distinct())[1]


@query(
    with_ctes(
        "SELECT symbol, date, round(ma20, 6) AS MA20 FROM (SELECT symbol, date, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS ma20, "
        "row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM (SELECT symbol, date, close * CASE WHEN date >= DATE '1999-01-01' THEN "
        "1.01::DOUBLE ELSE 1 END AS close FROM bars WHERE symbol % 3 = 0) "
        "WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) WHERE back <= 5",
        "bars",
    )
)
def sync_recomputed(spark, d):
    """Indicators of the symbols that a download changed, from all of their bars; the last five of each."""
    frame, fresh = src.bars(spark, d), _downloads(spark, d)
    merged = store.merged_coverage(frame, fresh, frame.select("symbol").distinct())[0].join(fresh.select("symbol").distinct(), "symbol", "left_semi")
    return store.clip(ta.moving_averages(merged), tail=5).select("symbol", "date", F.round("MA20", 6).alias("MA20"))


@query(with_ctes("SELECT symbol, date FROM box WHERE vol_ratio <= 2::DOUBLE OR boll_width >= 0.2::DOUBLE", "box"))
def rule_union(spark, d):
    """Signals that meet one rule set or another."""
    from functools import reduce
    from operator import or_

    from candela.operators.optimize import Rule, mask

    pools = ((Rule("vol_ratio", "<=", 2.0),), (Rule("boll_width", ">=", 0.2),))
    return _box(spark, d).where(reduce(or_, map(mask, pools))).select("symbol", "date")


_RULES = {"calm": ("vol_ratio <= 2", (("vol_ratio", "<=", 2.0),)), "wide": ("boll_width >= 0.2", (("boll_width", ">=", 0.2),)),
    "both": ("vol_ratio <= 2 AND boll_width >= 0.2", (("vol_ratio", "<=", 2.0), ("boll_width", ">=", 0.2)))}


@query(
    with_ctes(
        "SELECT name, part, count(*) AS n, round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win, round(avg(ret_10), 6) AS avg, round(avg((max_gain_10 > 0.02::DOUBLE)::INT::DOUBLE), 6) AS ever_up2, "
        "round(avg(max_gain_10), 6) AS avg_max_gain FROM (SELECT name, ret_10, max_gain_10, unnest(['all', CASE WHEN date >= DATE '1998-06-01' THEN 'test' ELSE 'train' END]) AS part FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS name, date, ret_10, max_gain_10 FROM events_ WHERE {v.replace('0.2', '0.2::DOUBLE')}" for k, (v, _) in _RULES.items())
        + ") WHERE ret_10 IS NOT NULL) GROUP BY ALL",
        "events_",
    )
)
def rule_train_test(spark, d):
    """Rule sets before a date, from it on, and in all."""
    from candela.operators.optimize import Rule, train_test

    out = train_test(_box_events(spark, d), {k: tuple(Rule(*x) for x in rules) for k, (_, rules) in _RULES.items()}, "1998-06-01")
    return out.select("name", "part", "n", *[F.round(c, 6).alias(c) for c in ("win", "avg", "ever_up2", "avg_max_gain")])


@query(with_ctes("SELECT symbol, rank_date AS date, rank::INT AS rank FROM ranks", "ranks"))
def rank_history(spark, d):
    """Rank histories, encrypted as a provider sends them, and read back."""
    ranked = src.ranks(src.bars(spark, d))
    texts = ranked.groupBy("symbol").agg(F.to_json(F.collect_list(F.struct(F.concat(F.col("rank_date").cast("string"), F.lit(" 15:00")).alias("calcTime"),
        "rank"))).alias("text"))  # the bars of one symbol
    key = "0123456789abcdef"
    sealed = F.base64(F.aes_encrypt(F.col("text").cast("binary"), F.lit(key.encode()), F.lit("CBC"), F.lit("PKCS")))
    return parsers.rank_history(texts.select("symbol", sealed.alias("payload")), key)


@query(with_ctes("SELECT symbol, date, 'qfq' AS adjust_type, round(close, 6) AS close, NULL::DOUBLE AS turnover_rate, coalesce(CASE WHEN symbol % 2 = 0 "
    "THEN 'first' END, 'derived') AS source FROM bars", "bars"))
def typed_sink_rows(spark, d):
    """Bars in the schema of the bar table: adjustment and source by default, what is not there null."""
    frame = src.bars(spark, d).withColumn("source", F.when(F.col("symbol") % 2 == 0, "first"))
    out = store.conform(frame, "symbol long, date date, adjust_type string, close double, turnover_rate double, source string",
        {"adjust_type": "qfq", "source": "derived"})
    return out.withColumn("close", F.round("close", 6))


@query(
    with_ctes(
        "SELECT t.symbol, count(*) AS pivot_count, max(w.impulse) AS impulse_score, arg_max(t.typ, t.ordinal) AS last_type, round(max(l.last_close), 6) AS "
        "close FROM line t JOIN (SELECT symbol, arg_max(close, date) AS last_close FROM bars GROUP BY symbol) l USING (symbol) "
        "LEFT JOIN (SELECT symbol, CASE WHEN n = 6 THEN (" + _IMPULSE + ") * 20 END AS impulse FROM lengths) w USING (symbol) GROUP BY t.symbol",
        "pivots", recursive=f"{_fold(0.03)}, {_SIX}",
    )
)
def wave_analysis(spark, d):
    """Each symbol's confirmed pivots, wave score and open leg in one row."""
    out = pv.analyse(src.bars(spark, d))
    return out.select("symbol", "pivot_count", "impulse_score", F.col("from_type").alias("last_type"), F.round("last_close", 6).alias("close"))
