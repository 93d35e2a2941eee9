"""Queries of the stock report and of sectors around a stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.series import lit
from candela.operators import indicators as ta
from candela.operators import levels, research
from candela.operators import pivots as pv
from candela.plans import market  # noqa: F401  its oracles are parts of the ones here
from candela.plans.analysis import _fold
from candela.plans.oracle import full, with_ctes
from candela.plans.registry import ORACLES, query
from candela.sources import bars as src

_LAST_BAR = f"""last_bar AS (SELECT * FROM (SELECT symbol, close, {full(120, 'avg(close)', 'close')} AS ma120, count(*) OVER (PARTITION BY symbol) - 1 AS idx,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn = 1 AND idx >= 259)"""
_TRENDS = f"""{_fold(0.03)}, {_LAST_BAR},
recent AS (SELECT l.*, row_number() OVER (PARTITION BY l.symbol, typ ORDER BY ordinal DESC) AS back FROM line l JOIN last_bar b ON b.symbol = l.symbol AND l.idx >= b.idx - 250),
turns AS (SELECT symbol, max(price) FILTER (typ = 'H') AS top, min(price) FILTER (typ = 'L') AS bottom, max(price) FILTER (typ = 'H' AND back = 1) AS h1,
  max(price) FILTER (typ = 'H' AND back = 2) AS h2, max(price) FILTER (typ = 'L' AND back = 1) AS l1, max(price) FILTER (typ = 'L' AND back = 2) AS l2 FROM recent GROUP BY symbol),
reached AS (SELECT t.*, min(r.idx) FILTER (r.typ = 'H' AND r.price = top) AS ti, min(r.idx) FILTER (r.typ = 'L' AND r.price = bottom) AS bi FROM turns t JOIN recent r USING (symbol) GROUP BY ALL),
stock_trends AS (SELECT b.symbol, CASE
  WHEN top / bottom - 1 >= 0.2::DOUBLE AND bi < ti AND NOT coalesce(close <= ma120, false) AND (coalesce(h1 > h2 AND l1 > l2, false) OR top / bottom - 1 >= 0.3::DOUBLE) THEN 'up'
  WHEN top / bottom - 1 >= 0.2::DOUBLE AND ti < bi AND NOT coalesce(close >= ma120, false) AND (coalesce(h1 < h2 AND l1 < l2, false) OR top / bottom - 1 >= 0.3::DOUBLE) THEN 'down'
  ELSE 'range' END AS trend FROM last_bar b LEFT JOIN reached USING (symbol))"""
_CONTEXT = f"""{_TRENDS}, sector_trends AS ({ORACLES['sector_trend']}),
last_flow AS (SELECT symbol, arg_max(net_inflow, date) AS net_inflow, arg_max(amount, date) AS amount FROM flows JOIN bars USING (symbol, date) GROUP BY symbol),
inside AS (SELECT sector_code, count(*) AS member_count, round(avg((change_rate > 0)::INT::DOUBLE) * 100, 2) AS breadth, round(median(change_rate), 4) AS median_change,
  sum(net_inflow) / nullif(sum(last_flow.amount), 0) * 100 AS net_pct FROM members LEFT JOIN spot USING (symbol) LEFT JOIN last_flow USING (symbol) GROUP BY ALL),
lengths_ AS (SELECT sector_code, count(*) AS bars FROM sector_bars GROUP BY ALL),
placed AS (SELECT m.symbol, sector_code, sector_type, member_count, coalesce(n.bars, 0) AS bars, s.trend AS st, coalesce(x.trend, 'unknown') AS se, breadth, median_change, net_pct,
  row_number() OVER (PARTITION BY m.symbol ORDER BY sector_type <> 'industry', coalesce(n.bars, 0) DESC, member_count, sector_code) AS position
  FROM members m JOIN stock_trends s USING (symbol) JOIN inside USING (sector_code) LEFT JOIN sector_trends x USING (sector_code) LEFT JOIN lengths_ n USING (sector_code)),
scored AS (SELECT *, round(greatest(-1, least(1, CASE WHEN st = se AND st IN ('up', 'down') THEN 0.45::DOUBLE WHEN st = 'range' OR se = 'range' THEN 0.15::DOUBLE ELSE -0.25::DOUBLE END
  + CASE WHEN sector_type = 'industry' THEN 0.15::DOUBLE ELSE 0 END + coalesce(greatest(-0.15::DOUBLE, least(0.15::DOUBLE, net_pct / 10)), 0)
  + coalesce(greatest(-0.2::DOUBLE, least(0.2::DOUBLE, (breadth - 50) / 100)), 0))), 4) AS alignment FROM placed WHERE position <= 6)"""


def sector_inputs(spark, d, member=None) -> dict:
    """What ``research.sector_context`` takes besides trends; ``member`` narrows it to some sectors."""
    member = src.members(spark, d) if member is None else member
    frame = src.bars(spark, d)
    flow = src.flows(frame).join(frame.select("symbol", "date", "amount"), ["symbol", "date"]).groupBy("symbol").agg(F.max_by("net_inflow", "date").alias("net_inflow"),
        F.max_by("amount", "date").alias("amount"))
    return {"members": member, "sectors": src.sector_bars(frame, member), "changes": src.spot(spark, d).select("symbol", "change_rate"), "flows": flow}


@query(with_ctes("SELECT symbol, position, sector_code, sector_type, member_count, bars, st AS stock_trend, se AS sector_trend, breadth, median_change, round(net_pct, 6) + 0::DOUBLE AS "
    "net_pct, CASE WHEN bars > 0 THEN alignment END AS alignment, CASE WHEN bars = 0 THEN NULL WHEN st = se AND st IN ('up', 'down') AND alignment >= 0.35::DOUBLE THEN 'aligned' "
    "WHEN (st = 'up' AND se = 'down') OR (st = 'down' AND se = 'up') OR alignment < 0 THEN 'conflicting' ELSE 'mixed' END AS label, CASE WHEN bars = 0 THEN 'missing' WHEN bars >= 260 "
    "THEN 'ready' ELSE 'short_history' END AS data_status FROM scored", "bars", "pivots", "members", "spot", "flows", "sector_bars", recursive=_CONTEXT))
def sector_alignment(spark, d):
    """Every symbol's sectors, at most six: both trends, breadth, median change, money flow, and how well they agree."""
    frame = src.bars(spark, d)
    found = research.sector_context(levels.trends(frame, pv.zigzag(pv.pivots(frame))), **sector_inputs(spark, d))
    return found.withColumn("net_pct", F.round("net_pct", 6) + lit(0))


def _ladder(close: str = "close") -> str:
    side = {"BOLL_UPPER": "false", "BOLL_LOWER": "true", "BOLL_MID": f"BOLL_MID <= {close}"}
    rows = " UNION ALL ".join(f"SELECT symbol, {i} AS place, '{c}' AS type, '{s}' AS strength, {c} AS value, {side.get(c, f'{c} < {close}')} AS under FROM last_"
        for i, (c, s) in enumerate(research.LEVELS))
    return f"""levels_ AS (SELECT *, round(value, 2) AS level FROM ({rows}) WHERE value > 0),
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY symbol, under ORDER BY CASE WHEN under THEN -level ELSE level END, place) AS k FROM levels_),
sides_ AS (SELECT symbol, string_agg(type || ':' || level::DECIMAL(18, 2)::VARCHAR || ':' || strength, ',' ORDER BY k) FILTER (under AND k <= 5) AS supports,
  string_agg(type || ':' || level::DECIMAL(18, 2)::VARCHAR || ':' || strength, ',' ORDER BY k) FILTER (NOT under AND k <= 5) AS resistances,
  max(level) FILTER (under AND k = 1) AS support, max(level) FILTER (NOT under AND k = 1) AS resistance FROM ranked_ GROUP BY symbol)"""


_BEFORE = "lag({0}) OVER (PARTITION BY symbol ORDER BY date) AS {0}_before"
_LAST = f"""last_ AS (SELECT * FROM (SELECT *, {", ".join(f"round(RETURN_{n} * 100, 1) AS p{n}" for n in (5, 10, 20, 60))}, count(*) OVER (PARTITION BY symbol) AS n_bars,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, (close - BOLL_LOWER) / nullif(BOLL_UPPER - BOLL_LOWER, 0) * 100 AS place, ATR14 / close * 100 AS swing FROM ind) WHERE rn = 1)"""
_REPORT = f"""momentum AS (SELECT * FROM ({ORACLES['rsi']}) JOIN ({ORACLES['kdj']}) USING (symbol, date) JOIN (SELECT *, {_BEFORE.format('DIF')}, {_BEFORE.format('DEA')} FROM ({ORACLES['macd']})) USING (symbol, date)),
{_LAST},
{_ladder()},
all_ AS (SELECT l.*, m.* EXCLUDE (symbol, date), p.pe_dynamic AS pe, p.pb, p.turnover_rate AS hands, p.symbol IS NOT NULL AS listed, supports, resistances, support, resistance,
  CASE WHEN ATR14 <> 0 AND support IS NOT NULL THEN CASE WHEN (close - round(support - ATR14, 2)) / close * 100 > 15 THEN round(close * 0.93::DOUBLE, 2) ELSE round(support - ATR14, 2) END
  WHEN ATR14 <> 0 THEN round(close - 2 * ATR14, 2) ELSE round(close * 0.95::DOUBLE, 2) END AS stop
  FROM last_ l JOIN momentum m USING (symbol, date) LEFT JOIN spot p USING (symbol) LEFT JOIN sides_ USING (symbol)),
paid AS (SELECT *, CASE WHEN close > stop AND resistance > close THEN round((resistance - close) / (close - stop), 2) WHEN close > stop AND resistance IS NOT NULL THEN -1 END AS rr FROM all_)"""
_RISK = """CASE WHEN listed AND NOT coalesce(pe > 0, false) THEN 'high' WHEN RSI14 > 80 OR KDJ_J > 100 THEN 'high' WHEN RSI14 > 70 THEN 'medium' WHEN swing > 8 THEN 'high' WHEN swing > 5 THEN 'medium'
  WHEN listed AND pe > 100 THEN 'medium' ELSE 'low' END"""
_ITEMS = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in {"rsi_extreme": "RSI14 > 80", "rsi_overbought": "RSI14 > 70 AND RSI14 <= 80", "kdj_overbought": "KDJ_J > 100", "swing_extreme": "swing > 8",
    "swing_high": "swing > 5 AND swing <= 8", "loss": "listed AND NOT coalesce(pe > 0, false)", "dear": "listed AND pe > 100", "price_to_book": "listed AND pb > 10",
    "illiquid": "listed AND hands < 1", "below_ma60": "n_bars >= 60 AND close < MA60"}.items())
_LABELS = """CASE WHEN RSI14 IS NULL THEN 'unknown' WHEN RSI14 > 80 THEN 'extreme_overbought' WHEN RSI14 > 70 THEN 'overbought' WHEN RSI14 < 20 THEN 'extreme_oversold' WHEN RSI14 < 30 THEN 'oversold'
  WHEN RSI14 BETWEEN 40 AND 60 THEN 'neutral' WHEN RSI14 > 60 THEN 'strong' ELSE 'weak' END AS rsi_status,
 CASE WHEN DIF > DEA AND DIF_before <= DEA_before THEN 'golden_cross' WHEN DIF > DEA THEN 'bullish' WHEN DIF_before >= DEA_before THEN 'death_cross' ELSE 'bearish' END AS macd_status,
 CASE WHEN KDJ_J IS NULL THEN 'unknown' WHEN KDJ_J > 100 THEN 'overheated' WHEN KDJ_J < 0 THEN 'exhausted' WHEN KDJ_K > 80 AND KDJ_D > 80 THEN 'overbought' WHEN KDJ_K < 20 AND KDJ_D < 20 THEN 'oversold'
  WHEN KDJ_K > KDJ_D THEN 'rising' ELSE 'falling' END AS kdj_status"""
_SHAPE = """CASE WHEN MA5 > MA10 AND MA10 > MA20 AND MA20 > MA60 THEN 'bullish' WHEN MA5 < MA10 AND MA10 < MA20 THEN 'bearish' WHEN MA5 > MA20 THEN 'leaning_up' ELSE 'tangled' END AS arrangement,
 CASE WHEN place IS NULL THEN 'unknown' WHEN place > 90 THEN 'at_upper' WHEN place > 70 THEN 'upper_part' WHEN place < 10 THEN 'at_lower' WHEN place < 30 THEN 'lower_part' ELSE 'middle' END AS boll_status,
 CASE WHEN p5 IS NULL THEN 'unknown' WHEN p5 > 3 AND p20 > 0 THEN 'strong_rise' WHEN p5 < -3 AND p20 < 0 THEN 'steady_fall' WHEN p5 > 0 THEN 'recovering' WHEN p5 < 0 THEN 'pulling_back' ELSE 'sideways' END AS direction"""
_UPSIDE = "coalesce(close > MA20, false)"
_CALM = f"({_UPSIDE} AND coalesce(MA20 > MA60, false) AND NOT coalesce(RSI14 >= 70, false))"


@query(with_ctes(f"SELECT symbol, {_SHAPE} FROM last_", "ind", recursive=_LAST))
def report_ladders(spark, d):
    return research.report(research.last_rows(ta.all_indicators(src.bars(spark, d)))).select("symbol", "arrangement", "boll_status", "direction")


@query(with_ctes(f"SELECT symbol, {_LABELS}, {_SHAPE}, coalesce(close > BOLL_MID, false) AS above_mid, coalesce(supports, '') AS supports, coalesce(resistances, '') AS resistances, support, resistance, "
    f"{_RISK} AS risk, concat_ws(',', {_ITEMS}) AS risk_items, round(stop, 2) AS stop, rr AS reward_risk, CASE WHEN rr >= 3 AND {_CALM} THEN 'enter' WHEN rr >= 3 AND {_UPSIDE} THEN 'join' "
    f"WHEN rr >= 3 THEN 'probe' WHEN rr >= 2 AND {_UPSIDE} THEN 'join' WHEN rr >= 2 THEN 'wait_or_tiny' WHEN rr > 0 THEN 'poor_reward' ELSE 'no_chance' END AS advice, CASE WHEN rr >= 3 AND {_CALM} "
    f"THEN '30-50%' WHEN rr >= 3 AND {_UPSIDE} THEN '15-30%' WHEN rr >= 3 THEN '5-15%' WHEN rr >= 2 AND {_UPSIDE} THEN '10-20%' WHEN rr >= 2 THEN '<10%' END AS position_pct FROM paid",
    "ind", "spot", recursive=_REPORT))
def stock_report(spark, d):
    """The report of every symbol, its levels as text."""
    out = research.report(research.last_rows(ta.all_indicators(src.bars(spark, d))), src.spot(spark, d))

    def told(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["type"], x["level"].cast("decimal(18,2)").cast("string"), x["strength"])), ",").alias(c)

    return out.select("symbol", "rsi_status", "macd_status", "kdj_status", "arrangement", "boll_status", "direction", "above_mid", told("supports"), told("resistances"), "support", "resistance",
        "risk", F.array_join("risk_items", ",").alias("risk_items"), "stop", "reward_risk", "advice", "position_pct")
