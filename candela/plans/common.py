"""Queries of what winning and losing events share, and of the universe that a search looks at."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from candela.functions.series import lit, rounded
from candela.operators import backtest, resonance, screens, store
from candela.operators import indicators as ta
from candela.plans import market  # noqa: F401  its oracles are parts of the ones here
from candela.plans.oracle import cte, with_ctes
from candela.plans.registry import ORACLES, query
from candela.sources import bars as src

_FIELDS = "symbol, date, vol_ratio, boll_pos, BIAS60, ma_bull"
cte("told", ("fac", "fwd"), f"""
  SELECT *, 'box_breakout' AS pattern, least(1, 0.6::DOUBLE + vol_ratio / 10) AS score FROM
   (SELECT {_FIELDS}, ret_10, CASE WHEN close > MA20 THEN 'up' WHEN close < MA20 THEN 'down' ELSE 'range' END AS trend FROM fac JOIN fwd USING (symbol, date)
    WHERE close > open AND ret_10 IS NOT NULL)
   JOIN (SELECT symbol, date, RSI14 FROM ({ORACLES['rsi']})) USING (symbol, date) JOIN (SELECT symbol, date, DIF FROM ({ORACLES['macd']})) USING (symbol, date)
   JOIN (SELECT symbol, date, KDJ_J FROM ({ORACLES['kdj']})) USING (symbol, date)""")


def _events(spark, d):
    """Rising bars as events, with indicators to six digits, a trend by MA20 and a score by volume."""
    frame = ta.simple_factors(ta.all_indicators(src.with_change(src.bars(spark, d)))).where(F.col("close") > F.col("open"))
    trend = F.when(F.col("close") > F.col("MA20"), "up").when(F.col("close") < F.col("MA20"), "down").otherwise("range")
    told = frame.select(*_FIELDS.split(", "), *rounded(["RSI14", "DIF", "KDJ_J"]), trend.alias("trend"), F.lit("box_breakout").alias("pattern"),
        F.least(lit(1), lit(0.6) + F.col("vol_ratio") / 10).alias("score"))
    return backtest.outcomes(told, src.bars(spark, d))


_RATES = "count(*) AS n, round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win_10, round(avg(ret_10), 6) + 0::DOUBLE AS avg_10"
_SQL = {k: re.sub(r"(\d)D\b", r"\1::DOUBLE", c) for k, c in {**resonance.FAVOURABLE, **resonance.COMBINATIONS, **resonance.RISKS}.items()}
_BIN_ROWS = ", ".join(f"('{f}', {i + 1}, {a}::DOUBLE, {b}::DOUBLE)" for f, edges in resonance.BINS.items() for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))


@query(with_ctes(f"SELECT field, bin, low, high, {_RATES} FROM (SELECT ret_10, unnest([{', '.join(repr(f) for f in resonance.BINS)}]) AS field, unnest([{', '.join(resonance.BINS)}]) AS x FROM told) "
    f"JOIN (VALUES {_BIN_ROWS}) b(field, bin, low, high) USING (field) WHERE x >= low AND x < high GROUP BY ALL HAVING count(*) > 10", "told"))
def bin_rates(spark, d):
    """Outcomes by fixed bins of RSI, band position, volume ratio and score."""
    return resonance.bin_rates(_events(spark, d)).select("field", "bin", "low", "high", "n", *rounded(["win_10", "avg_10"]))


_COUNT = " + ".join(f"coalesce({_SQL[k]}, false)::INT" for k in resonance.FAVOURABLE)


@query(with_ctes(f"SELECT 'count' AS part, ({_COUNT})::VARCHAR AS item, {_RATES} FROM told GROUP BY ALL HAVING count(*) >= 5 "
    + " ".join(f"UNION ALL SELECT 'factor', '{k}:' || CASE WHEN {_SQL[k]} THEN 'on' ELSE 'off' END AS i, {_RATES} FROM told GROUP BY i HAVING count(*) > 10" for k in resonance.FAVOURABLE)
    + " " + " ".join(f"UNION ALL SELECT 'combination', '{k}', {_RATES} FROM told WHERE {_SQL[k]} HAVING count(*) >= 10" for k in resonance.COMBINATIONS), "told"))
def factor_resonance(spark, d):
    """Outcomes by the number of favourable factors, by each factor on and off, and by named combinations."""
    return resonance.resonance(_events(spark, d)).select("part", "item", "n", *rounded(["win_10", "avg_10"]))


_LOST = f"FROM told WHERE ret_10 < {resonance.LOSS}::DOUBLE"
_AVG = "round(avg(ret_10), 6) + 0::DOUBLE"


@query(with_ctes(f"SELECT 'losers' AS part, 'share' AS item, count(*) AS n, round(avg((ret_10 < {resonance.LOSS}::DOUBLE)::INT::DOUBLE), 6) AS value, {_AVG} AS avg_10 FROM told "
    f"UNION ALL SELECT 'trend', trend, count(*), NULL, {_AVG} {_LOST} GROUP BY trend "
    + " ".join(f"UNION ALL SELECT 'mean', '{c}', count(*), round(avg({c}), 6) + 0::DOUBLE, {_AVG} {_LOST} AND {c} IS NOT NULL HAVING count(*) > 0" for c in resonance.PROFILE)
    + " " + " ".join(f"UNION ALL SELECT 'risk', '{k}', count(*), round(avg((ret_10 > 0)::INT::DOUBLE), 6), {_AVG} FROM told WHERE {_SQL[k]} HAVING count(*) > 5" for k in resonance.RISKS), "told"))
def loser_profile(spark, d):
    """Share and means of the events that lost most, and win rates under each risk."""
    return resonance.loser_profile(_events(spark, d)).select("part", "item", "n", *rounded(["value", "avg_10"]))


@query(with_ctes("SELECT symbol, name, count(*) AS row_count FROM basics JOIN bars USING (symbol) WHERE NOT contains(name, 'ST') GROUP BY ALL HAVING count(*) >= 260", "basics", "bars"))
def candidate_universe(spark, d):
    """Symbols that a similarity search looks at: enough bars, no special treatment; the longest histories first."""
    return screens.candidate_universe(src.basics(spark, d), store.coverage(src.bars(spark, d)))
