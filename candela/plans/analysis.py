"""Queries over pivots, patterns, back-tests, shapes, research and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from candela.functions.series import lit, ratio, rounded, trailing
from candela.operators import backtest, detectors, levels, optimize, research, resample, screens, similarity, structure
from candela.operators import indicators as ta
from candela.operators import pivots as pv
from candela.plans.oracle import W, cte, full, score_range, with_ctes
from candela.plans.oracle import rounded as r
from candela.plans.registry import query
from candela.sources import bars as src
from candela.sources import parsers
from candela.streaming import alerts, windows

FACTORS = ("change_rate", "turnover_ma20", "vol_ratio", "BIAS60", "boll_pos", "boll_width", "up_days_ratio_20")


def _simple(spark, d):
    return ta.simple_factors(ta.native_indicators(src.with_change(src.bars(spark, d))))


def _box(spark, d):
    """Raw box breakouts as signals."""
    found = detectors.box_breakout_raw(_simple(spark, d))
    return found.select("symbol", "date", F.lit("box_breakout").alias("pattern"),
        F.when(F.col("vol_ratio") >= 2, "strong").otherwise("plain").alias("variant"), F.lit("box_high, volume").alias("hit_levels"), "score", *rounded(list(FACTORS), 9))


def _box_events(spark, d):
    return backtest.outcomes(_box(spark, d), src.bars(spark, d))


_WIDTH, _BREAK = "(box_high - box_low) / box_low", "close / box_high - 1"
cte("box", ("fac",), f"""
  SELECT symbol, date, 'box_breakout' AS pattern, CASE WHEN vol_ratio >= 2 THEN 'strong' ELSE 'plain' END AS variant, 'box_high, volume' AS hit_levels, {r(' '.join(FACTORS), 9)},
         0.4::DOUBLE * {score_range('width', 0.05, 0.12, 0.02, 0.25)} + 0.35::DOUBLE * {score_range('vol_ratio', 2.0, 8.0, 1.5, 20.0)} + 0.25::DOUBLE * {score_range('breakout', 0.005, 0.05, 0.003, 0.099)} AS score
  FROM (SELECT *, {_WIDTH} AS width, {_BREAK} AS breakout
        FROM (SELECT *, {full(40, 'max(close)', 'close', True)} AS box_high, {full(40, 'min(close)', 'close', True)} AS box_low, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS high120 FROM fac))
  WHERE is_yang AND break_close40 AND vol_ratio >= 1.5 AND close > high120 * 0.999::DOUBLE AND width <= 0.25::DOUBLE AND breakout >= 0.003::DOUBLE AND {score_range('width', 0.05, 0.12, 0.02, 0.25)} > 0""")
_FWD = ", ".join(f"lead(close, {1 + n}) {W} / nullif(lead(open) {W}, 0) - 1 AS ret_{n}, CASE WHEN lead(close, {1 + n}) {W} IS NOT NULL THEN max(high) OVER "
    f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {1 + n} FOLLOWING) / nullif(lead(open) {W}, 0) - 1 END AS max_gain_{n}" for n in (5, 10, 20))
cte("fwd", ("bars",), f"SELECT symbol, date, lead(open) {W} AS entry, {_FWD} FROM bars")
cte("events_", ("box", "fwd"), "SELECT * FROM box JOIN fwd USING (symbol, date)")


@query(with_ctes("SELECT symbol, date, idx, typ, round(price, 6) AS price, confirm FROM pivots", "pivots"))
def pivot_events(spark, d):
    return pv.pivots(src.bars(spark, d)).select("symbol", "date", "idx", "typ", F.round("price", 6).alias("price"), "confirm")


def _fold(swing: float, source: str = "pivots", tag: str = "") -> str:
    """The zigzag as a recursion over pivots; the state after each says which point is last and how many there are."""
    step = f"CASE WHEN s.typ = p.typ THEN CASE WHEN (p.typ = 'H' AND p.price > s.price) OR (p.typ = 'L' AND p.price < s.price) THEN 1 ELSE 0 END WHEN abs(p.price / s.price - 1) >= {swing}::DOUBLE THEN 2 ELSE 0 END"
    return f"""p{tag} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confirm, idx, typ) AS k FROM {source}),
 s{tag}(symbol, k, date, idx, typ, price, confirm, ordinal) AS (SELECT symbol, k, date, idx, typ, price, confirm, 0 FROM p{tag} WHERE k = 1 UNION ALL
   SELECT symbol, k, CASE WHEN how > 0 THEN d2 ELSE date END, CASE WHEN how > 0 THEN i2 ELSE idx END, CASE WHEN how > 0 THEN t2 ELSE typ END,
          CASE WHEN how > 0 THEN p2 ELSE price END, CASE WHEN how > 0 THEN c2 ELSE confirm END, ordinal + CASE WHEN how = 2 THEN 1 ELSE 0 END
   FROM (SELECT p.symbol, p.k, s.date, s.idx, s.typ, s.price, s.confirm, s.ordinal, p.date AS d2, p.idx AS i2, p.typ AS t2, p.price AS p2, p.confirm AS c2, {step} AS how
         FROM s{tag} s JOIN p{tag} p ON p.symbol = s.symbol AND p.k = s.k + 1)),
 line{tag} AS (SELECT symbol, ordinal, arg_max(date, k) AS date, arg_max(idx, k) AS idx, arg_max(typ, k) AS typ, arg_max(price, k) AS price, arg_max(confirm, k) AS confirm FROM s{tag} GROUP BY symbol, ordinal),
 legs_{tag} AS (SELECT * FROM (SELECT symbol, ordinal, idx AS start_idx, price AS start_price, lead(idx) OVER w AS end_idx, lead(price) OVER w AS end_price, lead(confirm) OVER w AS confirm
   FROM line{tag} WINDOW w AS (PARTITION BY symbol ORDER BY ordinal)) WHERE end_idx IS NOT NULL)"""


@query(with_ctes("SELECT symbol, ordinal, idx, typ, round(price, 6) AS price, confirm FROM line", "pivots", recursive=_fold(0.03)))
def zigzag(spark, d):
    return pv.zigzag(pv.pivots(src.bars(spark, d))).select("symbol", "ordinal", "idx", "typ", F.round("price", 6).alias("price"), "confirm")


_SCALED = ", ".join(_fold(swing, source, f"_{scale}") for scale, source, swing in (("fine", "pivots3", 0.02), ("medium", "pivots", 0.04), ("coarse", "pivots10", 0.08)))


@query(
    with_ctes(
        " UNION ALL ".join(f"SELECT '{k}' AS scale, symbol, ordinal, date, idx, typ, round(price, 6) AS price, confirm FROM line_{k}" for k in ("fine",
        "medium", "coarse")), "pivots", "pivots3", "pivots10", recursive=_SCALED
    )
)
def zigzag_multiscale(spark, d):
    line = pv.multiscale(src.bars(spark, d))
    return line.select("scale", "symbol", "ordinal", "date", "idx", "typ", F.round("price", 6).alias("price"), "confirm")


def _line(spark, d):
    return pv.zigzag(pv.pivots(src.bars(spark, d)), 0.04)


def _legs(spark, d):
    return pv.legs(_line(spark, d), src.bars(spark, d))


_MOVES = f"""{_fold(0.04)},
 moves_ AS (SELECT l.*, CASE WHEN end_price > start_price THEN 'up' ELSE 'down' END AS direction, end_idx - start_idx AS bars, end_price / start_price - 1 AS pct, end_price - start_price AS move,
   round(abs(end_price - start_price) / CASE WHEN b.atr > 0 THEN b.atr END, 6) AS atr_move FROM legs_ l LEFT JOIN bars_n b ON b.symbol = l.symbol AND b.idx = l.end_idx),
 anchors_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(atr_move, abs(pct) * 100) DESC, bars DESC, end_idx DESC) AS position
   FROM moves_ WHERE bars >= 3 AND (atr_move IS NULL OR atr_move >= 1)) WHERE position <= 5),
 last_ AS (SELECT symbol, arg_max(close, idx) AS last_close, arg_max(atr, idx) AS last_atr FROM bars_n GROUP BY symbol)"""


@query(with_ctes("SELECT symbol, ordinal, start_idx, end_idx, confirm, bars, direction, round(pct, 6) AS pct, atr_move FROM moves_",
    "pivots", "bars_n", recursive=_MOVES))
def legs(spark, d):
    return _legs(spark, d).select("symbol", "ordinal", "start_idx", "end_idx", "confirm", "bars", "direction", F.round("pct", 6).alias("pct"),
        "atr_move")


@query(with_ctes("SELECT symbol, start_idx, end_idx, position, round(pct, 6) AS pct, round(1 / position, 6) AS rank FROM anchors_", "pivots", "bars_n", recursive=_MOVES))
def anchors(spark, d):
    return pv.anchors(_legs(spark, d)).select("symbol", "start_idx", "end_idx", "position", F.round("pct", 6).alias("pct"), "rank")


_ZONE = "end_price - ratio * move"
_REACH = "greatest(abs(last_atr) * 0.15::DOUBLE, 0.01::DOUBLE)"


@query(
    with_ctes(
        f"SELECT symbol, start_idx, end_idx, ratio, round({_ZONE}, 8) AS level, round({_ZONE} - {_REACH}, 8) AS lower, round({_ZONE} + {_REACH}, 8) AS "
        f"upper FROM anchors_ JOIN last_ USING (symbol), (SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786, 1]::DOUBLE[]) AS ratio)",
        "pivots", "bars_n", recursive=_MOVES,
    )
)
def fib_zones(spark, d):
    return pv.fib_zones(pv.anchors(_legs(spark, d)), src.bars(spark, d)).select("symbol", "start_idx", "end_idx", "ratio", *rounded(["level", "lower", "upper"], 8))


@query(
    with_ctes(
        "SELECT a.symbol, a.start_idx, a.end_idx, n.end_idx AS from_idx, ratio, round(n.end_price + ratio * a.move, 8) AS target, round((last_close - "
        "n.end_price) / a.move, 8) AS projection "
        "FROM anchors_ a JOIN legs_ n ON n.symbol = a.symbol AND n.start_idx = a.end_idx JOIN last_ l ON l.symbol = a.symbol, (SELECT unnest([1, 1.272, "
        "1.618, 2, 2.618]::DOUBLE[]) AS ratio)",
        "pivots", "bars_n", recursive=_MOVES,
    )
)
def projection_targets(spark, d):
    moves = _legs(spark, d)
    return pv.projections(pv.anchors(moves), moves, src.bars(spark, d)).select("symbol", "start_idx", "end_idx", "from_idx", "ratio", *rounded(["target", "projection"], 8))


_BACK = """SELECT a.symbol, a.start_idx, a.end_idx, a.direction, (a.end_price - last_close) / a.move AS retracement, (last_close - a.start_price) / a.move AS position, max((a.end_price - b.close) / a.move) AS deepest
 FROM anchors_ a JOIN bars_n b ON b.symbol = a.symbol AND b.idx >= a.end_idx JOIN last_ l ON l.symbol = a.symbol GROUP BY ALL"""


@query(
    with_ctes(
        "SELECT symbol, start_idx, end_idx, direction, round(retracement, 6) AS retracement, round(position, 6) AS position, round(deepest, 6) AS deepest, "
        "CASE WHEN retracement > 1 THEN 'over_retraced' WHEN deepest > 0 AND position > 1 THEN 'resumed' "
        f"WHEN deepest > 0 AND retracement <= 0 THEN 'retracement_confirming' WHEN deepest > 0 THEN 'retracing' ELSE 'impulse' END AS phase FROM ({_BACK})",
        "pivots", "bars_n", recursive=_MOVES,
    )
)
def retracement_phases(spark, d):
    return pv.retracements(pv.anchors(_legs(spark, d)), src.bars(spark, d)).select("symbol", "start_idx", "end_idx", "direction",
        *rounded(["retracement", "position", "deepest"]), "phase")


_TURNS = """turns_ AS (SELECT *, span / before AS ratio, list_extract(list_sort([{'d': abs(span / before - x), 'x': x} FOR x IN [0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]]), 1)['x'] AS nearest
 FROM (SELECT *, CASE WHEN lag(direction) OVER w = 'up' THEN 'up_pullback' ELSE 'down_rebound' END AS kind, lag(span) OVER w AS before, lag(direction) OVER w AS was
       FROM (SELECT *, abs(round(end_price, 3) - round(start_price, 3)) AS span FROM moves_) WINDOW w AS (PARTITION BY symbol ORDER BY ordinal)) WHERE before > 0 AND was <> direction)"""


@query(
    with_ctes(
        "SELECT kind, nearest, n, sum(n) OVER w AS turns, round(sum(total) OVER w / sum(n) OVER w, 3) AS mean_ratio, first(nearest) OVER (PARTITION BY "
        "kind ORDER BY n DESC, nearest) AS commonest "
        "FROM (SELECT kind, nearest, count(*) AS n, sum(ratio) AS total FROM turns_ GROUP BY ALL) WINDOW w AS (PARTITION BY kind)",
        "pivots", "bars_n", recursive=f"{_MOVES}, {_TURNS}",
    ).replace("sum(n) OVER w AS turns", "(sum(n) OVER w)::BIGINT AS turns")
)
def fib_turns(spark, d):
    return pv.fib_turns(pv.legs(_line(spark, d)))


_TRIPLES = """triples AS (SELECT *, CASE WHEN typ = 'L' THEN mid_price / least(left_price, right_price) - 1 ELSE 1 - mid_price / greatest(left_price, right_price) END AS depth, abs(right_price - left_price) / abs(left_price) AS deviation
 FROM (SELECT symbol, typ, idx AS left_idx, price AS left_price, lead(idx) OVER w AS mid_idx, lead(price) OVER w AS mid_price, lead(idx, 2) OVER w AS right_idx, lead(price, 2) OVER w AS right_price, lead(confirm, 2) OVER w AS confirm
       FROM line WINDOW w AS (PARTITION BY symbol ORDER BY ordinal)) WHERE right_idx IS NOT NULL),
 events2 AS (SELECT t.symbol, t.left_idx, t.right_idx, min(b.idx) AS event_idx, arg_min(b.failed, b.idx) AS failed FROM triples t JOIN LATERAL (SELECT idx,
   CASE WHEN t.typ = 'L' THEN low < least(t.left_price, t.right_price) * (1 - 0.03::DOUBLE) ELSE high > greatest(t.left_price, t.right_price) * (1 + 0.03::DOUBLE) END AS failed,
   CASE WHEN t.typ = 'L' THEN close > t.mid_price * (1 + 0.01::DOUBLE) ELSE close < t.mid_price * (1 - 0.01::DOUBLE) END AS broke FROM bars_n n WHERE n.symbol = t.symbol AND n.idx >= t.confirm) b ON true
   WHERE b.failed OR b.broke GROUP BY ALL)"""


@query(
    with_ctes(
        "SELECT t.symbol, CASE WHEN typ = 'L' THEN 'w_bottom' ELSE 'm_top' END AS pattern, t.left_idx, mid_idx, t.right_idx, round(mid_price, 6) AS "
        "neckline, round(deviation, 6) AS deviation, round(depth, 6) AS depth, "
        "round(0.65::DOUBLE * greatest(0, 1 - deviation / 0.10::DOUBLE) + 0.35::DOUBLE * least(1, depth / 0.20::DOUBLE), 6) AS score, "
        "CASE WHEN e.failed THEN 'invalidated' WHEN e.event_idx IS NULL THEN CASE WHEN typ = 'L' THEN 'right_bottom_confirmed' ELSE 'right_top_confirmed' "
        "END WHEN typ = 'L' THEN 'neckline_breakout' ELSE 'neckline_breakdown' END AS status, event_idx "
        "FROM triples t LEFT JOIN events2 e ON e.symbol = t.symbol AND e.left_idx = t.left_idx AND e.right_idx = t.right_idx WHERE deviation <= "
        "0.10::DOUBLE AND depth >= 0.05::DOUBLE",
        "pivots", "bars_n", recursive=f"{_fold(0.04)}, {_TRIPLES}",
    )
)
def double_patterns(spark, d):
    """W and M skeletons with what became of them."""
    found = pv.double_patterns(_line(spark, d), src.bars(spark, d))
    return found.select("symbol", "pattern", "left_idx", "mid_idx", "right_idx", *rounded(["neckline", "deviation", "depth", "score"]), "status", "event_idx")


_SIX = """six AS (SELECT symbol, count(*) AS n, arg_min(typ, back) = 'H' AS up, """ + ", ".join(f"max(price) FILTER (back = {i}) AS p{i}" for i in range(1, 7)) + """ FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ordinal DESC) AS back FROM line) WHERE back <= 6 GROUP BY symbol),
 lengths AS (SELECT *, CASE WHEN up THEN 1 ELSE -1 END AS sg, """ + ", ".join(f"abs(p{i - 1} - p{i}) AS l{i}" for i in range(2, 7)) + " FROM six)"
_IMPULSE = " + ".join(
    f"coalesce({c}, false)::INT"
    for c in (
        "sg * (p3 - p5) > 0 AND sg * (p1 - p3) > 0", "sg * (p4 - p6) > 0 AND sg * (p2 - p4) > 0",
        "l5 / nullif(l6, 0) BETWEEN 0.236::DOUBLE AND 0.786::DOUBLE", "l3 / nullif(l4, 0) BETWEEN 0.236::DOUBLE AND 0.618::DOUBLE", "l4 >= least(l6, l2)",
    )
)
_CORRECTION = "coalesce(l3 / nullif(l4, 0) BETWEEN 0.382::DOUBLE AND 0.786::DOUBLE, false)::INT + coalesce(l2 / nullif(l4, 0) BETWEEN 0.618::DOUBLE AND 1.618::DOUBLE, false)::INT"


@query(
    with_ctes(
        f"SELECT symbol, CASE WHEN n = 6 THEN ({_IMPULSE}) * 20 END AS impulse_score, CASE WHEN n = 6 THEN CASE WHEN up THEN 'up' ELSE 'down' END END AS "
        f"direction, round(CASE WHEN n = 6 THEN l5 / nullif(l6, 0) END, 6) AS wave2, "
        f"round(CASE WHEN n = 6 THEN l3 / nullif(l4, 0) END, 6) AS wave4, CASE WHEN n = 6 THEN sg * (p2 - p5) <= 0 END AS overlap, CASE WHEN n >= 4 THEN "
        f"({_CORRECTION}) * 50 END AS abc_score, CASE WHEN n >= 4 THEN CASE WHEN up THEN 'up' ELSE 'down' END END AS abc_direction FROM lengths",
        "pivots", recursive=f"{_fold(0.04)}, {_SIX}",
    )
)
def wave_scores(spark, d):
    return pv.waves(_line(spark, d)).withColumn("wave2", F.round("wave2", 6)).withColumn("wave4", F.round("wave4", 6))


@query(
    with_ctes(
        "SELECT symbol, p.idx AS from_idx, p.typ AS from_type, round(p.price, 3) AS from_price, CASE WHEN last_close >= p.price THEN 'up' ELSE 'down' END "
        "AS direction, round((last_close / p.price - 1) * 100, 2) AS change_pct, "
        "CASE WHEN p.typ = 'L' THEN 'prior_high' ELSE 'prior_low' END AS level, round(p.before, 3) AS price FROM (SELECT symbol, arg_max(struct_pack(idx "
        ":= idx, typ := typ, price := price, before := before), ordinal) AS p "
        "FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ordinal) AS before FROM line) GROUP BY symbol) JOIN last_ USING (symbol) WHERE "
        "p.before IS NOT NULL "
        "UNION ALL SELECT symbol, p.idx, p.typ, round(p.price, 3), CASE WHEN last_close >= p.price THEN 'up' ELSE 'down' END, round((last_close / p.price "
        "- 1) * 100, 2), CASE WHEN p.typ = 'L' THEN 'retr_' ELSE 'fib_' END || (x * 1000)::INT, "
        "round(p.price + CASE WHEN p.typ = 'L' THEN 1 ELSE -1 END * abs(p.price - p.before) * x, 3) FROM (SELECT symbol, arg_max(struct_pack(idx := idx, "
        "typ := typ, price := price, before := before), ordinal) AS p "
        "FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ordinal) AS before FROM line) GROUP BY symbol) JOIN last_ USING (symbol), (SELECT "
        "unnest([0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]) AS x) "
        "WHERE p.before IS NOT NULL AND (p.typ = 'H' OR x IN (0.382::DOUBLE, 0.5::DOUBLE, 0.618::DOUBLE))",
        "pivots", "bars_n", recursive=_MOVES,
    )
)
def active_leg(spark, d):
    """The open move of each symbol, a row for each level it may react at."""
    found = pv.active_leg(_line(spark, d), src.bars(spark, d)).withColumn("at", F.explode("levels"))
    return found.select("symbol", "from_idx", "from_type", "from_price", "direction", "change_pct", F.col("at.name").alias("level"), F.col("at.price").alias("price"))


@query(with_ctes("SELECT symbol, date, variant, round(score, 6) AS score FROM box", "box"))
def box_breakout_raw(spark, d):
    return _box(spark, d).select("symbol", "date", "variant", F.round("score", 6).alias("score"))


def _signals(spark, d):
    return detectors.with_filters(detectors.detect(ta.factors(src.with_change(src.bars(spark, d)))))


@query(with_ctes("SELECT symbol, date, " + r("entry ret_5 max_gain_5 ret_10 max_gain_10 ret_20 max_gain_20") + " FROM events_", "events_"))
def forward_returns(spark, d):
    return _box_events(spark, d).select("symbol", "date", *rounded("entry ret_5 max_gain_5 ret_10 max_gain_10 ret_20 max_gain_20".split()))


_SUM = [f"{k}_{n}" for n in (5, 10, 20) for k in ("win", "avg", "median")]


@query(with_ctes("SELECT pattern, variant, n, " + r(" ".join(_SUM)) + " FROM (SELECT pattern, variant, count(*) AS "
    "n, " + ", ".join(f"avg((ret_{n} > 0)::INT::DOUBLE) AS win_{n}, avg(ret_{n}) AS avg_{n}, median(ret_{n}) AS median_{n}" for n in (5, 10,
    20)) + " FROM events_ GROUP BY ALL)", "events_"))
def event_summary(spark, d):
    return backtest.event_summary(_box_events(spark, d)).select("pattern", "variant", "n", *rounded(_SUM))


_OVER = "win_5 win_10 win_20 avg_10 median_10 profit_loss avg_max_gain_10"
_OVER_SQL = "count(*) AS n, " + ", ".join(f"avg((ret_{n} > 0)::INT::DOUBLE) AS win_{n}" for n in (5, 10,
    20)) + ", avg(ret_10) AS avg_10, median(ret_10) AS median_10, CASE WHEN count(*) FILTER (ret_10 > 0) >= 2 AND count(*) FILTER (ret_10 <= 0) >= 2 THEN avg(ret_10) FILTER (ret_10 > 0) / nullif(abs(avg(ret_10) FILTER (ret_10 <= 0)), 0) END AS profit_loss, avg(max_gain_10) AS avg_max_gain_10"


@query(with_ctes(f"SELECT pattern, variant, n, {r(_OVER)} FROM (SELECT pattern, variant, {_OVER_SQL} FROM events_ GROUP BY ALL)", "events_"))
def report_overall(spark, d):
    return backtest.overall_report(_box_events(spark, d)).select("pattern", "variant", "n", *rounded(_OVER.split()))


@query(with_ctes(f"SELECT pattern, level, n, {r(_OVER)} FROM (SELECT pattern, level, {_OVER_SQL} FROM (SELECT *, trim(unnest(string_split(hit_levels, "
    f"','))) AS level FROM events_) GROUP BY ALL HAVING count(*) >= 30)", "events_"))
def report_levels(spark, d):
    return backtest.level_report(_box_events(spark, d)).select("pattern", "level", "n", *rounded(_OVER.split()))


@query(with_ctes("SELECT pattern, year(date) AS year, count(*) AS n, round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win_10 FROM events_ WHERE ret_10 IS NOT "
    "NULL GROUP BY ALL", "events_"))
def report_yearly(spark, d):
    return backtest.yearly_report(_box_events(spark, d)).withColumn("win_10", F.round("win_10", 6))


_LONG = "SELECT pattern, date, ret_10, factor, x FROM (UNPIVOT (SELECT pattern, date, ret_10, " + ", ".join(FACTORS) + " FROM events_) ON " + ", ".join(FACTORS) + " INTO NAME factor VALUE x) WHERE x IS NOT NULL"
_QLONG = f"long AS ({_LONG}), edges AS (SELECT pattern, factor, quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]::DOUBLE[]) AS e FROM long GROUP BY ALL HAVING count(x) >= 100 AND count(DISTINCT x) >= 4), bins AS (SELECT pattern, factor, date, ret_10, x, greatest(len(list_filter(list_distinct(e), lambda v: v < x)), 1)::INT AS bin FROM long JOIN edges USING (pattern, factor))"


@query(with_ctes("SELECT pattern, factor, bin, count(*) AS n, round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win_10, round(avg(ret_10), 6) AS avg_10 FROM "
    "bins GROUP BY ALL", "events_", recursive=_QLONG))
def report_factors_qcut(spark, d):
    return backtest.quartile_report(_box_events(spark, d), FACTORS).select("pattern", "factor", "bin", "n", F.round("win_10", 6).alias("win_10"),
        F.round("avg_10", 6).alias("avg_10"))


@query(with_ctes("SELECT CASE WHEN x < 0.2 THEN '<0.2' WHEN x < 0.5 THEN '0.2-0.5' WHEN x < 0.8 THEN '0.5-0.8' ELSE '>=0.8' END AS bin, count(*) AS n, "
    "round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win_10 FROM (SELECT boll_pos AS x, ret_10 FROM fac JOIN fwd USING (symbol, date) WHERE boll_pos IS NOT "
    "NULL AND ret_10 IS NOT NULL) GROUP BY 1 HAVING count(*) > 10".replace("0.2 ", "0.2::DOUBLE ").replace("0.5 ", "0.5::DOUBLE ").replace("0.8 ",
    "0.8::DOUBLE "), "fac", "fwd"))
def fixed_bins(spark, d):
    x = F.col("boll_pos")
    label = F.when(x < lit(0.2), "<0.2").when(x < lit(0.5), "0.2-0.5").when(x < lit(0.8), "0.5-0.8").otherwise(">=0.8")
    joined = _simple(spark, d).select("symbol", "date", "boll_pos").join(backtest.forward(src.bars(spark, d)),
        ["symbol", "date"]).where("boll_pos is not null and ret_10 is not null")
    return joined.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ret_10") > 0).cast("double")), 6).alias("win_10")).where("n > 10")


@query(with_ctes("SELECT ma_bull + (vol_ratio > 1)::INT + (BIAS60 > 0)::INT + (boll_pos > 0.5)::INT + (up_days_ratio_20 >= 0.5)::INT AS good, count(*) AS "
    "n, round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win_10 FROM fac JOIN fwd USING (symbol, date) WHERE BIAS60 IS NOT NULL AND boll_pos IS NOT NULL AND "
    "ret_10 IS NOT NULL GROUP BY 1", "fac", "fwd"))
def factor_count(spark, d):
    """Win rate by how many of five factors are favourable."""
    frame = _simple(spark, d).join(backtest.forward(src.bars(spark, d)).select("symbol", "date", "ret_10"),
        ["symbol", "date"]).where("BIAS60 is not null and boll_pos is not null and ret_10 is not null")
    good = sum((F.expr(c).cast("int") for c in ("vol_ratio > 1", "BIAS60 > 0", "boll_pos > 0.5", "up_days_ratio_20 >= 0.5")), F.col("ma_bull"))
    return frame.groupBy(good.alias("good")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ret_10") > 0).cast("double")), 6).alias("win_10"))


@query(with_ctes("SELECT sector_code, pattern, count(*) AS n, count(DISTINCT symbol) AS symbols, round(avg((ret_10 > 0)::INT::DOUBLE), 6) AS win_10 FROM "
    "events_ JOIN members USING (symbol) WHERE ret_10 IS NOT NULL GROUP BY ALL", "events_", "members"))
def sector_pattern(spark, d):
    joined = _box_events(spark, d).where("ret_10 is not null").join(src.members(spark, d).select("symbol", "sector_code"), "symbol")
    return joined.groupBy("sector_code", "pattern").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"),
        F.round(F.avg((F.col("ret_10") > 0).cast("double")), 6).alias("win_10"))


@query(with_ctes("SELECT ret_10 > 0 AS won, factor, count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS "
    "std, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, round(min(x), 6) AS low, round(max(x), 6) AS high FROM long "
    "WHERE ret_10 IS NOT NULL GROUP BY ALL", "events_", recursive=f"long AS ({_LONG})"))
def winners_losers(spark, d):
    long = _box_events(spark, d).where("ret_10 is not null").select((F.col("ret_10") > 0).alias("won"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in FACTORS])).alias("f")).select("won", "f.factor", "f.x")
    names = ("mean", "median", "std", "p25", "p75", "low", "high")
    return backtest.group_shapes(long, ["won", "factor"]).select("won", "factor", "n", *[F.round(c, 6).alias(c) for c in names])


def _trades(spark, d):
    return backtest.simulate(_box(spark, d), src.with_change(src.bars(spark, d)))


_TRADE_SQL = f"""
WITH x AS (SELECT 1), rows_ AS (SELECT symbol, date, open, high, low, close, change_rate, row_number() {W} AS rn, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS atr
  FROM (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM changed)),
t AS (SELECT b.symbol, b.date AS signal_date, s.rn, e.date AS entry_date, e.open AS entry, least(0.08::DOUBLE * e.open, greatest(2 * s.atr, 0.02::DOUBLE * e.open)) AS risk
  FROM box b JOIN rows_ s USING (symbol, date) JOIN rows_ e ON e.symbol = s.symbol AND e.rn = s.rn + 1 WHERE NOT (e.high = e.low AND coalesce(e.change_rate, 0) >= 9.5)),
p AS (SELECT t.*, entry - risk AS stop, entry + 2 * risk AS target, h.rn AS pos, h.date AS day, h.open AS o, h.high AS h, h.low AS l, h.close AS c, h.change_rate AS ch FROM t JOIN rows_ h ON h.symbol = t.symbol AND h.rn BETWEEN t.rn + 1 AND t.rn + 21),
q AS (SELECT *, l <= stop AND NOT (h = l AND coalesce(ch, 0) <= -9.5) AS s_, h >= target AS t_ FROM p),
f AS (SELECT symbol, signal_date, entry_date, entry, rn, stop, target, min(pos) FILTER (s_ OR t_) AS hit, max(pos) AS last FROM q GROUP BY ALL)
SELECT f.symbol, f.signal_date, f.entry_date, q.day AS exit_date, CASE WHEN f.hit IS NULL THEN 'time_exit' WHEN q.s_ THEN 'stop' ELSE 'target_2r' END AS reason, q.pos - f.rn AS holding_days,
       round(CASE WHEN f.hit IS NULL THEN q.c WHEN q.s_ THEN q.stop ELSE q.target END / f.entry - 1 - 0.0021::DOUBLE, 6) AS net_return
FROM f JOIN q ON q.symbol = f.symbol AND q.signal_date = f.signal_date AND q.pos = coalesce(f.hit, f.last)"""


@query(with_ctes("", "box", "changed").rstrip() + ", " + _TRADE_SQL.strip().removeprefix("WITH x AS (SELECT 1), "))
def trade_sim(spark, d):
    return _trades(spark, d).select("symbol", "signal_date", "entry_date", "exit_date", "reason", "holding_days", F.round("net_return", 6).alias("net_return"))


_ADMIT = """trades_ AS MATERIALIZED (SELECT symbol, signal_date, entry_date, exit_date, net_return, row_number() OVER (ORDER BY entry_date, symbol, signal_date) AS k FROM sold),
taken(k, held, won) AS (SELECT 0::BIGINT, []::STRUCT(s BIGINT, e DATE)[], false UNION ALL
  SELECT k, CASE WHEN ok THEN list_append(live, {'s': symbol, 'e': exit_date}) ELSE live END, ok
  FROM (SELECT *, len(live) < 10 AND NOT list_contains(list_transform(live, lambda x: x.s), symbol) AS ok
        FROM (SELECT t.k, t.symbol, t.exit_date, list_filter(a.held, lambda x: x.e >= t.entry_date) AS live FROM taken a JOIN trades_ t ON t.k = a.k + 1))),
kept_ AS (SELECT t.* FROM trades_ t JOIN taken USING (k) WHERE won),
daily_ AS (SELECT exit_date, sum(net_return) / 10 AS r FROM kept_ GROUP BY exit_date),
curve_ AS (SELECT exit_date, r, exp(sum(ln(1 + r)) OVER (ORDER BY exit_date)) AS equity FROM daily_),
falls_ AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY exit_date), 1) - 1 AS drawdown FROM curve_)"""


_SOLD = _TRADE_SQL.strip().removeprefix("WITH x AS (SELECT 1), ").replace("round(CASE WHEN f.hit IS NULL THEN q.c", "(CASE WHEN f.hit IS NULL THEN q.c").replace(
    "- 0.0021::DOUBLE, 6)", "- 0.0021::DOUBLE)")


@query(with_ctes("""SELECT (SELECT count(*) FROM kept_) AS trades, round(arg_max(equity, exit_date) - 1, 6) AS total_return, round(min(drawdown), 6) AS max_drawdown,
  (SELECT round(avg((net_return > 0)::INT::DOUBLE), 6) FROM kept_) AS win_rate, (SELECT round(avg(net_return), 6) FROM kept_) AS avg_return,
  (SELECT round(avg(net_return) FILTER (net_return > 0) / nullif(abs(avg(net_return) FILTER (net_return <= 0)), 0), 6) FROM kept_) AS payoff,
  round(CASE WHEN count(*) > 1 THEN pow(arg_max(equity, exit_date), 365.25::DOUBLE / greatest(max(exit_date) - min(exit_date), 1)) - 1 END, 6) AS annual_return,
  round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 6) AS sharpe FROM falls_""", "box", "changed", recursive=f"sold AS (WITH {_SOLD}), {_ADMIT}"))
def portfolio(spark, d):
    """One portfolio of ten places over the trades of all patterns."""
    names = ("total_return", "max_drawdown", "win_rate", "avg_return", "payoff", "annual_return", "sharpe")
    return backtest.portfolio(backtest.admit(_trades(spark, d))).select("trades", *[F.round(c, 6).alias(c) for c in names])


@query(with_ctes("SELECT factor, unnest(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]))) AS cut FROM long GROUP "
    "BY factor".replace("SELECT factor, unnest", "SELECT factor, round(cut, 6) AS cut FROM (SELECT factor, unnest") + ")", "events_", recursive=f"long AS ({_LONG})"))
def decile_rules(spark, d):
    rules = optimize.decile_rules(_box_events(spark, d), FACTORS)
    return spark.createDataFrame([(x.field, float(x.value)) for x in rules if x.op == "<="], "factor string, cut double").select("factor", F.round("cut", 6).alias("cut"))


#: The best single rule that the deciles and categories of all events suggest, by win rate.
_DEPTH_ONE = f"""long AS ({_LONG}), cuts AS (SELECT factor, unnest(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]))) AS cut
  FROM long WHERE ret_10 IS NOT NULL GROUP BY factor HAVING count(x) >= 30 AND count(DISTINCT x) >= 3),
tried AS (SELECT factor, op, cut, count(*) AS n, avg((ret_10 > 0)::INT::DOUBLE) AS win FROM long JOIN cuts USING (factor), (VALUES ('<='), ('>=')) o(op)
  WHERE ret_10 IS NOT NULL AND CASE op WHEN '<=' THEN x <= cut ELSE x >= cut END GROUP BY ALL
  UNION ALL SELECT 'variant', '==', NULL, count(*), avg((ret_10 > 0)::INT::DOUBLE) FROM events_ WHERE ret_10 IS NOT NULL GROUP BY variant)"""


@query(with_ctes("SELECT round(win, 6) AS win FROM tried WHERE n >= 20 AND n <= 0.95::DOUBLE * (SELECT count(*) FROM events_ WHERE ret_10 IS NOT NULL) ORDER BY win DESC LIMIT 6",
    "events_", recursive=_DEPTH_ONE))
def beam_front(spark, d):
    """Win rates of the six best single rules: the first step of the beam search."""
    found = optimize.beam_search(_box_events(spark, d), FACTORS, ("variant",), depth=1, least=20)
    return spark.createDataFrame([(float(x.win),) for x in found], "win double").select(F.round("win", 6).alias("win"))


@query()
def beam_search(spark, d):
    """The best rule sets of each pattern before a date, four rules deep, and how they did before it, from it on and in all."""
    events = _box_events(spark, d).where("ret_10 is not null")
    rules = optimize.strict_rules(events, "1998-06-01", ["box_breakout"], FACTORS, ("variant",), least=50)
    told = {p: " and ".join(f"{x.field} {x.op} {x.value}" for x in found) for p, found in rules.items()}
    if not told:
        return spark.createDataFrame([], "name string, part string, n long, win double, avg double, ever_up2 double, avg_max_gain double, rules string")
    name = F.create_map(*[x for kv in told.items() for x in map(F.lit, kv)])
    return optimize.train_test(events, rules, "1998-06-01").withColumn("rules", name[F.col("name")])


@query()
def greedy_filter(spark, d):
    found = optimize.greedy_filter(_box_events(spark, d).where("ret_10 is not null"), FACTORS, least=50)
    return spark.createDataFrame([(f"{x.field} {x.op} {x.value:.4f}", int(n), float(w)) for x, n, w in found], "rule string, n long, win double")


@query()
def market_structure(spark, d):
    return structure.market_structure(src.bars(spark, d))


@query()
def market_structure_compact(spark, d):
    return structure.compact(structure.market_structure(src.bars(spark, d)))


@query()
def confluence(spark, d):
    """Zones where retracement levels of different anchors and long averages meet."""
    zones = pv.fib_zones(pv.anchors(_legs(spark, d)), src.bars(spark, d))
    zones = zones.select("symbol", F.col("level").alias("center"), "lower", "upper", F.lit("fibonacci").alias("family"), F.col("leg_id").alias("dependency"))
    last = screens.latest(ta.moving_averages(src.bars(spark, d)))
    averages = last.select("symbol", F.explode(F.array(*[F.struct(F.lit(f"MA{n}").alias("dependency"), F.col(f"MA{n}").alias("center")) for n in (20, 60,
        120, 250)])).alias("m")).select("symbol", "m.center", F.col("m.center").alias("lower"), F.col("m.center").alias("upper"),
        F.lit("average").alias("family"), "m.dependency").where("center is not null")
    return structure.confluence(zones.unionByName(averages))


_QUERY = [100 * float(np.exp(0.004 * i + 0.03 * np.sin(i / 3))) for i in range(30)]
_SHAPE = similarity.standardise(np.log(np.array(_QUERY))).tolist()


@query(with_ctes(f"SELECT symbol, date, round(exp(-sqrt(list_sum([pow(coalesce((v[i] - m) / nullif(s, 0), 0) - q[i], 2) FOR i IN range(1, 31)]) / 30)), 5) "
    f"AS score FROM (SELECT symbol, date, list(ln(close)) OVER w AS v, avg(ln(close)) OVER w AS m, stddev_pop(ln(close)) OVER w AS s, {_SHAPE}::DOUBLE[] "
    f"AS q FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING)) WHERE len(v) = 30".replace("FOR i IN range(1, 31)",
    "FOR i IN range(1, 31)"), "bars"))
def similarity_coarse(spark, d):
    return similarity.coarse_native(src.bars(spark, d), _QUERY, 30).withColumn("score", F.round("score", 5))


def _query_shape():
    x = np.array(_QUERY)
    return {"close": x, "high": x * 1.01, "low": x * 0.99, "volume": np.full(30, 1000.0)}


def _matches(spark, d):
    frame = src.bars(spark, d)
    found = similarity.rerank(similarity.candidates(frame, np.array(_QUERY), 30), frame, _query_shape(), 30)
    return similarity.without_overlap(found, 30)


@query()
def similarity_rerank(spark, d):
    return _matches(spark, d)


@query()
def outcome_probs(spark, d):
    """What followed the hundred best matches that are left after the full comparison, by likeness."""
    best = screens.top(_matches(spark, d), "likeness", similarity.BEST)
    followed = best.withColumnRenamed("end_date", "date").join(similarity.forward_stats(src.bars(spark, d)), ["symbol", "date"])
    return similarity.probabilities(followed, weight="likeness")


def _series(spark, d):
    """Bars of all symbols in all timeframes, by one key."""
    return structure.timeframes(src.bars(spark, d)).withColumn("series", F.concat_ws(":", "timeframe", "symbol"))


def _cross_matches(spark, d):
    """What moved like the last 30 days of the first symbol, among all others."""
    frame = src.bars(spark, d)
    own = screens.top(frame.where("symbol = 1"), "date", 30).orderBy("date").toPandas()  # one window
    shape = {c: own[c].to_numpy(float) for c in ("close", "high", "low", "volume")}
    return similarity.search(_series(spark, d).where("symbol <> 1"), shape, (20, 30), own["date"].iloc[0])


@query()
def cross_timeframe_matches(spark, d):
    return _cross_matches(spark, d).where("rank <= 10")


@query()
def match_horizons(spark, d):
    """What followed the matches across timeframes, by horizon in bars of their own timeframe."""
    found = _cross_matches(spark, d).select(F.col("series").alias("symbol"), F.col("end_date").alias("date")).collect()  # similarity.BEST rows at most
    symbols = sorted({int(x.symbol.split(":")[1]) for x in found})
    frame = src.daily_bars(src.table(spark, d, "lineitem").where(F.col("l_suppkey").isin(symbols)))  # a symbol's bars rest on its own rows alone
    series = structure.timeframes(frame).withColumn("symbol", F.concat_ws(":", "timeframe", "symbol"))
    followed = spark.createDataFrame(found, "symbol string, date date").join(similarity.forward_stats(series), ["symbol", "date"])
    return similarity.horizon_summary(followed)


@query(
    with_ctes(
        "SELECT symbol, date, round(close / first_close - 1, 6) AS total_return, round(list_min([v[i] / list_max(v[1:i]) - 1 FOR i IN range(1, 31)]), 6) "
        "AS max_drawdown, round(top / bottom - 1, 6) AS price_range "
        "FROM (SELECT symbol, date, close, first(close) OVER w AS first_close, list(close) OVER w AS v, max(high) OVER w AS top, min(low) OVER w AS bottom FROM "
        "bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING)) WHERE len(v) = 30",
        "bars",
    )
)
def shape_metrics(spark, d):
    return similarity.shape_metrics(src.bars(spark, d), 30).select("symbol", "date", *rounded(["total_return", "max_drawdown", "price_range"]))


@query(with_ctes(f"SELECT symbol, date, h AS horizon, round(CASE h WHEN 5 THEN c5 WHEN 10 THEN c10 ELSE c20 END / close - 1, 6) AS ret FROM (SELECT "
    f"symbol, date, close, lead(close, 5) {W} AS c5, lead(close, 10) {W} AS c10, lead(close, 20) {W} AS c20 FROM bars), (SELECT unnest([5, 10, 20]) AS h) "
    f"WHERE CASE h WHEN 5 THEN c5 WHEN 10 THEN c10 ELSE c20 END IS NOT NULL", "bars"))
def forward_stats(spark, d):
    return similarity.forward_stats(src.bars(spark, d)).select("symbol", "date", "horizon", F.round("ret", 6).alias("ret"))


def _sector_change(spark, d):
    return src.members(spark, d).join(src.spot(spark, d).select("symbol", "change_rate"), "symbol").groupBy("sector_code").agg(F.avg("change_rate").alias("change"))


def rising_inputs(spark, d) -> dict:
    """What signals are enriched with: the day, higher timeframes, sectors, nearest levels, and symbols with a retracement."""
    frame = src.bars(spark, d)
    higher = resample.higher_score(resample.period_summary(resample.weekly(frame)), resample.period_summary(resample.monthly(frame)))
    line = pv.zigzag(pv.pivots(frame))
    return {"as_of": frame.agg(F.max("date").alias("as_of")), "higher": higher, "sector_scores": research.sector_scores(src.members(spark, d), _sector_change(spark, d)),
        "levels": levels.nearest_pair(levels.key_levels(frame, line)), "fib": levels.swing_levels(frame, line).where("name is not null")}


@query()
def rising_candidates(spark, d):
    return research.rising_candidates(_signals(spark, d), lookback=60, strict=False, **rising_inputs(spark, d))


@query(with_ctes("SELECT symbol, least(10, 2 * count(*))::DOUBLE AS sector_score FROM members JOIN (SELECT sector_code, avg(change_rate) AS change FROM "
    "members JOIN spot USING (symbol) GROUP BY ALL) USING (sector_code) WHERE change > 0 GROUP BY symbol", "members", "spot"))
def sector_scores(spark, d):
    return research.sector_scores(src.members(spark, d), _sector_change(spark, d))


@query("SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k FROM events")
def parse_props_json(spark, d):
    return src.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a "
    "href=\"([^\"]*)\">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), 1) - 1 AS position "
    "FROM pages) SELECT page_id, href, min(position)::INT AS position, arg_min(label, position) AS label FROM m GROUP BY page_id, href")
def parse_html_links(spark, d):
    return parsers.links(src.table(spark, d, "pages"))


@query(with_ctes(f"SELECT symbol, date, round((close - lag(close) {W}) / nullif(lag(close) {W}, 0) * 100, 4) AS change_rate, round((high - low) / "
    f"nullif(lag(close) {W}, 0) * 100, 4) AS amplitude FROM bars", "bars"))
def normalise_rows_change(spark, d):
    return parsers.with_lagged_change(src.bars(spark, d)).select("symbol", "date", "change_rate", "amplitude")


@query("SELECT s_suppkey AS symbol, CASE WHEN left(c, 1) = '6' THEN 'sh' WHEN left(c, 1) IN ('8', '9') THEN 'bj' ELSE 'sz' END || c AS code FROM (SELECT "
    "s_suppkey, lpad(((s_suppkey * 7919) % 1000000)::VARCHAR, 6, '0') AS c FROM supplier)")
def symbol_normalise(spark, d):
    raw = F.concat(F.lit(" SZ"), F.lpad(((F.col("s_suppkey") * 7919) % 1000000).cast("string"), 6, "0"))
    return src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), parsers.prefixed(raw).alias("code"))


@query(with_ctes("SELECT symbol, date, round(close, 6) AS close, round(volume, 6) AS volume FROM bars", "bars"))
def comma_bar_lines(spark, d):
    """Bars written as provider lines and read back."""
    text = F.concat_ws(",", F.col("date").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("open", "close", "high", "low",
        "volume", "amount")], *[F.lit("-")] * 4)
    return parsers.comma_bars(src.bars(spark, d).select("symbol", text.alias("line"))).select("symbol", F.to_date("date").alias("date"),
        F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"))


@query(with_ctes("SELECT symbol, date, round(close, 6) AS close, CASE WHEN symbol % 2 = 0 THEN 0 ELSE 1 END AS priority FROM bars", "bars"))
def source_fallback(spark, d):
    frame = src.bars(spark, d)
    return parsers.first_available(frame.where("symbol % 2 = 0"), frame).select("symbol", "date", F.round("close", 6).alias("close"), "priority")


@query("SELECT event_type, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, count(*) AS n, round(sum(value), 6) AS total, "
    "max(value) AS peak FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    return windows.tumbling(src.table(spark, d, "events"))


@query("SELECT event_type, s AS start, s + INTERVAL 2 HOUR AS end, count(*) AS n, round(sum(value), 6) AS total, max(value) AS peak FROM (SELECT *, "
    "unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def window_sliding(spark, d):
    return windows.sliding(src.table(spark, d, "events"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS n, round(sum(value), 6) AS total, max(value) AS peak FROM (SELECT "
    "*, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def window_session(spark, d):
    return windows.sessions(src.table(spark, d, "events"))


@query("SELECT symbol, start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, "
    "count(*) AS volume FROM (SELECT user_id % 50 AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS start, * FROM events) GROUP BY symbol, "
    "start".replace("arg_min(value, (ts, event_id))", "arg_min(value, struct_pack(a := ts, b := event_id))").replace("arg_max(value, (ts, event_id))",
    "arg_max(value, struct_pack(a := ts, b := event_id))"))
def intraday_bars(spark, d):
    events = src.table(spark, d, "events").select((F.col("user_id") % 50).alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1).alias("size"))
    return resample.intraday(events, 15).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def alert_events(spark, d):
    """Zone alerts over the event values of each group of users, as the stream would raise them."""
    events = src.table(spark, d, "events")
    updates = events.select(
        (F.col("user_id") % 20).cast("string").alias("zone_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"),
        F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"),
        (F.col("event_id") % 3 != 0).alias("closed"), lit(40).alias("lower"), lit(60).alias("upper"), F.lit(False).alias("invalidated"),
    )
    return alerts.alert_batch(updates)


@query(with_ctes(f"SELECT symbol, date, round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 6) AS ma20, round(close / "
    f"nullif(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 0) - 1, 6) AS away FROM weekly", "weekly"))
def weekly_average(spark, d):
    mean = F.avg("close").over(trailing(20))
    return resample.weekly(src.bars(spark, d)).select("symbol", "date", F.round(mean, 6).alias("ma20"), F.round(ratio(F.col("close"), mean) - 1, 6).alias("away"))


