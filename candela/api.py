"""The engine's calls by name, with checked arguments and one envelope for every answer.

Each call gets the session and the data folder and returns a DataFrame; ``call`` collects it, bounded by ``limit``.
Network download is not part of the engine: what a call would fetch is read from the tables at hand.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import backtest, detectors, levels, pivots, research, resample, screens, similarity, store, structure
from candela.operators import indicators as ta
from candela.sources import bars as src

CALLS: dict[str, Callable[..., DataFrame]] = {}
KINDS = {"int": int, "float": (int, float), "str": str, "bool": bool, "dict": dict, "list": (list, tuple)}
#: Rows an answer carries at most.
MOST_ROWS = 10_000


#: Frames that calls have persisted; ``call`` releases them once it has its answer.
_HELD: list[DataFrame] = []


def _once(frame: DataFrame) -> DataFrame:
    """A frame that several parts of one answer read, computed once; what memory cannot hold goes to disk."""
    _HELD.append(frame.persist())
    return frame


def tool(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    CALLS[function.__name__] = function
    return function


def check(name: str, args: dict[str, Any]) -> None:
    """Raise ValueError for unknown calls, unknown or missing arguments, and wrong types."""
    if name not in CALLS:
        raise ValueError(f"unknown call: {name}")
    known = list(inspect.signature(CALLS[name]).parameters.values())[2:]
    names = {p.name for p in known}
    if extra := set(args) - names:
        raise ValueError(f"unknown arguments: {sorted(extra)}")
    if missing := [p.name for p in known if p.default is p.empty and p.name not in args]:
        raise ValueError(f"missing arguments: {missing}")
    for p in known:
        kind = KINDS.get(str(p.annotation).split(" |")[0].split("[")[0])
        value = args.get(p.name)
        if value is not None and kind and (not isinstance(value, kind) or (kind is not bool and isinstance(value, bool))):
            raise ValueError(f"{p.name} must be {p.annotation}")


def call(spark: SparkSession, sf_dir: str, name: str, limit: int = 1000, **args) -> dict[str, Any]:
    """``{data, meta, warnings, error}``; problems are reported in ``error`` instead of raised."""
    try:
        check(name, args)
        limit = max(0, min(limit, MOST_ROWS))
        rows = [r.asDict(recursive=True) for r in CALLS[name](spark, sf_dir, **args).limit(limit + 1).collect()]
        cut = len(rows) > limit
        return {"data": rows[:limit], "meta": {"call": name, "rows": min(len(rows), limit), "truncated": cut},
            "warnings": [f"only the first {limit} rows"] if cut else [], "error": None}
    except ValueError as error:
        return {"data": None, "meta": {"call": name}, "warnings": [], "error": {"type": "invalid", "message": str(error)}}
    except Exception as error:
        return {"data": None, "meta": {"call": name}, "warnings": [], "error": {"type": type(error).__name__, "message": str(error)[:500]}}
    finally:
        while _HELD:
            _HELD.pop().unpersist()


def _factors(spark, d, symbol=None):
    frame = src.with_change(src.bars(spark, d))
    return ta.factors(frame if symbol is None else frame.where(F.col("symbol") == symbol))


#: Bars of each symbol that a load of some mode keeps; none: all.
MODES = {"quick": 260, "research": 320, "full": 4000}


@tool
def init_full_data(spark, sf_dir, mode: str = "research") -> DataFrame:
    """Coverage of every symbol after a load of its last bars, as many as the mode asks for."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    return store.coverage(store.clip(src.bars(spark, sf_dir), tail=MODES[mode]), min(MODES[mode], 260))


@tool
def update_daily_data(spark, sf_dir, as_of: str) -> DataFrame:
    """Symbols that lack bars up to a date, with the day to fetch from."""
    return store.stale_symbols(store.coverage(src.bars(spark, sf_dir)), as_of)


@tool
def sync_stock_kline_universe(spark, sf_dir, as_of: str, target: int = 320) -> DataFrame:
    covered = store.coverage(src.bars(spark, sf_dir), target)
    return store.stale_symbols(covered, as_of).join(covered.select("symbol", "row_count", "status"), "symbol")


@tool
def get_data_status(spark, sf_dir) -> DataFrame:
    return store.status(src.basics(spark, sf_dir), store.coverage(src.bars(spark, sf_dir)))


@tool
def screen_stocks(spark, sf_dir, conditions: dict | None = None, top_n: int = 20, sort_by: str = "change_rate", sector_code: str | None = None,
    name_keyword: str | None = None) -> DataFrame:
    inside = src.members(spark, sf_dir).where(F.col("sector_code") == sector_code) if sector_code else None
    return screens.screen(src.spot(spark, sf_dir), src.ranks(src.bars(spark, sf_dir)), conditions or {}, sort_by, top_n, inside, name_keyword)


@tool
def get_kline_local_or_net(spark, sf_dir, symbol: int, days: int = 250) -> DataFrame:
    return screens.top(src.bars(spark, sf_dir).where(F.col("symbol") == symbol), "date", days).orderBy("date")


@tool
def get_stock_kline_period(spark, sf_dir, symbol: int, period: str = "weekly", count: int = 0) -> DataFrame:
    """A symbol's bars in a period: daily, weekly, monthly, or minutes (5, 15, 30, 60) of its events; the last ``count`` of them, or all."""
    if period.isdigit() and int(period) in (5, 15, 30, 60):
        events = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1).alias("size"))
        frame, order = resample.intraday(events.where(F.col("symbol") == symbol), int(period)), "start"
    elif period in structure.TIMEFRAMES:
        frame, order = src.bars(spark, sf_dir).where(F.col("symbol") == symbol), "date"
        frame = frame if period == "daily" else {"weekly": resample.weekly, "monthly": resample.monthly}[period](frame)
    else:
        raise ValueError(f"unknown period: {period}")
    return (screens.top(frame, order, count) if count > 0 else frame).orderBy(order)


@tool
def get_rank_trend_data(spark, sf_dir, symbol: int, days: int = 30) -> DataFrame:
    return screens.top(src.ranks(src.bars(spark, sf_dir)).where(F.col("symbol") == symbol), "rank_date", days).orderBy("rank_date")


@tool
def get_sector_list(spark, sf_dir, sector_type: str | None = None) -> DataFrame:
    member = src.members(spark, sf_dir)
    member = member if sector_type is None else member.where(F.col("sector_type") == sector_type)
    return member.groupBy("sector_code", "sector_name", "sector_type").agg(F.count(F.lit(1)).alias("members"))


@tool
def get_stock_belong_sectors(spark, sf_dir, symbol: int) -> DataFrame:
    return src.members(spark, sf_dir).where(F.col("symbol") == symbol)


@tool
def generate_stock_report(spark, sf_dir, symbol: int) -> DataFrame:
    return research.report(research.last_rows(_factors(spark, sf_dir, symbol)), src.spot(spark, sf_dir))


@tool
def scan_patterns(spark, sf_dir, patterns: list | None = None, min_score: float = 0.6, strict: bool = False) -> DataFrame:
    """Signals of the latest trading day."""
    found = detectors.with_filters(detectors.detect(_factors(spark, sf_dir), tuple(patterns or detectors.PATTERNS), min_score))
    last = found.agg(F.max("date").alias("date"))
    found = found.join(F.broadcast(last), "date")
    return found.where("strict_pass") if strict else found


@tool
def scan_sector_patterns(spark, sf_dir, min_score: float = 0.6) -> DataFrame:
    """Signals of sector indices; sectors are numbered in the order of their codes."""
    frame = src.sector_bars(src.bars(spark, sf_dir), src.members(spark, sf_dir))
    codes = frame.select("sector_code").distinct().withColumn("symbol", F.abs(F.xxhash64("sector_code")))
    found = detectors.detect(ta.factors(src.with_change(frame.join(codes, "sector_code").drop("sector_code"))), min_score=min_score)
    return found.join(codes, "symbol").drop("symbol")


@tool
def get_pattern_history(spark, sf_dir, symbol: int) -> DataFrame:
    return detectors.with_filters(detectors.detect(_factors(spark, sf_dir, symbol))).orderBy("date")


@tool
def get_key_levels(spark, sf_dir, symbol: int) -> DataFrame:
    """A symbol's nearest supports and resistances, its structures in each timeframe, and its sectors, a row for each.

    ``section`` tells which a row is; sectors carry how well they agree with the symbol as their value.
    """
    frame = src.bars(spark, sf_dir).where(F.col("symbol") == symbol)
    near = levels.key_levels(frame, pivots.zigzag(pivots.pivots(frame)))
    out = near.select(F.lit("level").alias("section"), "name", "value", "distance_pct", "side", "position", F.col("trend").alias("state"))
    found = structure.compact(structure.multi_timeframe(frame).withColumn("scale", F.concat_ws(":", "timeframe", "scale")))
    label = F.concat_ws(":", "kind", "role")
    shapes = found.select(F.concat(F.lit("structure:"), "scale").alias("section"), label.alias("name"),
        F.coalesce("level", "upper", "end_price").alias("value"), F.lit(None).cast("double").alias("distance_pct"),
        F.lit(None).cast("string").alias("side"), "position", F.col("status").alias("state"))
    sectors = sector_alignment(spark, sf_dir, symbol)
    places = sectors.select(F.lit("sector").alias("section"), F.col("sector_code").alias("name"), F.col("alignment").alias("value"),
        F.lit(None).cast("double").alias("distance_pct"), F.lit(None).cast("string").alias("side"), "position", F.col("label").alias("state"))
    return out.unionByName(shapes).unionByName(places).orderBy("section", "side", "position")


def sector_alignment(spark, sf_dir, symbol: int) -> DataFrame:
    """How a symbol's first six sectors move beside it; no row for a symbol with too few bars for a trend."""
    from candela.plans.reports import sector_inputs

    member, frame = src.members(spark, sf_dir), src.bars(spark, sf_dir)
    near = member.join(member.where(F.col("symbol") == symbol).select("sector_code"), "sector_code", "left_semi")
    mine = frame.where(F.col("symbol") == symbol)
    return research.sector_context(levels.trends(mine, pivots.zigzag(pivots.pivots(mine))), **sector_inputs(spark, sf_dir, near))


@tool
def render_stock_charts(spark, sf_dir, symbol: int, period: str = "daily") -> DataFrame:
    """Candles with overlays, ready to draw; drawing itself is left to the caller."""
    frame = src.bars(spark, sf_dir).where(F.col("symbol") == symbol)
    frame = frame if period == "daily" else get_stock_kline_period(spark, sf_dir, symbol, period).drop("source_date")
    return ta.bollinger(ta.moving_averages(frame)).orderBy("date")


@tool
def screen_rising_candidates(spark, sf_dir, top_n: int = 20, lookback_days: int = 20, patterns: list | None = None, min_score: float = 0.6, strict: bool = True,
    symbols: list | None = None) -> DataFrame:
    """The best recent signals with score, its parts, evidence and sectors."""
    from candela.plans.analysis import rising_inputs

    signals = detectors.with_filters(detectors.detect(_factors(spark, sf_dir), min_score=min_score))
    signals = signals.where(F.col("symbol").isin(list(symbols))) if symbols else signals
    found = research.rising_candidates(signals, lookback=lookback_days, n=top_n, patterns=patterns, strict=strict, **rising_inputs(spark, sf_dir))
    near = src.members(spark, sf_dir).groupBy("symbol").agg(F.slice(F.array_sort(F.collect_list("sector_code")), 1, 10).alias("sectors"))
    return found.join(near, "symbol", "left").orderBy(F.desc("total_score"), F.desc("date"), "symbol")


@tool
def prepare_stock_analysis(spark, sf_dir, symbol: int) -> DataFrame:
    """One row: the report with the symbol's structures as an array."""
    found = structure.compact(structure.market_structure(src.bars(spark, sf_dir).where(F.col("symbol") == symbol)))
    packed = found.groupBy("symbol").agg(F.collect_list(F.struct("scale", "kind", "role", "status", "score", "lower", "upper",
        "level")).alias("structures"))  # a compact snapshot
    return generate_stock_report(spark, sf_dir, symbol).join(packed, "symbol", "left")


@tool
def find_cross_timeframe_similar_patterns(spark, sf_dir, symbol: int, query_period: str = "daily", candidate_periods: list | None = None, query_bars: int = 30,
    candidate_window_bars: list | None = None, top_n: int = 10, min_score: float = 0.55, candidate_scope: str = "market", candidate_symbols: list | None = None,
    search_mode: str = "history") -> DataFrame:
    """Where other symbols, some of them, or this one itself moved like its last bars, in any timeframe and window length."""
    periods = candidate_periods or [query_period]
    if unknown := {query_period, *periods} - set(structure.TIMEFRAMES):
        raise ValueError(f"unknown periods: {sorted(unknown)}")
    if candidate_scope not in ("self", "symbols", "market") or search_mode not in ("history", "latest"):
        raise ValueError("candidate_scope is self, symbols or market; search_mode history or latest")
    windows = tuple(sorted({int(w) for w in candidate_window_bars or [query_bars] if int(w) >= 12}))
    if not windows:
        raise ValueError("candidate_window_bars needs a window of 12 bars or more")
    frame = structure.timeframes(src.bars(spark, sf_dir)).withColumn("series", F.concat_ws(":", "timeframe", "symbol"))
    own = screens.top(frame.where((F.col("symbol") == symbol) & (F.col("timeframe") == query_period)), "date", query_bars).orderBy("date").toPandas()  # one window
    if len(own) < query_bars:
        raise ValueError(f"the query has {len(own)} bars")
    among = F.col("symbol") == symbol if candidate_scope == "self" else (F.col("symbol") != symbol)
    among &= F.col("symbol").isin(list(candidate_symbols or [])) if candidate_scope == "symbols" else F.lit(True)
    shape = {c: own[c].to_numpy(float) for c in ("close", "high", "low", "volume")}
    found = similarity.search(frame.where(among & F.col("timeframe").isin(periods)), shape, windows, own["date"].iloc[0], top_n, min_score, search_mode == "latest")
    return found.where(F.col("rank") <= top_n).orderBy("rank")


@tool
def backtest_pattern_strategy(spark, sf_dir, start: str = "", end: str = "", patterns: list | None = None, mode: str = "both", split: str = "2022-01-01",
    buy_cost_bps: float = 8.0, sell_cost_bps: float = 13.0, min_score: float = 0.6) -> DataFrame:
    """One row: assumptions, number of signals, event summary, portfolio, first trades and candidate factors of a pattern strategy.

    ``mode`` is event, trading or both; what it leaves out is null.
    """
    if mode not in ("event", "trading", "both"):
        raise ValueError("mode must be event, trading or both")
    if unknown := set(patterns or ()) - set(detectors.PATTERNS):
        raise ValueError(f"unknown patterns: {sorted(unknown)}")
    bars = src.with_change(src.bars(spark, sf_dir))
    signals = detectors.detect(_factors(spark, sf_dir), tuple(patterns or detectors.PATTERNS), min_score)
    signals = signals.where(F.col("date") >= F.lit(start).cast("date")) if start else signals
    signals = signals.where(F.col("date") <= F.lit(end).cast("date")) if end else signals
    signals = _once(signals)
    events = backtest.outcomes(signals, bars)
    assumed = F.struct(F.lit("next_open").alias("entry"), F.lit(backtest.HOLD).alias("max_holding_days"), F.lit("2R").alias("target"),
        F.lit("min(2 ATR, 8 %)").alias("fallback_stop"), F.lit(float(buy_cost_bps)).alias("buy_cost_bps"), F.lit(float(sell_cost_bps)).alias("sell_cost_bps"),
        F.lit(10).alias("max_positions"))
    out = signals.agg(F.count(F.lit(1)).alias("signals")).select(F.lit(mode).alias("mode"), F.lit(split).alias("split"), assumed.alias("assumptions"), "signals")

    def packed(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))  # summaries: a row for each group

    if mode != "trading":
        out = out.crossJoin(packed(backtest.event_summary(events), "event_summary"))
    if mode != "event":
        trades = backtest.simulate(signals, bars, buy_cost_bps, sell_cost_bps)
        preview = screens.top(trades, "net_return", 500)
        out = out.crossJoin(backtest.portfolio(backtest.admit(trades)).select(F.struct("*").alias("portfolio"))).crossJoin(packed(preview, "trades_preview"))
    common = backtest.commonality(events, ("score", "vol_ratio", "BIAS60", "RSI14", "resonance", "change_rate"), split)
    return out.crossJoin(packed(common.orderBy(F.desc("candidate"), F.desc("test")), "commonality_candidates"))
