"""What happened after signals: forward returns, grouped reports, trade simulation and portfolios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, ratio

HORIZONS = (5, 10, 20)
STOP_MOST, STOP_LEAST, STOP_ATR, REWARD, HOLD = 0.08, 0.02, 2.0, 2.0, 20
BUY_BPS, SELL_BPS = 8, 13


def forward(bars: DataFrame) -> DataFrame:
    """Each bar with the next open as entry, and return and best gain over each horizon from there."""
    w, entry = by_symbol(), F.col("entry")
    out = bars.select("symbol", "date", "high", "close", F.lead("open", 1).over(w).alias("entry"))
    cols = []
    for n in HORIZONS:
        window = w.rowsBetween(1, 1 + n)
        later = F.lead("close", 1 + n).over(w)
        cols += [(ratio(later, entry) - lit(1)).alias(f"ret_{n}"), F.when(later.isNotNull(), ratio(F.max("high").over(window), entry) - lit(1)).alias(f"max_gain_{n}")]
    return out.select("symbol", "date", "entry", *cols)


def outcomes(signals: DataFrame, bars: DataFrame) -> DataFrame:
    return signals.join(forward(bars), ["symbol", "date"])


def _win(column: str):
    return F.avg((F.col(column) > 0).cast("double"))


def event_summary(events: DataFrame, keys: tuple[str, ...] = ("pattern", "variant")) -> DataFrame:
    """Count, win rate, mean and median by group and horizon; missing keys are groups of their own."""
    aggregates = [x for n in HORIZONS for x in (_win(f"ret_{n}").alias(f"win_{n}"), F.avg(f"ret_{n}").alias(f"avg_{n}"))]
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return _meet(counts, medians(events, keys, {f"median_{n}": f"ret_{n}" for n in HORIZONS}), list(keys), "left")


def overall_report(events: DataFrame, keys: tuple[str, ...] = ("pattern", "variant"), least: int = 1) -> DataFrame:
    """Win rates, mean, median, profit-loss ratio (two gains and two losses at least) and mean best gain."""
    r = F.col("ret_10")
    gains, losses = F.avg(F.when(r > 0, r)), F.avg(F.when(r <= 0, r))
    enough = (F.count_if(r > 0) >= 2) & (F.count_if(r <= 0) >= 2)
    out = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[_win(f"ret_{n}").alias(f"win_{n}") for n in HORIZONS], F.avg("ret_10").alias("avg_10"),
        F.when(enough, ratio(gains, F.abs(losses))).alias("profit_loss"), F.avg("max_gain_10").alias("avg_max_gain_10"),
    )
    return _meet(out.where(F.col("n") >= least), medians(events, keys, {"median_10": "ret_10"}), list(keys), "left")


def level_report(events: DataFrame, least: int = 30) -> DataFrame:
    exploded = events.withColumn("level", F.explode(F.split("hit_levels", ","))).withColumn("level", F.trim("level"))
    return overall_report(exploded.where("level <> ''"), ("pattern", "level"), least)


def yearly_report(events: DataFrame) -> DataFrame:
    return events.where("ret_10 is not null").groupBy("pattern", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), _win("ret_10").alias("win_10"))


def factor_values(events: DataFrame, factors: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, factor, x): a row for each value of each factor."""
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])
    return events.select(*keys, F.explode(each).alias("f")).select(*keys, "f.factor", "f.x").where("x is not null")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The rows of ``left`` with what ``right`` has besides the keys; missing keys are keys like others."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


#: Ranges that a group's different values are cut into; only those that hold a wanted rank are put in order.
RANGES = 64
#: About so many of a group's different values are drawn, by their hash, to place the cuts.
DRAWN = 4096


def cut_points(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _cuts, n, kinds): values that cut each group of different values x, met _c times, into ``RANGES`` ranges of about equal numbers.

    The cuts depend on the values alone.  Spark may work them out more than once, in an order of rows that varies from run
    to run, and ranks are only found where all agree; those of an approximate sketch do not.
    """
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("kinds"))
    place = F.shiftrightunsigned(F.xxhash64("x"), 11).cast("double") / lit(1 << 53)
    drawn = _meet(counted, F.broadcast(sizes), keys).where(place < lit(DRAWN) / F.col("kinds"))
    told = drawn.groupBy(*keys, "n", "kinds").agg(F.array_sort(F.collect_list("x")).alias("_drawn"))
    at = [F.floor(F.size("_drawn") * lit(i / RANGES)).cast("int") for i in range(1, RANGES)]
    return told.select(*keys, F.array(*[F.col("_drawn")[i] for i in at]).alias("_cuts"), "n", "kinds")


def quantiles(values: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, kinds, quantiles): exact quantiles of x between its ranks, with the number of values and of different ones.

    Found by selection: equal values are counted, a bounded number of them cuts each group into ranges, counts say which
    ranges hold the wanted ranks, and those alone are put in order, each by itself.  So no task sorts or holds a group,
    and a value that most rows share is one row.  Groups without values give no row.
    """
    counted = values.where("x is not null").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_c"))
    cuts = F.broadcast(cut_points(counted, keys))  # a row a group, of which a report has few
    ranged = _meet(counted, cuts, keys).select(*keys, "x", "_c", "n", "kinds", F.size(F.filter("_cuts", lambda e: e < F.col("x"))).alias("_range"))
    along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_held"), F.first("n").alias("n")).withColumn("_before", F.coalesce(F.sum("_held").over(along), F.lit(0)))
    places = []
    for i, share in enumerate(shares):
        at = lit(share) * (F.col("n") - 1)
        part = at - F.floor(at)
        places += [F.struct(F.lit(i).alias("i"), rank(at).alias("at"), part.alias("part")) for rank in (F.floor, F.ceil)]
    inside = F.filter(F.array(*places), lambda p: (p["at"] >= F.col("_before")) & (p["at"] < F.col("_before") + F.col("_held")))
    wanted = totals.select(*keys, "_range", "_before", inside.alias("_places")).where(F.size("_places") > 0)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ordered = _meet(ranged, F.broadcast(wanted), [*keys, "_range"]).withColumn("_upto", upto)
    found = ordered.select(*keys, "n", "kinds", "x", F.explode(F.filter("_places", lambda p: (p["at"] >= F.col("_upto") - F.col("_c")) & (p["at"] < F.col("_upto")))).alias("_p"))
    each = found.groupBy(*keys, "_p.i").agg(F.first("n").alias("n"), F.first("kinds").alias("kinds"), (F.min("x") + (F.max("x") - F.min("x")) * F.first("_p.part")).alias("q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"])  # one for each share
    return each.groupBy(*keys).agg(F.first("n").alias("n"), F.first("kinds").alias("kinds"), listed.alias("quantiles"))


def medians(events: DataFrame, keys: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """(keys, names): exact medians of columns, name -> column, from one selection."""
    found = quantiles(factor_values(events, tuple(columns.values()), keys), [*keys, "factor"], [0.5])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("factor") == c, F.col("quantiles")[0])).alias(name) for name, c in columns.items()])


def quantile_edges(events: DataFrame, factors: tuple[str, ...], keys: tuple[str, ...] = ("pattern",), parts: int = 4) -> DataFrame:
    """(keys, factor, edges): distinct quantile edges of each factor where it has 100 values and 4 distinct ones."""
    found = quantiles(factor_values(events, factors, keys), [*keys, "factor"], [i / parts for i in range(parts + 1)])
    return found.where("n >= 100 and kinds >= 4").select(*keys, "factor", F.array_distinct("quantiles").alias("edges"))


def quartile_report(events: DataFrame, factors: tuple[str, ...], keys: tuple[str, ...] = ("pattern",)) -> DataFrame:
    """Outcomes by quantile of each factor: right-closed bins, the lowest edge included."""
    edges = quantile_edges(events, factors, keys)
    long = events.select(*keys, "ret_10", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"),
        F.col(f).cast("double").alias("x")) for f in factors])).alias("f")).select(*keys, "ret_10", "f.factor", "f.x").where("x is not null")
    binned = long.join(edges, [*keys, "factor"]).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col("x"))), F.lit(1)))
    return binned.groupBy(*keys, "factor", "bin").agg(F.count(F.lit(1)).alias("n"), _win("ret_10").alias("win_10"), F.avg("ret_10").alias("avg_10"),
        F.min("x").alias("low"), F.max("x").alias("high"))


def commonality(events: DataFrame, factors: tuple[str, ...], split: str, keys: tuple[str, ...] = (), least: tuple[int, int] = (50, 20)) -> DataFrame:
    """Win rates by quantile, of all patterns together unless ``keys`` say otherwise, before and from a date on, where both have enough events, their gap, and which quantiles deserve review."""
    edges = quantile_edges(events, factors, keys)
    long = events.select(*keys, "date", "ret_10", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"),
        F.col(f).cast("double").alias("x")) for f in factors])).alias("f")).select(*keys, "date", "ret_10", "f.factor",
        "f.x").where("x is not null and ret_10 is not null")
    binned = long.join(edges, [*keys, "factor"]).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col("x"))), F.lit(1)))
    won, late = (F.col("ret_10") > 0).cast("double"), F.col("date") >= F.lit(split).cast("date")
    out = binned.groupBy(*keys, "factor", "bin").agg(F.count_if(~late).alias("n_train"), F.count_if(late).alias("n_test"),
        F.avg(F.when(~late, won)).alias("train"), F.avg(F.when(late, won)).alias("test"))
    out = out.where((F.col("n_train") >= least[0]) & (F.col("n_test") >= least[1])).withColumn("gap", F.abs(F.col("test") - F.col("train")))
    return out.withColumn("candidate", (F.col("gap") <= lit(0.10)) & (F.col("test") > lit(0.5)))


def simulate(signals: DataFrame, bars_with_change: DataFrame, buy_bps: float = BUY_BPS, sell_bps: float = SELL_BPS) -> DataFrame:
    """One trade for each signal: bought at the next open, sold at the stop, at twice the risk, or after 20 bars.

    The stop comes first on a bar that touches both; a bar locked at its lower limit cannot be sold, one locked at the
    upper limit cannot be bought.  Exits are at the stop or the target itself, also where a bar opens beyond it.  Costs
    are taken off the return.  Each trade meets the bars of its holding period by their numbers.
    """
    w = by_symbol()
    before = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = bars_with_change.select("symbol", "date", "open", "high", "low", "close", "change_rate", (F.row_number().over(w)).alias("rn"), tr.alias("tr"))
    rows = rows.withColumn("atr", F.avg("tr").over(w.rowsBetween(-13, 0)))
    start = signals.select("symbol", "date", "pattern").join(rows.select("symbol", "date", "rn", "atr"), ["symbol", "date"])
    entry = rows.select("symbol", (F.col("rn") - 1).alias("rn"), F.col("date").alias("entry_date"), F.col("open").alias("entry"),
        ((F.col("high") == F.col("low")) & (F.coalesce("change_rate", lit(0)) >= 9.5)).alias("locked"))
    trades = start.join(entry, ["symbol", "rn"]).where("not locked")
    risk = F.least(lit(STOP_MOST) * F.col("entry"), F.greatest(lit(STOP_ATR) * F.col("atr"), lit(STOP_LEAST) * F.col("entry")))
    trades = trades.withColumn("stop", F.col("entry") - risk).withColumn("target", F.col("entry") + lit(REWARD) * risk)
    held = rows.select("symbol", F.col("rn").alias("at"), F.col("date").alias("day"), "high", "low", "close", "change_rate")
    path = trades.withColumn("at", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + 1 + HOLD))).join(held, ["symbol", "at"])
    sealed = (F.col("high") == F.col("low")) & (F.coalesce("change_rate", lit(0)) <= -9.5)
    stopped = (F.col("low") <= F.col("stop")) & ~sealed
    reached = F.col("high") >= F.col("target")
    hit = F.when(stopped, F.struct(F.lit("stop").alias("reason"), F.col("stop").alias("exit"), "day", "at")).when(reached,
        F.struct(F.lit("target_2r").alias("reason"), F.col("target").alias("exit"), "day", "at"))
    last = F.struct(F.lit("time_exit").alias("reason"), F.col("close").alias("exit"), "day", "at")
    done = path.withColumn("hit", hit).withColumn("last", last).groupBy("symbol", "pattern", "date", "entry_date", "entry", "stop", "target",
        "rn").agg(F.coalesce(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("at"))), F.max_by("last", "at")).alias("x"))
    gross = F.col("x.exit") / F.col("entry") - lit(1)
    return done.select("symbol", "pattern", F.col("date").alias("signal_date"), "entry_date", F.col("x.day").alias("exit_date"), "entry", "stop", "target",
        F.col("x.exit").alias("exit"), F.col("x.reason").alias("reason"), (F.col("x.at") - F.col("rn")).alias("holding_days"),
        (gross - lit((buy_bps + sell_bps) / 1e4)).alias("net_return"))


def admit(trades: DataFrame, most: int = 10) -> DataFrame:
    """Trades that one portfolio of ``most`` positions takes, by entry and symbol, never two of one symbol at once.

    Whether a trade fits depends on those still held, so trades are folded in order.  On a day at most ``most`` symbols are
    held and at most ``most`` can be taken, and of a symbol only the first trade of the day counts; so the first
    2 * ``most`` symbols of each day decide, and the fold sees no more than these, whatever the number of trades.
    """
    first = Window.partitionBy("entry_date", "symbol").orderBy("pattern", "exit_date")
    place = Window.partitionBy("entry_date").orderBy("symbol")
    decisive = trades.withColumn("_first", F.row_number().over(first)).where("_first = 1").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= 2 * most)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["entry_date", "symbol"], ignore_index=True)
        held: dict = {}
        kept = []
        for i, row in enumerate(rows.itertuples(index=False)):
            held = {s: end for s, end in held.items() if end >= row.entry_date}
            if len(held) < most and row.symbol not in held:
                held[row.symbol] = row.exit_date
                kept.append(i)
        return rows.iloc[kept]

    return decisive.drop("_first", "_place").groupBy().applyInPandas(run, trades.schema)


def portfolio(accepted: DataFrame, most: int = 10) -> DataFrame:
    """Return, drawdown and quality of the accepted trades, gains booked on the exit day at equal weights; one row, without trades one of zeros.

    Its windows run over exit days, whose number does not grow with the trades.
    """
    daily = accepted.groupBy("exit_date").agg((F.sum("net_return") / lit(most)).alias("r"))
    w = Window.orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(w)))
    curve = curve.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(w), lit(1)) - lit(1))
    shape = curve.agg(F.coalesce(F.max_by("equity", "exit_date"), lit(1)).alias("final"), F.coalesce(F.min("drawdown"), lit(0)).alias("max_drawdown"),
        (ratio(F.avg("r"), F.stddev_samp("r")) * F.sqrt(lit(252))).alias("sharpe"), F.datediff(F.max("exit_date"), F.min("exit_date")).alias("days"),
        F.count(F.lit(1)).alias("exits"))
    r = F.col("net_return")
    trade = accepted.agg(F.count(F.lit(1)).alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_return"),
        ratio(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r <= 0, r)))).alias("payoff"))
    return shape.crossJoin(trade).select("trades", (F.col("final") - lit(1)).alias("total_return"),  # one row each
        F.when(F.col("exits") > 1, F.pow("final", lit(365.25) / F.greatest("days", F.lit(1))) - lit(1)).alias("annual_return"), "max_drawdown", "sharpe",
        "win_rate", "avg_return", "payoff")


def wave_report(events: DataFrame, least: int = 30) -> DataFrame:
    """Outcomes by pattern and wave phase, where a group has enough events."""
    return overall_report(events, ("pattern", "wave_phase"), least)


def cohort(events: DataFrame, keys: tuple[str, ...], least: int = 1) -> DataFrame:
    """Events with an outcome by group: count, symbols, win rates in per cent, mean returns and best gains, mean score."""
    out = events.where("ret_5 is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), *[(_win(f"ret_{n}") * 100).alias(f"win_rate_{n}") for n in HORIZONS],
        *[F.avg(f"ret_{n}").alias(f"avg_ret_{n}") for n in HORIZONS], *[F.avg(f"max_gain_{n}").alias(f"avg_max_gain_{n}") for n in HORIZONS],
        F.avg("score").alias("avg_score"),
    )
    return out.where(F.col("n") >= least)


def score_distribution(events: DataFrame) -> DataFrame:
    """Count, mean, median and range of each pattern's scores."""
    scored = events.where("score is not null")
    each = {"mean": F.avg("score"), "high": F.max("score"), "low": F.min("score")}
    out = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in each.items()])
    return _meet(out, medians(scored, ("pattern",), {"median": "score"}), ["pattern"], "left")


def group_shapes(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, median, std, p25, p75, low, high) of x in each group."""
    out = values.where("x is not null").groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"),
        F.max("x").alias("high"))
    at = quantiles(values, keys, [0.25, 0.5, 0.75]).select(*keys, *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))])
    return _meet(out, at, keys, "left")


def yearly_returns(events: DataFrame, least: int = 30) -> DataFrame:
    """Count, win rate and mean return of each pattern and year with enough events."""
    out = events.groupBy("pattern", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), (_win("ret_10") * 100).alias("win_rate_10"),
        (F.avg("ret_10") * 100).alias("avg_ret_10"))
    return out.where(F.col("n") >= least)


def wave_phase(bars: DataFrame, found: DataFrame, lookback: int = 250) -> DataFrame:
    """(symbol, date, wave_phase) of each bar: near its highest close, else by how many pivots of type H were known and recent.

    ``found`` are pivots; one counts from the bar that confirms it until it is older than ``lookback`` bars.
    """
    w = by_symbol()
    numbered = bars.select("symbol", "date", "close", (F.row_number().over(w) - 1).alias("idx"))
    highs = found.where("typ = 'H'")
    steps = highs.select("symbol", F.col("confirm").alias("idx"), F.lit(1).alias("step")).unionByName(highs.select("symbol",
        (F.col("idx") + lookback + 1).alias("idx"), F.lit(-1).alias("step"))).groupBy("symbol", "idx").agg(F.sum("step").alias("step"))
    counted = numbered.join(steps, ["symbol", "idx"], "left").withColumn("highs",
        F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    top = F.max("close").over(Window.partitionBy("symbol").orderBy("idx").rowsBetween(-lookback, 0))
    phase = F.when(F.col("close") >= lit(0.995) * F.col("top"), "breakout_new_high").when(F.col("highs") == 1, "first_pullback").when(F.col("highs") == 2,
        "second_pullback").otherwise("later_pullback")
    return counted.withColumn("top", top).select("symbol", "date", phase.alias("wave_phase"))
