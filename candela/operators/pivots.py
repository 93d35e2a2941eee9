"""Local extremes, zigzags and what follows from them.

Pivots are native window columns.  A zigzag is a fold - whether a pivot counts depends on the one before - so it runs
once per symbol in a grouped map; legs and everything after are native again.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, ratio

#: Ratios that turns are compared with, and the limits of wave checks (fixed values).
TURN_RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
WAVE_2, WAVE_4, WAVE_B, WAVE_C = (0.236, 0.786), (0.236, 0.618), (0.382, 0.786), (0.618, 1.618)
#: An anchor has so many bars and moves by so many average ranges at least; a zone reaches so many average ranges, or a tick.
LEAST_BARS, LEAST_MOVE, ZONE_RANGES, TICK = 3, 1.0, 0.15, 0.01
#: Scale -> (bars left, bars right, least swing).
SCALES = {"fine": (3, 3, 0.02), "medium": (5, 5, 0.04), "coarse": (10, 10, 0.08)}
FIB_RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
PROJECTIONS = (1.0, 1.272, 1.618, 2.0, 2.618)
ZIGZAG = "symbol long, idx int, date date, typ string, price double, confirm int, ordinal int"


class Pivot(NamedTuple):
    idx: int
    typ: str
    price: float
    confirm: int


class Place(NamedTuple):
    """A pivot by its row in a table."""

    row: int
    typ: str
    price: float


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("idx", F.row_number().over(by_symbol()) - 1)


def from_here_on() -> WindowSpec:
    """A symbol's bars from the present one to the last, taken from the last back.

    So a bar adds one row to the frame; a frame that ends with the symbol would be read anew for every bar.
    """
    return Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)


def pivots(bars: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """(symbol, date, idx, typ, price, confirm): highs and lows of their whole neighbourhood, known ``right`` bars later."""
    window = by_symbol().rowsBetween(-left, right)
    seen = numbered(bars).select("symbol", "date", "idx", "high", "low", F.max("high").over(window).alias("hi"), F.min("low").over(window).alias("lo"),
        F.count("high").over(window).alias("n")).where(F.col("n") == left + right + 1)
    found = F.filter(
        F.array(F.struct(F.lit("H").alias("typ"), F.col("high").alias("price"), (F.col("high") == F.col("hi")).alias("yes")),
        F.struct(F.lit("L").alias("typ"), F.col("low").alias("price"), (F.col("low") == F.col("lo")).alias("yes"))),
        lambda p: p["yes"],
    )
    return seen.select("symbol", "date", "idx", F.explode(found).alias("p"), (F.col("idx") + right).alias("confirm")).select("symbol", "date", "idx",
        "p.typ", "p.price", "confirm")


def extend(line: list, pivot, swing: float) -> None:
    """Take a confirmed pivot into a zigzag: the more extreme of two like pivots stays, an opposite one must swing far enough."""
    if not line:
        line.append(pivot)
    elif line[-1].typ == pivot.typ:
        if pivot.price > line[-1].price if pivot.typ == "H" else pivot.price < line[-1].price:
            line[-1] = pivot
    elif line[-1].price > 0 and pivot.price > 0 and abs(pivot.price / line[-1].price - 1) >= swing:
        line.append(pivot)


def _fold(rows: pa.Table, swing: float) -> pa.Table:
    """The rows of the zigzag of one group's pivots, numbered; the rows stay Arrow, only what the fold looks at is unpacked."""
    idx, typ, price, confirm = (rows[c].to_pylist() for c in ("idx", "typ", "price", "confirm"))
    line: list = []
    for i in sorted(range(len(idx)), key=lambda i: (confirm[i], idx[i], typ[i])):
        extend(line, Place(i, typ[i], price[i]), swing)
    kept = rows.take(pa.array([p.row for p in line], pa.int64()))
    return kept.append_column("ordinal", pa.array(range(len(line)), pa.int32())).select([f.split()[0] for f in ZIGZAG.split(", ")])


def zigzag(found: DataFrame, swing: float = 0.03) -> DataFrame:
    """The zigzag of each symbol's pivots as it stands after the last."""

    return found.groupBy("symbol").applyInArrow(lambda rows: _fold(rows, swing), ZIGZAG)


def _mean_range(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """``atr`` of ``with_range`` over one symbol's bars: each frame is added up from its oldest bar, as a window does."""
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    known, total, count = ~np.isnan(tr), np.zeros(len(tr)), np.zeros(len(tr))
    for back in range(min(n, len(tr)) - 1, -1, -1):
        total[back:] += np.where(known, tr, 0.0)[: len(tr) - back]
        count[back:] += known[: len(tr) - back]
    return np.divide(total, count, out=np.full(len(tr), np.nan), where=count > 0)


def scale_line(high: np.ndarray, low: np.ndarray, left: int, right: int, swing: float) -> list[Place]:
    """The zigzag of one scale over one symbol's bars; the places are of its bars."""
    size, line = left + right + 1, []
    if len(high) < size:
        return line
    tops = np.lib.stride_tricks.sliding_window_view(high, size).max(1)  # missing where a high is, so equal to none
    bottoms = np.fmin.reduce(np.lib.stride_tricks.sliding_window_view(low, size), 1)
    middle = slice(left, len(high) - right)
    is_top, is_bottom = high[middle] == tops, ~np.isnan(tops) & (low[middle] == bottoms)
    for i in np.flatnonzero(is_top | is_bottom):
        for yes, typ, edge in ((is_top, "H", high), (is_bottom, "L", low)):
            if yes[i]:
                extend(line, Place(int(i) + left, typ, float(edge[i + left])), swing)
    return line


def _scales(rows: pa.Table) -> pa.Table:
    """The zigzags of all scales of one symbol's bars, in the columns of ``multiscale``."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("date", "ascending")], null_placement="at_start"))
    high, low, close = (rows[c].to_numpy().astype(float) for c in ("high", "low", "close"))
    atr = _mean_range(high, low, close)
    lines = {scale: scale_line(high, low, *how) for scale, how in SCALES.items()}
    at = np.array([p.row for line in lines.values() for p in line], np.int64)
    reach = np.repeat([SCALES[k][1] for k in lines], [len(line) for line in lines.values()])
    rest_low, rest_high = (f.accumulate(close[::-1])[::-1] for f in (np.fmin, np.fmax))
    fields = {
        "symbol": rows["symbol"].take(pa.array(at)), "idx": at, "date": rows["date"].take(pa.array(at)), "typ": [p.typ for line in lines.values() for p in line],
        "price": [p.price for line in lines.values() for p in line], "confirm": at + reach, "ordinal": [i for line in lines.values() for i in range(len(line))],
        "scale": [k for k, line in lines.items() for _ in line], "atr": atr[at], "rest_low": rest_low[at], "rest_high": rest_high[at],
        "last_close": np.full(len(at), close[-1]), "last_atr": np.full(len(at), atr[-1]), "last_idx": np.full(len(at), len(close) - 1),
    }
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    told = [f.split() for f in MULTISCALE.split(", ")]
    return pa.table({n: pa.array(fields[n], kinds[k], from_pandas=True) if k in kinds else fields[n] for n, k in told})


FACTS = "atr double, rest_low double, rest_high double, last_close double, last_atr double, last_idx int"
MULTISCALE = f"{ZIGZAG}, scale string, {FACTS}"


def multiscale(bars: DataFrame) -> DataFrame:
    """Zigzags of all scales, with scale and what later steps want to know of each pivot's bar.

    These facts are the mean true range there, the extremes of the closes from there on, and close, range and number of
    the symbol's last bar; carried along, they spare a join of legs with bars.  One grouped map finds pivots, zigzags and
    facts from a symbol's bars: a frame of many rows costs a window a step a row, and a group a scale a round of Python.
    """
    return bars.select("symbol", "date", "high", "low", "close").groupBy("symbol").applyInArrow(_scales, MULTISCALE)


def with_range(bars: DataFrame) -> DataFrame:
    """Numbered bars with ``atr``, the mean true range of up to 14 bars."""
    w = by_symbol()
    before = F.lag("close").over(w)
    spans = numbered(bars).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return spans.withColumn("atr", F.avg("tr").over(w.rowsBetween(-13, 0))).drop("tr")


def legs(line: DataFrame, bars: DataFrame | None = None, scale: str = "medium", key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Moves between neighbouring pivots: length, size and a stable id; with ``bars`` also the size in average ranges at the end."""
    w = Window.partitionBy(*key).orderBy("ordinal")
    ahead = [F.lead(c).over(w).alias(f"end_{c}") for c in ("idx", "typ", "price", "confirm")]
    ends = line.select("*", *ahead).where("end_idx is not null")
    name = F.format_string("%s:%d:%s:%.8f:%d:%s:%.8f", F.col("scale") if "scale" in key else F.lit(scale), "idx", "typ", "price", "end_idx", "end_typ", "end_price")
    out = ends.select(
        *key, "ordinal", F.col("idx").alias("start_idx"), F.col("price").alias("start_price"), "end_idx", "end_price", F.col("end_confirm").alias("confirm"),
        F.when(F.col("end_price") > F.col("price"), "up").otherwise("down").alias("direction"), (F.col("end_idx") - F.col("idx")).alias("bars"),
        (F.col("end_price") / F.col("price") - lit(1)).alias("pct"), F.concat(F.lit("leg_"), F.substring(F.sha1(name), 1, 16)).alias("leg_id"),
    )
    if bars is None:
        return out.withColumn("atr_move", F.lit(None).cast("double"))
    ranges = with_range(bars).select("symbol", F.col("idx").alias("end_idx"), "atr")
    moved = F.abs(F.col("end_price") - F.col("start_price")) / F.when(F.col("atr") > 0, F.col("atr"))
    return out.join(ranges, ["symbol", "end_idx"], "left").withColumn("atr_move", F.round(moved, 6)).drop("atr").select(*out.columns, "atr_move")


def anchors(moves: DataFrame, n: int = 5, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The n largest legs of each key that are long enough in bars and in average ranges, with the rank 1, 1/2, 1/3, ...

    Largest is by average ranges, or by per cent where these are not known, then by length, recency and id.
    """
    size = F.coalesce("atr_move", F.abs(F.col("pct") * 100))
    w = Window.partitionBy(*key).orderBy(F.desc(size), F.desc("bars"), F.desc("end_idx"), "leg_id")
    eligible = moves.where((F.col("bars") >= LEAST_BARS) & (F.col("atr_move").isNull() | (F.col("atr_move") >= LEAST_MOVE)))
    return eligible.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).withColumn("rank", F.round(lit(1) / F.col("position"), 6))


def latest_range(bars: DataFrame) -> DataFrame:
    """(symbol, last_close, last_atr) at each symbol's last bar."""
    return with_range(bars).groupBy("symbol").agg(F.max_by("close", "idx").alias("last_close"), F.max_by("atr", "idx").alias("last_atr"))


def fib_zones(anchored: DataFrame, bars: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Retracement levels of each anchor with a band of a share of the symbol's present average range."""
    out = anchored.withColumn("ratio", F.explode(F.array(*map(lit, FIB_RATIOS)))).join(latest_range(bars), "symbol")
    level = F.col("end_price") - F.col("ratio") * (F.col("end_price") - F.col("start_price"))
    reach = F.greatest(F.abs("last_atr") * lit(ZONE_RANGES), lit(TICK))
    return out.select(*key, "leg_id", "start_idx", "end_idx", "direction", "ratio", F.round(level, 8).alias("level"),
        F.round(level - reach, 8).alias("lower"), F.round(level + reach, 8).alias("upper"))


def projections(anchored: DataFrame, moves: DataFrame, bars: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Targets of each anchor's move from where the leg after it ended, and how far price has come towards them."""
    after = moves.select(*key, F.col("start_idx").alias("end_idx"), F.col("end_idx").alias("from_idx"), F.col("end_price").alias("from_price"))
    out = anchored.join(after, [*key, "end_idx"]).join(latest_range(bars), "symbol").withColumn("ratio", F.explode(F.array(*map(lit, PROJECTIONS))))
    move = F.col("end_price") - F.col("start_price")
    return out.select(
        *key, "leg_id", "start_idx", "end_idx", "from_idx", "ratio", F.round(F.col("from_price") + F.col("ratio") * move, 8).alias("target"),
        F.round((F.col("last_close") - F.col("from_price")) / move, 8).alias("projection"),
    )


def phase_of(retracement, deepest, position, resume: float = 0.0, over: float = 0.0):
    """Where price stands after a move: ``retracement`` and ``position`` are of the present price, ``deepest`` of the path since."""
    back = deepest > 0
    return (
        F.when(retracement > lit(1 + over), "over_retraced").when(back & (position > lit(1 + resume)), "resumed").when(back & (retracement <= 0),
        "retracement_confirming").when(back, "retracing").otherwise("impulse")
    )


def retracements(anchored: DataFrame, bars: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """How far closes have come back over each anchor since its end, at most and now, and in which phase that puts it.

    The extremes of the closes from a bar on are windows over the bars, so anchors meet them by their end alone.
    """
    rest = from_here_on()
    since = numbered(bars).select("symbol", F.col("idx").alias("end_idx"), F.min("close").over(rest).alias("lo"), F.max("close").over(rest).alias("hi"),
        F.first("close").over(rest).alias("price"))
    move = F.col("end_price") - F.col("start_price")
    extreme = F.when(move > 0, F.col("lo")).otherwise(F.col("hi"))
    out = anchored.join(since, ["symbol", "end_idx"]).select(
        *key, "leg_id", "start_idx", "end_idx", "direction", ((F.col("end_price") - F.col("price")) / move).alias("retracement"),
        ((F.col("price") - F.col("start_price")) / move).alias("position"), ((F.col("end_price") - extreme) / move).alias("deepest"),
    )
    return out.withColumn("phase", phase_of(F.col("retracement"), F.col("deepest"), F.col("position")))


def _nearest(value, ratios=TURN_RATIOS):
    """The ratio closest to a value, the smaller of two that are as close."""
    return F.array_min(F.array(*[F.struct(F.abs(value - lit(x)).alias("d"), lit(x).alias("x")) for x in ratios]))["x"]


def turns(moves: DataFrame) -> DataFrame:
    """Each leg that turns the one before, as a share of it, and the Fibonacci ratio that comes nearest; prices in thousandths."""
    w = Window.partitionBy("symbol").orderBy("ordinal")
    span = F.abs(F.round("end_price", 3) - F.round("start_price", 3))
    seen = moves.select("*", span.alias("span"), F.lag(span).over(w).alias("before"), F.lag("direction").over(w).alias("was")).where("before > 0 and was <> direction")
    ratio = F.col("span") / F.col("before")
    return seen.select("symbol", "ordinal", "end_idx", F.when(F.col("was") == "up", "up_pullback").otherwise("down_rebound").alias("kind"),
        ratio.alias("ratio"), _nearest(ratio).alias("nearest"))


def fib_turns(moves: DataFrame) -> DataFrame:
    """For pullbacks and rebounds, how often each ratio was the nearest; their number, mean and commonest ratio with it."""
    counted = turns(moves).groupBy("kind", "nearest").agg(F.count(F.lit(1)).alias("n"), F.sum("ratio").alias("total"))
    w = Window.partitionBy("kind")
    return counted.select("kind", "nearest", "n", F.sum("n").over(w).alias("turns"), (F.sum("total").over(w) / F.sum("n").over(w)).alias("mean_ratio"),
        F.max(F.struct("n", -F.col("nearest"))).over(w).alias("most")).select(
        "kind", "nearest", "n", "turns", F.round("mean_ratio", 3).alias("mean_ratio"), (-F.col("most.col2")).alias("commonest")
    )


#: W and M skeletons: how far the ends may differ, how deep the middle lies, how far beyond a level price must go (fixed values).
ENDS_APART, LEAST_DEPTH, BREAK, FAILURE, DEEP = 0.10, 0.05, 0.01, 0.03, 0.20


def _first_events(shapes: pa.Table, bars: pa.Table) -> pa.Table:
    """One symbol's skeletons with ``at`` and ``failed``: the first of its bars, from their confirmation on, that decides them."""
    if "_monitor" in shapes.column_names:
        age = pc.subtract(pa.scalar(len(bars) - 1), shapes["confirm"])
        shapes = shapes.filter(pc.less_equal(age, shapes["_monitor"])) if len(bars) else shapes.slice(0, 0)
        shapes = shapes.drop_columns(["_monitor"])
    bars = bars.take(pc.sort_indices(bars, sort_keys=[("date", "ascending")], null_placement="at_start"))
    close, high, low = (bars[c].to_numpy().astype(float) for c in ("close", "high", "low"))
    at, failed = [], []
    for pattern, left, mid, right, confirm in zip(*(shapes[c].to_pylist() for c in ("pattern", "left_price", "mid_price", "right_price", "confirm")), strict=True):
        if pattern == "w_bottom":
            fails, breaks = low[confirm:] < min(left, right) * (1 - FAILURE), close[confirm:] > mid * (1 + BREAK)
        else:
            fails, breaks = high[confirm:] > max(left, right) * (1 + FAILURE), close[confirm:] < mid * (1 - BREAK)
        first = next(iter(np.flatnonzero(fails | breaks).tolist()), None)
        at.append(None if first is None else confirm + first)
        failed.append(None if first is None else bool(fails[first]))
    return shapes.append_column("at", pa.array(at, pa.int32())).append_column("failed", pa.array(failed, pa.bool_()))


def double_patterns(line: DataFrame, bars: DataFrame, key: tuple[str, ...] = ("symbol",), monitor: Column | None = None) -> DataFrame:
    """W and M skeletons: triples of pivots with like ends and a deep middle, and what happens first after them.

    First is a wick beyond both ends (failure) or a close beyond the neckline, from the confirmation on; of one bar the
    wick counts.  Skeletons confirmed more than ``monitor`` bars before the last are left out.  A symbol's few skeletons
    and its bars meet in one grouped map, so no pair of skeleton and bar is made.
    """
    w = Window.partitionBy(*key).orderBy("ordinal")
    t = line.select(
        *key, F.when(F.col("typ") == "L", "w_bottom").otherwise("m_top").alias("pattern"), F.col("idx").alias("left_idx"),
        F.col("price").alias("left_price"), F.lead("idx", 1).over(w).alias("mid_idx"), F.lead("price", 1).over(w).alias("mid_price"),
        F.lead("idx", 2).over(w).alias("right_idx"), F.lead("price", 2).over(w).alias("right_price"), F.lead("confirm", 2).over(w).alias("confirm"),
    ).where("right_idx is not null")
    is_w = F.col("pattern") == "w_bottom"
    apart = F.abs(F.col("right_price") - F.col("left_price")) / F.abs("left_price")
    depth = F.when(is_w, F.col("mid_price") / F.least("left_price", "right_price") - lit(1)).otherwise(lit(1) - F.col("mid_price") / F.greatest("left_price", "right_price"))
    t = t.select("*", apart.alias("deviation"), depth.alias("depth")).where((F.col("deviation") <= lit(ENDS_APART)) & (F.col("depth") >= lit(LEAST_DEPTH)))
    if monitor is not None:
        t = t.withColumn("_monitor", monitor)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema if f.name != "_monitor") + ", at int, failed boolean"
    rows = bars.select("symbol", "date", "close", "high", "low").where("symbol is not null")
    seen = t.groupBy("symbol").cogroup(rows.groupBy("symbol")).applyInArrow(_first_events, schema)
    status = F.when(F.col("at").isNull(), F.when(is_w, "right_bottom_confirmed").otherwise("right_top_confirmed")).when(F.col("failed"),
        "invalidated").otherwise(F.when(is_w, "neckline_breakout").otherwise("neckline_breakdown"))
    score = lit(0.65) * F.greatest(lit(0), lit(1) - F.col("deviation") / lit(ENDS_APART)) + lit(0.35) * F.least(lit(1), F.col("depth") / lit(DEEP))
    return seen.select(*key, "pattern", "left_idx", "mid_idx", "right_idx", F.col("mid_price").alias("neckline"), "deviation", "depth",
        score.alias("score"), status.alias("status"), F.col("at").alias("event_idx"), "left_price", "right_price", "confirm")


def waves(line: DataFrame) -> DataFrame:
    """Each symbol's last six pivots scored as an impulse of five waves, and its last four as a correction, in per cent of checks met.

    Impulse: highs and lows go on in its direction, waves 2 and 4 retrace within their limits, wave 3 is not the
    shortest.  Correction: B retraces, and C compares to A, within theirs.  Too few pivots score null.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("ordinal"))
    last = line.withColumn("back", F.row_number().over(w)).where("back <= 6").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ordinal",
        "price", "typ"))).alias("p"))  # six pivots at most
    n = F.size("p")

    def at(back: int):
        """The price of a pivot, counted from the last."""
        return F.when(n >= back, F.element_at("p", F.greatest(n - back + 1, F.lit(1)))["price"])

    def length(back: int):
        return F.abs(at(back - 1) - at(back))

    def within(value, limits):
        return F.coalesce(value.between(lit(limits[0]), lit(limits[1])), F.lit(False))

    up = F.element_at("p", -1)["typ"] == "H"
    sign = F.when(up, lit(1)).otherwise(lit(-1))
    second, fourth = ratio(length(5), length(6)), ratio(length(3), length(4))
    checks = [
        (sign * (at(3) - at(5)) > 0) & (sign * (at(1) - at(3)) > 0), (sign * (at(4) - at(6)) > 0) & (sign * (at(2) - at(4)) > 0), within(second, WAVE_2),
        within(fourth, WAVE_4), length(4) >= F.least(length(6), length(2)),
    ]
    impulse = sum((c.cast("int") for c in checks), F.lit(0)) * 20
    correction = (within(ratio(length(3), length(4)), WAVE_B).cast("int") + within(ratio(length(2), length(4)), WAVE_C).cast("int")) * 50
    return last.select(
        "symbol", F.when(n == 6, impulse).alias("impulse_score"), F.when(n == 6, F.when(up, "up").otherwise("down")).alias("direction"),
        F.when(n == 6, second).alias("wave2"), F.when(n == 6, fourth).alias("wave4"),
        F.when(n == 6, sign * (at(2) - at(5)) <= 0).alias("overlap"), F.when(n >= 4, correction).alias("abc_score"),
        F.when(n >= 4, F.when(up, "up").otherwise("down")).alias("abc_direction"),
    )


def active_leg(line: DataFrame, bars: DataFrame) -> DataFrame:
    """The move since each symbol's last pivot, and the levels its price may react at, as (name, price) in ascending order."""
    w = Window.partitionBy("symbol").orderBy("ordinal")
    last = line.withColumn("before", F.lag("price").over(w)).groupBy("symbol").agg(F.max_by(F.struct("idx", "typ", "price", "before"),
        "ordinal").alias("p")).select("symbol", "p.*")
    out = last.join(latest_range(bars), "symbol")
    span = F.abs(F.col("price") - F.col("before"))

    def levels(names, sign, known):
        parts = [F.struct(F.round(F.col("price") + sign * span * lit(x), 3).alias("price"),
            F.lit(f"{names}_{int(x * 1000)}").alias("name")) for x in (TURN_RATIOS if names == "fib" else (0.382, 0.5, 0.618))]
        return F.array_sort(F.array(*parts, F.struct(F.round("before", 3).alias("price"), F.lit(known).alias("name"))))

    told = F.when(F.col("typ") == "L", levels("retr", 1, "prior_high")).otherwise(levels("fib", -1, "prior_low"))
    return out.select(
        "symbol", F.col("idx").alias("from_idx"), F.col("typ").alias("from_type"), F.round("price", 3).alias("from_price"),
        F.when(F.col("last_close") >= F.col("price"), "up").otherwise("down").alias("direction"),
        F.round((F.col("last_close") / F.col("price") - lit(1)) * 100, 2).alias("change_pct"), F.when(span > 0, told).alias("levels"),
    )


def analyse(bars: DataFrame, left: int = 5, right: int = 5, swing: float = 0.03) -> DataFrame:
    """One row for each symbol: how many pivots its zigzag has, its wave scores, its open leg and its last close."""
    line = zigzag(pivots(bars, left, right), swing)
    counted = line.groupBy("symbol").agg(F.count(F.lit(1)).alias("pivot_count"))
    open_leg = active_leg(line, bars).withColumnRenamed("direction", "leg_direction")
    return counted.join(waves(line), "symbol").join(open_leg, "symbol").join(latest_range(bars), "symbol")
