"""Trend lines, channels, ranges and confluence of one symbol's pivots; one grouped map yields all of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.series import lit
from candela.operators.detectors import local_extremes
from candela.operators.pivots import SCALES, Pivot, extend, with_range

POINTS, LINES, SEPARATION, SPAN, EXTENSION = 48, 8, 3, 120, 120
#: Bars that a line looks at together.
AHEAD = 32
SCHEMA = (
    "symbol long, scale string, kind string, id string, role string, status string, start_idx int, end_idx int, start_price double, end_price double, "
    "slope double, lower double, upper double, "
    "confirm_idx int, broken_idx int, touches array<int>, level double, valid_until int, score double, baseline string, construction string, source_line string"
)


def name(kind: str, *parts) -> str:
    """A stable id from what makes a structure what it is; prices with eight digits."""
    return kind + hashlib.sha1(":".join(f"{p:.8f}" if isinstance(p, float) else str(p) for p in parts).encode()).hexdigest()[:16]


def average_range(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Mean true range of up to n bars."""
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    sums = np.concatenate([[0.0], np.cumsum(tr)])
    i = np.arange(len(tr)) + 1
    first = np.maximum(i - n, 0)
    return (sums[i] - sums[first]) / (i - first)


def _broken(start: np.ndarray, price: np.ndarray, slope: np.ndarray, side: float, edge: np.ndarray, atr: np.ndarray) -> np.ndarray:
    """The first bar after its start that pierces each line by half a range, or -1.

    Most lines are pierced soon, so each looks at some bars at a time from its start on, and only those left look further.
    """
    out, left, since = np.full(len(start), -1), np.arange(len(start)), 1
    while len(left := left[start[left] + since < len(edge)]):
        bars = start[left][:, None] + np.arange(since, since + AHEAD)[None, :]
        inside = np.minimum(bars, len(edge) - 1)
        line = price[left][:, None] + slope[left][:, None] * (bars - start[left][:, None])
        pierced = (side * (edge[inside] - line) < -0.5 * atr[inside]) & (bars < len(edge))
        met = pierced.any(1)
        out[left[met]] = (start[left] + since + pierced.argmax(1))[met]
        left, since = left[~met], since + AHEAD
    return out


def trend_lines(found: list[Pivot], high: np.ndarray, low: np.ndarray, atr: np.ndarray, scale: str) -> list[dict]:
    """Rising lines under lows and falling lines over highs through two pivots, confirmed by a third touch.

    The first bar that pierces a line by half a range breaks it, wherever on the line it is.  A confirmed line that has
    run past its span counts as the level it reached.  All lines of one role are judged together, and only the best are
    written out.
    """
    end, out = len(high) - 1, []
    for typ, role, side, edge in (("L", "support", 1.0, low), ("H", "resistance", -1.0, high)):
        points = [p for p in found if p.typ == typ][-POINTS:]
        if len(points) < 2:
            continue
        idx, price = np.array([p.idx for p in points]), np.array([p.price for p in points])
        a, b = np.triu_indices(len(points), 1)
        span = idx[b] - idx[a]
        slope = (price[b] - price[a]) / np.maximum(span, 1)
        sound = (span >= SEPARATION) & (slope * side > 0)
        a, b, span, slope = a[sound], b[sound], span[sound], slope[sound]
        at = price[a][:, None] + slope[:, None] * (idx[None, :] - idx[a][:, None])
        near = np.abs(price[None, :] - at) <= np.maximum(0.35 * atr[idx][None, :], np.abs(at) * 0.002)
        near &= idx[None, :] > idx[b][:, None]
        broken = _broken(idx[a], price[a], slope, side, edge, atr)
        took, confirm = np.zeros(near.shape, bool), np.full(len(a), -1)
        last, count = idx[b].copy(), np.full(len(a), 2)
        for k, p in enumerate(points):
            took[:, k] = near[:, k] & (p.idx - last >= SEPARATION)
            last = np.where(took[:, k], p.idx, last)
            confirm = np.where(took[:, k] & (count == 2), p.confirm, confirm)
            count += took[:, k]
        until = idx[b] + np.maximum(20, np.minimum(EXTENSION, span))
        sure = (broken < 0) & (confirm >= 0)
        passed = sure & ((span > SPAN) | (end > until))
        scores = [round(min(1.0, 0.45 + 0.15 * (n - 2) + min(0.25, s / 200)), 4) for n, s in zip(count.tolist(), span.tolist(), strict=True)]
        place = np.lexsort((-idx[b], -np.array(scores), broken >= 0, ~(sure & ~passed)))
        lines = []
        for i in [int(i) for kind in (~passed, passed) for i in place[kind[place]][:LINES]]:
            one, two = points[a[i]], points[b[i]]
            status = "broken" if broken[i] >= 0 else "converted" if passed[i] else "confirmed" if sure[i] else "candidate"
            level = round(two.price if span[i] > SPAN else one.price + float(slope[i]) * (int(until[i]) - one.idx), 6) if passed[i] else None
            lines.append({"kind": "horizontal_level" if passed[i] else "trendline", "role": role, "status": status, "start_idx": one.idx, "end_idx": two.idx,
                "start_price": one.price, "end_price": two.price, "slope": float(slope[i]), "confirm_idx": int(confirm[i]) if confirm[i] >= 0 else None,
                "broken_idx": int(broken[i]) if broken[i] >= 0 else None, "touches": [one.idx, two.idx, *idx[took[i]].tolist()], "level": level,
                "valid_until": int(until[i]), "score": scores[i], "id": name("line_", scale, role, one.idx, one.price, two.idx, two.price)})
        out += lines
    return sorted(out, key=_order)


def _order(x: dict) -> tuple:
    """Confirmed lines first, broken ones last, then by score and recency."""
    return x["status"] != "confirmed", x["status"] == "broken", -x["score"], -x["end_idx"]


def channels(lines: list[dict], found: list[Pivot], high: np.ndarray, low: np.ndarray, atr: np.ndarray) -> list[dict]:
    """A parallel through the most extreme opposite pivot of each confirmed line; two touches of both sides confirm it.

    Where a confirmed line of the other role runs along the parallel, the channel is built of two independent lines, and
    it names the second; else its second side is the first one moved.
    """
    out, end = [], len(high) - 1
    confirmed = [x for x in lines if x["status"] == "confirmed" and x["kind"] == "trendline"]
    for line in confirmed:
        support, slope = line["role"] == "support", line["slope"]
        base = line["start_price"] - slope * line["start_idx"]
        inside = [p for p in found if p.idx >= line["start_idx"]]
        offsets = [(p.price - (base + slope * p.idx), p) for p in inside if (p.typ == "H") == support]
        offsets = [(o, p) for o, p in offsets if (o > 0) == support and o != 0]
        if not offsets:
            continue
        offset, edge = (max if support else min)(offsets, key=lambda x: x[0])
        lower, upper = sorted((base, base + offset))

        def touches(typ, intercept):
            return sorted({p.idx for p in inside if p.typ == typ and abs(p.price - (intercept + slope * p.idx)) <= max(0.45 * atr[p.idx], p.price * 0.002)})  # noqa: B023

        below, above = touches("L", lower), touches("H", upper)
        confirm = max(below[1], above[1]) if len(below) > 1 and len(above) > 1 else None
        bars = np.arange(confirm or edge.confirm, end + 1)
        gone = np.flatnonzero((low[bars] < lower + slope * bars - 0.6 * atr[bars]) | (high[bars] > upper + slope * bars + 0.6 * atr[bars]))
        broken = int(bars[gone[0]]) if len(gone) else None
        status = "broken" if broken is not None else "confirmed" if confirm is not None else "candidate"
        other = base + offset
        second = next((x for x in confirmed if x["role"] != line["role"] and abs(x["slope"] - slope) <= max(atr[end] * 0.01, abs(slope) * 0.15)
            and abs(x["start_price"] - x["slope"] * x["start_idx"] - other) <= max(atr[end] * 0.45, abs(other) * 0.002)), None)
        out.append({"kind": "channel", "id": name("channel_", line["id"], edge.idx), "role": "up" if slope > 0 else "down", "status": status,
            "start_idx": line["start_idx"], "end_idx": edge.idx, "slope": slope, "lower": lower, "upper": upper, "confirm_idx": confirm,
            "broken_idx": broken, "touches": sorted({*below, *above}), "score": round(min(1.0, 0.35 + 0.1 * (len(below) + len(above))), 4),
            "baseline": line["id"], "construction": "translated" if second is None else "independent_trendlines",
            "source_line": None if second is None else second["id"]})
    return sorted(out, key=lambda x: (x["status"] != "confirmed", x["status"] == "broken", -x["score"]))


def _middle(points: list[Pivot]) -> float:
    """The median price of pivots in order of their prices."""
    half = len(points) // 2
    return points[half].price if len(points) % 2 else (points[half - 1].price + points[half].price) / 2


def price_clusters(points: list[Pivot], tolerance: float = 0.025) -> list[list[Pivot]]:
    """From the lowest price up, each pivot joins the first cluster whose median is near; a cluster is in order of prices."""
    out: list[list[Pivot]] = []
    for p in sorted(points, key=lambda p: p.price):
        home = next((c for c in out if abs(p.price / _middle(c) - 1) <= tolerance), None)
        out.append([p]) if home is None else home.append(p)
    return out


def ranges(found: list[Pivot], close: np.ndarray, scale: str, tolerance: float = 0.025, most: int = 12) -> list[dict]:
    """Pairs of high and low clusters that were tested in the same stretch of time."""
    out = []
    tops, bottoms = ([c for c in price_clusters([p for p in found if p.typ == t], tolerance) if len(c) > 1] for t in "HL")
    for top in tops:
        for bottom in bottoms:
            upper, lower = _middle(top), _middle(bottom)
            hs, ls = sorted(p.idx for p in top), sorted(p.idx for p in bottom)
            drift = max((max(p.price for p in c) - min(p.price for p in c)) / m for c, m in ((top, upper), (bottom, lower)))
            if lower <= 0 or upper / lower < 1.05 or max(hs[0], ls[0]) > min(hs[-1], ls[-1]) or drift > 0.03:
                continue
            finish = max(hs[-1], ls[-1])
            after = close[finish + 1 :]
            left = np.flatnonzero((after > upper * (1 + tolerance)) | (after < lower * (1 - tolerance)))
            broken = finish + 1 + int(left[0]) if len(left) else None
            role = None if broken is None else "up" if close[broken] > upper else "down"
            start = min(hs[0], ls[0])
            out.append({"kind": "range", "id": name("range_", scale, str(round(lower, 6)), str(round(upper, 6)), start), "role": role,
                "status": "broken" if broken is not None else "confirmed", "start_idx": start, "end_idx": finish, "lower": round(lower, 6),
                "upper": round(upper, 6), "broken_idx": broken, "touches": sorted({*hs, *ls}), "score": round(min(1.0, 0.4 + 0.1 * (len(hs) + len(ls))), 4)})
    return sorted(out, key=lambda x: (x["status"] == "broken", -x["score"], -x["end_idx"]))[:most]


def structure(high: np.ndarray, low: np.ndarray, close: np.ndarray, scale: str, as_of: list[int] | None = None) -> list[dict]:
    """All structures of one scale, as they are known at the last bar, or at each of the bars ``as_of``.

    The zigzag is carried from one of these bars to the next; what is found at a bar depends on nothing after it.
    """
    left, right, swing = SCALES[scale]
    atr, line, at, out = average_range(high, low, close), [], 0, []
    found = local_extremes(high, low, left, right)
    for last in [len(close) - 1] if as_of is None else sorted({min(i, len(close) - 1) for i in as_of}):
        while at < len(found) and found[at].confirm <= last:
            extend(line, found[at], swing)
            at += 1
        seen = slice(0, last + 1)
        lines = trend_lines(line, high[seen], low[seen], atr[seen], scale)
        shapes = lines + channels(lines, line, high[seen], low[seen], atr[seen]) + ranges(line, close[seen], scale)
        out += [x | {"as_of_idx": last} for x in shapes]
    return out


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _table(rows: list[dict], schema: str) -> pa.Table:
    """Records as an Arrow table of a schema's columns; missing values are nulls."""
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({c: pa.array([r.get(c) for r in rows], _ARROW[kind], from_pandas=True) for c, kind in fields})


def _prices(rows: pa.Table) -> list[np.ndarray]:
    """High, low and close of one symbol's bars in order of their dates."""
    rows = rows.select(["date", "high", "low", "close"]).sort_by("date")
    return [rows[c].to_numpy().astype(float) for c in ("high", "low", "close")]


def market_structure(bars: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """Structures of each symbol on all scales, with the bar as of which they are known.

    ``as_of(symbol, as_of_idx)`` asks for other bars than the last, any number a symbol; a symbol without any gives no
    rows, and a number beyond the last bar means the last.
    """
    schema = f"{SCHEMA}, as_of_idx int"

    def told(rows: pa.Table, at: list[int] | None) -> pa.Table:
        if not len(rows):
            return _table([], schema)
        symbol, data = rows["symbol"][0].as_py(), _prices(rows)
        return _table([{"symbol": symbol, "scale": s} | x for s in SCALES for x in structure(*data, s, at)], schema)

    rows = bars.select("symbol", "date", "high", "low", "close").groupBy("symbol")
    if as_of is None:
        return rows.applyInArrow(lambda r: told(r, None), schema)
    asked = as_of.select("symbol", "as_of_idx").where("as_of_idx >= 0").groupBy("symbol")
    return rows.cogroup(asked).applyInArrow(lambda r, a: told(r, a["as_of_idx"].to_pylist()), schema)


def compact(structures: DataFrame, lines: int = 2, others: int = 3) -> DataFrame:
    """The best few: lines and converted levels of each scale and role, channels and ranges of each scale."""
    from pyspark.sql import Window

    by_role = F.col("kind").isin("trendline", "horizontal_level")
    w = Window.partitionBy("symbol", "scale", "kind", F.when(by_role, F.col("role"))).orderBy((F.col("status") != "confirmed"),
        (F.col("status") == "broken"), F.desc("score"), F.desc("end_idx"), "id")
    ranked = structures.withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= F.when(by_role, lines).otherwise(others))


TIMEFRAMES = ("daily", "weekly", "monthly")


def timeframes(bars: DataFrame) -> DataFrame:
    """Bars of all timeframes under one key: timeframe, symbol, the bar and the last real day in it."""
    from candela.operators import resample

    columns = ["symbol", "date", "open", "high", "low", "close", "volume", "amount", "source_date"]
    frames = {"daily": bars.withColumn("source_date", F.col("date")), "weekly": resample.weekly(bars), "monthly": resample.monthly(bars)}
    out = None
    for timeframe in TIMEFRAMES:
        frame = frames[timeframe].select(F.lit(timeframe).alias("timeframe"), *columns)
        out = frame if out is None else out.unionByName(frame)
    return out


def timeframe_heads(bars: DataFrame) -> DataFrame:
    """How many bars a symbol has in each timeframe, up to which day, and whether the last may be incomplete."""
    return timeframes(bars).groupBy("timeframe", "symbol").agg(F.count(F.lit(1)).alias("bar_count"), F.max("source_date").alias("as_of_date"),
        F.max_by(F.col("date") > F.col("source_date"), "date").alias("incomplete"))


def multi_timeframe(bars: DataFrame) -> DataFrame:
    """Structures of each symbol in each timeframe, every timeframe on its own bars, with ``timeframe_heads``."""
    schema = f"timeframe string, {SCHEMA}, as_of_idx int"

    def run(rows: pa.Table) -> pa.Table:
        keys, data = {c: rows[c][0].as_py() for c in ("timeframe", "symbol")}, _prices(rows)
        return _table([keys | {"scale": s} | x for s in SCALES for x in structure(*data, s)], schema)

    found = timeframes(bars).select("timeframe", "symbol", "date", "high", "low", "close").groupBy("timeframe", "symbol").applyInArrow(run, schema)
    return found.join(timeframe_heads(bars), ["timeframe", "symbol"])


def audit(structures: DataFrame, bars: DataFrame) -> DataFrame:
    """What confirmed lines and channels are not supposed to show: too few touches, or a wick beyond their limits.

    A structure meets the bars of its symbol from its start on; only bars that pierce it are kept, and the first counts.
    """
    wanted = structures.where("status = 'confirmed' and kind in ('trendline', 'channel')").select("symbol", "scale", "id", "kind", "role", "start_idx", "end_idx",
        "start_price", "slope", "lower", "upper", "confirm_idx", "touches")
    is_line = F.col("kind") == "trendline"
    few = is_line & ((F.size("touches") < 3) | (F.try_element_at("touches", F.lit(3)) <= F.col("end_idx")))
    rows = with_range(bars).select(F.col("symbol").alias("_symbol"), F.col("idx").alias("_idx"), "high", "low", "atr")
    at = F.col("start_price") + F.col("slope") * (F.col("_idx") - F.col("start_idx"))
    support = F.col("role") == "support"
    of_line = F.when(support, F.col("low") < at - lit(0.5) * F.col("atr")).otherwise(F.col("high") > at + lit(0.5) * F.col("atr"))
    moved, reach = F.col("slope") * F.col("_idx"), lit(0.6) * F.col("atr")
    of_channel = (F.col("low") < F.col("lower") + moved - reach) | (F.col("high") > F.col("upper") + moved + reach)
    since = F.when(is_line, F.col("start_idx") + 1).otherwise(F.col("confirm_idx"))
    key = ["symbol", "scale", "id", "kind"]
    crossed = wanted.where(~F.coalesce(few, F.lit(False))).join(rows, (F.col("symbol") == F.col("_symbol")) & (F.col("_idx") >= since) & F.when(is_line,
        of_line).otherwise(of_channel)).groupBy(*key).agg(F.min("_idx").alias("idx"))
    lacking = wanted.where(few).select(*key, F.lit("no_third_touch").alias("reason"), F.lit(None).cast("int").alias("idx"))
    return lacking.unionByName(crossed.select(*key, F.lit("wick_crossing").alias("reason"), "idx"))


def audit_zones(zones: DataFrame, anchors: DataFrame) -> DataFrame:
    """Zones whose level is not where their anchor and ratio put it: (symbol, scale, anchor_id, ratio, level, expected).

    ``zones(symbol, scale, anchor_id, ratio, level)``, ``anchors(symbol, scale, anchor_id, start_price, end_price)``.
    """
    met = zones.join(anchors.select("symbol", "scale", "anchor_id", "start_price", "end_price"), ["symbol", "scale", "anchor_id"])
    expected = F.round(F.col("end_price") - F.col("ratio") * (F.col("end_price") - F.col("start_price")), 8)
    return met.withColumn("expected", expected).where(F.abs(F.col("level") - F.col("expected")) > lit(1e-6)).select("symbol", "scale", "anchor_id", "ratio", "level", "expected")


def zone_clusters(packed: DataFrame, gap: float = 0.01) -> DataFrame:
    """Zones of each symbol's array of ``levels`` that overlap or lie within a gap of one another.

    A level is a struct (center, lower, upper, family, dependency, ...).  From the lowest center up, it joins the last
    zone if their bands overlap, or if it is near and the zone does not grow too wide; a fold over the sorted array says
    which zone each level is in.  The score counts what is independent; each zone keeps its levels as ``sources``.
    """
    kind = packed.schema["levels"].dataType.elementType
    start = F.struct(lit(0).alias("low"), lit(0).alias("high"), F.lit(0).alias("no"), F.array().cast(f"array<struct<no:int,level:{kind.simpleString()}>>").alias("placed"))

    def step(acc: Column, x: Column) -> Column:
        base = F.greatest(F.abs((acc["low"] + acc["high"]) / lit(2)), lit(1e-12))
        overlaps = (x["lower"] <= acc["high"]) & (x["upper"] >= acc["low"])
        near = ((x["center"] - acc["high"]) / base <= lit(gap)) & ((F.greatest(acc["high"], x["upper"]) - acc["low"]) / base <= lit(2 * gap))
        joins = (acc["no"] > 0) & (overlaps | near)
        no = acc["no"] + F.when(joins, 0).otherwise(1)
        return F.struct(F.when(joins, F.least(acc["low"], x["lower"])).otherwise(x["lower"]).alias("low"),
            F.when(joins, F.greatest(acc["high"], x["upper"])).otherwise(x["upper"]).alias("high"), no.alias("no"),
            F.concat(acc["placed"], F.array(F.struct(no.alias("no"), x.alias("level")))).alias("placed"))

    placed = packed.select("symbol", F.explode(F.aggregate(F.array_sort("levels"), start, step, lambda acc: acc["placed"])).alias("p")).select("symbol", "p.no", "p.level")
    depend, families = F.array_sort(F.collect_set("level.dependency")), F.array_sort(F.collect_set("level.family"))
    out = placed.groupBy("symbol", "no").agg(F.round(F.min("level.lower"), 8).alias("lower"), F.round(F.max("level.upper"), 8).alias("upper"),
        F.count(F.lit(1)).cast("int").alias("levels"), depend.alias("dependency_groups"), families.alias("families"), F.array_sort(F.collect_list("level")).alias("sources"))
    score = F.round(F.least(lit(1), lit(0.25) * F.size("dependency_groups") + lit(0.1) * F.size("families")), 4)
    return out.withColumn("score", score)


def confluence(levels: DataFrame, gap: float = 0.01) -> DataFrame:
    """Zones of ``levels(symbol, center, lower, upper, family, dependency)``; a symbol has few levels, its anchors' and averages'."""
    packed = levels.groupBy("symbol").agg(F.collect_list(F.struct("center", "lower", "upper", "family", "dependency")).alias("levels"))
    return zone_clusters(packed, gap).select("symbol", "lower", "upper", "levels", F.size("dependency_groups").alias("dependencies"), "families", "score")
