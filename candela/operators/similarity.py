"""Search for shapes: sliding windows scored coarsely on the executors, the best re-ranked by banded warping."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import by_symbol, lit, ratio

POINTS, BAND, LEAST_SCORE, HORIZONS = 64, 8, 0.55, (5, 10, 20)
WEIGHTS = {"price": 0.45, "drawdown": 0.15, "range": 0.10, "turning": 0.15, "volume": 0.15}


def standardise(x: np.ndarray) -> np.ndarray:
    """Zero mean and unit population deviation along the last axis; flat series become zeros."""
    x = x - x.mean(-1, keepdims=True)
    dev = x.std(-1, keepdims=True)
    return np.where(dev < 1e-12, 0.0, x / np.where(dev < 1e-12, 1, dev))


def resampled(x: np.ndarray, points: int = POINTS) -> np.ndarray:
    """Linear interpolation at evenly spaced places along the last axis."""
    at = np.linspace(0, x.shape[-1] - 1, points)
    low = np.minimum(at.astype(int), x.shape[-1] - 2) if x.shape[-1] > 1 else np.zeros(points, int)
    part = at - low
    return x[..., low] * (1 - part) + x[..., np.minimum(low + 1, x.shape[-1] - 1)] * part


def paths(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Shapes of one window: price, drawdown, range, turning points and, where half the bars have any, volume.

    Drawdown is relative to its deepest point; the others are standardised.  Turning points are the slope of the smoothed
    price shape.
    """
    close = rows["close"]
    price = standardise(resampled(np.log(close)))
    fall = close / np.maximum.accumulate(close) - 1
    deepest = abs(fall.min())
    smooth = np.array([price[max(0, i - 2) : i + 3].mean() for i in range(len(price))])
    out = {
        "price": price,
        "drawdown": resampled(fall / deepest if deepest > 1e-12 else fall),
        "range": standardise(resampled(np.maximum(rows["high"] - rows["low"], 0) / close)),
        "turning": standardise(np.gradient(smooth)),
    }
    if (rows["volume"] > 0).sum() >= len(close) // 2:
        out["volume"] = standardise(resampled(np.log1p(np.nan_to_num(rows["volume"]))))
    return out


def warp(a: np.ndarray, b: np.ndarray, band: int = BAND) -> float:
    """Mean absolute distance along the cheapest alignment within ``band`` steps of the diagonal."""
    n, m = len(a), len(b)
    cost, steps = np.full((n + 1, m + 1), np.inf), np.zeros((n + 1, m + 1))
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            ways = (cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
            k = int(np.argmin(ways))
            y, x = ((i - 1, j), (i, j - 1), (i - 1, j - 1))[k]
            cost[i, j] = ways[k] + abs(a[i - 1] - b[j - 1])
            steps[i, j] = steps[y, x] + 1
    return float(cost[n, m] / steps[n, m])


def likeness(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> float:
    """Weighted mean of exp(-distance) over the paths both have: prices are warped, the others compared point by point.

    A missing path's weight goes to the others in proportion.
    """
    both = [k for k in WEIGHTS if k in a and k in b]
    apart = {k: warp(a[k], b[k]) if k == "price" else float(np.sqrt(((a[k] - b[k]) ** 2).mean())) for k in both}
    return sum(WEIGHTS[k] * np.exp(-apart[k]) for k in both) / sum(WEIGHTS[k] for k in both)


def candidates(bars: DataFrame, query: np.ndarray, window: int, pool: int = 100, before: str | None = None) -> DataFrame:
    """The windows that go on to the full comparison: the best by coarse score, ten times the pool and 1000 at least."""
    return coarse(bars, query, window, before=before).orderBy(F.desc("score"), "symbol", "start").limit(max(1000, 10 * pool))


def shape_metrics(bars: DataFrame, window: int) -> DataFrame:
    """(symbol, date, total_return, max_drawdown, price_range) of the window that ends at each bar with enough before it; the range is the highest high over the lowest low, less one."""
    w = by_symbol()
    inside = w.rowsBetween(-(window - 1), 0)
    spread = ratio(F.max("high").over(inside), F.min("low").over(inside)) - lit(1)
    held = bars.select("symbol", "date", "close", F.count("close").over(inside).alias("n"), F.first("close").over(inside).alias("start"), spread.alias("price_range"),
        F.collect_list("close").over(inside).alias("c")).where(F.col("n") == window)
    start = F.struct(lit(0).alias("peak"), lit(0).alias("fall"))
    fall = F.aggregate("c", start, lambda a, x: F.struct(F.greatest(a["peak"], x).alias("peak"),
        F.least(a["fall"], x / F.greatest(a["peak"], x) - lit(1)).alias("fall")), lambda a: a["fall"])
    return held.select("symbol", "date", (F.col("close") / F.col("start") - lit(1)).alias("total_return"), fall.alias("max_drawdown"), "price_range")


def coarse(bars: DataFrame, query: np.ndarray, window: int, top: int = 10, before: str | None = None) -> DataFrame:
    """(symbol, start, end_date, score): each symbol's best windows by exp(-RMSE) of the price path, half a window apart.

    ``before``: only windows that end before this date, and whose longest horizon does too.
    """
    target = standardise(resampled(np.log(np.asarray(query, float))))
    tail = max(HORIZONS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", ignore_index=True)
        close = rows["close"].to_numpy(float)
        if before is not None:
            close = close[: max(0, int((pd.to_datetime(rows["date"]) < pd.Timestamp(before)).sum()) - tail)]
        if len(close) < window:
            return pd.DataFrame({"symbol": [], "start": [], "end_date": [], "score": []}).astype({"symbol": "int64", "start": "int32", "score": float})
        shapes = standardise(resampled(np.lib.stride_tricks.sliding_window_view(np.log(close), window)))
        score = np.exp(-np.sqrt(((shapes - target) ** 2).mean(1)))
        kept: list[int] = []
        for i in np.argsort(-score, kind="stable"):
            if all(abs(i - k) >= window // 2 for k in kept):
                kept.append(int(i))
                if len(kept) == top:
                    break
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "start": np.array(kept, np.int32), "end_date": [rows["date"][k + window - 1] for k in kept],
            "score": score[kept]})

    return bars.select("symbol", "date", "close").groupBy("symbol").applyInPandas(run, "symbol long, start int, end_date date, score double")


def coarse_native(bars: DataFrame, query: list[float], window: int) -> DataFrame:
    """The same coarse score of every window without resampling, by array functions alone; the query has ``window`` values."""
    target = standardise(np.log(np.asarray(query, float))).tolist()
    logs = bars.select("symbol", "date", F.log("close").alias("x"))
    w = by_symbol().rowsBetween(-(window - 1), 0)
    seen = logs.select("symbol", "date", F.collect_list("x").over(w).alias("v"), F.avg("x").over(w).alias("m"),
        F.stddev_pop("x").over(w).alias("s")).where(F.size("v") == window)
    diff = F.zip_with("v", F.array(*map(lit, target)), lambda x, q: F.pow(F.coalesce(ratio(x - F.col("m"), F.col("s")), lit(0)) - q, lit(2)))
    return seen.select("symbol", "date", F.exp(-F.sqrt(F.aggregate(diff, lit(0), lambda a, x: a + x) / lit(window))).alias("score"))


def rerank(candidates: DataFrame, bars: DataFrame, query: dict[str, np.ndarray], window: int, least: float = LEAST_SCORE) -> DataFrame:
    """Full likeness of the candidate windows, read back from their symbols' bars."""
    target = paths(query)

    def run(keys, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("date", ignore_index=True)
        data = {c: right[c].to_numpy(float) for c in ("close", "high", "low", "volume")}
        score = [likeness(target, paths({k: v[s : s + window] for k, v in data.items()})) for s in left["start"]]
        return left.assign(likeness=score)[["symbol", "start", "end_date", "score", "likeness"]]

    schema = "symbol long, start int, end_date date, score double, likeness double"
    frame = bars.select("symbol", "date", "close", "high", "low", "volume").join(candidates.select("symbol").distinct(), "symbol", "left_semi")
    return candidates.groupBy("symbol").cogroup(frame.groupBy("symbol")).applyInPandas(run, schema).where(F.col("likeness") >= least)


def without_overlap(matches: DataFrame, window: int) -> DataFrame:
    """Matches of a symbol that overlap a better one by half or more are left out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = rows.sort_values(["likeness", "start"], ascending=[False, True], ignore_index=True)
        for i, start in enumerate(rows["start"]):
            if all(abs(start - rows["start"][k]) > window / 2 for k in kept):
                kept.append(i)
        return rows.iloc[kept]

    return matches.groupBy("symbol").applyInPandas(run, matches.schema)


def forward_stats(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Return, best gain and worst fall after each bar by horizon, where the bars are there."""
    w = by_symbol()
    each = [F.struct(F.lit(h).alias("horizon"), (ratio(F.lead("close", h).over(w), F.col("close")) - lit(1)).alias("ret"),
        (ratio(F.max("high").over(w.rowsBetween(1, h)), F.col("close")) - lit(1)).alias("max_gain"),
        (ratio(F.min("low").over(w.rowsBetween(1, h)), F.col("close")) - lit(1)).alias("max_fall")) for h in horizons]
    named = bars.select("symbol", "date", *[s.alias(f"h{i}") for i, s in enumerate(each)])
    return named.select("symbol", "date", F.explode(F.array(*[f"h{i}" for i in range(len(each))])).alias("o")).select("symbol", "date", "o.*").where("ret is not null")


def search(series: DataFrame, query: dict[str, np.ndarray], windows: tuple[int, ...], query_start, top_n: int = 10, least: float = LEAST_SCORE, latest: bool = False) -> DataFrame:
    """Where any of ``series(series, date, close, high, low, volume)`` moved like the query, in windows of several lengths.

    Columns: rank, series, start, bars, start_date, end_date, coarse, likeness.  A series is one symbol in one timeframe.
    In history a window and its longest horizon end before the day ``query_start``; with ``latest`` each series offers its
    last window of each length alone.  Each series sends on no more than the pool that is compared in full holds, the pool
    is the best of all, and of windows of a series that overlap by half of the shorter or more the likest stays.
    """
    pool, target, whole = max(1000, 100 * top_n), standardise(resampled(np.log(query["close"]))), paths(query)
    tail, begins = 0 if latest else max(HORIZONS), np.datetime64(pd.Timestamp(query_start), "D")
    offer, schema = "series string, start int, bars int, coarse double", "series string, start int, bars int, start_date date, end_date date, coarse double, likeness double"

    def offered(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        end = len(rows) - tail if latest else min(len(rows), int((rows["date"].to_numpy() < begins).sum())) - tail
        close, starts, lengths, scores = np.log(rows["close"].to_numpy().astype(float)[: max(0, end)]), [], [], []
        for bars in windows:
            if len(close) < bars:
                continue
            first = len(close) - bars if latest else 0
            shapes = standardise(resampled(np.lib.stride_tricks.sliding_window_view(close[first:], bars)))
            score = np.exp(-np.sqrt(((shapes - target) ** 2).mean(1)))
            best = np.argsort(-score, kind="stable")[:pool]
            starts.append(best + first)
            lengths.append(np.full(len(best), bars))
            scores.append(score[best])
        start, length, score = (np.concatenate(x) if x else np.zeros(0) for x in (starts, lengths, scores))
        return pa.table({"series": pa.repeat(rows["series"][0], len(start)), "start": pa.array(start.astype(np.int32)), "bars": pa.array(length.astype(np.int32)), "coarse": pa.array(score)})

    found = series.select("series", "date", "close").groupBy("series").applyInArrow(offered, offer)
    best = found.orderBy(F.desc("coarse"), "series", "bars", "start").limit(pool)

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("date", ignore_index=True)
        data = {c: right[c].to_numpy(float) for c in ("close", "high", "low", "volume")}
        left = left.assign(likeness=[likeness(whole, paths({k: v[s : s + n] for k, v in data.items()})) for s, n in zip(left["start"], left["bars"], strict=True)])
        left = left[left["likeness"] >= least].sort_values(["likeness", "start", "bars"], ascending=[False, True, True], ignore_index=True)
        kept: list[int] = []
        for i, (start, bars) in enumerate(zip(left["start"], left["bars"], strict=True)):
            spans = [(left["start"][k], left["bars"][k]) for k in kept]
            if all(min(start + bars, s + n) - max(start, s) < 0.5 * min(bars, n) for s, n in spans):
                kept.append(i)
        left, dates = left.iloc[kept], right["date"].to_numpy(object)
        start, end = left["start"].to_numpy(int), (left["start"] + left["bars"]).to_numpy(int) - 1
        return left.assign(start_date=dates[start], end_date=dates[end])[["series", "start", "bars", "start_date", "end_date", "coarse", "likeness"]]

    held = series.select("series", "date", "close", "high", "low", "volume").join(best.select("series").distinct(), "series", "left_semi")
    matched = best.groupBy("series").cogroup(held.groupBy("series")).applyInPandas(compared, schema)
    chosen = matched.orderBy(F.desc("likeness"), "series", "start", "bars").limit(max(top_n, BEST))
    order = Window.orderBy(F.desc("likeness"), "series", "start", "bars")  # a hundred rows or so
    return chosen.select(F.row_number().over(order).alias("rank"), "*")


#: Matches that outcomes are told from.
BEST = 100


def horizon_summary(matched: DataFrame) -> DataFrame:
    """(horizon, samples, win_rate, avg_return, median_return, best, worst, avg_max_fall) of what followed matches."""
    return matched.groupBy("horizon").agg(F.count(F.lit(1)).alias("samples"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("avg_return"),
        F.median("ret").alias("median_return"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg("max_fall").alias("avg_max_fall"))


def probabilities(matched: DataFrame, threshold: float = 0.02, weight: str = "score") -> DataFrame:
    """Shares of rises, falls and neither by horizon, equally and by likeness, with a word on how much they rest on."""
    up, down = F.col("ret") > threshold, F.col("ret") < -threshold
    w = F.col(weight)

    def share(c):
        return F.round(F.avg(c.cast("double")) * 100, 4)

    def weighted(c):
        return F.round(F.sum(F.when(c, w).otherwise(lit(0))) / F.sum(w) * 100, 4)

    out = matched.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), share(up).alias("up"), share(down).alias("down"), share(~(up | down)).alias("sideways"),
        weighted(up).alias("up_weighted"), weighted(down).alias("down_weighted"),
        share(F.col("ret") > 0).alias("positive"), share(F.col("max_gain") >= 0.05).alias("reached_up"), share(F.col("max_fall") <= -0.05).alias("reached_down"),
        F.round(F.avg("ret"), 6).alias("avg_ret"), F.round(F.percentile("ret", 0.5), 6).alias("median_ret"),
    )
    return out.withColumn("confidence", F.when(F.col("n") >= 50, "high").when(F.col("n") >= 20, "medium").otherwise("low"))
