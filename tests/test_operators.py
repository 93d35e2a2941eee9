"""Scenarios with known answers."""

import datetime
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela import api
from candela.operators import backtest, detectors, levels, pivots, resample, research, similarity, store, structure
from candela.operators import indicators as ta
from candela.operators.pivots import Pivot
from candela.plans import analysis, cohorts, patterns
from candela.sources import bars as sources
from candela.sources import parsers
from candela.streaming import alerts

BARS = "symbol long, date date, open double, high double, low double, close double, volume double, amount double"


def days(n, start="2021-03-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def ramp(corners, loud=(), symbol=1):
    """Bars along straight lines between (bar, price) corners; on ``loud`` bars four times the volume."""
    at = np.arange(corners[-1][0] + 1)
    close = np.interp(at, *zip(*corners, strict=True))
    opened = np.concatenate([[close[0] * 0.999], close[:-1]])
    return [(symbol, d, float(o), float(max(o, c) * 1.003), float(min(o, c) * 0.997), float(c), 4e5 * (4 if i in loud else 1), 1e6) for i,
        (d, o, c) in enumerate(zip(days(len(at)), opened, close, strict=True))]


def signals_of(spark, rows, **over):
    from candela.sources.bars import with_change

    frame = spark.createDataFrame(rows, BARS)
    return detectors.detect(ta.factors(with_change(frame)), **over).orderBy("symbol", "date").collect()


def test_ewm_equals_pandas():
    rng = np.random.default_rng(1)
    for alpha, least in ((1 / 3, 0), (1 / 14, 14), (2 / 13, 0)):
        x = rng.normal(size=200)
        x[rng.random(200) < 0.2] = np.nan
        x[:5] = np.nan
        want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()
        assert np.allclose(ta.ewm(x, alpha, least), want, equal_nan=True)


def test_zigzag_keeps_extremes_and_swings():
    line = []
    for i, (typ, price) in enumerate([("L", 31), ("H", 31.5), ("L", 28), ("H", 35), ("H", 34), ("H", 37), ("L", 36.5), ("L", 33)]):
        pivots.extend(line, Pivot(i, typ, float(price), i + 4), 0.05)
    assert [(p.typ, p.price) for p in line] == [("L", 28), ("H", 37), ("L", 33)]


def test_pivots_native_equal_arrays(spark):
    rows = ramp([(0, 12), (9, 17), (16, 13), (30, 21), (41, 15), (55, 19)])
    frame = spark.createDataFrame(rows, BARS)
    native = sorted((r.idx, r.typ, r.price, r.confirm) for r in pivots.pivots(frame).collect())
    assert native == sorted(tuple(p) for p in detectors.local_extremes(np.array([r[3] for r in rows]), np.array([r[4] for r in rows])))
    assert all(c == i + 5 for i, _, _, c in native) and {(30, "H"), (41, "L")} <= {(i, t) for i, t, _, _ in native}


def test_fib_levels(spark):
    pivot = "struct<price:double,idx:int>"
    cases = [(1, (75.0, 90), (55.0, 20), None), (2, (75.0, 90), (55.0, 20), 80.0), (3, (75.0, 20), (55.0, 90), None), (4, None, (55.0, 20), 80.0)]
    frame = spark.createDataFrame(cases, f"k int, top {pivot}, bottom {pivot}, peak double")
    got = {r.k: r.x and {x.name: round(x.value, 2) for x in r.x} for r in frame.select("k", detectors.fib_levels(F.col("top"), F.col("bottom"), F.col("peak")).alias("x")).collect()}
    assert got[1] == {"fib_382": 67.36, "fib_500": 65.0, "fib_618": 62.64, "fib_786": 59.28}
    assert got[2]["fib_500"] == 67.5 and got[3]["retr_618"] == 67.36 and got[4] is None


#: Corners of a path, its loud bars, and the signal it leads to: pattern, variant, bar, trend, phase.
SCENES = {
    1: ([(0, 64), (190, 104), (262, 63), (276, 72), (290, 64.5), (304, 70)], (), ("w_bottom", "right_bottom", 295, "down", "base_rebound")),
    2: ([(0, 60), (70, 46), (270, 83), (283, 75), (296, 82), (306, 76.5), (316, 80)], (), ("m_neckline", "neckline_hold", 310, "up", "second_pullback")),
    3: ([(0, 40), (120, 44), (170, 55), (185, 51), (240, 66), (255, 62), (300, 80), (309, 75.5), (318, 79)], (),
    ("trend_pullback", "near_level", 260, "up", "second_pullback")),
    4: ([(0, 58), (240, 61), (275, 82), (300, 63.5), (316, 64.5), (324, 67)], (), ("ma_rebound", "MA120_hold", 317, "down", "downtrend_ma_support")),
    5: ([(0, 30), (150, 45), (230, 47), (240, 46), (250, 47.2), (262, 46.2), (272, 47), (275, 49)], (273, 274, 275),
    ("box_breakout", "box_breakout", 273, "range", "box_breakout")),
}


def test_each_detector_finds_its_scene(spark):
    rows = [r for symbol, (corners, loud, _) in SCENES.items() for r in ramp(corners, loud, symbol)]
    first, calendar = {}, days(400)
    for r in signals_of(spark, rows):
        first.setdefault(r.symbol, (r.pattern, r.variant, calendar.index(r.date), r.trend, r.wave_phase))
    assert first == {symbol: want for symbol, (_, _, want) in SCENES.items()}


def test_a_silent_breakout_is_none(spark):
    corners, _, _ = SCENES[5]
    assert signals_of(spark, ramp(corners), patterns=("box_breakout",)) == []


@pytest.mark.parametrize("cut", [330, 420])
def test_detectors_do_not_look_ahead(spark, cut):
    rng = np.random.default_rng(7)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 500)))
    opened = np.concatenate([[50], close[:-1]])
    rows = [(1, d, float(o), float(max(o, c) * 1.005), float(min(o, c) * 0.995), float(c), float(v), 1.0) for d, o, c,
        v in zip(days(500), opened, close, rng.uniform(1e5, 1e6, 500), strict=True)]
    whole = [(r.date, r.pattern, r.score) for r in signals_of(spark, rows) if r.date <= rows[cut - 1][1]]
    assert whole == [(r.date, r.pattern, r.score) for r in signals_of(spark, rows[:cut])]


def line_of(typ, pairs, lag=3):
    return [Pivot(i, typ, price, i + lag) for i, price in pairs]


def test_third_touch_confirms_a_line():
    found = sorted(line_of("L", [(4, 20.0), (12, 22.0), (24, 25.0)]) + line_of("H", [(8, 30.0), (18, 32.0)]), key=lambda p: p.idx)
    high, low = np.full(32, 33.0), np.arange(32) * 0.25 + 19.2
    line = next(x for x in structure.trend_lines(found, high, low, np.full(32, 1.5), "fine") if x["touches"] == [4, 12, 24])
    assert (line["role"], line["status"], line["confirm_idx"], line["start_price"] + line["slope"] * 20) == ("support", "confirmed", 27, 25.0)


def test_wick_breaks_a_line():
    high, low = np.full(40, 40.0), np.full(40, 38.0)
    high[31] = 47.0  # the line is at 46.2 there
    line = structure.trend_lines(line_of("H", [(10, 50.4), (20, 48.4)]), high, low, np.full(40, 1.0), "fine")[0]
    assert (line["role"], line["status"], line["broken_idx"]) == ("resistance", "broken", 31)


def test_horizontal_range():
    found = line_of("H", [(3, 44.0), (14, 44.5), (27, 43.8)]) + line_of("L", [(8, 40.0), (20, 40.4), (33, 39.8)])
    got = structure.ranges(found, np.full(45, 42.0), "fine")
    assert [(x["upper"], x["lower"], x["status"]) for x in got] == [(44.0, 40.0, "confirmed")]
    left = structure.ranges(found, np.concatenate([np.full(40, 42.0), np.full(5, 47.0)]), "fine")
    assert [(x["status"], x["broken_idx"], x["role"]) for x in left] == [("broken", 40, "up")]


def test_audit_finds_what_is_wrong(spark):
    frame = spark.createDataFrame(ramp([(0, 50), (60, 80)]), BARS)
    shape = {"scale": "fine", "status": "confirmed", "score": 0.5}
    good = shape | {"symbol": 1, "kind": "trendline", "id": "good", "role": "support", "start_idx": 0, "end_idx": 10, "start_price": 45.0, "slope": 0.4,
        "touches": [0, 10, 20], "confirm_idx": 23}
    rows = [good, good | {"id": "two", "touches": [0, 10]}, good | {"id": "crossed", "start_price": 49.0, "slope": 0.6},
        shape | {"symbol": 1, "kind": "channel", "id": "narrow", "slope": 0.5, "lower": 40.0, "upper": 49.0, "confirm_idx": 20}]
    names = [x.split()[0] for x in structure.SCHEMA.split(", ")]
    structures = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], structure.SCHEMA)
    assert {(r.id, r.reason) for r in structure.audit(structures, frame).collect()} == {("two", "no_third_touch"), ("crossed", "wick_crossing"),
        ("narrow", "wick_crossing")}


def legs_frame(spark, ups):
    """Legs of one symbol through the prices given, ten bars each."""
    line = [(1, 10 * i, days(1)[0], "L" if (i % 2 == 0) == (ups[1] > ups[0]) else "H", float(p), 10 * i + 3, i) for i, p in enumerate(ups)]
    return spark.createDataFrame(line, pivots.ZIGZAG)


@pytest.mark.parametrize(
    ("path", "phase", "ratio"),
    [([60, 60], "impulse", 0.0), ([60, 56, 58], "retracing", 0.1), ([60, 52, 60], "retracement_confirming", 0.0), ([60, 52, 63], "resumed", -0.15),
    ([60, 52, 38], "over_retraced", 1.1)],
)
@pytest.mark.parametrize("down", [False, True])
def test_retracement_phases(spark, path, phase, ratio, down):
    """A move from 40 to 60, or its mirror image, and the closes after it."""
    turn = (lambda p: 100 - p) if down else (lambda p: p)
    anchored = spark.createDataFrame([(1, "leg", 0, float(turn(40)), 1, float(turn(60)), "down" if down else "up")],
        "symbol long, leg_id string, start_idx int, start_price double, end_idx int, end_price double, direction string")
    closes = [turn(40), *map(turn, path)]
    frame = spark.createDataFrame([(1, d, float(c), float(c), float(c), float(c), 1.0, 1.0) for d, c in zip(days(len(closes)), closes, strict=True)], BARS)
    got = pivots.retracements(anchored, frame).first()
    assert (got.phase, round(got.retracement, 6), round(got.position, 6)) == (phase, ratio, round(1 - ratio, 6))


def test_anchors_need_length_and_size(spark):
    moves = pivots.legs(legs_frame(spark, [30, 50, 40, 70, 65]))
    sized = moves.withColumn("atr_move", F.element_at(F.array(*map(F.lit, (4.0, 0.9, 9.0, 2.0))), F.col("ordinal") + 1)).withColumn("bars",
        F.when(F.col("ordinal") == 3, 2).otherwise(F.col("bars")))
    assert [(r.ordinal, r.position, r.rank) for r in pivots.anchors(sized).orderBy("position").collect()] == [(2, 1, 1.0), (0, 2, 0.5)]


def test_zones_reach_a_share_of_the_range(spark):
    frame = spark.createDataFrame(ramp([(0, 60), (40, 60)]), BARS)
    anchored = pivots.anchors(pivots.legs(legs_frame(spark, [40, 60])))
    zone = {r.ratio: r for r in pivots.fib_zones(anchored, frame).collect()}[0.5]
    assert zone.level == 50 and zone.upper - zone.level == pytest.approx(0.15 * 0.36, rel=1e-3) == pytest.approx(zone.level - zone.lower)


@pytest.mark.parametrize(
    ("prices", "impulse", "direction"),
    [([20, 30, 25, 42, 36, 50], 100, "up"), ([50, 40, 45, 28, 34, 20], 100, "down"), ([20, 30, 29, 42, 30.5, 50], 60, "up"), ([20, 40, 30, 38, 35, 36], 80, "up")],
)
def test_impulse_scores(spark, prices, impulse, direction):
    got = pivots.waves(legs_frame(spark, prices)).first()
    assert (got.impulse_score, got.direction) == (impulse, direction)


@pytest.mark.parametrize(("prices", "score"), [([60, 40, 50, 35], 100), ([60, 40, 58, 35], 50), ([60, 40, 50, 12], 0 + 50), ([60, 40, 44, 41.5], 0)])
def test_correction_scores(spark, prices, score):
    got = pivots.waves(legs_frame(spark, prices)).first()
    assert (got.abc_score, got.abc_direction, got.impulse_score) == (score, "down", None)


def test_double_patterns_of_both_kinds(spark):
    for mirror, (kind, broken, failed, open_) in ((False, ("w_bottom", "neckline_breakout", "invalidated", "right_bottom_confirmed")),
        (True, ("m_top", "neckline_breakdown", "invalidated", "right_top_confirmed"))):
        turn = (lambda p: 100 - p) if mirror else (lambda p: p)
        line = legs_frame(spark, [turn(40), turn(46), turn(41)])
        for after, status in ((47.5, broken), (38.0, failed), (43.0, open_)):
            closes = [turn(43)] * 30 + [turn(after)] * 3
            frame = spark.createDataFrame([(1, d, float(c), float(c), float(c), float(c), 1.0, 1.0) for d, c in zip(days(33), closes, strict=True)], BARS)
            got = pivots.double_patterns(line, frame).first()
            assert (got.pattern, got.status, got.event_idx) == (kind, status, None if status == open_ else 30)


def test_turns_and_the_open_leg(spark):
    moves = pivots.legs(legs_frame(spark, [40, 60, 50, 66, 56]))
    assert [(r.kind, r.nearest, round(r.ratio, 3)) for r in pivots.turns(moves).orderBy("ordinal").collect()] == [("up_pullback", 0.5, 0.5),
        ("down_rebound", 0.786, 1.6), ("up_pullback", 0.618, 0.625)]
    frame = spark.createDataFrame(ramp([(0, 56), (50, 58)]), BARS)
    got = pivots.active_leg(legs_frame(spark, [40, 60, 50, 66, 56]), frame).first()
    assert (got.from_type, got.direction, got.change_pct) == ("L", "up", 3.57)
    assert [(x.name, x.price) for x in got.levels] == [("retr_382", 59.82), ("retr_500", 61.0), ("retr_618", 62.18), ("prior_high", 66.0)]


def test_confluence_counts_what_is_independent(spark):
    schema = "symbol long, center double, lower double, upper double, family string, dependency string"

    def zones(*levels):
        return structure.confluence(spark.createDataFrame([(1, *x) for x in levels], schema)).orderBy("lower").collect()

    level = (70.0, 69.3, 70.7, "fibonacci", "leg1")
    assert [(z["levels"], z["dependencies"], z["score"]) for z in zones(level, level)] == [(2, 1, 0.35)]
    near, far = (70.7, 70.63, 70.77, "average", "MA20"), (84.0, 84.0, 84.0, "average", "MA60")
    assert len(zones((70.0, 69.86, 70.14, "fibonacci", "leg1"), near, far)) == 2  # within the gap
    assert len(zones((70.0, 68.6, 70.14, "fibonacci", "leg1"), near, far)) == 3  # would grow too wide


def two_walks(spark, n=420):
    """Bars of two symbols that wander."""
    rng, rows = np.random.default_rng(29), []
    for symbol in (1, 2):
        close = 40 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(symbol, d, float(c), float(c * 1.01), float(c * 0.99), float(c), 1.0, 1.0) for d, c in zip(days(n), close, strict=True)]
    return spark.createDataFrame(rows, BARS)


def test_structures_are_those_of_the_bars_so_far(spark):
    """Lines, channels, ranges, skeletons and positions as of a bar are those of the table that ends there."""
    from candela.operators import snapshot

    frame = two_walks(spark)
    asked = spark.createDataFrame([(1, 200), (1, 333), (2, 260), (2, 10_000), (3, 5)], "symbol long, as_of_idx int")
    got = defaultdict(list)
    for r in structure.market_structure(frame, asked).collect():
        got[r.symbol, r.as_of_idx].append(tuple(r))
    assert set(got) == {(1, 200), (1, 333), (2, 260), (2, 419)}
    kinds = set()
    for (symbol, at), rows in got.items():
        here = snapshot.cut(frame, spark.createDataFrame([(symbol, at)], "symbol long, as_of_idx int"))
        want = structure.market_structure(here).collect()
        assert here.count() == at + 1 and sorted(map(repr, map(tuple, want))) == sorted(map(repr, rows))
        kinds |= {r.kind for r in want}
        known = pivots.multiscale(frame).where(f"symbol = {symbol} and scale = 'fine'") if at == 419 else pivots.multiscale(here).where("scale = 'fine'")
        assert known.agg(F.max("confirm")).first()[0] <= at
    assert {"trendline", "range"} <= kinds
    one = spark.createDataFrame([(1, 333), (2, 260)], "symbol long, as_of_idx int")
    whole, parts = snapshot.snapshot(frame, one).orderBy("symbol").collect(), []
    for symbol, at in ((1, 333), (2, 260)):
        first = frame.where(F.col("symbol") == symbol).orderBy("date").limit(at + 1)
        parts.append(snapshot.snapshot(first).first())
    assert whole == parts


def test_compact_snapshot_keeps_what_stems_from_its_anchors(spark):
    from candela.operators import snapshot

    full = snapshot.snapshot(two_walks(spark)).orderBy("symbol").collect()
    small = snapshot.compact(snapshot.snapshot(two_walks(spark))).orderBy("symbol").collect()
    for f, c in zip(full, small, strict=True):
        shown = {a.anchor_id for s in f.scales for a in s.anchors[:3]}
        assert {a.anchor_id for s in c.scales for a in s.anchors} == shown == {z.anchor_id for s in c.scales for z in s.zones}
        assert [(s.pivot_count, s.pivots) for s in c.scales] == [(len(s.pivots), s.pivots[-20:]) for s in f.scales]
        for kind, rows in (("trendline", c.trendlines), ("horizontal_level", c.converted_levels)):
            want = [x for s in ("fine", "medium", "coarse") for r in ("support", "resistance")
                for x in [x for x in f.trendlines if (x.scale, x.role, x.kind) == (s, r, kind)][:2]]
            assert rows == want
        near = [z for z in f.confluence_zones if any(x.anchor_id in shown for x in z.sources)]
        near.sort(key=lambda z: (abs((z.lower + z.upper) / 2 - f.current_price), -z.score, z.lower))
        assert [(z.lower, z.upper) for z in c.confluence_zones] == [(z.lower, z.upper) for z in near[:12]]
        for z, w in zip(c.confluence_zones, near, strict=False):
            assert [x.id for x in z.source_refs] == [x.id for x in w.sources if x.anchor_id in shown]
        assert c.counts.anchors == sum(len(s.anchors) for s in f.scales) and c.counts.trendlines == len(f.trendlines)


def test_channels_of_two_lines():
    """A channel's second side is the first one moved, or a line of its own that runs there."""
    found = sorted(line_of("L", [(4, 20.0), (14, 22.0), (26, 24.4)]) + line_of("H", [(8, 25.8), (20, 28.2), (30, 30.2)]), key=lambda p: p.idx)
    at = np.arange(34)
    low, high, atr = 19.2 + 0.2 * at + 0.05, 19.2 + 0.2 * at + 4.9, np.full(34, 0.5)
    support = next(x for x in structure.trend_lines(found, high, low, atr, "fine") if x["touches"] == [4, 14, 26])
    one = structure.channels([support], found, high, low, atr)[0]
    assert (one["construction"], one["source_line"], one["baseline"]) == ("translated", None, support["id"])
    other = support | {"id": "other", "role": "resistance", "start_idx": 8, "start_price": 25.8}
    two = structure.channels([support, other], found, high, low, atr)[0]
    assert (two["construction"], two["source_line"]) == ("independent_trendlines", "other")


def test_resample(spark):
    dates = days(40, "2023-08-02")  # a Wednesday
    frame = spark.createDataFrame([(1, d, 50.0 + i, 53.0 + i, 49.0 + i, 51.0 + i, 7.0, 1.0) for i, d in enumerate(dates)], BARS)
    weeks = resample.weekly(frame).orderBy("date").collect()
    assert (weeks[0].open, weeks[0].high, weeks[0].close, weeks[0].source_date) == (50, 55, 53, dates[2])
    assert sum(w.volume for w in weeks) == 280 and resample.monthly(frame).count() == 2


def test_similarity():
    t = np.arange(48)
    q = 30 + 0.2 * t + 2 * np.cos(t / 4)
    rows = {"close": q, "high": q * 1.01, "low": q * 0.98, "volume": np.linspace(50, 90, 48)}
    mine = similarity.paths(rows)
    assert similarity.likeness(mine, similarity.paths(rows)) == pytest.approx(1)
    assert "volume" not in similarity.paths({**rows, "volume": np.zeros(48)})
    assert mine["drawdown"].min() == pytest.approx(-1, abs=0.05) and mine["drawdown"].max() == 0
    assert np.allclose(mine["turning"], similarity.standardise(np.gradient(pd.Series(mine["price"]).rolling(5, center=True, min_periods=1).mean())))
    assert similarity.warp(np.array([0.0, 1, 2]), np.array([0.0, 1, 2])) == 0


def test_likeness_warps_prices_only():
    base = {k: np.zeros(64) for k in similarity.WEIGHTS}
    late = np.concatenate([np.zeros(3), np.sin(np.arange(61) / 5)])
    early = np.concatenate([np.sin(np.arange(61) / 5), np.zeros(3)])
    moved = similarity.likeness(base | {"price": late}, base | {"price": early})
    apart = {k: np.exp(-(similarity.warp(late, early) if k == "price" else np.sqrt(((late - early) ** 2).mean()))) for k in ("price", "range")}
    assert moved == pytest.approx(0.55 + 0.45 * apart["price"])
    assert similarity.likeness(base | {"range": late}, base | {"range": early}) == pytest.approx(0.90 + 0.10 * apart["range"])
    bare = {k: v for k, v in base.items() if k != "volume"}
    assert similarity.likeness(bare | {"range": late}, bare | {"range": early}) == pytest.approx(1 - 0.10 / 0.85 * (1 - apart["range"]))


def test_probabilities_sum(spark):
    frame = spark.createDataFrame([(5, r, 0.06 if r > 0 else 0.0, -0.06 if r < 0 else 0.0, 0.5 + i / 100) for i,
        r in enumerate([0.03, -0.03, 0.0, 0.05, 0.01] * 5)], "horizon int, ret double, max_gain double, max_fall double, score double")
    got = similarity.probabilities(frame).first()
    assert abs(got.up + got.down + got.sideways - 100) < 0.02 and got.confidence == "medium" and got.n == 25


def test_portfolio_admits_as_if_it_saw_all_trades(spark):
    """Against a fold over every trade: many symbols and patterns a day, some at once, some ending as others begin."""
    rng, calendar = np.random.default_rng(41), days(60)
    rows = {}
    for _ in range(2500):
        at, symbol, pattern = int(rng.integers(0, 45)), int(rng.integers(0, 60)), str(rng.choice(["a", "b"]))
        rows[at, symbol, pattern] = (symbol, pattern, calendar[at], calendar[at + int(rng.integers(0, 12))], float(round(rng.normal(0, 0.05), 6)))
    schema = "symbol long, pattern string, entry_date date, exit_date date, net_return double"
    held, want = {}, []
    for symbol, pattern, start, end, net in sorted(rows.values(), key=lambda r: (r[2], r[0], r[1])):
        held = {s: e for s, e in held.items() if e >= start}
        if len(held) < 10 and symbol not in held:
            held[symbol] = end
            want.append((symbol, pattern, start, end, net))
    accepted = backtest.admit(spark.createDataFrame(list(rows.values()), schema))
    assert sorted(tuple(r) for r in accepted.collect()) == sorted(want)
    got = backtest.portfolio(accepted).first()
    daily = pd.Series([r[4] / 10 for r in want]).groupby([r[3] for r in want]).sum().sort_index()
    equity = (1 + daily).cumprod()
    assert got.trades == len(want) and got.total_return == pytest.approx(equity.iloc[-1] - 1) and got.avg_return == pytest.approx(np.mean([r[4] for r in want]))
    assert got.max_drawdown == pytest.approx(min(0, (equity / np.maximum(equity.cummax(), 1) - 1).min()))
    none = backtest.portfolio(backtest.admit(spark.createDataFrame([], schema))).first()
    assert (none.trades, none.total_return, none.max_drawdown, none.win_rate) == (0, 0.0, 0.0, None)


def test_portfolio_takes_ten(spark):
    day = datetime.date(2024, 1, 2)
    trades = spark.createDataFrame([(i, "p", day, day + datetime.timedelta(5), 0.01) for i in range(15)],
        "symbol long, pattern string, entry_date date, exit_date date, net_return double")
    assert backtest.admit(trades).count() == 10


def test_stop_comes_before_target(spark):
    rows = ramp([(0, 88), (40, 88)])
    rows[20] = (1, rows[20][1], 88.0, 115.0, 60.0, 88.0, 1e6, 1e7)
    from candela.sources.bars import with_change

    frame = spark.createDataFrame(rows, BARS)
    signals = frame.where(F.col("date") == F.lit(rows[10][1])).select("symbol", "date", F.lit("p").alias("pattern"))
    trade = backtest.simulate(signals, with_change(frame)).first()
    assert (trade.reason, trade.exit_date, trade.entry_date) == ("stop", rows[20][1], rows[11][1])
    assert trade.exit == trade.stop  # also where the bar opens beyond it
    rows[20] = (1, rows[20][1], 60.0, 61.0, 58.0, 60.0, 1e6, 1e7)
    trade = backtest.simulate(signals, with_change(spark.createDataFrame(rows, BARS))).first()
    assert (trade.reason, trade.exit) == ("stop", trade.stop)


def test_alert_sequence():
    zone, state, seen = alerts.Zone("z", 49.0, 51.0), alerts.State(), []
    for u in (alerts.Update(1, 51.05, closed=False), alerts.Update(2, 50.5, 51.6, 50.0, False), alerts.Update(3, 51.5, closed=False), alerts.Update(4, 51.5)):
        seen += alerts.evaluate(zone, state, u)
    assert seen == [("approaching", False), ("touched", False), ("crossed_intrabar", False), ("breakout", True)]
    assert alerts.evaluate(zone._replace(invalidated=True), state, alerts.Update(5, 50)) == [("invalidated", True)]
    assert alerts.evaluate(zone, state, alerts.Update(6, 50)) == []


def test_alert_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    schema = "zone_id string, ts timestamp, close double, high double, low double, closed boolean, lower double, upper double, invalidated boolean"
    stamp = datetime.datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    rows = [(f"z{i % 3}", stamp + datetime.timedelta(minutes=i), float(10 + rng.normal(0, 0.4)), None, None, bool(i % 4), 9.8, 10.2,
        i > 280 and i % 3 == 1) for i in range(300)]
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {r.idempotency_key for r in alerts.alert_batch(frame).collect()}
    for run in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        alerts.sink(alerts.alert_stream(stream), str(tmp_path / "out"), str(tmp_path / run)).awaitTermination(120)
    out = [r.idempotency_key for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(out) == len(set(out)) and set(out) == want


def test_store(spark):
    old = spark.createDataFrame([(1, 100.0, "a"), (2, 5.0, "a")], "k long, rank double, source string")
    new = spark.createDataFrame([(1, 50.0, None), (3, 7.0, "b")], "k long, rank double, source string")
    assert sorted(tuple(r) for r in store.merge_coalesce(old, new, ["k"]).collect()) == [(1, 50.0, "a"), (2, 5.0, "a"), (3, 7.0, "b")]
    assert sorted(tuple(r) for r in store.insert_ignore(old, new, ["k"]).collect())[0] == (1, 100.0, "a")
    assert store.upsert(old, new.drop("source"), ["k"]).where("k = 1").first().source is None


def test_parsers(spark):
    lines = spark.createDataFrame([("2024-01-02,1,2,3,0.5,100,1e4,-,5%,1,0.2",), ("2024-01-03,1",), ("2024-01-04" + ",-" * 10,)], "line string")
    got = parsers.comma_bars(lines).orderBy("date").collect()
    assert len(got) == 2 and got[0].change_rate == 5.0 and got[0].amplitude is None and got[1].close is None
    codes = spark.createDataFrame([("sh600000",), ("430001",), ("x",)], "c string").select(parsers.prefixed(F.col("c")).alias("a"),
        parsers.prefixed(F.col("c"), True).alias("b")).collect()
    assert [tuple(r) for r in codes] == [("sh600000", "sh600000"), ("sz430001", "bj430001"), (None, None)]
    quotes = spark.createDataFrame([('v_sh600000="1~Name~600000~9.5";v_sz000001="51~Other~000001~";',)], "text string")
    assert [tuple(r) for r in parsers.tilde_quotes(quotes, {"name": 1, "price": 3}).collect()] == [("sh600000", "Name", "9.5"), ("sz000001", "Other", "")]


def test_registry_and_functions(spark):
    from candela.functions import registry

    registry.register_feature("twice")(lambda f: f.withColumn("twice", F.col("close") * 2))
    try:
        with pytest.raises(ValueError):
            registry.register_feature("twice")(lambda f: f)
        assert registry.with_features(spark.createDataFrame([(3.0,)], "close double"), "twice").first().twice == 6
    finally:
        del registry.FEATURES["twice"]
    registry.register_functions(spark)
    row = spark.sql("SELECT score_range(0.5D, 1D, 2D, 0D, 4D) AS a, score_range(3D, 1D, 2D, 0D, 4D) AS b, score_range(NULL, 1D, 2D, 0D, 4D) AS c, "
        "warp(array(0D, 1D), array(0D, 2D)) AS w").first()
    assert (row.a, row.b, row.c, row.w) == (0.5, 0.5, 0.0, 0.5)


def test_reports_and_command_line(spark, tmp_path, capsys):
    from candela.__main__ import main
    from candela.operators import research

    frame = spark.createDataFrame([(1, "a"), (2, "b")], "n long, name string")
    assert open(research.write_report(frame, str(tmp_path / "r.md"), "markdown")).read() == "|n|name|\n|-|-|\n|1|a|\n|2|b|\n"
    assert len(pd.read_csv(research.write_report(frame, str(tmp_path / "r.csv")))) == 2
    with pytest.raises(ValueError):
        research.write_report(frame, str(tmp_path / "r.json"), "json", most=1)
    assert main(["list"]) == 0 and "query golden_cross" in capsys.readouterr().out
    assert main(["query", "no_such_query", "--data", "/root/testdata/sf0.001"]) == 2
    assert main(["query", "latest_trade_date", "--data", "/root/testdata/sf0.001"]) == 0 and "latest" in capsys.readouterr().out


def test_names_of_patterns():
    known = {"w_bottom": "double bottom", "box_breakout": "box breakout"}
    assert parsers.pattern_names("bottom, box_breakout,double bottom, x", known) == ["w_bottom", "box_breakout"]


def test_search_across_series_and_lengths(spark):
    """Against a plain loop over all windows of all series."""
    rng, rows = np.random.default_rng(53), []
    for k, name in enumerate(("daily:2", "weekly:2", "daily:3", "short:4")):
        n = (90, 60, 75, 14)[k]
        close = 40 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(name, d, float(c), float(c * 1.01), float(c * 0.98), float(rng.integers(1, 50))) for d, c in zip(days(n), close, strict=True)]
    series = spark.createDataFrame(rows, "series string, date date, close double, high double, low double, volume double")
    own = 30 * np.exp(np.cumsum(rng.normal(0, 0.02, 16)))
    query = {"close": own, "high": own * 1.01, "low": own * 0.98, "volume": rng.integers(1, 50, 16).astype(float)}
    begins = days(90)[70]
    for latest in (False, True):
        target, every = similarity.paths(query), []
        for name in sorted({r[0] for r in rows}):
            data = [r for r in rows if r[0] == name]
            last = len(data) - 1 if latest else sum(r[1] < begins for r in data) - 1 - 20
            for bars in (12, 16):
                for start in range(max(0, last - bars + 1) if latest else 0, last - bars + 2):
                    cut = {c: np.array([r[i] for r in data[start : start + bars]]) for c, i in (("close", 2), ("high", 3), ("low", 4), ("volume", 5))}
                    every.append((similarity.likeness(target, similarity.paths(cut)), name, start, bars))
        want = []
        for score, name, start, bars in sorted((x for x in every if x[0] >= 0.3), key=lambda x: (-x[0], x[1], x[2], x[3])):
            if all(n != name or min(start + bars, s + b) - max(start, s) < 0.5 * min(bars, b) for _, n, s, b in want):
                want.append((score, name, start, bars))
        got = similarity.search(series, query, (12, 16), begins, least=0.3, latest=latest).orderBy("rank").collect()
        assert [(r.series, r.start, r.bars, round(r.likeness, 9)) for r in got] == [(n, s, b, round(x, 9)) for x, n, s, b in want] and len(want) > 2
        assert all(latest or r.end_date < begins for r in got)


def test_extremes_by_doubling(spark):
    from candela.functions.series import sliding_extremes

    rng = np.random.default_rng(61)
    values = {1: rng.integers(0, 50, 70).astype(float), 2: rng.integers(0, 50, 3).astype(float)}
    frame = spark.createDataFrame([(k, d, float(x)) for k, xs in values.items() for d, x in zip(days(len(xs)), xs, strict=True)], "symbol long, date date, x double")
    wanted = {f"{kind}_{n}": ("x", pick, n) for n in (1, 2, 3, 7, 8, 31, 60) for kind, pick in (("most", F.greatest), ("least", F.least))}
    got = sliding_extremes(frame, wanted)
    assert got.columns == ["symbol", "date", "x", *wanted]
    for symbol, xs in values.items():
        for i, r in enumerate(got.where(F.col("symbol") == symbol).orderBy("date").collect()):
            for n in (1, 2, 3, 7, 8, 31, 60):
                part = xs[max(0, i - n + 1) : i + 1]
                assert (r[f"most_{n}"], r[f"least_{n}"]) == (part.max(), part.min())


def test_symbols_resolve_in_order(spark):
    index = spark.createDataFrame([("BK1090", "Solar Power"), ("600000", "Bank of Solar"), ("BK77", "77 Bank"), ("000001", "")], "code string, name string")
    asked = spark.createDataFrame([(x,) for x in (" BK1090 ", "sh600000", "1090", "solar", "nk", "b", "", "zzz", "77", None, "sh600000")], "query string")
    got = {r.query: (r.code, r.how) for r in parsers.resolve_symbols(asked, index, "BK").collect()}
    assert got == {" BK1090 ": ("BK1090", "code"), "sh600000": ("600000", "digits"), "1090": ("BK1090", "prefix"), "solar": ("600000", "name"), "nk": ("600000", "name"),
        "b": ("600000", "name"), "": (None, None), "zzz": (None, None), "77": ("BK77", "prefix"), None: (None, None)}


def test_alert_events_are_listed(spark):
    stamp = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(f"z{i % 2}", stamp + datetime.timedelta(hours=i), f"k{i}") for i in range(6)],
        "zone_id string, ts timestamp, idempotency_key string")
    assert [r.idempotency_key for r in alerts.list_events(events, "z1", 2).collect()] == ["k5", "k3"]


def test_api_envelope(spark):
    d = "/root/testdata/sf0.001"
    assert len(api.CALLS) == 20
    assert api.call(spark, d, "nothing")["error"]["type"] == "invalid"
    assert api.call(spark, d, "get_kline_local_or_net")["error"]["message"].startswith("missing")
    assert api.call(spark, d, "get_kline_local_or_net", symbol="x")["error"]["type"] == "invalid"
    assert api.call(spark, d, "get_stock_kline_period", symbol=1, period="yearly")["error"]["type"] == "invalid"
    assert api.call(spark, d, "get_stock_kline_period", symbol=1, period="daily", count=7)["meta"]["rows"] == 7
    assert api.call(spark, d, "get_stock_kline_period", symbol=1, period="15")["error"] is None
    assert api.call(spark, d, "find_cross_timeframe_similar_patterns", symbol=1, candidate_scope="galaxy")["error"]["type"] == "invalid"
    ok = api.call(spark, d, "get_kline_local_or_net", symbol=1, days=5)
    assert ok["error"] is None and ok["meta"]["rows"] == 5
    assert api.call(spark, d, "get_key_levels", symbol=1)["data"]
    assert api.call(spark, d, "screen_stocks", conditions={"min_price": 1}, top_n=3)["meta"]["rows"] == 3


def test_quantiles_by_selection(spark):
    """Hot values, missing keys and values, single rows and groups without values, against numpy."""
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=997).round(2).tolist() + [0.1] * 600 + [None] * 9, None: rng.integers(0, 4, 300).astype(float).tolist(), "one": [2.5], "none": [None]}
    frame = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in backtest.quantiles(frame, ["k"], shares).collect()}
    assert set(got) == {"a", None, "one"}
    for k, r in got.items():
        xs = [x for x in data[k] if x is not None]
        assert (r.n, r.kinds) == (len(xs), len(set(xs)))
        assert r.quantiles == pytest.approx(np.quantile(xs, shares).tolist(), abs=1e-12)
    assert backtest.quantiles(frame.limit(0), ["k"], shares).count() == 0


def test_quantiles_cut_alike_in_any_order(spark):
    """Cuts are the same however rows are dealt, and about even, also of more values than any sketch of them holds."""
    counted = spark.range(120_000).select(F.when(F.col("id") < 60_000, "a").alias("k"), F.expr("double(xxhash64(id)) / 1e9").alias("x"), F.lit(2).alias("_c"))
    dealt = [backtest.cut_points(counted.repartition(n, F.hash("x")), ["k"]) for n in (3, 17)]
    first, second = ({r.k: (r["_cuts"], r.n, r.kinds) for r in cuts.collect()} for cuts in dealt)
    assert first == second and {k: v[1:] for k, v in first.items()} == {"a": (120_000, 60_000), None: (120_000, 60_000)}
    for k, (cuts, *_) in first.items():
        xs = np.sort([r.x for r in counted.where(F.col("k").eqNullSafe(F.lit(k))).collect()])
        held = np.diff(np.searchsorted(xs, [-np.inf, *cuts, np.inf]))
        assert len(cuts) == backtest.RANGES - 1 and 300 < held.min() and held.max() < 2000


def test_beam_search_makes_rules_anew(spark):
    """Three rules deep against every extension tried in pandas, on quantiles of each set's own rows."""
    from candela.operators import optimize

    rng = np.random.default_rng(8)
    n = 700
    events = pd.DataFrame({"p": rng.normal(size=n), "q": rng.integers(0, 9, n).astype(float), "kind": rng.choice(["x", "y"], n)})
    events["ret_10"] = 0.3 * events.p - 0.2 * (events.q > 5) + 0.2 * (events.kind == "y") + rng.normal(size=n)
    events.loc[::50, "p"] = np.nan
    front, best = [((), np.ones(n, bool))], []
    for _ in range(3):
        pool = {}
        for rules, kept in front:
            sub = events[kept]
            tried = [(f, op, c, events[f] <= c if op == "<=" else events[f] >= c) for f in ("p", "q") for c in sorted(set(sub[f].quantile([i / 10 for i in range(1, 10)])))
                for op in ("<=", ">=")] + [("kind", "==", v, events.kind == v) for v in sub.kind.value_counts().index]
            for f, op, c, m in tried:
                if 60 <= (kept & m).sum() <= 0.95 * kept.sum():
                    pool[(*rules, (f, op, c))] = kept & m
        front = sorted(pool.items(), key=lambda kv: -(events.ret_10[kv[1]] > 0).mean())[:4]
        best += [(int(m.sum()), (events.ret_10[m] > 0).mean()) for _, m in front]
    frame = spark.createDataFrame(events.astype(object).where(events.notna(), None), "p double, q double, kind string, ret_10 double")
    found = optimize.beam_search(frame, ("p", "q"), ("kind",), depth=3, beam=4, least=60, target=2.0)
    assert [x.n for x in found] == [x for x, _ in best]
    assert [x.win for x in found] == pytest.approx([x for _, x in best])


def test_ordered_alerts_equal_the_ordered_run(spark, tmp_path):
    """Shuffled updates over several micro-batches, late by less than the delay, against one run in order; a silent zone's state goes."""
    rng = np.random.default_rng(4)
    start, rows = datetime.datetime(2024, 3, 4, 9, 30), []
    for zone, at in (("a", 100.0), ("b", 50.0)):
        price = at * np.exp(np.cumsum(rng.normal(0, 0.012, 60)))
        rows += [(zone, start + datetime.timedelta(minutes=i), float(p), float(p * 1.002), float(p * 0.998), bool(i % 3), at, at * 1.01, zone == "b" and i == 50) for i, p in enumerate(price)]
    schema = "zone_id string, ts timestamp, close double, high double, low double, closed boolean, lower double, upper double, invalidated boolean"
    ordered = sorted(rows, key=lambda r: r[1])
    late = sorted(ordered, key=lambda r: (r[1] - start).total_seconds() / 60 + rng.uniform(0, 9))  # out of order, by nine minutes at most
    beyond = [("z", start + datetime.timedelta(days=days), 1.0, 1.0, 1.0, True, 5.0, 6.0, False) for days in (1, 90, 91)]
    for i, part in enumerate([*(late[k : k + 24] for k in range(0, 120, 24)), *([x] for x in beyond)]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(*[str(tmp_path / "in" / "*")])
    got = []
    stream = alerts.ordered_alert_stream(source, "10 minutes").writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation",
        str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert stream.exception() is None
    told = lambda rows: sorted((r.zone_id, r.ts, r.event_type, r.episode, r.confirmed, r.idempotency_key) for r in rows if r.zone_id != "z")
    want = told(alerts.alert_batch(spark.createDataFrame(rows, schema)).collect())
    assert len(want) > 8
    assert told(got) == want
    kept = [o.numRowsTotal for o in stream.lastProgress.stateOperators] if hasattr(stream.lastProgress, "stateOperators") else [o["numRowsTotal"] for o in stream.lastProgress["stateOperators"]]
    assert kept == [1]


def test_merge_rewrites_changed_buckets_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    old = spark.createDataFrame([(k, d, float(k)) for k in range(40) for d in days(3)], "symbol long, date date, close double")
    store.merge_table(old, path, ["symbol", "date"], buckets=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "bars").glob("bucket=*/*.parquet")}
    fresh = spark.createDataFrame([(3, days(3)[0], -1.0, "x"), (3, datetime.date(2021, 3, 9), 9.0, "y"), (None, days(1)[0], 5.0, None)],
        "symbol long, date date, close double, note string")
    store.merge_table(fresh, path, ["symbol", "date"], buckets=8)
    store.merge_table(fresh.limit(0), path, ["symbol", "date"], buckets=8)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "bars").glob("bucket=*/*.parquet")}
    touched = {f.parent.name for f in before if after.get(f) != before[f]}
    assert len(touched) == 1 and len({f.parent for f in before}) > 2
    assert {f.parent.name for f in after} - {f.parent.name for f in before} == {"bucket=-1"}
    whole = spark.read.option("mergeSchema", True).parquet(path)
    want = store.upsert(old, fresh, ["symbol", "date"])
    assert sorted(map(repr, whole.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        store.merge_table(fresh, path, ["date"])


def test_closes_are_rounded_as_the_c_library_rounds_them(spark):
    import math

    from candela.sources import bars as src

    days = [(1, datetime.datetime(2000, 1, 1) + datetime.timedelta(i), float(i % 7), (i * 7 % 11) / 100, 0.02, 1.0) for i in range(400)]
    lines = spark.createDataFrame(days, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double, l_extendedprice double")
    walk, want = 0.0, []
    for day in days:
        walk += (day[3] - 0.05) * 0.6
        want.append(100.0 * math.exp(round(walk, 9)))
    got = [r[0] for r in src.daily_bars(lines).orderBy("date").select("close").collect()]
    assert got == want
    odd = spark.range(3).select(src.exponential(F.when(F.col("id") == 1, F.lit(1e4)).when(F.col("id") == 2, F.lit(-1e4)))).collect()
    assert [r[0] for r in odd] == [None, math.inf, 0.0]


def test_an_answer_of_some_parts_is_that_of_all_without_the_others(spark):
    from candela.operators import snapshot
    from candela.sources import bars as src

    bars = src.bars(spark, "/root/testdata/sf0.001").where("symbol <= 3")
    some = snapshot.compact(snapshot.snapshot(bars, parts=("scales", "confluence_zones")))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapGroupsInPandas" not in plan  # no lines are looked for
    whole = {r["symbol"]: r for r in snapshot.compact(snapshot.snapshot(bars)).select("symbol", "scales", "confluence_zones").collect()}
    for row in some.collect():
        assert (row["scales"], row["confluence_zones"]) == (whole[row["symbol"]]["scales"], whole[row["symbol"]]["confluence_zones"])


def test_frames_to_the_last_bar_start_from_the_last(spark):
    rows = spark.createDataFrame([(1, datetime.date(2000, 1, 1) + datetime.timedelta(i), c) for i, c in enumerate([3.0, 1.0, 2.0])], "symbol long, date date, close double")
    rest = rows.select("date", F.min("close").over(pivots.from_here_on()), F.first("close").over(pivots.from_here_on())).orderBy("date").collect()
    assert [tuple(r)[1:] for r in rest] == [(1.0, 2.0), (1.0, 2.0), (2.0, 2.0)]


def test_levels_round_by_their_product(spark):
    from candela.functions.series import round_product

    got = spark.createDataFrame([(73.695,), (1.25,), (None,)], "x double").select(round_product(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [73.69 if 73.695 * 100 < 7369.5 else 73.7, 1.25, None]


def test_scales_of_one_map(spark):
    """Zigzags and facts of all scales from one grouped map equal windows and folds of each scale; bars without prices are no pivots."""
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in ((1, 200), (2, 7), (3, 6), (4, 90)):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n))).round(2)
        rows += [(symbol, datetime.date(2020, 1, 1) + datetime.timedelta(i), *((None,) * 3 if symbol == 4 and i % 40 == 7 else (float(c) * 1.01, float(c) * 0.99, float(c)))) for i, c in enumerate(close)]
    frame = spark.createDataFrame(rows, "symbol long, date date, high double, low double, close double")
    found = pivots.multiscale(frame)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rest = pivots.from_here_on()
    facts = pivots.with_range(frame).select("symbol", "idx", "atr", F.min("close").over(rest).alias("rest_low"), F.max("close").over(rest).alias("rest_high"),
        F.first("close").over(rest).alias("last_close"), F.first("atr").over(rest).alias("last_atr"), F.first("idx").over(rest).alias("last_idx"))
    want = set()
    for scale, (left, right, swing) in pivots.SCALES.items():
        line = pivots.zigzag(pivots.pivots(frame, left, right), swing).withColumn("scale", F.lit(scale)).join(facts, ["symbol", "idx"])
        want |= {tuple(r) for r in line.select(found.columns).collect()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r[found.columns.index("scale")] for r in got}) == 3


def test_lines_are_broken_where_bars_say(spark):
    """The first piercing bar found some bars at a time is the first of all bars, also beyond the first look and at the last bar."""
    rng = np.random.default_rng(8)
    for n in (1, 33, 34, 400):
        low, atr = 20 + np.cumsum(rng.normal(0, 0.3, n)), np.full(n, 0.4)
        start = rng.integers(0, n, 60)
        price, slope = low[start] - rng.uniform(0, 3, 60), rng.uniform(-0.02, 0.05, 60)
        want = [next((i for i in range(s + 1, n) if low[i] - (p + k * (i - s)) < -0.5 * atr[i]), -1) for s, p, k in zip(start, price, slope, strict=True)]
        assert structure._broken(start, price, slope, 1.0, low, atr).tolist() == want
    points = [Pivot(i, "H", float(x), i) for i, x in enumerate(np.sort(rng.uniform(9, 11, 9)))]
    assert all(structure._middle(points[:k]) == np.median([p.price for p in points[:k]]) for k in range(1, 10))


def test_skeletons_make_no_pairs(spark):
    """What decides a skeleton is found without a join of skeletons and bars; of one bar the wick counts, and old skeletons are left out."""
    close = [10, 9, 10, 11, 10, 9.1, 10, 10.5, 11.5, 8, 8]
    frame = spark.createDataFrame([(1, datetime.date(2020, 1, 1) + datetime.timedelta(i), c, c, c) for i, c in enumerate(map(float, close))],
        "symbol long, date date, high double, low double, close double")
    line = [(1, 1, "L", 9.0, 2, 0), (1, 3, "H", 11.0, 4, 1), (1, 5, "L", 9.1, 6, 2), (1, 8, "H", 11.5, 9, 3)]
    pivot = spark.createDataFrame(line, "symbol long, idx int, typ string, price double, confirm int, ordinal int")
    for monitor, want in ((None, {("w_bottom", "neckline_breakout", 8), ("m_top", "neckline_breakdown", 9)}), (F.lit(1), {("m_top", "neckline_breakdown", 9)})):
        found = pivots.double_patterns(pivot, frame, monitor=monitor)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.pattern, r.status, r.event_idx) for r in found.collect()} == want


def test_scores_round_by_product_and_levels_may_be_left_out(spark):
    """A total that lies at half a hundredth rounds as in the SQL, and signals that have a trend and a level of their own do not meet those near their symbol."""
    fields = "symbol long, pattern string, variant string, trend string, score double, vol_ratio double, resonance int, fib_level string, hit_levels string, key_level_value double, " \
        "right_bottom_price double, neckline_value double, box_high double"
    rows = [(1, "w_bottom", "right_bottom", "down", 0.0, 0.362, 1, "", "", None, 10.0, 11.0, None), (2, "trend_pullback", "near_level", "up", 0.7, 1.1, 2, "", "MA20", 9.5, None, None, None),
        (3, "box_breakout", "box_breakout", "range", 0.7, None, 1, "", "", None, None, None, 12.0), (4, "m_neckline", "neckline_hold", "up", 0.8, 0.5, 1, "", "", None, None, 1.0, None)]
    signals = spark.createDataFrame(rows, fields)
    higher, sectors = spark.createDataFrame([], "symbol long, higher_score double"), spark.createDataFrame([(2, 4.0)], "symbol long, sector_score double")
    near = spark.createDataFrame([(i, "up", 1.0, 2.0) for i in range(5)], "symbol long, level_trend string, near_support double, near_resistance double")
    shown = ("symbol", "stage", "confirmed", "entry_status", "total_score", "invalid_level")
    bare = research.enrich(signals, higher, sectors).select(*shown)
    got = sorted(tuple(r) for r in bare.collect())
    assert got == sorted(tuple(r) for r in research.enrich(signals, higher, sectors, near).select(*shown).collect())
    assert got[0][4] == 1.72 and [r[5] for r in got] == [9.8, 9.5, 12.0, 0.98]
    assert bare._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    plan = patterns.enriched_signals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "previous_high" not in plan


def test_exponential_averages_stay_arrow(spark):
    """Rows of a symbol reach the fold in any order, other columns pass unchanged, and what is not known yet is null, not a number."""
    day = datetime.date(2020, 1, 1)
    rows = [(s, day + datetime.timedelta(i), 10.0 + s, 9.0 - s, 9.5 + (i * 7 % 5) / 4, "x" if i % 2 else None) for s in (1, 2) for i in range(30)]
    frame = spark.createDataFrame(rows[::-1], "symbol long, date date, high double, low double, close double, note string")
    out = ta.exponential_indicators(frame)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.symbol, r.date): r for r in out.collect()}
    assert {tuple(r)[:6] for r in got.values()} == set(rows)
    for s in (1, 2):
        close = np.array([r[4] for r in rows if r[0] == s])
        edge = np.array([np.nan] * 8 + [1.0] * 22)
        for name, values in ta.exponential_columns(close, edge * (10.0 + s), edge * (9.0 - s)).items():
            assert [got[s, day + datetime.timedelta(i)][name] for i in range(30)] == [None if np.isnan(v) else v for v in values]


def test_own_levels_from_one_pass(spark):
    """The same levels and closes as by windows and joins, and one scan of the rows for a query."""
    frame = sources.bars(spark, "/root/testdata/sf0.001")
    line = pivots.zigzag(pivots.pivots(frame))
    parts = levels.average_levels(frame).unionByName(levels.pivot_levels(line))
    key = ("symbol", "name", "value", "distance_pct", "side", "position")
    got = sorted(tuple(r) for r in levels.nearest_to_close(levels.own_levels(frame)).select(*key).collect())
    assert got == sorted(tuple(r) for r in levels.nearest(parts, frame).select(*key).collect()) and got
    assert cohorts.nearest_levels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_outcomes_of_matches_look_at_their_symbols_alone(spark):
    """Windows stay Arrow; what followed matches is told from their symbols' rows, not from all bars."""
    told = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in told(analysis._cross_matches(spark, "/root/testdata/sf0.001"))
    plan = told(analysis.match_horizons(spark, "/root/testdata/sf0.001"))
    assert "FlatMapCoGroups" not in plan and "l_suppkey" in plan
