"""One nested answer a symbol: its structures on every scale, where its price stands in them, and what of it to show.

The zigzags come from one pass over the bars; legs, anchors, retracements, projections and zones follow from each
scale's array of pivots by array functions, so nothing is joined on the way.  A symbol's arrays are bounded by its bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import lit
from candela.operators import pivots as pv
from candela.operators import structure

#: Bars after its confirmation that a W or M skeleton is watched for, by scale.
MONITOR = {"fine": 120, "medium": 250, "coarse": 750}
FAMILY = "fibonacci_same_swing"
#: What a compact answer carries: recent pivots and legs, lines of a scale and role, channels, ranges and anchors of a scale, zones.
RECENT, PER_ROLE, PER_SCALE, NEAREST = 20, 2, 3, 12
ANCHORS = 5
#: Arrays of an answer; a caller may ask for some of them.
PARTS = ("scales", "trendlines", "channels", "ranges", "double_patterns", "confluence_zones")


def _id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text.cast("binary")), 1, 16))


def cut(bars: DataFrame, as_of: DataFrame | None) -> DataFrame:
    """Bars up to each symbol's bar of ``as_of(symbol, as_of_idx)``, all without it; a symbol that it lacks has none."""
    if as_of is None:
        return bars
    return pv.numbered(bars).join(as_of.select("symbol", "as_of_idx"), "symbol").where("idx <= as_of_idx").select(bars.columns)


def _anchors(legs: Column) -> Column:
    """The largest of the legs that are long enough, ranked: those of the first places are shown first."""
    eligible = F.filter(legs, lambda x: (x["bars"] >= pv.LEAST_BARS) & (x["atr_move"].isNull() | (x["atr_move"] >= lit(pv.LEAST_MOVE))))
    keyed = F.transform(eligible, lambda x: F.struct((-F.coalesce(x["atr_move"], F.abs(x["pct"]) * 100)).alias("size"), (-x["bars"]).alias("bars"),
        (-x["end_idx"]).alias("end"), x["leg_id"].alias("id"), x.alias("leg")))
    best = F.slice(F.array_sort(keyed), 1, ANCHORS)
    return F.transform(best, lambda x, i: F.struct((i + 1).alias("position"), _id("anchor_", F.concat(x["id"], F.lit(":fib-anchor"))).alias("anchor_id"),
        F.round(lit(1) / (i + 1), 6).alias("rank"), x["leg"]["start_idx"].alias("a_idx"), x["leg"]["start_price"].alias("a_price"), x["leg"]["end_idx"].alias("b_idx"),
        x["leg"]["end_price"].alias("b_price"), x["leg"]["direction"].alias("direction"), x["leg"]["confirm"].alias("confirmed_at_idx"), x["id"].alias("dependency_group"),
        x["leg"]["rest_low"].alias("rest_low"), x["leg"]["rest_high"].alias("rest_high")))


def _retracements(anchors: Column, price: Column) -> Column:
    def one(a: Column) -> Column:
        move = a["b_price"] - a["a_price"]
        back, position = (a["b_price"] - price) / move, (price - a["a_price"]) / move
        deepest = (a["b_price"] - F.when(move > 0, a["rest_low"]).otherwise(a["rest_high"])) / move
        return F.struct(a["anchor_id"].alias("anchor_id"), a["direction"].alias("direction"), F.round(back, 8).alias("retracement_ratio"),
            F.round(position, 8).alias("position_ratio"), pv.phase_of(back, deepest, position).alias("phase"))

    return F.transform(anchors, one)


def _projections(anchors: Column, legs: Column, price: Column) -> Column:
    """Of the anchors after which another leg is known, where their move would lead from its end."""

    def one(a: Column) -> Column:
        after = F.try_element_at(F.filter(legs, lambda x: x["start_idx"] == a["b_idx"]), F.lit(-1))
        move, c = a["b_price"] - a["a_price"], after["end_price"]
        targets = F.array(*[F.struct(lit(x).alias("multiple"), F.round(c + lit(x) * move, 8).alias("price")) for x in pv.PROJECTIONS])
        return F.struct(a["anchor_id"].alias("anchor_id"), after["end_idx"].alias("c_idx"), c.alias("c_price"), F.round((price - c) / move,
            8).alias("projection_ratio"), targets.alias("targets"))

    return F.filter(F.transform(anchors, one), lambda x: x["c_idx"].isNotNull())


def _zones(anchors: Column, last_atr: Column) -> Column:
    reach = F.greatest(F.abs(last_atr) * lit(pv.ZONE_RANGES), lit(pv.TICK))

    def one(a: Column) -> Column:
        def level(x: float) -> Column:
            center = a["b_price"] - lit(x) * (a["b_price"] - a["a_price"])
            return F.struct(F.round(center, 8).alias("center"), F.round(center - reach, 8).alias("lower"), F.round(center + reach, 8).alias("upper"),
                F.lit(FAMILY).alias("family"), a["dependency_group"].alias("dependency"),
                _id("fib_", F.concat(a["anchor_id"], F.lit(f":retracement:{x:.6f}"))).alias("id"), a["anchor_id"].alias("anchor_id"), lit(x).alias("ratio"))

        return F.array(*map(level, pv.FIB_RATIOS))

    return F.flatten(F.transform(anchors, one))


def scale_positions(bars: DataFrame) -> DataFrame:
    """(symbol, scale, last_idx, last_close, pivots, legs, anchors, retracements, projections, zones): a row for each scale with a pivot."""
    w = Window.partitionBy("symbol", "scale").orderBy("ordinal")
    ahead = {c: F.lead(c).over(w) for c in ("idx", "typ", "price", "confirm", "atr", "rest_low", "rest_high")}
    rows = pv.multiscale(bars).select("*", *[c.alias(f"end_{k}") for k, c in ahead.items()])
    name = F.format_string("%s:%d:%s:%.8f:%d:%s:%.8f", "scale", "idx", "typ", "price", "end_idx", "end_typ", "end_price")
    move = F.col("end_price") - F.col("price")
    leg = F.struct(
        F.col("ordinal").alias("ordinal"), _id("leg_", name).alias("leg_id"), F.col("idx").alias("start_idx"), F.col("price").alias("start_price"), "end_idx",
        "end_price", F.when(move > 0, "up").otherwise("down").alias("direction"), (F.col("end_price") / F.col("price") - lit(1)).alias("pct"),
        (F.col("end_idx") - F.col("idx")).alias("bars"), F.round(F.abs(move) / F.when(F.col("end_atr") > 0, F.col("end_atr")), 6).alias("atr_move"),
        F.col("end_confirm").alias("confirm"), F.col("end_rest_low").alias("rest_low"), F.col("end_rest_high").alias("rest_high"),
    )
    packed = rows.groupBy("symbol", "scale").agg(
        F.first("last_idx").alias("last_idx"), F.first("last_close").alias("last_close"), F.first("last_atr").alias("last_atr"),
        F.array_sort(F.collect_list(F.struct("ordinal", "idx", F.col("typ").alias("type"), "price", F.col("confirm").alias("confirmed_at_idx")))).alias("pivots"),
        F.array_sort(F.collect_list(F.when(F.col("end_idx").isNotNull(), leg))).alias("legs"),
    )
    out = packed.withColumn("anchors", _anchors(F.col("legs")))
    anchors, legs, price = F.col("anchors"), F.col("legs"), F.col("last_close")
    return out.select("symbol", "scale", "last_idx", "last_close", "pivots", "legs", "anchors", _retracements(anchors, price).alias("retracements"),
        _projections(anchors, legs, price).alias("projections"), _zones(anchors, F.col("last_atr")).alias("zones"))


def clusters(positions: DataFrame) -> DataFrame:
    """Where zones of the anchors of all scales meet; at most 90 of them a symbol."""
    packed = positions.groupBy("symbol").agg(F.flatten(F.collect_list("zones")).alias("levels"))
    return structure.zone_clusters(packed)


def scale_patterns(bars: DataFrame) -> DataFrame:
    """(symbol, scale, ...): W and M skeletons of all scales that are still watched."""
    monitor = F.create_map(*[x for k, n in MONITOR.items() for x in (F.lit(k), F.lit(n))])[F.col("scale")]
    return pv.double_patterns(pv.multiscale(bars), bars, ("symbol", "scale"), monitor)


def _sorted(rows: DataFrame, name: str, order: list[Column], fields: list[str]) -> DataFrame:
    """Rows of each symbol as one array in an order."""
    w = Window.partitionBy("symbol").orderBy(*order)
    numbered = rows.withColumn("_k", F.row_number().over(w))
    packed = numbered.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_k", F.struct(*fields).alias("x")))).alias("_all"))
    return packed.select("symbol", F.transform("_all", lambda r: r["x"]).alias(name))


def snapshot(bars: DataFrame, as_of: DataFrame | None = None, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row a symbol: last bar, scales, trendlines, channels, ranges, double_patterns and confluence_zones as arrays of structs.

    Only the ``parts`` asked for are found and are columns; a join would have to find the others even if nobody looks at them.

    ``scales`` has pivots, legs, anchors, retracements, projections and zones of each scale with a pivot; zones of all scales
    meet in ``confluence_zones``.  With ``as_of(symbol, as_of_idx)`` the answer is that of the bars up to there.
    """
    rows = cut(bars, as_of)
    last = pv.numbered(rows).groupBy("symbol").agg(F.max("idx").alias("as_of_idx"), F.max_by("close", "idx").alias("current_price"))
    order = F.when(F.col("scale") == "fine", 1).when(F.col("scale") == "medium", 2).otherwise(3)
    fields = ["scale", "pivots", "legs", "anchors", "retracements", "projections", "zones"]
    out = last
    if {"scales", "confluence_zones"} & {*parts}:
        positions = scale_positions(rows)
        if "scales" in parts:
            out = out.join(_sorted(positions, "scales", [order], fields), "symbol", "left")
        if "confluence_zones" in parts:
            zones = clusters(positions)
            out = out.join(_sorted(zones, "confluence_zones", [F.col("no")], [c for c in zones.columns if c not in ("symbol", "no")]), "symbol", "left")
    kinds = {n: k for n, k in {"trendlines": ("trendline", "horizontal_level"), "channels": ("channel",), "ranges": ("range",)}.items() if n in parts}
    if kinds:
        best = [order, F.col("status") != "confirmed", F.col("status") == "broken", F.desc("score"), F.desc("end_idx"), F.col("id")]
        names = [f.split()[0] for f in structure.SCHEMA.split(", ") if f.split()[0] != "symbol"]
        w = Window.partitionBy("symbol").orderBy(*best)
        ranked = structure.market_structure(rows).withColumn("_k", F.row_number().over(w)).groupBy("symbol").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind").isin(*k),
            F.struct("_k", F.struct(*names).alias("x"))))).alias(n) for n, k in kinds.items()]).select("symbol", *[F.transform(n, lambda r: r["x"]).alias(n) for n in kinds])
        out = out.join(ranked, "symbol", "left")
    if "double_patterns" in parts:
        found = scale_patterns(rows)
        out = out.join(_sorted(found, "double_patterns", [order, F.col("status") == "invalidated", F.desc(F.round("score", 4)), F.desc("right_idx")],
            [c for c in found.columns if c != "symbol"]), "symbol", "left")
    return out.select(*last.columns, *[c for c in PARTS if c in parts])


def _of(rows: str, field: str, value: str, n: int) -> Column:
    return F.slice(F.filter(rows, lambda x: x[field] == value), 1, n)


def _total(part: str) -> Column:
    return F.aggregate("scales", F.lit(0), lambda n, s: n + F.size(s[part]))


def _lines(kind: str) -> Column:
    """The first lines of a kind in each scale and role."""

    def some(scale: str, role: str) -> Column:
        return F.slice(F.filter("trendlines", lambda x: (x["kind"] == kind) & (x["role"] == role) & (x["scale"] == scale)), 1, PER_ROLE)

    return F.concat(*[some(s, r) for s in pv.SCALES for r in ("support", "resistance")])


def compact(full: DataFrame) -> DataFrame:
    """The rows of ``snapshot``, bounded: what each part had, the best few of it, and the zones nearest to the price.

    Only positions of the anchors shown remain, and of a zone only the sources that stem from them.  ``full`` has its scales;
    of other parts that it lacks the answer has nothing either.
    """
    parts = [c for c in PARTS if c in full.columns]
    rows = full.withColumns({c: F.coalesce(F.col(c), F.array().cast(full.schema[c].dataType)) for c in parts})
    shown = F.flatten(F.transform("scales", lambda s: F.transform(F.slice(s["anchors"], 1, PER_SCALE), lambda a: a["anchor_id"])))
    rows = rows.withColumn("_shown", shown)

    def mine(part: Column) -> Column:
        return F.filter(part, lambda x: F.array_contains(F.col("_shown"), x["anchor_id"]))

    def scale(s: Column) -> Column:
        return F.struct(
            s["scale"].alias("scale"), F.size(s["pivots"]).alias("pivot_count"), F.size(s["legs"]).alias("leg_count"),
            *[F.slice(s[c], F.greatest(F.size(s[c]) - (RECENT - 1), F.lit(1)), RECENT).alias(c) for c in ("pivots", "legs")],
            F.slice(s["anchors"], 1, PER_SCALE).alias("anchors"), *[mine(s[c]).alias(c) for c in ("retracements", "projections", "zones")],
        )

    def refs(z: Column) -> Column:
        return F.transform(mine(z["sources"]), lambda x: F.struct(x["id"].alias("id"), x["anchor_id"].alias("anchor_id"), x["family"].alias("family"),
            x["center"].alias("center")))

    def away(z: Column) -> Column:
        return F.struct(F.abs((z["lower"] + z["upper"]) / lit(2) - F.col("current_price")).alias("away"), (-z["score"]).alias("less"), z["lower"].alias("lower"),
            z["upper"].alias("upper"), z["levels"].alias("levels"), z["dependency_groups"].alias("dependency_groups"), z["families"].alias("families"),
            z["score"].alias("score"), refs(z).alias("source_refs"))

    near = F.filter("confluence_zones", lambda z: F.exists(z["sources"], lambda x: F.array_contains(F.col("_shown"), x["anchor_id"])))
    counts = F.struct(*[F.size(c).alias(c) for c in parts if c != "scales"], *[_total(c).alias(c) for c in ("anchors", "retracements", "projections", "zones")])
    shown_of = {
        "scales": lambda: [F.transform("scales", scale).alias("scales")],
        "trendlines": lambda: [_lines("trendline").alias("trendlines"), _lines("horizontal_level").alias("converted_levels")],
        **{k: lambda k=k: [F.concat(*[_of(k, "scale", s, PER_SCALE) for s in pv.SCALES]).alias(k)] for k in ("channels", "ranges")},
        "double_patterns": lambda: [F.col("double_patterns")],
        "confluence_zones": lambda: [F.slice(F.array_sort(F.transform(near, away)), 1, NEAREST).alias("confluence_zones")],
    }
    return rows.select("symbol", "as_of_idx", "current_price", counts.alias("counts"), *[c for part in parts for c in shown_of[part]()])
