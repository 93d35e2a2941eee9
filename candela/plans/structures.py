"""Queries over structure snapshots: the parts of one answer a symbol, each checked by SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.series import lit, rounded
from candela.operators import snapshot, structure
from candela.operators import pivots as pv
from candela.plans.analysis import _SCALED
from candela.plans.oracle import with_ctes
from candela.plans.registry import query
from candela.sources import bars as src

_UNION = " UNION ALL ".join(f"SELECT '{k}' AS scale, * FROM {{0}}_{k}" for k in pv.SCALES)
_POSITIONS = f"""{_SCALED},
 lines3 AS ({_UNION.format('line')}), legs3 AS (SELECT * FROM (SELECT scale, symbol, ordinal, idx AS start_idx, typ AS start_typ, price AS start_price, lead(idx) OVER w AS end_idx, lead(typ) OVER w AS end_typ,
   lead(price) OVER w AS end_price, lead(confirm) OVER w AS confirm FROM lines3 WINDOW w AS (PARTITION BY scale, symbol ORDER BY ordinal)) WHERE end_idx IS NOT NULL),
 last3 AS (SELECT symbol, max(idx) AS last_idx, arg_max(close, idx) AS last_close, arg_max(atr, idx) AS last_atr FROM bars_n GROUP BY symbol),
 moves3 AS (SELECT l.*, end_price - start_price AS move, CASE WHEN end_price > start_price THEN 'up' ELSE 'down' END AS direction, end_idx - start_idx AS bars,
   round(abs(end_price - start_price) / CASE WHEN b.atr > 0 THEN b.atr END, 6) AS atr_move,
   'leg_' || substr(sha1(printf('%s:%d:%s:%.8f:%d:%s:%.8f', scale, start_idx, start_typ, start_price, end_idx, end_typ, end_price)), 1, 16) AS leg_id
   FROM legs3 l LEFT JOIN bars_n b ON b.symbol = l.symbol AND b.idx = l.end_idx),
 anchors3 AS (SELECT *, 'anchor_' || substr(sha1(leg_id || ':fib-anchor'), 1, 16) AS anchor_id, round(1 / position, 6) AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol, scale ORDER BY coalesce(atr_move, abs(end_price / start_price - 1) * 100) DESC, bars DESC, end_idx DESC, leg_id) AS position
   FROM moves3 WHERE bars >= 3 AND (atr_move IS NULL OR atr_move >= 1)) WHERE position <= 5),
 zones3 AS (SELECT symbol, scale, anchor_id, position, leg_id, ratio, start_price, end_price, round(end_price - ratio * move, 8) AS center,
   round(end_price - ratio * move - reach, 8) AS lower, round(end_price - ratio * move + reach, 8) AS upper,
   'fib_' || substr(sha1(anchor_id || ':retracement:' || printf('%.6f', ratio)), 1, 16) AS id
   FROM (SELECT *, greatest(abs(last_atr) * 0.15::DOUBLE, 0.01::DOUBLE) AS reach FROM anchors3 JOIN last3 USING (symbol)),
        (SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786, 1]::DOUBLE[]) AS ratio))"""
_CLUSTERS = f"""{_POSITIONS},
 zn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY center, lower, upper, leg_id, id) AS k FROM zones3),
 fold(symbol, k, low, high, no) AS (SELECT symbol, k, lower, upper, 1 FROM zn WHERE k = 1 UNION ALL
   SELECT symbol, k, CASE WHEN joins THEN least(low, lower) ELSE lower END, CASE WHEN joins THEN greatest(high, upper) ELSE upper END, no + CASE WHEN joins THEN 0 ELSE 1 END
   FROM (SELECT z.symbol, z.k, z.lower, z.upper, f.low, f.high, f.no, (z.lower <= f.high AND z.upper >= f.low) OR ((z.center - f.high) / greatest(abs((f.low + f.high) / 2), 1e-12::DOUBLE)
          <= 0.01::DOUBLE AND (greatest(f.high, z.upper) - f.low) / greatest(abs((f.low + f.high) / 2), 1e-12::DOUBLE) <= 0.02::DOUBLE) AS joins
         FROM fold f JOIN zn z ON z.symbol = f.symbol AND z.k = f.k + 1)),
 clustered AS (SELECT zn.*, no FROM zn JOIN fold USING (symbol, k)),
 clusters3 AS (SELECT symbol, no, min(lower) AS lower, max(upper) AS upper, count(*)::INT AS levels, count(DISTINCT leg_id)::INT AS dependencies,
   round(least(1, 0.25::DOUBLE * count(DISTINCT leg_id) + 0.1::DOUBLE), 4) AS score, string_agg(id, ',' ORDER BY k) FILTER (position <= 3) AS refs
   FROM clustered GROUP BY symbol, no)"""
_NEEDS = ("pivots", "pivots3", "pivots10", "bars_n")


def _full(spark, d, *parts):
    return snapshot.snapshot(src.bars(spark, d), parts=parts or snapshot.PARTS)


def _scales(spark, d):
    return snapshot.scale_positions(src.bars(spark, d))


@query(with_ctes("SELECT symbol, scale, position, anchor_id, leg_id, start_idx AS a_idx, end_idx AS b_idx, direction, confirm AS confirmed_at_idx, rank FROM anchors3", *_NEEDS,
    recursive=_POSITIONS))
def structure_anchors(spark, d):
    """The largest legs of each scale."""
    a = _scales(spark, d).select("symbol", "scale", F.explode("anchors").alias("a"))
    return a.select("symbol", "scale", "a.position", "a.anchor_id", F.col("a.dependency_group").alias("leg_id"), "a.a_idx", "a.b_idx", "a.direction",
        "a.confirmed_at_idx", "a.rank")


@query(with_ctes("""SELECT symbol, scale, anchor_id, round(retracement, 8) AS retracement_ratio, round(position_, 8) AS position_ratio, CASE WHEN retracement > 1 THEN 'over_retraced'
  WHEN deepest > 0 AND position_ > 1 THEN 'resumed' WHEN deepest > 0 AND retracement <= 0 THEN 'retracement_confirming' WHEN deepest > 0 THEN 'retracing' ELSE 'impulse' END AS phase
  FROM (SELECT a.symbol, a.scale, a.anchor_id, (a.end_price - last_close) / a.move AS retracement, (last_close - a.start_price) / a.move AS position_,
          max((a.end_price - b.close) / a.move) AS deepest
        FROM anchors3 a JOIN bars_n b ON b.symbol = a.symbol AND b.idx >= a.end_idx JOIN last3 l ON l.symbol = a.symbol GROUP BY ALL)""", *_NEEDS, recursive=_POSITIONS))
def structure_retracements(spark, d):
    """Where the price stands in each anchor's move."""
    a = _scales(spark, d).select("symbol", "scale", F.explode("retracements").alias("a"))
    return a.select("symbol", "scale", "a.anchor_id", "a.retracement_ratio", "a.position_ratio", "a.phase")


@query(with_ctes("""SELECT a.symbol, a.scale, a.anchor_id, n.end_idx AS c_idx, round((last_close - n.end_price) / a.move, 8) AS projection_ratio, multiple,
  round(n.end_price + multiple * a.move, 8) AS price FROM anchors3 a JOIN (SELECT symbol, scale, start_idx, arg_max(end_idx, ordinal) AS end_idx, arg_max(end_price, ordinal) AS end_price
    FROM legs3 GROUP BY ALL) n ON n.symbol = a.symbol AND n.scale = a.scale AND n.start_idx = a.end_idx
  JOIN last3 l ON l.symbol = a.symbol, (SELECT unnest([1, 1.272, 1.618, 2, 2.618]::DOUBLE[]) AS multiple)""", *_NEEDS, recursive=_POSITIONS))
def structure_projections(spark, d):
    """Where each anchor's move would lead from the end of the leg after it."""
    a = _scales(spark, d).select("symbol", "scale", F.explode("projections").alias("a")).select("symbol", "scale", "a.*").withColumn("t", F.explode("targets"))
    return a.select("symbol", "scale", "anchor_id", "c_idx", "projection_ratio", "t.multiple", "t.price")


@query(with_ctes("SELECT symbol, scale, anchor_id, id, ratio, center, lower, upper FROM zones3", *_NEEDS,
    recursive=_POSITIONS))
def structure_zones(spark, d):
    """Retracement zones of all anchors."""
    a = _scales(spark, d).select("symbol", "scale", F.explode("zones").alias("a"))
    return a.select("symbol", "scale", "a.anchor_id", "a.id", "a.ratio", "a.center", "a.lower", "a.upper")


@query(with_ctes("SELECT symbol, no, lower, upper, levels, dependencies, score FROM clusters3", *_NEEDS, recursive=_CLUSTERS))
def structure_clusters(spark, d):
    """Zones where levels of the anchors of all scales meet."""
    return snapshot.clusters(_scales(spark, d)).select("symbol", "no", "lower", "upper", "levels",
        F.size("dependency_groups").alias("dependencies"), "score")


@query(with_ctes("""SELECT symbol, position, lower, upper, score, refs FROM (
  SELECT c.*, row_number() OVER (PARTITION BY symbol ORDER BY abs((lower + upper) / 2 - last_close), score DESC, lower, upper) AS position
  FROM clusters3 c JOIN last3 USING (symbol) WHERE refs IS NOT NULL) WHERE position <= 12""", *_NEEDS, recursive=_CLUSTERS))
def compact_clusters(spark, d):
    """The zones nearest to each symbol's price that stem from an anchor shown, with the levels that do."""
    z = snapshot.compact(_full(spark, d, "scales", "confluence_zones")).select("symbol", F.posexplode("confluence_zones").alias("position", "z"))
    return z.select("symbol", (F.col("position") + 1).alias("position"), "z.lower", "z.upper", "z.score",
        F.array_join(F.transform("z.source_refs", lambda x: x["id"]), ",").alias("refs"))


_WATCHED = f"""{_SCALED}, lines3 AS ({_UNION.format('line')}),
 triples3 AS (SELECT *, CASE WHEN typ = 'L' THEN mid_price / least(left_price, right_price) - 1 ELSE 1 - mid_price / greatest(left_price, right_price) END AS depth,
   abs(right_price - left_price) / abs(left_price) AS deviation
   FROM (SELECT scale, symbol, typ, idx AS left_idx, price AS left_price, lead(idx) OVER w AS mid_idx, lead(price) OVER w AS mid_price, lead(idx, 2) OVER w AS right_idx,
                lead(price, 2) OVER w AS right_price, lead(confirm, 2) OVER w AS confirm FROM lines3 WINDOW w AS (PARTITION BY scale, symbol ORDER BY ordinal))
   WHERE right_idx IS NOT NULL),
 events3 AS (SELECT scale, symbol, typ, left_idx, right_idx, min(n.idx) AS event_idx, arg_min(failed, n.idx) AS failed FROM (
     SELECT t.scale, t.symbol, t.typ, t.left_idx, t.right_idx, n.idx,
       CASE WHEN t.typ = 'L' THEN low < least(t.left_price, t.right_price) * (1 - 0.03::DOUBLE) ELSE high > greatest(t.left_price, t.right_price) * (1 + 0.03::DOUBLE) END AS failed,
       CASE WHEN t.typ = 'L' THEN close > t.mid_price * (1 + 0.01::DOUBLE) ELSE close < t.mid_price * (1 - 0.01::DOUBLE) END AS broke
     FROM triples3 t JOIN bars_n n ON n.symbol = t.symbol AND n.idx >= t.confirm) n WHERE n.failed OR n.broke GROUP BY ALL)"""


@query(with_ctes("""SELECT t.symbol, t.scale, CASE WHEN t.typ = 'L' THEN 'w_bottom' ELSE 'm_top' END AS pattern, t.left_idx, mid_idx, t.right_idx, round(deviation, 6) AS deviation,
  round(depth, 6) AS depth, CASE WHEN e.failed THEN 'invalidated' WHEN e.event_idx IS NULL THEN CASE WHEN t.typ = 'L' THEN 'right_bottom_confirmed' ELSE 'right_top_confirmed' END
  WHEN t.typ = 'L' THEN 'neckline_breakout' ELSE 'neckline_breakdown' END AS status, event_idx
  FROM triples3 t JOIN (SELECT symbol, max(idx) AS last_idx FROM bars_n GROUP BY symbol) l USING (symbol)
  LEFT JOIN events3 e ON e.scale = t.scale AND e.typ = t.typ AND e.symbol = t.symbol AND e.left_idx = t.left_idx AND e.right_idx = t.right_idx
  WHERE deviation <= 0.10::DOUBLE AND depth >= 0.05::DOUBLE AND last_idx - confirm <= CASE t.scale WHEN 'fine' THEN 120 WHEN 'medium' THEN 250 ELSE 750 END""",
    "pivots", "pivots3", "pivots10", "bars_n", recursive=_WATCHED))
def structure_patterns(spark, d):
    """W and M skeletons of all scales that are still watched, and what became of them."""
    return snapshot.scale_patterns(src.bars(spark, d)).select("symbol", "scale", "pattern", "left_idx", "mid_idx", "right_idx", *rounded(["deviation", "depth"]),
        "status", "event_idx")


@query(with_ctes("""SELECT symbol, last_idx AS as_of_idx, coalesce(s.n, 0)::INT AS scales, coalesce(p.n, 0)::INT AS pivots, coalesce(g.n, 0)::INT AS legs, coalesce(a.n, 0)::INT AS anchors,
  coalesce(a.n, 0)::INT AS retracements, coalesce(z.n, 0)::INT AS zones, coalesce(c.n, 0)::INT AS confluence_zones
  FROM last3 LEFT JOIN (SELECT symbol, count(DISTINCT scale) AS n FROM lines3 GROUP BY symbol) s USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS n FROM lines3 GROUP BY symbol) p USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM legs3 GROUP BY symbol) g USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS n FROM anchors3 GROUP BY symbol) a USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM zones3 GROUP BY symbol) z USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS n FROM clusters3 GROUP BY symbol) c USING (symbol)""", *_NEEDS, recursive=_CLUSTERS))
def structure_counts(spark, d):
    """How much of each part a symbol's compact answer stands for."""
    rows = snapshot.compact(_full(spark, d, "scales", "confluence_zones"))

    def total(field):
        return F.aggregate("scales", F.lit(0), lambda n, s: n + s[field])

    return rows.select("symbol", "as_of_idx", F.size("scales").alias("scales"), total("pivot_count").alias("pivots"), total("leg_count").alias("legs"), "counts.anchors",
        "counts.retracements", "counts.zones", "counts.confluence_zones")


@query()
def structure_snapshot(spark, d):
    """The compact answer of every symbol, nested."""
    return snapshot.compact(_full(spark, d))


_SIMPLE = """lines_ AS (SELECT * FROM (SELECT symbol, typ, idx AS start_idx, price AS start_price, lead(idx) OVER w AS end_idx, lead(price) OVER w AS end_price, lead(idx, 2) OVER w AS third
    FROM pivots WINDOW w AS (PARTITION BY symbol, typ ORDER BY idx)) WHERE third IS NOT NULL),
 faulty AS (SELECT *, (end_price - start_price) / (end_idx - start_idx) AS slope, start_idx % 5 = 0 AS lacks FROM lines_),
 wicked AS (SELECT n.*, CASE WHEN idx % 40 = 39 THEN low - 3 * atr ELSE low END AS low_, CASE WHEN idx % 40 = 39 THEN high + 3 * atr ELSE high END AS high_ FROM bars_n n),
 ranged AS (SELECT *, avg(tr_) OVER (PARTITION BY symbol ORDER BY idx ROWS 13 PRECEDING) AS atr_ FROM (
    SELECT *, greatest(high_ - low_, abs(high_ - lag(close) OVER (PARTITION BY symbol ORDER BY idx)), abs(low_ - lag(close) OVER (PARTITION BY symbol ORDER BY idx))) AS tr_ FROM wicked))"""


@query(with_ctes("""SELECT symbol, typ || ':' || start_idx AS id, 'no_third_touch' AS reason, NULL::BIGINT AS idx FROM faulty WHERE lacks
  UNION ALL SELECT f.symbol, typ || ':' || start_idx, 'wick_crossing', min(idx) FROM faulty f JOIN ranged r ON r.symbol = f.symbol AND r.idx > f.start_idx AND NOT lacks
    AND CASE WHEN typ = 'L' THEN low_ < start_price + slope * (idx - start_idx) - 0.5::DOUBLE * atr_ ELSE high_ > start_price + slope * (idx - start_idx) + 0.5::DOUBLE * atr_ END
  GROUP BY ALL""", "pivots", "bars_n", recursive=_SIMPLE))
def structure_audit(spark, d):
    """Faults of lines through three neighbouring lows or highs, of which some lack a touch, over bars some of which have wicks added."""
    from pyspark.sql import Window

    frame = src.bars(spark, d)
    w = Window.partitionBy("symbol", "typ").orderBy("idx")
    at = pv.pivots(frame).select("symbol", "typ", F.col("idx").alias("start_idx"), F.col("price").alias("start_price"), F.lead("idx").over(w).alias("end_idx"),
        F.lead("price").over(w).alias("end_price"), F.lead("idx", 2).over(w).alias("third")).where("third is not null")
    lines = at.select("symbol", F.lit("medium").alias("scale"), F.lit("trendline").alias("kind"), F.concat_ws(":", "typ", "start_idx").alias("id"),
        F.when(F.col("typ") == "L", "support").otherwise("resistance").alias("role"), F.lit("confirmed").alias("status"), "start_idx", "end_idx", "start_price",
        ((F.col("end_price") - F.col("start_price")) / (F.col("end_idx") - F.col("start_idx"))).alias("slope"), F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"), F.col("third").alias("confirm_idx"),
        F.when(F.col("start_idx") % 5 == 0, F.array("start_idx", "end_idx")).otherwise(F.array("start_idx", "end_idx", "third")).alias("touches"))
    hit = F.col("idx") % 40 == 39
    wicked = pv.with_range(frame).withColumns({"low": F.when(hit, F.col("low") - lit(3) * F.col("atr")).otherwise(F.col("low")),
        "high": F.when(hit, F.col("high") + lit(3) * F.col("atr")).otherwise(F.col("high"))}).drop("idx", "atr")
    return structure.audit(lines, wicked).select("symbol", "id", "reason", F.col("idx").cast("long").alias("idx"))


@query(with_ctes("""SELECT symbol, scale, anchor_id, ratio, round(center + 0.01::DOUBLE, 8) AS level, center AS expected FROM zones3
  WHERE ratio = 0.5::DOUBLE AND position = 1""", *_NEEDS, recursive=_POSITIONS))
def zone_audit(spark, d):
    """Zones that are not where their anchor puts them: the middle ones of the first anchors, moved by a tick."""
    rows = _scales(spark, d)
    anchors = rows.select("symbol", "scale", F.explode("anchors").alias("a")).select("symbol", "scale", "a.anchor_id", "a.position",
        F.col("a.a_price").alias("start_price"), F.col("a.b_price").alias("end_price"))
    zones = rows.select("symbol", "scale", F.explode("zones").alias("z")).select("symbol", "scale", "z.anchor_id", "z.ratio", F.col("z.center").alias("level"))
    moved = zones.join(anchors.select("symbol", "scale", "anchor_id", "position"), ["symbol", "scale", "anchor_id"])
    moved = moved.withColumn("level", F.when((F.col("ratio") == lit(0.5)) & (F.col("position") == 1), F.col("level") + lit(0.01)).otherwise(F.col("level"))).drop("position")
    return structure.audit_zones(moved, anchors).select("symbol", "scale", "anchor_id", "ratio", F.round("level", 8).alias("level"), "expected")
