"""DuckDB SQL that states each query's result independently of Spark."""

from __future__ import annotations

MA = (5, 10, 20, 30, 60, 100, 120, 200, 250)


def full(n: int, agg: str, over: str, prior: bool = False) -> str:
    frame = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if prior else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    w = f"OVER (PARTITION BY symbol ORDER BY date {frame})"
    return f"CASE WHEN count({over}) {w} = {n} THEN {agg} {w} END"


def score_range(v: str, a: float, b: float, lo: float, hi: float) -> str:
    below = f"({v} - {lo}::DOUBLE) / ({a}::DOUBLE - {lo}::DOUBLE)" if a > lo else "0::DOUBLE"
    above = f"({hi}::DOUBLE - {v}) / ({hi}::DOUBLE - {b}::DOUBLE)" if hi > b else "0::DOUBLE"
    return f"coalesce(CASE WHEN {v} BETWEEN {a}::DOUBLE AND {b}::DOUBLE THEN 1::DOUBLE WHEN {v} < {a}::DOUBLE THEN greatest({below}, 0::DOUBLE) ELSE greatest({above}, 0::DOUBLE) END, 0::DOUBLE)"


W = "OVER (PARTITION BY symbol ORDER BY date)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


cte("bars", (), f"""
  SELECT symbol, date, open, greatest(open, close) * (1 + x * 0.2::DOUBLE) AS high, least(open, close) * (1 - x * 0.2::DOUBLE) AS low, close, volume, amount
  FROM (SELECT *, coalesce(lag(close) {W}, 100::DOUBLE) AS open
        FROM (SELECT *, 100::DOUBLE * exp(round(sum((r - 0.05::DOUBLE) * 0.6::DOUBLE) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 9)) AS close
              FROM (SELECT l_suppkey AS symbol, l_shipdate::DATE AS date, sum(l_quantity) AS volume, round(avg(l_discount), 9) AS r, round(avg(l_tax), 9) AS x, sum(l_extendedprice) AS amount
                    FROM lineitem GROUP BY ALL)))""")  # fmt: skip
cte("changed", ("bars",), f"""
  SELECT *, round((close - lag(close) {W}) / nullif(lag(close) {W}, 0) * 100, 9) AS change_rate, (high - low) / nullif(lag(close) {W}, 0) * 100 AS amplitude,
         volume / nullif(sum(volume) OVER (PARTITION BY symbol), 0) * 100 AS turnover FROM bars""")
cte("ind", ("changed",), f"""
  SELECT *, volume / nullif(VOL_MA5, 0) AS VOL_RATIO5, volume / nullif(VOL_MA20, 0) AS VOL_RATIO20, ATR14 / nullif(close, 0) AS ATR_PCT,
         close / nullif(MA20, 0) - 1 AS BIAS20, close / nullif(MA60, 0) - 1 AS BIAS60, close / nullif(MA250, 0) - 1 AS BIAS250,
         {", ".join(f"close / nullif(lag(close, {n}) {W}, 0) - 1 AS RETURN_{n}" for n in (5, 10, 20, 60))},
         {", ".join(f"{full(n, 'max(high)', 'high')} AS HIGH_{n}, {full(n, 'min(low)', 'low')} AS LOW_{n}" for n in (20, 60, 120))}
  FROM (SELECT *, {", ".join(f"{full(n, 'avg(close)', 'close')} AS MA{n}" for n in MA)}, {", ".join(f"{full(n, 'avg(volume)', 'volume')} AS VOL_MA{n}" for n in (5, 10, 20))},
               {full(20, 'avg(close)', 'close')} AS BOLL_MID, {full(20, 'avg(close)', 'close')} + 2 * {full(20, 'stddev_samp(close)', 'close')} AS BOLL_UPPER,
               {full(20, 'avg(close)', 'close')} - 2 * {full(20, 'stddev_samp(close)', 'close')} AS BOLL_LOWER,
               {full(14, 'avg(TR)', 'TR')} AS ATR14
        FROM (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS TR FROM changed))""")
cte("fac", ("ind",), f"""
  SELECT *, {full(20, 'sum((close > open)::INT)', 'close')} / nullif({full(20, 'sum((close < open)::INT)', 'close')}, 0) AS updown_ratio_20,
         {full(20, 'avg(rose)', 'close')} AS up_days_ratio_20, {full(20, 'avg(turnover)', 'turnover')} AS turnover_ma20, volume / nullif(VOL_MA5, 0) AS vol_ratio,
         coalesce(MA5 > MA10 AND MA10 > MA20, false)::INT AS ma_bull, (close - BOLL_LOWER) / nullif(BOLL_UPPER - BOLL_LOWER, 0) AS boll_pos,
         (BOLL_UPPER - BOLL_LOWER) / nullif(BOLL_MID, 0) AS boll_width, close > open AS is_yang, coalesce(close > MA5, false) AS above_ma5,
         coalesce(close > {full(5, 'max(high)', 'high', True)}, false) AS break_high5, coalesce(close > {full(10, 'max(high)', 'high', True)}, false) AS break_high10,
         coalesce(close > {full(40, 'max(close)', 'close', True)}, false) AS break_close40
  FROM (SELECT *, coalesce(close > lag(close) {W}, false)::INT::DOUBLE AS rose FROM ind)""")
cte("basics", (), "SELECT s_suppkey AS symbol, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
cte("members", ("basics",), """
  SELECT 'N' || n_nationkey AS sector_code, n_name AS sector_name, 'industry' AS sector_type, symbol FROM basics JOIN nation ON nation = n_nationkey
  UNION ALL SELECT 'R' || r_regionkey, r_name, 'concept', symbol FROM basics JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("spot", ("changed", "basics"), f"""
  SELECT symbol, name, date AS trade_date, close AS latest_price, change_rate, volume, amount, amplitude, volume / nullif(v5, 0) AS volume_ratio, turnover AS turnover_rate,
         balance / 100 AS pe_dynamic, abs(balance) / 1000 AS pb, close * shares AS total_market_cap, close * shares * 0.7::DOUBLE AS float_market_cap, change_60d, change_ytd
  FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v5, (close / nullif(lag(close, 60) {W}, 0) - 1) * 100 AS change_60d,
               (close / nullif(first(open) OVER (PARTITION BY symbol, year(date) ORDER BY date), 0) - 1) * 100 AS change_ytd, sum(volume) OVER (PARTITION BY symbol) AS shares,
               row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM changed) JOIN basics USING (symbol) WHERE rn = 1""")
cte("ranks", ("bars",), 'SELECT date AS rank_date, symbol, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS rank FROM bars')
cte("sector_bars", ("bars", "members"), """
  SELECT sector_code, date, open, greatest(open, close) * (1 + span / 4) AS high, least(open, close) * (1 - span / 4) AS low, close, volume, amount
  FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY sector_code ORDER BY date), 1000::DOUBLE) AS open
        FROM (SELECT *, 1000::DOUBLE * exp(sum(ln(1 + r)) OVER (PARTITION BY sector_code ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close
              FROM (SELECT sector_code, date, avg(r) AS r, avg(span) AS span, sum(volume) AS volume, sum(amount) AS amount
                    FROM (SELECT *, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1, 0) AS r, (high - low) / nullif(close, 0) AS span FROM bars)
                    JOIN members USING (symbol) GROUP BY ALL)))""")
cte("flows", ("bars",), f"SELECT symbol, date, amount * coalesce(sign(close - lag(close) {W}), 0) AS net_inflow FROM bars")
for _tag, _reach in (("", 5), ("3", 3), ("10", 10)):
    cte(f"pivots{_tag}", ("bars",), f"""
  SELECT symbol, date, idx, typ, price, idx + {_reach} AS confirm FROM (
    SELECT symbol, date, row_number() OVER w0 - 1 AS idx, high, low, max(high) OVER w AS hi, min(low) OVER w AS lo, count(*) OVER w AS n FROM bars
    WINDOW w0 AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {_reach} PRECEDING AND {_reach} FOLLOWING))
  , LATERAL (SELECT 'H' AS typ, high AS price WHERE high = hi UNION ALL SELECT 'L', low WHERE low = lo) WHERE n = {2 * _reach + 1}""")
cte("bars_n", ("bars",), f"""
  SELECT *, row_number() {W} - 1 AS idx, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS atr
  FROM (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM bars)""")
cte("weekly", ("bars",), """
  SELECT symbol, label AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, sum(amount) AS amount, max(date) AS source_date
  FROM (SELECT *, date + ((12 - dayofweek(date)) % 7)::INT AS label FROM bars) GROUP BY symbol, label""")
cte("monthly", ("bars",), """
  SELECT symbol, last_day(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, sum(amount) AS amount, max(date) AS source_date
  FROM bars GROUP BY symbol, last_day(date)""")


def with_ctes(body: str, *needs: str, recursive: str = "") -> str:
    """``body`` preceded by the shared definitions it needs, each once and after its own needs."""
    order: list[str] = []

    def add(name):
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0::DOUBLE AS {c}" for c in columns.split())
