"""Readers of the quote formats that providers deliver, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import lit, ratio

BAR_FIELDS = ("open", "close", "high", "low", "volume", "amount", "amplitude", "change_rate", "change_amount", "turnover")


def number(text: Column) -> Column:
    """A number, or null for what is empty, a dash or no number; per cent signs and thousands commas are dropped."""
    return F.regexp_replace(F.trim(text), "[%,]", "").try_cast("double")


def symbol_code(text: Column) -> Column:
    """The six digits of a code such as sh600000."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), r"(\d{6})", 1), F.lit(""))


def prefixed(text: Column, also_four: bool = False) -> Column:
    """A code with its exchange; two providers disagree on codes that start with 4."""
    code = symbol_code(text)
    first = F.substring(code, 1, 1)
    return F.concat(F.when(first == "6", "sh").when(first.isin("8", "9", *(["4"] if also_four else [])), "bj").otherwise("sz"), code)


def sector_code(text: Column) -> Column:
    digits = F.regexp_extract(F.upper(F.trim(text)), r"(?:BK)?(\d{4})", 1)
    return F.when(digits != "", F.concat(F.lit("BK"), digits))


def comma_bars(frame: DataFrame, line: str = "line") -> DataFrame:
    """date and the fields of "date,open,close,..." lines; short lines are left out."""
    parts = F.split(F.col(line), ",")
    rows = frame.where(F.size(parts) >= len(BAR_FIELDS) + 1)
    return rows.select(*[c for c in frame.columns if c != line], F.trim(parts[0]).alias("date"), *[number(parts[i + 1]).alias(f) for i, f in enumerate(BAR_FIELDS)])


def tilde_quotes(frame: DataFrame, fields: dict[str, int], text: str = "text") -> DataFrame:
    """One row for each quoted record of ``v_code="a~b~c";`` texts, its fields taken by position."""
    records = F.regexp_extract_all(F.col(text), F.lit(r'v_(\w+)="([^"]*)"'), 2)
    codes = F.regexp_extract_all(F.col(text), F.lit(r'v_(\w+)="([^"]*)"'), 1)
    each = frame.select(F.explode(F.arrays_zip(codes.alias("code"), records.alias("record"))).alias("r")).select("r.*")
    return each.select("code", *[F.try_element_at(F.split("record", "~"), F.lit(i + 1)).alias(k) for k, i in fields.items()])


def with_lagged_change(frame: DataFrame) -> DataFrame:
    """change_rate, change_amount and amplitude from the close before; null on a symbol's first row."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return frame.select("*", F.round(ratio(F.col("close") - before, before) * lit(100), 4).alias("change_rate"),
        F.round(F.col("close") - before, 4).alias("change_amount"), F.round(ratio(F.col("high") - F.col("low"), before) * lit(100), 4).alias("amplitude"))


def first_available(*sources: DataFrame, key: str = "symbol") -> DataFrame:
    """Each key's rows from the first source that has any."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)])
    return tagged.withColumn("_best", F.min("priority").over(Window.partitionBy(key))).where("priority = _best").drop("_best")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, label): a page's links, the first of each target."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r'<a href="([^"]*)">([^<]*)</a>'), 1)
    labels = F.regexp_extract_all(F.col("html"), F.lit(r'<a href="([^"]*)">([^<]*)</a>'), 2)
    each = pages.select("page_id", F.posexplode(F.arrays_zip(found.alias("href"), labels.alias("label"))).alias("position", "l")).select("page_id", "position", "l.*")
    return each.groupBy("page_id", "href").agg(F.min("position").alias("position"), F.min_by("label", "position").alias("label"))


def name_variants(frame: DataFrame, column: str = "name", suffix: str = "概念") -> DataFrame:
    """Each name as it is, with and without a suffix, in the order to try them."""
    c = F.col(column)
    forms = F.array_distinct(F.array(c, F.concat(c, F.lit(suffix)), F.regexp_replace(c, f"{suffix}$", "")))
    return frame.select("*", F.posexplode(forms).alias("priority", "variant"))


def resolve(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``wanted(name)`` with the code of the first variant that ``index(name, code)`` knows."""
    found = name_variants(wanted).join(index.select(F.col("name").alias("variant"), "code"), "variant")
    return wanted.join(found.groupBy("name").agg(F.min_by("code", "priority").alias("code")), "name", "left")


#: Longest gram that names are looked up by.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of a text of so many characters."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size))))


def resolve_symbols(queries: DataFrame, index: DataFrame, prefix: str = "") -> DataFrame:
    """``(query, code, name, how)``: what each distinct query of ``queries(query)`` means among ``index(code, name)``.

    In this order: the code itself, the query's digits as a code, the digits after ``prefix`` unless the query begins with
    it, and the smallest code whose name holds the query, whatever the case.  Every step is a join on equal keys: a name
    is found by the query's rarest gram, so a query meets only names that share it.  Empty and unknown queries have nulls.
    """
    asked = queries.select("query").distinct().withColumns({"_text": F.trim("query"), "_digits": F.regexp_replace("query", "[^0-9]", "")})
    steps = [F.struct(F.lit(0).alias("step"), F.col("_text").alias("code")), F.struct(F.lit(1).alias("step"), F.nullif("_digits", F.lit("")).alias("code"))]
    if prefix:
        bare = (F.col("_digits") != "") & ~F.startswith(F.upper("_text"), F.lit(prefix))
        steps.append(F.struct(F.lit(2).alias("step"), F.when(bare, F.concat(F.lit(prefix), "_digits")).alias("code")))
    tried = asked.select("query", F.explode(F.array(*steps)).alias("t")).select("query", "t.*").where("code is not null")
    by_code = tried.join(index, "code").groupBy("query").agg(F.min(F.struct("step", "code", "name")).alias("hit"))
    open_ = asked.join(by_code, "query", "left_anti").select("query", F.lower("_text").alias("low")).where("low <> ''")
    size = F.least(F.length("low"), F.lit(GRAM))
    wanted = open_.select("query", "low", F.explode(_grams(F.col("low"), size)).alias("gram"))
    names = index.select("code", "name", F.lower("name").alias("low_name"))
    held = None
    for n in range(1, GRAM + 1):
        part = names.select("code", F.explode(_grams(F.col("low_name"), F.lit(n))).alias("gram"))
        held = part if held is None else held.unionByName(part)
    known = held.join(wanted.select("gram").distinct(), "gram", "left_semi")
    rarest = wanted.join(known.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left").groupBy("query", "low").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).select("query", "low", "least.gram")
    found = rarest.join(known, "gram").join(names, "code").where(F.contains("low_name", "low"))
    by_name = found.groupBy("query").agg(F.min(F.struct(F.lit(3).alias("step"), "code", "name")).alias("hit"))
    how = F.element_at(F.array(*map(F.lit, ("code", "digits", "prefix", "name"))), F.col("hit.step") + 1)
    told = by_code.unionByName(by_name).select("query", "hit.code", "hit.name", how.alias("how"))
    return asked.select("query").join(told, "query", "left")


def percent_rows(frame: DataFrame, line: str = "fields") -> DataFrame:
    """Rows [date, open, close, change, per cent, low, high, volume, amount in ten thousands, turnover] of text fields by symbol.

    Short rows and rows without a close are left out.  The amplitude is of the close before, on a symbol's first row of
    the close less its change.
    """
    field = lambda i: number(F.try_element_at(line, F.lit(i + 1)))
    rows = frame.where(F.size(line) >= 9).select(
        "symbol", F.to_date(F.element_at(line, 1)).alias("date"), field(1).alias("open"), field(6).alias("high"), field(5).alias("low"),
        field(2).alias("close"), field(7).alias("volume"), (field(8) * lit(10_000)).alias("amount"),
        field(4).alias("change_rate"), field(3).alias("change_amount"), field(9).alias("turnover"),
    ).where("close is not null")
    before = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("date")), F.col("close") - F.col("change_amount"))
    return rows.withColumn("amplitude", F.round(ratio(F.col("high") - F.col("low"), before) * lit(100), 4))


def frame_rows(frame: DataFrame) -> DataFrame:
    """Bars whose volume is in single shares and whose turnover is a share: in hundreds and per cent, with change and amplitude."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return frame.select(
        "symbol", "date", "open", "high", "low", "close", (F.col("volume") / lit(100)).alias("volume"), "amount",
        (ratio(F.col("high") - F.col("low"), before) * lit(100)).alias("amplitude"),
        ((ratio(F.col("close"), before) - lit(1)) * lit(100)).alias("change_rate"), (F.col("close") - before).alias("change_amount"),
        (F.col("turnover") * lit(100)).alias("turnover"),
    )


def member_rows(frame: DataFrame) -> DataFrame:
    """Sector members of text fields, those whose code has six digits; volumes in hundreds, amplitude of the settlement."""
    code = F.trim("code")
    n = {c: number(F.col(c)) for c in ("trade", "changepercent", "pricechange", "volume", "amount", "turnoverratio", "high", "low", "open", "settlement", "pb", "per")}
    return frame.where(code.rlike(r"^\d{6}$")).select(
        "sector_code", code.alias("stock_code"), F.trim("name").alias("stock_name"), n["trade"].alias("latest_price"),
        n["changepercent"].alias("change_rate"), n["pricechange"].alias("change_amount"), (n["volume"] / lit(100)).alias("volume"),
        n["amount"].alias("turnover"), n["turnoverratio"].alias("turnover_rate"), n["high"].alias("high"), n["low"].alias("low"),
        n["open"].alias("open_today"), n["settlement"].alias("close_yesterday"), n["pb"].alias("pb"), n["per"].alias("pe_dynamic"),
        F.round(ratio(n["high"] - n["low"], n["settlement"]) * lit(100), 4).alias("amplitude"),
    )


def node_maps(frame: DataFrame, text: str = "text") -> DataFrame:
    """(kind, name, node) of scripts ``var x = {"node": "id,name,..."}``; of nodes with one name the first in the script counts."""
    body = F.regexp_extract(F.col(text), r"(?s)=\s*(\{.*\})", 1)
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    each = frame.select("kind", F.posexplode(entries).alias("position", "e")).select("kind", "position", F.col("e.key").alias("node"),
        F.trim(F.try_element_at(F.split("e.value", ","), F.lit(2))).alias("name"))
    return each.where("name <> ''").groupBy("kind", "name").agg(F.min_by("node", "position").alias("node"))


def enriched(members: DataFrame, quotes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Members with the fields of their quotes, joined on the bare code; members without a quote stay."""
    return members.join(quotes.select(symbol_code(F.col("code")).alias("stock_code"), *fields), "stock_code", "left")


def renamed(frame: DataFrame, names: dict[str, str], newest_first: bool = True) -> DataFrame:
    """Columns under the engine's names; what the map lacks keeps its own."""
    out = frame.select(*[F.col(c).alias(names.get(c, c)) for c in frame.columns])
    return out.orderBy(F.desc("date")) if newest_first and "date" in out.columns else out


def pattern_names(text: str, known: dict[str, str]) -> list[str]:
    """Patterns named in a comma-separated text, by key or by part of their title, each once in the order given."""
    out = [k for part in text.split(",") if part.strip() for k, title in known.items() if part.strip() in (k, title) or part.strip() in title]
    return list(dict.fromkeys(out))


def rank_history(frame: DataFrame, key: str, text: str = "payload") -> DataFrame:
    """(symbol, date, rank) of encrypted histories: base64 of initial vector and AES-CBC text of [{"calcTime": ..., "rank": ...}, ...]."""
    plain = F.aes_decrypt(F.unbase64(text), F.lit(key.encode()), F.lit("CBC"), F.lit("PKCS")).cast("string")
    each = frame.select("symbol", F.explode(F.from_json(plain, "array<struct<calcTime:string,rank:int>>")).alias("r"))
    return each.select("symbol", F.to_date(F.substring("r.calcTime", 1, 10)).alias("date"), "r.rank")
