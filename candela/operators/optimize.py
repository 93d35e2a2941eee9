"""Search for filters that raise a pattern's win rate: every candidate of a step is counted in one aggregate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.series import lit
from candela.operators.backtest import factor_values, quantiles

DEPTH, BEAM, LEAST, MOST_SHARE = 4, 6, 100, 0.95


class Rule(NamedTuple):
    field: str
    op: str
    value: float | str

    def mask(self) -> Column:
        c = F.col(self.field)
        found = {"<=": lambda: c <= lit(self.value), ">=": lambda: c >= lit(self.value), "==": lambda: c == self.value,
            "contains": lambda: c.contains(self.value)}[self.op]()
        return F.coalesce(found, F.lit(False))


def mask(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(True)
    for rule in rules:
        out &= rule.mask()
    return out


def decile_rules(events: DataFrame, factors: tuple[str, ...], categories: tuple[str, ...] = (), most: int = 12) -> list[Rule]:
    """Both directions of each distinct decile of each factor with 30 values and 3 distinct ones, and the commonest categories."""
    return node_rules(events, [()], factors, categories, most)[0]


def node_rules(events: DataFrame, nodes: list[tuple[Rule, ...]], factors: tuple[str, ...], categories: tuple[str, ...] = (), most: int = 12) -> list[list[Rule]]:
    """For each rule set the rules that the rows it keeps suggest, as ``decile_rules`` does; all sets in one selection.

    A row comes to the driver for each set and factor, and for each set and common category.
    """
    kept = events.withColumn("_node", F.explode(F.array_compact(F.array(*[F.when(mask(rules), F.lit(i)) for i, rules in enumerate(nodes)]))))
    cuts: dict[tuple[int, str], list[float]] = {}
    for r in quantiles(factor_values(kept, factors, ("_node",)), ["_node", "factor"], [i / 10 for i in range(1, 10)]).collect():
        if r.n >= 30 and r.kinds >= 3:
            cuts[r["_node"], r.factor] = sorted(set(r.quantiles))
    common: dict[tuple[int, str], list[str]] = {}
    if categories:
        each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in categories])
        counts = kept.select("_node", F.explode(each).alias("_c")).select("_node", "_c.*").where("value is not null").groupBy("_node", "field", "value").count()
        top = Window.partitionBy("_node", "field").orderBy(F.desc("count"), "value")
        for r in counts.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= most).orderBy("_rn").collect():
            common.setdefault((r["_node"], r.field), []).append(r.value)
    return [[Rule(f, op, v) for f in factors for v in cuts.get((i, f), ()) for op in ("<=", ">=")] + [Rule(c, "==", v) for c in categories for v in common.get((i, c), ())]
        for i in range(len(nodes))]


def evaluate(events: DataFrame, candidates: list[tuple[Rule, ...]], ret: str = "ret_10") -> list[tuple[int, float | None]]:
    """(n, win rate) of each candidate, from one pass."""
    won = (F.col(ret) > 0).cast("double")
    wanted = [x for i, c in enumerate(candidates) for x in (F.count_if(mask(c)).alias(f"n{i}"), F.avg(F.when(mask(c), won)).alias(f"w{i}"))]
    row = events.where(F.col(ret).isNotNull()).agg(*wanted).first()
    return [(row[f"n{i}"], row[f"w{i}"]) for i in range(len(candidates))]


def evaluate_nodes(events: DataFrame, nodes: list[tuple[Rule, ...]], rules: list[list[Rule]], ret: str = "ret_10") -> dict[tuple[int, Rule], tuple[int, float]]:
    """(n, win rate) of every set extended by each of its rules, from one aggregate.

    Values are counted by where they lie among their factor's cuts, so the counts of all thresholds are running sums; a
    row comes to the driver for each set, factor and place, and for each set and category.
    """
    kept = events.where(F.col(ret).isNotNull()).withColumn("_node", F.explode(F.array_compact(F.array(*[F.when(mask(r), F.lit(i)) for i, r in enumerate(nodes)]))))
    cuts: dict[str, dict[int, list[float]]] = {}
    named: dict[str, set[str]] = {}
    for i, found in enumerate(rules):
        for r in found:
            if r.op == "==":
                named.setdefault(r.field, set()).add(r.value)
            elif r.op == "<=":
                cuts.setdefault(r.field, {}).setdefault(i, []).append(r.value)
    each = []
    for f, by_node in cuts.items():
        ends = F.element_at(F.array(*[F.array(*map(lit, by_node.get(i, []))).cast("array<double>") for i in range(len(nodes))]), F.col("_node") + 1)
        x = F.col(f).cast("double")
        below, upto = F.size(F.filter(ends, _less(x))), F.size(F.filter(ends, _at_most(x)))
        each.append(F.when(x.isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("value"), below.alias("below"), upto.alias("upto"))))
    for c, values in named.items():
        each.append(F.when(F.col(c).isin(sorted(values)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(0).alias("below"), F.lit(0).alias("upto"))))
    if not each:
        return {}
    long = kept.select("_node", (F.col(ret) > 0).cast("long").alias("won"), F.explode(F.array_compact(F.array(*each))).alias("_p")).select("_node", "won", "_p.*")
    counted: dict[tuple[int, str], list] = {}
    for r in long.groupBy("_node", "field", "value", "below", "upto").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w")).collect():
        counted.setdefault((r["_node"], r.field), []).append(r)
    out = {}
    for i, found in enumerate(rules):
        for r in found:
            rows = counted.get((i, r.field), [])
            if r.op == "==":
                mine = [x for x in rows if x.value == r.value]
            else:
                k = cuts[r.field][i].index(r.value)
                mine = [x for x in rows if (x.below <= k if r.op == "<=" else x.upto > k)]
            n = sum(x.n for x in mine)
            if n:
                out[i, r] = (n, sum(x.w for x in mine) / n)
    return out


def _less(x: Column):
    return lambda e: e < x


def _at_most(x: Column):
    return lambda e: e <= x


class Found(NamedTuple):
    rules: tuple[Rule, ...]
    n: int
    win: float


def beam_search(events: DataFrame, factors: tuple[str, ...], categories: tuple[str, ...] = (), depth: int = DEPTH, beam: int = BEAM, least: int = LEAST,
    target: float = 0.8) -> list[Found]:
    """The best rule sets of each depth, found by extending the best so far by the rules their own rows suggest.

    A rule must leave ``least`` events and narrow its set by 5 % at least; equal rates keep the order in which they were
    found.  The search ends once a set reaches ``target``.
    """
    events = events.where("ret_10 is not null").persist()
    try:
        front = [Found((), events.count(), 0.0)]
        best: list[Found] = []
        for _ in range(depth):
            front = [x for x in front if x.n >= least]
            if not front:
                break
            sets = [x.rules for x in front]
            tried = node_rules(events, sets, factors, categories)
            counts = evaluate_nodes(events, sets, tried)
            grown = {(*front[i].rules, r): (i, r) for i, rules in enumerate(tried) for r in rules if (i, r) in counts}
            found = [Found(c, *counts[at]) for c, at in grown.items() if least <= counts[at][0] <= MOST_SHARE * front[at[0]].n]
            front = sorted(found, key=lambda x: -x.win)[:beam]
            best += front
            if not front or front[0].win >= target:
                break
        return best
    finally:
        events.unpersist()


def strict_rules(events: DataFrame, split: str, patterns: list[str], factors: tuple[str, ...], categories: tuple[str, ...] = (), **limits) -> dict[str, tuple[Rule, ...]]:
    """The best rule set of each pattern before ``split``, the larger of equally good ones; patterns without any are left out."""
    early = events.where(F.col("date") < F.lit(split).cast("date"))
    found = {p: beam_search(early.where(F.col("pattern") == p), factors, categories, **limits) for p in patterns}
    return {p: max(sets, key=lambda x: (x.win, x.n)).rules for p, sets in found.items() if sets}


def greedy_filter(events: DataFrame, factors: tuple[str, ...], steps: int = 2, lift: float = 0.005, least: int = 100) -> list[tuple[Rule, int, float]]:
    """Up to ``steps`` thresholds, each the one that lifts the win rate most among the factors' quintile cuts."""
    chosen: list[tuple[Rule, int, float]] = []
    total, base = evaluate(events, [()])[0]
    for _ in range(steps):
        kept = events.where(mask(tuple(r for r, _, _ in chosen)))
        cuts = {r.factor: sorted(set(r.quantiles)) for r in quantiles(factor_values(kept, factors), ["factor"], [0.2, 0.4, 0.6, 0.8]).collect()}
        rules = [Rule(f, op, v) for f in factors if f in cuts for v in cuts[f] for op in ("<=", ">=")]
        scored = [(r, n, w) for r, (n, w) in zip(rules, evaluate(kept, [(r,) for r in rules]),
            strict=True) if w is not None and least <= n <= 0.9 * total and w - base > lift]
        if not scored:
            break
        pick = max(scored, key=lambda x: (x[2], x[1], str(x[0])))
        chosen.append(pick)
        total, base = pick[1], pick[2]
    return chosen


def train_test(events: DataFrame, rule_sets: dict[str, tuple[Rule, ...]], split: str, ret: str = "ret_10", gain: str = "max_gain_10") -> DataFrame:
    """(name, part, n, win, avg, ever_up2, avg_max_gain): outcomes of each rule set before a date, from it on, and in all.

    ``ever_up2`` is the share whose best gain was over 2 %.
    """
    won = (F.col(ret) > 0).cast("double")
    late = F.col("date") >= F.lit(split).cast("date")
    named = [F.when(mask(rules), F.lit(name)) for name, rules in rule_sets.items()]
    held = events.where(F.col(ret).isNotNull()).withColumn("name", F.explode(F.array_compact(F.array(*named))))
    both = held.withColumn("part", F.explode(F.array(F.lit("all"), F.when(late, "test").otherwise("train"))))
    return both.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"), F.avg(won).alias("win"), F.avg(ret).alias("avg"),
        F.avg((F.col(gain) > lit(0.02)).cast("double")).alias("ever_up2"), F.avg(gain).alias("avg_max_gain"))
