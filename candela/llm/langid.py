"""Language identification with interpolated Kneser-Ney character models.

Training counts 4-grams of letters (runs of anything else are one blank) over every labelled row on the executors;
lower orders follow from the 4-gram types, as Kneser-Ney's continuation counts do.  All types are kept.  The models of
all languages share sorted arrays of hashed grams, which are broadcast as long as they are small; beyond that the texts'
grams are joined with the models' tables, to the same result.  A text goes to the language of least cross-entropy per
symbol; it is rejected if that lies beyond what the language's own texts of that length show.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import by_parts, checkpoint, free_names, materialise

ORDER, BITS = 4, 16
#: Probabilities, of all orders and languages, up to which the models are broadcast; they take 8 bytes each.
#: Beyond that the texts' grams meet the shares in joins.  Both ways work in doubles and compare cross-entropies of nine digits, so they agree.
BROADCAST_CELLS = 16_000_000
#: A language with fewer texts of its own has the default bounds.  Medians are exact to one part in so many; smaller values than the least count as it.
LEAST_TEXTS, STEPS, LEAST_VALUE = 20, 10_000, 1e-9
#: So many grams are looked up at once; a worker holds several arrays of them for every language.
AT_ONCE = 60_000
#: Rejection: so many standard errors, and nats per symbol, beyond a language's typical cross-entropy.
SIGMAS, SLACK = 8.0, 0.75
UNKNOWN = "und"
PREDICTION = "lang_pred string, score double, xent double, n_symbols long, rejected boolean"
PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("xent", pa.float64()), ("n_symbols", pa.int64()), ("rejected", pa.bool_())])
_FLUSH, DIGITS = 1_000_000, 9


@lru_cache(1)
def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point of the basic plane, and whether it is a letter.

    Letters, in lower case, and combining marks stand for themselves; anything else is 0.
    """
    table, letter = np.zeros(65536, np.uint64), np.zeros(65536, bool)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            table[cp], letter[cp] = min(ord(c.lower()[0]), 65535), True
        elif unicodedata.category(c)[0] == "M" and not 0xFE00 <= cp <= 0xFE0F:
            table[cp] = cp
    return table, letter


def symbols(text: str | None) -> np.ndarray:
    """Letters of a text as symbols with single blanks between words, blanks around; empty without letters.

    Letters beyond the basic plane share the 2048 numbers that are no characters of it.
    """
    if not text:
        return np.zeros(0, np.uint64)
    table, letter = symbol_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(points, 65535)
    found, some = table[low], bool(letter[low].any())
    for at in np.flatnonzero(points > 65535):
        if chr(points[at]).isalpha():
            found[at], some = 0xD800 + int(points[at]) % 2048, True
    if not some:
        return np.zeros(0, np.uint64)
    keep = found != 0
    keep[1:] |= keep[:-1].copy()  # the first blank after a letter stays
    if found[0] == 0:
        keep[0] = False
    found = found[keep]
    tail = 1 if found[-1] else 0
    return np.concatenate([np.zeros(ORDER - 1, np.uint64), found, np.zeros(tail, np.uint64)])


def grams(text: str | None) -> np.ndarray:
    """Keys of the 4-grams that end at each symbol of the text."""
    s = symbols(text)
    n = len(s) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = s[:n].copy()
    for k in range(1, ORDER):
        key <<= np.uint64(BITS)
        key |= s[k : n + k]
    return key


def _count(batches):
    held: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(lang):
        keys, counts = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        if lang in sums:
            a, b = sums[lang]
            keys, place = np.unique(np.concatenate([a, keys]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([b, counts])).astype(np.int64)
        sums[lang] = keys, counts

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = grams(text.as_py())
            if len(found):
                held.setdefault(lang, []).append(found)
                if sum(map(len, held[lang])) > _FLUSH if len(held[lang]) % 64 == 0 else len(found) > _FLUSH:
                    flush(lang)
    for lang in list(held):
        flush(lang)
    for lang, (keys, counts) in sums.items():
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)),
                pa.array(counts[at : at + 100_000].astype(np.int64))], ["lang", "gram", "n"])


class HashArray:
    """Distinct keys in ascending order of their hash, with an index of where each hash prefix starts."""

    def __init__(self, keys: np.ndarray):
        hashed = self._hash(keys)
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.first = np.searchsorted(self.hashed >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def _hash(keys):
        return keys * np.uint64(0x9E3779B97F4A7C15)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for those that are missing."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashed):
            return out
        h = self._hash(keys)
        prefix = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[prefix], self.first[prefix + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hashed[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            todo, at, end, h = todo[more], at[more], end[more], h[more]
        return out


class Model:
    """Interpolated Kneser-Ney models of several languages over shared hash arrays.

    Made of ``(language, key, discounted share of its context)`` for each order; what shares leave of 1 goes to back-off.
    """

    def __init__(self, langs: list[str], shares: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, width = list(langs), len(langs)
        self.base = 1.0 / (1 + len(np.unique(shares[1][1])))
        self.grams, self.contexts, self.prob, self.back = {}, {}, {}, {}
        for n in range(1, ORDER + 1):
            of, key, share = shares[n]
            keys, at = np.unique(key, return_inverse=True)
            contexts, ctx = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            back = np.ones((len(contexts), width))
            np.subtract.at(back, (ctx[at], of), share)
            own = np.zeros((len(keys), width))
            own[at, of] = share
            for start in range(0, len(keys), 100_000):
                part = slice(start, start + 100_000)
                own[part] += back[ctx[part]] * self._lower(n, keys[part])
            table, before = HashArray(keys), HashArray(contexts)
            self.grams[n], self.contexts[n] = table, before
            self.prob[n], self.back[n] = own[table.order], back[before.order]
            table.order = before.order = None
        self.prob[ORDER] = np.log(self.prob[ORDER])  # of the longest grams only logarithms are asked for

    def _lower(self, n: int, keys: np.ndarray) -> np.ndarray:
        if n == 1:
            return np.full((len(keys), len(self.langs)), self.base)
        return self.of(n - 1, keys & np.uint64((1 << BITS * (n - 1)) - 1))

    def _backed_off(self, n: int, keys: np.ndarray) -> np.ndarray:
        ctx = self.contexts[n].find(keys >> np.uint64(BITS))
        weight = np.where((ctx >= 0)[:, None], self.back[n][np.maximum(ctx, 0)], 1.0) if len(self.back[n]) else 1.0
        return weight * self._lower(n, keys)

    def of(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Probabilities of the last symbol of each n-gram in each language, for n below ``ORDER``."""
        at = self.grams[n].find(keys)
        out = self.prob[n][np.maximum(at, 0)] if len(self.prob[n]) else np.zeros((len(keys), len(self.langs)))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._backed_off(n, keys[miss])
        return out

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Logarithms of the probability of the last symbol of each of the longest grams in each language."""
        at = self.grams[ORDER].find(keys)
        out = self.prob[ORDER][np.maximum(at, 0)] if len(self.prob[ORDER]) else np.zeros((len(keys), len(self.langs)))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = np.log(self._backed_off(ORDER, keys[miss]))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, and the number of symbols."""
        lengths, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        held, where, size = [], [], 0

        def flush():
            if not held:
                return
            logs = self.logs(np.concatenate(held))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
            for i, total in zip(where, np.add.reduceat(logs, starts, axis=0, dtype=np.float64), strict=True):
                out[i] -= total
            held.clear()
            where.clear()

        for i, text in enumerate(texts):
            found = grams(text)
            lengths[i] = len(found)
            for at in range(0, len(found), AT_ONCE):
                held.append(found[at : at + AT_ONCE])
                where.append(i)
                size += len(held[-1])
                if size > AT_ONCE:
                    flush()
                    size = 0
        flush()
        return out / np.maximum(lengths, 1)[:, None], lengths

    def predict(self, texts: list[str | None], bounds: np.ndarray | None = None) -> pd.DataFrame:
        """The columns of ``PREDICTION`` for each text; ``bounds``: typical cross-entropy and spread of each language."""
        xent, n = self.entropies(texts)
        xent = np.round(xent, DIGITS)
        best = xent.argmin(1)
        low = xent[np.arange(len(texts)), best]
        score = np.round(1 / np.exp(-(xent - low[:, None]) * (n / ORDER)[:, None]).sum(1), DIGITS)
        rejected = n == 0
        if bounds is not None:
            rejected |= low > bounds[best, 0] + SLACK + SIGMAS * bounds[best, 1] / np.sqrt(np.maximum(n, 1))
        names = np.array([*self.langs, UNKNOWN], object)[np.where(n > 0, best, len(self.langs))]
        return pd.DataFrame({"lang_pred": names, "score": np.where(n > 0, score, 0.0), "xent": low, "n_symbols": n, "rejected": rejected})


def shares_of(types: DataFrame) -> DataFrame:
    """``(lang, gram, share)`` of the types ``(lang, gram, n)`` of one order: the count less its language's discount, of its context's count."""
    per = types.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
    discount = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
    context = F.shiftrightunsigned("gram", BITS).alias("context")
    totals = types.groupBy("lang", context).agg(F.sum("n").alias("total"))
    held = types.join(F.broadcast(per.select("lang", discount.alias("discount"))), "lang").select("*", context)  # a row for each language
    return held.join(totals, ["lang", "context"]).select("lang", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share"))


def _shorter(n: int) -> Column:
    """The last n symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1).cast("long")).alias("gram") if n < ORDER else F.col("gram")


class Tables(NamedTuple):
    """The models as tables of shares for each order, for when they are too large to broadcast."""

    langs: list[str]
    shares: dict[int, DataFrame]
    base: float

    def _by_language(self, values: Column, missing: float) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(missing)))

    def probabilities(self, n: int, needed: DataFrame) -> DataFrame:
        """``(gram, p)`` for the distinct n-grams ``needed(gram)``: the last symbol's probability in each language."""
        if n == 0:
            return needed.select("gram", F.array_repeat(F.lit(self.base), len(self.langs)).alias("p"))
        entries = lambda c: F.map_from_entries(F.collect_list(F.struct("lang", c)))  # noqa: E731 - an entry for each language at most
        own = self.shares[n].groupBy("gram").agg(entries(F.col("share")).alias("own"))
        left = self.shares[n].groupBy(F.shiftrightunsigned("gram", BITS).alias("context"), "lang").agg((F.lit(1.0) - F.sum("share")).alias("left"))
        back = left.groupBy("context").agg(entries(F.col("left")).alias("back"))
        lower = self.probabilities(n - 1, needed.select(_shorter(n - 1)).distinct()).withColumnRenamed("gram", "shorter")
        rows = needed.select("gram", F.shiftrightunsigned("gram", BITS).alias("context"), _shorter(n - 1).alias("shorter"))
        rows = rows.join(own, "gram", "left").join(back, "context", "left").join(lower, "shorter")
        parts = F.arrays_zip(self._by_language(F.col("own"), 0.0).alias("own"), self._by_language(F.col("back"), 1.0).alias("back"), F.col("p").alias("low"))
        return rows.select("gram", F.transform(parts, lambda x: x["own"] + x["back"] * x["low"]).alias("p"))

    def predict(self, rows: DataFrame, text: Column, bounds: np.ndarray | None, name: str) -> DataFrame:
        """``rows`` with the struct of ``PREDICTION``; equal texts are looked up once."""
        key, key_ = free_names([*rows.columns, name], "text_key", "text_key_right")
        keyed = rows.withColumn(key, F.md5(F.coalesce(text, F.lit("")).cast("binary")))
        texts = keyed.groupBy(key).agg(F.first(text).alias("text"))
        counted = materialise(texts.select(F.col(key).alias("key"), "text").mapInArrow(_text_grams, "key string, gram long, n long"), "text-grams")
        p = self.probabilities(ORDER, counted.select("gram").distinct())
        sums = [F.sum(-F.ln(F.col("p")[i]) * F.col("n")).alias(f"x{i}") for i in range(len(self.langs))]
        told = counted.join(p, "gram").groupBy("key").agg(F.sum("n").alias("n"), *sums)
        told = told.select("key", "n", F.array(*[F.round(F.col(f"x{i}") / F.col("n"), DIGITS) for i in range(len(self.langs))]).alias("xent"))
        low = F.array_min("xent")
        best = F.array_position("xent", low).cast("int")
        score = F.round(F.lit(1.0) / F.aggregate("xent", F.lit(0.0), lambda a, x: a + F.exp(-(x - low) * F.col("n") / F.lit(float(ORDER)))), DIGITS)
        rejected = F.lit(False)
        if bounds is not None:
            typical, spread = (F.element_at(F.array(*[F.lit(float(x)) for x in bounds[:, i]]), best) for i in (0, 1))
            rejected = low > typical + F.lit(SLACK) + F.lit(SIGMAS) * spread / F.sqrt("n")
        known = told.select(F.col("key").alias(key_), F.struct(F.element_at(F.array(*map(F.lit, self.langs)), best).alias("lang_pred"),
            score.alias("score"), low.alias("xent"), F.col("n").alias("n_symbols"), rejected.alias("rejected")).alias(name))
        none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("xent"), F.lit(0).cast("long").alias("n_symbols"),
            F.lit(True).alias("rejected"))
        return keyed.join(known, F.col(key) == F.col(key_), "left").select(*rows.columns, F.coalesce(name, none).alias(name))


def _text_grams(batches):
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            found, n = np.unique(grams(text.as_py()), return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["key", "gram", "n"])


class Broadcast(NamedTuple):
    """The models in memory, once for all uses."""

    shared: object
    langs: list[str]
    base: float

    def predict(self, rows: DataFrame, text: Column, bounds: np.ndarray | None, name: str) -> DataFrame:
        shared = self.shared

        @F.arrow_udf(PREDICTION)
        def run(texts: pa.Array) -> pa.Array:
            return by_parts(lambda part: pa.RecordBatch.from_pandas(shared.value.predict(part, bounds), PREDICTED, preserve_index=False).to_struct_array(), texts)

        return rows.withColumn(name, run(text))


def train(docs: DataFrame, usable: Column) -> tuple[Broadcast | Tables, np.ndarray]:
    """Models of the rows of ``docs(text, lang)`` where ``usable`` holds and lang is not null, and their bounds for rejection."""
    rows = docs.where(usable & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = checkpoint(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}  # a row for each language
    langs = sorted(sizes) or [UNKNOWN]
    index = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int")
    types, orders = counts.select(index.alias("lang"), "gram", "n"), {}
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            types = checkpoint(types.groupBy("lang", _shorter(n)).agg(F.count(F.lit(1)).alias("n")))
        orders[n] = types
    cells = len(langs) * sum(t.count() for t in orders.values())
    shares = {n: shares_of(t) for n, t in orders.items()}
    if cells <= BROADCAST_CELLS:
        frames = {n: t.toPandas() for n, t in shares.items()}
        model = Model(langs, {n: (t["lang"].to_numpy(np.int64), t["gram"].to_numpy(np.int64).view(np.uint64), t["share"].to_numpy(np.float64)) for n,
            t in frames.items()})
        trained = Broadcast(docs.sparkSession.sparkContext.broadcast(model), langs, model.base)
    else:
        shares = {n: materialise(t, f"shares-{n}") for n, t in shares.items()}
        trained = Tables(langs, shares, 1.0 / (1 + orders[1].select("gram").distinct().count()))
    return trained, calibrate(trained, rows)


def _medians(values: DataFrame) -> dict[str, tuple[int, float]]:
    """How many ``values(lang, x)`` each language has, and their median, exact to a step.

    Values are counted by steps first, and the counts are put in order, so no task holds a language's values.
    """
    step = F.round(F.ln(F.greatest("x", F.lit(LEAST_VALUE))) * STEPS).cast("long")
    counted = values.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")
    ranked = counted.select("lang", "step", F.sum("n").over(whole).alias("of"), F.sum("n").over(whole.orderBy("step")).alias("upto"))
    middle = [F.min(F.when(F.col("upto") >= at, F.col("step"))) for at in (F.floor((F.col("of") + 1) / 2), F.floor(F.col("of") / 2) + 1)]
    told = ranked.groupBy("lang").agg(F.first("of"), *middle).collect()  # a row for each language
    return {lang: (n, float(np.exp(low / STEPS) + np.exp(high / STEPS)) / 2) for lang, n, low, high in told}


def calibrate(trained: Broadcast | Tables, rows: DataFrame) -> np.ndarray:
    """Typical cross-entropy and its spread (that of one symbol) in each language's own texts: medians over all of them, equal texts once."""
    scored = trained.predict(rows.withColumn("h", F.xxhash64("text")), F.col("text"), None, "p").where((F.col("p.lang_pred") == F.col("lang")) & (F.col("p.n_symbols") > 0))
    own = checkpoint(scored.groupBy("lang", "h").agg(F.min("p.xent").alias("xent"), F.min("p.n_symbols").alias("n")))
    typical = _medians(own.select("lang", F.col("xent").alias("x")))
    bounds = np.tile([np.log(1 / trained.base) * 0.75, 1.0], (len(trained.langs), 1))
    known = {lang: middle for lang, (n, middle) in typical.items() if n >= LEAST_TEXTS}
    if not known:
        return bounds
    middle = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.col("lang"))
    spread = _medians(own.where(F.col("lang").isin(*known)).select("lang", (F.abs(F.col("xent") - middle) * F.sqrt("n")).alias("x")))
    for i, lang in enumerate(trained.langs):
        if lang in known:
            bounds[i] = known[lang], 1.4826 * spread[lang][1]
    return bounds


def identify(docs: DataFrame, usable: Column | None = None) -> DataFrame:
    """``docs`` with a last column ``language_id``, a struct (lang_pred, score, xent, n_symbols, rejected) for each row.

    Trains on the rows of ``docs`` where ``usable`` holds (default: all) and lang is not null; the prediction itself
    sees the text alone.  The score is the posterior probability, evidence divided by the order since neighbouring grams
    overlap.  A text that is null or has no letter gets ``und``, score 0 and is rejected; with no labelled row at all
    every text gets ``und``.  Repeated rows count as often as they occur; ties go to the alphabetically first language.
    If ``docs`` has a column of that name already, the new one has an underscore after it.
    """
    trained, bounds = train(docs, F.lit(True) if usable is None else usable)
    return trained.predict(docs, F.col("text").cast("string"), bounds, free_names(docs.columns, "language_id")[0])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training must not see."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
