"""Quality scores by co-training.

Two classifiers see different views of a document: its text - shape, words and characters - and its page's metadata.
In each round either one labels the documents it is sure of, and the other learns from them.  A classifier is a linear
discriminant, so what it learns from any number of documents is their counts, sums and products, which Spark adds up: the
exchange covers the whole corpus, and no text leaves the executors.  Both views are calibrated on held-back labels, and
their combination scores every document.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import drawn, free_names, materialise
from candela.llm.hashing import U64, mix, stretch_hashes, word_places

ROUNDS, SURE = 3, 0.95
#: What a round's pseudo-labels weigh together, beside all labels together.
PSEUDO_WEIGHT = 0.5
#: Share of the labels held back to calibrate, and about how many of these are used at most.
HELD_BACK, CALIBRATION_ROWS = 0.25, 10_000
RIDGE = 0.02
SHAPE, WORDS, TRIGRAMS = 20, 128, 64
SOURCES, LANGS = 64, 16
TEXT_FEATURES, METADATA_FEATURES = SHAPE + WORDS + TRIGRAMS, 4 + SOURCES + LANGS
#: Documents are kept from this score on: low, so that removal needs clear evidence.
KEEP = 0.1
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "|{}[]<>#$%&*@^~_=+\\/"]] = True
_UPPER, _LOWER, _DIGIT = (np.array([chr(i).isascii() and getattr(chr(i), f)() for i in range(256)]) for f in ("isupper", "islower", "isdigit"))
_SENTENCE = re.compile(r"[.!?]+\s")


def _most(hashes: np.ndarray) -> tuple[int, int]:
    """How many different hashes there are, and how often the commonest occurs."""
    _, n = np.unique(hashes, return_counts=True)
    return (len(n), int(n.max())) if len(n) else (0, 0)


def text_view(text: str | None) -> np.ndarray:
    """Shape of a text - character classes, words, lines, repetition - and hashed shares of its words and byte trigrams.

    All zero but the first for texts without words.
    """
    out = np.zeros(TEXT_FEATURES)
    out[0] = 1
    lowered, starts, ends = word_places(text or "")
    w = len(starts)
    if not w:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n, sizes = len(data), ends - starts
    lines = text.split("\n")
    words = stretch_hashes(lowered, starts, ends)
    pairs = mix(words[:-1] * U64(0xD6E8FEB86659FD93) + words[1:])
    (kinds, most), (pair_kinds, pair_most) = _most(words), _most(pairs)
    upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
    out[1:SHAPE] = (
        np.log1p(n) / 10,
        upper / max(upper + lower, 1),
        counts[_DIGIT].sum() / n * 5,
        counts[_SYMBOLS].sum() / n * 10,
        counts[33] / w * 3,
        counts[46] / w * 3,
        counts[44] / w * 3,
        counts[128:].sum() / n,
        sizes.mean() / 8,
        min(sizes.std() / 8, 3),
        kinds / w,
        most / w,
        pair_most / w * 3,
        pair_kinds / max(w - 1, 1),
        len(lines) / w * 5,
        1 - len(set(lines)) / len(lines),
        min(len(_SENTENCE.findall(text)) / w * 5, 3),
        counts[124] / w,
        (n - lower - upper - counts[32]) / n,
    )
    out[SHAPE : SHAPE + WORDS] = np.sqrt(np.bincount((words >> U64(57)).astype(np.int64), minlength=WORDS) / w)
    wide = lowered.astype(np.uint32)
    trigrams = ((wide[:-2] * 2654435761 + wide[1:-1] * 40503 + wide[2:] * 69069) >> 7) % TRIGRAMS if n > 2 else wide[:0]
    out[SHAPE + WORDS :] = np.sqrt(np.bincount(trigrams, minlength=TRIGRAMS) / n)
    return out


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Where a document comes from and how long it says it is; source and language are hashed."""
    out = np.zeros(METADATA_FEATURES)
    size = float(n_chars) if n_chars is not None and n_chars > 0 else 0.0
    out[:4] = 1, np.log1p(size) / 10, size < 200, size > 20_000
    out[4 + zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[4 + SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    return out


def views(text, source, lang, size) -> tuple[np.ndarray, np.ndarray]:
    """Both views of several documents, as they are stored."""
    a = np.array([text_view(t) for t in text], np.float16).reshape(-1, TEXT_FEATURES)
    b = np.array([metadata_view(*m) for m in zip(source, lang, size, strict=True)], np.float16).reshape(-1, METADATA_FEATURES)
    return a, b


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method, classes weighted alike; of one class alone, its side."""
    w = np.zeros(x.shape[1])
    if len(np.unique(y)) < 2:
        w[0] = 0.0 if not len(y) else 3.0 * (2 * y[0] - 1)
        return w
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) / len(y) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a discriminant needs of rows of both classes, as numbers that add up: counts, sums, and the products' upper triangle."""
    x = x.astype(np.float64)
    ones = x[y > 0]
    return np.concatenate([[len(x) - len(ones), len(ones)], x.sum(0) - ones.sum(0), ones.sum(0), (x.T @ x)[np.triu_indices(x.shape[1])]])


def discriminant(total: np.ndarray, d: int) -> np.ndarray:
    """Weights and, last, the bias of the linear discriminant with these moments; zero while a class is empty."""
    n0, n1 = total[:2]
    if n0 <= 0 or n1 <= 0:
        return np.zeros(d + 1)
    mean0, mean1 = total[2 : 2 + d] / n0, total[2 + d : 2 + 2 * d] / n1
    within = np.zeros((d, d))
    within[np.triu_indices(d)] = total[2 + 2 * d :]
    within = (within + np.triu(within, 1).T - n0 * np.outer(mean0, mean0) - n1 * np.outer(mean1, mean1)) / (n0 + n1)
    w = np.linalg.solve(within + RIDGE * max(np.trace(within) / d, 1e-9) * np.eye(d), mean1 - mean0)
    return np.concatenate([w, [-w @ (mean0 + mean1) / 2]])


def blended(labelled: np.ndarray, pseudo: np.ndarray | None) -> np.ndarray:
    """Moments of labels and pseudo-labels, each counted by share; a round without pseudo-labels adds nothing."""
    total = labelled / max(labelled[:2].sum(), 1)
    return total if pseudo is None or not pseudo[:2].sum() else total + PSEUDO_WEIGHT * pseudo / pseudo[:2].sum()


class View(NamedTuple):
    """A discriminant and the line that makes its values log-odds."""

    weights: np.ndarray
    line: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]
        return np.clip(self.line[0] + self.line[1] * z, -15, 15)

    def sure(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows it is sure of, and their labels."""
        p = _sigmoid(self.odds(x))
        found = np.flatnonzero(np.maximum(p, 1 - p) >= SURE)
        return found, (p[found] > 0.5).astype(float)


def view_of(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> View:
    """A view with these moments, calibrated on held-back rows."""
    weights = discriminant(total, x.shape[1])
    z = x.astype(np.float64) @ weights[:-1] + weights[-1]
    return View(weights, logistic(np.stack([np.ones(len(z)), z], 1), y))


class Scorer(NamedTuple):
    text: View
    metadata: View
    combine: np.ndarray

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        za, zb = self.text.odds(a), self.metadata.odds(b)
        return _sigmoid(za), _sigmoid(zb), _sigmoid(self.combine[0] + self.combine[1] * za + self.combine[2] * zb)


def _columns(docs: DataFrame) -> list:
    cast = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in cast.items()]


def _features(batches):
    for batch in batches:
        a, b = views(*(batch.column(i).to_pylist() for i in range(1, 5)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in a], pa.binary()),
            pa.array([x.tobytes() for x in b], pa.binary())], ["doc_id", "a", "b"])


def _arrays(batch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float16).reshape(-1, d) for i, d in ((at, TEXT_FEATURES), (at + 1, METADATA_FEATURES)))


def _sums(chosen):
    """Rows (view, i, v) of the moments of what ``chosen`` picks from each batch, summed over a task."""

    def run(batches):
        total = None
        for batch in batches:
            found = [moments(x, y) for x, y in chosen(batch)]
            total = found if total is None else [t + f for t, f in zip(total, found, strict=True)]
        for k, values in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.int32()), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
                ["view", "i", "v"])

    return run


def _added_up(frame: DataFrame, chosen) -> list[np.ndarray]:
    """The moments of both views over all rows; their number depends on the features alone."""
    sums = frame.mapInArrow(_sums(chosen), "view int, i int, v double").groupBy("view", "i").agg(F.sum("v").alias("v")).toPandas()
    out = [np.zeros(2 + 2 * d + d * (d + 1) // 2) for d in (TEXT_FEATURES, METADATA_FEATURES)]
    for k, total in enumerate(out):
        mine = sums[sums["view"] == k]
        total[mine["i"].to_numpy()] = mine["v"].to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS) -> Scorer:
    """Fit on all labels but those held back, and exchange pseudo-labels over all documents in each round."""
    doc_id = (F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)).cast("long").alias("doc_id")
    pool = materialise(docs.select(doc_id, *_columns(docs)).mapInArrow(_features, "doc_id long, a binary, b binary"), "views")
    labelled = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(label) > 0).cast("int").alias("y"))
    held = drawn(HELD_BACK, F.col("doc_id"))
    known = materialise(pool.join(labelled, "doc_id").select("doc_id", "a", "b", "y", held.alias("held")), "labelled")
    most = known.where("held").count()
    kept = known.where("held").where(drawn(CALIBRATION_ROWS / max(most, CALIBRATION_ROWS), F.col("doc_id"), F.lit(1))).orderBy("doc_id", "a", "b")
    kept = kept.select("a", "b", "y").toArrow()
    xa, xb = (np.frombuffer(b"".join(kept[c].to_pylist()), np.float16).reshape(-1, d) for c, d in (("a", TEXT_FEATURES), ("b", METADATA_FEATURES)))
    y = kept["y"].to_numpy().astype(float)

    def labels_of(batch):
        a, b = _arrays(batch, 0)
        mine = batch.column(2).to_numpy(zero_copy_only=False)
        return (a, mine), (b, mine)

    own = _added_up(known.where("not held").select("a", "b", "y"), labels_of)
    text, metadata = view_of(blended(own[0], None), xa, y), view_of(blended(own[1], None), xb, y)
    for _ in range(rounds):

        def exchanged(batch, text=text, metadata=metadata):
            a, b = _arrays(batch, 0)
            (by_text, told), (by_metadata, said) = text.sure(a), metadata.sure(b)
            return (a[by_metadata], said), (b[by_text], told)

        pseudo = _added_up(pool.select("a", "b"), exchanged)
        text, metadata = view_of(blended(own[0], pseudo[0]), xa, y), view_of(blended(own[1], pseudo[1]), xb, y)
    both = np.stack([np.ones(len(y)), text.odds(xa), metadata.odds(xb)], 1)
    return Scorer(text, metadata, logistic(both, y))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` with a last column ``quality``, a struct (p_text, p_metadata, score, kept) for each row.

    Missing columns, nulls and empty texts are scored like any other value; repeated rows get equal scores.  Labels of
    documents that are not there, null labels and repeated labels (the worst counts) are allowed; without labels of
    both kinds the scores say so by being 0.5 or the only label's side.  If ``docs`` has a column of that name already,
    the new one has an underscore after it.
    """
    scorer = train(docs, labels, label)

    def run(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        a, b = views(text, source, lang, [None if pd.isna(n) else int(n) for n in size])
        by_text, by_metadata, p = scorer.score(a, b)
        return pd.DataFrame({"p_text": by_text, "p_metadata": by_metadata, "score": p, "kept": p >= KEEP})

    udf = F.pandas_udf(run, "p_text double, p_metadata double, score double, kept boolean")
    return docs.withColumn(free_names(docs.columns, "quality")[0], udf(*_columns(docs)))
