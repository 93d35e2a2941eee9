"""Interleaved documents of text and media.

HTML becomes an ordered array of text blocks and media references; references resolve to payloads by a join on their
digest, so each distinct payload is stored, moved and examined once however many documents show it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import utf8
from candela.llm.html import blocks

#: Samples in a row of a stored image; payloads are padded to a positive multiple of it.
ROW = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,n_items:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SCHEME = "sha256:"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """The payload as an 8-bit grey PNG, ``ROW`` samples wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of a stored image; raises if a checksum or the format is wrong."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a stored image")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean, deviation, entropy and a 16-bin histogram (per mille) of the samples, and a 64-bit gradient hash."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    bins = counts.reshape(16, 16).sum(1) * 1000 // len(samples)
    cells = np.add.reduceat(samples.astype(np.int64), np.arange(65) * len(samples) // 65) if len(samples) >= 65 else np.resize(samples, 65).astype(np.int64)
    gradient = int("".join("1" if b else "0" for b in cells[1:] > cells[:-1]), 2)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={abs((share * np.log2(share)).sum()):.4f};hist={'/'.join(map(str, bins))};gradient={gradient:016x}"


def _store(payloads: pd.Series) -> pd.Series:
    return payloads.map(encode)


def _examine(media: pd.Series) -> pd.DataFrame:
    rows = []
    for stored in media:
        payload = decode(stored)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])


def _items(media_only: bool):
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            found = blocks(page)
            items = []
            for i, b in enumerate(found):
                if b.src is None and media_only:
                    continue
                digest = b.src[len(SCHEME) :].lower() if b.src and b.src.startswith(SCHEME) else None
                kind, text = ("text", b.text) if b.src is None else ("media", b.src)
                items.append({"position": i, "n_items": len(found), "kind": kind, "text": text, "digest": digest, "caption": b.caption or None})
            out.append(items)
        return pd.Series(out)

    return run


def payload_of(text: str = "text") -> Column:
    """A text's UTF-8 bytes, zero-padded to a positive multiple of ``ROW``; null is empty."""
    data = F.encode(utf8(text), "UTF-8")
    size = F.octet_length(data)
    padding = F.greatest(F.ceil(size / ROW), F.lit(1)) * ROW - size
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), padding.cast("int"))))


def store(payloads: DataFrame) -> DataFrame:
    """``(digest, media)`` for the distinct payloads of ``payloads(digest, payload)``; null payloads are left out."""
    coded = payloads.where("payload is not null").select("digest", F.pandas_udf(_store, "binary")("payload").alias("media"))
    return coded.dropDuplicates(["digest"])


def examine(media: DataFrame) -> DataFrame:
    """``media(digest, media)`` read back: digest and the columns of ``FEATURES``."""
    return media.select("digest", F.pandas_udf(_examine, FEATURES)("media").alias("x")).select("digest", "x.*")


def interleave(pages: DataFrame, media: DataFrame, key: str = "page_id", page: str = "html", media_only: bool = False) -> DataFrame:
    """A row for each item of each page: key, position, n_items, kind, text, digest, caption and the matching columns of ``media``.

    Items keep their order on the page; ``n_items`` is how many the page has.  A media reference is written
    ``sha256:<digest>``; its text column has the reference as written.  References without such a digest, or with one that
    ``media`` lacks, stay with null payload columns.  Captions come from the figure around a reference, else from its
    alternative text.  With ``media_only`` the rows of texts are left out, and positions stay what they are.  Null or
    empty pages give no rows; repeated pages repeat their rows; ``media`` must have one row for each digest.
    """
    items = pages.select(F.col(key), F.explode(F.pandas_udf(_items(media_only), ITEMS)(F.col(page).cast("string"))).alias("item"))
    fields = [f"item.{c}" for c in ("position", "n_items", "kind", "text", "digest", "caption")]
    return items.select(key, *fields).join(media, "digest", "left")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _figure(digest: str, n_bytes: str) -> Column:
    """Mark-up of a stored text's figure."""
    return F.concat(F.lit('<figure><img src="'), F.lit(SCHEME), F.col(digest), F.lit('" alt="stored text"><figcaption>'), F.col(n_bytes).cast("string"),
        F.lit(" bytes of text</figcaption></figure>"))


def document_media(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Each document's text as stored media, resolved through the interleaved page that shows it.

    Columns: doc_id, n_bytes and those of ``FEATURES``, then position, n_items and caption: a document's own page has a
    paragraph for each line and the figure of its stored text after the first, so these say where the figure stands
    among the page's items and what is written under it.  With ``pages(page_id, html, ...)``: page_position, page_items
    and page_caption say the same of the figure at the end of the page whose page_id is the doc_id; null where there is
    none, and of repeated pages the smallest html counts.  Equal texts share one payload.  Rows without a doc_id, and
    repeated rows, are kept as they are; null texts are empty.
    """
    text = utf8("text")
    told = docs.select("doc_id", F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("n_bytes"), payload_of().alias("payload"),
        text.alias("text")).withColumn("digest", F.sha2("payload", 256))
    features = examine(store(told.select("digest", "payload")))
    line = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(line) + 2, F.length("text"))
    paragraphs = F.replace(_escaped(rest), F.lit("\n"), F.lit("</p><p>"))
    own = F.concat(F.lit("<article><p>"), _escaped(line), F.lit("</p>"), _figure("digest", "n_bytes"), F.lit("<p>"), paragraphs, F.lit("</p></article>"))
    shown = interleave(told.select(F.struct("doc_id", "n_bytes", "digest").alias("page_id"), own.alias("html")),
        features, media_only=True).where("digest = page_id.digest")
    names = [x.split()[0] for x in FEATURES.split(", ")]
    out = shown.select("page_id.doc_id", "page_id.n_bytes", *names, "position", "n_items", "caption")
    if pages is None:
        return out
    html = pages.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("html").cast("string"),
        F.lit(""))).alias("html"))
    ids = told.select("doc_id", "n_bytes", "digest").distinct()  # rows that repeat a doc_id with another text show another figure
    with_figure = html.join(ids, "doc_id").select(F.struct("doc_id", "n_bytes", "digest").alias("page_id"), F.concat("html", _figure("digest", "n_bytes")).alias("html"))
    none = features.select("digest").limit(0)
    placed = interleave(with_figure, none, media_only=True).where("digest = page_id.digest").groupBy("page_id.doc_id", "page_id.n_bytes")
    placed = placed.agg(F.max("position").alias("page_position"), F.max("n_items").alias("page_items"), F.max("caption").alias("page_caption"))
    return out.join(placed, ["doc_id", "n_bytes"], "left")
