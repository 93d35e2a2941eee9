"""Content-addressed web archive.

A record's payload is stored once, as a gzip member under the SHA-256 of its bytes, and its header, byte for byte, in a
table of its own; a join of the two gives the record back as it would stand in a WARC file.  Records whose payload another one holds already become
revisits.  Whatever is read back is checked: the payload against its address, the record against its own length and
digest.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import free_names, materialise

#: Alphabet of base 32 after RFC 4648, beside the digits that ``conv`` writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
VERSION, END = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are stored once; each record of a smaller one is a response.
MIN_BYTES = 0
#: Records have no date of their own unless one is given.
DATE = "2000-01-01T00:00:00Z"


#: Container of a gzip member, and how hard it is packed.
GZIP, LEVEL = 31, 6


def pack(payload: bytes) -> bytes:
    return zlib.compress(payload, LEVEL, GZIP)


def unpack(stored: bytes) -> bytes:
    return zlib.decompress(stored, GZIP)


def _packed(payloads: pd.Series) -> pd.Series:
    return payloads.map(pack)


def _unpacked(stored: pd.Series) -> pd.Series:
    return stored.map(unpack, na_action="ignore")


def base32(sha1: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: five hexadecimal digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _binary(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _field(name: str, value: Column | str) -> Column:
    """A header line; without a value there is none."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def record_id(page: Column, url: Column, copy: Column) -> Column:
    """An identifier in the form of a UUID, from what names the record."""
    told = F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), copy.cast("string"))
    h = F.md5(told.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def headers(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, url, digest, record_id, header)`` for the rows of ``pages(page_id, url, digest, sha1, n_bytes)``.

    Of the records of one payload, that with the smallest page_id is the response (of equal ones the smallest url, and of
    equal rows one); rows without a page_id come last.  Only names and digests move; a payload that very many records
    share is one row in the search for its first record, and its records meet it in a join whose large partitions split.
    """
    key = ["digest", "sha1", "n_bytes"]
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    named = pages.groupBy(*key, "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    first = pages.groupBy("digest").agg(F.min(order).alias("first"))
    rows = named.join(first, "digest").select(*key, "page_id", "url", "first", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    stored_once = F.col("n_bytes") >= min_bytes
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1)
    response = ~stored_once | is_first
    own, target = record_id(F.col("page_id"), F.col("url"), F.col("copy")), record_id(F.col("first.page_id"), F.col("first.url"), F.lit(1))
    safe_url = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    header = F.concat(
        F.lit(f"{VERSION}{END}"), _field("WARC-Type", F.when(response, "response").otherwise("revisit")), _field("WARC-Record-ID", own), _field("WARC-Date", DATE),
        _field("WARC-Target-URI", safe_url), _field("WARC-Source-Page", F.col("page_id").cast("string")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(response, F.lit("")).otherwise(F.concat(_field("WARC-Profile", PROFILE), _field("WARC-Refers-To", target),
            _field("WARC-Refers-To-Page", F.col("first.page_id").cast("string")))),
        _field("Content-Type", "text/html; charset=utf-8"), _field("Content-Length", F.when(response, F.col("n_bytes")).otherwise(0).cast("string")), F.lit(END),
    )
    return rows.select("page_id", "url", "digest", own.alias("record_id"), _binary(header).alias("header"))


def archive(pages: DataFrame, page: str = "html", min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(headers, payloads)`` of a record for each row of ``pages(page_id, url, <page>)``, written to the shared folder.

    ``payloads(digest, stored)`` has each distinct payload once, packed after copies have been left out.  The payload is
    the page in UTF-8; a null page is empty.
    Rows that repeat are records of their own; other columns are not read; an empty table gives two empty tables.
    """
    payload = _binary(F.coalesce(F.col(page).cast("string"), F.lit("")))
    told = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    names = told.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n_bytes"))
    store = told.select("digest", "payload").dropDuplicates(["digest"]).select("digest", F.pandas_udf(_packed, "binary")("payload").alias("stored"))
    return materialise(headers(names, min_bytes), "warc-headers"), materialise(store, "warc-payloads")


def restore(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """``heads`` with ``payload`` and ``record``: the record's exact bytes, of a revisit without its payload.

    Each header must have its payload in the store, and a payload's bytes must give its address; else the job stops.
    Payloads are moved packed.  Where ``heads`` has a column of one of these names, the added one has an underscore after it.
    """
    stored, payload, record = free_names(heads.columns, "stored", "payload", "record")
    met = heads.join(payloads.select("digest", F.col("stored").alias(stored)), "digest", "left").withColumn(payload, F.pandas_udf(_unpacked, "binary")(stored))
    wrong = F.raise_error(F.concat(F.when(F.col(payload).isNull(), "no payload at address ").otherwise("payload does not match its address "), F.col("digest")))
    met = met.withColumn(payload, F.when(F.sha2(payload, 256) == F.col("digest"), F.col(payload)).otherwise(wrong.cast("binary")))
    body = F.when(content_length(F.col("header")) > 0, F.col(payload)).otherwise(_binary(F.lit("")))
    return met.withColumn(record, F.concat(F.col("header"), body, _binary(F.lit(END * 2)))).select(*heads.columns, payload, record)


def value_of(header: Column, name: str) -> Column:
    """What a header's first line of this name says; null where there is none."""
    found = F.regexp_extract(header.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(F.rlike(header.cast("string"), F.lit(rf"(?im)^{name}:")), found)


def content_length(header: Column) -> Column:
    return F.coalesce(value_of(header, "Content-Length").cast("long"), F.lit(0))


def split_record(record: Column) -> tuple[Column, Column]:
    """Header and block of a record's bytes: the header ends with the first empty line and says how long the block is."""
    size = F.locate(END * 2, record.cast("string")) + 3  # in characters; headers are told apart by bytes below
    head = F.encode(F.substring(record.cast("string"), F.lit(1), size), "UTF-8")
    return head, F.substring(record, F.octet_length(head) + 1, content_length(head).cast("int"))


def read_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with header, block and the fields record_type, source_page, refers_to_page and payload_sha1.

    A record that is shorter or longer than its header says stops the job.
    """
    head, block = split_record(F.col(record))
    parsed = records.withColumns({"header": head, "block": block})
    whole = F.octet_length(record) == F.octet_length("header") + content_length(F.col("header")) + len(END * 2)
    wrong = F.raise_error(F.concat(F.lit("a record's length is wrong: "), F.col("header").cast("string"))).cast("binary")
    parsed = parsed.withColumn("block", F.when(whole, F.col("block")).otherwise(wrong))
    return parsed.withColumns({
        "record_type": value_of(F.col("header"), "WARC-Type"), "source_page": value_of(F.col("header"), "WARC-Source-Page").cast("long"),
        "refers_to_page": value_of(F.col("header"), "WARC-Refers-To-Page").cast("long"),
        "payload_sha1": F.regexp_replace(value_of(F.col("header"), "WARC-Payload-Digest"), "^sha1:", ""),
    })


def write_files(records: DataFrame, path: str, record: str = "record", files: int | None = None) -> None:
    """The records' bytes as gzipped WARC files.

    A record ends with two line ends, which are what the text writer puts after each; so Spark writes the files itself,
    to whatever store the path names.
    """
    body = F.substring(F.col(record), F.lit(1), (F.octet_length(record) - len(END * 2)).cast("int"))
    out = records.select(body.cast("string").alias("value"))
    (out.repartition(files) if files else out).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(record)``: the records of gzipped WARC files, cut where their headers say that they end.

    A file is read by one task and streamed record by record.
    """

    def cut(files):
        import gzip
        import io

        import pandas as pd

        for frame in files:
            for content in frame["content"]:
                stream = gzip.GzipFile(fileobj=io.BytesIO(content))
                while line := stream.readline():
                    lines, size = [line], 0
                    while (line := stream.readline()).strip():
                        lines.append(line)
                        if line.lower().startswith(b"content-length:"):
                            size = int(line.split(b":", 1)[1])
                    yield pd.DataFrame({"record": [b"".join([*lines, line, stream.read(size), stream.read(4)])]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(cut, "record binary")


def archived_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """What the archive of ``pages`` says of each page once its records are read back.

    Columns: page_id, payload_bytes and payload_digest (base 32 SHA-1), both taken from the payload as it was read,
    record_type, refers_to (the page of a revisit's response), record_bytes, record_sha256.  Null pages are empty;
    repeated rows are records of their own; pages of any length are stored whole; a digest that differs from the
    header's stops the job.
    """
    heads, payloads = archive(pages, min_bytes=min_bytes)
    back = read_records(restore(heads.select("digest", "header"), payloads))
    wrong = F.raise_error(F.concat(F.lit("a payload's digest is not its record's: "), F.col("payload_sha1")))
    digest = base32(F.sha1("payload"))
    return back.select(
        F.col("source_page").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(digest == F.col("payload_sha1"), digest).otherwise(wrong.cast("string")).alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to_page")).alias("refers_to"), F.octet_length("record").cast("long").alias("record_bytes"),
        F.sha2("record", 256).alias("record_sha256"),
    )


ORACLE_SQL = r"""
WITH told AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha1, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
              FROM pages),
coded AS (
  SELECT *, strlen(html) AS n, list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform([32768, 1024, 32, 1],
           lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[('0x' || sha1[5 * i + 1 : 5 * i + 5])::INT // d % 32 + 1]), lambda a, b: a || b)), lambda a, b: a || b) AS b32,
         md5(page_id || ' ' || url || ' 1') AS own FROM told),
met AS (SELECT c.*, f.own AS other FROM coded c JOIN coded f ON f.page_id = c.first),
written AS (
  SELECT *, array_to_string(['WARC/1.1', 'WARC-Type: ' || CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END,
      'WARC-Record-ID: <urn:uuid:' || array_to_string([own[1:8], own[9:12], own[13:16], own[17:20], own[21:32]], '-') || '>',
      'WARC-Date: 2000-01-01T00:00:00Z', 'WARC-Target-URI: ' || url, 'WARC-Source-Page: ' || page_id, 'WARC-Payload-Digest: sha1:' || b32]
      || CASE WHEN page_id = first THEN []::VARCHAR[] ELSE ['WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest',
         'WARC-Refers-To: <urn:uuid:' || array_to_string([other[1:8], other[9:12], other[13:16], other[17:20], other[21:32]], '-') || '>',
         'WARC-Refers-To-Page: ' || first] END
      || ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || CASE WHEN page_id = first THEN n ELSE 0 END, '',
          CASE WHEN page_id = first THEN html ELSE '' END, '', ''], chr(13) || chr(10)) AS record FROM met)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256 FROM written
"""
