"""WARC archives with revisit records.

Headers (payload digest, length, id) are shuffled by digest; the smallest id of a payload is
its response and the others revisit it. Records are written by Spark's text writer, whose
line separator is the blank line pair that ends a WARC record: task commits, retries and any
Hadoop file system come with it. Archives are read back as binary files and parsed by their
content lengths, so a payload may hold anything, record separators included.

Fresh headers are derived from the page (id, url, digest) and a fixed date; writing again
gives the same bytes.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.store import NO_ID, discard, stored, transient_shuffles, with_id

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are always written as responses.
LEAST_BYTES = 100
#: Payload bytes per archive file, about; a file is read whole by one task.
FILE_BYTES = 32 << 20

READ = (
    "record_id string, record_type string, page_id long, target_uri string, payload_digest string, "
    "refers_to string, payload binary"
)


def headers(pages: DataFrame) -> DataFrame:
    """``(id, url, payload_digest, payload_bytes)`` of pages ``(id, url, html)``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("id", "url", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve_revisits(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Headers with ``original``, the smallest id of the same payload where that is another one.

    Digest and length are compared. The least id of a digest is found by partial aggregates,
    and joined back to the headers of that digest alone: payloads take no part.
    """
    long = heads.where(F.col("payload_bytes") >= least_bytes)
    first = long.groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"), "original")
    first = stored(first, "warc-originals")  # a plain table, so that Spark can split the join on a hot digest
    same = (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b"))
    done = heads.join(first, same, "left").drop("_d", "_b")
    return done.withColumn("original", F.when(F.col("original") != F.col("id"), F.col("original")))


def _record_id(id_: F.Column, digest: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", id_.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _clean(text: F.Column) -> F.Column:
    """Header values hold no line breaks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n]+", " ")


def records(pages: DataFrame, date: str) -> DataFrame:
    """``value``: one WARC record per page, without the end that the writer adds."""
    payload = F.coalesce("html", F.lit(""))
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload)
    number = F.when(F.col("id") != NO_ID, F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(number.isNotNull(), line("WARC-Page-ID", number.cast("string"))).otherwise(F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", _record_id(F.col("original"), F.col("payload_digest"))),
            line("WARC-Refers-To-Date", F.lit(date)),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return pages.select(F.concat(head, body).alias("value"))


def write_archives(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Write one record per row below ``path``, later copies of a payload as revisits.

    A null payload is empty, a null url blank. A null id counts as larger than any other and
    its record carries none. Rows that repeat the smallest id of a payload are one page:
    each is written as a response with the same record id. An empty table writes no record.
    Other columns are ignored. ``compression`` is gzip or none, for each file as a whole.
    """
    pages = with_id(df, id_col, url=url_col, html=html_col)
    heads = stored(headers(pages), "warc-headers")
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(16, -(-total // FILE_BYTES))
    decided = resolve_revisits(heads.select("id", "payload_digest", "payload_bytes").distinct(), least_bytes)
    decided = decided.withColumnRenamed("payload_digest", "_digest").drop("payload_bytes")
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    apart = F.xxhash64("id", "_digest")
    left = pages.withColumn("_digest", digest).withColumn("_file", apart).repartition(files, "_file")
    right = decided.withColumn("_file", apart).repartition(files, "_file")
    rows = left.join(right, ["_file", "id", "_digest"], "left").withColumnRenamed("_digest", "payload_digest")
    with transient_shuffles(df.sparkSession):
        records(rows, date).write.option("lineSep", END).option("compression", compression).text(path)
    discard(heads)


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive: header fields in lower case, and ``block``."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = head_end + 4
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end at its length")
        yield fields | {"block": data[begin:end]}
        at = end + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("content"):
            rows: list[tuple] = []
            size = 0
            data = cell.as_py()
            for r in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                page = r.get("warc-page-id")
                rows.append((
                    r["warc-record-id"], r["warc-type"], None if page is None else int(page), r.get("warc-target-uri"),
                    r.get("warc-payload-digest", "").removeprefix("sha256:"), r.get("warc-refers-to"), r["block"],
                ))
                size += len(r["block"])
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").mapInArrow(_parsed, READ)


def resolved(archive: DataFrame) -> DataFrame:
    """Records with the length and digest of their full payload, revisits from their originals.

    Revisits are joined to the responses they refer to by record id; a response is counted
    once however often it was written.
    """
    heads = archive.select(
        "page_id", "record_id", "record_type", "refers_to",
        F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"),
    )
    heads = stored(heads, "warc-read")
    originals = heads.where("record_type = 'response'").dropDuplicates(["record_id"])
    originals = originals.select(
        F.col("record_id").alias("_to"), F.col("page_id").alias("_page"), F.col("n").alias("_n"), F.col("digest").alias("_digest")
    )
    originals = stored(originals, "warc-responses")
    both = heads.join(originals, heads["refers_to"] == originals["_to"], "left")
    revisit = F.col("record_type") == "revisit"
    return both.select(
        "page_id",
        F.when(revisit, F.col("_n")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("_page")).alias("refers_to"),
    )


ORACLE = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, '')) AS payload_bytes FROM pages
),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""
