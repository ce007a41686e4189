"""WARC: records of equal payloads become revisits of the first one."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Prefix of a record's id; the row's own id follows.
URN = "urn:x-record:"
RECORDS = ("record_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, "
           "refers_to long, payload binary")


def base32(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1: five hexadecimal digits are four letters."""
    letters = []
    for g in range(8):
        n = F.conv(F.substring(sha1_hex, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), (F.shiftright(n, s).bitwiseAND(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """For each record that repeats an earlier payload: ``id``, ``digest``, ``refers_to``.

    ``heads`` has ``id``, ``digest`` and ``bytes`` only, payloads are not shuffled. The first record of a digest is a
    combinable minimum, so a frequent payload is one row a task; only then are heads joined to it.
    """
    enough = heads.where(F.col("bytes") >= min_bytes).select("id", "digest")
    first = enough.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return enough.join(first, "digest").where("id <> refers_to").distinct()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
            date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``record``: the text of one WARC/1.1 record for each row, without the line ends that close it."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    decided = revisits(rows.select("id", "digest", F.octet_length("html").alias("bytes")), min_bytes)
    rows = rows.join(decided, ["id", "digest"], "left").withColumn("bytes", F.octet_length("html").cast("string"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), "bytes", F.lit(END * 2))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20")
    head = F.concat_ws(
        END, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{URN}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return rows.select(F.concat(head, F.lit(END * 2), block).alias("record"))


def write(pages: DataFrame, path: str, records_per_file: int = 1000, **options) -> None:
    """Writes the rows as gzip archives below ``path``, with fresh headers.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the smallest id is a response and the others revisit
    it; all shorter ones are responses. Rows that repeat an id and a payload are written as they are, the smallest id
    as a response each time. A null payload is empty; rows with a null id are responses; white space and control
    characters in an address become %20; a null address has no header. Files are committed by Spark's writer.
    """
    (records(pages, **options).write.option("lineSep", END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, as in ``RECORDS``; a response whose payload has not its digest is an error."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:top].decode().split(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {version[:40]!r}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        block = data[top + 4:top + 4 + int(head["content-length"])]
        at = top + 4 + len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest, again = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
        if not again and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} has another digest")
        number = lambda k: int(x) if (x := head.get(k, "").strip("<>").removeprefix(URN)) else None
        yield (number("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), digest, sizes[0],
               number("warc-refers-to"), None if again else payload)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path`` (see ``RECORDS``; a revisit has no payload)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = list(parse(gzip.decompress(content.as_py())))
                for a in range(0, len(rows), 200):
                    columns = zip(*rows[a:a + 200])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return files.mapInArrow(run, RECORDS)


def resolve(found: DataFrame) -> DataFrame:
    """``found`` with the payload of each revisit taken from the response that it refers to."""
    source = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), "payload_digest", F.col("payload").alias("_original")) \
        .dropDuplicates(["refers_to", "payload_digest"])
    out = found.join(source, ["refers_to", "payload_digest"], "left")
    return out.select(*[F.coalesce("payload", "_original").alias(c) if c == "payload" else c for c in found.columns])
