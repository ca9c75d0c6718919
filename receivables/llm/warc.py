"""A content-addressed archive of web pages, and WARC files made from it.

Payload bytes are stored once under their SHA-256 digest; the exact head of every record
(WARC fields and HTTP head) is stored apart with the address of its payload. Records are
rebuilt by a join. Two payloads count as equal if their digests are; that their lengths
and SHA-1 digests are equal too is checked when they are stored, and that a payload has
the digest it is stored under when it is read.

Results by case: a NULL payload counts as empty; of records with equal payloads of at
least ``least_bytes`` those with the smallest page id are responses and the others
revisits of it (a repeated row is a response like its copy; a NULL id comes after all
others); line breaks in a URL are percent-encoded, a NULL URL has no field; an empty
table gives an empty archive; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.functions import key_hash
from receivables.functions.keys import KEY_HASH
from receivables.llm.common import map_rows, stored, type_of
from receivables.scratch import new_folder

# Fixed values of the format and of base32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
END = "\r\n\r\n"
RECORD_ID = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in base32: 160 bits in 32 letters, four from each 20 bits."""
    digits = F.sha1(payload)
    letters = []
    for first in range(1, 41, 5):
        bits = F.conv(F.substring(digits, first, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.url_encode(F.coalesce(page_id.cast("string"), F.lit(""))), F.lit(">"))


def _head(date: str) -> Column:
    """The exact text before the payload."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", url), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            revisit,
            F.concat(
                field("WARC-Refers-To", _record_id(F.col("refers_to"))),
                field("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ),
        ).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
        F.lit("\r\n" + HTTP_HEAD),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0,
) -> None:
    """Writes ``path/payloads`` and ``path/heads``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")
    )
    addressed = pages.withColumn("address", F.sha2("payload", 256))
    # Copies fall away within each task first, so a page with a third of all rows is sent
    # once per task.
    addressed.select("address", "payload").dropDuplicates(["address"]).write.option(
        "compression", "zstd"
    ).parquet(
        f"{path}/payloads"
    )
    keys = stored(
        addressed.select(
            "page_id",
            "url",
            "address",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
        ),
        "keys",
    )
    first = keys.groupBy("address").agg(
        F.min("page_id").alias("_first"),
        F.min("payload_bytes").alias("_least"),
        F.max("payload_bytes").alias("_most"),
        F.min("payload_digest").alias("_one"),
        F.max("payload_digest").alias("_other"),
    )
    same = (F.col("_least") == F.col("_most")) & (F.col("_one") == F.col("_other"))
    first = first.select(
        F.when(same, F.col("address"))
        .otherwise(F.raise_error(F.concat(F.lit("different payloads with digest "), "address")))
        .alias("address"),
        "_first",
    )
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    (
        keys.withColumn(KEY_HASH, key_hash(["address"]))
        .join(first.withColumn(KEY_HASH, key_hash(["address"])), [KEY_HASH, "address"])
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .select("page_id", "record_type", "address", _head(date).alias("head"))
        .write.parquet(f"{path}/heads")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``record`` (the exact text of the WARC record without the blank lines
    behind it) and ``payload``, which for a revisit is that of the response."""
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.sha2("payload", 256) == F.col("address")
    checked = payloads.select(
        F.when(intact, F.col("address"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "address")))
        .alias("address"),
        "payload",
    )
    block = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    return (
        spark.read.parquet(f"{path}/heads")
        .join(checked, "address")
        .select("page_id", F.concat("head", block).alias("record"), "payload")
    )


def write_warc(records: DataFrame, path: str) -> None:
    """One compressed WARC file per task: records, each with two line ends behind it."""
    (
        records.select("record")
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .text(path)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files ``write_warc`` made: their fields and their payloads.

    A compressed file is not split, so its parts come in order; put together again, they
    are read as any WARC file: a record is as long as its ``Content-Length`` says, whatever
    its payload holds.
    """

    def record(data: bytes, at: int) -> tuple[int, tuple | None]:
        """Where the record that starts at ``at`` ends, and it, if it is there as a whole."""
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return len(data) + 1, None
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = stop + 4 + int(fields["Content-Length"])
        if end + len(END) > len(data):
            return end + len(END), None
        payload = data[stop + 4 + len(HTTP_HEAD) : end]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = fields["WARC-Type"] == "revisit"
        claimed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if data[end : end + len(END)] != END.encode() or not revisit and digest != claimed:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        return end + len(END), (
            fields["WARC-Record-ID"],
            fields["WARC-Type"],
            fields.get("WARC-Target-URI"),
            claimed,
            fields.get("WARC-Refers-To"),
            None if revisit else payload,
        )

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        parts: list[bytes] = []
        have, needed = 0, 1
        for batch in batches:
            out = []
            for part in batch["value"]:
                parts.append(part.encode() + END.encode())
                have += len(parts[-1])
                if have < needed:
                    continue
                data, at = b"".join(parts), 0
                while True:
                    while data[at : at + 2] == b"\r\n":  # at a file's end some may be left
                        at += 2
                    if at == len(data):
                        needed = at + 1
                        break
                    needed, found = record(data, at)
                    if found is None:
                        break
                    out.append(found)
                    at = needed
                parts, have, needed = [data[at:]], len(data) - at, needed - at
            yield list(zip(*out)) if out else [[]] * 6
        if have:
            raise ValueError(f"cut off record: {parts[0][:80]!r}")

    parts = spark.read.option("lineSep", END).text(path)
    return map_rows(
        parts,
        "record_id string, record_type string, url string, payload_digest string, "
        "refers_to string, payload binary",
        work,
    )


def _page_id(record_id: str) -> Column:
    text = F.regexp_extract(record_id, f"^<{RECORD_ID}(.*)>$", 1)
    return F.url_decode(F.when(text != "", text))


def archive_and_read_back(pages: DataFrame) -> DataFrame:
    """Archives ``pages``, rebuilds the records into WARC files, and reads those."""
    spark, path = pages.sparkSession, new_folder(pages.sparkSession, "archive")
    write_archive(pages, path)
    write_warc(read_archive(spark, path), f"{path}/warc")
    id_type = type_of(pages, "page_id")
    records = stored(
        read_warc(spark, f"{path}/warc").select(
            _page_id("record_id").cast(id_type).alias("page_id"),
            F.octet_length("payload").cast("long").alias("_bytes"),
            "payload_digest",
            "record_type",
            _page_id("refers_to").cast(id_type).alias("refers_to"),
        ),
        "records",
    )
    sizes = records.filter("record_type = 'response'").groupBy("payload_digest").agg(
        F.max("_bytes").alias("payload_bytes")
    )
    return (
        records.withColumn(KEY_HASH, key_hash(["payload_digest"]))
        .join(sizes.withColumn(KEY_HASH, key_hash(["payload_digest"])), [KEY_HASH, "payload_digest"])
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
