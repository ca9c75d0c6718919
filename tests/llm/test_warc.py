import base64
import hashlib

import duckdb
import pytest
from odd_rows import tuples, with_clashes

from receivables.llm import queries
from receivables.llm import warc as W
from receivables.scratch import new_folder

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/\r\n4", ""),
    (5, "http://a/5", "a\r\n\r\nb\r\n\r\n"),
    (6, "http://a/6", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (7, "http://a/7", "ünï\n日本\r\x00" * 30_000),
    (8, "http://a/8", "<p>one</p>"),
    (9, "http://a/9", "\r\n"),
    (10, "http://a/10", "\r\n\r\n"),
    (11, "u", "same row"),
    (11, "u", "same row"),
    (None, "n", "no id"),
    (None, "n", "<p>one</p>"),
]
FIELDS = "page_id long, url string, html string"


def by_hand(pages):
    least = {}
    for page_id, _, html in pages:
        if page_id is not None:
            least[html or ""] = min(least.get(html or "", page_id), page_id)
    rows = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = least.get(html or "")
        same = page_id == first
        rows.append((page_id, len(payload), digest, "response" if same else "revisit", None if same else first))
    return sorted(rows, key=repr)


def test_round_trip(spark):
    pages = with_clashes(spark.createDataFrame(PAGES, FIELDS)).repartition(4)
    result = W.archive_and_read_back(pages)
    assert result.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert tuples(result) == by_hand(PAGES)


def test_payloads_are_stored_once_and_records_are_exact(spark):
    path = new_folder(spark, "archive")
    W.write_archive(spark.createDataFrame(PAGES, FIELDS), path)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert sorted(bytes(row.payload) for row in stored) == sorted({(p[2] or "").encode() for p in PAGES})
    records = W.read_archive(spark, path).collect()
    assert len(records) == len(PAGES)
    for row in records:
        head, _, block = row.record.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block.encode())
        html = block.removeprefix(W.HTTP_HEAD)
        if fields["WARC-Type"] == "response":
            assert html.encode() == bytes(row.payload)
        else:
            assert html == "" and fields["WARC-Profile"] == W.REVISIT_PROFILE
    (four,) = [row.record for row in records if row.page_id == 4]
    assert "WARC-Target-URI: http://a/%0D%0A4\r\n" in four
    (three,) = [row.record for row in records if row.page_id == 3]
    assert "WARC-Target-URI" not in three


def test_files_hold_the_records(spark, tmp_path):
    path, files = new_folder(spark, "archive"), str(tmp_path / "warc")
    W.write_archive(spark.createDataFrame(PAGES, FIELDS), path)
    records = W.read_archive(spark, path)
    W.write_warc(records, files)
    read = spark.read.format("binaryFile").load(f"{files}/*.gz").collect()
    import gzip

    whole = b"".join(gzip.decompress(bytes(row.content)) for row in read)
    assert sorted(whole) == sorted(b"".join(r.record.encode() + b"\r\n\r\n" for r in records.collect()))


def test_small_payloads_are_all_responses(spark):
    path = new_folder(spark, "archive")
    W.write_archive(spark.createDataFrame(PAGES, FIELDS), path, least_bytes=10**6)
    heads = spark.read.parquet(f"{path}/heads")
    assert {row.record_type for row in heads.collect()} == {"response"}


def test_damage_is_found(spark, tmp_path):
    path = new_folder(spark, "archive")
    W.write_archive(spark.createDataFrame(PAGES[:2], FIELDS), path)
    from pyspark.sql import functions as F

    broken = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    broken.write.parquet(f"{path}/other/payloads")
    spark.read.parquet(f"{path}/heads").write.parquet(f"{path}/other/heads")
    with pytest.raises(Exception, match="damaged payload"):
        W.read_archive(spark, f"{path}/other").collect()
    records = W.read_archive(spark, path)
    for i, record in enumerate((F.replace("record", F.lit("one"), F.lit("two")), F.lit("no record"))):
        W.write_warc(records.withColumn("record", record), str(tmp_path / f"warc{i}"))
        with pytest.raises(Exception, match="damaged record|not a WARC record"):
            W.read_warc(spark, str(tmp_path / f"warc{i}")).collect()


def test_no_pages(spark):
    assert W.archive_and_read_back(spark.createDataFrame([], FIELDS)).count() == 0


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, key):
    sf_dir = "/root/testdata/sf0.01"
    result = queries.queries()[key](spark, sf_dir)
    oracle = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = oracle.execute(queries.oracle_sql()[key])
    names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(names)
    expected = sorted(cursor.fetchall(), key=repr)
    assert expected
    assert tuples(result.select(*names)) == expected
