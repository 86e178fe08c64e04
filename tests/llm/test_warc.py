import base64
import hashlib
import io
import zipfile

import pytest

from tallyspark import scratch
from tallyspark.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [(1, "http://a/", "same"), (2, "http://b/\r\nx: y", "same"), (3, None, "other é\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (6, "u", "same"), (7, "u", "z" * 300_000)]


def expected(rows, least=0):
    own = {}
    for i, _, h in rows:
        own[h or ""] = max(own.get(h or "", i), i)
    out = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and own[h or ""] != i
        out.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", own[h or ""] if again else None))
    return out


@pytest.mark.parametrize(("zip64", "least", "most", "size"), [(False, 0, 10, 1 << 20), (True, 0, 0, 10), (True, 3, 10, 10)], ids=["plain", "zip64, joined, many packages", "least bytes"])
def test_round_trip(spark, zip64, least, most, size):
    folder = scratch.fresh(spark, "packages")
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    manifest = warc.write_packages(df, folder, least_bytes=least, package_bytes=size, max_broadcast_rows=most, zip64=zip64)
    got = warc.read_packages(manifest, folder, payloads=True).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(ROWS, least)
    by = {r.page_id: r for r in got}
    assert {i: by[i].url for i, u, _ in ROWS} == {i: u for i, u, _ in ROWS}
    assert all(bytes(by[i].payload) == (h or "").encode() for i, _, h in ROWS if by[i].record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_other_readers_open_the_packages_and_ours_opens_theirs(spark):
    folder = scratch.fresh(spark, "packages")
    manifest = warc.write_packages(spark.createDataFrame([(*r, None) for r in ROWS], SCHEMA), folder)
    for row in manifest.collect():
        with zipfile.ZipFile(f"{folder.removeprefix('file://')}/{row['package']}") as z:
            assert z.testzip() is None and len(z.namelist()) == 2 and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/a.warc.gz", b"abc", compress_type=zipfile.ZIP_STORED)
        z.writestr("packed", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    raw.size = lambda: len(raw.getvalue())
    package = warc.PackageReader(raw)
    member = package.members["archive/a.warc.gz"]
    assert package.read(package.data_at(member), member.size) == b"abc"
    with pytest.raises(ValueError, match="compressed"):
        package.data_at(package.members["packed"])


def test_damage_is_an_error():
    with pytest.raises(ValueError, match="end of central directory"):
        raw = io.BytesIO(b"not a zip")
        raw.size = lambda: 9
        warc.PackageReader(raw)
    good = warc.record(1, "u", b"abc", warc.digest(b"abc"), None)
    assert warc.parse(good)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="cut short"):
        warc.parse(good[:-6])


def test_null_ids_repeats_and_empty_tables(spark):
    folder = scratch.fresh(spark, "packages")
    df = spark.createDataFrame([(None, "u", "a", None), (3, "u", "a", None), (3, "u", "a", None)], SCHEMA)
    got = warc.read_packages(warc.write_packages(df, folder), folder).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("3", "response"), ("3", "response"), ("None", "response")]
    folder = scratch.fresh(spark, "packages")
    assert warc.read_packages(warc.write_packages(df.limit(0), folder), folder).count() == 0


def test_a_page_id_with_several_payloads_is_judged_by_each(spark):
    folder = scratch.fresh(spark, "packages")
    df = spark.createDataFrame([(1, "u", "a", None), (1, "u", "b", None), (2, "u", "a", None), (3, "u", "b", None), (3, "u", "a", None)], SCHEMA)
    got = warc.read_packages(warc.write_packages(df, folder), folder).collect()
    payload = {warc.digest(x.encode()): x for x in "ab"}
    assert sorted((r.page_id, payload[r.payload_digest], r.refers_to or 0) for r in got) == [(1, "a", 3), (1, "b", 3), (2, "a", 3), (3, "a", 0), (3, "b", 0)]


def test_many_records_are_read_in_ranges(spark):
    folder = scratch.fresh(spark, "packages")
    rows = [(i, f"http://h/{i}", f"page {i % 1700} é " * (1 + i % 40), None) for i in range(2500)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    manifest = warc.write_packages(df, folder)
    assert manifest.count() == 3
    got = warc.read_packages(manifest, folder, payloads=True).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected([r[:3] for r in rows])


def test_query_over_the_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op7_warc_packages(spark, sf_dir).collect()} == expected(rows)
