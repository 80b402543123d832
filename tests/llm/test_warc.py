"""Archives: exact round trips, revisits, rolling, repeatability."""

import hashlib
import os

import pytest

from quern.llm import warc

LONG = "<p>ü</p>" * 40


@pytest.fixture(scope="module")
def rows():
    texts = [LONG, None, "", LONG, "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "\r\n\r\nContent-Length: 7\r\n" * 9, LONG + "z", "big " * 300_000]
    return [(i * 3 - 6, f"http://h/{i}?q=a b\r\nü" if i % 4 else None, t) for i, t in enumerate(texts)]


def test_round_trip_and_revisits(spark, rows, tmp_path):
    pages = spark.createDataFrame([(a, b, c, 1, "f") for a, b, c in rows], "page_id long, url string, html string, digest int, first string")
    folder = f"file://{tmp_path}/one"
    manifest = warc.write(pages, folder, shard_bytes=100_000, roll_bytes=300).collect()
    found = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert len(found) == len(rows) == sum(m.records for m in manifest) and len(manifest) > 3
    first = {}
    for key, _, html in rows:
        payload = (html or "").encode()
        r, at = found[key], first.setdefault(payload, key)
        revisit = len(payload) >= 100 and at != key
        assert (r.record_type, r.refers_to) == (("revisit", at) if revisit else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.payload is None if revisit else bytes(r.payload) == payload
    warc.write(pages.repartition(3), f"file://{tmp_path}/two", shard_bytes=10**9, roll_bytes=10**9)
    warc.write(pages.repartition(2), f"file://{tmp_path}/three", shard_bytes=10**9, roll_bytes=10**9)
    names = [sorted(x for x in os.listdir(tmp_path / d) if x.endswith(".gz")) for d in ("two", "three")]
    assert names[0] == names[1] == ["records-000000-00000.warc.gz"]
    assert (tmp_path / "two" / names[0][0]).read_bytes() == (tmp_path / "three" / names[0][0]).read_bytes()


def test_repeated_rows_null_ids_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", LONG), (1, "u", LONG), (None, "u", LONG), (None, None, "y" * 200), (None, None, "y" * 200)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a")
    found = sorted(((str(r.page_id), r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/a").collect()), key=str)
    assert found == sorted([("1", "response", None), ("1", "revisit", 1), ("None", "response", None), ("None", "revisit", None), ("None", "revisit", 1)], key=str)
    warc.write(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 0


def test_damage_is_found(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/c")
    name = next(x for x in os.listdir(tmp_path / "c") if x.endswith(".gz"))
    data = (tmp_path / "c" / name).read_bytes()
    (tmp_path / "c" / name).write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="archive ends|records|damaged"):
        warc.read(spark, f"file://{tmp_path}/c").count()
