import hashlib
import os
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodeweave.llm import media
from lodeweave.sources.storage import shared_root
from tests.conftest import DATA


def plain_feature(p):
    rows = [list(p[i : i + 24]) for i in range(0, len(p), 24)]
    n, mean = len(p), sum(p) / len(p)
    bits = ""
    for i in range(8):
        band = rows[i * len(rows) // 8 : (i + 1) * len(rows) // 8]
        for j in range(8):
            bits += str(int(8 * len(rows) * sum(sum(r[3 * j : 3 * j + 3]) for r in band) > sum(p) * len(band)))
    return f"{len(rows)}x24;mean={mean:.4f};var={sum(x * x for x in p) / n - mean**2:.3f};ahash={int(bits, 2):016x}"


def plain(docs):
    out = []
    for doc, text in docs:
        t = (text or "").encode()
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        out.append((doc, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), plain_feature(p)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in frame.collect()), key=str)


@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    p = media.padded(data)
    assert len(p) % media.BLOCK == 0 and p and p.startswith(data)
    stored = media.encode_png(p)
    assert media.decode_png(stored) == p
    assert media.feature(p) == media.feature(p)
    broken = bytearray(stored)
    broken[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(broken))


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = media.media_columns(docs)
    assert rows_of(got) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert got.groupBy("payload_sha256").agg({"media_sha256": "approx_count_distinct"}).where("`approx_count_distinct(media_sha256)` > 1").count() == 0


def test_odd_rows(odd_docs, no_docs):
    assert rows_of(media.media_columns(odd_docs)) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert media.media_columns(no_docs).count() == 0


def test_byte_ranges_and_retries(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(60)], "doc_id long, text string").repartition(2)
    media.write_archives(docs, str(tmp_path), archive_bytes=1000)
    archives = sorted(p.name for p in tmp_path.glob("*.zip"))
    assert len(archives) > 4
    for size in (500, 1 << 20):
        read = media.read_archives(spark, str(tmp_path), rangeBytes=size)
        assert sorted(int(r.member) for r in read.collect()) == list(range(60))
    name = archives[0]
    raw = bytearray((tmp_path / name).read_bytes())
    raw[30 + struct.unpack_from("<H", raw, 26)[0] + 60] ^= 255
    (tmp_path / name).write_bytes(raw)
    rows = media.read_archives(spark, str(tmp_path), onError="row", retries=2).collect()
    bad = [r for r in rows if r.media is None]
    assert len(rows) == 60 and len(bad) == 1 and bad[0].failed == 3 and "crc32" in bad[0].error
    with pytest.raises(Exception, match="crc32"):
        media.read_archives(spark, str(tmp_path)).collect()


def test_empty_null_and_long_ids(spark):
    ids = ["", None, "x", "y" * 70_000]
    docs = spark.createDataFrame([(d, f"text of {i}") for i, d in enumerate(ids)], "doc_id string, text string")
    assert rows_of(media.media_columns(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_own_folder_is_removed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    before = set(os.listdir(shared_root(spark).removeprefix("file:")))
    assert media.media_columns(docs).count() == 1
    assert not [x for x in set(os.listdir(shared_root(spark).removeprefix("file:"))) - before if x.startswith("media-")]
    media.media_columns(docs, str(tmp_path / "kept"))
    assert list((tmp_path / "kept").glob("*.zip"))
