"""The archive data source: entries by ranged reads, 64-bit records, damage, nesting, encodings, bounded memory."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlens.sources import archives


def zipped(files, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def wide(name: str, data: bytes) -> bytes:
    """An archive of one stored entry whose sizes, place and counts are in 64-bit records alone."""
    import zlib

    raw, see = name.encode(), 0xFFFFFFFF
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), see, see, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), see, see, len(raw), 28, 0, 0, 0, 0, see) + raw + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    record = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\6\7" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    return local + central + record + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, see, see, 0)


@pytest.fixture()
def folder(tmp_path):
    inner = zipped({"deep.csv": "t,v\n1,2\n", "deeper.zip": zipped({"x.csv": "a\n", "no.zip": zipped({"y.csv": "b"})})})
    late = ("t,v\n" + "1,2\n" * 40_000).encode() + "3,시간\n".encode("euc-kr")
    one = {"a.csv": b"\xef\xbb\xbft,v\r\n1,2\r\n\r\n2,3\rx", "__MACOSX/._a.csv": "x", "b.md": "no", "n.zip": inner, "late.csv": late, "e.csv": "", "d/": "", "한.csv": "한\n"}
    damaged = bytearray(zipped({"good.csv": "1\n2\n", "bad.csv": "q" * 5000 + "\n", "crc.csv": "same size\n"}, zipfile.ZIP_DEFLATED))
    with zipfile.ZipFile(io.BytesIO(bytes(damaged))) as z:
        bad, crc = z.getinfo("bad.csv"), z.getinfo("crc.csv")
    damaged[bad.header_offset + 37 : bad.header_offset + 45] = b"\xff" * 8
    damaged[damaged.find(struct.pack("<I", crc.CRC), crc.header_offset + 30) + 3] ^= 1
    files = {"one.zip": zipped(one), "stored.zip": zipped({"n.zip": inner}, zipfile.ZIP_STORED), "wide.zip": wide("w.csv", b"5\n6\n"), "before.zip": b"#!/bin/sh\n" * 30 + zipped({"p.csv": "7\n"}, comment=b"PK\5\6 in a comment"), "before64.zip": b"x" * 99 + wide("w.csv", b"8\n"), "damaged.zip": bytes(damaged), "no.zip": b"not a zip", "empty.zip": b"", "odd.zip": zipped({"l.csv": "1\n"}, zipfile.ZIP_LZMA)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def rows(df):
    short = F.element_at(F.split("archive", "/"), -1).alias("z")
    return df.select(short, *[c for c in df.columns if c != "archive"])


def test_catalog(spark, folder):
    got = {(r["z"], r["path"]): (r["status"], r["depth"], r["reason"]) for r in rows(archives.read(spark, str(folder), "catalog")).collect()}
    assert got["one.zip", "a.csv"] == ("ready", 0, None) and got["one.zip", "n.zip/deep.csv"] == ("ready", 1, None) and got["one.zip", "n.zip/deeper.zip/x.csv"] == ("ready", 2, None)
    assert got["stored.zip", "n.zip/deeper.zip/x.csv"] == ("ready", 2, None) and got["one.zip", "n.zip/deeper.zip/no.zip"][:2] == ("skipped", 2)
    assert got["one.zip", "b.md"] == ("skipped", 0, "extension") and got["one.zip", "e.csv"][0] == "cataloged" and got["one.zip", "한.csv"][0] == "ready"
    assert got["no.zip", ""][0] == got["empty.zip", ""][0] == "error" and got["odd.zip", "l.csv"] == ("error", 0, "method 14")
    assert not any("MACOSX" in p or p.endswith("/") for _, p in got)


def test_lines_and_errors(spark, folder):
    got = rows(archives.read(spark, str(folder)))
    lines = {}
    for r in sorted(got.filter("status = 'ready'").collect(), key=lambda r: (r["z"], r["path"], r["seq"])):
        lines.setdefault((r["z"], r["path"]), []).append((r["seq"], r["value"]))
    assert lines["one.zip", "a.csv"] == [(0, "t,v"), (1, "1,2"), (3, "2,3\rx")]
    assert lines["one.zip", "n.zip/deep.csv"] == lines["stored.zip", "n.zip/deep.csv"] == [(0, "t,v"), (1, "1,2")]
    assert lines["wide.zip", "w.csv"] == [(0, "5"), (1, "6")] and lines["before.zip", "p.csv"] == [(0, "7")] and lines["before64.zip", "w.csv"] == [(0, "8")]
    assert lines["damaged.zip", "good.csv"] == [(0, "1"), (1, "2")]
    assert len(lines["one.zip", "late.csv"]) == 40_002 and lines["one.zip", "late.csv"][-1] == (40_001, "3,시간")  # decided over all bytes
    wrong = {(r["z"], r["path"]): r["reason"] for r in got.filter("status = 'error'").collect()}
    assert wrong["damaged.zip", "crc.csv"] == "checksum differs" and ("damaged.zip", "bad.csv") in wrong and ("no.zip", "") in wrong
    assert got.filter("status = 'cataloged'").count() == 1
    assert archives.read(spark, str(folder / "one.zip"), all_sizes=True).filter("status = 'cataloged'").count() == 0


def test_an_entry_is_a_task(spark, tmp_path):
    (tmp_path / "many.zip").write_bytes(zipped({f"{i}.csv": f"{i}\n" * 10 for i in range(12)}))
    df = archives.read(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 12 and df.count() == 120


def test_reading_keeps_little_in_memory(tmp_path):
    """64 MB that shrink to nearly nothing pass in chunks: no read, no chunk and no batch is longer than its bound."""
    (tmp_path / "big.zip").write_bytes(zipped({"big.csv": b"0123456789abcde\n" * (4 << 20)}))
    reader = archives.ArchiveReader({"path": str(tmp_path), "allSizes": "true"})
    (entry,) = reader.partitions()
    data = archives.opened(entry.archive)
    assert max(len(c) for c in archives.chunks(data, entry)) <= archives.CHUNK
    assert max(b.num_rows for b in reader.read(entry)) <= archives.LINES
    import tracemalloc

    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(entry))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 4 << 20 and most < 24 << 20


def test_slides(spark, tmp_path):
    page = "<p><a:t>{}</a:t><a:t>two\nlines</a:t></p>".format
    (tmp_path / "deck.pptx").write_bytes(zipped({f"ppt/slides/slide{i}.xml": page(i) for i in (10, 2, 1)} | {"ppt/slides/_rels/slide1.xml": "no", "x.txt": "no"}))
    (tmp_path / "bad.pptx").write_bytes(b"no")
    found = archives.slides(spark, str(tmp_path))
    assert [r["text"] for r in archives.deck(found).collect()] == ["1 two\nlines\n2 two\nlines\n10 two\nlines"]
    assert found.filter("status = 'error'").count() == 1


def test_packed_lines_come_back(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("archive"), F.concat(F.lit("e"), F.col("id") % 2, F.lit(".csv")).alias("entry"), F.col("id").cast("string").alias("value"), "id")
    archives.pack(df, f"file://{tmp_path}/z", order=["id"])
    back = archives.read(spark, f"file://{tmp_path}/z")
    assert back.count() == 1000 and back.select("archive", "path").distinct().count() == 6
    assert {int(r["value"]) for r in back.collect()} == set(range(1000))
    assert [int(r["value"]) for r in back.filter("path = 'e0.csv' and archive like '%/0.zip'").orderBy("seq").collect()] == list(range(0, 1000, 6))
