"""Archives as a Spark data source whose partitions are entries.

The planner reads the end record and the central directory of each archive by
ranged reads, nothing else; every entry becomes a task of its own, which reads and
inflates its bytes in chunks. So an archive of any size is many tasks of bounded
memory. An entry is read twice: once to decide its encoding over all its bytes and to verify its length
and checksum, once to give its lines. What cannot be read is a row with status `error`
and a reason, and its neighbours are read all the same.

A nested archive that is stored is read in place by the same ranges; a compressed one is one task, which inflates it to
scratch space of its own. Encrypted entries, archives of several
disks and other methods than store and deflate are errors. Paths are those that
Arrow's file systems open (local, file://, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import codecs
import re
import struct
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is read, how deep, and what stays in the catalog until asked for.
TEXTS = (".csv", ".txt", ".log", ".tsv", ".dat")
DEPTH, NESTED_BYTES, AUTO_BYTES = 2, 300 << 20, 20 << 20
# Fixed values of the format: signatures, and the field that says "see the 64-bit record".
END, END64, LOCATOR64, ENTRY_SIGN, LOCAL_SIGN, SEE64 = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4", 0xFFFFFFFF
CHUNK, LINES, SCRATCH = 1 << 18, 20_000, 32 << 20

SCHEMAS = {
    "lines": "archive string, path string, seq long, value string, status string, reason string, encoding string",
    "catalog": "archive string, path string, depth int, bytes long, status string, reason string",
    "texts": "archive string, path string, value string, status string, reason string",
}


@dataclass
class Entry(InputPartition):
    """An entry: where its local header is in the archive file, and what the directory says of it."""

    archive: str
    path: str
    depth: int
    status: str
    reason: str | None = None
    size: int = 0
    packed: int = 0
    method: int = 0
    crc: int = 0
    header: int = 0

    @property
    def nested(self) -> bool:
        return self.path.lower().endswith(".zip")


class Ranges:
    """Part of a file that is read by ranges."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size = file, start, size

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.size:
            raise ValueError("a range lies outside the archive")
        self.file.seek(self.start + at)
        data = self.file.read(size)
        if len(data) < size:
            raise ValueError("the archive ends early")
        return data


def opened(uri: str) -> Ranges:
    system, path = fs.FileSystem.from_uri(uri)
    return Ranges(system.open_input_file(path), 0, system.get_file_info(path).size)


def files(uri: str) -> list[str]:
    """The archives below a folder, or the file itself, in order."""
    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        return [uri]
    whole = uri[: len(uri) - len(path)] if uri.endswith(path) else uri.partition("://")[0] + "://"
    return sorted(whole + i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File)


def directory(data: Ranges) -> tuple[int, int, int]:
    """(begin and size of the central directory, bytes before the archive proper)."""
    tail = min(data.size, 22 + 0xFFFF)
    end = data.read(data.size - tail, tail)
    at = end.rfind(END)
    while at >= 0 and (at + 22 > tail or at + 22 + struct.unpack_from("<H", end, at + 20)[0] != tail):
        at = end.rfind(END, 0, at)  # the signature may stand in a comment
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    disk, first, _, _, size, begin = struct.unpack_from("<HHHHII", end, at + 4)
    place = data.size - tail + at
    if place >= 20 and (found := data.read(place - 20, 20)).startswith(LOCATOR64):
        record = struct.unpack_from("<Q", found, 8)[0]
        for where in (record, place - 20 - 56):  # as said, or right before the locator where something was put before the archive
            if 0 <= where <= data.size - 56 and (wide := data.read(where, 56)).startswith(END64):
                disk, first, _, _, size, begin = struct.unpack_from("<IIQQQQ", wide, 16)
                place = where
                break
        else:
            raise ValueError("no 64-bit end record where the locator says")
    if disk or first:
        raise ValueError("archive of several disks")
    before = place - size - begin
    if before < 0:
        raise ValueError("the central directory does not fit the archive")
    return begin + before, size, before


def listed(data: Ranges, archive: str, prefix: str = "", depth: int = 0, whole: bool = False) -> Iterator[Entry]:
    """Entries of an archive as the directory tells them; its bytes are read a chunk at a time."""
    begin, left, before = directory(data)
    held = b""
    while left or held:
        while left and len(held) < CHUNK:
            step = min(left, CHUNK)
            held, begin, left = held + data.read(begin, step), begin + step, left - step
        if not held.startswith(ENTRY_SIGN) or len(held) < 46:
            raise ValueError("damaged central directory")
        flags, method, _, crc, packed, size, name, extra, comment, disk = struct.unpack_from("<HH4sIIIHHHH", held, 8)
        header = struct.unpack_from("<I", held, 42)[0]
        raw, more = held[46 : 46 + name], held[46 + name : 46 + name + extra]
        held = held[46 + name + extra + comment :]
        size, packed, header = sizes64(more, size, packed, header)
        path = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        if path.endswith("/") or artifact(path):
            continue
        entry = Entry(archive, prefix + path, depth, "ready", None, size, packed, method, crc, header + before)
        yield judged(entry, flags, disk, whole)


def sizes64(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and place with the 64-bit ones of the extra field where the 32-bit ones point to them."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, values = extra[at + 4 : at + 4 + length], []
            for v in (size, packed, header):
                if v == SEE64 and len(field) >= 8:
                    v, field = struct.unpack_from("<Q", field)[0], field[8:]
                values.append(v)
            return tuple(values)
        at += 4 + length
    return size, packed, header


def artifact(path: str) -> bool:
    parts = path.split("/")
    return "__MACOSX" in parts or parts[-1].startswith("._")


def judged(e: Entry, flags: int, disk: int, whole: bool) -> Entry:
    """An entry with its status: ready, cataloged (read on demand), skipped or error."""
    say = lambda status, reason=None: replace(e, status=status, reason=reason)
    if flags & 1:
        return say("error", "encrypted")
    if disk:
        return say("error", "entry on another disk")
    if e.method not in (0, 8):
        return say("error", f"method {e.method}")
    if whole:
        return e
    if e.nested:
        return say("skipped", "nested too deep or too large") if e.depth + 1 > DEPTH or e.packed > NESTED_BYTES else e
    if not e.path.lower().endswith(TEXTS):
        return say("skipped", "extension")
    return e if 0 < e.size <= AUTO_BYTES else say("cataloged")


def payload(data: Ranges, e: Entry) -> int:
    """Where the bytes of an entry begin."""
    header = data.read(e.header, 30)
    if not header.startswith(LOCAL_SIGN):
        raise ValueError("no local header where the directory says")
    name, extra = struct.unpack_from("<HH", header, 26)
    return e.header + 30 + name + extra


def chunks(data: Ranges, e: Entry) -> Iterator[bytes]:
    """The bytes of an entry, some at a time, with their length and checksum verified at the end."""
    at, left, size, crc = payload(data, e), e.packed, 0, 0
    inflate = zlib.decompressobj(-15) if e.method == 8 else None
    while left or (inflate and inflate.unconsumed_tail):
        raw = inflate.unconsumed_tail if inflate and inflate.unconsumed_tail else b""
        if not raw:
            step = min(left, CHUNK)
            raw, at, left = data.read(at, step), at + step, left - step
        out = inflate.decompress(raw, CHUNK) if inflate else raw
        size, crc = size + len(out), zlib.crc32(out, crc)
        if size > e.size:
            raise ValueError("longer than the directory says")
        yield out
    if inflate:
        out = inflate.flush()
        size, crc = size + len(out), zlib.crc32(out, crc)
        yield out
    if size != e.size:
        raise ValueError(f"{size} bytes where the directory says {e.size}")
    if crc != e.crc:
        raise ValueError("checksum differs")


def encoding(parts: Iterator[bytes]) -> str:
    """utf-8 if all bytes are, else euc-kr; all parts are read."""
    decoder, valid = codecs.getincrementaldecoder("utf-8")(), True
    for part in parts:
        if valid:
            try:
                decoder.decode(part)
            except UnicodeDecodeError:
                valid = False
    try:
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        valid = False
    return "utf-8" if valid else "euc-kr"


def numbered(parts: Iterator[bytes], name: str) -> Iterator[tuple[int, str]]:
    """(number, text) of the lines that are not blank; lines end at a line feed alone, a carriage return before it goes."""
    held, seq = b"", 0
    for part in parts:
        *whole, held = (held + part).split(b"\n")
        for line in whole:
            yield seq, line
            seq += 1
    yield seq, held


def nested(data: Ranges, e: Entry, whole: bool) -> Iterator[tuple[Ranges, Entry]]:
    """The entries of a nested archive, inflated to scratch space where it is compressed, and of those in it."""
    if e.method == 0:
        inner = Ranges(data.file, data.start + payload(data, e), e.size)
        yield from walked(inner, e, whole)
        return
    with tempfile.SpooledTemporaryFile(SCRATCH) as scratch:
        for part in chunks(data, e):
            scratch.write(part)
        yield from walked(Ranges(scratch, 0, e.size), e, whole)


def walked(inner: Ranges, e: Entry, whole: bool) -> Iterator[tuple[Ranges, Entry]]:
    try:
        for found in listed(inner, e.archive, e.path + "/", e.depth + 1, whole):
            if found.nested and found.status == "ready":
                yield from nested(inner, found, whole)
            else:
                yield inner, found
    except (ValueError, OSError, zlib.error, struct.error) as error:
        yield inner, replace(e, status="error", reason=str(error))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.what = options.get("what", "lines")
        self.uris = options["path"]
        self.all_sizes = options.get("allsizes", "false") == "true"
        self.pattern = options.get("entries")  # a pattern of paths in place of the list of extensions

    def partitions(self) -> list[Entry]:
        found = []
        for uri in files(self.uris):
            try:
                data = opened(uri)
                for e in listed(data, uri, whole=self.pattern is not None):
                    stack = [e]
                    if e.nested and e.status == "ready" and e.method == 0:
                        stack = [replace(x, header=x.header + inner.start) for inner, x in nested(data, e, self.pattern is not None)]
                    found += stack
            except (ValueError, OSError, zlib.error, struct.error) as error:
                found.append(Entry(uri, "", 0, "error", str(error)))
        return found or [Entry("", "", 0, "none")]

    def read(self, partition: Entry) -> Iterator[pa.RecordBatch]:
        if partition.status == "none":
            return
        if partition.nested and partition.status == "ready":
            try:
                inner = nested(opened(partition.archive), partition, self.pattern is not None)
                for data, e in inner:
                    yield from self.rows(data, e)
            except (ValueError, OSError, zlib.error, struct.error) as error:
                yield from self.rows(None, replace(partition, status="error", reason=str(error)))
        else:
            yield from self.rows(opened(partition.archive) if partition.status in ("ready", "cataloged") else None, partition)

    def rows(self, data: Ranges | None, e: Entry) -> Iterator[pa.RecordBatch]:
        if self.pattern is not None and e.status == "ready" and not re.search(self.pattern, e.path):
            return
        if self.what == "catalog":
            yield pa.RecordBatch.from_pylist([{"archive": e.archive, "path": e.path, "depth": e.depth, "bytes": e.size, "status": e.status, "reason": e.reason}], schema=arrow("catalog"))
        elif e.status not in ("ready", "cataloged") or e.status == "cataloged" and not self.all_sizes:
            yield self.told(e)
        else:
            try:
                name = encoding(chunks(data, e))
                yield from self.texts(data, e, name) if self.what == "texts" else self.lines(data, e, name)
            except (ValueError, OSError, zlib.error, struct.error) as error:
                yield self.told(replace(e, status="error", reason=str(error)))

    def told(self, e: Entry) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"archive": e.archive, "path": e.path, "status": e.status, "reason": e.reason}], schema=arrow(self.what))

    def lines(self, data: Ranges, e: Entry, name: str) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            seq, value = zip(*held, strict=True) if held else ((), ())
            return pa.record_batch([pa.array([e.archive] * n, pa.string()), pa.array([e.path] * n, pa.string()), pa.array(seq, pa.int64()), pa.array(value, pa.string()), pa.array(["ready"] * n, pa.string()), pa.nulls(n, pa.string()), pa.array([name] * n, pa.string())], schema=arrow("lines"))

        for seq, raw in numbered(chunks(data, e), name):
            value = raw.removesuffix(b"\r").decode(name, "replace")
            value = value.removeprefix("﻿") if seq == 0 else value
            if value.strip():
                held.append((seq, value))
                if len(held) >= LINES:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    def texts(self, data: Ranges, e: Entry, name: str) -> Iterator[pa.RecordBatch]:
        value = b"".join(chunks(data, e)).decode(name, "replace")
        yield pa.RecordBatch.from_pylist([{"archive": e.archive, "path": e.path, "value": value, "status": "ready", "reason": None}], schema=arrow("texts"))


def arrow(what: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMAS[what].split(", ")])


class ArchiveSource(DataSource):
    """format("gridlens_archive"): option `what` is lines, catalog or texts."""

    @classmethod
    def name(cls) -> str:
        return "gridlens_archive"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "lines")]

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read(spark: SparkSession, path: str, what: str = "lines", all_sizes: bool = False, entries: str | None = None) -> DataFrame:
    """Rows of the archives at `path`, a file or a folder: numbered lines, the catalog, or whole texts of entries that `entries` names."""
    spark.dataSource.register(ArchiveSource)
    options = {"what": what, "allSizes": str(all_sizes).lower()} | ({} if entries is None else {"entries": entries})
    return spark.read.format("gridlens_archive").options(**options).load(path)


def slides(spark: SparkSession, path: str) -> DataFrame:
    """archive, slide, text of presentations: the runs of a slide joined by spaces, slides by their number."""
    found = read(spark, path, "texts", entries=r"^ppt/slides/slide\d+\.xml$")
    number = F.regexp_extract("path", r"(\d+)\.xml$", 1).try_cast("int")
    runs = F.array_join(F.regexp_extract_all("value", F.lit(r"<a:t>([\s\S]*?)</a:t>"), 1), " ")
    return found.select("archive", number.alias("slide"), runs.alias("text"), "status", "reason")


def deck(found: DataFrame) -> DataFrame:
    """archive, text: the slides of each presentation in order, one to a line."""
    told = found.filter("status = 'ready'").groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("slide", "text"))).alias("all"))
    return told.select("archive", F.array_join(F.transform("all", lambda s: s["text"]), "\n").alias("text"))


def pack(rows: DataFrame, folder: str, archive: str = "archive", entry: str = "entry", value: str = "value", order: list[str] | None = None) -> None:
    """Writes lines into one deflated archive for each value of `archive`, an entry for each value of `entry`, a row at a time.

    An archive is one task, as its format asks; a task that is run again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out = zipped = member = now = None

        def close():
            for x in (member, zipped, out):
                if x is not None:
                    x.close()

        for batch in batches:
            for a, e, v in zip(*(batch.column(c).to_pylist() for c in (archive, entry, value)), strict=True):
                if now is None or a != now[0]:
                    close()
                    out = system.open_output_stream(f"{path}/{a}.zip")
                    zipped, member, now = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), None, (a, None)
                if e != now[1]:
                    if member is not None:
                        member.close()
                    member, now = zipped.open(zipfile.ZipInfo(e, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True), (a, e)
                member.write(f"{v}\n".encode())
        close()
        yield from ()

    dealt = rows.select(archive, entry, value, *(order or [])).repartition(archive).sortWithinPartitions(archive, entry, *(order or []))
    dealt.mapInArrow(run, "none int").count()
