"""Bytes of archive members and Parquet rows, read by ranges of their files.

Files are opened with ``pyarrow.fs`` inside tasks, so any store it knows will do, and
only the ranges wanted are fetched: the directory of an archive, the footer of a
Parquet file, then members and row groups. Work is dealt by Spark, never by file: a
task gets a stretch of an archive or one row group, whatever the size of the file.
"""

from __future__ import annotations

import posixpath
import shutil
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive that one task reads, and bytes of contents in one Arrow batch.
STRETCH, BATCH_BYTES = 64 << 20, 16 << 20
#: The fixed part of a member's header, and the mark that it begins with (both of the archive format).
HEADER, MARK = struct.Struct("<4s5H3I2H"), b"PK\x03\x04"
#: The same for an entry of the directory, the end of an archive, its wide form and the place of that; the flag of names in UTF-8, and where wide forms begin.
ENTRY, ENTRY_MARK = struct.Struct("<4s6H3I5H2I"), b"PK\x01\x02"
END, WIDE_END, WIDE_AT, UTF8, MOST = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI"), 0x800, 0xFFFFFFFF
#: Bytes of a directory read, or of an archive written, at once.
CHUNK = 1 << 20
MEMBERS = "archive_path string, member_path string, start long, packed long, size long, crc long, method int, flags int, reason string"


def opened(path: str) -> pa.NativeFile:
    """The file at a path or address, for random access."""
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    store, name = fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


class _Writer:
    """An archive written member by member; its directory waits in a temporary file, so memory does not grow with the members."""

    def __init__(self, target: pa.NativeFile):
        self.target, self.directory, self.at, self.n = target, tempfile.TemporaryFile(), 0, 0

    def add(self, member: str, content: bytes) -> None:
        name, squeeze = member.encode(), zlib.compressobj(wbits=-15)
        packed = squeeze.compress(content) + squeeze.flush()
        # Version 2.0, names in UTF-8 where they need it, first day of 1980.
        common = (0 if member.isascii() else UTF8, zipfile.ZIP_DEFLATED, 0, 1 << 5 | 1, zlib.crc32(content), len(packed), len(content), len(name))
        self.target.write(HEADER.pack(MARK, 20, *common, 0) + name + packed)
        far = struct.pack("<2HQ", 1, 8, self.at) if self.at >= MOST else b""
        self.directory.write(ENTRY.pack(ENTRY_MARK, 45 if far else 20, 45 if far else 20, *common, len(far), 0, 0, 0, 0, min(self.at, MOST)) + name + far)
        self.at += HEADER.size + len(name) + len(packed)
        self.n += 1

    def close(self) -> None:
        size, n = self.directory.tell(), self.n
        self.directory.seek(0)
        shutil.copyfileobj(self.directory, self.target, CHUNK)
        self.directory.close()
        if n >= 0xFFFF or size >= MOST or self.at >= MOST:
            self.target.write(WIDE_END.pack(b"PK\6\6", WIDE_END.size - 12, 45, 45, 0, 0, n, n, size, self.at) + WIDE_AT.pack(b"PK\6\7", 0, self.at + size, 1))
        self.target.write(END.pack(b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, MOST), min(self.at, MOST), 0))
        self.target.close()


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Write ``members`` (archive, member_path, content) as one archive ``<folder>/<archive>.zip`` each; ``archive, n`` of what was written.

    An archive is one file, so one task writes it, member by member. A task that runs
    again writes its archives anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, z = None, None

        def closed() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n": pa.array([z.n], pa.int64())})

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                for archive, member, content in zip(*(part.column(c).to_pylist() for c in ("archive", "member_path", "content"))):
                    if archive != name:
                        if z:
                            yield closed()
                        store, at = fs.FileSystem.from_uri(folder) if ":" in folder.partition("/")[0] else (fs.LocalFileSystem(), folder)
                        path = posixpath.join(at, f"{archive}.zip")
                        store.create_dir(posixpath.dirname(path))
                        name, z = archive, _Writer(store.open_output_stream(path, buffer_size=CHUNK))
                    z.add(member, content or b"")
        if z:
            yield closed()

    rows = members.select(F.col("archive").cast("string").alias("archive"), F.col("member_path").cast("string").alias("member_path"), F.col("content").cast("binary").alias("content"))
    return rows.repartition("archive").sortWithinPartitions("archive", "member_path").mapInArrow(run, "archive string, n long")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, length`` of the files below ``root``; their contents are not read, so they may have any size. Empty files are not listed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def _directory(file: pa.NativeFile) -> tuple[int, int, int]:
    """Where the directory of an archive begins, its bytes, and what is to be added to the places that it gives."""
    length = file.size()
    back = min(length, END.size + WIDE_AT.size + 0xFFFF)
    file.seek(length - back)
    tail = file.read(back)
    found = tail.rfind(b"PK\5\6")
    if found < 0 or len(tail) - found < END.size:
        raise zipfile.BadZipFile("File is not a zip file")
    *_, size, start, _ = END.unpack_from(tail, found)
    end = length - back + found
    if found >= WIDE_AT.size and tail[found - WIDE_AT.size : found].startswith(b"PK\6\7"):
        at = end - WIDE_AT.size - WIDE_END.size
        file.seek(max(0, at))
        wide = file.read(WIDE_END.size)
        if at >= 0 and wide.startswith(b"PK\6\6"):
            (*_, size, start), end = WIDE_END.unpack(wide), at
    moved = end - size - start
    if moved < 0:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return start + moved, size, moved


def _entries(file: pa.NativeFile, begin: int, size: int, moved: int) -> Iterator[tuple]:
    """Name, place, packed size, size, checksum, method and flags of each member, the directory read chunk by chunk."""
    file.seek(begin)
    held, at, left = b"", 0, size

    def need(n: int) -> None:
        nonlocal held, at, left
        while len(held) - at < n:
            more = file.read(min(CHUNK, left))
            if not more:
                raise zipfile.BadZipFile("Truncated central directory")
            held, at, left = held[at:] + more, 0, left - len(more)

    while left or at < len(held):
        need(ENTRY.size)
        mark, _, version, flags, method, _, _, crc, packed, full, named, extras, noted, _, _, _, start = ENTRY.unpack_from(held, at)
        if mark != ENTRY_MARK:
            raise zipfile.BadZipFile("Bad magic number for central directory")
        if version & 0xFF > zipfile.MAX_EXTRACT_VERSION:
            raise NotImplementedError(f"zip file version {(version & 0xFF) / 10:.1f}")
        need(ENTRY.size + named + extras + noted)
        raw, extra = held[at + ENTRY.size : at + ENTRY.size + named], held[at + ENTRY.size + named : at + ENTRY.size + named + extras]
        at += ENTRY.size + named + extras + noted
        try:
            name = raw.decode("utf-8" if flags & UTF8 else "cp437")
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                if kind == 1:  # sizes and places beyond 32 bits
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full = wide.pop(0) if full == MOST else full
                    packed = wide.pop(0) if packed == MOST else packed
                    start = wide.pop(0) if start == MOST else start
                elif kind == 0x7075 and n > 5 and struct.unpack_from("<BI", extra, 4) == (1, zlib.crc32(raw)):
                    name = extra[9 : 4 + n].decode()
                extra = extra[4 + n :]
        except (UnicodeDecodeError, struct.error, IndexError) as e:
            raise zipfile.BadZipFile(f"Corrupt entry: {e}") from e
        yield name.partition("\0")[0], start + moved, packed, full, crc, method, flags


def list_members(archives: DataFrame, path: str = "path") -> DataFrame:
    """One row of ``MEMBERS`` for each file in each archive, from the directories at the archives' ends; an unreadable archive gives one row with a reason.

    A directory is read twice in chunks, to check it and to list it, and never held whole.
    """

    def listed(name: str) -> Iterator[tuple]:
        try:
            with opened(name) as file:
                where = _directory(file)
                for _ in _entries(file, *where):
                    pass
                for entry in _entries(file, *where):
                    if not entry[0].endswith("/"):
                        yield name, *entry, None
        except FileNotFoundError:
            yield name, *[None] * 7, "archive_not_found"
        except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, pa.ArrowInvalid) as e:
            yield name, *[None] * 7, f"invalid_zip: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = listed(name)
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist([dict(zip(_MEMBERS.names, r)) for r in part], schema=_MEMBERS)

    return archives.select(path).mapInArrow(run, MEMBERS)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_MEMBERS = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in MEMBERS.split(", ")])
_CONTENTS = pa.schema([("archive_path", pa.string()), ("member_path", pa.string()), ("content", pa.binary()), ("reason", pa.string())])


def _member(file: pa.NativeFile, row: dict) -> bytes:
    """The content of a member, checked against its length and checksum."""
    if row["flags"] & 1:
        raise ValueError("it is encrypted")
    if row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {row['method']} is unknown")
    file.seek(row["start"])
    head = file.read(HEADER.size)
    if len(head) < HEADER.size or head[:4] != MARK:
        raise ValueError("no header")
    *_, name, extra = HEADER.unpack(head)
    file.seek(name + extra, 1)
    packed = file.read(row["packed"])
    content = packed if row["method"] == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(packed, row["size"] + 1)
    if len(content) != row["size"] or zlib.crc32(content) != row["crc"]:
        raise ValueError("length or checksum differ")
    return content


def read_members(members: DataFrame) -> DataFrame:
    """``archive_path, member_path, content, reason`` of rows of ``MEMBERS``; filter those first, only what is left is fetched.

    Members of one stretch of an archive are read by one task in the order in which
    they lie there. A member that cannot be read gives its reason, ``bad_member: ...``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, rows, held = None, None, [], 0
        out = lambda: pa.RecordBatch.from_pylist([dict(zip(_CONTENTS.names, r)) for r in rows], schema=_CONTENTS)
        for batch in batches:
            for row in batch.to_pylist():
                content, reason = None, row["reason"]
                if reason is None:
                    try:
                        if row["archive_path"] != name:
                            name, file = row["archive_path"], opened(row["archive_path"])
                        content = _member(file, row)
                    except (ValueError, OSError, zlib.error) as e:
                        reason = f"bad_member: {e}"
                rows.append((row["archive_path"], row["member_path"], content, reason))
                held += len(content or b"") + 1024  # the row itself counts too
                if held >= BATCH_BYTES:
                    yield out()
                    rows, held = [], 0
        yield out()

    stretch = F.floor(F.coalesce("start", F.lit(0)) / STRETCH)
    return members.withColumn("stretch", stretch).repartition("archive_path", "stretch").sortWithinPartitions("archive_path", "start").drop("stretch").mapInArrow(run, "archive_path string, member_path string, content binary, reason string")


def list_row_groups(files: DataFrame, path: str = "path") -> DataFrame:
    """``path, row_group, first, n, reason``: the row groups of Parquet files, from their footers."""
    schema = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    with opened(name) as file:
                        meta, first = pq.ParquetFile(file).metadata, 0
                        for i in range(meta.num_row_groups):
                            rows.append((name, i, first, meta.row_group(i).num_rows, None))
                            first += meta.row_group(i).num_rows
                except FileNotFoundError:
                    rows.append((name, None, None, None, "file_not_found"))
                except (pa.ArrowInvalid, OSError) as e:
                    rows.append((name, None, None, None, f"unreadable_file: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return files.select(path).mapInArrow(run, "path string, row_group int, first long, n long, reason string")


def read_rows(wanted: DataFrame, column: str) -> DataFrame:
    """``path, row_index, content, reason`` of the binary or text column (or the ``bytes`` of a struct) in the rows that ``wanted`` (path, row_index) names.

    Footers are read once a file; then each row group that holds a wanted row is read
    by one task, that column only, and no other row group is touched.
    """
    asked = wanted.select("path", "row_index").distinct()
    groups = list_row_groups(asked.select("path").distinct())
    broken = groups.where("reason is not null").select("path", "reason")
    spans = groups.where("reason is null").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("first", "n", "row_group"))).alias("spans"))
    placed = asked.join(spans, "path", "left").withColumn("span", F.get(F.filter("spans", lambda s: (F.col("row_index") >= s["first"]) & (F.col("row_index") < s["first"] + s["n"])), F.lit(0)))
    found = placed.where("span is not null").select("path", F.col("span.row_group").alias("row_group"), (F.col("row_index") - F.col("span.first")).alias("at"), "row_index")
    lost = placed.where("span is null").join(broken, "path", "left").select("path", "row_index", F.lit(None).cast("binary").alias("content"), F.coalesce("reason", F.lit("row_not_found")).alias("reason"))
    schema = pa.schema([("path", pa.string()), ("row_index", pa.int64()), ("content", pa.binary()), ("reason", pa.string())])

    def take(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("at")
        name, at, index = key[0].as_py(), table["at"].to_pylist(), table["row_index"].to_pylist()
        cells = [None] * len(at)
        reason = None
        try:
            with opened(name) as file:
                reader, done, i = pq.ParquetFile(file), 0, 0
                kind = reader.schema_arrow.field(column).type
                for batch in reader.iter_batches(batch_size=256, row_groups=[key[1].as_py()], columns=[f"{column}.bytes" if pa.types.is_struct(kind) else column]):
                    while i < len(at) and at[i] < done + len(batch):
                        value = batch.column(0)[at[i] - done].as_py()
                        value = value["bytes"] if isinstance(value, dict) else value
                        cells[i] = value.encode() if isinstance(value, str) else value
                        i += 1
                    done += len(batch)
        except (pa.ArrowInvalid, OSError, KeyError) as e:
            reason = f"unreadable_rows: {e}"
        rows = [{"path": name, "row_index": r, "content": c, "reason": reason or (None if c is not None else "no_bytes")} for r, c in zip(index, cells)]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=schema)

    def take_all(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(take(key, table), schema)

    return found.groupBy("path", "row_group").applyInArrow(take_all, "path string, row_index long, content binary, reason string").unionByName(lost)


def read_files(files: DataFrame, path: str = "path") -> DataFrame:
    """``path, content, reason`` of whole files, by name."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with opened(name) as file:
                        row = {"path": name, "content": file.read(), "reason": None}
                except FileNotFoundError:
                    row = {"path": name, "content": None, "reason": "file_not_found"}
                except (OSError, pa.ArrowInvalid) as e:
                    row = {"path": name, "content": None, "reason": f"unreadable_file: {e}"}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select(path).mapInArrow(run, "path string, content binary, reason string")


def resolve_paths(wanted: DataFrame, roots: dict[str, tuple[str, str]], column: str = "image") -> DataFrame:
    """``path, content, reason`` for each distinct ``path`` of ``wanted``, by its scheme.

    ``roots`` maps a scheme to its kind, ``"zip"`` or ``"parquet"``, and the folder that
    containers lie in: ``scheme://container#member`` or ``scheme://container#row``.
    Other paths are files. A scheme's containers are opened once for their directory
    or footer, and only for what is wanted; ``column`` holds the bytes of rows.
    """
    paths = wanted.select("path").where("path is not null").distinct()
    scheme = F.regexp_extract("path", "^([A-Za-z][A-Za-z0-9+.-]*)://[^#]*#", 1)
    asked = paths.withColumn("scheme", scheme).withColumn("container", F.regexp_extract("path", "://([^#]*)#", 1)).withColumn("member", F.regexp_extract("path", "#(.*)$", 1))
    out = read_files(asked.where(~F.col("scheme").isin(*roots)).select("path"))
    for name, (kind, root) in sorted(roots.items()):
        own = asked.where(F.col("scheme") == name).withColumn("file", F.concat(F.lit(posixpath.join(root, "")), "container"))
        if kind == "zip":
            members = list_members(own.select("file").distinct(), "file")
            listed = members.where("reason is null").join(own.select(F.col("file").alias("archive_path"), F.col("member").alias("member_path")), ["archive_path", "member_path"], "left_semi")
            latest = listed.groupBy("archive_path", "member_path").agg(F.max(F.struct(*[F.col(c) for c in _MEMBERS.names[2:]])).alias("m")).select("archive_path", "member_path", "m.*")  # a name may stand twice
            read = read_members(latest.select(_MEMBERS.names)).select(F.col("archive_path").alias("file"), F.col("member_path").alias("member"), "content", "reason")
            broken = members.where("reason is not null").select(F.col("archive_path").alias("file"), F.col("reason").alias("_broken"))
            got = own.join(read, ["file", "member"], "left").join(broken, "file", "left")
            missing = F.col("content").isNull() & F.col("reason").isNull()
            out = out.unionByName(got.select("path", "content", F.when(missing, F.coalesce("_broken", F.lit("member_not_found"))).otherwise(F.col("reason")).alias("reason")))
        elif kind == "parquet":
            numbered = own.withColumn("row_index", F.col("member").try_cast("long"))
            read = read_rows(numbered.where("row_index is not null").select(F.col("file").alias("path"), "row_index"), column).select(F.col("path").alias("file"), "row_index", "content", "reason")
            got = numbered.join(read, ["file", "row_index"], "left")
            out = out.unionByName(got.select("path", "content", F.when(F.col("row_index").isNull(), F.lit("row_not_found")).otherwise(F.col("reason")).alias("reason")))
        else:
            raise ValueError(f"unknown kind of container: {kind}")
    return out
