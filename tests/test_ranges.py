"""Members of archives and rows of Parquet files by ranges."""

import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.sources import ranges, scans


def archive(path, members, **kinds):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(name, data, compress_type=kinds.get(name.partition(".")[0], zipfile.ZIP_DEFLATED))


def test_bad_archives_and_members_give_reasons(spark, tmp_path):
    data = {f"m{i}.png": bytes([i]) * (100 * i) for i in range(6)}
    archive(tmp_path / "good.zip", [*data.items(), ("notes.txt", b"x"), ("d/", b""), ("é/ü.PNG", b"u")], m2=zipfile.ZIP_STORED, m3=zipfile.ZIP_LZMA)
    archive(tmp_path / "hurt.zip", [("a.png", b"a" * 500), ("b.png", b"b" * 500)], a=zipfile.ZIP_STORED, b=zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "hurt.zip").read_bytes())
    raw[100] = 0  # inside the first member
    (tmp_path / "hurt.zip").write_bytes(raw)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    got = {(r["archive_path"].rpartition("/")[2], r["member_path"]): r for r in scans.scan_zip_archives(spark, f"file://{tmp_path}").collect()}
    for name, content in data.items():
        row = got["good.zip", name]
        assert (row["error"].startswith("bad_member: compression method") if name == "m3.png" else bytes(row["content"]) == content and row["error"] is None)
    assert bytes(got["good.zip", "é/ü.PNG"]["content"]) == b"u" and ("good.zip", "notes.txt") not in got
    assert got["hurt.zip", "a.png"]["error"].startswith("bad_member") and bytes(got["hurt.zip", "b.png"]["content"]) == b"b" * 500
    assert got["none.zip", None]["error"].startswith("invalid_zip") and len(got) == 6 + 1 + 2 + 1  # scans do not list empty files
    asked = spark.createDataFrame([(str(tmp_path / n),) for n in ("empty.zip", "gone.zip")], "path string")
    assert {r["archive_path"].rpartition("/")[2]: r["reason"].partition(":")[0] for r in ranges.list_members(asked).collect()} == {"empty.zip": "invalid_zip", "gone.zip": "archive_not_found"}


def test_an_archive_over_2_gib_spreads_over_tasks(spark, tmp_path):
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:  # sparse: members lie far apart, with holes between
        with zipfile.ZipFile(f, "w") as z:
            for i in range(12):
                f.seek(i * (200 << 20))
                z.start_dir = f.tell()
                z.writestr(f"m{i}.png", f"content {i}")
    assert path.stat().st_size > 2 << 30
    read = scans.scan_zip_archives(spark, f"file://{tmp_path}").withColumn("task", F.spark_partition_id())
    rows = read.collect()
    assert sorted((r["member_path"], bytes(r["content"])) for r in rows) == sorted((f"m{i}.png", f"content {i}".encode()) for i in range(12))
    plan = ranges.read_members(ranges.list_members(ranges.list_files(spark, f"file://{tmp_path}", "*.zip")))
    assert "hashpartitioning(archive_path" in plan._jdf.queryExecution().toString()
    stretches = ranges.list_members(ranges.list_files(spark, f"file://{tmp_path}", "*.zip")).select(F.floor(F.col("start") / ranges.STRETCH)).distinct().count()
    assert stretches == 12


def shard(path, n, per_group):
    rows = [{"img_id": str(i), "image": {"bytes": f"bytes {i}".encode() * 50, "path": "p"}, "raw": None if i == 7 else f"raw {i}".encode()} for i in range(n)]
    pq.write_table(pa.Table.from_pylist(rows), path, row_group_size=per_group, compression="none", use_dictionary=False)


def test_only_the_row_groups_of_wanted_rows_are_read(spark, tmp_path):
    for name in ("train-0", "train-1"):
        shard(tmp_path / f"{name}.parquet", 100, 10)
    path = tmp_path / "train-0.parquet"
    meta = pq.ParquetFile(path).metadata
    raw = bytearray(path.read_bytes())
    for group in range(10):  # all groups but those of rows 3 and 57 are spoilt
        if group not in (0, 5):
            for c in range(meta.num_columns):
                column = meta.row_group(group).column(c)
                raw[column.data_page_offset : column.data_page_offset + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    path.write_bytes(raw)
    other = tmp_path / "train-1.parquet"
    wanted = [(str(path), 3), (str(path), 57), (f"file://{path}", 50), (str(other), 99), (str(other), 0), (str(other), 100), (str(tmp_path / "gone.parquet"), 1), (str(path), 12)]
    got = {(r["path"], r["row_index"]): r for r in ranges.read_rows(spark.createDataFrame(wanted + wanted[:2], "path string, row_index long"), "image").collect()}
    assert len(got) == len(wanted)
    for key in wanted[:5]:
        assert bytes(got[key]["content"]) == f"bytes {key[1]}".encode() * 50 and got[key]["reason"] is None
    assert [got[k]["reason"] for k in wanted[5:7]] == ["row_not_found", "file_not_found"]
    assert got[wanted[7]]["reason"].startswith("unreadable_rows")  # proof that the other groups are spoilt
    plain = {r["row_index"]: r for r in ranges.read_rows(spark.createDataFrame([(str(other), 7), (str(other), 8)], "path string, row_index long"), "raw").collect()}
    assert plain[7]["reason"] == "no_bytes" and bytes(plain[8]["content"]) == b"raw 8"


def test_paths_are_resolved_by_scheme(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "s").mkdir()
    archive(tmp_path / "z/a.zip", [("x/1.png", b"one"), ("x/2.png", b"two")])
    (tmp_path / "z/bad.zip").write_bytes(b"none")
    shard(tmp_path / "s/train-0.parquet", 20, 5)
    (tmp_path / "plain.png").write_bytes(b"plain")
    wanted = {
        "wildfake-zip://a.zip#x/1.png": (b"one", None), "wildfake-zip://a.zip#x/3.png": (None, "member_not_found"), "wildfake-zip://bad.zip#x": (None, "invalid_zip"), "wildfake-zip://gone.zip#x": (None, "archive_not_found"),
        "sidset-parquet://train-0.parquet#13": (b"bytes 13" * 50, None), "sidset-parquet://train-0.parquet#20": (None, "row_not_found"), "sidset-parquet://train-0.parquet#x": (None, "row_not_found"), "sidset-parquet://gone.parquet#1": (None, "file_not_found"),
        str(tmp_path / "plain.png"): (b"plain", None), str(tmp_path / "gone.png"): (None, "file_not_found"),
    }
    df = spark.createDataFrame([(p, 1) for p in [*wanted, *wanted, None]], "path string, n int")
    got = {r["path"]: r for r in ranges.resolve_paths(df, {"wildfake-zip": ("zip", str(tmp_path / "z")), "sidset-parquet": ("parquet", str(tmp_path / "s"))}).collect()}
    assert set(got) == set(wanted)
    for path, (content, reason) in wanted.items():
        assert (None if got[path]["content"] is None else bytes(got[path]["content"])) == content, path
        assert got[path]["reason"] == reason if reason is None else got[path]["reason"].startswith(reason), path


def test_archives_of_many_members_are_written_and_listed_in_little_memory(tmp_path):
    import tracemalloc

    names = [f"train/{i:06d}.png" for i in range(70_000)]  # more than the plain form of an end can count
    path = str(tmp_path / "many.zip")
    tracemalloc.start()
    z = ranges._Writer(ranges.fs.LocalFileSystem().open_output_stream(path))
    for n in names:
        z.add(n, b"content of " + n.encode())
    z.close()
    with ranges.opened(path) as file:
        count = sum(1 for _ in ranges._entries(file, *ranges._directory(file)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == len(names) and peak < 24 << 20
    with zipfile.ZipFile(path) as check:
        assert check.namelist() == names and check.read(names[66_000]) == b"content of " + names[66_000].encode() and check.testzip() is None


def test_a_directory_is_listed_as_by_the_library(tmp_path):
    path = tmp_path / "odd.zip"
    archive(path, [("a.png", b"a"), ("d/", b""), ("é/ü.PNG", b"u" * 900), ("s.png", b"")], s=zipfile.ZIP_STORED)
    for before, after in ((b"", b""), (b"some bytes in front", b"")):
        moved = tmp_path / f"moved{len(before)}.zip"
        moved.write_bytes(before + path.read_bytes() + after)
        with zipfile.ZipFile(moved) as z, ranges.opened(str(moved)) as file:
            want = [(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits) for i in z.infolist()]
            assert list(ranges._entries(file, *ranges._directory(file))) == want
