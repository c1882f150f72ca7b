"""Reports as one file each, there whole or not at all.

A report has one writer by its nature. The task writes beside the target under a name
of its own; the commit moves that file to its place, an abort removes it. A task that
fails or runs twice therefore never shows a part of a report.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, text: bool):
        self.path, self.text = path, text

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, target = _located(self.path)
        store.create_dir(posixpath.dirname(target))
        part, rows, out = f"{target}.{uuid.uuid4().hex}.part", 0, None
        with store.open_output_stream(part) as file:
            for batch in iterator:
                if self.text:
                    for line in batch.column(0).to_pylist():
                        file.write(f"{line}\n".encode())
                else:
                    out = out or csv.CSVWriter(file, batch.schema, write_options=csv.WriteOptions(quoting_style="needed"))
                    out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        return Written(part, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m for m in messages if m is not None]
        if len(parts) > 1:
            self.abort(messages)
            raise ValueError("a report has one writer: write it from one partition")
        store, target = _located(self.path)
        for m in parts:
            store.move(m.part, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _located(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.part).type == fs.FileType.File:
                store.delete_file(m.part)


class ReportFile(DataSource):
    """Format ``report_file``: option ``path`` names the file; ``text`` writes the first column as lines, else CSV with a header."""

    @classmethod
    def name(cls) -> str:
        return "report_file"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("text", "false").lower() == "true")


def write_report(df: DataFrame, path: str, *order: str, text: bool = False) -> None:
    """``df`` in the given order as one file at ``path``, in place of a former one. Its header is there even if it has no rows."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(ReportFile)
    rows = (df.orderBy(*order) if order else df).coalesce(1)
    if not text:
        # One line of nothing would lose the header, so an empty report is written as lines.
        names = ",".join(f'"{c}"' for c in df.columns)
        if df.isEmpty():
            rows, text = spark.range(1).select(F.lit(names)).coalesce(1), True
    rows.write.format("report_file").mode("append").option("path", path).option("text", str(text).lower()).save()


def error_lines(errors: DataFrame, filtered: DataFrame, key: str = "image_id", p: str = "p") -> DataFrame:
    """``line``s of the error report as Markdown tables, in the order of ``at``: sure false positives, false negatives, and false positives among filtered originals."""
    row = F.concat(F.lit("| `"), F.col(key).cast("string"), F.lit("` | "), F.format_number(F.col(p).cast("double"), 2), F.lit(" |"))
    spark = errors.sparkSession

    def section(number: int, title: str, rows: DataFrame) -> DataFrame:
        head = spark.createDataFrame([(number, -3 + i, line) for i, line in enumerate((f"## {title}", "| Image | Score |", "|---|---|"))], "part int, at long, line string")
        ranked = rows.select(F.lit(number).alias("part"), F.col("rank").cast("long").alias("at"), row.alias("line"))
        return head.unionByName(ranked)

    out = section(0, "False positives", errors.where("kind = 'false_positive'"))
    out = out.unionByName(section(1, "False negatives", errors.where("kind = 'false_negative'")))
    return out.unionByName(section(2, "False positives among filtered originals", filtered.where("kind = 'false_positive'")))
