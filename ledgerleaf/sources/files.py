"""Documents from files, and documents written as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TEXT_SCHEMA = "value string"
PAGE_SCHEMA = (
    "doc_id bigint, page_number int, text string, "
    "tables array<array<array<string>>>, width double, height double"
)


def readable(text: Column) -> Column:
    """Undecodable bytes dropped, line ends as \\n."""
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    )
    return F.regexp_replace(decoded, "\r\n?", "\n")


def as_documents(raw: DataFrame) -> DataFrame:
    """Rows of whole files as documents keyed by a hash of their path."""
    path = F.col("_metadata.file_path")
    return raw.select(
        F.xxhash64(path).alias("doc_id"),
        path.alias("file_path"),
        F.url_decode(F.element_at(F.split(path, "/"), -1)).alias("original_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("created_at"),
        readable(F.col("value")).alias("text"),
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document of one page per file."""
    return as_documents(spark.read.text(path, wholetext=True))


def write_text_files(docs: DataFrame, folder: str) -> int:
    """Write every row (doc_id, text) as a text file of its own, closed by a line end, into a folder for each task; returns
    how many. The names, `<doc_id>_<row in the task>.txt`, are the same when a task runs again.

    Tasks write the files themselves: Spark's writer moves a file and a folder for each value of a partition column on
    the driver, and starts a process for the rights of each of them where Hadoop's native library is missing."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(folder)
        part, row = f"{root}/{TaskContext.get().partitionId()}", 0
        system.create_dir(part)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                with system.open_output_stream(f"{part}/{key}_{row}.txt") as out:
                    out.write((text.as_py() or b"") + b"\n")
                row += 1
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64())], names=["files"])

    system, root = FileSystem.from_uri(folder)
    system.create_dir(f"{root}/0")  # there are no tasks without documents
    written = docs.select("doc_id", "text").mapInArrow(write, "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def stream_text_files(spark: SparkSession, path: str) -> DataFrame:
    return as_documents(spark.readStream.text(path, wholetext=True))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pre-paged documents, one JSON row per page."""
    return spark.read.schema(PAGE_SCHEMA).json(path)
