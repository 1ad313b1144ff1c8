"""Input manifest, partitioned outputs and CSV export."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import ensure_checkpoint_dir

#: Names of files that the text reader would decompress; they are read whole.
PACKED = r"\.(bz2|deflate|gz|lz4|passthrough|snappy|zst|zstd)$"
MARK, WHOLE = b"\xef\xbb\xbf", str(1 << 60)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: name, size, sha-256, modification time. A digest is computed in order, so one task reads a file, piece by piece."""
    def found(session: SparkSession, form: str, **options) -> DataFrame:
        return session.read.format(form).options(pathGlobFilter=glob, recursiveFileLookup=True, **options).load(path).withColumn("at", F.col("_metadata.file_path"))

    files = found(spark, "binaryFile")
    packed = files.where(F.col("_metadata.file_name").rlike(PACKED)).select("at", F.sha2("content", 256).alias("sha256"))
    plain = spark.newSession()                                         # one task a file: none is cut, none shares a task
    for name in ("maxPartitionBytes", "openCostInBytes"):
        plain.conf.set(f"spark.sql.files.{name}", WHOLE)
    pieces = found(plain, "text", lineSep="\n").where(~F.col("_metadata.file_name").rlike(PACKED))
    hashed = pieces.select("at", F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece")).mapInArrow(digests, "at string, sha256 string")
    out = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    hashed.write.parquet(out)
    known = packed.unionByName(spark.read.parquet(out))
    return files.join(known, "at", "left").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"),
        F.coalesce("sha256", F.when(F.col("length") == len(MARK), F.sha2(F.lit(MARK), 256))).alias("sha256"), F.col("modificationTime").alias("retrieved_at"))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, sha256) of files from their pieces between line feeds, in order. The reader leaves out a last line feed and a byte order mark at
    the start, which the size of the file tells; a file of that mark alone has no pieces."""
    at = size = None

    def ended() -> pa.RecordBatch:
        for start, state in states.items():
            for end in (b"", b"\n"):
                if seen + len(start) + len(end) == size:
                    state.update(end)
                    return pa.RecordBatch.from_pydict({"at": [at], "sha256": [state.hexdigest()]})
        raise ValueError(f"{at}: {seen} bytes read of {size}")

    for b in batches:
        for name, n, piece in zip(b.column("at").to_pylist(), b.column("size").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if name != at:
                if at is not None:
                    yield ended()
                at, size, seen, states = name, n, 0, {start: hashlib.sha256(start) for start in (b"", MARK)}
            else:
                piece = b"\n" + piece
            seen += len(piece)
            for state in states.values():
                state.update(piece)
    if at is not None:
        yield ended()


def manifest_hash(files: DataFrame) -> DataFrame:
    """One hash over the sorted manifest lines (one short line per file)."""
    line = F.concat_ws(" ", "file", "bytes", "sha256")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("manifest_sha256"))


def write_partitioned(df: DataFrame, path: str, key: str = "as_of") -> None:
    """One folder per date; rewriting a date replaces just that date."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(key).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
