"""What the operators of this subpackage share: table access, shared storage and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at an ASCII blank: space, or tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def kept(keep: tuple[str, ...], results: tuple[str, ...]) -> tuple[str, ...]:
    """The caller's columns that an operator passes on, each once.

    One rule for all operators: a kept column with the name of a result column gives way to the result, and names
    that begin with "_" are the operators' own, so keeping one is an error. Columns that are not kept never clash.
    """
    own = [c for c in keep if c.startswith("_")]
    if own:
        raise ValueError(f"names that begin with _ are the operators' own: {own}")
    return tuple(dict.fromkeys(c for c in keep if c not in results))


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="acervo-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder of
    its own (as in tests); a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can reach it; one that is gone is no error."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def setting_bytes(value: str) -> int:
    """A size setting in bytes: "64m" is 64 MiB; -1 (no bound) is as large as can be."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", value.lower()).groups()
    return int(number) * _UNITS[unit] if int(number) >= 0 else 1 << 62


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with Arrow batches of a bounded size: very long texts do not add up in a worker.

    The bound is the session's spark.sql.execution.arrow.maxBytesPerBatch, which is lowered to BATCH_BYTES. Spark
    reads it when the plan runs, so it stays lowered.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if setting_bytes(df.sparkSession.conf.get(key)) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def materialize(df: DataFrame, label: str, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """The same rows, reread from a table in the shared folder: lineage ends here, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As materialize, as a bucketed table: what groups it by the key needs no shuffle of it."""
    path = new_path(df.sparkSession, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    atexit.register(_drop, df.sparkSession, name)
    return df.sparkSession.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_of(batches: Iterator[pa.RecordBatch], limit_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none is much over limit_bytes unless a single row is; this bounds what a worker holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * limit_bytes / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
