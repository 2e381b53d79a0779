"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes of one Arrow batch: a Python worker holds a few of these, however long the texts are.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20

ASCII_SPACE = "\t\n\x0b\x0c\r "
# One or more characters between words, as Java and Python both read it.
SPACES = "[\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """Rows no model may learn from. A null id counts as the empty string."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name like ``base`` that differs from all taken ones in any letter case."""
    used, name = {column.lower() for column in taken}, base
    while name.lower() in used:
        name += "_"
    return name


def add_struct(frame: DataFrame, result: Column, fields: list[str]) -> DataFrame:
    """Append the fields of a struct column; columns of those names that were there before are replaced."""
    name = fresh(frame.columns, "_result")
    kept = [F.col(f"`{column}`") for column in frame.columns
            if column.lower() not in {field.lower() for field in fields}]
    return frame.withColumn(name, result).select(*kept, *[F.col(f"`{name}`.`{field}`") for field in fields])


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8 bytes; nothing is decoded, so odd bytes do no harm."""
    return texts.cast(pa.binary() if not pa.types.is_large_string(texts.type) else pa.large_binary()).to_pylist()


def give_back() -> None:
    """Return what this Python worker has freed to the system: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. A lambda works out anything else it refers to for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_share(column: Column, seed: int, share: float) -> Column:
    """A share of all keys, the same ones on every run."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/palaver-llm"


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: its lineage ends there, and every executor sees it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int) -> DataFrame:
    """Left join where a key may hold a large share of the left rows: the right side, unique by key, is repeated for
    each salt, and ``spread`` deals the left rows of a key over the salts."""
    salt = fresh([*left.columns, *right.columns], "_salt")
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [*keys, salt], "left").drop(salt)
