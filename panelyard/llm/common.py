"""Expressions and small helpers shared by the document operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.storage import note, scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Java and RE2 pattern of what separates words of ASCII letters, digits and all other non-ASCII characters
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, renamed; whatever else the table holds can't clash with an operator's columns."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def remainder_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder under the folder that driver and executors share; ``release`` deletes it."""
    return note(spark, f"{scratch_dir(spark)}/{what}/{uuid.uuid4().hex}")


#: rows of one Arrow batch
BATCH_ROWS = 1_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once an application, however the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Return freed memory to the system: the C library keeps what many small objects of a training leave, for all later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


_HELD: dict[tuple, object] = {}


def held(key: tuple, build):
    """What a Python worker keeps from task to task, one thing at a time: workers serve all stages, and memories add up."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = build()
    return _HELD[key]


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with a function of this package; every column may hold nulls.

    Rows are whole documents, so the session's batches are limited to BATCH_ROWS rows, which bounds what the executor and
    its Python workers hold.
    """
    ship(df.sparkSession)
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, mask) -> DataFrame:
    """Rows of ``docs``, all columns, for which ``mask`` (texts -> booleans, built once in a task by the call mask()) holds; nothing is exchanged.

    The text column is called ``text``.
    """

    def run(batches):
        judge = mask()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                yield batch.filter(pa.array(judge(batch.column(batch.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return map_arrow(docs, run, docs.schema)
