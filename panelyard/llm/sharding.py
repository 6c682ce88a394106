"""Sharding by histogram sort: splitters refined from exact byte counts, then one exchange.

Rows are ordered by (hash of the text, id), so equal texts lie side by side. A splitter is found by counting, over all
partitions, the exact bytes below evenly spaced probe keys; only the interval that holds an unresolved target is
probed again, between its own smallest and largest key. When an interval has shrunk to one text hash (a group of equal
texts larger than the tolerance), probing goes on over the ids of that group, so a hot text is divided like any other.
Rounds read a slim table (two longs and a size); texts move once.

Defined cases: a null text has size 1 (no bytes) and sorts with its own hash; a null id sorts first; rows that repeat
both id and text are one key and stay in one shard; an empty table gives no rows; extra columns travel inside the
``doc`` struct, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize
from panelyard.llm.common import scratch_path

LONG_MIN = -(2**63)


@dataclass(frozen=True)
class Splitter:
    """Rows from this key on (``after``: behind it) belong to the right."""

    hash: int
    id: int
    after: bool

    def right(self, h: Column, i: Column) -> Column:
        beyond = i > F.lit(self.id) if self.after else i >= F.lit(self.id)
        return (h > F.lit(self.hash)) | ((h == F.lit(self.hash)) & beyond)


@dataclass
class _Interval:
    """Keys lo..hi of the hash, or of the id under one ``fixed`` hash, with ``below`` bytes before them."""

    lo: int
    hi: int
    below: int
    fixed: int | None = None
    targets: list[tuple[int, float]] = field(default_factory=list)

    def holds(self) -> Column:
        k = F.col("k_hash") if self.fixed is None else F.col("k_id")
        inside = k.between(F.lit(self.lo), F.lit(self.hi))
        return inside if self.fixed is None else (F.col("k_hash") == F.lit(self.fixed)) & inside

    def bin(self, probes: int) -> Column:
        k = F.col("k_hash") if self.fixed is None else F.col("k_id")
        width = self.hi - self.lo + 1
        step = -(-width // probes)
        if width < 2**63:
            return F.call_function("div", k - F.lit(self.lo), F.lit(step)).cast("long")
        return F.floor((k.cast("double") - F.lit(float(self.lo))) / F.lit(float(step))).cast("long")  # monotone, which is all that a bin needs


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 256) -> list[Splitter]:
    """Splitters of (k_hash, k_id, size) rows into ``shards`` parts of equal size.

    A round returns at most (shards - 1) * (probes + 1) rows to the driver, whatever the table's size. ``tolerance`` is a
    share of the ideal shard size; a single key that is larger is never cut, and its nearer edge is taken.
    """
    total, lo, hi = keys.agg(F.sum("size"), F.min("k_hash"), F.max("k_hash")).first()
    if not total:
        return []
    found: dict[int, Splitter] = {}
    slack = tolerance * total / shards
    todo = [_Interval(lo, hi, 0, targets=[(i, total * i / shards) for i in range(1, shards)])]
    while todo:
        where = F.lit(None).cast("struct<at:int,bin:long>")
        for j in reversed(range(len(todo))):
            where = F.when(todo[j].holds(), F.struct(F.lit(j).alias("at"), todo[j].bin(probes).alias("bin"))).otherwise(where)
        key = F.struct("k_hash", "k_id")
        counted = (
            keys.withColumn("where", where).where("where is not null").groupBy("where")
            .agg(F.sum("size").alias("size"), F.min(key).alias("first"), F.max(key).alias("last")).orderBy("where").collect()
        )
        refined: dict[tuple[int, int], _Interval] = {}
        below = [t.below for t in todo]
        for row in counted:
            at, before = row["where"]["at"], below[row["where"]["at"]]
            after = below[at] = before + row["size"]
            first, last = row["first"], row["last"]
            for i, target in todo[at].targets:
                if not before < target <= after:
                    continue
                single = first == last
                if target - before <= slack or (single and target - before <= after - target):
                    found[i] = Splitter(first["k_hash"], first["k_id"], after=False)
                elif after - target <= slack or single:
                    found[i] = Splitter(last["k_hash"], last["k_id"], after=True)
                else:
                    one = first["k_hash"] == last["k_hash"]
                    part = "k_id" if one else "k_hash"
                    refined.setdefault((at, row["where"]["bin"]), _Interval(first[part], last[part], before, first["k_hash"] if one else None)).targets.append((i, target))
        todo = list(refined.values())
    return [found[i] for i in sorted(found)]


def _shard_of(splitters: list[Splitter], lo: int = 0, hi: int | None = None) -> Column:
    """Number of splitters at or below the key, by bisection."""
    hi = len(splitters) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(splitters[mid].right(F.col("k_hash"), F.col("k_id")), _shard_of(splitters, mid + 1, hi)).otherwise(_shard_of(splitters, lo, mid))


def write_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tolerance: float = 0.001) -> str:
    """Write ``df`` as ``shards`` folders of near equal bytes and return the path.

    Columns: doc (the input row as a struct), size (bytes of the text plus 1), place (order within the shard, with
    gaps between tasks), shard.
    """
    h, i = F.xxhash64(df[text_col]), F.coalesce(df[id_col].cast("long"), F.lit(LONG_MIN))
    size = text_bytes(df[text_col]) + 1
    keys = materialize(df.select(h.alias("k_hash"), i.alias("k_id"), size.alias("size")))
    splitters = find_splitters(keys, shards, tolerance)
    path = path or scratch_path(df.sparkSession, "shards")
    (
        df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), size.alias("size"), h.alias("k_hash"), i.alias("k_id"))
        .withColumn("shard", _shard_of(splitters)).repartitionByRange("shard", "k_hash", "k_id").sortWithinPartitions("shard", "k_hash", "k_id")
        .select("doc", "size", F.monotonically_increasing_id().alias("place"), "shard")
        .write.option("compression", "zstd").partitionBy("shard").parquet(path)
    )
    return path


def read_shards(spark, path: str, schema) -> DataFrame:
    """Rows of written shards with ``slot``, the gapless place within the shard.

    ``place`` holds the writing task in its upper 31 bits, so rows of a shard are counted by task and a task's first row
    is set behind those of earlier tasks. That table has a row per task and shard it wrote to, hence the broadcast.
    """
    stored = spark.read.schema(schema).parquet(path)
    task = F.shiftright("place", 33)
    counts = stored.groupBy("shard", task.alias("task")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "task", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    placed = stored.withColumn("task", task).join(F.broadcast(starts), ["shard", "task"])
    return placed.select("doc", "size", "shard", (F.col("place") + F.col("shift")).alias("slot"))


def shard_rows(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, size, shard, slot of every row, read back from the written shards."""
    path = write_shards(df, shards, id_col, text_col)
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields)
    return read_shards(df.sparkSession, path, f"doc struct<{fields}>, size long, place long, shard int")
