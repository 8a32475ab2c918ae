"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
import threading
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import run_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECORDS = threading.local()


@contextlib.contextmanager
def recording():
    """A list of the tables that :func:`saved` writes in the block."""
    made: list[DataFrame] = []
    open_ = _RECORDS.__dict__.setdefault("open", [])
    open_.append(made)
    try:
        yield made
    finally:
        open_.pop()


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut
    there, and a lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    for made in _RECORDS.__dict__.get("open", ()):
        made.append(table)
    return table


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The ``columns`` (default all) of ``df`` and a number of each row, stored with it:
    a later job may read the table in other partitions, and numbers given anew would
    be those of other rows. :func:`row_of` tells the numbers, whose column has a name that
    no other has. A table that was numbered here keeps its numbers."""
    if hasattr(df, "row_column"):
        return df
    rows = df.select(*dict.fromkeys(columns)) if columns else df
    taken, name = {c.lower() for c in rows.columns}, "row_number"
    while name in taken:
        name += "_"
    table = saved(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")
    table.row_column = name
    return table


def row_of(df: DataFrame) -> Column:
    """The stored numbers of a numbered table; else numbers that hold for one job."""
    return F.col(df.row_column) if hasattr(df, "row_column") else F.monotonically_increasing_id()


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`saved` wrote and nobody reads again; no
    harm if they are gone."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    """Buckets for :func:`running`, so that each holds about ``per_bucket`` rows."""
    return max(1, -(-rows // per_bucket))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n_buckets: int,
    out: str,
    weight: Column | None = None,
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` (default 1, so the 0-based rank)
    over the rows of the same ``keys`` that come before the row.

    The order is that of a hash bucket of ``order``, then ``order`` itself. No
    task holds a whole key: rows are dealt by (key, bucket), and only the sums
    of the buckets are ordered per key. ``keys`` must hold no null.
    """
    b = f"__b_{out}"
    spread = df.withColumn(b, F.pmod(F.xxhash64(*order, F.lit(out)), F.lit(n_buckets)))
    w = F.lit(1).cast("long") if weight is None else weight
    sums = spread.groupBy(*keys, b).agg(F.sum(w).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys, b, F.coalesce(F.sum("__sum").over(before), F.lit(0).cast("long")).alias("__start")
    )
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("__in", F.coalesce(F.sum(w).over(inner), F.lit(0).cast("long")))
    return (
        ranked.join(starts, [*keys, b])
        .withColumn(out, F.col("__start") + F.col("__in"))
        .drop(b, "__start", "__in")
    )


def permuted(x: Column, n: Column, *seed: Column, rounds: int = 32) -> Column:
    """A pseudorandom permutation of ``0 .. n-1`` applied to ``x``.

    Swap-or-not rounds: each pairs ``x`` with ``k - x (mod n)`` for a keyed
    ``k`` and swaps the pair on a keyed bit of its larger member, so every
    round, and the whole, is a bijection for any ``n``.
    """

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - acc, n)
        top = F.greatest(acc, other)
        swap = F.xxhash64(*seed, r, top).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)


def small_table(spark: SparkSession, rows: Sequence[tuple], **types: str) -> DataFrame:
    """A DataFrame of a few given rows, built by SQL literals alone."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, types.items())]) for r in rows
    ]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _kept() -> types.ModuleType:
    """What this Python worker keeps between tasks; ``asked``: names that the running one used."""
    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))
    if not hasattr(kept, "made"):
        kept.made, kept.asked = {}, set()
    return kept


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returned for ``key`` in this Python worker before, or returns now.

    Spark's workers run many tasks, each with functions of its own; what is costly to
    build and only saves work (vocabularies, caches of hashes) outlives them here, until
    a task of :func:`lean` that does not ask for it.
    """
    kept, name = _kept(), repr(key)
    kept.asked.add(name)
    if name not in kept.made:
        kept.made[name] = make()
    return kept.made[name]


def lean(
    fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``, whose worker gives back at the end of each task what the
    task does not need any more: a worker waits beside the JVM through the stages that
    follow, and Arrow and the C library keep the freed memory of the largest batches."""

    @functools.wraps(fn)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept()
        kept.asked = set()
        yield from fn(batches)
        for name in kept.made.keys() - kept.asked:
            del kept.made[name]
        _give_back()

    return run


def _give_back() -> None:
    """Free memory goes back to the system, where the allocators can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
