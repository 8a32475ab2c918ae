"""The audit: what was sent, what was persisted, what is missing and why.

A3 (persisted count), A5 (completeness: summary and missing records), A6
(delivery check). The reference collects every persisted key to the driver
and compares lists there; here both sides stay on the executors.

Missing records are found by *reconciling counts* rather than by a plain
anti-join: sent records and sink rows are unioned and aggregated per group
key, so a hot key (say, the same key on a third of all records) is combined
on the map side before the shuffle and the reconciliation stays exact when
keys repeat. One shuffle on the group key; no broadcast whose size depends on
the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.envelope import GROUP_KEY, as_wall_clock, bytes_to_text, key_to_id


def reconcile(sent: DataFrame, persisted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per group key: records sent, records persisted (sum of ``cnt``) and
    sink rows holding the group."""
    keys = keys or GROUP_KEY
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sent_side = sent.select(
        *keys, one.alias("sent"), zero.alias("persisted"), zero.alias("sink_rows")
    )
    sink_side = persisted.select(
        *keys, zero.alias("sent"), F.col("cnt").cast("bigint").alias("persisted"),
        one.alias("sink_rows"),
    )
    return (
        sent_side.unionByName(sink_side)
        .groupBy(*keys)
        .agg(
            F.sum("sent").alias("sent"),
            F.sum("persisted").alias("persisted"),
            F.sum("sink_rows").alias("sink_rows"),
        )
    )


def reconcile_progress(marked: DataFrame, persisted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """:func:`reconcile` for a stream on its way: ``marked`` are the records sent, with
    ``is_read``; adds ``unread``, the records of the group not read yet."""
    keys = keys or GROUP_KEY
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    unread = F.when(F.col("is_read"), zero).otherwise(one)
    sent_side = marked.select(
        *keys, one.alias("sent"), unread.alias("unread"), zero.alias("persisted"),
        zero.alias("sink_rows"),
    )
    sink_side = persisted.select(
        *keys, zero.alias("sent"), zero.alias("unread"),
        F.col("cnt").cast("bigint").alias("persisted"), one.alias("sink_rows"),
    )
    names = ("sent", "unread", "persisted", "sink_rows")
    both = sent_side.unionByName(sink_side).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    # A batch that committed while the audit read: its records are there, so not unread.
    gap = F.greatest(F.col("sent") - F.col("persisted"), zero)
    return both.withColumn("unread", F.least("unread", gap))


def missing_progress(reconciled: DataFrame, watermark: Column) -> DataFrame:
    """:func:`missing` for a stream on its way, with a third reason: ``unread``."""
    gap = F.col("sent") - F.col("persisted") - F.col("unread")
    read_reason = F.when(F.col("timestamp") <= watermark, F.lit("late")).otherwise(F.lit("withheld"))
    each = F.array(
        F.struct(F.lit("unread").alias("reason"), F.col("unread").alias("n_missing")),
        F.struct(read_reason.alias("reason"), gap.alias("n_missing")),
    )
    return (
        reconciled.where(F.col("sent") > F.col("persisted"))
        .withColumn("m", F.explode(each))
        .where("m.n_missing > 0")
        .select(
            key_to_id("key").alias("id"),
            bytes_to_text("key").alias("key_text"),
            as_wall_clock("timestamp").alias("timestamp"),
            "partition",
            "m.n_missing",
            "m.reason",
        )
    )


def summary_progress(reconciled: DataFrame, watermark: Column) -> DataFrame:
    """:func:`summary` of the records read, and ``missing_unread``."""
    read = reconciled.withColumn("sent", F.col("sent") - F.col("unread"))
    rows = summary(read, watermark)
    zero = F.lit(0).cast("bigint")
    unread = reconciled.agg(F.coalesce(F.sum("unread"), zero).alias("missing_unread"))
    # Two one-row results side by side.
    return (
        rows.select("*", unread.scalar().alias("missing_unread"))
        .withColumn("sent", F.col("sent") + F.col("missing_unread"))
        .withColumn("complete", F.col("complete") & (F.col("missing_unread") == 0))
    )


def watermark_at(ms: int) -> Column:
    """An event-time watermark (epoch milliseconds) as a timestamp literal."""
    return F.timestamp_millis(F.lit(int(ms)))


def expected_watermark(sent: DataFrame, delay: str) -> Column:
    """The watermark a run over ``sent`` ends on once its no-data batch ran:
    max event time, truncated to milliseconds, minus the delay. A scalar
    subquery, evaluated on the executors."""
    newest = sent.agg(F.max("timestamp").alias("m")).scalar()
    return F.timestamp_millis(F.unix_millis(newest)) - F.expr(f"INTERVAL {delay}")


def missing(reconciled: DataFrame, watermark: Column) -> DataFrame:
    """A5: groups with fewer records persisted than sent, identified by the
    key as text (``key_text``) and decoded (``id``, null when the key is not
    decimal text).

    ``reason`` is ``late`` when the record time is at or below the run's
    final watermark (it must have been dropped on arrival: had it been kept
    it would have been emitted) and ``withheld`` above it (still in state,
    waiting for newer data to move the watermark).
    """
    gap = F.col("sent") - F.col("persisted")
    return reconciled.where(gap > 0).select(
        key_to_id("key").alias("id"),
        bytes_to_text("key").alias("key_text"),
        as_wall_clock("timestamp").alias("timestamp"),
        "partition",
        gap.alias("n_missing"),
        F.when(F.col("timestamp") <= watermark, F.lit("late"))
        .otherwise(F.lit("withheld"))
        .alias("reason"),
    )


def summary(reconciled: DataFrame, watermark: Column) -> DataFrame:
    """A3 + A5: one row for the whole audit, computed in one job. Counts are
    0 (never null) on empty input; ``latest_persisted`` is null then."""
    gap = F.greatest(F.col("sent") - F.col("persisted"), F.lit(0).cast("bigint"))
    is_late = F.col("timestamp") <= watermark
    zero = F.lit(0).cast("bigint")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    return reconciled.agg(
        total(F.col("sent")).alias("sent"),
        total(F.col("sink_rows")).alias("persisted_rows"),
        total(F.col("persisted")).alias("persisted"),
        as_wall_clock(F.max(F.when(F.col("sink_rows") > 0, F.col("timestamp")))).alias(
            "latest_persisted"
        ),
        total(F.when(is_late, gap).otherwise(zero)).alias("missing_late"),
        total(F.when(is_late, zero).otherwise(gap)).alias("missing_withheld"),
        total(
            F.when((F.col("sink_rows") > 0) & key_to_id("key").isNull(), F.col("sink_rows"))
            .otherwise(zero)
        ).alias("malformed_keys"),
        (total(gap) == 0).alias("complete"),
    )


def delivery_check(
    sent: DataFrame,
    received: DataFrame,
    expected: int | Column | None = None,
    *more: int | Column | None,
) -> DataFrame:
    """Were at least ``expected`` records received (default: all sent)?

    Reports received, expected and sent side by side, plus the number of
    distinct keys received, so loss and duplication can be told apart; a row
    for each of several expectations. One job over the union of both sides; no collect.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    no_key = F.lit(None).cast("binary")
    tagged = sent.select(one.alias("s"), zero.alias("r"), no_key.alias("k")).unionByName(
        received.select(zero.alias("s"), one.alias("r"), F.col("key").alias("k"))
    )
    out = tagged.agg(
        F.coalesce(F.sum("s"), zero).alias("sent"),
        F.coalesce(F.sum("r"), zero).alias("received"),
        F.countDistinct("k").alias("distinct_keys"),
    )

    def want(e: int | Column | None) -> Column:
        if e is None:
            return F.col("sent")
        return e if isinstance(e, Column) else F.lit(int(e)).cast("bigint")

    wants = F.array(*[want(e) for e in (expected, *more)])
    return out.select(
        "sent", "received", F.explode(wants).alias("expected"), "distinct_keys"
    ).withColumn("ok", F.col("received") >= F.col("expected"))


def fingerprint(records: DataFrame, keys: Column | str = "key", values: Column | str = "value") -> DataFrame:
    """``partition, n, key_sum, key_xor, pair_sum, pair_xor``: digests of each partition's records
    that do not depend on their order. Sums (modulo 2^64, as decimals) count copies, which a xor
    cancels; together they tell multisets apart. Only one row of each partition moves."""

    def digests(name: str, h: Column) -> list[Column]:
        total = F.sum(h.cast("decimal(38,0)")) % F.lit(str(2**64)).cast("decimal(38,0)")
        return [total.cast("decimal(20,0)").alias(f"{name}_sum"), F.bit_xor(h).alias(f"{name}_xor")]

    return records.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"),
        *digests("key", F.xxhash64(keys)),
        *digests("pair", F.xxhash64(keys, values)),
    )


def delivery_fingerprint(sent: DataFrame, received: DataFrame) -> DataFrame:
    """A6 by partition: ``sent``, ``received`` and ``verdict``: ``same`` (the same records), ``values``
    (the same keys, other values), ``lost`` or ``copied`` (fewer or more records), ``other``
    (as many, other keys). Two one-row-a-partition tables are joined."""
    one = fingerprint(sent).select("partition", *[F.col(c).alias(f"s_{c}") for c in FINGERPRINT])
    two = fingerprint(received).select("partition", *[F.col(c).alias(f"r_{c}") for c in FINGERPRINT])
    zero = F.lit(0).cast("bigint")
    both = one.join(two, "partition", "full").select(
        "partition",
        F.coalesce("s_n", zero).alias("sent"),
        F.coalesce("r_n", zero).alias("received"),
        *[F.col(f"s_{c}").eqNullSafe(F.col(f"r_{c}")).alias(c) for c in FINGERPRINT if c != "n"],
    )
    same_keys, same_pairs = F.col("key_sum") & F.col("key_xor"), F.col("pair_sum") & F.col("pair_xor")
    verdict = (
        F.when(F.col("received") < F.col("sent"), "lost")
        .when(F.col("received") > F.col("sent"), "copied")
        .when(same_keys & same_pairs, "same")
        .when(same_keys, "values")
        .otherwise("other")
    )
    return both.select("partition", "sent", "received", verdict.alias("verdict"))


FINGERPRINT = ("n", "key_sum", "key_xor", "pair_sum", "pair_xor")
