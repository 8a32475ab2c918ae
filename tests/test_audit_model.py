"""The count reconciliation against brute-force counting in Python."""

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.envelope import text_to_bytes
from tidemark.operators import audit

T0 = dt.datetime(2024, 1, 1)
KEYS = ["1", "2", "3", "key", "x"]  # "key"/"x" do not decode

rec = st.tuples(st.integers(0, 1), st.integers(0, 3), st.sampled_from(KEYS))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(rec, max_size=40),
    st.lists(st.tuples(rec, st.integers(1, 5)), max_size=10),
    st.integers(0, 3),
)
def test_reconcile_matches_brute_force(spark, sent, sink, cut):
    def to_df(rows, with_cnt):
        schema = "partition int, s int, k string" + (", cnt long" if with_cnt else "")
        flat = [(*r, c) for r, c in rows] if with_cnt else rows
        df = spark.createDataFrame(flat, schema)
        return df.select(
            "partition",
            (F.lit(T0).cast("timestamp") + F.make_interval(secs=F.col("s"))).alias("timestamp"),
            text_to_bytes("k").alias("key"),
            *(["cnt"] if with_cnt else []),
        )

    wm = F.lit(T0).cast("timestamp") + F.make_interval(secs=F.lit(cut))
    rec_df = audit.reconcile(to_df(sent, False), to_df(sink, True))
    def order(t):
        return tuple(-1 if v is None else v for v in t)

    got = sorted(
        ((r.partition, r.timestamp.second, r.id, r.n_missing, r.reason)
         for r in audit.missing(rec_df, wm).collect()),
        key=order,
    )

    sent_n = Counter(sent)
    kept = Counter()
    for r, c in sink:
        kept[r] += c
    want = []
    for r, n in sent_n.items():
        gap = n - kept.get(r, 0)
        if gap > 0:
            p, s, k = r
            ident = int(k) if k.isdigit() else None
            want.append((p, s, ident, gap, "late" if s <= cut else "withheld"))
    assert got == sorted(want, key=order)

    row = audit.summary(rec_df, wm).first()
    assert row.sent == len(sent)
    assert row.persisted == sum(c for _, c in sink)
    assert row.persisted_rows == len(sink)
    assert row.malformed_keys == sum(1 for (_, _, k), _ in sink if not k.isdigit())
    assert row.missing_late == sum(w[3] for w in want if w[4] == "late")
    assert row.missing_withheld == sum(w[3] for w in want if w[4] == "withheld")
    assert row.complete == (not want)
