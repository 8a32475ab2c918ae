"""Random arrivals against a plain model of the watermark rules.

The model is the specification in ``tidemark.streaming.flow``'s docstring,
written out over a handful of rows; Spark must agree with it exactly.
"""

from helpers import BASE, fixture_records, keys_out, small_settings
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.streaming.replay import run_arrivals

DELAY_S = 20


def model(batches, delay_s=DELAY_S, allow_multiple=True, no_data=True, to_ms=None):
    """Keys emitted by append mode for arrival ``batches`` of (key, second);
    ``to_ms`` maps an event time to epoch milliseconds (default: seconds
    after the fixture base)."""
    to_ms = to_ms or (lambda t: (BASE + t) * 1000)
    d = delay_s * 1000
    newest = None  # max event time (ms) seen in earlier batches
    evict_prev = evict = 0
    state, out = {}, set()
    for rows in batches:
        evict_prev = evict
        if newest is not None:
            evict = max(evict, newest - d)
        late = evict_prev if allow_multiple else evict
        for k, t in rows:
            ms = to_ms(t)
            if ms <= late:
                continue
            state[k] = ms
        for k, ms in list(state.items()):
            if ms <= evict:
                out.add(k)
                del state[k]
        top = max(to_ms(t) for _, t in rows) if rows else None
        if top is not None:
            newest = top if newest is None else max(newest, top)
    if no_data and newest is not None and newest - d > evict:
        evict = newest - d
        out |= {k for k, ms in state.items() if ms <= evict}
    return sorted(out)


times = st.lists(
    st.lists(st.integers(min_value=0, max_value=90), min_size=1, max_size=5),
    min_size=1,
    max_size=4,
)


def _keyed(batches_of_times):
    k, out = 0, []
    for batch in batches_of_times:
        rows = []
        for t in batch:
            rows.append((k, t))
            k += 1
        out.append(rows)
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(times, st.booleans(), st.booleans())
def test_random_arrivals_match_model(spark, batch_times, allow_multiple, no_data):
    batches = _keyed(batch_times)
    run = run_arrivals(
        spark,
        fixture_records(spark, batches),
        "batch",
        len(batches),
        small_settings(allow_multiple=allow_multiple, no_data_batches=no_data),
    )
    assert keys_out(spark, run.sink) == model(
        batches, allow_multiple=allow_multiple, no_data=no_data
    )


def test_model_reproduces_the_boundary_fixture():
    from test_semantics import BOUNDARY

    assert model(BOUNDARY) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert model(BOUNDARY, allow_multiple=False) == [0, 1, 2, 5, 6, 9, 10]


def _event_batches(spark, n_batches):
    """sf0.001's events in arrival batches by the registered rule (Python)."""
    import pyarrow.parquet as pq
    from conftest import SF_SMALL

    from tidemark.streaming.replay import LATE_BY, LATE_EVERY

    ev = pq.read_table(f"{SF_SMALL}/events.parquet", columns=["event_id", "ts"]).to_pylist()
    n = len(ev)
    batches = [[] for _ in range(n_batches)]
    for r in ev:
        i = r["event_id"]
        b = min(n_batches - 1, i * n_batches // n + (LATE_BY if i % LATE_EVERY == 0 else 0))
        batches[b].append((i, r["ts"]))
    return batches


def _to_ms(ts):  # naive UTC wall clock -> epoch ms, truncated like Spark
    import calendar

    return calendar.timegm(ts.timetuple()) * 1000 + ts.microsecond // 1000


def _keys(df):
    return sorted(r.key for r in df.select("key").collect())


def test_registered_arrivals_match_model_on_events(spark):
    """The multi-batch queries against the model, on sf0.001's events with
    the same arrival rule (independent of the SQL statements)."""
    from conftest import SF_SMALL

    from tidemark.plans import catalog
    from tidemark.plans import scenarios as sc

    batches = _event_batches(spark, sc.ARRIVAL_BATCHES)
    assert len(batches) == 6
    assert _keys(catalog.stream_append_multibatch(spark, SF_SMALL)) == model(
        batches, to_ms=_to_ms
    )
    assert _keys(catalog.stream_append_strict_late(spark, SF_SMALL)) == model(
        batches, allow_multiple=False, to_ms=_to_ms
    )
    assert _keys(catalog.stream_nodata_off(spark, SF_SMALL)) == model(
        batches, no_data=False, to_ms=_to_ms
    )


def model_update(batches, delay_s=DELAY_S, allow_multiple=True):
    """(batch, key) pairs update mode emits: every kept record's group, in
    the batch it arrives in (the late rule is the same as in append mode)."""
    d = delay_s * 1000
    newest, evict_prev, evict, out = None, 0, 0, []
    for b, rows in enumerate(batches):
        evict_prev = evict
        if newest is not None:
            evict = max(evict, newest - d)
        late = evict_prev if allow_multiple else evict
        out += [(b, k) for k, t in rows if (BASE + t) * 1000 > late]
        top = max((BASE + t) * 1000 for _, t in rows) if rows else None
        if top is not None:
            newest = top if newest is None else max(newest, top)
    return sorted(out)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(times, st.booleans())
def test_update_mode_matches_model(spark, batch_times, allow_multiple):
    batches = _keyed(batch_times)
    run = run_arrivals(
        spark,
        fixture_records(spark, batches),
        "batch",
        len(batches),
        small_settings(allow_multiple=allow_multiple),
        output_mode="update",
    )
    rows = spark.read.parquet(run.sink).selectExpr(
        "batch_id", "cast(decode(key, 'UTF-8') as int) AS k"
    ).collect()
    assert sorted((r.batch_id, r.k) for r in rows) == model_update(
        batches, allow_multiple=allow_multiple
    )


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(times)
def test_one_run_per_batch_matches_the_current_watermark_model(spark, batch_times):
    """Restarting after each batch (W7) drops by the current batch's
    watermark, like ``allowMultiple=false`` in one run."""
    from tidemark.streaming.replay import run_per_arrival

    batches = _keyed(batch_times)
    run = run_per_arrival(
        spark, fixture_records(spark, batches), "batch", len(batches), small_settings()
    )
    assert keys_out(spark, run.sink) == model(batches, allow_multiple=False)
