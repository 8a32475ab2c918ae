"""Command line for the flows a user runs day to day.

    python -m tidemark ingest --topic DIR|--kafka HOSTS --sink PATH [--for SECONDS]
    python -m tidemark drain  --topic DIR --sink PATH          # bounded run (availableNow)
                              [--poll]                         # audit beside the running query
    python -m tidemark audit  --topic DIR|--kafka HOSTS --sink PATH [--every S --rounds N]
                              [--checkpoint PATH]              # tells unread records from late ones
                              [--daily]                        # sink by day, polls that read what is new
    python -m tidemark compact --sink PATH [--expire-before DATE]        # a sink by day
    python -m tidemark publish --topic DIR|--kafka HOSTS --table PARQUET --form counter|pair|constant
                               --id-col C --time-col C [--key-col C --value-col C]
                               (no --time-col with --kafka: the broker stamps its own time)
    python -m tidemark consume --topic DIR|--kafka HOSTS --expect N | --sent PARQUET   # delivery check
    python -m tidemark roundtrip --path PATH [--n 1000]                  # range -> Parquet -> first 20

``ingest`` starts the watermarked per-key count with a processing-time
trigger at half the delay; ``audit`` prints the completeness summary of the
sink against the topic. The checkpoint sits next to the sink unless
``--checkpoint`` says otherwise; on a cluster both must be shared paths. With ``--daily``
(``ingest``, ``drain``, ``audit``) the sink is the one by day, and the audit of a file topic keeps its totals
beside the sink (``--totals``) and reads only what is new or open at each poll.
"""

from __future__ import annotations

import argparse
import json
import threading
import time

from pyspark.sql import functions as F

from tidemark.functions.envelope import TOPIC, WATERMARK_DELAY
from tidemark.operators import audit
from tidemark.operators.order import first_rows
from tidemark.operators.records import constant_records, counter_records, pair_records
from tidemark.session import build_session
from tidemark.sinks.daily import DailySink, start_daily_sink
from tidemark.sinks.files import overwrite_parquet
from tidemark.sources.tables import id_range, scan_parquet
from tidemark.sources.kafka import KafkaTopic
from tidemark.sources.topic import FileTopic
from tidemark.streaming.flow import StreamSettings, run_count, start_parquet_sink
from tidemark.streaming.live import audit_now, poll, start_ingest, supervise
from tidemark.streaming.watch import Watch


def _topic(spark, args):
    if args.kafka:
        opts = {"starting_offsets": args.starting_offsets}
        if args.isolation_level:
            opts["isolation_level"] = args.isolation_level
        if args.max_offsets_per_trigger:
            opts["max_offsets_per_trigger"] = args.max_offsets_per_trigger
        return KafkaTopic(spark, args.kafka, args.topic_name, **opts)
    return FileTopic(spark, args.topic)


def _settings(args) -> StreamSettings:
    return StreamSettings(
        delay=args.delay,
        state_partitions=args.state_partitions,
        state_store=args.state_store,
    )


def _ask(spark, topic, args, checkpoint: str):
    """One audit round of a sink by day. A topic on Kafka has no files to tell what is new: its
    audit is the full one."""
    if isinstance(topic, FileTopic):
        totals = args.totals or args.sink.rstrip("/") + "_totals"
        return Watch(spark, topic, args.sink, checkpoint, totals).poll
    return lambda: audit_now(
        spark, topic, args.sink, checkpoint=checkpoint, read=lambda s, path: DailySink(s, path).read()
    )


def _poll(spark, query, topic, args, checkpoint: str) -> None:
    ask = _ask(spark, topic, args, checkpoint) if args.daily else None
    for _, row in poll(spark, query, topic, args.sink, args.every, args.rounds, checkpoint, ask):
        print(json.dumps(row.asDict() if row else None, default=str), flush=True)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(
        prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    p.add_argument(
        "command", choices=["ingest", "drain", "audit", "compact", "publish", "consume", "roundtrip"]
    )
    src = p.add_mutually_exclusive_group()
    src.add_argument("--topic", help="directory of a file topic")
    src.add_argument("--kafka", help="bootstrap servers, comma separated")
    p.add_argument("--topic-name", default=TOPIC)
    p.add_argument("--starting-offsets", default="earliest", help="Kafka: where a new query starts")
    p.add_argument("--isolation-level", choices=["read_committed", "read_uncommitted"])
    p.add_argument("--max-offsets-per-trigger", type=int,
                   help="Kafka: bound on records per micro-batch (and so on state)")
    p.add_argument("--sink")
    p.add_argument("--table", help="publish: Parquet table to encode")
    p.add_argument("--form", choices=["counter", "pair", "constant"], default="counter")
    p.add_argument("--id-col")
    p.add_argument("--time-col")
    p.add_argument("--key-col")
    p.add_argument("--value-col")
    p.add_argument("--expect", type=int, default=None, help="consume: records that must be there")
    p.add_argument("--sent", help="consume: Parquet table with a row per record sent")
    p.add_argument("--path", help="roundtrip: where the range table goes")
    p.add_argument("--n", type=int, default=1000)
    p.add_argument("--checkpoint")
    p.add_argument("--daily", action="store_true", help="ingest, drain, audit: the sink by day")
    p.add_argument("--totals", help="--daily: where the audit keeps its totals (default: beside the sink)")
    p.add_argument("--expire-before", metavar="DATE", help="compact: drop the days before that date")
    p.add_argument("--delay", default=WATERMARK_DELAY)
    p.add_argument("--state-partitions", type=int, default=None,
                   help="required outside local mode; frozen into the checkpoint")
    p.add_argument("--state-store", choices=["rocksdb", "hdfs"], default="rocksdb")
    p.add_argument("--for", dest="run_for", type=float, default=None,
                   help="ingest: stop after this many seconds (default: run until stopped)")
    p.add_argument("--restarts", type=int, default=3,
                   help="ingest: restarts on the same checkpoint after a query failure")
    p.add_argument("--poll", action="store_true",
                   help="ingest: print an audit row every --every seconds, --rounds times at most")
    p.add_argument("--every", type=float, default=10.0)
    p.add_argument("--rounds", type=int, default=None)
    p.add_argument("--master", default=None)
    args = p.parse_args(argv)

    needs_topic = args.command not in ("roundtrip", "compact")
    if needs_topic and not (args.topic or args.kafka):
        p.error("--topic or --kafka is required")
    if args.command in ("ingest", "drain", "audit", "compact") and not args.sink:
        p.error("--sink is required")
    if args.command == "consume" and args.expect is None and not args.sent:
        p.error("consume needs --expect N or --sent PARQUET")
    if args.command == "publish" and args.kafka and args.time_col:
        p.error("--time-col: a broker stamps records with the time of their arrival")
    spark = build_session(args.master, app_name=f"tidemark-{args.command}")
    if args.command == "roundtrip":
        path = overwrite_parquet(id_range(spark, args.n), args.path)
        first_rows(scan_parquet(spark, path), "id", 20).show()
        spark.stop()
        return 0
    if args.command == "compact":
        sink = DailySink(spark, args.sink)
        if args.expire_before:
            sink.expire(args.expire_before)
        done = [day for day in sink.days() if sink.compact(day)]
        sink.vacuum()
        print(json.dumps({"days": len(sink.days()), "compacted": len(done)}))
        spark.stop()
        return 0
    topic = _topic(spark, args)
    start = start_daily_sink if args.daily else start_parquet_sink
    checkpoint = args.checkpoint or (args.sink or "").rstrip("/") + "_checkpoint"
    if args.command == "publish":
        table = scan_parquet(spark, args.table)
        if args.kafka:  # the record time is not sent, but the counter form's text holds one
            table, args.time_col = table.withColumn("__now", F.current_timestamp()), "__now"
        if args.form == "counter":
            records = counter_records(table, args.id_col, args.time_col)
        elif args.form == "pair":
            records = pair_records(
                table, args.key_col, args.value_col, args.time_col, args.id_col
            )
        else:
            records = constant_records(table, args.time_col, args.id_col)
        topic.publish(records)
    elif args.command == "consume":
        received = topic.read()
        if args.sent:
            row = audit.delivery_check(scan_parquet(spark, args.sent), received, args.expect).first()
        else:
            row = audit.delivery_check(received.limit(0), received, args.expect).first()
        print(json.dumps(row.asDict()))
    elif args.command == "ingest":
        def begin():
            query = start_ingest(spark, topic, args.sink, checkpoint, _settings(args), start=start)
            if args.poll:
                threading.Thread(
                    target=_poll, args=(spark, query, topic, args, checkpoint), daemon=True
                ).start()
            return query

        supervise(
            begin,
            restarts=args.restarts,
            timeout_s=args.run_for,
        )
    elif args.command == "drain":
        progress = run_count(spark, topic.read_stream(), args.sink, checkpoint, _settings(args), start=start)
        print(json.dumps({"batches": len(progress),
                          "input_rows": sum(p.get("numInputRows", 0) for p in progress)}))
    else:
        rounds = args.rounds or 1
        ask = _ask(spark, topic, args, checkpoint) if args.daily else None
        for n in range(rounds):
            row = ask() if ask else audit_now(
                spark, topic, args.sink, delay=args.delay, checkpoint=args.checkpoint
            )
            print(json.dumps(row.asDict() if row else None, default=str))
            if n + 1 < rounds:
                time.sleep(args.every)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
