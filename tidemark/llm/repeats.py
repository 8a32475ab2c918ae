"""Removal of repeated passages by induced suffix sorting in shards.

Which bytes lie in a string of ``length`` bytes that also starts elsewhere? A
sample of suffixes is sorted, the suffixes before them are induced from it one
character at a time, and common-prefix values are carried along; a suffix
whose common prefix with a neighbour reaches ``length`` starts a repeated string.

* The sample is content-defined, so that equal strings meet in one shard: every
  string of ``length`` bytes belongs to its least hashed ``KMER`` (an anchor). The
  strings that share an anchor's place form a segment; segments are counted by
  anchor hash. An anchor met once repeats nothing; a segment met twice
  repeats as a whole; only anchors with several different segments are sorted.
* Tuples (shard key, suffix at the anchor, the bytes before it) are sorted by
  Spark's external sorter: sorted runs on disk, merged through a priority queue. A
  task holds the tuples of a few keys, whatever the size of its shard.
* Keys carry over half of the string's own bytes, so that an anchor that very many
  texts share is divided by its surroundings. A key that still has more than
  ``TOGETHER`` tuples is deepened: each tuple gives one for the nearer and one for the
  farther half of the strings it stands for, and the new keys carry all bytes that the
  strings of a half have in common. Of tuples with the same bytes one goes on. That ends
  at the latest where a tuple stands for one string and its key for all bytes of it.
* Induction: a stable sort by the preceding byte turns the order of the suffixes
  into that of the suffixes one longer. The common prefix of two neighbours is one
  more than the least value between their old places if they are preceded by the
  same byte, else 0. Suffixes that can no longer reach ``length`` leave.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep
all bytes; matches never cross documents; of repeated rows each counts as
a document, so both lose all; an empty table gives an empty result; other columns are
not read. Rows are numbered once and stored with their numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import dropped, numbered, row_of, saved

KMER = 32
#: Bytes of text looked at together; bounds the memory of a task.
PIECE = 1 << 19
#: Suffixes sorted together, and the most that a key may have to be sorted at all.
TOGETHER = 30_000
_PLACE = np.uint64((1 << 24) - 1)


def _kmers(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the KMER bytes at each place."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) + np.uint64(1)
        factor, size = np.uint64(0x9E3779B97F4A7C15), 1
        while size < KMER:
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, size * 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(data: np.ndarray, ends: np.ndarray, length: int):
    """``(start, windows, lead, anchor)`` of the segments of several texts in one array.

    ``ends[i]``: end of the text that byte i belongs to. ``windows`` strings of
    ``length`` bytes start at ``start`` and on; all have the anchor at ``start + lead``.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashed = _kmers(data)
    # The least hash; of equal ones the first.
    keyed = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)
    place = (_least(keyed, length - KMER + 1) & _PLACE).astype(np.int64)
    inside = np.arange(len(place)) + length <= ends[: len(place)]
    place[~inside] = -1
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    windows = np.diff(np.append(start, len(place)))
    real = place[start] >= 0
    start, windows = start[real], windows[real]
    at = place[start]
    return start, windows, at - start, hashed[at]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Texts joined up to about PIECE bytes: ``([(index, offset in the text)], bytes)``.
    A longer text comes in pieces that share ``length - 1`` bytes."""
    of: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for lo in range(0, max(len(text) - length + 1, 0), PIECE):
            part = text[lo : lo + PIECE + length - 1]
            of.append((i, lo, size))
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield of, b"".join(parts)
                of, parts, size = [], [], 0
    if parts:
        yield of, b"".join(parts)


def segment_rows(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``row, start, windows, lead, anchor, hi, lo`` (digest of its bytes) of every segment."""
    given = docs.select(row_of(docs).alias("row"), F.col(text_col).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = batch.column(0).to_numpy()
            texts = [(t.as_py() or "").encode("utf-8") for t in batch.column(1)]
            for of, joined in _pieces(texts, length):
                data = np.frombuffer(joined, np.uint8)
                index, offset, at = np.array(of, np.int64).T
                ends = np.append(at[1:], len(data))
                start, windows, lead, anchor = segments(data, np.repeat(ends, ends - at), length)
                digests = b"".join(
                    xxhash.xxh3_128_digest(joined[a:b])
                    for a, b in zip(start.tolist(), (start + windows + length - 1).tolist())
                )
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                part = np.searchsorted(at, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[index[part]]),
                        pa.array(start - at[part] + offset[part]),
                        pa.array(windows.astype(np.int32)),
                        pa.array(lead.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                    ],
                    names=["row", "start", "windows", "lead", "anchor", "hi", "lo"],
                )

    return given.mapInArrow(
        cut, "row long, start long, windows int, lead int, anchor long, hi long, lo long"
    )


def _tuples(anchor: int, lead: int, data: bytes, length: int) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """``(key, lead, suffix, before, reach)``: the suffix at the anchor for strings that begin
    close before it, and one that begins further left for the others. The strings begin
    ``reach`` bytes before the suffix at most."""
    half = (length - KMER) // 2
    key = anchor.to_bytes(8, "little", signed=True)
    right = len(data) - lead
    if right >= length - half:  # some string begins at most ``half`` bytes before the anchor
        suffix = data[lead : lead + length]
        near = xxhash.xxh64_intdigest(key + b"r" + suffix[: length - half])
        yield near, lead, suffix, data[max(0, lead - half) : lead], half
    if lead > half:
        at = lead - half - 1
        suffix = data[at : at + length]
        far = xxhash.xxh64_intdigest(key + b"l" + suffix[: half + 1 + KMER])
        yield far, at, suffix, data[:at], length - half - 1 - KMER


def _halves(key: int, at: int, suffix: bytes, before: bytes, reach: int, length: int):
    """The tuples, as of :func:`_tuples`, of both halves of the strings that a tuple stands for."""
    half = reach // 2
    old = key.to_bytes(8, "little", signed=True)
    least = max(0, length - len(suffix))  # nearer strings are not whole
    if least <= min(half, len(before)):
        near = xxhash.xxh64_intdigest(old + b"r" + suffix[: length - half])
        yield near, at, suffix, before[max(0, len(before) - half) :], half
    cut = len(before) - half - 1
    if cut >= 0 and least <= len(before):
        suffix, reach = (before[cut:] + suffix)[:length], reach - half - 1
        far = xxhash.xxh64_intdigest(old + b"l" + suffix[: length - reach])
        yield far, at - half - 1, suffix, before[:cut], reach


def induce(keys: np.ndarray, suffixes: list[bytes], before: list[bytes], length: int) -> np.ndarray:
    """``found[i, t]``: whether the string of ``length`` bytes that begins ``t`` bytes before
    suffix i is also begun by another suffix of the same key.

    Suffixes come sorted by key and bytes.
    """
    n = len(keys)
    room = np.fromiter(map(len, before), np.int64, n)
    found = np.zeros((n, int(room.max(initial=0)) + 1), bool)
    # Text before each suffix, its last byte first.
    lead = np.frombuffer(b"".join(b[::-1] for b in before), np.uint8)
    first = np.cumsum(room) - room
    size = np.fromiter(map(len, suffixes), np.int64, n)
    table = np.frombuffer(b"".join(s.ljust(length, b"\0") for s in suffixes), np.uint8).reshape(n, length)
    group = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
    common = np.zeros(n, np.int64)
    for lo in range(1, n, 4096):
        hi = min(n, lo + 4096)
        differ = table[lo:hi] != table[lo - 1 : hi - 1]
        common[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    common[1:][group[1:] != group[:-1]] = 0
    live = np.arange(n)
    t = 0
    while True:
        whole = common >= length
        found[live[whole], t] = True
        found[live[:-1][whole[1:]], t] = True
        best = np.maximum(common, np.append(common[1:], 0))
        left = room[live] - t
        kept = np.flatnonzero((left > 0) & (best + left >= length))
        if not len(kept):
            return found
        preceding = lead[first[live[kept]] + t]
        bucket = group[live[kept]] * 256 + preceding
        order = np.argsort(bucket, kind="stable")
        bucket, old = bucket[order], kept[order]
        same = np.flatnonzero(bucket[1:] == bucket[:-1])
        between = np.column_stack([old[same] + 1, old[same + 1] + 1]).ravel()
        following = np.zeros(len(old), np.int64)
        if len(between):
            values = np.minimum.reduceat(np.append(common, 0), between)[::2]
            following[same + 1] = np.minimum(values + 1, length)
        live, common = live[old], following
        t += 1


def _runs(found: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(i, first t, last t)`` of each run of found strings."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return zip(i.tolist(), lo.tolist(), (hi - 1).tolist())


def _sorted_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole keys of a sorted stream, some at a time; keys with one row are left out."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield _shared(table.slice(0, last))
        held = table.slice(last).combine_chunks().to_batches()
        rows = table.num_rows - last
    if rows:
        yield _shared(pa.Table.from_batches(held))


def _shared(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_numpy()
    same = keys[1:] == keys[:-1]
    return table.filter(pa.array(np.append(same, False) | np.append(False, same)))


_TUPLE = "key long, suffix binary, before binary, row long, at long, copies long, reach int"
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def _tuple_batch(found: Iterable[tuple]) -> pa.RecordBatch:
    """Rows of ``_TUPLE`` from ``((key, at, suffix, before, reach), row, copies)``."""
    out: list[list] = [[] for _ in _TYPES]
    for (key, at, suffix, before, reach), row, copies in found:
        key = key - (1 << 64) if key >> 63 else key
        for column, v in zip(out, (key, suffix, before, row, at, copies, reach)):
            column.append(v)
    names = ["key", "suffix", "before", "row", "at", "copies", "reach"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _TYPES)], names=names)


def _segment_tuples(docs: DataFrame, mixed: DataFrame, text_col: str, length: int) -> DataFrame:
    """The tuples (``_TUPLE``) of the segments ``mixed``."""
    text = docs.select(row_of(docs).alias("row"), F.col(text_col).alias("text"))
    wanted = mixed.groupBy("row").agg(
        F.collect_list(F.struct("anchor", "start", "windows", "lead", "copies")).alias("parts")
    )

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, text, parts in zip(*[c.to_pylist() for c in batch.columns]):
                data = (text or "").encode("utf-8")
                for p in parts:
                    a = p["start"]
                    part = data[a : a + p["windows"] + length - 1]
                    for key, at, *rest in _tuples(p["anchor"], p["lead"], part, length):
                        yield (key, a + at, *rest), row, p["copies"]

        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                yield _tuple_batch(tuples(whole.slice(lo, 200)))

    return text.join(wanted, "row").select("row", "text", "parts").mapInArrow(fetch, _TUPLE)


def _deepened(tuples: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """``tuples`` under longer keys, one for all with the same bytes, and the spans
    (``row, lo, hi``) of those that are not alone with their bytes."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                rows = zip(*[c.to_pylist() for c in whole.slice(lo, 2000).columns])
                yield _tuple_batch(
                    (half, row, copies)
                    for key, suffix, before, row, at, copies, reach in rows
                    for half in _halves(key, at, suffix, before, reach, length)
                )

    parts = saved(tuples.select(*_names(_TUPLE)).mapInArrow(split, _TUPLE), "deepened")
    same = ["key", "suffix", "before", "reach"]
    alike = parts.groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.first(F.struct("row", "at")).alias("one")
    )
    alike = saved(alike.select(*same, "n", "copies", "one.row", "one.at"), "alike")
    again = parts.where("copies = 1").join(alike.where("n > 1").select(*same), same, "left_semi")
    spans = again.select(
        "row", (F.col("at") - F.length("before")).alias("lo"), (F.col("at") + F.length("suffix")).alias("hi")
    )
    return alike.select(*_names(_TUPLE)), spans


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _induced_spans(tuples: DataFrame, length: int) -> DataFrame:
    """``row, lo, hi``: repeated bytes that sorting each key's tuples finds."""
    parts = int(tuples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tuples.drop("reach").repartition(parts, "key").sortWithinPartitions("key", "suffix")

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _sorted_shards(batches):
            if not shard.num_rows:
                continue
            found = induce(
                shard.column("key").to_numpy(),
                shard.column("suffix").to_pylist(),
                shard.column("before").to_pylist(),
                length,
            )
            rows, at = shard.column("row").to_numpy(), shard.column("at").to_numpy()
            once = shard.column("copies").to_numpy() == 1
            runs = [(rows[i], at[i] - hi, at[i] - lo + length) for i, lo, hi in _runs(found) if once[i]]
            columns = np.array(runs, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, k]) for k in range(3)], names=["row", "lo", "hi"])

    return ordered.mapInArrow(sort, "row long, lo long, hi long")


def _bounded_keys(tuples: DataFrame, length: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of tuples in which no key has more than ``most``, and spans found on the way there."""
    calm, spans = [], []
    while True:
        hot = tuples.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        hot = saved(hot.select("key"), "hot-keys")
        if hot.isEmpty():
            return [*calm, tuples], spans
        # One key for more than ``most`` rows.
        calm.append(tuples.join(F.broadcast(hot), "key", "left_anti"))
        tuples, whole = _deepened(tuples.join(F.broadcast(hot), "key", "left_semi"), length)
        spans.append(whole)


def _sort_segments(docs: DataFrame, mixed: DataFrame, text_col: str, length: int, most: int) -> DataFrame:
    """``row, lo, hi``: repeated bytes of the segments that are met once, ``mixed`` holding one
    place and the number of ``copies`` of every segment of an anchor with several."""
    tuples = saved(_segment_tuples(docs, mixed, text_col, length), "tuples")
    calm, spans = _bounded_keys(tuples, length, most)
    return reduce(DataFrame.unionByName, [*(_induced_spans(t, length) for t in calm), *spans])


def repeated_spans(
    docs: DataFrame, length: int = 200, text_col: str = "text", most: int = TOGETHER
) -> DataFrame:
    """``row, lo, hi``: byte spans, possibly overlapping, that cover all repeated strings.

    Keys with more than ``most`` tuples are deepened before they are sorted.
    """
    if length < 2 * KMER:
        raise ValueError(f"strings must have {2 * KMER} bytes at least")
    docs = numbered(docs, text_col)
    found = saved(segment_rows(docs, text_col, length), "segments")
    differ = (F.min("hi") != F.max("hi")) | (F.min("lo") != F.max("lo"))
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), differ.alias("mixed"))
    shared = anchors.where("n > 1").select("anchor", "mixed")
    shared = saved(found.join(shared, "anchor"), "shared-segments")
    dropped(found)
    keys = ["anchor", "hi", "lo"]
    # All rows of a group have the same bytes, so any one of them stands for them.
    places = ["row", "start", "windows", "lead"]
    each = shared.where("mixed").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in places]
    )
    each = saved(each, "mixed-segments")
    again = each.where("copies > 1").select(*keys)
    whole = shared.where("NOT mixed").unionByName(shared.where("mixed").join(again, keys, "left_semi"), True)
    whole = whole.select(
        "row", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + (length - 1)).alias("hi")
    )
    sorted_out = saved(_sort_segments(docs, each, text_col, length, most), "sorted-spans")
    return whole.unionByName(sorted_out)


def without_repeats(
    docs: DataFrame,
    length: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_bytes: bool = False,
) -> DataFrame:
    """``id, n_bytes, removed`` (maximal spans of bytes), ``kept_sha256`` (and ``kept``) of every row."""
    docs = numbered(docs, id_col, text_col)
    spans = repeated_spans(docs, length, text_col)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    given = docs.select(
        row_of(docs).alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    joined = given.join(spans, "row", "left").select("id", "text", "spans")
    kind = given.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, removed array<struct<lo:long,hi:long>>, kept_sha256 string"
    names = ["id", "n_bytes", "removed", "kept_sha256"] + ["kept"] * keep_bytes
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, removed, digests, kept = [], [], [], []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    data = (text or "").encode("utf-8")
                    merged: list[list[int]] = []
                    for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(s[1], merged[-1][1])
                        else:
                            merged.append(list(s))
                    edges = [0, *(x for m in merged for x in m), len(data)]
                    rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    sizes.append(len(data))
                    removed.append([{"lo": a, "hi": b} for a, b in merged])
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_bytes, names=names)

    return joined.mapInArrow(remove, schema + ", kept binary" * keep_bytes)
