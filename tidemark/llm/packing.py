"""Best-fit packing of token sequences by residual vectors.

A piece needs (tokens, one document, tokens squared); a bin has capacities for
the three. Pieces go in order of falling length into the open bin that has room
in every dimension and fits best, by residual norm or weighted dot product.
Needs depend on the length alone, so the choice is made once for all pieces of a
length and all bins of one residual: the plan reads the histogram of lengths (at
most ``max_tokens`` rows, whatever the input) and deals out runs of equal pieces
to runs of equal bins. Pieces find their run by their rank among
those of their length, which Spark computes without gathering a length in one task.

Defined cases: a null text is an empty one, and so a sequence of the end token
alone; repeated rows are separate documents; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import buckets_for, lean, per_process, running, saved

#: Kept in each Python worker, some 300 bytes each.
CACHED_WORDS = 200_000
END_MARK = "</w>"
# The splitting rule of the vocabulary for lower-case Latin-1 text
# (contractions, runs of letters, single numbers, runs of other characters).
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PART = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+"
)


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold; ``weights`` scale the three dimensions when bins are compared."""

    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0**2
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


class WordEncoder:
    """Ids of whole texts from ids of words.

    The vocabulary's splitter drops white space and never joins what it
    divides, so a text's ids are those of its words in order. Texts of Latin-1
    characters are lower-cased, split and reduced to their distinct words in bulk; the
    words are divided here by the vocabulary's own rule, and parts not met before go
    to the merges together, where each part ends at a token with the end mark. Words of
    other texts go through the whole tokenizer. Ids already met are kept up to a bound.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = struct.pack("<I", end_id)
        # The same merges for parts that are split and lower-cased already.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        vocabulary = self.merges.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(END_MARK)]] = True
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            ids = self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not end each word by a marked token")
            data, lo = ids.tobytes(), 0
            for part, hi in zip(some, ends):
                self.known[part] = data[lo:hi]
                lo = hi

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct lower-case Latin-1 words."""
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        if len(known) + 2 * len(new) > CACHED_WORDS:
            known.clear()
        # A word of letters alone is one part.
        letters = [words[i] for i in new if words[i].isalpha()]
        other = {words[i]: PART.findall(words[i]) for i in new if not words[i].isalpha()}
        met = {p for parts in other.values() for p in parts}
        met.update(letters)
        self._learn(list(met.difference(known)))
        for word, parts in other.items():
            known[word] = b"".join([known[p] for p in parts])
        for i in new:
            out[i] = known[words[i]]
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        words = lists.flatten().dictionary_encode()
        ids = self._plain_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = words.indices.to_numpy().tolist()
        bounds = lists.offsets.to_numpy().tolist()
        return [b"".join([ids[c] for c in code[a:b]]) + self.end for a, b in zip(bounds, bounds[1:])]

    def _encode_any(self, text: str) -> bytes:
        out = []
        for word in text.encode("utf-8").split():
            if word not in self.words:
                if len(self.words) > CACHED_WORDS:
                    self.words.clear()
                ids = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids
                self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(self.words[word])
        return b"".join(out) + self.end

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        given = [text or "" for text in texts]
        plain = [_is_plain(text) for text in given]
        bulk = iter(self._encode_plain([t for t, p in zip(given, plain) if p]))
        return [next(bulk) if p else self._encode_any(t) for t, p in zip(given, plain)]


def _is_plain(text: str) -> bool:
    """Whether lower-casing and splitting need no more than Latin-1, and no special token is named."""
    if "<|" in text or END_MARK in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(
    docs: DataFrame,
    vocabulary: str,
    max_tokens: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``row, id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every document."""
    given = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    step = 4 * max_tokens
    kind = given.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, piece int, start long, length long, ids_crc32 long"
    names = ["row", "id", "piece", "start", "length", "ids_crc32"]
    if keep_ids:
        schema, names = schema + ", ids binary", [*names, "ids"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(
            ("encoder", vocabulary, end_id), lambda: WordEncoder(vocabulary, end_id)
        )
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(encoder.encode(batch.column(2).to_pylist())):
                    for k, lo in enumerate(range(0, len(got), step)):
                        part = got[lo : lo + step]
                        of.append(i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                columns = [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    batch.column(1).take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(lean(cut), schema)


def plan(histogram: dict[int, int], capacity: Capacity = Capacity()) -> list[tuple[int, int, int, int]]:
    """Runs ``(length, first rank, first sequence, offset)``: pieces of a length,
    by rank, from the first on, go to consecutive sequences at the same offset, until
    the next run of that length.

    Bins with one residual form a run of consecutive sequences; a run is split
    when a length needs a part of it only.
    """
    scale = np.array(capacity.weights) / np.array(
        [capacity.tokens, capacity.documents, capacity.attention], dtype=float
    )
    # Open runs of bins: residual tokens, documents, attention; first sequence; number.
    room = np.zeros((64, 3))
    first = np.zeros(64, dtype=np.int64)
    many = np.zeros(64, dtype=np.int64)
    used = bins = 0
    runs: list[tuple[int, int, int, int]] = []

    def add(left: np.ndarray, seq: int, n: int) -> None:
        nonlocal room, first, many, used
        if left[0] < 1 or left[1] < 1 or left[2] < 1:
            return
        if used == len(many):
            live = np.flatnonzero(many[:used])
            if len(live) > used // 2:
                room = np.concatenate([room, np.zeros_like(room)])
                first, many = np.concatenate([first, first * 0]), np.concatenate([many, many * 0])
            else:
                k = len(live)
                room[:k], first[:k], many[:k] = room[live], first[live], many[live]
                many[k:], used = 0, k
        room[used], first[used], many[used] = left, seq, n
        used += 1

    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1.0, float(length) ** 2])
        if (need > [capacity.tokens, capacity.documents, capacity.attention]).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero((many[:used] > 0) & (room[:used] >= need).all(axis=1))
            if len(fits):
                after = (room[fits] - need) * scale
                if capacity.rule == "dot":
                    best = fits[np.argmin(-(room[fits] * scale) @ (need * scale))]
                else:
                    best = fits[np.argmin(np.einsum("ij,ij->i", after, after))]
                n = int(min(left, many[best]))
                seq, was = int(first[best]), room[best].copy()
                first[best] += n
                many[best] -= n
            else:
                was = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
                # As many bins as these pieces fill by themselves.
                each = int(min(was[0] // length, was[1], was[2] // need[2]))
                n, seq = max(1, left // each) if left >= each else 1, bins
                bins += n
            # A run of bins takes as many rounds of this length as fit and are there.
            while n and left:
                runs.append((length, rank, seq, int(capacity.tokens - was[0])))
                rank += n
                left -= n
                was = was - need
                if (was < need).any() or left == 0:
                    break
                if left < n:
                    add(was, seq + left, n - left)
                    n = left
            add(was, seq, n)
    return runs


def pack(cut: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces of :func:`pieces`.

    ``cut`` must be a stored table: it is read for the histogram and for the ranks.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(histogram, capacity))
    spark = cut.sparkSession
    # At most some runs per length, and lengths are bounded: small for any input.
    table = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 4))
    ranked = running(cut, ["length"], ["row", "piece"], buckets_for(sum(histogram.values())), "rank")
    out = cut.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        # (length, rank) as one sortable number; ranks stay far below 2**50.
        key = (runs[:, 0] << 50) + runs[:, 1] if len(runs) else runs[:, 0]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 50) + rank, side="right") - 1
            columns = [batch.column(c) for c in out.names[:-2]]
            columns.append(pa.array(runs[at, 2] + rank - runs[at, 1]))
            columns.append(pa.array(runs[at, 3]))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return ranked.mapInArrow(lean(place), out)


def best_fit(
    docs: DataFrame,
    vocabulary: str,
    capacity: Capacity = Capacity(),
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and the token offset in it."""
    cut = saved(
        pieces(docs, vocabulary, capacity.tokens, end_id, id_col, text_col, keep_ids), "pieces"
    )
    return pack(cut, capacity)
