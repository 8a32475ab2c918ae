"""Quality rules: counts of words, symbols and repeats, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that says
the same again and again compresses far better than prose of its length, random
characters far worse; how well prose compresses depends on its length, so each length
has its own limits (``Bands``). A text fails when its whole ratio lies outside the limits
of its length, or when more than ``chunk_share`` of its bytes lie in chunks outside
theirs: a repetitive or random passage shows in its chunks where the whole hides it.

Defined cases: a null text has no words, no bytes and no ratio; an empty or blank one has
no words; both fail the base rule (fewer than ``LEAST_WORDS`` words). Texts and last
chunks shorter than the first limit are in band. Repeated rows are judged alike;
an empty table gives an empty result; other columns are not read. One scan without a
shuffle; a long text is read in pieces, of which only word numbers are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"
LEAST_WORDS = 10
WINDOW = 5
#: Most words, in per cent, in windows found twice or more.
MOST_REPEATED = 20


@dataclass(frozen=True)
class Bands:
    """``limits``: (from so many bytes on, least ratio, most ratio) of compressed bytes to
    bytes, by ascending length. Prose takes 0.6 of its bytes at 512 bytes, 0.5 at 2 KiB and 0.4
    beyond 16 KiB (less where a letter takes two bytes); base64 of random bytes takes 0.76."""

    limits: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 1.05),
        (256, 0.30, 0.90),
        (512, 0.27, 0.80),
        (1024, 0.24, 0.74),
        (2048, 0.21, 0.70),
        (4096, 0.18, 0.68),
        (16384, 0.16, 0.66),
    )
    chunk_bytes: int = 2048
    chunk_share: float = 0.3
    level: int = 3

    def side(self, raw: int, packed: int) -> int:
        """-1 for too repetitive, 1 for incompressible, 0 in band."""
        for least_bytes, low, high in reversed(self.limits):
            if raw >= least_bytes:
                return int(packed > high * raw) - int(packed < low * raw)
        return 0


class Measure:
    """Counts and bands of whole texts."""

    def __init__(self, bands: Bands, piece: int = 1 << 20):
        self.bands = bands
        self.piece = piece
        self.packer = zstandard.ZstdCompressor(level=bands.level)

    def word_ids(self, data: bytes) -> np.ndarray:
        """A number for each word: the same for equal words."""
        numbers: dict[bytes, int] = {}
        found, at = [], 0
        while at < len(data):
            end = at + self.piece
            # A piece ends where white space starts, or the text does.
            piece = data[at:end]
            if end < len(data):
                cut = max(piece.rfind(s.encode()) for s in SPACES)
                while cut < 0:
                    end += self.piece
                    piece = data[at:end]
                    cut = max(piece.rfind(s.encode()) for s in SPACES) if end < len(data) else len(piece)
                piece = piece[: cut + 1]
            words = piece.split()
            found.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            at += len(piece)
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def repeated(self, ids: np.ndarray) -> int:
        """Words in windows that are found twice or more."""
        n = len(ids) - WINDOW + 1
        if n < 2:
            return 0
        # The number of a window of k + 1 words: that of its first k and its last one.
        name = ids
        for k in range(1, WINDOW):
            pair = name[:-1] * (ids.max() + 1) + ids[k:]
            _, name = np.unique(pair, return_inverse=True)
        twice = np.bincount(name)[name] > 1
        edge = np.zeros(len(ids) + 1, np.int64)
        starts = np.flatnonzero(twice)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge) > 0).sum())

    def duplicate_lines(self, text: str) -> int:
        """Lines with a word that are equal to an earlier line."""
        seen: set[str] = set()
        again, at = 0, 0
        while at <= len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            if line.strip(SPACES):
                again += line in seen
                seen.add(line)
            at = end + 1
        return again

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8")
        ids = self.word_ids(data)
        size = len(data)
        packed = len(self.packer.compress(data)) if size else 0
        low = high = 0
        step = self.bands.chunk_bytes
        for at in range(0, size, step) if size > step else ():
            chunk = data[at : at + step]
            side = self.bands.side(len(chunk), len(self.packer.compress(chunk)))
            low += len(chunk) * (side < 0)
            high += len(chunk) * (side > 0)
        return (
            len(ids),
            len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)),
            self.duplicate_lines(text),
            self.repeated(ids),
            size,
            packed,
            self.bands.side(size, packed),
            low,
            high,
        )


COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_bytes", "n_packed", "band", "low_bytes", "high_bytes",
)


def judge(
    docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, the counts, ``n_bytes``, ``n_packed`` (compressed), ``band`` of the whole text,
    ``low_bytes`` and ``high_bytes`` in chunks out of band, ``base_failed``, ``reason``, ``kept``.

    ``reason``: the first rule that fails (``words``, ``repeats``, ``repetitive``,
    ``incompressible``, ``chunks``), else null.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Measure(bands)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = [one(t.as_py()) for t in batch.column(1)]
                counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts], names=["id", *COLUMNS])

    kind = given.schema["id"].dataType.simpleString()
    told = given.mapInArrow(measure, f"id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS))
    few = F.col("n_words") < LEAST_WORDS
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    out_of_band = F.col("low_bytes") + F.col("high_bytes") > bands.chunk_share * F.col("n_bytes")
    reason = (
        F.when(few, "words")
        .when(repeats, "repeats")
        .when(F.col("band") < 0, "repetitive")
        .when(F.col("band") > 0, "incompressible")
        .when(out_of_band, "chunks")
    )
    return (
        told.withColumn("base_failed", few | repeats)
        .withColumn("reason", reason)
        .withColumn("kept", F.col("reason").isNull())
    )
