"""Alignment of two tokenizers over the bytes of the same text.

Tokens are rows of incidence matrices over the bytes they cover, in compressed sparse rows
built by hand (``Csr``). Gustavson's row products A·Bᵀ give the overlap links: pairs of
token occurrences that share bytes, with their number. Offsets where tokens of both
end cut the text into groups; products of the group incidences give the shared-group links.

Neither tokenizer joins a word to the space after it, so a text is cut at each single
space between two other characters into pieces that are encoded apart: the same tokens, but
a piece that a chunk of the corpus holds many times is encoded and multiplied once. That a
vocabulary allows it is checked when it is loaded; else texts stay whole. A chunk is some
millions of characters of consecutive documents, each a list of piece numbers. How often two
ids are linked in the corpus is counted from the chunks' distinct pairs, and the counts are
sent back to the chunks that hold the pair, not to each document.

Defined cases: a null or empty text has no tokens; neither has one whose joined token
bytes differ from a space and the text (a text with U+2581, say): zeros and an empty digest, and
it counts for no pair. Strings of special tokens are plain text. Repeated rows count each time; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import per_process, saved

#: What U+2581 stands for in pieces.
SPACE_MARK = "▁"
#: Characters that are white space in no tokenizer's eyes.
SOLID = r"[!-~\xa1-\u167f]"
#: Where a text may be cut: both tokenizers start a token at a single space between two of them.
CUT = re.compile(rf"(?<={SOLID}) (?={SOLID})")
#: Pieces that may stand next to each other in one text.
JOINABLE = re.compile(rf"{SOLID}(?:.*{SOLID})?", re.DOTALL)
#: Characters of such a text.
JOINED = 20_000
#: Characters of the texts of a chunk, and the part of a long text read at once.
CHUNK = 4_000_000
PART = 1_000_000


# -- matrices ----------------------------------------------------------------
@dataclass(frozen=True)
class Csr:
    """A sparse matrix of ones: row ``i`` holds the columns
    ``columns[starts[i]:starts[i + 1]]``, ascending."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, ends: np.ndarray, width: int) -> Csr:
        """Rows that cover the columns one after the other, up to ``ends``."""
        return cls(np.append(0, ends), np.arange(width), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=self.width)
        return Csr(np.append(0, np.cumsum(counts)), rows[order], self.height)


def products(left: Csr, right: Csr, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """``left · right`` by Gustavson's rows: (row, column, value) of the entries that are not zero.

    Row ``i`` of the product is the sum of the rows of ``right`` that row ``i`` of ``left`` names. Rows are
    taken together up to about ``block`` summands; a row with more is alone.
    """
    size = np.diff(right.starts)
    # Summands of the rows of ``left`` before each.
    work = np.append(0, np.cumsum(size[left.columns]))[left.starts]
    at = 0
    while at < left.height:
        end = max(at + 1, int(np.searchsorted(work, work[at] + block, "right")) - 1)
        named = left.columns[left.starts[at] : left.starts[end]]
        row = np.repeat(np.arange(at, end), np.diff(left.starts[at : end + 1]))
        n = size[named]
        row = np.repeat(row, n)
        # Each named row of ``right``, entry by entry.
        spot = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(right.starts[named], n)
        key = row * np.int64(right.width) + right.columns[spot]
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        value = np.diff(np.append(first, len(key)))
        yield key[first] // max(right.width, 1), key[first] % max(right.width, 1), value
        at = end


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray, block: int = 1 << 20) -> Iterator[tuple]:
    """(a, b, bytes shared) of the tokens that end there: A·Bᵀ over the bytes."""
    width = int(ends_a[-1]) if len(ends_a) else 0
    a, b = Csr.of_spans(ends_a, width), Csr.of_spans(ends_b, width)
    return products(a, b.transposed(), block)


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Each token's group: the one that ends at the first of ``cuts`` from its end on."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), len(cuts))


def shared_group_links(ends_a: np.ndarray, ends_b: np.ndarray, block: int = 1 << 20) -> Iterator[tuple]:
    """(a, b, 1) of the tokens that lie in one group: the product of the group incidences."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    left, right = group_incidence(ends_a, cuts), group_incidence(ends_b, cuts)
    return products(left, right.transposed(), block)


# -- tokenizers --------------------------------------------------------------
def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Ids of texts, and the bytes of each id.

    ``encode`` takes texts and gives the ids of a space and the text.
    """

    def __init__(self, encode: Callable, entries: list[bytes | None], cuttable: bool):
        self.encode = encode
        self.entries = entries
        self.cuttable = cuttable
        self.sizes = np.array([len(e or b"") for e in entries], np.int64)
        names = [str(i) for i in range(len(entries))]
        self.comma = np.array([n + "," for n in names], object)
        self.bar = np.array([n + "|" for n in names], object)
        self.semicolon = np.array([n + ";" for n in names], object)

    def joined(self, ids: list[int]) -> bytes | None:
        try:
            return b"".join([self.entries[i] for i in ids])
        except TypeError:  # an id without bytes
            return None


def byte_level(path: str) -> Tokens:
    """A byte-level vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = _byte_letters()
    entries: list[bytes | None] = [None] * tokenizer.get_vocab_size()
    for word, i in tokenizer.get_vocab().items():
        entries[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else None
    told = json.loads(tokenizer.to_str())
    split = told["pre_tokenizer"] or {}
    cuttable = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in run([" " + t for t in texts], add_special_tokens=False)]

    return Tokens(encode, entries, cuttable)


def piece_model(path: str) -> Tokens:
    """A sentencepiece model that puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            entries.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            entries.append(None)
        else:
            entries.append(piece.replace(SPACE_MARK, " ").encode("utf-8"))
    joins = re.compile(rb"[^ ] ")
    # No entry runs over a word's end, and a space survives as it is.
    cuttable = not any(e and joins.search(e) for e in entries) and model.normalize("a  b") == "▁a▁▁b"

    def encode(texts: list[str]) -> list[list[int]]:
        return model.encode(texts, num_threads=1)

    return Tokens(encode, entries, cuttable)


def _gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    shift = np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts)
    return flat[np.arange(len(shift)) + shift]


@dataclass(frozen=True)
class Pair:
    """Both tokenizers."""

    a: Tokens
    b: Tokens

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        return per_process(("aligned", a_path, b_path), lambda: cls(byte_level(a_path), piece_model(b_path)))

    @property
    def cuttable(self) -> bool:
        return self.a.cuttable and self.b.cuttable

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, for a part of it at a time."""
        if not self.cuttable:
            yield [text]
            return
        at = 0
        while at <= len(text):
            cut = CUT.search(text, at + PART)
            end = cut.start() if cut else len(text)
            yield CUT.split(text[at:end])
            at = end + 1

    def _texts(self, pieces: list[str]) -> Iterator[list[int]]:
        """Pieces to be encoded as one text."""
        run, size = [], 0
        for i, p in enumerate(pieces):
            if not (self.cuttable and JOINABLE.fullmatch(p)):
                yield [i]
                continue
            if run and size + len(p) > JOINED:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(p) + 1
        if run:
            yield run

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """``good, n_a, a, n_b, b``: whether both give the bytes of each piece (else it has no
        tokens), how many ids it has, and the ids of all."""
        n = len(pieces)
        good, runs, found = np.zeros(n, bool), list(self._texts(pieces)), []
        while runs:
            texts = [" ".join([pieces[i] for i in run]) for run in runs]
            again = []
            for run, text, a, b in zip(runs, texts, self.a.encode(texts), self.b.encode(texts)):
                want = b" " + text.encode("utf-8")
                if self.a.joined(a) == want and self.b.joined(b) == want:
                    good[run] = True
                    found.append((run, a, b))
                elif len(run) > 1:  # one of them has other bytes
                    again += [[i] for i in run]
            runs = again
        order = np.array([i for run, _, _ in found for i in run], np.int64)
        sizes = np.array([len(pieces[i].encode("utf-8")) + 1 for i in order], np.int64)
        ends = np.cumsum(sizes)
        out = [good]
        for tokens, ids in ((self.a, [a for _, a, _ in found]), (self.b, [b for _, _, b in found])):
            flat = np.array([i for part in ids for i in part], np.int64)
            # Where the tokens end, a piece does.
            stops = np.searchsorted(np.cumsum(tokens.sizes[flat]), ends) + 1
            first, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first[order] = np.append(0, stops[:-1]) if len(stops) else stops
            counts[order] = np.diff(np.append(0, stops))
            out += [counts, _gathered(flat, first, counts)]
        return tuple(out)


# -- chunks ------------------------------------------------------------------
def _grouped_text(pair: Pair, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[str]:
    """Ids of the groups, each id with the sign that follows it; ``in_a``, ``in_b``: the
    group of each token, ascending."""
    last_a = np.append(in_a[1:] != in_a[:-1], True)
    last_b = np.append(in_b[1:] != in_b[:-1], True)
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.searchsorted(in_b, in_a)] = np.where(last_a, pair.a.bar[a], pair.a.comma[a])
    out[np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")] = np.where(
        last_b, pair.b.semicolon[b], pair.b.comma[b]
    )
    return out


class Chunk:
    """The distinct pieces of some documents: their tokens, links and groups."""

    def __init__(self, pair: Pair, pieces: list[str]):
        self.good, self.n_a, a, self.n_b, b = pair.tokens(pieces)
        # All pieces side by side: where a piece ends, tokens of both end.
        ends_a, ends_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a = group_incidence(ends_a, cuts).columns
        in_b = group_incidence(ends_b, cuts).columns
        piece_a = np.repeat(np.arange(len(pieces)), self.n_a)
        of_group = np.zeros(len(cuts), np.int64)
        of_group[in_a] = piece_a
        n = len(pieces)
        self.n_groups = np.bincount(of_group, minlength=n)
        shared = np.bincount(in_a, minlength=len(cuts)) * np.bincount(in_b, minlength=len(cuts))
        self.n_shared = np.bincount(of_group, shared, minlength=n).astype(np.int64)
        found = [(i, j) for i, j, _ in overlap_links(ends_a, ends_b)]
        none = np.empty(0, np.int64)
        i, j = (np.concatenate([none, *[x[k] for x in found]]) for k in (0, 1))
        #: Distinct pairs of ids, the pair of each link, and the links of each piece.
        self.pairs, self.link = np.unique(b[j] << 32 | a[i], return_inverse=True)
        self.n_links = np.bincount(piece_a[i], minlength=n)
        signs = _grouped_text(pair, a, b, in_a, in_b).tolist()
        at = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        self.groups = ["".join(signs[x:y]) for x, y in zip(at, at[1:])]

    def link_counts(self, times: np.ndarray) -> np.ndarray:
        """Links of each distinct pair, with the pieces taken ``times`` often."""
        weight = np.repeat(times, self.n_links)
        out = np.zeros(len(self.pairs), np.int64)
        np.add.at(out, self.link, weight)
        return out


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``; runs may be empty."""
    total = np.append(0, np.cumsum(values))
    return total[starts[1:]] - total[starts[:-1]]


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, in two bytes each where these do."""
    small = len(numbers) == 0 or numbers.max() < 1 << 16
    return (b"2" if small else b"4") + numbers.astype("<u2" if small else "<u4").tobytes()


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{int(data[:1])}", offset=1).astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
#: Rows of documents hold their pieces, the first row of a chunk its pairs and its pieces' links.
CHUNK_COLUMNS = ("pieces", "pairs", "counts", "link", "piece_links")


def _chunk_rows(pair: Pair, chunk: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    numbers: dict[str, int] = {}
    lists = []
    for text in texts:
        found = [np.empty(0, np.int64)]
        for part in pair.pieces(text) if text else ():
            found.append(np.fromiter((numbers.setdefault(p, len(numbers)) for p in part), np.int64, len(part)))
        lists.append(np.concatenate(found))
    done = Chunk(pair, list(numbers))
    good = [bool(x.size and done.good[x].all()) for x in lists]
    lists = [x if g else x[:0] for x, g in zip(lists, good)]
    flat = np.concatenate(lists)
    starts = np.append(0, np.cumsum([len(x) for x in lists]))
    times = np.bincount(flat, minlength=len(numbers))
    counts = done.link_counts(times)
    digests = [
        sha256("".join([done.groups[k] for k in x.tolist()])[:-1].encode()).hexdigest() if g else ""
        for x, g in zip(lists, good)
    ]
    n = len(texts)
    first = [None] * max(n - 1, 0)
    arrays = {
        "chunk": pa.array([chunk] * n, pa.int64()),
        "at": pa.array(range(n), pa.int64()),
        "id": ids,
        **{c: pa.array(_sums(getattr(done, c)[flat], starts), pa.int64()) for c in COUNTS},
        "groups_sha256": pa.array(digests, pa.string()),
        "pieces": pa.array([_narrow(x) for x in lists], pa.binary()),
        "pairs": pa.array([done.pairs.astype("<i8").tobytes(), *first], pa.binary()),
        "counts": pa.array([counts.astype("<i8").tobytes(), *first], pa.binary()),
        "link": pa.array([_narrow(done.link), *first], pa.binary()),
        "piece_links": pa.array([_narrow(done.n_links), *first], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _runs(sizes: list[int | None], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``most`` bytes; a longer one is alone."""
    at = total = 0
    for k, size in enumerate(sizes):
        if k > at and total + (size or 0) > most:
            yield at, k
            at, total = k, 0
        total += size or 0
    if at < len(sizes):
        yield at, len(sizes)


def chunked(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """The rows of documents in chunks, see ``CHUNK_COLUMNS``; to be stored."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(a_path, b_path)
        # Numbers of its own for each task: the result is stored as one job writes it.
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for lo, hi in _runs(sizes, most):
                yield _chunk_rows(pair, chunk, ids.slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist())
                chunk += 1

    kind = given.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    blobs = ", ".join(f"{c} binary" for c in CHUNK_COLUMNS)
    return given.mapInArrow(encode, f"chunk long, at long, id {kind}, {counts}, groups_sha256 string, {blobs}")


def _chunk_pairs(chunks: DataFrame) -> DataFrame:
    """``chunk, a, b, n``: each distinct pair of each chunk, with its links there."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["pairs"], "<i8")
                n = np.frombuffer(row["counts"], "<i8")
                pairs, n = pairs[n > 0], n[n > 0]
                columns = [np.full(len(pairs), row["chunk"]), pairs & 0xFFFFFFFF, pairs >> 32, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["chunk", "a", "b", "n"])

    heads = chunks.where("at = 0").select("chunk", "pairs", "counts")
    return heads.mapInArrow(told, "chunk long, a long, b long, n long")


def _answered(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums of their links' counts."""
    rows = rows.sort_by("at")
    head = {c: rows.column(c)[0].as_py() for c in ("pairs", "link", "piece_links")}
    pairs = np.frombuffer(head["pairs"], "<i8")
    n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    if answers.num_rows:
        asked = answers.column("b").to_numpy() << 32 | answers.column("a").to_numpy()
        spot = np.searchsorted(pairs, asked)
        n[spot] = answers.column("n").to_numpy()
        best[spot] = answers.column("is_best").to_numpy(zero_copy_only=False)
    link = _widened(head["link"])
    starts = np.append(0, np.cumsum(_widened(head["piece_links"])))
    per_piece = [_sums(values[link], starts) for values in (best, n)]
    sums = [[], []]
    for data in rows.column("pieces"):
        pieces = _widened(data.as_py())
        for out, values in zip(sums, per_piece):
            out.append(int(values[pieces].sum()))
    told = rows.select(["id", *COUNTS, "groups_sha256"])
    return told.append_column("n_best", pa.array(sums[0], pa.int64())).append_column(
        "count_sum", pa.array(sums[1], pa.int64())
    )


@dataclass(frozen=True)
class Alignment:
    """``documents``: ``id, n_a, n_b, n_groups, n_links, n_shared`` (shared-group links), ``n_best``
    (links whose pair is the most frequent of its B id), ``count_sum``, ``groups_sha256``.
    ``pairs``: ``a, b, n`` (links in the corpus), ``is_best``."""

    documents: DataFrame
    pairs: DataFrame


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK,
) -> Alignment:
    """Every document's tokens of both, and the corpus-wide counts of linked ids."""
    chunks = saved(chunked(docs, a_path, b_path, id_col, text_col, chunk_bytes), "aligned")
    found = saved(_chunk_pairs(chunks), "chunk-pairs")
    pairs = found.groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = saved(pairs, "pair-counts")
    # One row for each id of B.
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    pairs = pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))
    answers = found.select("chunk", "a", "b").join(pairs, ["a", "b"])
    kind = chunks.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    documents = (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_answered, f"id {kind}, {counts}, groups_sha256 string, n_best long, count_sum long")
    )
    return Alignment(documents, pairs)


def links(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    shared: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 1 << 16,
) -> DataFrame:
    """``id, a_at, b_at, a, b, n``: each link between token occurrences (places from 0), with the bytes
    shared; with ``shared`` the shared-group links (``n`` is 1). Written block by block of the product."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    product = shared_group_links if shared else overlap_links

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(a_path, b_path)
        for batch in batches:
            kind = batch.column(0).type
            for one, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                pieces = [p for part in pair.pieces(text) for p in part] if text else []
                good, _, a, _, b = pair.tokens(pieces)
                if not good.all():
                    continue
                for i, j, n in product(np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b]), block):
                    numbers = [pa.array(x, pa.int64()) for x in (i, j, a[i], b[j], n)]
                    ids = pa.array([one.as_py()] * len(i), kind)
                    yield pa.RecordBatch.from_arrays([ids, *numbers], names=["id", "a_at", "b_at", "a", "b", "n"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(link, f"id {kind}, a_at long, b_at long, a long, b long, n long")
