"""Byte-level BPE in length-bucketed numpy matrices: encoding of whole texts by a rank file, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import RUN

FILE = "byte_bpe_multi_50k.tiktoken"
WIDTHS = (*range(2, 25), 32, 48, 64, 96, 128)  # of matrices; a longer piece is a row of its own
CELLS = 1 << 16  # of one matrix
GROUP = 1 << 20  # code points of texts encoded together
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 200  # runs remembered, and the longest of them
NONE = np.iinfo(np.int32).max  # rank of a pair that is no token
_FREE = np.uint64(2**64 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pairs:
    """Pairs of tokens that together are a token, in a hash table with open addressing that whole arrays are looked up in."""

    def __init__(self, left: np.ndarray, right: np.ndarray, token: np.ndarray):
        bits = max(4, int(len(token) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.tokens = np.full(1 << bits, _FREE), np.full(1 << bits, NONE, dtype=np.int32)
        key = self._key(left, right)
        slot = (key * _FACTOR) >> self.shift
        while len(key):
            free = np.flatnonzero(self.keys[slot] == _FREE)
            first = free[np.unique(slot[free], return_index=True)[1]]  # one key for each free slot
            self.keys[slot[first]], self.tokens[slot[first]] = key[first], token[first]
            rest = np.ones(len(key), dtype=bool)
            rest[first] = False
            key, token, slot = key[rest], token[rest], (slot[rest] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair, which is its rank too; NONE where there is none."""
        key = self._key(left, right).ravel()
        slot = (key * _FACTOR) >> self.shift
        held = self.keys[slot]
        out = np.where(held == key, self.tokens[slot], NONE)
        todo = np.flatnonzero((held != key) & (held != _FREE))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.tokens[slot[todo[hit]]]
            todo = todo[~hit & (held != _FREE)]
        return out.reshape(left.shape)


class Vocabulary:
    """A rank file: token bytes and their ids, which are their ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pattern = regex.compile(pattern)
        self.words = pattern == _default_pattern()
        self.seen: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> Pairs:
        """What encoding needs, but decoding doesn't."""
        joined = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        return Pairs(*np.array(joined or [(0, 0, NONE)], dtype=np.int64).T)

    @cached_property
    def packed(self) -> dict[bytes, bytes]:
        return {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids of byte strings of like length, as rows of a padded matrix.

        In every round each row merges its leftmost pair of least rank and closes the gap, so the matrix gets a column narrower;
        rows without a pair that is a token leave it.
        """
        sizes = np.array([len(r) for r in rows])
        width = max(2, sizes.max(initial=0))
        m = np.zeros((len(rows), width), dtype=np.int32)
        m[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        rank = self.pairs(m[:, :-1], m[:, 1:])
        rank[np.arange(1, width) >= sizes[:, None]] = NONE
        out, ends, place = np.zeros((len(rows), width), dtype="<u4"), sizes.copy(), np.arange(len(rows))
        while True:
            row = np.arange(len(place))
            at = rank.argmin(axis=1)
            least = rank[row, at]
            go = least < NONE
            if not go.all():
                out[place[~go], : m.shape[1]], ends[place[~go]] = m[~go], sizes[~go]
                place, m, rank, sizes, at, least = place[go], m[go], rank[go], sizes[go], at[go], least[go]
                row = row[: len(place)]
            if not len(place):
                break
            m[row, at] = least
            gap = np.ones(m.shape, dtype=bool)
            gap[row, at + 1] = False
            m = m[gap].reshape(len(m), -1)
            gap = gap[:, 1:]  # the pair that merged has the place before the gap
            rank, sizes = rank[gap].reshape(len(m), -1), sizes - 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < sizes)
            rank[before, at[before] - 1] = self.pairs(m[before, at[before] - 1], least[before])
            rank[after, at[after]] = self.pairs(least[after], m[after, at[after] + 1])
            last = np.flatnonzero((at + 1 >= sizes) & (at < rank.shape[1]))
            rank[last, at[last]] = NONE
            if not rank.shape[1]:
                out[place, :1], ends[place] = m, 1
                break
        held, step = out.tobytes(), 4 * width
        return [held[i : i + 4 * n] for i, n in zip(range(0, len(held), step), ends.tolist(), strict=True)]

    def merge_long(self, row: bytes) -> bytes:
        """Ids of one long byte string, by the same order of merges, with several of them a round.

        All pairs of the least rank merge from left to right, up to and with the first that makes a new pair of a lower rank: until
        then the leftmost least pair would have been the next of them anyway.
        """
        m = self.bytes[np.frombuffer(row, dtype=np.uint8)]
        rank = self.pairs(m[:-1], m[1:])
        while len(rank) and (least := rank.min()) < NONE:
            at = np.flatnonzero(rank == least)
            fresh = np.diff(at, prepend=-2) != 1
            within = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[within % 2 == 0]  # of overlapping pairs every other
            token = np.full(len(at), least, dtype=np.int32)
            left = np.where(np.diff(at, prepend=-3) == 2, least, m[np.maximum(at - 1, 0)])
            lower = (at > 0) & (self.pairs(left, token) < least)
            lower |= (at + 2 < len(m)) & (self.pairs(token, m[np.minimum(at + 2, len(m) - 1)]) < least)
            at = at[: int(lower.argmax()) + 1] if lower.any() else at
            stays = np.ones(len(m), dtype=bool)
            stays[at + 1] = False
            m[at] = least
            m = m[stays]
            new = at - np.arange(len(at))  # where the merged tokens stand now
            rank = np.append(rank, NONE)[stays][: len(m) - 1]
            for p in (new - 1, new):
                p = p[(p >= 0) & (p < len(m) - 1)]
                rank[p] = self.pairs(m[p], m[p + 1])
        return m.astype("<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each byte string, in buckets by length."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        bucket = np.searchsorted(WIDTHS, sizes)
        out = [b""] * len(pieces)
        for k, width in enumerate(WIDTHS):
            at = np.flatnonzero(bucket == k).tolist()
            step = CELLS // width
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(bucket == len(WIDTHS)):
            out[i] = self.merge_long(pieces[i])
        return out

    def learn(self, runs: set[str]) -> None:
        """Remembers the ids of ``runs``. A piece that is a token is that token; the others are merged together."""
        seen, packed, cut = self.seen, self.packed, self.pattern.findall
        plain, mixed = [], []
        for run in runs:  # ASCII letters after a space at most are one match of the pattern, as most runs are
            word = run[1:] if run[0] == " " else run
            (plain if self.words and word.isascii() and word.isalpha() else mixed).append(run)
        flat, ends = [], []
        for run in mixed:
            flat += cut(run)
            ends.append(len(flat))
        pieces, flat = [run.encode() for run in plain], [p.encode("utf-8", "replace") for p in flat]
        unknown = [p for p in {*pieces, *flat} if p not in packed]
        known = dict(zip(unknown, self.merge(unknown), strict=True))
        seen.update(zip(plain, [packed.get(p) or known[p] for p in pieces], strict=True))
        flat = [packed.get(p) or known[p] for p in flat]
        start = 0
        for run, end in zip(mixed, ends, strict=True):
            seen[run] = b"".join(flat[start:end])
            start = end

    def _encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as runs."""
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        new = set().union(*texts) - self.seen.keys()
        self.learn(new)
        out = [b"".join(map(self.seen.__getitem__, runs)) for runs in texts]
        for run in new:
            if len(run) > CACHE_LENGTH:
                del self.seen[run]
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of texts, as little-endian unsigned 32-bit integers.

        A text is cut before white space that follows another character, where no match of the pattern crosses; so its ids are
        those of its runs one after another. Texts are encoded in groups, a very long one in slices of runs.
        """
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > GROUP:
                yield from self._encode(group)
                group, size = [], 0
                runs, parts = (m[0] for m in RUN.finditer(text)), []
                while some := list(islice(runs, 1 << 17)):
                    parts += self._encode([some])
                yield b"".join(parts)
                continue
            if size > GROUP:
                yield from self._encode(group)
                group, size = [], 0
            group.append(RUN.findall(text))
            size += len(text)
        yield from self._encode(group)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that is no token is an error."""
        at, token = np.frombuffer(ids, dtype="<u4"), self.tokens.__getitem__
        return b"".join(b"".join(map(token, at[lo : lo + (1 << 18)].tolist())) for lo in range(0, len(at), 1 << 18))


_read: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file, read once in a Python process."""
    import public_tokenizers

    key = (path or public_tokenizers.path(FILE), pattern or _default_pattern())
    if key not in _read:
        _read[key] = Vocabulary(*key)
    return _read[key]


def _groups(values: Iterable, sizes: list[int]) -> Iterator[tuple[int, list]]:
    """Consecutive values with the place of the first, so many that their sizes add up to about GROUP."""
    start, held, size = 0, [], 0
    for i, (value, n) in enumerate(zip(values, sizes, strict=True)):
        held.append(value)
        size += n
        if size >= GROUP:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def _extended(docs: DataFrame, column: str, read: str, columns: list[str] | None, work) -> DataFrame:
    """``columns`` of ``docs`` and a binary ``column`` that ``work`` makes of column ``read``, in record batches of bounded size."""
    kept = [c for c in (docs.columns if columns is None else columns) if c != column]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{read}`").alias("\0read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(len(kept))
            sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in source]
            for start, part in _groups(work(source), sizes):
                held = [batch.column(k).slice(start, len(part)) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(part, pa.binary())], names=[*kept, column])

    names = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{names}, `{column}` binary" if kept else f"`{column}` binary")


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", columns: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with a binary column ``ids``: the text's token ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately by the ranks of the file ``path``, without special tokens: a match that is a
    token is that token, else pairs of least rank merge, leftmost first. Texts are encoded whole, very long ones in slices. A null text
    counts as empty, and an empty text has no ids. Every row stands for itself, whatever its id; a column named ``ids`` is replaced, other
    columns are kept. An empty table gives no rows.
    """

    def work(texts: pa.Array) -> Iterator[bytes]:
        return vocabulary(path, pattern).encode(t.as_py() or "" for t in texts)

    return _extended(docs.withColumn(text, F.col(f"`{text}`").cast("string")), ids, text, columns, work)


def decode(docs: DataFrame, ids: str = "ids", data: str = "data", columns: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with a binary column ``data``: the bytes that ``ids``, as of ``encode``, stand for.

    Null ids count as none and give no bytes. An id that is no token of the file is an error. A column named ``data`` is replaced.
    """

    def work(values: pa.Array) -> Iterator[bytes]:
        v = vocabulary(path, pattern)
        return (v.decode(x.as_py() or b"") for x in values)

    return _extended(docs, data, ids, columns, work)
