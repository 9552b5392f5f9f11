"""Best-fit packing of tokenised documents by linear grouping of lengths."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, sub_groups, written

# Unicode white space, at whose start a byte-level vocabulary never joins two tokens.
WHITE = "\t-\r \x85\xa0  -     　"
RUN = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
SPECIAL = "<|endoftext|>"
CACHE_ENTRIES = 100_000
LARGE = (0.25, 0.4, 0.5)  # shares of a sequence from which on a piece is large
GAP = 0.002  # the patterns found are within this share of the best
_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids of texts as little-endian bytes; runs of one word are remembered.

    A text is cut before white space that follows a word, where no token crosses, so a text's ids
    are its runs' ids one after another. Runs are encoded with the ranks of the same vocabulary;
    a run that holds a special token's string goes to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.tokenizer = tokenizer
        self.seen: dict[str, bytes] = {}

    @cached_property
    def exact(self):
        """The tokenizer itself, loaded by the first run that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def _run(self, run: str) -> bytes:
        ids = self.exact.encode(run, add_special_tokens=False).ids if SPECIAL in run else self.fast.encode_ordinary(run)
        return np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        seen, out = self.seen, []
        for i in range(0, len(text), 1 << 22):  # very long texts in slices, cut where a run begins
            for run in RUN.findall(text) if len(text) <= 1 << 22 else self._slice(text, i):
                ids = seen.get(run)
                if ids is None:
                    ids = self._run(run)
                    if len(run) < 200:
                        seen[run] = ids
                out.append(ids)
        return b"".join(out)

    @staticmethod
    def _slice(text: str, at: int) -> Iterator[str]:
        """Runs that begin in ``text[at : at + 4 Mi]``."""
        end = at + (1 << 22)
        if at:
            while at < len(text) and not (re.match(f"[{WHITE}]", text[at]) and not re.match(f"[{WHITE}]", text[at - 1])):
                at += 1
        for m in RUN.finditer(text, at):
            if m.start() >= end and re.match(f"[{WHITE}]", m[0]):
                return
            yield m[0]


def encoder(tokenizer: str | None, ranks: str | None) -> Encoder:
    import public_tokenizers

    key = (tokenizer or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end: int = 2, size: int = 1024, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32.

    A document's tokens are its ids and ``end``. Documents of over ``size`` tokens are cut; every
    piece but the first has ``size`` tokens. Null text counts as empty: the one token ``end``. Very long texts are encoded in
    slices, whole. Null and repeated ids and rows are documents each. Other columns are left out; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer, ranks), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(t.as_py() or "") + last)
                n = len(ids) // 4
                ends = range((n - 1) % size + 1, n + 1, size)
                lo = 0
                for k, hi in enumerate(ends):
                    for column, value in zip(rows, (doc, k, lo, hi - lo, zlib.crc32(ids[lo * 4 : hi * 4])), strict=True):
                        column.append(value)
                    lo = hi
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demands: list[int], size: int, rounds: int = 800) -> list[tuple[list[int], int]]:
    """Whole numbers of configurations for a few distinct sizes: the linear programme of cutting
    patterns by column generation, its solution rounded down. A configuration is a count per size."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(size // s) for s in sizes])  # column j: as many as fit of size j
    need = np.array(demands, dtype=float)
    lengths = np.array(sizes)
    fits = k - np.searchsorted(lengths[::-1], np.arange(size + 1), side="right")  # the first size that fits a capacity
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        # The most valuable pattern: a knapsack over capacities 0 .. size. Sizes fall.
        value, pick = np.zeros(size + 1), np.full(size + 1, -1)
        for c in range(1, size + 1):
            value[c] = value[c - 1]
            if fits[c] < k:
                gains = value[c - lengths[fits[c] :]] + price[fits[c] :]
                best = int(gains.argmax())
                if gains[best] > value[c] + 1e-12:
                    value[c], pick[c] = gains[best], best + fits[c]
        if value[size] <= 1 + GAP:
            break
        pattern, c = np.zeros(k), size
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                pattern[pick[c]] += 1
                c -= sizes[pick[c]]
        amount, step = inverse @ need, inverse @ pattern
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    amount = np.linalg.inv(basis) @ need
    return [([int(x) for x in basis[:, j]], int(np.floor(amount[j] + 1e-9))) for j in range(k) if amount[j] > 1 - 1e-9]


def plan(counts: dict[int, int], size: int = 1024, groups: int = 64, large: Sequence[float] = LARGE) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many alike), for a count of pieces per length: of the schemes that call a piece large from each share
    of ``large`` on, the one with the fewest sequences. From a half on a configuration is one piece or two, and the scheme is best fit."""
    return min((_plan(counts, size, groups, share) for share in large), key=lambda p: sum(many for _, many in p))


def _plan(counts: dict[int, int], size: int, groups: int, large: float) -> list[tuple[tuple[int, ...], int]]:
    """One scheme. Lengths of at least ``large * size`` form ``groups`` groups of equal cardinality, rounded up to
    the group's largest; configurations of these few sizes are optimised; the actual lengths take
    the places of their group; what remains, large or small, goes where it fits best, longest
    first. Only counts per length are handled, ``size`` of them at most, however many pieces there are.
    """
    rest = Counter({n: c for n, c in counts.items() if c})
    done: list[tuple[tuple[int, ...], int]] = [((size,), rest.pop(size))] if rest.get(size) else []
    big = sorted((n for n in rest if n >= large * size), reverse=True)
    total = sum(rest[n] for n in big)
    queues: list[list[list[int]]] = []  # per group its [length, count], longest first
    if total:
        per, at = -(-total // groups), 0
        for n in big:
            c = rest[n]
            while c:
                g = at // per
                while len(queues) <= g:
                    queues.append([])
                take = min(c, (g + 1) * per - at)
                queues[g].append([n, take])
                at, c = at + take, c - take
    merged: dict[int, list[list[int]]] = {}  # groups of one rounded size are one
    for q in queues:
        merged.setdefault(q[0][0], []).extend(q)
    sizes = sorted(merged, reverse=True)
    open_bins: Counter[tuple[int, ...]] = Counter()
    for pattern, many in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], size):
        slots = [sizes[j] for j, c in enumerate(pattern) for _ in range(c)]
        while many:
            use = Counter(slots)
            run, lengths = many, []
            heads = {s: [list(x) for x in merged[s]] for s in use}
            for s in slots:  # the actual lengths at the head of each group, as many times as all last
                while heads[s] and not heads[s][0][1]:
                    heads[s].pop(0)
                if not heads[s]:
                    run = 0
                    break
                lengths.append(heads[s][0][0])
                heads[s][0][1] -= 1
            if not run:
                break
            for s in use:
                for n in set(lengths):
                    uses = sum(1 for x, t in zip(lengths, slots, strict=True) if x == n and t == s)
                    if uses:
                        run = min(run, next(c for m, c in merged[s] if m == n and c) // uses)
            run = max(run, 1)
            for n, s in zip(lengths, slots, strict=True):
                left = run
                for entry in merged[s]:
                    if entry[0] == n and left:
                        took = min(left, entry[1])
                        entry[1] -= took
                        left -= took
                rest[n] -= run
            open_bins[tuple(lengths)] += run
            many -= run
    # Best fit, longest first, for many pieces of one length and many sequences of one room at a time.
    by_room: dict[int, Counter[tuple[int, ...]]] = defaultdict(Counter)
    for lengths, many in open_bins.items():
        by_room[size - sum(lengths)][lengths] += many
    rooms = sorted(by_room)
    for n in sorted((n for n in rest if rest[n]), reverse=True):
        left = rest[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                each = size // n
                full, part = divmod(left, each)
                for many, alike in ((each, full), (part, 1 if part else 0)):
                    if alike:
                        room = size - many * n
                        if room not in by_room or not by_room[room]:
                            bisect.insort(rooms, room) if room not in rooms else None
                        by_room[room][(n,) * many] += alike
                break
            room = rooms[i]
            lengths, many = next(iter(by_room[room].items()))
            times = room // n if many == 1 else 1
            take = min(many, left)
            fit = min(times, left) if many == 1 else 1
            by_room[room][lengths] -= take
            if not by_room[room][lengths]:
                del by_room[room][lengths]
            if not by_room[room]:
                rooms.pop(i)
                del by_room[room]
            new = room - n * fit
            if new not in by_room:
                bisect.insort(rooms, new)
            by_room[new][lengths + (n,) * fit] += take
            left -= take * fit
    done += [(lengths, many) for room in sorted(by_room) for lengths, many in sorted(by_room[room].items())]
    return done


def pack(table: DataFrame, size: int = 1024, groups: int = 64) -> DataFrame:
    """``table`` of pieces (length long, and columns that tell rows apart) with sequence_id and offset (long).

    The count of pieces per length, ``size`` numbers at most, comes to the driver for the plan; pieces are
    numbered within their length, in parts, and look their place up in the plan, whose size depends on
    ``size`` alone. Identical rows get places of their own, pieces of one length theirs by the other columns. No pieces: no rows.
    """
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: first rank, first sequence, offset
    used: Counter[int] = Counter()
    sequence = 0
    for lengths, many in plan(counts, size, groups):
        offset = 0
        for n in lengths:
            spans[n].append((used[n], sequence, offset))
            used[n] += many
            offset += n
        sequence += many
    arrays = {n: np.array(s, dtype=np.int64).T for n, s in spans.items()}
    spark = table.sparkSession
    parts = spark.createDataFrame([(n, sub_groups(c)) for n, c in counts.items()], "length long, __parts int")
    others = [c for c in table.columns if c != "length"]
    parted = table.join(F.broadcast(parts), "length").withColumn("__part", F.pmod(F.xxhash64(*others), F.col("__parts")).cast("int")).drop("__parts")
    ranked = gapless(parted, ["length"], "__part", [F.col(c) for c in others], "__rank").drop("__part").select(*table.columns, "__rank")
    shared = spark.sparkContext.broadcast(arrays)
    names = table.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequences, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, offset = shared.value[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequences[at], offsets[at] = base[k] + rank[at] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequences), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in table.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, size: int = 1024, groups: int = 64, **options) -> DataFrame:
    """Pieces of every document with their place in sequences of at most ``size`` tokens; see ``pieces`` and ``pack`` for the odd cases."""
    return pack(written(pieces(docs, size=size, **options)), size, groups)
