"""What the chunks of a corpus learn from each other about their n-grams.

Texts become chunks of about ``_CHUNK`` bytes: token numbers and 64-bit word names, staged once. A
chunk lists each of its n-grams once, as sorted names, and sends slices of that list to buckets of
the name space. A bucket adds up what the training rows of all chunks count and answers every chunk
in the order it asked, so answers hold no names: a bit for kept or not, counts of what is kept, and
a bit that makes one chunk the owner of a kept n-gram. Owners add up, per context, what the model
needs for backoff weights; the buckets of the contexts merge those sums and answer likewise. So an
n-gram's name travels once per chunk, in about six bytes, whatever its count.

Nothing is kept of n-grams that the training rows have only once, and nothing else is left out. A
word's name is its XXH3 hash, an n-gram's the mixed name of its context and its last word: among
the some 10^9 n-grams of 30 GB of text less than one pair that shares a name is expected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tokens import slices
from tillroll.plans.staging import stage

_CHUNK = 14 << 20
_SLICE = 1 << 20
#: buckets for every so many chunks: a bucket holds some ten megabytes of names
_GROUP, _BUCKETS = 256, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TINY = 1e-12


# ---------------------------------------------------------------- packing
def _frame(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _unframe(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends], ends)]


def _pack_names(names: np.ndarray) -> bytes:
    """Sorted 64-bit names as the bytes that their gaps need; the uppermost is compressed."""
    if not len(names):
        return b""
    gaps = np.diff(names)
    width = (int(gaps.max(initial=0)).bit_length() + 7) // 8
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = np.array([width], np.uint8).tobytes() + names[:1].astype("<u8").tobytes()
    if not width:  # a single name, as names differ
        return head
    low, top = body[:, : width - 1].tobytes(), body[:, width - 1].tobytes()
    return head + np.array([len(gaps)], "<u4").tobytes() + low + zstandard.compress(top, 1)


def _unpack_names(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, first = data[0], np.frombuffer(data, "<u8", 1, 1)
    if not width:
        return first.copy()
    n = int(np.frombuffer(data, "<u4", 1, 9)[0])
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, : width - 1] = np.frombuffer(data, np.uint8, n * (width - 1), 13).reshape(n, width - 1)
    top = zstandard.decompress(data[13 + n * (width - 1) :])
    gaps[:, width - 1] = np.frombuffer(top, np.uint8)
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    """Byte planes, compressed: small counts leave the upper planes empty."""
    planes = np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(np.array([len(n)], "<u8").tobytes() + planes.tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


# ---------------------------------------------------------------- chunks
def tokens_of(text: str | None, end: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(end)
    return words


def chunked(docs: DataFrame, keep: list[Column], text: str, train: Column, end: bytes) -> DataFrame:
    """(chunk, kept array, data): chunks of whole texts that never span two tasks. Staged."""
    chosen = docs.select(
        F.struct(*keep).alias("kept"), F.col(f"`{text}`").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    kind = chosen.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = pyspark.TaskContext.get().partitionId() << 32
        kept, sizes, train, numbers, known, held = [], [], [], [], {}, 0

        def out() -> pa.RecordBatch:
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            turn = np.argsort(names)
            place = np.empty(len(turn), np.int64)
            place[turn] = np.arange(len(turn))
            ids = place[np.concatenate(numbers)]
            data = _frame(
                [_pack_names(names[turn]), _pack_counts(ids), _pack_counts(np.array(sizes)),
                 _pack_bits(np.array(train, bool))]
            )
            rows = pa.concat_arrays(kept)
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), lists, pa.array([data], pa.binary())],
                names=["chunk", "kept", "data"],
            )

        for batch in slices(batches, 1, _SLICE):
            kept.append(batch.column(0))
            train += batch.column(2).to_pylist()
            for value in batch.column(1).to_pylist():
                words = tokens_of(value, end)
                sizes.append(len(words))
                numbers.append(
                    np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                )
            held += batch.column(1).nbytes
            if held >= _CHUNK:
                yield out()
                chunk += 1
                kept, sizes, train, numbers, known, held = [], [], [], [], {}, 0
        if kept:
            yield out()

    return stage(
        chosen.mapInArrow(run, f"chunk bigint, kept array<{kind}>, data binary"), "chunks"
    )


@dataclass
class Chunk:
    """Tokens of some texts and their n-grams; per order, from 1 on:

    ``names`` sorted, ``at`` the n-gram that ends at each token (-1: none), ``first`` a token
    where each n-gram ends. ``counts`` are those of the training rows (0: not kept), ``own`` whose
    sums this chunk adds up, ``backoff`` the log10 weights of contexts.
    """

    sizes: np.ndarray
    train: np.ndarray
    ids: np.ndarray
    names: list[np.ndarray]
    at: list[np.ndarray]
    first: list[np.ndarray]
    counts: list[np.ndarray] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def read(cls, data: bytes, order: int) -> Chunk:
        packed, ids, sizes, train = _unframe(data)
        words, sizes = _unpack_names(packed), _unpack_counts(sizes)
        ids = _unpack_counts(ids).astype(np.int32)
        ends = np.cumsum(sizes)
        place = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        names, at, gram = [words], [ids], words[ids]
        for k in range(1, order):
            gram = np.roll(gram, 1) * _ODD + words[ids]
            gram ^= gram >> np.uint64(32)
            gram *= _MIX
            gram ^= gram >> np.uint64(29)
            inside = np.flatnonzero(place >= k)
            own, inverse = np.unique(gram[inside], return_inverse=True)
            where = np.full(len(ids), -1, np.int32)
            where[inside] = inverse
            names.append(own)
            at.append(where)
        first = []
        for own, where in zip(names, at):
            token = np.zeros(len(own), np.int32)
            inside = np.flatnonzero(where >= 0)
            token[where[inside]] = inside
            first.append(token)
        return cls(sizes, _unpack_bits(train, len(sizes)), ids, names, at, first)

    def suffix(self, k: int) -> np.ndarray:
        """Of every n-gram of level ``k`` (from 0) the number of it without its first word."""
        return self.at[k - 1][self.first[k]]

    def chance(self, k: int, some: np.ndarray, floor: int, discount: float) -> np.ndarray:
        """Probability of kept n-grams of level ``k`` after their contexts."""
        if not k:
            return (self.counts[0][some] + 1) / floor
        context = self.at[k - 1][self.first[k][some] - 1]
        return (self.counts[k][some] - discount) / self.counts[k - 1][context]


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _slices(names: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(names, _edges(buckets)), [len(names)]])


_SENT = "bucket int, chunk bigint, data binary"


def _sent(chunk: int, parts: list[bytes]) -> pa.RecordBatch:
    """One row per bucket."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), chunk), pa.int64()),
         pa.array(parts, pa.binary())],
        names=["bucket", "chunk", "data"],
    )


def _rows(table: pa.Table) -> list[tuple[int, list[bytes]]]:
    """(chunk, frames) of the rows of a bucket, by chunk."""
    pairs = zip(table.column("chunk").to_pylist(), table.column("data").to_pylist())
    return sorted((c, _unframe(d)) for c, d in pairs)


# ---------------------------------------------------------------- counts
def _ask_counts(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Chunk.read(data.as_py(), order)
                learned = np.repeat(own.train, own.sizes)
                parts: list[list[bytes]] = [[] for _ in range(buckets)]
                for names, at in zip(own.names, own.at):
                    inside = learned & (at >= 0)
                    n = np.bincount(at[inside], minlength=len(names))
                    cuts = _slices(names, buckets)
                    for part, a, b in zip(parts, cuts, cuts[1:]):
                        part += [_pack_names(names[a:b]), _pack_counts(n[a:b])]
                yield _sent(chunk, [_frame(p) for p in parts])

    return chunks.select("chunk", "data").mapInArrow(run, _SENT)


def _merge_counts(asked: DataFrame, order: int) -> DataFrame:
    """(bucket, chunk, data, words, tokens): answers; totals of the bucket in its first row."""

    def merge(table: pa.Table) -> pa.Table:
        rows, answers, totals = _rows(table), [], (0, 0)
        answers = [[] for _ in rows]
        for k in range(order):
            lists = [_unpack_names(parts[2 * k]) for _, parts in rows]
            names, first, inverse = np.unique(
                np.concatenate(lists), return_index=True, return_inverse=True
            )
            told = np.concatenate([_unpack_counts(parts[2 * k + 1]) for _, parts in rows])
            n = np.zeros(len(names), np.int64)
            np.add.at(n, inverse, told)
            kept = n >= (1 if k == 0 else 2)
            owner = np.zeros(len(inverse), bool)
            owner[first] = True
            if k == 0:
                totals = int(kept.sum()), int(n.sum())
            upto = 0
            for answer, own in zip(answers, lists):
                mine = slice(upto, upto + len(own))
                upto += len(own)
                stays = kept[inverse[mine]]
                answer += [
                    _pack_bits(stays), _pack_counts(n[inverse[mine]][stays]),
                    _pack_bits(owner[mine][stays]),
                ]
        here = np.zeros((2, len(rows)), np.int64)
        here[:, 0] = totals
        return pa.table({
            "bucket": table.column("bucket"),
            "chunk": pa.array([c for c, _ in rows], pa.int64()),
            "data": pa.array([_frame(a) for a in answers], pa.binary()),
            "words": pa.array(here[0]),
            "tokens": pa.array(here[1]),
        })

    return asked.groupBy("bucket").applyInArrow(merge, _SENT + ", words bigint, tokens bigint")


def _answered(table: pa.Table, kind: int) -> list[list[bytes]]:
    """Frames of the answers of one kind, by bucket."""
    some = zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "data")))
    return [_unframe(d) for _, d in sorted((b, d) for k, b, d in some if k == kind)]


def _learn_counts(chunk: Chunk, answers: list[list[bytes]]) -> None:
    for k, names in enumerate(chunk.names):
        cuts = _slices(names, len(answers))
        counts, own = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for parts, a, b in zip(answers, cuts, cuts[1:]):
            stays = _unpack_bits(parts[3 * k], b - a)
            at = a + np.flatnonzero(stays)
            counts[at] = _unpack_counts(parts[3 * k + 1])
            own[at] = _unpack_bits(parts[3 * k + 2], len(at))
        chunk.counts.append(counts)
        chunk.own.append(own)


# ---------------------------------------------------------------- backoff weights
def _contexts(chunk: Chunk, k: int) -> np.ndarray:
    """Numbers of the kept n-grams of level ``k`` (from 0) that a token of the chunk follows."""
    follows = np.flatnonzero(chunk.at[k + 1] >= 0) - 1
    used = np.zeros(len(chunk.names[k]), bool)
    used[chunk.at[k][follows]] = True
    return np.flatnonzero(used & (chunk.counts[k] > 0))


def _ask_backoff(pairs, order: int, buckets: int, floor: int, discount: float) -> DataFrame:
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for number, data in zip(chunks.column("chunk").to_pylist(), chunks.column("data")):
            chunk = Chunk.read(data.as_py(), order)
            _learn_counts(chunk, _answered(answers, 0))
            parts: list[list[bytes]] = [[] for _ in range(buckets)]
            for k in range(order - 1):
                mine = np.flatnonzero(chunk.own[k + 1])
                ends, size = chunk.first[k + 1][mine], len(chunk.names[k])
                context, suffix = chunk.at[k][ends - 1], chunk.at[k][ends]
                given = np.bincount(context, chunk.chance(k + 1, mine, floor, discount), size)
                below = np.bincount(context, chunk.chance(k, suffix, floor, discount), size)
                asked = _contexts(chunk, k)
                names, told = chunk.names[k][asked], given[asked] > 0
                cuts = _slices(names, buckets)
                for part, a, b in zip(parts, cuts, cuts[1:]):
                    some = asked[a:b][told[a:b]]
                    part += [
                        _pack_names(names[a:b]), _pack_bits(told[a:b]),
                        given[some].tobytes(), below[some].tobytes(),
                    ]
            out.append(_sent(number, [_frame(p) for p in parts]))
        return pa.Table.from_batches(out, _sent(0, []).schema)

    return pairs.applyInArrow(run, _SENT)


def _merge_backoff(asked: DataFrame, order: int) -> DataFrame:
    """(bucket, chunk, data): the weights of the contexts a chunk asked for."""

    def merge(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        answers: list[list[bytes]] = [[] for _ in rows]
        for k in range(order - 1):
            lists = [_unpack_names(parts[4 * k]) for _, parts in rows]
            names, inverse = np.unique(np.concatenate(lists), return_inverse=True)
            sums = np.zeros((2, len(names)))
            upto = 0
            for (_, parts), own in zip(rows, lists):
                told = _unpack_bits(parts[4 * k + 1], len(own))
                at = inverse[upto : upto + len(own)][told]
                for i in (0, 1):
                    sums[i][at] += np.frombuffer(parts[4 * k + 2 + i], np.float64)
                upto += len(own)
            given, below = sums
            weight = np.log10(np.maximum(1 - given, _TINY) / np.maximum(1 - below, _TINY))
            upto = 0
            for answer, own in zip(answers, lists):
                at = inverse[upto : upto + len(own)]
                upto += len(own)
                has = given[at] > 0
                answer += [_pack_bits(has), weight[at][has].tobytes()]
        return pa.table({
            "bucket": table.column("bucket"),
            "chunk": pa.array([c for c, _ in rows], pa.int64()),
            "data": pa.array([_frame(a) for a in answers], pa.binary()),
        })

    return asked.groupBy("bucket").applyInArrow(merge, _SENT)


def _learn_backoff(chunk: Chunk, answers: list[list[bytes]]) -> None:
    for k in range(len(chunk.names) - 1):
        asked = _contexts(chunk, k)
        cuts = _slices(chunk.names[k][asked], len(answers))
        weight = np.zeros(len(chunk.names[k]))
        for parts, a, b in zip(answers, cuts, cuts[1:]):
            has = _unpack_bits(parts[2 * k], b - a)
            weight[asked[a:b][has]] = np.frombuffer(parts[2 * k + 1], np.float64)
        chunk.backoff.append(weight)
    chunk.backoff.append(np.zeros(len(chunk.names[-1])))


# ---------------------------------------------------------------- whole
@dataclass
class Learned:
    """Chunks beside all they were told; training totals."""

    pairs: object  # chunks cogrouped with answers
    tokens: int
    floor: int
    #: staged tables that may go when the pairs have been read
    staged: list[DataFrame]


def told(data: bytes, answers: pa.Table, order: int) -> Chunk:
    """A chunk with its counts and backoff weights."""
    chunk = Chunk.read(data, order)
    _learn_counts(chunk, _answered(answers, 0))
    _learn_backoff(chunk, _answered(answers, 1))
    chunk.names, chunk.own = [], []  # not needed any more
    return chunk


def learn(chunks: DataFrame, order: int, discount: float) -> Learned:
    """Count, keep and weigh the n-grams of all chunks."""
    rows = chunks.count()
    buckets = (1 + rows // _GROUP) * _BUCKETS
    counted = stage(_merge_counts(_ask_counts(chunks, order, buckets), order), "counts")
    sums = counted.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    tokens, floor = sums.tokens or 0, (sums.tokens or 0) + (sums.words or 0) + 1
    counts = counted.select(F.lit(0).alias("kind"), "bucket", "chunk", "data")

    def beside(answers: DataFrame):
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))

    weights = stage(
        _merge_backoff(_ask_backoff(beside(counts), order, buckets, floor, discount), order), "weights"
    )
    both = counts.union(weights.select(F.lit(1).alias("kind"), "bucket", "chunk", "data"))
    return Learned(beside(both), tokens, floor, [chunks, counted, weights])
