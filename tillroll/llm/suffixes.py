"""Suffix-array dedup: cut out every byte covered by a long string that also starts elsewhere.

A full suffix array has one suffix per byte. Here only suffixes that can matter are sorted:

1. Each string of ``length`` bytes is anchored at the least-hashed gram inside it, so equal
   strings have equal anchors at equal offsets. Strings of neighbouring starts that share an
   anchor form a run, about one per 70 bytes. A string can only repeat if its anchor does.
2. Suffixes of runs, as tokens (gram, name of the whole run), are range-partitioned by sampled
   splitters on their leading tokens. Buckets sort by multikey quicksort; equal neighbours are
   repeats as a whole. Runs whose gram repeats but whose whole does not are left over: they touch
   the end of a repeat.
3. For those, and one witness of each repeated run beside them, every start is a suffix of its
   own, as tokens of half the length. The same sort finds equal neighbours among them.

Splitters take the row and place as last tokens, so copies of one string, however many, spread
over buckets. A splitter is itself a suffix of the bucket before: a bucket whose first suffix
equals its splitter knows both are repeats, which settles comparison across boundaries.

Tokens are 64-bit hashes, a string is told by two (128 bits). Texts cross the network once per
join, compressed.

Cases: null text is empty; texts shorter than ``length`` keep all; a string that overlaps its own
repeat counts; equal rows repeat each other; null or repeated ids get row numbers of their own;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import partitions
from tillroll.llm.tokens import slices
from tillroll.plans.staging import stage

LENGTH = 400
SAMPLE = 64
_BLOCK = 1 << 16
_PLACE = np.uint64((1 << 20) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = pow(int(_BASE), -1, 1 << 64)
_SMALL = 512

SPAN, LOOSE = 1, 2


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(int(_BASE), _BLOCK * 2)
_DOWN = _powers(_BACK, _BLOCK * 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return sums


def _hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[begin]) * _DOWN[begin])


def _gram(length: int) -> int:
    return max(1, length * 5 // 8)


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, n, gram, name) of all runs of the texts that end at ``ends`` in ``data``."""
    gram = _gram(length)
    width = length - gram + 1
    begins = np.concatenate(([0], ends[:-1]))
    found = []
    for a in range(0, len(data) - length + 1, _BLOCK):
        part = data[a : a + _BLOCK + length - 1]
        if len(part) < length:
            break
        sums = _prefix(part)
        grams = (sums[gram:] - sums[:-gram]) * _DOWN[: len(sums) - gram]
        grams = _mix(grams)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        anchor = (least & _PLACE).astype(np.int64)
        start = np.arange(len(anchor))
        # strings that end inside their text
        first = np.searchsorted(ends, a, "right")
        cut = np.zeros(len(anchor) + 1, np.int64)
        for e in ends[first:]:
            if e - a - length + 1 >= len(anchor):
                break
            cut[max(0, e - a - length + 1)] += 1
            cut[min(len(anchor), e - a)] -= 1
        ok = np.cumsum(cut[:-1]) == 0
        start, anchor = start[ok], anchor[ok]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        low = start[new]
        high = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        at = anchor[new]
        name = _hash(sums, low, high + length)
        shape = (at - low).astype(np.uint64) * np.uint64(length * 4) + (high - low).astype(np.uint64)
        text = np.searchsorted(ends, low + a, "right")
        found.append((text, low + a - begins[text], high - low + 1, grams[at], _mix(name ^ _mix(shape))))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: three-way partitions per token, deeper where equal."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        rows = order[low:high]
        if depth == len(tokens) or len(rows) < 2:
            continue
        if len(rows) <= _SMALL:
            order[low:high] = rows[np.lexsort([t[rows] for t in tokens[depth:][::-1]])]
            continue
        key = tokens[depth][rows]
        pivot = np.partition(key[:: max(1, len(key) // 9)], -5)[-5] if len(key) >= 9 else key[0]
        below, same = key < pivot, key == pivot
        above = ~(below | same)
        order[low:high] = np.concatenate([rows[below], rows[same], rows[above]])
        b, s = int(below.sum()), int(same.sum())
        todo += [(low, low + b, depth), (low + b, low + b + s, depth + 1), (low + b + s, high, depth)]
    return order


def _bucket_of(splitters: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """Splitters below each suffix; a suffix equal to a splitter belongs before it."""
    if not len(splitters):
        return np.zeros(len(tokens[0]), np.int64)
    leading = splitters[:, 0]
    bucket = np.searchsorted(leading, tokens[0], "left")
    alike = np.flatnonzero(np.searchsorted(leading, tokens[0], "right") > bucket)
    if len(alike):  # the leading token decides nothing: sort them among the splitters
        both = [np.concatenate([t[alike], s]) for t, s in zip(tokens, splitters.T)]
        is_splitter = np.arange(len(both[0])) >= len(alike)
        order = np.lexsort([is_splitter, *both[::-1]])
        below = np.empty(len(order), np.int64)
        below[order] = np.cumsum(is_splitter[order])
        bucket[alike] = below[: len(alike)]
    return bucket


_KINDS = "bucket int, t0 bigint, t1 bigint, row bigint, start bigint, n bigint, known int"
#: what the task that made a suffix knows: nothing; that it is repeated; that, and that another
#: suffix of the task stands for it
_OPEN, _REPEATED, _DONE = 0, 1, 2


def _suffix_batch(splitters, t0, t1, row, start, n, known=None) -> pa.RecordBatch:
    tokens = [t0, t1, row.astype(np.uint64), start.astype(np.uint64)]
    bucket = _bucket_of(splitters, tokens)
    if known is None:
        known = np.full(len(t0), _OPEN)
    else:  # those done only pass through, anywhere
        done = known == _DONE
        bucket[done] = ((row[done] * 31 + start[done]) % (len(splitters) + 1)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int32)), pa.array(t0.view(np.int64)), pa.array(t1.view(np.int64)),
         pa.array(row.astype(np.int64)), pa.array(start.astype(np.int64)),
         pa.array(n.astype(np.int64)), pa.array(known.astype(np.int32))],
        names=["bucket", "t0", "t1", "row", "start", "n", "known"],
    )


def _splitters(sampled: DataFrame, parts: int) -> np.ndarray:
    """``parts`` - 1 splitters (t0, t1, row, start) from a bounded random choice of suffixes."""
    chosen = (
        sampled.filter(F.col("known") != _DONE)
        .select("t0", "t1", "row", "start")
        .orderBy(F.xxhash64("row", "start"))
        .limit(32 * parts)
        .toArrow()
    )
    if not chosen.num_rows:
        return np.zeros((0, 4), np.uint64)
    keys = np.stack([c.to_numpy().view(np.uint64) for c in chosen.columns], axis=1)
    keys = keys[multikey_order(list(keys.T.copy()))]
    return keys[np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1]]


def _buckets(suffixes: DataFrame, splitters: np.ndarray, judge, kinds: str) -> DataFrame:
    """Sort every bucket and hand it, in order, to ``judge`` with the splitter before it."""
    ready = suffixes.repartitionById(len(splitters) + 1, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        known = table.column("known").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("t0", "t1", "row", "start", "n")]
        if (known == _DONE).any():
            row, start, n = (c[known == _DONE] for c in columns[2:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(start), pa.array(n), pa.array(np.full(len(row), SPAN), pa.int32())],
                names=["row", "start", "n", "what"],
            )
        columns, known = [c[known != _DONE] for c in columns], known[known != _DONE]
        if not len(known):
            return
        tokens = [columns[0].view(np.uint64), columns[1].view(np.uint64)]
        order = multikey_order(tokens)
        before = splitters[bucket - 1] if bucket else None
        after = splitters[bucket] if bucket < len(splitters) else None
        columns = [c[order] for c in (*columns[2:], known)]
        yield from judge([t[order] for t in tokens], columns, before, after)

    return ready.mapInArrow(run, kinds)


def _classes(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(class number, size of own class) of sorted suffixes that equal each other in all tokens."""
    new = np.ones(len(tokens[0]), bool)
    for i, t in enumerate(tokens):
        new[1:] = (t[1:] != t[:-1]) if i == 0 else new[1:] | (t[1:] != t[:-1])
    number = np.cumsum(new) - 1
    return number, np.bincount(number)[number]


_RUNS = "row bigint, start bigint, n bigint, what int"


def _judge_runs(tokens, columns, before, after) -> Iterator[pa.RecordBatch]:
    """Repeated runs are spans; what shares their gram and is not repeated is loose.

    Of equal runs of one task only the first comes here: a text that repeats itself thousands of
    times is one row, and the others pass through as the spans they are.
    """
    gram, whole = _classes(tokens[:1]), _classes(tokens)
    *columns, known = columns
    repeated = (whole[1] > 1) | (known == _REPEATED)
    # one that its task found repeated says so for the whole class
    repeated |= np.bincount(whole[0], known == _REPEATED)[whole[0]] > 0
    # a gram at the border of the bucket may go on in the next one
    edge = np.zeros(len(tokens[0]), bool)
    if before is not None:
        edge |= tokens[0] == before[0]
    if after is not None:
        edge |= tokens[0] == after[0]
    mixed = np.bincount(gram[0], ~repeated)[gram[0]] > 0
    first = np.ones(len(tokens[0]), bool)
    first[1:] = whole[0][1:] != whole[0][:-1]
    loose = ~repeated & ((gram[1] > 1) | edge)
    witness = repeated & first & (mixed | edge)
    what = SPAN * repeated + LOOSE * (loose | witness)
    at = np.flatnonzero(what)
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(c[at]) for c in columns), pa.array(what[at].astype(np.int32))],
        names=["row", "start", "n", "what"],
    )


_STARTS = "row bigint, start bigint"


def _judge_starts(tokens, columns, before, after) -> Iterator[pa.RecordBatch]:
    """Starts of strings that stand elsewhere too."""
    _, size = _classes(tokens)
    repeated = size > 1
    row, start = columns[0], columns[1]
    more: list[tuple[int, int]] = []
    if before is not None:
        like = (tokens[0] == before[0]) & (tokens[1] == before[1])
        if like.any():  # the splitter, last suffix of the bucket before, is repeated here
            repeated |= like
            more = [(int(before[2]), int(before[3]))]
    at = np.flatnonzero(repeated)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(row[at], [m[0] for m in more]).astype(np.int64)),
         pa.array(np.append(start[at], [m[1] for m in more]).astype(np.int64))],
        names=["row", "start"],
    )


def _run_suffixes(rows: DataFrame, splitters: np.ndarray, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            text, start, n, gram, name = runs_of(
                np.frombuffer(b"".join(raw), np.uint8), ends, length
            )
            known = np.full(len(gram), _OPEN)
            order = np.lexsort((name, gram))
            same = (np.diff(gram[order]) == 0) & (np.diff(name[order]) == 0)
            known[order[1:][same]] = _DONE
            known[order[:-1][same & ~np.append(False, same[:-1])]] = _REPEATED
            yield _suffix_batch(
                splitters, gram, name, batch.column(0).to_numpy()[text], start, n, known
            )

    long = rows.filter(F.octet_length("text") >= length).select("row", "text")
    return long.mapInArrow(run, _KINDS)


def _start_suffixes(packed: DataFrame, loose: DataFrame, splitters: np.ndarray, length: int) -> DataFrame:
    """A suffix for every start of the loose runs of a text."""
    half = length // 2
    # the same shuffle of texts as for the final cut: same columns, same kind of join
    joined = packed.join(loose, "row", "left").select("row", "doc_id", "packed", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            made: list[tuple] = []
            size = 0
            batch = batch.filter(batch.column(3).is_valid())
            for row, packed, runs in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                data = np.frombuffer(open_.decompress(packed), np.uint8)
                runs.sort(key=lambda r: r["start"])
                while runs:
                    # as many runs as one block of hashes reaches
                    a = runs[0]["start"]
                    near = [r for r in runs if r["start"] + r["n"] + length <= a + _BLOCK]
                    runs = runs[len(near) :]
                    at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in near])
                    sums = _prefix(data[a : int(at.max()) + length])
                    made.append(
                        (_hash(sums, at - a, at - a + half), _hash(sums, at - a + half, at - a + length),
                         np.full(len(at), row), at)
                    )
                    size += len(at)
                if size > 200_000:
                    t0, t1, rows, at = (np.concatenate(c) for c in zip(*made))
                    yield _suffix_batch(splitters, t0, t1, rows, at, np.ones(len(at), np.int64))
                    made, size = [], 0
            if made:
                t0, t1, rows, at = (np.concatenate(c) for c in zip(*made))
                yield _suffix_batch(splitters, t0, t1, rows, at, np.ones(len(at), np.int64))

    return joined.mapInArrow(run, _KINDS)


def _packed(rows: DataFrame) -> DataFrame:
    """(row, doc_id, packed): texts compressed before they cross the network."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            press = zstandard.ZstdCompressor(level=6)
            done = [
                press.compress((t or "").encode("utf-8", "surrogatepass"))
                for t in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(done, pa.binary())],
                names=["row", "doc_id", "packed"],
            )

    chosen = rows.select("row", "doc_id", "text")
    return chosen.mapInArrow(run, f"row bigint, doc_id {kind}, packed binary")


def _cut(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and number of the merged spans, and what stays."""
    if not len(start):
        return 0, 0, data
    order = np.argsort(start)
    begin = start[order]
    end = np.maximum.accumulate(begin + size[order])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    begin, end = begin[new], end[np.append(new[1:] - 1, len(end) - 1)]
    stay = zip([0, *end.tolist()], [*begin.tolist(), len(data)])
    return int((end - begin).sum()), len(new), b"".join(data[a:b] for a, b in stay)


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, text) with a number of its own for every row: the id where ids are unique."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    whole = chosen.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint")
    shared = chosen.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if whole and shared.isEmpty():
        return chosen.withColumn("row", F.col("doc_id").cast("bigint"))
    return stage(chosen.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _sampled(row: Column) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(SAMPLE)) == 0


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(row, start, size) of strings that repeat, overlapping, and the packed texts."""
    spark = rows.sparkSession
    parts = partitions(spark)
    none = np.zeros((0, 4), np.uint64)
    lead = _splitters(_run_suffixes(rows.filter(_sampled(F.col("row"))), none, length), parts)
    runs = stage(_buckets(_run_suffixes(rows, lead, length), lead, _judge_runs, _RUNS), "runs")
    loose = stage(
        runs.filter(F.col("what").bitwiseAND(LOOSE) > 0)
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "n")).alias("runs")),
        "loose-runs",
    )
    packed = _packed(rows)
    some = _packed(rows.filter(_sampled(F.col("row"))))
    lead = _splitters(_start_suffixes(some, loose, none, length), parts)
    starts = _buckets(_start_suffixes(packed, loose, lead, length), lead, _judge_starts, _STARTS)
    whole = runs.filter(F.col("what").bitwiseAND(SPAN) > 0).select(
        "row", "start", (F.col("n") + length - 1).alias("size")
    )
    single = starts.select("row", "start", F.lit(length).cast("bigint").alias("size"))
    return whole.union(single), packed


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    doc_id: str = "doc_id",
    text: str = "text",
    with_kept: bool = True,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, ``kept``, the bytes."""
    rows = numbered(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans, packed = repeated_spans(rows, length)
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = packed.join(per_row, "row", "left").select("row", "doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column(3)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            start, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "size"))
            out, upto = [], 0
            for packed, k in zip(batch.column(2), n.tolist()):
                data = open_.decompress(packed.as_py())
                own = slice(upto, upto + k)
                upto += k
                removed, count, kept = _cut(data, start[own], size[own])
                digest = hashlib.sha256(kept).hexdigest()
                out.append((len(data), removed, count, digest, kept if with_kept else None))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    found = joined.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "kept binary",
    )
    return found if with_kept else found.drop("kept")
