"""Exact removal of repeated 100-byte strings by prefix-free parsing.

Parsing. A rolling hash over short grams puts a trigger into every 100-byte string: the
gram with the smallest hash in it, the leftmost of equals. Neighbouring strings with the
same trigger form a phrase; its content is all bytes of these strings, so each phrase
goes 99 bytes into the next. Equal strings have equal triggers, wherever they stand.

Dictionary and parse. Distinct phrases are the dictionary, a phrase's occurrences in
(document, position) order the parse. Of an equal phrase all occurrences but the first
are repeats as a whole. Only dictionary phrases that share their trigger with a different
phrase can hold further repeats: their 100-byte strings are grouped by a hash and ranked by
(document, position), and all but the first of equal ones are repeats. No suffix arrays of
dictionary or parse are built and nothing is sorted by content: a repeat is decided by
exactly 100 bytes, so equality at that length, which hashes tell, replaces their order.

Phrases are compared by 112 bits of rolling hashes with random byte values, strings by
79 bits. Copies within one batch are settled there before anything is shuffled, and a
trigger with very many different phrases in a batch (the rim of a common passage) goes
straight to its strings, so no key gathers the rows of a hot passage. Where keys
repeat, equal rows of one key are taken once and what is found is joined back to all of them.

The key must be an integer; rows are ordered by it, null last. Null texts count as empty.
A string is a repeat if it also starts at a smaller key, or at the same key at a smaller
position; so repeated rows of one document don't remove each other. Empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from parallax.llm.common import whole_text, written

LENGTH = 100
GRAM = 50
HOT = 64  # different phrases of one trigger in a batch, from which it is taken for hot
CHUNK = 1 << 20  # string starts that are hashed at once
BATCH = 16 << 20  # text bytes whose phrases are compared at once
LAST = (1 << 63) - 1

_RANDOM = np.random.RandomState(20240229)
_BYTES = [_RANDOM.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
          for _ in range(2)]
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, made once per worker."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(CHUNK + 2 * LENGTH, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of up to CHUNK + LENGTH bytes."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = _power_tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _chunks(data: bytes, length: int):
    """(offset, bytes) pieces that overlap such that each string lies in one of them."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - length + 1), CHUNK):
        yield at, raw[at:at + CHUNK + length - 1]


def phrases_of(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(trigger hash, content hash, first string, trigger - first, last - first) of all phrases."""
    window = length - gram + 1
    out = []
    for at, raw in _chunks(data, length):
        one, two = Rolling(raw, _BYTES[0]), Rolling(raw, _BYTES[1])
        hashes = one.grams(gram)
        # the smallest hash with its position; the leftmost of equals wins
        low = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        n, span = len(raw) - length + 1, 1
        while span * 2 <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[window - span:window - span + n])
        trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [n - 1]))
        trigger = trigger[first]
        place = ((trigger - first) << 7 | (last - first)).astype(np.uint64)
        content = two.of(first, last + length) ^ _mix(place + np.uint64(1))
        out.append((hashes[trigger] >> np.uint64(16), content, first + at, trigger - first, last - first))
    if not out:
        return None
    return [np.concatenate(x) for x in zip(*out)]


def strings_of(data: bytes, starts: np.ndarray, length: int = LENGTH):
    """(64-bit hash, 15 more bits) of the strings at sorted ``starts``."""
    first, second = [], []
    for at, raw in _chunks(data, length):
        own = starts[np.searchsorted(starts, at):np.searchsorted(starts, at + CHUNK)] - at
        if len(own):
            first.append(Rolling(raw, _BYTES[0]).of(own, own + length))
            second.append(Rolling(raw, _BYTES[1]).of(own, own + length) >> np.uint64(49))
    return np.concatenate(first), np.concatenate(second)


def _classes(*keys: np.ndarray):
    """Sorted order by all keys, and where each new class of all but the last two begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:-2]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _repeated(order: np.ndarray, new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that stand strictly after the first row of their class."""
    d, a = doc[order], at[order]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d != d[head]) | (a != a[head])
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


# what is to be done with a row: compare, is a repeat, look into its strings, says its trigger is shared
COMPARE, REPEAT, LOOK, SHARED = 0, 1, 2, 3
PHRASES = "trigger bigint, content bigint, k bigint, v bigint, at bigint"
STRINGS = "hash bigint, k bigint, v bigint, at bigint"


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mix(doc.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64)) >> np.uint64(16)


def _settled_phrases(parts: list, hot_at: int) -> pa.RecordBatch:
    trigger, content, first, to_trigger, to_last, k, v = (np.concatenate(x) for x in zip(*parts))
    order, new = _classes(trigger, content, k, first)
    kind = np.where(_repeated(order, new, k, first), REPEAT, COMPARE)
    # triggers with very many different phrases here
    begins = np.flatnonzero(np.concatenate(([True], trigger[order][1:] != trigger[order][:-1])))
    many = np.add.reduceat(new.astype(np.int64), begins) >= hot_at
    hot = np.zeros(len(order), bool)
    hot[order] = np.repeat(many, np.diff(np.concatenate((begins, [len(order)]))))
    kind[hot & (kind == COMPARE)] = LOOK
    shared = trigger[order][begins[many]].astype(np.int64)
    route = np.where(kind == COMPARE, trigger, _spread(k, first)).astype(np.int64)
    at = first << 16 | kind << 14 | to_trigger << 7 | to_last
    n = len(shared)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((route, shared))),
        pa.array(np.concatenate((content.view(np.int64), np.full(n, -1)))),
        pa.array(np.concatenate((k, np.full(n, LAST)))), pa.array(np.concatenate((v, np.zeros(n, np.int64)))),
        pa.array(np.concatenate((at, np.full(n, SHARED << 14))))], names=["trigger", "content", "k", "v", "at"])


def _phrases(batches, hot_at: int, batch_bytes: int):
    """(k, v, data) > phrases, those of one batch already compared with each other."""
    for batch in batches:
        parts, size = [], 0
        for k, v, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = data.as_py()
            found = phrases_of(data)
            if found is None:
                continue
            n = len(found[0])
            parts.append((*found, np.full(n, k, np.int64), np.full(n, v, np.int64)))
            size += len(data)
            if size >= batch_bytes:
                yield _settled_phrases(parts, hot_at)
                parts, size = [], 0
        if parts:
            yield _settled_phrases(parts, hot_at)


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield batch.set_column(3, "data", pa.array([squeeze(x.as_py()) for x in batch.column(3)], pa.binary()))


def _settled_strings(parts: list) -> pa.RecordBatch:
    one, two, start, k, v = (np.concatenate(x) for x in zip(*parts))
    order, new = _classes(one, two, k, start)
    kind = np.where(_repeated(order, new, k, start), REPEAT, COMPARE)
    route = np.where(kind == COMPARE, one.view(np.int64), _spread(k, start).astype(np.int64))
    at = start << 16 | kind << 15 | two.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(k), pa.array(v), pa.array(at)],
                                      names=["hash", "k", "v", "at"])


def _strings(batches):
    """(key, k, v, data, look) > the strings of the phrases in ``look``."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        parts, size = [], 0
        for k, v, data, look in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3),
                                    batch.column(4)):
            look = np.sort(look.values.to_numpy())
            first, count = look >> 16, (look & 127) + 1
            starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            starts = np.unique(starts)
            one, two = strings_of(open_(data.as_py()), starts)
            parts.append((one, two, starts, np.full(len(one), k, np.int64), np.full(len(one), v, np.int64)))
            size += len(one)
            if size >= CHUNK:
                yield _settled_strings(parts)
                parts, size = [], 0
        if parts:
            yield _settled_strings(parts)


def spans_of(n: int, phrases: np.ndarray, strings: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by repeated phrases (packed places) or strings (starts)."""
    starts = np.concatenate((phrases >> 16, strings))
    ends = np.concatenate(((phrases >> 16) + (phrases & 127) + length, strings + length))
    if not len(starts):
        return []
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    covered = np.concatenate(([False], np.cumsum(edge)[:n] > 0, [False]))
    turn = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def _removed(batches):
    """(key, data, repeats, starts) > key, n_bytes, spans, kept."""
    open_ = zstandard.ZstdDecompressor().decompress
    none = np.zeros(0, np.int64)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, spans, kept = [], [], []
            for data, phrases, strings in zip(part.column(1), part.column(2), part.column(3)):
                data = open_(data.as_py())
                runs = spans_of(len(data), phrases.values.to_numpy() if phrases.is_valid else none,
                                strings.values.to_numpy() if strings.is_valid else none)
                left, end = [], 0
                for a, b in runs:
                    left.append(data[end:a])
                    end = b
                left.append(data[end:])
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind),
                                              pa.array(kept, pa.binary())], names=["key", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_at: int = HOT,
                   batch_bytes: int = BATCH) -> DataFrame:
    """One row per document: key, n_bytes, ``spans`` (removed runs of bytes), ``kept`` (the bytes left).

    ``hot_at`` and ``batch_bytes`` say what is settled before the shuffle; results don't depend on them.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"),
                       whole_text(F.col(f"`{text}`")).cast("binary").alias("data"))
    ids = rows.select(F.coalesce("key", F.lit(LAST)).alias("k"))
    repeated = bool(ids.groupBy("k").count().where("count > 1").limit(1).count())
    # rows of one key are told apart by their content, which only repeated keys need
    version = F.xxhash64("data") if repeated else F.lit(0).cast("long")
    rows = rows.select("key", F.coalesce("key", F.lit(LAST)).alias("k"), version.alias("v"), "data")
    # equal rows have equal repeats: these are found on one of them and joined back to all, so that
    # n copies neither gather under their phrases nor mark each other n times
    once = rows
    if repeated:
        once = written(rows.groupBy("k", "v").agg(F.any_value("data").alias("data")), "repeat-texts")
        once = once.select(F.col("k").alias("key"), "k", "v", "data")

    found = once.select("k", "v", "data").mapInArrow(
        lambda b: _phrases(b, hot_at, batch_bytes), PHRASES)
    kind = F.col("at").bitwiseAND(F.lit(3 << 14))
    same = Window.partitionBy("trigger", "content").orderBy("k", F.shiftright("at", 16))
    ranked = found.withColumn("place", F.rank().over(same))
    group = Window.partitionBy("trigger")
    ranked = ranked.withColumn("shared", F.min("content").over(group) != F.max("content").over(group))
    repeat = (kind == REPEAT << 14) | ((kind == COMPARE << 14) & (F.col("place") > 1))
    look = (kind == LOOK << 14) | ((kind == COMPARE << 14) & (F.col("place") == 1) & F.col("shared"))
    marks = ranked.where(repeat | look).select("k", "v", F.when(repeat, F.col("at")).alias("repeat"),
                                               F.when(look, F.col("at")).alias("look"))
    marks = written(marks.groupBy("k", "v").agg(F.collect_list("repeat").alias("repeats"),
                                                F.collect_list("look").alias("look")), "phrases")

    # the texts are shuffled once, compressed: both joins need the same exchange, so k and v
    # are declared non-null and both use all columns
    kinds = StructType([StructField("key", LongType()), StructField("k", LongType(), False),
                        StructField("v", LongType(), False), StructField("data", BinaryType())])
    texts = rows.mapInArrow(_packed, kinds)
    sources = once.mapInArrow(_packed, kinds) if repeated else texts
    inside = marks.where(F.size("look") > 0).select("k", "v", "look").join(sources, ["k", "v"]) \
        .select("key", "k", "v", "data", "look").mapInArrow(_strings, STRINGS)
    same = Window.partitionBy("hash", F.col("at").bitwiseAND(F.lit(0x7FFF))).orderBy("k", F.shiftright("at", 16))
    inside = inside.withColumn("place", F.rank().over(same))
    inside = inside.where((F.col("at").bitwiseAND(F.lit(1 << 15)) != 0) | (F.col("place") > 1))
    starts = inside.groupBy("k", "v").agg(F.collect_list(F.shiftright("at", 16)).alias("starts"))
    whole = texts.join(marks.select("k", "v", "repeats"), ["k", "v"], "left").join(starts, ["k", "v"], "left")
    removed = whole.select("key", "data", "repeats", "starts").mapInArrow(
        _removed, "key bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return removed.withColumnRenamed("key", key)
