"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of 10 consecutive words of each benchmark item (a
shorter item is one window). For all windows of one length a block shift table
says, for the two words at the end of the current position, how far the search
may jump; blocks that end a window lead to a suffix-hash bucket whose windows are
compared word by word.

The benchmark is a stated query set: it is split into blocks of at most
``block_bytes`` of text, each searched in all documents. Equal items are dropped first;
an item longer than a block is cut into pieces that overlap by one word less than a
window, so that no window is lost (only a window that is itself longer than a block makes a
larger one). One block at a time is collected and broadcast, and freed when its hits are written.

Words are maximal runs of digits, letters and non-ASCII characters, A-Z in lower
case. Null texts have no words; null item ids are reported as "null"; repeated items
count once; empty tables give empty results or no hits; every input row gets its
own result row, repeated or not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import shared_path, whole_text, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
# Every byte that is no word character becomes a space, A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_WORD_BYTES).split()


def windows_of(words: Sequence[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class Searcher:
    """Shift and suffix tables of one length of windows."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], length: int):
        self.length = length
        self.block = min(2, length)
        self.longest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for w in windows:
            for end in range(self.block, length + 1):
                key, step = w[end - self.block:end], length - end
                if step < self.shift.get(key, self.longest):
                    self.shift[key] = step
            self.buckets.setdefault(w[-self.block:], []).append((w, windows[w]))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, item ids) of every occurrence of a window, in order."""
        shift, longest, length, n = self.shift.get, self.longest, self.length, len(words)
        end = length
        if self.block == 1:
            for i, word in enumerate(words):
                for _, items in self.buckets.get((word,), ()):
                    yield i, items
            return
        while end <= n:
            block = (words[end - 2], words[end - 1])
            step = shift(block, longest)
            if step:
                end += step
                continue
            here = tuple(words[end - length:end])
            for window, items in self.buckets[block]:
                if window == here:
                    yield end - length, items
            end += 1


class Patterns:
    """All windows of one block of the benchmark."""

    def __init__(self, items: Iterable[tuple[str, str | None]], size: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                ids = by_length.setdefault(len(w), {}).setdefault(w, [])
                if item not in ids:
                    ids.append(item)
        self.searchers = [Searcher(w, n) for n, w in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged [start, end) runs of hit words, and the items that occur."""
        spans, items = [], set()
        for s in self.searchers:
            for start, ids in s.find(words):
                spans.append((start, start + s.length))
                items.update(ids)
        return merged(spans), sorted(items)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _patterns(name: str, block: Broadcast, size: int) -> Patterns:
    """The tables of the block of this name, kept while a worker searches it."""
    return Patterns(block.value, size)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _searched(batches, items, size, names):
    """Result columns in place of the text, the last column."""
    patterns = _patterns(*items, size)
    for batch in batches:
        n_words, spans, found = [], [], []
        for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
            words = words_of(text.as_py())
            runs, ids = patterns.search(words)
            n_words.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in runs])
            found.append(ids)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(spans, SPANS),
             pa.array(found, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])


def _clean(batches, items, size, at):
    """The rows whose column ``at`` has no hit."""
    patterns = _patterns(*items, size)
    for batch in batches:
        keep = [not patterns.search(words_of(t.as_py()))[0] for t in batch.column(at).cast(pa.binary())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _joined(batches):
    """Runs that several blocks found (the last column but one), merged."""
    for batch in batches:
        runs = [[{"start": a, "end": b} for a, b in merged((s["start"], s["end"]) for s in row)]
                for row in batch.column("spans").to_pylist()]
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(runs, SPANS))


def pieces_of(text: bytes, size: int, most: int) -> Iterator[bytes]:
    """The words of a text that is longer than ``most`` bytes, cut to that length; each piece begins
    with the last ``size`` - 1 words of the one before, and has a whole window at least."""
    words, first = words_of(text), 0
    while first < len(words):
        last, held = first, 0
        while last < len(words) and (last < first + size or held + len(words[last]) < most):
            held += len(words[last]) + 1
            last += 1
        yield b" ".join(words[first:last])
        if last == len(words):
            return
        first = last - size + 1


ITEM_BYTES = 64  # what an item counts for beside its text


def _dealt(batches, size: int, most: int):
    """(item, text) > (block, item, text): blocks of at most ``most`` bytes, one open at a time."""
    name, held = uuid.uuid4().hex, 0
    for batch in batches:
        rows: list[tuple[str, str, bytes]] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            short = len(text) + len(item.encode()) + ITEM_BYTES <= most
            room = most - len(item.encode()) - ITEM_BYTES
            for piece in (text,) if short else pieces_of(text, size, room):
                cost = len(piece) + len(item.encode()) + ITEM_BYTES
                if held and held + cost > most:
                    name, held = uuid.uuid4().hex, 0
                held += cost
                rows.append((name, item, piece))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
             pa.array(columns[2], pa.binary()).cast(pa.string())], names=["block", "item", "text"])


class Blocks:
    """A benchmark dealt into blocks, written to the shared folder by block."""

    def __init__(self, benchmark: DataFrame, item: str, size: int, block_bytes: int):
        self.spark = benchmark.sparkSession
        tests = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"),
                                 whole_text("text").alias("text")).distinct()
        total = tests.agg(F.sum(F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
        parts = max(1, -(-total // block_bytes))
        tests = tests.coalesce(1) if parts == 1 else tests.repartition(parts)
        dealt = tests.mapInArrow(lambda b: _dealt(b, size, block_bytes), "block string, item string, text string")
        self.path = shared_path(self.spark, "blocks")
        dealt.write.partitionBy("block").parquet(self.path)
        self.table = self.spark.read.schema("item string, text string, block string").parquet(self.path)
        self.names = sorted(r[0] for r in self.table.select("block").distinct().collect())

    def __iter__(self) -> Iterator[tuple[str, Broadcast]]:
        """(name, broadcast items) of each block; the block before is freed."""
        for name in self.names:
            rows = self.table.where(F.col("block") == name).select("item", "text").collect()
            shared = self.spark.sparkContext.broadcast(tuple(sorted((r["item"], r["text"]) for r in rows)))
            yield name, shared
            if len(self.names) > 1:  # what came of it has been written
                shared.destroy()


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item: str = "item_id", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, n_words, ``spans`` (runs of hit words), ``items`` (sorted as strings)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    blocks = Blocks(benchmark, item, size, block_bytes)
    if len(blocks.names) <= 1:
        one = next(iter(blocks), ("none", docs.sparkSession.sparkContext.broadcast(())))
        found = rows.mapInArrow(lambda b: _searched(b, one, size, ["key"]), f"key {kind}, {RESULT}")
        return found.select(F.col("key").alias(key), "n_words", "spans", "items")
    # several blocks: rows are numbered once, each block adds its part, the parts of a row meet
    rows = written(rows.select(F.monotonically_increasing_id().alias("row_no"), "key", "text"), "leak-rows")
    parts = [written(rows.mapInArrow(lambda b, one=one: _searched(b, one, size, ["row_no", "key"]),
                                     f"row_no bigint, key {kind}, {RESULT}"), "leak-part") for one in blocks]
    met = reduce(DataFrame.unionByName, parts).groupBy("row_no").agg(
        F.any_value("key").alias("key"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = met.select("key", "n_words", "spans", "items")
    return met.mapInArrow(_joined, met.schema).withColumnRenamed("key", key)


def clean_of(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
             size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit word, with their own columns. One block: a filter,
    without a shuffle; of several each writes what it leaves before the next is read."""
    at = docs.columns.index(text)
    blocks = Blocks(benchmark, item, size, block_bytes)
    for one in blocks:
        docs = docs.mapInArrow(lambda b, one=one: _clean(b, one, size, at), docs.schema)
        docs = written(docs, "clean-of") if len(blocks.names) > 1 else docs
    return docs
