"""Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random into groups of bounded size; each group is packed by
itself, so no step sees more than a group. In a group every document is cut into
pieces of the sequence length and one rest. Rests are placed longest first into the
first sequence with room, found by descending a tournament tree whose inner nodes
hold the largest room below them. Rests of the emptiest sequences are then cut
to fill the rooms that are left, so that a group ends with one open sequence, which
is cut into powers of two (those need no padding).

A token stream is the document's ids plus an end id. Null texts count as empty
(the end id alone); repeated rows are packed as documents of their own; empty tables
give no pieces.
"""

import base64
from collections.abc import Sequence
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import whole_text

LENGTH = 2048
END_ID = 1
GROUP_BYTES = 16 << 20  # text bytes that a group holds on average


class Tokens:
    """The ids of a byte-level vocabulary, by its rank file: the same vocabulary, cutting and
    special strings as its .json has, in a quarter of the time. What that library can't cut
    (a run of white space of a million characters) is encoded by the .json's own."""

    def __init__(self, vocabulary_path: str, ranks_path: str, special: dict[str, int], pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.vocabulary_path = vocabulary_path

    @cached_property
    def vocabulary(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary_path)

    def ids(self, text: str) -> list[int]:
        try:
            return self.encoding.encode(text, allowed_special="all")
        except ValueError:
            return self.vocabulary.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def _tokens(vocabulary_path: str | None, ranks_path: str | None) -> Tokens:
    import public_tokenizers

    return Tokens(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"),
                  ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256},
                  public_tokenizers.PATTERN)


def token_streams(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  vocabulary_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """key, ids: little-endian unsigned 32-bit ids with the end id, as bytes."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))

    def encoded(batches):
        tokens = _tokens(vocabulary_path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.array(tokens.ids(t.as_py()) + [END_ID], "<u4").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return rows.mapInArrow(encoded, f"key {rows.schema['key'].dataType.simpleString()}, ids binary")


class Rooms:
    """Tournament tree over bins: each node holds the largest room below it."""

    def __init__(self, most_bins: int, room: int):
        self.size = 1 << max(0, most_bins - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with that much room."""
        i = 1
        while i < self.size:
            i *= 2
            if self.tree[i] < need:
                i += 1
        return i - self.size

    def take(self, bin_: int, amount: int) -> None:
        i = bin_ + self.size
        self.tree[i] -= amount
        while i > 1:
            i //= 2
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def room(self, bin_: int) -> int:
        return self.tree[bin_ + self.size]


Piece = tuple[int, int, int]  # document (its place in the group), start, length


def first_fit_decreasing(rests: Sequence[Piece], length: int) -> list[list[Piece]]:
    rooms = Rooms(max(1, len(rests)), length)
    bins: list[list[Piece]] = []
    for piece in sorted(rests, key=lambda p: (-p[2], p[0])):
        b = rooms.first(piece[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(piece)
        rooms.take(b, piece[2])
    return bins


def fill_rooms(bins: list[list[Piece]], length: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Cut the pieces of the emptiest bins into the rooms of the others.

    As many bins are kept as the tokens can fill; what is left over is less than a
    sequence and comes back as the second value.
    """
    def used(b: list[Piece]) -> int:
        return sum(p[2] for p in b)

    order = sorted(bins, key=used, reverse=True)
    n_keep = sum(map(used, order)) // length
    keep, loose = order[:n_keep], [p for b in order[n_keep:] for p in b]
    loose.sort(key=lambda p: p[2])
    for b in keep:
        room = length - used(b)
        while room:
            doc, start, size = loose.pop()
            cut = min(size, room)
            b.append((doc, start, cut))
            room -= cut
            if cut < size:
                loose.append((doc, start + cut, size - cut))
    return keep, loose


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """One open sequence as several whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    out, queue = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        own: list[Piece] = []
        while need:
            doc, start, size = queue.pop(0)
            cut = min(size, need)
            own.append((doc, start, cut))
            need -= cut
            if cut < size:
                queue.insert(0, (doc, start + cut, size - cut))
        if own:
            out.append(own)
    return out


def pack(lengths: Sequence[int], length: int = LENGTH) -> list[list[Piece]]:
    """Sequences of pieces for documents of these lengths."""
    full = [[(d, s, length)] for d, n in enumerate(lengths) for s in range(0, n - length + 1, length)]
    rests = [(d, n - n % length, n % length) for d, n in enumerate(lengths) if n % length]
    closed, left = fill_rooms(first_fit_decreasing(rests, length), length)
    return full + closed + powers(left)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   group_bytes: int = GROUP_BYTES, vocabulary_path: str | None = None,
                   ranks_path: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids (bytes), doc_tokens, sequence_id, offset.

    The number of groups follows from the bytes of all texts; a document's group
    from a hash of its key and its row, so repeated rows and hot keys spread.
    """
    total = docs.agg(F.sum(F.octet_length(whole_text(F.col(f"`{text}`"))) + 8)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    streams = token_streams(docs, key, text, vocabulary_path, ranks_path)
    group = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(groups))
    kind = streams.schema["key"].dataType.simpleString()

    def packed(group_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        # the rows' order must not depend on the shuffle: a repeated task makes the same sequences
        order = sorted(range(len(part)), key=part["row_no"].tolist().__getitem__)
        keys, ids = part["key"].tolist(), part["ids"].tolist()
        out = []
        for n, pieces in enumerate(pack([len(ids[i]) // 4 for i in order], length)):
            offset = 0
            for d, start, size in pieces:
                i = order[d]
                out.append((keys[i], start, size, ids[i][4 * start:4 * (start + size)], len(ids[i]) // 4,
                            (int(group_key[0]) << 32) + n, offset))
                offset += size
        return pd.DataFrame(out, columns=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    streams = streams.withColumn("row_no", F.monotonically_increasing_id())
    pieces = streams.withColumn("group", group).groupBy("group").applyInPandas(
        packed, f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                "sequence_id bigint, offset bigint")
    return pieces.withColumnRenamed("key", key)
