"""Token counts by heap-and-linked-list byte-pair merging.

Counts what the piece vocabulary's own library would emit, without ever making an
identifier: a text's symbols are its characters (a character outside the vocabulary
counts as its UTF-8 bytes); the adjacent pair whose union ranks best is merged again
and again, taken from a heap, neighbours being kept in a linked list. The count is
symbols minus merges.

No piece of such a vocabulary goes on with a space mark after another character
(checked when it is loaded), so merges never cross from a character into a following
space: the text is cut there, and counts of cut units are remembered in a bounded
cache per worker.

Null texts count as empty (no tokens); every input row gets its own result row;
empty tables give empty results.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import whole_text

SPACE = "▁"
# What a worker remembers: units of so many characters, and so many characters in all. Memory
# only, counts don't depend on it.
CACHED_UNIT = 64
CACHED_CHARS = 8_000_000


class PieceCounter(dict):
    """unit > tokens, filled on demand. A unit is a run of characters between cuts."""

    def __init__(self, model_path: str):
        super().__init__()
        self.held = 0  # characters
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(self.model.get_piece_size())
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in ids
                      if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("a piece holds a space mark after another character; units can't be cut there")
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        self.cut_lines = not any("\n" in p for p in self.score)
        if not self.cut_lines:
            self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # what normalisation does to plain text: nothing but the space marks, if these agree
        self.plain = self.model.normalize("a  b\tc\né Ａ ") == f"{SPACE}a{SPACE}{SPACE}b\tc\né{SPACE}Ａ{SPACE}"

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.model.normalize(text)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units.findall(self.normalised(text))))

    def __missing__(self, unit: str) -> int:
        n = self.merged(unit)
        if len(unit) <= CACHED_UNIT:
            if self.held + len(unit) > CACHED_CHARS:
                self.clear()
                self.held = 0
            self[unit] = n
            self.held += len(unit)
        return n

    def merged(self, unit: str) -> int:
        """Symbols minus merges of one unit."""
        score = self.score
        text = list(unit)
        n = sum(1 if c in score else len(c.encode("utf-8")) for c in text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            pair = text[i] + text[j]
            rank = score.get(pair)
            if rank is not None:
                heapq.heappush(heap, (-rank, i, j, pair))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            # stale once either side has grown or gone
            if not text[i] or not text[j] or text[i] + text[j] != pair or right[i] != j:
                continue
            text[i], text[j] = pair, ""
            right[i] = right[j]
            if right[j] < len(text):
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
            n -= 1
        return n


@lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """key, n_bytes, n_tokens per document. The model's file must be where the workers
    look for it; without a path each worker takes the installed one."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))

    def counted(batches):
        counter = _counter(model_path or default_model())
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.as_py()) for t in texts.cast(pa.binary())], pa.int64()),
                pa.array([counter.count(t.as_py()) for t in texts], pa.int64())], names=["key", "n_bytes", "n_tokens"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(counted, f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key)
