"""Periodic runs of words by multi-scale minimizers.

A run is a longest stretch of words that repeats with smallest period q and is at least
``least`` words and ``times`` periods long. Periods below ``SHORT`` are found by comparing
the words with themselves at each lag. Longer ones are found scale by scale. The scale
of width w takes periods from 2w up to 4w: every start of w words has a content hash, the
minimal hashes of all windows of w starts are the scale's minimizers, and two minimizers
of equal hash at a distance within the scale's periods seed an extension at that
distance, word by word in both directions. No hash decides a result.

Why no run is missed: in a run of period q the contents at i and i + q are equal, so a
window within the run and the one q further have their minima at the same place. A run of
three periods holds such a pair of windows for each start in its first period, as 2w <= q.
Starts whose w words have a period of w / 3 or less belong to runs of earlier scales and
are no candidates; they can't fill a whole period (else q were not the smallest). The rest
have equal neighbours only more than w / 3 apart, so a minimizer meets at most twelve
partners, and a scale has seeds in proportion to the words over w.

Documents of similar length are searched in one array, parted by words that occur once,
``CHUNK`` words at a time; one document is one unit however long. Words are maximal runs
without ASCII white space. Null texts have no words; repeated rows and null keys get their
own result row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import whole_text

LEAST = 24
TIMES = 3
SHORT = 16  # periods below are found by lag scans
CHUNK = 200_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
Run = tuple[int, int, int]  # start, length, period


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i:i + width] for every i; ``width`` is a power of two."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _lag_scans(words: np.ndarray, least: int, times: int) -> Iterator[Run]:
    """Longest stretches of each short period that are ``least`` words and ``times`` periods long."""
    for q in range(1, min(SHORT, len(words))):
        same = np.flatnonzero(words[q:] == words[:-q])
        if not len(same):
            continue
        cut = np.flatnonzero(np.diff(same) != 1)
        begin, end = same[np.concatenate(([0], cut + 1))], same[np.concatenate((cut, [len(same) - 1]))] + 1
        long = np.flatnonzero(end - begin + q >= max(least, times * q))
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            yield a, b - a + q, q


def _extended(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch [a, b) round ``at`` whose words are those ``lag`` further on."""
    n, step, b = len(words) - lag, 64, at
    while b < n:
        end = min(n, b + step)
        differ = words[b:end] != words[b + lag:end + lag]
        if differ.any():
            b += int(differ.argmax())
            break
        b, step = end, step * 2
    step, a = 64, at
    while a > 0:
        begin = max(0, a - step)
        differ = (words[begin:a] != words[begin + lag:a + lag])[::-1]
        if differ.any():
            a -= int(differ.argmax())
            break
        a, step = begin, step * 2
    return a, b


def _seeds(hashes: np.ndarray, usable: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal minimizers 2 to 4 widths apart, by distance, then position."""
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ranked = np.where(usable, hashes, NONE)
    least = _sliding(ranked, width, np.minimum)
    # a start is a minimizer if it is the least of any window that holds it
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    chosen = np.flatnonzero(usable & (ranked == most))
    order = chosen[np.argsort(hashes[chosen], kind="stable")]
    keys, at, lag, step = hashes[order], [], [], 1
    while step < len(order):
        apart = order[step:] - order[:-step]
        near = (keys[step:] == keys[:-step]) & (apart < 4 * width)
        if not near.any():
            break
        hit = np.flatnonzero(near & (apart >= 2 * width))
        at.append(order[hit])
        lag.append(apart[hit])
        step += 1
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, lag = np.concatenate(at), np.concatenate(lag)
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def find_runs(words: np.ndarray, longest: int | None = None, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs (start, length, period) of an array of word numbers, by start, then period.

    ``longest``: no run is longer (the longest document where several stand in the array).
    ``times`` is at least three: the search rests on it."""
    if times < 3:
        raise ValueError("runs of fewer than three periods can't be found this way")
    longest = len(words) if longest is None else longest
    found: dict[tuple[int, int], int] = {}  # (start, length) > smallest period
    for a, size, q in _lag_scans(words, SHORT // 2, 3):  # shorter ones too: starts in them are no candidates
        found.setdefault((a, size), q)
    hashes, width = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while times * 2 * width <= longest or width < SHORT // 2:
        if width >= SHORT // 2:
            usable = np.ones(len(hashes), bool)
            for (a, size), q in found.items():
                if 3 * q <= width <= size:
                    usable[a:a + size - width + 1] = False
            done: tuple[int, int] = (0, 0)  # distance, end of the last stretch
            for at, lag in zip(*(x.tolist() for x in _seeds(hashes, usable, width))):
                if done[0] == lag and at < done[1]:
                    continue
                a, b = _extended(words, at, lag)
                done = (lag, b)
                if b - a >= 2 * lag:
                    found.setdefault((a, b - a + lag), lag)
        if len(hashes) <= width:
            break
        hashes = _mixed(hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) + hashes[width:])
        width *= 2
    return sorted((a, size, q) for (a, size), q in found.items() if size >= max(least, times * q))


def _of_documents(texts: Sequence[list[bytes]], least: int, times: int) -> Iterator[list[Run]]:
    """The runs of each document; their words are numbered together and parted by unique ones."""
    numbers: dict[bytes, int] = {}
    whole = np.empty(sum(map(len, texts)) + len(texts), np.int64)
    begins, at = [], 0
    for i, words in enumerate(texts):
        begins.append(at)
        whole[at:at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        at += len(words)
        whole[at] = -1 - i
        at += 1
    runs: list[list[Run]] = [[] for _ in texts]
    for a, size, q in find_runs(whole, max(map(len, texts)), least, times):
        i = int(np.searchsorted(begins, a, side="right")) - 1
        runs[i].append((a - begins[i], size, q))
    yield from runs


def kept_words(n: int, runs: Sequence[Run]) -> np.ndarray:
    """Which of n words stand in no run after its first period."""
    kept = np.ones(n, bool)
    for a, size, q in runs:
        kept[a + q:a + size] = False
    return kept


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RESULT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _searched(batches, least, times):
    for batch in batches:
        texts = [t.as_py().split() for t in batch.column(1).cast(pa.binary())]  # bytes: ASCII white space
        runs: list[list[Run]] = [[] for _ in texts]
        # documents of a size in one array: as many scales for all of it
        order = sorted((i for i, w in enumerate(texts) if len(w) >= max(least, times)), key=lambda i: len(texts[i]))
        part: list[int] = []
        total = 0
        for k, i in enumerate(order):
            part.append(i)
            total += len(texts[i])
            last = k + 1 == len(order)
            if last or total >= CHUNK or len(texts[order[k + 1]]).bit_length() > len(texts[part[0]]).bit_length():
                for j, found in zip(part, _of_documents([texts[j] for j in part], least, times)):
                    runs[j] = found
                part, total = [], 0
        collapsed = [b" ".join([w for w, k in zip(words, kept_words(len(words), own).tolist()) if k] if own else words)
                     for words, own in zip(texts, runs)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(w) for w in texts], pa.int64()),
             pa.array([[{"start": a, "length": s, "period": q} for a, s, q in own] for own in runs], RUNS),
             pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
                  times: int = TIMES) -> DataFrame:
    """One row per document: key, n_words, ``runs`` (by start, then period) and ``collapsed``:
    the words that no run holds after its first period, joined by one space."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _searched(b, least, times), f"key {kind}, {RESULT}").withColumnRenamed("key", key)
