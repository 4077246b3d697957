"""Word translation probabilities by expectation-maximisation (M4).

Each target word of a sentence pair comes from one source word within ``band`` words of the
diagonal, every one of them being as likely beforehand. A round takes the posterior of
each (source word, target word) link under the present probabilities and sums them
to new ones. A pair has at most 2 * band + 1 links per target word, so rows are linear in
the text; a band as wide as the sentence is the classic model without positions.

The links of one target word are a cell (key, j). Cells are dealt out once, as one string each, in order of
their target words, and packed into chunks of bounded size: words and distinct (s, t) pairs once, links
as numbers. A round runs inside the chunks, in arrays. Between them go only each chunk's sums per
source word, and per pair for the few target words that several chunks have: numbers alone, by
parts (hashes of source words), as which words stand where is settled before the first round. A round's
counts are written to the shared folder with the log-likelihood of its input, so the stop rule
reads one number a chunk and a lost executor costs no round.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.sources.io import scratch_path, write_bucketed, written

BAND = 2
CHUNK = 1 << 20  # links of a chunk, about
FULL = 1.25  # tasks per chunk's worth of links: ranges are uneven, and few tasks are to have a second chunk
ROUNDS = 5
TOLERANCE = 1e-4


def _banded(src, tgt, band: int):
    """(j, t, ss) of each target word of a pair; null if a side is empty or null."""
    n, m = F.size(src), F.size(tgt)

    def cell(j):
        centre = F.ceil(j * n / m).cast("int")
        low = F.greatest(centre - band, F.lit(1))
        return F.struct(j.alias("j"), F.element_at(tgt, j).alias("t"),
                        F.slice(src, low, F.least(centre + band, n) - low + 1).alias("ss"))

    return F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(1), m), cell))


def _links_of(cells: DataFrame) -> DataFrame:
    return cells.select("key", "c.j", "c.t", F.size("c.ss").alias("size"), F.explode("c.ss").alias("s"))


def banded_links(pairs: DataFrame, key: str, src: str, tgt: str, band: int = BAND) -> DataFrame:
    """Token arrays > (key, j, t, s, size): target word j and each source word within ``band`` of
    ceil(j * n / m); size is the number of these. Pairs with an empty or null side have none.
    Rows are dealt out by key while they are pairs, so that cells need no exchange."""
    some = pairs.where((F.size(src) > 0) & (F.size(tgt) > 0)).repartition(F.col(key))
    return _links_of(some.select(F.col(key).alias("key"), F.explode(_banded(src, tgt, band)).alias("c")))


def banded_cells(pairs: DataFrame, key: str, src: Column, tgt: Column, band: int = BAND) -> DataFrame:
    """The cells of ``banded_links``, for ``train``. Only keys that several rows have are grouped link by
    link: else a pair's cells are whole as they are. Token arrays given as expressions are
    made after the exchange by key."""
    rows = pairs.repartition(_partitions(pairs), F.col(key)).withColumn(
        "_rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
    words = rows.select(F.col(key).alias("key"), "_rows", src.alias("s"), tgt.alias("t"))  # once, not for each cell
    cells = words.select("key", "_rows", F.explode(_banded(F.col("s"), F.col("t"), band)).alias("c"))
    own = cells.where(F.col("_rows") == 1)
    return _compact(own, F.array("c.t"), F.array_sort("c.ss"), F.array(F.size("c.ss"))).unionByName(
        _cells(_links_of(cells.where(F.col("_rows") > 1))))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cells(links: DataFrame) -> DataFrame:
    """The cells of links, each cell's in order."""
    cells = links.groupBy("key", "j").agg(F.array_sort(F.collect_list(F.struct("t", "s", "size"))).alias("l"))

    def short(a):
        return F.when(F.size(F.array_distinct(a)) == 1, F.slice(a, 1, 1)).otherwise(a)

    return _compact(cells, short(F.col("l.t")), F.col("l.s"), short(F.col("l.size")))


_CELLS = ["n", "c", "t", "size"]
_BETWEEN = "\x1f"
_ESCAPED = (("\x1b", "\x1be"), (_BETWEEN, "\x1bu"))


def _compact(cells: DataFrame, t, s, size) -> DataFrame:
    """(n, c, t, size) of arrays, where those of length one hold for all n links: c has a target word and
    the source words as one string; t and size are empty if it says enough, as it does of nearly all cells
    (empty, as Arrow is slow to take lists that are null)."""
    def escaped(w):
        for was, mark in _ESCAPED:
            w = F.replace(w, F.lit(was), F.lit(mark))
        return w

    def said(a, enough):
        return F.when(enough, F.slice(a, 1, 0)).otherwise(a)

    n = F.size(s)
    return cells.select(n.alias("n"), F.concat_ws(_BETWEEN, F.transform(F.concat(F.slice(t, 1, 1), s), escaped)).alias("c"),
                        said(t, F.size(t) == 1).alias("t"), said(size, (F.size(size) == 1) & (size[0] == n)).alias("size"))


def _opened(batch):
    """(t, s, size) of compact cells as lists of words and numbers."""
    c, t, size = (batch.column(batch.schema.get_field_index(name)) for name in _CELLS[1:])
    lists = pc.split_pattern(c, _BETWEEN)
    words, own = lists.flatten(), pc.list_value_length(lists).to_numpy()
    for was, mark in reversed(_ESCAPED):
        words = pc.replace_substring(words, mark, was)
    first = np.zeros(len(words), bool)
    first[np.cumsum(own) - own] = True

    def lists_of(values, lengths):
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)

    def filled(given, values):
        plain, empty = lists_of(values, np.ones(len(own), np.int64)), pc.equal(pc.list_value_length(given), 0)
        return plain if pc.all(empty).as_py() else pc.if_else(empty, plain.cast(given.type), given)

    return (filled(t, words.filter(pa.array(first))), lists_of(words.filter(pa.array(~first)), own - 1),
            filled(size, pa.array(own - 1, pa.int32())))


_CHUNKS = ("chunk long, s array<string>, t array<string>, pair_s array<int>, pair_t array<int>, "
           "link array<int>, size array<int>, cell array<int>, parts array<int>")


def _row(key: int, schema: str, *values) -> pa.RecordBatch:
    """One row of a number and a list of each of the values."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in values]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *lists], names=[c.split()[0] for c in schema.split(", ")])


def _packed(batches, chunk, parts):
    """Cells > chunks: distinct words and pairs, the pair of each link, its cell's size, links per cell.
    Source words stand in order of their part; ``parts`` has the words in each."""
    task, made, held, links = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        cells = pa.RecordBatch.from_arrays([*_opened(batch)], names=["t", "s", "size"])
        ends = np.cumsum(pc.list_value_length(cells.column(1)).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // chunk)) + 1), cells.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            held.append(cells.slice(a, b - a))
            links += ends[b - 1] - (ends[a - 1] if a else 0)
            if links >= chunk:
                yield _chunk(task << 32 | made, held, parts)
                made, held, links = made + 1, [], 0
    if held:
        yield _chunk(task << 32 | made, held, parts)


def _chunk(key, held, parts):
    t, s, size = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
    cell = pc.list_value_length(s).to_numpy()

    def per_link(lists, values):
        own = pc.list_value_length(lists).to_numpy()
        return np.repeat(values, np.repeat(np.where(own == 1, cell, 1), own))

    words, targets = (a.flatten().dictionary_encode() for a in (s, t))
    part = np.array([zlib.crc32(w.encode()) % parts for w in words.dictionary.to_pylist()], np.int64)
    order = np.argsort(part, kind="stable")
    code = np.argsort(order)[words.indices.to_numpy()] * np.int64(len(targets.dictionary)) + per_link(t, targets.indices.to_numpy())
    pairs, link = np.unique(code, return_inverse=True)
    pair_s, pair_t = np.divmod(pairs, max(len(targets.dictionary), 1))
    return _row(key, _CHUNKS, words.dictionary.take(pa.array(order)), targets.dictionary, pair_s.astype(np.int32), pair_t.astype(np.int32),
                link.astype(np.int32), per_link(size, size.flatten().to_numpy()), cell.astype(np.int32),
                np.bincount(part, minlength=parts).astype(np.int32))


def _chunks(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            yield {n: v.values if isinstance(v, pa.ListScalar) else v.as_py() for n, v in row.items()}


def _shared(c):
    """The pairs of target words that other chunks have too."""
    if c["shared"] is None:
        return np.zeros(0, np.int64)
    return np.flatnonzero(pc.is_in(c["t"], value_set=c["shared"]).to_numpy(zero_copy_only=False)[c["pair_t"].to_numpy()])


def _by_part(c, shared):
    """(order, numbers per part): the source words and then the shared pairs, by part."""
    own = np.repeat(np.arange(len(c["parts"])), c["parts"].to_numpy())
    part = np.concatenate((own, own[c["pair_s"].to_numpy()[shared]]))
    return np.argsort(part, kind="stable"), np.bincount(part, minlength=len(c["parts"]))


def _from_parts(c, name, shared):
    """What all parts say of the source words and of the shared pairs."""
    order, _ = _by_part(c, shared)
    out = np.empty(len(order), c[name].type.to_pandas_dtype())
    out[order] = c[name].to_numpy(zero_copy_only=False)
    return out[:len(c["s"])], out[len(c["s"]):]


def _probabilities(c):
    """p of each pair: its count over all chunks by that of its source word."""
    shared = _shared(c)
    counts, (total, whole) = c["counts"].to_numpy().copy(), _from_parts(c, "total", shared)
    counts[shared] = whole
    return counts / total[c["pair_s"].to_numpy()]


_COUNTS = "chunk long, counts array<double>, ll array<double>"


def _counted(batches, vocabulary):
    """One expectation step: expected counts of the pairs, and the log-likelihood. Without
    counts every target word is equally likely."""
    for c in _chunks(batches):
        link, size, cell = (c[n].to_numpy() for n in ("link", "size", "cell"))
        if "counts" in c:
            p = _probabilities(c)[link]
            total = np.repeat(np.add.reduceat(p, np.cumsum(cell) - cell), cell)
            share, ll = p / total, np.log(total / size) / size
        else:
            share, ll = 1 / size, -math.log(max(vocabulary, 1)) / size
        yield _row(c["chunk"], _COUNTS, np.bincount(link, share, len(c["pair_s"])), np.array([ll.sum()]))


_PARTS = "part int, chunk long, c array<double>"
_WORDS = "part int, chunk long, s array<string>, t array<string>"
_PLACES = "part int, chunk long, id array<int>"
_SUMS = "part int, chunk long, total array<double>, first array<boolean>"


def _lists(keys, ends, names, *values) -> pa.RecordBatch:
    """Rows of the keys and, of each of the values, the stretches that end there."""
    ends = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(ends, v if isinstance(v, pa.Array) else pa.array(v))
                                                for v in values)], names=[n.split()[0] for n in names.split(", ")])


def _part_keys(c):
    return pa.array(np.arange(len(c["parts"]), dtype=np.int32)), pa.array(np.full(len(c["parts"]), c["chunk"]))


def _parted(batches):
    """What a chunk tells the others: its counts per source word and per shared pair, a row a part."""
    for c in _chunks(batches):
        shared, counts = _shared(c), c["counts"].to_numpy()
        order, own = _by_part(c, shared)
        sums = np.concatenate((np.bincount(c["pair_s"].to_numpy(), counts, len(c["s"])), counts[shared]))
        yield _lists(_part_keys(c), np.cumsum(own), _PARTS, sums[order])


def _worded(batches):
    """The source words and shared pairs (t null, or not) that ``_parted`` counts, in its order."""
    for c in _chunks(batches):
        shared = _shared(c)
        order, own = _by_part(c, shared)
        s, t = (c[n].take(c[f"pair_{n}"].take(pa.array(shared))) for n in "st")
        both = (pa.concat_arrays([c["s"], s]), pa.concat_arrays([pa.nulls(len(c["s"]), pa.string()), t]))
        yield _lists(_part_keys(c), np.cumsum(own), _WORDS, *(a.take(pa.array(order)) for a in both))


def _joined(table, name):
    """(all lists of a column as one, their lengths)."""
    lists = table.column(name).combine_chunks()
    return lists.flatten(), pc.list_value_length(lists).to_numpy()


def _numbered(words: pa.Table) -> pa.Table:
    """One part's words and pairs as numbers that its chunks share."""
    (s, own), (t, _) = _joined(words, "s"), _joined(words, "t")
    s, t = s.dictionary_encode().indices.to_numpy(), t.dictionary_encode(null_encoding="encode").indices.to_numpy()
    _, numbers = np.unique(s * np.int64(t.max(initial=0) + 1) + t, return_inverse=True)
    keys = [words.column(n).combine_chunks() for n in ("part", "chunk")]
    return pa.Table.from_batches([_lists(keys, np.cumsum(own), _PLACES, numbers.astype(np.int32))])


def _summed(parts: pa.Table, places: pa.Table) -> pa.Table:
    """One part's counts summed over all chunks, and whether a chunk is the first to have the number."""
    parts, places = parts.sort_by("chunk"), places.sort_by("chunk")
    (c, own), (numbers, _) = _joined(parts, "c"), _joined(places, "id")
    numbers = numbers.to_numpy()
    first = np.zeros(len(numbers), bool)
    first[np.unique(numbers, return_index=True)[1]] = True
    total = np.bincount(numbers, c.to_numpy()).astype(float)[numbers]  # a part may be empty
    keys = [parts.column(n).combine_chunks() for n in ("part", "chunk")]
    return pa.Table.from_batches([_lists(keys, np.cumsum(own), _SUMS, total, first)])


def _listed(batches):
    """(s, t, p), each pair from the first chunk that has it."""
    for c in _chunks(batches):
        own, shared = np.ones(len(c["pair_s"]), bool), _shared(c)
        own[shared] = _from_parts(c, "first", shared)[1]
        s, t = (c[n].take(c[f"pair_{n}"].filter(pa.array(own))) for n in "st")
        yield pa.RecordBatch.from_arrays([s, t, pa.array(_probabilities(c)[own])], names=["s", "t", "p"])


def _kept(chunks: DataFrame, name: str, key: str = "chunk") -> DataFrame:
    """Written by the key, so that chunks and their counts, or a part's, meet without an exchange."""
    return write_bucketed(chunks, scratch_path(chunks.sparkSession, name), key, exchange=False)


def chunks_of(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links, or cells, > bucketed chunks of whole cells, each with the target words it shares with others.
    No more tasks pack them than there are full chunks, or cores: every chunk tells others of its source words."""
    cells = written(links if links.columns == _CELLS else _cells(links), "em-cells")
    parts, whole = _partitions(links), cells.agg(F.sum("n")).first()[0] or 0
    tasks = min(parts, max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(FULL * whole / chunk)))
    packed = cells.select(*_CELLS[1:]).repartitionByRange(tasks, "c").sortWithinPartitions("c").mapInArrow(
        partial(_packed, chunk=chunk, parts=parts), _CHUNKS)
    chunks = _kept(packed, "em-chunks")
    places = chunks.select("chunk", F.explode("t").alias("t")).groupBy("t").agg(F.collect_set("chunk").alias("chunks"))
    shared = places.where(F.size("chunks") > 1).select("t", F.explode("chunks").alias("chunk"))
    return chunks.join(written(shared.groupBy("chunk").agg(F.collect_list("t").alias("shared")), "em-shared"), "chunk", "left")


def places_of(chunks: DataFrame) -> DataFrame:
    """(part, chunk, id): the numbers, within a part, of the words and pairs whose sums a chunk tells."""
    return _kept(chunks.mapInArrow(_worded, _WORDS).groupBy("part").applyInArrow(_numbered, _PLACES), "em-places", "part")


def part_sums(counted: DataFrame) -> DataFrame:
    """(part, chunk, c): what the chunks tell each other in a round."""
    return counted.mapInArrow(_parted, _PARTS)


def whole_sums(parts: DataFrame, places: DataFrame) -> DataFrame:
    """(chunk, total, first), by part: the sums over all chunks, and whether this chunk is the first to have them."""
    sums = parts.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_summed, _SUMS)
    lists = sums.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "total", "first"))).alias("l"))
    return lists.select("chunk", F.flatten("l.total").alias("total"), F.flatten("l.first").alias("first"))


def train(links: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
          on_round: Callable[[int, float], None] | None = None, chunk: int = CHUNK) -> tuple[DataFrame, list[tuple[int, float]]]:
    """((s, t, p), [(round, log-likelihood before it)]) of links, or of ``banded_cells``. Ends after ``rounds``, or once the
    log-likelihood gains less than ``tolerance`` of itself; 0 runs all rounds. The
    probabilities come from the last round's written counts. Words are not null."""
    chunks = chunks_of(links, chunk)
    vocabulary = chunks.select(F.explode("t")).distinct().count()
    known, log, places = chunks, [], places_of(chunks)
    for i in range(1, rounds + 1):
        counts = _kept(known.mapInArrow(partial(_counted, vocabulary=vocabulary), _COUNTS), "em-counts")
        likelihood = counts.agg(F.sum(F.col("ll")[0])).first()[0] or 0.0
        log.append((i, likelihood))
        if on_round is not None:
            on_round(i, likelihood)
        counted = chunks.join(counts.select("chunk", "counts"), "chunk")
        known = counted.join(whole_sums(part_sums(counted), places), "chunk")
        if i > 1 and tolerance and likelihood - log[-2][1] < tolerance * math.fabs(log[-2][1]):
            break
    return known.mapInArrow(_listed, "s string, t string, p double"), log


def best_targets(probs: DataFrame, most: int = 1) -> DataFrame:
    """(s, t, p, rank): the ``most`` likeliest targets of each source word (9 decimals; ties: smallest t)."""
    order = Window.partitionBy("s").orderBy(F.round("p", 9).desc(), "t")
    return probs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
