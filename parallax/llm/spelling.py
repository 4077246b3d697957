"""Spelling variants by a relational trie frontier.

The vocabulary is laid out as the edge table of a trie whose chains are closed up: an
edge has a parent node, a first character, a label, a child node and the word that ends
there, if any. States (word, what is left of it, node, edits) move through it level by
level: they are joined with the level's edges, an exact match of the label keeps the
edits, one replaced or one dropped character makes them 1, and a state with one edit whose
word is used up where another word ends is a pair of neighbours. States without an
edit are at the same time the words from which the next level's edges are grouped, so one
table a level is written to the shared folder, whatever the length of the words: a level
is a fork, not a character.

Only replacing by a greater character and dropping one are tried, as being near is mutual.
Near the top a node has all the words, so an edit is only made in the later half of a
word; a second trie of the reversed words, in the same tables, finds edits in the first half.

Words are compared by code points. Null and repeated words of a given table are left out
and added up; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import whole_text, written

LETTERS = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHORTEST = 6  # code points
RAREST = 5  # occurrences
TIMES = 5  # a form has so many times the occurrences of its variant
# A task counts so many different words, of so many characters in all, before it passes them on.
HELD_WORDS = 200_000
HELD_CHARS = 8_000_000
SMALL_LEVEL = 20_000  # edges of a level that are broadcast


def drop_one(key, word: str, every: int = 199) -> str:
    """The slip of the pen that the words of one in ``every`` (document, word) get."""
    mark = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    if mark % every:
        return word
    at = mark % len(word)
    return word[:at] + word[at + 1:]


def _counted(batches, change, shortest):
    held: Counter[str] = Counter()
    chars = 0

    def out():
        words = list(held)
        part = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())],
                                          names=["word", "n"])
        held.clear()
        return part

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            lowered = text.as_py().translate(_LOWER).decode()
            for word, n in Counter(LETTERS.findall(lowered)).items():
                if change is not None:
                    word = change(key, word)
                if len(word) >= shortest:
                    chars += 0 if word in held else len(word)
                    held[word] += n
            if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                yield out()
                chars = 0
    yield out()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
                rarest: int = RAREST, change: Callable | None = None) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z in lower case.

    ``change(key, word)`` may rewrite the words of a document before they are counted.
    Null texts have no words, repeated rows count each; no letters at all: no rows."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    parts = rows.mapInArrow(lambda b: _counted(b, change, shortest), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _common(a: Column, b: Column) -> Column:
    """How many code points a and b have in common at their start."""
    x, y = F.split(a, ""), F.split(b, "")
    same = F.zip_with(x, y, lambda p, q: F.coalesce((p == q) & (p != ""), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(F.concat(same, F.array(F.lit(False))), False), F.lit(0)) - 1,
                      F.lit(0)).cast("int")


def _tail(text: Column, at: Column | int) -> Column:
    """text from code point ``at`` (from 0) on."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(text, at + 1, F.length(text))


def _words(vocabulary: DataFrame) -> DataFrame:
    """Both directions' states at the roots: the word's number doubled, plus 1 if reversed.

    ``exact``: characters that must still match before an edit may be made."""
    size = F.length("word")
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("rest"), F.floor(size / 2).cast("int").alias("exact")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("rest"), F.ceil(size / 2).cast("int").alias("exact")))
    side = vocabulary.select("id", F.explode(both).alias("s"))
    return side.select((F.col("id") * 2 + F.col("s.side")).alias("word"), "s.rest", "s.exact",
                       (F.lit(-1) - F.col("s.side")).cast("long").alias("node"), F.lit(None).cast("long").alias("ends"),
                       F.lit(0).alias("edits"))


def _edges(states: DataFrame) -> DataFrame:
    """The edges that leave the nodes of one level, from the words that stand there.

    A label is what the smallest and the greatest rest have in common: all between have
    it too. A child is named by the smallest number below it, which no other of its level has."""
    live = states.where((F.col("edits") == 0) & (F.col("rest") != ""))
    grouped = live.groupBy("node", F.substring("rest", 1, 1).alias("head")).agg(
        F.min(F.struct("rest", "word")).alias("low"), F.max("rest").alias("high"), F.min("word").alias("child"),
        F.count(F.lit(1)).alias("words"))
    common = F.when(F.col("words") == 1, F.length("low.rest")).otherwise(_common(F.col("low.rest"), F.col("high")))
    labelled = grouped.withColumn("label", F.substring(F.col("low.rest"), F.lit(1), common))
    return labelled.select("node", "head", "label", "child", (F.col("words") == 1).alias("leaf"),
                           F.when(F.col("low.rest") == F.col("label"), F.col("low.word")).alias("ends"))


def _moved(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level further down.

    A word without an edit stands on its own path, whose label ahead is all its own: edits
    are made where it leaves that path by the edge of another character."""
    e = edges.select("node", "head", "label", "leaf", F.col("child"), F.col("ends").alias("child_ends"))
    rest, label, size = F.col("rest"), F.col("label"), F.length("label")
    moving = states.where("rest != ''").select("word", "rest", "exact", "node", "edits")
    to = [F.col("child").alias("node"), F.col("child_ends").alias("ends"), "leaf"]

    ahead = moving.withColumn("head", F.substring("rest", 1, 1)).join(e, ["node", "head"]).where(F.startswith(rest, label))
    ahead = ahead.select("word", _tail(rest, size).alias("rest"), (F.col("exact") - size).alias("exact"), *to, "edits")

    aside = moving.where((F.col("edits") == 0) & (F.col("exact") <= 0)).join(e, "node")
    replaced = (label > rest) & (F.length(rest) >= size) & (_tail(label, 1) == F.substring(rest, F.lit(2), size - 1))
    dropped = label == F.substring(rest, F.lit(2), size)
    aside = aside.where((F.substring("rest", 1, 1) != F.col("head")) & (replaced | dropped))
    ways = F.array(F.when(replaced, size), F.when(dropped, size + 1))
    aside = aside.select("*", F.explode(ways).alias("used")).where("used is not null").select(
        "word", _tail(rest, F.col("used")).alias("rest"), F.lit(0).alias("exact"), *to, F.lit(1).alias("edits"))
    return ahead.unionByName(aside).where((~F.col("leaf") & (F.col("rest") != "")) | _met()).drop("leaf")


def _met() -> Column:
    """Another word ends where the state stands: all but at most one character is used up,
    and that one or the one before is the edit."""
    return F.col("ends").isNotNull() & (F.length("rest") + F.col("edits") == 1)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(id, word) with unique long ids > pairs (a, b) of ids whose words are one edit apart,
    each pair in both orders, once."""
    states, pairs = written(_words(vocabulary), "spelling-states"), []
    while True:
        pairs.append(states.where(_met()).select("word", "ends"))
        edges = written(_edges(states), "spelling-edges")
        n = edges.count()
        if not n:  # no word goes on from here
            break
        # the levels near the top are small and met by all words
        states = written(_moved(states, F.broadcast(edges) if n <= SMALL_LEVEL else edges), "spelling-states")
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    one, two = F.shiftright("word", 1), F.shiftright("ends", 1)
    ends = found.select(F.explode(F.array(F.struct(one.alias("a"), two.alias("b")),
                                          F.struct(two.alias("a"), one.alias("b")))).alias("p"))
    return ends.select("p.a", "p.b").distinct()


def group_variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n) > word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if
    that has at least ``times`` the word's n; root: from the word, follow forms to the last."""
    if times <= 1:
        raise ValueError("a form must be more frequent than its variant, or forms would go in circles")
    clean = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    words = written(clean.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    pairs = near_pairs(words.select("id", "word"))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("near"))
    best = pairs.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    enough = -F.col("near.less") >= times * F.col("n")
    formed = words.join(best, words.id == best.a, "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("near.form")).alias("form"), F.when(enough, -F.col("near.less")).alias("form_n"))
    formed = written(formed, "forms")
    links = formed.where("form is not null").select("word", F.col("form").alias("to"))
    while True:  # each round doubles how far a link goes; n grows ``times``-fold from form to form
        further = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        links = written(links.join(further, "to", "left").select(
            "word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("went_on")), "roots")
        if links.where("went_on").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n",
                                                     F.coalesce("to", "word").alias("root"))
