"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain of
it and whose path starts with the rule's. Of the rules that fit, the one with the most
host labels wins, then the one with the longest path; where one (host, path) is both
allowed and blocked, it is blocked. Urls that no rule fits get the default verdict.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case; path: what follows up to ``?``, ``#`` or the end. A null url, or one without
``://``, has an empty host and path, and no rule fits an empty host.

The rules' size is summed first. Up to ``trie_bytes`` they are broadcast as one trie and
pages are judged without a shuffle. Beyond it, urls meet the rules in a join on (host
suffix, folder of the path), of which a url has no more than the deepest rule does.

Rules with a null or empty host are left out, a null path is empty. Repeated rows and null
keys get their own result row; empty tables give empty results; no rules: the default.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import written

TRIE_BYTES = 8 << 20
ALLOW, BLOCK = "allow", "block"
# The rules that the registered query applies (host, path, verdict).
SAMPLE_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
                ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    return F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))


class Trie:
    """Rules by their host labels from the right, then by their path segments.

    A path is its segments between slashes; the last one of a rule need only begin the
    url's segment at its place, so ``/en/1`` is ``en``, then what begins with ``1``.
    """

    def __init__(self, rules):
        self.top: dict = {}
        for host, path, verdict in rules:
            node = self.top
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            paths = node.setdefault(None, ({}, {}))  # None is no label: the paths of this host
            *folders, last = path.split("/")
            for name in folders:
                paths = paths[0].setdefault(name, ({}, {}))
            old = paths[1].setdefault(len(last), {}).get(last)
            paths[1][len(last)][last] = (host + path, BLOCK if BLOCK in (verdict, old and old[1]) else verdict)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, best, names = self.top, None, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                names = names or path.split("/")
                best = self._path(node[None], names) or best
        return best

    @staticmethod
    def _path(node, names: list[str]) -> tuple[str, str] | None:
        best = None
        for name in names:
            for size in sorted(node[1], reverse=True):
                if (found := node[1][size].get(name[:size])) is not None:
                    best = found
                    break
            node = node[0].get(name)
            if node is None:
                break
        return best


@lru_cache(maxsize=1)
def _trie(rules: tuple[tuple[str, str, str], ...]) -> Trie:
    return Trie(rules)


def _judged(batches, rules, names):
    trie = _trie(rules.value)
    for batch in batches:
        found = [trie.longest(h, p) if h else None for h, p in
                 zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
        columns = [pa.array([f and f[i] for f in found], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)


def by_trie(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (key, host, path) with ``rule`` and ``found``; rules of a checked size."""
    shared = urls.sparkSession.sparkContext.broadcast(tuple(sorted(tuple(r) for r in rules.collect())))
    names = [*urls.columns, "rule", "found"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(lambda b: _judged(b, shared, names), f"{kinds}, rule string, found string")


def by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join, for rules of any size.

    A url meets a rule where one of its host suffixes and one of its folders are the
    rule's; what follows the rule's last slash is compared in the join. A url is spread
    to no more suffixes and folders than the deepest rule has.
    """
    rows = written(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    folder = F.regexp_extract("path", "^.*/", 0)
    cut = rules.select("host", "path", "verdict", folder.alias("folder"),
                       F.substring("path", F.length(folder) + 1, F.length("path")).alias("rest"))
    deep = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"),
                     F.max(F.size(F.split("path", "/"))).alias("folders")).first()
    labels, names = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deep["labels"] or 1))),
                           lambda i: F.array_join(F.slice(labels, -i, i), "."))
    folders = F.transform(F.sequence(F.lit(0), F.least(F.size(names), F.lit(deep["folders"] or 1)) - 1),
                          lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(names, 1, i), "/"), F.lit("/")))
                          .otherwise(F.lit("")))
    spread = rows.where("host != ''").select("row", "path", F.explode(suffixes).alias("suffix"), folders.alias("folders"))
    spread = spread.select("row", F.col("path").alias("url_path"), "suffix", F.explode("folders").alias("url_folder"))
    met = spread.join(cut, (F.col("suffix") == F.col("host")) & (F.col("url_folder") == F.col("folder"))
                      & F.startswith("url_path", F.concat("folder", "rest")))
    rank = F.struct(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"),
                    F.concat("host", "path").alias("rule"), F.col("verdict").alias("found"))
    best = met.groupBy("row").agg(F.max(rank).alias("best")).select("row", "best.rule", "best.found")
    return rows.join(best, "row", "left").drop("row")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW,
               trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per page: key, host, path, ``rule`` (host and path; null if none fits), ``verdict``.

    ``rules`` has the columns host, path, verdict (allow or block)."""
    clean = rules.where("host != ''").groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).agg(F.max("verdict").alias("verdict"))
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    address = F.col(f"`{url}`").cast("string")
    urls = pages.select(F.col(f"`{key}`").alias("key"), host_of(address).alias("host"), path_of(address).alias("path"))
    found = by_trie(urls, clean) if size <= trie_bytes else by_join(urls, clean)
    return found.select(F.col("key").alias(key), "host", "path", "rule",
                        F.coalesce("found", F.lit(default)).alias("verdict"))
