"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text, its blob.
The ledger says which rule versions a blob has been scanned with and what they
found. A run scans only blob and rule-version pairs that the ledger lacks; equal
texts are scanned once, whatever the number of paths that hold them. Findings
go back to all paths by a join on the blob.

Findings carry the rule version that made them. A run reports those of the versions it is
given, so what a replaced version or a rule since taken out had found is kept in the ledger
and no longer reported.

Native column functions only. A null text counts as empty; empty tables give
empty results; repeated rows and null paths each get their own result row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.llm.common import fresh_name, whole_text, written


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has fewer
    than ``least`` characters are dropped afterwards. ``hint``: a string that every
    match holds, for a cheap first look."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN_NAMES = ("[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
                "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
BASE_RULES: tuple[SecretRule, ...] = (
    SecretRule("assign", rf"""({ASSIGN_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18, hint="AKIA"),
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES: tuple[SecretRule, ...] = (
    SecretRule("github", r"gh[opusr]_[A-Za-z0-9]{30,}", hint="gh"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{30,}", hint="AIza"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
LEDGER_SCHEMA = "blob string, scanned array<string>, findings array<struct<start: int, rule: string, end: int>>"
FEW_BLOBS = 100_000  # unseen blobs of a run on a ledger up to which their addresses (64 characters each) are broadcast


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _matches(text: Column, rule: SecretRule, number: int) -> Column:
    """Per match: characters before it since the last match, its length, whether it counts.

    Splitting at the matches gives one piece more than there are matches, in order.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else whole
    rows = F.transform(F.arrays_zip(whole.alias("m"), judged.alias("g"), F.slice(gaps, 1, F.size(whole)).alias("gap")),
                       lambda z, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), z["gap"].alias("gap"),
                                             F.length(z["m"]).alias("len"),
                                             (F.length(z["g"]) >= rule.least).alias("ok")))
    seen = text.rlike(rule.pattern)
    if rule.hint:
        seen = F.contains(text, F.lit(rule.hint)) & seen
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(seen, rows).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """(blob, text, todo: rule keys) > ledger rows (blob, scanned, findings).

    The matches of a blob are few beside its text; a running sum over them turns
    gaps and lengths into positions (code points from 0, end exclusive).
    """
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    found = F.concat(*[F.when(F.array_contains("todo", r.key), _matches(F.col("text"), r, i)).otherwise(none)
                       for i, r in enumerate(rules)])
    rows = blobs.select("blob", "todo", F.explode_outer(found).alias("m")).select("blob", "todo", "m.*")
    order = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order).cast("int"))
    key = F.get(_keys(rules), F.col("kind"))
    hit = F.when(F.col("ok"), F.struct((F.col("end") - F.col("len")).alias("start"), key.alias("rule"), "end"))
    return rows.groupBy("blob").agg(F.first("todo").alias("scanned"),
                                    F.sort_array(F.collect_list(hit)).alias("findings"))


def _keys(rules: Sequence[SecretRule]) -> Column:
    return F.array(*[F.lit(r.key) for r in rules])


def current(findings: Column, rules: Sequence[SecretRule]) -> Column:
    """The ledger's findings of just these rule versions, by start, then kind: its place in ``rules``."""
    placed = F.transform(findings, lambda x: F.struct(
        x["start"].alias("start"), (F.array_position(_keys(rules), x["rule"]) - 1).cast("int").alias("kind"),
        x["end"].alias("end")))
    return F.sort_array(F.filter(placed, lambda x: x["kind"] >= 0))


def unseen_blobs(rows: DataFrame, ledger: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """(blob, text) rows > (blob, text, todo) of the blobs that the ledger lacks a rule version for.

    Addresses alone meet the ledger. While the blobs to scan are few, their addresses are
    broadcast and no other text is shuffled; a run with more new blobs than ``FEW_BLOBS``
    shuffles the texts to the addresses.
    """
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
    todo = rows.select("blob").distinct().join(known, "blob", "left").select("blob", F.array_except(
        _keys(rules), F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
    todo = written(todo.where(F.size("todo") > 0), "unseen")
    few = todo.limit(FEW_BLOBS + 1).count() <= FEW_BLOBS
    fetched = rows.join(F.broadcast(todo) if few else todo, "blob")
    return fetched.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("todo").alias("todo"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text",
                  rules: Sequence[SecretRule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, findings by path). ``versions`` holds every version of every path.

    The new rows are written to the shared folder before they are joined, as a
    caller would append them to the ledger. Findings by path: path, blob, findings
    (start, kind, end) of the given rule versions; a kind is a position in ``rules``.
    """
    rows = versions.select(F.col(f"`{path}`").alias("path"), whole_text(F.col(f"`{text}`")).alias("text"))
    rows = rows.withColumn("blob", blob_of(F.col("text")))
    if ledger is None:
        blobs = rows.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("todo", _keys(rules))
    else:
        blobs = unseen_blobs(rows.select("blob", "text"), ledger, rules)
    new = written(scan_blobs(blobs, rules), "ledger")
    per_blob = new if ledger is None else ledger.unionByName(new).groupBy("blob").agg(
        F.flatten(F.collect_list("findings")).alias("findings"))
    hits = per_blob.select("blob", current(F.col("findings"), rules).alias("findings")).where(F.size("findings") > 0)
    found = rows.select("path", "blob").join(hits, "blob", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return new, found.select(F.col("path").alias(path), "blob", F.coalesce("findings", empty).alias("findings"))


def spelled(findings: Column, rules: Sequence[SecretRule] = RULES) -> Column:
    """kind:start:end by start, then kind in the rules' order, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def drop_secret_holders(docs: DataFrame, text: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """The documents in whose text no rule finds a secret, with their own columns.

    The verdict of the ledger goes back to the documents by an anti-join on the blob.
    """
    spark = docs.sparkSession
    new, _ = scan_versions(docs.select(F.lit(None).cast("string").alias("path"), F.col(f"`{text}`").alias("text")),
                           path="path", rules=rules)
    blob = fresh_name(docs, "blob")
    bad = new.where(F.size("findings") > 0).select(F.col("blob").alias(blob))
    out = docs.withColumn(blob, blob_of(whole_text(F.col(f"`{text}`")))).join(bad, blob, "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
