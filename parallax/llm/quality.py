"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; a policy is a versioned mask over those bits, so
a new policy, or the effect of leaving a rule out, needs no second look at the
texts, only bitwise arithmetic on the ledger.

Native column functions only. A null text has no words; an empty table gives an
empty ledger; repeated rows each get their own ledger row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import WHITE, fresh_name, white_words, whole_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """One rule: ``fails`` maps a lookup of measurements to a boolean column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A named version: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]


# The position in this tuple is the rule's bit; append only, so that ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule("symbol_ratio", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("duplicate_lines", lambda m: m("n_dup_lines") * 10 > m("n_lines") * 5),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 20)),
    Rule("upper_case", lambda m: m("n_upper") * 2 > m("word_chars")),
)
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", ("few_words", "repeated_words", "symbol_ratio")),
    Policy("v2", tuple(r.name for r in RULES)),
)}
CURRENT = "v2"


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def word_windows(words: Column) -> Column:
    """A hash of every three consecutive words, in order."""
    first = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def repeated_words(words: Column, windows: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    The windows' hashes are sorted with their positions; equal neighbours are
    confirmed on the words themselves. Rows whose hashes all differ stop before
    the sort.
    """
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, 3) == F.slice(words, b["i"] + 1, 3))

    def repeats(order: Column) -> Column:
        flagged = F.transform(order, lambda x, j: F.when(
            F.coalesce(same(x, F.get(order, j - 1)), F.lit(False))
            | F.coalesce(same(x, F.get(order, j + 1)), F.lit(False)), x["i"]))
        at = F.filter(flagged, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    # a one-element transform binds the sorted array once for all its uses
    counted = F.get(F.transform(F.array(tagged), repeats), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(counted)


def measured(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with one struct column of all measurements (long).

    The one-row explode keeps a later filter from being pushed below the
    measurements, where each rule would measure again.
    """
    t, w, win, lines = (fresh_name(docs, s) for s in ("text", "words", "windows", "lines"))
    keep = list(docs.columns)
    df = docs.withColumn(t, whole_text(F.col(f"`{text}`")))
    df = df.withColumn(w, white_words(F.col(t))).withColumn(
        lines, F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0))
    df = df.withColumn(win, word_windows(F.col(w)))
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(F.col(t), F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(F.col(lines))),
        "n_repeat_words": repeated_words(F.col(w), F.col(win)),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(F.col(t), F.lit(r"\p{Lu}")),
    }
    return df.select(*[F.col(f"`{c}`") for c in keep],
                     F.explode(F.array(F.struct(*[values[m].cast("long").alias(m) for m in MEASURES]))).alias(out))


def failure_bits(measures: str, rules: Sequence[Rule] = RULES) -> Column:
    """The rules' failures as bits of one long."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(lambda m: F.col(measures)[m]), F.lit(1 << i))
                              .otherwise(F.lit(0)).cast("long"))
    return bits


def rule_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text",
                rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: key, the measurements, ``failure_bits``."""
    m = "measures"
    df = measured(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", m)
    return df.select(F.col("key").alias(key), *[F.col(m)[x].alias(x) for x in MEASURES],
                     failure_bits(m, rules).alias("failure_bits"))


def apply_policy(ledger: DataFrame, policy: Policy, out: str = "kept",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with the policy's verdict."""
    return ledger.withColumn(out, F.col("failure_bits").bitwiseAND(F.lit(mask_of(policy.rules, rules))) == 0)


def ablation(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only this
    rule rejects (kept once it is left out). Documents are first counted by
    their bits, so the table that is expanded has at most 2^rules rows."""
    mask = mask_of(policy.rules, rules)
    counted = ledger.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                               for i, r in enumerate(rules) if r.name in policy.rules]))
    return (counted.select("bits", "n", rule.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_documents")))


def keep_good(docs: DataFrame, policy: Policy | None = None, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    policy = policy or POLICIES[CURRENT]
    m = fresh_name(docs, "measures")
    kept = measured(docs, text, m).where(failure_bits(m).bitwiseAND(F.lit(mask_of(policy.rules))) == 0)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
