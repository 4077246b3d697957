"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm import (bpe_count, chat, licences, packing, periodic, quality, repeats, secrets, simhash, spelling,
                          toxicity, urls, wumanber)
from parallax.llm.common import load, white_words
from parallax.llm.oracles import HOSTILE, ORACLE  # noqa: F401


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], rows.schema)
    done = chat.format_conversations(rows.unionByName(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # cut out of the formatted text by the mask, so that the digest proves the mask
    done = done.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped", "identical")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = secrets.scan_versions(load(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"] < len(secrets.BASE_RULES))

    def count(kind: int):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
                        secrets.spelled(F.col("findings")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe_count.count_tokens(load(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")

    def fold(key: str):
        return F.crc32(F.col(key).cast("string").cast("binary")) % 5

    sample = toxicity.training_sample(docs, load(spark, sf_dir, "labels"), usable=fold("key") != 0)
    scored = toxicity.score_documents(docs, toxicity.fit_sample(sample))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("sentences").cast("long").alias("n_offending"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack_documents(load(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wumanber.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(load(spark, sf_dir, "documents"))

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    base = F.filter("spans", lambda s: s["base"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"), F.array_max(F.col("base.start")).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.rule_ledger(load(spark, sf_dir, "documents"))
    judged = quality.apply_policy(ledger, quality.POLICIES[quality.CURRENT])
    base = quality.apply_policy(judged, quality.BASE, "base_kept")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_kept")).alias("base_failed"), "kept", "failure_bits")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.SAMPLE_RULES), "host string, path string, verdict string")
    return urls.judge_urls(load(spark, sf_dir, "pages"), rules)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten goes round in a loop from some word on.

    With h the CRC-32 of the id, divisible by ten, and g = h // 10: from word a = g % n on the
    n words repeat those from a to a + p, p = 1 + (n - a) // (3 + g % 8). Other texts stay."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, white_words(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("words", words).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))
    turned = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(again), F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(looped(load(spark, sf_dir, "documents")))
    # runs come by start, then period: the first of greatest length over period stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(load(spark, sf_dir, "documents"), change=spelling.drop_one)
    return spelling.group_variants(counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_token_count": op4_token_count,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_pack": op7_pack,
    "op8_decontaminate": op8_decontaminate,
    "op9_licence_scan": op9_licence_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_url_filter": op11_url_filter,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
