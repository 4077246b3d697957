"""End-to-end batch jobs that write each stage to storage.

The registered queries are lazy plans. A production run instead writes every
stage to a table and reads it back. That cuts the lineage, so a lost
executor recomputes one stage and not the whole chain. It also lets later
jobs read the table instead of re-deriving it, the way the curation,
training and evaluation steps hand over files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parallax import constants as K
from parallax.functions import text as T
from parallax.operators import curate as C
from parallax.operators import metrics as M
from parallax.operators import models as MD
from parallax.operators import overlap as O
from parallax.operators import pairing as P
from parallax.operators import positional as G
from parallax.sources import io as IO


def write_curated_splits(spark: SparkSession, raw: DataFrame, path: str, key: str = "pair_id",
                         cols: Sequence[str] = ("src", "tgt"), normalize: bool = False,
                         hard_drop_english: bool = False) -> tuple[DataFrame, DataFrame]:
    """raw > clean/flag > split > written by split; with the stage counts (A1) of that job.

    The counts are observed while the jobs run that write: the cleaned rows once, which reads
    the input once, then the splits. Should executors have been lost, tasks that ran again are
    observed again; then the observed rows are more than the table's, and the counts are
    taken from the tables instead."""
    seen, clean, made = Observation("raw"), Observation("cleaned"), Observation("splits")
    curated = C.preprocess_pairs(raw.observe(seen, F.count(F.lit(1)).alias("raw")), normalize, hard_drop_english, cols)
    curated = IO.written(curated.observe(clean, F.count(F.lit(1)).alias("cleaned"), F.count_if("mostly_english").alias("flagged")),
                         "curated")
    splits = G.split_dataset(curated, key)
    names = ("train", "dev", "test")
    IO.save_splits(splits.observe(made, *[F.count_if(F.col("split") == n).alias(n) for n in names]), path)
    written = spark.read.schema(splits.schema).parquet(path)
    n = {**seen.get, **clean.get, **made.get}
    if not written.count() == n["cleaned"] == sum(n[s] for s in names):
        return written, M.stage_counts(raw, written)
    stages = [(s, n[s]) for s in ("raw", "cleaned", "flagged", *names) if s not in names or n[s]]
    return written, spark.createDataFrame(stages, "stage string, n bigint")


def curate_file(spark: SparkSession, raw_csv: str, out_dir: str, normalize: bool = False,
                avoid_equal_text: bool = False, multi_line: bool = True) -> dict[str, DataFrame]:
    """The curation entry from a path: the raw CSV of pairs > row keys > ``prepare_corpus``."""
    raw = IO.with_row_key(IO.load_raw(spark, raw_csv, multi_line=multi_line))
    return prepare_corpus(spark, IO.written(raw, "raw"), out_dir, normalize, avoid_equal_text)


def prepare_corpus(spark: SparkSession, raw: DataFrame, out_dir: str, normalize: bool = False,
                   avoid_equal_text: bool = False) -> dict[str, DataFrame]:
    """raw (pair_id, src, tgt) > clean/flag > split > write ``generation``;
    read it back > detection examples > write ``detection``.

    Both tables are partitioned by split, so a reader of one split prunes
    the others. Returns the written tables, the stage counts and the rows per split."""
    generation, counts = write_curated_splits(spark, raw.select("pair_id", "src", "tgt"), f"{out_dir}/generation",
                                              normalize=normalize)
    det_path = f"{out_dir}/detection"
    examples = P.build_detection_examples(generation, avoid_equal_text=avoid_equal_text)
    IO.save_splits(examples, det_path)
    detection = spark.read.parquet(det_path)
    stats = M.dataset_statistics(generation, detection)
    return {"generation": generation, "detection": detection, "counts": counts, "statistics": stats}


def evaluate_generation(spark: SparkSession, generation: DataFrame, out_dir: str) -> dict[str, DataFrame]:
    """Train the lexicon on the train split, generate for the test split,
    write per-sentence chrF once, then derive every report from that table."""
    train = generation.filter(F.col("split") == "train")
    lex = MD.train_lexicon(train.select(T.whitespace_tokens("src").alias("s"),
                                        T.whitespace_tokens("tgt").alias("t")), "s", "t")
    IO.write_result(lex, f"{out_dir}/lexicon")
    lex = spark.read.parquet(f"{out_dir}/lexicon")
    test = generation.filter(F.col("split") == "test").select("pair_id", "src", "tgt")
    generated = IO.written(MD.generate(test, "pair_id", lex, keep=["tgt"]), "generated")
    scored_in = generated.select("pair_id", F.col("generated").alias("hyp"), F.col("tgt").alias("ref"))
    IO.write_result(O.sentence_chrf(scored_in).join(generated, "pair_id"), f"{out_dir}/generation_scores")
    scores = spark.read.parquet(f"{out_dir}/generation_scores")
    return {
        "scores": scores,
        "corpus_chrf": O.corpus_chrf(scored_in),
        "corpus_bleu": O.corpus_bleu(scored_in),
        "mean_median": M.mean_and_median(scores, "chrf"),
    }


def evaluate_detection(spark: SparkSession, detection: DataFrame, out_dir: str) -> dict[str, DataFrame]:
    """Train the pair classifier on the train split and score the test split once, into a table
    bucketed by example; errors, report and counts are all read from that table and
    written beside it."""
    examples = detection.select("split", "example_id", "src", "tgt", "label")
    model = MD.TokenLogOdds.fit(examples.filter(F.col("split") == "train"))
    judged = MD.judged(model.score(examples.filter(F.col("split") == "test"), "example_id", ["label", "src", "tgt"]))
    predictions = IO.write_bucketed(
        judged.select("example_id", "src", "tgt", F.col("label").alias("gold"), "pred", "label_pred", "confidence"),
        f"{out_dir}/predictions", "example_id")
    names = {0: K.LABEL_INCORRECT, 1: K.LABEL_CORRECT}
    made = {
        "errors": predictions.filter(F.col("pred") != F.col("gold")).select(
            "example_id", "src", "tgt", T.label_name(F.col("gold")).alias("gold"),
            F.col("label_pred").alias("predicted"), "confidence"),
        "report": M.classification_report(predictions.select("gold", "pred"), class_names=names),
        "counts": M.binary_error_counts(predictions),
    }
    for name, df in made.items():
        IO.write_result(df, f"{out_dir}/{name}")
    return {"predictions": predictions, **{name: spark.read.parquet(f"{out_dir}/{name}") for name in made}}
