"""Structured Streaming jobs (ST1-ST3).

Each stream applies the *same* DataFrame functions as the batch queries.
Requests are answered within the row while the lexicon is small enough to be
broadcast, as a stateless append; beyond that a join and a regroup run per micro-batch
in ``foreachBatch``. The only state is ST3's de-duplication and daily windows,
bounded by a watermark. Sinks and checkpoints live under caller-given (shared) paths.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions import text as T
from parallax.operators import curate as C
from parallax.operators import feedback as FB
from parallax.operators import models as MD
from parallax.sources.io import written

LEXICON_BYTES = 64 << 20  # what a broadcast lexicon may take in a worker

def write_batch(batch: DataFrame, out_dir: str, batch_id: int, *partitions: str) -> None:
    """A micro-batch into its own ``batch_id=`` folder, in place of what an earlier try left there."""
    batch.write.mode("overwrite").partitionBy(*partitions).parquet(f"{out_dir}/batch_id={batch_id}")


# ST1 -------------------------------------------------------------------------

def prepare_requests(requests: DataFrame, text_col: str = "slang") -> DataFrame:
    """Stateless part: validate (F9), clean (T6), build the prompt."""
    v = C.validate_request(requests, text_col)
    return (v.withColumn("clean", T.clean_text(F.col("slang_clean")))
             .withColumn("prompt", T.generation_prompt("clean", quoted=True)))


def answer_requests(prepared: DataFrame, key: str, lexicon: DataFrame,
                    lexicon_bytes: int = LEXICON_BYTES) -> DataFrame:
    """Score valid requests (M2) and keep errors as a column: one output row
    per request with ``formal`` or ``error``."""
    shared = shared_lexicon(lexicon, lexicon_bytes)
    if shared is not None:
        return answer_in_row(prepared, key, shared)
    # errors ride along as rows without tokens: one regroup by key, no join back
    rows = prepared.select(key, F.when(F.col("error").isNull(), F.col("clean")).alias("src"), "error")
    gen = MD.generate(rows, key, lexicon, "src", "formal", keep=["error"])
    return gen.select(key, F.when(F.col("error").isNull(), F.col("formal")).alias("formal"), "error")


def shared_lexicon(lexicon: DataFrame, most_bytes: int = LEXICON_BYTES):
    """The lexicon as a broadcast (s > t) if its words take at most ``most_bytes``, else None."""
    words = lexicon.where(F.col("s").isNotNull()).select("s", "t")
    words = written(words, "lexicon")
    size = words.agg(F.sum(F.octet_length("s") + F.octet_length(F.coalesce("t", "s")) + 128)).first()[0] or 0
    if size > most_bytes:
        return None
    return lexicon.sparkSession.sparkContext.broadcast({r["s"]: r["t"] for r in words.collect() if r["t"] is not None})


ROWS_AT_ONCE = 256  # requests whose words a worker looks up at a time


def answer_in_row(prepared: DataFrame, key: str, shared) -> DataFrame:
    """Each request answered on its own, without a shuffle: what a stateless stream can append."""
    rows = prepared.select(key, "error", F.when(F.col("error").isNull(), F.col("clean")).alias("src"),
                           F.when(F.col("error").isNull(), T.whitespace_tokens("clean")).alias("tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def translated(batches):
        words = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield part.set_column(3, "said", said_by(words, part.column(3)))

    out = rows.mapInArrow(translated, f"`{key}` {kinds[key]}, error string, src string, said string")
    # the prompt is made again here: a text goes to the worker once
    prompted = out.withColumn("prompt", T.generation_prompt("src", quoted=True))
    formal = T.postprocess_completion(F.concat("prompt", "said"), F.col("prompt"))
    return prompted.select(key, F.when(F.col("error").isNull(), formal).alias("formal"), "error")


def said_by(words: dict[str, str], tokens: pa.ListArray) -> pa.Array:
    """Token lists > texts of their translations (unknown words copied). Only distinct words
    become Python objects; the rest stays in Arrow's buffers."""
    coded = tokens.flatten().dictionary_encode()
    known = pa.array([words.get(w, w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(tokens), 0)
    ends = pc.cumulative_sum(sizes.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    made = pc.binary_join(pa.ListArray.from_arrays(offsets, known.take(coded.indices)), " ")
    return pc.if_else(tokens.is_valid(), made, pa.scalar(None, pa.string()))


def start_request_stream(spark: SparkSession, source_dir: str, schema, key: str, lexicon: DataFrame,
                         out_dir: str, checkpoint: str, available_now: bool = True,
                         max_files_per_trigger: int | None = None, lexicon_bytes: int = LEXICON_BYTES):
    """Requests to answers: a stateless append while the lexicon can be broadcast, else per micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    prepared = prepare_requests(reader.parquet(source_dir))
    shared = shared_lexicon(lexicon, lexicon_bytes)
    if shared is not None:
        w = answer_in_row(prepared, key, shared).writeStream.outputMode("append").format("parquet").option("path", out_dir)
    else:
        def score_batch(batch: DataFrame, batch_id: int) -> None:
            write_batch(answer_requests(batch, key, lexicon, lexicon_bytes), out_dir, batch_id)

        w = prepared.writeStream.foreachBatch(score_batch)
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


# ST2 -------------------------------------------------------------------------

def start_feedback_router(spark: SparkSession, source_dir: str, schema, out_dir: str,
                          checkpoint: str, max_files_per_trigger: int = 1):
    """Validate (F8) and route each micro-batch to high_quality / corrections
    / quarantine (/ other) folders under ``out_dir``."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    routed = FB.route(FB.with_event_time(stream))

    def write_routes(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, out_dir, batch_id, "route")

    return (routed.writeStream.foreachBatch(write_routes).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ST3 -------------------------------------------------------------------------

def daily_stats_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Drop duplicate submissions (same content, same UTC day) and rows whose
    day is older than the watermark; daily count, mean rating and incorrect
    rate. Append mode: a day is emitted once the watermark passes it, and the
    dedup state of a day is dropped then too."""
    s = FB.with_day(FB.with_event_time(stream)).withWatermark("day", watermark)
    return FB.daily_feedback_stats(FB.dedup_daily(s))


def start_daily_stats(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint: str,
                      watermark: str = "1 day", max_files_per_trigger: int = 1):
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    return (daily_stats_stream(stream, watermark).writeStream.outputMode("append").format("parquet")
            .option("path", out_dir).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
