"""Stage C as a file stream: generated-dialogue JSON lines are parsed (T4), item tags are
replaced by titles (T8), the dialogues are formatted and rendered (T15, T3) and kept when
they carry a recommendation (F8), batch by batch.

The reference reads its inputs whole; this runner only lets the same operators run as
files land.  Each micro-batch is written to its own ``batch=<id>`` folder with overwrite,
so a batch replayed after a failure replaces its own output (idempotent sink), and the
stream's progress lives in ``checkpointLocation``.  The stratified split (P2) needs whole
strata and stays a batch step over the accumulated output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convrec import schemas
from convrec.functions.dialogue import parse_markers
from convrec.operators import dialogue as dl


def export_batch(batch: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The per-batch stage-C transformation (also usable on a static DataFrame)."""
    d = batch.withColumn("conv_id", F.sha2(F.concat_ws("\u0001", "response", "target_asin", "scenario"), 256))
    d = dl.non_empty(d.withColumn("conversation", parse_markers("response")))
    r = dl.with_target(dl.replace_ids_with_titles(d, dictionary))
    r = dl.render_dialogues(dl.format_dialogues(r))
    return dl.with_token(r).select("conv_id", "text", "target", "named_items", "scenario")


def start_export_stream(
    spark: SparkSession,
    source_dir: str,
    dictionary: DataFrame,
    sink_dir: str,
    checkpoint_location: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(schemas.GENERATED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.json(source_dir)

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        export_batch(batch_df, dictionary).write.mode("overwrite").json(f"{sink_dir.rstrip('/')}/batch={batch_id}")

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
