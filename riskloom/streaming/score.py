"""Scoring and dialogue chains on arriving files; the transforms are the batch ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.dialogue import dialogue_chunk
from riskloom.functions.formats import prediction_csv, prediction_json
from riskloom.functions.text import each, emoji_remove, text_normalize
from riskloom.operators.model import FeatureState
from riskloom.operators.scoring import literal_features, literals
from riskloom.plans.staging import new_stage_path


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that has arrived, append, and stop. The checkpoint makes a rerun exact."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def replay(
    spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Read a table, one file or a folder of part files, as a stream, transform, and return what was written.

    A stream reads folders; a table that is a single file is read as its folder's only match.
    """
    reader = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    stream = transform(reader.parquet(path))
    out = new_stage_path(spark, "stream")
    run_available(stream, out, out + "-checkpoint")
    return spark.read.schema(stream.schema).parquet(out)


def stream_score(
    requests: DataFrame, state: FeatureState, fills: dict[str, float], defaults: dict[str, float], predict, keep=("id",)
) -> DataFrame:
    """Map, fill, force numbers, predict and format records; stateless, so append mode holds no state."""
    df = literal_features(requests, state, fills, defaults)
    df = predict(df)
    raw = F.array(1.0 - F.col("score"), F.col("score"))
    return df.select(
        *keep, "score", prediction_json(raw, raw, 2).alias("json"), prediction_csv(raw, raw, 2).alias("csv")
    )


def stream_dialogue(rows: DataFrame, key: list[str], messages, max_tokens: int) -> DataFrame:
    """Messages to cleaned chunks, one row per chunk."""
    clean = each(lambda m: text_normalize(emoji_remove(m)))(messages)
    return rows.select(*key, F.posexplode(dialogue_chunk(clean, max_tokens)).alias("chunk_no", "chunk"))


__all__ = ["run_available", "replay", "stream_score", "literals", "stream_dialogue"]
