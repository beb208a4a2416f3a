"""Detection and redaction of arriving texts.

Row-wise operators run on a stream as they are; the mapping of a project only grows, so each micro-batch appends to it and redacts with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators import detect, mapping, redact
from veilspark.operators.rules import RULES


def detected_stream(texts: DataFrame, text: str) -> DataFrame:
    """The columns of a stream with kind and original of each value in its text."""
    rest = [c for c in texts.columns if c != text]
    found = F.flatten(F.array(*[_tagged(text, r) for r in RULES]))
    return texts.select(*rest, F.inline(found))


def _tagged(text: str, rule):
    return F.transform(detect.matches(F.col(text), rule), lambda x: F.struct(F.lit(rule.kind).alias("kind"), x.alias("original")))


def hits_per_window(detected: DataFrame, time: str, lateness: str = "7 days", window: str = "1 day") -> DataFrame:
    """Values by kind and window of event time; rows later than the watermark allows are left out by the stream, as defined there."""
    return detected.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def redact_stream(texts: DataFrame, store: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Redacts a stream of (project_id, doc_id, text): each micro-batch first appends its new values to the mapping in ``store``.

    The mapping is written under the batch's number before the texts are, so a batch that is run again finds and rewrites its own part."""

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fields = "project_id string, ord int, candidate_id string, kind string, original string, placeholder string, replacement string, strategy string, default_strategy string, preservation_value string, epoch long"
        before = _stored(spark, store, fields).filter(F.col("epoch") < epoch).drop("epoch")
        entities = detect.ordered(detect.detect(batch, ["project_id"], "doc_id", "text"), ["project_id"])
        nobody = spark.createDataFrame([], "project_id string, candidate_id string, action string, strategy string")
        merged = mapping.merge_mapping(before, entities, nobody)
        merged.filter("added").drop("added").write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        now = _stored(spark, store, fields).filter(F.col("epoch") <= epoch)
        redact.redact(batch, now, "project_id", "doc_id", "text").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def _stored(spark: SparkSession, store: str, fields: str) -> DataFrame:
    """What is stored so far. Only a missing folder means nothing; any other failure must rise, as numbering would begin again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(store)
