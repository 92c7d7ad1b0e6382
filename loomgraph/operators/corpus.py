"""From raw corpus records to classified examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import mark_entities, strip


def gold_mentions(raw: DataFrame) -> DataFrame:
    """One row of each gold mention whose three fields are not empty; records without a list have none."""
    x = raw.select("sentText", "articleId", "sentId", F.explode("relationMentions").alias("m"))
    x = x.select("sentText", "articleId", "sentId", strip(F.col("m.em1Text")).alias("head"), strip(F.col("m.em2Text")).alias("tail"), strip(F.col("m.label")).alias("relation"))
    return x.where((F.length("head") > 0) & (F.length("tail") > 0) & (F.length("relation") > 0))


def examples(raw: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """Marked examples with label ids; rows with an empty sentence, an unknown label or a name that the sentence lacks are dropped. labels: label, id."""
    g = gold_mentions(raw).where(F.length(strip(F.col("sentText"))) > 0)
    j = g.join(F.broadcast(labels.select(F.col("label").alias("relation"), F.col("id").alias("label_id"))), "relation")  # one row a label
    marked = j.withColumn("text", mark_entities(F.col("sentText"), F.col("head"), F.col("tail"))).where("text IS NOT NULL")
    return marked.select("text", "relation", "label_id", "head", "tail", F.lit(split).alias("split"), F.struct("sentId", "articleId").alias("meta"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "relation").agg(F.count(F.lit(1)).alias("count"))


def decoded(df: DataFrame, labels: DataFrame, pred: str = "pred_id", unknown: str = "__UNK_ID_{}__") -> DataFrame:
    """df with the label of an id; unknown ids are named after `unknown`."""
    a, b = unknown.split("{}")
    j = df.join(F.broadcast(labels.select(F.col("id").alias("__i"), F.col("label").alias("__l"))), F.col(pred) == F.col("__i"), "left")  # one row a label
    return j.withColumn("label", F.coalesce("__l", F.concat(F.lit(a), F.col(pred).cast("string"), F.lit(b)))).drop("__i", "__l")


def pruned(df: DataFrame, drop: tuple[str, ...] = ("text", "relation", "head", "tail", "meta")) -> DataFrame:
    """df without the columns that training has no use for, as far as it has them."""
    return df.drop(*[c for c in drop if c in df.columns])


def builtin_mentions(spark: SparkSession) -> DataFrame:
    """The mentions of a built-in sentence of our own, as pairs.text_between() takes them."""
    s = "Acme Mills in Riverton, and Weston near Brightwater Bank."
    names = [("Acme Mills", "ORG"), ("Riverton", "LOC"), ("Weston", "LOC"), ("Brightwater Bank", "ORG")]
    rows = [(0, 0, k, t, kind, s.index(t), s.index(t) + len(t), s) for k, (t, kind) in enumerate(names)]
    return spark.createDataFrame(rows, "doc_id long, sent_id int, ord int, text string, type string, start int, end int, sentence string")
