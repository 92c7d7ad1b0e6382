"""A corpus pipeline: quality, near duplicates, decontamination, mixing and sharding, each stage over all that the one before kept.

Stages know the columns doc_id, text and source; all others pass through whatever their names, also names that an operator or a stage gives to
columns of its own. No stage changes a text, and an empty table gives an empty table of the same columns. Where the session has no setting of its own,
the stages set Arrow batches of ARROW_ROWS rows, for whole texts are wide rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Staged, fits, fold, marked, small, staged, table
from loomgraph.llm.decontamination import decontaminate
from loomgraph.llm.jaccard import classes
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.quality import CUT, score
from loomgraph.llm.sharding import shard

#: Least score of a document that stays; rows of an Arrow batch.
LEAST_SCORE, ARROW_ROWS = CUT, 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _wide_rows(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(ARROW_ROWS))


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator uses, and those names."""
    own = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def _back(docs: DataFrame, own: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(k).alias(c) for c, k in own.items()])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of all folds but one.

    Null and empty texts are scored as one chunk of padding, long ones whole; repeated rows score alike and stay or go together; a score of just
    LEAST_SCORE stays. A null doc_id has no label but is scored. With no labels the network is untrained.
    """
    _wide_rows(spark)
    rows, own = _apart(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(own["doc_id"]), "quality")
    scored = score(rows, labels, fold(F.col(own["doc_id"]), 4) != 2, text=own["text"], key=own["doc_id"], keep=tuple(own.values()))
    return _back(scored.where(F.col("score") >= LEAST_SCORE), own)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of n-gram Jaccard links: that of the smallest doc_id, of several the one with the smallest hash of its text.

    Rows without a doc_id come last. A row is told by its doc_id and text; rows that repeat both are dropped as copies. Documents without words
    (null, empty) have no links and stay. Texts of any length are compared whole.
    """
    _wide_rows(spark)
    rows, own = _apart(docs)
    text, key = F.col(own["text"]), F.col(own["doc_id"])
    kind = rows.schema[own["doc_id"]].dataType
    name = F.concat(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")))
    found = classes(rows.select(name.alias("name"), text.alias("text")), key="name")
    linked = Staged(found.where("n_shingles > 0").select("row_key", "label").distinct(), "linked")
    of_key = F.when(F.length("row_key") > 32, F.expr("substring(row_key, 34)").cast(kind))
    groups = linked.df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min_by("row_key", F.struct(of_key.isNull(), of_key, "row_key")).alias("first"))
    several = Staged(groups.where("n > 1").select("label", "first"), "several")  # groups of one row lose none
    gone = Staged(linked.df.join(small(several.df), "label").where("row_key <> first").select(F.col("row_key").alias("name")), "gone")
    rows = rows.withColumn("name", name)
    if fits(gone.df):
        rest = rows.join(F.broadcast(gone.df), "name", "left_anti").drop("name")
    else:  # only rows that may go are shuffled with their texts
        rows = marked(rows, "name", gone.df, "maybe")
        rest = rows.where("maybe").drop("maybe").join(gone.df, "name", "left_anti").drop("name").unionByName(rows.where("NOT maybe").drop("name", "maybe"))
    return _back(one_of_repeats(rest, own["doc_id"], own["text"]), own)


def one_of_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of rows that repeat key and text one; the rest as they are. Only rows of repeated keys are shuffled with their texts."""
    twice = Staged(docs.groupBy(F.col(key).alias("repeated")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("repeated"), "repeats").df
    if twice.isEmpty():
        return docs
    same = F.col(key).eqNullSafe(F.col("repeated"))
    again, alone = docs.join(small(twice), same, "left_semi"), docs.join(small(twice), same, "left_anti")
    return alone.unionByName(again.dropDuplicates([key, text]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark. Null and empty texts have none and stay; repeated rows are judged alike; texts are read whole."""
    _wide_rows(spark)
    rows, own = _apart(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), text=own["text"])
    return _back(found.where(~F.col("contaminated")), own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in their interleaved order: an exhausted source leaves the schedule, and no row is dropped.

    Rows without a source are a source of their own; null and repeated doc_ids and any text are rows like others.
    """
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    mixed = mix_sources(docs.select(row.alias("row"), "source", "doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc")), ties=(F.col("crc"),))
    return mixed.orderBy("position").select("row.*")


def in_order(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns of docs and place, from 0: the order in which the rows were written, by file and row. What is not just a table of files is written first.

    The driver gets one count a file.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = staged(docs, "in-order")
    written = docs.metadataColumn("_metadata")
    rows = docs.select(*columns, written["file_path"].alias("__file"), written["row_index"].alias("__row"))
    offsets, before = [], 0
    for r in sorted(rows.groupBy("__file").count().collect()):
        offsets.append((r["__file"], before))
        before += r["count"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(offsets, "__file string, __before long"))
    return rows.join(offsets, "__file").withColumn("place", F.col("__before") + F.col("__row")).drop("__file", "__before", "__row")


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; columns of these names (in any case) are replaced. Slots keep the order of the table, so each shard is
    mixed as the whole is.

    Null and repeated doc_ids are rows like others, told apart by their texts; null texts count as empty.
    """
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = in_order(docs, F.struct(*kept).alias("row"), F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("tie"))
    dealt = shard(rows.select("place", "doc_id", "tie"), ties=(F.col("tie"),), order="place").select("place", "shard", "slot")
    return rows.select("row", "place").join(dealt, "place").select("row.*", "shard", "slot")


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", deal)]
#: A trained network and links over hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
