"""Readers and writers: JSON lines, detected JSON, label maps, thresholds, CSV, reports and graph tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.plans.staging import remove

CORPUS = "sentText string, articleId string, sentId string, relationMentions array<struct<em1Text:string,em2Text:string,label:string>>"
CONTAINERS = ("data", "examples", "records", "items", "sentences")


#: Where a row stands: its file, the first byte of its split and its number there.
PLACE = ("__file", "__split", "__row")


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """Lines of JSON; blank lines are skipped and a bad one fails the read. limit: only so many rows, the first by file and line."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not limit:
        return df
    return placed(df).orderBy(*PLACE).limit(limit).drop(*PLACE)


def placed(df: DataFrame) -> DataFrame:
    """df of a file source with the columns of PLACE, by which rows sort as in their files."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines count) and text of each line that isn't JSON. Lines before a bad one are counted by split, so no file is read as a whole."""
    lines = placed(spark.read.text(path))
    splits = lines.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumn("before", before).select("__file", "__split", "first", "before")  # one row a split
    bad = lines.where((F.length(F.trim("value")) > 0) & F.try_parse_json("value").isNull())
    j = bad.join(starts, ["__file", "__split"])
    return j.select(F.col("__file").alias("file"), (F.col("before") + F.col("__row") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_jsonl_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, but a bad line fails at once, with ValueError, its number and the start of its text."""
    worst = bad_lines(spark, path).orderBy("file", "line").first()
    if worst is not None:
        raise ValueError(f"bad JSON on line {worst['line']} of {worst['file']}: {worst['text'][:200]}")
    return read_jsonl(spark, path, schema)


def read_detected(spark: SparkSession, path: str) -> DataFrame:
    """record (variant) of a file that holds JSON lines, a list, an object with a list under a usual name, or an object of objects; else ValueError."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.try_parse_json("value").alias("record"))
    n = lines.agg(F.count(F.lit(1)).alias("n"), F.count("record").alias("good")).first()
    if n["n"] > 1 and n["good"] == n["n"]:
        return lines
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = whole.select(F.schema_of_variant("v").alias("s"), F.expr("try_variant_get(v, '$', 'map<string, variant>')").alias("m")).first()
    if kind is None or kind["s"] is None:
        raise ValueError(f"{path}: neither records nor lines of JSON")
    if kind["s"].startswith("ARRAY"):
        return whole.select(F.explode(F.expr("variant_get(v, '$', 'array<variant>')")).alias("record"))
    keys = kind["m"] or {}
    for name in CONTAINERS:
        if name in keys and whole.select(F.expr(f"schema_of_variant(variant_get(v, '$.{name}', 'variant'))")).first()[0].startswith("ARRAY"):
            return whole.select(F.explode(F.expr(f"variant_get(v, '$.{name}', 'array<variant>')")).alias("record"))
    kinds = whole.select(F.explode(F.expr("variant_get(v, '$', 'map<string, variant>')")).alias("k", "record"))
    if keys and kinds.where(~F.schema_of_variant("record").startswith("OBJECT")).isEmpty():
        return kinds.select("record")
    if kind["s"].startswith("OBJECT"):
        return whole.select(F.col("v").alias("record"))
    raise ValueError(f"{path}: neither records nor lines of JSON")


def read_json_object(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # configuration files are small


def no_relation_id(labels: DataFrame, name: str = "no_relation") -> int | None:
    """The id of the label of that name, else of one that differs in case only; None without one."""
    rows = labels.where(F.lower("label") == name.lower()).collect()  # one row a label
    return min(((r["label"] != name, r["id"]) for r in rows), default=(True, None))[1]


def read_label_map(spark: SparkSession, *paths: str) -> DataFrame:
    """label, id of the first of these files that is there: label to id, id to label, or a model's configuration with label2id and id2label (of equal
    size, else the next file counts)."""
    for path in paths:
        try:
            got = read_json_object(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        if "label2id" in got or "id2label" in got:
            a, b = got.get("label2id"), got.get("id2label")
            ids = {k for k in b if str(k).lstrip("-").isdigit()} if isinstance(b, dict) else set()
            if not isinstance(a, dict) or not a or len(ids) != len(a):
                continue
            got = a
        rows = [(v, int(k)) if isinstance(v, str) else (k, int(v)) for k, v in got.items()]
        return spark.createDataFrame(rows, "label string, id int")
    raise FileNotFoundError(f"no label map at {', '.join(paths)}")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """relation, threshold of a flat object or one under "thresholds"; values that are no numbers are skipped, 0 is kept."""
    got = read_json_object(spark, path)
    got = got["thresholds"] if isinstance(got.get("thresholds"), dict) else got
    rows = [(k, float(v)) for k, v in got.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "relation string, threshold double")


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    out = None
    for split, path in paths.items():
        df = read_jsonl(spark, path, schema).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def text_source(spark: SparkSession, text: str | None = None, path: str | None = None, default: str | None = None) -> DataFrame:
    """doc_id, text: of a given text, of the files below a path, or of a built-in paragraph; ValueError without any. Texts are stripped."""
    if path:
        files = read_texts(spark, path)
        return files.select(F.xxhash64("file").alias("doc_id"), strip(F.col("text")).alias("text"))
    if not (text or default):
        raise ValueError("give a text or the path of one")
    return spark.createDataFrame([(0, text or default)], "doc_id long, text string").withColumn("text", strip(F.col("text")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Lines of JSON with null keys kept; files follow the partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(df: DataFrame, path: str, **settings: object) -> dict:
    """One row of counters and the settings as a JSON object; also returned."""
    out = settings | df.first().asDict(recursive=True)
    df.sparkSession.createDataFrame([(json.dumps(out, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges below path as CSV, confidences with six digits. Overwrites its own folders only."""
    nodes.select("id", "name", "type").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/nodes")
    conf = [F.format_string("%.6f", c).alias(c) for c in ("conf_max", "conf_mean")]
    edges.select("src_id", "dst_id", "rel_type", "rel_raw", "support_count", *conf, "evidence").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/edges")


def wipe(spark: SparkSession, path: str) -> None:
    """Removes a graph that write_graph() has written: its own two folders below path and nothing else."""
    remove(spark, f"{path}/nodes")
    remove(spark, f"{path}/edges")


def write_report(path: str, metrics: DataFrame, labels: DataFrame, confusions: DataFrame, thresholds: DataFrame | None = None) -> None:
    write_summary(metrics, f"{path}/metrics.json")
    write_csv(labels, f"{path}/per_label")
    write_csv(confusions, f"{path}/confusions")
    if thresholds is not None:
        write_csv(thresholds, f"{path}/thresholds")


def listed(edges: DataFrame, least: float = 0.0, n: int = 50) -> list[str]:
    """The first n edges of a confidence of at least `least` (none counts as 1) as lines for a console."""
    rows = edges.where(F.coalesce("conf", F.lit(1.0)) >= least).limit(n).collect()
    return [f"({r['head']}) -[{r['relation']}]-> ({r['tail']})" + ("" if r["conf"] is None else f"  {r['conf']:.3f}") for r in rows]
