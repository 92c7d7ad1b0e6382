"""From gated triples to node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import bare, import_type, node_id, strip
from loomgraph.plans import rules
from loomgraph.plans.staging import staged

KINDS_UNKNOWN = ("", "UNK")


def edge_rows(df: DataFrame) -> DataFrame:
    """Rows with head, tail (source and target first, head and tail where those are empty) and relation; rows that lack one are dropped.

    conf without a value is 0; evidence is stripped, and empty without a value.
    """
    head = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.col("head")) if "source" in df.columns else F.col("head")
    tail = F.coalesce(F.nullif(F.col("target"), F.lit("")), F.col("tail")) if "target" in df.columns else F.col("tail")
    out = df.withColumns({"head": bare(head), "tail": bare(tail), "relation": bare(F.col("relation"))}).drop("source", "target")
    if "conf" in out.columns:
        out = out.withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    if "evidence" in out.columns:
        out = out.withColumn("evidence", bare(F.coalesce("evidence", F.lit(""))))
    return out.where((F.length("head") > 0) & (F.length("tail") > 0) & (F.length("relation") > 0))


def gate_direction(df: DataFrame) -> DataFrame:
    """df (head, head_type, tail, tail_type, relation) with action keep, flip or drop; flipped rows have their ends exchanged."""
    rule = F.broadcast(rules.direction_rules(df.sparkSession)).withColumnRenamed("relation", "__r")
    ht, tt = (F.upper(strip(F.coalesce(F.col(c), F.lit("")))) for c in ("head_type", "tail_type"))
    j = df.join(rule, F.col("relation") == F.col("__r"), "left")

    def fits(a: Column, b: Column) -> Column:
        return F.array_contains("head_types", a) & F.array_contains("tail_types", b)

    action = F.when(F.col("__r").isNull() | ht.isin(*KINDS_UNKNOWN) | tt.isin(*KINDS_UNKNOWN) | fits(ht, tt), "keep").when(F.col("allow_flip") & fits(tt, ht), "flip").otherwise("drop")
    j = j.withColumn("action", action)
    flip = F.col("action") == "flip"
    swapped = {a: F.when(flip, F.col(b)).otherwise(F.col(a)) for a, b in (("head", "tail"), ("tail", "head"), ("head_type", "tail_type"), ("tail_type", "head_type"))}
    return j.select(*[swapped.get(c, F.col(c)).alias(c) for c in df.columns], "action")


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"src_id": node_id(F.col("head_type"), F.col("head")), "dst_id": node_id(F.col("tail_type"), F.col("tail")), "rel_type": import_type(F.col("relation"))})


def aggregate_edges(df: DataFrame, evidence_cap: int = 0, min_support: int = 1) -> DataFrame:
    """One row an edge: support_count, conf_max, conf_mean, rel_raw (first by ord) and the first evidence_cap texts that aren't empty.

    Counts and means combine on the map side, in buffers of fixed width by (edge, relation); the few relations of an edge are then put together. Evidence
    is ranked first, so that no more than evidence_cap texts of an edge are gathered; df is then written once and read twice. A hash of the edge leads the
    keys: ids begin alike, so sorts would compare whole rows, and with it they rarely do.
    """
    keys = ["src_id", "rel_type", "dst_id"]
    if evidence_cap:
        df = staged(df.select(*keys, "relation", "conf", "ord", "evidence"), "edges")
    df, keys = df.withColumn("__h", F.xxhash64(*keys)), ["__h", *keys]
    each = df.groupBy(*keys, "relation").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf_max"), F.sum("conf").alias("total"), F.min("ord").alias("ord"))
    edges = each.groupBy(*keys).agg(F.sum("n").alias("support_count"), F.max("conf_max").alias("conf_max"), (F.sum("total") / F.sum("n")).alias("conf_mean"), F.min_by("relation", "ord").alias("rel_raw"))
    edges = edges.where(F.col("support_count") >= min_support)
    if not evidence_cap:
        return edges.drop("__h").withColumn("evidence", F.lit(""))
    w = Window.partitionBy(*keys).orderBy("ord")
    texts = df.where(F.length("evidence") > 0).select(*keys, "ord", "evidence").withColumn("k", F.row_number().over(w)).where(F.col("k") <= evidence_cap)
    texts = texts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence"))), lambda x: x["evidence"]), " || ").alias("evidence"))
    return edges.join(texts, keys, "left").drop("__h").withColumn("evidence", F.coalesce("evidence", F.lit("")))


def node_registry(df: DataFrame) -> DataFrame:
    """Nodes by id (type and name), of all rows, also those whose edges are filtered later; name and type as first seen by ord."""
    ends = df.select(F.col("src_id").alias("id"), F.col("head").alias("name"), F.col("head_type").alias("type"), (F.col("ord") * 2).alias("o"))
    ends = ends.unionByName(df.select(F.col("dst_id").alias("id"), F.col("tail").alias("name"), F.col("tail_type").alias("type"), (F.col("ord") * 2 + 1).alias("o")))
    kind = F.upper(strip(F.coalesce("type", F.lit(""))))
    first = F.min(F.struct("o", strip(F.col("name")).alias("name"), F.when(kind == "", "UNK").otherwise(kind).alias("type")))
    return ends.groupBy("id").agg(first.alias("x")).select("id", "x.name", "x.type")


def live_nodes(df: DataFrame, keep: str = "last") -> DataFrame:
    """Nodes by name alone. keep last: the type of the last write; first: of the first write that has one."""
    ends = df.select(F.col("head").alias("name"), F.col("head_type").alias("type"), (F.col("ord") * 2).alias("o")).unionByName(df.select(F.col("tail").alias("name"), F.col("tail_type").alias("type"), (F.col("ord") * 2 + 1).alias("o")))
    if keep == "last":
        return ends.groupBy("name").agg(F.max(F.struct("o", "type")).alias("x")).select("name", "x.type")
    return ends.groupBy("name").agg(F.min(F.when(F.col("type").isNotNull(), F.struct("o", "type"))).alias("x")).select("name", "x.type")


def live_edges(df: DataFrame, keep: str = "first") -> DataFrame:
    """One row of head, relation and tail: the first write's properties, or the last's."""
    pick = (F.min if keep == "first" else F.max)(F.struct("ord", "conf", "evidence"))
    return df.groupBy("head", "relation", "tail").agg(pick.alias("x")).select("head", "relation", "tail", "x.conf", "x.evidence")


def best_triples(df: DataFrame, fallback: str | None = rules.FALLBACK) -> DataFrame:
    """The best row of each (head, relation, tail): patterns before fallbacks, then confidence, then the first. One aggregate, without a sort of groups."""
    is_fb = F.col("pattern").startswith(fallback) if fallback else F.lit(False)
    rest = [c for c in df.columns if c not in ("head", "relation", "tail")]
    best = F.min(F.struct(is_fb.alias("__f"), (-F.col("conf")).alias("__c"), F.col("ord").alias("__o"), *rest))
    return df.groupBy("head", "relation", "tail").agg(best.alias("x")).select("head", "relation", "tail", *[F.col(f"x.{c}").alias(c) for c in rest])


def unique_names(nodes: DataFrame, name: str = "name") -> bool:
    """The uniqueness constraint: whether no name comes twice."""
    return nodes.groupBy(name).count().where("count > 1").isEmpty()
