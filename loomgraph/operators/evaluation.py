"""Reports over gold and predicted labels, thresholds, counts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_map(df: DataFrame, label: str = "relation") -> DataFrame:
    """Distinct labels in code-point order with ids from 0. The labels are few; ids come from one ordered window over them."""
    return df.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct().withColumn("id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Counts of (true_id, pred_id), also of ids that no label has; per_label() leaves those out, and overall() counts them in its total."""
    return df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("true_id"), F.col(pred).alias("pred_id")).agg(F.count(F.lit(1)).alias("count"))


def per_label(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of every label of labels (label, id), zero where undefined."""
    by = conf.select(F.col("true_id").alias("id"), F.col("count").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("true_id") == F.col("pred_id"), F.col("count")).otherwise(0).alias("tp"))
    by = by.unionByName(conf.select(F.col("pred_id").alias("id"), F.lit(0).cast("long").alias("t"), F.col("count").alias("p"), F.lit(0).cast("long").alias("tp")))
    by = by.groupBy("id").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    j = labels.join(F.broadcast(by), "id", "left").na.fill(0, ["t", "p", "tp"])  # one row a label
    p, r = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("t"))
    return j.select("id", "label", F.col("t").alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), F.col("tp"), F.col("p").alias("predicted"))


def inside(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of conf whose ids are both labels."""
    ids = F.broadcast(labels.select("id"))  # one row a label
    return conf.join(ids.withColumnRenamed("id", "true_id"), "true_id", "left_semi").join(ids.withColumnRenamed("id", "pred_id"), "pred_id", "left_semi").select("true_id", "pred_id", "count")


def out_of_range(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: total (all pairs), counted (both ids are labels), correct, accuracy (correct by total) and micro_f1 (of the counted ones)."""
    marked = inside(conf, labels).groupBy().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("counted"), F.coalesce(F.sum(F.when(F.col("true_id") == F.col("pred_id"), F.col("count"))), F.lit(0)).alias("correct"))
    j = conf.groupBy().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).join(marked, F.lit(True))  # one row each
    return j.select("total", "counted", "correct", ratio(F.col("correct"), F.col("total")).alias("accuracy"), ratio(F.col("correct"), F.col("counted")).alias("micro_f1"))


def averages(table: DataFrame) -> DataFrame:
    """Rows 'accuracy', 'macro avg' and 'weighted avg' of a report over per_label()'s table: precision, recall, f1, support. A micro average isn't one of them."""
    w = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    one = table.agg(F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("acc"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[w(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"), F.col("n").alias("support"))
    rows = F.array(row("accuracy", "acc", "acc", "acc"), row("macro avg", "m_precision", "m_recall", "m_f1"), row("weighted avg", "w_precision", "w_recall", "w_f1"))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def label_order(table: DataFrame) -> DataFrame:
    """per_label()'s table as it is listed: by support, id and label, all descending."""
    return table.orderBy(F.desc("support"), F.desc("id"), F.desc("label"))


def training_metrics(table: DataFrame, no_relation: str = "no_relation") -> DataFrame:
    """One row: metrics, a map of accuracy, micro_f1 and macro_f1, and of macro_f1_no_relation_excluded where a label of that name is there."""
    o = overall(table, no_relation)
    names = ("accuracy", "micro_f1", "macro_f1", "macro_f1_no_relation_excluded")
    return o.select(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)), lambda k, v: v.isNotNull()).alias("metrics"))


def label_universe(conf: DataFrame) -> DataFrame:
    """Every id that is a gold or a predicted one."""
    return conf.select(F.explode(F.array("true_id", "pred_id")).alias("id")).distinct()


def dense_matrix(conf: DataFrame, labels: DataFrame) -> DataFrame:
    """true_id, pred_id, count of every pair of labels, 0 included: a matrix as a long table."""
    ids = labels.select("id")
    every = ids.withColumnRenamed("id", "true_id").join(F.broadcast(ids.withColumnRenamed("id", "pred_id")), F.lit(True))  # labels by labels
    return every.join(F.broadcast(conf), ["true_id", "pred_id"], "left").select("true_id", "pred_id", F.coalesce("count", F.lit(0)).alias("count"))


def conf_stats(df: DataFrame, conf: str = "conf") -> DataFrame:
    """One row: conf_min, conf_mean and conf_max."""
    return df.agg(F.min(conf).alias("conf_min"), F.avg(conf).alias("conf_mean"), F.max(conf).alias("conf_max"))


def extreme_conf(df: DataFrame, n: int, order: str, highest: bool = False) -> DataFrame:
    """The n rows of the lowest confidence, or of the highest, with place, their place by ascending confidence; of equal ones the earlier counts as lower."""
    cols = [F.desc("conf"), F.desc(order)] if highest else [F.asc("conf"), F.asc(order)]
    top = df.orderBy(*cols).limit(n)
    return top.withColumn("place", (F.row_number().over(Window.orderBy("conf", order)) - 1).cast("int"))  # n rows


def overall(table: DataFrame, no_relation: str = "no_relation") -> DataFrame:
    """One row of samples, accuracy, micro_f1, macro_f1 (all labels), macro_f1_no_relation_excluded (null without such a label) and weighted_f1."""
    has = F.max(F.lower("label") == no_relation)
    rest = F.avg(F.when(F.lower("label") != no_relation, F.col("f1")))
    return table.agg(
        F.sum("support").alias("samples"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")).alias("micro_f1"),
        F.avg("f1").alias("macro_f1"), F.when(has, rest).alias("macro_f1_no_relation_excluded"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def top_confusions(conf: DataFrame, n: int, ties: str = "desc") -> DataFrame:
    """The n largest counts off the diagonal; ties by the largest ids (desc) or the smallest (asc)."""
    tie = [F.desc("true_id"), F.desc("pred_id")] if ties == "desc" else [F.asc("true_id"), F.asc("pred_id")]
    return conf.where(F.col("true_id") != F.col("pred_id")).orderBy(F.desc("count"), *tie).limit(n)


def class_weights(df: DataFrame, labels: DataFrame, gold: str = "gold", most: float = 20.0) -> DataFrame:
    """total / (classes * count), 0 for labels without rows, at most `most`."""
    counts = df.groupBy(F.col(gold).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = labels.join(counts, "id", "left").na.fill(0, ["n"])
    j = j.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1)))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # one row a label
    return j.select("id", "label", "n", F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(most), F.col("total") / (F.col("k") * F.col("n")))).alias("weight"))


def sample_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(sample_order(seed, key), key).limit(n)


def stride_sample(df: DataFrame, stride: int, most: int, order: str) -> DataFrame:
    """Every stride-th row by a dense order column from 0, at most `most`."""
    return df.where(F.col(order) % stride == 0).orderBy(order).limit(most)


def downsample(df: DataFrame, is_negative: Column, key: str, ratio_: float = 2.0, seed: int = 42) -> DataFrame:
    """All positives and int(ratio * positives) negatives of the smallest seeded hashes; everything if there are no positives or fewer negatives.

    The hash's prefix places negatives in 4096 ranges: their counts find the range of the cut, and only that range is ranked.
    """
    h = sample_order(seed, key)
    d = df.withColumn("__n", is_negative).withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy("__n", "__b").count().collect()  # 2 * 4096 rows at most
    positives = sum(r["count"] for r in counts if not r["__n"])
    want = int(ratio_ * positives)
    by = {r["__b"]: r["count"] for r in counts if r["__n"]}
    if not positives or sum(by.values()) <= want:
        return df
    taken, b = 0, 0
    while taken + by.get(b, 0) <= want:
        taken += by.get(b, 0)
        b += 1
    last = d.where(F.col("__n") & (F.col("__b") == b)).orderBy("__h", key).limit(want - taken)
    return d.where(~F.col("__n") | (F.col("__b") < b)).unionByName(last).drop("__n", "__h", "__b")


def relation_share(df: DataFrame, n: int = 15, relation: str = "relation") -> DataFrame:
    counts = df.groupBy(F.col(relation).alias("relation")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("count"), "relation").limit(n)  # one row a relation


def gap_stats(df: DataFrame, gap: Column) -> DataFrame:
    """Least, upper median (the value at place n div 2 from 0) and largest gap. The median is found by counts of distinct values, not by a list."""
    counts = df.select(gap.alias("g")).where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # ranges first, so that no one task orders all values
    lo_hi = counts.agg(F.min("g"), F.max("g"), F.sum("n")).first()
    if lo_hi[2] is None:
        return df.sparkSession.createDataFrame([], "gap_min double, gap_p50 double, gap_max double")
    lo, hi, n = lo_hi
    width = (hi - lo) / 4096 or 1.0
    bucket = F.least(F.floor((F.col("g") - lo) / width), F.lit(4095))
    sizes = {r["b"]: r["n"] for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}  # 4096 rows at most
    seen, b = 0, 0
    while seen + sizes.get(b, 0) <= n // 2:
        seen += sizes.get(b, 0)
        b += 1
    inside = counts.where(bucket == b).withColumn("c", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("g")))
    return inside.where(F.col("c") > n // 2 - seen).agg(F.lit(float(lo)).alias("gap_min"), F.min("g").alias("gap_p50"), F.lit(float(hi)).alias("gap_max"))


def first_rejections(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows of each reject reason; the rank filter is pushed below the sort's exchange."""
    w = Window.partitionBy("reason").orderBy(order)
    return df.where("decision = 'reject'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def grid() -> list[float]:
    """Thresholds from 0 in steps of 0.005, added up one by one as they were when thresholds were fitted."""
    out, t = [], 0.0
    while t <= 1.0 + 1e-9:
        out.append(t)
        t += 0.005
    return out


def fit_grid(df: DataFrame, no_relation: str = "no_relation", least: int = 50) -> DataFrame:
    """Per predicted label (gold, pred, conf) the grid threshold of the best F1; ties within 1e-9 by precision, then the smallest.

    Predictions are first counted by (label, grid step), so what crosses the grid is at most 201 rows a label, whatever the input.
    """
    spark, points = df.sparkSession, grid()
    steps = F.array(*[F.lit(x) for x in points])
    slot = F.size(F.filter(steps, lambda t: t <= F.col("conf"))) - 1  # the last threshold that the row still passes
    rows = df.where(F.lower("pred") != no_relation).select("pred", (F.col("gold") == F.col("pred")).alias("ok"), slot.alias("k"))
    counts = rows.groupBy("pred", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("tp"))
    golds = df.groupBy(F.col("gold").alias("pred")).agg(F.count(F.lit(1)).alias("gold_n"))
    labels = counts.groupBy("pred").agg(F.sum("n").alias("all_n")).where(F.col("all_n") >= least).join(golds, "pred", "left").na.fill(0, ["gold_n"])
    every = labels.crossJoin(F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(points)], "k int, threshold double")))  # 201 rows a label
    w = Window.partitionBy("pred").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    j = every.join(counts, ["pred", "k"], "left").na.fill(0, ["n", "tp"]).withColumn("kept", F.sum("n").over(w)).withColumn("tpc", F.sum("tp").over(w))
    p, r = ratio(F.col("tpc"), F.col("kept")), ratio(F.col("tpc"), F.col("gold_n"))
    j = j.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = F.min(F.struct((-F.round("f1", 9)).alias("f"), (-F.col("precision")).alias("p"), F.col("threshold").alias("threshold"), "precision", "recall", "f1"))
    out = j.groupBy("pred").agg(best.alias("x"))
    return out.select(F.col("pred").alias("relation"), *[F.round(f"x.{c}", 6).alias(c) for c in ("threshold", "precision", "recall", "f1")])


def fit_observed(df: DataFrame, min_margin: float = 0.0, metric: str = "f1", target: float = 0.95, no_relation: str = "no_relation") -> DataFrame:
    """Per predicted label the observed confidence (or 0 or 1) that is best as a threshold, by one cumulative pass over distinct confidences.

    f1: the largest F1, or recall: the largest recall of a precision of `target` at least; the smallest threshold wins ties; 1.0 and null figures if
    none qualifies. Rows whose margin is below min_margin are not accepted, whatever their confidence; a null margin passes.
    """
    wide = F.coalesce("margin", F.lit(float("inf"))) >= min_margin
    rows = df.where(F.col("pred") != no_relation).select("pred", "conf", wide.alias("wide"), (F.col("gold") == F.col("pred")).alias("ok"))
    counts = rows.groupBy("pred", "conf").agg(F.count_if("wide").alias("n"), F.count_if(F.col("wide") & F.col("ok")).alias("tp"))
    golds = df.groupBy(F.col("gold").alias("pred")).agg(F.count(F.lit(1)).alias("gold_n"))
    ends = counts.select("pred").distinct().select("pred", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("conf"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("tp"))
    points = counts.unionByName(ends).groupBy("pred", "conf").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    w = Window.partitionBy("pred").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    c = points.withColumn("kept", F.sum("n").over(w)).withColumn("tpc", F.sum("tp").over(w)).join(golds, "pred", "left").na.fill(0, ["gold_n"])
    c = c.withColumns({"precision": ratio(F.col("tpc"), F.col("kept")), "recall": ratio(F.col("tpc"), F.col("gold_n"))})
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    value = F.col("f1") if metric == "f1" else F.when(F.col("precision") >= target - 1e-12, F.col("recall"))
    c = c.withColumn("v", value)
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("v")).alias("v"), F.col("conf").alias("threshold"), F.col("tpc").alias("tp"), (F.col("kept") - F.col("tpc")).alias("fp"), (F.col("gold_n") - F.col("tpc")).alias("fn"), "precision", "recall", "f1")))
    out = c.groupBy("pred").agg(best.alias("x"))
    return out.select(F.col("pred").alias("relation"), F.coalesce(F.round("x.threshold", 6), F.lit(1.0)).alias("threshold"), "x.tp", "x.fp", "x.fn", *[F.round(f"x.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def label_keys(df: DataFrame, json: str, most: int = 2000, order: str = "ord") -> DataFrame:
    """Of key_frequency()'s keys those that look like a label's: they name a label, a relation or a predicate."""
    return key_frequency(df, json, most, order).where(F.lower("key").rlike("label|rel|predicate"))


def key_frequency(df: DataFrame, json: str, most: int = 2000, order: str = "ord") -> DataFrame:
    """How often each top-level key comes in the first `most` records."""
    head = df.orderBy(order).limit(most)
    return head.select(F.explode(F.json_object_keys(json)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count"))
