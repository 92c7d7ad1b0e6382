"""From logits to decisions: probabilities, top-k, margins and the gates with their reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomgraph.functions.text import is_no_relation, strip
from loomgraph.plans import rules


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities; a temperature of 0 or 1 changes nothing."""
    t = temperature if temperature not in (0, 1) else 1.0
    shifted = bound(F.struct(logits.alias("z"), F.array_max(logits).alias("top")), lambda s: F.transform(s["z"], lambda x: F.exp((x - s["top"]) / t)))
    return bound(shifted, lambda e: bound(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("sum")), lambda s: F.transform(s["e"], lambda x: x / s["sum"])))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def top_k(probs: Column, k: int) -> Column:
    """(id, prob) of the k largest; equal ones by id."""
    ranked = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("n"), i.alias("id"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["id"].cast("int").alias("id"), (-s["n"]).alias("prob")))


def predicted(df: DataFrame, logits: str = "logits", k: int = 5, temperature: float = 1.0) -> DataFrame:
    """df with probs, topk, pred_id, conf and margin (null with fewer than two classes)."""
    out = df.withColumn("probs", softmax(F.col(logits), temperature)).withColumn("topk", top_k(F.col("probs"), max(k, 2)))
    out = out.withColumns({"pred_id": F.col("topk")[0]["id"], "conf": F.col("topk")[0]["prob"], "margin": F.when(F.size("topk") > 1, F.col("topk")[0]["prob"] - F.col("topk")[1]["prob"])})
    return out.withColumn("topk", F.slice("topk", 1, k))


def score(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """df with logits of `text`. scorer makes the model once a worker; it maps texts to a matrix. Distinct filters belong before this step."""
    schema = StructType([*df.schema.fields, StructField("logits", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        for batch in batches:
            logits = model(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(logits, float).tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "logits"])

    return df.mapInArrow(run, schema)


def score_distinct(df: DataFrame, keys: list[str], text: Column, scorer) -> DataFrame:
    """As score, but each distinct text is scored once and joined back: the verifier's cache."""
    asked = df.withColumn("__text", text)
    scored = score(asked.select("__text").distinct(), "__text", scorer)
    return asked.join(scored, "__text").drop("__text")


class CentroidScorer:
    """An offline stand-in for a trained classifier: hashed character trigrams times one fixed random direction a label."""

    def __init__(self, labels: int, dim: int = 512, seed: int = 42):
        self.w = np.random.default_rng(seed).normal(size=(dim, labels))
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        low = [(t or "").lower().encode() for t in texts]
        raw = np.frombuffer(b"".join(low), np.uint8).astype(np.int32)
        row = np.repeat(np.arange(len(low)), [len(b) for b in low])
        x = np.zeros(len(low) * self.dim)
        if len(raw) > 2:
            whole = row[:-2] == row[2:]  # trigrams of one text
            hashed = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) % self.dim
            x = np.bincount(row[:-2][whole] * self.dim + hashed[whole], minlength=len(x)).astype(float)
        x = x.reshape(len(low), self.dim)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n) @ self.w


def accepts(conf: Column, top2: Column, threshold: float = 0.8, min_conf: float = 0.5, margin: float = 0.15) -> Column:
    """Whether a prediction is kept: sure, or fairly sure and clear of the runner-up (null: there is none)."""
    return (conf >= threshold) | ((conf >= min_conf) & (top2.isNull() | (conf - top2 >= margin)))


def export_reason(df: DataFrame, drop_labels: list[str] = (), strict: bool = False, enforce: bool = True, threshold: float = 0.8, min_conf: float = 0.5, margin: float = 0.15) -> DataFrame:
    """df (relation, conf, top2, head_type, tail_type) with reason: the first gate of the export that rejects a row, or kept. Reasons are disjoint."""
    rule = F.broadcast(rules.export_rules(df.sparkSession)).withColumnRenamed("relation", "__r").withColumnRenamed("min_conf", "__m")
    j = df.join(rule, F.col("relation") == F.col("__r"), "left")
    none = F.col("__r").isNull()
    typed = (F.length("head_type") > 0) & (F.length("tail_type") > 0)
    fits = F.array_contains("head_types", F.col("head_type")) & F.array_contains("tail_types", F.col("tail_type"))
    reason = F.when(F.col("relation").isin(list(drop_labels)) if drop_labels else F.lit(False), "dropped_label")
    if enforce:
        reason = reason.when(none & F.lit(strict), "dropped_no_rule").when(~none & (F.col("conf") < F.col("__m")), "dropped_rule_conf").when(~none & typed & ~fits, "dropped_type")
    reason = reason.when(~accepts(F.col("conf"), F.col("top2"), threshold, min_conf, margin), "dropped_conf").otherwise("kept")
    return j.withColumn("reason", reason).select(*df.columns, "reason")


def schema_ok(df: DataFrame) -> DataFrame:
    """df with schema_ok: relations without signatures pass, others need theirs."""
    sigs = rules.signatures(df.sparkSession).groupBy("relation").agg(F.collect_set(F.concat_ws(">", "head_type", "tail_type")).alias("__s")).withColumnRenamed("relation", "__r")
    j = df.join(F.broadcast(sigs), F.col("relation") == F.col("__r"), "left")  # one row a relation of the rules
    return j.withColumn("schema_ok", F.col("__s").isNull() | F.array_contains("__s", F.concat_ws(">", "head_type", "tail_type"))).drop("__s", "__r")


def trigger_ok(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """df with trigger_ok (no triggers, or one is part of the sentence in lower case) and needs_trigger."""
    t = F.broadcast(rules.triggers(df.sparkSession)).withColumnRenamed("relation", "__r")
    j = df.join(t, F.col("relation") == F.col("__r"), "left")
    low = F.lower(F.col(sentence))
    return j.withColumn("trigger_ok", F.coalesce(F.exists("triggers", lambda x: F.contains(low, x)), F.lit(True))).withColumn("needs_trigger", F.coalesce("needs_trigger", F.lit(False))).drop("triggers", "__r")


def gated(df: DataFrame, thresholds: DataFrame | None = None, default: float = 0.9, min_margin: float = 0.15, explicit_only: bool = False, verifier: str | None = None, least_entailment: float = 0.8, entailments: DataFrame | None = None, no_relation: str = "no_relation") -> DataFrame:
    """df (pattern, marked, relation, conf, margin, head_type, tail_type, sentence) with decision and reason.

    Gates in order; the first that rejects gives the reason: explicit_only, mark_failed, no_relation, schema, conf_threshold, margin, trigger,
    verifier. verifier names a column with entailments of survivors, of which null is not asked; entailments (relation, threshold) has what a relation
    asks for, others ask least_entailment. One pass; rules are broadcast. verify() asks a verifier about the rows that get here only.
    """
    thr = (rules.thresholds(df.sparkSession) if thresholds is None else thresholds).withColumnsRenamed({"relation": "__tr", "threshold": "__thr"})
    j = trigger_ok(schema_ok(df)).join(F.broadcast(thr), F.col("relation") == F.col("__tr"), "left")  # one row a relation
    is_fb = F.col("pattern").startswith(rules.FALLBACK)
    need = F.coalesce("__thr", F.lit(default))
    need = F.when(is_fb, F.least(F.lit(rules.FALLBACK_MOST), need + rules.FALLBACK_EXTRA)).otherwise(need)
    reason = (
        F.when(F.lit(explicit_only) & (is_fb | F.contains("pattern", F.lit("+P8"))), "explicit_only")
        .when(F.coalesce(F.length("marked"), F.lit(0)) == 0, "mark_failed")
        .when(F.lower("relation") == no_relation, "no_relation")
        .when(~F.col("schema_ok"), "schema")
        .when(F.col("conf") < need, "conf_threshold")
        .when(F.col("margin").isNotNull() & (F.col("margin") < min_margin), "margin")
        .when(F.col("needs_trigger") & ~F.col("trigger_ok"), "trigger")
    )
    if verifier:
        j, least = least_entailments(j, entailments, least_entailment)
        reason = reason.when(F.col(verifier) < least, "verifier")
    out = j.withColumn("reason", reason.otherwise("accept")).withColumn("decision", F.when(F.col("reason") == "accept", "accept").otherwise("reject"))
    return out.select(*df.columns, "decision", "reason")


def least_entailments(df: DataFrame, entailments: DataFrame | None, default: float) -> tuple[DataFrame, Column]:
    """df with the entailment that its relation asks for, and that column."""
    if entailments is None:
        return df, F.lit(default)
    e = entailments.withColumnsRenamed({"relation": "__er", "threshold": "__least"})
    return df.join(F.broadcast(e), F.col("relation") == F.col("__er"), "left"), F.coalesce("__least", F.lit(default))  # one row a relation


def verify(gates: DataFrame, scorer, entailment_id: int = 2, entailments: DataFrame | None = None, least_entailment: float = 0.8, temperature: float = 1.0) -> DataFrame:
    """gates (of gated(), with head, tail and sentence) with entailment, and decision and reason after the verifier.

    Only rows that all other gates accept are asked, each pair of premise and hypothesis once; entailment is null for the rest.
    """
    kept = gates.columns
    asked = hypothesis(gates.where("decision = 'accept'")).withColumn("__ask", F.struct(strip(F.col("sentence")).alias("premise"), strip(F.col("hypothesis")).alias("hypothesis")))
    texts = asked.select(F.concat_ws("\n", "__ask.premise", "__ask.hypothesis").alias("__text")).distinct()
    said = score(texts, "__text", scorer).select("__text", softmax(F.col("logits"), temperature)[entailment_id].alias("entailment"))
    asked = asked.withColumn("__text", F.concat_ws("\n", "__ask.premise", "__ask.hypothesis")).join(said, "__text")
    asked, least = least_entailments(asked, entailments, least_entailment)
    fails = F.col("entailment") < least
    asked = asked.withColumn("reason", F.when(fails, "verifier").otherwise("accept")).withColumn("decision", F.when(fails, "reject").otherwise("accept"))
    rest = gates.where("decision <> 'accept'").withColumn("entailment", F.lit(None).cast("double"))
    return asked.select(*kept, "entailment").unionByName(rest)


def clear(conf: Column, top2: Column, min_conf: float = 0.5, margin: float = 0.15) -> Column:
    """Whether a prediction is sure enough and clear of the runner-up; without one the runner-up has 0."""
    return (conf >= min_conf) & (conf - F.coalesce(top2, F.lit(0.0)) >= margin)


def shown(df: DataFrame, hide_no_relation: bool = True, min_conf: float = 0.0) -> DataFrame:
    """Predictions (relation, conf) that are listed: none of no relation, if those are hidden, and none below min_conf."""
    sure = df.where(F.col("conf") >= min_conf)
    return sure.where(~is_no_relation(F.col("relation"))) if hide_no_relation else sure


def counters(df: DataFrame) -> DataFrame:
    """One row of export_reason()'s result: seen, kept, kept_ratio and the dropped ones by reason."""
    n = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return df.agg(F.count(F.lit(1)).alias("seen"), n("kept"), *[n(f"dropped_{x}") for x in ("label", "no_rule", "rule_conf", "type", "conf")], F.coalesce(F.try_divide(F.count_if(F.col("reason") == "kept").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("kept_ratio"))


def merged_thresholds(base: DataFrame, new: DataFrame) -> DataFrame:
    """New thresholds over old ones, 0 included; values that are no numbers are skipped."""
    n = new.select("relation", F.expr("try_cast(threshold as double)").alias("__t")).where("__t IS NOT NULL")
    return base.join(n, "relation", "full").select("relation", F.coalesce("__t", "threshold").alias("threshold"))


def hypothesis(df: DataFrame) -> DataFrame:
    """df (relation, head, tail) with hypothesis, the sentence that a verifier is asked about."""
    t = F.broadcast(rules.templates(df.sparkSession)).withColumnRenamed("relation", "__r")
    j = df.join(t, F.col("relation") == F.col("__r"), "left")
    text = F.replace(F.coalesce("template", F.lit(rules.GENERIC_TEMPLATE)), F.lit("{r}"), F.col("relation"))
    # both names go in at once: a name that holds the other's placeholder stays as it is
    out = F.array_join(F.transform(F.split(text, r"(?<=\{h\})|(?=\{h\})|(?<=\{t\})|(?=\{t\})"), lambda p: F.when(p == "{h}", F.col("head")).when(p == "{t}", F.col("tail")).otherwise(p)), "")
    return j.withColumn("hypothesis", out).select(*df.columns, "hypothesis")


def directed(df: DataFrame) -> DataFrame:
    """df (head, tail, direction) with source and target: exchanged where the rule says reverse."""
    back = F.coalesce(F.col("direction") == "reverse", F.lit(False))
    return df.withColumns({"source": F.when(back, F.col("tail")).otherwise(F.col("head")), "target": F.when(back, F.col("head")).otherwise(F.col("tail"))})


def entailment_ids(labels: dict[int, str]) -> tuple[int, int, int]:
    """(entailment, neutral, contradiction) ids of a verifier by the names of its labels; (2, 1, 0) where they say nothing."""
    low = {v.lower(): k for k, v in labels.items()}
    found = [next((k for name, k in low.items() if part in name), None) for part in ("entail", "neutral", "contra")]
    return tuple(found) if None not in found else (2, 1, 0)  # type: ignore[return-value]


def side_by_side(model: DataFrame, llm: DataFrame, keys: list[str]) -> DataFrame:
    """Both answers on the same pair: keys, model_relation, model_conf, llm_relation, agree."""
    a = model.select(*keys, F.col("relation").alias("model_relation"), F.col("conf").alias("model_conf"))
    b = llm.select(*keys, F.col("relation").alias("llm_relation"))
    return a.join(b, keys).withColumn("agree", F.col("model_relation").eqNullSafe(F.col("llm_relation")))
