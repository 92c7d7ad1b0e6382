"""Parsing, repair and validation of answers by language models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from loomgraph.functions.text import strip
from loomgraph.plans import rules
from loomgraph.plans.staging import staged


BRACKET = re.compile(r"[\[\]]")
#: A bracket or brace, or a whole string, which may lack its end.
SIGN = re.compile(r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?|[\[\]{}]')


def greedy_array(text: Column) -> Column:
    """From the first [ to the last ], or null."""
    return F.nullif(F.regexp_extract(text, r"\[[\s\S]*\]", 0), F.lit(""))


def greedy_object(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit(""))


def unfenced(text: Column) -> Column:
    """Without code fences (plain, or of json) at the start and the end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def strict_array(text: str | None) -> str | None:
    """From the first [ to the ] that closes it by depth; brackets inside strings count as well."""
    if text is None or (start := text.find("[")) < 0:
        return None
    depth = 0
    for x in BRACKET.finditer(text, start):
        depth += 1 if x[0] == "[" else -1
        if depth == 0:
            return text[start : x.end()]
    return None


def salvaged_array(text: str | None) -> str | None:
    """The whole array if it is closed, else the array up to its last complete object at the top level, closed again. Strings and escapes are respected.
    Null without an array, or without such an object in one that isn't closed."""
    if text is None or (start := text.find("[")) < 0:
        return None
    arrays, objects, end = 0, 0, -1
    for x in SIGN.finditer(text, start):
        c = x[0]
        if c in "[]":
            arrays += 1 if c == "[" else -1
            if not arrays:
                return text[start : x.end()]
        elif c in "{}":
            objects += 1 if c == "{" else -1
            if c == "}" and arrays == 1 and not objects:
                end = x.start()
    return None if end < 0 else text[start : end + 1] + "]"


def recovered(df: DataFrame, text: str = "response") -> DataFrame:
    """df with strict and salvaged, the arrays that the two scans find. The only step here that needs Python."""
    schema = StructType([*df.schema.fields, StructField("strict", StringType()), StructField("salvaged", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(text).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(strict_array, rows), pa.string()), pa.array(map(salvaged_array, rows), pa.string())], names=[*batch.schema.names, "strict", "salvaged"])

    return df.mapInArrow(run, schema)


def parsed(df: DataFrame, text: str = "response") -> DataFrame:
    """df with items (array of variants) and how: strict, salvaged or null when neither scan gives valid JSON."""
    d = recovered(df.withColumn(text, unfenced(F.col(text))), text)
    # exploded one by one, so that each text is parsed once, however often its variant is named
    d = d.select(*d.columns, F.explode(F.array(F.try_parse_json("strict"))).alias("__a"))
    d = d.select(*d.columns, F.explode(F.array(F.when(F.col("__a").isNull(), F.try_parse_json("salvaged")))).alias("__b"))
    d = d.withColumn("how", F.when(F.col("__a").isNotNull(), "strict").when(F.col("__b").isNotNull(), "salvaged"))
    items = F.try_variant_get(F.coalesce("__a", "__b"), "$", "array<variant>")
    return d.withColumn("items", items).drop("strict", "salvaged", "__a", "__b")


def first_parsed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document's attempts (attempt, how) the first that parsed; documents without one are left out."""
    ok = df.where("how IS NOT NULL")
    return ok.join(ok.groupBy(key).agg(F.min("attempt").alias("attempt")), [key, "attempt"])


def validated(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Triples of df (key, items, and how, if it has that): head, head_type, relation, tail, tail_type, evidence, confidence, ord. Items that are no objects, lack a name or have
    an unknown relation go; unknown types become OTHER; a confidence that is no number is 0, and all are clamped to 0 and 1."""
    own = [key, *(["how"] if "how" in df.columns else [])]
    x = df.select(*own, F.posexplode_outer("items").alias("ord", "v"))  # outer: no filter that would need items twice; a row without an item has no names

    def get(path: str) -> Column:
        return strip(F.coalesce(F.try_variant_get("v", path, "string"), F.lit("")))

    def kind(path: str) -> Column:
        up = F.upper(get(path))
        return F.when(up.isin(*rules.LLM_TYPES), up).otherwise("OTHER")

    conf = F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.expr("try_cast(try_variant_get(v, '$.confidence', 'string') as double)"), F.lit(0.0))
    t = x.select(*own, "ord", get("$.head.text").alias("head"), kind("$.head.type").alias("head_type"), get("$.relation").alias("relation"), get("$.tail.text").alias("tail"), kind("$.tail.type").alias("tail_type"), get("$.evidence").alias("evidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"))
    return t.where((F.length("head") > 0) & (F.length("tail") > 0) & F.col("relation").isin(*rules.LLM_RELATIONS))


def best_of_response(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The surest row of each (key, head, relation, tail); the first of equal ones."""
    rest = [c for c in df.columns if c not in (key, "head", "relation", "tail")]
    best = F.min(F.struct((-F.col("confidence")).alias("__c"), F.col("ord").alias("__o"), *rest))
    return df.groupBy(key, "head", "relation", "tail").agg(best.alias("x")).select(key, "head", "relation", "tail", *[F.col(f"x.{c}").alias(c) for c in rest])


def coerced_label(answer: Column, labels: list[str], policy: str = "first") -> Column:
    """(label, conf_kept, note) of an answered label. first: exact, or equal without spaces, else labels[0] without a confidence; no_relation:
    exact, else NO_RELATION and label_not_allowed; null: exact, else null and label_not_allowed."""
    exact = F.array_contains(F.lit(labels), answer)
    if policy == "first":
        loose = F.filter(F.lit(labels), lambda x: F.replace(x, F.lit(" "), F.lit("")) == F.replace(answer, F.lit(" "), F.lit("")))
        return F.when(exact, F.struct(answer.alias("label"), F.lit(True).alias("conf_kept"), F.lit(None).cast("string").alias("note"))).when(F.size(loose) > 0, F.struct(loose[0].alias("label"), F.lit(True).alias("conf_kept"), F.lit(None).cast("string").alias("note"))).otherwise(F.struct(F.lit(labels[0]).alias("label"), F.lit(False).alias("conf_kept"), F.lit("fallback").alias("note")))
    other = F.lit("NO_RELATION" if policy == "no_relation" else None).cast("string")
    return F.when(F.coalesce(exact, F.lit(False)), F.struct(answer.alias("label"), F.lit(True).alias("conf_kept"), F.lit(None).cast("string").alias("note"))).otherwise(F.struct(other.alias("label"), F.lit(False).alias("conf_kept"), F.lit("label_not_allowed").alias("note")))


class CannedLLM:
    """Answers from a table (doc_id, attempt, response) in place of a model service; ask() joins them to questions."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def ask(self, questions: DataFrame, key: str = "doc_id") -> DataFrame:
        return questions.join(self.responses, key)


def ask(df: DataFrame, prompt: str, provider: Callable[[], Callable[[list[str]], list[str]]], attempt: int = 0) -> DataFrame:
    """df with response and attempt from any provider; it is made once a worker and maps prompts to answers."""
    schema = StructType([*df.schema.fields, StructField("response", StringType()), StructField("attempt", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = provider()
        for batch in batches:
            out = call(batch.column(prompt).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array([attempt] * len(out), pa.int32())], names=[*batch.schema.names, "response", "attempt"])

    return df.mapInArrow(run, schema)


def extracted(questions: DataFrame, provider: Callable[[], Callable[[list[str]], list[str]]], key: str = "doc_id", text: str = "text", retries: int = 2, strict: bool = False) -> DataFrame:
    """key, attempt, response, how and items of the first answer of each question that parses: strict, else salvaged, else by a repair prompt with the bad
    answer, `retries` times at most. Each round asks for what is still open only. Questions that never parse have their last answer and a null how; with
    strict, reading them raises."""
    now = staged(ask(questions.select(key, triple_prompt(F.col(text)).alias("prompt")), "prompt", provider, 0), "asked")
    done = None
    for k in range(retries + 1):
        p = staged(parsed(now).select(key, "attempt", "response", "how", F.to_json(F.col("items").cast("array<variant>")).alias("items")), "parsed")
        p = p.withColumn("items", F.try_variant_get(F.try_parse_json("items"), "$", "array<variant>"))
        last = k == retries
        good = p if last else p.where("how IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        open_ = p.where("how IS NULL")
        if last or open_.isEmpty():
            break
        now = staged(ask(open_.select(key, repair_prompt(F.col("response")).alias("prompt")), "prompt", provider, k + 1), "asked")
    if strict:
        done = done.withColumn("how", F.coalesce("how", F.raise_error(F.lit("an answer could not be parsed after all retries")).cast("string")))
    return done


def answered_array(response: Column, labels: list[str]) -> Column:
    """(label, note) of an answer that should be an array of one object with relation and note: NO_RELATION and bad_output for another shape,
    NO_RELATION and label_not_allowed for an unknown label."""
    first = F.try_variant_get(F.try_parse_json(greedy_array(response)), "$[0]", "variant")
    said = strip(F.coalesce(F.try_variant_get(first, "$.relation", "string"), F.lit("NO_RELATION")))
    note = strip(F.coalesce(F.try_variant_get(first, "$.note", "string"), F.lit("")))
    ok = F.coalesce(F.schema_of_variant(first).startswith("OBJECT"), F.lit(False))
    pair = lambda a, b: F.struct(a.alias("label"), b.alias("note"))
    none = F.lit("NO_RELATION")
    return F.when(~ok, pair(none, F.lit("bad_output"))).when(said.isin("NO_RELATION", *labels), pair(said, note)).otherwise(pair(none, F.lit("label_not_allowed")))


def answered_object(response: Column, labels: list[str]) -> Column:
    """(label, note) of an answer that should be an object with relation and rationale_short: no label and no_json, bad_json or label_not_allowed where it
    isn't."""
    text = greedy_object(response)
    obj = F.try_parse_json(text)
    said, why = (strip(F.coalesce(F.try_variant_get(obj, f"$.{k}", "string"), F.lit(""))) for k in ("relation", "rationale_short"))
    none = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("label"), b.alias("note"))
    return F.when(text.isNull(), pair(none, F.lit("no_json"))).when(obj.isNull(), pair(none, F.lit("bad_json"))).when(said.isin(*labels), pair(said, why)).otherwise(pair(none, F.lit("label_not_allowed")))


def answered_label(df: DataFrame, labels: list[str], key: str = "doc_id") -> DataFrame:
    """key, label, confidence, attempt of answers (key, attempt, response) that should be an object with label and confidence: the first attempt whose label
    is known, exactly or without spaces; else the first label, without confidence and attempt."""
    obj = F.try_parse_json(greedy_object(F.col("response")))
    said = strip(F.coalesce(F.try_variant_get(obj, "$.label", "string"), F.lit("")))
    conf = F.coalesce(F.try_variant_get(obj, "$.confidence", "double"), F.expr("try_cast(try_variant_get(o, '$.confidence', 'string') AS double)"))
    c = df.withColumn("o", obj).withColumn("said", said).withColumn("confidence", conf).withColumn("c", coerced_label(F.col("said"), labels, "first"))
    best = F.min(F.when(F.col("o").isNotNull() & F.col("c.conf_kept"), F.struct("attempt", F.col("c.label").alias("label"), "confidence")))
    return c.groupBy(key).agg(best.alias("x")).select(key, F.coalesce("x.label", F.lit(labels[0])).alias("label"), "x.confidence", "x.attempt")


def ner_answers(df: DataFrame, key: str = "doc_id", response: str = "response") -> DataFrame:
    """key, ord, text, label of answers that should be an array of objects with text and label; empty texts and labels off the list go."""
    items = F.try_variant_get(F.try_parse_json(greedy_array(F.col(response))), "$", "array<variant>")
    x = df.select(key, F.posexplode(items).alias("ord", "v"))
    x = x.select(key, "ord", *[strip(F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit(""))).alias(k) for k in ("text", "label")])
    return x.where((F.length("text") > 0) & F.col("label").isin(*rules.NER_LABELS))


def triple_prompt(text: Column) -> Column:
    return F.concat(F.lit("List the relations that the text states as a JSON array of objects with head {text, type}, relation, tail {text, type}, evidence and confidence.\nRelations: " + ", ".join(rules.LLM_RELATIONS) + "\nTypes: " + ", ".join(rules.LLM_TYPES) + "\nText:\n"), text)


def repair_prompt(response: Column) -> Column:
    return F.concat(F.lit("Return the following as one valid JSON array, with nothing else:\n"), response)


def classify_prompt(sentence: Column, head: Column, head_type: Column, tail: Column, tail_type: Column, labels: list[str]) -> Column:
    """Asks for an array of one object with relation and note."""
    ask_for = "\nAnswer with a JSON array of one object with relation and note. relation is NO_RELATION unless the sentence itself states one of: " + ", ".join(labels)
    return F.concat(F.lit("Sentence: "), sentence, F.lit("\nE1: "), head, F.lit(" ("), head_type, F.lit(")\nE2: "), tail, F.lit(" ("), tail_type, F.lit(")" + ask_for))


def choose_prompt(marked: Column, labels: list[str]) -> Column:
    """Asks for an object with relation and rationale_short."""
    return F.concat(F.lit("Which one of these relations holds between [E1] and [E2]? " + ", ".join(labels) + "\nAnswer with a JSON object with relation and rationale_short (12 words at most).\nSentence:\n"), marked)


def label_prompt(marked: Column, labels: list[str]) -> Column:
    """Asks for an object with label and confidence."""
    return F.concat(F.lit("Choose the label of the relation between [E1] and [E2]:\n" + "\n".join(f"- {x}" for x in labels) + "\nAnswer with a JSON object with label and confidence (0 to 1).\nSentence:\n"), marked)


def ner_prompt(text: Column) -> Column:
    """Asks for an array of objects with text and label."""
    return F.concat(F.lit("List the named entities of the text as a JSON array of objects with text, as it is written there, and label, one of: " + ", ".join(rules.NER_LABELS) + "\nText:\n"), text)
