"""Mentions and their pairs within a sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import mark_entities, sentences, strip
from loomgraph.operators import parse_arrays
from loomgraph.plans import rules

SENTENCE = ["doc_id", "sent_id"]


def sentence_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, sent_id (from 0), sentence. Splitting happens next to the scan; nothing is shuffled."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(sentences(F.col(text))).alias("sent_id", "sentence"))


class GazetteerAnnotator:
    """An offline stand-in for a trained recogniser: runs of capitalised words are mentions, and a name list (or else a hash of the name) types them."""

    TYPES = ("PERSON", "ORG", "GPE", "LOC")

    def __init__(self, names: DataFrame | None = None):
        """names: name, type; joined by a broadcast only while Spark finds it small enough."""
        self.names = names

    def _found(self, sents: DataFrame) -> Column:
        """The mentions (text, start, end) of a sentence, in order."""
        found = F.regexp_extract_all("sentence", F.lit(r"(?U)(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"), 1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

        def step(acc, name):
            rest = F.substring(F.col("sentence"), acc["at"] + 1, F.length("sentence"))
            start = acc["at"] + F.instr(rest, name) - 1
            end = start + F.length(name)
            item = F.struct(name.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
            return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

        return F.aggregate(found, zero, step)["out"]

    def _guess(self, text: Column) -> Column:
        kinds = F.array(*[F.lit(x) for x in self.TYPES])
        digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text.cast("binary")), 1, 1)) - 1
        return F.element_at(kinds, (digit % len(self.TYPES) + 1).cast("int"))

    def rows(self, sents: DataFrame) -> DataFrame:
        """Sentences that have mentions, one a row, with ms (ord, text, type, start, end). Without names nothing is shuffled."""
        if self.names is not None:
            return mention_rows(self.mentions(sents))
        ms = F.transform(self._found(sents), lambda m, i: F.struct(i.alias("ord"), m["text"].alias("text"), self._guess(m["text"]).alias("type"), m["start"].alias("start"), m["end"].alias("end")))
        return sents.select(*SENTENCE, "sentence", F.explode(F.array(ms)).alias("ms")).where(F.size("ms") > 0)  # exploded, so that it is computed once

    def mentions(self, sents: DataFrame) -> DataFrame:
        """doc_id, sent_id, ord (from 0), text, type, start, end: each name's first place at or after the end of the mention before."""
        rows = sents.select(*SENTENCE, "sentence", F.posexplode(self._found(sents)).alias("ord", "m"))
        rows = rows.select(*SENTENCE, "sentence", "ord", "m.text", "m.start", "m.end", self._guess(F.col("m.text")).alias("guess"))
        if self.names is None:
            return rows.withColumnRenamed("guess", "type")
        named = rows.join(self.names.select(F.col("name").alias("__n"), F.col("type").alias("__t")), F.col("text") == F.col("__n"), "left")
        return named.withColumn("type", F.coalesce("__t", "guess")).drop("guess", "__n", "__t")


def mention_rows(mentions: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a sentence with ms, its mentions (of those with keep, if that is given), n, their number in all, and the sentence, if mentions have it."""
    if "ms" in mentions.columns:
        rows = mentions.withColumn("n", F.size("ms").cast("long"))
        return rows if keep is None else rows.withColumn("ms", F.filter("ms", keep))
    cols = F.struct(*[c for c in ("ord", "text", "type", "start", "end", "root_i") if c in mentions.columns])
    ms = F.collect_list(cols if keep is None else F.when(keep(F.struct("ord")), cols))
    whole = [F.first("sentence").alias("sentence")] if "sentence" in mentions.columns else []
    return mentions.groupBy(*SENTENCE).agg(F.count(F.lit(1)).alias("n"), *whole, F.array_sort(ms).alias("ms"))


def distinct_mentions(mentions: DataFrame, by: str = "text") -> DataFrame:
    """The first mention of each stripped (text, type), or of each span, numbered anew."""
    key = ["text", "type"] if by == "text" else ["start", "end"]
    rest = [c for c in mentions.columns if c not in (*SENTENCE, *key)]
    m = mentions.withColumn("text", strip(F.col("text"))) if by == "text" else mentions
    first = m.groupBy(*SENTENCE, *key).agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("x"))
    out = first.select(*SENTENCE, *key, *[F.col(f"x.{c}").alias(c) for c in rest])
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(*SENTENCE).orderBy("ord")) - 1).select(mentions.columns)


def of_types(mentions: DataFrame, types: tuple[str, ...] = tuple(rules.ENTITY_TYPES)) -> DataFrame:
    """Mentions of these types only."""
    return mentions.where(F.col("type").isin(*types))


def capped_pairs(mentions: DataFrame, cap: int = 30) -> DataFrame:
    """The first `cap` ordered pairs of different mentions of a sentence, by (head, tail) order.

    With n mentions only heads below ceil(cap / (n - 1)) and tails up to cap can come up, so a sentence gathers at most cap + 1 mentions and makes about cap
    pairs; n is never squared. Pairs are made inside the row: mentions are gathered by one exchange, which those of one partition enter as one row a sentence;
    a table that has a row a sentence (as of rows()) needs none.
    """
    cols = ("ord", "text", "type", "start", "end")
    m = mention_rows(mentions, lambda x: x["ord"] <= cap).where("n > 1")
    n = F.col("n")

    def place(h, t):
        return h["ord"] * (n - 1) + t["ord"] - F.when(t["ord"] > h["ord"], 1).otherwise(0)

    heads = F.filter("ms", lambda h: h["ord"] < F.ceil(F.lit(cap) / (n - 1)))
    made = F.flatten(F.transform(heads, lambda h: F.transform(F.filter("ms", lambda t: t["ord"] != h["ord"]), lambda t: F.struct(h.alias("h"), t.alias("t"), place(h, t).alias("k")))))
    rows = m.select(*SENTENCE, "sentence", F.explode(F.filter(made, lambda p: p["k"] < cap)).alias("p"))
    return rows.select(*SENTENCE, "sentence", *[F.col(f"p.{s}.{c}").alias(f"{side}_{c}") for s, side in (("h", "head"), ("t", "tail")) for c in cols], F.col("p.k").alias("ord"))


def typed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose types are on the list of allowed ones."""
    allowed = F.broadcast(rules.pair_types(pairs.sparkSession))
    return pairs.join(allowed, ["head_type", "tail_type"], "left_semi")


def marked_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("marked", mark_entities(F.col("sentence"), F.col("head_text"), F.col("tail_text")))


def fallback_pairs(mentions: DataFrame, existing: DataFrame | None = None, window: int = 2, distance: int = rules.FALLBACK_DISTANCE) -> DataFrame:
    """Pairs of mentions at most `window` apart whose roots (root_i) are at most `distance` apart, in both orders, unless their spans are proposed already.

    Pairs are made inside a sentence's row, over arrays, as for capped_pairs. Of equal span pairs the first comes through.
    """
    m = mention_rows(mentions)
    kinds = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    fields = m.schema["ms"].dataType.elementType.names
    ms = F.transform("ms", lambda x: F.struct(*[(x[c] if c in fields else F.lit(None)).alias(c) for c in parse_arrays.MENTION_NAMES])).cast(parse_arrays.MENTIONS)
    names = [*(f"{s}_{c}" for s in ("head", "tail") for c in ("start", "end")), *(f"{s}_{c}" for s in ("head", "tail") for c in ("text", "type")), "pattern", "ord"]
    types = ["int"] * 4 + ["string"] * 5 + ["int"]
    schema = ", ".join(f"{c} {t}" for c, t in zip([*SENTENCE, *names], [kinds[c] for c in SENTENCE] + types, strict=True))
    none = F.array().cast(parse_arrays.TOKENS)
    first = m.select(*SENTENCE, none.alias("ts"), ms.alias("ms")).mapInArrow(parse_arrays.runner(lambda s: parse_arrays.fallback(s, window, distance), SENTENCE, names), schema)
    if existing is None:
        return first
    span = names[:4]
    return first.join(existing.select(*SENTENCE, *span).distinct(), [*SENTENCE, *span], "left_anti")


def text_between(mentions: DataFrame, first_type: str = "ORG", second_type: str = "LOC", pattern: str = r".*\bin\b.*") -> DataFrame:
    """Neighbouring mentions of the two types whose text between matches."""
    w = Window.partitionBy(*SENTENCE).orderBy("ord")
    m = mentions.withColumns({"n_text": F.lead("text").over(w), "n_type": F.lead("type").over(w), "n_start": F.lead("start").over(w)})
    filler = F.substring("sentence", F.col("end") + 1, F.col("n_start") - F.col("end"))
    m = m.where((F.col("type") == first_type) & (F.col("n_type") == second_type)).withColumn("filler", filler)
    return m.where(F.col("filler").rlike(pattern)).select(*SENTENCE, F.col("text").alias("subject"), "filler", F.col("n_text").alias("object"))
