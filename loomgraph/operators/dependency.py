"""Candidate pairs and triples from token tables (doc_id, sent_id, i, text, lemma, pos, dep, head_i), over sentences, one a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import parse_arrays
from loomgraph.operators.pairs import SENTENCE
from loomgraph.plans import rules
from loomgraph.plans.staging import staged

TOKENS = parse_arrays.TOKENS.removeprefix("array<").removesuffix(">")
#: Characters that an annotator is given at once.
ANNOTATED = 1 << 20
MENTION = parse_arrays.MENTIONS.removeprefix("array<").removesuffix(">")


def annotated(sents: DataFrame, annotator, text: str = "sentence", columns: tuple[str, ...] = ("text", "lemma", "pos", "dep", "head_i")) -> DataFrame:
    """The token table of sentences (doc_id, sent_id, text) by any tagger or parser.

    annotator makes it once a worker; it maps a list of texts to a list of tokens (text, lemma, pos, dep, head_i) for each, head_i being the token itself
    where there is no head. Null texts have no tokens. columns: those that are asked for leave the worker, with i. Long batches are parsed in parts of about
    ANNOTATED characters.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    types = {"text": pa.string(), "lemma": pa.string(), "pos": pa.string(), "dep": pa.string(), "head_i": pa.int32()}
    places = [list(types).index(c) for c in columns]

    def run(batches):
        parse = annotator()
        for batch in batches:
            total, start = pc.cumulative_sum(pc.fill_null(pc.cast(pc.utf8_length(batch.column(text)), pa.int64()), 0)).to_numpy(), 0
            while start < batch.num_rows:
                end = max(start + 1, int(total.searchsorted((total[start - 1] if start else 0) + ANNOTATED, "right")))
                part = batch.slice(start, end - start)
                found = parse([t or "" for t in part.column(text).to_pylist()])
                ends, i = [0], []
                for tokens in found:
                    i.extend(range(len(tokens)))
                    ends.append(len(i))
                fields = [pa.array(i, pa.int32())] + [pa.array([t[k] for tokens in found for t in tokens], types[c]) for k, c in zip(places, columns, strict=True)]
                ts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["i", *columns]))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in SENTENCE] + [ts], names=[*SENTENCE, "ts"])
                start = end

    kinds = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    row = ",".join(f"{c}:{'int' if c in ('i', 'head_i') else 'string'}" for c in ("i", *columns))
    out = sents.select(*SENTENCE, text).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in SENTENCE) + f", ts array<struct<{row}>>")
    return out.select(*SENTENCE, F.explode("ts").alias("t")).select(*SENTENCE, "t.*")


class ShapeTagger:
    """An offline stand-in for a trained tagger: parts of speech by the shape of a word, every token a root of its own."""

    WORDS = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"

    def __init__(self):
        import regex

        self.words = regex.compile(self.WORDS)
        self.known = {}
        self.shapes = [(pos, regex.compile(p)) for pos, p in (("PROPN", r"\p{Lu}"), ("NUM", r"\p{N}"), ("X", r"\p{L}"))]

    def __call__(self, texts: list[str]) -> list[list[tuple]]:
        if len(self.known) > 1 << 17:  # words that come again are told once
            self.known.clear()
        known = self.known

        def tag(t: str) -> tuple[str, str]:
            said = known[t] = t.lower(), next((pos for pos, p in self.shapes if p.match(t)), "PUNCT")
            return said

        return [[(t, *(known.get(t) or tag(t)), "ROOT", i) for i, t in enumerate(self.words.findall(x))] for x in texts]


def _within(tokens: DataFrame, steps: int) -> None:
    """Raises ValueError if a path of so many steps is longer than the longest sentence: then heads form a cycle."""
    if steps >= 32 and steps > (tokens.groupBy(*SENTENCE).count().agg(F.max("count")).first()[0] or 0):
        raise ValueError("heads of a sentence form a cycle")


def jump(tokens: DataFrame, follow: Column) -> DataFrame:
    """(doc_id, sent_id, i, top): where each token ends by following heads as long as `follow` holds, by pointer doubling until no pointer moves."""
    p = tokens.select(*SENTENCE, "i", F.when(follow & (F.col("head_i") != F.col("i")), F.col("head_i")).otherwise(F.col("i")).alias("top"))
    steps = 1
    while True:
        p = staged(p, "pointers")
        q = p.where("top <> i").select(*SENTENCE, F.col("i").alias("top"), F.col("top").alias("next"))
        far = p.where("top <> i").join(q, [*SENTENCE, "top"])
        moves, loops = far.agg(F.count(F.lit(1)), F.count(F.when(F.col("next") == F.col("i"), 1))).first()
        if not moves:
            return p
        if loops:
            raise ValueError("heads of a sentence form a cycle")
        _within(tokens, steps)
        p = p.join(q, [*SENTENCE, "top"], "left").select(*SENTENCE, "i", F.coalesce("next", "top").alias("top"))
        steps *= 2


def ancestors(tokens: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, sent_id, i, a) of the tokens of `of` and every token above them, themselves included, by doubling paths until none is left."""
    step = tokens.where(F.col("head_i") != F.col("i")).select(*SENTENCE, "i", F.col("head_i").alias("a"))
    every = of.select(*SENTENCE, "i", F.col("i").alias("a"))
    steps = 1
    while True:
        step, every = staged(step, "steps"), staged(every, "paths")
        if step.isEmpty():
            return every.distinct()
        _within(tokens, steps)
        far = step.select(*SENTENCE, F.col("i").alias("a"), F.col("a").alias("b"))
        every = every.unionByName(every.join(far, [*SENTENCE, "a"]).select(*SENTENCE, "i", F.col("b").alias("a")))
        step = step.join(far, [*SENTENCE, "a"]).select(*SENTENCE, "i", F.col("b").alias("a"))
        steps *= 2


def conjuncts(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, i, j): the other tokens of i's coordination."""
    root = jump(tokens, F.col("dep") == "conj")
    a = root.select(*SENTENCE, "top", "i")
    return a.join(root.select(*SENTENCE, "top", F.col("i").alias("j")), [*SENTENCE, "top"]).where("i <> j").drop("top")


def parses(tokens: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """One row a sentence: doc_id, sent_id, ts (its tokens) and ms (its mentions: ord, text, type, start, end, first_i, last_i, root_i; what is missing is null).

    One exchange of tokens and mentions together. A table that has a row a sentence already needs none: all that takes tokens and mentions takes it as well.
    """
    if "ts" in tokens.columns:
        return tokens
    t = tokens.select(*SENTENCE, F.struct("i", "text", "lemma", "pos", "dep", "head_i").cast(TOKENS).alias("t"), F.lit(None).cast(MENTION).alias("m"))
    if mentions is not None:
        have = [F.col(c) if c in mentions.columns else F.lit(None).alias(c) for c in ("ord", "text", "type", "start", "end", "first_i", "last_i", "root_i")]
        t = t.unionByName(mentions.select(*SENTENCE, F.lit(None).cast(TOKENS).alias("t"), F.struct(*have).cast(MENTION).alias("m")))
    return t.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list("t")).alias("ts"), F.array_sort(F.collect_list("m")).alias("ms"))


def _found(sents: DataFrame, find, columns: str) -> DataFrame:
    """What find (of parse_arrays) sees in sentences, with doc_id and sent_id."""
    kinds = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    s = sents.select(*SENTENCE, F.col("ts").cast(parse_arrays.TOKENS).alias("ts"), F.col("ms").cast(parse_arrays.MENTIONS).alias("ms"))
    names = [c.split()[0] for c in columns.split(", ")]
    return s.mapInArrow(parse_arrays.runner(find, SENTENCE, names), ", ".join(f"{c} {kinds[c]}" for c in SENTENCE) + f", {columns}")


PAIR = ", ".join(f"{s}_{c}" for s in ("head", "tail") for c in ("text string", "type string", "start int", "end int")) + ", pattern string, ord int"


def proposed(tokens: DataFrame, mentions: DataFrame | None = None, window: int = 2) -> DataFrame:
    """Candidate pairs of all patterns, expanded over coordinations, once per (head span, tail span, pattern), and fallback pairs.

    doc_id, sent_id, head_*, tail_* (text, type, start, end), pattern, ord (by sentence, from 0). mentions: ord, text, type, start, end, first_i, last_i,
    root_i. Patterns are found inside a sentence's row, over arrays: no row of a token or a pair is shuffled but once, by parses().
    """
    return _found(parses(tokens, mentions), lambda s: parse_arrays.proposed(s, window), PAIR)


TRIPLE = "subject string, relation string, object string, pattern string, ord int"


def simple_triples(tokens: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """doc_id, sent_id, subject, relation, object, pattern, ord: active verbs, passive verbs with prepositions and predicates with prepositions; of several
    subjects or objects the last counts. Empty names give no triple."""
    return _found(parses(tokens, mentions), parse_arrays.simple, TRIPLE)


def coordinated_triples(tokens: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """As simple_triples, with the first subject and object and their direct coordinates, and passive agents turned to subjects. ord orders a sentence."""
    return _found(parses(tokens, mentions), parse_arrays.coordinated, TRIPLE)


def flat_graph(triples: DataFrame, by: str = "doc_id") -> DataFrame:
    """The edges (source, relation, target) of triples without events."""
    return triples.select(by, F.col("subject").alias("source"), "relation", F.col("object").alias("target"))


def arcs(tokens: DataFrame) -> DataFrame:
    """The token table with head_text and children (texts, in order): what a listing of a parse shows."""
    key = [*SENTENCE, "i"]
    ts = parses(tokens)
    row = ts.select(*SENTENCE, "ts", F.explode("ts").alias("t"))
    head = F.get(F.filter("ts", lambda h: h["i"] == F.col("t.head_i")), F.lit(0))["text"]
    children = F.transform(F.filter("ts", lambda c: (c["head_i"] == F.col("t.i")) & (c["i"] != F.col("t.i"))), lambda c: c["text"])
    return row.select(*SENTENCE, "t.i", "t.text", "t.lemma", "t.pos", "t.dep", "t.head_i", head.alias("head_text"), children.alias("children")).select(*key, "text", "lemma", "pos", "dep", "head_i", "head_text", "children")


def event_graph(triples: DataFrame, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Events (event_id, type) and edges (source, relation, target) of triples (by, ord, subject, relation, object; with sent_id ord counts in a sentence).

    Events are numbered in the order of the text. Each triple whose relation is an event verb is a core and gets an event by number; a triple of the same subject whose relation starts with the verb and
    an underscore belongs to the first core that can take it; all others stay edges between names. Triples are shuffled once, by document: numbers and first
    cores are windows over the same partitions.
    """
    place = ["sent_id", "ord"] if "sent_id" in triples.columns else ["ord"]
    core = F.col("relation").isin(*rules.EVENT_VERBS)
    base = F.when(core, F.col("relation")).otherwise(F.substring_index("relation", "_", 1))
    t = triples.where("relation IS NOT NULL").select(by, *place, "subject", "relation", "object")
    so_far = Window.partitionBy(by).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("n", F.when(core, F.count(F.when(core, 1)).over(so_far)))
    event = F.concat_ws("_event_", "relation", F.col("n").cast("string"))
    events = t.where(core).select(by, event.alias("event_id"), F.col("relation").alias("type"))
    t = t.withColumn("base", base).withColumn("first", F.min("n").over(Window.partitionBy(by, "subject", "base")))
    is_mod = F.col("subject").isNotNull() & F.col("first").isNotNull() & F.contains("relation", F.lit("_"))

    def edge(source: Column, relation: Column, target: Column) -> Column:
        return F.struct(source.alias("source"), relation.alias("relation"), target.alias("target"))

    of_core = F.array(edge(event, F.lit("subject"), F.col("subject")), edge(event, F.lit("object"), F.col("object")))
    owner = F.concat_ws("_event_", "base", F.col("first").cast("string"))
    rest = F.array(edge(F.when(is_mod, owner).otherwise(F.col("subject")), F.when(is_mod, F.expr("substring(relation, length(base) + 2)")).otherwise(F.col("relation")), F.col("object")))
    return events, t.select(by, F.explode(F.when(core, of_core).otherwise(rest)).alias("x")).select(by, "x.*")
