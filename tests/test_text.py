import random

from pyspark.sql import functions as F

from loomgraph.functions import text as T


def column(spark, rows, schema, **exprs):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[v.alias(k) for k, v in exprs.items()]).collect()]


def marked(s, h, t):
    """The marking rule, said again in Python."""
    a, b = s.find(h) if h else -1, s.find(t) if t else -1
    if a < 0 or b < 0:
        return None
    tags = [(a, len(h), "1"), (b, len(t), "2")]
    for at, n, k in sorted(tags, key=lambda x: (x[0], x[2]) if a <= b else (x[0], -int(x[2])), reverse=True):
        s = s[: at + n] + f" [/E{k}]" + s[at + n :]
        s = s[:at] + f"[E{k}] " + s[at:]
    return s


def test_mark_entities_random(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab ") for _ in range(8)), rng.choice(["a", "ab", "b", "ba", "bab"]), rng.choice(["a", "ab", "b", "aba"])) for _ in range(300)]
    rows.append(("New York City", "New York", "York City"))
    got = column(spark, rows, "s string, h string, t string", m=T.mark_entities(F.col("s"), F.col("h"), F.col("t")))
    assert [r["m"] for r in got] == [marked(*r) for r in rows]


def test_mark_spans(spark):
    rows = [("abcdef", 0, 2, 0, 2), ("abcdef", 0, 2, 3, 5), ("abcdef", 3, 5, 0, 2), ("abcdef", 0, 2, 0, 4)]
    got = [r["m"] for r in column(spark, rows, "s string, a int, b int, c int, d int", m=T.mark_spans(F.col("s"), F.col("a"), F.col("b"), F.col("c"), F.col("d")))]
    assert got[0] == ""
    assert got[1] == "[E1]ab[/E1]c[E2]de[/E2]f"
    assert got[2] == "[E2]ab[/E2]c[E1]de[/E1]f"
    assert "[E2]" in got[3] and "[E1]" in got[3]


def test_mark_longest_first_and_any_case(spark):
    got = column(spark, [("Ann Lee met ANN", "Ann", "Ann Lee")], "s string, a string, b string", m=T.mark_longest_first(F.col("s"), F.col("a"), F.col("b")), n=T.mark_ignoring_case(F.col("s"), F.lit("MET"), F.lit("lee")))[0]
    assert got["m"] == "[E2][E1]Ann[/E1] Lee[/E2] met ANN"
    assert got["n"] == "Ann [E2] Lee [/E2] [E1] met [/E1] ANN"


def test_sentences_and_strip(spark):
    got = column(spark, [("One. Two!  Three? ",), (None,), ("",)], "s string", m=T.sentences(F.col("s")), k=T.strip(F.col("s")))
    assert [r["m"] for r in got] == [["One.", "Two!", "Three?"], [], []]
    assert got[0]["k"].endswith("Three?")


def test_types(spark):
    rows = [("/a-b/c d",), ("9x",), ("//",), ("",)]
    got = column(spark, rows, "r string", i=T.import_type(F.col("r")), g=T.graph_type(F.col("r")), m=T.llm_graph_type(F.col("r")))
    assert [r["i"] for r in got] == ["A_B_C D", "9X", "_", ""]
    assert [r["g"] for r in got] == ["A_B_C_D", "_9X", "RELATED_TO", "RELATED_TO"]
    assert [r["m"] for r in got] == ["A_B_C_D", "9X", "RELATED_TO", "RELATED_TO"]


def test_small_rules(spark):
    got = column(spark, [("per", None, "/x/NA")], "a string, b string, c string", l=T.ner_label(F.col("a")), i=T.node_id(F.col("b"), F.col("a")), n=T.is_no_relation(F.col("c")), q=T.normalize_quotes(F.lit("’“x”")), p=T.preposition(F.lit("at")), p2=T.preposition(F.lit("over")))[0]
    assert got == {"l": "PERSON", "i": "UNK:per", "n": True, "q": "'\"x\"", "p": "in", "p2": "over"}


def test_checked_spans(spark):
    rows = [("abcdef", 0, 2, 3, 5), ("abcdef", 3, 5, 0, 2), ("abcdef", 0, 2, 3, 9), ("abcdef", 2, 2, 3, 4), ("abcdef", 0, 4, 2, 6)]
    got = [r["m"] for r in column(spark, rows, "s string, a int, b int, c int, d int", m=T.mark_checked_spans(F.col("s"), F.col("a"), F.col("b"), F.col("c"), F.col("d")))]
    assert got[:4] == ["[E1]ab[/E1]c[E2]de[/E2]f", "[E2]ab[/E2]c[E1]de[/E1]f", "", ""] and got[4] != ""


def test_strip_without_patterns(spark):
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{c} a{c}b {c}",) for c in every] + [("",), (None,), ("　\n",)], "s string")
    got = df.select(T.strip(F.col("s")).alias("a"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("b"))
    assert got.where("NOT a <=> b").isEmpty() and "regexp" not in T.strip(F.col("s"))._jc.toString()


def test_edge_types_without_patterns(spark):
    rows = ["/a/b-c", "  /x", "//y/", "a", "", None, " ", "/", " /ä-ß ", "!z~", "~", "- /-"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    old = F.upper(F.translate(F.regexp_replace(F.regexp_replace("r", r"(?U)^\s+|\s+$", ""), "^/", ""), "/-", "__"))
    assert df.where(~T.import_type(F.col("r")).eqNullSafe(old) | ~T.bare(F.col("r")).eqNullSafe(T.strip(F.col("r")))).isEmpty()
    assert not any(x in T.import_type(F.col("r"))._jc.toString() for x in ("regexp", "translate"))
