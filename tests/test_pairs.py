from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import dependency, pairs

M = "doc_id long, sent_id int, ord int, text string, type string, start int, end int, root_i int, sentence string"


def ments(spark, n, doc=1):
    return [(doc, 0, i, f"N{i}", "ORG" if i % 2 else "PERSON", 3 * i, 3 * i + 2, i * 4, "s") for i in range(n)]


def test_capped_pairs_match_enumeration(spark):
    for n, cap in ((1, 5), (2, 1), (3, 4), (7, 9), (12, 30), (20, 50)):
        df = spark.createDataFrame(ments(spark, n), M)
        got = sorted((r["ord"], r["head_ord"], r["tail_ord"]) for r in pairs.capped_pairs(df, cap).collect())
        assert got == [(k, a, b) for k, (a, b) in enumerate(permutations(range(n), 2)) if k < cap]


def test_typed_and_distinct(spark):
    df = spark.createDataFrame(ments(spark, 4), M)
    got = pairs.typed_pairs(pairs.capped_pairs(df)).select("head_type", "tail_type").distinct().collect()
    assert {(r[0], r[1]) for r in got} == {("PERSON", "ORG"), ("ORG", "PERSON")}
    twice = df.unionByName(spark.createDataFrame([(1, 0, 4, " N0 ", "PERSON", 0, 2, 0, "s")], M))
    assert pairs.distinct_mentions(twice).count() == 4 and pairs.distinct_mentions(twice, "span").count() == 4


def test_mentions(spark):
    s = spark.createDataFrame([(1, 0, "Ann Lee saw Ann and Bo."), (2, 0, ""), (3, 0, "none here")], "doc_id long, sent_id int, sentence string")
    got = [(r["text"], r["start"], r["end"]) for r in pairs.GazetteerAnnotator().mentions(s).orderBy("ord").collect()]
    assert got == [("Ann Lee", 0, 7), ("Ann", 12, 15), ("Bo", 20, 22)]
    names = spark.createDataFrame([("Bo", "LOC")], "name string, type string")
    assert pairs.GazetteerAnnotator(names).mentions(s).where("text = 'Bo'").first()["type"] == "LOC"


def test_fallback(spark):
    df = spark.createDataFrame(ments(spark, 4), M)
    got = {(r["head_text"], r["tail_text"], r["pattern"]) for r in pairs.fallback_pairs(df, window=1).collect()}
    assert ("N0", "N1", "P0_fallback_window") in got and ("N1", "N0", "P0_fallback_window_rev") in got and len(got) == 6
    assert pairs.fallback_pairs(df, distance=3, window=1).isEmpty()
    have = spark.createDataFrame([(1, 0, 0, 2, 3, 5)], "doc_id long, sent_id int, head_start int, head_end int, tail_start int, tail_end int")
    assert pairs.fallback_pairs(df, have, window=1).count() == 5


def test_text_between(spark):
    s = "Acme in Rome"
    df = spark.createDataFrame([(1, 0, 0, "Acme", "ORG", 0, 4, 0, s), (1, 0, 1, "Rome", "LOC", 8, 12, 2, s)], M)
    assert pairs.text_between(df).first()["filler"] == " in "


TOK = "doc_id long, sent_id int, i int, text string, lemma string, pos string, dep string, head_i int"
MEN = "doc_id long, sent_id int, ord int, text string, type string, start int, end int, first_i int, last_i int, root_i int"


def parse(words, doc=1):
    """(text, pos, dep, head) rows; capitalised words are mentions."""
    toks = [(doc, 0, i, t, t.lower(), p, d, h) for i, (t, p, d, h) in enumerate(words)]
    names = [i for i, w in enumerate(words) if w[1] == "PROPN"]
    return toks, [(doc, 0, k, words[i][0], "ORG", i * 10, i * 10 + 5, i, i, i) for k, i in enumerate(names)]


def frames(spark, words):
    t, m = parse(words)
    return spark.createDataFrame(t, TOK), spark.createDataFrame(m, MEN)


LIVE = [("Paul", "PROPN", "nsubj", 3), ("and", "CCONJ", "cc", 0), ("Anna", "PROPN", "conj", 0), ("live", "VERB", "ROOT", 3), ("in", "ADP", "prep", 3), ("Rome", "PROPN", "pobj", 4), ("and", "CCONJ", "cc", 5), ("Oslo", "PROPN", "conj", 5)]
BOUGHT = [("Beats", "PROPN", "nsubjpass", 2), ("was", "AUX", "auxpass", 2), ("acquire", "VERB", "ROOT", 2), ("by", "ADP", "prep", 2), ("Apple", "PROPN", "pobj", 3), ("in", "ADP", "prep", 2), ("May", "PROPN", "pobj", 5)]


def test_coordinated_triples(spark):
    got = [tuple(r[c] for c in ("subject", "relation", "object", "pattern")) for r in dependency.coordinated_triples(*frames(spark, LIVE)).orderBy("ord").collect()]
    assert got == [(s, "live_in", o, "B_predicate_prep") for s in ("Paul", "Anna") for o in ("Rome", "Oslo")]
    got = {tuple(r[c] for c in ("subject", "relation", "object", "pattern")) for r in dependency.coordinated_triples(*frames(spark, BOUGHT)).collect()}
    assert ("Apple", "acquire", "Beats", "A_passive_by") in got and ("Beats", "acquire_in", "May", "B_predicate_prep") in got


def test_simple_triples(spark):
    got = {tuple(r[c] for c in ("subject", "relation", "object", "pattern")) for r in dependency.simple_triples(*frames(spark, LIVE)).collect()}
    assert got == {("Paul", "live_in", "Rome", "C_predicate_prep")}
    got = {r["pattern"] for r in dependency.simple_triples(*frames(spark, BOUGHT)).collect()}
    assert got == {"B_passive_prep"}


def test_events(spark):
    rows = [(1, 0, "A", "acquire", "B"), (1, 1, "A", "acquire", "C"), (1, 2, "A", "acquire_in", "May"), (1, 3, "D", "acquire_in", "June"), (1, 4, "A", "sell", "E")]
    ev, ed = dependency.event_graph(spark.createDataFrame(rows, "doc_id long, ord int, subject string, relation string, object string"))
    assert {r["event_id"] for r in ev.collect()} == {"acquire_event_1", "acquire_event_2"}
    got = {(r["source"], r["relation"], r["target"]) for r in ed.collect()}
    assert ("acquire_event_1", "in", "May") in got and ("D", "acquire_in", "June") in got and ("A", "sell", "E") in got and ("acquire_event_2", "object", "C") in got and len(got) == 7


def proposals(spark, words, **kw):
    return {(r["head_text"], r["tail_text"], r["pattern"]) for r in dependency.proposed(*frames(spark, words), **kw).collect()}


def test_patterns(spark):
    got = proposals(spark, LIVE)
    assert {("Paul", "Rome", "P2_pred_prep"), ("Paul", "Oslo", "P2_pred_prep+conj"), ("Anna", "Rome", "P2_pred_prep+P8_head_conj"), ("Paul", "Oslo", "P2_pred_prep+P8_tail_conj")} <= got
    assert not any(p.startswith("P0") and {h, t} == {"Paul", "Rome"} for h, t, p in got if p == "P0_fallback_window")
    svo = [("Acme", "PROPN", "nsubj", 1), ("owns", "VERB", "ROOT", 1), ("Bolt", "PROPN", "dobj", 1)]
    assert proposals(spark, svo) == {("Acme", "Bolt", "P1_SVO"), ("Bolt", "Acme", "P0_fallback_window_rev")}
    # the last subject counts, also if it has no mention
    two = [("Acme", "PROPN", "nsubj", 2), ("it", "PRON", "nsubj", 2), ("owns", "VERB", "ROOT", 2), ("Bolt", "PROPN", "dobj", 2)]
    assert not any(p == "P1_SVO" for _, _, p in proposals(spark, two))
    appos = [("Acme", "PROPN", "ROOT", 0), (",", "PUNCT", "punct", 0), ("Bolt", "PROPN", "appos", 0)]
    assert {("Acme", "Bolt", "P5_appos"), ("Bolt", "Acme", "P5_appos_rev")} == proposals(spark, appos)
    noun = [("Acme", "PROPN", "poss", 1), ("head", "NOUN", "ROOT", 1), ("of", "ADP", "prep", 1), ("Bolt", "PROPN", "pobj", 2)]
    assert ("Acme", "Bolt", "P6_noun_of_poss") in proposals(spark, noun)
    cop = [("Acme", "PROPN", "nsubj", 2), ("is", "AUX", "cop", 2), ("part", "NOUN", "ROOT", 2), ("of", "ADP", "prep", 2), ("Bolt", "PROPN", "pobj", 3)]
    got = proposals(spark, cop)
    assert ("Acme", "Bolt", "P3_copular_prep") in got and ("Acme", "Bolt", "P6_noun_of_cop_subj") in got


def test_long_chains(spark):
    n = 75
    chain = [(0, 0, i, "conj" if i else "dobj", max(i - 1, 0)) for i in range(n)]
    df = spark.createDataFrame(chain, "doc_id long, sent_id int, i int, dep string, head_i int")
    assert {(r["i"], r["j"]) for r in dependency.conjuncts(df).collect()} == {(i, j) for i in range(n) for j in range(n) if i != j}
    up = dependency.ancestors(df, df.where(f"i = {n - 1}").select("doc_id", "sent_id", "i"))
    assert sorted(r["a"] for r in up.collect()) == list(range(n))


@pytest.mark.parametrize("size", [2, 3, 4])
def test_cycles_of_heads(spark, size):
    df = spark.createDataFrame([(0, 0, i, "conj", (i + 1) % size) for i in range(size)], "doc_id long, sent_id int, i int, dep string, head_i int")
    with pytest.raises(ValueError):
        dependency.jump(df, F.col("dep") == "conj")
    with pytest.raises(ValueError):
        dependency.ancestors(df, df.select("doc_id", "sent_id", "i"))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


SENTS = "doc_id long, sent_id int, ts array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head_i:int>>, ms array<struct<ord:int,text:string,type:string,start:int,end:int,first_i:int,last_i:int,root_i:int>>"


@pytest.mark.parametrize("find", [dependency.proposed, dependency.simple_triples, dependency.coordinated_triples])
def test_rows_of_sentences_are_not_shuffled(spark, find):
    t, m = parse(LIVE)
    df = spark.createDataFrame([(1, 0, [x[2:] for x in t], [x[2:] for x in m])], SENTS)
    one = find(df)
    assert shuffles(one) == 0 and shuffles(find(*frames(spark, LIVE))) == 1
    assert sorted(one.collect()) == sorted(find(*frames(spark, LIVE)).collect())


def test_proposals_over_pieces(spark, monkeypatch):
    """Many sentences a batch, a long coordination in blocks, and sentences without tokens or mentions."""
    names = [("Acme", "PROPN", "nsubj", 1), ("owns", "VERB", "ROOT", 1), ("N0", "PROPN", "dobj", 1), *((f"N{k}", "PROPN", "conj", k + 1) for k in range(1, 60))]
    t, m = parse(names)
    rows = [(1, 0, [x[2:] for x in t], [x[2:] for x in m]), (1, 1, [], [x[2:] for x in m[:2]]), (1, 2, [x[2:] for x in t], []), (1, 3, None, None)]
    got = dependency.proposed(spark.createDataFrame(rows, SENTS)).collect()
    assert {(r["head_text"], r["tail_text"]) for r in got if r["pattern"] == "P1_SVO+P8_tail_conj"} == {("Acme", f"N{k}") for k in range(1, 60)}
    assert sorted(r["ord"] for r in got if r["sent_id"] == 0) == list(range(sum(r["sent_id"] == 0 for r in got)))
    assert {(r["head_text"], r["pattern"]) for r in got if r["sent_id"] == 1} == {("Acme", "P0_fallback_window"), ("N0", "P0_fallback_window_rev")} and {r["sent_id"] for r in got} == {0, 1}

    from loomgraph.operators import parse_arrays

    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "sent_id", "ts", "ms"), (1, k, [dict(zip(TOK_NAMES, x[2:])) for x in t], [dict(zip(MEN_NAMES, x[2:])) for x in m]))) for k in range(3)])
    whole = list(parse_arrays.runner(lambda s: parse_arrays.proposed(s, 2), ["doc_id", "sent_id"], PAIR_NAMES)([batch]))
    for name in ("PIECE", "BLOCK", "OUT"):
        monkeypatch.setattr(parse_arrays, name, 7)
    parts = list(parse_arrays.runner(lambda s: parse_arrays.proposed(s, 2), ["doc_id", "sent_id"], PAIR_NAMES)([batch]))
    assert max(p.num_rows for p in parts) <= 7 and pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()


TOK_NAMES, MEN_NAMES = ([c.split()[0] for c in x.split(", ")[2:]] for x in (TOK, MEN))
PAIR_NAMES = [c.split()[0] for c in dependency.PAIR.split(", ")]


def test_events_shuffle_once(spark):
    df = spark.createDataFrame([(1, 0, "A", "acquire", "B"), (1, 1, None, "acquire", "B"), (1, 2, None, "acquire_in", "May"), (1, 3, "A", None, "B")], "doc_id long, ord int, subject string, relation string, object string")
    ev, ed = dependency.event_graph(df)
    assert shuffles(ev) == 1 and shuffles(ed) == 1
    assert {(r["source"], r["relation"], r["target"]) for r in ed.collect()} == {("acquire_event_1", "subject", "A"), ("acquire_event_1", "object", "B"), ("acquire_event_2", "subject", None), ("acquire_event_2", "object", "B"), (None, "acquire_in", "May")}


def test_rows_of_mentions_are_not_shuffled(spark):
    s = spark.createDataFrame([(1, 0, "Ann Lee saw Ann and Bo."), (2, 0, ""), (3, 0, "none here"), (4, 0, "Bo met Cy. Di")], "doc_id long, sent_id int, sentence string")
    g = pairs.GazetteerAnnotator()
    rows, flat = g.rows(s), g.mentions(s)
    assert sorted((r["doc_id"], *m) for r in rows.collect() for m in r["ms"]) == sorted((r["doc_id"], r["ord"], r["text"], r["type"], r["start"], r["end"]) for r in flat.collect())
    named = pairs.GazetteerAnnotator(spark.createDataFrame([("Bo", "LOC")], "name string, type string")).rows(s)
    assert {(m["text"], m["type"]) for r in named.collect() for m in r["ms"]} >= {("Bo", "LOC")}
    root = F.transform("ms", lambda x: F.struct(*[x[c].alias(c) for c in ("ord", "text", "type", "start", "end")], x["ord"].alias("root_i")))
    for find, a, b in ((pairs.capped_pairs, rows, flat), (pairs.fallback_pairs, rows.withColumn("ms", root), flat.withColumn("root_i", F.col("ord")))):
        assert shuffles(find(a)) == 0 and shuffles(find(b)) == 1
        assert sorted(find(a).collect()) == sorted(find(b).collect())


def test_annotated_parts(spark, monkeypatch):
    s = spark.createDataFrame([(1, 0, "Ann met Bo-Li on 3 May, twice."), (1, 1, None), (2, 0, ""), (2, 1, "Ann's 2nd")], "doc_id long, sent_id int, sentence string")
    whole = sorted(dependency.annotated(s, dependency.ShapeTagger).collect())
    assert [(r["i"], r["text"], r["lemma"], r["pos"], r["dep"], r["head_i"]) for r in whole if r["doc_id"] == 2] == [(0, "Ann's", "ann's", "PROPN", "ROOT", 0), (1, "2nd", "2nd", "NUM", "ROOT", 1)]
    some = dependency.annotated(s, dependency.ShapeTagger, columns=("pos",))
    assert some.columns == ["doc_id", "sent_id", "i", "pos"] and sorted(some.collect()) == [(r["doc_id"], r["sent_id"], r["i"], r["pos"]) for r in whole]
