from loomgraph.operators import graph

ROWS = "head string, head_type string, relation string, tail string, tail_type string, conf double, ord long, evidence string"


def test_direction(spark):
    df = spark.createDataFrame([("Chad", "GPE", "/people/person/nationality", "Ann", "PERSON"), ("X", "GPE", "/location/location/contains", "Y", "ORG"), ("X", "UNK", "/location/location/contains", "Y", "ORG"), ("X", "GPE", "/made/up", "Y", "ORG")], "head string, head_type string, relation string, tail string, tail_type string")
    got = {(r["head"], r["relation"], r["head_type"]): (r["action"], r["tail"]) for r in graph.gate_direction(df).collect()}
    assert got[("Ann", "/people/person/nationality", "PERSON")] == ("flip", "Chad")
    assert got[("X", "/location/location/contains", "GPE")][0] == "drop"
    assert got[("X", "/location/location/contains", "UNK")][0] == "keep"
    assert got[("X", "/made/up", "GPE")][0] == "keep"


def edges(spark):
    rows = [("A", "ORG", "/r", "B", "GPE", 0.5, 1, "one"), ("A", "ORG", "/r", "B", "GPE", 0.9, 2, ""), ("A", "ORG", "/r", "B", "GPE", 0.7, 3, "three"), ("A", "ORG", "/r", "B", "GPE", 0.7, 4, "four"), ("C", "PERSON", "/r", "A", "PERSON", 0.7, 5, "x")]
    return graph.with_ids(spark.createDataFrame(rows, ROWS))


def test_edges_and_nodes(spark):
    e = edges(spark)
    got = {r["src_id"]: r for r in graph.aggregate_edges(e, evidence_cap=2).collect()}
    assert got["ORG:A"]["evidence"] == "one || three"
    assert (got["ORG:A"]["support_count"], got["ORG:A"]["conf_max"]) == (4, 0.9)
    assert [r["src_id"] for r in graph.aggregate_edges(e, min_support=2).collect()] == ["ORG:A"]
    nodes = {r["id"] for r in graph.node_registry(e).collect()}
    assert nodes == {"ORG:A", "GPE:B", "PERSON:C", "PERSON:A"}
    assert not {x for r in graph.aggregate_edges(e).collect() for x in (r["src_id"], r["dst_id"])} - nodes


def test_live_graph(spark):
    e = edges(spark)
    assert {r["name"]: r["type"] for r in graph.live_nodes(e, "last").collect()}["A"] == "PERSON"
    first = graph.live_nodes(e, "first")
    assert {r["name"]: r["type"] for r in first.collect()}["A"] == "ORG"
    assert graph.unique_names(first)
    assert {(r["head"], r["conf"]) for r in graph.live_edges(e, "first").collect()} == {("A", 0.5), ("C", 0.7)}
    assert {(r["head"], r["conf"]) for r in graph.live_edges(e, "last").collect()} == {("A", 0.7), ("C", 0.7)}


def test_best(spark):
    rows = [("a", "r", "b", 0.99, 1, "P0_fallback_window"), ("a", "r", "b", 0.91, 2, "P1_SVO"), ("a", "r", "b", 0.91, 3, "P2"), ("a", "r", "c", 0.5, 4, "P0_fallback_window_rev")]
    got = {r["tail"]: r["ord"] for r in graph.best_triples(spark.createDataFrame(rows, "head string, relation string, tail string, conf double, ord long, pattern string")).collect()}
    assert got == {"b": 2, "c": 4}


def test_sorts_of_edges_are_led_by_a_hash(spark):
    e = edges(spark)
    plan = graph.aggregate_edges(e, evidence_cap=2)._jdf.queryExecution().sparkPlan().toString()
    assert "Window [row_number() windowspecdefinition(__h" in plan
    assert "__h" not in graph.aggregate_edges(e, evidence_cap=2).columns + graph.aggregate_edges(e).columns
