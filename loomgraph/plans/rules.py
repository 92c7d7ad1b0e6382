"""Rule tables. All have a fixed number of rows, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Relations, their type signatures, thresholds, triggers, templates, export rules and direction rules.
SIGNATURES = {
    "/business/company/place_founded": [("ORG", "GPE"), ("ORG", "LOC")],
    "/business/company/founders": [("ORG", "PERSON")],
    "/business/company/major_shareholders": [("ORG", "PERSON"), ("ORG", "ORG")],
    "/business/company_shareholder/major_shareholder_of": [("PERSON", "ORG"), ("ORG", "ORG")],
    "/business/person/company": [("PERSON", "ORG")],
    "/people/person/place_lived": [("PERSON", "GPE"), ("PERSON", "LOC")],
    "/people/person/place_of_birth": [("PERSON", "GPE"), ("PERSON", "LOC")],
    "/people/deceased_person/place_of_death": [("PERSON", "GPE"), ("PERSON", "LOC")],
    "/people/person/nationality": [("PERSON", "GPE"), ("PERSON", "NORP")],
    "/people/person/children": [("PERSON", "PERSON")],
    "/location/country/capital": [("GPE", "GPE"), ("GPE", "LOC")],
    "/location/administrative_division/country": [("GPE", "GPE"), ("LOC", "GPE")],
    "/location/country/administrative_divisions": [("GPE", "GPE")],
    "/location/location/contains": [("GPE", "GPE"), ("GPE", "LOC"), ("LOC", "LOC"), ("LOC", "GPE")],
    "/location/neighborhood/neighborhood_of": [("GPE", "GPE"), ("LOC", "GPE"), ("GPE", "LOC")],
}
THRESHOLDS = {
    "/location/location/contains": 0.99, "/people/person/place_lived": 0.95, "/people/person/place_of_birth": 0.95,
    "/people/deceased_person/place_of_death": 0.95, "/location/administrative_division/country": 0.95,
    "/location/country/administrative_divisions": 0.95, "/location/country/capital": 0.90, "/business/company/place_founded": 0.90,
    "/business/company/founders": 0.85, "/business/person/company": 0.90, "/people/person/nationality": 0.90,
    "/business/company/major_shareholders": 0.90, "/business/company_shareholder/major_shareholder_of": 0.90, "/people/person/children": 0.95,
}
TRIGGERED = ["/people/person/children", "/business/company/major_shareholders", "/business/company_shareholder/major_shareholder_of"]
TRIGGERS = {
    "/business/company/place_founded": ["founded", "headquartered", "based", "incorporated"],
    "/business/company/founders": ["founded by", "co-founded", "founder", "cofounder"],
    "/business/person/company": ["works at", "joined", "ceo", "executive", "employee", "employed", "president"],
    "/business/company/major_shareholders": ["major shareholder", "major shareholders", "stake", "owns", "ownership"],
    "/business/company_shareholder/major_shareholder_of": ["major shareholder", "stake", "owns", "ownership"],
    "/location/country/capital": ["capital"],
    "/people/person/place_of_birth": ["born"],
    "/people/person/place_lived": ["lives in", "lived in", "resides in", "resident", "moved to"],
    "/people/person/nationality": ["nationality", "citizen", "citizenship"],
    "/people/person/children": ["son", "daughter", "child", "children", "father", "mother", "parents"],
}
TEMPLATES = {
    "/business/company/place_founded": "{h} was founded in {t}.",
    "/business/company/founders": "{t} founded {h}.",
    "/business/person/company": "{h} is associated with the company {t}.",
    "/business/company/major_shareholders": "{t} is a major shareholder of {h}.",
    "/business/company_shareholder/major_shareholder_of": "{h} is a major shareholder of {t}.",
    "/location/location/contains": "{h} contains {t}.",
    "/location/neighborhood/neighborhood_of": "{h} is a neighborhood of {t}.",
    "/location/country/capital": "{t} is the capital of {h}.",
    "/location/administrative_division/country": "{h} is in the country {t}.",
    "/location/country/administrative_divisions": "{t} is an administrative division of {h}.",
    "/people/person/place_lived": "{h} has lived in {t}.",
    "/people/person/place_of_birth": "{h} was born in {t}.",
    "/people/deceased_person/place_of_death": "{h} died in {t}.",
    "/people/person/nationality": "{h} has nationality {t}.",
    "/people/person/children": "{t} is a child of {h}.",
}
GENERIC_TEMPLATE = "{h} has relation {r} with {t}."
EXPORT = {  # head types, tail types, least confidence; all forward
    "/business/company/place_founded": (["ORG"], ["GPE", "LOC"], 0.8),
    "/business/company/founders": (["ORG"], ["PERSON"], 0.8),
    "/business/person/company": (["PERSON"], ["ORG"], 0.8),
    "/business/company/major_shareholders": (["ORG"], ["PERSON", "ORG"], 0.8),
    "/business/company_shareholder/major_shareholder_of": (["PERSON", "ORG"], ["ORG"], 0.8),
    "/people/person/place_lived": (["PERSON"], ["GPE", "LOC"], 0.8),
    "/people/person/place_of_birth": (["PERSON"], ["GPE", "LOC"], 0.8),
    "/people/deceased_person/place_of_death": (["PERSON"], ["GPE", "LOC"], 0.8),
    "/location/country/capital": (["GPE", "LOC"], ["GPE", "LOC"], 0.8),
    "/location/location/contains": (["GPE", "LOC"], ["GPE", "LOC"], 0.9),
}
DIRECTION = {  # head types, tail types, whether a reversed pair is turned
    "/location/location/contains": (["GPE", "LOC", "FAC"], ["GPE", "LOC", "FAC"], False),
    "/location/neighborhood/neighborhood_of": (["GPE", "LOC"], ["GPE", "LOC"], False),
    "/location/administrative_division/country": (["GPE", "LOC"], ["GPE", "LOC"], True),
    "/location/country/capital": (["GPE", "LOC"], ["GPE", "LOC"], True),
    "/people/person/place_of_birth": (["PERSON"], ["GPE", "LOC"], True),
    "/people/person/place_lived": (["PERSON"], ["GPE", "LOC"], True),
    "/people/deceased_person/place_of_death": (["PERSON"], ["GPE", "LOC"], True),
    "/people/person/nationality": (["PERSON"], ["NORP", "GPE", "LOC"], True),
    "/business/person/company": (["PERSON"], ["ORG"], True),
    "/business/company/founders": (["ORG"], ["PERSON"], True),
    "/business/company/place_founded": (["ORG"], ["GPE", "LOC"], True),
    "/business/company/major_shareholders": (["ORG"], ["PERSON", "ORG"], True),
    "/business/company_shareholder/major_shareholder_of": (["PERSON", "ORG"], ["ORG"], True),
}
PAIR_TYPES = [("ORG", x) for x in ("GPE", "LOC", "FAC", "PERSON")] + [("PERSON", x) for x in ("ORG", "GPE", "LOC", "FAC")] + [(x, y) for x in ("GPE", "LOC", "FAC") for y in ("GPE", "LOC", "FAC")]
LLM_RELATIONS = [
    "/location/location/contains", "/location/administrative_division/country", "/people/person/nationality", "/people/person/place_lived",
    "/business/person/company", "/location/neighborhood/neighborhood_of", "/people/person/place_of_birth", "/people/deceased_person/place_of_death",
    "/business/company/founders", "/location/country/administrative_divisions", "/location/country/capital", "/people/person/children",
    "/business/company/place_founded", "/business/company/major_shareholders", "/business/company_shareholder/major_shareholder_of",
    "/business/company/advisors", "/people/ethnicity/geographic_distribution", "/sports/sports_team_location/teams", "/sports/sports_team/location",
]
LLM_TYPES = ["PERSON", "ORG", "GPE", "LOC", "NORP", "FAC", "OTHER"]
NER_LABELS = ["PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "DATE", "TIME", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL"]
NER_NAMES = {"PER": "PERSON", "ORG": "ORG", "LOC": "LOC", "MISC": "MISC", "ORGANIZATION": "ORG", "LOCATION": "LOC"}
PREPOSITIONS = {"at": "in", "in": "in", "on": "on", "of": "of", "for": "for", "from": "from", "to": "to", "by": "by", "with": "with"}
EVENT_VERBS = ["acquire", "buy", "purchase", "merge", "acquisition"]
ENTITY_TYPES = ["PERSON", "ORG", "GPE", "LOC"]
FALLBACK, FALLBACK_EXTRA, FALLBACK_MOST, FALLBACK_DISTANCE = "P0_fallback_window", 0.03, 0.999, 18


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, h, t) for r, s in SIGNATURES.items() for h, t in s], "relation string, head_type string, tail_type string")


def thresholds(spark: SparkSession, values: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((THRESHOLDS if values is None else values).items()), "relation string, threshold double")


def triggers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t, r in TRIGGERED) for r, t in TRIGGERS.items()], "relation string, triggers array<string>, needs_trigger boolean")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "relation string, template string")


def export_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, h, t, "forward", c) for r, (h, t, c) in EXPORT.items()], "relation string, head_types array<string>, tail_types array<string>, direction string, min_conf double")


def direction_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, h, t, f) for r, (h, t, f) in DIRECTION.items()], "relation string, head_types array<string>, tail_types array<string>, allow_flip boolean")


def pair_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIR_TYPES, "head_type string, tail_type string")
