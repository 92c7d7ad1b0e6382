"""Text rules as column expressions. Offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.plans.rules import NER_NAMES, PREPOSITIONS


#: Unicode white space.
SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def bare(c: Column) -> Column:
    """As strip, faster for plain columns: values that begin and end with a visible sign of ASCII stay as they are."""
    return F.when(F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~"), c).otherwise(strip(c))


def find(text: Column, needle: Column) -> Column:
    """First place of needle, or null; an empty needle is not found."""
    at = F.instr(text, needle)
    return F.when((F.length(needle) > 0) & (at > 0), at - 1)


def put(text: Column, at: Column, tag: str) -> Column:
    """text with the tag before place `at`; text comes up once, so insertions can follow each other."""
    return F.overlay(text, F.lit(tag), at + 1, F.lit(0))


def mark_entities(text: Column, head: Column, tail: Column) -> Column:
    """Tags with spaces round the first places of head and tail. The later one is tagged first, each by its end, at the places of the plain text;
    overlaps come out as these four insertions make them. Null if one is missing."""
    hs, ts = find(text, head), find(text, tail)
    he, te = hs + F.length(head), ts + F.length(tail)
    a = put(put(put(put(text, te, " [/E2]"), ts, "[E2] "), he, " [/E1]"), hs, "[E1] ")
    b = put(put(put(put(text, he, " [/E1]"), hs, "[E1] "), te, " [/E2]"), ts, "[E2] ")
    return F.when(hs.isNull() | ts.isNull(), None).when(hs <= ts, a).otherwise(b)


def mark_spans(text: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Tags without spaces round two given spans; equal spans give the empty text, and of equal starts the second counts as first."""
    later2 = put(put(put(put(text, e2, "[/E2]"), s2, "[E2]"), e1, "[/E1]"), s1, "[E1]")
    later1 = put(put(put(put(text, e1, "[/E1]"), s1, "[E1]"), e2, "[/E2]"), s2, "[E2]")
    return F.when((s1 == s2) & (e1 == e2), F.lit("")).when(s1 < s2, later2).otherwise(later1)


def mark_checked_spans(text: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Tags without spaces, the later start first; each span must lie within the text as it is then, else the empty text."""

    def tag(t: Column, s: Column, e: Column, k: int) -> Column:
        ok = (s >= 0) & (s < e) & (e <= F.length(t))
        return F.when(F.coalesce(ok, F.lit(False)), put(put(t, e, f"[/E{k}]"), s, f"[E{k}]"))

    return F.coalesce(F.when(s1 >= s2, tag(tag(text, s1, e1, 1), s2, e2, 2)).otherwise(tag(tag(text, s2, e2, 2), s1, e1, 1)), F.lit(""))


def mark_longest_first(text: Column, e1: Column, e2: Column) -> Column:
    """Tags without spaces: the longer name first, the other one where it is found in the tagged text; a missing one stays untagged."""

    def tag(t: Column, name: Column, k: int) -> Column:
        at = find(t, name)
        return F.when(at.isNull(), t).otherwise(put(put(t, at + F.length(name), f"[/E{k}]"), at, f"[E{k}]"))

    return F.when(F.length(e1) >= F.length(e2), tag(tag(text, e1, 1), e2, 2)).otherwise(tag(tag(text, e2, 2), e1, 1))


def mark_ignoring_case(text: Column, head: Column, tail: Column) -> Column:
    """Tags with spaces round the first places in any case, the later first; null if one is missing."""
    low = F.lower(text)
    hs, ts = find(low, F.lower(head)), find(low, F.lower(tail))
    he, te = hs + F.length(head), ts + F.length(tail)
    a = put(put(put(put(text, te, " [/E2]"), ts, "[E2] "), he, " [/E1]"), hs, "[E1] ")
    b = put(put(put(put(text, he, " [/E1]"), hs, "[E1] "), te, " [/E2]"), ts, "[E2] ")
    return F.when(hs.isNull() | ts.isNull(), None).when(hs <= ts, a).otherwise(b)


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 0)


def tokens(text: Column) -> Column:
    """Words (with inner apostrophes or hyphens) and single other signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])"), 1)


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, "’“”", "'\"\"")


def import_type(rel: Column) -> Column:
    """Edge type of the import: stripped, one leading slash off, slashes and hyphens to underscores, upper case."""
    r = bare(rel)
    short = F.when(F.startswith(r, F.lit("/")), F.substring(r, 2, 2**31 - 1)).otherwise(r)
    return F.upper(F.replace(F.replace(short, F.lit("/"), F.lit("_")), F.lit("-"), F.lit("_")))


def graph_type(rel: Column) -> Column:
    """Edge type of the live graph: letters, digits and single underscores, upper case; a leading underscore before a digit, RELATED_TO if empty."""
    t = F.regexp_replace(F.regexp_replace(rel, "^/+|/+$", ""), "[^0-9A-Za-z_]+", "_")
    t = F.upper(F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("RELATED_TO")).when(t.rlike("^[A-Z_]"), t).otherwise(F.concat(F.lit("_"), t))


def llm_graph_type(rel: Column) -> Column:
    """As graph_type, but digits may lead."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(rel, "^/+|/+$", ""), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("RELATED_TO")).otherwise(F.upper(t))


def node_id(kind: Column, name: Column) -> Column:
    k = F.upper(bare(F.coalesce(kind, F.lit(""))))
    return F.concat(F.when(k == "", "UNK").otherwise(k), F.lit(":"), bare(F.coalesce(name, F.lit(""))))


def ner_label(label: Column) -> Column:
    up = F.upper(strip(F.coalesce(label, F.lit(""))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NER_NAMES.items() for x in kv]), up), up)


def preposition(p: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PREPOSITIONS.items() for x in kv]), p), p)


def is_no_relation(label: Column) -> Column:
    low = F.lower(label)
    return low.isin("na", "no_relation", "n/a", "none") | low.contains("no_relation") | low.endswith("/na")


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
