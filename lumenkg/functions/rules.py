"""Validation rules of triplets and entities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenkg.functions.text import contains_ignoring_space, effective_length

#: Relations a triplet may have, names that mean one of them, and verbs a description may state.
RELATIONS = ("belong_to", "part_of", "depend_on", "synonym_of", "related_with", "property_of")
SYNONYMS = {
    "is_a": "belong_to", "isa": "belong_to", "instance_of": "belong_to", "subclass_of": "belong_to", "belongs_to": "belong_to",
    "has_part": "part_of", "contains": "part_of", "component_of": "part_of", "requires": "depend_on", "depends_on": "depend_on",
    "prerequisite_of": "depend_on", "same_as": "synonym_of", "alias_of": "synonym_of", "equivalent_to": "synonym_of",
    "related_to": "related_with", "associated_with": "related_with", "has_property": "property_of", "attribute_of": "property_of",
}


def bad_entity(c: Column) -> Column:
    """Empty, one character of the alphabet or a digit, a label ending in a colon, a formula application, a lone symbol."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | t.rlike("^[A-Za-z0-9]$") | t.rlike("[:：]$") | t.rlike(r"^[A-Za-z]\w*\([^)]*\)$") | t.rlike(r"^[=+\-*/<>^|&~]+$")


def placeholder_entity(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(r"^([a-z](\s*[,，、]\s*[a-z])+|\.\.\.|x|n/?a|none|null)$")


def overly_specific(c: Column) -> Column:
    """A numbered theorem, example, figure or chapter."""
    return F.lower(c).rlike(r"^(theorem|lemma|example|figure|table|chapter|section|定理|引理|例|图|表|第)\s*[0-9]+")


def normal_relation(c: Column) -> Column:
    """Lower case with underscores, synonyms replaced."""
    base = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])[base], base)


def statement(subject: Column, phrase: Column, object_: Column, forward: Column) -> Column:
    """The sentence of a triplet: a slot sign in the phrase takes the object, and direction decides who comes first."""
    a, b = F.when(forward, subject).otherwise(object_), F.when(forward, object_).otherwise(subject)
    return F.when(phrase.contains("…"), F.concat(a, F.replace(phrase, F.lit("…"), b))).otherwise(F.concat(a, phrase, b))


def first_failure(t: dict[str, Column], longest: int = 8) -> Column:
    """The first rule a triplet breaks, or null: t has subject, object, relation, phrase, direction, context, source."""
    rules = [
        ("bad_entity", bad_entity(t["subject"]) | bad_entity(t["object"])),
        ("placeholder", placeholder_entity(t["subject"]) | placeholder_entity(t["object"])),
        ("overly_specific", overly_specific(t["subject"]) | overly_specific(t["object"])),
        ("self_loop", t["subject"] == t["object"]),
        ("missing_relation", ~F.coalesce(t["relation"], F.lit("")).isin(*RELATIONS)),
        ("concrete_empty", F.trim(F.coalesce(t["phrase"], F.lit(""))) == ""),
        ("concrete_too_long", effective_length(t["phrase"]) > longest),
        ("concrete_is_sentence", t["phrase"].rlike("[。.!?！？]$")),
        ("bad_direction", ~F.coalesce(t["direction"], F.lit("")).isin("subject_to_object", "object_to_subject")),
        ("context_not_in_source", ~contains_ignoring_space(t["source"], t["context"])),
    ]
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])


def weak_alias(c: Column) -> Column:
    """Shorter than two characters, or digits and punctuation only."""
    t = F.trim(c)
    return (F.length(t) < 2) | t.rlike(r"^[\d\W_]+$")
