"""Rule tables: shapes, units and vocabularies as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
BOUNDARY = "()[]{}\"'.,;:!?"
DESIGNATION_SHAPES = (
    "^[A-Z]{1,4}[0-9]{1,4}$",
    "^[0-9]{2,3}-[A-Z]{1,3}[0-9]{1,3}$",
    "^[+-][A-Z]{1,3}[0-9]{1,3}(-[A-Z]{1,3}[0-9]{1,3})?$",
    "^-[A-Z]{1,4}[0-9]{0,4}$",
    "^-[A-Z]{1,4}[0-9]{0,4}[.][A-Z]{1,4}[0-9]{0,4}$",
)
STANDALONE_LOCATION = "^[+][A-Z]{1,8}[0-9]{0,4}$"
COMPOUND = "^([+][A-Z]{1,3}[0-9]{1,3})(-[A-Z]{1,3}[0-9]{1,3})$"
NUMBER = "^[0-9]+([.,][0-9]+)*$"
NUMBER_WITH_UNIT = "^([0-9]+(?:[.,][0-9]+)*)([A-Za-zÂ²³µΩ]+[²³]?)$"
UNITS = (
    ("V", "voltage_value", ("V", "v", "Volt", "volt", "VOLT"), None, None),
    ("kV", "voltage_value", ("kV", "KV", "kv"), "V", 1000),
    ("A", "current_value", ("A", "Ampere", "ampere", "AMPERE"), None, None),
    ("kA", "current_value", ("kA", "KA", "ka"), "A", 1000),
    ("VA", "power_value", ("VA", "va"), None, None),
    ("kVA", "power_value", ("kVA", "KVA", "kva"), "VA", 1000),
    ("MVA", "power_value", ("MVA", "Mva", "mva"), "VA", 1000000),
    ("mm²", "cable_section_value", ("mm²", "mm2", "MM²", "MM2"), None, None),
)
RULE_VERSIONS = {"designation_generic": "2.0", "location_aspect_iec_81346": "2.0", "voltage_value": "1.0", "current_value": "1.0", "power_value": "1.0", "cable_section_value": "1.0"}
NODE_KINDS = (("equipment_designation", "engineering_asset"), ("engineering_quantity", "engineering_quantity"), ("structural_location", "structural_location"))
EDGE_KINDS = (("has_rated_power", "engineering_asset", "engineering_quantity"), ("is_located_in", "engineering_asset", "structural_location"))
REASONS = (
    ("approved", ("confirmed_by_source", "consistent_with_design", "engineering_exception", "other")),
    ("rejected", ("incorrect_interpretation", "insufficient_evidence", "pipeline_limitation", "documentation_issue", "other")),
    ("needs_investigation", ("ambiguous_evidence", "insufficient_evidence", "pipeline_limitation", "documentation_issue", "other")),
)


def unit_of(variant: Column) -> Column:
    """unit, quantity_type, base_unit and scale of a written unit, null if it is none: a literal map of under 30 entries."""
    text = lambda x: F.lit(x).cast("string")
    entries = [(F.lit(v), F.struct(text(symbol).alias("unit"), text(kind).alias("quantity_type"), text(base).alias("base_unit"), F.lit(scale).cast("long").alias("scale"))) for symbol, kind, variants, base, scale in UNITS for v in variants]
    return F.create_map(*(x for pair in entries for x in pair))[variant]


def matches_any(text: Column, shapes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(s) for s in shapes))


def is_designation(text: Column) -> Column:
    return matches_any(text, DESIGNATION_SHAPES) & ~text.rlike(STANDALONE_LOCATION)


def location_of(text: Column) -> Column:
    """The location part of a compound, a standalone location whole, else null."""
    return F.when(text.rlike(COMPOUND), F.regexp_extract(text, COMPOUND, 1)).when(text.rlike(STANDALONE_LOCATION), text)
