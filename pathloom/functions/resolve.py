"""Labels and relationships out of open attribute bags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute names in order of precedence, and those that never stand in for them.
LABELS = ("name", "label", "title", "display_name", "text", "value")
NOT_LABELS = ("id", "type", "category", "color", "shape", "tier")
RELATIONSHIPS = ("label", "relationship_type", "relationship", "rel", "type", "edge_type", "connection_type", "relation", "predicate")
NOT_RELATIONSHIPS = ("id", "color", "weight", "reasoning")
DEFAULT_RELATIONSHIP = "RELATED_TO"


def value(attrs: Column, key: str) -> Column:
    """The last value under that key, or null."""
    return F.try_element_at(F.filter(attrs, lambda p: p.key == key), F.lit(-1))["value"]


def _truthy(p: Column) -> Column:
    number = p.type.isin("int", "long", "float", "double")
    return F.when(p.value.isNull() | (p.value == ""), False).when(number, ~p.value.rlike(r"^[+-]?0*\.?0*(?:[eE].*)?$")).when(p.type == "boolean", ~F.lower(p.value).isin("false", "0")).otherwise(True)


def _first_of(attrs: Column, keys: tuple[str, ...]) -> Column:
    """The truthy value under the first of the keys that has one, of several the last: one pass over the bag."""
    order = F.array(*map(F.lit, keys))
    good = F.filter(attrs, lambda p: p.key.isin(*keys) & _truthy(p))
    return F.array_min(F.transform(good, lambda p, i: F.struct(F.array_position(order, p.key).alias("k"), (-i).alias("i"), p.value.alias("v"))))["v"]


def _first_other(attrs: Column, never: tuple[str, ...]) -> Column:
    found = F.filter(attrs, lambda p: (p.type == "string") & p.value.isNotNull() & (p.value != "") & ~p.key.isin(*never))
    return F.get(found, F.lit(0))["value"]


def node_label(attrs: Column, node_id: Column) -> Column:
    """The first present of the label names, else the first other text in the bag, else the id."""
    return F.coalesce(_first_of(attrs, LABELS), _first_other(attrs, NOT_LABELS), node_id)


def edge_relationship(attrs: Column) -> Column:
    return F.coalesce(_first_of(attrs, RELATIONSHIPS), _first_other(attrs, NOT_RELATIONSHIPS), F.lit(DEFAULT_RELATIONSHIP))


def node_description(attrs: Column) -> Column:
    """`description` where the bag has that key, even if empty, else `desc`, else nothing."""
    has = F.exists(attrs, lambda p: p.key == "description")
    return F.when(has, F.coalesce(value(attrs, "description"), F.lit(""))).otherwise(F.coalesce(value(attrs, "desc"), F.lit("")))


def edge_reasoning(attrs: Column) -> Column:
    return F.coalesce(value(attrs, "reasoning"), F.lit(""))
