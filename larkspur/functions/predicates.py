"""Conditions on property values; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(key: str, default=None) -> Column:
    return F.col(key) if default is None else F.coalesce(F.col(key), F.lit(default))


def has(col: Column) -> Column:
    return col.isNotNull()


def property_keys(df: DataFrame, own: Sequence[str] = ("id", "label", "eid", "src", "dst", "type")) -> Column:
    """Names of the properties that a row has, in column order."""
    return F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in df.columns if c not in own]), lambda x: x.isNotNull())


def properties(df: DataFrame, own: Sequence[str] = ("id", "label", "eid", "src", "dst", "type")) -> Column:
    """The properties of a row as a map of strings, without missing ones."""
    pairs = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in df.columns if c not in own]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))


def exact(col: Column, value) -> Column:
    return F.coalesce(col == F.lit(value), F.lit(False))


def exact_any(df: DataFrame, key: str, value) -> Column:
    """A single value that is equal, or an array that holds it."""
    many = isinstance(df.schema[key].dataType, T.ArrayType)
    return F.coalesce(F.array_contains(key, value) if many else F.col(key) == F.lit(value), F.lit(False))


def exact_any_of(df: DataFrame, key: str, values: Sequence) -> Column:
    many = isinstance(df.schema[key].dataType, T.ArrayType)
    return F.coalesce(F.arrays_overlap(key, F.array(*map(F.lit, values))) if many else F.col(key).isin(*values), F.lit(False))


def regex_full(col: Column, pattern: str) -> Column:
    return F.coalesce(col.cast("string").rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def regex_partial(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(col.cast("string").rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def compare(df: DataFrame, key: str, op: str, value) -> Column:
    """< <= = >= >, of any value of an array; values of another kind than `value` compare as strings."""
    kind = df.schema[key].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    alike = isinstance(inner, T.NumericType) == isinstance(value, (int, float)) and isinstance(inner, T.StringType) == isinstance(value, str)

    def one(x: Column) -> Column:
        a, b = (x, F.lit(value)) if alike else (x.cast("string"), F.lit(str(value)))
        return {"<": a < b, "<=": a <= b, "=": a == b, ">=": a >= b, ">": a > b}[op]

    return F.coalesce(F.exists(key, one) if isinstance(kind, T.ArrayType) else one(F.col(key)), F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def property_filter(props: Column, patterns: dict[str, str], ignore_case: bool = False, loose: bool = False) -> Column:
    """Every key pattern has to find a property whose value fits its value pattern; loose patterns fit parts."""
    flag = "(?i)" if ignore_case else ""
    whole = (lambda p: flag + p) if loose else (lambda p: rf"{flag}\A(?:{p})\z")

    def found(k: str, v: str) -> Column:
        return F.exists(F.map_entries(props), lambda e: e["key"].rlike(whole(k)) & e["value"].rlike(whole(v)))

    return all_of(*[found(k, v) for k, v in patterns.items()])


def free_search(id_col: Column, props: Column, pattern: str) -> Column:
    """A full match of the id or of any property value; a pattern that is a number finds the node of that id."""
    return id_col.cast("string").rlike(rf"\A(?:{pattern})\z") | F.exists(F.map_values(props), lambda v: v.rlike(rf"\A(?:{pattern})\z"))


def property_values(df: DataFrame, own: Sequence[str] = ("id", "label", "eid", "src", "dst", "type")) -> Column:
    """The values of the properties that a row has, as strings in column order."""
    return F.filter(F.array(*[F.col(c).cast("string") for c in df.columns if c not in own]), lambda x: x.isNotNull())


def filter_groups(groups: dict[str, Sequence[Column]], any_group: bool = False) -> Column:
    """Conditions in named groups: all of a group, and all groups or any."""
    each = [all_of(*g) for g in groups.values()]
    return any_of(*each) if any_group else all_of(*each)


def as_set(col: Column, many: bool) -> Column:
    """A single value as an array of one, an array without repeats."""
    return F.array_distinct(col) if many else F.when(col.isNotNull(), F.array(col))


EARTH_KM = 6371.0


def chord_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight distance through the earth between two points in degrees."""
    xyz = lambda lat, lon: (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    return EARTH_KM * F.sqrt(sum((a - b) * (a - b) for a, b in zip(xyz(lat1, lon1), xyz(lat2, lon2), strict=True)))


#: XSD datatypes and the SQL types that hold their values.
XSD = {
    "string": "string", "boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "integer": "int", "long": "bigint",
    "float": "float", "double": "double", "decimal": "double", "date": "date", "dateTime": "timestamp", "time": "string", "gYear": "int",
}


#: Digits of XSD dates and times, with a zone or none.
_ZONE = r"(Z|[+-]\d{2}:\d{2})?"


def xsd_value(col: Column, datatype: str) -> Column:
    """A literal in the SQL type of its datatype, null if malformed; unknown datatypes raise.

    A dateTime without a zone is in UTC; of a date or year the zone is left out.
    Booleans are true, false, 1 and 0.
    """
    if datatype not in XSD:
        raise ValueError(f"unknown datatype {datatype}")
    text = F.trim(col.cast("string"))
    if datatype == "dateTime":
        parts = rf"^(-?\d{{4,}}-\d{{2}}-\d{{2}})T(\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?){_ZONE}$"
        zone = F.when(F.regexp_extract(text, parts, 3).isin("", "Z"), "+00:00").otherwise(F.regexp_extract(text, parts, 3))
        return F.when(text.rlike(parts), F.concat(F.regexp_extract(text, parts, 1), F.lit(" "), F.regexp_extract(text, parts, 2), zone).try_cast("timestamp"))
    if datatype == "date":
        return F.when(text.rlike(rf"^-?\d{{4,}}-\d{{2}}-\d{{2}}{_ZONE}$"), F.regexp_extract(text, r"^(-?\d{4,}-\d{2}-\d{2})", 1).try_cast("date"))
    if datatype == "gYear":
        return F.when(text.rlike(rf"^-?\d{{4,}}{_ZONE}$"), F.regexp_extract(text, r"^(-?\d{4,})", 1).try_cast("int"))
    if datatype == "boolean":
        return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
    return col.try_cast(XSD[datatype])


def xsd_literal(col: Column, datatype: str) -> Column:
    """A value as a literal of its datatype; a dateTime is written in the session's zone, with its offset."""
    if datatype == "dateTime":
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssXXX")
    if datatype == "gYear":
        return F.lpad(col.cast("string"), 4, "0")
    return col.cast(XSD[datatype]).cast("string")
