"""Dimension tables from JSON lines by a specification of columns: a name, a dotted path and a kind each.

A line is parsed once, to a variant; the select list comes from the specification. Kinds: int and float (null where the
value is no number), bool (an absent or null value is false), str and name (cut to 255 and 100 characters; a name that is
an object of languages gives its `en`, or else its first value), json (the value as JSON text) and overflow (the line).
Lines that aren't JSON objects, blank ones apart, are bad: they are left out and can be counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STR_MAX, NAME_MAX = 255, 100
KINDS = ("int", "float", "bool", "str", "name", "json", "overflow")


@dataclass(frozen=True)
class Field:
    name: str
    path: str
    kind: str

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"column {self.name} has kind {self.kind!r}, not one of {', '.join(KINDS)}")


def specification(text: str) -> tuple[Field, ...]:
    """Of "name path kind" lines, or "name kind" where the path is the name; a last column `data` takes the line."""
    words = [line.split() for line in text.strip().splitlines()]
    return (*(Field(w[0], w[-2], w[-1]) for w in words), Field("data", "", "overflow"))


#: Files of the static data export and their columns.
SPECS = {
    "mapRegions.jsonl": specification("""id _key int
        name name
        faction_id factionID int
        nebula_id nebulaID int
        wormhole_class_id wormholeClassID int
        position_x position.x float
        position_y position.y float
        position_z position.z float"""),
    "mapConstellations.jsonl": specification("""id _key int
        name name
        region_id regionID int
        faction_id factionID int
        wormhole_class_id wormholeClassID int
        position_x position.x float
        position_y position.y float
        position_z position.z float"""),
    "mapSolarSystems.jsonl": specification("""id _key int
        name name
        region_id regionID int
        constellation_id constellationID int
        star_id starID int
        security_status securityStatus float
        security_class securityClass str
        hub bool
        border bool
        international bool
        regional bool
        luminosity float
        radius float
        position_x position.x float
        position_y position.y float
        position_z position.z float"""),
}


def _at(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def _value(f: Field) -> Column:
    if f.kind == "overflow":
        return F.trim("value")
    v, at = F.col("__v"), _at(f.path)
    text = F.try_variant_get(v, at, "string")
    if f.kind == "int":
        kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
        whole = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))
        return F.when(kind == "STRING", whole).otherwise(F.try_variant_get(v, at, "bigint"))
    if f.kind == "float":
        return F.try_variant_get(v, at, "double")
    if f.kind == "bool":
        return F.coalesce(~text.isin("false", "0", "", "{}", "[]"), F.lit(False))
    if f.kind == "json":
        return F.to_json(F.try_variant_get(v, at, "variant"))
    if f.kind == "str":
        return F.left(text, F.lit(STR_MAX))
    languages = F.from_json(F.get_json_object("value", at), "map<string, string>")
    is_object = F.startswith(F.schema_of_variant(F.try_variant_get(v, at, "variant")), F.lit("OBJECT"))
    english = F.nullif(F.try_element_at(languages, F.lit("en")), F.lit(""))
    named = F.when(is_object, F.coalesce(english, F.try_element_at(F.map_values(languages), F.lit(1)), F.lit(""))).otherwise(text)
    return F.left(named, F.lit(NAME_MAX))


def _parsed(lines: DataFrame) -> DataFrame:
    parsed = lines.where("trim(value) <> ''").select("value", F.try_parse_json("value").alias("__v"))
    return parsed.withColumn("__ok", F.coalesce(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.lit(False)))


def rows_of(lines: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """The table of a specification, of a column `value` with a JSON text per row."""
    return _parsed(lines).where("__ok").select(*[_value(f).alias(f.name) for f in fields])


def bad_lines(lines: DataFrame) -> DataFrame:
    return _parsed(lines).where("not __ok").select("value")


def load(spark: SparkSession, folder: str, specs: dict[str, tuple[Field, ...]] = SPECS) -> tuple[dict[str, DataFrame], list[str]]:
    """(table of each file that the folder holds, JSON-lines files there without a specification)."""
    found = {p.rsplit("/", 1)[1]: p for p in spark.read.option("pathGlobFilter", "*.jsonl").text(folder).inputFiles()}
    return {name: rows_of(spark.read.text(found[name]), fields) for name, fields in specs.items() if name in found}, sorted(found.keys() - specs.keys())
