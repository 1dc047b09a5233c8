"""Names and classes of map features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes by their names in the feeds.
SAC_SCALE = ["hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]
AERIALWAY = {"cable_car": "CableCar", "gondola": "Gondola", "mixed_lift": "Gondola", "chair_lift": "ChairLift", "goods": "GoodsLift", "zip_line": "GoodsLift"}
RAILWAY = {"funicular": "Funicular", "rack_railway": "CogRailway"}
LIFT_SPEED = {"CableCar": 8.0, "Gondola": 5.0, "ChairLift": 2.5, "DragLift": 2.5, "Funicular": 8.0, "CogRailway": 7.0, "GoodsLift": 1.0}
BOARDING_S = 180.0
OBSTACLES = {"CATENARY": "Catenary", "CRANE": "Crane", "ANTENNA": "Antenna", "TOWER": "Tower", "WIND_TURBINE": "WindTurbine", "WINDTURBINE": "WindTurbine", "BUILDING": "Building", "CHIMNEY": "Chimney"}
SEVERITY = {"Wildruhezone": "High", "HuntingReserve": "Critical", "NationalPark": "High", "AirspaceCtr": "Critical", "AirspaceTma": "Medium", "Airport": "Critical", "NatureReserve": "Medium", "Other": "Low"}
AERODROMES = ["public", "international", "regional", "military"]


def _lookup(value: Column, table: dict) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out


def sac_of(name: Column) -> Column:
    """T1 to T6 from an OSM name or a T-code, else NULL."""
    return F.coalesce(_lookup(name, {x: f"T{k}" for k, x in enumerate(SAC_SCALE, 1)}), F.when(name.rlike("^T[1-6]$"), name))


def sac_regex(least: int) -> str:
    return "^(" + "|".join(SAC_SCALE[least - 1 :]) + ")$"


def lift_kind(aerialway: Column, railway: Column, rack: Column) -> Column:
    """The aerialway decides where there is one, even if it is none of ours."""
    cog = railway.isin("narrow_gauge", "rail") & rack.isNotNull()
    rail = F.coalesce(_lookup(railway, RAILWAY), F.when(cog, F.lit("CogRailway")))
    return F.when(aerialway.isNotNull(), _lookup(aerialway, AERIALWAY)).otherwise(rail)


def lift_seconds(kind: Column, length_m: Column) -> Column:
    return length_m / _lookup(kind, LIFT_SPEED) + BOARDING_S


def human_transport(kind: Column) -> Column:
    """Whether people ride the lift."""
    return kind != "GoodsLift"


def obstacle_kind(name: Column) -> Column:
    return F.coalesce(_lookup(name, OBSTACLES), F.lit("Other"))


def severity(kind: Column) -> Column:
    return _lookup(kind, SEVERITY)


def restriction_kind(tags: Column) -> Column:
    """Class of a tagged area, NULL for aerodromes that don't count."""
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    counts = F.when(tag("aerodrome:type").isNotNull(), tag("aerodrome:type").isin(AERODROMES)).otherwise(tag("iata").isNotNull() | tag("icao").isNotNull())
    wildlife = F.coalesce(F.lower(tag("name")).contains("wildruhe"), F.lit(False)) | F.coalesce(tag("protect_class").isin("4", "24"), F.lit(False))
    protected = F.coalesce(tag("boundary") == "protected_area", F.lit(False)) | F.coalesce(tag("leisure") == "nature_reserve", F.lit(False))
    return F.when(tag("aeroway") == "aerodrome", F.when(counts, "Airport")).when(protected, F.when(wildlife, "Wildruhezone").otherwise("NatureReserve")).otherwise("Other")


def attribute(properties: Column, attributes: Column, key: str) -> Column:
    """A string attribute of a JSON feature, from its properties or else its attributes; other types don't count."""
    def text(doc: Column) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant")) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))

    return F.coalesce(text(properties), text(attributes))
