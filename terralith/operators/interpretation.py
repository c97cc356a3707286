"""Findings and rule cards about a grid result: small projections over its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names and units by which a property is known. Anything else is generic.
PROFILES = [
    ("resistivity", ["rho"], ["ω·m", "ωm", "ohm_m", "ohm·m"]),
    ("microseismic_velocity", ["vx", "vx_km_s"], ["km/s"]),
    ("gas_content", ["ch4", "ch4_content", "gas", "gas_content"], ["ml/g"]),
]
GENERIC = "generic_3d"
CARD = "profile string, direction string, title string, meaning string, impact string, action string, limitation string"
# What a high or low anomaly of a property may mean; generic properties have no cards.
RULES = [
    ("resistivity", "low", "Low resistivity", "often water, fractures, clay or another conductor", "check water and structure here first if other data agree", "compare with boreholes and water records", "low resistivity alone doesn't prove water"),
    ("resistivity", "high", "High resistivity", "often dense or dry rock, or a resistive rock type", "may mark a change of rock or of its water", "compare with rock type and structure", "high resistivity alone doesn't prove sound rock"),
    ("microseismic_velocity", "low", "Low velocity", "often loose, broken or porous ground, or fluids", "look for weak structure here first", "check the cover by survey lines, then rock and boreholes", "says nothing about seismic activity and names no fault"),
    ("microseismic_velocity", "high", "High velocity", "often dense ground, or a change of rock or stress", "helps to tell structures apart", "compare with rock, stress and the survey lines", "fast ground isn't always stable"),
    ("gas_content", "high", "High gas content", "more gas than around, perhaps a local pocket", "measure again first, and check drainage and ventilation", "compare with pressure, drainage and ventilation records", "high within the model is no legal class of danger"),
    ("gas_content", "low", "Low gas content", "less gas than around", "shows how content changes, not that a place is safe", "check the cover by samples and the depth of the holes", "low content isn't safety"),
]
AT_EDGE = "reaches the model's edge, so it may be larger"


def resolve_profile(value_name: str, unit: str) -> str:
    """By the registered names and units only; case, and blanks in the unit, don't count."""
    name, unit = value_name.strip().lower(), unit.strip().lower().replace(" ", "")
    return next((p for p, names, units in PROFILES if name in names and unit in units), GENERIC)


def rule_cards(components: DataFrame, profile: str, most: int = 3) -> DataFrame:
    """The first ``most`` components of each direction with the profile's card. ``components``: direction, rank,
    touches_grid_boundary, ..."""
    rules = components.sparkSession.createDataFrame(RULES, CARD).where(F.col("profile") == profile)
    limits = F.when(F.col("touches_grid_boundary"), F.concat_ws("; ", "limitation", F.lit(AT_EDGE))).otherwise(F.col("limitation"))
    return components.where(F.col("rank") <= most).join(F.broadcast(rules), "direction").withColumn("limitation", limits)


def findings(depth: DataFrame | None, components: DataFrame, model: DataFrame | None = None, has_uncertainty: bool = False) -> DataFrame:
    """(finding, subject, n, label): the depth bin with the largest share of high nodes (the first of equals; none without a
    ``depth`` profile), the component with the largest support (of equals the one with the highest value, then the first; with
    its nodes), how many components touch the boundary (none without one), the ``model`` (candidate, n: one row) with its rows in common, and
    whether there is an uncertainty layer: available, missing, or not_applicable on a flat grid."""
    row = lambda name, subject, n, label=None: [F.lit(name).alias("finding"), subject.cast("long").alias("subject"), n.cast("long").alias("n"), (F.lit(None) if label is None else label).cast("string").alias("label")]
    none = F.lit(None)
    largest = components.orderBy(F.desc("support_measure"), F.desc("value_max"), "component_id").limit(1).select(*row("largest_component", F.col("component_id"), F.col("support_node_count")))
    contact = components.agg(F.count_if("touches_grid_boundary").alias("c")).where("c > 0").select(*row("boundary_contacts", none, F.col("c")))
    layer = "not_applicable" if depth is None else "available" if has_uncertainty else "missing"
    told = components.sparkSession.range(1).select(*row("uncertainty", none, none, F.lit(layer)))
    out = largest.unionByName(contact).unionByName(told)
    if depth is not None:
        out = out.unionByName(depth.where("n > 0").orderBy(F.desc("high_ratio"), "bin").limit(1).select(*row("dominant_depth", F.col("bin"), F.col("n"))))
    return out if model is None else out.unionByName(model.select(*row("model", none, F.col("n"), F.col("candidate"))))


# What a property needs for the analysis made for it; the first two are told by their exact names.
NEEDED = {"resistivity": "value_name=RHO", "microseismic_velocity": "value_name=Vx", "gas_content": "value_name∈{CH4,CH4_content,gas,gas_content}"}
VELOCITY_UNIT, SPACE_ONLY = "value_unit=km/s", "dimension=3d"
GAS_NAMES = ["ch4", "ch4_content", "gas", "gas_content"]


def analysis_profiles(mappings: DataFrame) -> DataFrame:
    """``mappings`` (value_name, value_unit, dimension, ...) with the analysis that fits: ``profile``, ``specialized``, and for
    a generic one ``disabled``: what each special analysis lacks, in their order. Names and units are trimmed, a missing
    dimension is 3d; another one than 3d is generic."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    name, unit, given = blank("value_name"), blank("value_unit"), F.lower(blank("dimension"))
    deep = (given == "3d") | (given == "")
    fits = {"resistivity": name == "RHO", "microseismic_velocity": (name == "Vx") & (unit == "km/s"), "gas_content": F.lower(name).isin(GAS_NAMES)}
    profile = F.lit(GENERIC)
    for k, fit in reversed(fits.items()):
        profile = F.when(deep & fit, k).otherwise(profile)
    lack = lambda k: F.when(fits[k], F.when(~deep, SPACE_ONLY)).when(F.lit(k == "microseismic_velocity") & (name == "Vx"), VELOCITY_UNIT).otherwise(NEEDED[k])
    disabled = F.array(*(F.struct(F.lit(k).alias("profile"), lack(k).alias("missing")) for k in fits))
    return mappings.withColumns({"profile": profile, "specialized": profile != GENERIC, "disabled": F.when(profile == GENERIC, disabled)})
