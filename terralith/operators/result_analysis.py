"""The whole analysis of a grid result, from the parts that exist: every part reads one written grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators import anomalies, grid, interpretation
from terralith.operators.errors import GeoError
from terralith.operators.shared import checkpointed

DEPTH_BINS, MOST_COMPONENTS, LEAST_NODES = 8, 8, 2


def analyze(result: DataFrame, value_name: str, unit: str, flat: bool = False, gates: dict[str, float] | None = None, model: DataFrame | None = None) -> dict[str, DataFrame]:
    """{"grid", "composition", "depth", "components", "cards", "findings"} of a grid. A flat grid has no depth profile; ``model``
    (candidate, n) is what the findings say about it; a grid without valid nodes is rejected."""
    g = checkpointed(result)
    if not grid.valid(g).limit(1).count():
        raise GeoError("RESULT_ANALYSIS_NO_VALID_CELLS")
    out = {"grid": grid.grid_statistics(g), "composition": grid.composition(g), "components": checkpointed(anomalies.ranked_components(g, LEAST_NODES, MOST_COMPONENTS, flat, gates))}
    if not flat:
        out["depth"] = grid.depth_profile(g, DEPTH_BINS)
    out["cards"] = interpretation.rule_cards(out["components"], interpretation.resolve_profile(value_name, unit))
    out["findings"] = interpretation.findings(out.get("depth"), out["components"].where("direction = 'high'"), model, bool(gates))
    return out


def as_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(section, item, metric, value) of all numbers, for one export as JSON lines."""
    keys, out = {"composition": "class", "depth": "bin", "components": "component_id", "findings": "finding"}, None
    for section, df in parts.items():
        if section == "cards":
            continue
        key = keys.get(section)
        numbers = [c for c, kind in df.dtypes if c != key and kind in ("int", "bigint", "double")]
        item = F.col(key).cast("string") if key else F.lit(None).cast("string")
        stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers)))
        part = df.select(F.lit(section).alias("section"), item.alias("item"), stacked.alias("s")).select("section", "item", "s.*")
        out = part if out is None else out.unionByName(part)
    return out


def write_json(parts: dict[str, DataFrame], path: str) -> None:
    as_rows(parts).write.mode("overwrite").json(path)
