"""The stages of a full run, from layers to tables for export.

Each stage takes and gives DataFrames; `write` puts the tables of a stage under a folder. Rows of single buildings stay
in `work`; `output` holds suppressed roll-ups only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.config import CODES, DEFAULT, Model
from gradewalk.functions import text
from gradewalk.operators import hbi, network, raster, spatial
from gradewalk.operators.stats import quantiles
from gradewalk.operators.tables import save


@dataclass
class Layers:
    """Inputs of a run in working coordinates. lines: line_id, points. Polygons: ordinal, rings, envelope columns."""

    lines: DataFrame
    stairs: DataFrame
    level: DataFrame
    buildings: DataFrame
    stops: DataFrame
    pixels: DataFrame
    origin: tuple[float, float]
    pixel_m: float
    covers: DataFrame | None = None
    pharmacies: DataFrame | None = None
    fine_pixels: DataFrame | None = None
    fine_pixel_m: float = 1.0
    extra: dict = field(default_factory=dict)


def elevated(nodes: DataFrame, pixels: DataFrame, origin: tuple[float, float], size: float) -> DataFrame:
    """nodes with z."""
    return raster.bilinear(nodes.drop("z"), "node_id", pixels.withColumn("z", raster.valid(F.col("z"))), origin, (size, -size))


def network_stage(layers: Layers, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes with z of kept components, links)."""
    nodes, links = network.build(layers.lines, layers.stairs, layers.level, m)
    return save(elevated(nodes.filter("kept"), layers.pixels, layers.origin, layers.pixel_m), "nodes"), save(links, "links")


def homes_and_destinations(layers: Layers, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(homes, destinations): medical ones are clinics and pharmacies, pharmacies are a target of their own too."""
    b = layers.buildings
    homes = b.filter(text.is_home(F.col("use_code"), F.col("kind"), CODES.residential_use, CODES.residential_kind))
    floors = text.floors(F.col("floor_text"))
    homes = homes.select("id", "x", "y", floors.alias("floors"), "area", (floors * F.col("area")).alias("weight"))
    if layers.covers is None:
        homes = homes.withColumn("edge", F.lit(False))
    else:
        homes = spatial.edge_flag(homes, "id", layers.covers, m.edge_buffer_m, m.edge_cell_m)
    use = F.upper(F.coalesce("use_code", F.lit("")))
    of = lambda codes, target: b.filter(use.isin(*codes)).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("id"), "x", "y", F.lit(target).alias("target"))
    dests = of(CODES.medical_use, "medical").unionAll(of(CODES.elderly_use, "elderly")).unionAll(layers.stops.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), "x", "y", "target"))
    if layers.pharmacies is not None:
        for target in ("medical", "pharmacy"):
            dests = dests.unionAll(layers.pharmacies.select(F.concat(F.lit(target), F.col("id").cast("string")).alias("id"), "x", "y", F.lit(target).alias("target")))
    return homes, dests


def index_stage(layers: Layers, nodes: DataFrame, links: DataFrame, m: Model = DEFAULT) -> DataFrame:
    """The long building table: one row for each home and target; with a second height model also hbi_dem1."""
    homes, dests = homes_and_destinations(layers, m)
    components = nodes.select("node_id", "comp") if "comp" in nodes.columns else None
    rows = save(hbi.run(nodes, links, homes, dests, m, components=components), "homes")
    free = hbi.round_trips(hbi.weights(hbi.sloped(nodes, links, m), m, ("wheel",), stairs_passable=True), hbi.destination_nodes(dests, nodes, m))
    rows = rows.join(free.select("target", F.col("node").alias("node_id"), (F.col("go") + F.col("back")).alias("t_wheel_stairok")), ["target", "node_id"], "left")
    if layers.fine_pixels is not None:
        fine = elevated(nodes, layers.fine_pixels, layers.origin, layers.fine_pixel_m)
        trips = hbi.round_trips(hbi.weights(hbi.sloped(fine, links, m), m, ("elder",)), hbi.destination_nodes(dests, nodes, m))
        rows = rows.join(trips.select("target", F.col("node").alias("node_id"), (F.col("go") + F.col("back")).alias("_e")), ["target", "node_id"], "left")
        rows = rows.withColumn("hbi_dem1", hbi.ratio(F.col("_e"), F.col("t_flat"))).drop("_e")  # over the coarse flat time
    return save(rows, "buildings")


def export_stage(rows: DataFrame, parcels: DataFrame | None = None, m: Model = DEFAULT) -> dict[str, DataFrame]:
    """Tables for export, by name."""
    found = {"summary": hbi.summary(rows, m), "grid": hbi.grid(rows, m)}
    if parcels is not None:
        medical = rows.filter("target = 'medical'").drop("target")
        placed = spatial.in_polygons(medical, "id", parcels, "ordinal", spatial.inside_rings(), 100.0)
        own = save(hbi.parcels(placed, m), "parcels")
        found["parcel_by_legal_district"] = hbi.parcels_by_district(own, m)
        plots = F.col("jimok").contains("대")
        wide = own.agg(F.count("*").cast("double").alias("n_parcels"), F.count_if(plots).cast("double").alias("n_plots"), F.try_divide(F.count_if(plots & (F.col("hbi") >= m.band_high)), F.count_if(plots)).alias("share_high"))
        found["parcel_summary"] = wide.unpivot([], wide.columns, "metric", "value")
    return found


def wide_table(rows: DataFrame) -> DataFrame:
    """One row for each home with a column for each target and value; for the sink only."""
    values = [c for c in rows.columns if c not in ("id", "target", "x", "y", "floors", "area", "weight", "edge", "node_id", "snap_d")]
    targets = [r[0] for r in rows.select("target").distinct().orderBy("target").collect()]  # a handful
    keys = [c for c in ("id", "x", "y", "floors", "area", "weight", "edge", "node_id", "snap_d") if c in rows.columns]
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == t, F.col(v))).alias(f"{t}_{v}") for t in targets for v in values])


def checks(nodes_built: int, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of sanity figures: kept nodes, missing heights, snapped homes, median index."""
    z = nodes.agg((F.count("*") / F.lit(nodes_built)).alias("kept_share"), F.avg(F.col("z").isNull().cast("double")).alias("height_missing"))
    h = rows.agg(F.avg(F.col("node_id").isNotNull().cast("double")).alias("snapped_share"))
    middle = quantiles(rows, [], {"hbi_median": ("hbi", 0.5)})
    return z.join(F.broadcast(h), how="cross").join(F.broadcast(middle), how="cross")  # single rows


def write(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
