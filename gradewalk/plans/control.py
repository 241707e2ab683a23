"""The control run: the same model on an open network and open terrain, compared with another grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewalk.config import DEFAULT, Model
from gradewalk.functions.geo import cell, cell_centre, mercator_pixel, project
from gradewalk.operators import hbi, joins, network, raster
from gradewalk.operators.tables import save

STATION_SNAP_M = 300.0


def open_network(lines: DataFrame, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of lines (line_id, points in degrees): each vertex pair is cut on its own, ends are not noded."""

    def moved(p):
        x, y = project(p["x"], p["y"], 4326)
        return F.struct(x.alias("x"), y.alias("y"))

    seg = network.segments_of(lines.select("line_id", F.transform("points", moved).alias("points")))
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    pieces = network.segmentize(seg.select("line_id", "seg", F.array(corner("x0", "y0"), corner("x1", "y1")).alias("points")), m)
    nodes, links = network.merge_nodes(pieces.drop("line_id", "seg", "k"), m)
    links = links.select("u", "v", "length", F.lit(False).alias("is_stair"), F.lit(False).alias("flat"))
    return network.keep_large(save(nodes, "nodes"), save(links, "links"), m)


def terrain(nodes: DataFrame, pixels: DataFrame, zoom: int = 15) -> DataFrame:
    """nodes with z from global terrain pixels (row, col, z), their voids filled first."""
    lon, lat = project(F.col("x"), F.col("y"), 5186, 4326)
    px, py = mercator_pixel(lon, lat, zoom)
    placed = nodes.withColumn("_px", px).withColumn("_py", py)
    return raster.bilinear(placed, "node_id", raster.fill_voids(pixels), (0.0, 0.0), (1.0, 1.0), "_px", "_py").drop("_px", "_py")


def node_grid(nodes: DataFrame, trips: DataFrame, m: Model = DEFAULT, least: int = 5) -> DataFrame:
    """target, cell_x, cell_y, n_nodes, hbi_mean, elder_min, flat_min of cells with enough nodes."""
    total = F.col("go") + F.col("back")
    pick = lambda g: F.max(F.when(F.col("graph") == g, total))
    wide = trips.groupBy("target", "node").agg(pick("elder").alias("e"), pick("flat").alias("f"))
    rows = wide.join(nodes.select(F.col("node_id").alias("node"), "x", "y"), "node").withColumn("hbi", hbi.ratio(F.col("e"), F.col("f"))).filter("hbi IS NOT NULL")
    cells = rows.groupBy("target", cell(F.col("x"), m.grid_m).alias("gx"), cell(F.col("y"), m.grid_m).alias("gy")).agg(F.count("*").alias("n_nodes"), F.avg("hbi").alias("hbi_mean"), (F.percentile("e", F.lit(0.5)) / 60).alias("elder_min"), (F.percentile("f", F.lit(0.5)) / 60).alias("flat_min"))
    return cells.filter(F.col("n_nodes") >= least).select("target", cell_centre(F.col("gx"), m.grid_m).alias("cell_x"), cell_centre(F.col("gy"), m.grid_m).alias("cell_y"), "n_nodes", "hbi_mean", "elder_min", "flat_min")


def run(lines: DataFrame, stations: DataFrame, pixels: DataFrame, other_grid: DataFrame | None = None, m: Model = DEFAULT) -> tuple[DataFrame, DataFrame | None]:
    """(grid, comparison with other_grid). stations: id, x, y, target."""
    nodes, links = open_network(lines, m)
    nodes = save(terrain(nodes.filter("kept"), pixels), "nodes")
    dests = hbi.destination_nodes(stations, nodes, m.but(dest_snap_m=STATION_SNAP_M))
    edges = hbi.weights(hbi.sloped(nodes, links, m), m, ("elder", "flat"))
    grid = save(node_grid(nodes, hbi.round_trips(edges, dests), m), "control-grid")
    return grid, None if other_grid is None else joins.compare_grids(other_grid, grid, m)
