"""Areas: (area_id, lat, lon, half_width_km, half_height_km, angle_deg), rectangles turned clockwise from north.

Also the elevation grid: tile plan and sampling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ridgeline.functions.measures import KM_PER_DEGREE, degrees_per_km_lon
from ridgeline.session import ensure_checkpoint_dir

EDGE_TOLERANCE = 1e-9
TILE = 2048
SHAPE = ("lat", "lon", "half_width_km", "half_height_km", "angle_deg")
SIGNS = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))


def resolve_area(lat: float, lon: float, radius_km: float | None = None, width_km: float | None = None, height_km: float | None = None, angle_deg: float = 0.0) -> dict:
    """Checks one spelling of an area and gives its half extents; the first fault is raised."""
    sized = width_km is not None or height_km is not None
    if (radius_km is not None) == sized:
        raise ValueError("give a radius, or a width and a height")
    if sized and (width_km is None or height_km is None):
        raise ValueError("width and height belong together")
    half_w, half_h = (radius_km, radius_km) if not sized else (width_km / 2, height_km / 2)
    for name, value in (("lat", lat), ("lon", lon), ("width", half_w), ("height", half_h), ("angle", angle_deg)):
        if not math.isfinite(value):
            raise ValueError(f"{name} must be finite")
    if half_w <= 0 or half_h <= 0:
        raise ValueError("extents must be positive")
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError("the centre is not on the globe")
    return {"lat": lat, "lon": lon, "half_width_km": half_w, "half_height_km": half_h, "angle_deg": angle_deg}


def area_km2(half_width: Column, half_height: Column) -> Column:
    return 4 * half_width * half_height


def _corner(sign_x: Column, sign_y: Column) -> tuple[Column, Column]:
    """lon and lat of the corner on these sides of an area."""
    x, y = sign_x * F.col("half_width_km"), sign_y * F.col("half_height_km")
    a = F.radians("angle_deg")
    east, north = x * F.cos(a) + y * F.sin(a), y * F.cos(a) - x * F.sin(a)
    return F.col("lon") + east * degrees_per_km_lon(F.col("lat")), F.col("lat") + north / KM_PER_DEGREE


def corners(areas: DataFrame) -> DataFrame:
    """One row for each corner (corner 0 to 3, counterclockwise from the lower left): lon, lat."""
    signs = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(SIGNS)])
    lon, lat = _corner(F.col("_c.x"), F.col("_c.y"))
    return areas.withColumn("_c", F.explode(signs)).select("area_id", F.col("_c.corner").alias("corner"), lon.alias("lon"), lat.alias("lat"))


def bounding_boxes(areas: DataFrame) -> DataFrame:
    return corners(areas).groupBy("area_id").agg(F.min("lon").alias("left"), F.min("lat").alias("bottom"), F.max("lon").alias("right"), F.max("lat").alias("top"))


def holds(entry: str, lon: Column, lat: Column) -> Column:
    """Whether an entry's rectangle (columns with a prefix) holds a point; the boundary counts."""
    c = lambda x: F.col(f"{entry}{x}")
    east, north = (lon - c("lon")) / degrees_per_km_lon(c("lat")), (lat - c("lat")) * KM_PER_DEGREE
    a = F.radians(c("angle_deg"))
    x, y = east * F.cos(a) - north * F.sin(a), east * F.sin(a) + north * F.cos(a)
    return (F.abs(x) <= c("half_width_km") + EDGE_TOLERANCE) & (F.abs(y) <= c("half_height_km") + EDGE_TOLERANCE)


def _with_corners(areas: DataFrame) -> DataFrame:
    """Areas with their corners as columns lon0, lat0, ..., lon3, lat3."""
    ring = [(k, *_corner(F.lit(x), F.lit(y))) for k, (x, y) in enumerate(SIGNS)]
    return areas.withColumns({f"{name}{k}": c for k, lon, lat in ring for name, c in (("lon", lon), ("lat", lat))})


def _frame(areas: DataFrame, cell_deg: float) -> DataFrame:
    """Areas with the cells of their boxes, and the numbers that the test of a point needs."""
    cell = lambda x: F.floor(x / cell_deg).cast("int")
    spread = lambda name: F.explode(F.sequence(*[cell(edge(*[F.col(f"{name}{k}") for k in range(4)])) for edge in (F.least, F.greatest)]))
    a = F.radians("angle_deg")
    return _with_corners(areas).withColumn("cx", spread("lon")).withColumn("cy", spread("lat")).select(
        "cx", "cy", F.col("area_id").alias("e_id"), F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat"), F.cos(a).alias("e_cos"), F.sin(a).alias("e_sin"),
        (1 / degrees_per_km_lon(F.col("lat"))).alias("e_scale"), (F.col("half_width_km") + EDGE_TOLERANCE).alias("e_w"), (F.col("half_height_km") + EDGE_TOLERANCE).alias("e_h"),
        area_km2(F.col("half_width_km"), F.col("half_height_km")).alias("e_km2"),
    )


def covering(queries: DataFrame, entries: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """(query_id, area_id): the smallest entry that holds all four corners of a query, ties by id.

    Entries of one shape and place are folded to their smallest id, and queries
    of one shape and place are asked once: neither are paired with each other's
    copies. Entries are listed in the degree cells that their boxes touch and
    queries look in the cell of their centre, so the range join is an equi-join
    on cells. Corners are columns, so that the test stays in generated code, and
    the smallest entry combines on the map side.
    """
    cell = lambda x: F.floor(x / cell_deg).cast("int")
    folded = entries.groupBy(*SHAPE).agg(F.min("area_id").alias("area_id"))
    places = _with_corners(queries.select(*SHAPE).distinct()).withColumns({"cx": cell(F.col("lon")), "cy": cell(F.col("lat"))})
    met = places.join(_frame(folded, cell_deg), ["cx", "cy"])
    inside = F.lit(True)
    for k in range(4):
        east, north = (F.col(f"lon{k}") - F.col("e_lon")) * F.col("e_scale"), (F.col(f"lat{k}") - F.col("e_lat")) * KM_PER_DEGREE
        inside &= (F.abs(east * F.col("e_cos") - north * F.col("e_sin")) <= F.col("e_w")) & (F.abs(east * F.col("e_sin") + north * F.col("e_cos")) <= F.col("e_h"))
    best = met.where(inside).groupBy(*SHAPE).agg(F.min(F.struct("e_km2", "e_id")).alias("b")).select(*SHAPE, "b.e_id")
    return queries.select(F.col("area_id").alias("query_id"), *SHAPE).join(best, list(SHAPE)).select("query_id", F.col("e_id").alias("area_id")).distinct()


def planar_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """On a plane whose longitude scale is that of the mean latitude; null where that has none (at a pole)."""
    north = (lat2 - lat1) * KM_PER_DEGREE
    east = (lon2 - lon1) / degrees_per_km_lon((lat1 + lat2) / 2)
    return F.sqrt(north * north + east * east)


def nearest(queries: DataFrame, entries: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """(query_id, area_id, distance_km) of the nearest entry, ties by id.

    A query meets the entries of the nine cells around it, and its best one is
    final if it is nearer than anything outside of them can be; queries without one
    go on with cells of twice the size, at last of the whole globe. Entries at
    one place are folded to their smallest id. A distance that is null is larger
    than any other.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    places = entries.groupBy("lat", "lon").agg(F.min("area_id").alias("area_id")).withColumnsRenamed({"lat": "e_lat", "lon": "e_lon"})
    left = queries.select(F.col("area_id").alias("query_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    done, size = None, cell_deg
    while True:
        last = size >= 360
        cell = lambda x: F.lit(0) if last else F.floor(x / size).cast("int")  # noqa: B023, E731
        around = F.array(F.lit(0)) if last else F.array(F.lit(-1), F.lit(0), F.lit(1))
        listed = places.withColumns({"cx": cell(F.col("e_lon")), "cy": cell(F.col("e_lat"))})
        beside = lambda x: F.explode(F.transform(around, lambda d: cell(F.col(x)) + d))  # noqa: B023, E731
        looks = left.withColumn("cx", beside("q_lon")).withColumn("cy", beside("q_lat"))
        km = planar_distance_km(F.col("q_lat"), F.col("q_lon"), F.col("e_lat"), F.col("e_lon"))
        best = looks.join(listed, ["cx", "cy"]).groupBy("query_id", "q_lat", "q_lon").agg(F.min(F.struct(km.isNull().alias("unknown"), km.alias("distance_km"), "area_id")).alias("b"))
        # Outside of the cells, a place is `size` degrees away in latitude or in longitude.
        safe = F.lit(size * KM_PER_DEGREE) * F.cos(F.radians(F.least(F.lit(90.0), F.abs("q_lat") + size / 2)))
        final = best if last else best.where(~F.col("b.unknown") & (F.col("b.distance_km") < safe))
        found = final.select("query_id", "b.area_id", "b.distance_km").checkpoint()
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        left = left.join(found.select("query_id"), "query_id", "left_anti").checkpoint()
        if left.isEmpty():
            return done
        size *= 2 if size < 8 else 64


def coverage_hint(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, area_id, largest_radius_km) for queries that no entry covers: the nearest entry, and how large a square around
    the query's centre would fit into it. Null unless both are upright squares and some radius fits."""
    missed = queries.join(covering(queries, entries).select(F.col("query_id").alias("area_id")), "area_id", "left_anti")
    square = lambda x: (F.col(f"{x}.angle_deg") == 0) & (F.col(f"{x}.half_width_km") == F.col(f"{x}.half_height_km"))
    q, e = missed.alias("q"), entries.alias("e")
    both = nearest(missed, entries).alias("n").join(q, F.col("n.query_id") == F.col("q.area_id")).join(e, F.col("n.area_id") == F.col("e.area_id"))
    north = F.abs(F.col("q.lat") - F.col("e.lat")) * KM_PER_DEGREE
    east = F.abs(F.col("q.lon") - F.col("e.lon")) / degrees_per_km_lon((F.col("q.lat") + F.col("e.lat")) / 2)
    radius = F.col("e.half_width_km") - F.greatest(north, east)
    return both.select("n.query_id", "n.area_id", F.when(square("q") & square("e") & (radius > 0), radius).alias("largest_radius_km"))


def cache_key(areas: DataFrame, *parts: str) -> DataFrame:
    """(area_id, key): 16 hex digits over the rounded area and other parts."""
    fields = [F.format_string("%.6f", F.bround("lat", 6)), F.format_string("%.6f", F.bround("lon", 6))]
    fields += [F.format_string("%.3f", F.bround(c, 3)) for c in ("half_width_km", "half_height_km", "angle_deg")]
    return areas.select("area_id", F.substring(F.sha2(F.concat_ws("|", *fields, *[F.lit(p) for p in parts]), 256), 1, 16).alias("key"))


def stale_siblings(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Entries that a newer key of the same area, policy and elevation version replaces; others of the area stay."""
    same = ["area_id", "policy", "dem_version"]
    now = current.select(*[F.col(c).alias(f"_now_{c}") for c in (*same, "key")])
    match = entries["key"] != now["_now_key"]
    for c in same:
        match &= entries[c] == now[f"_now_{c}"]
    return entries.join(now, match, "left_semi")


def dem_cache_key(left: Column, bottom: Column, right: Column, top: Column, pixel: Column, *parts: str) -> Column:
    """16 hex digits over a grid's bounds, pixel and other parts (layer, version): equal requests share a download."""
    fields = [F.format_string("%.6f", F.bround(c, 6)) for c in (left, bottom, right, top, pixel)]
    return F.substring(F.sha2(F.concat_ws("|", *fields, *[F.lit(x) for x in parts]), 256), 1, 16)


def bounds_feature(areas: DataFrame) -> DataFrame:
    """(area_id, feature): a GeoJSON polygon with a closed ring of five points."""
    ring = F.array_sort(F.collect_list(F.struct("corner", "lon", "lat")))
    line = F.transform(F.concat(F.col("ring"), F.slice("ring", 1, 1)), lambda p: F.array(p["lon"], p["lat"]))
    rings = corners(areas).groupBy("area_id").agg(ring.alias("ring"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(line).alias("coordinates"))
    return rings.select("area_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"))).alias("feature"))


def tile_plan(grids: DataFrame, tile: int = TILE) -> DataFrame:
    """(grid_id, row0, col0, rows, cols) of blocks that cover each grid (grid_id, width, height)."""
    starts = lambda n: F.explode(F.sequence(F.lit(0), n - 1, F.lit(tile)))
    rows = grids.where("width > 0 and height > 0").withColumn("row0", starts(F.col("height"))).withColumn("col0", starts(F.col("width")))
    return rows.select("grid_id", "row0", "col0", F.least(F.lit(tile), F.col("height") - F.col("row0")).alias("rows"), F.least(F.lit(tile), F.col("width") - F.col("col0")).alias("cols"))


def sample_grid(points: DataFrame, cells: DataFrame, left: float, top: float, width: int, height: int, pixel: float, nodata: float | None = None) -> DataFrame:
    """`points` (lon, lat) with elev of their cell (row, col, elev); outside the half-open grid, or without data, null."""
    col, row = F.floor((F.col("lon") - left) / pixel).cast("int"), F.floor((top - F.col("lat")) / pixel).cast("int")
    placed = points.withColumns({"_row": row, "_col": col})
    inside = F.col("_row").between(0, height - 1) & F.col("_col").between(0, width - 1)
    good = cells.where(~F.isnan("elev")) if nodata is None else cells.where(~F.isnan("elev") & (F.col("elev") != nodata))
    good = good.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "elev")
    return placed.withColumn("_row", F.when(inside, F.col("_row"))).join(good, ["_row", "_col"], "left").drop("_row", "_col")
