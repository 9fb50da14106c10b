"""Joins on the sphere: points, point sets, boxes and lines."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions import geo, lines, regions
from entitylink.functions.common import once
from entitylink.operators.editjoin import key_pairs
from entitylink.operators.skew import meet, pair_join, sized
from entitylink.operators.values import folded, unfolded
from entitylink.session import materialize


# Side of the finest cells of the box grid, in degrees.
FINEST = 2.0**-10
# Points of a shape that go along with the keys of its cells; larger shapes are attached to pairs.
CARRIED = 16
# Width of those cells in search radii: wider ones mean fewer copies of a shape and more pairs to test.
WIDE = 3


def max_km(theta: float) -> float:
    """Largest distance with 1/(1 + d) >= theta."""
    return 1 / theta - 1


def _whole(pts: Column) -> Column:
    """Points without a missing coordinate."""
    return F.filter(pts, lambda p: p.lat.isNotNull() & p.lon.isNotNull())


class SphereGrid:
    """Latitude bands as high as the search radius, each cut into longitude cells at
    least as wide as the radius reaches anywhere in the band. Cells wrap at 180; a band
    within reach of a pole is one cell. ``wide``: height and least width in radii."""

    def __init__(self, km: float, wide: int = 1):
        self.radius = math.degrees(km / geo.EARTH_KM) * (1 + 1e-9) + 1e-12
        self.wide = wide
        self.bands = max(1, math.floor(180 / (self.radius * wide)))
        self.height = 180 / self.bands

    def band(self, lat: Column) -> Column:
        b = F.floor((lat + 90) / self.height)
        return F.greatest(F.least(b, F.lit(self.bands - 1)), F.lit(0)).cast("bigint")

    def _reach(self, band: Column) -> Column:
        """Degrees of longitude that the radius reaches at most in a band; 360 close to a pole."""
        lo, hi = band * self.height - 90, (band + 1) * self.height - 90
        steep = F.greatest(F.abs(lo), F.abs(hi))
        sine = F.least(math.sin(math.radians(min(self.radius, 90))) / F.cos(F.radians(F.least(steep, F.lit(89.999)))), F.lit(1.0))
        return F.when(steep + self.radius >= 90, F.lit(360.0)).otherwise(F.degrees(F.asin(sine)))

    def cells(self, band: Column) -> Column:
        """Longitude cells of a band."""
        return F.greatest(F.floor(F.lit(360) / (self._reach(band) * self.wide)), F.lit(1)).cast("bigint")

    def key(self, band: Column, cell: Column) -> Column:
        return F.concat_ws(":", band.cast("string"), cell.cast("string"))

    def _column(self, lon: Column, n: Column) -> Column:
        turned = F.pmod(lon + 180, F.lit(360.0))
        return F.least(F.floor(turned / 360 * n), n - 1).cast("bigint")

    def own(self, points: DataFrame) -> DataFrame:
        """Add to point rows (column p) the key of the cell they lie in."""
        rows = points.withColumn("b", self.band(F.col("p.lat"))).withColumn("n", self.cells(F.col("b")))
        return rows.withColumn("key", self.key(F.col("b"), self._column(F.col("p.lon"), F.col("n")))).drop("b", "n")

    def own_keys(self, pts: Column) -> Column:
        """Keys of the cells that points lie in, as hashes: cells that share one only meet more often."""
        key = lambda p: once(self.band(p.lat), lambda b: F.xxhash64(b, self._column(p.lon, self.cells(b))))
        return F.array_distinct(F.transform(_whole(pts), key))

    def near_keys(self, pts: Column) -> Column:
        """Keys of the cells that a point within the radius of one of the points can lie in."""

        def columns(p: Column, b: Column, n: Column) -> Column:
            at, reach = F.pmod(p.lon + 180, F.lit(360.0)) / 360 * n, self._reach(b) / 360 * n + 1e-6
            # one turn at most
            return F.sequence(F.floor(at - F.least(reach, n / 2)), F.floor(at + F.least(reach, n / 2)))

        def of_band(p: Column, b: Column) -> Column:
            return once(self.cells(b), lambda n: F.transform(columns(p, b, n), lambda c: F.xxhash64(b, F.pmod(c, n))))

        bands = lambda p: F.sequence(self.band(p.lat - self.radius), self.band(p.lat + self.radius))
        keys = F.transform(_whole(pts), lambda p: F.flatten(F.transform(bands(p), lambda b: of_band(p, b))))
        return F.array_distinct(F.flatten(keys))

    def around(self, points: DataFrame) -> DataFrame:
        """Repeat point rows into every cell a point within the radius can lie in."""
        bands = F.sequence(self.band(F.col("p.lat")) - 1, self.band(F.col("p.lat")) + 1)
        rows = points.withColumn("b", F.explode(bands)).where((F.col("b") >= 0) & (F.col("b") < self.bands))
        rows = rows.withColumn("n", self.cells(F.col("b"))).withColumn("c", self._column(F.col("p.lon"), F.col("n")))
        near = F.array_distinct(F.array(*[F.pmod(F.col("c") + d, F.col("n")) for d in (-1, 0, 1)]))
        rows = rows.withColumn("c", F.explode(near))
        return rows.withColumn("key", self.key(F.col("b"), F.col("c"))).drop("b", "n", "c")


def shape_pairs(src: DataFrame, tgt: DataFrame, id_col: str, pts: str, km: float) -> DataFrame:
    """Pairs with some two points in neighbouring cells: (source, target)."""
    grid = SphereGrid(km)
    no_target = F.lit(None).cast(tgt.schema[id_col].dataType).alias("target")
    no_source = F.lit(None).cast(src.schema[id_col].dataType).alias("source")
    s = grid.around(src.select(F.col(id_col).alias("source"), no_target, F.explode(pts).alias("p")))
    t = grid.own(tgt.select(no_source, F.col(id_col).alias("target"), F.explode(pts).alias("p")))
    return key_pairs(s.drop("p").unionByName(t.drop("p")).distinct())


def with_shapes(pairs: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, pts: str) -> DataFrame:
    s = src.select(F.col(id_col).alias("source"), F.col(pts).alias("pts_s"))
    return pairs.join(s, "source").join(tgt.select(F.col(id_col).alias("target"), F.col(pts).alias("pts_t")), "target")


def near_shapes(src: DataFrame, tgt: DataFrame, id_col: str, pts: str, find: tuple[Column, Column], km: float, fits: Callable) -> DataFrame:
    """Pairs with both shapes, each once, that have two of the points ``find`` in neighbouring cells
    and pass ``fits(ball_s, ball_t)``: (source, target, pts_s, pts_t).

    Shapes go to their cells with their points, so a pair is tested where it is found and no
    list of pairs is shuffled. A pair that shares several cells counts in the one of the
    smallest key.
    """
    grid = SphereGrid(km, WIDE)

    def placed(df: DataFrame, id_as: str, x: str, find: Column, keys: Callable) -> DataFrame:
        rows = df.where(F.size(_whole(find)) > 0).select(F.col(id_col).alias(id_as), F.col(pts).alias(f"pts_{x}"), geo.ball(F.col(pts)).alias(f"ball_{x}"), keys(find).alias(f"keys_{x}"))
        rows = materialize(rows, "placed")  # keys and balls are worked out once: a filter on keys would do so again
        return rows.withColumn("key", F.explode(f"keys_{x}"))

    s, t = placed(src, "source", "s", find[0], grid.near_keys), placed(tgt, "target", "t", find[1], grid.own_keys)
    alone = F.size("keys_t") == 1
    home = alone | (F.array_min(F.array_intersect("keys_s", "keys_t")) == F.col("key"))
    return meet(s, t, "key", "source", "target", fits(F.col("ball_s"), F.col("ball_t")) & home).select("source", "target", "pts_s", "pts_t")


def _by_size(src: DataFrame, tgt: DataFrame, pts: str, small: Callable, large: Callable) -> DataFrame:
    """``small(src, tgt)`` for the shapes that are carried and ``large`` for pairs with one that is
    not: it has many points, or one with a missing coordinate."""
    missing = F.exists(pts, lambda p: p.isNull() | p.lat.isNull() | p.lon.isNull())
    over = F.coalesce((F.size(pts) > CARRIED) | missing, F.lit(False))
    s, t = [(df.where(~over), df.where(over)) for df in (src, tgt)]
    out = small(s[0], t[0])
    if not s[1].isEmpty():
        out = out.unionByName(large(s[1], tgt))
    if not t[1].isEmpty():
        out = out.unionByName(large(s[0], t[1]))
    return out


def _scored(pairs: DataFrame, d: Column, km: float) -> DataFrame:
    # a generator: a filter on the distance would be pushed below it and measure twice
    rows = pairs.select("source", "target", F.explode(F.filter(F.array(d), lambda x: x <= km)).alias("d"))
    return rows.select("source", "target", (1 / (1 + F.col("d"))).alias("sim"))


def point_join(src: DataFrame, tgt: DataFrame, id_col: str, point: Column | str, theta: float, kernel: str = "haversine") -> DataFrame:
    """sim = 1/(1 + km). ``kernel='ellipsoid'`` measures on WGS84."""
    point = F.col(point) if isinstance(point, str) else point
    km = max_km(theta)
    src = src.select(id_col, F.array(point).alias("pts"))
    tgt = tgt.select(id_col, F.array(point).alias("pts"))
    # The ellipsoid distance is at most 0.6 % off the sphere's.
    reach = km if kernel == "haversine" else km * 1.006
    pts = F.col("pts")
    pairs = near_shapes(src, tgt, id_col, "pts", (pts, pts), reach, lambda a, b: geo.may_reach("max", a, b, reach))
    p, q = F.get("pts_s", F.lit(0)), F.get("pts_t", F.lit(0))
    d = geo.haversine(p, q) if kernel == "haversine" else geo.ellipsoid(p.lat, p.lon, q.lat, q.lon)
    return _scored(pairs, d, km)


def shape_join(src: DataFrame, tgt: DataFrame, id_col: str, pts: str, theta: float, distance: str | Callable) -> DataFrame:
    """Point-set join by any distance that is never below the smallest point distance,
    or by the distance of the mean points."""
    km = max_km(theta)
    if distance == "mean":  # means can be close where no points are
        mean = [df.select(id_col, geo.mean_point(F.col(pts)).alias("p")) for df in (src, tgt)]
        return point_join(*mean, id_col, "p", theta)
    measure = geo.SET_DISTANCES[distance] if isinstance(distance, str) else distance
    # Hausdorff: every source point has a near target point, so has the first one.
    # The largest distance: all points are near each other, so are the first ones.
    find = [F.slice(pts, 1, 1) if distance in first else F.col(pts) for first in (("hausdorff", "sym_hausdorff", "max"), ("max",))]
    both = distance == "sym_hausdorff"

    def small(src: DataFrame, tgt: DataFrame) -> DataFrame:
        pairs = near_shapes(src, tgt, id_col, pts, find, km, lambda a, b: geo.may_reach(distance, a, b, km))
        few = geo.few_points(distance) if isinstance(distance, str) else measure
        return _scored(pairs, few(F.col("pts_s"), F.col("pts_t")), km)

    def large(src: DataFrame, tgt: DataFrame) -> DataFrame:
        pairs = shape_pairs(src.withColumn(pts, find[0]), tgt.withColumn(pts, find[1]), id_col, pts, km)
        if distance in ("hausdorff", "sym_hausdorff"):
            pairs = _near_outlines(pairs, src, tgt, id_col, pts, km, both)
            return _near_sets(with_shapes(pairs, src, tgt, id_col, pts), km, both)
        return _scored(with_shapes(pairs, src, tgt, id_col, pts), measure(F.col("pts_s"), F.col("pts_t")), km)

    return _by_size(src, tgt, pts, small, large)


def line_join(src: DataFrame, tgt: DataFrame, id_col: str, pts: str, theta: float) -> DataFrame:
    """Lines by continuous Frechet distance. Walks start together and end together, so the first
    points find candidates and the last ones thin them before any line is measured."""
    km = max_km(theta)
    first = F.slice(pts, 1, 1)
    src, tgt = (df.where(F.size(pts) > 0) for df in (src, tgt))
    near = lambda k: geo.haversine(F.element_at("pts_s", k), F.element_at("pts_t", k)) <= km + 1e-6
    d = lines.continuous_frechet(F.col("pts_s"), F.col("pts_t"), km)

    def small(src: DataFrame, tgt: DataFrame) -> DataFrame:
        pairs = near_shapes(src, tgt, id_col, pts, (first, first), km, lambda a, b: near(1) & near(-1))
        return _scored(pairs, d, km)

    def large(src: DataFrame, tgt: DataFrame) -> DataFrame:
        ends = [[df.select(id_col, F.array(F.element_at(pts, k)).alias("e")) for df in (src, tgt)] for k in (1, -1)]
        pairs = with_shapes(shape_pairs(*ends[0], id_col, "e", km), *ends[1], id_col, "e").where(near(1)).select("source", "target")
        return _scored(with_shapes(pairs, src, tgt, id_col, pts), d, km)

    return _by_size(src, tgt, pts, small, large)


def _near_outlines(pairs: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, pts: str, km: float, both: bool) -> DataFrame:
    """Pairs whose outlines leave a Hausdorff distance within ``km``, found before any points are attached."""
    bounds = [df.where(F.size(pts) > 0).select(id_col, geo.outline(F.col(pts)).alias("outline")) for df in (src, tgt)]
    a, b = F.col("pts_s"), F.col("pts_t")
    above = geo.hausdorff_above(a, b)
    above = F.greatest(above, geo.hausdorff_above(b, a)) if both else above
    # a set with missing coordinates may have no bound
    return with_shapes(pairs, *bounds, id_col, "outline").where(F.coalesce(above, F.lit(0.0)) <= km + 1e-6).select("source", "target")


def _near_sets(pairs: DataFrame, km: float, both: bool) -> DataFrame:
    """Pairs by Hausdorff distance, in both directions or from the source: the first point without
    a near one ends a pair."""
    a, b = F.col("pts_s"), F.col("pts_t")
    near = geo.all_near(a, b, km)
    near = near & geo.all_near(b, a, km) if both else near
    d = geo.hausdorff_within(a, b, km)
    d = F.greatest(d, geo.hausdorff_within(b, a, km)) if both else d
    return _scored(pairs.where(near), d, km)


def _levels(box: Column, finest: float) -> Column:
    """Level of a box: the first one whose cells (``finest`` * 2**level degrees) are no smaller
    than it."""
    size = F.greatest(box.lat_hi - box.lat_lo, box.lon_hi - box.lon_lo)
    return F.greatest(F.ceil(F.log2(size / finest)), F.lit(0)).cast("int")


def box_pairs(src: DataFrame, tgt: DataFrame, id_col: str, box: str, finest: float = FINEST, carry: str | None = None) -> DataFrame:
    """Pairs of meeting boxes with both boxes, each once; with column ``carry`` of both sides as
    ``pts_s`` and ``pts_t``.

    Grids of several levels: a box lives at the level of its own size, where it covers at
    most four cells, and visits the coarser levels at which boxes live, at most four cells
    each. So a box makes rows by the number of levels, whatever its extent, and small
    boxes do not pile up in the cells of large ones. Two boxes are paired at the coarser of
    their levels, in the cell of the lower corner of their common part alone.

    A box without extent or smaller than ``finest`` degrees lives at level 0; null boxes
    meet nothing.
    """
    own = _levels(F.col(box), finest).alias("own")
    more = lambda x: [] if carry is None else [F.col(carry).alias(f"pts_{x}")]
    sides = [df.select(F.col(id_col).alias(i), F.col(box).alias(f"b_{x}"), own, *more(x)) for df, i, x in ((src, "source", "s"), (tgt, "target", "t"))]
    lived = sides[0].select("own").unionByName(sides[1].select("own")).where("own is not null")
    lived = lived.agg(F.collect_set("own")).scalar()

    cell = lambda level: F.lit(finest) * F.pow(F.lit(2.0), level)

    def cells(df: DataFrame, b: Column, side: str) -> DataFrame:
        """Rows by cell; a pair meets under role "s" if the source lives at the level, else "t"."""
        rows = df.withColumn("level", lived).withColumn("level", F.explode("level")).where("level >= own")
        lives = F.col("level") == F.col("own")
        # a source that lives here meets all targets; one that visits, those that live here
        s, t = F.lit(0), F.lit(1)
        roles = F.when(lives, F.array(s)).otherwise(F.array(t)) if side == "s" else F.when(lives, F.array(s, t)).otherwise(F.array(s))
        rows = rows.withColumn("role", F.explode(roles)).withColumn("cell", cell(F.col("level")))
        span = lambda lo, hi: F.sequence(F.floor(lo / F.col("cell")), F.floor(hi / F.col("cell")))
        rows = rows.withColumn("r", F.explode(span(b.lat_lo, b.lat_hi))).withColumn("c", F.explode(span(b.lon_lo, b.lon_hi)))
        # a number for the cell: two that share one only meet more often
        rows = rows.withColumn("key", F.xxhash64("role", "level", "r", "c")).withColumnRenamed("own", f"own_{side}")
        return rows.drop("level", "role", "cell", "r", "c")

    a, b = F.col("b_s"), F.col("b_t")
    left, right = cells(sides[0], a, "s"), cells(sides[1], b, "t")
    level = F.greatest("own_s", "own_t")
    corner = [F.floor(F.greatest(getattr(a, x), getattr(b, x)) / cell(level)) for x in ("lat_lo", "lon_lo")]
    home = F.xxhash64((F.col("own_s") < F.col("own_t")).cast("int"), level, *corner) == F.col("key")
    left, right = sized(left, right, "key")
    pairs = pair_join(left, right, "key", "source", "target", "_n_left", "_n_right", geo.box_intersects(a, b) & home)
    return pairs.select("source", "target", "b_s", "b_t", *([] if carry is None else ["pts_s", "pts_t"]))


def topology_join(src: DataFrame, tgt: DataFrame, id_col: str, box: str, relation: str, finest: float = FINEST) -> DataFrame:
    """Pairs of boxes in a relation, sim 1.

    Every relation but ``disjoint`` needs the boxes to meet. Listing the disjoint pairs
    would list nearly all pairs: use ``disjoint_counts``, or ``relate`` on given pairs.
    """
    if relation == "disjoint":
        raise ValueError("disjoint pairs are not listed; see disjoint_counts and relate")
    # equal boxes are one until their pairs are tested; an id may be missing, its struct is not
    src, tgt = (materialize(folded(df.select(F.struct(id_col).alias(id_col), box), id_col, box), "folded") for df in (src, tgt))
    pairs = box_pairs(src, tgt, id_col, box, finest)
    pairs = pairs.where(geo.BOX_RELATIONS[relation](F.col("b_s"), F.col("b_t"))).select("source", "target")
    return unfolded(pairs).select(F.col(f"source.{id_col}").alias("source"), F.col(f"target.{id_col}").alias("target"), F.lit(1.0).alias("sim"))


def disjoint_counts(src: DataFrame, tgt: DataFrame, id_col: str, box: str, finest: float = FINEST) -> DataFrame:
    """(source, disjoint): all targets less the meeting ones."""
    meeting = box_pairs(src, tgt, id_col, box, finest).groupBy("source").agg(F.count("*").alias("n"))
    rows = src.select(F.col(id_col).alias("source")).join(meeting, "source", "left")
    return rows.select("source", (tgt.agg(F.count("*")).scalar() - F.coalesce("n", F.lit(0))).alias("disjoint"))


def relate(links: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, box: str, relation: str) -> DataFrame:
    """Keep the given links whose boxes stand in a relation, ``disjoint`` included."""
    rows = with_shapes(links, src, tgt, id_col, box)
    return rows.where(geo.BOX_RELATIONS[relation](F.col("pts_s"), F.col("pts_t"))).select(*links.columns)


def crossing_lines(src: DataFrame, tgt: DataFrame, id_col: str, pts: str, finest: float = FINEST) -> DataFrame:
    """Lines (point sequences) that cross, sim 1. Candidates: meeting bounding boxes."""
    boxed = [df.select(id_col, geo.bounding_box(F.col(pts)).alias("box")) for df in (src, tgt)]
    pairs = box_pairs(*boxed, id_col, "box", finest).select("source", "target")
    rows = with_shapes(pairs, src, tgt, id_col, pts)
    return rows.where(geo.lines_cross(F.col("pts_s"), F.col("pts_t"))).select("source", "target", F.lit(1.0).alias("sim"))


def region_join(src: DataFrame, tgt: DataFrame, id_col: str, rings: str, relation: str, finest: float = FINEST) -> DataFrame:
    """Pairs of regions (arrays of rings, holes and islands included) in an exact relation,
    sim 1. Candidates: meeting bounding boxes. ``disjoint`` is for given pairs: see
    ``relate_regions``."""
    if relation == "disjoint":
        raise ValueError("disjoint pairs are not listed; see relate_regions")
    return _region_links(src, tgt, id_col, rings, F.flatten(rings), regions.RELATIONS[relation], False, finest)


def line_region_join(lines: DataFrame, areas: DataFrame, id_col: str, shape: str, relation: str = "crosses", finest: float = FINEST) -> DataFrame:
    """Pairs of a line (array of points) and a region (array of rings), both in column
    ``shape``, in a relation of ``regions.LINE_RELATIONS``, sim 1."""
    if relation == "disjoint":
        raise ValueError("disjoint pairs are not listed")
    return _region_links(lines, areas, id_col, shape, F.col(shape), regions.LINE_RELATIONS[relation], True, finest)


def _region_links(src: DataFrame, tgt: DataFrame, id_col: str, shape: str, points: Column, test: Callable, line: bool, finest: float) -> DataFrame:
    """Shapes of few points go to the cells of their boxes, so their pairs are tested where they are found.

    Equal ones among them are one shape until their pairs are tested. Coordinates for the test are
    laid out once for a shape, not for each of its pairs.
    """
    # relations cost far more than the bytes of a row or pair tell: keep as many tasks as shuffles have
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [(src, points, line), (tgt, F.flatten(shape), False)]
    over = [F.coalesce(F.size(points) > CARRIED, F.lit(False)) for _, points, _ in sides]
    small, large = ([df.where(o if many else ~o) for (df, _, _), o in zip(sides, over)] for many in (False, True))

    def boxed(k: int, df: DataFrame) -> DataFrame:
        _, points, line = sides[k]
        missing = F.exists(points, lambda p: p.isNull() | p.lat.isNull() | p.lon.isNull())  # such a shape meets nothing
        return df.where(~missing).select(id_col, geo.bounding_box(points).alias("box"), regions.flat_shape(F.col(shape), line).alias("flat"))

    def tested(rows: DataFrame, flat: bool) -> DataFrame:
        rows = regions.with_relation(rows, "pts_s", "pts_t", line, flat, test)
        return rows.select("source", "target", F.lit(1.0).alias("sim"))

    def of_large(s: DataFrame, t: DataFrame) -> DataFrame:
        pairs = box_pairs(boxed(0, s), boxed(1, t), id_col, "box", finest).select("source", "target").repartition(tasks)
        return tested(with_shapes(pairs, src, tgt, id_col, shape), False)

    a, b = (materialize(regions.with_packed(boxed(k, folded(df, id_col, shape)).repartition(tasks), "flat"), "boxed") for k, df in enumerate(small))
    out = unfolded(tested(box_pairs(a, b, id_col, "box", finest, carry="flat").select("source", "target", "pts_s", "pts_t"), True))
    if not large[0].isEmpty():
        out = out.unionByName(of_large(large[0], tgt))
    if not large[1].isEmpty():
        out = out.unionByName(of_large(small[0], large[1]))
    return out


def relate_regions(links: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, rings: str, relation: str) -> DataFrame:
    """Keep the given links whose regions stand in a relation, ``disjoint`` included."""
    rows = regions.with_relation(with_shapes(links, src, tgt, id_col, rings), "pts_s", "pts_t")
    return rows.where(regions.RELATIONS[relation](F.col("mask"))).select(*links.columns)


def polygon_join(src: DataFrame, tgt: DataFrame, id_col: str, ring: str, relation: str, finest: float = FINEST) -> DataFrame:
    """``region_join`` of polygons given as one ring of points each."""
    src, tgt = (df.select(id_col, F.array(ring).alias(ring)) for df in (src, tgt))
    return region_join(src, tgt, id_col, ring, relation, finest)


def relate_polygons(links: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, ring: str, relation: str) -> DataFrame:
    """``relate_regions`` of polygons given as one ring of points each."""
    src, tgt = (df.select(id_col, F.array(ring).alias(ring)) for df in (src, tgt))
    return relate_regions(links, src, tgt, id_col, ring, relation)
