"""Entry and exit regions found from tracks alone, for all sites at once.

Ends of whole tracks are put into clusters by k-means for every number of clusters from 2 to 9; the elbow of the spread picks the number.
All sites, both kinds of ends and all numbers of clusters go through the same jobs: an assignment is a join with the few
centres of a site, an update is a sum by cluster. Equal places are summed up first and carry their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtally.sources.sinks import dealt, kept_table

# How ends are taken and how many regions are tried.
END_POINTS, MARGIN, LEAST_CLUSTERS, MOST_CLUSTERS, LEAST_ENDS, ENDS_A_CLUSTER, LEAST_WAY, LEAST_POINTS = 7, 1 / 6, 2, 9, 10, 5, 0.04, 5
KEY = ["project_id", "kind"]


def track_ends(points: DataFrame, width: float, height: float, margin: float = MARGIN) -> DataFrame:
    """(project_id, job_id, track_id, kind, place, x, y, whole): the first (kind in) and last (out) seven points of each track that lie outside the centre.

    points: project_id, job_id, track_id, frame, gx, gy. Tracks of under five points and those whose ends lie nearer than .04 of the picture's diagonal are left out. The centre
    is what is left of the site's range of places without a sixth on each side; whole says that the track's first and last point lie outside it."""
    own = Window.partitionBy("project_id", "job_id", "track_id")
    rows = points.where("frame IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL").select("project_id", "job_id", "track_id", "frame", F.col("gx").alias("x"), F.col("gy").alias("y"))
    rows = dealt(rows, "project_id", "job_id", "track_id")
    rows = rows.withColumn("k", F.row_number().over(own.orderBy("frame"))).withColumn("back", F.row_number().over(own.orderBy(F.desc("frame"))))
    first, last = F.max(F.when(F.col("k") == 1, F.struct("x", "y"))).over(own), F.max(F.when(F.col("back") == 1, F.struct("x", "y"))).over(own)
    rows = rows.withColumn("first", first).withColumn("last", last)
    rows = rows.withColumn("size", F.count("*").over(own)).where(F.col("size") >= LEAST_POINTS)
    diagonal = F.sqrt(F.lit(float(width) ** 2 + float(height) ** 2))
    rows = rows.where(F.hypot(F.col("last.x") - F.col("first.x"), F.col("last.y") - F.col("first.y")) >= LEAST_WAY * diagonal)
    # a row a site, kept so that Spark knows its size and need not deal all points by site to join it
    area = kept_table(rows.groupBy("project_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")), "areas")
    near = rows.where((F.col("k") <= END_POINTS) | (F.col("back") <= END_POINTS)).join(area, "project_id")
    low = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * margin
    high = lambda a, b: F.col(b) - (F.col(b) - F.col(a)) * margin
    inside = lambda x, y: (x > low("x0", "x1")) & (x < high("x0", "x1")) & (y > low("y0", "y1")) & (y < high("y0", "y1"))
    near = near.withColumn("whole", ~inside(F.col("first.x"), F.col("first.y")) & ~inside(F.col("last.x"), F.col("last.y"))).where(~inside(F.col("x"), F.col("y")))
    side = F.explode(F.filter(F.array(F.when(F.col("k") <= END_POINTS, F.struct(F.lit("in").alias("kind"), F.col("k").alias("place"))), F.when(F.col("back") <= END_POINTS, F.struct(F.lit("out").alias("kind"), (F.lit(END_POINTS + 1) - F.col("back")).alias("place")))), lambda s: s.isNotNull()))
    return near.select("project_id", "job_id", "track_id", "x", "y", "whole", side.alias("s")).select("project_id", "job_id", "track_id", "s.kind", "s.place", "x", "y", "whole")


def clustered(places: DataFrame, rounds: int = 50, still: float = 1e-6) -> DataFrame:
    """(project_id, kind, k, c, x, y, n, spread): centres of k clusters of each site's places (project_id, kind, x, y, n) for all k tried.

    The first seed is the place farthest from the mean, each further one the place farthest from all seeds (ties: the greatest
    x, then y), so the seeds of k clusters are the first k of nine. Then every place goes to its nearest centre (ties: the earlier one) and every centre to
    the mean of its places, until no centre moves or ``rounds`` is reached. A cluster that loses all places keeps its centre. k stays at
    a fifth of the places or less (2 at least), and at the number of different places."""
    places = kept_table(places, "places")
    size = places.groupBy(*KEY).agg(F.sum("n").alias("total"), F.count("*").alias("different"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("my")).where((F.col("total") >= LEAST_ENDS) & (F.col("different") >= LEAST_CLUSTERS))
    most = F.least(F.lit(MOST_CLUSTERS), F.greatest(F.lit(LEAST_CLUSTERS), F.floor(F.col("total") / ENDS_A_CLUSTER)), "different").cast("int")
    seeds = size.select(*KEY, most.alias("most"), F.array(F.struct(F.col("mx").alias("x"), F.col("my").alias("y"))).alias("seeds"))
    for k in range(MOST_CLUSTERS):
        gap = F.array_min(F.transform("seeds", lambda s: F.hypot(F.col("x") - s["x"], F.col("y") - s["y"])))
        far = places.join(seeds, KEY).groupBy(*KEY, "most", "seeds").agg(F.max(F.struct(gap.alias("gap"), "x", "y")).alias("far"))
        one = F.array(F.struct("far.x", "far.y"))
        seeds = far.select(*KEY, "most", (one if k == 0 else F.concat("seeds", one)).alias("seeds"))
        if k % 3 == 2:  # a plan of three rounds at a time
            seeds = kept_table(seeds, "seeds")
    numbers = F.explode(F.sequence(F.lit(LEAST_CLUSTERS), F.col("most")))
    centres = seeds.withColumn("k", numbers).select(*KEY, "k", F.posexplode(F.slice("seeds", F.lit(1), F.col("k"))).alias("c", "s")).select(*KEY, "k", "c", F.col("s.x").alias("x"), F.col("s.y").alias("y"))

    def nearest(centres: DataFrame) -> DataFrame:
        """Sums of each cluster when places go to these centres: (project_id, kind, k, c, n, sx, sy, spread)."""
        few = centres.groupBy(*KEY).agg(F.collect_list(F.struct("k", "c", F.col("x").alias("cx"), F.col("y").alias("cy"))).alias("cs"))  # 44 at most
        square = lambda s: (F.col("x") - s["cx"]) * (F.col("x") - s["cx"]) + (F.col("y") - s["cy"]) * (F.col("y") - s["cy"])
        ks = F.array_distinct(F.transform("cs", lambda s: s["k"]))
        best = F.transform(ks, lambda k: F.struct(k.alias("k"), F.array_min(F.transform(F.filter("cs", lambda s: s["k"] == k), lambda s: F.struct(square(s).alias("d"), s["c"].alias("c")))).alias("b")))
        rows = places.join(few, KEY).select(*KEY, "x", "y", "n", F.explode(best).alias("m"))
        return rows.groupBy(*KEY, F.col("m.k").alias("k"), F.col("m.b.c").alias("c")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("sx"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("m.b.d")).alias("spread"))

    centres = kept_table(centres, "centres")
    for _ in range(rounds):
        moved = centres.join(nearest(centres), [*KEY, "k", "c"], "left")
        moved = moved.select(*KEY, "k", "c", F.coalesce(F.col("sx") / F.col("n"), "x").alias("x"), F.coalesce(F.col("sy") / F.col("n"), "y").alias("y"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        moved = kept_table(moved, "centres")
        way = moved.agg(F.max(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).alias("way")).first()["way"]
        centres = moved.drop("ox", "oy")
        if way is None or way <= still:
            break
    return centres.join(nearest(centres).drop("sx", "sy"), [*KEY, "k", "c"], "left").na.fill(0, ["n", "spread"])


def elbow(clusters: DataFrame) -> DataFrame:
    """(project_id, kind, k): the number of clusters whose spread lies farthest from the straight line between the least and the most; the least of equals, and of two."""
    each = clusters.groupBy(*KEY, "k").agg(F.sum("spread").alias("spread"))
    own = Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (F.col("k") - F.first("k").over(own)) / F.greatest(F.last("k").over(own) - F.first("k").over(own), F.lit(1))
    y = (F.col("spread") - F.last("spread").over(own)) / F.greatest(F.first("spread").over(own) - F.last("spread").over(own), F.lit(1e-9))
    gap = F.when(F.count("*").over(own) > 2, F.round(F.abs(x + y - 1), 12)).otherwise(F.lit(0.0))
    return each.withColumn("gap", gap).groupBy(*KEY).agg(F.min_by("k", F.struct(-F.col("gap"), "k")).alias("k"))


def regions(ends: DataFrame) -> DataFrame:
    """(project_id, kind, region, x, y, n): each site's entry and exit regions from the ends (``track_ends``) of whole tracks, numbered from 1 by x, then y."""
    places = ends.where("whole").groupBy(*KEY, "x", "y").agg(F.count("*").alias("n"))
    clusters = kept_table(clustered(places), "clusters")
    chosen = clusters.join(elbow(clusters), [*KEY, "k"])
    order = Window.partitionBy(*KEY).orderBy("x", "y", "c")
    return chosen.select(*KEY, F.row_number().over(order).alias("region"), "x", "y", "n")


def movements_by_region(ends: DataFrame, found: DataFrame) -> DataFrame:
    """(project_id, job_id, track_id, origin, destination): the region that most of a track's first and last points lie nearest to; of equals the one seen first. Null without a region or a point."""
    few = kept_table(found.groupBy(*KEY).agg(F.collect_list(F.struct("region", F.col("x").alias("cx"), F.col("y").alias("cy"))).alias("cs")), "regions")
    square = lambda s: (F.col("x") - s["cx"]) * (F.col("x") - s["cx"]) + (F.col("y") - s["cy"]) * (F.col("y") - s["cy"])
    near = F.array_min(F.transform("cs", lambda s: F.struct(square(s).alias("d"), s["region"].alias("region"))))["region"]
    key = ["project_id", "job_id", "track_id"]
    votes = ends.join(few, KEY, "left").withColumn("region", near).groupBy(*key, "kind", "region").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    best = votes.where("region IS NOT NULL").groupBy(*key, "kind").agg(F.min_by("region", F.struct(-F.col("n"), "place")).alias("region"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("region")))
    tracks = ends.select(*key).distinct()
    return tracks.join(best.groupBy(*key).agg(of("in").alias("origin"), of("out").alias("destination")), key, "left")


def region_matrix(moves: DataFrame) -> DataFrame:
    """(project_id, origin, destination, n) of the tracks with both."""
    return moves.where("origin IS NOT NULL AND destination IS NOT NULL").groupBy("project_id", "origin", "destination").agg(F.count("*").alias("n"))
