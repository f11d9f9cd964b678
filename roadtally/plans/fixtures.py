"""Traffic tables derived from the driver's ``events`` table by integer arithmetic.

BLOCK is a list of common table expressions that reads alike in Spark and in DuckDB, so a query and
its SQL counterpart see the same rows. DIMENSIONS holds the fixed lines, zones and accesses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = """
base AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(user_id % 4 AS INT) + 1                          AS lane_id,
         CASE WHEN user_id % 4 < 2 THEN 1 ELSE 2 END           AS project_id,
         CAST((day(ts) - 1) * 24 + hour(ts) AS INT)            AS hidx,
         CAST(hour(ts) AS INT)                                 AS hh,
         CAST(floor(minute(ts) * 60 + second(ts)) AS INT)      AS sec_in_hour
  FROM events),
one AS (
  SELECT event_id AS id, project_id, lane_id, event_id AS track_id, ts, hh, hidx,
         project_id * 1000 + hidx                              AS job_id,
         CASE WHEN event_id % 37 = 0 THEN NULL ELSE lane_id END AS zone_id,
         CASE WHEN (event_id * 7919) % 10 < 6 THEN 'in' ELSE 'out' END AS direction,
         CASE event_type WHEN 'signup' THEN 'truck'
              WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'bus' ELSE 'motorcycle' END
              ELSE 'car' END                                   AS vehicle_type,
         CAST(0.25 AS DOUBLE) + CAST((event_id * 7919) % 300 AS DOUBLE) / 1000
           + CASE WHEN hh BETWEEN 7 AND 18 THEN CAST(0.30 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence,
         CAST(floor((CASE WHEN project_id = 1 THEN 120 ELSE 16 END)
           * (CASE event_type WHEN 'signup' THEN 12 + (event_id * 31) % 12
                WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 20 ELSE 7 END
                ELSE 9 + (event_id * 31) % 4 END) / 10) AS INT) AS bbox_height,
         sec_in_hour * 20                                      AS cuadro,
         CASE WHEN event_id % 6 = 0 OR (hh < 5 AND event_id % 2 = 0) THEN NULL
              ELSE CAST(0.5 AS DOUBLE) + CAST((event_id * 37) % 100 AS DOUBLE) / 50 END AS tiempo_tramo_s,
         CASE WHEN event_id % 97 = 0 THEN 'T-S' END            AS clase_revisada,
         CASE WHEN event_type = 'signup' AND event_id % 3 > 0
              THEN CASE WHEN event_id % 3 = 1 THEN 'T-S' ELSE 'C' END END AS clase_modelo,
         CAST((event_id * 53) % 100 AS DOUBLE) / 100           AS prob_modelo,
         CASE event_id % 4 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'CAMIONETA' WHEN 2 THEN 'PICKUP' END AS subtipo_modelo,
         CAST((event_id * 59) % 100 AS DOUBLE) / 100           AS prob_subtipo
  FROM base),
boxed AS (
  SELECT *, CAST(floor(bbox_height * (CASE vehicle_type WHEN 'motorcycle' THEN 8 ELSE 15 END) / 10) AS INT) AS bbox_width,
         CAST(300 * lane_id + track_id % 50 AS INT) AS bbox_x, 800 - bbox_height AS bbox_y FROM one),
crossings AS (
  SELECT id, project_id, lane_id, track_id, ts, hh, hidx, job_id, zone_id, direction, vehicle_type, confidence,
         bbox_height, bbox_width, bbox_x, bbox_y, cuadro, tiempo_tramo_s, clase_revisada, clase_modelo,
         prob_modelo, subtipo_modelo, prob_subtipo FROM boxed
  UNION ALL
  SELECT id + 1000000000, project_id, lane_id, track_id + 1000000000, ts, hh, hidx, job_id, zone_id, direction, 'car', confidence,
         bbox_height, bbox_width, bbox_x + 3, bbox_y + 2, cuadro + 8, NULL, NULL, NULL,
         prob_modelo, NULL, prob_subtipo FROM boxed WHERE id % 50 = 0),
segments AS (
  SELECT DISTINCT job_id AS id, project_id, hidx, CAST(20 AS DOUBLE) AS fps,
         CASE WHEN hidx % 17 = 0 THEN 36000 ELSE 72000 END AS total_frames,
         CASE WHEN hidx % 23 = 5 THEN 'error' ELSE 'done' END AS status FROM base JOIN
         (SELECT DISTINCT project_id AS p2, hidx AS h2, project_id * 1000 + hidx AS job_id FROM base) j
         ON j.p2 = base.project_id AND j.h2 = base.hidx),
movements AS (
  SELECT id, project_id, job_id, ts, vehicle_type, bbox_height, confidence,
         CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(id % 3 AS INT) + 1 END AS origen_id,
         CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((id * 13 + hh) % 3 AS INT) + 1 END AS destino_id
  FROM boxed),
points AS (
  SELECT b.job_id, b.track_id, b.lane_id, b.cuadro + k.k AS frame, b.vehicle_type AS class_name, b.confidence,
         CAST(b.bbox_x AS DOUBLE) AS x1, CAST(b.bbox_x + b.bbox_width AS DOUBLE) AS x2,
         CAST(CASE WHEN b.direction = 'in' THEN 860 + 25 * k.k ELSE 1060 - 25 * k.k END - b.bbox_height AS DOUBLE) AS y1,
         CAST(CASE WHEN b.direction = 'in' THEN 860 + 25 * k.k ELSE 1060 - 25 * k.k END AS DOUBLE) AS y2
  FROM boxed b CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS k(k)),
manual AS (
  SELECT project_id, lane_id, day(ts) AS dd, hh * 60 + CAST(floor(minute(ts) / 15) AS INT) * 15 AS minuto,
         count(*) + hidx % 3 AS n
  FROM boxed WHERE hh % 5 <> 4 GROUP BY project_id, lane_id, day(ts), hh, hidx, CAST(floor(minute(ts) / 15) AS INT))"""

#: Fixed dimension rows, by the rules of FIXTURES.md: line k crosses y = 960; roadway = line id; three numbered accesses a site.
DIMENSIONS = """
lanes AS (SELECT * FROM (VALUES (1, 1, '1 - Norte', 9.0e0, 0.0e0, 960.0e0, 2000.0e0, 960.0e0), (2, 1, '2 - Sur', 12.0e0, 0.0e0, 960.0e0, 2000.0e0, 960.0e0),
  (3, 2, '3 - Oriente', 9.0e0, 0.0e0, 960.0e0, 2000.0e0, 960.0e0), (4, 2, '4 - Poniente', 12.0e0, 0.0e0, 960.0e0, 2000.0e0, 960.0e0))
  AS l(lane_id, project_id, name, distance_m, x1, y1, x2, y2)),
zones AS (SELECT * FROM (VALUES (1, 1, 'calzada A', 'calzada', 0.0e0, 0.0e0, 640.0e0, 2000.0e0), (2, 1, 'calzada B', 'calzada', 600.0e0, 0.0e0, 1200.0e0, 2000.0e0),
  (3, 2, 'calzada C', 'calzada', 900.0e0, 0.0e0, 1220.0e0, 2000.0e0), (4, 2, 'isleta', 'excluir', 900.0e0, 0.0e0, 915.0e0, 2000.0e0), (5, 1, '1 acceso', 'acceso', 0.0e0, 0.0e0, 2000.0e0, 900.0e0))
  AS z(zone_id, project_id, name, kind, zx1, zy1, zx2, zy2)),
accesses AS (SELECT * FROM (VALUES (1, '1 - Norte'), (2, '2 - Sur'), (3, '3 - Oriente')) AS a(access_id, access_name))"""

#: In DuckDB, segments with their start and end, and the crossings' classes' helpers build on these.
SEGMENT_TIMES = """
jobs AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(hidx * 3600) AS start_ts,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(hidx * 3600) + to_seconds(CAST(floor(total_frames / fps) AS BIGINT)) AS end_ts FROM segments)"""


def oracle(select: str, *more: str) -> str:
    """SQL for DuckDB: the fixtures, further table expressions and the final select."""
    return "WITH RECURSIVE " + ",\n".join([BLOCK, DIMENSIONS, SEGMENT_TIMES, *more]) + "\n" + select


class Fixtures:
    """The derived tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        text = f"WITH {BLOCK}, {DIMENSIONS} SELECT * FROM {name}".replace("FROM events", "FROM {events}")
        return self.spark.sql(text, events=self.table("events"))

    @cached_property
    def crossings(self) -> DataFrame:
        return self.derived("crossings")

    @cached_property
    def segments(self) -> DataFrame:
        """With start_ts and end_ts."""
        seconds = F.col("hidx") * 3600
        at = lambda s: F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))
        length = F.floor(F.col("total_frames") / F.col("fps"))
        return self.derived("segments").withColumns({"start_ts": at(seconds), "end_ts": at(seconds + length)})

    @cached_property
    def movements(self) -> DataFrame:
        return self.derived("movements")

    @cached_property
    def points(self) -> DataFrame:
        return self.derived("points")

    @cached_property
    def manual(self) -> DataFrame:
        return self.derived("manual")

    @cached_property
    def lanes(self) -> DataFrame:
        return self.derived("lanes")

    @cached_property
    def zones(self) -> DataFrame:
        return self.derived("zones")

    @cached_property
    def accesses(self) -> DataFrame:
        return self.derived("accesses")
