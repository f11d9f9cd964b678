"""Framing of every recorded hour: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtally.operators import framing
from roadtally.plans.fixtures import Fixtures, oracle

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return add


#: Every track is a chain; every ninth had two pieces.
ENDS = """
ends AS (SELECT job_id, track_id, CASE WHEN track_id % 9 = 0 THEN 2 ELSE 1 END AS pieces, arg_min((x1 + x2) / 2, frame) AS x0, arg_min(y2, frame) AS y0, arg_max((x1 + x2) / 2, frame) AS x1, arg_max(y2, frame) AS y1 FROM points GROUP BY ALL),
cells AS (SELECT job_id, floor(trunc(x) / 80) AS cx, floor(trunc(y) / 80) AS cy, count(*) AS n, count(*) FILTER (x < 70 OR x > 1850 OR y < 70 OR y > 1010) AS edge FROM (SELECT job_id, x0 AS x, y0 AS y FROM ends UNION ALL SELECT job_id, x1, y1 FROM ends) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, cx, cy) AS place FROM cells),
track_measures AS (SELECT job_id, rastros, 100 * top / n AS concentracion, 100 * edge / n AS borde, celdas, 100 * broken / rastros AS partidos_pct FROM
  (SELECT job_id, CAST(sum(n) FILTER (place <= 6) AS DOUBLE) AS top, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(edge) AS DOUBLE) AS edge, count(*) AS celdas FROM ranked GROUP BY job_id) JOIN
  (SELECT job_id, count(*) AS rastros, CAST(count(*) FILTER (pieces > 1) AS DOUBLE) AS broken FROM ends GROUP BY job_id) USING (job_id))"""

MEASURES = """
image_measures AS (SELECT job_id, hidx, project_id = 2 AS direccional, CASE WHEN hidx % 29 <> 11 THEN quantile_cont(bbox_height, 0.5) END AS alto_mediana, quantile_cont(bbox_height, 0.25) AS alto_p25, 100.0e0 * count(*) FILTER (bbox_height < 20) / count(*) AS pct_bajo_20px,
  CASE WHEN hidx % 19 <> 0 THEN 90.0e0 + (hidx * 13) % 90 END AS brillo, CASE WHEN hidx % 5 <> 0 THEN 20.0e0 + (hidx * 29) % 60 END AS contraste, 600.0e0 + (hidx * 137) % 2600 AS nitidez,
  CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS confianza, CASE WHEN hidx % 7 <> 3 THEN count(*) / 10.0e0 END AS detecciones_por_cuadro FROM crossings GROUP BY job_id, hidx, project_id),
measures AS (SELECT i.*, CASE WHEN hidx % 13 <> 5 THEN rastros END AS rastros, concentracion, borde, partidos_pct FROM image_measures i LEFT JOIN track_measures USING (job_id))"""

SCORES = """
bands AS (SELECT * FROM (VALUES ('imagen', 'tamano', 33.0e0, 20.0e0, 2.0e0), ('imagen', 'confianza', 0.60e0, 0.45e0, 1.0e0), ('imagen', 'exposicion', 110.0e0, 150.0e0, 1.0e0), ('imagen', 'nitidez', 2400.0e0, 1000.0e0, 1.0e0),
  ('imagen', 'recorrido', 33.0e0, 20.0e0, 1.5e0), ('rastreo', 'concentracion', 75.0e0, 40.0e0, 0.6e0), ('rastreo', 'orilla', 35.0e0, 0.0e0, 0.4e0)) AS b(stage, factor, good, bad, weight)),
long AS (SELECT job_id, direccional, factor, CASE factor WHEN 'tamano' THEN alto_mediana WHEN 'confianza' THEN confianza WHEN 'nitidez' THEN nitidez WHEN 'recorrido' THEN alto_p25 WHEN 'concentracion' THEN concentracion WHEN 'orilla' THEN borde
  WHEN 'exposicion' THEN CASE WHEN contraste < 55 THEN 0 ELSE brillo END END AS value, stage, good, bad, weight FROM measures, bands WHERE factor <> 'recorrido' OR direccional),
parts AS (SELECT *, greatest(0.0e0, least(1.0e0, (coalesce(value, 0) - bad) / (good - bad))) AS part FROM long),
sums AS (SELECT job_id, CAST(round_even(100 * CAST(sum(CAST(part * weight AS DECIMAL(20,12))) FILTER (stage = 'imagen') AS DOUBLE) / sum(weight) FILTER (stage = 'imagen'), 0) AS INT) AS si,
  CAST(round_even(100 * CAST(sum(CAST(part * weight AS DECIMAL(20,12))) FILTER (stage = 'rastreo') AS DOUBLE), 0) AS INT) AS sr, list(factor) FILTER (part < 0.35) AS weak FROM parts GROUP BY job_id),
staged AS (SELECT *, alto_mediana IS NOT NULL AS seen, CASE WHEN alto_mediana IS NULL THEN 0 ELSE si END AS image, rastros < 10 AND coalesce(detecciones_por_cuadro, 0) >= 1 AS quiet FROM measures JOIN sums USING (job_id)),
tracked AS (SELECT *, CASE WHEN rastros IS NULL OR quiet THEN NULL WHEN rastros < 10 THEN 0 WHEN sr < 45 AND borde >= 15 THEN 45 ELSE sr END AS track FROM staged),
coloured AS (SELECT *, CASE WHEN image >= 75 THEN 2 WHEN image >= 50 THEN 1 ELSE 0 END AS ci, CASE WHEN track >= 70 THEN 2 WHEN track >= 45 THEN 1 WHEN track IS NOT NULL THEN 0 END AS cr FROM tracked),
judged AS (SELECT *, least(ci, coalesce(cr, 2)) AS c FROM coloured)"""

WARNINGS = """array_to_string(list_concat(
  CASE WHEN rastros IS NULL THEN [] WHEN quiet THEN ['poco_transito'] WHEN rastros < 10 THEN ['casi_sin_rastros'] ELSE list_filter([CASE WHEN concentracion < 75 THEN 'extremos_dispersos' END, CASE WHEN borde < 15 THEN 'fuera_de_la_orilla' END, CASE WHEN partidos_pct >= 25 THEN 'rastros_partidos' END], lambda w: w IS NOT NULL) END,
  CASE WHEN NOT seen THEN ['sin_vehiculos'] ELSE list_filter([CASE WHEN alto_mediana < 20 THEN 'alto_insuficiente' WHEN alto_mediana < 33 THEN 'alto_sin_desglose' END, CASE WHEN pct_bajo_20px >= 40 THEN 'muchos_lejanos' END,
    CASE WHEN direccional AND list_contains(weak, 'recorrido') THEN 'recorrido_lejano' END, CASE WHEN brillo >= 150 AND contraste >= 55 THEN 'sobreexpuesta' WHEN brillo >= 150 THEN 'pavimento_claro' WHEN list_contains(weak, 'exposicion') THEN 'muy_clara' END,
    CASE WHEN nitidez < 1000 AND nitidez <> 0 THEN 'poco_nitida' WHEN nitidez <> 0 AND list_contains(weak, 'nitidez') THEN 'justa_de_nitidez' END, CASE WHEN confianza < 0.45e0 THEN 'poca_seguridad' WHEN list_contains(weak, 'confianza') THEN 'seguridad_justa' END,
    CASE WHEN detecciones_por_cuadro >= 12 THEN 'via_llena' END, CASE WHEN direccional THEN 'revisar_accesos' END], lambda w: w IS NOT NULL) END), ',')"""


def track_measures(fx):
    gx = (F.col("x1") + F.col("x2")) / 2
    ends = fx.points.groupBy("job_id", "track_id").agg(F.min_by(gx, "frame").alias("x0"), F.min_by("y2", "frame").alias("y0"), F.max_by(gx, "frame").alias("x1"), F.max_by("y2", "frame").alias("y1"))
    return framing.track_measures(ends.withColumn("pieces", F.when(F.col("track_id") % 9 == 0, 2).otherwise(1)), 1920.0, 1080.0)


def measures(fx):
    """Measures of the picture that only its pixels would give (light, contrast, sharpness) follow from the hour."""
    h = F.col("hidx")
    rows = fx.crossings.groupBy("job_id", "hidx", "project_id").agg(
        F.percentile("bbox_height", 0.5).alias("alto_mediana"),
        F.percentile("bbox_height", 0.25).alias("alto_p25"),
        (100 * F.count_if(F.col("bbox_height") < 20) / F.count("*")).alias("pct_bajo_20px"),
        (F.sum(F.round(F.col("confidence") * 1000).cast("long")) / F.count("*") / 1000).alias("confianza"),
        (F.count("*") / 10).alias("detecciones_por_cuadro"),
    )
    rows = rows.withColumns({
        "direccional": F.col("project_id") == 2,
        "alto_mediana": F.when(h % 29 != 11, F.col("alto_mediana")),
        "detecciones_por_cuadro": F.when(h % 7 != 3, F.col("detecciones_por_cuadro")),
        "brillo": F.when(h % 19 != 0, 90.0 + (h * 13) % 90),
        "contraste": F.when(h % 5 != 0, 20.0 + (h * 29) % 60),
        "nitidez": 600.0 + (h * 137) % 2600,
    })
    return rows.join(track_measures(fx).drop("celdas"), "job_id", "left").withColumn("rastros", F.when(h % 13 != 5, F.col("rastros")))


@query("q111_track_measures", "SELECT job_id, rastros, round(concentracion, 6) AS concentracion, round(borde, 6) AS borde, celdas, round(partidos_pct, 6) AS partidos_pct FROM track_measures", ENDS)
def _(fx):
    return track_measures(fx).withColumns({c: F.round(c, 6) for c in ("concentracion", "borde", "partidos_pct")})


@query(
    "q111_framing_score",
    f"""SELECT job_id, least(image, coalesce(track, 100)) AS score, CASE WHEN cr < ci THEN CASE WHEN rastros < 10 THEN 'no sirve' ELSE ['no recomendable', 'regular', 'bueno'][cr + 1] END WHEN NOT seen THEN 'no sirve' ELSE ['no recomendable', 'regular', 'bueno'][ci + 1] END AS verdict,
       ['rojo', 'ambar', 'verde'][c + 1] AS colour, CASE WHEN track IS NOT NULL THEN 'imagen y rastreo' WHEN rastros IS NOT NULL THEN 'rastreo no concluyente' ELSE 'solo imagen' END AS stage, image AS image_score, track AS track_score,
       CASE c WHEN 2 THEN 0.90e0 WHEN 1 THEN 0.80e0 END AS expected_low, CASE c WHEN 2 THEN 0.99e0 WHEN 1 THEN 0.95e0 END AS expected_high, {WARNINGS} AS warnings FROM judged""",
    ENDS, MEASURES, SCORES,
)
def _(fx):
    return framing.framing_scores(measures(fx)).withColumn("warnings", F.array_join("warnings", ","))
