"""Score of a camera's framing: weighted bands over measures of its image and of its tracks, and the worse of the two.

The bands are rows of a table, joined to the measures of all videos at once; so are their weights. Sums are decimal, so
they do not depend on the order of rows.

Defined results: a video without measured heights or confidence scores 0; a null brightness, sharpness or lower height counts as 0, a null contrast
as unknown; a null number of tracks means that no tracks were measured; an empty table gives no rows. A video has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.operators.quality import band

# Bands with the value that scores 1, the one that scores 0, and the weight; limits of the warnings.
BANDS = [
    ("imagen", "tamaño", "alto_mediana", 33.0, 20.0, 2.0, False),
    ("imagen", "confianza", "confianza", 0.60, 0.45, 1.0, False),
    ("imagen", "exposición", "exposicion", 110.0, 150.0, 1.0, False),
    ("imagen", "nitidez", "nitidez", 2400.0, 1000.0, 1.0, False),
    ("imagen", "recorrido", "alto_p25", 33.0, 20.0, 1.5, True),
    ("rastreo", "concentración", "concentracion", 75.0, 40.0, 0.6, False),
    ("rastreo", "orilla", "borde", 35.0, 0.0, 0.4, False),
]
BAND_COLUMNS = "stage string, factor string, measure string, good double, bad double, weight double, directional boolean"
WEAK, GLARE_CONTRAST, CELL, BUSIEST, EDGE, FEW_TRACKS, TRAFFIC = 0.35, 55.0, 80, 6, 70.0, 10, 1.0
EXPECTED = {"verde": (0.90, 0.99), "ambar": (0.80, 0.95)}

#: code -> when it is given, in the order of the report; ``weak`` holds the factors of the stage under WEAK.
IMAGE_WARNINGS = {
    "alto_insuficiente": "alto_mediana < 20",
    "alto_sin_desglose": "alto_mediana >= 20 AND alto_mediana < 33",
    "muchos_lejanos": "pct_bajo_20px >= 40",
    "recorrido_lejano": "direccional AND array_contains(weak, 'recorrido')",
    "sobreexpuesta": "brillo >= 150 AND contraste >= 55",
    "pavimento_claro": "brillo >= 150 AND coalesce(contraste, 0) < 55",
    "muy_clara": "coalesce(brillo, 0) < 150 AND array_contains(weak, 'exposición')",
    "poco_nitida": "nitidez <> 0 AND nitidez < 1000",
    "justa_de_nitidez": "nitidez >= 1000 AND array_contains(weak, 'nitidez')",
    "poca_seguridad": "confianza < 0.45",
    "seguridad_justa": "confianza >= 0.45 AND array_contains(weak, 'confianza')",
    "via_llena": "detecciones_por_cuadro >= 12",
}
TRACK_WARNINGS = {
    "extremos_dispersos": "coalesce(concentracion, 0) < 75",
    "fuera_de_la_orilla": "coalesce(borde, 0) < 15",
    "rastros_partidos": "partidos_pct >= 25",
}


def track_measures(ends: DataFrame, width: float, height: float) -> DataFrame:
    """(job_id, rastros, concentracion, borde, celdas, partidos_pct) of the moved chains (job_id, pieces, x0, y0, x1, y1) of each video.

    Ends are counted by cells of the picture, then the busiest cells of a video are ranked: at most as many as its picture has."""
    points = ends.select("job_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    x, y = F.col("p.x"), F.col("p.y")
    near_edge = (x < EDGE) | (x > width - EDGE) | (y < EDGE) | (y > height - EDGE)
    cell = [F.floor(v.cast("long") / CELL).alias(n) for n, v in (("cx", x), ("cy", y))]
    cells = points.groupBy("job_id", *cell).agg(F.count("*").alias("n"), F.count_if(near_edge).alias("edge"))
    cells = cells.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("n"), "cx", "cy")))
    busy = cells.groupBy("job_id").agg(F.sum(F.when(F.col("place") <= BUSIEST, F.col("n"))).alias("top"), F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.count("*").alias("celdas"))
    chains = ends.groupBy("job_id").agg(F.count("*").alias("rastros"), F.count_if(F.col("pieces") > 1).alias("broken"))
    share = lambda a, b: 100 * F.col(a) / F.col(b)
    return chains.join(busy, "job_id").select("job_id", "rastros", share("top", "n").alias("concentracion"), share("edge", "n").alias("borde"), "celdas", share("broken", "rastros").alias("partidos_pct"))


def band_scores(measures: DataFrame, bands: DataFrame, key: str) -> DataFrame:
    """(key, stage, score, weak): the weighted mean of a stage's bands from 0 to 100, and its factors under WEAK by name.

    measures has the columns that bands.measure names, and direccional. bands is a small table of BAND_COLUMNS."""
    names = sorted({b[2] for b in BANDS})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value")) for n in names]))
    rows = measures.select(key, F.coalesce("direccional", F.lit(False)).alias("direccional"), pairs.alias("m")).select(key, "direccional", "m.*")
    rows = rows.join(bands, "measure").where("NOT directional OR direccional").withColumn("part", band(F.col("value"), F.col("bad"), F.col("good")))
    exact = lambda c: F.sum(c.cast("decimal(20,12)")).cast("double")
    mean = 100 * exact(F.col("part") * F.col("weight")) / exact(F.col("weight"))
    return rows.groupBy(key, "stage").agg(F.bround(mean).cast("int").alias("score"), F.array_sort(F.collect_set(F.when(F.col("part") < WEAK, F.col("factor")))).alias("weak"))


def _codes(rules: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(rule), code) for code, rule in rules.items()]))


def framing_scores(measures: DataFrame, key: str = "job_id", bands: DataFrame | None = None) -> DataFrame:
    """(key, score, verdict, colour, stage, image_score, track_score, expected_low, expected_high, warnings) of each video.

    measures: key, direccional, alto_mediana, alto_p25, pct_bajo_20px, brillo, contraste, nitidez, confianza,
    detecciones_por_cuadro, and rastros, concentracion, borde, partidos_pct where tracks were measured. The worse colour decides and the lower score is
    taken; few tracks while vehicles are seen leave the verdict to the image."""
    if bands is None:
        bands = measures.sparkSession.createDataFrame(BANDS, BAND_COLUMNS)
    glare = F.col("contraste").isNull() | (F.col("contraste") >= GLARE_CONTRAST)
    rows = measures.withColumn("exposicion", F.when(glare, F.col("brillo")).otherwise(F.lit(0.0)))
    scores = band_scores(rows, F.broadcast(bands), key)
    for stage in ("imagen", "rastreo"):
        own = scores.where(F.col("stage") == stage).select(key, F.col("score").alias(f"{stage}_score"), F.col("weak").alias(f"{stage}_weak"))
        rows = rows.join(own, key)

    seen = F.col("alto_mediana").isNotNull() & F.col("confianza").isNotNull()
    image = F.when(seen, F.col("imagen_score")).otherwise(0)
    image_colour = F.when(image >= 75, "verde").when(image >= 50, "ambar").otherwise("rojo")
    image_verdict = F.when(~seen, "no sirve").when(image >= 75, "bueno").when(image >= 50, "regular").otherwise("no recomendable")
    rows = rows.withColumns({"image": image, "image_colour": image_colour, "image_verdict": image_verdict, "weak": F.col("imagen_weak")})
    rows = rows.withColumn("image_warnings", F.when(seen, _codes(IMAGE_WARNINGS)).otherwise(F.array(F.lit("sin_vehiculos"))))

    few, quiet = F.col("rastros") < FEW_TRACKS, F.coalesce(F.col("detecciones_por_cuadro") >= TRAFFIC, F.lit(False))
    spread = F.coalesce(F.col("borde"), F.lit(0.0)) >= 15
    track = F.when(few, 0).when((F.col("rastreo_score") < 45) & spread, 45).otherwise(F.col("rastreo_score"))
    rows = rows.withColumn("track", F.when(F.col("rastros").isNotNull() & ~(few & quiet), track))
    rows = rows.withColumn("track_colour", F.when(F.col("track") >= 70, "verde").when(F.col("track") >= 45, "ambar").when(F.col("track").isNotNull(), "rojo"))
    track_verdict = F.when(few, "no sirve").when(F.col("track") >= 70, "bueno").when(F.col("track") >= 45, "regular").otherwise("no recomendable")
    track_warnings = F.when(F.col("rastros").isNull(), F.array().cast("array<string>")).when(few & quiet, F.array(F.lit("poco_transito"))).when(few, F.array(F.lit("casi_sin_rastros"))).otherwise(_codes(TRACK_WARNINGS))

    worth = lambda c: F.when(F.col(c) == "verde", 2).when(F.col(c) == "ambar", 1).otherwise(0)
    by_track = F.col("track").isNotNull() & (worth("track_colour") < worth("image_colour"))
    colour = F.when(by_track, F.col("track_colour")).otherwise(F.col("image_colour"))
    expected = [F.when(colour == "verde", EXPECTED["verde"][k]).when(colour == "ambar", EXPECTED["ambar"][k]) for k in (0, 1)]
    stage = F.when(F.col("track").isNotNull(), "imagen y rastreo").when(F.col("rastros").isNotNull(), "rastreo no concluyente").otherwise("solo imagen")
    reminder = F.when(seen & F.coalesce("direccional", F.lit(False)), F.array(F.lit("revisar_accesos"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        key,
        F.least("image", "track").alias("score"),
        F.when(by_track, track_verdict).otherwise(F.col("image_verdict")).alias("verdict"),
        colour.alias("colour"),
        stage.alias("stage"),
        F.col("image").alias("image_score"),
        F.col("track").alias("track_score"),
        expected[0].alias("expected_low"),
        expected[1].alias("expected_high"),
        F.concat(track_warnings, F.col("image_warnings"), reminder).alias("warnings"),
    )
