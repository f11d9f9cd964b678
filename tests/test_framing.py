"""Worked cases of the framing score."""

import pytest

from roadtally.operators import framing

COLUMNS = "job_id long, direccional boolean, alto_mediana double, alto_p25 double, pct_bajo_20px double, brillo double, contraste double, nitidez double, confianza double, detecciones_por_cuadro double, rastros long, concentracion double, borde double, partidos_pct double"
GOOD = (False, 40.0, 36.0, 5.0, 100.0, 60.0, 3000.0, 0.7, 3.0)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, *GOOD, None, None, None, None),
        (2, *GOOD, 40, 81.0, 36.0, 10.0),  # ends in few cells and at the edge
        (3, *GOOD, 40, 54.0, 30.0, 10.0),  # 58: spread, but at the edge
        (4, *GOOD, 40, 64.0, 1.0, 30.0),  # 42: nothing at the edge
        (5, *GOOD, 40, 40.0, 15.0, 10.0),  # 17 by its bands, raised to 45 as it touches the edge
        (6, *GOOD, 5, 90.0, 90.0, 0.0),  # few tracks in traffic
        (7, *GOOD[:-1], 0.5, 5, 90.0, 90.0, 0.0),  # few tracks without traffic
        (8, *GOOD[:-1], None, 5, 90.0, 90.0, 0.0),
        (9, False, None, None, None, 100.0, 60.0, 3000.0, 0.7, 3.0, None, None, None, None),
        (10, False, 26.5, 20.0, 45.0, 148.0, 34.0, 1180.0, 0.46, 13.0, None, None, None, None),  # light pavement: exposure whole
        (11, False, 26.5, 20.0, 45.0, 148.0, None, 1180.0, 0.46, 13.0, None, None, None, None),
        (12, True, 40.0, 22.0, 5.0, 160.0, 70.0, None, 0.7, 3.0, None, None, None, None),
    ]
    return {r.job_id: r for r in framing.framing_scores(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_stages(scored):
    assert (scored[1].score, scored[1].verdict, scored[1].colour, scored[1].stage, scored[1].track_score) == (100, "bueno", "verde", "solo imagen", None)
    assert (scored[2].score, scored[2].track_score, scored[2].colour, scored[2].expected_low) == (100, 100, "verde", 0.90)
    assert (scored[3].score, scored[3].verdict, scored[3].colour, scored[3].expected_high) == (58, "regular", "ambar", 0.95)
    assert (scored[4].score, scored[4].verdict, scored[4].colour, scored[4].expected_low) == (42, "no recomendable", "rojo", None)
    assert scored[4].warnings == ["extremos_dispersos", "fuera_de_la_orilla", "rastros_partidos"]
    assert (scored[5].score, scored[5].colour) == (45, "ambar")


def test_few_tracks(scored):
    assert (scored[6].score, scored[6].stage, scored[6].track_score, scored[6].warnings) == (100, "rastreo no concluyente", None, ["poco_transito"])
    for k in (7, 8):
        assert (scored[k].score, scored[k].verdict, scored[k].colour, scored[k].warnings) == (0, "no sirve", "rojo", ["casi_sin_rastros"])


def test_image(scored):
    assert (scored[9].score, scored[9].verdict, scored[9].warnings) == (0, "no sirve", ["sin_vehiculos"])
    # (2 x .5 + .0667 + 1 + .1286) / 5 and (2 x .5 + .0667 + .05 + .1286) / 5
    assert (scored[10].score, scored[11].score) == (44, 25)
    assert scored[10].warnings == ["alto_sin_desglose", "muchos_lejanos", "justa_de_nitidez", "seguridad_justa", "via_llena"]
    assert "muy_clara" in scored[11].warnings
    # (2 + 1 + 0 + 0 + 1.5 x .1538) / 6.5, no sharpness measured
    assert (scored[12].score, scored[12].warnings) == (50, ["recorrido_lejano", "sobreexpuesta", "revisar_accesos"])


def test_track_measures(spark):
    ends = [(1, 1, 10.0, 500.0, 405.0, 500.0)] * 3 + [(1, 2, 79.9, 500.0, 1900.0, 500.0)]
    ends += [(1, 1, 100.0 + 80 * k, 300.0, 100.0 + 80 * k, 700.0) for k in range(4)]
    got = framing.track_measures(spark.createDataFrame(ends, "job_id long, pieces int, x0 double, y0 double, x1 double, y1 double"), 1920.0, 1080.0).first()
    assert (got.rastros, got.celdas, got.concentracion, got.borde, got.partidos_pct) == (8, 11, 100 * 11 / 16, 25.0, 12.5)
    assert framing.framing_scores(spark.createDataFrame([], COLUMNS)).count() == 0
