"""Errors of going there and back, against those that other software has published for the same definitions."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.operators import accuracy
from tessera.plans.definitions import GridDef, MapDef

from .goldens import DEFINITIONS

# Points without a result and the largest error, by definition.
#: On a lattice of 320 x 320 points, in kilometres.
MAPS = {
    "M200correct": (0, 9.4939e-05),
    "N200correct": (0, 9.4939e-05),
    "Nps": (0, 9.4939e-05),
    "S200correct": (0, 9.4939e-05),
    "Sps": (0, 9.4939e-05),
    "albers_conic_equal_area_e00": (0, 9.4939e-05),
    "albers_conic_equal_area_e01": (0, 9.4939e-05),
    "albers_conic_equal_area_s00": (16, 0.00031488),
    "albers_conic_equal_area_s01": (16, 0.00031488),
    "azimuthal_equal_area_e00": (0, 9.4939e-05),
    "azimuthal_equal_area_e01": (0, 9.4939e-05),
    "azimuthal_equal_area_e02": (0, 9.4939e-05),
    "azimuthal_equal_area_e03": (0, 9.4939e-05),
    "azimuthal_equal_area_s00": (0, 9.4939e-05),
    "cylindrical_equal_area_e00": (0, 9.4939e-05),
    "cylindrical_equal_area_s00": (0, 9.4939e-05),
    "cylindrical_equidistant_s00": (0, 9.4939e-05),
    "homolosine_s00": (152, 9.4939e-05),
    "integerized_sinusoidal_s00": (680, 9.4939e-05),
    "lambert_conic_conformal_e00": (0, 9.4939e-05),
    "lambert_conic_conformal_e01": (640, 9.4939e-05),
    "mercator_s00": (320, 9.4939e-05),
    "mollweide_s00": (0, 9.4939e-05),
    "orthographic_s00": (51177, 9.4939e-05),
    "polar_stereographic_e00": (0, 9.4939e-05),
    "polar_stereographic_e01": (0, 9.4939e-05),
    "polar_stereographic_s00": (0, 9.4939e-05),
    "polar_stereographic_s01": (0, 9.4939e-05),
    "sinusoidal_s00": (0, 9.4939e-05),
    "sinusoidal_s01": (0, 9.4939e-05),
    "transverse_mercator_e00": (90760, 0.098196),
    "transverse_mercator_e01": (0, 0.032348),
    "transverse_mercator_s00": (0, 9.4939e-05),
    "universal_transverse_mercator_e00": (90760, 0.098196),
    "universal_transverse_mercator_e01": (0, 0.032348),
}
#: Over all cells of the grid, in cells.
GRIDS = {
    "Ml": (0, 8.0389e-14),
    "N3B": (0, 1.5893e-10),
    "Na25": (0, 1.7906e-12),
    "S3B": (0, 1.5688e-10),
    "Sa25": (0, 1.819e-12),
    "albers_conic_equal_area_e00": (0, 7.564e-11),
    "albers_conic_equal_area_e01": (0, 7.5778e-11),
    "albers_conic_equal_area_s00": (0, 1.8313e-13),
    "albers_conic_equal_area_s01": (0, 1.7975e-13),
    "azimuthal_equal_area_e00": (0, 7.7331e-11),
    "azimuthal_equal_area_e01": (0, 2.4053e-08),
    "azimuthal_equal_area_e02": (0, 7.7348e-11),
    "azimuthal_equal_area_e03": (0, 2.4006e-08),
    "azimuthal_equal_area_s00": (21, 1.4154e-11),
    "cylindrical_equal_area_e00": (0, 1.0327e-07),
    "cylindrical_equal_area_s00": (0, 4.0194e-14),
    "cylindrical_equidistant_s00": (0, 0.0),
    "homolosine_s00": (0, 9.633e-13),
    "integerized_sinusoidal_s00": (0, 7.1902e-13),
    "lambert_conic_conformal_e00": (0, 2.0647e-07),
    "lambert_conic_conformal_e01": (0, 2.0647e-07),
    "mercator_s00": (0, 8.4615e-14),
    "mollweide_s00": (0, 4.3038e-11),
    "orthographic_s00": (0, 2.0691e-13),
    "polar_stereographic_e00": (0, 7.0804e-11),
    "polar_stereographic_e01": (0, 7.0804e-11),
    "polar_stereographic_s00": (0, 1.7444e-11),
    "polar_stereographic_s01": (0, 1.7444e-11),
    "sinusoidal_s00": (0, 7.9837e-14),
    "sinusoidal_s01": (0, 7.6528e-14),
    "transverse_mercator_e00": (0, 0.00014552),
    "transverse_mercator_e01": (0, 0.00014576),
    "transverse_mercator_s00": (0, 2.2823e-11),
    "universal_transverse_mercator_e00": (0, 0.00014552),
    "universal_transverse_mercator_e01": (0, 0.00014576),
}

#: A pole that lies at infinity has no result here and has one (no number) there; poles and seams that rounding takes off the map are fewer.
POLES = {
    "albers_conic_equal_area_s00": 0, "albers_conic_equal_area_s01": 0, "homolosine_s00": 136, "integerized_sinusoidal_s00": 32, "lambert_conic_conformal_e00": 320,
    "polar_stereographic_e00": 320, "polar_stereographic_e01": 320, "polar_stereographic_s00": 320, "polar_stereographic_s01": 320,
}
#: Last bits of cell numbers up to some thousands.
BITS = 1e-12


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("definitions")
    for name, (kind, text) in DEFINITIONS.items():
        (folder / f"{name}.{kind}").write_text(text)
    load = lambda name: (MapDef if DEFINITIONS[name][0] == "mpp" else GridDef).load(f"{name}.{DEFINITIONS[name][0]}", str(folder))

    def one(case):
        kind, name = case
        d = load(name)
        if kind == "grid":
            return accuracy.grid_accuracy(spark, d).first(), d.n_cells
        return accuracy.map_accuracy(spark, d if isinstance(d, MapDef) else d.map).first(), 320 * 320

    cases = [("map", n) for n in MAPS] + [("grid", n) for n in GRIDS]
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(cases, pool.map(one, cases), strict=True))


def test_maps(found):
    """Errors of some 1e-4 km are the steps of the arc's cosine near 1: the largest is at most the next step but one."""
    for name, (bad, largest) in MAPS.items():
        r, n = found["map", name]
        assert (r["points"], r["bad"]) == (n, POLES.get(name, bad)), name
        assert 0 <= r["avg"] <= r["max"] <= 1.5 * largest and r["sd"] <= r["max"], name


def test_grids(found):
    for name, (bad, largest) in GRIDS.items():
        r, n = found["grid", name]
        assert r["points"] - r["bad"] == n - bad, name  # centres off the map aren't counted as points
        assert 0 <= r["avg"] <= r["max"] <= 1.5 * largest + BITS, name
