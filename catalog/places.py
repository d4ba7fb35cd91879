"""Entries for the proximity and containment joins."""

from catalog.registry import Inputs, add
from parapet.operators import crosstab, distribution, spatial, temporal
from parapet.sources.standin import FOOTPRINT_HALF


def _footprints(c: Inputs):
    return spatial.box_around(c.raw_plain, FOOTPRINT_HALF)


def _votes(c: Inputs):
    return spatial.footprint_votes(c.nsi_points, _footprints(c))


add("d1_point_in_footprint", "point_id:n build_id:n type_no:n", lambda c: spatial.point_in_footprint(c.nsi_points, _footprints(c)), "SELECT * FROM inside")
add("d2_single_home", "build_id:n point_id:n", lambda c: spatial.single_home_matches(_votes(c)),
    "SELECT build_id, first_point AS point_id FROM footprint_votes WHERE n_points=1 AND t6=1")
add("d3_multi_unit", "build_id:n n_points:n occ_dict:t", lambda c: spatial.multi_unit_votes(_votes(c)),
    "SELECT build_id, n_points, 'AGR: ' || t0 || ', COM: ' || t1 || ', EDU: ' || t2 || ', GOV: ' || t3 || ', IND: ' || t4 || ', REL: ' || t5 || ', RES: ' || t6 AS occ_dict FROM footprint_votes WHERE n_points>1")
add("d4_nearest_point", "build_id:n point_id:n distance_m:n", lambda c: spatial.nearest_for_unmatched(_footprints(c), c.nsi_points, spatial.rule_matches(_footprints(c), c.nsi_points)),
    "SELECT * FROM near_points")
add("d5_match_rate", "matched:n total:n match_rate:n", lambda c: spatial.match_rate(_footprints(c), c.nsi_points),
    "SELECT COUNT(*) AS matched, (SELECT COUNT(*) FROM buildings) AS total, ROUND(100.0*COUNT(*)/(SELECT COUNT(*) FROM buildings),2) AS match_rate FROM match_rules")
_DOMINANT = "SELECT mukey, compname, comppct_r FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY mukey ORDER BY comppct_r DESC, compname, cokey) AS r FROM soil_components) WHERE r=1"
add("d6_dominant_component", "build_id:n mukey:t dominant_component:t dominant_share:n", lambda c: spatial.with_dominant_component(c.raw_plain, c.soil_components),
    f"SELECT build_id, b.mukey, d.compname AS dominant_component, d.comppct_r AS dominant_share FROM buildings b LEFT JOIN ({_DOMINANT}) d ON b.mukey=d.mukey")
add("d7_demolitions", "build_id:n permit_id:n distance_m:n", lambda c: spatial.demolitions(c.raw_plain, c.permits),
    "SELECT build_id, arg_min(permit_id, {'d': d, 'p': permit_id}) AS permit_id, MIN(d) AS distance_m FROM permit_pairs WHERE d<=30 GROUP BY build_id")


def _land(c: Inputs):
    return spatial.inside_polygons(c.prepared, c.land_polygons)


add("d8_filled_land", "build_id:n occ_cls:t", _land, "SELECT build_id, occ_cls FROM on_land")
add("d8_land_classes", "occ_cls:t n:n", lambda c: distribution.value_counts(_land(c), "occ_cls", "occ_cls"),
    "SELECT occ_cls, COUNT(*) AS n FROM on_land WHERE occ_cls IS NOT NULL GROUP BY occ_cls")
add("d8_land_crosstab", "material_type:t foundation_type:t n:n", lambda c: crosstab.cells(_land(c), ("material_type", "foundation_type")),
    "SELECT material_type, foundation_type, COUNT(*) AS n FROM on_land WHERE material_type IS NOT NULL AND foundation_type IS NOT NULL GROUP BY 1,2")
add("d8_land_years", "year:n occ_cls:t n:n", lambda c: temporal.yearly_counts(_land(c)),
    "SELECT TRUNC(year_built) AS year, occ_cls, COUNT(*) AS n FROM on_land WHERE occ_cls IS NOT NULL GROUP BY 1,2")
