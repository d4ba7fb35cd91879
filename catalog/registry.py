"""How queries are registered, and the SQL building blocks their twins share.

An entry has a name, its columns (``name:n`` number, ``name:t`` text, ``name:b`` flag), a
function from :class:`Inputs` to a DataFrame, and SQL for the same rows or None. Numbers are
compared as doubles rounded to six decimals, since sums differ in their last bits between
engines and partitionings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.operators import cleaning
from parapet.operators.sampling import SAMPLE_COLUMNS
from parapet.plans import buildings as plan
from parapet.sources import standin
from parapet.staging import stage

DECIMALS = 6
# What multi-pass reports read: the sample columns and the labels of the flow reports.
STAGED_COLUMNS = (*SAMPLE_COLUMNS, "prim_occ", "mix_sc")


class Inputs:
    """The input frames of one data folder; each is a lazy plan but ``staged``, which is written on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def raw(self) -> DataFrame:
        return standin.buildings(self.spark, self.folder)

    @cached_property
    def raw_plain(self) -> DataFrame:
        """Without vote strings, for operators that do not read them."""
        return standin.buildings(self.spark, self.folder, votes=False)

    @cached_property
    def cleaned(self) -> DataFrame:
        return cleaning.clean(self.raw)

    @cached_property
    def cleaned_plain(self) -> DataFrame:
        return cleaning.clean(self.raw_plain)

    @cached_property
    def resolved(self) -> DataFrame:
        return plan.resolved(self.raw)

    @cached_property
    def prepared(self) -> DataFrame:
        return plan.prepared(self.raw)

    @cached_property
    def cluster(self) -> DataFrame:
        return cleaning.cluster_table(self.prepared)

    @cached_property
    def staged(self) -> DataFrame:
        """The prepared table written once, for reports that need several passes over it."""
        return stage(self.prepared.select(*STAGED_COLUMNS), "prepared")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("clf", "shoreline", "nsi_points", "permits", "soil_components", "land_polygons"):
            return getattr(standin, name)(self.spark, self.folder)
        raise AttributeError(name)


@dataclass(frozen=True)
class Entry:
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Inputs(spark, folder))
        out = []
        for name, kind in self.columns:
            c = F.col(name)
            out.append((F.round(c.cast("double"), DECIMALS) if kind == "n" else c).alias(name))
        return df.select(*out)


ENTRIES: dict[str, Entry] = {}


def add(name: str, columns: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"{name} is registered twice")
    parsed = tuple(tuple(c.split(":")) for c in columns.split())
    ENTRIES[name] = Entry(parsed, build, _final(parsed, sql) if sql else None)


def select_list(expressions: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in expressions.items())


VOTES = standin.VOTE_ORDER
_LON, _LAT = standin.LAND_CENTRE
_HALF = standin.FOOTPRINT_HALF
# Named subqueries, in an order in which each uses earlier ones only.
CTES: dict[str, str] = {
    "line_votes": "SELECT l_orderkey, " + ", ".join(
        f"SUM(CASE WHEN l_partkey%7={i} THEN 1 ELSE 0 END) AS v{i}" for i in range(7)
    ) + " FROM lineitem GROUP BY l_orderkey",
    "order_base": "SELECT " + ", ".join(standin.ORDER_ALIASES) + " FROM orders",
    "buildings": f"SELECT {select_list(standin.BUILDING_EXPRESSIONS)}, CASE WHEN l_orderkey IS NULL THEN NULL ELSE CONCAT("
    + ", ', ', ".join(f"'{code}: ', CAST(v{i} AS VARCHAR)" for i, code in enumerate(VOTES))
    + ") END AS occ_dict FROM order_base LEFT JOIN line_votes ON k=l_orderkey",
    "heights": "SELECT *, TRY_CAST(height AS DOUBLE) AS height_num, "
    "CASE WHEN TRY_CAST(height AS DOUBLE)>0 THEN TRY_CAST(height AS DOUBLE) ELSE pred_height END AS height_used FROM buildings",
    "cleaned": "SELECT *, height_used AS assumed_height FROM heights WHERE year_built>0 AND gfa>0 AND (height_num IS NULL OR height_num>0) AND height_used>0",
    # Votes of open rows as (id, code letter, class, votes), one row per candidate class.
    "ballots": "SELECT build_id, UNNEST(['A','C','E','G','I','S','R']) AS code, "
    "UNNEST(['Agriculture','Commercial','Education','Government','Industrial','Assembly','Residential']) AS cls, "
    "UNNEST(['AGR','COM','EDU','GOV','IND','REL','RES']) AS vote, "
    "UNNEST(list_transform(regexp_extract_all(occ_dict, '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS n "
    "FROM cleaned WHERE (occ_cls IS NULL OR occ_cls='Unclassified') AND occ_dict IS NOT NULL",
    "verdicts": "SELECT build_id, CASE WHEN SUM(n)=0 THEN 'none' WHEN COUNT(*) FILTER (WHERE n=top)>1 THEN 'tie' ELSE 'changed' END AS outcome, "
    "MIN(cls) FILTER (WHERE n=top) AS first_cls, MIN(vote) FILTER (WHERE n=top) AS first_vote, MIN(top) AS top, "
    "string_agg(code || ':' || n, ', ' ORDER BY code) FILTER (WHERE n=top) AS tie_text, "
    "COUNT(*) FILTER (WHERE n>0) AS n_types "
    "FROM (SELECT *, MAX(n) OVER (PARTITION BY build_id) AS top FROM ballots) GROUP BY build_id",
    "resolved": "SELECT c.* REPLACE (CASE WHEN v.outcome='changed' THEN v.first_cls ELSE c.occ_cls END AS occ_cls), c.occ_cls AS occ_cls_orig, "
    "CASE WHEN c.occ_cls IS NULL OR c.occ_cls='Unclassified' THEN COALESCE(v.outcome,'none') END AS outcome, "
    "CASE WHEN v.outcome='changed' THEN v.first_cls END AS vote_class, CASE WHEN v.outcome='tie' THEN v.tie_text END AS tie, v.n_types "
    "FROM cleaned c LEFT JOIN verdicts v USING (build_id)",
    # The winner's own type always has votes here, so only two of the four mix rules can apply.
    "prepared": "SELECT * REPLACE (CASE WHEN occ_cls_orig='Unclassified' AND occ_cls<>'Unclassified' "
    "THEN CASE WHEN n_types=1 THEN NULL ELSE 'MIX_SC2' END ELSE mix_sc END AS mix_sc), "
    "CASE WHEN eng_property IS NULL THEN NULL WHEN eng_property<=0.17 THEN 'Favorable' WHEN eng_property<=0.24 THEN 'Fair' "
    "WHEN eng_property<=0.32 THEN 'Poor' ELSE 'Very poor' END AS eng_class FROM resolved",
    "cluster_rows": "SELECT build_id, occ_cls, gfa, sqmeters, height_used, pred_height, year_built, material_type, foundation_type FROM prepared "
    "WHERE occ_cls IS NOT NULL AND gfa IS NOT NULL AND sqmeters IS NOT NULL AND height_used IS NOT NULL AND pred_height IS NOT NULL "
    "AND year_built IS NOT NULL AND material_type IS NOT NULL AND foundation_type IS NOT NULL",
    "sample_rows": "SELECT *, md5(build_id || '#337') AS hkey FROM prepared WHERE sqmeters IS NOT NULL AND height_used IS NOT NULL AND year_built IS NOT NULL "
    "AND occ_cls IS NOT NULL AND gfa < (SELECT quantile_cont(gfa, 0.99999) FROM prepared WHERE sqmeters IS NOT NULL AND height_used IS NOT NULL "
    "AND year_built IS NOT NULL AND occ_cls IS NOT NULL)",
    "random_rows": "SELECT * FROM sample_rows ORDER BY hkey, build_id LIMIT 75000",
    "balanced_rows": "SELECT * FROM sample_rows QUALIFY ROW_NUMBER() OVER (PARTITION BY occ_cls ORDER BY hkey, build_id)<=2500",
    "sample_chunks": "SELECT *, FLOOR(sample_index/5000)+1 AS chunk_index FROM ("
    "SELECT 'random' AS type, build_id, ROW_NUMBER() OVER (ORDER BY hkey, build_id)-1 AS sample_index FROM random_rows UNION ALL "
    "SELECT 'balanced', build_id, ROW_NUMBER() OVER (ORDER BY hkey, build_id)-1 FROM balanced_rows)",
    "clf": f"SELECT {select_list(standin.CLF_EXPRESSIONS)} FROM buildings",
    "shoreline": "SELECT * EXCLUDE (foundation_type, occ_dict) FROM buildings",
    "nsi_points": "SELECT l_orderkey*10+l_linenumber AS point_id, MIN(l_partkey)%7 AS type_no, "
    "CAST((MIN(o_custkey)*31+l_orderkey)%3600 AS DOUBLE)/1000-73.5E0+(l_linenumber-4)*0.00002E0 AS longitude, "
    "CAST((MIN(o_custkey)*17+l_orderkey*7)%1600 AS DOUBLE)/1000+41.2E0 AS latitude "
    "FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY l_orderkey, l_linenumber",
    "permits": f"SELECT {select_list(standin.PERMIT_EXPRESSIONS)} FROM events",
    "soil_components": f"SELECT {select_list(standin.SOIL_EXPRESSIONS)} FROM part",
    "land_edges": "SELECT n_nationkey AS polygon_id, " + ", ".join(
        f"UNNEST([{', '.join(f'{centre}+({corner[axis]})' for corner in corners)}]) AS {name}"
        for name, centre, axis, corners in (
            ("lon_a", _LON, 0, standin.LAND_CORNERS), ("lat_a", _LAT, 1, standin.LAND_CORNERS),
            ("lon_b", _LON, 0, standin.LAND_CORNERS[1:] + standin.LAND_CORNERS[:1]),
            ("lat_b", _LAT, 1, standin.LAND_CORNERS[1:] + standin.LAND_CORNERS[:1]),
        )) + " FROM nation",
    "footprints": f"SELECT build_id, longitude, latitude, longitude-{_HALF} AS lon_min, longitude+{_HALF} AS lon_max, "
    f"latitude-{_HALF} AS lat_min, latitude+{_HALF} AS lat_max FROM buildings",
    "inside": "SELECT point_id, build_id, type_no FROM nsi_points p JOIN footprints f ON p.longitude BETWEEN lon_min AND lon_max "
    "AND p.latitude BETWEEN lat_min AND lat_max",
    "footprint_votes": "SELECT build_id, " + ", ".join(f"SUM(CASE WHEN type_no={i} THEN 1 ELSE 0 END) AS t{i}" for i in range(7))
    + ", MIN(point_id) AS first_point, COUNT(*) AS n_points FROM inside GROUP BY build_id",
    "point_pairs": "SELECT build_id, point_id, {distance} AS d FROM footprints f JOIN nsi_points p "
    "ON p.latitude BETWEEN f.latitude-0.0001 AND f.latitude+0.0001 AND p.longitude BETWEEN f.longitude-0.0002 AND f.longitude+0.0002 "
    "WHERE NOT EXISTS (SELECT 1 FROM footprint_votes v WHERE v.build_id=f.build_id AND (n_points>1 OR (n_points=1 AND t6=1)))",
    "near_points": "SELECT build_id, arg_min(point_id, {{'d': d, 'p': point_id}}) AS point_id, MIN(d) AS distance_m FROM point_pairs WHERE d<=5 GROUP BY build_id",
    "match_rules": "SELECT build_id, 'single' AS rule FROM footprint_votes WHERE n_points=1 AND t6=1 UNION ALL "
    "SELECT build_id, 'multi' FROM footprint_votes WHERE n_points>1 UNION ALL SELECT build_id, 'nearest' FROM near_points",
    "permit_pairs": "SELECT build_id, permit_id, {distance} AS d FROM buildings f JOIN permits p "
    "ON p.latitude BETWEEN f.latitude-0.0005 AND f.latitude+0.0005 AND p.longitude BETWEEN f.longitude-0.0008 AND f.longitude+0.0008",
    "on_land": "SELECT * FROM prepared b WHERE build_id IN (SELECT build_id FROM ("
    "SELECT b2.build_id, e.polygon_id, COUNT(*) AS crossings FROM buildings b2 JOIN land_edges e ON (lat_a>latitude)<>(lat_b>latitude) "
    "AND longitude < lon_a+(lon_b-lon_a)*((latitude-lat_a)/(lat_b-lat_a)) GROUP BY b2.build_id, e.polygon_id) WHERE crossings%2=1)",
    "year_counts": "SELECT TRUNC(year_built) AS year, occ_cls, COUNT(*) AS n FROM prepared WHERE occ_cls IS NOT NULL GROUP BY 1,2",
    "banded": "SELECT *, CASE WHEN gfa<a33 THEN 'Small' WHEN gfa<a67 THEN 'Medium' ELSE 'Large' END AS area_cat, "
    "CASE WHEN height_used<h33 THEN 'Short' WHEN height_used<h67 THEN 'Mid' ELSE 'High' END AS height_cat, "
    "CASE WHEN year_built<1940 THEN 'Historic (<1940)' WHEN year_built<1980 THEN 'Mid-Century (40-80)' ELSE 'Modern (>1980)' END AS year_cat, "
    "COALESCE(drainagecl,'Unknown Drainage') AS drainage_cat, "
    "CASE WHEN occ_cls IN (SELECT occ_cls FROM prepared WHERE occ_cls IS NOT NULL GROUP BY occ_cls ORDER BY COUNT(*) DESC, occ_cls LIMIT 9) THEN occ_cls ELSE 'Other' END AS occ_cat "
    "FROM prepared, (SELECT quantile_cont(gfa,0.33) AS a33, quantile_cont(gfa,0.67) AS a67, quantile_cont(height_used,0.33) AS h33, quantile_cont(height_used,0.67) AS h67 FROM prepared)",
}
_DISTANCE = (
    "ROUND(2*6371000.0*asin(least(sqrt(pow(sin(radians(p.latitude-f.latitude)/2),2)"
    "+cos(radians(f.latitude))*cos(radians(p.latitude))*pow(sin(radians(p.longitude-f.longitude)/2),2)),1.0)),6)"
)
CTES = {k: v.replace("{distance}", _DISTANCE).replace("{{", "{").replace("}}", "}") for k, v in CTES.items()}


def define(name: str, sql: str) -> None:
    """A further named subquery, built on those defined before."""
    CTES[name] = sql


def _links(scope: str, detail: str, levels: tuple[str, ...], root: str, source: str) -> list[str]:
    out = []
    for step, level in enumerate(levels, 1):
        origin = root if step == 1 else levels[step - 2]
        out.append(
            f"SELECT {scope} AS scope, '{detail}' AS detail, {step} AS step, {origin} AS source, {level} AS target, "
            f"COUNT(*) AS n, SUM(gfa) AS area FROM {source} WHERE {origin} IS NOT NULL AND {level} IS NOT NULL GROUP BY ALL"
        )
    return out


_LEVELS = ("occ_cat", "area_cat", "height_cat", "year_cat", "drainage_cat")
_SHORT = ("occ_cat", "year_cat", "drainage_cat")
define("big_classes", "SELECT * FROM banded WHERE occ_cls IN (SELECT occ_cls FROM prepared GROUP BY occ_cls HAVING COUNT(*)>100)")
define("link_sums", " UNION ALL ".join(
    _links("'all'", "full", _LEVELS, "'All Buildings'", "banded") + _links("'all'", "simplified", _SHORT, "'All Buildings'", "banded")
    + _links("occ_cls", "full", _LEVELS[1:], "occ_cls", "big_classes") + _links("occ_cls", "simplified", _SHORT[1:], "occ_cls", "big_classes")
))
define("hierarchy", "SELECT scope, detail, 'count' AS metric, step, source, target, CAST(n AS DOUBLE) AS value FROM link_sums UNION ALL "
       "SELECT scope, detail, 'gfa', step, source, target, area FROM link_sums")
define("use_links", "SELECT occ_cls, prim_occ, occ_cls || ' (Class)' AS source, CASE WHEN prim_occ='Unclassified' THEN 'Unclassified (from ' || occ_cls || ')' "
       "ELSE prim_occ || ' (Type)' END AS target, COUNT(*) AS value FROM prepared WHERE occ_cls IS NOT NULL AND prim_occ IS NOT NULL GROUP BY occ_cls, prim_occ")
define("vote_rows", "SELECT build_id, COALESCE(occ_cls,'nan') AS occ_cls, split_part(part, ': ', 1) AS vote_type, CAST(split_part(part, ': ', 2) AS BIGINT) AS points "
       "FROM (SELECT build_id, occ_cls, UNNEST(string_split(occ_dict, ', ')) AS part FROM prepared WHERE occ_dict IS NOT NULL)")
define("vote_links", "SELECT metric, occ_cls, vote_type, occ_cls || ' (Class)' AS source, vote_type || ' (from ' || occ_cls || ')' AS target, value FROM ("
       "SELECT 'points' AS metric, occ_cls, vote_type, SUM(points) AS value FROM vote_rows GROUP BY 2,3 UNION ALL "
       "SELECT 'buildings', occ_cls, vote_type, SUM(CASE WHEN points>0 THEN 1 ELSE 0 END) FROM vote_rows GROUP BY 2,3) WHERE value>0")
define("clf_labelled", "SELECT * FROM clf WHERE material_type IS NOT NULL AND general_fnd_type IS NOT NULL AND str_sys_summary IS NOT NULL")
define("clf_sides", "SELECT 'material' AS heatmap, material_type AS row, general_fnd_type AS foundation, gfa FROM clf_labelled UNION ALL "
       "SELECT 'struct', str_sys_summary, general_fnd_type, gfa FROM clf_labelled")
define("clf_grid", "SELECT r.heatmap, r.row, f.foundation, COUNT(s.row) AS n, COALESCE(SUM(s.gfa),0) AS area FROM (SELECT DISTINCT heatmap, row FROM clf_sides) r "
       "JOIN (SELECT DISTINCT heatmap, foundation FROM clf_sides) f USING (heatmap) LEFT JOIN clf_sides s ON s.heatmap=r.heatmap AND s.row=r.row AND s.foundation=f.foundation GROUP BY 1,2,3")
define("eras", "SELECT *, 'all' AS era FROM prepared UNION ALL SELECT *, CASE WHEN year_built<1940 THEN 'pre1940' ELSE 'post1940' END FROM prepared")
define("era_cells", "SELECT * FROM eras WHERE material_type IS NOT NULL AND foundation_type IS NOT NULL")
define("flow_rows", "SELECT CASE WHEN year_built<1940 THEN 'Historic (<1940)' WHEN year_built<1980 THEN 'Mid-Century (1940–1980)' ELSE 'Modern (>1980)' END AS year_band, "
       "occ_cls, COALESCE(material_type,'Unknown') AS material, COALESCE(foundation_type,'Unknown') AS foundation, COALESCE(compname,'Unknown') AS soil, gfa FROM prepared")


def with_ctes(body: str) -> str:
    """``body`` preceded by the named subqueries it needs, directly or not."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", todo.pop())))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    chosen = ", ".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    return f"WITH RECURSIVE {chosen} {body}" if chosen else body


def _final(columns: tuple[tuple[str, str], ...], sql: str) -> str:
    out = [f"ROUND(CAST({n} AS DOUBLE), {DECIMALS}) AS {n}" if kind == "n" else n for n, kind in columns]
    return with_ctes(f"SELECT {', '.join(out)} FROM ({sql}) AS result")
