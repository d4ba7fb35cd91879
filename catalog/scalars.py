"""Entries for bands, labels, vote parsing and other row-wise functions."""

from pyspark.sql import functions as F

from catalog.registry import add
from parapet.functions import bands as B
from parapet.functions import numbers as N
from parapet.functions import votes as V
from parapet.functions.text import UNKNOWN, has_text, is_unclassified
from parapet.operators import classes, crosstab, flows
from parapet.sources import standin
from parapet.sources.schema import id_column

add("c1_year_bands", "build_id:n hierarchy:t flow:t",
    lambda c: c.raw_plain.select("build_id", B.year_band(F.col("year_built"), B.YEAR_LABELS_HIERARCHY).alias("hierarchy"),
                                 B.year_band(F.col("year_built"), B.YEAR_LABELS_FLOW).alias("flow")),
    "SELECT build_id, CASE WHEN year_built<0 THEN NULL WHEN year_built<1940 THEN 'Historic (<1940)' WHEN year_built<1980 THEN 'Mid-Century (40-80)' WHEN year_built>=1980 THEN 'Modern (>1980)' END AS hierarchy, "
    "CASE WHEN year_built<0 THEN NULL WHEN year_built<1940 THEN 'Historic (<1940)' WHEN year_built<1980 THEN 'Mid-Century (1940–1980)' WHEN year_built>=1980 THEN 'Modern (>1980)' END AS flow FROM buildings")
add("c2_quantile_bands", "build_id:n area_cat:t height_cat:t",
    lambda c: flows.with_bands(c.cleaned_plain, flows.terciles(c.cleaned_plain)),
    "SELECT build_id, area_cat, height_cat FROM banded")
add("c3_engineering_bands", "build_id:n eng_class:t",
    lambda c: c.raw_plain.select("build_id", B.engineering_class(F.col("eng_property")).alias("eng_class")),
    "SELECT build_id, CASE WHEN eng_property IS NULL THEN NULL WHEN eng_property<=0.17 THEN 'Favorable' WHEN eng_property<=0.24 THEN 'Fair' "
    "WHEN eng_property<=0.32 THEN 'Poor' ELSE 'Very poor' END AS eng_class FROM buildings")
add("c4_null_label", "build_id:n drainage:t material:t soil:t",
    lambda c: c.raw_plain.select("build_id", F.coalesce("drainagecl", F.lit("Unknown Drainage")).alias("drainage"),
                                 F.coalesce("material_type", F.lit(UNKNOWN)).alias("material"), F.coalesce("compname", F.lit(UNKNOWN)).alias("soil")),
    "SELECT build_id, COALESCE(drainagecl,'Unknown Drainage') AS drainage, COALESCE(material_type,'Unknown') AS material, COALESCE(compname,'Unknown') AS soil FROM buildings")
add("c5_top_n_recode", "build_id:n occ_cat:t", lambda c: flows.grouped_classes(c.prepared, 5),
    "SELECT build_id, CASE WHEN occ_cls IN (SELECT occ_cls FROM prepared WHERE occ_cls IS NOT NULL GROUP BY occ_cls ORDER BY COUNT(*) DESC, occ_cls LIMIT 5) THEN occ_cls ELSE 'Other' END AS occ_cat FROM prepared")
add("c6_display_year", "build_id:n display_year:t",
    lambda c: c.cleaned_plain.select("build_id", B.display_year(F.col("year_built")).alias("display_year")),
    "SELECT build_id, CASE WHEN year_built<1940 THEN 'pre-1940' ELSE CAST(CAST(year_built AS BIGINT) AS VARCHAR) END AS display_year FROM cleaned")
add("c7_decade_label", "build_id:n decade:t",
    lambda c: c.cleaned_plain.select("build_id", B.decade_label(F.col("year_built")).alias("decade")),
    "SELECT build_id, CAST(CAST(FLOOR(year_built/10)*10 AS BIGINT) AS VARCHAR) || 's' AS decade FROM cleaned")
# The vote text gets odd spellings: lower case, no blanks, fractions, a repeated code behind other letters.
_ODD_TEXT = "CASE k%4 WHEN 0 THEN LOWER(occ_dict) WHEN 1 THEN CONCAT(REPLACE(occ_dict,' ',''),'.9; XRES : -2') WHEN 2 THEN CONCAT('{',REPLACE(occ_dict,',',';'),', RES: 4}') ELSE occ_dict END".replace("k%4", "build_id%4")


def _tokens(c):
    odd = c.raw.selectExpr("build_id", f"{_ODD_TEXT} AS t").where("t IS NOT NULL")
    found = odd.withColumn("found", V.tokens("t"))
    return found.select("build_id", *[V.votes_for("found", x).alias(x.lower()) for x in standin.VOTE_ORDER])


def _listed(c):
    odd = c.raw.selectExpr("build_id", f"{_ODD_TEXT} AS t").where("t IS NOT NULL")
    return odd.select("build_id", F.inline(V.listed("t"))).withColumnRenamed("type", "vote_type")


_COUNT = {x: f"CAST(regexp_extract(occ_dict, '{x}: ([0-9]+)', 1) AS BIGINT)" for x in standin.VOTE_ORDER}
add("c8_vote_tokens", "build_id:n " + " ".join(f"{x.lower()}:n" for x in standin.VOTE_ORDER), _tokens,
    "SELECT build_id, " + ", ".join(
        f"{sql}" + (" + CASE build_id%4 WHEN 1 THEN -2 WHEN 2 THEN 4 ELSE 0 END" if x == "RES" else "") + f" AS {x.lower()}"
        for x, sql in _COUNT.items()) + " FROM buildings WHERE occ_dict IS NOT NULL")
# The list reading keeps case; 'RES: n.9; XRES : -2' splits at the semicolon, the last RES entry wins.
add("c9_vote_list", "build_id:n vote_type:t points:n", _listed,
    " UNION ALL ".join(
        f"SELECT build_id, CASE WHEN build_id%4=0 THEN '{x.lower()}' ELSE '{x}' END AS vote_type, "
        + ("CASE WHEN build_id%4=2 THEN 4 ELSE " + sql + " END" if x == "RES" else sql) + " AS points FROM buildings WHERE occ_dict IS NOT NULL"
        for x, sql in _COUNT.items())
    + " UNION ALL SELECT build_id, 'XRES', -2 FROM buildings WHERE occ_dict IS NOT NULL AND build_id%4=1")
add("c10_has_text", "build_id:n has_votes:b has_padded:b",
    lambda c: c.raw.select("build_id", has_text(F.col("occ_dict")).alias("has_votes"),
                           has_text(F.expr("CASE build_id%4 WHEN 0 THEN '  ' WHEN 1 THEN ' NaN ' WHEN 2 THEN mix_sc END")).alias("has_padded")),
    "SELECT build_id, occ_dict IS NOT NULL AS has_votes, build_id%4=2 AS has_padded FROM buildings")
add("c11_vote_winner", "build_id:n occ_cls:t outcome:t vote_class:t", lambda c: classes.vote_outcome(c.cleaned),
    "SELECT build_id, occ_cls_orig AS occ_cls, outcome, vote_class FROM resolved")
add("c12_tie_key", "build_id:n tie:t", lambda c: c.resolved.where("tie IS NOT NULL"),
    "SELECT build_id, tie FROM resolved WHERE tie IS NOT NULL")
_LEGEND = "(VALUES ('Residential','R','RES'),('Commercial','C','COM'),('Industrial','I','IND'),('Agriculture','A','AGR'),('Government','G','GOV'),('Education','E','EDU'),('Assembly','S','REL'))"
add("c13_class_codes", "build_id:n occ_cls:t code:t back:t",
    lambda c: c.raw_plain.select("build_id", "occ_cls", V.class_to_code(F.col("occ_cls")).alias("code")).withColumn("back", V.code_to_class(F.col("code"))),
    f"SELECT build_id, occ_cls, code, name AS back FROM buildings LEFT JOIN {_LEGEND} AS l(name, code, vote) ON occ_cls=name")
add("c14_mix_rule", "build_id:n occ_cls:t mix_sc:t", lambda c: c.prepared, "SELECT build_id, occ_cls, mix_sc FROM prepared")
# Votes for homes and up to two other types, by the id, judged for a home: every rule occurs.
_FEW_VOTES = "CASE build_id%5 WHEN 0 THEN 'RES: 3' WHEN 1 THEN 'RES: 3, COM: 1, XYZ: 0' WHEN 2 THEN 'COM: 2, RES: 0' WHEN 3 THEN 'COM: 2; ABC: 1' ELSE 'RES: 0, COM: -1' END"


def _mix_cases(c):
    judged = c.raw_plain.selectExpr("build_id", "mix_sc AS before", f"{_FEW_VOTES} AS t").withColumn("found", V.tokens("t"))
    return judged.withColumn("rule", V.mix_rule("found", "'RES'")).withColumn("mix_sc", V.apply_mix(F.col("rule"), F.col("before")))


add("c14_mix_cases", "build_id:n rule:t mix_sc:t", _mix_cases,
    "SELECT build_id, CASE build_id%5 WHEN 0 THEN 'same' WHEN 1 THEN 'MIX_SC2' WHEN 2 THEN 'MIX_SC1' WHEN 3 THEN 'MIX_SC3' ELSE 'keep' END AS rule, "
    "CASE build_id%5 WHEN 0 THEN NULL WHEN 1 THEN 'MIX_SC2' WHEN 2 THEN 'MIX_SC1' WHEN 3 THEN 'MIX_SC3' ELSE mix_sc END AS mix_sc FROM buildings")
add("c15_band_texts", "band:t description:t", lambda c: flows.band_descriptions(c.cleaned_plain, flows.terciles(c.cleaned_plain)),
    "SELECT UNNEST(['Area','Height','Year','Drainage']) AS band, UNNEST([printf('Small (<%.0f sqm), Medium (%.0f-%.0f sqm), Large (>%.0f sqm)', a, a, b, b), "
    "printf('Short (<%.1fm), Mid (%.1f-%.1fm), High (>%.1fm)', h, h, i, i), 'Historic (<1940), Mid-Century (1940-1980), Modern (>1980)', "
    "'Multiple classes including Well, Moderately, Poorly drained, etc.']) AS description FROM (SELECT quantile_cont(gfa,0.33) AS a, quantile_cont(gfa,0.67) AS b, "
    "quantile_cont(height_used,0.33) AS h, quantile_cont(height_used,0.67) AS i FROM cleaned)")
add("c16_edge_labels", "occ_cls:t prim_occ:t source:t target:t", lambda c: flows.class_use_links(c.prepared),
    "SELECT occ_cls, prim_occ, source, target FROM use_links")
add("c17_cell_key", "build_id:n cell:t",
    lambda c: c.raw_plain.dropna("any", subset=["material_type", "foundation_type"]).withColumn("cell", crosstab.cell_key(F.col("material_type"), F.col("foundation_type"))),
    "SELECT build_id, material_type || '_' || foundation_type AS cell FROM buildings WHERE material_type IS NOT NULL AND foundation_type IS NOT NULL")
add("c18_truncate", "occ_cls:t avg_year:n shifted:n",
    lambda c: c.prepared.where("occ_cls IS NOT NULL").groupBy("occ_cls").agg(
        N.truncate(F.avg("year_built")).alias("avg_year"), N.truncate(F.avg("year_built") - 2100).alias("shifted")),
    "SELECT occ_cls, TRUNC(AVG(year_built)) AS avg_year, TRUNC(AVG(year_built)-2100) AS shifted FROM prepared WHERE occ_cls IS NOT NULL GROUP BY occ_cls")
add("c19_percent", "occ_cls:t pct:n",
    lambda c: c.prepared.where("occ_cls IS NOT NULL").groupBy("occ_cls").agg(
        N.percent(F.count_if(F.col("year_built") < 1940), F.count(F.lit(1))).alias("pct")),
    "SELECT occ_cls, ROUND(100.0*COUNT(*) FILTER (WHERE year_built<1940)/COUNT(*),2) AS pct FROM prepared WHERE occ_cls IS NOT NULL GROUP BY occ_cls")


def _chosen_id(c):
    renamed = c.raw_plain.select(F.col("build_id").alias("OBJECTID"), F.col("mukey").alias("id"), "occ_cls")
    chosen = id_column(renamed.columns)
    return renamed.select(F.lit(chosen).alias("id_field"), F.col(chosen).alias("build_id"))


add("c20_id_column", "id_field:t build_id:n", _chosen_id, "SELECT 'OBJECTID' AS id_field, build_id FROM buildings")
_PADDED = "CASE WHEN build_id%3=0 THEN CONCAT(' ',LOWER(occ_cls),'  ') ELSE occ_cls END"
add("c21_unclassified", "build_id:n open:b",
    lambda c: c.raw_plain.select("build_id", is_unclassified(F.expr(_PADDED)).alias("open")),
    "SELECT build_id, occ_cls IS NULL OR occ_cls='Unclassified' AS open FROM buildings")
add("c22_original_label", "build_id:n occ_cls:t occ_cls_orig:t", lambda c: c.resolved, "SELECT build_id, occ_cls, occ_cls_orig FROM resolved")

add("j6_class_lookup", "build_id:n vote_type:t",
    lambda c: c.raw_plain.select("build_id", V.class_to_vote_type(F.col("occ_cls")).alias("vote_type")),
    f"SELECT build_id, vote AS vote_type FROM buildings LEFT JOIN {_LEGEND} AS l(name, code, vote) ON occ_cls=name")
