"""Line dedup by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. For every line the pages of the host that contain it are counted and
divided by the pages of the host; a line on more than ``ratio`` of them, and on ``min_pages`` at
least, is boilerplate there and dropped from every page of the host. Exact copies of a page
count as one page, so a page does not become boilerplate by being copied. Lines are compared
without blanks at their ends.

Counting shuffles 128-bit hashes of lines and pages, reduced map-side, never texts. The drop list
of a page is found by joins that Spark may broadcast only below its own size threshold, and
adaptive execution splits a crowded host or page there.

Defined results: a null host is a host of its own; a null text stays null and has no lines;
blank lines are not counted and stay; a text that loses all its lines becomes empty; repeated
rows each keep their row; an empty table gives an empty table; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import boxed, unboxed

RATIO, MIN_PAGES = 0.1, 5
_BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _mark(line: Column) -> Column:
    """A 128-bit hash: two 64-bit ones with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _filled(text: Column) -> Column:
    bare = F.transform(F.split(text, "\n"), _bare)
    return F.filter(bare, lambda s: s != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, mark) of boilerplate lines; ``pages`` has host, page and text."""
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(_filled(F.col("text")), _mark))).alias("mark"))
    counts = lines.groupBy("host", "mark").agg(F.count_distinct("page").alias("n"))
    totals = pages.groupBy("host").agg(F.count_distinct("page").alias("total"))
    frequent = counts.where(F.col("n") >= min_pages).join(totals, "host")
    return frequent.where(F.col("n") > ratio * F.col("total")).select("host", "mark")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with cleaned texts and the columns ``n_lines`` (filled lines before) and ``n_dropped``."""
    own = F.when(F.col(host).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(host).cast("string")))
    base = boxed(docs, host=own, page=F.md5(F.col(text).cast("binary")), text=F.col(text))
    pages = base.select("host", "page", "text")
    bad = boilerplate(pages, ratio, min_pages)
    found = pages.select("host", "page", F.explode(F.array_distinct(F.transform(_filled(F.col("text")), _mark))).alias("mark"))
    drops = found.join(bad, ["host", "mark"], "left_semi").groupBy("host", "page").agg(F.collect_set("mark").alias("drops"))
    joined = base.join(drops, ["host", "page"], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda s: ~F.array_contains(F.col("drops"), _mark(_bare(s))))
    empty = F.forall(kept, lambda s: _bare(s) == "")
    cleaned = F.when(F.col("drops").isNull(), F.col("text")).when(empty, F.lit("")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(_filled(F.col("text"))), F.lit(0))
    dropped = F.when(F.col("drops").isNull(), F.lit(0)).otherwise(
        F.size(F.filter(lines, lambda s: F.array_contains(F.col("drops"), _mark(_bare(s)))))
    )
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines)
    return unboxed(joined, docs.columns, **{text: cleaned, "n_lines": n_lines.cast("long"), "n_dropped": dropped.cast("long")})


SQL = r"""
WITH p AS (
  SELECT doc_id, text, coalesce('=' || source, 'null') AS host, md5(text) AS page, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT DISTINCT host, page, trim(ln, ' ' || chr(9) || chr(13)) AS t FROM (SELECT host, page, unnest(ls) AS ln FROM p)
), bad AS (
  SELECT host, t FROM (SELECT host, t, count(*) AS n FROM l WHERE t <> '' GROUP BY host, t)
  JOIN (SELECT host, count(DISTINCT page) AS total FROM p GROUP BY host) USING (host) WHERE n >= 5 AND n > 0.1 * total
), drops AS (
  SELECT host, page, list(t) AS ts FROM l JOIN bad USING (host, t) GROUP BY host, page
), out AS (
  SELECT doc_id, text, ls, coalesce(ts, []) AS ts FROM p LEFT JOIN drops USING (host, page)
), cut AS (
  SELECT doc_id, text, ts, len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS n_lines,
         len(list_filter(ls, lambda x: list_contains(ts, trim(x, ' ' || chr(9) || chr(13))))) AS n_dropped,
         list_filter(ls, lambda x: NOT list_contains(ts, trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM out
), fin AS (
  SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
         CASE WHEN len(ts) = 0 THEN text WHEN len(list_filter(kept, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) = 0 THEN ''
              ELSE array_to_string(kept, chr(10)) END AS t FROM cut
)
SELECT doc_id, n_lines, n_dropped, length(t) AS n_chars, md5(t) AS text_md5 FROM fin
"""
