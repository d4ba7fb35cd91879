"""Line-first quality rules, with DataFrame functions only and without a shuffle.

Base measures are taken on the whole text. Then every line with a word is judged by itself: it
fails without closing punctuation, as a navigation line (three separators or more, one per five
words at least), or as a short boilerplate line (licence, rights, cookie or script notices).
Failed lines are removed, and a document that loses more than ``max_lost`` of the characters of
its filled lines is rejected.

Defined results: a null, empty or blank text has all measures 0, fails the base test and is not
kept; white space is space and tab to carriage return; n_dup_lines compares whole lines;
repeated rows each keep their row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import SPACES, let, words_of

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST, NOTICE_CHARS = 50, 50, 0.5, 200
SYMBOLS = "#*$%&|<>"
# Marks that end a sentence or a phrase, by script: Latin, Greek, Armenian, Arabic and Urdu, Devanagari, Tibetan, Myanmar, Ethiopic, Khmer, Chinese and Japanese.
MARKS = ".!?…:;\"'" + "\u037e\u0387" + "։" + "؛؟۔" + "।॥" + "།" + "၊။" + "።፧" + "។៕" + "。！？；：．｡"
#: Such a mark or a closing bracket or quote, in the syntax that Java and RE2 share; Thai and Lao write no marks at line ends.
CLOSING = rf"([{MARKS}\p{{Pe}}\p{{Pf}}]|[\x{{0E00}}-\x{{0EFF}}])[\x20\x09-\x0D]*$"
SEPARATORS = "|»›•·"
NOTICES = (
    "licensed under|released under|all rights reserved|copyright|creative commons|terms of use|terms of service|privacy policy|"
    "cookie|javascript|subscribe|sign in|log in"
)
_FILLED = r"[^\x20\x09-\x0D]"


def _repeated(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by 64-bit hashes. Sorted with their positions, repeated windows are
    neighbours; each one adds the words that the window before it in the text does not cover.
    """
    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1).getField("h").eqNullSafe(x.getField("h"))) | (F.get(s, i + 1).getField("h").eqNullSafe(x.getField("h")))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.getField("p")))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"))
        covered = F.aggregate(let(pairs, positions), start, step, lambda acc: acc["sum"])
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(F.lit(0))

    windows = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 4, let(windows, count)).otherwise(F.lit(0))


def line_passes(line: Column, notices: str = NOTICES) -> Column:
    """Whether a line with a word survives the punctuation, navigation and boilerplate rules; ``notices`` is a pattern over its lower case."""
    separators = F.length(line) - F.length(F.translate(line, SEPARATORS, ""))
    blanks = F.length(line) - F.length(F.translate(line, " ", ""))
    navigation = (separators >= 3) & (separators * 5 >= blanks + 1)
    notice = (F.length(line) <= NOTICE_CHARS) & F.lower(line).rlike(notices)
    return line.rlike(CLOSING) & ~navigation & ~notice


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST, notices: str = NOTICES) -> DataFrame:
    """One row per document: the base measures, the base verdict, ``kept``, text lost to the line rules, and ``cleaned``, the lines that survive them.

    Blank lines are no part of ``cleaned``; a document that is not kept has it too.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.cast("long").alias("n_words"), _repeated(words, n).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        chars = lambda found: F.aggregate(found, F.lit(0), lambda acc, s: acc + F.length(s))
        return let(F.filter(lines, lambda s: line_passes(s, notices)), lambda good: F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), chars(lines).cast("long").alias("line_chars"),
            (chars(lines) - chars(good)).cast("long").alias("lost_chars"), F.array_join(good, "\n").alias("cleaned"),
        ))

    filled = F.filter(F.split(t, "\n"), lambda s: s.rlike(_FILLED))
    rows = docs.select(
        F.col(key), let(words_of(t), of_words).alias("w"), let(filled, of_lines).alias("l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n, repeats = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    lost = F.col("l.lost_chars") > max_lost * F.col("l.line_chars")
    return rows.select(
        key, n.alias("n_words"), "word_chars", "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"), repeats.alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & ~lost).alias("kept"), F.col("l.line_chars").alias("line_chars"), F.col("l.lost_chars").alias("lost_chars"),
        F.col("l.cleaned").alias("cleaned"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), d AS (
  SELECT doc_id, text, row_number() OVER () AS row_no FROM t
), w AS (
  SELECT row_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT row_no, unnest(range(1, len(ws) - 1)) AS i, unnest([[ws[j], ws[j + 1], ws[j + 2]] FOR j IN range(1, len(ws) - 1)]) AS win FROM w WHERE len(ws) >= 3
), rep AS (
  SELECT row_no, i FROM win QUALIFY count(*) OVER (PARTITION BY row_no, win) > 1
), cov AS (
  SELECT row_no, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY row_no
), ln AS (
  SELECT row_no, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d
), marks AS (
  SELECT row_no, line_no, line, length(line) AS n, length(line) - length(translate(line, '|»›•·', '')) AS seps,
         length(line) - length(replace(line, ' ', '')) AS blanks FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT row_no, line_no, line, n, regexp_matches(line, '@CLOSING@') AND NOT (seps >= 3 AND seps * 5 >= blanks + 1)
    AND NOT (n <= 200 AND regexp_matches(lower(line), '@NOTICES@')) AS pass
  FROM marks
), lines AS (
  SELECT row_no, count(*) - count(DISTINCT line) AS n_dup_lines, sum(n) AS line_chars, coalesce(sum(n) FILTER (WHERE NOT pass), 0) AS lost_chars,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE pass), '') AS cleaned FROM judged GROUP BY row_no
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, md5(coalesce(cleaned, '')) AS cleaned_md5
  FROM d JOIN w USING (row_no) LEFT JOIN cov USING (row_no) LEFT JOIN lines USING (row_no)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT lost_chars > 0.5 * line_chars AS kept, line_chars, lost_chars, cleaned_md5 FROM m
""".replace("@CLOSING@", CLOSING.replace("'", "''")).replace("@NOTICES@", NOTICES)
