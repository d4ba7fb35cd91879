"""Reading vote strings such as ``RES: 1, COM: 0`` and deciding on them, row by row.

Two readings exist because two reports define them differently: the *token* reading
(any ``ABC: number`` found anywhere, repeated codes added up) decides the class, the
*list* reading (comma separated pairs, the last repeat wins) feeds the vote flow.
Everything is one SQL expression per function: no shuffle, no Python in the tasks. The
functions take the name of the text column.

``bind`` evaluates a value once per row and names it. Inside a lambda body Spark does not
share repeated expressions, so a parsed list mentioned twice would be parsed twice.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.functions.text import has_text

# The vote token pattern, and class, code and vote type of each candidate.
VOTE_TOKEN = r"(?i)([A-Z]{3})\s*:\s*(-?\d+(\.\d+)?)"
CANDIDATES = (
    ("Residential", "R", "RES"),
    ("Commercial", "C", "COM"),
    ("Industrial", "I", "IND"),
    ("Agriculture", "A", "AGR"),
    ("Government", "G", "GOV"),
    ("Education", "E", "EDU"),
    ("Assembly", "S", "REL"),
)


def _literal_map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def class_to_code(c: Column) -> Column:
    return F.try_element_at(_literal_map([(name, code) for name, code, _ in CANDIDATES]), c)


def code_to_class(c: Column) -> Column:
    return F.try_element_at(_literal_map([(code, name) for name, code, _ in CANDIDATES]), c)


def class_to_vote_type(c: Column) -> Column:
    return F.try_element_at(_literal_map([(name, vote) for name, _, vote in CANDIDATES]), c)


def _bind(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# --- the token reading ----------------------------------------------------------------------
def _tokens(column: str) -> str:
    parsed = (
        "named_struct('code', upper(substr(t, 1, 3)), "
        "'votes', try_cast(try_cast(substring_index(t, ':', -1) AS DOUBLE) AS BIGINT))"
    )
    return f"filter(transform(regexp_extract_all({column}, r'{VOTE_TOKEN}', 0), t -> {parsed}), t -> t.votes IS NOT NULL)"


def _votes_for(found: str, vote_type: str) -> str:
    return f"aggregate({found}, 0L, (total, t) -> total + IF(t.code = '{vote_type}', t.votes, 0L))"


def _scores(found: str) -> str:
    """One struct<name,code,type,votes> per candidate."""
    entries = [
        f"named_struct('name', '{name}', 'code', '{code}', 'type', '{vote}', 'votes', {_votes_for(found, vote)})"
        for name, code, vote in CANDIDATES
    ]
    return f"array({', '.join(entries)})"


def _winners(scored: str) -> str:
    """The candidates that share the highest vote; null when all votes add up to zero."""
    top = _bind("top", f"array_max(transform({scored}, s -> s.votes))", f"filter({scored}, s -> s.votes = top)")
    return f"IF(aggregate({scored}, 0L, (total, s) -> total + s.votes) <> 0, {top}, NULL)"


def _tie(winners: str) -> str:
    """``C:1, R:1`` with the codes in order."""
    return f"array_join(array_sort(transform({winners}, s -> concat(s.code, ':', CAST(s.votes AS STRING)))), ', ')"


def _mix_rule(found: str, own: str) -> str:
    """Which mix label the positive votes imply, given the vote type of the class.

    ``same`` when only the own type has votes, ``keep`` when nothing has.
    """
    codes = f"array_distinct(transform(filter({found}, t -> t.votes > 0), t -> t.code))"
    has_own = f"array_contains(codes, {own})"
    label = (
        f"CASE WHEN {has_own} AND size(codes) = 1 THEN 'same' WHEN {has_own} THEN 'MIX_SC2' "
        "WHEN size(codes) = 1 THEN 'MIX_SC1' WHEN size(codes) > 1 THEN 'MIX_SC3' ELSE 'keep' END"
    )
    return _bind("codes", codes, label)


def tokens(column: str) -> Column:
    """array<struct<code,votes>> of every token, in order, votes cut toward zero."""
    return F.expr(_tokens(column))


def votes_for(found: str, vote_type: str) -> Column:
    """Sum of the tokens of one vote type; ``found`` names a column made by :func:`tokens`."""
    return F.expr(_votes_for(found, vote_type))


def mix_rule(found: str, own: str) -> Column:
    return F.expr(_mix_rule(found, own))


def implied_mix_rule(column: str, name: str) -> Column:
    """The mix rule of a vote text for the class in the column ``name``; null for a class without a vote type."""
    own = "CASE " + " ".join(f"WHEN {name} = '{label}' THEN '{vote}'" for label, _, vote in CANDIDATES) + " END"
    rule = _bind("own", own, f"IF(own IS NULL, NULL, {_mix_rule('found', 'own')})")
    return F.expr(_bind("found", _tokens(column), rule))


def decide(column: str) -> Column:
    """struct<outcome,name,tie,rule> for one vote text, parsed once.

    ``outcome`` is changed, tie or none; ``rule`` is the mix rule that a winner implies.
    """
    one, several = "size(winners) = 1", "size(winners) > 1"
    verdict = (
        f"named_struct('outcome', CASE WHEN {one} THEN 'changed' WHEN {several} THEN 'tie' ELSE 'none' END, "
        f"'name', IF({one}, winners[0].name, NULL), 'tie', IF({several}, {_tie('winners')}, NULL), "
        f"'rule', IF({one}, {_mix_rule('found', 'winners[0].type')}, NULL))"
    )
    judged = _bind("scored", _scores("found"), _bind("winners", _winners("scored"), verdict))
    return F.expr(_bind("found", _tokens(column), judged))


def apply_mix(rule: Column, current: Column) -> Column:
    """The mix label after a rule; one type only is written as null."""
    return F.when(rule == "same", F.lit(None).cast("string")).when(rule == "keep", current).otherwise(rule)


# --- the list reading -----------------------------------------------------------------------
_SPACE = r"' \t\n\r\u000B\u000C'"
_NUMBER = r"r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _whole_number(text: str) -> str:
    """Text to whole number, 0 when it is none (digits may be grouped by underscores)."""
    plain = f"regexp_replace(btrim({text}, {_SPACE}), r'(?<=\\d)_(?=\\d)', '')"
    number = f"IF({plain} RLIKE {_NUMBER}, try_cast({plain} AS DOUBLE), NULL)"
    return f"coalesce(try_cast({text} AS BIGINT), try_cast({number} AS BIGINT), 0L)"


def listed(column: str) -> Column:
    """array<struct<type,points>> of a delimited list; of a repeated type the last entry stays."""
    body = f"btrim(btrim({column}, {_SPACE}), '{{}}')"
    parts = f"filter(split(replace({body}, ';', ','), ','), p -> contains(p, ':'))"
    points = _whole_number("substr(p, instr(p, ':') + 1)")
    pairs = f"transform({parts}, p -> named_struct('type', btrim(substring_index(p, ':', 1), {_SPACE}), 'points', {points}))"
    later = "exists(slice(pairs, i + 2, greatest(size(pairs), 1)), o -> o.type = e.type)"
    repeated = "size(array_distinct(transform(pairs, e -> e.type))) < size(pairs)"
    return F.expr(_bind("pairs", pairs, f"IF({repeated}, filter(pairs, (e, i) -> NOT {later}), pairs)"))


def listed_if_text(column: str) -> Column:
    return F.when(has_text(F.col(column)), listed(column))
