"""Mixing sources to target weights by budgets on a tree of domains, languages and sources.

Every node has a weight among its siblings and a capacity: its tokens times ``max_epochs``. The
token budget flows down from the root. At each node it is shared by weight; a child that cannot
use its share is filled up, and what it leaves goes to its siblings first. Since a node's
capacity is the sum below it, only what a whole family cannot use reaches the family's siblings.
Budgets are whole tokens, rounded down.

A leaf with budget B and T tokens takes every document B div T times, and of the next epoch's
seeded order the longest run of whole documents from the start that fits in B mod T. With ``cut`` it also takes
what is left of B mod T from the start of the next document, so no budget is lost; without, that rest (less than a
document) goes to nobody. The order is an MD5 of seed, epoch and document. Where the run ends is found without sorting a leaf: token
sums per hash prefix give the prefix in which it ends, and only documents with that prefix are
ordered one by one. The prefix grows longer with the largest leaf, so that this rest stays small.

Defined results: a null level is a node of its own; a null or blank text has 0 tokens and is
taken with the run it falls in, if its leaf gets any budget; rows alike in id, tokens and text
are taken or left together; weights that are missing count as 1, weights of 0 or less take
nothing; an empty table gives an empty table; all other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet.llm.common import boxed, unboxed, words_of
from parapet.staging import stage

SEED = 337
ROWS_PER_PREFIX = 2_000
#: The shares of the registered query: first sources of the tables as domains, then languages; sources are alike.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4"), "forum": ("src5", "src6", "src7", "src8", "src9"), "books": ("src10", "src11", "src12", "src13", "src14")}
WEIGHTS = {"web": 2.0, "forum": 1.0, "books": 4.0, "rest": 1.0, "web/en": 2.0, "forum/en": 2.0, "books/en": 2.0, "rest/en": 2.0}
#: The total as a share of all tokens, and the epochs of a leaf at most.
TOTAL, EPOCHS = 0.6, 2


def domain_of(source: Column) -> Column:
    """The domain of a source by DOMAINS, else ``rest``."""
    named = [F.when(source.isin(*sources), F.lit(name)) for name, sources in DOMAINS.items()]
    return F.coalesce(*named, F.lit("rest"))


def shares(children: DataFrame, parents: Sequence[Column | str]) -> DataFrame:
    """The ``budget`` of each child: ``children`` has its parent's columns and ``given``, ``name``, ``weight`` and ``cap``.

    In the order of cap per weight the children that are filled up come first. The first child
    that is not fixes the common rate at which it and all later ones are served.
    """
    full = F.col("cap").cast("double")
    order = W.partitionBy(*parents).orderBy(full / F.col("weight"), "name")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = children.withColumn("rate", (F.col("given") - before) / weights)
    rows = rows.withColumn("filled", full <= F.col("rate") * F.col("weight")).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(~F.col("filled"), F.struct("place", "rate"))).over(W.partitionBy(*parents))
    served = F.floor(first.getField("rate") * F.col("weight"))
    rows = rows.withColumn("budget", F.when(F.col("filled"), full).otherwise(served).cast("long"))
    return rows.drop("rate", "filled", "place", "given")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, float], total: float, max_epochs: int) -> DataFrame:
    """Leaves (``levels`` without nulls, and ``tokens``) with their ``budget``; ``total`` is a share of all tokens."""
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first().tokens
    given = min(int(whole * total), whole * max_epochs)
    out = None
    for depth in range(1, len(levels) + 1):
        path, parents = list(levels[:depth]), list(levels[:depth - 1])
        weight = F.lit(1.0) if named is None else F.coalesce(named[F.concat_ws("/", *path)], F.lit(1.0))
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap"))
        nodes = nodes.withColumn("weight", weight).withColumn("name", F.col(path[-1])).where(F.col("weight") > 0)
        if out is None:
            nodes = nodes.withColumn("given", F.lit(given).cast("long"))
        else:
            nodes = nodes.join(out.select(*parents, F.col("budget").alias("given")), parents)
        out = shares(nodes, parents or [F.lit(0)])
    return leaves.join(out.select(*levels, "budget"), list(levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0)).cast("long"))


def plan(narrow: DataFrame, levels: Sequence[str], weights: Mapping[str, float], total: float, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: ``budget``, full ``epochs``, ``cut``, the last order key taken of the next epoch (null: none), and ``part``, the key after it with the tokens left for it.

    ``narrow`` has the levels, ``tokens`` and ``identity`` (the text that is hashed into the order).
    """
    leaves = narrow.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = stage(leaves, "mix-leaves")
    most = leaves.agg(F.max("n")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(most / ROWS_PER_PREFIX, 1), 16)))
    given = budgets(leaves, levels, weights, total, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    given = given.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("tokens", "n")
    given = stage(given, "mix-budgets")
    keyed = narrow.join(given.where(F.col("rest") > 0), list(levels)).withColumn("key", order_key(F.col("epochs"), F.col("identity"), seed))
    keyed = keyed.withColumn("prefix", F.substring("key", 1, digits))
    sums = keyed.groupBy(*levels, "prefix").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest"))
    before = F.sum("sum").over(W.partitionBy(*levels).orderBy("prefix")) - F.col("sum")
    # The run ends in the last prefix that begins within the rest; a rest equal to a prefix's end goes on with documents of 0 tokens.
    ends = sums.withColumn("before", before).where(F.col("before") <= F.col("rest")).groupBy(*levels).agg(F.max(F.struct("prefix", "before")).alias("end"))
    tail = keyed.join(ends, list(levels)).where(F.col("prefix") == F.col("end.prefix"))
    tail = tail.groupBy(*levels, "key").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("alike"), F.max("rest").alias("rest"), F.max("end.before").alias("before"))
    upto = F.col("before") + F.sum("tokens").over(W.partitionBy(*levels).orderBy("key"))
    # The first key that does not fit gives what is left, shared by the rows of that key.
    left = F.col("rest") - (F.col("upto") - F.col("tokens"))
    part = F.struct("key", F.floor(left / F.col("alike")).cast("long").alias("tokens"))
    last = tail.withColumn("upto", upto).groupBy(*levels).agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("last"), F.min(F.when(F.col("upto") > F.col("rest"), part)).alias("part")
    )
    cuts = ends.join(last, list(levels), "left").select(*levels, F.coalesce("last", F.col("end.prefix")).alias("cut"), "part")
    return given.join(cuts, list(levels), "left").select(*levels, "budget", "epochs", "cut", "part")


def order_key(epoch: Column, identity: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), identity))


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, float], total: float, key: str = "doc_id", text: str = "text",
    max_epochs: int = 2, seed: int = SEED, cut: bool = False,
) -> DataFrame:
    """The chosen rows of ``docs`` with the levels' names, ``n_tokens`` (words) and ``n_copies``, how often each is taken.

    With ``cut`` there is also ``n_part``: the first tokens of a row that are taken once more, not 0 for the rows of one
    document a leaf; such a row may have no whole copy. :func:`first_words` cuts its text.
    ``levels`` maps level names, root first, to expressions over ``docs``; a null becomes ``null``.
    """
    names = list(levels)
    named = {name: F.coalesce(c.cast("string"), F.lit("null")) for name, c in levels.items()}
    tokens = F.size(words_of(F.col(text))).cast("long")
    tokens = F.when(F.col(text).isNull(), F.lit(0)).otherwise(tokens)
    identity = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")))
    base = boxed(docs, **{f"level_{i}": c for i, c in enumerate(named.values())}, tokens=tokens.cast("long"), identity=identity)
    inner = [f"level_{i}" for i in range(len(names))]
    narrow = stage(base.select(*inner, "tokens", "identity"), "mix-narrow")
    # Written, so that Spark knows how small it is and can send it to the rows instead of the rows to it.
    by_depth = stage(plan(narrow, inner, weights, total, max_epochs, seed), "mix-plan")
    joined = base.join(by_depth, inner)
    part = F.col("cut").isNotNull() & (order_key(F.col("epochs"), F.col("identity"), seed) <= F.col("cut"))
    joined = joined.withColumn("copies", F.col("epochs") + F.when(part, F.lit(1)).otherwise(F.lit(0)))
    more = F.coalesce(F.when(order_key(F.col("epochs"), F.col("identity"), seed) == F.col("part.key"), F.col("part.tokens")), F.lit(0).cast("long"))
    joined = joined.withColumn("more", more if cut else F.lit(0)).where("copies > 0 OR more > 0")
    taken = {c.lower() for c in docs.columns}
    extra = {name: F.col(c) for name, c in zip(names, inner) if name.lower() not in taken}
    parts = {"n_part": F.col("more")} if cut else {}
    return unboxed(joined, docs.columns, **extra, n_tokens=F.col("tokens"), n_copies=F.col("copies").cast("long"), **parts)


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, white space before and between them as it is."""
    # Words and the runs before them, in turn; a run may be empty only before the first word.
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n), "")


def _sql() -> str:
    domain = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{name}'" for name, sources in DOMAINS.items())
    weight = lambda path: "CASE " + path + " " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
    names = ("domain", "lang", "source")
    parts = [
        "t AS (SELECT doc_id, CASE " + domain + " ELSE 'rest' END AS domain, coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source, "
        r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens, "
        "coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') AS identity FROM documents)",
        "leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL)",
    ]
    for depth in (1, 2, 3):
        path, parents = list(names[:depth]), list(names[:depth - 1])
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        given = f"(SELECT CAST(floor(sum(tokens) * {TOTAL}) AS BIGINT) FROM leaf)" if depth == 1 else "g.budget"
        source = "n" if depth == 1 else f"n JOIN b{depth - 1} g USING ({', '.join(parents)})"
        parts.append(
            f"b{depth} AS (WITH n AS (SELECT {', '.join(path)}, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS cap, {weight(' || chr(47) || '.join(path))} AS w FROM leaf GROUP BY {', '.join(path)}), "
            f"r AS (SELECT {', '.join(path)}, cap, w, ({given} - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
            f"/ sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, row_number() OVER o AS place FROM {source} "
            f"WINDOW o AS ({by} ORDER BY cap / w, {path[-1]})), "
            f"f AS (SELECT *, cap <= rate * w AS filled FROM r) "
            f"SELECT {', '.join(path)}, CAST(CASE WHEN filled THEN cap ELSE floor(w * (min({{'place': place, 'rate': rate}}) FILTER (WHERE NOT filled) OVER ({by})).rate) END AS BIGINT) AS budget FROM f)"
        )
    parts += [
        "p AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM leaf JOIN b3 USING (domain, lang, source))",
        "k AS (SELECT t.*, epochs, budget - epochs * tokens AS rest, "
        f"md5('{SEED}:' || epochs || ':' || identity) AS key FROM t JOIN p USING (domain, lang, source))",
        "c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, "
        "sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS own, count(*) OVER (PARTITION BY domain, lang, source, key) AS alike FROM k)",
    ]
    return (
        "WITH " + ", ".join(parts) + " SELECT * FROM (SELECT doc_id, domain, lang, source, n_tokens, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n_copies, "
        "CAST(CASE WHEN upto > rest AND upto - own < rest THEN (rest - upto + own) // alike ELSE 0 END AS BIGINT) AS n_part FROM c) AS taken "
        "WHERE n_copies > 0 OR n_part > 0"
    )


SQL = _sql()
