"""A Merkle manifest of a dataset: one hash tree per group of rows, and a tree over the groups' roots.

Leaves of a group are numbered in the order of their keys: rows are dealt by ranges of (group, key),
numbered within each range, and the counts of the ranges before are added, so neither a large
group nor the table passes one task. Aligned subtrees of BLOCK leaves are built each by one
task in van Emde Boas order (:mod:`veb`) and written; the roots of a group's blocks are the leaves
of its next layer, and so on until one node is left. Proofs come down the same layers: a block
turns the path above it into one path per leaf, found by address arithmetic in its stored layout, so a
join carries one path for a whole block below.

A digest is the SHA-256 of hex digests one after the other; a leaf is that of its row's fields,
each as ``-`` if null, else its length in UTF-8 bytes, ``:``, and its text.

Defined results: rows with the same group and key ascend by their leaf; a null key comes first, as
does the null group; repeated rows are leaves of their own; a tree of one leaf is that leaf, with
no siblings (the digest of an empty proof is that of an empty text); an empty table gives no
rows; columns that are no fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parapet.llm import veb
from parapet.staging import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block and its leaves.
LEVELS = 3
BLOCK = veb.FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch that a task returns.
_ROWS = 4096
_PATH = "array<struct<before:string,after:string>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(df: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", changed: Column | None = None, **values: Column) -> DataFrame:
    """(grp, key, digest, changed): ``changed`` is the leaf with ``values`` in place of its fields where the condition holds, else null."""
    other = F.when(changed, F.unhex(leaf([values.get(f, F.col(f)) for f in fields]))) if changed is not None else F.lit(None).cast("binary")
    # A null group sorts before all others.
    grp = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    return df.select(grp.alias("grp"), F.col(key).alias("key"), F.unhex(leaf([F.col(f) for f in fields])).alias("digest"), other.alias("changed"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and each row's place in its group within the range; rows come sorted."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("grp").dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        if coded.dictionary[int(codes[0])].as_py() == last:
            first = starts[1] if len(starts) > 1 else len(codes)
            place[:first] += count
        last, count = coded.dictionary[int(codes[-1])].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(codes), part), pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"]
        )


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (grp, key, digest, changed) with ``rank`` from 0 in the order of key and digest, and ``n`` rows of the group."""
    # The last column only tells repeated rows apart, so that ranges can part them.
    order = ("grp", "key", "digest", "tie")
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stage(dealt.mapInArrow(_number, f"{schema}, part long, place long"), name)
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
    group = W.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("grp", "part", before.alias("offset"), F.sum("rows").over(group).alias("n"))
    joined = placed.join(offsets, ["grp", "part"])
    return joined.select(*rows.columns, (F.col("offset") + F.col("place")).alias("rank"), "n")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of rows that come sorted by group and rank."""
    at, kept = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("grp", "rank", "n", "digest", "changed")]
        keys = batch.column("key")
        for i, row in enumerate(zip(*columns)):
            here = row[0], row[1] // BLOCK
            if here != at and kept:
                yield _block(at, kept)
                kept = []
            at = here
            kept.append((*row[2:], keys[i]))
    if kept:
        yield _block(at, kept)


def _block(at: tuple[str, int], kept: list[tuple]) -> pa.RecordBatch:
    height = min(LEVELS, veb.height_of(kept[0][0]))
    nodes = veb.build([row[1] for row in kept], height)
    keys = [row[3] for row in kept]
    arrays = [
        pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([kept[0][0]], pa.int64()), pa.array([nodes[:veb.DIGEST]], pa.binary()),
        pa.array([nodes], pa.binary()), pa.array([[row[2] for row in kept]], pa.list_(pa.binary())), pa.array([[k.as_py() for k in keys]], pa.list_(keys[0].type)),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["grp", "block", "n", "root", "nodes", "changed", "keys"])


@dataclass(frozen=True)
class Forest:
    """The written layers of some trees, lowest first: (grp, block, n, root, nodes, changed, keys)."""

    layers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(grp, root) of all trees: the only block of a tree's highest layer."""
        tops = [layer.where(F.col("n") <= BLOCK).select("grp", "root") for layer in self.layers]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out


def forest(rows: DataFrame, name: str) -> Forest:
    """Trees over ``rows`` (grp, key, digest, changed)."""
    layers, layer = [], ranked(rows, f"{name}-order")
    key = rows.schema["key"].dataType.simpleString()
    while True:
        dealt = layer.withColumn("block", F.floor(F.col("rank") / BLOCK)).repartition("grp", "block").sortWithinPartitions("grp", "rank")
        built = dealt.mapInArrow(_blocks, f"grp string, block long, n long, root binary, nodes binary, changed array<binary>, keys array<{key}>")
        layers.append(stage(built, f"{name}-layer{len(layers)}"))
        more = layers[-1].where(F.col("n") > BLOCK)
        if more.isEmpty():
            return Forest(layers)
        key = "bigint"
        layer = more.select(
            "grp", F.col("block").alias("key"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"),
            F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"),
        )


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks with the path above them, one row per leaf with its whole path: (grp, key, above, tree)."""
    for batch in batches:
        keys = batch.column("keys")
        for i, row in enumerate(batch.select(["grp", "n", "nodes", "above", "tree"]).to_pylist()):
            found = keys[i].values
            height = min(LEVELS, veb.height_of(row["n"]))
            levels = veb.siblings(row["nodes"], len(found), height)
            above = [(x["before"], x["after"]) for x in row["above"]]
            paths = [[levels[level][k // veb.FAN**level] for level in range(height)] + above for k in range(len(found))]
            paths = [[{"before": b, "after": a} for b, a in path] for path in paths]
            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            for start in range(0, len(found), 256):
                part = paths[start:start + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * len(part)), found[start:start + 256], pa.array(part, kind), pa.array([row["tree"]] * len(part), pa.binary())],
                    ["grp", "key", "above", "tree"],
                )


def _leaf_rows(root: bytes) -> Callable:
    """From the lowest blocks, one row per leaf with its proof, folded anew from its changed digest if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            for i, row in enumerate(batch.select(["n", "nodes", "changed", "above", "tree"]).to_pylist()):
                found, n = keys[i].values, len(row["changed"])
                height = min(LEVELS, veb.height_of(row["n"]))
                levels = veb.siblings(row["nodes"], n, height)
                above = [(x["before"], x["after"]) for x in row["above"]]
                upper = "".join(b + a for b, a in above)
                digests, proofs, folded = veb.leaves_of(row["nodes"], n, height), [], []
                for k in range(n):
                    path = [levels[level][k // veb.FAN**level] for level in range(height)]
                    proofs.append(hashlib.sha256(("".join(b + a for b, a in path) + upper).encode()).hexdigest())
                    folded.append(veb.fold(row["changed"][k] or digests[k], path + above))
                for start in range(0, n, _ROWS):
                    part = slice(start, start + _ROWS)
                    size = len(digests[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            found[start:start + _ROWS], pa.array([d.hex() for d in digests[part]]), pa.array([row["tree"].hex()] * size), pa.array([root.hex()] * size),
                            pa.array(proofs[part]), pa.array([d.hex() for d in folded[part]]), pa.array([d == root for d in folded[part]]),
                        ],
                        ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                    )

    return run


def _down(trees: Forest, tops: DataFrame) -> DataFrame:
    """The lowest blocks with the path above them, from ``tops`` (grp, above, tree) of the trees' roots."""
    paths = None
    for depth in range(len(trees.layers) - 1, -1, -1):
        layer = trees.layers[depth]
        highest = tops.select("grp", F.lit(0).cast("long").alias("block"), "above", "tree")
        if paths is None:
            here = highest
        else:
            below = paths.select("grp", F.col("key").alias("block"), "above", "tree")
            # Trees that end at this layer start here, the others come from the layer above.
            ends = layer.where(F.col("n") <= BLOCK).select("grp")
            here = below.unionByName(highest.join(ends, "grp", "left_semi"))
        joined = layer.join(here, ["grp", "block"])
        if depth == 0:
            return joined
        paths = joined.mapInArrow(_below, f"grp string, key long, above {_PATH}, tree binary")


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, the tree over their roots, and the root of it all (None for an empty table)."""

    groups: Forest
    over: Forest
    root: bytes | None

    def proofs(self) -> DataFrame:
        """One row per leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified."""
        empty = F.array().cast(_PATH)
        start = self.over.roots().select("grp", empty.alias("above"), F.col("root").alias("tree"))
        above = _down(self.over, start).mapInArrow(_below, f"grp string, key string, above {_PATH}, tree binary")
        paths = above.select(F.col("key").alias("grp"), "above").join(self.groups.roots().withColumnRenamed("root", "tree"), "grp")
        kind = self.groups.layers[0].schema["keys"].dataType.elementType.simpleString()
        schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return _down(self.groups, paths).mapInArrow(_leaf_rows(self.root or b""), schema)


def manifest(rows: DataFrame) -> Manifest:
    """The manifest over ``rows`` as :func:`leaves` makes them."""
    # Texts are hashed once; dealing by ranges reads its input twice.
    groups = forest(stage(rows, "leaves"), "groups")
    tops = groups.roots().select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"))
    over = forest(tops, "over")
    found = over.roots().first()
    return Manifest(groups, over, bytes(found["root"]) if found else None)


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, checked against a copy whose texts are lower-cased where five divides the id's CRC-32."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    made = manifest(leaves(docs, changed=picked, text=F.translate("text", UPPER, LOWER)))
    return made.proofs().withColumnRenamed("key", "doc_id")


def _field(name: str) -> str:
    return f"COALESCE(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


_BYTE = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: {_BYTE}))"


def _tree(name: str, rows: str, by: str, order: str) -> str:
    """A recursive table of all nodes (level, ``by``, i, n, h) over ``rows`` with a digest h."""
    return f"""
{name} AS (
  SELECT 0 AS level, {by}, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, COUNT(*) OVER (PARTITION BY {by}) AS n, h FROM {rows}
  UNION ALL
  SELECT level + 1, {by}, i // 16, (MAX(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, {by}, i // 16
)"""


def _beside(nodes: str, by: str) -> str:
    """Each node of a run with the digests before and after it."""
    return f"""
  SELECT a.level, a.{by}, a.i, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM {nodes} a JOIN {nodes} b ON a.level = b.level AND a.{by} = b.{by} AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.level, a.{by}, a.i"""


SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, COALESCE('+' || source, '') AS grp, text, COALESCE({_CRC} % 5 = 0, FALSE) AS picked,
    {" || ".join(_field(f) for f in FIELDS[:-1])} AS head
  FROM documents
),
leaf_rows AS (
  SELECT doc_id, grp, sha256(head || {_field("text")}) AS h,
    sha256(head || {_field(f"CASE WHEN picked THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")}) AS altered
  FROM fields
),
ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf_rows),
{_tree("nodes", "leaf_rows", "grp", "doc_id NULLS FIRST, h")},
tops AS (SELECT grp, h, level AS height, 0 AS forest FROM nodes WHERE n = 1),
{_tree("over_nodes", "tops", "forest", "grp")},
places AS (SELECT grp, height, h AS subroot, ROW_NUMBER() OVER (ORDER BY grp) - 1 AS place FROM tops),
steps AS (
  SELECT level AS step, grp, i, l, r FROM ({_beside("nodes", "grp")})
  UNION ALL
  SELECT height + level, grp, 0, l, r FROM places JOIN ({_beside("over_nodes", "forest")}) s ON s.i = place // CAST(16 ** level AS BIGINT)
),
folds AS (
  SELECT doc_id, grp, i AS own, 0 AS step, i, altered AS h, '' AS proof, h AS leaf FROM ordered
  UNION ALL
  SELECT f.doc_id, f.grp, f.own, f.step + 1, f.i // 16, sha256(s.l || f.h || s.r), f.proof || s.l || s.r, f.leaf
  FROM folds f JOIN steps s ON s.grp = f.grp AND s.step = f.step AND s.i = f.i
),
last_folds AS (SELECT grp, own, MAX(step) AS step FROM folds GROUP BY grp, own)
SELECT f.doc_id, f.leaf, p.subroot, o.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM folds f JOIN last_folds USING (grp, own, step) JOIN places p USING (grp) CROSS JOIN (SELECT h FROM over_nodes WHERE n = 1) o
"""
