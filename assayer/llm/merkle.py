"""Merkle manifest of a dataset: a root for all rows, a subroot for each source, and a proof for each row.

Leaves of a source, in the order of their ids, are nodes 0, 1, ... of a tree in which every ARITY consecutive nodes become
their hash until one remains. The digits of a node's rank to the base ARITY are columns. Within a block of ARITY**DIGITS
nodes they are grouped away one after the other, the last first: each step nests the children's structs in their parent's,
so a block ends as one row that holds its whole subtree. Blocks are the nodes of the next tier, until a tree has one block.
The subroots, by source, are the nodes of one more tree.

Proofs come down the tiers: a block's row and the path from its root upwards are grouped together, a transform over the
nested structs appends the siblings of every level, and an explode hands each child its path. No row is looked up by a join,
and no group exceeds a block.

Fields of a row are hashed as `-` if null, else UTF-8 byte count, `:`, value. A null source is a source of its own and comes
first; null ids come before others. Rows that share an id are ordered by their leaf, fully equal rows in any order (each
has a place of its own). An empty table gives an empty result. Columns that aren't asked for aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import storage
from assayer.llm.ranking import ranked

ARITY, DIGITS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _roll(nodes: DataFrame) -> DataFrame:
    """(tree, block, size, node) from (tree, rank, size, hash, body): the digits grouped away, child structs nested."""
    digits = [(F.floor(F.col("rank") / ARITY**k) % ARITY).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    block = F.floor(F.col("rank") / ARITY**DIGITS).cast("long").alias("block")
    rows = nodes.select("tree", block, "size", *digits, F.struct("hash", "rank", "body").alias("node")).repartition("tree", "block")
    for k in range(DIGITS):
        rest = [f"d{j}" for j in range(k + 1, DIGITS)]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node"))).alias("kids")
        rows = rows.groupBy("tree", "block", *rest).agg(F.first("size").alias("size"), kids)
        joint = digest(F.concat_ws("", F.col("kids.node.hash")))
        hashed = F.when(F.col("size") > ARITY**k, joint).otherwise(F.col("kids")[0]["node"]["hash"])
        rows = rows.select("tree", "block", "size", *rest, F.struct(hashed.alias("hash"), "kids").alias("node"))
    return rows


def _unfold(kids: Column, size: Column, k: int) -> Column:
    """All nodes below: array of (rank, body, hash, path up to these children's parent)."""
    def entry(i: Column) -> Column:
        hashes = kids["node"]["hash"]
        left, right = F.concat_ws("", F.slice(hashes, 1, i)), F.concat_ws("", F.slice(hashes, i + 2, ARITY))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        return F.when(size > ARITY**k, step).otherwise(F.array().cast(_PATH))

    def below(kid: Column, i: Column) -> Column:
        node = kid["node"]
        if k == 0:
            return F.struct(node["rank"].alias("rank"), node["body"].alias("body"), node["hash"].alias("hash"), entry(i).alias("path"))
        return F.transform(
            _unfold(node["kids"], size, k - 1),
            lambda x: F.struct(x["rank"].alias("rank"), x["body"].alias("body"), x["hash"].alias("hash"), F.concat(x["path"], entry(i)).alias("path")),
        )

    found = F.transform(kids, below)
    return found if k == 0 else F.flatten(found)


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tiers of blocks, the lowest first. A tree ends in the tier in which it has one block."""
    tiers = [storage.stage(_roll(nodes), f"{name}_0")]
    while (tiers[-1].agg(F.max("block")).first()[0] or 0) > 0:
        parents = F.ceil(F.col("size") / ARITY**DIGITS).cast("long").alias("size")
        above = tiers[-1].filter(F.col("size") > ARITY**DIGITS)
        nodes = above.select("tree", F.col("block").alias("rank"), parents, F.col("node.hash").alias("hash"), F.lit(None).cast("string").alias("body"))
        tiers.append(storage.stage(_roll(nodes), f"{name}_{len(tiers)}"))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree."""
    ended = [t.filter(F.col("size") <= ARITY**DIGITS).select("tree", F.col("node.hash").alias("hash")) for t in tiers]
    return reduce(DataFrame.unionByName, ended)


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, rank, body, hash, path, label) of the lowest nodes. tops: (tree, up, label), the path above each tree's root."""
    paths = None
    for tier in reversed(tiers):
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        kind = tier.schema["node"].dataType
        rows = tier.select("tree", "block", "size", "node", none(_PATH, "top"), none(_PATH, "up"), none("string", "label"))
        rows = rows.unionByName(tops.select("tree", F.lit(0).cast("long").alias("block"), none("long", "size"), none(kind, "node"), F.col("up").alias("top"), none(_PATH, "up"), "label"))
        if paths is not None:
            rows = rows.unionByName(paths.select("tree", F.col("rank").alias("block"), none("long", "size"), none(kind, "node"), none(_PATH, "top"), F.col("path").alias("up"), "label"))
        met = rows.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "top", "up", "label")])
        met = met.filter("node IS NOT NULL").withColumn("up", F.when(F.col("size") <= ARITY**DIGITS, F.col("top")).otherwise(F.col("up")))
        below = met.select("tree", "up", "label", F.explode(_unfold(F.col("node.kids"), F.col("size"), DIGITS - 1)).alias("x"))
        paths = below.select("tree", "x.rank", "x.body", "x.hash", F.concat("x.path", "up").alias("path"), "label")
    return paths


def fold(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["left"], acc, step["right"]))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", altered: Column | None = None, altered_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, path, altered_leaf) for each row; path: left and right siblings of each level, upwards.

    altered: a value that takes the place of `altered_col` in altered_leaf, to try what a proof finds."""
    hashed = digest(*[field(F.col(c)) for c in fields])
    other = digest(*[field(altered if c == altered_col else F.col(c)) for c in fields]) if altered is not None else hashed
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("")).alias("tree")
    leaves = docs.select(group, F.col(id_col).alias("id"), hashed.alias("hash"), other.alias("other"))
    nodes = ranked(leaves, "tree", ["id", "hash"], "leaves").withColumn("body", F.struct("id", "other"))
    lower = climb(nodes, "blocks")
    subroots = ranked(roots(lower).select(F.lit("").alias("tree"), F.col("tree").alias("body"), "hash"), "tree", ["body"], "subroots")
    upper = climb(subroots, "sources")
    top = roots(upper).first()
    start = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("up"), F.lit(None).cast("string").alias("label"))
    of_sources = descend(upper, start).select(F.col("body").alias("tree"), F.col("path").alias("up"), F.col("hash").alias("label"))
    found = descend(lower, storage.stage(of_sources, "source_paths"))
    return found.select(
        F.col("body.id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("label").alias("subroot"), F.lit(top.hash if top else None).cast("string").alias("root"),
        "path", F.col("body.other").alias("altered_leaf"),
    )


def proofs(docs: DataFrame) -> DataFrame:
    """The digests of `manifest`, and whether a row whose text lost its line ends (every row with an even crc32 of its id) still folds to the root."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, altered=text)
    siblings = F.concat_ws("", F.transform("path", lambda step: F.concat(step["left"], step["right"])))
    folded = rows.withColumn("folded_root", fold(F.col("path"), F.col("altered_leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
