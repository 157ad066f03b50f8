"""Merkle manifest of a dataset: trees of SHA-256 digests whose parents keep the hash states before each child slot.

Digests are lowercase hex text, a parent is the hash of its children's digests in order. While a parent is
hashed, a copy of the state is kept before every child slot. To fold a changed child up to the root, the copy at
its slot is resumed with the replacement and the right siblings only; nothing to the left is hashed again.

Trees are cut into blocks of about BLOCK neighbouring leaves, each of which one task lifts to one node; the nodes are
cut again, until one is left of each tree. So a tree with most of all leaves is many blocks, and n leaves take
log(n) / log(BLOCK) rounds. On the way down every block gets one row with the way from its node to the root, and
keeps its states for that way as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillworks.llm import shared
from rillworks.operators.carried import walk

#: Leaves of a block at most, unless one parent has more children.
BLOCK = 1024


def element(value: Column) -> Column:
    """A value as its UTF-8 byte count, `:` and itself; `-` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[element(v) for v in values]), 256)


def _levels(count: int, arity: int) -> int:
    """Levels above `count` nodes until one is left."""
    n = 0
    while count > 1:
        count, n = -(-count // arity), n + 1
    return n


def _height(arity: int) -> int:
    """Levels of a block."""
    n = 1
    while arity ** (n + 1) <= BLOCK:
        n += 1
    return n


class _Block:
    """The nodes above some neighbouring ones, with the states of each parent before its child slots."""

    def __init__(self, digests: list[str], levels: int, arity: int):
        self.arity = arity
        self.parents: list[list[list[tuple]]] = []  # by level, parent and slot: (state, left siblings, right siblings)
        nodes = [d.encode() for d in digests]
        for _ in range(levels):
            above, row = [], []
            for at in range(0, len(nodes), arity):
                run = nodes[at:at + arity]
                state, slots = sha256(), []
                for i, child in enumerate(run):
                    slots.append((state.copy(), b"".join(run[:i]), b"".join(run[i + 1:])))
                    state.update(child)
                above.append(state.hexdigest().encode())
                row.append(slots)
            self.parents.append(row)
            nodes = above
        self.top = nodes[0].decode()

    def way(self, at: int) -> Iterator[tuple]:
        """(state, left, right) of each level above the node."""
        for row in self.parents:
            yield row[at // self.arity][at % self.arity]
            at //= self.arity


def _resumed(way: list[tuple], digest: str) -> str:
    node = digest.encode()
    for state, _, right in way:
        h = state.copy()
        h.update(node)
        h.update(right)
        node = h.hexdigest().encode()
    return node.decode()


def _shown(way: Iterator[tuple]) -> str:
    return "".join(f"/{left.decode()}:{right.decode()}" for _, left, right in way)


def _opened(path: str) -> list[tuple]:
    """The way that a path text spells, with its states: one hash of left siblings per level, used for a whole block."""
    steps = [p.split(":") for p in path.split("/")[1:]]
    return [(sha256(left.encode()), left.encode(), right.encode()) for left, right in steps]


def places(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Adds `pos`, the place of a row within its tree, and `count`, the rows of the tree.

    Rows are range-partitioned, so the places of a tree come from the row counts of partitions; rows that tie in
    everything are told apart by where they were read. Written once: later steps all see the same places."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(tree), *order, F.col("_tie")]
    ranged = rows.repartitionByRange(shared.partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("_tie")
    kept = shared.stored(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    parts = kept.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_tree").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_tree", "_p", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_shift"),
                          F.sum("_n").over(Window.partitionBy("_tree")).alias("count"))
    joined = kept.join(starts, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.drop("_tie").columns, (F.col("_at") - F.col("_shift")).alias("pos"), "count")


def _cut(nodes: DataFrame, arity: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(arity ** _height(arity))).cast("bigint"))


def _lifted(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, count, digest) one tier up."""
    height = _height(arity)

    def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        counts, digests = zip(*rows)
        levels = min(height, _levels(counts[0], arity))
        yield key[0], key[1], -(-counts[0] // arity ** levels), _Block(list(digests), levels, arity).top

    return walk(_cut(nodes, arity), ["tree", "block"], ["pos"], ["count", "digest"], step, "tree string, pos bigint, count bigint, digest string")


def _tiers(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Written nodes (tree, pos, count, digest) of each tier, from the leaves to one node per tree."""
    tiers = [leaves]
    while (tiers[-1].agg(F.max("count")).first()[0] or 0) > 1:
        tiers.append(shared.stored(_lifted(tiers[-1], arity)))
    return tiers


def _led(nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """Nodes by block, each block led by a row with the path of the node it was lifted to."""
    lead = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "path")
    return _cut(nodes, arity).withColumn("path", F.lit(None).cast("string")).unionByName(lead, allowMissingColumns=True)


def _lowered(nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, path) of a tier from those of the tier above."""
    height = _height(arity)
    width = arity ** height

    def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        path = next(rows)[2]
        counts, digests, _ = zip(*rows)
        block = _Block(list(digests), min(height, _levels(counts[0], arity)), arity)
        for i in range(len(digests)):
            yield key[0], key[1] * width + i, _shown(block.way(i)) + path

    return walk(_led(nodes, above, arity), ["tree", "block"], ["pos"], ["count", "digest", "path"], step, "tree string, pos bigint, path string")


def _tree_key(tree: str) -> Column:
    """Tree names as text that sorts NULL first and then bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))


def _roots(tops: DataFrame, arity: int) -> tuple[str, list[DataFrame]]:
    """The root over the trees' own roots, and the tiers between."""
    roots = places(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", [F.col("name")])
    tiers = _tiers(roots, arity)
    last = tiers[-1].select("digest").first()
    return (last[0] if last else sha256().hexdigest()), tiers


def manifest(rows: DataFrame, tree: str, order: list[str], leaf: str, arity: int = 2) -> tuple[str, DataFrame]:
    """The root digest, and (tree, leaves, subroot) for each tree: what is published with a dataset.

    Leaves ascend by `order` (NULL first), ties by digest. The root of no rows is the hash of nothing."""
    digests = rows.select(_tree_key(tree).alias("tree"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(leaf).alias("digest"))
    leaves = places(digests, "tree", [*[F.col(f"o{i}") for i in range(len(order))], F.col("digest")])
    counts = leaves.groupBy("tree").agg(F.max("count").alias("leaves"))
    tops = _tiers(leaves.select("tree", "pos", "count", "digest"), arity)[-1].select("tree", "digest")
    root, _ = _roots(tops, arity)
    name = F.when(F.col("tree") != "", F.substring("tree", F.lit(2), F.length("tree")))
    return root, counts.join(tops, "tree").select(name.alias("tree"), "leaves", F.col("digest").alias("subroot"))


def proofs(rows: DataFrame, tree: str, key: str, leaf: str, claim: str | None = None, arity: int = 2) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    Leaves of a tree ascend by `key` (NULL first), ties by digest and then `claim`; every run of `arity` nodes becomes
    their hash until one is left, and the trees' roots, ordered by name (NULL first, then bytewise), likewise. proof_sha256
    is the hash of the siblings on the way from the leaf to the root, level by level, left to right. `claim` holds
    the digest that someone has for the row now, NULL where it is unchanged: it is folded with the original siblings, and
    verified says whether that gives the root. Repeated rows are leaves of their own; other columns don't matter; no rows give none.
    """
    claimed = F.lit(None).cast("string") if claim is None else F.col(claim)
    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(_tree_key(tree).alias("tree"), F.col(key).alias("key"), F.col(leaf).alias("digest"), claimed.alias("claim"))
    leaves = places(given, "tree", [F.col("key"), F.col("digest"), F.col("claim")])
    tiers = _tiers(leaves, arity)
    root, upper = _roots(tiers[-1].select("tree", "digest"), arity)

    way = upper[-1].select("tree", "pos", F.lit("").alias("path"))
    for tier in reversed(upper[:-1]):
        way = _lowered(tier, way, arity)
    # paths of tree roots: nothing within the tree, then the way over the trees
    way = shared.stored(way.join(upper[0].select("pos", "name"), "pos").select(
        F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("|"), "path").alias("path")))
    for tier in reversed(tiers[1:-1]):
        way = _lowered(tier, way, arity)

    height = _height(arity)

    def step(_: tuple, block_rows: Iterator[tuple]) -> Iterator[tuple]:
        inner, outer = map(_opened, next(block_rows)[4].split("|"))
        counts, digests, keys, claims, _ = zip(*block_rows)
        block = _Block(list(digests), min(height, _levels(counts[0], arity)), arity)
        subroot, above = _resumed(inner, block.top), inner + outer
        for i, (name, digest, claim) in enumerate(zip(keys, digests, claims)):
            way = [*block.way(i), *above]
            folded = _resumed(way, digest if claim is None else claim)
            proof = sha256(b"".join(left + right for _, left, right in way)).hexdigest()
            yield name, digest, subroot, root, proof, folded, folded == root

    out = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = walk(_led(leaves, way, arity), ["tree", "block"], ["pos"], ["count", "digest", "key", "claim", "path"], step, out)
    return found.withColumnRenamed("key", key)
