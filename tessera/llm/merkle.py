"""A Merkle manifest of a dataset: one root, a digest of every row, and a proof that the row is under the root.

Rows are leaves. Within a group (a language, say) leaves stand in order; every `arity` consecutive nodes of a level have a
parent, the last parent of a level having fewer children; the group's last node is its subroot, and the subroots stand
under one root in the same way. Digests are SHA-256 in lowercase hex, a parent's being that of its children's hex joined.

1. Leaves (digests, no texts) are range-partitioned by group and order, and numbered by the sizes of the ranges.
2. Nodes are combined by a key, the aligned block of a few levels that they are in. Each node that comes is an event: it goes
   to its partial parent, which gathers children by their places until it has as many as the level's size gives it, whereupon
   it goes up itself. What has no parent in its block, the frontier, is dealt out anew by the next larger blocks, a round for
   every eight levels or so.
3. Proofs come down the same way: each block gets the proof of its top node, and hands it down to its nodes with their siblings.

No block has more than BLOCK nodes, so a group that holds all rows is spread like any other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, written

ARITY = 2
#: Nodes of one level in a block, at most.
BLOCK = 256


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other: `-` for null, else length in UTF-8 bytes, a colon, the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof; null if either is null."""
    steps = F.filter(F.split(proof, ";"), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.split_part(s, F.lit("."), F.lit(1)), h, F.split_part(s, F.lit("."), F.lit(2))), 256))


def siblings(proof: Column) -> Column:
    """The siblings' digests of a proof, level by level and from left to right, joined."""
    return F.translate(proof, ".;", "")


def height(n: int, arity: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def block_levels(arity: int, block: int = BLOCK) -> int:
    """Levels of a block."""
    levels = 1
    while arity ** (levels + 1) <= block:
        levels += 1
    return levels


class Parents:
    """Partial parents over one block, so many levels high, of a level with n nodes in all."""

    def __init__(self, n: int, arity: int, levels: int):
        self.arity, self.levels = arity, min(levels, height(n, arity))
        self.sizes = [n]
        for _ in range(self.levels):
            self.sizes.append(-(-self.sizes[-1] // arity))
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.done: dict[tuple[int, int], dict[int, str]] = {}
        self.top: list[tuple[int, str]] = []

    def add(self, at: int, digest: str) -> None:
        """A node of the lowest level comes; every parent that now has all its children goes up."""
        level = 0
        while level < self.levels:
            parent = at // self.arity
            key = (level, parent)
            children = self.open.setdefault(key, {})
            children[at] = digest
            if len(children) < min(self.arity, self.sizes[level] - parent * self.arity):
                return
            self.done[key] = dict(sorted(self.open.pop(key).items()))
            digest = hashlib.sha256("".join(self.done[key].values()).encode()).hexdigest()
            level, at = level + 1, parent
        self.top.append((at, digest))

    def proofs(self, tail: str) -> dict[int, str]:
        """Of each node of the lowest level: its siblings on the left, a dot, those on the right and a semicolon, for every level up; then tail."""
        above = {at: tail for at, _ in self.top}
        for level in range(self.levels - 1, -1, -1):
            here = {}
            for (of, parent), children in self.done.items():
                if of == level:
                    kids = list(children.values())
                    for k, at in enumerate(children):
                        here[at] = f"{''.join(kids[:k])}.{''.join(kids[k + 1 :])};{above[parent]}"
            above = here
        return above


def _filled(nodes: pa.Table, arity: int, levels: int) -> Parents:
    parents = Parents(nodes.column("n")[0].as_py(), arity, levels)
    for at, digest in zip(nodes.column("at").to_pylist(), nodes.column("digest").to_pylist(), strict=True):
        parents.add(at, digest)
    return parents


def _ascended(nodes: pa.Table, arity: int, levels: int) -> pa.Table:
    """The block's frontier: the one node that has no parent in it."""
    p = _filled(nodes, arity, levels)
    k = len(p.top)
    return pa.table({"g": pa.array([nodes.column("g")[0].as_py()] * k), "at": pa.array([at for at, _ in p.top], pa.int64()), "n": pa.array([p.sizes[-1]] * k, pa.int64()), "digest": pa.array([d for _, d in p.top])})


def _descended(nodes: pa.Table, tops: pa.Table, arity: int, levels: int) -> pa.Table:
    """The block's nodes (without the block's number) with what tops has for it, and their proofs."""
    proofs = _filled(nodes, arity, levels).proofs(tops.column("proof")[0].as_py())
    out = nodes.drop_columns(["block"]).append_column("proof", pa.array([proofs[at] for at in nodes.column("at").to_pylist()], pa.string()))
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([tops.column(name)[0].as_py()] * nodes.num_rows, pa.string()))
    return out


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with a group g) and at, each row's place in its group by `order`, and n, the group's rows. Rows without difference in g and order are taken as they come."""
    ranged = rows.repartitionByRange(partitions_for(rows), "g", *order).sortWithinPartitions("g", *order)
    ranged = written(ranged.withColumn("row", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("part", F.shiftright("row", 33))
    ranges = ranged.groupBy("g", "part").agg(F.min("row").alias("lo"), F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("g", "part", (before - F.col("lo")).alias("shift"), F.sum("c").over(group).alias("n"))
    return ranged.join(starts, ["g", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {size}"))


def ascend(leaves: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes from which each round of leaves (g, at, n, digest) starts, and each group's last one (g, digest)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds, nodes = [], leaves
    for _ in range(-(-height(most, arity) // levels)):
        rounds.append(nodes)
        blocks = _in_blocks(nodes.select("g", "at", "n", "digest"), arity**levels).groupBy("g", "block")
        nodes = written(blocks.applyInArrow(lambda t: _ascended(t, arity, levels), "g string, at long, n long, digest string"), "merkle-nodes")
    return rounds, nodes.select("g", "digest")


def descend(rounds: list[DataFrame], tops: DataFrame, arity: int, levels: int) -> DataFrame:
    """The columns of the first round's nodes, with proof, subroot and root, from those of each group's last node (g, proof, subroot, root)."""
    tops = tops.withColumn("at", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        nodes = _in_blocks(rounds[k], arity**levels)
        above = tops.select("g", F.col("at").alias("block"), "proof", "subroot", "root")
        schema = ", ".join(f"`{c}` {kind}" for c, kind in rounds[k].dtypes) + ", proof string, subroot string, root string"
        tops = nodes.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(lambda x, y: _descended(x, y, arity, levels), schema)
        if k:
            tops = written(tops, "merkle-proofs")
    return tops


def manifest(rows: DataFrame, digest: Column, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, arity: int = ARITY, block: int = BLOCK) -> DataFrame:
    """Per row: `order`, leaf, subroot, root, proof (see folded), and the columns of carry.

    digest gives the rows' digests, such as leaf_digest of some columns. Groups come in the bytewise order of their names,
    null first; leaves by `order` (null first), then by their digests, so equal rows are neighbours and have a leaf and a
    proof each. A group of one leaf has it as its subroot, as a single group's subroot is the root. No rows give no rows.
    Columns of rows that aren't named play no part, whatever they are called.
    """
    carry, names, levels = carry or {}, ["g", "at", "n", "digest"], block_levels(arity, block)
    own = {f"more_{k}": c for k, c in enumerate(carry.values())}
    g = F.coalesce(F.concat(F.lit("="), rows[group].cast("string")), F.lit(""))
    leaves = written(rows.select(g.alias("g"), rows[order].alias("key"), digest.alias("digest"), *[c.alias(k) for k, c in own.items()]), "merkle-leaves")
    leaves = written(in_order(leaves, "key", "digest").select(*names, "key", *own), "merkle-leaves")
    rounds, subroots = ascend(leaves, arity, levels)
    top = written(in_order(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "of").select(*names, "of"), "merkle-subroots")
    top_rounds, root = ascend(top, arity, levels)
    above = written(root.select("g", F.lit("").alias("proof"), F.col("digest").alias("root"), F.lit("").alias("subroot")), "merkle-root")
    if top_rounds:
        above = descend(top_rounds, above, arity, levels).select(F.col("of").alias("g"), "proof", F.col("digest").alias("subroot"), "root")
    else:
        above = top.select(F.col("of").alias("g"), F.lit("").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    if rounds:
        out = descend(rounds, written(above, "merkle-proofs"), arity, levels)
    else:
        out = leaves.join(above, "g")
    return out.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(k).alias(name) for k, name in zip(own, carry, strict=True)])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_digest(docs: DataFrame, **instead: Column) -> Column:
    """The leaf of a row of documents; instead: other values for some of its fields."""
    return leaf_digest(*[instead.get(f, docs[f]) for f in FIELDS])


def tampered_documents(docs: DataFrame, arity: int = ARITY, block: int = BLOCK) -> DataFrame:
    """The manifest of documents, held against rows of which some have one more in n_chars: see op11_merkle.

    Rows whose doc_id or n_chars is null stay as they are, as no null is tampered with.
    """
    touched = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    more = document_digest(docs, n_chars=docs["n_chars"].cast("decimal(20,0)") + 1)
    return manifest(docs, document_digest(docs), carry={"found": F.when(touched & docs["n_chars"].isNotNull(), more)}, arity=arity, block=block)


def verified(rows: DataFrame) -> DataFrame:
    """rows of a manifest with a column found (a row's digest as it is now; null: unchanged): proof_sha256, folded_root and verified are added."""
    now = folded(F.coalesce("found", "leaf"), F.col("proof"))
    return rows.withColumn("proof_sha256", F.sha2(siblings(F.col("proof")), 256)).withColumn("folded_root", now).withColumn("verified", F.col("folded_root") == F.col("root"))


