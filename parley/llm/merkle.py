"""A Merkle manifest of documents: leaves, roots and authentication paths (operator 13).

Leaves are numbered within their group (``ranks.number``) and dealt to aligned blocks of ``2**HEIGHT``. A block's
root is one task's work; block roots are the leaves of the next level, until a group has one block. Then paths go down again: in
each block a traversal moves from leaf to leaf with one treehash stack a level, so that it holds a number of digests in
the order of ``HEIGHT``, and what lies above a block is appended to all its paths.

H is the lowercase hexadecimal SHA-256 of its inputs' concatenation, digests as hexadecimal text. While a group has several
nodes, every two consecutive ones become their H; an odd last one becomes its own H. A lone leaf is its group's root.

Cases: a null value is ``-``; documents without a lang are the first group; within a group ids ascend (nulls first) and equal ids
are in order of their leaves, so that repeated rows are leaves of their own and of equal digest; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.ranks import number
from parley.llm.store import table

HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: dict[str, Column]) -> Column:
    """H of a row's fields, each as its length in bytes, ``:`` and its text."""
    framed = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def parent(left: str | None, right: str | None) -> str | None:
    """H of two nodes; beyond the last leaf there are none (None)."""
    return hashlib.sha256((left + (right or "")).encode()).hexdigest() if left is not None else None


def height_of(size: int, limit: int) -> int:
    """Levels above the leaves of a block: all of them where its group has several blocks."""
    return limit if size > 1 << limit else max(0, (size - 1).bit_length())


class Treehash:
    """One level's next node, built leaf by leaf on a stack of at most ``level + 1`` nodes."""

    def __init__(self, leaves: list[str], level: int, node: str | None):
        self.leaves, self.level, self.stack, self.next, self.end = leaves, level, [(level, node)], 0, 0

    def begin(self, at: int) -> None:
        self.stack, self.next, self.end = [], at, at + (1 << self.level)

    def step(self) -> None:
        """Join the two topmost nodes if they are of one level, else take a leaf."""
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            (level, right), (_, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((level + 1, parent(left, right)))
        elif self.next < self.end:
            self.stack.append((0, self.leaves[self.next] if self.next < len(self.leaves) else None))
            self.next += 1


def begin(leaves: list[str], height: int) -> tuple[str | None, list[str | None], list[Treehash]]:
    """A block's root, the first leaf's path, and the stacks that hold the left nodes of each level."""
    path, stacks, stack = [None] * height, [None] * height, []
    for i in range(1 << height):
        node, level, at = leaves[i] if i < len(leaves) else None, 0, i
        while True:
            if level < height and at == 1:
                path[level] = node
            if level < height and at == 0:
                stacks[level] = Treehash(leaves, level, node)
            if not stack or stack[-1][0] != level:
                break
            node, level, at = parent(stack.pop()[1], node), level + 1, at // 2
        stack.append((level, node))
    return stack[0][1], path, stacks


def paths(leaves: list[str], height: int) -> Iterator[list[str | None]]:
    """Each leaf's siblings, lowest first (None where there is none), in order of the leaves.

    The classic schedule: after leaf i every level whose nodes end there takes the node its stack has made and starts on the one after next; then
    every stack makes two steps, which is enough for it to be ready in time.
    """
    _, path, stacks = begin(leaves, height)
    for i in range(len(leaves)):
        yield list(path)
        for level, stack in enumerate(stacks):
            if (i + 1) % (1 << level) == 0:
                path[level] = stack.stack[0][1]
                stack.begin((i + 1 + (1 << level)) ^ (1 << level))
        for stack in stacks:
            stack.step()
            stack.step()


def block_roots(nodes: DataFrame, group: str, height: int = HEIGHT) -> DataFrame:
    """group, ``_pos``, ``_size`` and ``digest`` of the level above: one node a block."""

    def run(key, found):
        import pyarrow as pa

        found = found.sort_by("_pos")
        size, leaves = found["_size"][0].as_py(), found["digest"].to_pylist()
        root, *_ = begin(leaves, height_of(size, height))
        return pa.table({group: [key[0].as_py()], "_pos": [key[1].as_py()], "_size": [-(-size >> height) if size > 1 << height else 1], "digest": [root]})

    return nodes.groupBy(group, F.shiftright("_pos", height).alias("_block")).applyInArrow(run, f"{group} string, _pos long, _size long, digest string")


def block_paths(nodes: DataFrame, above: DataFrame | None, group: str, height: int = HEIGHT) -> DataFrame:
    """``nodes`` with ``path``: the siblings within the block, then those in ``path`` of the block's row of ``above``."""
    kept = [f for f in nodes.schema.fields if f.name not in ("_size",)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", path array<string>"

    def walk(found, upper):
        import pyarrow as pa

        found = found.sort_by("_pos")
        height_here = height_of(found["_size"][0].as_py(), height)
        own = [p + upper for p in paths(found["digest"].to_pylist(), height_here)]
        out = found.select([f.name for f in kept])
        return out.append_column("path", pa.array(own, pa.list_(pa.string())))

    block = nodes.withColumn("_block", F.shiftright("_pos", height))
    if above is None:
        return block.groupBy(group, "_block").applyInArrow(lambda key, found: walk(found, []), schema)
    higher = above.select(group, F.col("_pos").alias("_block"), F.col("path").alias("_upper"))
    return block.groupBy(group, "_block").cogroup(higher.groupBy(group, "_block")).applyInArrow(lambda key, found, higher: walk(found, higher["_upper"][0].as_py()), schema)


def tree(nodes: DataFrame, group: str, name: str, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``path``, group and ``root``) for numbered nodes with a ``digest``.

    One pass up and one down a level; a level has ``2**height`` times fewer nodes than the one below, so that 10^12 nodes have
    three levels. The driver counts levels.
    """
    levels = [nodes]
    while levels[-1].where(F.col("_size") > 1 << height).limit(1).count():
        levels.append(table(block_roots(levels[-1], group, height), f"{name}-{len(levels)}"))
    roots = table(block_roots(levels[-1], group, height).select(group, F.col("digest").alias("root")), f"{name}-roots")
    placed = None
    for level in reversed(levels):
        placed = block_paths(level, placed, group, height)
    return placed, roots


def manifest(docs: DataFrame, height: int = HEIGHT, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, ``leaf``, ``subroot``, ``root``, ``siblings`` (array, null where there is none) and ``rights`` (whether the node is its run's second).

    Levels go from the leaf to its group's root and on to the root of all groups. ``extra`` columns of ``docs`` stay with their rows.
    """
    values = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("long"), "text": F.col("text")}
    # A group's key sorts by bytes, null first.
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(values["doc_id"].alias("doc_id"), key.alias("_lang"), leaf(values).alias("digest"), *(c.alias(n) for n, c in (extra or {}).items()))
    numbered = number(table(leaves, "leaves"), ["_lang"], ["doc_id", "digest"], "numbered")
    placed, subroots = tree(numbered, "_lang", "blocks", height)
    groups = number(subroots.select(F.lit("").alias("_all"), "_lang", F.col("root").alias("digest")), ["_all"], ["_lang"], "groups")
    upper, root = tree(groups, "_all", "tops", height)
    upper = upper.join(root, "_all").select("_lang", F.col("digest").alias("subroot"), "root", F.col("path").alias("_up"), F.col("_pos").alias("_at"))
    sides = lambda at, path: F.transform(F.col(path), lambda _, i: F.getbit(F.col(at), i) == 1)
    joined = placed.join(table(upper, "groups"), "_lang")
    return joined.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "_up").alias("siblings"), F.concat(sides("_pos", "path"), sides("_at", "_up")).alias("rights"), *(extra or {}))


def fold(node: Column, siblings: Column, rights: Column) -> Column:
    """The root that a leaf and its path lead to."""
    hash_of = lambda x: F.sha2(x.cast("binary"), 256)
    up = lambda h, s: hash_of(F.when(s["sibling"].isNull(), h).when(s["right"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])))
    return F.aggregate(F.zip_with(siblings, rights, lambda s, r: F.struct(s.alias("sibling"), r.alias("right"))), node, up)


def verify(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Proofs of all documents, checked against leaves of which every seventh's ``n_chars`` was tampered with."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0
    values = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("long") + 1, "text": F.col("text")}
    found = manifest(docs, height, {"_tampered": F.when(hit & F.col("n_chars").isNotNull(), leaf(values))})
    folded = fold(F.coalesce("_tampered", "leaf"), F.col("siblings"), F.col("rights"))
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    checked = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
