"""SimHash near-duplicates with BK-trees (operator 10).

Every text gets a 64-bit fingerprint. Fingerprints that differ in at most ``radius`` bits are
linked; documents in one connected component are near-duplicates. If two fingerprints
differ in at most r bits, they agree in at least one of r + 1 blocks of bits, so the distinct
fingerprints are dealt to shards by the value of each block. A shard's fingerprints form
BK-trees of a bounded size: a node's children hang on edges named by their
Hamming distance to it, and a search follows only the edges whose name differs from the
query's distance by at most the radius. Trees are built by the executors and broadcast a
bounded block at a time to the fingerprints of the same shards. A search task unites what it
finds and sends a spanning forest, not the pairs: links inside a dense group grow with its
members. Connected components are found by alternating star contraction.

``keep_similar`` works on similarity instead of a few bits: word shingles of ``WIDE_SHINGLE`` words that
texts share to ``SIMILARITY`` (Jaccard) or more. There fingerprints of ``WIDE_BITS`` bits propose pairs: shards are samples of bits, as
many and as wide as the number of fingerprints asks for, and a shard's trees are built and searched where its fingerprints meet. Every link
is then verified by both texts' sets of shingles. Where a proposed link falls, the texts around it propose further ones, until no pair
within the radius is left that could connect two groups.

Cases: a null, empty or blank text has no words and the fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; a null id keeps its row, with the
smallest other id of the component (null if there is none); repeated rows are equal
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import cut, discard, table
from parley.llm.words import hash_words, mix, split_words, text_slices, window_hashes

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in one tree, and in all trees of one broadcast: 16 bytes each.
TREE_NODES = 1 << 13
BROADCAST_NODES = 1 << 20
WIDE_SHINGLE, WIDE_BITS, SIMILARITY = 5, 512, 0.8
#: Share of the pairs of just ``SIMILARITY`` that some shard shall hold; fingerprints that a shard holds on average; most of them in one tree.
RECALL, SHARD_PRINTS, PART_PRINTS = 0.97, 24, 1 << 14
#: Standard deviations beyond the distance that is expected at ``SIMILARITY`` at which a pair is still proposed, and before it within which it is first.
REACH, CLOSE = 2.0, -5.0
#: Bins in which the shingles of a text are counted, to tell pairs that can't be alike.
TALLIES = 512

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is 1 where more than half the hashes have a 1."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # eight counters of a byte in each lane
        part = hashes[at : at + 255]
        for bit in range(8):
            lanes = np.add.reduce((part >> np.uint64(bit)) & _LANES)
            ones[bit::8] += np.frombuffer(np.uint64(lanes).tobytes(), np.uint8)
    return int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)), where=2 * ones > len(hashes), initial=np.uint64(0)))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return majority_bits(np.array(found, dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint ``fp`` of every row."""

    def run(batches):
        for batch in batches:
            found = []
            for _, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                found += [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: 64-bit words, or rows of such words."""
    n = np.bitwise_count(a ^ b).astype(np.int64)
    return n if n.ndim == 1 else n.sum(axis=1)


class BKForest:
    """BK-trees over fingerprints, one for each group, in arrays.

    Child edges are the sorted keys ``parent * span + distance``; ``child`` is where each leads.
    """

    def __init__(self, groups: np.ndarray, words: np.ndarray):
        self.words = words
        self.span = 64 * (1 if words.ndim == 1 else words.shape[1]) + 1
        order = np.argsort(groups, kind="stable")
        first = np.r_[True, groups[order][1:] != groups[order][:-1]] if len(order) else np.zeros(0, bool)
        roots = order[first]
        self.groups, self.roots = groups[roots], roots
        parent = np.repeat(roots, np.diff(np.r_[np.flatnonzero(first), len(order)])) if len(order) else order
        rest = ~first
        node, parent = order[rest], parent[rest]
        keys, children = [], []
        while len(node):
            edge = parent * self.span + distance(words[node], words[parent])
            key, at, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(node[at])
            parent = node[at][inverse]
            stay = parent != node
            node, parent = node[stay], parent[stay]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.keys, self.child = key[order], child[order]

    def search(self, groups: np.ndarray, words: np.ndarray, radius: int, connect: bool = False):
        """Yield (query, node) index arrays of words within ``radius`` in the query's own group.

        All of them; with ``connect`` so many as connect all: what hangs on a hit by an edge within the radius
        is near that hit itself and is not looked at again.
        """
        at = np.searchsorted(self.groups, groups)
        inside = (at < len(self.groups)) & (self.groups[np.minimum(at, len(self.groups) - 1)] == groups) if len(self.groups) else np.zeros(len(groups), bool)
        at_once = 4_000 if words.ndim == 1 else 1_000
        for begin in range(0, len(groups), at_once):
            query = np.flatnonzero(inside[begin : begin + at_once]) + begin
            node = self.roots[at[query]]
            while len(query):
                found = distance(words[query], self.words[node])
                hit = found <= radius
                yield query[hit], node[hit]
                least = np.maximum(found - radius, 0)
                if connect:
                    least = np.where(hit, radius + 1, least)
                low = np.searchsorted(self.keys, node * self.span + least, "left")
                high = np.searchsorted(self.keys, node * self.span + np.minimum(found + radius, self.span - 1), "right")
                n = np.maximum(high - low, 0)
                query = np.repeat(query, n)
                edge = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                node = self.child[edge]

    def near_parents(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, parent) of the edges within the radius: with these, ``connect`` loses no connection."""
        found = self.keys % self.span <= radius
        return self.child[found], self.keys[found] // self.span


class Union:
    """Union-find over 64-bit values; the representative is the smallest."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.root = np.arange(len(self.values))

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unite the sets of a[i] and b[i]; returns which i did: a spanning forest of what was joined."""
        a, b, at = np.searchsorted(self.values, a), np.searchsorted(self.values, b), np.arange(len(a))
        taken = [at[:0]]
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return np.concatenate(taken)
            a, b, at = a[apart], b[apart], at[apart]
            high, low = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            self.root[high[first]] = low[first]
            taken.append(at[first])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(value, representative) of every value that isn't its own representative."""
        apart = self.root != np.arange(len(self.root))
        return self.values[apart], self.values[self.root[apart]]


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """The shard of ``fp`` by each of its radius + 1 blocks of bits: array<long>."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.lit(i << 32) + F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - (hi - lo)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))


def links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(a, b): a spanning forest of all pairs of fingerprints at most ``radius`` bits apart.

    ``distinct``: one column ``fp`` of distinct fingerprints. The driver sees how many
    fingerprints each shard has: (radius + 1) * 2**13 counts, whatever the input.
    """
    spark = distinct.sparkSession
    dealt = table(distinct.select("fp", F.explode(blocks(F.col("fp"), radius)).alias("shard")).repartitionByRange("shard", "fp"), "simhash-shards", sort=["shard"])
    sizes = dealt.groupBy("shard").count().where("count > 1").collect()
    # A shard of more fingerprints than one tree may hold gets several; its queries visit them all.
    trees = [(r["shard"], k, -(-r["count"] // -(-r["count"] // tree_nodes))) for r in sorted(sizes, key=lambda r: r["shard"]) for k in range(-(-r["count"] // tree_nodes))]
    plan, number, held = [], 0, 0
    per_shard = {r["shard"]: -(-r["count"] // tree_nodes) for r in sizes}
    for shard, k, n in trees:
        if held and held + n > broadcast_nodes:
            number, held = number + 1, 0
        held += n
        plan.append((shard, k, per_shard[shard], number))
    if not plan:
        return spark.createDataFrame([], "a long, b long")
    plan_df = F.broadcast(spark.createDataFrame(pd.DataFrame(plan, columns=["shard", "k", "trees", "number"]), "shard long, k int, trees int, number int"))

    def grow(frames):
        """The nodes of whole trees, packed: executors build them, a broadcast carries them."""
        held = [x for x in frames if len(x)]
        if held:
            rows = pd.concat(held)
            order = np.lexsort((rows["k"], rows["shard"]))
            rows = rows.iloc[order]
            keys = rows[["number", "shard", "k"]].to_numpy()
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            fps = rows["fp"].to_numpy()
            for a, b in zip(begin, [*begin[1:], len(fps)], strict=True):
                yield pd.DataFrame({"number": [keys[a, 0]], "shard": [keys[a, 1]], "k": [keys[a, 2]], "nodes": [fps[a:b].tobytes()]})

    members = dealt.join(plan_df, "shard").where(F.pmod(F.xxhash64("fp"), F.col("trees")) == F.col("k"))
    grown = table(members.select("number", "shard", "k", "fp").repartition("shard", "k").mapInPandas(grow, "number int, shard long, k int, nodes binary"), "bk-trees")
    out = []
    for step in range(number + 1):
        block = grown.where(F.col("number") == step).select("shard", "k", "nodes").collect()  # at most broadcast_nodes fingerprints
        sent = spark.sparkContext.broadcast([(r["shard"], r["k"], bytes(r["nodes"])) for r in block])
        mine = [x for x in plan if x[3] == step]  # of consecutive shards: the scan skips all other files
        near = dealt.where(F.col("shard").between(mine[0][0], mine[-1][0]))
        shards = F.broadcast(plan_df.where(F.col("number") == step).select("shard", "k"))

        def look(batches, sent=sent):
            groups, words = _block(sent)
            forest = None
            held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
            if not held:
                return
            shard, k, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            mine = np.isin(groups, np.unique(_group(shard, k)))
            forest = BKForest(groups[mine], words[mine])
            query = fp.view(np.uint64)
            union = Union(np.concatenate([query, forest.words]))
            for a, b in forest.search(_group(shard, k), query, radius):
                union.join(query[a], forest.words[b])
            a, b = union.edges()
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].view(np.int64)) for x in (a, b)], names=["a", "b"])

        found = near.join(shards, "shard").select("shard", "k", "fp").mapInArrow(look, "a long, b long")
        out.append(table(found, "simhash-links"))
        sent.destroy()
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def _group(shard: np.ndarray, k: np.ndarray) -> np.ndarray:
    return shard * 4096 + k  # shard is under 2**35, trees of a shard under 4096 at 2**25 of its fingerprints


def _block(sent) -> tuple[np.ndarray, np.ndarray]:
    rows = sent.value
    words = np.concatenate([np.frombuffer(x, np.uint64) for _, _, x in rows]) if rows else np.zeros(0, np.uint64)
    groups = np.repeat([s * 4096 + k for s, k, _ in rows], [len(x) // 8 for _, _, x in rows]).astype(np.int64)
    return groups, words


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of an edge list (a, b), by alternating large and small stars.

    Each round is two shuffles and a checkpoint; the number of rounds grows with the logarithm
    of the size of a component. A node of high degree is reduced by a map-side minimum and a
    join, never gathered.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()

    before = mark(edges)
    while before[0]:
        edges = cut(star(star(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every distinct fingerprint."""
    prints = cut(fingerprints(docs, id_col, text_col))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(least.select("fp"), radius))
    rooted = least.join(member, least["fp"] == member["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest id of the document's component."""
    prints, classes = _classes(docs, id_col, text_col, radius)
    # One fingerprint may stand for a third of all rows. ``classes`` has it once, so the adaptive
    # skew join can split its documents over tasks.
    found = prints.join(classes.select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, bits: int = WIDE_BITS) -> DataFrame:
    """doc_id, ``text_key``, ``node``, ``fp`` and ``grams`` of every row.

    ``text_key`` hashes the text, ``node`` the set of its shingles; ``fp``: majority bits of the shingles' hashes, as bytes; ``grams``: the
    set itself, 32 bits of each hash in ascending order (n shingles of two texts agree by chance in about n^2 / 2^33).
    """
    offsets = mix(np.arange(1, bits // 64 + 1, dtype=np.uint64))

    def majorities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of 64-bit words; ``bounds``: where the hashes of each text begin."""
        n = np.diff(bounds)
        cut_at = np.concatenate([np.arange(a, b, 255) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a])  # eight counters of a byte in each lane
        owner = np.searchsorted(bounds, cut_at, "right") - 1
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        some = np.flatnonzero(n)
        out = np.zeros((len(n), bits // 64), np.uint64)
        for word in range(bits // 64):
            h = mix(hashes ^ offsets[word])
            ones = np.empty((len(some), 64), np.int64)
            for bit in range(8):
                lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cut_at)
                ones[:, bit::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
            out[some, word] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def run(batches):
        for batch in batches:
            for row, data, ends in text_slices(batch.column(2)):
                words = split_words(data, ends)
                hashes = hash_words(data, words, lower=True)
                count = np.diff(words.bounds)
                grams = window_hashes(hashes, shingle)
                inside = np.flatnonzero(words.row[shingle - 1 :] == words.row[: len(grams)]) if len(grams) else np.zeros(0, np.int64)
                short = np.flatnonzero((count > 0) & (count < shingle))
                whole = np.array([mix(np.bitwise_xor.reduce(mix(hashes[words.bounds[i] : words.bounds[i + 1]] + np.arange(count[i], dtype=np.uint64)), keepdims=True))[0] for i in short], np.uint64)
                owner, h = np.r_[words.row[inside], short].astype(np.int64), np.r_[grams[inside], whole]
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                bounds, node = np.zeros(len(count) + 1, np.int64), np.zeros(len(count), np.uint64)
                if len(h):
                    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]
                    owner, h = owner[new], h[new]
                    bounds = np.searchsorted(owner, np.arange(len(count) + 1))
                    some = np.flatnonzero(np.diff(bounds))
                    node[some] = mix(np.add.reduceat(mix(h ^ np.uint64(SEED)), bounds[some]) + np.diff(bounds)[some].astype(np.uint64))
                    fp = majorities(h, bounds)
                else:
                    fp = np.zeros((len(count), bits // 64), np.uint64)
                # Hashes ascend within a text, and so do their upper halves.
                upper = (h >> np.uint64(32)).astype("<u4")
                sets = [upper[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                part = [batch.column(i).slice(row, len(count)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(node.view(np.int64)), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "text_key", "node", "fp", "grams"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, node long, fp binary, grams binary")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")


def samples(prints: int, bits: int = WIDE_BITS, similarity: float = SIMILARITY, recall: float = RECALL) -> list[np.ndarray]:
    """The bits of each sample that deals so many fingerprints to shards.

    Two fingerprints of texts with this similarity agree in a bit with probability 1 - angle / pi, so a sample
    of k bits has both in one shard with that to the power of k. k makes shards hold about ``SHARD_PRINTS`` others; there
    are as many samples as the recall asks for.
    """
    k = max(4, int(np.ceil(np.log2(max(1, prints) / SHARD_PRINTS)))) if prints > SHARD_PRINTS else 4
    together = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** k
    rng = np.random.default_rng(41)
    return [np.sort(rng.permutation(bits)[:k]) for _ in range(int(np.ceil(np.log(1 - recall) / np.log(1 - together))))]


def wide_radius(bits: int = WIDE_BITS, similarity: float = SIMILARITY, deviations: float = REACH) -> int:
    """Bits in which fingerprints of texts with this similarity differ, and some standard deviations more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return max(0, int(np.floor(bits * p + deviations * np.sqrt(bits * p * (1 - p)))))


def _packed(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def deal(distinct: DataFrame, count: int, bits: int, similarity: float, recall: float) -> DataFrame:
    """(shard, node, fp): every fingerprint in a shard of each sample."""
    chosen = samples(count, bits, similarity, recall)

    def run(batches):
        for batch in batches:
            one = np.unpackbits(_packed(batch.column(1)).reshape(-1, bits // 8), axis=1, bitorder="little")
            for number, sample in enumerate(chosen):
                shard = (number << 40) + one[:, sample].astype(np.int64) @ (1 << np.arange(len(sample), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1)], names=["shard", "node", "fp"])

    return distinct.select("node", "fp").mapInArrow(run, "shard long, node long, fp binary")


def _by_group(batches, limit: int = 50_000):
    """Arrays of whole groups of rows that agree in the first column and follow each other; about ``limit`` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([_packed(c).reshape(batch.num_rows, -1) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows > limit:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = int(np.flatnonzero(columns[0] != columns[0][-1]).max(initial=-1)) + 1
                held, rows = [[c[end:] for c in columns]], rows - end
                if end:
                    yield [c[:end] for c in columns]
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def proposed_links(shards: DataFrame, bits: int = WIDE_BITS, similarity: float = SIMILARITY, part_prints: int = PART_PRINTS) -> DataFrame:
    """(a, b): near pairs of nodes that connect all that are near within a shard; the closest come first.

    A shard of more than ``part_prints`` fingerprints is dealt to several trees. Of each only those fingerprints that hang on
    no very close one go on to meet those of the shard's other trees, round by round. Where these hardly get fewer, trees meet in pairs.
    """
    radii = wide_radius(bits, similarity, CLOSE), wide_radius(bits, similarity)

    def meet(batches):
        """Links have a null shard; leaders name theirs, for the shards that were dealt to several trees."""
        for group, shard, node, raw, open_ in _by_group(batches):
            _, inverse, n = np.unique(group, return_inverse=True, return_counts=True)
            met = (n[inverse] > 1) | open_
            group, shard, node, raw, open_ = (x[met] for x in (group, shard, node, np.ascontiguousarray(raw), open_))
            if not len(group):
                continue
            words = np.ascontiguousarray(raw).view(np.uint64)
            forest, union = BKForest(group, words), Union(node)
            for radius in radii:
                child, parent = forest.near_parents(radius)
                taken = union.join(node[child], node[parent])
                yield links_of(node[child[taken]], node[parent[taken]])
                for a, b in forest.search(group, words, radius, connect=True):
                    taken = union.join(node[a], node[b])
                    if len(taken):
                        yield links_of(node[a[taken]], node[b[taken]])
            leads = open_.copy()
            leads[forest.near_parents(radii[0])[0]] = False
            if leads.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[leads]), pa.array([None] * int(leads.sum()), pa.int64()), pa.array(shard[leads]), pa.array([x.tobytes() for x in raw[leads]], pa.binary())], names=names)

    def links_of(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([None] * len(a), pa.int64()), pa.array([None] * len(a), pa.binary())], names=names)

    names = ["a", "b", "shard", "fp"]
    out, left, taken = [], None, 0
    while True:
        large = shards.groupBy("shard").count().where(F.col("count") > part_prints).select("shard", F.ceil(F.col("count") / part_prints).cast("int").alias("parts"))
        large = table(large, "simhash-large-shards")  # one in ``part_prints`` rows at most
        now, parts = shards.count(), F.coalesce("parts", F.lit(1))
        pairs = left is not None and now > 0.7 * left
        keyed = shards.join(large, "shard", "left").select("shard", "node", "fp", F.pmod(F.xxhash64("node", F.lit(taken)), parts).cast("int").alias("part"), parts.alias("parts"))
        if pairs:
            other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            keyed = keyed.withColumn("_o", other).select("shard", "node", "fp", F.struct(F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j")).alias("part"), F.lit(1).alias("parts"))
        met = keyed.select(F.xxhash64("shard", "part").alias("group"), "shard", "node", "fp", (F.col("parts") > 1).alias("open")).repartition("group").sortWithinPartitions("group")
        found = table(met.mapInArrow(meet, "a long, b long, shard long, fp binary"), "simhash-links")
        out.append(found.where("shard is null").select("a", "b"))
        discard(large)
        left, taken = now, taken + 1
        shards = found.where("shard is not null").select("shard", F.col("a").alias("node"), "fp")
        if shards.isEmpty():
            break
    return reduce(DataFrame.unionByName, out).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tallies(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tally): of the set of shingles of each of ``nodes``, how many fall in each of ``TALLIES`` bins, a byte each."""

    def run(batches):
        for batch in batches:
            out = []
            for grams in batch.column(1).to_pylist():
                found = np.bincount(np.frombuffer(grams, "<u4") % TALLIES, minlength=TALLIES)
                out.append(np.minimum(found, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "tally"])

    return prints.select("node", "grams").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(run, "node long, tally binary")


def may_be_alike(tally: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float, pairs: int = 8192) -> np.ndarray:
    """Of pairs of rows of ``tally``, which can have the similarity: sets share no more of a bin than the smaller count of it.

    True as well where a full byte hides a larger count.
    """
    n, full, out = tally.sum(1, dtype=np.int64), (tally == 255).any(1), np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), pairs):
        x, y = a[i : i + pairs], b[i : i + pairs]
        both = np.minimum(tally[x], tally[y]).sum(1, dtype=np.int64)
        out[i : i + pairs] = (both >= similarity * (n[x] + n[y] - both)) | full[x] | full[y]
    return out


def further_links(shards: DataFrame, state: DataFrame, most: int, bits: int = WIDE_BITS, similarity: float = SIMILARITY, part_prints: int = PART_PRINTS) -> DataFrame:
    """(a, b): of every open node the ``most`` nearest in each other group that it meets in a shard and could be connected with.

    ``state``: node, ``f`` (connected by proposed links), ``v`` (by verified ones), ``asks``, which is false for the largest ``v`` of
    an ``f``, and ``tally``, by which pairs are left out that can't be alike. Large meetings are cut into pieces of nodes and of asking nodes, so that a task holds ``part_prints`` of each.
    """
    radius = wide_radius(bits, similarity)
    met = shards.join(state, "node").withColumn("group", F.xxhash64("shard", "f"))
    sizes = met.groupBy("group").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).where("q > 0 AND n > 1")
    sizes = sizes.select("group", F.ceil(F.col("n") / part_prints).cast("int").alias("np"), F.ceil(F.col("q") / part_prints).cast("int").alias("qp"))
    met = met.join(table(sizes, "simhash-open"), "group").withColumns({"i": F.pmod(F.xxhash64("node"), F.col("np")), "j": F.pmod(F.xxhash64("node", "f"), F.col("qp"))})
    range_ = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    nodes = met.select("group", "i", F.explode(range_("qp")).alias("j"), "node", "v", "fp", "tally", F.lit(False).alias("asks"))
    asking = met.where("asks").select("group", F.explode(range_("np")).alias("i"), "j", "node", "v", "fp", "tally", F.lit(True).alias("asks"))
    placed = nodes.unionByName(asking).select(F.xxhash64("group", "i", "j").alias("piece"), "node", "v", "fp", "tally", "asks").repartition("piece").sortWithinPartitions("piece")

    def run(batches):
        for piece, node, v, raw, tally, asks in _by_group(batches):
            words = np.ascontiguousarray(raw).view(np.uint64)
            forest = BKForest(piece[~asks], words[~asks])
            query = np.flatnonzero(asks)
            there = np.flatnonzero(~asks)
            found = []
            for x, y in forest.search(piece[query], words[query], radius):
                x, y = query[x], there[y]
                apart = v[x] != v[y]
                x, y = x[apart], y[apart]
                near = may_be_alike(tally, x, y, similarity)
                found.append((x[near], y[near]))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            far = distance(words[a], words[b])
            order = np.lexsort((far, v[b], a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (v[b][1:] != v[b][:-1])]) if len(a) else np.zeros(0, np.int64)
            place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
            near = place < most
            yield pa.RecordBatch.from_arrays([pa.array(node[a[near]]), pa.array(node[b[near]])], names=["a", "b"])

    found = placed.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verify(pairs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``pairs`` (a, b) with ``alike``: whether their sets of shingles have the similarity. Only the sets of nodes in pairs are shuffled."""
    needed = table(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "simhash-needed")
    sets = table(prints.select("node", "grams").join(needed, "node", "left_semi").dropDuplicates(["node"]), "simhash-sets")
    side = lambda n: sets.select(F.col("node").alias(n), F.col("grams").alias(f"_{n}"))

    def run(batches):
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), "<u4") for z in (x, y))
                # Of different sizes alone may follow that they are not alike.
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    alike.append(False)
                    continue
                both = len(np.intersect1d(x, y))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long, alike boolean")


def _rooted(edges: DataFrame, name: str) -> DataFrame:
    """(node, ``name``) of all nodes of an edge list, the root's own row included."""
    member = components(edges).select("node", F.col("root").alias(name))
    return member.unionByName(member.select(F.col(name).alias("node"), name).distinct())


def similar_links(prints: DataFrame, bits: int = WIDE_BITS, similarity: float = SIMILARITY, recall: float = RECALL, part_prints: int = PART_PRINTS) -> DataFrame:
    """(a, b): verified links between nodes that connect all pairs which are near in some shard and alike.

    ``prints``: node, fp and grams of all rows. After the first proposals only groups that fell apart go on: their nodes but for the largest
    piece's propose the nearest of each other piece, 64 times as many a round, until all they can propose is verified.
    """
    how = {"bits": bits, "similarity": similarity, "part_prints": part_prints}
    distinct = table(prints.select("node", "fp").distinct(), "simhash-distinct")
    shards = table(deal(distinct, distinct.count(), bits, similarity, recall), "simhash-shards")
    done = table(verify(table(proposed_links(shards, bits, similarity, part_prints), "simhash-proposed"), prints, similarity), "simhash-verified")
    if done.where("not alike").isEmpty():
        discard(shards, distinct)
        return done.where("alike").select("a", "b")
    state = table(_rooted(done.select("a", "b"), "f").join(_rooted(done.where("alike").select("a", "b"), "v"), "node", "left").withColumn("v", F.coalesce("v", "node")), "simhash-state")
    tally = table(tallies(prints, state), "simhash-tallies")
    most = 2
    while True:
        sizes = state.groupBy("f", "v").count().groupBy("f").agg(F.max_by("v", F.struct("count", "v")).alias("_big"), F.count("*").alias("_pieces")).where("_pieces > 1").select("f", "_big")
        open_ = table(state.join(sizes, "f").select("node", "f", "v", (F.col("v") != F.col("_big")).alias("asks")), "simhash-pieces")
        if open_.isEmpty():
            break
        more = table(further_links(shards, open_.join(tally, "node"), most, **how).join(done.select("a", "b"), ["a", "b"], "left_anti"), "simhash-further")
        if more.isEmpty():
            break
        fresh = table(verify(more, prints, similarity), "simhash-verified")
        done = done.unionByName(fresh)
        new = fresh.where("alike").select("a", "b")
        if not new.isEmpty():
            # New links join pieces: a small graph, whose roots become the pieces' names.
            piece = lambda n: open_.select(F.col("node").alias(n), F.col("v").alias(f"_{n}"))
            joined = new.join(piece("a"), "a").join(piece("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            moved = components(joined).select(F.col("node").alias("v"), "root")
            state = table(open_.join(moved, "v", "left").select("node", "f", F.coalesce("root", "v").alias("v")), "simhash-state")
        most *= 64
    discard(shards, distinct, tally)
    return done.where("alike").select("a", "b")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``text_key`` and ``node`` of every row; ``node`` and ``root`` of the nodes with links): nodes of one root are connected."""
    prints = table(wide_fingerprints(docs, id_col, text_col), "simhash-prints")
    return prints, table(components(similar_links(prints, **how)), "simhash-classes")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each group of texts connected by similarities of ``SIMILARITY`` or more: that with the smallest id, nulls last.

    All columns stay. Similarity is that of the sets of shingles. Of rows with that id the text with the smallest hash stays, of repeated rows
    one; other texts of the same id are kept or not by their own groups. Rows without an id are told apart by their texts.
    """
    prints, classes = similar_classes(docs, id_col, text_col, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    # A text that a third of all rows have is one node: its smallest row is a map-side minimum.
    least = prints.groupBy("node").agg(first.alias("_k")).join(classes, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("_k").alias("_k"))
    chosen = table(least.select(F.col("_k.doc_id").alias("_parley_id"), F.col("_k.text_key").alias("_parley_key")), "simhash-chosen")
    keyed = docs.withColumn("_parley_text", text_key(F.col(text_col)))
    kept = keyed.join(chosen, F.col(id_col).cast("long").eqNullSafe(F.col("_parley_id")) & (F.col("_parley_text") == F.col("_parley_key")), "left_semi")
    out = kept.dropDuplicates([id_col, "_parley_text"]).select(*docs.columns)
    discard(prints)
    return out
