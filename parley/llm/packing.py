"""Best-fit packing by hierarchical residual merging (operator 5).

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Every
partition best-fits its own pieces; bins that are nearly full are final. The bins left
over go on as single items to fewer partitions, where they are best-fitted again, until
a round brings nothing or one partition is left. A merge task never gets more than about
``group_items`` items, however many are left.

Cases: a null or empty text is one piece holding only the end token; null ids are kept
as they are; repeated rows are packed once per row; extra columns are ignored; an empty
table gives an empty result. Ties between bins go to the bin opened first.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.store import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
PLACED = "item long, bin long, place long, size long, full boolean, part int"

_encoders: dict = {}


def encoder(path: str, pattern: str):
    """The encoder of a ``tokenizers`` file of byte-level BPE, made once per Python worker.

    The file's vocabulary lists tokens in the order of their merges, so its ids are ranks, and
    tiktoken gives the same ids from them as the tokenizers library (a test holds the two
    against each other) at a quarter of its memory traffic. Added tokens are matched inside texts,
    as the tokenizers library does by default.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        # Byte-level files write a byte as itself if it is printable and else as a letter from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(plain)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all whole but the first, which takes the rest."""
    first = total % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with the CRC-32 of its little-endian unsigned 32-bit ids."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            encode = partial(encoder(path, pattern).encode, allowed_special="all")
            out: dict[str, list] = {c: [] for c in ("doc", "piece", "start", "length", "crc", "item")}
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    for key, value in zip(out, (row, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), number), strict=True):
                        out[key].append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out["doc"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc", "item"))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "item"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item. Each goes to the fullest bin that can take it."""
    room: list[int] = []  # distinct amounts of room left, ascending
    by_room: dict[int, deque[int]] = {}
    bins = np.empty(len(sizes), np.int64)
    opened = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(room, size)
        if at == len(room):
            bins[i], left = opened, capacity - size
            opened += 1
        else:
            left = room[at]
            waiting = by_room[left]
            bins[i] = waiting.popleft()
            if not waiting:
                del by_room[left]
                room.pop(at)
            left -= size
        if left:
            if left not in by_room:
                bisect.insort(room, left)
                by_room[left] = deque()
            by_room[left].append(bins[i])
    return bins


def _pack_round(items: DataFrame, capacity: int, slack: int) -> DataFrame:
    """Best-fit each partition's items; ``place`` is the item's offset in its bin."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        item, size = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(item, kind="stable")
        item, size = item[order], size[order]
        bins = best_fit(size, capacity)
        order = np.argsort(bins, kind="stable")
        item, size, bins = item[order], size[order], bins[order]
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        runs = np.diff(np.r_[first, len(bins)])
        before = np.cumsum(size) - size
        total = np.add.reduceat(size, first)
        names = np.repeat(item[first], runs)  # a bin is named after its first item
        place = before - np.repeat(before[first], runs)
        full = np.repeat(total >= capacity - slack, runs)
        for at in range(0, len(item), 50_000):
            to = at + 50_000
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[at:to]) for x in (item, names, place, np.repeat(total, runs), full)] + [pa.array(np.full(len(item[at:to]), part, np.int32))],
                names=["item", "bin", "place", "size", "full", "part"],
            )

    return items.mapInArrow(run, PLACED)


def pack(found: DataFrame, capacity: int = 2048, slack: int = 2, fan_in: int = 8, group_items: int = 200_000) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset``.

    ``slack``: a bin with at most so many free places is final. ``fan_in``: how many
    partitions' leftovers meet in one of the next round. ``group_items`` bounds a merge
    task; leftovers beyond it are spread over more tasks. Each round writes its placements, so a lost executor costs one round.
    """
    # Whole pieces are bins already; the rest are dealt to tasks of a bounded size.
    whole = found.where(F.col("length") >= capacity).select(*found.columns, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items = found.where(F.col("length") < capacity)
    items = open_items.select("item", F.col("length").alias("size"))
    left = items.count()
    groups = max(1, -(-left // (group_items // 8)))
    placements: DataFrame | None = None
    taken = 0
    while left:
        taken += 1
        items = items.repartition(groups, F.xxhash64("item", F.lit(taken))) if groups > 1 else items.coalesce(1)
        placed = cut(_pack_round(items, capacity, slack))
        if placements is None:
            placements = placed.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
        else:
            moved = placed.select(F.col("item").alias("sequence_id"), "bin", F.col("place").alias("shift"))
            placements = cut(
                placements.join(moved, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
            )
        rest = placed.where(~F.col("full")).select(F.col("bin").alias("item"), "size").distinct()
        before, left = left, rest.count()
        if groups == 1:
            break
        if left > 0.98 * before:
            rest = rest.where(F.col("size") * 2 <= capacity)
            left = rest.count()
            if left < 2:
                break
        items = rest
        groups = max(-(-groups // fan_in), -(-left // group_items))
    if placements is None:
        return whole
    return whole.unionByName(open_items.join(placements, "item").select(*whole.columns))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    found = cut(pieces(docs, path, pattern, capacity))
    return pack(found, capacity, **how).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
