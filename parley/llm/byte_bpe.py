"""Byte-level BPE by prefix dynamic programming (operator 9).

For every prefix of a byte string there is exactly one last token with which its BPE
encoding ends. ``Prefixes`` stores it, so that appending bytes costs only the new
prefixes, and an edit re-encodes from the edited place on. A token may end a prefix if its
bytes agree and the token before it, itself the last token of the shorter
prefix, may stand next to it: a pair may stand together if undoing the merges along
their border never meets a merge that the encoder would have made first.

Cases: a null text is an empty one and has no tokens; ids and other columns may be null;
rows are independent, so repeated rows and empty tables need no care; a text of any
length is encoded whole, match by match of the splitting pattern.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Encodings of about so many distinct matches are remembered by a Python worker.
REMEMBERED = 800_000


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._merge: dict[tuple[int, int], int] = {}
        self._parts: list[tuple[int, int]] = [(r, r) for r in range(len(self.tokens))]
        for rank, token in enumerate(self.tokens):
            for at in range(len(token) - 1, 0, -1):
                left, right = ranks.get(token[:at], rank), ranks.get(token[at:], rank)
                if left < rank and right < rank and self._together(left, right):
                    self._parts[rank] = (left, right)
                    self._merge[left, right] = rank
                    break

    def _together(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side.

        Undoes the younger of the two tokens at the border, again and again. If the tokens
        then at the border merge into one that is older than what was undone last, the
        encoder would have made that merge instead.
        """
        bound = len(self.tokens)
        while True:
            if self._merge.get((left, right), bound) < bound:
                return False
            a, b = self._parts[left][1], self._parts[right][0]
            if left > right and a != left or b == right:
                if a == left:
                    return True
                bound, left = left, a
            else:
                # A tie in age is settled in favour of the leftmost merge.
                bound, right = right + 1, b

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[key] = self._together(left, right)
        return found

    def encode(self, piece: bytes) -> list[int]:
        found = self.ranks.get(piece)
        return [found] if found is not None else Prefixes(self, piece).ids()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of one byte string (one match of the splitting pattern)."""

    def __init__(self, bpe: ByteBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        data, find, last, bpe = self.data + more, self.bpe.ranks.get, self.last, self.bpe
        self.data = data
        longest, known = bpe.longest, bpe._fits
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = find(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    if not (known[before, token] if (before, token) in known else bpe.fits(before, token)):
                        continue
                last.append(token)
                break

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes ``start`` to ``end``; prefixes before ``start`` stay."""
        rest = self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(new + rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.bpe.tokens[token])
        return out[::-1]


_loaded: dict = {}
_known: dict = {}


def load(path: str) -> ByteBPE:
    """The encoder of a file of base64 tokens and ranks, made once per Python worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            _loaded[path] = ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})
    return _loaded[path]


def encode_texts(path: str, pattern: str, texts: list[str | None]):
    """For each text a list of (ids as unsigned 32-bit integers, decimal ids joined by a space), a match each."""
    bpe, split = load(path), regex.compile(pattern)
    known = _known.setdefault((path, pattern), {})
    for text in texts:
        matches = split.findall(text or "")
        try:
            yield list(map(known.__getitem__, matches))
            continue
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for match in matches:
            got = known.get(match)
            if got is None:
                ids = bpe.encode(match.encode("utf-8", "surrogatepass"))
                got = (array("I", ids).tobytes(), " ".join(map(str, ids)))
                if len(match) <= 64:
                    known[match] = got
            found.append(got)
        yield found


def ids_of(found: list[tuple[bytes, str]]) -> np.ndarray:
    return np.frombuffer(b"".join([x[0] for x in found]), dtype=np.uint32)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token ids (``array<int>``) of every text."""

    def run(batches):
        for batch in batches:
            ids = [ids_of(found).astype(np.int32) for found in encode_texts(path, pattern, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and return the count and digests of both.

    Encoding and decoding share a task, so the ids of one document only ever exist in it.
    """

    def run(batches):
        bpe = load(path)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for found in encode_texts(path, pattern, batch.column(1).to_pylist()):
                ids = ids_of(found).tolist()
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGESTS)
