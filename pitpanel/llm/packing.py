"""Packing of documents into sequences of tokens: descending documents to the sequence of least cost with room.

A document of n tokens costs linear * n + n * n: attention is within documents, the rest of the network by token. Every
task packs its own documents, PACK tokens at a time, into exactly as many sequences as these tokens fill; what does
not fill one more goes to sequences of 1,024, 512, ... tokens, one for each binary digit, so nothing is padded.
A document goes whole to the cheapest sequence with room for it; where none has that much, it is cut at the room of the
cheapest with any. Nothing is shuffled: a lost task packs its own documents again, the same way.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.bpe import SPLIT, byte_letters

CAPACITY, PACK, WINDOW = 2048, 1 << 22, 1 << 20
_BLANK = re.escape("".join(c for c in map(chr, range(0x3100)) if regex.match(r"\s", c)))
_CUT = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])")  # no pre-split piece reaches over such a place


class Coder:
    """Text -> ids of a byte-level BPE file whose merges are in order of their ids. Held once per Python worker."""

    held: dict[str, Coder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if order != sorted(order) or any(re.search(f"[{_BLANK}]", t) for t in added):
            raise ValueError(f"{path}: merges that are not in order of ids, or white space in an added token")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
        coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self.ids = functools.partial(coder.encode_to_numpy, allowed_special="all")

    @classmethod
    def at(cls, path: str) -> Coder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, a window of about WINDOW characters at a time."""
        out, lo = [], 0
        while lo < len(text):
            cut = _CUT.search(text, lo + WINDOW) if len(text) - lo > WINDOW else None
            hi = cut.start() if cut else len(text)
            out.append(self.ids(text[lo:hi]))
            lo = hi
        return np.concatenate([np.zeros(0, dtype="<u4"), *out])


def capacities(total: int, capacity: int) -> np.ndarray:
    """Sizes of sequences that `total` tokens fill without padding: whole ones, then a power of two for each bit left."""
    rest = total % capacity
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([capacity] * (total // capacity) + bits, dtype=np.int64)


def pack(sizes: np.ndarray, capacity: int, linear: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these sizes.

    Whole sequences are cut from a document larger than one first; what is left of it is packed as the others are.
    """
    pieces, n_whole = [], 0
    for d in np.flatnonzero(sizes >= capacity):
        for k in range(sizes[d] // capacity):
            pieces.append((int(d), k * capacity, capacity, n_whole, 0))
            n_whole += 1
    left = sizes % capacity
    full = capacities(int(left.sum()), capacity)
    room, cost = full.copy(), np.zeros(len(full), dtype=np.int64)
    for d in np.argsort(-left, kind="stable"):
        n, start = int(left[d]), int(sizes[d] - left[d])
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room)
            s = int(fits[np.argmin(cost[fits])])
            took = min(n, int(room[s]))
            pieces.append((int(d), start, took, n_whole + s, int(full[s] - room[s])))
            room[s] -= took
            cost[s] += took * (linear + took)
            n, start = n - took, start + took
    return pieces


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = 1,
    linear: int = 6144,
    most: int = PACK,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset longs, ids array<int>), a row for each piece.

    capacity: tokens of a sequence, a power of two. end_id: the id behind each document's ids. linear: the cost of a
    token besides attention, in pairs of tokens (six times the width of a model). most: tokens that a task packs at a
    time, its bound of memory beside the largest single document. tokenizer: the path, on every executor, of a
    byte-level BPE file; strings of its added tokens become their ids.

    A document's pieces cover its ids without gap or overlap; a sequence's pieces lie one behind the other from offset
    0; its length is capacity or a smaller power of two, so none is padded. sequence_id is unique, not dense. Null and empty
    texts are the end id alone. Every row is a document of its own, so repeated rows are packed as often as they
    occur; null ids are kept; an empty table gives no rows; other columns are not looked at. A document that alone has more tokens
    than `most` is packed with those before it.
    """

    def run(batches):
        coder = Coder.at(tokenizer)
        first = TaskContext.get().partitionId() << 36
        ends = np.array([end_id], dtype="<u4")
        held, names, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate((coder.encode(text.as_py() or ""), ends))
                held.append(ids)
                names.append(doc.as_py())
                size += len(ids)
                if size >= most:
                    out, n = packed(held, names, first)
                    yield from out
                    first, held, names, size = first + n, [], [], 0
        if held:
            yield from packed(held, names, first)[0]

    def packed(held: list[np.ndarray], names: list, first: int):
        pieces = pack(np.array([len(x) for x in held], dtype=np.int64), capacity, linear)
        table = np.array(pieces, dtype=np.int64)
        out = []
        for lo in range(0, len(table), 4096):
            part = table[lo : lo + 4096]
            cut = [held[d][s : s + n] for d, s, n, _, _ in part]
            cols = [
                pa.array([names[d] for d in part[:, 0]], pa.int64()),
                pa.array(part[:, 1]),
                pa.array(part[:, 2]),
                pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                pa.array([len(held[d]) for d in part[:, 0]], pa.int64()),
                pa.array(part[:, 3] + first),
                pa.array(part[:, 4]),
            ]
            if with_ids:
                at = np.concatenate(([0], np.cumsum(part[:, 2]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cut).astype(np.int32))))
            out.append(pa.RecordBatch.from_arrays(cols, names=columns))
        return out, int(table[:, 3].max()) + 1

    kinds = dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "long")
    kinds |= {"ids": "array<int>"} if with_ids else {}
    columns = list(kinds)
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity: a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))
