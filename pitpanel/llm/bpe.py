"""Byte-pair encoding as a tokenization automaton, and decoding by emitting arc labels.

The automaton starts as one state with a loop for every byte. Each merge u v -> w, in order, is a gadget: wherever
u leads to a state with an arc v, the arc u is turned to a copy of that state without v, and an arc w is added
beside u that leads where v led. All arcs with one label lead to one state, so a state needs only the state
that it copies, the label that its gadget took away, and when. The paths that are left spell exactly the encodings of all byte strings,
one path for each string. Arcs are looked up in a table that is filled as they are first asked for.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.words import runs

MEMO = 100_000
# fixed values: the pre-split pattern of byte-level BPE
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class TokenAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        n = max(vocab.values()) + 1
        self.labels = [b""] * n
        for word, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in word)
        # a state beside the first: whose arcs lead to it, and the merge that made it
        self.owner, self.born = (array("i", [-1]) for _ in range(2))
        # of each owner: its states in order, when they were made, the labels taken away, the state it had before
        self.states: dict[int, list[int]] = {}
        self.times: dict[int, list[int]] = {}
        self.gone: dict[int, dict[int, int]] = {}
        self.base: dict[int, int] = {}
        self.lead = array("i", [0]) * n  # the state that every arc with this label leads to
        self.made, self.left = array("i", [-1]) * n, array("i", [-1]) * n
        self.arcs: dict[bytes, int] = {bytes([b]): vocab[c] for c, b in letters.items() if c in vocab}
        for step, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            q = self.lead[u]
            if not self._has(q, v):
                continue  # no path takes u then v any more: the gadget finds nothing
            if u not in self.base:
                self.base[u], self.states[u], self.times[u], self.gone[u] = q, [], [], {}
            self.owner.append(u)
            self.born.append(step)
            self.lead[w] = q if u == v else self.lead[v]
            self.lead[u] = len(self.born) - 1
            self.states[u].append(self.lead[u])
            self.times[u].append(step)
            self.gone[u][v] = step
            self.made[w], self.left[w] = step, u
            self.arcs[self.labels[w]] = w
        self.reach: dict[bytes, int] = {}  # the longest label that begins with three bytes
        self.size, self.shorter = array("i", [0]) * n, array("i", [-1]) * n  # shorter: the longest label within its beginning
        for x, i in self.arcs.items():
            self.reach[x[:3]] = max(self.reach.get(x[:3], 2), len(x))
            self.size[i] = len(x)
            self.shorter[i] = next((self.arcs[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in self.arcs), -1)
        self.table: dict[int, bool] = {}

    def _has(self, state: int, label: int) -> bool:
        """Whether the state has an arc with this label."""
        owner, born, made, left = self.owner, self.born, self.made, self.left
        while True:
            since = made[label]
            while born[state] > since:
                x = owner[state]
                step = self.gone[x].get(label, -1)
                if since < step <= born[state]:
                    return False
                k = bisect_right(self.times[x], since)  # the state as it was then
                state = self.states[x][k - 1] if k else self.base[x]
            if since < 0:
                return True
            label = left[label]  # the arc was added beside this one, if the state had it then

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word.

        Every prefix is spelled by one path at most, so a place that leads nowhere once never does: the walk tries
        the longest arcs first and goes back only where it has to.
        """
        arcs = self.arcs
        label = arcs.get(word)
        if label is not None:
            return [label]
        lead, table, reach, shorter, size = self.lead, self.table, self.reach, self.shorter, self.size
        n, at, state, label = len(word), 0, 0, -1
        path: list[int] = []
        closed = set()
        while at < n:
            if label < 0:  # the longest arc label that the rest begins with
                end = at + reach.get(word[at : at + 3], 2)
                if end > n:
                    end = n
                label = arcs.get(word[at:end], -1)
                while label < 0:
                    end -= 1
                    label = arcs.get(word[at:end], -1)
            else:
                label = shorter[label]
            while label >= 0:
                key = state << 20 | label
                ok = table.get(key)
                if ok is None:
                    ok = table[key] = self._has(state, label)
                if ok and at + size[label] not in closed:
                    break
                label = shorter[label]
            if label >= 0:
                path.append(label)
                at, state, label = at + size[label], lead[label], -1
            else:
                closed.add(at)
                label = path.pop()
                at -= size[label]
                state = lead[path[-1]] if path else 0
        return path


class Codec:
    """A tokenizer file's splitter, automaton and added tokens. Held once per Python worker."""

    held: dict[str, Codec] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_length = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.pieces = regex.compile(SPLIT).findall
        labels = self.automaton.labels
        labels += [b""] * (max([len(labels) - 1, *self.added.values()]) + 1 - len(labels))
        for word, i in self.added.items():
            labels[i] = word.encode()
        self.memo = _Memo(self.automaton)

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        self.memo.turn(MEMO)
        if len(self.automaton.table) > 3 * MEMO:
            self.automaton.table.clear()
        get = self.memo.__getitem__
        if not any(x in text for x in self.added):
            return b"".join(map(get, self.pieces(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(struct.pack("<I", self.added[part]))
            else:
                out += map(get, self.pieces(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        label = self.automaton.labels.__getitem__
        return b"".join(map(label, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class Recent(dict):
    """Results by piece. When it holds many, those move to a second rank, and those used again move back."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, object] = {}

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.before = dict(self)
            self.clear()

    def make(self, piece: str):
        raise NotImplementedError

    def __missing__(self, piece: str):
        out = self.before.get(piece)
        if out is None:
            out = self.make(piece)
            if len(piece) > 64:
                return out
        self[piece] = out
        return out


class _Memo(Recent):
    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def make(self, piece: str) -> bytes:
        ids = self.automaton.encode(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)


def encode_decode(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(doc_id long, ids array<int>, decoded string, n_tokens long, ids_sha256, decoded_sha256), a row for each row.

    tokenizer: the path, on every executor, of a byte-level BPE file. Strings of its added tokens inside texts
    become their ids. Null texts are empty: no ids, the digests of nothing. Null ids and repeated rows are kept as
    they are; other columns are not looked at. with_ids: whether to return ids and decoded beside the digests.
    """

    def run(batches):
        codec = Codec.at(tokenizer)
        for batch in batches:
            for lo, hi in runs(batch.column(1)):
                coded = [codec.encode(x.as_py() or "") for x in batch.column(1).slice(lo, hi - lo)]
                back = [codec.decode(x) for x in coded]
                cols = [batch.column(0).slice(lo, hi - lo)]
                if with_ids:
                    at = np.cumsum([0, *[len(x) // 4 for x in coded]], dtype=np.int32)
                    values = pa.array(np.frombuffer(b"".join(coded), dtype=np.int32))
                    cols += [pa.ListArray.from_arrays(pa.array(at), values), pa.array(back, pa.string())]
                cols += [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    whole = {"ids": "array<int>", "decoded": "string"} if with_ids else {}
    kinds = {"doc_id": "long", **whole, "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    names = list(kinds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))
