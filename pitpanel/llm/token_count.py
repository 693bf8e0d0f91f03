"""Token counts by byte-pair merging on a linked list with a heap of adjacent pairs; no ids are made."""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.bpe import MEMO, Recent, byte_letters

# fixed values: the pre-split pattern of the tokenizer with word ends
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


class Counter(Recent):
    """Word piece -> number of tokens; filled as pieces are met. Held once per Python worker."""

    held: dict[str, Counter] = {}

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = {b: c for c, b in byte_letters().items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            self.ranks[tuple(m) if isinstance(m, list) else tuple(m.split(" "))] = i
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.added)))
        self.pieces = regex.compile(SPLIT).findall

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def make(self, piece: str) -> int:
        """Initial symbols minus merges."""
        sym = [self.letters[b] for b in piece.encode("utf-8", "replace")]
        sym[-1] += self.end
        n, ranks = len(sym), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or sym[i] == "" or ranks.get((sym[i], sym[j])) != r:
                continue  # one of the two has been merged since
            sym[i] += sym[j]
            sym[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := ranks.get((sym[a], sym[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return left

    def count(self, text: str) -> int:
        self.turn(MEMO)
        total = 0
        parts = self.cut.split(text) if any(x in text for x in self.added) else [text]
        for part in parts:
            if not part.isascii():
                # each character by itself: no special form for a sigma at a word's end
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            total += sum(map(self.__getitem__, self.pieces(part.lower())))
        return total + len(parts) - 1


def token_counts(
    docs: DataFrame, tokenizer: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id long, n_bytes long, n_tokens long, over_limit boolean), a row for each row of docs.

    tokenizer: the path, on every executor, of a BPE file with word ends. Strings of its added tokens inside texts
    count one each. Null texts are empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as they are; other
    columns are not looked at.
    """

    def run(batches):
        counter = Counter.at(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            sizes, counts = [], []
            for x in texts:
                text = x.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "replace")))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
