"""Ranked lexical search: hashed max-sketches give upper bounds, exact scores are made in descending order of them.

A document's impacts (term weight times saturated frequency) fold into a sketch: coordinate hash(term) mod size holds
the largest of those that fall there, so a lookup is never below the term's own impact, and the sum of a query's lookups
never below its score. Sketches have four to eight coordinates for each term that they hold. A task makes the sketches of
about a megabyte of text, bounds all queries of a block over it in batched lookups, and scores documents exactly in
descending order of bound until the bound is under the task's own top-th best score. Only these best of every task are
shuffled. Queries go in blocks, each with one pass for its terms' document counts and one for the scores; the block is
all that goes through the driver, and its size is bounded by bytes of text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.words import U, chunks, word_hashes, word_spans

BLOCK = 1 << 20
_CELLS = 1 << 21
_GAP = np.ones(256, dtype=bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _GAP[_lo : _hi + 1] = False


def _terms(texts: pa.Array):
    """(first row, hashes of all terms, index of each row's first) of runs of rows of about a megabyte."""
    for lo, _, buf, offs in chunks(texts):
        starts, ends, first = word_spans(buf, offs, _GAP)
        yield lo, word_hashes(buf, starts, ends), first


class Block:
    """Queries: their distinct terms (hashes in order), and each query's terms with how often it repeats them."""

    def __init__(self, texts: list[str | None]):
        found = [np.unique(h, return_counts=True) for h in self._each(texts)]
        self.vocab = np.unique(np.concatenate([np.zeros(0, dtype=U), *[h for h, _ in found]]))
        self.size = np.array([len(h) for h, _ in found], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        at = [np.searchsorted(self.vocab, h) for h, _ in found]
        self.term = np.concatenate([np.zeros(0, dtype=np.int64), *at])
        self.times = np.concatenate([np.zeros(0, dtype=np.int64), *[n for _, n in found]]).astype(np.int64)

    @staticmethod
    def _each(texts: list[str | None]):
        for _, h, first in _terms(pa.array(texts, pa.string())):
            for i in range(len(first) - 1):
                yield h[first[i] : first[i + 1]]

    def met(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, frequency), by row and term, of the block's terms among these."""
        n, v = np.diff(first), len(self.vocab)
        at = np.searchsorted(self.vocab, h)
        at[at == v] = 0
        hit = np.flatnonzero(self.vocab[at] == h)
        code, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * v + at[hit], return_counts=True)
        return code // v, code % v, tf


def _count(rows: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, their terms, documents of each of the block's terms), over all rows."""

    def run(batches):
        df = np.zeros(len(block.vocab) + 2, dtype=np.int64)
        for batch in batches:
            for _, h, first in _terms(batch.column(1)):
                df[-2] += np.count_nonzero(np.diff(first))
                df[-1] += len(h)
                df[:-2] += np.bincount(block.met(h, first)[1], minlength=len(block.vocab))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    df = np.zeros(len(block.vocab) + 2, dtype=np.int64)
    for r in rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.term] = r.n
    return int(df[-2]), int(df[-1]), df[:-2]


class _Best:
    """The best `top` (score, document) of each query of a block so far: scores descending, then documents ascending."""

    def __init__(self, queries: int, top: int):
        self.score = np.zeros((queries, top), dtype=np.int64)
        self.doc = np.zeros((queries, top), dtype=np.int64)

    def floor(self) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.score[:, -1], 1)

    def put(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score[q], score)), np.concatenate((self.doc[q], doc))
        order = np.lexsort((doc, -score))[: self.score.shape[1]]
        self.score[q], self.doc[q] = score[order], doc[order]


def _search(block: Block, best: _Best, weight: np.ndarray, damp: np.ndarray, met, docs: np.ndarray) -> None:
    """Put what these documents score into best. damp: of each document; met: the block's terms in them."""
    row, term, tf = met
    v, n = len(block.vocab), len(docs)
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * damp[row]))
    held = np.bincount(row, minlength=n)
    some = np.flatnonzero(held)
    if not len(some):
        return
    size = 1 << np.ceil(np.log2(np.maximum(4 * held, 16))).astype(np.int64)
    base = np.cumsum(size) - size
    sketch = np.zeros(int(size.sum()), dtype=np.int64)
    hashed = (block.vocab >> U(17)).astype(np.int64)
    np.maximum.at(sketch, base[row] + (hashed[term] & (size[row] - 1)), impact)
    bounds = np.zeros((len(block.size), n), dtype=np.int64)
    filled = np.flatnonzero(block.size)
    if not len(filled):
        return
    step = max(1, _CELLS // len(block.term))
    for a in range(0, len(some), step):
        d = some[a : a + step]
        found = sketch[base[d] + (hashed[:, None] & (size[d] - 1))]  # every term of the block in every sketch
        bounds[filled[:, None], d] = np.add.reduceat(found[block.term] * block.times[:, None], block.first[filled], axis=0)
    code = row * v + term
    for q in np.flatnonzero((bounds >= best.floor()[:, None]).any(axis=1)):
        own = bounds[q]
        cand = np.flatnonzero(own >= best.floor()[q])
        cand = cand[np.argsort(-own[cand], kind="stable")]
        ours = slice(block.first[q], block.first[q + 1])
        for a in range(0, len(cand), best.score.shape[1]):
            d = cand[a : a + best.score.shape[1]]
            d = d[own[d] >= best.floor()[q]]
            if not len(d):
                break
            want = d[:, None] * v + block.term[ours]
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            exact = np.where(code[at] == want, impact[at], 0) @ block.times[ours]
            best.put(q, exact, docs[d])


def _ranked(rows: DataFrame, block: Block, stats: tuple[int, int, np.ndarray], top: int, b: int) -> DataFrame:
    """(query long, doc_id, score): each task's best documents of each query of the block."""
    n_docs, n_terms, df = stats
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)

    def run(batches):
        best = _Best(len(block.size), top)
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, h, first in _terms(batch.column(1)):
                n = np.diff(first)
                damp = 100 - b + (b * n * n_docs) // n_terms if n_terms else n
                _search(block, best, weight, damp, block.met(h, first), docs[lo : lo + len(n)])
        q, at = np.nonzero(best.score)
        cols = [pa.array(q), pa.array(best.doc[q, at]), pa.array(best.score[q, at])]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query long, doc_id long, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = 10,
    b: int = 75,
    block_bytes: int = BLOCK,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """(item_id long, rank int, doc_id long, score long): the top best documents of every item, score above 0.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased, in whole texts; told
    apart by 64-bit hashes. b: how much of a document's length counts, in hundredths. Equal scores rank by doc_id.

    Null and empty texts have no terms: such documents score nothing, such items find nothing. Rows of docs with a null id
    are left out of everything; every other row is a document, so repeated rows count as often as they occur and each
    takes a rank. Repeated rows of items count once; an id with several texts is searched by each of them and
    keeps the best, a document once; a null item_id is an id. Empty tables give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    asked = asked.where(F.length("text") > 0).distinct()
    n_bytes = asked.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = n_bytes // block_bytes + 1
    found, schema = None, "item_id long, doc_id long, score long"
    for k in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = Block([r.text for r in mine])
        if not len(block.vocab):
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(mine)], "query long, item_id long")
        part = _ranked(rows, block, _count(rows, block), top, b).join(F.broadcast(names), "query").drop("query")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    if blocks > 1 or len({r.item_id for r in mine}) < len(mine):  # an id with several texts
        again = asked.groupBy("item_id").count().where("count > 1").select("item_id")
        if again.limit(1).count():
            several = found.join(again, "item_id", "left_semi").groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
            found = found.join(again, "item_id", "left_anti").unionByName(several)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
