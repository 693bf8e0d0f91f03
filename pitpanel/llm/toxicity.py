"""Toxicity by weak supervision.

Voters vote for toxic, for not toxic, or abstain. Lexicon voters are words and word beginnings that labelled toxic
documents use far more often than others (an exact binomial test of every term, corrected for the number of
tests); each votes toxic where it stands. Pattern voters look at the text as a whole and may vote either way. A
generative label model estimates from the votes how often each voter votes so on either class, and how votes
correlate within the classes; labels only give the model its start and the classes' shares. A linear classifier is
trained on the model's posterior labels and scores all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.quality import binomial_tail
from pitpanel.llm.store import by_size, materialise

#: Most labelled rows that the models are fitted on (taken by hash); documents that a term needs to be tested; share
#: of false terms allowed in the lexicon; precision of a term; fitted rows that a voter of its own must vote on.
FIT_ROWS, TESTED, FALSE_SHARE, PRECISION, OWN = 20_000, 4, 0.01, 0.8, 10
FIT_PARTS = 32
_HELD_TERMS = 300_000
_LETTERS = regex.compile(r"\p{L}+")
_BROKEN = regex.compile(r"(?<!\p{L})\p{L}(?:[.*_\-]\p{L}){2,}(?!\p{L})")
#: What the patterns see; each is two voters, one for either vote.
PATTERNS = ("listed", "repeated", "marks", "capitals", "broken", "short")


def _terms_of(word: str) -> list[str]:
    """A word itself (=) and its first 4 (4) and 5 (5) letters."""
    n = len(word)
    out = ["=" + word] if 2 < n <= 24 else []
    if n > 4:
        out.append("4" + word[:4])
    if n > 5:
        out.append("5" + word[:5])
    return out


def _count_terms(batches):
    """(term, toxic documents, other documents) of a partition; the counts of a part of it where it has many terms."""
    seen: dict[str, list[int]] = {}

    def told():
        counts = list(seen.values())
        cols = [pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, names=["term", "p", "q"])

    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for t in {t for w in set(_LETTERS.findall((x.as_py() or "").lower())) for t in _terms_of(w)}:
                seen.setdefault(t, [0, 0])[1 - y] += 1
            if len(seen) > _HELD_TERMS:
                yield told()
                seen.clear()
    yield told()


def lexicon(train: DataFrame, sizes: dict[int, int]) -> list[str]:
    """The terms that vote toxic: all whose use in labelled documents (text, toxic) passes the test.

    For every term in TESTED documents or more: how likely is it that so many of them are toxic, if they were drawn
    from all? By Benjamini and Hochberg's step, at most FALSE_SHARE of the terms that pass are false ones; terms
    also need PRECISION. Terms are counted and tested where they are; the driver gets a histogram and those that pass.
    """
    base = sizes[1] / (sizes[0] + sizes[1])
    counted = train.select("text", "toxic").mapInArrow(_count_terms, "term string, p long, q long")
    counted = counted.groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= TESTED)

    def tested(frames):
        held: dict[tuple[int, int], float] = {}
        for df in frames:
            out = []
            for p, q in zip(df["p"].tolist(), df["q"].tolist(), strict=True):
                if (p, q) not in held:
                    if len(held) > 100_000:
                        held.clear()
                    tail = binomial_tail(q, p + q, 1 - base) if p > base * (p + q) else 1.0
                    held[p, q] = -math.log10(max(tail, 1e-300))
                out.append(held[p, q])
            yield df.assign(log_p=out)

    known = materialise(counted.mapInPandas(tested, "term string, p long, q long, log_p double"))
    bins = known.groupBy(F.floor(F.col("log_p") * 10).alias("b")).count().orderBy(F.desc("b")).collect()
    total, so_far, least = sum(r["count"] for r in bins), 0, math.inf
    for r in bins:  # at most 3,001
        so_far += r["count"]
        if 10 ** (-r["b"] / 10) * total <= FALSE_SHARE * so_far:
            least = r["b"]
    passed = known.where((F.floor(F.col("log_p") * 10) >= least) & (F.col("p") >= PRECISION * (F.col("p") + F.col("q"))))
    return sorted(r["term"] for r in passed.select("term").collect()) if least < math.inf else []


def _votes(text: str, listed: set[str]) -> tuple[set[str], list[int]]:
    """The lexicon's terms in a text, and the patterns' votes: 1, 0, or -1 (abstains)."""
    every = _LETTERS.findall(text)
    low = [w.lower() for w in every]
    found, words = set(), 0
    for w in set(low):
        hits = [t for t in _terms_of(w) if t in listed]
        found.update(hits)
        words += bool(hits)
    n = max(1, len(every))
    marks = text.count("!") / n
    capitals = sum(w.isupper() for w in every if len(w) > 2) / n
    apart = {t for x in _BROKEN.findall(text) for t in _terms_of(regex.sub(r"\P{L}", "", x).lower())}
    again = words and sum(any(t in listed for t in _terms_of(w)) for w in low) > words
    patterns = [
        1 if words >= 2 else 0 if words == 0 else -1,
        1 if again else -1,
        1 if marks >= 0.1 else 0 if marks == 0 and words == 0 else -1,
        1 if capitals >= 0.3 and n >= 5 else 0 if capitals == 0 and words == 0 else -1,
        1 if apart & listed else -1,
        1 if words and n < 60 else 0 if n >= 60 and words == 0 else -1,
    ]
    return found, patterns


def _features(found: set[str], patterns: list[int], index: dict[str, int], own: int) -> list[int]:
    """Columns of the voters that vote: terms of their own, terms pooled by kind, then patterns for and against."""
    cols = {index.get(t, own + "=45".index(t[0])) for t in found}
    cols |= {own + 3 + 2 * k + 1 - v for k, v in enumerate(patterns) if v >= 0}
    return sorted(cols)


def n_features(own: int) -> int:
    return own + 3 + 2 * len(PATTERNS)


def label_model(
    fired: np.ndarray, polarity: np.ndarray, labels: np.ndarray, rounds: int = 30, trust: float = 0.1
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each row, how often each voter votes on class 1 and on class 0, weights).

    fired: rows x voters, 1 where a voter votes; polarity: the class that it votes for. Expectation-maximisation,
    started from the labels' rates, which stay in as prior counts worth `trust` of the rows; a row's own label has no
    say in its posterior. A voter votes at least as often on the class that it votes for. Votes that correlate
    within the classes share their weight: 1 over 1 plus the sum of its correlations with others.
    """
    rows = len(fired)
    y = labels.astype(np.float64)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = [(y @ fired + 0.5) / (y.sum() + 1), ((1 - y) @ fired + 0.5) / ((1 - y).sum() + 1)]
    on1, on0 = start
    weight, post = np.ones(fired.shape[1]), y
    for _ in range(rounds):
        mean = np.sqrt(on1 * on0)
        on1, on0 = np.where(polarity == 1, np.maximum(on1, mean), np.minimum(on1, mean)), np.where(polarity == 1, np.minimum(on0, mean), np.maximum(on0, mean))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + fired @ (np.log(on1 / on0) * weight), -30, 30)))
        change, post = np.abs(new - post).max(), new
        one, zero = post.sum(), rows - post.sum()
        k1, k0 = trust * rows * prior, trust * rows * (1 - prior)
        on1 = (post @ fired + k1 * start[0]) / (one + k1)
        on0 = ((1 - post) @ fired + k0 * start[1]) / (zero + k0)
        # what votes have in common within the classes
        within = fired.T @ fired / rows - (np.outer(on1, on1) * one + np.outer(on0, on0) * zero) / rows
        sd = np.sqrt(np.maximum(np.diag(within), 1e-12))
        common = np.clip(within / sd[:, None] / sd[None, :], 0, 1)
        np.fill_diagonal(common, 0)
        weight = 1 / (1 + np.where(common > 0.1, common, 0).sum(1))
        if change < 1e-4:
            break
    return post, on1, on0, weight


def _linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_rows(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    threshold: float = 0.3,
) -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int), a row for each row of docs.

    labels: (doc_id, toxic); only rows with crc32(doc_id as text) mod 4 <> 2 and toxic 0 or 1 are learned from. The
    lexicon is counted over all of those; the models are fitted on at most fit_rows, taken by hash. With no labelled
    document of either class every score is the share of toxic labels (0 if there are none). Null and empty texts
    are scored as texts without words. Null ids are scored and not held out; repeated rows are scored alike; an empty
    table gives no rows; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = labels.where("toxic in (0, 1)").where(train_rows()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = materialise(by_size(docs, materialise(known), "doc_id").select("doc_id", "text", "toxic"))
    sizes = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    sizes = {k: sizes.get(k, 0) for k in (0, 1)}
    terms = lexicon(train, sizes) if sizes[0] and sizes[1] else []
    listed = set(terms)
    index, weights, constant = _fit(train, listed, fit_rows, sizes)
    own = len(index)

    def run(batches):
        for batch in batches:
            z = []
            for x in batch.column(1):
                found, patterns = _votes(x.as_py() or "", listed)
                z.append(constant + sum(weights[k] for k in _features(found, patterns, index, own)))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(~train_rows(), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fitted(train: DataFrame, fit_rows: int) -> DataFrame:
    """Rows of the fit_rows documents that come first by hash: only their numbers go to the texts, which stay where they are."""
    taken = train.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return train.join(F.broadcast(taken), "doc_id").limit(2 * fit_rows).repartition(FIT_PARTS)


def _fit(train: DataFrame, listed: set[str], fit_rows: int, sizes: dict[int, int]) -> tuple[dict[str, int], list[float], float]:
    """The terms with a voter of their own and their columns, the weights of all columns, and the constant."""
    total = sizes[0] + sizes[1]
    if not sizes[0] or not sizes[1]:
        share = min(max(sizes[1] / total if total else 0.0, 1e-9), 1 - 1e-9)
        return {}, [0.0] * n_features(0), float(np.log(share / (1 - share)))
    if total > fit_rows:
        train = fitted(train, fit_rows)

    def run(frames):
        for df in frames:
            both = [_votes(x or "", listed) for x in df["text"]]
            yield df[["toxic"]].assign(found=[sorted(b[0]) for b in both], patterns=[b[1] for b in both])

    df = train.mapInPandas(run, "toxic int, found array<string>, patterns array<int>").toPandas()
    n: dict[str, int] = {}
    for found in df["found"]:
        for t in found:
            n[t] = n.get(t, 0) + 1
    index = {t: k for k, t in enumerate(sorted(t for t, c in n.items() if c >= OWN))}
    own = len(index)
    fired = np.zeros((len(df), n_features(own)), dtype=np.float32)
    for i, (found, patterns) in enumerate(zip(df["found"], df["patterns"], strict=True)):
        fired[i, _features(set(found), list(patterns), index, own)] = 1
    polarity = np.array([1] * (own + 3) + [1, 0] * len(PATTERNS))
    post, *_ = label_model(fired, polarity, df["toxic"].to_numpy())
    w = _linear(fired.astype(np.float64), post)
    return index, w[:-1].tolist(), float(w[-1])
