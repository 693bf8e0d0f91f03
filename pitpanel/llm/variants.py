"""Spelling variant grouping: words one edit apart by a variable-length gram index.

A frequency-pruned dictionary holds the grams of up to GRAM_MAX - 1 letters that are frequent among the words. A word is decomposed at
every place into the shortest gram, of two letters or more, that is not frequent (or has GRAM_MAX letters, or meets
the word's end). One edit changes only the grams over its place, so the most grams over any place of a word bound how
many it loses: with m grams and at most a affected, a word within one edit shares m - a of them, at known places and
lengths. Of lists to be merged for that many, all but the a + 1 rarest of a word can be left out. Candidates that meet in a
list are verified by edit distance. Lists longer than LONG are not merged pair by pair: their words meet where
they are equal but for one letter at one place, which at most an alphabet of words are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.store import by_size, materialise

GRAM_MIN, GRAM_MAX, LONG, SHARE = 2, 5, 128, 50_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FLUSH = 300_000


def word_counts(docs: DataFrame, *, least: int, every: int | None, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of all runs of letters, of at least `least` of them after the deletions."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                own = Counter(run_of((text.as_py() or "").encode("utf-8", "replace").translate(_LOWER).decode()))
                if not every:
                    total.update(own)
                    continue
                head = zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), head)
                    if h % every == 0:
                        p = h % len(word)
                        word = word[:p] + word[p + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
            if len(total) > _FLUSH:
                yield told(total)
                total.clear()
        if total:
            yield told(total)

    def told(total: Counter) -> pa.RecordBatch:
        cols = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["word", "n"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, share: int) -> set[str]:
    """The grams of GRAM_MIN to GRAM_MAX - 1 letters that make up more than 1 / share of all grams of their length.

    So there are at most `share` of each length, whatever the size of the vocabulary.
    """
    ends = F.length("word") - F.col("q") + 1
    sized = words.select("word", F.explode(F.array(*map(F.lit, range(GRAM_MIN, GRAM_MAX)))).alias("q"))
    at = sized.where(F.length("word") >= F.col("q")).select("q", "word", F.explode(F.sequence(F.lit(1), ends)).alias("p"))
    grams = at.groupBy(F.substr("word", F.col("p"), F.col("q")).alias("gram")).agg(F.count("*").alias("n"))
    grams = materialise(grams)
    totals = grams.groupBy(F.length("gram").alias("q")).agg(F.sum("n").alias("total"))
    kept = grams.join(F.broadcast(totals), F.length("gram") == F.col("q")).where(F.col("n") * share > F.col("total") + 16 * share)
    return {r.gram for r in kept.select("gram").toLocalIterator()}


def decompose(word: str, frequent: set[str]) -> list[tuple[str, int, int]]:
    """(gram, place, last place that an edit there changes it from) at every place of the word."""
    out, n = [], len(word)
    for p in range(n - GRAM_MIN + 1):
        q = GRAM_MIN
        while q < GRAM_MAX and p + q < n and word[p : p + q] in frequent:
            q += 1
        open_end = p + q == n and q < GRAM_MAX and word[p:] in frequent
        out.append((word[p : p + q], p, n if open_end else p + q - 1))
    return out


def affected(grams: list[tuple[str, int, int]], n: int) -> int:
    """The most grams that one edit of the word of n letters can change."""
    return max(sum(p <= j <= e for _, p, e in grams) for j in range(n + 1))


def lists_of(words: DataFrame, frequent: set[str]) -> DataFrame:
    """(word, n, gram, place) of the rarest grams of every word: one more than an edit can change."""

    def run(batches):
        for batch in batches:
            cols = [[], [], [], []]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = decompose(word, frequent)
                # one order for all words: frequent grams last
                grams_in_order = sorted((g in frequent, g, p) for g, p, _ in grams)
                for _, g, p in grams_in_order[: affected(grams, len(word)) + 1]:
                    for col, x in zip(cols, (word, n, g, p), strict=True):
                        col.append(x)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["word", "n", "gram", "place"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, gram string, place int")


def _keyed(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, word, n) of lists by gram, place and length of word; and what a word of the same length or one more asks for."""
    size = F.length("word")
    key = lambda place, size: F.xxhash64("gram", place, size)
    index = lists.select(key(F.col("place"), size).alias("key"), "word", "n")
    asked = F.array(key(F.col("place"), size), key(F.col("place"), size - 1), key(F.col("place") - 1, size - 1))
    return index, lists.select(F.explode(asked).alias("key"), "word", "n")


def _but_one(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), each pair once or more: words that are equal but for one letter at one place, through that place."""
    size = F.length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), size)).alias("p"))
    less = at.select("word", "n", size.alias("size"), "p", F.concat(F.substr("word", F.lit(1), F.col("p") - 1), F.substr("word", F.col("p") + 1)).alias("rest"))
    a, b = less.alias("a"), less.alias("b")
    same = (F.col("a.rest") == F.col("b.rest")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.word") < F.col("b.word"))
    cols = [F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb")]
    swapped = a.join(b, same).select(*cols)
    longer = less.alias("a").join(words.alias("b"), F.col("a.rest") == F.col("b.word")).select(*cols)
    return swapped.unionByName(longer)


def near_words(words: DataFrame, *, share: int = SHARE, long: int = LONG) -> DataFrame:
    """(a, na, b, nb), a row for each pair of words one edit apart; words: (word, n), distinct, longer than GRAM_MAX + 1."""
    lists = materialise(lists_of(words, frequent_grams(words, share)))
    index, asked = _keyed(lists)
    hot = materialise(index.groupBy("key").count().where(F.col("count") > long).select("key"))
    cold = [by_size(x, hot, "key", "left_anti") for x in (index, asked)]
    a, b = cold[1].alias("a"), cold[0].alias("b")
    met = (F.col("a.key") == F.col("b.key")) & ((F.length("a.word") > F.length("b.word")) | (F.col("a.word") < F.col("b.word")))
    near = a.join(b, met & (F.levenshtein("a.word", "b.word", 1) == 1))
    found = near.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))
    if hot.limit(1).count():
        crowded = materialise(by_size(asked, hot, "key", "left_semi").select("word", "n").distinct())
        found = found.unionByName(_but_one(crowded))
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of forms (word, form), follow forms to the last; the way doubles every round."""
    now = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while now.where("open").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = now.join(further, "root", "left")
        now = materialise(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("open")))
    return now.select("word", "root")


def group_variants(
    docs: DataFrame,
    *,
    least: int = 7,
    times: int = 2,
    factor: int = 10,
    every: int | None = 31,
    share: int = SHARE,
    long: int = LONG,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long), a row for each word.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, of at least `least` letters (at
    least GRAM_MAX + 2), that occur at least `times` times in all. every: in about one of so many pairs of document and run a letter is deleted, by crc32 (None: in none).
    form: the near word that occurs most (ties: the smaller), if that is at least factor times as often; root: the end of that way.

    Null and empty texts have no words; rows with a null id are left out; repeated rows count as often as they occur; an empty
    table gives no rows. A long text is one row of a task. Other columns are not looked at.
    """
    if least < GRAM_MAX + 2:
        raise ValueError(f"words of under {GRAM_MAX + 2} letters can share no gram")
    counted = word_counts(docs, least=least, every=every, id_col=id_col, text_col=text_col)
    words = materialise(counted.where(F.col("n") >= times))
    pairs = materialise(near_words(words, share=share, long=long))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")),
    )).alias("r")).select("r.*")
    most: Column = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    seen = both.groupBy("word").agg(F.count("*").alias("n_near"), most.alias("most"))
    taken = -F.col("most.less") >= factor * F.col("n")
    told = words.join(seen, "word", "left").select(
        "word",
        F.when(taken, F.col("most.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, -F.col("most.less")).alias("form_n"),
    )
    told = materialise(told)
    roots = _roots(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
