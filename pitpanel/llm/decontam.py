"""Benchmark decontamination: SimHash fingerprints of windows find the items, exact weighted shingles confirm them.

Windows come in the sizes of WINDOWS. An item takes the largest of which two parts of it hold one each; it has
fingerprints of windows at the start of every such part, and at the next places after it. A document has windows
of the sizes that items take, every `step` words, so that wherever it holds a part of an item, one of its windows
is at one of the item's places. A copy with a changed word keeps a part whole, or nearly so.

A fingerprint has 64 bits, cut in BLOCKS. By the pigeonhole principle, two fingerprints within RADIUS bits agree on
one block but for RADIUS // BLOCKS bits. All block values within that of an item's are listed with the item; a
document's windows look theirs up, which finds every fingerprint within the radius. Those tell where the item would
begin; the runs of words about there are compared with it exactly: sum of the smaller shingle counts over sum of
the larger.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.store import by_size, materialise

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 7, 4
#: Shingles of a window -> step between a document's windows. Odd, so that no bit is a tie.
WINDOWS = {1: 1, 3: 1, 5: 2, 7: 3, 11: 4, 17: 6}
#: Places of windows in a segment of a document: a multiple of all steps.
SEGMENT = 252
_OTHER = r"[^\p{L}\p{N}]+"
# fixed values: what stands between words most often
_TRIM = " \t\n\r.,;:!?\"'()[]{}<>-*#|%&$/"


def with_shingles(df: DataFrame, name: str, k: int = SHINGLE) -> DataFrame:
    """df with the hashes of the k-word shingles of its text, in order; words are runs of letters and digits, in lower case.

    In two steps, so that the words are not split again for every shingle.
    """
    words = F.split(F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(_TRIM)), _OTHER)
    df = df.withColumn("text", F.transform(words, lambda w: F.xxhash64(w)))
    last = F.size("text") - k
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(places, lambda p: F.xxhash64(*[F.get("text", p + i) for i in range(k)]))
    return df.withColumn(name, hashed).drop("text")


def size_for(n: Column) -> Column:
    """Shingles of the windows of an item of n shingles: two of them (that may meet) and a step fit in it."""
    return F.coalesce(*[F.when(n >= -(-9 * w // 5) + step - 1, F.lit(w)) for w, step in sorted(WINDOWS.items(), reverse=True)], F.lit(1))


def places_in(n: Column, w: Column) -> Column:
    """Where an item of n shingles has windows of w: `step` places from the start of each part, the last ones at its end."""
    step = F.coalesce(*[F.when(w == size, F.lit(step)) for size, step in WINDOWS.items()])
    last = n - w - step + 1
    parts = F.when(last >= 0, F.sequence(F.lit(0), last, w)).otherwise(F.array().cast("array<int>"))
    starts = F.concat(parts, F.array(F.greatest(last, F.lit(0))))
    spots = F.flatten(F.transform(starts, lambda t: F.sequence(t, t + step - 1)))
    return F.array_distinct(F.filter(spots, lambda x: x + w <= n))


def with_fingerprint(df: DataFrame, sh: str, at: str, width: str, most: int = max(WINDOWS)) -> DataFrame:
    """df with fp: the 64-bit SimHash of `width` (odd, `most` at most) shingles from `at`; a bit is that of most hashes.

    The bits of all 64 counters are kept in five words, one for each power of two, and hashes are added to them
    by bitwise full adders. A count of ones is the larger part if adding 32 less half the width carries over.
    """
    names = iter(range(10_000))

    def put(**cols: Column) -> None:
        nonlocal df
        df = df.withColumns(cols)

    at_level: list[list[str]] = [[] for _ in range(6)]
    first = {f"_h{i}": F.coalesce(F.get(sh, F.when(F.col(width) > i, F.col(at) + i)), F.lit(0).cast("long")) for i in range(most)}
    put(**first)
    at_level[0] = list(first)
    for level in range(5):
        row = at_level[level]
        while len(row) > 1:
            a, b, c = *row[:2], row[2] if len(row) > 2 else None
            k = next(names)
            put(**{f"_x{k}": F.col(a).bitwiseXOR(F.col(b)), f"_a{k}": F.col(a).bitwiseAND(F.col(b))})
            if c is None:
                row, carry = [f"_x{k}"], f"_a{k}"
            else:
                put(**{f"_s{k}": F.col(f"_x{k}").bitwiseXOR(F.col(c)), f"_c{k}": F.col(f"_a{k}").bitwiseOR(F.col(f"_x{k}").bitwiseAND(F.col(c)))})
                row, carry = [*row[3:], f"_s{k}"], f"_c{k}"
            at_level[level + 1].append(carry)
        at_level[level] = row
    add = F.lit(32) - F.shiftright(F.col(width) + 1, 1)
    carry: Column = F.lit(0).cast("long")
    for level in range(5):
        mask = -F.shiftright(add, level).bitwiseAND(F.lit(1)).cast("long")
        bits = F.col(at_level[level][0]) if at_level[level] else F.lit(0).cast("long")
        put(**{f"_m{level}": bits.bitwiseAND(mask).bitwiseOR(carry.bitwiseAND(bits.bitwiseOR(mask)))})
        carry = F.col(f"_m{level}")
    made = [c for c in df.columns if c[0] == "_" and c[1] in "hxascm" and c[2:].isdigit()]
    return df.withColumn("fp", carry).drop(*made)


def block_keys(fp: Column, width: Column, flips: int = 0) -> Column:
    """The keys of a fingerprint's blocks: window size, block and bits; with `flips`, of all bits within so many changes."""
    bits = 64 // BLOCKS
    masks = [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)]

    def around(key: Column) -> Column:
        return F.transform(F.array(*map(F.lit, masks)), lambda m: key.bitwiseXOR(m.cast("long")))

    keys = []
    for i in range(BLOCKS):
        block = F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1))
        head = F.shiftleft(width.cast("long") * BLOCKS + i, bits).bitwiseOR(block)
        keys.append(around(head) if flips else head)
    return F.flatten(F.array(*keys)) if flips else F.array(*keys)


def weighted_similarity(a: Column, b: Column, plain: Column) -> Column:
    """Sum of the smaller counts over sum of the larger, of two arrays taken as multisets; plain: whether b has no element twice."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.array_intersect(a, b)
    many = F.aggregate(both, F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    low = F.when(plain, F.size(both)).otherwise(many)
    return low / (F.size(a) + F.size(b) - low)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id long, item_id long, similarity double, start long), a row for each document and item it holds.

    A document holds an item if a run of its words as long as the item has a weighted 5-word-shingle similarity of
    at least `similarity` to it, and a window of it lies within RADIUS bits of one of the item's; start is the word
    at which the first most similar run begins. Case and punctuation do not count. Items of under five words have
    no shingle and are found nowhere; null texts are empty; rows with null ids are left out; repeated rows of
    either table count once; empty tables give no rows. Other columns are not looked at.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = with_shingles(items.where("item_id is not null"), "item")
    items = materialise(items.where(F.size("item") > 0).withColumns({"n": F.size("item"), "plain": F.size(F.array_distinct("item")) == F.size("item")}).distinct())
    items = items.withColumn("w", size_for(F.col("n")))
    sizes = sorted(r["w"] for r in items.select("w").distinct().collect())  # those of WINDOWS at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start long")
    known = items.select("item_id", "n", "item", "w", F.explode(places_in(F.col("n"), F.col("w"))).alias("offset"))
    known = with_fingerprint(known, "item", "offset", "w").select("item_id", "n", "w", "offset", F.col("fp").alias("item_fp"))
    listed = known.select("item_id", "n", "offset", "item_fp", F.explode(block_keys(F.col("item_fp"), F.col("w"), RADIUS // BLOCKS)).alias("key"))
    listed = materialise(listed)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    kinds = ", ".join(f"struct({w} as w, {WINDOWS[w]} as step)" for w in sizes)
    # in segments that overlap, so that a window drags no whole document along; outer: no filter on sh that computes it again
    rows = with_shingles(docs, "sh").withColumn("m", F.size("sh"))
    starts = F.when(F.col("m") > 0, F.sequence(F.lit(0), F.col("m") - 1, F.lit(SEGMENT)))
    segments = F.transform(starts, lambda s: F.struct(s.alias("base"), F.slice("sh", s + 1, SEGMENT + max(WINDOWS) - 1).alias("sh")))
    rows = rows.select("doc_id", "m", F.explode_outer(segments).alias("x")).select("doc_id", "m", "x.base", "x.sh", F.expr(f"inline(array({kinds}))"))
    last = F.least(F.size("sh") - F.col("w"), F.lit(SEGMENT - 1))
    rows = rows.withColumn("at", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last, F.col("step"))))).where("at is not null")
    rows = with_fingerprint(rows, "sh", "at", "w", max(sizes))
    rows = rows.select("doc_id", "m", (F.col("base") + F.col("at")).alias("p"), "fp", F.explode(block_keys(F.col("fp"), F.col("w"))).alias("key"))
    met = by_size(rows, listed, "key", max_rows=1_000_000).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # the item would begin at p - offset; the runs about there
    slack = F.ceil(F.col("n") / 4).cast("int")
    last = F.greatest(F.col("m") - F.col("n"), F.lit(0))
    begin = F.col("p") - F.col("offset")
    low, high = F.greatest(begin - slack, F.lit(0)), F.least(begin + slack, last)
    low = F.least(low, last)
    met = materialise(met.select("doc_id", "m", "item_id", "n", low.alias("low"), F.greatest(high, low).alias("high")).distinct())
    # the texts of documents that were met, once each
    hit = met.select("doc_id").distinct()
    texts = with_shingles(by_size(docs, hit, "doc_id", "left_semi"), "sh").withColumn("m", F.size("sh"))
    part = F.slice("sh", F.col("low") + 1, F.col("high") - F.col("low") + F.col("n"))
    met = by_size(texts, met, ["doc_id", "m"]).select("doc_id", "item_id", "low", "high", part.alias("part"))
    # dealt by rows: the rows are few, the work on each is not
    near = by_size(met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), items.drop("w"), "item_id")

    def best(acc: Column, start: Column) -> Column:
        now = weighted_similarity(F.slice("part", start - F.col("low") + 1, F.col("n")), F.col("item"), F.col("plain"))
        held = F.struct(now.alias("similarity"), (-start).alias("before"))
        return F.greatest(acc, held)

    least = F.struct(F.lit(-1.0).alias("similarity"), F.lit(0).alias("before"))
    near = near.select("doc_id", "item_id", F.aggregate(F.sequence("low", "high"), least, best).alias("best"))
    near = near.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).where(F.col("best.similarity") >= similarity)
    return near.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).cast("long").alias("start"))
