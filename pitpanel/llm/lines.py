"""Line dedup: a segment-partition join for lines within EDITS edits of an earlier line.

A line of n characters is cut in EDITS + 1 segments. Two lines within EDITS edits share one of them: the longer
line has, near where the shorter line's segment is, a substring equal to it. So every line has index keys (its own
length, a segment's number and characters) and probe keys (substrings of it, at the few places that a segment of a
line of its length or up to EDITS shorter can have moved to). A first pass over all keys finds those that an index
key and another line share, by two numbers a key and in partitions in proportion to keys; only lines that hold
one of these are read again. Lines that meet in a key are compared by banded bit-parallel edit distance; a key with many lines is dealt out as pairs of blocks, and each line only takes
away how many partners it has there, the first of them and the first line of its component there, so no pairs are
emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm import urls
from pitpanel.llm.store import by_size, connected_components, materialise

EDITS, MIN_CHARS, BLOCK, HALF = 2, 9, 128, 0.5
_INK = r"[^\x20\x09-\x0D]"
ORDER = "decimal(38,0)"
_LINES = 1 << 31  # places of lines in a document
_PAD = b"\xff" * 4  # no character
FEW, NUMBERS = 200_000, 2_000_000  # rows, and numbers in their arrays, that are broadcast at most
KEYS = 1_000_000  # keys of a task, about
_MOST_BITS = 1 << 26


def _may_be_one_of(ids: DataFrame, n: int):
    """A test of a long column: true for the n ids (one long column), false for most others and for null.

    A Bloom filter of 8 MB at most, so that rows which a join would drop are not shuffled for it.
    """
    bits = 64 * max(1, -(-min(_MOST_BITS, n * urls.BITS_PER_KEY) // 64))
    made = urls._filter_of(ids.toDF("host"), 0, bits)
    return lambda key: key.isNotNull() & urls._has(made, key, 0, bits)


def _those(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with key in ids, a written table of one long column of that name. Others are not shuffled, but for a few."""
    n = ids.count()
    if n <= FEW:
        return rows.join(F.broadcast(ids), key, "left_semi")
    return rows.where(_may_be_one_of(ids, n)(F.col(key))).join(ids, key, "left_semi")


def _moves(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, places that it moved) of all keys of a line."""
    return [
        (less, i, move)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for move in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]


def _segment(n: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line of n characters: even, longer ones last."""
    size = F.floor(n / parts).cast("int")
    long_from = F.lit(parts) - n % parts
    return size * i + F.greatest(i - long_from, F.lit(0)), size + (i >= long_from).cast("int")


def _piece(line: Column, start: Column, length: Column) -> Column:
    """Characters of a line that is held as four bytes a character."""
    return F.substring(line, start * 4 + 1, length * 4)


def common_prefix(a: Column, b: Column, most: Column, at_end: bool = False) -> Column:
    """Characters that a and b have in common at their starts (or ends), `most` at most, by halving."""
    size = lambda x: F.octet_length(x)

    def equal(lo: Column, mid: Column) -> Column:
        if at_end:
            cut = lambda x: F.substring(x, size(x) - mid * 4 + 1, (mid - lo) * 4)
        else:
            cut = lambda x: _piece(x, lo, mid - lo)
        return cut(a) == cut(b)

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        ok = (s["lo"] < s["hi"]) & equal(s["lo"], mid)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), most.alias("hi")), step, lambda s: s["lo"])


def _held(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines (four bytes a character) are within `edits` edits, by banded bit-parallel edit distance.

    A bit stands for a diagonal of the band and a number of edits: set if the characters of b so far turn, with so
    many edits, into those of a up to the diagonal. All bits move in one 64-bit integer, a field of eight bits for
    each number of edits. What both have in common at their ends is left out first.
    """
    if not 1 <= edits <= 3:
        raise ValueError("edits: 1 to 3")
    width, fields = 2 * edits + 1, range(edits + 1)
    ones = sum(1 << 8 * e for e in fields)
    mask = ones * ((1 << width) - 1)
    start = sum(1 << 8 * e + edits + d for e in fields for d in range(e + 1))
    band = lambda x, m: x.bitwiseAND(F.lit(m))

    def walk(z: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            c = _piece(z["b"], j, F.lit(1))
            same = None
            for d in range(width):
                bit = F.when(_piece(z["a"], j + d, F.lit(1)) == c, F.lit(ones << d)).otherwise(F.lit(0).cast("long"))
                same = bit if same is None else same.bitwiseOR(bit)
            out = acc.bitwiseAND(same).bitwiseOR(F.shiftleft(acc, 8)).bitwiseOR(F.shiftleft(acc, 7))
            return _closed(out)

        def _closed(x: Column) -> Column:
            def use(v: Column) -> Column:  # characters of a that are left out, as long as edits are left
                out = moved = v
                for _ in range(edits):
                    moved = band(F.shiftleft(moved, 9), mask)
                    out = out.bitwiseOR(moved)
                return out

            return _held(band(x, mask), use)

        n = (F.octet_length(z["b"]) / 4).cast("int")
        ends = F.call_function("shiftleft", F.lit(1).cast("long"), z["gap"] + 9 * edits)
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(start).cast("long"), step).bitwiseAND(ends) != 0

    chars = lambda x: (F.octet_length(x) / 4).cast("int")

    def cut_end(z: Column) -> Column:
        most = F.least(chars(z["a"]), chars(z["b"])) - z["pre"]
        return _held(F.struct(z["a"].alias("a"), z["b"].alias("b"), z["pre"].alias("pre"), common_prefix(z["a"], z["b"], most, True).alias("post")), core)

    def core(z: Column) -> Column:
        part = lambda x: _piece(x, z["pre"], chars(x) - z["pre"] - z["post"])
        padded = F.concat(F.lit(_PAD * edits), part(z["a"]), F.lit(_PAD * edits))
        return _held(F.struct(padded.alias("a"), part(z["b"]).alias("b"), (chars(z["a"]) - chars(z["b"])).alias("gap")), walk)

    pre = common_prefix(a, b, F.least(chars(a), chars(b)))
    return (F.abs(chars(a) - chars(b)) <= edits) & _held(F.struct(a.alias("a"), b.alias("b"), pre.alias("pre")), cut_end)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, id, id2, at) of the lines that have a visible character; at orders all lines.

    id and id2 are hashes with seeds of their own: 128 bits that stand for the line.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("line").rlike(_INK))
    at = F.col("doc_id").cast(ORDER) * F.lit(_LINES).cast(ORDER) + F.col("line_no")
    return rows.select("doc_id", "line_no", "line", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2"), at.cast(ORDER).alias("at"))


def keyed_lines(rows: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """rows, a row for each key: key, size (of the line with the segment), seg, index (whether it is an own segment)."""
    places = ", ".join(f"struct({a} as less, {b} as seg, {c} as move)" for a, b, c in _moves(edits))
    # four bytes a character, so that its pieces are cut without counting characters
    rows = rows.withColumns({"n": F.char_length("line"), "b": F.encode("line", "UTF-32")})
    rows = rows.where(F.col("n") >= max(min_chars, 3 * (edits + 1)))
    rows = rows.select("*", F.expr(f"inline(array({places}))")).withColumn("size", F.col("n") - F.col("less"))
    start, length = _segment(F.col("size"), F.col("seg"), edits + 1)
    key = F.xxhash64("size", "seg", _piece(F.col("b"), start + F.col("move"), length))
    return rows.withColumns({"key": key, "index": (F.col("less") == 0) & (F.col("move") == 0)}).drop("less", "move", "b")


def _meeting(rows: DataFrame, edits: int, min_chars: int, n: int) -> DataFrame:
    """(key, line): the keys that an index key and another line share, with the lines that hold them (63 bits of their ids).

    Two numbers of each key are shuffled, to partitions of about KEYS keys, whatever the table's size. n: the lines of rows.
    """
    keyed = keyed_lines(rows, edits, min_chars)
    mark = F.col("id").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("index").cast("long"))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed.select("key", mark.alias("mark")).repartition(max(least, -(-n * len(_moves(edits)) // KEYS)), "key")
    line = F.shiftright("mark", 1)
    met = keys.groupBy("key").agg(F.min(line).alias("low"), F.max(line).alias("high"), F.max(F.col("mark").bitwiseAND(F.lit(1))).alias("index"))
    met = met.where("index = 1 and low <> high").select("key")
    # the shuffled keys are read twice, not shuffled twice
    return materialise(keys.join(met.hint("shuffle_hash"), "key").select("key", line.alias("line_key")))


def near_lines(rows: DataFrame, edits: int, min_chars: int, block: int, n: int) -> DataFrame:
    """(id, id2, at, links int, first at, low at), a row for each group where a distinct line has others within `edits` edits.

    at: the line's first place; links: how many others; first: the first of them; low: the first line of those that
    links within the group reach. n: about how many lines there are.
    """
    hold = _meeting(rows, edits, min_chars, n)
    some = _those(rows.withColumn("line_key", F.shiftright("id", 1)), materialise(hold.select("line_key").distinct()), "line_key")
    met = materialise(hold.select("key").distinct())
    few = by_size(keyed_lines(some.drop("line_key"), edits, min_chars), met, "key").groupBy("key", "size", "seg", "id", "id2").agg(
        F.min("at").alias("at"), F.max("index").alias("index"), F.any_value("line").alias("line")
    )
    few = materialise(few)
    group = ["key", "size", "seg"]
    sizes = few.groupBy(*group).agg(F.count("*").alias("members"))
    nb = F.ceil(F.col("members") / block).cast("int")
    dealt = few.join(sizes, group).withColumns({"nb": nb, "own": F.pmod(F.xxhash64("id", F.lit(7)), nb).cast("int")})
    dealt = dealt.where("members > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")})
    # an explicit count: Spark would size these partitions by bytes, where their work is in comparing
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "bi", "bj")
    rows = dealt.groupBy(*group, "bi", "bj").agg(F.collect_list(F.struct("id", "id2", "at", "index", F.encode("line", "UTF-32").alias("b"), "own")).alias("g"))
    chars = lambda x: (F.octet_length(x["b"]) / 4).cast("int")

    def earlier_segment(x: Column, y: Column) -> Column:
        """Whether x also has a segment of y before this one: the pair counts in the first that it shares."""
        out = F.lit(False)
        for less, i, move in _moves(edits):
            start, length = _segment(F.col("size"), F.lit(i), edits + 1)
            same = _piece(x["b"], start + move, length) == _piece(y["b"], start, length)
            out = out | ((F.col("seg") > i) & (chars(x) == F.col("size") + less) & same)
        return out

    def partner(x: Column, y: Column) -> Column:
        """Whether x, not the shorter of the two and the later one if equally long, is within reach of y."""
        return (
            y["index"]
            & (chars(y) == F.col("size"))
            & ((chars(x) > F.col("size")) | (x["at"] > y["at"]))
            & ((x["own"] != y["own"]) | (F.col("bi") == F.col("bj")))
            & ~earlier_segment(x, y)
            & within_edits(x["b"], y["b"], edits)
        )

    pairs = F.flatten(
        F.transform("g", lambda x: F.transform(F.filter("g", lambda y: partner(x, y)), lambda y: F.struct(x["at"].alias("x"), y["at"].alias("y"))))
    )

    def reached(ps: Column) -> Column:
        """The lines of the group that have partners, with these partners' places."""

        def ats(x: Column) -> Column:
            mine = F.filter(ps, lambda p: (p["x"] == x["at"]) | (p["y"] == x["at"]))
            return F.transform(mine, lambda p: F.when(p["x"] == x["at"], p["y"]).otherwise(p["x"]))

        found = F.transform("g", lambda x: F.struct(x["id"].alias("id"), x["id2"].alias("id2"), x["at"].alias("at"), ats(x).alias("ats")))
        return F.when(F.size(ps) > 0, F.filter(found, lambda r: F.size(r["ats"]) > 0))

    def joined(parts: Column, r: Column) -> Column:
        own = F.concat(F.array(r["at"]), r["ats"])
        met = F.flatten(F.filter(parts, lambda p: F.arrays_overlap(p, own)))
        return F.concat(F.filter(parts, lambda p: ~F.arrays_overlap(p, own)), F.array(F.array_union(own, met)))

    def told(hits: Column) -> Column:
        parts = F.aggregate(hits, F.array().cast(f"array<array<{ORDER}>>"), joined)

        def row(x: Column, parts: Column) -> Column:
            low = F.array_min(F.flatten(F.filter(parts, lambda p: F.array_contains(p, x["at"]))))
            own = [x[c].alias(c) for c in ("id", "id2", "at")]
            return F.struct(*own, F.size(x["ats"]).alias("links"), F.array_min(x["ats"]).alias("first"), low.alias("low"))

        return _held(parts, lambda ps: F.transform(hits, lambda x: row(x, ps)))

    # each step is held, so that none is computed again for every element of the next
    return rows.select(F.inline(_held(pairs, lambda ps: _held(reached(ps), told))))


def _once(docs: DataFrame) -> DataFrame:
    """The rows of line_rows, those of a repeated doc_id without what is repeated at one place."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialise(again)
    rows = line_rows(docs)
    if not again.limit(1).count():
        return rows
    others = line_rows(by_size(docs, again, "doc_id", "left_anti"))
    return others.unionByName(line_rows(by_size(docs, again, "doc_id", "left_semi")).distinct())


def _first_of_many(rows: DataFrame, again: DataFrame, n: int) -> DataFrame:
    """rows (n of them), of the few lines with the most copies only the first: the keys of one line are not heaped up in a task.

    again: (id, id2, at, copies), of each repeated line its first place.
    """
    often = again.where(F.col("copies") > max(100, n // 100_000)).select("id", "id2", F.col("at").alias("head"))
    if not often.limit(1).count():
        return rows
    return rows.join(F.broadcast(often), ["id", "id2"], "left").where("head is null or head = at").drop("head")


def line_dedup(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_lines, n_dropped, n_links, class_id longs, dropped array<int>, sources array<long>, sizes array<int>, n_chars long).

    docs: (doc_id, text). A line with a visible character is a repeat if an earlier line (by doc_id, then line
    number) is equal, or if both have at least min_chars characters and one that is first of its kind is within
    `edits` edits; lines under 3 * (edits + 1) characters have no segments of three and are repeats only if equal.
    All repeats are dropped. n_links: other distinct lines within reach of this document's lines; class_id: the
    smallest doc_id that is reached through equal lines and lines within reach, over any number of documents, itself
    included. dropped: line numbers from 0, in order; sources: of each, the document with the earlier line; sizes: its
    characters; n_chars: those of all lines. Null and empty texts have no lines; null ids are left out;
    repeated ids are one document, whose equal lines at one place count once; an empty table gives no rows. Other
    columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _once(docs)
    again = materialise(rows.groupBy("id", "id2").agg(F.min("at").alias("at"), F.count("*").alias("copies")).where("copies > 1"))
    n = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("long"))).first()[0] or 0
    met = materialise(near_lines(_first_of_many(rows, again, n), edits, min_chars, block, n))
    near = met.groupBy("id", "id2", "at").agg(F.sum("links").alias("links"), F.min("first").alias("first"))
    keep = again.drop("copies").join(near, ["id", "id2", "at"], "full_outer").withColumnRenamed("at", "head")
    keep = materialise(keep)
    place = by_size(rows.select("doc_id", "line_no", "id", "id2", "at", F.char_length("line").alias("size")), keep, ["id", "id2"], "left")
    repeat = (F.col("first") < F.col("head")) | (F.col("head") < F.col("at"))
    doc_of = lambda at: F.floor(F.col(at) / F.lit(_LINES).cast(ORDER)).cast("long")
    source = F.when(F.col("first") < F.col("head"), doc_of("first")).otherwise(doc_of("head"))
    by_doc = place.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.sum("links").alias("n_links"),
        F.sum("size").alias("n_chars"),
        F.collect_list(F.when(repeat, F.struct("line_no", source.alias("source"), "size"))).alias("repeats"),
        F.collect_set(doc_of("head")).alias("heads"),
    )
    by_doc = materialise(by_doc)
    links = by_doc.select(F.col("doc_id").alias("a"), F.explode("heads").alias("b"))
    links = links.unionByName(met.select(doc_of("at").alias("a"), doc_of("low").alias("b")))
    roots = connected_components(links).select(F.col("id").alias("doc_id"), F.col("root").alias("class_id"))
    by_doc = by_size(by_doc.drop("heads"), roots, "doc_id", "left")
    every = docs.where("doc_id is not null").select("doc_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    repeats = F.array_sort("repeats")
    dropped = F.coalesce(F.transform(repeats, lambda x: x["line_no"]), F.array().cast("array<int>"))
    sources = F.coalesce(F.transform(repeats, lambda x: x["source"]), F.array().cast("array<long>"))
    sizes = F.coalesce(F.transform(repeats, lambda x: x["size"]), F.array().cast("array<int>"))
    return every.join(by_doc, "doc_id", "left").select(
        "doc_id",
        zero("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        zero("n_links"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        dropped.alias("dropped"),
        sources.alias("sources"),
        sizes.alias("sizes"),
        zero("n_chars"),
    )


def _without(text: Column, numbers: Column) -> Column:
    """text without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(numbers, i)), "\n")


def _shingles(text: Column, k: int) -> Column:
    """The distinct hashes of text's k-word shingles, A-Z lower-cased; with fewer words, of all of them as one."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        last = F.size(h) - k
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda p: F.xxhash64(*[F.get(h, p + i) for i in range(k)]))
        return F.when(F.size(h) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<long>"))

    return _held(F.transform(words, lambda w: F.xxhash64(w)), of)


def copies_of(docs: DataFrame, gone: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(doc_id, copied): documents that are copies of the one document copied from which most characters of their repeats come.

    docs: (doc_id, text); gone: what line_dedup says of documents. Compared is what would be left of the two: of the copy all
    but repeats from elsewhere, of the other all but its repeats. By the lengths of their lines, the repeats must be HALF
    of what both have together or more; of those pairs alone texts are read, and the similarity of their sets of
    shingles decides. So near-duplicate detection with that similarity finds the pair after line dedup.
    """
    repeated = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)
    left = gone.select("doc_id", (F.col("n_chars") - repeated).alias("left"))
    each = gone.select("doc_id", F.inline(F.arrays_zip("sources", "sizes"))).where("sources <> doc_id").groupBy("doc_id", "sources").agg(F.sum("sizes").alias("n"))
    most = each.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("sources")).alias("before"))).alias("most"))
    own = most.select("doc_id", (-F.col("most.before")).alias("copied"), F.col("most.n").alias("n")).join(left, "doc_id")
    theirs = left.select(F.col("doc_id").alias("copied"), F.col("left").alias("theirs"))
    pairs = own.join(theirs, "copied").where(F.col("n") >= HALF * (F.col("left") + F.col("theirs")))
    pairs = materialise(pairs.select("doc_id", "copied"))

    copy = _on_ids(docs, gone.select("doc_id", "dropped", "sources").join(pairs, "doc_id"))
    elsewhere = F.filter(F.arrays_zip("dropped", "sources"), lambda x: x["sources"] != F.col("copied"))
    a = copy.select("doc_id", "copied", _shingles(_without(F.col("text"), F.transform(elsewhere, lambda x: x["dropped"])), shingle).alias("a"))
    first = pairs.select(F.col("copied").alias("doc_id")).distinct().join(gone.select("doc_id", "dropped"), "doc_id", "left")
    own = F.coalesce("dropped", F.array().cast("array<int>"))
    b = _on_ids(docs, first).select(F.col("doc_id").alias("copied"), _shingles(_without(F.col("text"), own), shingle).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    like = (both > 0) & (both >= similarity * (F.size("a") + F.size("b") - both))
    return a.join(b, "copied").where(like).select("doc_id", "copied").distinct()


def _on_ids(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs joined with rows by doc_id; rows, with arrays of line numbers, are broadcast only if they are few and short.

    Else only the texts of documents in rows are shuffled, and a few more.
    """
    rows = materialise(rows)
    few = rows.agg(F.count("*").alias("n"), F.sum(F.size("dropped")).alias("lines")).first()
    if few["n"] <= FEW and (few["lines"] or 0) <= NUMBERS:
        return docs.join(F.broadcast(rows), "doc_id")
    return docs.where(_may_be_one_of(rows.select("doc_id"), few["n"])(F.col("doc_id"))).join(rows, "doc_id")


def drop_lines(docs: DataFrame, found: DataFrame, whole: float | None = None, shingle: int = 5) -> DataFrame:
    """docs, all columns, with the lines that line_dedup dropped taken out of text; n_chars, if there, counted anew.

    Rows of documents without dropped lines, null texts and null ids stay as they are; columns may have any names.
    With `whole`, a document that is mostly a copy of another (copies_of, this similarity) keeps the lines that it
    has from there: it would be a scrap that near-duplicate detection cannot recognise. A document that loses all
    its lines stays as an empty one.
    """
    names = docs.columns
    if whole is not None:
        found = materialise(found)
    gone = materialise(found.where("n_dropped > 0").select("doc_id", "dropped", "sources"))
    if whole is not None:
        copies = materialise(copies_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), found, whole, shingle))
        gone = by_size(gone, copies, "doc_id", "left")
        left = F.transform(F.filter(F.arrays_zip("dropped", "sources"), lambda x: x["sources"] != F.col("copied")), lambda x: x["dropped"])
        gone = materialise(gone.select("doc_id", F.when(F.col("copied").isNull(), F.col("dropped")).otherwise(left).alias("dropped")))
    gone = gone.where(F.size("dropped") > 0).select(F.struct("doc_id", "dropped").alias("gone"))
    held = docs.select(F.struct(*docs.columns).alias("row"))
    on = F.col("row.doc_id") == F.col("gone.doc_id")
    few = gone.agg(F.count("*").alias("n"), F.sum(F.size("gone.dropped")).alias("lines")).first()
    if few["n"] <= FEW and (few["lines"] or 0) <= NUMBERS:  # 8 MB of numbers
        joined = held.join(F.broadcast(gone), on, "left")
    else:  # documents that lose nothing are not shuffled, but for a few
        may = _may_be_one_of(gone.select("gone.doc_id"), few["n"])(F.col("row.doc_id").cast("long"))
        none = F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")
        joined = held.where(~may).select("row", none).unionByName(held.where(may).join(gone, on, "left"))
    text, changed = F.col("row.text"), F.col("gone").isNotNull()
    new = F.when(changed, _without(text, F.col("gone.dropped"))).otherwise(text)
    cols = {c: F.col("row")[c] for c in names} | {"text": new}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(changed, F.char_length(new).cast(kind)).otherwise(F.col("row.n_chars"))
    return joined.select(*[cols[c].alias(c) for c in names])
