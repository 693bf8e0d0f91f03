"""Near-duplicate documents by SetSketch registers: banded, estimated jointly by likelihood, confirmed on full sets.

Documents with equal shingle sets become one class first. Classes that share a band meet in that band's bucket,
where the pairs whose registers make a similarity near the threshold likely span trees of likely links; a bucket of
over BLOCK members is dealt out as pairs of blocks. These links are confirmed on full shingle sets: the members that
hang on one hub pass by its set in a stream. A bucket all of whose links are confirmed has nothing more to say. In
the others, the likely pairs that confirmed links do not connect yet are compared too, each in the first band that
it shares. Only links leave a task, as many as members at most, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm import sketch
from pitpanel.llm.store import by_size, connected_components, materialise
from pitpanel.llm.words import chunks, shingle_hashes, word_hashes, word_spans

BLOCK, STAR, REST = 2048, 512, 256  # members of a block of a bucket, of a hub, of a bucket with refuted links


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each of some rows)."""
    for lo, _, buf, offs in chunks(col):
        starts, ends, first = word_spans(buf, offs)
        s, at = shingle_hashes(word_hashes(buf, starts, ends), first, k)
        yield lo, [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _sketches(k: int) -> Callable:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, sets in _sets(batch.column(1), k):
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                reg = sketch.registers(np.concatenate(sets), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in reg], pa.binary()),
                        pa.array(list(sketch.bands(reg)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "reg", "bands"],
                )

    return run


def _tree(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(member, the member that reached it) of trees that span a symmetric boolean matrix."""
    left = linked.any(1)
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        left[i] = False
        front = [int(i)]
        for at in front:
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            front += new.tolist()
            for j in new:
                yield int(j), at


def _likely_pairs(n: np.ndarray, reg: np.ndarray, least_same: int, least_j: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i < j) of the pairs that may reach the threshold."""
    g = len(n)
    step = max(1, (1 << 23) // (g * sketch.M))
    for a in range(0, g, step):
        same = (reg[a : a + step, None, :] == reg[None, :, :]).sum(2, dtype=np.int16)
        i, j = np.nonzero(same >= least_same)
        i += a
        i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 1 << 14):
            x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
            more, less = (reg[x] > reg[y]).sum(1), (reg[x] < reg[y]).sum(1)
            ok = sketch.likely_jaccard(more, less, n[x], n[y]) >= least_j
            yield x[ok], y[ok]


def _likely(ids, n, reg, least_same: int, least_j: float) -> Iterator[tuple[int, int]]:
    """Spanning links of the pairs within one bucket that may reach the threshold."""
    linked = np.zeros((len(ids), len(ids)), dtype=bool)
    for x, y in _likely_pairs(n, reg, least_same, least_j):
        linked[x, y] = linked[y, x] = True
    for j, i in _tree(linked):
        yield int(ids[j]), int(ids[i])


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with the same keys, of a partition that is sorted by them."""
    rest = None
    for df in frames:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        cut = np.flatnonzero((df[keys].to_numpy()[1:] != df[keys].to_numpy()[:-1]).any(1)) + 1
        edge = [0, *cut, len(df)]
        for a, b in zip(edge[:-2], edge[1:-1], strict=True):
            yield df.iloc[a:b]
        rest = df.iloc[edge[-2] :]
    if rest is not None and len(rest):
        yield rest


def _bucket_links(least_same: int, least_j: float) -> Callable:
    """(a, b, bucket) of the likely links that span each group."""

    def run(frames):
        out: list[tuple[int, int, int]] = []
        pairs: list[pd.DataFrame] = []

        def two():
            if not pairs:
                return
            p = pd.concat(pairs)
            pairs.clear()
            ids, n, bucket = p["id"].to_numpy().reshape(-1, 2), p["n"].to_numpy().reshape(-1, 2), p["bucket"].to_numpy()[::2]
            reg = np.frombuffer(b"".join(p["reg"]), dtype=np.uint8).reshape(-1, 2, sketch.M)
            more, less = (reg[:, 0] > reg[:, 1]).sum(1), (reg[:, 0] < reg[:, 1]).sum(1)
            ok = (sketch.M - more - less >= least_same) & (
                sketch.likely_jaccard(more, less, n[:, 0], n[:, 1]) >= least_j
            )
            out.extend(zip(ids[ok, 1].tolist(), ids[ok, 0].tolist(), bucket[ok].tolist(), strict=True))

        for g in _groups(frames, ["bucket", "bi", "bj"]):
            if len(g) == 2:
                pairs.append(g)
                if len(pairs) >= 4096:
                    two()
            elif len(g) > 2:
                reg = np.frombuffer(b"".join(g["reg"]), dtype=np.uint8).reshape(-1, sketch.M)
                bucket = int(g["bucket"].iloc[0])
                links = _likely(g["id"].to_numpy(), g["n"].to_numpy(), reg, least_same, least_j)
                out.extend((a, b, bucket) for a, b in links)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["a", "b", "bucket"])
                out = []
        two()
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "bucket"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are not empty and similar enough."""
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(k: int, percent: int) -> Callable:
    """(a, b, ok) of the members that hang on a hub: rows sorted by (hub, part), the hub's own row first."""

    def run(batches):
        at, own = None, None
        for batch in batches:
            hub, part, member, ids = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple[int, int, bool]] = []
            for lo, sets in _sets(batch.column(4), k):
                for i, s in enumerate(sets, lo):
                    if not member[i]:
                        at, own = (hub[i], part[i]), s
                    elif at == (hub[i], part[i]):
                        out.append((ids[i], hub[i], _similar(own, s, percent)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "ok"])

    return run


def _rest(k: int, percent: int, least_same: int, least_j: float) -> Callable:
    """(a, b) links of the likely pairs of a group that have different roots and share no earlier band."""

    def links(g: pd.DataFrame) -> Iterator[tuple[int, int]]:
        ids, band, reg = g["id"].to_numpy(), int(g["band"].iloc[0]), np.frombuffer(b"".join(g["reg"]), dtype=np.uint8).reshape(-1, sketch.M)
        low: dict[int, int] = {}
        roots = g["root"].tolist()

        def find(r: int) -> int:
            while low.get(r, r) != r:
                r = low[r]
            return r

        held: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in held:
                held[i] = np.concatenate([s for _, some in _sets(pa.array([g["text"].iloc[i]], pa.large_string()), k) for s in some])
            return held[i]

        block = g["own"].to_numpy()
        inside = g["bi"].iloc[0] == g["bj"].iloc[0]
        cut = reg.reshape(len(reg), sketch.BANDS, sketch.ROWS)
        for x, y in _likely_pairs(g["n"].to_numpy(), reg, least_same, least_j):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                a, b = find(roots[i]), find(roots[j])
                if a == b or not (inside or block[i] != block[j]) or (cut[i, :band] == cut[j, :band]).all(1).any():
                    continue
                if _similar(full(i), full(j), percent):
                    low[max(a, b)] = min(a, b)
                    yield int(ids[j]), int(ids[i])

    def run(frames):
        for g in _groups(frames, ["bucket", "bi", "bj"]):
            if len(g) > 1 and (found := list(links(g))):
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """rows with (bucket, id) -> with block numbers bi <= bj; a bucket of n blocks has each row n times."""
    nb = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    out = rows.join(sizes, "bucket").withColumn("nb", nb).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("nb", "other", "size")


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "id")


def _told(links: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, ok): whether the sets of a and of its hub b are similar enough. Hubs with many members are dealt to parts."""
    sizes = links.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    star = materialise(links.join(sizes, "b").select(F.col("b").alias("hub"), part.alias("part"), F.lit(True).alias("member"), F.col("a").alias("id")))
    hubs = star.select("hub", "part", F.lit(False).alias("member"), F.col("hub").alias("id")).distinct()
    rows = by_size(texts, materialise(star.unionByName(hubs)), "id").select("hub", "part", "member", "id", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member", "id")
    return rows.mapInArrow(_confirmed(k, percent), "a long, b long, ok boolean").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    percent: int = 85,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long, kept boolean), one row for each row of docs with an id.

    A document's set: its distinct `shingle`-word shingles, A-Z lower-cased; with fewer words, all of them as one.
    Documents are linked if 100 * |intersection| >= percent * |union|; component_id is the smallest id reachable.
    Null, empty and blank texts have the empty set and are linked with nothing. Rows with a null id are not
    documents and are left out; repeated ids are one document each time, with equal results if their texts agree.
    Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null"
    )
    schema = "doc_id long, n_shingles long, set_key binary, reg binary, bands array<long>"
    sketched = materialise(docs.mapInArrow(_sketches(shingle), schema))
    full = sketched.where("n_shingles > 0")
    classes = full.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("reg").alias("reg")
    )
    classes = materialise(classes)
    banded = full.join(
        classes.select(F.col("set_key").alias("k"), "id"), (F.col("set_key") == F.col("k")) & (F.col("doc_id") == F.col("id"))
    ).select("id", F.explode("bands").alias("bucket"))
    sizes = banded.distinct().groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(_in_blocks(banded.distinct(), sizes, block))
    met = met.join(classes.select("id", "n", "reg"), "id")
    least_same, least_j = sketch.floor_at(percent / 100)
    links = _by_block(met.drop("own")).mapInPandas(_bucket_links(least_same, least_j), "a long, b long, bucket long")
    links = materialise(links)
    texts = docs.withColumnRenamed("doc_id", "id")
    told = materialise(_told(links.select("a", "b").distinct(), texts, shingle, percent))
    sure = told.where("ok").select("a", "b")
    refuted = links.join(told.where("not ok"), ["a", "b"], "left_semi").select("bucket")
    refuted = materialise(sizes.where("size > 2").join(refuted.distinct(), "bucket", "left_semi"))
    linked = connected_components(sure)
    if refuted.limit(1).count():
        linked = materialise(linked)
        again = materialise(_in_blocks(banded.distinct().join(refuted, "bucket", "left_semi"), refuted, REST))
        again = again.join(classes.select("id", "n", "reg"), "id").join(linked, "id", "left")
        # the band's number stands before its register values
        band = F.shiftright("bucket", 8 * sketch.ROWS).cast("int")
        again = again.withColumns({"root": F.coalesce("root", "id"), "band": band})
        again = texts.join(again, "id")
        more = _by_block(again).mapInPandas(_rest(shingle, percent, least_same, least_j), "a long, b long")
        linked = connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    of_class = classes.join(linked, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("root", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )
