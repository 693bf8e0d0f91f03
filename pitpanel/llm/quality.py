"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Every rule is a ratio with a fixed ladder of cutoffs; a document fails a rule if its ratio is above the cutoff of
its stratum. A quarter of the labelled documents puts all rules' cutoffs of a stratum in one order, the ones that
reject the fewest good documents first; the others are the holdout. In that order the cutoffs are put in force one
after the other, and each time an exact binomial test asks whether all in force together falsely reject less than
the allowed risk of the holdout's good documents. The first that fails ends the sequence: tests in an order fixed
beforehand need no correction among themselves. The level is divided by the number of strata.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.store import by_size, materialise
from pitpanel.llm.words import U, chunks, mix, shingle_hashes, word_hashes, word_spans

#: rule -> (ratio of text counts, ladder of cutoffs)
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    "shouting": ("n_upper / word_chars", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeated_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.4)),
}
RISK, LEVEL = 0.04, 0.05
#: One in TUNING labelled documents orders the cutoffs; the others test them.
TUNING = 4
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def _repeat_words(buf, starts, ends, first) -> np.ndarray:
    """Words of each row in 3-word windows that are found twice or more in it."""
    count = np.diff(first)
    s, at = shingle_hashes(word_hashes(buf, starts, ends, lower=False), first, 3)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    key = mix(s + row.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    pos = (first[:-1][row] + np.arange(len(key)) - at[:-1][row])[twice & (count[row] >= 3)]
    covered = np.zeros(len(starts) + 2, dtype=bool)
    for i in range(3):
        covered[pos + i] = True
    return _per_row(covered[: len(starts)], first)


def _lines(text: str) -> tuple[int, int]:
    seen: set[str] = set()
    n = again = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            n += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return n, again


def _upper(text: str) -> int:
    return sum(map(str.isupper, text)) if not text.islower() else 0


def _counted(batch: pa.RecordBatch, names: list[str]):
    """The batch's columns but the last, which is the text, and its counts."""
    texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
    for lo, hi, buf, offs in chunks(texts):
        starts, ends, first = word_spans(buf, offs)
        lead = (buf & 0xC0) != 0x80
        blank = np.zeros(256, dtype=bool)
        blank[list(_BLANK.encode())] = True
        own = texts.slice(lo, hi - lo).to_pylist()
        lines = [_lines(x) for x in own]
        ascii_up = _per_row((buf >= 65) & (buf <= 90), offs).tolist()
        cols = [
            np.diff(first),
            _per_row(lead & ~blank[buf], offs),
            _per_row(_SYMBOL[buf], offs),
            [x[1] for x in lines],
            _repeat_words(buf, starts, ends, first),
            [u if x.isascii() else _upper(x) for x, u in zip(own, ascii_up, strict=True)],
            [x[0] for x in lines],
        ]
        keys = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in cols)], names=names)


def text_counts(docs: DataFrame, *, keys: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """keys (column -> type; doc_id long unless given) and COUNTS (long), a row for each row of docs, over whole texts.

    Words are runs of characters other than space and tab to carriage return. Null texts have none. Null keys and
    repeated rows are kept as they are; other columns are not looked at.
    """
    keys = keys or {"doc_id": "long"}
    names = [*keys, *COUNTS]

    def run(batches):
        for batch in batches:
            yield from _counted(batch, names)

    rows = docs.select(*[F.col(k).cast(t).alias(k) for k, t in keys.items()], F.col(text_col).alias("text"))
    kinds = [*keys.values(), *["long"] * len(COUNTS)]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, kinds, strict=True)))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), as a regularised incomplete beta function by continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 20_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    part = front * h / a
    return 1 - part if swap else part


def _ratios() -> list[F.Column]:
    return [
        F.struct(F.lit(name).alias("rule"), F.expr(f"try_divide({ratio.replace(' / ', ', ')})").alias("x"), F.array(*map(F.lit, ladder)).alias("cuts"))
        for name, (ratio, ladder) in RULES.items()
    ]


def cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, risk: float, level: float) -> DataFrame:
    """(stratum, rule, cutoff), a row for each rule that may be used in a stratum."""
    quality = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").alias("_q")).distinct()
    rows = counts.join(quality, "doc_id").where(~base_failed()).distinct()
    rows = rows.select("doc_id", stratum, F.col("_q").alias("q"), F.array(*_ratios()).alias("ratios"))
    tuning = F.crc32(F.col("doc_id").cast("string")) % TUNING == 0
    test = rows.where(~tuning & (F.col("q") == 1))

    grid = test.select(stratum).distinct().select(
        stratum, F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(c).alias("cutoff")) for name, (_, ladder) in RULES.items() for c in ladder]))
    )
    long = rows.where(tuning).select(stratum, "q", F.inline("ratios")).select(stratum, "q", "rule", "x", F.explode("cuts").alias("cutoff"))
    over = (F.col("x") > F.col("cutoff")).cast("int")
    seen = long.groupBy(stratum, "rule", "cutoff").agg(
        F.avg(F.when(F.col("q") == 1, over)).alias("good"), F.avg(F.when(F.col("q") == 0, over)).alias("bad")
    )
    # a stratum's cutoffs, 24 at most: the fewest good documents first, then the most bad ones, then the loosest
    order = [F.coalesce("good", F.lit(0.0)), -F.coalesce("bad", F.lit(0.0)), F.desc("cutoff"), F.col("rule")]
    path = grid.join(seen, [stratum, "rule", "cutoff"], "left")
    path = materialise(path.select(stratum, "rule", "cutoff", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).alias("step")))

    # the step at which a good document is rejected first, if at any
    steps = path.groupBy(stratum).agg(F.collect_list(F.struct("rule", "cutoff", "step")).alias("path"))
    tagged = by_size(test, steps, stratum)
    hit = F.flatten(F.transform("ratios", lambda r: F.transform(
        F.filter("path", lambda t: (t["rule"] == r["rule"]) & (r["x"] > t["cutoff"])), lambda t: t["step"])))
    found = tagged.select(stratum, F.array_min(hit).alias("step")).groupBy(stratum, "step").agg(F.count("*").alias("c"))
    sizes = found.groupBy(stratum).agg(F.sum("c").alias("n"))
    strata = sizes.agg(F.count("*").alias("strata"))
    grown = Window.partitionBy(stratum).orderBy("step")
    tests = path.join(found.where("step is not null"), [stratum, "step"], "left").join(sizes, stratum).crossJoin(F.broadcast(strata))
    tests = tests.withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(grown))

    def judged(frames):
        for df in frames:
            p = [binomial_tail(int(k), int(n), risk) for k, n in zip(df["k"], df["n"], strict=True)]
            df["ok"] = np.array(p, dtype=float) <= level / df["strata"].to_numpy()
            yield df[[stratum, "rule", "cutoff", "step", "ok"]]

    kept = tests.select(stratum, "rule", "cutoff", "step", "k", "n", "strata").mapInPandas(
        judged, f"`{stratum}` string, rule string, cutoff double, step int, ok boolean"
    )
    kept = kept.withColumn("ok", F.min("ok").over(grown)).where("ok")
    return kept.groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    stratum: str = "lang",
    risk: float = RISK,
    level: float = LEVEL,
) -> DataFrame:
    """(doc_id, COUNTS, base_failed boolean, kept boolean), a row for each row of docs (doc_id, text, stratum).

    kept is false where base_failed (under 50 words, or over half the words in repeated 3-word windows), or where
    a ratio of RULES is above its stratum's cutoff. With a chance of at least 1 - level, every stratum's rules
    together falsely reject at most `risk` of its good documents. labels: (doc_id, quality); 1 is good, 0 is bad and
    only looked at for the order of cutoffs, other values and nulls are not used, repeated ones count once. With no labels, or too few, no rule is used and only
    base_failed rejects; an empty table gives no rows. Null
    texts have no words and fail; a null stratum is one of its own. Rows with null ids are judged too.
    """
    docs = docs.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    stratum = "_stratum"  # its own name may be one of COUNTS
    counts = materialise(text_counts(docs, keys={"doc_id": "long", stratum: "string"}))
    cuts = materialise(cutoffs(counts, labels, stratum, risk, level))
    failed = F.lit(False)
    wide = cuts.groupBy(stratum).agg(
        *[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in RULES]
    )
    joined = counts.join(F.broadcast(wide) if wide.limit(10_001).count() <= 10_000 else wide, stratum, "left")
    for name, (ratio, _) in RULES.items():
        x = F.expr(f"try_divide({ratio.replace(' / ', ', ')})")
        failed = failed | F.coalesce(x > F.col(f"cut_{name}"), F.lit(False))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~failed).alias("kept"))

