"""Personal data: base patterns with validators, and spans added by boosted trees over high-recall candidates.

Loose generators propose candidates of every kind, also inside runs that a base pattern took and rejected, and they
may overlap. Trees are boosted on format and context features; what says whether a fitted candidate is right is
withheld from them: a validator (checksum, octets, digits), and for secrets, which have none, the words that
introduce them. The threshold of each kind is the lowest that keeps the asked precision on candidates held out
from the fit, counted over all of them. An accepted candidate must still pass its kind's validator. Base spans
always stay.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.store import materialise

# fixed values: the base patterns, with loops that never step back where that changes no match
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: The loose generators: kind of span, pattern.
LOOSE = {
    "mail": ("email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[A-Z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Z0-9-]{2,63})+"),
    "octets": ("ip", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    "digits": ("card", r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])"),
    "call": ("phone", r"(?:\+|(?<![0-9])00)[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    "code": ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+"),
    "told": ("secret", r"(?i)(?<=(?:passwor[dt]|passwd|token|secret|api.?key|auth)[\x20\x22\x27]{0,2}[:=][\x20]{0,2}[\x22\x27]{0,1})[^\s\x22\x27=:]{8,128}"),
}
#: Share of digits that are none of the kind and pass its validator all the same.
CHANCE = {"card": 0.1, "ip": 0.005}
CONTEXT = 24
FIT_ROWS, TREES, DEPTH, STEP, PRECISION = 4_000, 10, 5, 0.3, 0.95
_TELLING = r"(?i)(?:passw|token|secret|api|key|auth|tel|phone|call|card|visa|mail|ip|host|addr)\w*\W*$"
_SECRET = r"(?i)(?:passw|token|secret|api.?key|auth)\w*[\x20\x22\x27]*[:=][\x20\x22\x27]*$"


EMPTY = "array<struct<start:int,end:int,match:string,before:string>>"


def with_spans(df: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column for each pattern (name -> pattern, what texts can have it): the leftmost non-overlapping matches.

    array<struct<start, end, match, before>> in code points; before: the characters ahead of it, CONTEXT at most.
    In steps, so that each pattern runs twice over a text: for what lies between matches, and for the matches.
    """
    cols = {}
    for name, (pattern, may) in patterns.items():
        cols[f"{name}_gaps"] = F.when(may, F.split("text", pattern, -1))
        cols[f"{name}_found"] = F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumns(cols)

    def step(acc, x):
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        before = F.right(x["gap"], F.lit(CONTEXT))
        item = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), before.alias("before"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    out = {}
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(EMPTY).alias("out"))
    for name in patterns:
        found = F.col(f"{name}_found")
        pair = lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
        pairs = F.zip_with(F.slice(f"{name}_gaps", 1, F.size(found)), found, pair)
        every = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
        out[name] = F.when(F.size(found) > 0, every).otherwise(F.array().cast(EMPTY))
    return df.withColumns(out).drop(*cols)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    size = F.char_length(_digits(x))
    if kind == "card":
        return size.between(14, 19) & _luhn(_digits(x))
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _patterns() -> dict[str, tuple[str, Column]]:
    text = F.col("text")
    return {
        "email": (EMAIL, text.contains("@")),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9][\x20-]?[0-9]")),
        "phone": (PHONE, text.contains("+")),
        "mail": (LOOSE["mail"][1], text.rlike(r"(?i)[(\[{\x20@](?:at|dot)?[)\]}\x20@]") & text.rlike("(?i)dot")),
        "octets": (LOOSE["octets"][1], text.rlike(r"[0-9]\.[0-9]")),
        "digits": (LOOSE["digits"][1], text.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}")),
        "call": (LOOSE["call"][1], text.rlike(r"\+|00[0-9]{2}")),
        "code": (LOOSE["code"][1], text.rlike("[A-Za-z0-9_/+-]{12}")),
        "told": (LOOSE["told"][1], text.rlike(r"[:=]") & text.rlike("(?i)passw|token|secret|key|auth")),
    }


def _features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context columns; none tells what _label looks at."""
    x, before = F.col("match"), F.col("before")
    size, secret = F.char_length(x), F.col("kind") == "secret"
    share = lambda others: F.char_length(F.regexp_replace(x, others, "")) / size
    cols = {
        "f_size": F.least(size, F.lit(64)),
        "f_digits": share("[^0-9]"),
        "f_upper": share("[^A-Z]"),
        "f_lower": share("[^a-z]"),
        "f_marks": share("[A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(F.split(F.left(x, F.lit(64)), ""))) / F.least(size, F.lit(64)),
        "f_hex": x.rlike("^[0-9a-f]+$"),
        "f_turns": F.least(F.char_length(F.regexp_replace(x, "[0-9]+|[^0-9]+", "x")), F.lit(32)),
        "f_words": x.rlike("[a-z]{4}"),
        "f_telling": ~secret & before.rlike(_TELLING),
        "f_quote": ~secret & before.rlike("[\"']$"),
        "f_glued": before.rlike("[A-Za-z0-9]$"),
        "f_line": before.rlike(r"(?:^|\n)\s*$"),
        **{f"f_{k}": F.col("kind") == k for k in ("email", "ip", "card", "phone")},
    }
    return df.withColumns({k: v.cast("double") for k, v in cols.items()}), list(cols)


def _label(df: DataFrame) -> Column:
    """Whether a candidate is right, by what the features leave out."""
    x = F.col("match")
    out = F.when(F.col("kind") == "secret", F.col("before").rlike(_SECRET))
    for k in ("ip", "card", "phone"):
        out = out.when(F.col("kind") == k, _valid(k, x))
    return out.otherwise(F.lit(True)).cast("double")


def find_pii(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
    precision: float = PRECISION,
) -> DataFrame:
    """(doc_id long, n_email, n_ip, n_card, n_phone longs, base_sha256 string, spans string), a row for each row of docs.

    Spans are kind:start:end, code points from 0, end exclusive, sorted by start, kind (KINDS, then secret), end and
    joined by commas. The counts and base_sha256 are of the base spans; spans also has the added ones, which overlap
    neither base spans nor each other: of two, the likelier stays, then the longer, then the earlier. The trees
    are fitted on at most fit_rows candidates, taken by hash; without candidates of both labels nothing is added.
    Null and empty texts have no spans. Null ids and repeated rows are kept as they are; an empty table gives no
    rows; other columns are not looked at.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    rows = with_spans(rows, _patterns()).drop("text")
    rows = materialise(rows)
    tagged = lambda kind, c, base: F.transform(
        c, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before"))
    )
    cand = F.concat(
        *[tagged(k, F.col(k), True) for k in ("ip", "card", "phone")],
        *[tagged(kind, F.col(name), False) for name, (kind, _) in LOOSE.items()],
    )
    cands = rows.where(F.size(cand) > 0).select("doc_id", "text_key", F.inline(cand))
    added = _added(cands, fit_rows, precision)
    order = {k: i for i, k in enumerate([*KINDS, "secret"])}
    span = lambda kind, x: F.struct(x["start"].alias("start"), F.lit(order[kind]).alias("o"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    passed = lambda kind: F.filter(kind, lambda x: _valid(kind, x["match"]))
    kept = {k: (lambda kind: F.transform(passed(kind), lambda x: span(kind, x)))(k) for k in KINDS}
    base = F.array_sort(F.concat(*kept.values()))
    text_of = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = rows.select("doc_id", "text_key", *[F.size(v).cast("long").alias(f"n_{k}") for k, v in kept.items()], base.alias("base"))
    kind_of = "array<struct<start:int,o:int,end:int,kind:string,p:double>>"
    if added is None:
        more = out.withColumn("more", F.array().cast(kind_of))
    else:
        o = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])[F.col("kind")]
        per = added.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", o.alias("o"), "end", "kind", "p")).alias("more"))
        per = per.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "t")
        more = out.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    rank = lambda s: F.struct(s["p"], s["end"] - s["start"], -s["start"], -s["o"])
    beside = F.filter(F.coalesce("more", F.array().cast(kind_of)), lambda s: ~F.exists("base", lambda b: meets(s, b)))
    more = more.withColumn("beside", F.when(F.size("more") > 0, beside).otherwise(F.array().cast(kind_of)))
    extra = F.filter("beside", lambda s: ~F.exists("beside", lambda b: meets(s, b) & (rank(b) > rank(s))))
    extra = F.transform(extra, lambda s: F.struct(s["start"].alias("start"), s["o"].alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    return more.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.array_sort(F.concat("base", extra))).alias("spans"),
    )


def _added(cands: DataFrame, fit_rows: int, precision: float) -> DataFrame | None:
    """The candidates beside the base ones that the trees accept; None if there is nothing to learn from."""
    rows, names = _features(cands)
    place = F.xxhash64("doc_id", "start", "kind", "text_key")
    rows = materialise(
        rows.withColumn("label", _label(rows)).withColumn("ok", _valid_by_kind()).withColumn("h", place)
        .select("doc_id", "text_key", "kind", "base", "start", "end", "label", "ok", "h", *names)
    )
    held = F.pmod("h", F.lit(5)) == 0
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    fit = rows.where(~held).orderBy("h", "doc_id", "start", "kind", "end", "base").limit(fit_rows)
    train = assembler.transform(materialise(fit.select("label", *names)))
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=1).fit(train)
    p = vector_to_array("probability")[1]
    steps = [0.3 + 0.05 * i for i in range(14)]
    scored = model.transform(assembler.transform(rows.where(held))).select("kind", "label", p.alias("p"))
    rates = scored.groupBy("kind").agg(*[F.avg(F.when(F.col("p") >= s, F.col("label"))).alias(f"s{i}") for i, s in enumerate(steps)])

    def kept(kind: str, right: float | None) -> float:
        """Precision of what passes the validator too, if a share `right` of all does, and CHANCE of those that are wrong."""
        chance = CHANCE.get(kind, 0.0)
        true = max(0.0, ((right or 0.0) - chance) / (1 - chance))
        return true / right if right else 0.0

    cuts: dict[str, float] = {}
    for r in rates.collect():
        for i, s in reversed(list(enumerate(steps))):
            right = kept(r["kind"], r[f"s{i}"]) if r["kind"] in CHANCE else r[f"s{i}"] or 0.0
            if right >= precision:
                cuts[r["kind"]] = s
    cut = F.create_map(*[x for k in [*KINDS, "secret"] for x in (F.lit(k), F.lit(cuts.get(k, 2.0)))])
    if "email" not in cuts:  # no held-out candidate: the middle
        cut = F.map_concat(F.map_filter(cut, lambda k, _: k != "email"), F.create_map(F.lit("email"), F.lit(0.5)))
    out = model.transform(assembler.transform(rows.where(~F.col("base") & F.col("ok")))).withColumn("p", p)
    return out.where(F.col("p") >= cut[F.col("kind")]).select("doc_id", "text_key", "kind", "start", "end", "p")


def _valid_by_kind() -> Column:
    out = F.when(F.col("kind") == "secret", F.lit(True))
    for k in ("ip", "card", "phone"):
        out = out.when(F.col("kind") == k, F.coalesce(_valid(k, F.col("match")), F.lit(False)))
    return out.otherwise(F.lit(True))
