"""What line dedup puts on disk: two numbers a key, and texts only of documents that lose lines."""

from __future__ import annotations

import random

from pitpanel.llm import lines, store


def shuffled(spark, make):
    """What make gives, and the bytes that were shuffled for it, a number for each stage."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    out = make()
    return out, [v for k, v in stages().items() if k not in before]


def rows(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def text(rng, n, size=60):
    return "\n".join("".join(rng.choice("abcdefghij ") for _ in range(size)) for _ in range(n))


def test_a_key_is_two_numbers(spark):
    """20,000 lines, of which none meet: only keys are shuffled, and no task holds more than its share of them."""
    rng = random.Random(1)
    df = store.materialise(rows(spark, [(d, text(rng, 20)) for d in range(1000)]))
    found, sent = shuffled(spark, lambda: lines.line_dedup(df).agg({"n_dropped": "sum"}).first()[0])
    assert found == 0
    assert max(sent) < 20_000 * 12 * 18


def test_partitions_follow_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS", 100)
    seen = []
    monkeypatch.setattr(lines, "materialise", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or store.materialise(df))
    lines.line_dedup(rows(spark, [(d, text(random.Random(d), 5)) for d in range(20)])).collect()
    assert any(", 12), REPARTITION_BY_NUM" in plan for plan in seen)


def test_large_tables_as_small_ones(spark, monkeypatch):
    """With nothing broadcast: the same rows, and texts of documents that lose nothing stay where they are."""
    rng = random.Random(2)
    docs = [(d, text(rng, 8)) for d in range(300)] + [(None, "x"), (400, None), (401, "")]
    one = docs[7][1].split("\n")
    docs += [(500, "\n".join(["new line of its own", *one[:4]])), (501, "\n".join([one[3][:-1] + "Q", "\n".join(one[4:7])])), (501, one[2])]
    df = store.materialise(rows(spark, docs))
    told = lambda found: sorted((str(x) for x in found.collect()))
    found = store.materialise(lines.line_dedup(df))
    assert {r.doc_id for r in found.where("n_dropped > 0").collect()} == {500, 501}
    few = told(found), told(lines.drop_lines(df, found)), told(lines.drop_lines(df, found, whole=0.8))
    monkeypatch.setattr(lines, "FEW", 0)
    monkeypatch.setattr(lines, "NUMBERS", 0)
    monkeypatch.setattr(store.by_size, "__defaults__", ("inner", 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = store.materialise(lines.line_dedup(df))
        assert told(again) == few[0]
        left, sent = shuffled(spark, lambda: told(lines.drop_lines(df, again)))
        assert left == few[1]
        assert told(lines.drop_lines(df, again, whole=0.8)) == few[2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sent) < 0.1 * sum(len(t or "") for _, t in docs)


def test_a_line_of_many_copies(spark, monkeypatch):
    """Copies of a very common line send no keys but the first's; what it is near to is found all the same."""
    rng = random.Random(3)
    common = "the same line at the top of every page"
    docs = [(d, f"{common}\n{text(rng, 1)}") for d in range(150)] + [(200, common + "s"), (201, "A" + common)]
    found = {r.doc_id: list(r.dropped) for r in lines.line_dedup(rows(spark, docs)).collect()}
    assert found == {d: [0] if d else [] for d, _ in docs}
