"""Packing, ranked search and spelling variants against plain Python, on odd inputs and on the small tables."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF
from pitpanel.llm import packing, queries, search, variants

ODD = ["", None, " \n\t ", "one", "two words", "é ü 漢字 🎉", "a\\b </turn> x", "x" * 5000, "Σίσυφος ΣΑΣ İ", "tab\tand\x0bvt nbsp em"]
SCHEMA = "doc_id long, text string, lang string, score int, term string, ids string, key string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, docs):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", 1, "x", "y", "z") for d, t in docs], SCHEMA)


def sums_up(pieces, want, capacity):
    """Asserts that the pieces are these documents' ids, each once, and returns the padding."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            if "ids" in p.__fields__:
                assert p.ids == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["word", "über", "a<|endoftext|>b", "12", "\n\n", "it's"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    texts.append("long text \n" * 4000)
    library = Tokenizer.from_file(PATH)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    docs = frame(spark, list(enumerate(texts)))
    for capacity, most in ((2048, packing.PACK), (64, 500), (1, 100)):
        assert sums_up(packing.pack_documents(docs, PATH, capacity=capacity, most=most).collect(), want, capacity) == 0
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []
    again = packing.pack_documents(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), PATH, with_ids=False).collect()
    assert {(p.doc_id, p.doc_tokens) for p in again} == {(1, 3), (None, 1)}
    assert sum(p.length for p in again) == 7 and sum(p.start == 0 for p in again) == 3
    with pytest.raises(ValueError):
        packing.pack_documents(docs, PATH, capacity=100)


def test_packing_windows(monkeypatch):
    """Cuts of long texts change no ids."""
    monkeypatch.setattr(packing, "WINDOW", 7)
    rng, library = random.Random(4), Tokenizer.from_file(PATH)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "the", "'s", "'ll", "<|endoftext|>", "<|", "é", "漢", "12", ".", "🎉", "　", "​"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert packing.Coder.at(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pack_is_by_cost():
    """Descending documents to the cheapest sequence with room, whole where one has it."""
    got = packing.pack(np.array([5, 9, 4, 3, 3]), 8, 10)
    assert sorted(got) == [(0, 0, 5, 1, 0), (1, 0, 8, 0, 0), (1, 8, 1, 2, 7), (2, 0, 4, 2, 0), (3, 0, 3, 2, 4), (4, 0, 3, 1, 5)]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 3000, 500)
    pieces = packing.pack(sizes, 2048, 6144)
    cost = collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n * (6144 + n)
    length = collections.Counter()
    for _, _, n, s, _ in pieces:
        length[s] += n
    whole = [cost[s] for s in cost if length[s] == 2048]
    assert max(whole) < 1.4 * min(whole)
    assert len(pieces) <= len(sizes) + len(length)  # a cut for each sequence at most


def test_op11_on_the_small_tables(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    assert sums_up(queries.op11_pack(spark, SF).collect(), want, 2048) == 0


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(docs, items, top):
    """(item, rank, doc, score), every document scored."""
    bags = [(d, collections.Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for i, t in items:
        asked, scores = collections.Counter(TERM.findall((t or "").translate(LOW))), []
        for d, bag in bags:
            s = 0
            for w, k in asked.items():
                if bag[w]:
                    m = 25 + (75 * sum(bag.values()) * n_docs) // n_terms
                    s += k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * bag[w]) // (1000 * bag[w] + 8 * m))
            if s > 0:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def test_search(spark):
    rng = random.Random(8)
    text = lambda n, v: " ".join(f"w{min(rng.randrange(v), rng.randrange(v))}" for _ in range(n))
    docs = list(enumerate(ODD)) + [(100 + i, text(rng.randrange(1, 60), 80)) for i in range(150)]
    docs += [(300 + i, docs[20][1]) for i in range(12)] + [docs[30], docs[30], (400, text(20_000, 500))]
    items = [(i, text(rng.randrange(1, 25), 120)) for i in range(30)] + [(50, ""), (51, None), (52, docs[20][1]), (53, "never-seen"), (None, "W1 w1 漢字"), (54, "w3")]
    want = ranking(docs, items, 4)
    for block in (search.BLOCK, 300):  # one block, many blocks
        got = search.rank_documents(frame(spark, docs).repartition(5), frame(spark, [*items, items[0]]).withColumnRenamed("doc_id", "item_id"), top=4, block_bytes=block)
        assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=str) == want


def test_search_odd_tables(spark):
    items = frame(spark, [(1, "a b"), (1, "b c"), (2, "")]).withColumnRenamed("doc_id", "item_id")
    docs = frame(spark, [(5, "b"), (6, "c"), (7, "x"), (8, "x"), (None, "b b")])
    got = sorted((r.item_id, r["rank"], r.doc_id) for r in search.rank_documents(docs, items).collect())
    assert got == [(1, 1, 5), (1, 2, 6)]  # by the better of the item's texts, each document once
    assert search.rank_documents(frame(spark, []), items).collect() == []
    assert search.rank_documents(docs, items.limit(0)).collect() == []
    assert search.rank_documents(frame(spark, [(1, ""), (2, None)]), items).collect() == []


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouping(docs, every=31):
    total = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        close = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 10 * n else None, n, len(close)]
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, words[form] if form else None))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=str)


def test_variants(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abÀéz") for _ in range(rng.randrange(7, 12))) for _ in range(40)]
    def typo(w):
        p = rng.randrange(len(w) + 1)
        return rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abz") + w[p:], w[:p] + rng.choice("abz") + w[p + 1 :]])
    docs = list(enumerate(ODD))
    for i in range(100, 160):
        docs.append((i, " ".join(rng.choice(base) if rng.random() < 0.9 else typo(rng.choice(base)) for _ in range(150))))
    docs += [(200, "Strasse-Strasse " * 500 + "strassé strassé trasse strasse3strasse"), docs[20], docs[20]]
    chain = ("chained", "chainned", "chainnned")
    ids = [i for i in range(300, 400) if all(zlib.crc32(f"{i}:{w}".encode()) % 5 for w in chain)][:12]
    docs += [(d, "chained " * (i < 4) + "chainned " * 4 + "chainnned " * 60) for i, d in enumerate(ids)]  # a way of two steps
    want = grouping(docs, 5)
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] and r[1] != r[2] for r in want)
    for share, long in ((variants.SHARE, variants.LONG), (60, 10**6), (60, 2), (10**6, 0)):  # lists of all kinds and lengths
        assert rows_of(variants.group_variants(frame(spark, docs), every=5, share=share, long=long)) == want


def test_variants_of_the_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_spelling_variants(spark, SF)) == grouping(docs)


def test_variants_odd_tables(spark):
    assert variants.group_variants(frame(spark, [])).collect() == []
    assert variants.group_variants(frame(spark, [(1, None), (2, ""), (None, "abcdefg abcdefg")])).collect() == []
    with pytest.raises(ValueError):
        variants.group_variants(frame(spark, []), least=5)


def test_affected_grams_bound_an_edit():
    """A word within one edit keeps all grams but those that the bound allows, at the places they move to."""
    rng = random.Random(9)
    frequent = {"".join(rng.choice("ab") for _ in range(q)) for q in (2, 3, 4) for _ in range(12)}
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(7, 12)))
        p, c = rng.randrange(len(w) + 1), rng.choice("abc")
        x, shift = rng.choice([(w[:p] + c + w[p:], 1), (w[:p] + w[p + 1 :], -1), (w[:p] + c + w[p + 1 :], 0)])
        mine = {(g, q) for g, q, _ in variants.decompose(w, frequent)}
        theirs = {(g, q) for g, q, _ in variants.decompose(x, frequent)}
        kept = sum((g, q) in theirs or (g, q + shift) in theirs for g, q in mine)
        assert kept >= len(mine) - variants.affected(variants.decompose(w, frequent), len(w)) >= 1
