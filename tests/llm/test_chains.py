"""Packing by large items, the audit of filter chains and collocations: edge cases, brute force, whole tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_edges import SCHEMA, TEXTS, WORDS, crc, ids_of
from tokenizers import Tokenizer

from gleanwise.llm import catalogue, collocations, filter_audit, large_items
from gleanwise.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", "src" + str(k % 2), None if t is None else len(t), None, "s", "i", "l", k, 0.5, "r", "p") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def gapless(parts):
    parts = sorted(parts)
    return parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))


def least_sequences(lengths, capacity):
    """A bound from below: what the tokens fill, and what the best matching of large pieces leaves."""
    large, pairs = sorted(x for x in lengths if 3 * x > capacity), 0
    low, high = 0, len(large) - 1
    while low < high:  # the smallest with the largest that fits
        if large[low] + large[high] <= capacity:
            low, pairs = low + 1, pairs + 1
        high -= 1
    return max(-(-sum(lengths) // capacity), len(large) - pairs)


def test_large_items_plan():
    r = random.Random(11)
    for k in range(300):
        capacity = r.choice([1, 2, 3, 10, 31, 100, 2048])
        counts = {x: r.randint(1, r.choice([1, 3, 50])) for x in r.sample(range(1, capacity + 1), r.randint(0, min(capacity, 30)))}
        places, n = large_items.plan(counts, capacity)
        of, ranks = defaultdict(list), defaultdict(list)
        ends = {(length, rank): min((q for x, q, *_ in places if x == length and q > rank), default=counts[length]) for length, rank, *_ in places}
        for length, rank, each, first, offset in places:
            for x in range(rank, ends[length, rank]):
                of[first + (x - rank) // each].append((offset + (x - rank) % each * length, length))
                ranks[length].append(x)
        assert {x: sorted(v) for x, v in ranks.items()} == {x: list(range(c)) for x, c in counts.items()}
        assert sorted(of) == list(range(n)) and all(gapless(p) and sum(x for _, x in p) <= capacity for p in of.values())
        lengths = [x for x, c in counts.items() for _ in range(c)]
        assert sum(3 * x > capacity for p in of.values() for _, x in p) == sum(3 * x > capacity for x in lengths)
        if all(3 * x > capacity for x in lengths):
            assert n == least_sequences(lengths, capacity)
        else:
            assert n <= 1 + least_sequences(lengths, capacity) * 11 / 9


def test_large_items_edges(docs, tokenizer):
    got = large_items.packed(docs, tokenizer_path(), 100).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = [*ids_of(tokenizer, t), 0]
        want.update((i, len(ids[s : s + 100]), crc(ids[s : s + 100])) for s in range(0, len(ids), 100))
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want
    of = defaultdict(list)
    for r in got:
        assert r["start"] == 100 * r["piece"]
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(gapless(p) and sum(n for _, n in p) <= 100 for p in of.values())
    assert large_items.packed(docs.where("false"), tokenizer_path()).count() == 0


def test_large_items_keeps_columns(spark):
    pieces = spark.createDataFrame([(1, 0, "a", 5, 1.5), (2, 0, None, 9, None), (2, 0, "b", 11, 0.0), (None, None, "c", 0, 0.0), (3, 0, "d", None, 0.0)], "doc_id int, start int, offset string, length int, x double")
    rows = large_items.pack(pieces, 10).collect()
    assert len(rows) == 5 and rows[0].asDict().keys() == {"doc_id", "start", "length", "x", "sequence_id", "offset"}
    assert all((r["sequence_id"] is None) == (r["offset"] is None) == (r["length"] in (0, 11, None)) for r in rows)
    assert sorted((r["sequence_id"], r["offset"]) for r in rows if r["length"] in (5, 9)) == [(0, 0), (1, 0)]


def test_large_items_by_the_library(spark, folder, tokenizer):
    docs = {r["doc_id"]: [*ids_of(tokenizer, r["text"]), 0] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalogue.QUERIES["op11_large_items"](spark, folder).collect()
    pieces, of = defaultdict(list), defaultdict(list)
    for r in rows:
        own = docs[r["doc_id"]]
        assert r["start"] == 2048 * r["piece"] and r["length"] == min(2048, len(own) - r["start"]) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append(r["piece"])
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: list(range(-(-len(x) // 2048))) for i, x in docs.items()}
    assert all(gapless(p) and sum(n for _, n in p) <= 2048 for p in of.values())
    assert len(of) <= 1.005 * least_sequences([r["length"] for r in rows], 2048) + 1


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        own["E"] = i is not None and i > first[t]
        fails.append((i, lang or "", {k for k, v in own.items() if v}))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[1] == part]
            for k, f in enumerate(order):
                hit = [x for x in left if f in x[2]]
                gone = sum(x[1] == part and f in x[2] and bool(x[2] & set(order[:k])) for x in fails)
                alone = sum(x[1] == part and x[2] == {f} for x in fails)
                left = [x for x in left if f not in x[2]]
                out[part, "".join(order), k + 1] = [len(left), len(hit), gone, alone, sum(x[0] in good for x in hit), sum(x[0] in toxic for x in hit), f]
                shapley[part, f] += len(hit)
    return sorted((*k, *v[:6], shapley[k[0], v[6]]) for k, v in out.items())


AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_filter_audit_edges(spark, docs):
    docs = docs.unionByName(spark.createDataFrame([(20, "$ " * 300, "", *[None] * 10), (21, "$ " * 300, "de", *[None] * 10), (21, "$ " * 300, "de", *[None] * 10), (22, "A" * 1000, "de", *[None] * 10)], SCHEMA))
    told = [(1, 1, 0), (1, 0, 1), (2, None, None), (10, 1, None), (20, 1, 1), (21, 0, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame([(*x, "p", True) for x in told], "doc_id bigint, quality int, toxic int, part string, good boolean")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    got = filter_audit.audit(docs, labels).collect()
    assert sorted(tuple(r[c] for c in AUDIT) for r in got) == brute_audit(rows, told)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    bare = sorted(tuple(r[c] for c in AUDIT) for r in filter_audit.audit(docs, labels.where("false")).collect())
    assert bare == brute_audit(rows, [])


def test_filter_audit_other_filters(spark, docs):
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id int, quality int, toxic int"), {"X": "n_words = 0", "Y": "is_copy"}).collect()
    assert len(rows) == 2 * 4 and {r["filter_order"] for r in rows} == {"XY", "YX"}
    for r in rows:
        assert r["removed"] + r["kept"] <= len(TEXTS)


PIECE_END = re.compile(r"[.,;:!?\x0A-\x0D]")


def brute_collocations(docs, least, share, top):
    """docs: (text, lang)."""
    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in PIECE_END.split(low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))] if len(p) < 4 else []
            if any(100 * found[q] >= share * a for q in inside):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


COLLOCATIONS = "lang rank phrase a l r n score".split()


def test_collocations_edges(spark):
    r = random.Random(5)
    some = ["the", "New", "york", "Üben", "straße", "a\x1cb", "x y", "\x85", "c\xa0d", "'", "\U0001f600", "Z"]
    texts = [" ".join(r.choice(some) + r.choice(["", "", "", ".", ",", "\n", "\t", "\v", "\f"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    rows = [(t, r.choice(["en", "en", None, ""]), 1) for t in texts] + [(None, "en", 1), ("", "de", 1), (" \t.,;:!?\n", "fr", 1), ("one two " * 5000, "xx", 1), ("w" * 50_000, "xx", 1)]
    rows += [("same words here again. " * 3, "es", 1)] * 20
    docs = spark.createDataFrame(rows, "text string, lang string, phrase int")
    want = brute_collocations([x[:2] for x in rows], 4, 80, 50)
    got = collocations.collocations(docs, least=4, top=50)
    assert sorted(tuple(x[c] for c in COLLOCATIONS) for x in got.collect()) == want and len(want) > 100
    assert collocations.collocations(docs.where("false")).count() == 0


def test_collocations_rows_name_shards(spark, folder):
    """No row of Spark's holds a shard: its words and numbers are in a file that only its tasks read."""
    own = collocations.shards(spark.read.parquet(f"{folder}/documents.parquet"), most=2000)
    assert "binary" not in dict(own.dtypes).values()
    files = [r["file"] for r in collocations.written(own, "shards").collect()]
    assert len(set(files)) == len(files) > 10


def test_collocations_in_small_shards(spark, folder):
    """Many shards give what one gives; the filter of pairs may be almost full."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = collocations.shards(docs.repartition(7), most=2000)
    assert own.count() > 20
    known = collocations.frequent_pairs(own, 5, 1 << 16)
    parts = collocations.phrase_counts(own, known, 5)
    want = Counter()
    for text, lang in docs.select("text", "lang").collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in PIECE_END.split(low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                want.update((lang, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    assert {(r["lang"], r["phrase"]): r["f"] for r in parts.collect()} == {k: n for k, n in want.items() if n >= 5}


def test_automaton():
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 40, 300):
        ids = r.integers(0, 5, size).astype(np.int32)
        own = collocations.Automaton(ids, 4)
        pieces, ends = " ".join(map(str, ids)).split("0"), defaultdict(set)
        at = 0
        for p in pieces:
            w = p.split()
            for i in range(len(w)):
                for n in range(1, min(4, len(w) - i) + 1):
                    ends[tuple(map(int, w[i : i + n]))].add(at + i + n)
            at += len(w) + 1
        string = lambda d, x: tuple(ids[own.first[d][x] : own.first[d][x] + d].tolist())
        found = {string(d, x): (d, x) for d in range(1, 5) for x in range(1, len(own.count[d])) if own.count[d][x]}
        assert {s: own.count[d][x] for s, (d, x) in found.items()} == {s: len(e) for s, e in ends.items()}
        longer = own.states()
        for s, (d, x) in found.items():
            if d > 1:
                assert string(d - 1, own.prefix[d][x]) == s[:-1] and string(d - 1, own.link[d][x]) == s[1:]
            assert longer[d][x] == max(len(o) for o in ends if o[-d:] == s and ends[o] == ends[s]) - d
