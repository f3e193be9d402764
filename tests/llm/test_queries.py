"""The registered queries over whole tables: against SQL where there is some, else against brute force; and the pipeline."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import told
from test_edges import WORDS, brute_em, brute_join, crc, edited, ids_of, normal
from tokenizers import Tokenizer

import corpus_pipeline
from gleanwise.llm import bpe, catalogue, ngram_join, quality
from gleanwise.llm.common import tokenizer_path


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, folder, duck, name):
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = duck.sql(catalogue.SQL[name])
    assert sorted(found.columns) == columns
    rows = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert told(df.collect(), columns) == told(rows, columns)


def test_near_copies_by_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in ngram_join.query(spark, folder).collect())
    assert got == brute_join(rows)


@pytest.fixture(scope="module")
def encoded(spark, folder):
    """(doc_id, ids) of every document, by the library."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return tokenizer, [(r["doc_id"], ids_of(tokenizer, r["text"])) for r in rows]


def test_bpe_by_the_library(spark, folder, encoded):
    tokenizer, docs = encoded
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))) for i, ids in docs]
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r[n] for n in names) for r in catalogue.QUERIES["op4_bpe_tree"](spark, folder).collect()) == sorted(want)


def test_bpe_tree_on_the_table(encoded, spark, folder):
    """Every text over the leaf's length is halved and joined."""
    own = bpe.TreeEncoder(tokenizer_path())
    want = dict(encoded[1])
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r["text"] or "") > bpe.HALF_CHARS]
    for i, text in texts:
        before = own.joins
        assert np.frombuffer(own.text_ids(text), "<u4").tolist() == want[i] and own.joins > before
    assert len(texts) > 20 and own.joins > len(texts)


def test_packing_by_the_library(spark, folder, encoded):
    ids = {i: [*x, 2] for i, x in encoded[1]}
    rows = catalogue.QUERIES["op6_packing"](spark, folder).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    gapless = lambda parts: all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert set(pieces) == set(ids) and all(gapless(p) and sum(n for _, n in p) == len(ids[i]) for i, p in pieces.items())
    assert sorted(sequences) == list(range(len(sequences))) and all(gapless(p) and sum(n for _, n in p) <= 4096 for p in sequences.values())
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_binary_ids_by_the_library(spark, folder, encoded):
    want, start = [], 0
    for i, ids in sorted(encoded[1]):
        want.append((i, start, len(ids) + 1, crc([*ids, 1])))
        start += len(ids) + 1
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r[n] for n in names) for r in catalogue.QUERIES["op8_binary_ids"](spark, folder).collect()) == want


def test_edit_counts_by_the_library(spark, folder, encoded):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    before = {i: len(ids) for i, ids in encoded[1]}
    got = catalogue.QUERIES["op7_edit_counts"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n = len(docs[r["doc_id"]])
        text = edited(docs[r["doc_id"]], ((n // 3, n // 3 + 40, ""), (n // 2, n // 2, f" Revised in document {r['doc_id']}. "), (2 * (n // 3), 2 * (n // 3) + 1, "x")))
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (before[r["doc_id"]], len(ids_of(encoded[0], text)), len(text))


def test_sharding_by_its_law(spark, folder):
    docs = sorted((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = catalogue.QUERIES["op3_kd_sharding"](spark, folder).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == docs and {r["law"] for r in got} == {"bytes"}
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Documents are few here: a shard's size may miss the mean by the largest one.
    largest, mean = max(s for _, s, _ in docs), sum(sizes.values()) / 40
    assert all(abs(s - mean) <= 2 * largest for s in sizes.values())


def told_good(rows):
    """doc_id of the documents that the quality rules keep, by plain Python over all rows."""
    measures = [measured_plainly(t) for _, t in rows]
    votes = [[2 if eval(bad, {}, m) else 1 if eval(good, {}, m) else 0 for bad, good in PLAIN_RULES] for m in measures]
    posterior = brute_em(votes, quality.ROUNDS)
    failed = [m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for m in measures]
    return [(i, m, f, not f and p >= 0.5) for (i, _), m, f, p in zip(rows, measures, failed, posterior, strict=True)]


#: The rules' SQL as Python.
PLAIN_RULES = [(a.replace(" OR ", " or ").replace(" AND ", " and ").replace("least(", "min("), b.replace(" AND ", " and ").replace("least(", "min(")) for a, b in quality.RULES.values()]


def measured_plainly(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    kind = unicodedata.category
    plain = lambda x: x and all(kind(c)[0] in "LM" for c in x)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in range(3)}),
        "n_lines": len(lines),
        "n_bullets": sum(x.lstrip(" \t\n\v\f\r")[0] in "-*|>\u2022" for x in lines),
        "n_capitals": sum(kind(c) == "Lu" for c in t),
        "n_distinct": len(set(w)),
        "n_stop_words": len(set(w) & set(quality.STOP_WORDS)),
        "n_others": sum(kind(c)[0] not in "LM" for x in w for c in x),
        "n_digits": sum(kind(c) == "Nd" for c in t),
        "n_plain_words": sum(bool(plain(x) or x[-1] in ".,;:!?" and plain(x[:-1])) for x in w),
        "n_sentences": sum(x[-1] in ".!?\u3002" for x in w),
    }


def test_quality_by_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((r["doc_id"], *(r[n] for n in names), r["base_failed"], r["kept"]) for r in quality.query(spark, folder).collect())
    assert got == sorted((i, *(m[n] for n in names), f, k) for i, m, f, k in told_good(rows))


def test_pipeline_by_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    good = {i for i, _, _, kept in told_good(sorted(docs.items())) if kept}
    first: dict[str, int] = {}
    for i in sorted(good):
        first.setdefault(normal(docs[i]), i)
    rows = [(i, docs[i]) for i in sorted(first.values())]
    import ast

    left = sorted(i for i, c, _ in map(ast.literal_eval, brute_join(rows)) if i == c)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r["doc_id"] for r in got}) == left
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    sequences, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        ids = [*ids_of(tokenizer, docs[r["doc_id"]]), 2]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
        pieces[r["doc_id"]].append(r["length"])
        sequences[r["sequence_id"]] += r["length"]
    assert all(sum(v) == len(ids_of(tokenizer, docs[i])) + 1 for i, v in pieces.items())
    assert max(sequences.values()) <= 4096 and sorted(sequences) == list(range(len(sequences)))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
