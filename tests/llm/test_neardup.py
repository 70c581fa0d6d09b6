import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm.common import ALNUM_WORDS, SPACE_WORDS, WordHasher, connected_components
from quantspark.llm.neardup import NearDupConfig, keep_one_of_each, near_duplicates, super_minhash, tile_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    ids = sorted(rows)
    sets, up = {i: shingle_set(rows[i], k) for i in ids}, {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(sets[i]) for i in ids}


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = {}
    for i in range(60):
        rows[i] = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
    base = [rng.choice(words) for _ in range(150)]
    for i in range(60, 260):  # a group of near copies, many of which are too far from one another
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows[i] = " ".join(w)
    rows |= {300: rows[0].upper(), 301: "  " + rows[1].replace(" ", "\n\t"), 302: "", 303: None, 304: " \n ", 305: "Solo", 306: "solo", 307: "x y", 308: "É é"}
    return rows


@pytest.mark.parametrize(("k", "few"), [(2, 32), (2, 4), (5, 32)])
def test_components_equal_brute_force(spark, k, few):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows.items()], SCHEMA)
    got = near_duplicates(df, NearDupConfig(words=k, few=few, tile=16)).collect()
    want, sizes = brute(rows, k)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "a b c d e f g", "x", "s", 1), (1, "a b c d e f g", "x", "s", 1), (2, "A B c d e f g", "x", "s", 1), (None, "q r s t u v", None, None, None), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)).withColumn("node", F.lit(2))
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert sorted(str(r.doc_id) for r in keep_one_of_each(df).collect()) == ["1", "3", "None"]
    assert keep_one_of_each(df).columns == df.columns
    assert near_duplicates(df.limit(0)).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    sig = super_minhash(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [1000, 1000, 1]), 3, 448, 1)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08
    assert sorted(np.floor(sig[2]).astype(int)) == list(range(448))  # one element deals every rank once


def test_tiles_count_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    ask = np.arange(40) < 20
    span = tile_links(sets, ask, 50, columns=16)
    linked = {(i, j) for i in range(20) for j in range(20, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert set(span) <= linked and bool(span) == bool(linked)


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


@pytest.mark.parametrize(("table", "pattern"), [(SPACE_WORDS, rb"[^\x20\x09-\x0D]+"), (ALNUM_WORDS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_word_hashes(table, pattern, monkeypatch):
    from quantspark.llm import common

    text = "The cat, the CAT\tzweiß\x0b über-über 42\n".encode() * 40
    whole = WordHasher(table)(np.frombuffer(text, dtype=np.uint8))
    monkeypatch.setattr(common, "SEGMENT", 64)
    parts = WordHasher(table)(np.frombuffer(text, dtype=np.uint8))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    words = re.findall(pattern, text.lower())
    assert len(words) == len(whole[2])
    by = {}
    for w, h in zip(words, whole[2].tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
