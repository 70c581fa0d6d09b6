import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quantspark.llm.common import cut, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "mixing" or docs.columns == columns
        assert set(kept[name]) <= {r.doc_id for r in before.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept["quality"] for i in good) >= 0.9 * len(good) and sum(i in kept["quality"] for i in bad) <= 0.2 * len(bad)
    sets = {}
    for i, r in kept["near_duplicates"].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
    dropped = set(kept["quality"]) - set(kept["near_duplicates"])
    for i in dropped:
        w = re.findall(r"[^\x20\x09-\x0D]+", kept["quality"][i].text.lower())
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
        assert any(100 * len(s & t) >= 60 * len(s | t) for t in sets.values())
    assert not any(re.search("[0-9a-f]{24,}", r.text or "") for r in kept["secrets"].values())
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert all(1 <= r.copies <= 3 for r in kept["mixing"].values())


WORD = r"[^\x20\x09-\x0D]+"
SECRET = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}"),
)


def shingle_sets(text, k, word=WORD):
    w = re.findall(word, (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_stages_after_the_classifier_equal_brute_force(spark, docs_schema):
    """Nulls, empty and long texts, repeated rows and clashing columns included."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(n) for n in (3, 12, 40)]
    rows = [(i, text(rng.randint(5, 150))) for i in range(40)]
    for i in range(40, 60):  # near copies, some too far away
        w = list(rows[i % 10][1])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, w))
    rows += [(60 + k, text(30) + item + text(30)) for k, item in enumerate(items)]
    rows += [(70, text(30) + [w if i % 15 else "edit" for i, w in enumerate(items[2])]), (71, ["token", "=", "abcdef123456", "end"] + text(9)), (72, ["key", "0123456789abcdef" * 2] + text(9))]
    rows += [(73, text(60_000))]
    data = [(i, " ".join(w), "en", f"s{i % 4}", 0) for i, w in rows] + [(80, None, "en", "s0", None), (81, "", None, None, 0), (82, "  ", "en", "s1", 2)]
    data += data[3:5]
    clash = {c: F.lit("c") for c in ("rk", "found", "_c", "was", "_was", "_text", "_row", "of", "edge", "whole", "scale", "spans", "copies", "w", "b")}
    df = cut(spark.createDataFrame(data, docs_schema).withColumns(clash))
    bench = tempfile.mkdtemp()
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")

    sets = {i: frozenset(shingle_sets(t, 5)) for i, t, *_ in data}
    up = {i: i for i in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i for i in sets if root(i) == i}
    one = cut(cp.near_duplicates(spark, df, bench))
    assert one.columns == df.columns and sorted(r.doc_id for r in one.collect()) == sorted(want)

    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    holds = lambda t, q: len(q & shingle_sets(t, min(5, len(next(iter(q)))), alnum)) >= 0.8 * len(q)
    held = {r.doc_id for r in one.collect() for item in items if holds(r.text, shingle_sets(" ".join(item), min(5, len(item)), alnum))}
    two = cut(cp.decontamination(spark, one, bench))
    assert {60, 61, 62} & want <= held and sorted(r.doc_id for r in two.collect()) == sorted(want - held) and two.columns == df.columns

    before = {r.doc_id: r for r in two.collect()}
    three = cut(cp.secrets(spark, two, bench))
    after = {r.doc_id: r for r in three.collect()}
    assert set(after) == set(before) and three.columns == df.columns
    for i, r in after.items():
        secret = any(p.search(before[i].text or "") for p in SECRET)
        assert (r.text != before[i].text) == secret and (r.n_chars == (len(r.text) if secret else before[i].n_chars))

    size = lambda t: len(re.findall(WORD, t or ""))
    per = {}
    for r in after.values():
        per[r.source] = per.get(r.source, 0) + size(r.text)
    names = sorted(per, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(per.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * per[s]}
        for s in full or open_:
            target[s] = 3 * per[s] if full else level * weight[s]
        left -= sum(3 * per[s] for s in full)
        open_ -= full or open_
    mixed, largest = cp.mixing(spark, three, bench).collect(), {}
    for r in after.values():
        largest[r.source] = max(largest.get(r.source, 0), size(r.text))
    assert all(1 <= r.copies <= 3 for r in mixed)
    for s in names:
        taken = sum(size(r.text) * r.copies for r in mixed if r.source == s)
        assert abs(taken - target[s]) <= largest[s] / 2 + 1
    for stage in (cp.near_duplicates, cp.decontamination, cp.secrets, cp.mixing):
        assert stage(spark, df.limit(0), bench).count() == 0
