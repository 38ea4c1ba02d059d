import random
import re
from collections import Counter

import numpy as np

from cubeloom.llm.components import components
from cubeloom.llm.minhash import keep_one, near_duplicates, round_salts, shingle_set, sketch

from .shared import no_documents, odd_documents


def sets_of(docs, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute(docs, n=4):
    sets = sets_of(docs, n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"new{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_groups_at_the_edge_of_the_threshold(spark):
    """Copies so different that many pairs of a group don't link, whoever is the pivot."""
    rng = random.Random(11)
    docs, i = [], 0
    for group in range(4):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([60, 120, 200]))]
        for _ in range(90 if group == 0 else 25):
            docs.append((i, mutated(rng, base, rng.randint(0, max(1, len(base) // 25)))))
            i += 1
    docs += [(i + k, " ".join(f"x{rng.randint(0, 50)}" for _ in range(rng.randint(0, 6)))) for k in range(60)]
    docs += [(i + 60, None), (i + 61, ""), (i + 62, "One two"), (i + 63, "one TWO"), (i + 64, "one two three")]
    rng.shuffle(docs)
    want = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"pivots": 1, "block": 16}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, words=4, **options).collect()}
        assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 50, 3000):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        s = sketch(np.unique(a), 160, round_salts(160))
        assert len(s) == 160 and (s == sketch(np.unique(a), 160, round_salts(160))).all()
    common, errors = rng.integers(0, 2**63, 400, dtype=np.uint64), []
    for _ in range(30):
        a = np.unique(np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)]))
        errors.append((sketch(a, 160, round_salts(160)) == sketch(b, 160, round_salts(160))).mean() - 400 / 500)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_shingles():
    assert len(shingle_set(b"a b c d e", 4)) == 2
    assert (shingle_set(b"A b  c\nD", 4) == shingle_set(b"a b c d", 4)).all()
    assert len(shingle_set(b"a b", 4)) == 1 and len(shingle_set(b" \t", 4)) == 0
    assert shingle_set(b"a b", 4)[0] != shingle_set(b"b a", 4)[0]


def test_odd_rows(spark):
    rows = near_duplicates(odd_documents(spark)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 10
    assert by_id[5].kept and not by_id[6].kept and by_id[6].component_id == 5
    assert by_id[2].n_shingles == 0 and by_id[2].component_id == 2 and by_id[3].kept and by_id[4].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_duplicates(no_documents(spark)).collect() == []


def test_keep_one_drops_repeated_rows(spark):
    docs = odd_documents(spark)
    ids = sorted((r.doc_id or 0) for r in keep_one(docs, near_duplicates(docs)).collect())
    assert ids == [0, 1, 2, 3, 4, 5, 7, 8]


def test_different_texts_of_one_id_are_judged_each(spark):
    rng = random.Random(5)
    a, b, c, d = ([f"{name}{rng.randint(0, 10**6)}" for _ in range(60)] for name in "abcd")
    docs = [(1, " ".join(a)), (5, mutated(rng, a, 1)), (5, " ".join(b)), (5, " ".join(c)), (5, mutated(rng, c, 1)), (5, " ".join(c)), (9, mutated(rng, b, 1)), (9, " ".join(d)), (9, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    result = near_duplicates(frame)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in result.collect())
    assert got == Counter([(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (5, 5, True), (5, 5, True), (9, 5, False), (9, 9, True), (9, 9, True)])
    stay = [(r.doc_id, r.text) for r in keep_one(frame, result).collect()]
    of_c = [row for row in stay if row in docs[3:5]]
    assert len(of_c) == 1 and Counter(stay) == Counter([docs[0], docs[2], docs[7], docs[8], *of_c])


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (150, 300)] + [(1000, 1001 + k) for k in range(200)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and {got[k] for k in (100, 150, 200, 300)} == {100} and got[1200] == 1000
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
