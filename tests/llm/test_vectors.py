import math
import random
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from cubeloom.llm import embedding_dedup, staging, topk
from cubeloom.llm.embedding_dedup import audit_recall, build_graph, near_duplicate_vectors, range_search, unit, with_reverse
from cubeloom.llm.topk import exact_products, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rep long, links long, score long, rank int"
CLASH = (1, 2, 3, 4, 5)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, least=0.98):
    usable = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and sound(v) and any(v)]
    links = {i: 0 for i, _, _ in rows if i is not None}
    parent = {i: i for i in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x, p) in enumerate(usable):
        for b, y, q in usable[k + 1 :]:
            if p == q and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (links[i], find(i)) for i in links}


def group(rng, centre, n, noise):
    return [(centre + noise * rng.normal(size=len(centre)) / math.sqrt(len(centre))).tolist() for _ in range(n)]


def vectors(seed, n_groups=8, size=40, singles=200, d=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(n_groups):
        for v in group(rng, unit(rng.normal(size=(1, d)))[0][0], size, 0.12 + 0.02 * g):
            rows.append((i, v, g % 3))
            i += 1
    for v in rng.normal(size=(singles, d)).tolist():
        rows.append((i, v, i % 3))
        i += 1
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [2048, 60])
def test_links_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(embedding_dedup, "PIECE_ROWS", piece)
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 70)
    rows = vectors(4)
    df = frame(spark, rows)
    result = near_duplicate_vectors(df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in result.collect()}
    want = brute_links(rows)
    true = sum(n for n, _ in want.values())
    assert true > 1000
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * true
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert audit_recall(df, result, every=3) >= 0.97


def test_audit_counts_lost_links_and_passes_over_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.02], 0), (4, [0.0, 1.0], 0), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (6, None, 0), (7, [1.0, 0.0], None), (8, [0.0, 0.0], 0)]
    df = frame(spark, rows)
    assert audit_recall(df, near_duplicate_vectors(df), every=1) == 1.0
    lossy = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0)], "vec_id long, n_links long")
    assert audit_recall(df, lossy, every=1) == 0.5
    assert audit_recall(df.limit(0), near_duplicate_vectors(df.limit(0)), every=1) == 1.0


def test_links_of_later_shards_count(monkeypatch):
    """A search that misses every pair in the first shard, and only there, loses no link."""
    x, _ = unit(np.array([[1.0, 0.001 * i] for i in range(12)]))
    pdf = pd.DataFrame({"piece": 0, "rep": range(12), "copies": 1, "x": list(x), "clusters": [[0, 1]] * 12, "near": [list(range(12))] * 12})
    search = embedding_dedup._searcher(0.98)
    later = search(("0", 1, 0, 0), pdf)
    monkeypatch.setattr(embedding_dedup, "range_search", lambda *a, **k: iter(()))
    first = search(("0", 0, 0, 0), pdf)
    assert (later["low"] == 0).all() and (first["low"] == 0).all()
    assert (first["links"] + later["links"] == 11).all()


@pytest.mark.parametrize("least", [0.98, 0.9])
def test_pairs_across_a_border_share_a_shard(least):
    """Two dimensions and many centroids: a pair at the threshold straddles a border."""
    angles = np.linspace(0, 2 * np.pi, 2000)
    x = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    centres = x[::250]
    shards = [set(s) for s in embedding_dedup.shards_of(x, centres, embedding_dedup.margin(least))]
    assert all(shards[a] & shards[b] for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True))


def test_batches_of_unlike_widths(spark, monkeypatch):
    """The longest vectors are few, beyond the fitting sample, and not in every batch."""
    monkeypatch.setattr(embedding_dedup, "FIT_ROWS", 2)
    rows = [(i, [1.0, 0.1 * i], 0) for i in range(60)] + [(60 + i, [1.0, 0.1 * i, 0.0, 0.01, 0.0][: 4 + i % 2], 0) for i in range(6)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_links([(i, v + [0.0] * (5 - len(v)), lab) for i, v, lab in rows])


def test_links_across_shards_pieces_parts_and_rounds_are_exact(spark, monkeypatch):
    for name, value in {"SHARD_ROWS": 30, "PIECE_ROWS": 20, "ASK_ROWS": 50, "COPIES_A_ROUND": 2.0}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = vectors(6, n_groups=6, size=30, singles=120, d=8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_of_a_linked_pair_one_visits_the_others_home():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(3000, 64)))[0]
    x = np.concatenate([x, unit(x + 0.19 * unit(rng.normal(size=x.shape))[0])[0]])
    centres = embedding_dedup.fit_centroids(x[:2000], 60)
    shards = embedding_dedup.shards_of(x, centres, embedding_dedup.margin(0.98))
    linked = [(a, a + 3000) for a in range(3000) if x[a] @ x[a + 3000] >= 0.98]
    assert len(linked) > 2000 and sum(shards[a][0] != shards[b][0] for a, b in linked) > 100
    assert all(shards[a][0] in shards[b] or shards[b][0] in shards[a] for a, b in linked)
    # By the angle to the nearest centroid alone a vector went to 14 shards.
    assert np.mean([len(s) for s in shards]) < 10


def test_disk_stays_near_the_input(spark, monkeypatch, tmp_path):
    """Vectors without a direction in common, many shards: what is on disk after each stage, its copies' shuffles among it."""
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 40)
    x = unit(np.random.default_rng(8).normal(size=(4000, 64)))[0].astype(np.float32)
    spark.createDataFrame(pd.DataFrame({"vec_id": range(4000), "embedding": x.tolist(), "label": 0}), "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/in")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = f"{staging.shared_dir(spark)}/{spark.sparkContext.applicationId}"

    def used():
        own = sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))
        files = blocks.getAllFiles()
        return own + sum(files.apply(k).length() for k in range(files.size()))

    stage, floor, seen = embedding_dedup.stage, used(), []

    def measured(df, name):
        out = stage(df, name)
        for _ in range(20):  # files go in the background
            seen.append(used() - floor)
            time.sleep(0.1)
        seen[-20:] = [min(seen[-20:])]
        return out

    monkeypatch.setattr(embedding_dedup, "stage", measured)
    assert near_duplicate_vectors(spark.read.parquet(f"{tmp_path}/in")).count() == 4000
    assert max(seen) < 4 * sum(f.stat().st_size for f in (tmp_path / "in").rglob("*.parquet"))


ODD = [
    (1, [1.0, 0.0], 1),
    (2, [2.0, 0.0], 1),
    (3, [2.0, 0.0], 1),
    (4, [2.0, 0.0], 2),
    (5, [2.0, 0.0], None),
    (6, None, 1),
    (7, [], 1),
    (8, [0.0, 0.0], 1),
    (9, [1.0, None], 1),
    (10, [float("nan"), 1.0], 1),
    (11, [float("inf"), 1.0], 1),
    (12, [1.0], 1),
    (13, [1.0, 0.0, 0.0], 1),
    (None, [1.0, 0.0], 1),
    (14, [3e38, 3e30], 1),
]


def test_odd_vectors(spark):
    got = {r.vec_id: r for r in near_duplicate_vectors(frame(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    want = {i: 0 for i in range(1, 15)} | {1: 5, 2: 5, 3: 5, 12: 5, 13: 5, 14: 5}
    assert {i: got[i].n_links for i in want} == want
    assert got[14].component_id == 1 and got[4].component_id == 4 and not got[2].kept
    assert got[None].component_id is None and got[None].kept
    assert near_duplicate_vectors(frame(spark, [])).collect() == []


def test_graph_search_reaches_a_cluster():
    rng = np.random.default_rng(0)
    x, _ = unit(np.concatenate([np.array(group(rng, unit(rng.normal(size=(1, 32)))[0][0], 80, 0.1)), rng.normal(size=(400, 32))]))
    lists = with_reverse(build_graph(x))
    found = dict(range_search(x, lists, x[:80], [np.array([450, k]) for k in range(80)], 0.97))
    want = x[:80] @ x.T >= 0.97
    assert sum(len(found[k]) for k in range(80)) == want.sum()


def brute_top(rows, k):
    q = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and sound(v)}
    width = max(map(len, q.values()))
    q = {i: np.pad(v, (0, width - len(v))) for i, v in q.items()}
    out = []
    for i in q:
        if i % 20 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_equals_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(9)
    rows = vectors(7)
    rows = [(i, (np.array(v) * np.exp(spread * rng.normal())).tolist(), lab) for i, v, lab in rows]
    rows += [(2000 + k, [0.25] * 24, 0) for k in range(60)]  # ties beyond k
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    df = frame(spark, rows)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 20 = 0"), k=20).collect())
    assert got == brute_top(rows, 20)


def test_top_k_of_odd_vectors(spark):
    rows = [(i, v, lab) for i, v, lab in ODD if i not in (14,)] + [(20, [1.0, -0.5], 1), (40, [0.0, 0.0], 1), (60, None, 1)]
    df = frame(spark, rows)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 20 = 0"), k=20).collect())
    assert got == brute_top(rows, 20)
    empty = frame(spark, [])
    assert top_k(empty, empty).collect() == []


@pytest.mark.parametrize("copies", [2, 30])
def test_top_k_of_a_repeated_query_row(spark, monkeypatch, copies):
    rng = np.random.default_rng(12)
    rows = [(i, v, 0) for i, v in enumerate(rng.normal(size=(300, 24)).tolist(), 1)]
    hot = (1000, (3 * rng.normal(size=24)).tolist(), 0)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 400)
    df = frame(spark, rows + [hot] * copies)
    got = sorted((r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 1000"), k=20).collect())
    want = [(n, j, s) for i, n, j, s in brute_top([*rows, hot], 20) if i == 1000]
    assert len(want) == 20
    assert got == sorted(want * copies)


@pytest.mark.parametrize("copies", [2, 30])
def test_own_rows_take_no_place_of_a_block(copies):
    p = np.array([[9.0, 0.0]] * copies + [[2.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    top = topk.TopK(np.array([7]), p[:1], np.array([-np.inf]), 2)
    top.visit(np.array([7] * copies + [1, 2, 3]), p, np.sqrt((p**2).sum(axis=1)))
    assert [b.tolist() for b in top.best[0]] == [[1, 2], [18, 9]]


def test_products_stay_exact():
    big = np.array([[2.0**40, 3.0]])
    assert exact_products(big, big)[0, 0] == 2**63 - 1
    mid = np.array([[2.0**30 + 1, 1.0]])
    assert exact_products(mid, mid)[0, 0] == (2**30 + 1) ** 2 + 1


def test_pruning_saves_work():
    rng = np.random.default_rng(2)
    x = np.floor(64 * unit(rng.normal(size=(3000, 16)))[0] * np.exp(rng.normal(size=(3000, 1))))
    x = x[np.argsort(-np.sqrt((x**2).sum(axis=1)))]
    top = topk.TopK(np.arange(10**6, 10**6 + 50), x[::60].copy(), np.full(50, -np.inf), 10)
    for at in range(0, 3000, 200):
        top.visit(np.arange(at, at + 200), x[at : at + 200], np.sqrt((x[at : at + 200] ** 2).sum(axis=1)))
    assert top.verified < 0.5 * 50 * 3000


def test_query_blocks_visit_only_ranges_that_can_reach_them(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "GROUP", 1)
    directions = rng.normal(size=(1000, 8))
    directions /= np.sqrt((directions**2).sum(axis=1))[:, None]
    lengths = np.geomspace(50, 0.05, 1000)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rows = [(int(i), [float(c) for c in directions[i] * lengths[i]], 0) for i in range(1000)]
    df = frame(spark, rows)
    search = topk._search

    def counted(k):
        run = search(k)
        folder = str(tmp_path)

        def counting(batches):
            import os
            import uuid

            def noted():
                for batch in batches:
                    for team, role in zip(batch.column("team").to_pylist(), batch.column("role").to_pylist(), strict=True):
                        open(os.path.join(folder, f"{role}-{team}-{uuid.uuid4().hex}"), "w").close()
                    yield batch

            yield from run(noted())

        return counting

    monkeypatch.setattr(topk, "_search", counted)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 20 = 0"), k=20).collect())
    assert got == brute_top(rows, 20)
    teams = [p.name.split("-")[:2] for p in tmp_path.iterdir()]
    candidates, asked = ([t for r, t in teams if r == side] for side in "01")
    assert len(set(candidates)) >= 8 and len(asked) < 0.7 * len(set(candidates)) * max(asked.count(t) for t in set(asked))


def test_huge_components(spark):
    assert np.isfinite(topk.quantised(np.array([[1e308, -1e308, 0.5]]), 64.0)).all()
    df = spark.createDataFrame([(20, [1e308, 1.0]), (21, [1e308, 2.0]), (22, [-1e308, 0.0])], "vec_id long, embedding array<double>")
    rows = top_k(df, df.where("vec_id = 20")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in rows] == [(1, 21, 2**63 - 1), (2, 22, -(2**63))]
