import math
import random
import zlib

import numpy as np
import pytest

from cubeloom.llm import quality, toxicity

from .shared import no_documents, odd_documents

DATA = "/root/testdata/sf0.1"


def held_out(rows, labels):
    return [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def auc(pairs):
    positive, negative = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([[(a > b) + (a == b) / 2 for b in negative] for a in positive])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    rows = quality.classify(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    pairs = held_out(rows, known)
    assert len(rows) == docs.count() and auc(pairs) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    rows = toxicity.classify(docs, labels).collect()
    pairs = held_out(rows, {r.doc_id: r.toxic for r in labels.collect()})
    caught = [s >= 0.5 for s, y in pairs if y]
    false = [s >= 0.5 for s, y in pairs if not y]
    # Some junk documents are labelled toxic without a toxic word in them.
    assert np.mean(caught) > 0.8 and np.mean(false) < 0.02
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    label = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (2, 1), (3, 0), (7, 1), (7, 0)], f"doc_id long, {label} int")
    rows = module.classify(odd_documents(spark), labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id is None).held_out is False
    nothing = labels.where("false")
    assert len(module.classify(odd_documents(spark), nothing).collect()) == 10
    assert module.classify(no_documents(spark), nothing).collect() == []


def sentences(rng, n):
    out = []
    for _ in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet elit sed tempor".split()) for _ in range(5)]
        toxic = rng.random() < 0.4
        if toxic:
            words.append(rng.choice(["vile", "awful"]))
        # In the sample, one group is named mostly in toxic sentences.
        if rng.random() < (0.7 if toxic else 0.1):
            words.append("gay")
        if rng.random() < 0.1:
            words.append("straight")
        out.append((" ".join(words) + ". Nothing else.", int(toxic)))
    return out


def odds(model, text):
    p = model.scorer()(text)
    return math.log(p / (1 - p))


def test_swaps_change_scores_less_with_the_penalty(spark, tmp_path):
    path = str(tmp_path / "sample")
    spark.createDataFrame(sentences(random.Random(1), 1500), "text string, y int").write.parquet(path)
    rows = toxicity.training_rows(spark.read.parquet(path))
    plain, fair = (toxicity.fit(*rows, fairness=f, ridge=0.1) for f in (0.0, 1.0))
    gap = lambda m, a, b: abs(odds(m, a) - odds(m, b))
    swapped = ("the gay man sat", "the straight man sat")
    assert gap(plain, *swapped) > 0.8 and gap(fair, *swapped) < 0.05
    assert fair.scorer()("a gay neighbour sat here") < 0.5 < fair.scorer()("what a vile lorem")


def test_the_querys_own_model_ignores_neutral_mentions(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    assert "w !!" not in model.weights
    plain = odds(model, "the neighbour came by and had tea")
    assert 1 / (1 + math.exp(-plain)) < 0.5
    for group in toxicity.IDENTITY_GROUPS:
        for term in group:
            assert abs(odds(model, f"the {term} neighbour came by and had tea") - plain) < 0.05, term
            assert f"w {term}" in model.weights
    sample = toxicity.stage(toxicity.labelled_sample(docs, labels, "toxic", 5, 0, 300), "sample")
    chosen, x, y, differences = toxicity.training_rows(sample)
    assert np.abs(toxicity.penalty_matrix(differences, x.shape[1] + 1)).sum() > 0
    unfair = toxicity.fit(chosen, x, y, differences, fairness=0.0)
    assert unfair.weights != toxicity.fit(chosen, x, y, differences).weights


def test_counterfactuals_are_sentences():
    groups = (("cat", "dog"), ("red", "blue"))
    pairs = [(sorted(a), sorted(b)) for a, b in toxicity.counterfactuals("A cat sat. It was fine", groups)]
    assert (["a", "cat", "sat"], ["a", "dog", "sat"]) in pairs and len(pairs) in (4, 5)
    named = [b for a, b in pairs if len(b) > len(a)]
    assert len({frozenset(a) for a, b in pairs if len(b) > len(a)}) == 1 and {"red", "blue"} <= {w for b in named for w in b}
    assert list(toxicity.counterfactuals(None, groups)) == []


def test_toxicity_scores_and_step_equal_loops():
    rng = random.Random(2)
    chosen = ["w vile", "4 vile", "w tea", "w cat", "w dog"]
    x = np.array([[rng.random() < 0.4 for _ in chosen] for _ in range(40)], dtype=np.uint8)
    y = np.array([float(rng.random() < 0.5) for _ in range(40)])
    differences = {(4, -5): 3, (-4,): 2}
    hold = 2 * 0.7 * toxicity.penalty_matrix(differences, 6) + 2 * 0.3 * np.diag([1.0] * 5 + [0.0])

    def loss(w):
        total = 0.3 * sum(v * v for v in w[:5]) + 0.7 * (3 * (w[3] - w[4]) ** 2 + 2 * w[3] ** 2)
        for row, label in zip(x, y, strict=True):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row.tolist(), w, strict=False)) - w[5]))
            total -= label * math.log(p) + (1 - label) * math.log(1 - p)
        return total

    def slope(w, k, h=1e-5):
        up, down = list(w), list(w)
        up[k] += h
        down[k] -= h
        return (loss(up) - loss(down)) / (2 * h)

    w = [rng.uniform(-0.5, 0.5) for _ in range(6)]
    g = np.array([slope(w, k) for k in range(6)])
    bend = np.array([[(slope([*w[:j], w[j] + 1e-4, *w[j + 1 :]], k) - slope([*w[:j], w[j] - 1e-4, *w[j + 1 :]], k)) / 2e-4 for j in range(6)] for k in range(6)])
    ones = np.hstack([x.astype(np.int8), np.ones((40, 1), dtype=np.int8)])
    assert np.allclose(toxicity.newton_step(np.array(w), ones, y, hold), np.linalg.solve(bend, g), rtol=1e-2, atol=1e-3)
    model = toxicity.Model({"w vile": 1.5, "4 vile": 0.25, "w tea": -0.5}, -1.0)
    score = model.scorer()
    for text, z in (("Vile!", 0.5), ("VILENESS vile tea vile", 0.25 + 1.5 - 0.5 - 1), (None, -1.0), ("", -1.0), ("violet", -1.0)):
        assert math.isclose(score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-12), text


def test_quality_scores_and_gradient_equal_loops():
    rng = np.random.default_rng(3)
    hidden, gates, width = 3, 2, 4
    p = {"encode": rng.normal(size=(width, hidden)), "encode_bias": rng.normal(size=hidden), "v": rng.normal(size=(hidden, gates)), "u": rng.normal(size=(hidden, gates)), "attend": rng.normal(size=gates), "out": rng.normal(size=hidden), "bias": np.array(0.3)}
    sizes, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(6, width))
    sig = lambda z: 1 / (1 + math.exp(-z))

    def z_of(p, rows):
        hs, es = [], []
        for row in rows:
            h = [math.tanh(sum(row[i] * p["encode"][i, k] for i in range(width)) + p["encode_bias"][k]) for k in range(hidden)]
            gate = [math.tanh(sum(h[k] * p["v"][k, g] for k in range(hidden))) * sig(sum(h[k] * p["u"][k, g] for k in range(hidden))) for g in range(gates)]
            hs.append(h)
            es.append(math.exp(sum(gate[g] * p["attend"][g] for g in range(gates))))
        return sum(e / sum(es) * h[k] * p["out"][k] for e, h in zip(es, hs, strict=True) for k in range(hidden)) + float(p["bias"])

    def loss(p):
        at, total = 0, 0.0
        for n, label in zip(sizes.tolist(), y.tolist(), strict=True):
            q = sig(z_of(p, x[at : at + n]))
            total -= (label * math.log(q) + (1 - label) * math.log(1 - q)) / 3
            at += n
        return total

    for name, g in quality.gradients(p, x, sizes, y).items():
        for at in np.ndindex(p[name].shape):
            up, down = ({**p, name: p[name].copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert math.isclose(np.asarray(g)[at], (loss(up) - loss(down)) / 2e-6, rel_tol=1e-4, abs_tol=1e-7), (name, at)
    wide = {**p, "encode": rng.normal(size=(quality.WIDTH, hidden))}
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), **{k: (float(v) if k == "bias" else v) for k, v in wide.items()})
    text = "lorem ipsum " * 150
    width = quality.WIDTH
    assert math.isclose(model.score(text), sig(z_of(wide, quality.encode_passages(text))), rel_tol=1e-6)


def test_training_passages_are_spread_over_the_text():
    rows = np.arange(100.0)[:, None]
    assert quality.spread(rows, 5).ravel().tolist() == [0, 25, 50, 74, 99] and len(quality.spread(rows, 100)) == 100


def test_sample_is_bounded_and_ignores_absent_ids(spark):
    from cubeloom.llm.training import labelled_sample

    docs = spark.createDataFrame([(i, f"t{k}") for i in range(40) for k in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-500, 40)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 5, 0, 10).collect()
    assert len(rows) == 20 == len({r.d for r in rows}) and sum(r.y for r in rows) == 10


def test_attention_finds_the_telling_passage():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "north", "wind", "sun", "was", "strong", "travel", "cloak"]) + rng.choice(["", "", ",", "."]) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["$$$", "###", "win!!", "%%%"]) for _ in range(n))
    bags, y = [], []
    for _ in range(300):
        bad = rng.random() < 0.5
        parts = [prose(96) for _ in range(rng.randint(1, 6))]
        if bad:
            parts[rng.randrange(len(parts))] = junk(96)
        bags.append(quality.encode_passages(" ".join(parts)))
        y.append(0.0 if bad else 1.0)
    model = quality.fit(bags, np.array(y), epochs=30)
    text = " ".join([prose(96), prose(96), junk(96), prose(96)])
    h, a = model.attention(quality.encode_passages(text))
    assert a.argmax() == 2 and model.score(text) < 0.5 < model.score(" ".join(prose(96) for _ in range(4)))


def test_passages_cover_the_whole_text():
    words = [f"w{i}" for i in range(1000)]
    parts = quality.passages(" ".join(words))
    assert sum(map(len, parts)) == 1000 and parts[-1][-1] == b"w999"
    assert quality.encode_passages(None).shape == (1, quality.WIDTH) == quality.encode_passages("").shape
