import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import mixing, packing, token_counts
from cubeloom.llm.ranks import running
from cubeloom.llm.token_counts import TokenTotals, Tokenizer, count_tokens, deletes, inserts, revisions

from .shared import LONG, no_documents, odd_documents

BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# Token counts


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_signed_batches_equal_a_recount(spark, tmp_path):
    rng = random.Random(6)
    state = {i: (rng.choice("ab"), rng.choice(["en", None]), rng.randint(0, 50)) for i in range(60)}
    schema = "id long, source string, lang string, tokenizer string, tokens long"
    counts = lambda s: spark.createDataFrame([(i, a, b, "t1", n) for i, (a, b, n) in s.items()], schema)
    store = TokenTotals(spark, str(tmp_path / "totals"))
    assert store.apply("b0", inserts(counts(state))) and not store.apply("b0", inserts(counts(state)))
    for step in range(1, 5):
        gone = {i: state.pop(i) for i in rng.sample(sorted(state), 5)}
        revised = {i: state[i] for i in rng.sample(sorted(state), 8)}
        new = {i: (rng.choice("abc"), "de", rng.randint(0, 90)) for i in revised}
        state.update(new)
        signed = deletes(counts(gone)).unionByName(revisions(counts(revised), counts(new)))
        assert store.apply(f"b{step}", signed) and not store.apply(f"b{step}", signed)
        want = defaultdict(lambda: [0, 0])
        for a, b, n in state.values():
            want[a, b, "t1"][0] += 1
            want[a, b, "t1"][1] += n
        assert totals(store) == {k: tuple(v) for k, v in want.items()}
        if step == 2:
            store.compact()
            assert totals(store) == {k: tuple(v) for k, v in want.items()}
            assert not store.apply("b1", signed)
    with pytest.raises(ValueError):
        store.apply("../x", inserts(counts(state)))


def test_a_batch_without_a_commit_does_not_count(spark, tmp_path):
    store = TokenTotals(spark, str(tmp_path / "totals"))
    rows = spark.createDataFrame([("a", "en", "t", 1, 5)], token_counts.DELTA)
    store._write(rows)  # the driver dies before the commit
    assert totals(store) == {}
    assert store.apply("b", rows) and totals(store) == {("a", "en", "t"): (1, 5)}


def test_tokenizers(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=token_counts.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_documents(spark)
    rows = count_tokens(docs, [Tokenizer("w"), Tokenizer.from_file("b", BPE)]).collect()
    texts = docs.select("doc_id", "text").collect()
    assert Counter((r.id, r.tokenizer, r.tokens) for r in rows) == Counter(
        x for t in texts for x in ((t.doc_id, "w", len((t.text or "").encode().split())), (t.doc_id, "b", len(encoding.encode_ordinary(t.text or ""))))
    )
    assert count_tokens(no_documents(spark), [Tokenizer("w")]).collect() == []


def test_long_runs_are_counted_whole():
    count = Tokenizer.from_file("b", BPE).counter()
    prose = "It's 3 o'clock;  \t\nthe  sun\u3000shone, they'll say. "
    rng = random.Random(9)
    for n in (9_990, 10_010, 20_000):
        for run in (" ", "\n", "\t ", "a", "7", "'", "\u2003", "é", "x9", "'s"):
            text = prose + run * (n // len(run)) + rng.choice(["", "a", "'s", " b", "9", "!"]) + prose
            assert token_counts.has_long_run(text) or n < 10_000
            assert count(text) == slowly(text)
    for text in (" " * 5_000_000, "\n" * 5_000_000 + "x", "a" * 5_000_000, "lorem " + " " * 1_000_000 + "ipsum"):
        assert count(text) > 0
    assert count("a" * 5_000_000) == 5 * count("a" * 1_000_000)


def slowly(text):
    """The tokenizer without any cutting; for runs that its stack bears."""
    import base64

    import tiktoken

    global _slow
    if _slow is None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
        _slow = tiktoken.Encoding("own", pat_str=token_counts.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return len(_slow.encode_ordinary(text))


_slow = None


def test_vocabularies_are_checked(tmp_path):
    with pytest.raises(FileNotFoundError, match="no tokenizer vocabulary"):
        Tokenizer.from_file("b", str(tmp_path / "none.tiktoken"))


# Running sums


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_running_equals_a_loop(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randint(0, 40), rng.randint(0, 9)) for _ in range(700)]
    got = running(spark.createDataFrame(rows, "g string, o long, v long"), "g", [F.col("o")], "v", parts).collect()
    for g in {"hot", "a", "b"}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and len(own) == sum(x[0] == g for x in rows)
        assert [r.o for r in own] == sorted(r.o for r in own)
        assert [r.before for r in own] == list(itertools.accumulate((r.v for r in own), initial=0))[:-1]


# Mixing


def water(sizes, weights, share, most):
    """Targets by resharing the excess until none is above, as a loop."""
    total, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        left = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > most * sizes[s]]
        if not over:
            target.update({s: left * weights[s] / w for s in open_})
            break
        target.update({s: most * sizes[s] for s in over})
        open_ -= set(over)
    return target


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["hot"] * 6 + ["a", "b", "é", None])) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, taken = water(sizes, weights, 1.5, 2.0), Counter()
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_heavier_documents_are_taken_sooner(spark):
    docs = spark.createDataFrame([(i, "abc def" if i % 2 else "1 2", "only" if i < 2000 else "big") for i in range(4000)], "doc_id long, text string, source string")
    rows = [r for r in mixing.mix(docs, weights=(2.0, 1.0), share=1.0, most=3.0, quality=F.when(F.col("letters") > 0, 4.0).otherwise(1.0)).collect() if r.source == "only"]
    by_kind = {k: np.mean([r.taken > 0 for r in rows if r.doc_id % 2 == k]) for k in (0, 1)}
    assert by_kind[1] > by_kind[0] + 0.1


def test_draw_takes_what_the_mix_says(spark):
    docs = spark.createDataFrame([(i, f"a{i}  b\tc d", s) for i, s in enumerate("xxyyyyyyyy")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    words = Counter()
    for r in mixing.draw(docs, mixed).collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_mix_odd_rows(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    assert len(rows) == 10 and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert next(r.size for r in rows if r.doc_id == 5) == len(LONG.split())
    assert mixing.mix(no_documents(spark)).collect() == []
    assert mixing.draw(no_documents(spark), mixing.mix(no_documents(spark))).collect() == []


# Packing


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for r in range(k) for c in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
        assert padding(lengths, counts, packing.choose_boundaries(np.array(lengths, dtype=float), np.array(counts), k)) == best


def test_batches_fill_buckets(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * int(rng.paretovariate(0.8)))) for i in range(1500)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), buckets=6, token_budget=256).collect()
    sizes = {i: len(t.split()) for i, t in docs}
    assert {r.doc_id: r.length for r in rows} == sizes
    batches = defaultdict(list)
    for r in rows:
        assert r.length <= r.boundary
        batches[r.bucket, r.batch].append(r)
    for (bucket, _), own in batches.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].boundary <= 256
        last = max(b for k, b in batches if k == bucket)
        assert own[0].batch == last or len(own) == max(1, 256 // own[0].boundary)


def test_pack_odd_rows(spark):
    rows = packing.pack(odd_documents(spark)).collect()
    assert len(rows) == 10 and len({(r.bucket, r.batch, r.slot) for r in rows}) == 10
    assert packing.pack(no_documents(spark)).collect() == []


def test_cells_never_round_down(spark):
    rows = spark.range(0, 40000, 7).select("id", packing.cell_of(F.col("id")).alias("cell")).collect()
    assert all(r.cell >= r.id and r.cell <= r.id * (1 + 2 / packing.EXACT) + 1 for r in rows)
    assert all(r.cell == r.id for r in rows if r.id <= packing.EXACT)
