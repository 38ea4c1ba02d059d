"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import mixing, toxicity

from .test_line_dedup import brute as brute_lines
from .test_minhash import brute as brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input, output)] of every stage over a slice of the test documents, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    source = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 900")
    line = "this line stands in very many documents, word for word, and is long enough to go"
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 30 == 0, F.concat("text", F.lit("\n" + line))).otherwise(F.col("text")))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").where("doc_id < 900").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return str(folder), out


def test_stage_order_and_columns(stages):
    assert [s[0] for s in stages[1]] == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "packing"]
    assert all(after.columns == COLUMNS for _, _, after in stages[1][:-1])


def test_toxic_documents_go(spark, stages):
    folder, ((_, before, after), *_) = stages
    model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    run = model.scorer()
    want = {r.doc_id: r.text for r in before.collect() if run(r.text) < 0.5}
    assert {r.doc_id: r.text for r in after.collect()} == want and 0 < before.count() - len(want) < 0.2 * before.count()


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, 1)], [(3, None)]])
def test_no_document_goes_without_labels_of_both_kinds(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"text {i}", "en", "x", 6) for i in range(9)] + [(None, None, "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert Counter(after.collect()) == Counter(docs.collect())
    assert {r.predicted for r in toxicity.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()} == {0}


def test_repeated_lines_go(stages):
    _, before, after = stages[1][1]
    want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    rows = after.collect()
    assert {r.doc_id: r.text for r in rows} == {i: t for i, (_, _, t) in want.items()}
    assert sum(n for _, n, _ in want.values()) > 5 and all(r.n_chars == len(r.text) for r in rows)


def test_near_copies_go(stages):
    _, before, after = stages[1][2]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()], n=5)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in groups.values()})


def test_mix_takes_its_words(stages):
    _, before, after = stages[1][3]
    want = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == Counter(want)
    sizes = sum(len((r.text or "").encode().split()) for r in before.collect())
    assert abs(sum(words.values()) - 1.5 * sizes) <= before.select("source").distinct().count()


def test_mix_draws_rows_without_an_id_of_their_own(spark):
    rows = [(i, f"one{i} a b c d", "en", s, 14) for i, s in enumerate("xxyyyyyyyyyy")]
    rows += [(None, f"none{i} a b" + " c" * (i % 3), "en", "x", 9) for i in range(12)] + [(None, "same a b", "en", "y", 8)] * 9
    rows += [(50, f"fifty{i} a b c", "en", "y", 9) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text_of = {r.h: r.text for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    want, words = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, text_of[r.text_hash].split()[0]] += r.taken
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r.doc_id, r.text.split()[0]] += len(r.text.split())
    assert words == +want and sum(n for (i, _), n in want.items() if i is None) > 50


def test_every_row_is_packed_once(stages):
    _, before, after = stages[1][4]
    rows = after.collect()
    assert len(rows) == before.count() == len({(r.bucket, r.batch, r.slot) for r in rows})
    assert Counter((r.doc_id, r.length) for r in rows) == Counter((r.doc_id, len(r.text.encode().split())) for r in before.collect())


def test_run_gives_the_last_stage(spark, stages):
    folder, out = stages
    key = lambda r: (r.doc_id, r.length, r.bucket, r.batch, r.slot)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, out[-1][2].collect()))
