import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cubeloom.llm.line_dedup import keep_lines, line_dedup

from .shared import no_documents, odd_documents

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=40, min_docs=5):
    """{id: (n_lines, n_dropped, text)} for unique ids."""
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("parts", [1, 8, 61])
def test_equals_brute_force_at_any_partitioning(spark, parts):
    rng = random.Random(parts)
    stock = [f"Line number {k} of the stock that is surely long enough é" for k in range(40)]
    hot = "THE LINE that every third document holds, word for word"
    docs = []
    for i in range(400):
        lines = [rng.choice(stock) if rng.random() < 0.5 else f"own line {i} {j} {'x' * rng.randint(0, 50)}" for j in range(rng.randint(0, 9))]
        if i % 3 == 0:
            lines += ["  " + hot.lower() + "\r", hot]
        docs.append((i, "\n".join(lines) if i % 50 else None))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        rows = keep_lines(frame, line_dedup(frame)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = brute(docs)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in rows} == want
    assert sum(d for _, d, _ in want.values()) > 100


def test_bitmap_marks_lines(spark):
    line = "this very line stands in six documents of the table"
    frame = spark.createDataFrame([(i, f"own {i}\n{line}\nend") for i in range(6)], "doc_id long, text string")
    maps = {r.doc_id: r for r in line_dedup(frame).collect()}
    assert sorted(maps) == [0, 1, 2, 3, 4]
    bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[0].keep), dtype=np.uint8), count=3)
    assert bits.tolist() == [1, 0, 1] and maps[0].n_lines == 3 and maps[0].n_dropped == 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = keep_lines(docs, line_dedup(docs)).collect()
    assert len(rows) == 10
    assert {c for c in docs.columns} <= set(rows[0].asDict())
    assert all(r.n_dropped == 0 for r in rows)
    assert next(r for r in rows if r.doc_id == 2).n_lines == 1
    assert next(r for r in rows if r.doc_id == 4).n_lines == 3
    empty = no_documents(spark)
    assert keep_lines(empty, line_dedup(empty)).collect() == []


def test_rows_that_repeat_an_id_count_once(spark):
    line = "a line that is long enough to take part in this comparison"
    frame = spark.createDataFrame([(i, line) for i in (1, 1, 1, 2, 3, 4)], "doc_id long, text string")
    assert line_dedup(frame).collect() == []
    frame = spark.createDataFrame([(i, line) for i in (1, 1, 2, 3, 4, 5)], "doc_id long, text string")
    rows = keep_lines(frame, line_dedup(frame)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0)]
