import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from cubeloom.llm.arrow import portions
from cubeloom.llm.texts import first_words, letter_bytes, word_count

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    marks = "ab Zé\t\n\x0b\x0c\r\x00\x1f\x85\xa0中\U0001f600.$1\\ "
    made = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*made, None, "", "   ", " a", "a ", " a b ", "x" * 100_000, " " * 100_000, "lorem ipsum\n" * 50_000, "\x01" * 50]


def test_words_and_letters_equal_a_count_over_bytes(spark):
    rows = list(enumerate(texts()))
    got = spark.createDataFrame(rows, "i long, t string").select("i", word_count(F.col("t")).alias("w"), letter_bytes(F.col("t")).alias("l")).collect()
    not_letters = bytes(b for b in range(128) if not chr(b).isalpha())
    for r in got:
        raw = (rows[r.i][1] or "").encode()
        assert (r.w, r.l) == (len(raw.split()), len(raw.translate(None, not_letters))), rows[r.i][1][:80]


def test_first_words_equal_a_scan(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice([1, 2, 3, 50, 70_000])) for i, t in enumerate(texts()) if t is not None]
    for r in spark.createDataFrame(rows, "i long, t string, n long").select("t", "n", first_words(F.col("t"), F.col("n")).alias("cut")).collect():
        ends = [m.end() for m in WORD.finditer(r.t.encode())]
        assert r.cut.encode() == (r.t.encode()[: ends[r.n - 1]] if len(ends) >= r.n else r.t.encode())


def test_portions_are_bounded_in_bytes():
    texts = pa.array(["a" * 5, None, "b" * (5 << 20), "", "c" * (3 << 20), "d" * (2 << 20)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), texts, pa.array([[1], None, [], [2, 3], [4], [5]], pa.list_(pa.int64()))], names=list("xyz"))
    parts = [p.column(0).to_pylist() for p in portions([batch, batch.slice(2), batch.slice(0, 0)])]
    assert parts == [[0, 1], [2], [3, 4], [5], [2], [3, 4], [5]]
    assert [p.num_rows for p in portions([pa.RecordBatch.from_arrays([pa.array(range(450))], names=["x"])])] == [200, 200, 50]
