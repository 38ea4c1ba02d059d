"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes is reduced to one signed row per (source, lang, tokenizer)
before it is shuffled, and written under a name of its own. It counts only once
its commit file exists; creating that file is atomic and fails if it is there,
so a batch that is sent twice, or whose driver died half-way, counts once.
Totals are the sum of committed deltas; ``compact`` folds them into one.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import portions

#: Fixed value: the public split pattern of byte-level BPE vocabularies.
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file is read on the driver and sent to executors; larger ones are refused.
VOCABULARY_BYTES = 32 << 20

KEY = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


#: The same pieces for Python's ``regex``: \s spelled out as the characters of Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Texts with a run of blanks or a word longer than this are cut into pieces here: the tokenizer's own
#: pattern backtracks over a long run by recursion, and its stack ends at about a million characters.
LONG_RUN = 10_000


@dataclass(frozen=True)
class Tokenizer:
    """``ranks`` is the text of a .tiktoken file; None counts runs free of blanks."""

    version: str
    ranks: bytes | None = None

    @classmethod
    def from_file(cls, version: str, path: str) -> Tokenizer:
        """The vocabulary at ``path`` on the driver, from where it is sent to executors."""
        file = Path(path)
        if not file.is_file():
            raise FileNotFoundError(f"no tokenizer vocabulary at {path}: name a .tiktoken file that the driver can read")
        if file.stat().st_size > VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
        return cls(version, file.read_bytes())

    def counter(self) -> Callable[[str], int]:
        return make_counter(self.version, self.ranks)


def has_long_run(text: str) -> bool:
    """Whether a word, or maybe a run of blanks, exceeds LONG_RUN; cheap for the others."""
    if len(text) <= LONG_RUN:
        return False
    sizes = [len(w) for w in text.split()]
    return max(sizes, default=0) > LONG_RUN or len(text) - sum(sizes) - len(sizes) >= LONG_RUN


def make_counter(version: str, ranks: bytes | None) -> Callable[[str], int]:
    """A function from a text to its number of tokens, for texts of any length and kind."""
    if ranks is None:
        return lambda text: len(text.encode().split())
    import regex
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    encoding = tiktoken.Encoding(version, pat_str=BYTE_BPE_PATTERN, mergeable_ranks=merges, special_tokens={})
    whole = tiktoken.Encoding(f"{version}-whole", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={})
    piece = regex.compile(_PIECE)

    def count(text: str) -> int:
        if not has_long_run(text):
            return len(encoding.encode_ordinary(text))
        return sum(len(whole.encode_ordinary(m[0])) for m in piece.finditer(text))

    return count


def count_tokens(docs: DataFrame, tokenizers: list[Tokenizer], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, source, lang, tokenizer, tokens): a row per row of ``docs`` and tokenizer.

    Null and empty texts have 0 tokens; texts are counted whole, with runs of
    blanks, letters or marks of any length. Rows that
    repeat an id, or have none, count each. Null sources and languages are
    groups like others. An empty table gives an empty result.
    """
    # Plain values: a broadcast object of a class would need the package on executors.
    sent = docs.sparkSession.sparkContext.broadcast([(t.version, t.ranks) for t in tokenizers])
    versions = [t.version for t in tokenizers]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [make_counter(*t) for t in sent.value]
        for batch in portions(batches):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for version, counter in zip(versions, counters, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([version] * len(texts), pa.string()), pa.array([counter(t) for t in texts], pa.int64())],
                    names=["id", "source", "lang", "tokenizer", "tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(n) for c, n in ((source_col, "source"), (lang_col, "lang"), (text_col, "text"))])
    return named.mapInArrow(count, f"id {kind}, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("n_docs"), (-F.col("tokens")).alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that take documents from their old counts (or source, language) to the new ones."""
    return deletes(before).unionByName(inserts(after))


class TokenTotals:
    """Totals in a folder that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def _commits(self) -> dict[str, dict]:
        out = {}
        for status in self._fs.listStatus(self._path(f"{self.folder}/commits")):
            name = status.getPath().getName()
            if not name.startswith((".", "_")):
                stream = self._fs.open(status.getPath())
                try:
                    out[name] = json.loads(bytes(stream.readAllBytes()) or b"{}")
                finally:
                    stream.close()
        return out

    def _commit(self, batch: str, entry: dict) -> bool:
        """Create the commit file; False if another run of the batch did."""
        final = self._path(f"{self.folder}/commits/{batch}")
        draft = self._path(f"{self.folder}/commits/.{batch}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        # The full file is renamed, so a commit is never seen half-written.
        done = not self._fs.exists(final) and self._fs.rename(draft, final)
        if not done:
            self._fs.delete(draft, False)
        return bool(done)

    def _write(self, signed: DataFrame) -> str:
        name = uuid.uuid4().hex
        total = signed.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        total.where("n_docs != 0 or n_tokens != 0").write.parquet(f"{self.folder}/deltas/{name}")
        return name

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Add signed rows (source, lang, tokenizer, n_docs, n_tokens) once; False if ``batch`` was applied before."""
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        commits = self._commits()
        if batch in commits or any(batch in c.get("covers", ()) for c in commits.values()):
            return False
        return self._commit(batch, {"delta": self._write(signed)})

    def _live(self, commits: dict[str, dict]) -> list[str]:
        covered = {b for c in commits.values() for b in c.get("covers", ())}
        return [c["delta"] for b, c in commits.items() if b not in covered]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); groups that have come down to nothing are left out."""
        live = self._live(self._commits())
        paths = [f"{self.folder}/deltas/{d}" for d in live]
        signed = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return signed.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Fold the committed deltas into one; batch names stay known."""
        commits = self._commits()
        if len(self._live(commits)) > 1:
            self._commit(f"compact-{uuid.uuid4().hex}", {"delta": self._write(self.totals()), "covers": sorted(commits)})
