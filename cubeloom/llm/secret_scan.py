"""Secrets in texts, found by one minimised automaton for all rules.

The rules are compiled once on the driver into transition arrays
(``automaton.compile_rules``); executors scan every byte of every text once for
all rules together. No shuffle, no state between rows: memory is bounded by an
Arrow batch, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import portions
from .automaton import Anchored, Automaton, compile_rules, match_ends


@dataclass(frozen=True)
class Rule:
    """``head`` then ``tail`` is the span; spans whose tail is shorter than ``least`` are dropped after matching."""

    kind: str
    head: str
    tail: str
    least: int = 1

    @property
    def pattern(self) -> str:
        head = self.head.removeprefix("(?i)")
        return "(?i)" * self.head.startswith("(?i)") + head + self.tail


# The three base rules. Hex has its minimum inside the pattern, where it gives the same
# spans as a filter behind it: every word has short runs of these letters, and none need be reported.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
EXTRA_RULES = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]+", 30),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", 12),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 8),
    Rule("pem", "-----BEGIN [A-Z ]*", "PRIVATE KEY-----", 1),
)
#: Text bytes scanned together; bounds the scanner's arrays.
SCAN_BYTES = 1 << 21


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    auto: Automaton = field(init=False)

    def __post_init__(self) -> None:
        if len({r.kind for r in self.rules}) != len(self.rules):
            raise ValueError("rule kinds must differ")
        self.auto = compile_rules([r.pattern for r in self.rules])
        if not self.auto.reset[10]:
            raise ValueError("a rule may not match across line ends")
        self.back = [Anchored(r.pattern, reverse=True) for r in self.rules]
        self.heads = [Anchored(r.head) for r in self.rules]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, end, rule number) in code points, by start and then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) < SCAN_BYTES:
                size += len(texts[last])
                last += 1
            self._scan_block(texts, first, last, out)
            first = last
        return out

    def _scan_block(self, texts, first, last, out) -> None:
        data = b"\n".join(texts[first:last]) + b"\n"
        ends = sorted(match_ends(self.auto, data))
        text, base, before = first, 0, [0] * len(self.rules)
        for end, rule in ends:
            while base + len(texts[text]) < end:
                base += len(texts[text]) + 1
                text += 1
                before = [base] * len(self.rules)
            window = data[before[rule] : end]
            start = end - self.back[rule].longest(reversed(window))
            before[rule] = end
            if end - start - self.heads[rule].longest(data[start:end]) < self.rules[rule].least:
                continue
            own = texts[text]
            if own.isascii():
                out[text].append((start - base, end - base, rule))
            else:
                lead = len(own[: start - base].decode("utf-8", "replace"))
                out[text].append((lead, lead + end - start, rule))
        for k in range(first, last):
            out[k].sort(key=lambda s: (s[0], s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """One row (id, spans) per input row; ``spans`` is array<struct<kind, start, end>>.

    Starts and ends count code points, ends are exclusive; spans come by start,
    then in the order of ``rules``. Null and empty texts have no spans. Null and
    repeated ids pass through, a row each. Only the two named columns are read,
    so other columns, whatever they're called, don't matter.
    """
    scanner = Scanner(tuple(rules))
    kinds = [r.kind for r in rules]
    kind_of = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1000):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            spans = scanner.scan(texts)
            flat = [s for row in spans for s in row]
            offsets = [0]
            for row in spans:
                offsets.append(offsets[-1] + len(row))
            items = pa.StructArray.from_arrays(
                [pa.array([kinds[s[2]] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int64())],
                names=["kind", "start", "end"],
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], names=["id", "spans"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"id {kind_of}, spans array<struct<kind:string,start:bigint,`end`:bigint>>")
    return found.withColumnRenamed("id", id_col)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = [r.kind for r in BASE_RULES]
    return found.select(
        id_col,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(*base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
