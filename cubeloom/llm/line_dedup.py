"""Lines that many documents share are kept in one document only.

Every line long enough gets a 128-bit hash of its key. The occurrences are
range-partitioned by (hash, document) and sorted within partitions by hash,
document from the largest id down, and position; each partition is then
streamed once. Partition borders fall between documents of one hash too, so a
line that a third of the corpus holds spreads over many tasks. Only the first
and last hash of a partition can continue in a neighbour: their counts (at
most two small rows a partition) are added up and settle their rows.

The result is a compressed bitmap of kept lines per document that loses some;
text is moved only where ``keep_lines`` puts the bitmaps to use.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import portions
from .staging import stage

#: Characters stripped from both ends of a line to make its key.
BLANK = b" \t\n\x0b\x0c\r"
_LEAD = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() touches A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.translate(None, _LEAD)) >= least)


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, row_key, n_lines, positions): a row per document and distinct long key."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            h1, h2, ids, rows, counts, at = [], [], [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                places: dict[bytes, list[int]] = {}
                for n, line in enumerate(lines):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        places.setdefault(key, []).append(n)
                for key, where in places.items():
                    digest = xxhash.xxh3_128_intdigest(key)
                    h1.append((digest >> 64) - (1 << 63))
                    h2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                    ids.append(doc)
                    rows.append(row)
                    counts.append(len(lines))
                    at.append(where)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(counts, pa.int32()), pa.array(at, pa.list_(pa.int32()))],
                names=["h1", "h2", "id", "row_key", "n_lines", "positions"],
            )

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(occurrences, "h1 long, h2 long, id long, row_key long, n_lines int, positions array<int>")


class _Group:
    """Rows of one hash in one partition, streamed: the first document's rows stay, others wait until enough documents came."""

    def __init__(self, key: tuple[int, int], edge: bool) -> None:
        self.key, self.edge = key, edge
        self.largest: int | None = None
        self.last: int | None = None
        self.documents = 0
        self.waiting: list[tuple] = []


def _settle(min_docs: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: _Group | None = None
        seen_any = False
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "h1", "h2", "id", "row_key", "n_lines", "positions", "documents"])
            out.clear()
            return batch

        def close(last: bool) -> None:
            # An edge group may go on in a neighbouring partition: its rows were sent as open, with a summary.
            if group.edge or last:
                if not group.edge:
                    out.extend((1, *group.key, *row, None) for row in group.waiting)
                out.append((2, *group.key, group.largest, None, None, None, group.documents))

        for batch in batches:
            h1, h2, ids = (batch.column(k).to_numpy() for k in range(3))
            row_keys, counts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            positions = batch.column(5)
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            firsts = np.flatnonzero(new)
            # Groups within the batch that can't reach min_docs documents are passed over without a loop over rows.
            sizes = np.diff(np.append(firsts, len(h1)))
            for k, (a, n) in enumerate(zip(firsts.tolist(), sizes.tolist(), strict=True)):
                key = (int(h1[a]), int(h2[a]))
                inner = 0 < k < len(firsts) - 1
                if inner and n < min_docs:
                    if group is not None:
                        close(False)
                        group = None
                    continue
                if group is None or group.key != key:
                    if group is not None:
                        close(False)
                    group = _Group(key, edge=not seen_any)
                    seen_any = True
                for r in range(a, a + n):
                    doc = int(ids[r])
                    if group.largest is None:
                        group.largest = doc
                    if doc != group.last:
                        group.documents += 1
                        group.last = doc
                    if doc == group.largest and not group.edge and group.documents == 1:
                        group.waiting.append((doc, row_keys[r], counts[r], positions[r].as_py()))
                        continue
                    row = (doc, row_keys[r], counts[r], positions[r].as_py())
                    if group.edge:
                        out.append((1, *key, *row, None))
                    else:
                        group.waiting.append(row)
                if not group.edge and group.documents >= min_docs:
                    # Enough documents: nothing that follows can change these rows' fate, but
                    # the largest document, which came first, keeps its lines.
                    out.extend((0, *key, *row, None) for row in group.waiting if row[0] != group.largest)
                    group.waiting = [row for row in group.waiting if row[0] == group.largest]
                if len(out) >= 20_000:
                    yield flush()
        if group is not None:
            close(True)
        if out:
            yield flush()

    return settle


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Bitmaps of the lines to keep: (id, row_key, n_lines, n_dropped, keep), for documents that lose a line.

    A key of at least ``min_chars`` code points (the line stripped of blanks,
    A-Z lower-cased) that stands in at least ``min_docs`` documents loses all
    its lines except in the largest id holding it. ``keep`` is a zlib-packed bit
    array, first line in the highest bit; documents not listed keep all lines.
    ``row_key`` is the hash of the text: rows that repeat an id count as one
    document, and each distinct text among them has its own bitmap. Rows with a
    null id take no part; null and empty texts are one empty line; an empty
    table gives an empty result.
    """
    found = stage(line_occurrences(docs, id_col, text_col, min_chars), "line-occurrences")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("h1").asc(), F.col("h2").asc(), F.col("id").desc()]
    ranged = found.repartitionByRange(parts, *order).sortWithinPartitions(*order, "row_key")
    settled = stage(ranged.mapInArrow(_settle(min_docs), "kind byte, h1 long, h2 long, id long, row_key long, n_lines int, positions array<int>, documents long"), "line-settled")
    edges = settled.where("kind = 2").groupBy("h1", "h2").agg(F.sum("documents").alias("documents"), F.max("id").alias("largest")).where(F.col("documents") >= min_docs).drop("documents")
    # Two rows a partition at most, so the broadcast is bounded by the number of partitions.
    opened = settled.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where(F.col("id") != F.col("largest"))
    keep_of = ["id", "row_key", "n_lines", "positions"]
    dropped = settled.where("kind = 0").select(*keep_of).unionByName(opened.select(*keep_of))
    # A document's rows are as many as its own lines, so the group is bounded by the document.
    per_doc = dropped.groupBy("id", "row_key").agg(F.first("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()
    return per_doc.mapInArrow(_pack, "id long, row_key long, n_lines long, n_dropped long, keep binary").select(F.col("id").cast(kind).alias(id_col), "row_key", "n_lines", "n_dropped", "keep")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps, gone_counts = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, dtype=np.uint8)
            bits[gone] = 0
            keeps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            gone_counts.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(keeps, pa.binary())],
            names=["id", "row_key", "n_lines", "n_dropped", "keep"],
        )


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return b"\n".join(line for line, bit in zip(lines, bits.tolist(), strict=True) if bit)


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``, its text reduced to kept lines, with ``n_lines`` and ``n_dropped``.

    Columns of ``docs`` stay as they are but for the text, which is null only
    where it was null and empty if all lines went. ``n_lines`` and
    ``n_dropped`` replace columns of those names.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"))
    marks = bitmaps.select(F.struct(F.col(id_col).alias("id"), "row_key", "keep", "n_dropped").alias("m"))
    text = F.col(f"d.`{text_col}`")
    joined = rows.join(marks.hint("shuffle_hash"), (F.col(f"d.`{id_col}`") == F.col("m.id")) & (F.xxhash64(text) == F.col("m.row_key")), "left")

    @F.pandas_udf("string")
    def reduced(texts, keeps):
        return texts.combine(keeps, lambda t, k: None if k is None else kept_text(t.encode(), k).decode())

    marked = F.col("m.keep").isNotNull()
    new_text = F.when(marked, reduced(F.when(marked, text), F.col("m.keep"))).otherwise(text)
    n_lines = F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(1)).cast("long")
    columns = [(new_text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in own]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce("m.n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
