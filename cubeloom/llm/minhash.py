"""Near-duplicate documents: fast similarity sketching, banding, exact confirmation.

1. Every text becomes its set of word shingles, hashed to 64 bits, and a
   sketch: in round i every element falls into one of ``t`` bins with a value;
   a bin keeps the smallest value of the first round that reaches it. Rounds
   t..2t-1 send all elements to bin i - t, so every coordinate fills, also for
   sets far smaller than t, and the share of equal coordinates estimates the
   Jaccard similarity with concentration bounds.
2. Documents with equal sets are one class, found by a 128-bit hash of the set.
3. Sketches of the classes are cut into bands. Classes that share a band meet
   in a bucket. A bucket is never expanded into pairs: all members are compared
   with one pivot, the one that shares most bands with others. Members that the
   pivot proves to be in one component need no more comparisons. Buckets that
   still hold several components get further pivots.
4. Candidates whose sketches don't rule out the threshold are confirmed on the
   full shingle sets, rebuilt from the whole texts; a pivot's followers are dealt
   to tasks in portions.
   What pivots leave open is compared block against block: first the sketches
   say which members have a possible partner in another component, then these
   members' texts meet and only links that join components leave the task.
5. Components of the confirmed links are found with distributed star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import portions
from .components import components
from .staging import stage

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Remembers hashes of words; forgotten when large, so texts of random words don't fill memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words: int, hashes: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words the whole sequence is one."""
    own = text.lower().split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, own), dtype=np.uint64, count=len(own))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(out))


def round_salts(t: int) -> np.ndarray:
    return mix64(np.arange(1, 2 * t + 1, dtype=np.uint64) * _STEP)


def sketch(elements: np.ndarray, t: int, salts: np.ndarray) -> np.ndarray:
    """``t`` coordinates of a non-empty set, t at most 256: each packs round and value; ``salts`` are those of ``t``."""
    coords = np.zeros(t, dtype=np.uint64)
    open_bins = np.ones(t, dtype=bool)
    at, portion = 0, max(1, -(-2 * t // len(elements)))
    while open_bins.any():
        rounds = np.arange(at, min(at + portion, 2 * t), dtype=np.uint64)
        h = mix64(elements[None, :] ^ salts[rounds.astype(np.int64)][:, None])
        bins = (h >> np.uint64(32)) % np.uint64(t)
        late = rounds >= t
        bins[late] = (rounds[late] - np.uint64(t))[:, None]
        # bin, then round, then value: sorted, the first entry of a bin is its coordinate
        keys = np.sort(((bins << np.uint64(56)) | (rounds[:, None] << np.uint64(46)) | (mix64(h) >> np.uint64(18))).ravel())
        found = (keys >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        first = first[open_bins[found[first]]]
        coords[found[first]] = keys[first] & np.uint64((1 << 56) - 1)
        open_bins[found[first]] = False
        at += portion
    return coords


def band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for k in range(rows):
        h = mix64(h * _BASE + coords[k : bands * rows : rows])
    return h.view(np.int64)


def _sketches(words: int, bands: int, rows: int):
    t = bands * rows
    salts = round_salts(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in portions(batches):
            n, hi, lo, keys, coords = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                elements = shingle_set(text or b"", words, hashes)
                n.append(len(elements))
                if not len(elements):
                    for column in (hi, lo, keys, coords):
                        column.append(None)
                    continue
                digest = xxhash.xxh3_128_intdigest(elements.tobytes())
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & ((1 << 64) - 1)) - (1 << 63))
                s = sketch(elements, t, salts)
                keys.append(band_keys(s, bands, rows))
                coords.append(s.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(coords, pa.binary())],
                names=["id", "text_hash", "n_shingles", "hi", "lo", "bands", "coords"],
            )

    return run


def _confirm(words: int, percent: int):
    """Streams (pivot, part, role, rep, text) sorted by the first three: a pivot's texts, then its followers'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        group, pivots = None, []
        for batch in portions(batches):
            us, vs = [], []
            for pivot, part, role, own, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if group != (pivot, part):
                    group, pivots = (pivot, part), []
                elements = shingle_set(text or b"", words, hashes)
                if role == 0:
                    pivots.append(elements)
                    continue
                for p in pivots:
                    both = len(np.intersect1d(p, elements, assume_unique=True))
                    if both and 100 * both >= percent * (len(p) + len(elements) - both):
                        us.append(own)
                        vs.append(pivot)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def confirm_links(texts: DataFrame, owners: DataFrame, pairs: DataFrame, words: int, percent: int, portion: int = 64) -> DataFrame:
    """The pairs (u, v) of classes whose full shingle sets reach ``percent`` Jaccard similarity; v is the pivot.

    ``texts`` is (id, text, text_hash), ``owners`` (rep, own_id, own_hash) says
    whose text a class has, ``pairs`` is a staged table. A pivot with more than
    ``portion`` followers is sent to several tasks, each with its share of them.
    """
    crowded = pairs.groupBy("v").count().where(F.col("count") > portion).select("v", F.ceil(F.col("count") / portion).cast("int").alias("parts"))
    dealt = pairs.join(crowded, "v", "left").select("u", "v", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("parts"))).cast("int").alias("part"))
    dealt = stage(dealt, "pairs-dealt")
    routes = dealt.select(F.col("u").alias("rep"), F.col("v").alias("pivot"), "part", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("v").alias("rep"), F.col("v").alias("pivot"), "part", F.lit(0).alias("role")).distinct()
    )
    routed = _with_text(texts, owners, routes).select("pivot", "part", "role", "rep", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = routed.repartition(parts, "pivot", "part").sortWithinPartitions("pivot", "part", "role")
    return grouped.mapInArrow(_confirm(words, percent), "u long, v long")


def _with_text(texts: DataFrame, owners: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of classes with a text of each; an id alone won't do, as several texts may share it."""
    owned = rows.join(owners, "rep").hint("shuffle_hash")
    return texts.join(owned, (F.col("id") == F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).drop("id", "text_hash", "own_id", "own_hash")


def _near(t: int, least: float):
    @F.pandas_udf("boolean")
    def near(a, b):
        left = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), t)
        right = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), t)
        return pd.Series((left == right).mean(axis=1) >= least)

    return near


class _Block:
    """Rows of one pair of blocks of a bucket, gathered from a sorted stream."""

    def __init__(self, key: tuple) -> None:
        self.key, self.rows = key, []

    def pairs(self, t: int, least: float, rank: int) -> Iterator[tuple[int, np.ndarray]]:
        """Possible partners across components for each row: agreeing enough, and meeting first in this band."""
        rows = self.rows
        side, comp = np.array([r["side"] for r in rows]), np.array([r["comp"] for r in rows], dtype=np.int64)
        coords = np.frombuffer(b"".join(r["coords"] for r in rows), dtype=np.uint8).reshape(len(rows), t)
        bands = np.array([r["bands"] for r in rows], dtype=np.int64)
        right = np.flatnonzero(side != 1)
        own = self.key[1] == self.key[2]
        for i in np.flatnonzero(side != 2):
            others = right[(right > i) if own else slice(None)]
            others = others[comp[others] != comp[i]]
            others = others[(coords[others] == coords[i]).mean(axis=1) >= least]
            if rank:
                others = others[~(bands[others, :rank] == bands[i, :rank]).any(axis=1)]
            if len(others):
                yield i, others


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block = None
    for batch in portions(batches):
        for r in batch.to_pylist():
            key = (r["band"], r["b1"], r["b2"])
            if block is None or block.key != key:
                if block is not None:
                    yield block
                block = _Block(key)
            block.rows.append(r)
    if block is not None:
        yield block


def _rank(block: _Block) -> int:
    """The number of the band that the bucket belongs to."""
    return next(r["bands"].index(block.key[0]) for r in block.rows if block.key[0] in r["bands"])


def _possible(t: int, least: float):
    """Members of a block pair that have a possible partner in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            live = np.zeros(len(block.rows), dtype=bool)
            for i, others in block.pairs(t, least, _rank(block)):
                live[i] = True
                live[others] = True
            reps = [block.rows[i]["rep"] for i in np.flatnonzero(live)]
            n = len(reps)
            columns = [pa.array([v] * n, k) for v, k in zip(block.key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(reps, pa.int64())], names=["band", "b1", "b2", "rep"])

    return run


def _joining(t: int, least: float, words: int, percent: int):
    """Links of a block pair that join components, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for block in _blocks(batches):
            sets: dict[int, np.ndarray] = {}
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            us, vs = [], []
            rows = block.rows
            for r in rows:
                r["comp"] = int(r["comp"])
            for i, others in block.pairs(t, least, _rank(block)):
                for j in others.tolist():
                    a, b = root(rows[i]["comp"]), root(rows[j]["comp"])
                    if a == b:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = shingle_set((rows[k]["text"] or "").encode(), words, hashes)
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        parent[max(a, b)] = min(a, b)
                        us.append(rows[i]["rep"])
                        vs.append(rows[j]["rep"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    pivots: int = 3,
    block: int = 256,
) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash, chosen), one row per row of ``docs``.

    Words are runs free of blanks in the text with A-Z lower-cased; documents
    link when 100 * |A & B| >= percent * |A | B| for their sets of ``words``-word
    shingles. ``component_id`` is the smallest id reachable, ``kept`` marks it.
    With 32 bands of 5 rows, a pair at similarity 0.8 misses all bands with
    probability 3e-6. Texts that are null or free of words link with nothing.
    Rows that repeat an id are judged each by its own text; components that have
    only an id in common may show the same ``component_id``. ``text_hash`` and
    ``chosen`` tell them apart for ``keep_one``: chosen is the one text of a
    component, of the smallest id, that stays. Rows with a null id take no part:
    their component is null and they are kept.
    An empty table gives an empty result; ids must be integers.
    """
    t, least = bands * rows, percent / 100 - 0.18
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_hash(text_col).alias("text_hash"))
    drawn = stage(texts.mapInArrow(_sketches(words, bands, rows), "id long, text_hash long, n_shingles long, hi long, lo long, bands array<long>, coords binary"), "sketches")
    # All of a class have the same set, so the same bands and coordinates: any row's will do. Classes have keys of
    # their own, as several of them may have the same smallest id; written, the keys stay.
    classes = drawn.where("id is not null and hi is not null").groupBy("hi", "lo").agg(F.min(F.struct("id", "text_hash")).alias("own"), F.first("bands").alias("bands"), F.first("coords").alias("coords"))
    classes = stage(classes.select("hi", "lo", F.col("own.id").alias("own_id"), F.col("own.text_hash").alias("own_hash"), F.monotonically_increasing_id().alias("rep"), "bands", "coords"), "classes")
    owners = classes.select("rep", "own_id", "own_hash")
    members = classes.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high")
    buckets = stage(members.join(shared.select("band"), "band").distinct(), "buckets")
    coords = classes.select("rep", "coords")
    sizes = buckets.groupBy("band").agg(F.count("*").alias("size"))
    # How many others a class meets, over all its bands: the centre of a group of copies meets most.
    weights = stage(buckets.join(sizes, "band").groupBy("rep").agg(F.sum("size").alias("weight")), "weights")
    buckets = stage(buckets.join(weights, "rep"), "buckets")
    links: DataFrame | None = None
    labels: DataFrame | None = None
    tried: DataFrame | None = None
    pivoted: DataFrame | None = None
    near = _near(t, least)
    for _ in range(pivots):
        current = _labelled(buckets, labels)
        # A bucket in one component is finished.
        open_buckets = current.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(F.struct("comp", "weight", "rep"))["rep"].alias("late"), F.max(F.struct("weight", "rep"))["rep"].alias("central"))
        chosen = stage(open_buckets.where("c0 != c1").select("band", F.col("central" if labels is None else "late").alias("v")), "pivots")
        pivoted = chosen if pivoted is None else pivoted.unionByName(chosen)
        pairs = current.join(chosen, "band").where("rep != v").select(F.col("rep").alias("u"), "v").distinct()
        if labels is not None:
            pairs = _cross_only(pairs, labels)
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = stage(pairs, "pairs")
        if not pairs.limit(1).count():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        likely = pairs.join(coords.select(F.col("rep").alias("u"), F.col("coords").alias("cu")), "u").join(coords.select(F.col("rep").alias("v"), F.col("coords").alias("cv")), "v")
        likely = stage(likely.where(near("cu", "cv")).select("u", "v").distinct(), "pairs-near")
        confirmed = stage(confirm_links(texts, owners, likely, words, percent), "links")
        links = confirmed if links is None else links.unionByName(confirmed)
        labels = stage(components(links), "labels")
    if labels is not None:
        rest = stage(_remaining_links(texts, _labelled(buckets, labels), pivoted, classes, t, least, block, words, percent), "links")
        if rest.limit(1).count():
            labels = stage(components(links.unionByName(rest)), "labels")
    return _result(drawn, classes, labels, id_col, kind)


def _cross_only(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    left = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    right = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    return pairs.join(left, "u", "left").join(right, "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.select("band", "rep", "weight", F.col("rep").alias("comp"))
    own = labels.select(F.col("node").alias("rep"), F.col("component").alias("known"))
    return buckets.join(own, "rep", "left").select("band", "rep", "weight", F.coalesce("known", "rep").alias("comp"))


def _remaining_links(texts: DataFrame, current: DataFrame, pivoted: DataFrame, classes: DataFrame, t: int, least: float, block: int, words: int, percent: int) -> DataFrame:
    """Links across components in buckets that pivots left open, block against block."""
    open_buckets = current.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 != c1")
    n = F.ceil(F.col("size") / block).cast("int")
    # Pivots have been compared with the whole bucket.
    tested = pivoted.select("band", F.col("v").alias("rep"), F.lit(True).alias("was")).distinct()
    rows = current.join(open_buckets.select("band", n.alias("blocks")), "band").join(tested, ["band", "rep"], "left").where("was is null")
    rows = rows.join(classes.select("rep", "coords", "bands"), "rep")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # Each row goes to every pair of blocks that has its own: on side 1, side 2, or 0 for a block with itself.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("band", "rep", "comp", "coords", "bands", mine.alias("mine"), others)
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = stage(dealt.select("band", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "rep", "comp", "coords", "bands", side.alias("side")), "blocks")
    parts = int(current.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.repartition(parts, "band", "b1", "b2").sortWithinPartitions("band", "b1", "b2")

    possible = stage(grouped(dealt).mapInArrow(_possible(t, least), "band long, b1 int, b2 int, rep long"), "possible")
    live = dealt.join(possible, ["band", "b1", "b2", "rep"], "left_semi")
    return grouped(_with_text(texts, classes.select("rep", "own_id", "own_hash"), live)).mapInArrow(_joining(t, least, words, percent), "u long, v long")


def _result(drawn: DataFrame, classes: DataFrame, labels: DataFrame | None, id_col: str, kind: str) -> DataFrame:
    own = F.struct(F.col("own_id").alias("id"), F.col("own_hash").alias("text_hash"))
    reps = classes.select("hi", "lo", "rep", own.alias("own"))
    if labels is not None:
        # Only here do keys become ids: the smallest of the component, and the text that has it.
        smallest = labels.join(reps.select(F.col("rep").alias("node"), "own"), "node").groupBy("component").agg(F.min("own").alias("least"))
        known = labels.join(smallest, "component").select(F.col("node").alias("rep"), "least")
        reps = reps.join(known, "rep", "left").select("hi", "lo", F.coalesce("least", "own").alias("first"))
    else:
        reps = reps.select("hi", "lo", F.col("own").alias("first"))
    per_row = drawn.select("id", "text_hash", "n_shingles", "hi", "lo").join(reps.select(F.struct("hi", "lo", "first").alias("r")), (F.col("hi") == F.col("r.hi")) & (F.col("lo") == F.col("r.lo")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("r.first.id", "id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return per_row.select(
        F.col("id").cast(kind).alias(id_col),
        "n_shingles",
        component.cast(kind).alias("component_id"),
        kept.alias("kept"),
        "text_hash",
        (kept & F.coalesce(F.col("text_hash") == F.col("r.first.text_hash"), F.lit(True))).alias("chosen"),
    )


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def keep_one(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` chose, and those with a null id; of rows that repeat an id and its text, one."""
    chosen = result.where(F.col("chosen") & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), text_hash(text_col).alias("h"))
    chosen = stage(chosen.select(F.struct("_id", "_hash", "_rows").alias("k")), "kept")
    joined = rows.join(chosen.hint("shuffle_hash"), (F.col(f"d.`{id_col}`") == F.col("k._id")) & (F.col("h") == F.col("k._hash")))
    once, again = joined.where("k._rows = 1").select("d.*"), joined.where("k._rows > 1")
    out = once.unionByName(rows.where(F.col(f"d.`{id_col}`").isNull()).select("d.*"))
    if chosen.where("k._rows > 1").limit(1).count():
        out = out.unionByName(again.groupBy("k._id", "k._hash").agg(F.min_by("d", F.to_json("d")).alias("d")).select("d.*"))
    return out
