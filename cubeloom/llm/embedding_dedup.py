"""Near-duplicate embeddings through a robust-pruned flat graph.

1. Equal vectors of a label are one class with a multiplicity.
2. Centroids are fitted to a bounded sample. A vector is at home in the shard
   of its nearest centroid and visits those whose border it is so near that a
   linked vector may lie behind it: of a linked pair, one visits the other's
   home. Shards never mix labels. The homes of a large shard are cut into pieces.
3. Every piece builds a graph of its homes: candidates are a node's nearest and
   some random nodes; robust pruning keeps a candidate unless one already kept is
   nearer to it by the factor alpha; reverse edges are added.
4. Homes and visitors of the shard search the graph. Entries are the nodes that
   a bound on a few projected components leaves; without any but itself a vector
   has no link there. Others search from these, the medoids and their own list,
   greedily towards themselves, and through everything within the (slackened)
   range.
5. What the search reaches is verified by its cosine in double precision, and so
   are the entries, as the bound passes every link. A pair whose vectors visit
   each other's home counts in the first one. Only counts and local components
   leave a task, never pairs; components join the shards' stars.

Vectors are kept as their own bytes and copied to the shards in rounds, each of
about COPIES_A_ROUND copies of the table, whose shuffle files go before the next.

``audit_recall`` compares with brute force for a sample of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import portions
from .components import components
from .staging import drop, shuffles_freed, stage
from .vectors import to_matrix

#: Vectors the centroids are fitted to, at most, and the most centroids.
FIT_ROWS, MOST_CENTROIDS = 8192, 1024
#: Homes of a shard aimed at, of a piece at most, and vectors that search a piece in one task at most (in expectation).
SHARD_ROWS, PIECE_ROWS, ASK_ROWS = 1500, 2048, 65536
#: Projected components of the bound, and copies of the table that a round shuffles (in expectation).
LEADING, COPIES_A_ROUND = 16, 1.0
NEAREST, RANDOM, DEGREE, ALPHA = 48, 8, 24, 1.2
#: The range is loosened by SLACK times what ``least`` leaves to 1.
SLACK, BEAM = 2.0, 0.02


def margin(least: float) -> float:
    """The angle of a pair at the threshold."""
    return float(np.arccos(np.clip(least, -1, 1))) + 1e-6


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 and whether each has a direction; scaled by its largest component first, so nothing overflows."""
    top = np.abs(m).max(axis=1, initial=0)
    ok = top > 0
    m = m / np.where(ok, top, 1)[:, None]
    return m / np.where(ok, np.sqrt((m**2).sum(axis=1)), 1)[:, None], ok


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        lengths = np.sqrt((sums**2).sum(axis=1))
        centres = np.where(lengths[:, None] > 0, sums / np.where(lengths > 0, lengths, 1)[:, None], centres)
    return centres


def spacing(centres: np.ndarray) -> np.ndarray:
    """Distances between centroids."""
    squares = (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (centres @ centres.T), 0))


def shards_of(x: np.ndarray, centres: np.ndarray, margin: float, apart: np.ndarray | None = None) -> list[list[int]]:
    """Each row's home, then the shards it visits.

    The border of two shards is the plane between their centroids. The distances
    to it of two vectors at home on either side sum to at most their own, the
    chord of ``margin``: the nearer one, within half of that, visits the other's home.
    """
    apart = spacing(centres) if apart is None else apart
    near = x @ centres.T
    home = near.argmax(axis=1)
    half = np.sin(min(margin, np.pi) / 2)
    # For centroids that all but coincide the distance is too small to be exact.
    visits = near[np.arange(len(x)), home][:, None] - near <= half * apart[home] + 1e-7
    visits[np.arange(len(x)), home] = False
    rows, columns = np.nonzero(visits)
    return [[h, *c] for h, c in zip(home.tolist(), (c.tolist() for c in np.split(columns, np.searchsorted(rows, np.arange(1, len(x))))), strict=True)]


def build_graph(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """Adjacency (rows, DEGREE) of a robust-pruned graph; -1 fills."""
    n = len(x)
    if n < 2:
        return np.full((n, DEGREE), -1, dtype=np.int32)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    distance = 1 - x @ x.T
    np.fill_diagonal(distance, np.inf)
    near = min(NEAREST, n - 1)
    cand = np.argpartition(distance, near - 1, axis=1)[:, :near]
    cand = np.concatenate([cand, rng.integers(0, n, (n, RANDOM))], axis=1)
    rows = np.arange(n)
    d = distance[rows[:, None], cand]
    adj = np.full((n, DEGREE), -1, dtype=np.int32)
    for k in range(DEGREE):
        pick = d.argmin(axis=1)
        ok = np.isfinite(d[rows, pick])
        if not ok.any():
            break
        kept = cand[rows, pick]
        adj[ok, k] = kept[ok]
        # Candidates that the kept node covers go, and the node itself.
        between = distance[kept[:, None], cand]
        d[(ALPHA * between <= d) | (cand == kept[:, None])] = np.inf
        d[~ok] = np.inf
    return adj


def with_reverse(adj: np.ndarray) -> list[np.ndarray]:
    n = len(adj)
    src, col = np.nonzero(adj >= 0)
    dst = adj[src, col]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    codes = np.unique(a.astype(np.int64) * n + b)
    return np.split(codes % n, np.searchsorted(codes // n, np.arange(1, n)))


def medoids(x: np.ndarray, extra: int = 3) -> list[int]:
    """The node nearest the mean, then nodes far from those before."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    while len(out) < min(extra + 1, len(x)):
        out.append(int((x @ x[out].T).max(axis=1).argmin()))
    return out


def range_search(x: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, starts: list[np.ndarray], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, nodes of cosine >= least) reached by range-expanding greedy search.

    A visited node is expanded while it is nearly the query's best so far or
    lies within the range loosened by SLACK.
    """
    slack = SLACK * (1 - least)
    sizes = np.array([len(a) for a in adjacency])
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, int)
    flat = np.concatenate(adjacency) if len(adjacency) else np.zeros(0, int)
    chunk = 128
    for at in range(0, len(queries), chunk):
        q = queries[at : at + chunk]
        seen = np.zeros((len(q), len(x)), dtype=bool)
        sims = np.full((len(q), len(x)), -2.0)
        best = np.full(len(q), -2.0)
        qs = np.repeat(np.arange(len(q)), [len(s) for s in starts[at : at + chunk]])
        ns = np.concatenate(starts[at : at + chunk]).astype(np.int64)
        while len(qs):
            codes = np.unique(qs * len(x) + ns)
            qs, ns = codes // len(x), codes % len(x)
            fresh = ~seen[qs, ns]
            qs, ns = qs[fresh], ns[fresh]
            if not len(qs):
                break
            seen[qs, ns] = True
            s = np.concatenate([np.einsum("ij,ij->i", q[qs[i : i + 50_000]], x[ns[i : i + 50_000]]) for i in range(0, len(qs), 50_000)])
            sims[qs, ns] = s
            np.maximum.at(best, qs, s)
            go = (s >= best[qs] - BEAM) | (s >= least - slack)
            qs, ns = qs[go], ns[go]
            count = sizes[ns]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            qs, ns = np.repeat(qs, count), flat[np.repeat(offsets[ns], count) + inner]
        for k in range(len(q)):
            yield at + k, np.flatnonzero(sims[k] >= least)


def _local_components(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable, by repeated minimum over pairs."""
    label = np.arange(n)
    if not pairs:
        return label
    a = np.concatenate([p[0] for p in pairs])
    b = np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _build(key, pdf):
    pdf = pdf.sort_values("rep", kind="stable")
    x, reps = np.stack(pdf["x"].to_numpy()), pdf["rep"].to_numpy()
    lists = with_reverse(build_graph(x))
    return pd.DataFrame({"rep": reps, "near": [reps[a] for a in lists]})


def _projection(width: int) -> np.ndarray:
    """Orthonormal columns, the same in every task; a pair's distance never grows by it."""
    return np.linalg.qr(np.random.default_rng(7).normal(size=(width, min(LEADING, width))))[0]


def _entries(nodes: np.ndarray, asks: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asks, nodes): the pairs whose projections are near enough for a cosine >= least."""
    turn = _projection(nodes.shape[1])
    a, b = ((m @ turn).astype(np.float32) for m in (asks, nodes))
    ends = np.concatenate([-2 * b, np.ones((len(b), 1), np.float32), (b**2).sum(axis=1)[:, None]], axis=1).T
    most = 2 - 2 * least + 1e-5
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        squares = np.concatenate([part, (part**2).sum(axis=1)[:, None], np.ones((len(part), 1), np.float32)], axis=1) @ ends
        some = np.flatnonzero(squares.min(axis=1) <= most)
        rows, columns = np.nonzero(squares[some] <= most)
        yield at + some[rows], columns


def _counted_before(a: np.ndarray, b: np.ndarray, cluster: int, clusters: np.ndarray) -> np.ndarray:
    """Whether a pair counts in an earlier shard: the home of one, which the other visits."""
    rows = np.unique(np.concatenate([a, b]))
    lists = [np.asarray(clusters[k], dtype=np.int64) for k in rows]
    home = np.array([c[0] for c in lists])
    there = np.repeat(rows << 32, [len(c) for c in lists]) + np.concatenate(lists)
    ha, hb = home[np.searchsorted(rows, a)], home[np.searchsorted(rows, b)]
    return ((ha < cluster) & np.isin((b << 32) + ha, there)) | ((hb < cluster) & np.isin((a << 32) + hb, there))


def _searcher(least: float):
    """Links and local components that piece ``second`` of a shard finds in piece ``first``. A row's ``clusters`` begin with its home."""

    def search(key, pdf):
        cluster, first, second = key[1], key[2], key[3]
        pdf = pdf.sort_values(["piece", "rep"])
        same = first == second
        reps, weight, clusters = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["clusters"].to_numpy()
        x = np.stack(pdf["x"].to_numpy())
        nodes = np.flatnonzero(pdf["piece"].to_numpy() == first)
        asks = nodes if same else np.flatnonzero(pdf["piece"].to_numpy() == second)
        links = np.zeros(len(reps), dtype=np.int64)
        pairs = []
        hits: list[np.ndarray] = []
        medoid = united = None

        def note(a, b):
            a, b = a[a != b], b[a != b]
            hits.append(np.minimum(a, b) * len(reps) + np.maximum(a, b))
            if len(hits) > 500:
                hits[:] = [np.unique(np.concatenate(hits))]

        for asked, entered in _entries(x[nodes], x[asks], least) if len(nodes) and len(asks) else ():
            other = asks[asked] != nodes[entered]
            asked, entered = asked[other], entered[other]
            if not len(asked):
                continue
            if medoid is None:
                # Nodes are sorted by rep.
                lists = [np.asarray(near) for near in pdf["near"].iloc[nodes]]
                flat = np.searchsorted(reps[nodes], np.concatenate(lists))
                united = np.split(flat, np.cumsum([len(near) for near in lists])[:-1])
                medoid = np.array(medoids(x[nodes]), dtype=np.int64)
            who, starts = np.unique(asked, return_index=True)
            # At most 256 entries start a search; all are verified.
            entry = [np.concatenate([medoid, e[:256], [k] if same else []]).astype(np.int64) for k, e in zip(who, np.split(entered, starts[1:]), strict=True)]
            for q, found in range_search(x[nodes], united, x[asks[who]], entry, least):
                note(np.full(len(found), asks[who[q]]), nodes[found])
            for at in range(0, len(asked), 50_000):
                a, b = asks[asked[at : at + 50_000]], nodes[entered[at : at + 50_000]]
                ok = np.einsum("ij,ij->i", x[a], x[b]) >= least
                note(a[ok], b[ok])
        codes = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        if not len(codes):
            return pd.DataFrame({"rep": reps, "links": links, "low": reps})
        for at in range(0, len(codes), 100_000):
            a, b = codes[at : at + 100_000] // len(reps), codes[at : at + 100_000] % len(reps)
            pairs.append((a, b))
            new = ~_counted_before(a, b, cluster, clusters)
            np.add.at(links, a[new], weight[b[new]])
            np.add.at(links, b[new], weight[a[new]])
        label = _local_components(len(reps), pairs)
        lowest = pd.Series(reps).groupby(label).transform("min").to_numpy()
        return pd.DataFrame({"rep": reps, "links": links, "low": lowest})

    return search


def _meeting(least: float, number: str):
    """The homes of a piece, and those who search it: ``asks`` marks visitors and homes of later pieces."""
    search = _searcher(least)

    def meet(key, pdf):
        _, cluster, first, part = key
        asks = pdf["asks"].to_numpy()
        raw = np.frombuffer(b"".join(pdf["x"]), dtype=number).reshape(len(pdf), -1)
        # Those without an entry find nothing; most visitors go here.
        homes = unit(raw[~asks].astype(np.float64))[0]
        stay = ~asks
        for at in range(0, len(raw) if len(homes) and asks.any() else 0, 4096):
            own = at + np.flatnonzero(asks[at : at + 4096])
            for asked, _ in _entries(homes, unit(raw[own].astype(np.float64))[0], least):
                stay[own[asked]] = True
        pdf, asks, m = pdf[stay], asks[stay], raw[stay].astype(np.float64)
        pdf = pdf.assign(
            x=list(unit(m)[0]), piece=np.where(asks, -1, first), clusters=pd.Series([[h] if a else c for h, a, c in zip(pdf["home"], asks, pdf["clusters"], strict=True)], index=pdf.index, dtype=object)
        )
        nodes = pdf[~asks].sort_values("rep", kind="stable")
        found = []
        if len(nodes):
            nodes["near"] = _build(key, nodes)["near"].to_numpy()
            if part == 0:
                found.append(search((key[0], cluster, first, first), nodes))
            if asks.any():
                found.append(search((key[0], cluster, first, -1), pd.concat([nodes, pdf[asks]])))
        out = pd.concat(found) if found else pd.DataFrame({"rep": [], "links": [], "low": []}, dtype="int64")
        return out[(out["links"] > 0) | (out["low"] != out["rep"])]

    return meet


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors of equal, non-null labels link when their cosine in double precision
    is at least ``least``. Those that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do rows whose label is null.
    Vectors of unlike lengths compare as if padded with zeros. Equal rows that
    repeat an id count as one vector per row in ``n_links``; rows with a null id
    take no part, with a null component, and are kept. An empty table gives an
    empty result.
    """
    with shuffles_freed(vectors.sparkSession):
        return _near_duplicate_vectors(vectors, id_col, vector_col, label_col, least)


def _near_duplicate_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, least: float) -> DataFrame:
    spark = vectors.sparkSession
    number = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    kind = vectors.schema[id_col].dataType.simpleString()
    label = F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # The hash passes over nulls, so vectors that hold some get none.
    whole = ~F.exists("v", lambda x: x.isNull())
    rows = rows.select("id", "label", "v", F.when(whole, F.xxhash64("v")).alias("h1"), F.when(whole, F.xxhash64(F.lit(1), F.col("v"))).alias("h2"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that take part, as the bytes of their components."""
        for batch in portions(batches, rows=2000):
            m, valid = to_matrix(batch.column(1))
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            ok = valid & (m != 0).any(axis=1)
            raw = m.astype(number)
            column = pa.array([raw[k, : sizes[k]].tobytes() for k in np.flatnonzero(ok)], pa.binary())
            keep = pa.array(ok)
            label, h1, h2, ids = (batch.column(k).filter(keep) for k in (0, 2, 3, 4))
            yield pa.RecordBatch.from_arrays([label, column, h1, h2, ids], names=["label", "x", "h1", "h2", "id"])

    drawn = rows.where("id is not null and label is not null and h1 is not null").select("label", "v", "h1", "h2", "id").mapInArrow(bounded, "label string, x binary, h1 long, h2 long, id long")
    classes = stage(drawn.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")), "vector-classes")
    shape = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels"), F.max(F.octet_length("x")).alias("bytes")).first()
    centroids = min(MOST_CENTROIDS, max(1, round(shape.n / max(1, shape.labels) / SHARD_ROWS)))
    sample = classes.select("x", "h1").orderBy("h1").limit(FIT_ROWS).select("x").toArrow().column("x").to_pylist()
    width = shape.bytes or 1

    def read(column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in column), dtype=number).reshape(len(column), -1).astype(np.float64)

    fitted = fit_centroids(unit(read(sample))[0], centroids) if sample else np.ones((1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = spacing(fitted)
        for batch in portions(batches, rows=500):
            column = batch.column(0).to_pylist()
            shards = shards_of(unit(read(column))[0], fitted, margin(least), apart)
            yield pa.RecordBatch.from_arrays([pa.array([v.ljust(width, b"\0") for v in column], pa.binary()), *batch.columns[1:], pa.array(shards, pa.list_(pa.int32()))], names=["x", "label", "h1", "h2", "rep", "copies", "clusters"])

    placed = stage(classes.select("x", "label", "h1", "h2", "rep", "copies").mapInArrow(assign, "x binary, label string, h1 long, h2 long, rep long, copies long, clusters array<int>"), "vector-shards")
    drop(classes)
    sizes = placed.select("label", F.posexplode("clusters").alias("place", "cluster")).groupBy("label", "cluster").agg(F.count_if(F.col("place") == 0).alias("homes"), F.count("*").alias("all"))
    cut = sizes.select("label", "cluster", F.ceil(F.col("homes") / PIECE_ROWS).cast("int").alias("pieces"), F.ceil(F.col("all") / ASK_ROWS).cast("int").alias("parts"))
    # Shards that stay whole need no row here, so the table is small beside the vectors.
    cut = stage(cut.where("pieces > 1 or parts > 1"), "shard-sizes").hint("broadcast")
    places = placed.agg(F.sum(F.size("clusters"))).first()[0] or 0
    rounds = max(1, int(np.ceil(places / max(1, shape.n) / COPIES_A_ROUND)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape_out = "rep long, links long, low long"
    found = None
    for turn in range(rounds):
        own = F.filter("clusters", lambda c: F.pmod(F.xxhash64("label", c), F.lit(rounds)) == turn)  # noqa: B023
        member = placed.select("label", "rep", "copies", "x", "clusters", F.explode(own).alias("cluster")).join(cut, ["label", "cluster"], "left")
        member = member.select("label", "cluster", "rep", "copies", "x", "clusters", F.col("clusters")[0].alias("home"), F.greatest(F.lit(1), F.coalesce("pieces", F.lit(1))).alias("pieces"), F.greatest(F.lit(1), F.coalesce("parts", F.lit(1))).alias("parts"))
        member = member.withColumns({"at_home": F.col("home") == F.col("cluster"), "piece": F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"), "part": F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int")})
        # A piece's homes go to all parts of those who search it; these are its visitors and the homes of later pieces.
        as_node = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.col("at_home")), lambda k: F.struct(F.col("piece").alias("first"), k.alias("part"), F.lit(False).alias("asks")))
        as_ask = F.transform(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: ~F.col("at_home") | (k < F.col("piece"))), lambda k: F.struct(k.alias("first"), F.col("part").alias("part"), F.lit(True).alias("asks")))
        met = member.withColumn("to", F.explode(F.concat(as_node, as_ask))).select(
            "label", "cluster", F.col("to.first").alias("first"), F.col("to.part").alias("part"), F.col("to.asks").alias("asks"), "rep", "copies", "x", "home", F.when(~F.col("to.asks"), F.col("clusters")).alias("clusters")
        )
        met = met.repartition(partitions, "label", "cluster", "first", "part").groupBy("label", "cluster", "first", "part").applyInPandas(_meeting(least, number), shape_out)
        part = stage(met, "vector-links")
        found = part if found is None else found.unionByName(part)
    labels = components(found.where("rep != low").select(F.col("rep").alias("u"), F.col("low").alias("v")).distinct())
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = stage(placed.select("label", "h1", "h2", "rep", "copies").join(linked, "rep", "left"), "vector-components")
    drop(placed)
    known = known.select(F.struct("label", "h1", "h2", "rep", "copies", "links", "component").alias("k"))
    slim = rows.select("id", "label", "h1", "h2")
    joined = slim.join(known, (F.col("label") == F.col("k.label")) & (F.col("h1") == F.col("k.h1")) & (F.col("h2") == F.col("k.h2")) & F.col("id").isNotNull(), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("k.component", "k.rep", "id"))
    n_links = F.coalesce(F.col("k.links"), F.lit(0)) + F.coalesce(F.col("k.copies") - 1, F.lit(0))
    return joined.select(F.col("id").cast(kind).alias(id_col), n_links.cast("long").alias("n_links"), component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, most: int = 2000) -> float:
    """Share of true links that ``result`` has, over at most ``most`` vectors whose hashed ids are divisible by ``every``.

    The sampled vectors go to all tasks and are compared with all rows by brute
    force. Rows without an id are left out.
    """
    named = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    picked = named.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id")).limit(most).toArrow()
    q, valid = to_matrix(picked.column(2).combine_chunks()) if len(picked) else (np.zeros((0, 1)), np.zeros(0, bool))
    q, ok = unit(np.where(valid[:, None], q, 0))
    ids = np.array(picked.column(0).to_pylist(), dtype=np.int64)
    codes = {name: k for k, name in enumerate(dict.fromkeys(n for n in picked.column(1).to_pylist() if n is not None))}
    labels = np.array([codes.get(n, -1) for n in picked.column(1).to_pylist()], dtype=np.int64)
    usable = valid & ok & (labels >= 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in portions(batches, rows=1000):
            m, good = to_matrix(batch.column(2))
            x, there = unit(np.where(good[:, None], m, 0))
            wide = max(x.shape[1], q.shape[1])
            s = np.pad(q, ((0, 0), (0, wide - q.shape[1]))) @ np.pad(x, ((0, 0), (0, wide - x.shape[1]))).T
            own = np.array([codes.get(n, -2) for n in batch.column(1).to_pylist()], dtype=np.int64)
            hit = (s >= least) & (good & there)[None, :] & usable[:, None] & (labels[:, None] == own[None, :]) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
            total += hit.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "links"])

    truth = named.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("true"))
    both = truth.join(result.select(F.col(id_col).cast("long").alias("id"), "n_links"), "id").agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return 1.0 if not both[0] else both[1] / both[0]
