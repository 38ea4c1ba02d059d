"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A source's target may be several times its size: whole epochs come first, and
what remains is filled by a weighted sample without replacement. Each document
draws an exponential key -ln(u)/w from a hash of its id and the seed, w being
its quality weight; documents are taken in key order until the running sum of
their sizes reaches the budget. The one document that crosses it gives only the
words that still fit, so a source meets its target to the word.

Sizes and weights are computed in one pass over the texts; everything after
moves a few numbers per document. Running sums come from ``ranks.running``, so
a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running
from .staging import stage
from .texts import first_words, letter_bytes, word_count


def measure(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, letters, bytes, text_hash): words (runs free of blanks) and letter bytes of every whole text."""

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        letter_bytes(text).alias("letters"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        _text_hash(text_col).alias("text_hash"),
    )


def letter_share() -> Column:
    """Quality weight in 0.05..1: the share of letters among a text's bytes; prose is near 0.8, markup and junk lower."""
    return F.greatest(F.lit(0.05), F.col("letters") / F.greatest(F.col("bytes"), F.lit(1)))


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u)/w with u in (0, 1) from 52 bits of the md5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source_key, source_size, target): budgets proportional to weights, none above ``most`` times its source.

    The common level L solves sum(min(most * size, L * weight)) = share * total.
    Sources sorted by most * size / weight fill up in that order, so L follows
    from running sums over the table of sources. That table, with one row per
    source, is windowed as a whole; it doesn't grow with the documents.
    """
    per = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    fill = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stepped = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(fill), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))).alias("open_weight"),
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("total"),
    )
    # The level if this source and all after it stay below their caps; the first for which that holds is the level.
    level = F.when((F.col("total") - F.col("capped")) / F.col("open_weight") <= F.col("cap") / F.col("weight"), (F.col("total") - F.col("capped")) / F.col("open_weight"))
    levelled = stepped.withColumn("level", level).withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("cap") / F.col("weight"))).over(everything))
    return levelled.select("source_key", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """One row (id, source, size, source_size, target, taken, text_hash) per row of ``docs``.

    ``weights`` repeat over the sources in code-point order, null last; together
    sources get ``share`` times all words, none more than ``most`` times its
    own. ``taken`` is the number of words used, repeats counted: whole epochs
    plus, for sampled documents, one more whole pass or the words that still fit.
    ``quality`` is an expression over (size, letters, bytes); by default the
    share of letters. Null and empty texts have size 0 and give nothing. Rows
    that repeat an id, or have none, are ordered by size and ``text_hash``, by
    which ``draw`` knows them again; equal ones share a key and are taken one
    after the other. An empty table gives an empty result. Reruns agree.
    """
    sizes = stage(measure(docs, id_col, source_col, text_col), "mix-sizes")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    weight = quality if quality is not None else letter_share()
    keyed = sizes.select("id", "source", key.alias("source_key"), "size", exponential_key(F.col("id"), weight, seed).alias("es_key"), "text_hash")
    # Written, the table's true size is known, and the join broadcasts it only if that is small.
    targets = stage(source_targets(keyed, weights, share, most), "mix-targets")
    placed = running(keyed, "source_key", [F.col("es_key"), F.col("id"), F.col("size"), F.col("text_hash")], "size")
    joined = placed.join(targets, "source_key")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    budget = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("before")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "text_hash")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _row_key(id_col: str, text_hash: Column, source_col: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("n")), text_hash.cast("string"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")))


def _numbered(rows: DataFrame) -> DataFrame:
    """(k, at) with ``place``, the number of rows of the key before; a key with many rows is dealt to many tasks."""
    return running(rows.select("k", "at", F.lit(1).cast("long").alias("one")), "k", [F.col("at")], "one").select("k", "at", "place")


def draw(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as ``mixed`` takes them: a row per whole pass, and one cut to the words that still fit.

    Rows are known by id, text and source, so ids may repeat or be null; of rows
    equal in all three each gets the share of one of them. Documents of which
    nothing is taken go.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), _row_key(id_col, _text_hash(text_col), source_col).alias("k"))
    keyed = mixed.select(_row_key(id_col, F.col("text_hash"), source_col).alias("k"), "size", "taken")
    plan = stage(keyed.groupBy("k").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("taken").alias("taken")).where("taken > 0"), "draw-plan")
    single = plan.where("n = 1").select(F.struct("k", "size", "taken").alias("m"))
    joined = rows.join(single.hint("shuffle_hash"), F.col("k") == F.col("m.k")).select("d", "m")
    repeated = plan.where("n > 1").select("k")
    if repeated.limit(1).count():
        held = stage(rows.join(repeated, "k").withColumn("at", F.monotonically_increasing_id()), "draw-rows")
        wanted = stage(keyed.where("taken > 0").join(repeated, "k").withColumn("at", F.monotonically_increasing_id()), "draw-shares")
        shares = _numbered(wanted).join(wanted.select("at", "size", "taken"), "at").select("k", "place", F.struct("k", "size", "taken").alias("m"))
        places = _numbered(held).join(shares, ["k", "place"]).select("at", "m")
        joined = joined.unionByName(held.join(places, "at").select("d", "m"))
    whole = F.floor(F.col("m.taken") / F.greatest(F.col("m.size"), F.lit(1))).cast("int")
    joined = joined.select("d", F.struct(whole.alias("whole"), (F.col("m.taken") - whole * F.col("m.size")).alias("rest")).alias("m"))
    passes = F.when(F.col("m.whole") > 0, F.array_repeat(F.lit(0).cast("long"), F.col("m.whole"))).otherwise(F.array().cast("array<long>"))
    last = F.when(F.col("m.rest") > 0, F.array(F.col("m.rest"))).otherwise(F.array().cast("array<long>"))
    each = joined.select("d", F.explode(F.concat(passes, last)).alias("cut"))

    # Evaluated for the few rows with a cut only.
    whole_text = F.col(f"d.`{text_col}`").cast("string")
    text = F.when(F.col("cut") > 0, first_words(whole_text, F.col("cut"))).otherwise(whole_text)
    return each.select(*[(text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in own])
