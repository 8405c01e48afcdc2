"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank_spaced, keyed, numbered, table, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 128
SHARD_WORDS = 1 << 20
SEED = 17


def n_words(text: Column) -> Column:
    """Number of runs of non-white-space code points; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def beside_totals(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """``rows`` with aggregates over their group of ``keys`` (over all rows without keys), joined back, so that no task holds a group."""
    sums = rows.groupBy(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys))).agg(*(c.alias(n) for n, c in totals.items()))
    if not keys:
        return rows.join(F.broadcast(sums))  # one row
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(sums, on).drop(*(f"_g{i}" for i in range(len(keys))))


def sainte_lague(rows: DataFrame, keys: list[str], order: list[str], votes: str, seats: str, out: str, most: str | None = None) -> DataFrame:
    """Apportion ``seats`` among the rows of each group of ``keys`` by highest quotients votes / (2 j + 1); ties go by ``order``, which tells rows of a group apart.

    Seats that a row surely gets are granted at once: with V votes, S seats and m rows in a group, a row
    with v votes starts at s0 = round(v S / V) and can only move by d = ceil(m v / V) + 2 seats, so only
    its quotients s0 - d to s0 + d compete. That makes at most about 7 m quotients a group, however many seats there are; they are
    numbered over all tasks. Rows without votes get no seat. A row that has as many seats as its column ``most`` says gets no more; the next highest quotients do.
    """
    v = F.col(votes)
    limit = F.col(most) if most else F.lit((1 << 62) - 1)
    start = beside_totals(rows, keys, _total=F.sum(v), _m=F.count("*"))
    start = start.withColumn("_s0", F.when(v > 0, F.floor(v * F.col(seats) / F.col("_total") + 0.5)).otherwise(0).cast("long"))
    start = start.withColumn("_d", F.when(v > 0, F.ceil(F.col("_m") * v / F.col("_total")) + 2).otherwise(0).cast("long"))
    start = written(start.withColumn("_lo", F.least(limit, F.greatest(F.lit(0), F.col("_s0") - F.col("_d")))), "seats-start")
    left = beside_totals(start, keys, _sure=F.sum("_lo")).withColumn("_left", F.col(seats) - F.col("_sure"))
    cand = left.where((v > 0) & (F.col("_lo") < limit)).withColumn("_j", F.explode(F.sequence("_lo", F.least(limit - 1, F.col("_s0") + F.col("_d")))))
    cand = cand.withColumn("_q", -(v / (2 * F.col("_j") + 1))).select(*keys, *order, "_j", "_q", "_left")
    won = numbered(cand, keys, [F.col("_q"), *(F.col(c) for c in order), F.col("_j")], "seats-quotients").where(F.col("_place") <= F.col("_left"))
    names = [*keys, *order]
    got = won.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(names))).agg(F.count("*").alias("_won"))
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return start.join(got, on, "left").withColumn(out, F.col("_lo") + F.coalesce("_won", F.lit(0))).select(*rows.columns, out)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): ``weights`` in code-point order of the names, null last, repeating.

    Together the targets make the sum of all sizes. Each stops at max_repeats times its source's size; what
    is above goes to the others by weight. That is filling to one level: with the sources by rising
    max_repeats * size / weight, a source is at its stop exactly while all before it are and the level
    that the rest would share reaches it.
    """
    name = [F.col("source").isNull(), F.col("source")]
    cycle = F.array(*(F.lit(float(x)) for x in weights))
    s = numbered(sizes, [], name, "mix-names").withColumn("weight", F.element_at(cycle, ((F.col("_place") - 1) % len(weights) + 1).cast("int"))).drop("_place")
    s = s.withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    s = numbered(s, [], [F.col("cap") / F.col("weight"), *name], "mix-rising", caps="cap", weights="weight")
    s = written(beside_totals(s, [], all_size=F.sum("source_size"), all_weight=F.sum("weight")), "mix-levels")
    s = s.withColumn("level", (F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights")))
    open_ = F.col("cap") > F.col("weight") * F.col("level")
    s = beside_totals(s, [], first=F.min(F.when(open_, F.struct("_place", "level"))))
    target = F.when(F.col("first").isNull() | (F.col("_place") < F.col("first._place")), F.col("cap")).otherwise(F.col("weight") * F.col("first.level"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document the mix takes.

    A source's documents are dealt by a seeded hash of id and text to shards of about ``shard_words`` words, so a
    hot source has many. In a shard they stand in seeded order, and their words in a row are cut into blocks of
    equally many words, near ``block_words``. Sainte-Laguë apportionment gives sources, and within each its
    shards, integer numbers of blocks. A shard with n blocks and a quota q takes every block q div n times, and
    a run of q mod n blocks from a seeded start, in a circle, once more; so nearly all documents are taken whole.
    ``first_word`` to ``last_word`` (0-based, end exclusive, and a second run when the circle closes within a document)
    say which words of the document are in that run.

    Nulls: a null text has no words; null sources are one source, last in order; null and repeated ids are told apart by text,
    rows alike in both keep their order by row. Empty texts take 0. Repeated rows are separate documents. Ties in the seeded order go
    by id, then row. An empty table gives an empty result. Other columns are ignored; those of ``keep`` go through.

    Returns doc_id, size, source_size, target, taken, passes, first_word, last_word, first_word2, last_word2, *keep.
    """
    base = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("seeded"), *(F.col(c).alias(f"keep_{c}") for c in keep)), "mix-sizes")
    targets = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "mix-targets")
    named = targets.withColumnsRenamed({"source": "_source"}).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    key = F.col("seeded")
    rows = base.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight").withColumn("shard", F.pmod(key, F.col("n_shards")))
    shards = rows.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block_words))
    shards = written(shards, "mix-shards")
    per_source = shards.groupBy("source", "target", "source_size").agg(F.sum("blocks").alias("all_blocks"))
    per_source = per_source.withColumn("votes", F.col("target") * F.col("all_blocks") / F.col("source_size"))
    per_source = per_source.withColumn("most", max_repeats * F.col("all_blocks"))
    per_source = written(beside_totals(per_source, [], seats=F.round(F.sum("votes")).cast("long")), "mix-votes")
    quota = sainte_lague(per_source, [], ["source"], "votes", "seats", "source_blocks", "most")
    quota = quota.select(F.col("source").alias("_source"), "source_blocks")
    shards = shards.join(quota, F.col("source").eqNullSafe(F.col("_source"))).select("source", "shard", "words", "blocks", "source_blocks", (max_repeats * F.col("blocks")).alias("most"))
    shards = sainte_lague(shards, ["source"], ["shard"], "words", "source_blocks", "quota", "most")
    q, n, words = F.col("quota"), F.col("blocks"), F.col("words")
    begin = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source", "shard"), n)
    edge = lambda b: F.floor(b * words / n)
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "words", F.floor(q / n).alias("passes"), edge(begin).alias("run_from"), (F.when(begin + q % n >= n, words + edge(begin + q % n - n)).otherwise(edge(begin + q % n))).alias("run_to"))
    shards = written(shards, "mix-quotas")

    seeded = Window.partitionBy("source", "shard").orderBy(key, F.col("doc_id"), "rid")
    placed = rows.where("size > 0").withColumn("to", F.sum("size").over(seeded)).withColumn("from", F.col("to") - F.col("size"))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")

    def part(shift: Column) -> tuple[Column, Column]:
        a = F.greatest(F.col("from") + shift, "run_from") - shift - F.col("from")
        b = F.least(F.col("to") + shift, "run_to") - shift - F.col("from")
        return a, F.greatest(a, b)

    (a, b), (a2, b2) = part(F.lit(0)), part(F.col("words"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "passes", "first_word", "last_word", "first_word2", "last_word2", *(f"keep_{c}" for c in keep)]
    placed = placed.withColumns({"first_word": a, "last_word": b, "first_word2": a2, "last_word2": b2}).withColumn("taken", F.col("passes") * F.col("size") + F.col("last_word") - F.col("first_word") + F.col("last_word2") - F.col("first_word2"))
    none = rows.where("size = 0").withColumns({c: F.lit(0).cast("long") for c in ("taken", "passes", "first_word", "last_word", "first_word2", "last_word2")})
    out = placed.select(*columns).unionByName(none.select(*columns))
    return out.withColumnsRenamed({f"keep_{c}": c for c in keep})


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns as they were, each as often as the mix takes it.

    A whole pass over a document repeats its row; where the last run of blocks begins or ends within a document (at
    most twice a shard, thrice where the run closes its circle), a row holds just the words of the run, joined by blanks.
    Documents of which no word is taken, empty ones included, are left out.
    """
    cols = docs.columns
    source, key = keyed(docs, id_col)
    renamed = source.select(F.col(key).alias("doc_id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(cols)))
    text, origin = (f"c{cols.index(c)}" for c in (text_col, source_col))
    plan = mix_sources(renamed, "doc_id", text, origin, **options).where("taken > 0")
    plan = written(plan.select("doc_id", "size", "passes", "first_word", "last_word", "first_word2", "last_word2"), "mix-plan")
    rows = renamed.join(plan, "doc_id")
    words = F.array_remove(F.split(blank_spaced(F.col(text)), " "), "")

    def run(a: str, b: str) -> Column:
        n = F.col(b) - F.col(a)
        cut = F.array_join(F.slice(words, (F.col(a) + 1).cast("int"), n.cast("int")), " ")
        return F.when(n >= F.col("size"), F.col(text)).when(n > 0, cut)

    copies = F.array_compact(F.concat(F.array_repeat(F.col(text), F.col("passes").cast("int")), F.array(run("first_word", "last_word"), run("first_word2", "last_word2"))))
    rows = rows.withColumn(text, F.explode(copies))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
