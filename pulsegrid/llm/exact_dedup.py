"""Exact deduplication by deterministic block naming (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, discard, numbered, table, without_chars, written

BLOCK_BYTES = 8192


def _two_hashes(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(7), block)


def _named(pairs: DataFrame, keys: list[str], keep: list[str], tag: str) -> DataFrame:
    """Distinct rows of ``keys``, cut to ``keep``, with an integer name each: their place in the order of ``keep``, whatever the partitions.

    Rows are made distinct before they are sorted into ranges, so equal ones, however many, meet after map-side aggregation.
    """
    distinct = written(pairs.select(*keys).distinct().select(*keep), f"{tag}-distinct")
    named = written(numbered(distinct, [], [F.col(k) for k in keep], f"{tag}-ranges").withColumnRenamed("_place", "name"), tag)
    discard(distinct)
    return named


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Callable[[Column], tuple[Column, Column]] = _two_hashes,
) -> DataFrame:
    """Find rows whose texts are equal once all white space is deleted.

    Each normalised text is cut into blocks of ``block_bytes`` UTF-8 bytes. Distinct blocks are sorted by fingerprint and
    named by their places, the same in every run; then adjacent names are paired, distinct pairs are named, and so on until each
    document has one name. (number of blocks, last name) is the document's identity: two documents share
    it exactly when their texts are equal. Block texts cross the network once, after map-side
    deduplication; names go back to their documents by a 128-bit fingerprint whose uniqueness over all
    distinct blocks is verified, else by the block's content.

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    Nulls: a null text counts as empty, a null id sorts last. Empty texts form one group. Repeated rows (same id) are
    separate rows, of which one stays. An empty table gives an empty result. Other columns are ignored,
    whatever their names.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), without_chars(text, SPACE_CHARS).alias("norm"))
    cut = src.select(
        "doc_id",
        "n_chars",
        F.sha2("norm", 256).alias("text_sha256"),
        F.expr(f"CASE WHEN norm = '' THEN array() ELSE transform(array_repeat(cast(norm AS binary), 1), b -> transform(sequence(0, cast((octet_length(b) - 1) div {block_bytes} AS int)), i -> substring(b, i * {block_bytes} + 1, {block_bytes})))[0] END").alias("blocks"),
    )
    h1, h2 = fingerprint(F.col("block"))
    blocks = cut.select(F.explode("blocks").alias("block")).select(h1.alias("h1"), h2.alias("h2"), "block")
    keys = ["h1", "h2"]
    names = _named(blocks, ["h1", "h2", "block"], keys, "block-names")
    if not names.groupBy(*keys).count().where("count > 1").isEmpty():
        # Two distinct blocks share a fingerprint: names go back by content as well.
        keys = ["h1", "h2", "block"]
        names = _named(blocks, keys, keys, "block-names-by-content")

    def part(block: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in zip(keys, (*fingerprint(block), block), strict=False)))

    base = written(cut.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", "text_sha256", F.transform("blocks", part).alias("parts")), "block-docs")
    size = F.size("parts")
    rows = base.select("rid", "doc_id", "n_chars", size.alias("n"), F.posexplode("parts").alias("pos", "part")).select("rid", "doc_id", "n_chars", "n", "pos", "part.*")
    rows = rows.join(names, keys).select("rid", "doc_id", "n_chars", "n", "pos", "name")
    done = [base.where(size == 0).select("rid", "doc_id", "n_chars", F.lit(0).alias("n"), F.lit(-1).cast("long").alias("name"))]
    rows = written(rows, "names-0")
    discard(names)
    done.append(rows.where("n = 1").drop("pos"))
    most = rows.agg(F.max("n")).first()[0] or 0
    level = 1
    while 2 ** (level - 1) < most:
        half = F.col("pos").bitwiseAND(1)
        pairs = (
            rows.where(F.col("n") > 2 ** (level - 1))
            .groupBy("rid", "doc_id", "n_chars", "n", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(half == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("r"))
        )
        pairs = written(pairs, f"pairs-{level}")
        names = _named(pairs, ["l", "r"], ["l", "r"], f"pair-names-{level}")
        rows = written(pairs.join(names, ["l", "r"]).select("rid", "doc_id", "n_chars", "n", "pos", "name"), f"names-{level}")
        discard(pairs, names)
        done.append(rows.where((F.col("n") > 2 ** (level - 1)) & (F.col("n") <= 2**level)).drop("pos"))
        level += 1
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("rid").alias("d"))
    groups = written(ids.groupBy("n", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("n", "name", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_rid"), "group_size")
    found = ids.select("rid", "n", "name").join(groups, ["n", "name"])
    return base.select("rid", "doc_id", "text_sha256").join(found, "rid").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
