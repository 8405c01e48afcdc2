"""MinHash near-deduplication by an inverted join over signature coordinates.

A document is posted under each of its signature's (coordinate, value) pairs. Two documents whose signatures agree in T of K coordinates share
one of the K - T + 1 rarest of either's pairs, so only that prefix is merged, and long lists of frequent pairs are skipped.
Documents with fewer than T pairs that any other shares have no partner. For pairs that the lists propose all collisions are counted, those
with T or more stay, and these are confirmed on the full shingle sets.

A list's members are first compared with the list's most central document, which is one pair a document and settles most of a
group of near copies; only members that are in different components after that are compared with each other. In lists of up to LONG_LIST
members all such pairs are proposed, which is at most so many a posting. Members of longer lists must besides share one
of their rarest shingles, as many as exact bounds on sizes and places ask for (prefix and positional filters of set joins): text around a template
that many documents share then proposes no pairs through the template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import discard, table, written
from .components import connected_components

SIMILAR = 75
#: Coordinates and matches. Of pairs at similarity 0.75 a share of 4.4e-5 has fewer matches, of pairs at 0.8 one of 3.2e-7.
K, T = 64, 34
#: Lists of more members propose only pairs that share a rare shingle. Which lists are long changes the work, not the result.
LONG_LIST = 64


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 0, sets: bool = False) -> DataFrame:
    """rid, doc_id, n (distinct shingles), print1, print2 of each row, its MinHash signature of ``k`` coordinates, and with ``sets`` the hashes themselves."""
    rows = _columns(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in shingles.text_runs(batch.column(2)):
                hashes, sizes = shingles.shingle_sets(data, offsets)
                prints = shingles.set_prints(hashes, sizes).view(np.int64)
                part = batch.slice(a, b - a)
                columns = [part.column(0), part.column(1), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1])]
                names = ["rid", "doc_id", "n", "print1", "print2"]
                if k:
                    columns.append(lists(shingles.signatures(hashes, sizes, k).ravel(), np.full(len(sizes), k)))
                    names.append("signature")
                if sets:
                    columns.append(lists(hashes, sizes))
                    names.append("hashes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", signature array<long>" * bool(k) + ", hashes array<long>" * sets
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n long, print1 long, print2 long{more}")


def _similar(o: Column, n1: Column, n2: Column, similar: int) -> Column:
    return 100 * o >= similar * (n1 + n2 - o)


def near_components(reps: DataFrame, docs: DataFrame, similar: int = SIMILAR, k: int = K, t: int = T, long_list: int = LONG_LIST) -> DataFrame:
    """(node, component) of the representatives that have a partner. ``reps``: rep, doc_id, n, print1, print2, signature; ``docs``: doc_id, text."""
    pairs = reps.select("rep", F.posexplode("signature").alias("c", "value")).select("rep", F.xxhash64("c", "value").alias("token"))
    counts = written(pairs.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "near-counts")
    shared = pairs.join(counts, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens")).where(F.size("tokens") >= t)
    tokens = shared.select("rep", F.transform("tokens", lambda x: x["token"]).alias("tokens"))
    candidates = written(tokens.join(reps.drop("signature"), "rep"), "near-candidates")
    discard(counts)

    # Full sets of the candidates; shingles that no other candidate has are counted but not kept, as they match nothing.
    wanted = candidates.select(F.col("doc_id").alias("_id")).distinct()
    found = shingle_table(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), sets=True)
    sets = found.drop("rid", "doc_id").dropDuplicates(["n", "print1", "print2"]).join(candidates.select("rep", "n", "print1", "print2"), ["n", "print1", "print2"])
    exploded = written(sets.select("rep", "n", F.explode("hashes").alias("h")), "near-shingles")
    twice = written(exploded.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-shared")
    kept = exploded.join(twice, "h").groupBy("rep", "n").agg(F.collect_list("h").alias("hashes"))
    kept = kept.withColumn("m", F.size("hashes").cast("long")).where(100 * F.col("m") >= similar * F.col("n"))
    kept = written(kept.join(candidates.select("rep", "tokens"), "rep"), "near-sets")
    discard(exploded, candidates)
    prefix = F.slice("tokens", 1, F.size("tokens") - t + 1)
    postings = written(kept.select("rep", "n", "m", F.explode(prefix).alias("token")), "near-postings")

    # One pair for each document: with the most central document of its lists, the one with the largest share of shared shingles.
    rank = F.struct((F.col("m") / F.col("n")).alias("ratio"), (-F.col("rep")).alias("first"), F.col("n").alias("hn"), F.col("m").alias("hm"))
    hubs = written(postings.groupBy("token").agg(F.max(rank).alias("hub"), F.count("*").alias("size")).where("size > 1"), "near-hubs")
    fits = _similar(F.least("m", "hub.hm"), F.col("n"), F.col("hub.hn"), similar) & (F.col("hub.first") != -F.col("rep"))
    best = postings.join(hubs, "token").where(fits).groupBy("rep").agg(F.max("hub").alias("hub")).select("rep", (-F.col("hub.first")).alias("hub"))
    best = written(best, "near-best")
    star = written(_overlaps(_collisions(best, kept), kept), "near-star")
    linked = (F.col("collisions") >= t) & _similar(F.col("o"), F.col("n"), F.col("hn"), similar)
    links = star.where(linked).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    first = written(connected_components(links), "near-first")

    # Members of other components than their list's hub, against all members that exact bounds leave open.
    overlap = star.select("rep", "hub", "o").unionByName(star.select(F.col("hub").alias("rep"), "hub", F.col("hn").alias("o")).distinct().join(star.select("rep"), "rep", "left_anti"))
    scalars = overlap.groupBy("rep").agg(F.max("hub").alias("hub"), F.max_by("o", "hub").alias("o"))
    facts = postings.join(hubs.select("token", "size", (-F.col("hub.first")).alias("list_hub")), "token").join(scalars, "rep", "left")
    comp = lambda x: F.coalesce(F.col(x), F.col("rep"))
    facts = facts.join(first.withColumnsRenamed({"node": "rep", "component": "_c"}), "rep", "left").withColumn("comp", comp("_c")).drop("_c")
    hub_comp = first.select(F.col("node").alias("list_hub"), F.col("component").alias("_hc"))
    facts = facts.join(hub_comp, "list_hub", "left").withColumn("outside", F.col("comp") != F.coalesce("_hc", "list_hub")).drop("_hc", "list_hub")
    facts = written(facts, "near-facts")
    discard(postings, hubs, best, first)
    few = _pairs_of_short_lists(facts.where(F.col("size") <= long_list).drop("size"), similar)
    many = _pairs_of_long_lists(facts.where(F.col("size") > long_list), kept, twice, similar)
    rest = written(few.unionByName(many).distinct(), "near-rest")
    matched = written(_collisions(rest, kept).where(F.col("collisions") >= t), "near-matched")
    more = _overlaps(matched, kept).where(linked).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    out = connected_components(links.unionByName(written(more, "near-more")))
    discard(star, facts, rest, matched, kept, twice)
    return out


def _pairs_of_short_lists(facts: DataFrame, similar: int) -> DataFrame:
    """Pairs (rep, hub) of members of one list that are in different components and that bounds leave open."""
    x, y = (facts.select(*(F.col(c).alias(f"{c}_{s}") for c in facts.columns)) for s in "xy")
    x = x.where("outside_x")
    most = F.least("m_x", "m_y")
    by_hub = F.least("o_x", "o_y") + F.least(F.col("m_x") - F.col("o_x"), F.col("m_y") - F.col("o_y"))
    most = F.when(F.col("hub_x") == F.col("hub_y"), F.least(most, by_hub)).otherwise(most)
    open_ = (F.col("token_x") == F.col("token_y")) & (F.col("comp_x") != F.col("comp_y")) & (~F.col("outside_y") | (F.col("rep_x") < F.col("rep_y"))) & _similar(most, F.col("n_x"), F.col("n_y"), similar)
    return x.join(y, open_).select(F.least("rep_x", "rep_y").alias("rep"), F.greatest("rep_x", "rep_y").alias("hub"))


def _pairs_of_long_lists(facts: DataFrame, kept: DataFrame, twice: DataFrame, similar: int) -> DataFrame:
    """Pairs (rep, hub) of members of long lists that are in different components and share one of their rarest shingles.

    With all shingles in one order, rarest first, let the first that x and a smaller or equal y share be at places p and q (from 0). Then at most
    n_x - p and n_y - q are shared. A link shares at least similar % of n_x and 2 similar / (100 + similar) of n_y, which bounds both places, and
    similar / (100 + similar) of n_x + n_y. Shingles that no other candidate has stand in front of all others.
    """
    long = facts.groupBy("token").agg(F.max("outside").alias("any")).where("any").select("token")
    members = facts.join(long, "token").groupBy("rep", "n", "m", "comp").agg(F.max("outside").alias("out"))
    rare = members.join(kept.select("rep", F.explode("hashes").alias("h")), "rep").join(twice, "h")
    rare = rare.groupBy("rep", "n", "m", "comp", "out").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("rare"))
    larger = F.col("m") - F.ceil(similar * F.col("n") / 100) + 1
    smaller = F.col("m") - F.ceil(2 * similar * F.col("n") / (100 + similar)) + 1
    placed = rare.select("rep", "n", "m", "comp", "out", smaller.alias("places"), F.posexplode(F.slice("rare", 1, F.greatest(F.lit(0), larger).cast("int"))).alias("place", "shingle"))
    placed = placed.select("rep", "n", "comp", "out", (F.col("n") - F.col("m") + F.col("place")).alias("p"), (F.col("place") < F.col("places")).alias("early"), F.col("shingle.h").alias("h"))
    placed = written(placed, "near-places")
    x, y = (placed.select(*(F.col(c).alias(f"{c}_{s}") for c in placed.columns)) for s in "xy")
    y = y.where("early_y")
    most = F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y"))
    open_ = (F.col("h_x") == F.col("h_y")) & (F.col("comp_x") != F.col("comp_y")) & ((F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("rep_y") < F.col("rep_x")))) & _similar(most, F.col("n_x"), F.col("n_y"), similar)
    both = x.where("out_x").join(y, open_).unionByName(x.where("not out_x").join(y.where("out_y"), open_))
    return both.select(F.least("rep_x", "rep_y").alias("rep"), F.greatest("rep_x", "rep_y").alias("hub"))


def _collisions(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """``pairs`` (rep, hub) with the number of coordinates in which their signatures agree."""
    left = kept.select("rep", F.col("tokens").alias("_x"))
    right = kept.select(F.col("rep").alias("hub"), F.col("tokens").alias("_y"))
    return pairs.join(left, "rep").join(right, "hub").select("rep", "hub", F.size(F.array_intersect("_x", "_y")).cast("long").alias("collisions"))


def _overlaps(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """``pairs`` (rep, hub, ...) with both set sizes (n, hn) and the size of the intersection (o)."""
    left = kept.select("rep", "n", F.col("hashes").alias("_x"))
    right = kept.select(F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("hashes").alias("_y"))
    return pairs.join(left, "rep").join(right, "hub").select(*pairs.columns, "n", "hn", F.size(F.array_intersect("_x", "_y")).cast("long").alias("o"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, k: int = K, t: int = T) -> DataFrame:
    """Components of documents under links of 100 * intersection >= ``similar`` * union of their shingle sets.

    Rows with equal sets are one representative, whatever their number. A linked pair at similarity 0.75 agrees in fewer than 34 of 64
    coordinates, and so goes unseen, with a chance of 4.4e-5, and at 0.8 of 3.2e-7; every reported link is confirmed.

    Nulls: a null text counts as empty; empty texts have no shingles and are linked with nothing. A null id sorts after all others. Repeated rows
    share a component. An empty table gives an empty result. Other columns are ignored.

    Returns doc_id, n_shingles, component_id (smallest id of the component), kept (doc_id = component_id; for null ids, where no id is smaller).
    """
    source = _columns(docs, id_col, text_col)
    base = written(shingle_table(docs, id_col, text_col, k=k), "near-base")
    full = base.where("n > 0")
    reps = written(full.groupBy("n", "print1", "print2").agg(F.min("rid").alias("rep")), "near-reps")
    with_signature = reps.join(full.select(F.col("rid").alias("rep"), "doc_id", "signature"), "rep")
    comps = written(near_components(with_signature, source, similar, k, t), "near-components")
    named = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("n", "print1", "print2", F.coalesce("component", "rep").alias("component"))
    named = written(named, "near-named")
    rows = full.select("rid", "doc_id", "n", "print1", "print2").join(named, ["n", "print1", "print2"]).select("doc_id", "n", "component")
    rows = written(rows.unionByName(base.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component"))), "near-rows")
    discard(base, reps, comps, named)
    least = written(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-least")
    out = rows.where("component is not null").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(rows.where("component is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
