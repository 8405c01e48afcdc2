"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import components, exact_dedup, near_dedup, shingles

from . import fixtures as fx


def clashing_fingerprint(block):
    return F.length(block).cast("long"), F.lit(0).cast("long")


@pytest.mark.parametrize("block_bytes", [64, exact_dedup.BLOCK_BYTES])
@pytest.mark.parametrize("fingerprint", [exact_dedup._two_hashes, clashing_fingerprint])
def test_exact(spark, block_bytes, fingerprint):
    docs = fx.documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), i is None, i or 0, i))
    want = sorted(repr((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())) for i, t in rows)
    got = exact_dedup.exact_dedup(docs, block_bytes=block_bytes, fingerprint=fingerprint).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_names_do_not_depend_on_partitions(spark):
    names = []
    for parts in (1, 5):
        blocks = spark.createDataFrame([(f"b{i * i % 37}",) for i in range(100)], "block string").repartition(parts)
        h1, h2 = exact_dedup._two_hashes(F.col("block"))
        found = exact_dedup._named(blocks.select(h1.alias("h1"), h2.alias("h2"), "block"), ["h1", "h2", "block"], ["h1", "h2"], "test").collect()
        names.append({(r.h1, r.h2): r["name"] for r in found})
    assert names[0] == names[1] and sorted(names[0].values()) == list(range(1, len(names[0]) + 1))


def test_exact_sql(spark, duck, sf_dir):
    got = exact_dedup.op4_exact_dedup(spark, sf_dir).toPandas()
    want = duck.execute(exact_dedup.ORACLE_SQL).df()
    columns = sorted(got.columns)
    assert got[columns].sort_values("doc_id").values.tolist() == want[columns].sort_values("doc_id").values.tolist()


def test_near(spark):
    docs = fx.unique_documents(spark)
    want = fx.near_components([(r.doc_id, r.text) for r in docs.collect()])
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = fx.near_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op5_near_dedup(spark, sf_dir).collect()} == want


def test_near_group_with_pairs_below_the_threshold(spark):
    """Edits of one text, many of whose pairs are not similar enough themselves: the residual comparison has to find what the star misses."""
    words = fx.prose(9, 60).split()
    rows = []
    for i in range(60):
        w = list(words)
        for k in range(i % 5 + 1):
            w[(7 * i + 13 * k) % 60] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words[i : i + 50])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == fx.near_components(rows)


def templated(n):
    """n documents of one template of 100 words and three sentences of a pool that grows with n: pairs are alike, but for few not enough to be linked."""
    rng, template = random.Random(4), fx.prose(41, 100)
    pool = [fx.prose(1000 + i, 6) for i in range(max(12, n // 2))]
    return [(i, f"{template} {' '.join(rng.sample(pool, 3))}") for i in range(n)]


def test_near_templates_propose_few_pairs(spark, monkeypatch):
    """Pairs that go on to full sets grow with the documents, not with their square; in short lists and in long ones."""
    sizes = {}

    def watched(df, tag, write=near_dedup.written):
        out = write(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", watched)
    compared = {}
    for n in (200, 400):
        rows = templated(n)
        want = fx.near_components(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()} == want
        compared[n] = sizes["near-rest"] + sizes["near-best"]
    assert compared[400] < 2.5 * compared[200] and compared[400] < 20 * 400, compared


@pytest.mark.parametrize("long_list", [0, 3, 10**9])
def test_near_lists_of_any_length(spark, monkeypatch, long_list):
    monkeypatch.setattr(near_dedup.near_components, "__defaults__", (*near_dedup.near_components.__defaults__[:-1], long_list))
    rows = [(r.doc_id, r.text) for r in fx.unique_documents(spark).collect()] + [(1000 + i, t) for i, t in templated(60)]
    words = fx.prose(9, 60).split()
    for i in range(60):
        w = list(words)
        for k in range(i % 5 + 1):
            w[(7 * i + 13 * k) % 60] = f"edit{i}x{k}"
        rows.append((2000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect()} == fx.near_components(rows)


def test_near_recall_of_the_match_threshold():
    """Over 10,000 pairs at similarity 0.75 to 0.8, measured."""
    rng = np.random.default_rng(12)
    found = pairs = 0
    for _ in range(40):
        sets = []
        for _ in range(300):
            size = int(rng.integers(40, 160))
            shared = -(-3 * 2 * size // 7)  # of equal sizes: shared / (2 size - shared) >= 3/4
            shared = min(size, shared + int(rng.integers(0, max(1, size // 40))))
            own = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            sets += [np.sort(own[:size]), np.sort(np.concatenate([own[:shared], own[size:]]))]
        signature = shingles.signatures(np.concatenate(sets), np.array([len(s) for s in sets]), near_dedup.K)
        matches = (signature[::2] == signature[1::2]).sum(axis=1)
        found, pairs = found + int((matches >= near_dedup.T).sum()), pairs + len(matches)
    assert pairs >= 10_000 and found / pairs >= 0.999


def test_odd_rows(spark):
    docs = fx.documents(spark)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == docs.count()
    assert all(r.n_shingles == 0 or r.component_id is not None or r.doc_id is None for r in got)
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup):
        assert f(fx.empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (7, 7), (50, 30)] + [(200, k) for k in range(201, 230)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21))
    assert got[100] == got[95] == 90 and got[50] == 30 and got[229] == 200 and 7 in got
