"""Quality rules by weak supervision: rules vote or abstain, EM weighs them (DataFrame operations only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_UPPER, blank_spaced, table, without_chars, written

#: The symbol characters that are counted.
SYMBOLS = "#*$%&|<>"
#: ASCII marks and digits, and what may end a line of prose.
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
LINE_END = r"[.!?:;…。！？\"'”’»)\]][\x20\x09\x0B-\x0D]*(?:\n|\z)"
WINDOW = 5
ITERATIONS, TOLERANCE = 60, 1e-3
#: Kinds of badness and the rules that look for each. A document is good or bad of one kind.
KINDS = {
    "shape": ("length", "word_length"),
    "marks": ("symbols", "marks", "line_ends"),
    "repetition": ("dup_lines", "repeats", "vocabulary"),
    "shouting": ("capitals", "shouts"),
}
#: Start of EM and centre of its priors: share of good documents (the kinds share the rest alike), and a voting rule's
#: chance of voting bad on documents bad of its own kind, bad of another kind, and good.
GOOD_SHARE, ON_KIND, ON_OTHER, ON_GOOD = 0.8, 0.6, 0.05, 0.02
#: Pseudo-documents that the shares and each chance get from the start, as a share of all documents and as a number.
PRIOR_SHARE, PRIOR_LEAST = 0.002, 2.0


def text_statistics(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """Statistics of whole texts by array functions within the row, without a shuffle; null counts as empty.

    n_repeat_words marks the 5-word windows that occur twice: windows are 64-bit hashes of word hashes; in texts
    with a repeated hash, (hash, place) pairs are sorted and each place beside an equal hash covers its words.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    s = docs.select(*keep, t.alias("_t"), blank_spaced(t).alias("_s"))
    s = s.select("*", F.array_remove(F.split("_s", " "), "").alias("_words"), F.char_length(F.replace("_s", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.replace(blank_spaced(x), F.lit(" "), F.lit(""))) > 0)
    s = s.select("*", lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_wh"))
    place = F.sequence(F.lit(0), F.size("_wh") - WINDOW)
    win = F.when(F.size("_wh") >= WINDOW, F.transform(place, lambda i: F.xxhash64(*(F.get("_wh", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    s = s.select("*", win.alias("_win"))
    s = s.select("*", (F.size("_win") > F.size(F.array_distinct("_win"))).alias("_again"))
    pairs = F.when(F.col("_again"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    s = s.select("*", pairs.alias("_pairs"))
    beside = lambda p, k: p["h"].eqNullSafe(F.get("_pairs", k - 1)["h"]) | p["h"].eqNullSafe(F.get("_pairs", k + 1)["h"])
    s = s.select("*", F.when(F.col("_again"), F.sort_array(F.transform(F.filter("_pairs", beside), lambda p: p["i"]))).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda chars: (F.char_length("_t") - F.char_length(without_chars(F.col("_t"), chars))).cast("long")
    return s.select(
        *(F.col(c) for c in docs.select(*keep).columns),
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.char_length("_t") - F.char_length(F.translate("_t", ASCII_UPPER, ""))).cast("long").alias("n_upper"),
        count("!?").alias("n_shouts"),
        F.size(F.array_distinct("_wh")).cast("long").alias("n_distinct"),
        (F.char_length("_t") - F.char_length(F.translate("_t", MARKS, ""))).cast("long").alias("n_marks"),
        F.regexp_count("_t", F.lit(LINE_END)).cast("long").alias("n_ended"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rule_votes() -> dict[str, Column]:
    """Each rule's vote over text_statistics(): -1 bad, 0 abstains, 1 good. Most kinds of junk are looked at from more than one side."""
    n, chars, lines = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_lines")
    n1, enough = F.greatest(n, F.lit(1)), n >= 10
    return {
        "length": _vote(n < 10, n >= 40),
        "word_length": _vote((n > 0) & ((chars < 2 * n) | (chars > 12 * n)), (chars >= 3 * n) & (chars <= 8 * n)),
        "symbols": _vote(F.col("n_symbols") > 0.1 * n1, F.col("n_symbols") <= 0.02 * n1),
        "marks": _vote(F.col("n_marks") > 0.2 * chars, F.col("n_marks") <= 0.1 * chars),
        "line_ends": _vote((lines > 0) & (F.col("n_ended") < 0.3 * lines), enough & (F.col("n_ended") >= 0.8 * lines)),
        "dup_lines": _vote(F.col("n_dup_lines") > 0.3 * lines, (F.col("n_dup_lines") == 0) & (lines > 1)),
        "repeats": _vote(F.col("n_repeat_words") > 0.2 * n1, enough & (F.col("n_repeat_words") <= 0.1 * n1)),
        "vocabulary": _vote(enough & (F.col("n_distinct") < 0.25 * n), enough & (F.col("n_distinct") >= 0.4 * n)),
        "capitals": _vote(F.col("n_upper") > 0.4 * chars, F.col("n_upper") <= 0.15 * chars),
        "shouts": _vote(F.col("n_shouts") > 0.2 * n1, F.col("n_shouts") <= 0.05 * n1),
    }


@dataclass(frozen=True)
class VoteModel:
    """Shares of the classes (good, then each kind of badness) and, by rule, the chance of a bad vote in each class, when the rule votes."""

    shares: tuple[float, ...]
    chances: dict[str, tuple[float, ...]]


def start_model() -> VoteModel:
    kinds = len(KINDS)
    rules = [r for of in KINDS.values() for r in of]
    return VoteModel((GOOD_SHARE, *[(1 - GOOD_SHARE) / kinds] * kinds), {r: (ON_GOOD, *(ON_KIND if r in of else ON_OTHER for of in KINDS.values())) for r in rules})


def class_weights(model: VoteModel) -> Column:
    """Joint probability of the array ``votes``, in the order of the model's rules, with each class; a rule that abstains says nothing."""
    numbers = lambda xs: f"array({', '.join(f'{x!r}D' for x in xs)})"
    out = []
    for c, share in enumerate(model.shares):
        bad, good = numbers(math.log(p[c]) for p in model.chances.values()), numbers(math.log1p(-p[c]) for p in model.chances.values())
        out.append(f"exp(aggregate(transform(votes, (v, i) -> CASE v WHEN -1 THEN {bad}[i] WHEN 1 THEN {good}[i] ELSE 0D END), {math.log(share)!r}D, (a, x) -> a + x))")
    return F.expr(f"array({', '.join(out)})")


def fit_votes(patterns: DataFrame, iterations: int = ITERATIONS) -> VoteModel:
    """EM for the shares of the classes and each rule's chances of voting bad in each class.

    ``patterns`` has one row for each array of ``votes`` that occurs, with its count: at most 3 ** rules rows,
    whatever the size of the corpus. Each step is one aggregate, whose sums by rule, vote and class alone come to the driver. The classes are told apart
    by where EM starts, by weak priors there, and by one condition: a rule votes bad on bad documents, all kinds together, at least as often as
    on good ones. Where the sums say otherwise, its chance is the common one in every class, and the rule says nothing.
    """
    model = start = start_model()
    total = patterns.agg(F.sum("count")).first()[0] or 0
    if not total:
        return model
    prior = max(PRIOR_LEAST, PRIOR_SHARE * total)
    patterns = patterns.coalesce(1)  # a table of fixed size at most: one task a step, without a shuffle
    classes, rules = range(len(start.shares)), list(start.chances)
    for _ in range(iterations):
        w = patterns.select("votes", "count", class_weights(model).alias("w")).selectExpr("posexplode(votes) AS (rule, vote)", "transform(w, x -> count * x / aggregate(w, 0D, (a, y) -> a + y)) AS w")
        sums = w.groupBy("rule", "vote").agg(*(F.sum(F.col("w")[c]) for c in classes)).collect()
        got = {(r[0], r[1]): r[2:] for r in sums}
        of = lambda rule, c, *votes: sum(got[rule, v][c] for v in votes if (rule, v) in got)
        shares = tuple((of(0, c, -1, 0, 1) + prior * start.shares[c]) / (total + prior) for c in classes)
        chances = {}
        for k, r in enumerate(rules):
            bad, voted = [of(k, c, -1) + prior * start.chances[r][c] for c in classes], [of(k, c, -1, 1) + prior for c in classes]
            worse = bad[0] * sum(voted[1:]) > voted[0] * sum(bad[1:])
            chances[r] = (sum(bad) / sum(voted),) * len(bad) if worse else tuple(x / n for x, n in zip(bad, voted, strict=True))
        last, model = model, VoteModel(shares, chances)
        if max(abs(a - b) for x, y in zip([last.shares, *last.chances.values()], [shares, *chances.values()], strict=True) for a, b in zip(x, y, strict=True)) < TOLERANCE:
            break
    return model


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Posterior quality probability of each document from rules whose accuracies EM estimates on all documents.

    A document fails at once (base_failed) with fewer than 10 words or over 20 % repeated words; any other is kept
    where its posterior is ``threshold`` or more. One pass over the texts leaves a slim table of counts; votes,
    their combinations' counts and the posterior come from that.

    Nulls: a null text has no words and fails; a null id stays null. Empty texts fail. Repeated rows are judged
    alike, each on its own. An empty table gives an empty result. Other columns are ignored.

    Returns doc_id, the statistics, base_failed, posterior, kept.
    """
    stats = written(text_statistics(docs, F.col(text_col), F.col(id_col).alias("doc_id")), "quality-stats")
    votes = rule_votes()
    voted = stats.withColumns({f"vote_{r}": v for r, v in votes.items()})
    voted = voted.withColumn("votes", F.array(*(F.col(f"vote_{r}") for of in KINDS.values() for r in of)))
    model = fit_votes(written(voted.groupBy("votes").count(), "quality-patterns"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "_weights": class_weights(model)}).withColumn("posterior", F.expr("_weights[0] / aggregate(_weights, 0D, (a, x) -> a + x)"))
    return out.drop("votes", "_weights").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
