"""Small inputs and brute-force versions that the operators' tests share."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts():
    """Nulls, empty and blank texts, copies, near copies, one long text, and repeated words."""
    base = prose(1)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 100, 9)]
    far = [" ".join("w%d" % (i * k) if k % 3 == 0 else w for k, w in enumerate(words)) for i in range(3)]
    out = [None, "", " \n\t ", "one two", "ONE two", "one  two ", "é ü 日本", base, base.upper(), base.replace(" ", "\n"), *near, *far, prose(2), prose(2) + " tail", prose(3, 20000), "again " * 300, "x" * 5000]
    out += [prose(100 + i) for i in range(20)] + ["A line\nA line\nother ###\n", "shout!! " * 40]
    return out


def documents(spark):
    """doc ids repeat and are null in places; columns clash with names that operators use inside."""
    rows = [(i, t, "en", None if i % 7 == 3 else f"src{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    rows += [(3, "one two", "en", "src3", 7), (3, "one two", "en", "src3", 7), (None, "lost id", None, "src0", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit(1) for c in ("rid", "n", "name", "kept", "score", "size", "key", "h", "token", "html", "url", "block", "source_size")}
    return df.repartition(3).withColumns(clash)


def unique_documents(spark):
    return spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts())], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_components(rows):
    """{id: (set size, smallest id reachable)} over links of 75 % similarity, all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    lists, both, up = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for ids in lists.values():
        both.update((a, b) for k, a in enumerate(ids) for b in ids[:k])

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), o in both.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
