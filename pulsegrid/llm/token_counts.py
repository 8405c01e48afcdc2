"""Token counts by offset-mapped attribution to sections."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "majority")


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokenizer:
    """A byte-level byte-pair encoder, with the number of bytes of each token."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.n_bytes[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; their bytes in a row are the text's UTF-8 bytes."""
        return np.array(self.encoding.encode_ordinary(text), dtype=np.int64)


def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer for each worker process and path."""
    kept = sys.__dict__.setdefault("_token_counts_tokenizers", {})
    if path not in kept:
        kept[path] = ByteTokenizer(path)
    return kept[path]


def attribute(token_bytes: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens in each section, and how many tokens cross a boundary.

    ``section_ends`` are the sections' rising end offsets in bytes, the last one the text's length. The interval join of
    token spans with sections is two sorted searches. A token that crosses a boundary counts for the section of its first byte
    (``start``), of its last byte (``end``), or of most of its bytes, the first of equals (``majority``). Empty sections get none.
    """
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    to = first
    if rule == "end":
        to = last
    elif rule == "majority" and len(crossing):
        to = first.copy()
        for i in crossing:
            edges = np.clip(np.concatenate([[starts[i]], section_ends[first[i] : last[i] + 1]]), starts[i], ends[i])
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(section_ends)), len(crossing)


def section_ends(data: bytes, separator: bytes = b"\n") -> np.ndarray:
    """Byte ends of the sections of a text: a section ends with its separator, the last at the text's end."""
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(raw == separator[0]) + 1
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "start", by_section: bool = True, path: str | None = None) -> DataFrame:
    """Encode each document once, as a whole, and count its tokens by section.

    The document is its ``fields`` in order, each but the last followed by a line feed. With ``by_section`` every line is a section (its line
    feed included); else every field is one. ``rule`` says where tokens go that cross a boundary: ``start``, ``end`` or ``majority``.

    Nulls: a null field counts as empty; a null id stays null. An empty document has one empty section and no token. Repeated rows are
    counted each. An empty table gives an empty result. Other columns are ignored. Rows stay where they are: no shuffle.

    Returns doc_id, n_tokens, n_crossing, section_tokens (an array in section order; it sums to n_tokens).
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")
    where = path or tokenizer_path()
    names = [f"f{i}" for i in range(len(fields))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(fields, names, strict=True)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(where)
        for b in batches:
            totals, crossings, sections = [], [], []
            for parts in zip(*(b[n] for n in names), strict=True):
                text = "\n".join(parts)
                data = text.encode()
                if by_section:
                    ends = section_ends(data)
                else:
                    ends = np.cumsum([len(p.encode()) + 1 for p in parts])
                    ends[-1] -= 1
                ids = bpe.encode(text)
                counts, crossing = attribute(bpe.n_bytes[ids], ends, rule)
                totals.append(len(ids))
                crossings.append(crossing)
                sections.append(counts)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": totals, "n_crossing": crossings, "section_tokens": sections})

    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, n_crossing long, section_tokens array<long>")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
