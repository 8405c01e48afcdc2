"""SentencePiece encoding with seeded merge-dropout, and decoding.

The encoder is byte-pair merging over an agenda: candidates, pairs of neighbouring symbols whose join is a piece, are taken by
score, leftmost first, and a popped candidate is skipped for good where a keyed hash says so. The hash's key is the seed, the
unit (a run of blanks and the word behind it, which no piece crosses), the occurrence's document and place, and the candidate's place; so
a candidate's fate is known when it comes up. Each distinct unit is merged once without skips, many at a time in numpy; an occurrence that
skips none of these joins ends alike, and each of the others is merged on its own.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 29
#: Segmentations that a unit can have under one seed, at most; none: no bound, each occurrence draws its own by a keyed hash of its document and place.
VARIANTS = None
#: Units of more code points go through a heap one by one; shorter ones through numpy together.
LONGEST_TOGETHER = 48
CHUNK_BYTES = 4 << 20
BLANK = "▁"
NONE = np.int32(2**31 - 1)

U64 = (1 << 64) - 1
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
STEP1, STEP2, STEP3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
UNITS = re.compile(r" *[^ ]+| +$")


def mix(x: int) -> int:
    """A 64-bit finaliser; mix_array does the same to arrays."""
    x &= U64
    x = ((x ^ (x >> 30)) * MIX1) & U64
    x = ((x ^ (x >> 27)) * MIX2) & U64
    return x ^ (x >> 31)


def mix_array(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def unit_key(unit: str, seed: int, variant: int) -> int:
    h = FNV_START
    for c in unit:
        h = ((h ^ ord(c)) * FNV_PRIME) & U64
    return mix(h ^ mix(seed * STEP1 + variant + 1))


def unit_hashes(points: np.ndarray) -> np.ndarray:
    """What unit_key makes of the code points of units of one length, before seed and variant come in."""
    h = np.full(len(points), FNV_START, dtype=np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ points[:, k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def unit_keys(hashes: np.ndarray, seed: int, variants: np.ndarray) -> np.ndarray:
    """unit_key of arrays."""
    return mix_array(hashes ^ mix_array(variants.astype(np.uint64) + np.uint64((seed * STEP1 + 1) & U64)))


def place_key(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What a candidate's place adds to its unit's key in is_skipped."""
    return start.astype(np.uint64) * np.uint64(STEP1) + middle.astype(np.uint64) * np.uint64(STEP2) + end.astype(np.uint64) * np.uint64(STEP3)


def is_skipped(key: int, start: int, middle: int, end: int, threshold: int) -> bool:
    return mix(key + start * STEP1 + middle * STEP2 + end * STEP3) < threshold


def threshold_of(dropout: float) -> int:
    if not 0 <= dropout < 1:
        raise ValueError(f"dropout must be at least 0 and below 1, not {dropout}")
    return int(dropout * (1 << 64))


def concatenated(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class PieceModel:
    """Pieces of a SentencePiece byte-pair model with byte fallback, in tables for numpy."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p.replace(BLANK, " "): i for i, p in enumerate(pieces) if plain[i]}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece with a blank behind a word crosses units")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(BLANK)] = -1  # the character itself goes through bytes, and so comes back
        self.merges = {(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        raw = [b""] * n
        for p, i in self.ids.items():
            raw[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw_length = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self._hash_merges()

    def _hash_merges(self) -> None:
        """Merges in an open-addressing table: key left << 32 | right."""
        keys = np.array([a << 32 | b for a, b in self.merges], dtype=np.int64)
        values = np.fromiter(self.merges.values(), dtype=np.int32, count=len(keys))
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.merged = np.full(1 << self.bits, -1, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[at[put]], self.merged[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(STEP1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's join, -1 where that is no piece. Symbols below 0 are characters without piece."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where((found == keys) & (left >= 0) & (right >= 0), self.merged[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            at_open = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_open
            found = self.slots[at_open]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at_open[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    # Encoding

    def merge_one(self, unit: str, key: int, threshold: int) -> list[int]:
        """Symbols of one unit by the agenda; characters without piece are -(code point) - 1."""
        n = len(unit)
        sym = [int(i) if (i := self.char_id[ord(c)]) >= 0 else -ord(c) - 1 for c in unit]
        before, after, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.merges.get((sym[a], sym[b]))) is not None:
                heapq.heappush(agenda, (int(self.rank[i]), a, b, end[b], i))

        for a in range(n - 1):
            propose(a, a + 1)
        gone = [False] * n
        while agenda:
            _, a, b, e, i = heapq.heappop(agenda)
            if gone[a] or gone[b] or after[a] != b or end[b] != e or self.merges.get((sym[a], sym[b])) != i:
                continue
            if threshold and is_skipped(key, a, b, e, threshold):
                continue
            sym[a], end[a], after[a], gone[b] = i, e, after[b], True
            if after[a] >= 0:
                before[after[a]] = a
            propose(before[a], a)
            propose(a, after[a])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def _merge_together(self, points: np.ndarray, variants: np.ndarray, seed: int, threshold: int, joins: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The agenda of many units of one length at once: (rows, symbols) as they come to an end.

        Each round joins in each row its best candidate, the leftmost of equals. A row that has none is done. ``joins`` gets each round's rows and what their joins add to a key.
        """
        n, width = points.shape
        key = unit_keys(unit_hashes(points), seed, variants)
        rows = np.arange(n)
        sym = self.char_id[points]
        sym = np.where(sym >= 0, sym, -points.astype(np.int32) - 1)
        pos = np.broadcast_to(np.arange(width + 1, dtype=np.int64), (n, width + 1)).copy()

        def rated(left, right, a, b, e, k):
            to = self.join(left, right)
            rank = np.where(to >= 0, self.rank[to], NONE)
            if threshold:
                h = mix_array(k + place_key(a, b, e))
                rank = np.where(h < np.uint64(threshold), NONE, rank)
            return rank

        flat = lambda x: np.ascontiguousarray(x).ravel()
        if width > 1:
            rank = rated(flat(sym[:, :-1]), flat(sym[:, 1:]), flat(pos[:, :-2]), flat(pos[:, 1:-1]), flat(pos[:, 2:]), np.repeat(key, width - 1)).reshape(n, width - 1)
        while width > 1 and len(rows):
            j = rank.argmin(axis=1)
            live = rank[np.arange(len(rows)), j] < NONE
            if not live.all():
                yield rows[~live], sym[~live]
                rows, sym, pos, rank, key, j = rows[live], sym[live], pos[live], rank[live], key[live], j[live]
            m = len(rows)
            if not m:
                return
            r = np.arange(m)
            if joins is not None:
                joins.append((rows, place_key(pos[r, j], pos[r, j + 1], pos[r, j + 2])))
            sym[r, j] = self.join(sym[r, j], sym[r, j + 1])
            keep = np.ones((m, width), dtype=bool)
            keep[r, j + 1] = False
            sym = sym[keep].reshape(m, width - 1)
            keep = np.ones((m, width + 1), dtype=bool)
            keep[r, j + 1] = False
            pos = pos[keep].reshape(m, width)
            keep = np.ones((m, width - 1), dtype=bool)
            keep[r, j] = False
            rank = rank[keep].reshape(m, width - 2)
            width -= 1
            for at, ok in ((j - 1, j >= 1), (j, j <= width - 2)):
                q, c = r[ok], at[ok]
                rank[q, c] = rated(sym[q, c], sym[q, c + 1], pos[q, c], pos[q, c + 1], pos[q, c + 2], key[q])
        if len(rows):
            yield rows, sym

    def encode_units(self, units: list[str], which: np.ndarray, variants: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pairs (units[which], variants) in a row, and how many each has."""
        threshold = threshold_of(dropout)
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(lengths) - lengths
        found_rows, found_sizes, found_symbols = [], [], []
        of = lengths[which]
        by_length = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[by_length], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            width = int(of[by_length[a]])
            if width <= LONGEST_TOGETHER:
                step = max(1, (1 << 19) // max(1, width))
                for c in range(a, b, step):
                    part = by_length[c : min(b, c + step)]
                    for rows, symbols in self._merge_together(points[starts[which[part]][:, None] + np.arange(width)], variants[part], seed, threshold):
                        found_rows.append(part[rows])
                        found_sizes.append(np.full(len(rows), symbols.shape[1], dtype=np.int64))
                        found_symbols.append(symbols.ravel())
            else:
                for i in by_length[a:b]:
                    unit = units[which[i]]
                    symbols = self.merge_one(unit, unit_key(unit, seed, int(variants[i])), threshold)
                    found_rows.append(np.array([i]))
                    found_sizes.append(np.array([len(symbols)]))
                    found_symbols.append(np.array(symbols, dtype=np.int32))
        if not found_rows:
            return np.zeros(0, dtype=np.int32), np.zeros(len(which), dtype=np.int64)
        rows, sizes, symbols = np.concatenate(found_rows), np.concatenate(found_sizes), np.concatenate(found_symbols)
        order = np.argsort(rows, kind="stable")
        symbols = symbols[concatenated((np.cumsum(sizes) - sizes)[order], sizes[order])]
        sizes = sizes[order]
        return self._with_bytes(symbols, sizes)

    def _with_bytes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without piece as the ids of their UTF-8 bytes."""
        lost = symbols < 0
        if not lost.any():
            return symbols.astype(np.int32), sizes
        point = np.where(lost, -symbols.astype(np.int64) - 1, 0)
        n = np.where(lost, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        ends = np.cumsum(n)
        k = np.arange(ends[-1]) - np.repeat(ends - n, n)  # which byte of its character
        p, m = np.repeat(point, n), np.repeat(n, n)
        tail = 0x80 | ((p >> (6 * (m - 1 - k))) & 0x3F)
        head = np.where(m == 1, p, ((0xF00 >> m) & 0xFF) | (p >> (6 * (m - 1))))
        out = np.where(np.repeat(lost, n), self.byte_ids[np.where(k == 0, head, tail)], np.repeat(symbols, n))
        owner_ends = np.cumsum(sizes)
        total = np.concatenate([[0], ends])[np.concatenate([[0], owner_ends])]
        return out.astype(np.int32), np.diff(total)

    def _skipping(self, units: list[str], which: np.ndarray, variants: np.ndarray, seed: int, dropout: float) -> np.ndarray:
        """Places of the pairs (units[which], variants) that skip a join of their unit's agenda without skips. Long units count as such."""
        threshold = np.uint64(threshold_of(dropout))
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(lengths) - lengths
        hashes = np.zeros(len(units), dtype=np.uint64)
        owners, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for width in np.unique(lengths[lengths <= LONGEST_TOGETHER]).tolist():
            same = np.flatnonzero(lengths == width)
            step = max(1, (1 << 19) // max(1, width))
            for c in range(0, len(same), step):
                part = same[c : c + step]
                letters, joins = points[starts[part][:, None] + np.arange(width)], []
                hashes[part] = unit_hashes(letters)
                for _ in self._merge_together(letters, np.zeros(len(part), dtype=np.uint64), seed, 0, joins):
                    pass
                owners += [part[rows] for rows, _ in joins]
                places += [key for _, key in joins]
        owner, place = np.concatenate(owners), np.concatenate(places)
        place = place[np.argsort(owner, kind="stable")]
        n_joins = np.bincount(owner, minlength=len(units))
        first = np.cumsum(n_joins) - n_joins
        long = lengths > LONGEST_TOGETHER
        skips = long[which]
        left = np.flatnonzero(n_joins[which] > 0)
        key, at, to = unit_keys(hashes[which[left]], seed, variants[left]), first[which[left]], (first + n_joins)[which[left]]
        while len(left):
            skipped = mix_array(key + place[at]) < threshold
            skips[left[skipped]] = True
            at = at + 1
            go = ~skipped & (at < to)
            left, key, at, to = left[go], key[go], at[go], to[go]
        return np.flatnonzero(skips)

    def encode_column(self, texts: pa.Array, keys: np.ndarray, seed: int, dropout: float, variants: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids. ``keys``: a 64-bit key for each text. No nulls."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        empty = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
        odd = np.unique(np.searchsorted(offsets, empty, side="right") - 1)
        if not len(odd):
            return self._encode_words(words, offsets, " ", keys, seed, dropout, variants)
        # Texts with runs of blanks, blanks at an end, or nothing: their units are found one by one.
        n_ids = np.zeros(len(texts), dtype=np.int64)
        plain = np.setdiff1d(np.arange(len(texts)), odd)
        parts = []
        if len(plain):
            got, sizes = self.encode_column(texts.take(pa.array(plain)), keys[plain], seed, dropout, variants)
            parts.append((plain, got, sizes))
        units = [UNITS.findall(" " + t) if t else [] for t in texts.take(pa.array(odd)).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)
        got, sizes = self._encode_words(pa.array([x for u in units for x in u], type=pa.string()), ends, "", keys[odd], seed, dropout, variants)
        parts.append((odd, got, sizes))
        for rows, _, sizes in parts:
            n_ids[rows] = sizes
        starts = np.cumsum(n_ids) - n_ids
        ids = np.empty(n_ids.sum(), dtype=np.int32)
        for rows, got, sizes in parts:
            ids[concatenated(starts[rows], sizes)] = got
        return ids, n_ids

    def _encode_words(self, words: pa.Array, offsets: np.ndarray, prefix: str, keys: np.ndarray, seed: int, dropout: float, variants: int | None) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, dtype=np.int32), np.zeros(len(keys), dtype=np.int64)
        coded = words.dictionary_encode()
        units = [prefix + w for w in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy().astype(np.int64)
        variants = variants if dropout else 1
        n_words = np.diff(offsets)
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(offsets[:-1], n_words).astype(np.uint64)
        variant = mix_array(np.repeat(mix_array(keys.view(np.uint64) ^ np.uint64(mix(seed))), n_words) + place * np.uint64(STEP1))
        if variants is None:
            ids, sizes = self.encode_units(units, np.arange(len(units)), np.zeros(len(units), dtype=np.uint64), seed, 0.0)
            own = self._skipping(units, which, variant, seed, dropout)
            own_ids, own_sizes = self.encode_units(units, which[own], variant[own], seed, dropout)
            ids, sizes, row = np.concatenate([ids, own_ids]), np.concatenate([sizes, own_sizes]), which.copy()
            row[own] = len(units) + np.arange(len(own))
        else:
            variant = (variant % np.uint64(variants)).astype(np.int64)
            pair = which * variants + variant
            seen = np.zeros(len(units) * variants, dtype=bool)
            seen[pair] = True
            distinct = np.flatnonzero(seen)
            number = np.cumsum(seen) - 1
            ids, sizes = self.encode_units(units, distinct // variants, distinct % variants, seed, dropout)
            row = number[pair]
        starts = np.cumsum(sizes) - sizes
        out = ids[concatenated(starts[row], sizes[row])]
        ends = np.concatenate([[0], np.cumsum(sizes[row])])
        return out, np.diff(ends[offsets])

    # Decoding

    def decode_column(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in a row, and each text's number of bytes, without the blank that encoding put in front."""
        lengths = self.raw_length[ids]
        data = self.raw[concatenated(self.raw_start[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_ids)])]
        sizes = np.diff(ends)
        front = ends[:-1][sizes > 0]
        drop = front[data[front] == 0x20]
        keep = np.ones(len(data), dtype=bool)
        keep[drop] = False
        first_blank = np.zeros(len(sizes), dtype=np.int64)
        first_blank[sizes > 0] = data[front] == 0x20
        return data[keep], sizes - first_blank


def model(path: str) -> PieceModel:
    """One model for each worker process and path."""
    kept = sys.__dict__.setdefault("_sentence_piece_models", {})
    if path not in kept:
        kept[path] = PieceModel(path)
    return kept[path]


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _lossless(pieces: PieceModel, texts: pa.Array, ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """Whether each text comes back from its ids."""
    data, sizes = pieces.decode_column(ids, n_ids)
    ends = np.cumsum(sizes)
    want = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if np.array_equal(want, sizes):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if np.array_equal(np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], data):
            return np.ones(len(texts), dtype=bool)
    raw = data.tobytes()
    return np.array([raw[e - s : e] == t.encode() for e, s, t in zip(ends, sizes, texts.to_pylist(), strict=True)])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK_BYTES each."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES)))
        yield a, b
        a = b


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, variants: int | None = VARIANTS, path: str | None = None) -> DataFrame:
    """Piece ids of each row's whole text under merge-dropout, and whether they decode to it.

    With ``dropout`` 0 the segmentation is the library's own. Else it varies with ``seed``, which a training run may change each epoch, with the unit, and
    with the occurrence (by a keyed hash of the row's id and the place in the text, one of ``variants`` kinds if that is given); it always decodes to the text. The same
    id, text and seed give the same ids, however rows are partitioned. A literal U+2581, which stands for a blank in pieces, goes through byte pieces.

    Nulls: a null text counts as empty; a null id stays null and has a key of its own. Empty texts have no ids. Repeated rows get the same ids.
    An empty table gives an empty result. Other columns are ignored. Rows stay where they are: no shuffle.

    Returns doc_id, n_tokens, ids, lossless.
    """
    threshold_of(dropout)
    where = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(where)
        for batch in batches:
            for a, b in _chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                texts = part.column(2)
                ids, n_ids = pieces.encode_column(texts, part.column(1).to_numpy(), seed, dropout, variants)
                ok = _lossless(pieces, texts, ids, n_ids)
                offsets = np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(ok)], names=["doc_id", "n_tokens", "ids", "lossless"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")


def decode_pieces(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of piece ids: doc_id, text. Null ids count as none and give an empty text."""
    where = path or tokenizer_path()
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    rows = rows.select(F.col(id_col).alias("doc_id"), ids.alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(where)
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            data, sizes = pieces.decode_column(flat, pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            raw, ends = data.tobytes(), np.cumsum(sizes)
            texts = [raw[e - s : e].decode("utf-8", "replace") for e, s in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
