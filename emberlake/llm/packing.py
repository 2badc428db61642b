"""Best-fit packing of token sequences, with bounds that certify bin counts.

Documents become token ids (plus an end id) and are cut into pieces only where longer
than a sequence. Pieces are dealt to partitions, and each partition packs its own by
best-fit decreasing. Dual feasible functions give a lower bound of the bins that any
packing of those pieces needs. Where the bound is met, the partition is certified and
only its emptiest bin is given back; where there is a gap, its emptiest bins are. What is
given back moves on to fewer partitions, meets what others gave back, and is packed
again, until one partition of left-overs remains. A partition gives back a number of
bins set by its gap, so later rounds stay small.

Tokens: byte-level BPE as the vocabulary file says. Texts of common letters are split by
vectorised rules that agree with the tokenizer's own pre-tokenizer, and each distinct
piece of text is encoded once; any text with other characters, or with the opening of a
special token, goes through the tokenizer itself.

Defined results: null and empty texts are the end id alone; repeated rows are packed
each; a null doc_id is kept; extra columns are ignored; an empty table gives an empty
result. Reruns give the same pieces and about the same sequences.

The ids themselves travel apart from the rounds: pieces are written with a row number,
rounds move lengths and digests, and the settled rows are joined to their ids by number.
Ids are little-endian unsigned 32-bit numbers; the pieces of a sequence, end to end by
offset, are the training sequence.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import U64, lean, mix, powers, small_batches
from emberlake.llm.scratch import Scratch

CAPACITY, END_ID = 1024, 2
FAN_IN = 16  # partitions whose left-overs meet in the next round
PER_TASK = 200_000  # pieces that a task packs, about: bounds its memory, and small inputs are packed as one
MOST_CACHED = 1 << 19  # distinct pieces of text remembered by a worker

# ---- tokens ------------------------------------------------------------------------

LETTER, NUMBER, OTHER, BLANK, STRANGE = range(5)
CODE_VALUE = mix(np.arange(0x3000, dtype=U64) + U64(77))
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed value of the pre-tokenizer, after an apostrophe


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000; STRANGE ones are left to the tokenizer."""
    import regex

    table = np.full(0x3000, STRANGE, np.uint8)
    for c in [*range(0x20, 0x250), 9, 10, 11, 12, 13, *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]:
        x = chr(c)
        table[c] = BLANK if regex.match(r"\s", x) else LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER
    table[0x85] = table[0x7F] = STRANGE
    return table


class Encoder:
    """Token ids of many texts."""

    def __init__(self, path: str):
        self.path = path
        self.classes = _classes()
        self.coder = self._pieces()
        self.reset()

    def _pieces(self):
        """Encoder of one pre-token's bytes, from the tokenizer's own vocabulary."""
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown}
        chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        coder = tiktoken.Encoding("own", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[b"\0"]
        return coder

    @functools.cached_property
    def tokenizer(self):
        """The library itself, for texts that the fast rules leave to it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def reset(self) -> None:
        self.known = np.zeros(0, U64)  # sorted hashes of pieces of text
        self.ref = np.zeros(0, np.int64)  # their places in the lists below
        self.offs, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _splits(self, codes: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of pre-tokens in code points of documents that end at ``ends``."""
        n = len(codes)
        edge = np.zeros(n + 1, bool)
        edge[0] = True
        edge[ends] = True
        run = edge.copy()
        run[1:n] |= kinds[1:] != kinds[:-1]
        start = run[:n].copy()
        at = np.flatnonzero(run[:n])
        stop = np.append(at[1:], n)
        kind = kinds[at]
        last = stop - 1
        followed = (kind == BLANK) & ~edge[stop]
        # the last blank of a run stands alone or joins what follows
        start[last[followed]] = True
        joins = followed & (codes[last] == 0x20)
        start[stop[joins]] = False
        # contractions: a lone apostrophe that no space joins, before certain letters
        lone = np.flatnonzero((kind == OTHER) & (stop - at == 1) & (codes[at] == 0x27) & ~edge[stop])
        lone = lone[start[at[lone]] & (kinds[np.minimum(stop[lone], n - 1)] == LETTER)]
        for i in lone.tolist():
            a, b = int(stop[i]), int(stop[i + 1])
            tail = "".join(map(chr, codes[a : min(b, a + 2)].tolist()))
            for c in CONTRACTIONS:
                if tail.startswith(c):
                    start[a] = False
                    if a + len(c) < b:
                        start[a + len(c)] = True
                    break
        return np.flatnonzero(start)

    def _usual(self, codes: np.ndarray) -> np.ndarray | None:
        """Classes of code points, if none is left to the tokenizer."""
        if not len(codes) or codes.max() >= 0x3000:
            return None
        kinds = self.classes[codes]
        return None if (kinds == STRANGE).any() else kinds

    def _fast(self, texts: list[str]) -> list[np.ndarray] | None:
        """Ids of non-empty texts, or None if some character is left to the tokenizer."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._usual(codes)
        if kinds is None or "<|" in whole:
            return None
        ends = np.cumsum([len(t) for t in texts])
        starts = self._splits(codes, kinds, ends)
        n = len(codes)
        p, q = powers(n + 1)
        acc = np.zeros(n + 1, U64)
        np.cumsum(CODE_VALUE[codes] * p[:n], out=acc[1:])
        stops = np.append(starts[1:], n)
        h = mix((acc[stops] - acc[starts]) * q[starts] + (stops - starts).astype(U64))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, u)
        there = np.zeros(len(u), bool)
        inside = place < len(self.known)
        there[inside] = self.known[place[inside]] == u[inside]
        new = np.flatnonzero(~there)
        if len(new):
            if len(self.known) + len(new) > MOST_CACHED and len(self.known):
                self.reset()
                return self._fast(texts)
            f = first[new]
            # NUL, which usual texts do not hold, keeps the pieces apart in one call
            got = self.coder.encode_to_numpy("\0".join([whole[a:b] for a, b in zip(starts[f].tolist(), stops[f].tolist(), strict=True)]), disallowed_special=())
            gaps = np.flatnonzero(got == self.between)
            size = np.diff(gaps, prepend=-1, append=len(got)) - 1
            base = len(self.offs) - 1
            self.offs = np.append(self.offs, self.offs[-1] + np.cumsum(size))
            self.ids = np.append(self.ids, np.delete(got, gaps))
            self.ref = np.insert(self.ref, place[new], base + np.arange(len(new)))
            self.known = np.insert(self.known, place[new], u[new])
            place = np.searchsorted(self.known, u)
        ref = self.ref[place][back]
        size = self.offs[ref + 1] - self.offs[ref]
        total = np.append(0, np.cumsum(size))
        ids = self.ids[np.repeat(self.offs[ref] - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.searchsorted(starts, ends)]
        return np.split(ids, cut[:-1])

    def encode(self, texts: list[str], chars: int = 1_000_000) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        none = np.zeros(0, np.uint32)
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= chars):
                held += len(texts[end])
                end += 1
            some = [t for t in texts[at:end] if t]
            got = self._fast(some) if some else []
            if got is None:
                got = [(self._fast([t]) or [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)])[0] for t in some]
            rest = iter(got)
            for t in texts[at:end]:
                yield next(rest) if t else none
            at = end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: all of a document that fits, else pieces of ``capacity`` ids of which the first may be shorter."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for off in range(0, batch.num_rows, 512):
                doc_ids = batch.column(0).slice(off, 512).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(off, 512).to_pylist()]
                rows, held = [], []
                for doc_id, got in zip(doc_ids, enc.encode(texts), strict=True):
                    ids = np.append(got, np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        held.append(ids[a:b].tobytes())
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(held, pa.binary())], [*names, "ids"])
                else:
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), PIECES + (", ids binary" if with_ids else ""))


# ---- bins --------------------------------------------------------------------------


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and the fill of each bin."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has r left
    bins = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i] = b
        fill[b] += s
        left = r - s
        if left:
            free[left].append(b)
            some |= 1 << left
    return bins, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1)
    total = int((count * s).sum())
    best = -(-total // capacity)
    number, volume = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * s))  # of sizes below i
    half = capacity // 2
    for t in range(1, half + 1):
        # sizes over capacity - t count whole, those from t to it by their size, smaller ones not
        large = number[capacity + 1] - number[capacity - t + 1]
        middle = number[capacity - t + 1] - number[half + 1]
        room = middle * capacity - (volume[capacity - t + 1] - volume[half + 1])
        small = volume[half + 1] - volume[t]
        best = max(best, int(large + middle + max(0, -(-(small - room) // capacity))))
    for k in range(1, 33):
        # x counts as itself where (k + 1) * x is a whole number of capacities, else rounded down to k-ths
        scaled = (k + 1) * s
        value = np.where(scaled % capacity == 0, k * s, scaled // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, level: int, final: bool):
    """Pack a partition; rows given back have no sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        del tables
        sizes = t["length"].to_numpy()
        bins, fill = best_fit_decreasing(sizes, capacity)
        gap = len(fill) - lower_bound(sizes, capacity)
        back = np.zeros(len(fill), bool)
        if not final:
            emptiest = np.argsort(fill, kind="stable")[: 1 if gap <= 0 else 4 * gap + 4]
            back[emptiest[fill[emptiest] < capacity]] = True
        order = np.lexsort((-sizes, bins))
        ends = np.cumsum(sizes[order])
        begin = np.append(0, np.cumsum(fill)[:-1])
        offset = np.zeros(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - begin[bins[order]]
        seq = (np.int64(level) << 56) | (np.int64(TaskContext.get().partitionId()) << 32) | bins
        gone = back[bins]
        t = t.append_column("sequence_id", pa.array(seq, pa.int64(), mask=gone)).append_column("offset", pa.array(offset, pa.int64(), mask=gone))
        yield from t.to_batches(max_chunksize=8192)

    return run


PACKED = PIECES + ", sequence_id long, offset long"


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (columns of `pieces`, with or without ids) a sequence and its offset there."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "packing")
    names = [c.split()[0] for c in PIECES.split(", ")]
    has_ids = "ids" in rows.columns
    whole = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), *names, *(["ids"] if has_ids else [])), "pieces", "zstd")
    names = ["row", *names]
    pool = whole.select(names)
    parts, level, done = max(1, -(-pool.count() // PER_TASK)), 0, None
    while True:
        deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(parts * 64))
        got = scratch.keep(pool.repartition(parts, deal).mapInArrow(_pack(capacity, level, parts == 1), "row long, " + PACKED), f"round{level}")
        settled = got.filter("sequence_id is not null")
        done = settled if done is None else done.union(settled)
        if parts == 1:
            return (done.join(whole.select("row", "ids"), "row") if has_ids else done).drop("row")
        pool = got.filter("sequence_id is null").select(names)
        parts, level = -(-parts // FAN_IN), level + 1


def digests(packed: DataFrame) -> DataFrame:
    """What `pack` gives, with length and digest taken from the ids that came through, in place of the ids."""
    out = packed.withColumn("length", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))
    return out.select(*(c.split()[0] for c in PACKED.split(", ")))


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, bound on the sequences any packing needs), from the counts of the lengths (at most ``capacity`` rows)."""
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    counts = packed.groupBy("length").count().collect()
    sizes = np.repeat([r["length"] for r in counts], [r["count"] for r in counts]).astype(np.int64) if counts else np.zeros(0, np.int64)
    return used, lower_bound(sizes, capacity)
