"""Substring dedup: remove words of passages that already occur earlier in the corpus.

Seed and extend. A *window* is ``length`` consecutive words of one document. Every window
holds one winnowed anchor: the k-word gram of least hash among its grams, leftmost on
ties, so equal windows hold equal anchors at equal places.

1. Seeds: anchors go to buckets by hash; those that occur once are done with.
2. Extension: each occurrence of a repeated anchor is extended to both sides, to every
   window that selected it (up to length - k words left and right); occurrences of an
   anchor whose windows agree share that stretch of text. Windows count as equal where
   both the anchor's hash and the window's own agree (128 bits together).
3. Of equal windows the one of smallest (doc_id, start) stays. The others' stretches,
   from all anchors of a document, join up into its maximal repeats of at least
   ``length`` words, and those are removed.

A passage that stands in a third of all documents never meets in one task: each chunk of
a task settles its own repeats (all but its first occurrence are surely later ones) and
hands on one occurrence of each anchor and window. Answers go back packed by slots of
documents, so their rows follow the number of tasks, not of anchors.

Defined results: null, empty and short texts have nothing removed; rows of equal doc_id
and text are the same occurrence and get equal results; a null doc_id counts as larger
than all others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import U64, blocks, gram_hashes, lean, mix, small_batches, span_hashes, word_spans
from emberlake.llm.scratch import shuffle_partitions

LAST = np.iinfo(np.int64).max
CHUNK = 8 << 20  # bytes of text whose repeats are settled together
SEED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("dig", "<i8"), ("pos", "<i4")])  # pos: its complement where the answer is known
RUN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("dig", "<i8"), ("start", "<i4"), ("n", "<i4")])
HEAD = np.dtype([("doc", "<i8"), ("dig", "<i8"), ("n", "<i4")])  # a document's part of an answer


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Anchors and windows of a block of documents."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, k: int, length: int):
        starts, ends, self.first = word_spans(buf, offs)
        words = span_hashes(buf, starts, ends)
        self.grams = gram_hashes(words, k)
        total = len(words)
        if total < length:
            self.start = self.anchor = np.zeros(0, np.int64)
            self.doc = self.start
            return
        bits = U64(max(20, int(total).bit_length()))
        key = (self.grams >> bits << bits) | np.arange(len(self.grams), dtype=U64)
        span, step = length - k + 1, 1
        while 2 * step <= span:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if span > step:
            key = np.minimum(key[: -(span - step)], key[span - step :])
        anchor = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
        doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.start = np.flatnonzero(doc_of[: total - length + 1] == doc_of[length - 1 :])
        self.anchor = anchor[self.start]
        self.doc = doc_of[self.start]
        self.words = words

    def windows(self, length: int) -> np.ndarray:
        """Hashes of the windows at ``start``."""
        half = gram_hashes(self.words, length // 2)
        a = half[self.start]
        b = half[self.start + length - length // 2]
        mid = gram_hashes(self.words, length - 2 * (length // 2))[self.start + length // 2] if length % 2 else U64(0)
        return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(29))) * U64(0xC2B2AE3D27D4EB4F) + mid)


def _packed(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(rows)], strict=True):
        yield int(bucket[a]), rows[a:b].tobytes()


def _answers(doc: np.ndarray, dig: np.ndarray, values: np.ndarray, slots: int) -> Iterator[tuple[int, bytes]]:
    """Values (rows of int32) of each document, packed by the document's slot: number of documents, their heads, values."""
    if not len(doc):
        return
    slot = (mix(mix(doc.astype(U64)) ^ dig.astype(U64)) % U64(slots)).astype(np.int64)
    order = np.lexsort((dig, doc, slot))
    doc, dig, slot, values = doc[order], dig[order], slot[order], values[order]
    first = np.flatnonzero((np.diff(doc, prepend=doc[0]) != 0) | (np.diff(dig, prepend=dig[0]) != 0) | (np.arange(len(doc)) == 0))
    heads = np.zeros(len(first), HEAD)
    heads["doc"], heads["dig"], heads["n"] = doc[first], dig[first], np.diff(np.append(first, len(doc)))
    cut = np.flatnonzero(np.diff(slot[first], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(first)], strict=True):
        part = values[first[a] : first[b] if b < len(first) else len(doc)]
        yield int(slot[first[a]]), int(b - a).to_bytes(4, "little") + heads[a:b].tobytes() + np.ascontiguousarray(part, "<i4").tobytes()


def _merge(width: int):
    """All answers of a partition's slots as a row for each document: distinct places, or ranges joined up where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, values = [], []
        for batch in batches:
            for body in batch.column(1).to_pylist():
                n = int.from_bytes(body[:4], "little")
                heads.append(np.frombuffer(body, HEAD, n, 4))
                values.append(np.frombuffer(body, "<i4", -1, 4 + n * HEAD.itemsize).reshape(-1, width))
        if not heads:
            return
        head, value = np.concatenate(heads), np.concatenate(values)
        del heads, values
        doc, dig = np.repeat(head["doc"], head["n"]), np.repeat(head["dig"], head["n"])
        order = np.lexsort((value[:, -1], value[:, 0], dig, doc))
        doc, dig, value = doc[order], dig[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (dig[1:] != dig[:-1])
        if width == 2:  # joined up within a document: starts rise, so a stretch ends before a start beyond all ends so far
            of = np.cumsum(new).astype(np.int64) << 32
            reach = np.maximum.accumulate(of + value[:, 1])
            begin = np.ones(len(doc), bool)
            begin[1:] = (of + value[:, 0])[1:] > reach[:-1]
            at = np.flatnonzero(begin)
            last = np.append(at[1:], len(doc)) - 1
            value = np.stack([value[at, 0], (reach[last] - of[last])], axis=1).astype("<i4")
            doc, dig, new = doc[at], dig[at], new[at]
        first = np.flatnonzero(new)
        rows = [(int(doc[a]), int(dig[a]), value[a:b].tobytes()) for a, b in zip(first, [*first[1:], len(doc)], strict=True)]
        yield from _out(rows, *REPLY)

    return run


def _ranges(doc: np.ndarray, dig: np.ndarray, start: np.ndarray, length: int, slots: int) -> Iterator[tuple[int, bytes]]:
    """Stretches of words that runs of adjacent windows cover, as answers (first word, end)."""
    if not len(doc):
        return
    order = np.lexsort((start, dig, doc))
    doc, dig, start = doc[order], dig[order], start[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (dig[1:] != dig[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    ends = start[np.append(at[1:], len(start)) - 1] + length
    yield from _answers(doc[at], dig[at], np.stack([start[at], ends], axis=1), slots)


def _out(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 8192):
        cols = list(zip(*rows[at : at + 8192], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(names))


POSTED = ("bucket", "body"), (pa.int32(), pa.binary())  # buckets from 0 hold questions, those below answers of slot -1 - bucket
POSTED_SCHEMA = "bucket int, body binary"
ANSWER = ("slot", "body"), (pa.int32(), pa.binary())
ANSWER_SCHEMA = "slot int, body binary"
REPLY = ("doc", "dig", "body"), (pa.int64(), pa.int64(), pa.binary())
REPLY_SCHEMA = "doc long, dig long, body binary"


def _seeds(k: int, length: int, buckets: int, slots: int):
    """Anchors by bucket; in-chunk repeats are answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digs = _ids(batch.column(0)), batch.column(2).to_numpy()
            for i, j, buf, offs in blocks(batch.column(1), CHUNK):
                w = Words(buf, offs, k, length)
                if not len(w.start):
                    continue
                one = np.flatnonzero(np.diff(w.anchor, prepend=-1))  # windows of an anchor are adjacent
                anchor, doc = w.anchor[one], w.doc[one]
                rows = np.zeros(len(one), SEED)
                rows["h"], rows["doc"], rows["dig"], rows["pos"] = w.grams[anchor], ids[i:j][doc], digs[i:j][doc], anchor - w.first[doc]
                order = np.lexsort((rows["pos"], rows["dig"], rows["doc"], rows["h"]))
                rows = rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = rows["h"][1:] != rows["h"][:-1]
                again = np.ones(len(rows), bool)
                again[:-1] = new[1:]
                known = rows[~(new & again)]  # of a group of two or more
                first = rows[new]
                first["pos"] = np.where(again[new], first["pos"], ~first["pos"])  # the first of such a group asks no more
                out = list(_packed((mix(first["h"]) % U64(buckets)).astype(np.int64), first))
                out += [(-1 - slot, body) for slot, body in _answers(known["doc"], known["dig"], known["pos"][:, None], slots)]
                yield from _out(out, *POSTED)

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> tuple[list, list[bytes]]:
    """Answers that are known already, and bodies of questions."""
    answers, bodies = [], []
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket < 0:
                answers.append((-1 - bucket, body))
            else:
                bodies.append(body)
    return answers, bodies


def _match_seeds(slots: int):
    """Positions of anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, bodies = _parts(batches)
        yield from _out(answers, *ANSWER)
        del answers
        if not bodies:
            return
        rows = np.frombuffer(b"".join(bodies), SEED)
        del bodies
        rows = rows[np.argsort(rows["h"], kind="stable")]
        begin = np.flatnonzero(np.diff(rows["h"].view(np.int64), prepend=rows["h"].view(np.int64)[0] ^ 1))
        size = np.diff(np.append(begin, len(rows)))
        rows = rows[(np.repeat(size, size) > 1) & (rows["pos"] >= 0)]
        yield from _out(list(_answers(rows["doc"], rows["dig"], rows["pos"][:, None], slots)), *ANSWER)

    return run


def _extend(k: int, length: int, buckets: int, slots: int):
    """Window hashes around repeated anchors, by the anchor's bucket; later windows of a chunk are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digs = _ids(batch.column(0)), batch.column(2).to_numpy()
            spots = batch.column(3)
            for i, j, buf, offs in blocks(batch.column(1), CHUNK):
                w = Words(buf, offs, k, length)
                if not len(w.start):
                    continue
                hit = np.zeros(len(w.grams), bool)
                for r in range(i, j):
                    at = np.frombuffer(spots[r].as_py(), "<i4")
                    held = at[at < len(hit) - w.first[r - i]]  # rows of equal digest and another text could point beyond
                    hit[w.first[r - i] + held] = True
                h = w.windows(length)
                keep = hit[w.anchor]
                h, start, anchor, doc = h[keep], w.start[keep], w.anchor[keep], w.doc[keep]
                pos, own, dig = start - w.first[doc], ids[i:j][doc], digs[i:j][doc]
                seed = w.grams[anchor]
                order = np.lexsort((pos, own, seed, h))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (seed[order][1:] != seed[order][:-1])
                # an equal occurrence (same doc_id and start) of a repeated row is not later
                same = np.zeros(len(h), bool)
                lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                same = (own[order] == own[order][lead]) & (pos[order] == pos[order][lead])
                later = order[~new & ~same]
                first = np.sort(order[new | same])
                out = [(-1 - slot, body) for slot, body in _ranges(own[later], dig[later], pos[later], length, slots)]
                if len(first):
                    cut = np.ones(len(first), bool)
                    cut[1:] = (anchor[first][1:] != anchor[first][:-1]) | (first[1:] != first[:-1] + 1)
                    at = np.flatnonzero(cut)
                    n = np.diff(np.append(at, len(first)))
                    rows = np.zeros(len(at), RUN)
                    lead = first[at]
                    rows["h"], rows["doc"], rows["dig"], rows["start"], rows["n"] = w.grams[anchor[lead]], own[lead], dig[lead], pos[lead], n
                    bucket = (mix(rows["h"]) % U64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    # hashes of the runs in bucket order
                    lens = n[by]
                    index = np.repeat(at[by] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
                    hashes = h[first][index]
                    rows, bucket = rows[by], bucket[by]
                    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                    total = np.append(0, np.cumsum(lens))
                    for a, b in zip(edge, [*edge[1:], len(rows)], strict=True):
                        out.append((int(bucket[a]), int(b - a).to_bytes(4, "little") + rows[a:b].tobytes() + hashes[total[a] : total[b]].tobytes()))
                yield from _out(out, *POSTED)

    return run


def _match_windows(length: int, slots: int):
    """Stretches of windows whose words also start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, bodies = _parts(batches)
        yield from _out(answers, *ANSWER)
        del answers
        runs, hashes = [], []
        for body in bodies:
            n = int.from_bytes(body[:4], "little")
            runs.append(np.frombuffer(body, RUN, n, 4))
            hashes.append(np.frombuffer(body, U64, -1, 4 + n * RUN.itemsize))
        if not runs:
            return
        del bodies
        run, h = np.concatenate(runs), np.concatenate(hashes)
        del runs, hashes
        n = run["n"].astype(np.int64)
        of = np.repeat(np.arange(len(run)), n)
        start = run["start"][of].astype(np.int64) + np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        doc, seed = run["doc"][of], run["h"][of]
        order = np.lexsort((start, doc, seed, h))
        h, seed, doc, start, of = h[order], seed[order], doc[order], start[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (seed[1:] != seed[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = (doc != doc[lead]) | (start != start[lead])
        yield from _out(list(_ranges(doc[later], run["dig"][of[later]], start[later], length, slots)), *ANSWER)

    return run


RESULT = (
    ("doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"),
    (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()),
)
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: int, end: int>>, kept_text string"


def _apply(texts: bool):
    """Kept words of each document, and its maximal repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, marks in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                repeats = np.minimum(np.frombuffer(marks or b"", "<i4").reshape(-1, 2), len(words)).tolist()
                kept, at = [], 0
                for a, b in repeats:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                body = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), [{"start": a, "end": b} for a, b in repeats], body.decode("utf-8", "replace") if texts else None))
            yield from _out(rows, *RESULT)

    return run


def remove_repeats(docs: DataFrame, length: int = 20, k: int = 6, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats, kept_text) of every row of ``docs`` (doc_id long, text string).

    repeats: maximal stretches of words (from 0, end exclusive) that were removed, in order.
    kept_text is null unless ``texts``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    buckets = 8 * parts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("dig", F.xxhash64("text"))
    order = F.coalesce("doc_id", F.lit(int(LAST)))
    placed = docs.withColumn("doc", order).repartition(parts, "doc", "dig")

    seeds = docs.mapInArrow(lean(_seeds(k, length, buckets, parts)), POSTED_SCHEMA).repartition(parts, "bucket")
    spots = seeds.mapInArrow(lean(_match_seeds(parts)), ANSWER_SCHEMA).repartition(parts, "slot").mapInArrow(lean(_merge(1)), REPLY_SCHEMA)
    # both joins take all columns of ``placed``, so that its one shuffle serves them both
    around = placed.join(spots.hint("merge"), ["doc", "dig"]).select("doc", "text", "dig", "body", "doc_id")
    windows = around.mapInArrow(lean(_extend(k, length, buckets, parts)), POSTED_SCHEMA).repartition(parts, "bucket")
    marks = windows.mapInArrow(lean(_match_windows(length, parts)), ANSWER_SCHEMA).repartition(parts, "slot").mapInArrow(lean(_merge(2)), REPLY_SCHEMA)
    rows = placed.join(marks.hint("merge"), ["doc", "dig"], "left").select("doc_id", "text", "body")
    return rows.mapInArrow(lean(_apply(texts)), RESULT_SCHEMA)
