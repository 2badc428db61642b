"""N-gram Jaccard join: exact near-duplicate links between documents' word-shingle sets.

Method. Documents with equal shingle sets are one *set* (a 96-bit digest). Shingles are
put in a global order, those that a count sketch finds frequent last, and a set is posted
under its prefix in that order, which is long enough that two linked sets must share a
posted shingle. Postings of one shingle, sorted by set size and cut where neighbouring
sizes are too far apart to link, are *size-banded tiles*. Within tiles, parity bitmaps of
hashed shingles bound the overlap of two sets from above (as, before that, do the places
of a shared shingle in both orders); pairs that pass are decided by
intersecting the sorted hash arrays. Sets already connected are not compared again, so a
family of near copies costs about one comparison a member and pairs are never listed:

1. in each tile, sets that no other set of the tile can reach by size and bitmap go;
2. each set left goes with its array to its most populous tile, in bounded blocks; blocks
   of one tile are bridged through their largest groups;
3. tiles that still span several components compare bitmaps between components (of sets
   that did not meet in step 2), block pair by block pair, keeping the sets of which some
   pair passes;
4. those sets meet again with their arrays for the exact decision.

Every pair of sets that share a tile is thus linked, bounded away, decided, or already
in one component, so components are exact.

Defined results: null and empty texts have the empty set (0 shingles) and link with
nothing; texts of fewer than k words are one shingle of all their words; repeated rows
and equal texts share a set; a row without doc_id takes its set's component and never
names one (a set without any doc_id links with nothing, its component is null); extra
columns are ignored; an empty table gives an empty result. Shingles are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.llm.components import components, forest
from emberlake.llm.kernels import U64, lean, mix, shingle_sets, small_batches
from emberlake.llm.scratch import Scratch, shuffle_partitions
from emberlake.llm.tables import row_key

SID = 12  # bytes of a set's digest
CHUNK_BITS = 14  # counters of a row of the sketch: 2**14
FLUSH = 1 << 21  # postings a task holds before it hands them on
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20  # bounds of a block of a tile, where arrays travel
WIDE_SETS = 4096  # sets of a block of a tile, where bitmaps travel
RAW = np.dtype([("h", "<u8"), ("sid", f"V{SID}"), ("n", "<u4"), ("at", "<u2")])  # at: place in the set's order, in 65536ths of n, rounded down
NEAR = 48  # places of a tile up to which pairs are looked at one by one


def set_digest(u: np.ndarray) -> bytes:
    """Order-free digest of a set of hashes."""
    lo = int(mix(u).sum(dtype=U64))
    hi = int(mix(u ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64))
    pair = mix(np.array([lo, hi ^ (lo >> 7) ^ len(u)], U64))
    return int(pair[0]).to_bytes(8, "big") + (int(pair[1]) >> 32).to_bytes(4, "big")


def prefix_length(n: int, share: int) -> int:
    """Shingles of a set of n that must hold one of each linked set; share is in hundredths."""
    return n - -(-share * n // 100) + 1


def bitmap(u: np.ndarray) -> np.ndarray:
    """Parity bitmap: each bit is the parity of the set's hashes that fall on it; about as many bits as shingles.

    Width depends on the size only up to a power of two; `fold` makes two widths meet.
    """
    bits = 1 << max(6, min(15, int(len(u) - 1).bit_length()))
    odd = np.bincount((mix(u) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def fold(bm: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmap of fewer bytes: low bits of the hash choose the bit, so halves are added modulo two."""
    while len(bm) > size:
        bm = bm[: len(bm) // 2] ^ bm[len(bm) // 2 :]
    return bm


class Union:
    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Exact decision on two sorted arrays of distinct hashes."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= share * (len(both) - inter)


def candidates(i: int, sizes: np.ndarray, maps: np.ndarray, share: int) -> np.ndarray:
    """Rows before i (sizes rise) whose size and bitmap allow a link with row i."""
    lo = int(np.searchsorted(sizes, -(-share * int(sizes[i]) // 100)))
    if lo >= i:
        return np.zeros(0, np.int64)
    apart = np.bitwise_count(maps[lo:i] ^ maps[i]).sum(axis=1, dtype=np.int64)
    total = sizes[lo:i] + sizes[i]
    # overlap <= (total - apart) / 2, and a link needs overlap >= share * total / (100 + share)
    return lo + np.flatnonzero((total - apart) * (100 + share) >= 2 * share * total)


def prepare(sizes: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    width = min(len(b) for b in bitmaps)
    width = max(8, width - width % 8)
    return np.stack([fold(np.frombuffer(b, np.uint8), width) for b in bitmaps]).view(U64)


def cluster(sids: list[bytes], sizes: list[int], arrays: list[np.ndarray], labels: list, share: int) -> list[tuple[bytes, bytes]]:
    """Edges that join the given sets' components: pairs of one component are not compared."""
    order = sorted(range(len(sids)), key=lambda i: (sizes[i], sids[i]))
    n = np.array([sizes[i] for i in order], np.int64)
    maps = prepare(n, [bitmap(arrays[i]).tobytes() for i in order])
    union, edges = Union([labels[i] for i in order]), []
    roots = np.array([union.root(i) for i in range(len(order))])
    for i in range(1, len(order)):
        found = candidates(i, n, maps, share)
        while len(found := found[roots[found] != roots[i]]):
            j = int(found[-1])
            found = found[:-1]
            if linked(arrays[order[i]], arrays[order[j]], share):
                a, b = sorted((int(roots[i]), int(roots[j])))
                roots[roots == b] = a
                edges.append((sids[order[i]], sids[order[j]]))
    return edges


# ---- corpus passes -----------------------------------------------------------------


def _slim(k: int, lower: bool, bits: int):
    """Documents' digests and sizes, and a count sketch of their shingles in rows of 2**CHUNK_BITS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "n", "sid", "bm", "chunk", "counts", "row"]
        for batch in batches:
            ids, n, sid, bm, held = batch.column(0), [], [], [], []
            for _, u in shingle_sets(batch.column(1), k, lower):
                n.append(len(u))
                sid.append(set_digest(u) if len(u) else None)
                bm.append(bitmap(u).tobytes() if len(u) else None)
                held.append((u >> U64(64 - bits)).astype(np.int64))
                if len(held) == 256:
                    sketch += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                    held = []
            if held:
                sketch += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
            if len(ids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(bm, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary()), batch.column(2)], names)
        step = 1 << CHUNK_BITS
        some = [c for c in range(len(sketch) // step) if sketch[c * step : (c + 1) * step].any()]
        if some:
            counts = [zlib.compress(sketch[c * step : (c + 1) * step].tobytes(), 1) for c in some]
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(some, pa.int32()), pa.array(counts, pa.binary()), pa.nulls(m, pa.binary())], names)

    return run


def heavy_counters(sketch: DataFrame, bits: int, level: float) -> np.ndarray:
    """Packed flags of the counters of at least ``level``: one bit a counter comes to the driver, a fixed size."""
    step = 1 << CHUNK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(raw), np.uint32)
                total[chunk] = total.get(chunk, 0) + got.astype(np.int64)
        flags = [np.packbits(x >= level).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(flags, pa.binary())], ["chunk", "flags"])

    heavy = np.zeros(1 << bits, np.uint8)
    parts = min(shuffle_partitions(sketch.sparkSession), 1 << max(0, bits - CHUNK_BITS))
    for r in sketch.repartition(parts, "chunk").mapInArrow(run, "chunk int, flags binary").collect():
        heavy[r.chunk * step : (r.chunk + 1) * step] = np.unpackbits(np.frombuffer(r.flags, np.uint8))[:step]
    return np.packbits(heavy)


def _postings(k: int, lower: bool, share: int, bits: int, heavy, buckets: int):
    """Prefix postings, in packed runs by bucket of the shingle's hash; equal sets of a task are posted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(np.frombuffer(heavy.value, np.uint8)).astype(bool)
        seen: set[bytes] = set()
        hs: list[np.ndarray] = []
        sids: list[bytes] = []
        ns: list[int] = []
        held = 0

        def flush():
            nonlocal held
            if not hs:
                return
            counts = [len(h) for h in hs]
            out = np.zeros(held, RAW)
            out["h"] = np.concatenate(hs)
            out["sid"] = np.repeat(np.frombuffer(b"".join(sids), f"V{SID}"), counts)
            out["n"] = np.repeat(np.array(ns, np.uint32), counts)
            starts = np.repeat(np.cumsum(counts) - counts, counts)
            out["at"] = (np.arange(held) - starts) * 65536 // out["n"].astype(np.int64)
            bucket = (mix(out["h"]) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*cut[1:], len(out)]
            rows = [(int(bucket[a]), out[a:b].tobytes()) for a, b in zip(cut, ends, strict=True)]
            hs.clear(), sids.clear(), ns.clear()
            held = 0
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["bucket", "posts"])

        for batch in batches:
            for _, u in shingle_sets(batch.column(0), k, lower):
                if not len(u):
                    continue
                sid = set_digest(u)
                if sid in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(sid)
                p = prefix_length(len(u), share)
                late = frequent[(u >> U64(64 - bits)).astype(np.int64)]
                first = u[~late][:p]
                if len(first) < p:
                    first = np.concatenate([first, u[late][: p - len(first)]])
                hs.append(first)
                sids.append(sid)
                ns.append(len(u))
                held += len(first)
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def with_partner(tile: np.ndarray, n: np.ndarray, least: np.ndarray, share: int) -> np.ndarray:
    """Rows of tiles (sizes n rising within each) of which some other row of the tile may be a link's first common shingle.

    Before the first common shingle nothing is shared, so the overlap is at most what
    follows its place in either set. Tiles of more than NEAR rows are left whole.
    """
    size = np.bincount(tile, minlength=int(tile[-1]) + 1 if len(tile) else 0)
    ok = size[tile] > NEAR
    for lag in range(1, NEAR):
        a = np.flatnonzero((tile[lag:] == tile[:-lag]) & ~ok[lag:] | (tile[lag:] == tile[:-lag]) & ~ok[:-lag]) if lag < len(tile) else np.zeros(0, np.int64)
        if not len(a):
            if lag >= len(tile) or not (tile[lag:] == tile[:-lag]).any():
                break
            continue
        b = a + lag
        need = -(-share * (n[a] + n[b]) // (100 + share))
        fit = (np.minimum(n[a] - least[a], n[b] - least[b]) >= need) & (100 * n[a] >= share * n[b])
        ok[a[fit]] = True
        ok[b[fit]] = True
    return ok


def _tiles(share: int):
    """Size-banded tiles of two sets or more, from all postings of some buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_py(), RAW) for batch in batches for x in batch.column(1)]
        if not parts:
            return
        posts = np.concatenate(parts)
        del parts
        digest = np.frombuffer(posts["sid"].tobytes(), ">u4").reshape(-1, SID // 4)
        hi = (digest[:, 0].astype(U64) << U64(32)) | digest[:, 1]
        order = np.lexsort((digest[:, 2], hi, posts["n"], posts["h"]))
        posts, hi, lo = posts[order], hi[order], digest[order, 2].astype(U64)
        fresh = np.ones(len(posts), bool)
        fresh[1:] = (posts["h"][1:] != posts["h"][:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        posts, hi, lo = posts[fresh], hi[fresh], lo[fresh]
        n = posts["n"].astype(np.int64)
        begin = np.ones(len(posts), bool)
        begin[1:] = (posts["h"][1:] != posts["h"][:-1]) | (100 * n[:-1] < share * n[1:])
        tile = np.cumsum(begin)
        least = posts["at"].astype(np.int64) * n >> 16  # no later than the shingle's place in its set's order
        kept = with_partner(tile, n, least, share)
        posts, hi, lo, tile = posts[kept], hi[kept], lo[kept], tile[kept]
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        m = np.diff([*starts, len(posts)])
        g1 = np.add.reduceat(mix(hi ^ lo), starts) if len(starts) else np.zeros(0, U64)
        g2 = np.add.reduceat(mix(hi + (lo << U64(13)) + U64(99)), starts) if len(starts) else g1
        many = np.flatnonzero(m > 1)
        _, one = np.unique(np.stack([g1[many], g2[many]]), axis=1, return_index=True)
        for at in range(0, len(one), 4096):
            rows = many[one[at : at + 4096]]
            body = [posts[["sid", "n"]][starts[r] : starts[r] + m[r]] for r in rows]
            packed = [b"".join((x["sid"].tobytes(), x["n"].astype("<u4").tobytes())) for x in body]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g1[rows].view(np.int64)), pa.array(g2[rows].view(np.int64)), pa.array(m[rows], pa.int64()), pa.array(packed, pa.binary())], ["g1", "g2", "m", "members"]
            )

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set of a tile, with its block: sets in size order, bounded in number and in shingles."""
    for batch in batches:
        for g1, g2, m, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            n = np.frombuffer(raw, "<u4", m, m * SID).astype(np.int64)
            block = np.maximum(np.arange(m) // BLOCK_SETS, (np.cumsum(n) - n) // BLOCK_SHINGLES).astype(np.int32)
            wide = (np.arange(m) // WIDE_SETS).astype(np.int32)
            sids = [raw[i * SID : (i + 1) * SID] for i in range(m)]
            for at in range(0, m, 8192):
                k = min(8192, m - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, g1)), pa.array(np.full(k, g2)), pa.array(np.full(k, m)), pa.array(block[at : at + k]), pa.array(wide[at : at + k]), pa.array(sids[at : at + k], pa.binary()), pa.array(n[at : at + k])], ["g1", "g2", "m", "block", "wide", "sid", "n"]
                )


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small output batches of `_unpack` joined up."""
    held, rows = [], 0
    for batch in _unpack(batches):
        held.append(batch)
        rows += batch.num_rows
        if rows >= 8192:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _arrays(k: int, lower: bool):
    """Sorted hash arrays of chosen documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [u for _, u in shingle_sets(part.column(0), k, lower)]
                same = [i for i, u in enumerate(sets) if set_digest(u) == part.column(1)[i].as_py()]
                if len(same) < len(sets):  # another text under the same doc_id
                    part, sets = part.take(pa.array(same, pa.int64())), [sets[i] for i in same]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([u.tobytes() for u in sets], pa.binary())], [*part.schema.names[1:], "arr"])

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal first ``keys`` columns, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in range(keys):
            col = batch.column(c)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new).tolist()
        for a, b in zip(at, [*at[1:], n], strict=True):
            key = tuple(batch.column(c)[a] for c in range(keys))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(table) -> table or None`` over rows of equal keys, many groups to a task, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for t in groups(batches, len(keys)):
            out = fn(t)
            if out is not None and out.num_rows:
                held.append(out)
                rows += out.num_rows
                if rows >= 4096:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


def _edge_table(edges: list[tuple[bytes, bytes]]) -> pa.Table | None:
    if not edges:
        return None
    return pa.table({"a": pa.array([e[0] for e in edges], pa.binary()), "b": pa.array([e[1] for e in edges], pa.binary())})


def reachable(t: pa.Table, share: int, *settled: list) -> np.ndarray:
    """Rows of a tile that some row may be linked with, by size and bitmap.

    settled: labels of the rows; pairs that agree in any of them are decided already.
    """
    n = t["n"].to_numpy()
    if len(n) == 2:  # most tiles: the same bound on two integers
        if any(x[0] == x[1] for x in settled):
            return np.zeros(0, np.int64)
        small, large = sorted(n.tolist())
        a, b = (x.as_py() for x in t["bm"])
        width = min(len(a), len(b))
        x = int.from_bytes(fold(np.frombuffer(a, np.uint8), width).tobytes()) ^ int.from_bytes(fold(np.frombuffer(b, np.uint8), width).tobytes())
        fit = 100 * small >= share * large and (small + large - x.bit_count()) * (100 + share) >= 2 * share * (small + large)
        return np.arange(2 if fit else 0)
    sids = t["sid"].to_pylist()
    order = sorted(range(len(n)), key=lambda i: (n[i], sids[i]))
    sizes = n[order].astype(np.int64)
    maps = prepare(sizes, [t["bm"][i].as_py() for i in order])
    labels = []
    for given in settled:
        names = {c: i for i, c in enumerate(dict.fromkeys(given))}
        labels.append(np.array([names[given[i]] for i in order]))
    alive = np.zeros(len(n), bool)
    for i in range(1, len(n)):
        if not labels and alive[i]:
            continue
        found = candidates(i, sizes, maps, share)
        for label in labels:
            found = found[label[found] != label[i]]
        if len(found):
            alive[i] = True
            alive[found] = True
    return np.array(order)[alive]


def _alive(share: int):
    """Sets of a tile's block pair that some other set there may be linked with."""

    def run(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        kept = reachable(t, share)
        return t.select(["g1", "g2", "m", "block", "sid", "n"]).take(pa.array(kept)) if len(kept) else None

    return run


def _cluster_block(share: int):
    """Edges within a block of a tile, and the array of the block's largest group for bridging."""

    def run(t: pa.Table) -> pa.Table | None:
        sids, arrays = t["sid"].to_pylist(), [np.frombuffer(x.as_py(), U64) for x in t["arr"]]
        edges = cluster(sids, [len(a) for a in arrays], arrays, list(range(len(sids))), share) if len(sids) > 1 else []
        rows = [(a, b, None) for a, b in edges]
        if t["blocks"][0].as_py() > 1:
            roots = forest(edges)
            count = Counter(roots.get(s, s) for s in sids)
            best = max(range(len(sids)), key=lambda i: (count[roots.get(sids[i], sids[i])], sids[i]))
            rows.append((sids[best], None, arrays[best].tobytes()))
        if not rows:
            return None
        g1, g2 = t["g1"][0].as_py(), t["g2"][0].as_py()
        a, b, arr = zip(*rows, strict=True)
        return pa.table({"g1": pa.array([g1] * len(rows), pa.int64()), "g2": pa.array([g2] * len(rows), pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "arr": pa.array(arr, pa.binary())})

    return run


def _cluster_group(share: int):
    """Edges between components of the sets of one group, decided exactly."""

    def run(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        sids, arrays = t["sid"].to_pylist(), [np.frombuffer(x.as_py(), U64) for x in t["arr"]]
        return _edge_table(cluster(sids, [len(a) for a in arrays], arrays, t["comp"].to_pylist(), share))

    return run


def _survivors(share: int):
    """Of the sets of a block pair, those that some set of another component and another home cannot be bounded away from."""

    def run(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        sids = t["sid"].to_pylist()
        kept = reachable(t, share, t["comp"].to_pylist(), t["home"].to_pylist()).tolist()
        if not kept:
            return None
        names = b"".join(sorted(sids[i] for i in kept))
        digest = set_digest(np.frombuffer(names, np.dtype("<u4")).astype(U64) + (np.arange(len(names) // 4).astype(U64) << U64(32)))
        return pa.table({"key": pa.array([digest], pa.binary()), "sids": pa.array([[sids[i] for i in kept]], pa.list_(pa.binary()))})

    return run


def link_components(docs: DataFrame, k: int = 5, share: int = 80, lower: bool = True, sketch_bits: int | None = None, frequent: int = 300) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id long, text string).

    k: words of a shingle. share: hundredths of the union that the intersection must reach
    (above 50). sketch_bits, frequent: size of the count sketch (2**18 to 2**24 counters, by the
    number of rows) and the count from which shingles are ordered last; they change cost, never
    results.
    """
    slim, every = _groups(docs, k, share, lower, sketch_bits, frequent)
    return slim.join(every, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _row() -> Column:
    """Identity of a row: its doc_id, which may be null or shared, and its text."""
    return F.unhex(row_key("doc_id", "text"))


def _groups(docs: DataFrame, k: int, share: int, lower: bool, sketch_bits: int | None, frequent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, sid, row), and of each set (sid, component_id, group, pick): pick is its first row, that of the smallest doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", _row().alias("row"))
    if sketch_bits is None:
        sketch_bits = max(18, min(24, (4 * docs.count()).bit_length()))
    scratch = Scratch(spark, "ngram")
    parts = shuffle_partitions(spark)
    buckets = parts * 8
    first = scratch.keep(docs.mapInArrow(lean(_slim(k, lower, sketch_bits)), "doc_id long, n long, sid binary, bm binary, chunk int, counts binary, row binary"), "slim")
    slim = first.filter("chunk is null").select("doc_id", "n", "sid", "row")
    mean = (slim.agg(F.sum("n")).first()[0] or 0) / (1 << sketch_bits)
    heavy = heavy_counters(first.filter("chunk is not null").select("chunk", "counts"), sketch_bits, max(frequent, mean + 12 * mean**0.5))
    shared = spark.sparkContext.broadcast(heavy.tobytes())  # one bit a counter: a fixed size
    sets = scratch.keep(first.filter("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("pick"), F.max("bm").alias("bm")), "sets")

    # each step is a function, so that plans it no longer needs (and their shuffle files) can go
    def in_company() -> DataFrame:
        """1. Sets of a tile that some other set there may be linked with."""
        posts = docs.select("text").mapInArrow(lean(_postings(k, lower, share, sketch_bits, shared, buckets)), "bucket int, posts binary")
        tiles = posts.repartition(parts, "bucket").mapInArrow(lean(_tiles(share)), "g1 long, g2 long, m long, members binary").dropDuplicates(["g1", "g2"])
        members = tiles.mapInArrow(_regroup, "g1 long, g2 long, m long, block int, wide int, sid binary, n long")
        # a row for every pair of wide blocks of its tile that a set's block is in: one for most tiles
        last = F.floor((F.col("m") - 1) / WIDE_SETS).cast("int")
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("i", F.least("wide", "other")).withColumn("j", F.greatest("wide", "other"))
        offered = members.join(sets.select("sid", "bm"), "sid").select("g1", "g2", "i", "j", "m", "block", "sid", "n", "bm")
        alive = by_key(offered, ["g1", "g2", "i", "j"], _alive(share), "g1 long, g2 long, m long, block int, sid binary, n long")
        return scratch.keep(alive.dropDuplicates(["g1", "g2", "sid"]), "alive")

    def at_home() -> DataFrame:
        """Arrays of the sets that are left, with each one's most populous tile."""
        home = alive.groupBy("sid").agg(F.max(F.struct("m", "g1", "g2", "block")).alias("home")).select("sid", "home.g1", "home.g2", "home.block")
        # the number of a tile's blocks goes along with the slim rows, so that arrays are dealt once
        blocks = home.groupBy("g1", "g2").agg(F.count_distinct("block").alias("blocks"))
        chosen = sets.select("sid", "pick.row").join(home.join(blocks, ["g1", "g2"]), "sid")
        texts = docs.join(chosen, "row").select("text", "sid", "g1", "g2", "block", "blocks")
        return scratch.keep(texts.mapInArrow(lean(_arrays(k, lower)), "sid binary, g1 long, g2 long, block int, blocks long, arr binary"), "arrays")

    def near_edges() -> DataFrame:
        """2. Links within the blocks of home tiles, and bridges between blocks."""
        rows = arrays.select("g1", "g2", "block", "sid", "arr", "blocks")
        near = scratch.keep(by_key(rows, ["g1", "g2", "block"], _cluster_block(share), "g1 long, g2 long, a binary, b binary, arr binary"), "near", few=True)
        bridges = near.filter("b is null").select("g1", "g2", F.col("a").alias("sid"), "arr", F.col("a").alias("comp"))
        out = scratch.keep(near.filter("b is not null").select("a", "b").union(by_key(bridges, ["g1", "g2"], _cluster_group(share), "a binary, b binary")), "edges", few=True)
        scratch.drop(near)
        return out

    def open_groups() -> DataFrame:
        """3. Sets of tiles with several components that bitmaps cannot keep apart."""
        # the sets of one home (a block of a tile) have met there with their arrays: those pairs are decided
        homes = arrays.select("sid", F.unhex(F.md5(F.concat_ws(" ", "g1", "g2", "block"))).alias("home"))
        names = homes.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "home", F.coalesce("root", "sid").alias("comp"))
        placed = alive.join(names, "sid").select("g1", "g2", "block", "sid", "n", "home", "comp")
        placed = scratch.keep(placed, "placed")
        mixed = placed.groupBy("g1", "g2").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.max("block").alias("last")).filter("c1 <> c2").select("g1", "g2", "last")
        open_tiles = placed.join(mixed, ["g1", "g2"]).join(sets.select("sid", "bm"), "sid")
        pairs = open_tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        pairs = pairs.select("g1", "g2", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "n", "home", "comp", "bm")
        out = scratch.keep(by_key(pairs, ["g1", "g2", "i", "j"], _survivors(share), "key binary, sids array<binary>").dropDuplicates(["key"]), "open", few=True)
        scratch.drop(placed)
        return out

    def far_edges() -> DataFrame:
        """4. Exact decisions between components."""
        rows = open_.select("key", F.explode("sids").alias("sid")).join(arrays.select("sid", "arr"), "sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left")
        return by_key(rows.select("key", "sid", "arr", F.coalesce("root", "sid").alias("comp")), ["key"], _cluster_group(share), "a binary, b binary")

    alive = in_company()
    scratch.settle()
    arrays = at_home()
    scratch.settle()
    edges = near_edges()
    scratch.settle()
    comps = components(edges, scratch)
    open_ = open_groups()
    final = comps if open_.isEmpty() else components(edges.union(far_edges()), scratch)
    scratch.drop(arrays, alive)
    scratch.settle()

    named = final.join(sets, final.node == sets.sid).select("sid", "root", F.col("pick.doc_id").alias("rep"))
    label = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = named.join(label, "root").select("sid", "root", "component_id")
    every = sets.join(classes, "sid", "left").select("sid", F.coalesce("component_id", "pick.doc_id").alias("component_id"), F.coalesce("root", "sid").alias("group"), "pick")
    every = scratch.keep(every, "every")
    scratch.drop(sets, edges, comps, open_, final)  # ``slim`` and ``every`` are what callers read
    return slim, every


def keep_one(docs: DataFrame, k: int = 5, share: int = 80, lower: bool = True, sketch_bits: int | None = None, frequent: int = 300) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest doc_id (nulls last), then of the least digest; columns as they are.

    Rows are known by doc_id and text; of equal ones one stays. Texts without words are in
    no group and all stay.
    """
    slim, every = _groups(docs, k, share, lower, sketch_bits, frequent)
    kept = every.groupBy("group").agg(F.min("pick").alias("pick")).select("pick.row", F.lit(True).alias("kept"))
    rows = slim.filter("sid is not null").groupBy("row").agg(F.count(F.lit(1)).alias("equal"))
    fate = rows.join(kept, "row", "left").filter("kept is null or equal > 1").select("row", "kept")
    fate = Scratch(docs.sparkSession, "ngram").keep(fate, "fate")
    known = docs.select(F.struct("*").alias("whole"), _row().alias("row"))  # no name of the table meets those used here
    out = known.join(fate.hint("merge"), "row", "left_anti").select("whole")
    if not fate.filter("kept").isEmpty():  # where no rows are equal texts travel once
        number = F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64("whole")))
        repeated = known.join(fate.filter("kept").hint("merge"), "row", "left_semi").withColumn("nth", number).filter("nth = 1")
        out = out.union(repeated.select("whole"))
    return out.select("whole.*")
