"""WARC archives: write captures, read them back, keep an external index of histories.

Captures are written as gzip members of WARC/1.1 records into archives held as rows of
bytes (any shared store that Spark writes to; `export` puts them into plain files). Equal
payloads are stored once: the capture of smallest page_id is the response, the others are
revisit records that name it; `payloads` resolves them. Each archive part, when read, is a
run of index rows sorted by URL key and timestamp, stored as blocks of at most BLOCK rows.
Runs are merged externally: blocks come to a task in the order of their first rows (Spark
sorts and spills them), a loser tree over the blocks under way gives the next row, and only
blocks that reach the current row are held, so memory is the fan-in times a block. While
there are more than FAN_IN runs, groups of about FAN_IN are merged to longer stored runs; the
last merge is cut by ranges of the key, blocks being split at the cuts, so that ranges in
order are one globally ordered history.

Defined results: null html is an empty payload; null url is an empty target; repeated rows
(equal page_id and payload) are equal records; a null page_id comes before all others;
payloads below ``least_bytes`` are always responses; extra columns are ignored; an empty
table gives an empty result. A page or URL of any number of captures is dealt by payload
or by key, time and place in the archives, never as one group.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm.kernels import lean, small_batches
from emberlake.llm.scratch import Scratch, shuffle_partitions

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PART_BYTES = 4 << 20  # bytes of a row of an archive
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
FIRST = -(1 << 63)
BLOCK = 512  # index rows of a block of a run
FAN_IN = 256  # runs that are merged at once
SAMPLE, PROBES = 20, 8  # rows a range that cuts are chosen from, and rows of a block that may be among them


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort-friendly form: reversed host, path, sorted query; scheme, www and fragment do not count."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if len(labels) > 2 and labels[0].startswith("www") and (labels[0][3:].isdigit() or labels[0] == "www"):
        labels = labels[1:]
    at = "" if port in (None, 80, 443) else f":{port}"
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{','.join(reversed(labels))}{at}){u.path or '/'}{'?' + query if query else ''}".lower()


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, first_id: int | None) -> bytes:
    """One WARC record as a gzip member."""
    when = EPOCH + timedelta(seconds=(page_id or 0) % 10**9)
    size = len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    safe = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": safe,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(size),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{'' if first_id is None else first_id}>"}
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(31)
        out = d.decompress(view[at:]) + d.flush()
        if not d.eof:
            raise ValueError("truncated gzip member")
        end = len(data) - len(d.unused_data)
        yield at, end - at, out
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return fields, block


def _page(urn: str | None) -> int | None:
    if urn is None:
        return None
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


ARCHIVES = "archive string, part int, data binary"


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Archives of all rows of ``pages`` (page_id, url, html), as a stored table."""
    p = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(FIRST)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    slim = p.select("page_id", F.sha1(F.col("html").cast("binary")).alias("dig"), F.octet_length("html").alias("size")).filter(F.col("size") >= least_bytes)
    firsts = slim.groupBy("dig", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # slim rows meet the first captures by payload, so that html is dealt by page only
    later = slim.join(firsts, ["dig", "size"]).filter("page_id <> first_id").select("page_id", "dig", "first_id").distinct()
    rows = p.withColumn("dig", F.sha1(F.col("html").cast("binary"))).join(later, ["page_id", "dig"], "left").select("page_id", "url", "html", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"captures-{TaskContext.get().partitionId():06d}"
        held, size, part = [], 0, 0
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = html.as_py().encode("utf-8", "surrogatepass")
                page, first_id = page_id.as_py(), first.as_py()
                kind = "response" if first_id is None else "revisit"
                got = record(kind, None if page == FIRST else page, url.as_py(), payload, sha1_base32(payload), None if first_id == FIRST else first_id)
                held.append(got)
                size += len(got)
                if size >= PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "part", "data"])
                    held, size, part = [], 0, part + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "part", "data"])

    small_batches(pages.sparkSession)
    return scratch.keep(rows.mapInArrow(lean(run), ARCHIVES), "archives")


INDEX = "run string, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, part int, offset long, length long"
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    spec = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(spec)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, (_, t) in zip(cols, spec, strict=True)], [n for n, _ in spec])


BLOCKS = "run string, url_key string, captured string, page_id long, archive string, part int, offset long, body binary"
HEAD = ("url_key", "captured", "page_id", "archive", "part", "offset")


def _order(row: tuple) -> tuple:
    """URL key, timestamp, page, then the record's place: no two rows are equal."""
    return (row[1], row[2], FIRST if row[3] is None else row[3], row[9], row[10], row[11])


def _blocks(run: str, rows: list[tuple]) -> Iterator[tuple]:
    """Sorted index rows as stored blocks, each with the order of its first row."""
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        batch = _batch(part, INDEX)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield (run, *_order(part[0]), sink.getvalue().to_pybytes())


def _rows(body: bytes) -> list[tuple]:
    with pa.ipc.open_stream(body) as stream:
        return [row for batch in stream for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def _block_batch(rows: list[tuple], extra: str = "") -> pa.RecordBatch:
    spec = [c.split() for c in (BLOCKS + extra).split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(spec)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, (_, t) in zip(cols, spec, strict=True)], [n for n, _ in spec])


def read_archives(archives: DataFrame) -> DataFrame:
    """Locally sorted runs of index rows, one for each archive part, as blocks; payloads are read back and checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, part, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                name, number, rows = archive.as_py(), part.as_py(), []
                for offset, length, raw in members(data.as_py()):
                    head, block = parse(raw)
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if sha1_base32(payload) != digest or len(payload) != size:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    url = head.get("WARC-Target-URI", "")
                    rows.append((f"{name}/{number}", url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, kind, _page(head.get("WARC-Refers-To")), url, name, number, offset, length))
                rows.sort(key=_order)
                yield _block_batch(list(_blocks(f"{name}/{number}", rows)))

    return archives.mapInArrow(lean(run), BLOCKS)


def payloads(archives: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, payload) of every capture of ``index``, those of revisits taken from the response that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(2):
                got = [(head, block) for head, block in (parse(raw) for _, _, raw in members(data.as_py())) if head["WARC-Type"] == "response"]
                ids, digests = [_page(h["WARC-Record-ID"]) for h, _ in got], [h["WARC-Payload-Digest"].removeprefix("sha1:") for h, _ in got]
                bodies = [b.partition(b"\r\n\r\n")[2] for _, b in got]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())], ["held_by", "held_digest", "payload"])

    held = archives.mapInArrow(lean(run), "held_by long, held_digest string, payload binary").dropDuplicates(["held_by", "held_digest"])
    wanted = index.select("page_id", F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.col("page_id")).alias("of"), "payload_digest")
    return wanted.join(held, F.col("of").eqNullSafe(F.col("held_by")) & (F.col("payload_digest") == F.col("held_digest"))).select("page_id", "payload")


class LoserTree:
    """K-way merge: each inner node holds the loser of its match, the overall winner stands on top.

    Taking the winner replays only its path to the root: one comparison a level.
    """

    def __init__(self, runs: list[list], key, at: list[int] | None = None):
        self.runs, self.key = runs, key
        self.at = list(at or [0] * len(runs))
        self.k = max(1, len(runs))
        self.heads = [(key(r[a]), i) if a < len(r) else None for i, (r, a) in enumerate(zip(runs, self.at, strict=True))]
        self.nodes = [-1] * self.k
        self.winner = self._build(1) if len(runs) > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        self.nodes[node] = b if not self._less(b, a) else a
        return a if not self._less(b, a) else b

    def until(self, end=None) -> Iterator:
        """Rows in order, those before ``end`` if given."""
        while self.runs and (head := self.heads[self.winner]) is not None and (end is None or head[0] < end):
            i = self.winner
            run = self.runs[i]
            yield run[self.at[i]]
            self.at[i] += 1
            self.heads[i] = (self.key(run[self.at[i]]), i) if self.at[i] < len(run) else None
            node = (i + self.k) // 2
            while node >= 1:
                if self._less(self.nodes[node], i):
                    i, self.nodes[node] = self.nodes[node], i
                node //= 2
            self.winner = i

    def __iter__(self) -> Iterator:
        return self.until()

    def rest(self) -> tuple[list[list], list[int]]:
        """Runs that are not used up, and how far each is read."""
        left = [(r, a) for r, a in zip(self.runs, self.at, strict=True) if a < len(r)]
        return [r for r, _ in left], [a for _, a in left]


def merged(blocks: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple]:
    """Rows in order of blocks (order of the first row, body) that come by their first rows."""
    tree = LoserTree([], _order)
    for first, body in blocks:
        yield from tree.until(first)
        runs, at = tree.rest()
        tree = LoserTree([*runs, _rows(body)], _order, [*at, 0])
    yield from tree


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Merged rows of each group of blocks, which come by group; a group's rows must be used before the next is asked for."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(batch.column(c)[i].as_py() for c in range(9))

    for group, found in itertools.groupby(rows(), key=lambda x: x[8]):
        yield group, merged((x[1:7], x[7]) for x in found)


def _longer_runs(level: int):
    """Groups of runs as one run each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _by_group(batches):
            while part := list(itertools.islice(rows, BLOCK)):
                yield _block_batch(list(_blocks(f"level{level}/{group}", part)))

    return run


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_group(batches):
        while part := list(itertools.islice(rows, 8192)):
            yield _batch(part, INDEX)


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Orders of up to PROBES evenly spaced rows of each block."""
    kinds = [KINDS[c.split()[1]] for c in BLOCKS.split(", ") if c.split()[0] in HEAD]
    for batch in batches:
        out = []
        for body in batch.column(7):
            rows = _rows(body.as_py())
            step = -(-len(rows) // PROBES)
            out += [_order(r) for r in rows[step // 2 :: step]]
        cols = list(zip(*out, strict=True)) or [[]] * len(HEAD)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(HEAD))


def _dealt(cuts: list[tuple]):
    """Blocks with the range that they fall into, split where a cut goes through them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                rows = _rows(batch.column(7)[i].as_py())
                keys = list(map(_order, rows))
                low, high = bisect_right(cuts, keys[0]), bisect_right(cuts, keys[-1])
                if low == high:
                    out.append((*(batch.column(c)[i].as_py() for c in range(8)), low))
                    continue
                ends = [bisect_left(keys, c) for c in cuts[low:high]]
                for r, (a, b) in enumerate(zip([0, *ends], [*ends, len(rows)], strict=True)):
                    out += [(*x, low + r) for x in _blocks(rows[0][0], rows[a:b])]
            yield _block_batch(out, ", range int")

    return run


def merge_runs(blocks: DataFrame, parts: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Runs merged into one history: partitions in order, each ordered by URL key, timestamp, page and place."""
    spark = blocks.sparkSession
    parts = parts or shuffle_partitions(spark)
    scratch, level = Scratch(spark, "warc-runs"), 0
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    while (runs := blocks.agg(F.approx_count_distinct("run", 0.02)).first()[0]) > fan_in:
        groups = -(-runs // fan_in)
        grouped = blocks.select(*names, F.pmod(F.xxhash64("run", F.lit(level)), F.lit(groups)).cast("int").alias("group"))
        longer = grouped.repartition(min(groups, parts), "group").sortWithinPartitions("group", *HEAD).mapInArrow(lean(_longer_runs(level)), BLOCKS)
        after = scratch.keep(longer, f"level{level}")
        scratch.drop(blocks)
        blocks, level = after, level + 1
    # about SAMPLE rows a range come to the driver, from all over the blocks: first rows alone are the least of their runs
    share = min(1.0, SAMPLE * parts / max(1, PROBES * blocks.count()))
    keys = blocks.select(names).mapInArrow(lean(_probes), ", ".join(c for c in BLOCKS.split(", ") if c.split()[0] in HEAD))
    seen = sorted(tuple(r) for r in keys.sample(share, 7).collect())
    cuts = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    dealt = blocks.select(names).mapInArrow(lean(_dealt(cuts)), BLOCKS + ", range int")
    return dealt.repartitionByRange(parts, "range").sortWithinPartitions("range", *HEAD).mapInArrow(lean(_final), INDEX)


def history(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives, read them back and give the merged capture history."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, scratch, least_bytes)
    runs = scratch.keep(read_archives(archives), "runs")
    scratch.drop(archives)  # `write_archives` keeps them for callers that want the records
    return merge_runs(runs)


def export(archives: DataFrame, folder: str) -> None:
    """Write archives as plain .warc.gz files into a folder that this process can reach; a part at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    for row in archives.orderBy("archive", "part").toLocalIterator():
        with open(os.path.join(folder, f"{row.archive}.warc.gz"), "ab" if row.part else "wb") as f:
            f.write(row.data)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives (one part each) from .warc.gz files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.lit(0).alias("part"), F.col("content").alias("data"))
