"""WARC archives of page captures and their index.

Each task writes one archive of its captures in order of URL key and time; its index lines are a sorted
run. Runs are merged externally: key ranges of about equal size (a URL with many captures spans several)
are dealt to tasks, and each merges its slices of the runs with a loser tree. Ranges in order give
globally ordered capture histories; a place is the range's base, a prefix sum, plus the place in it.

Of captures with equal payloads of at least ``least`` bytes, that with the smallest id is written as
response, others as revisit records that refer to it. Every record is a gzip member of its own.

Defined cases: a NULL payload is empty, a NULL URL has the empty key, NULL times and ids come first; rows
that repeat are written each, those with the smallest id all as responses; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.shared import plain, uri_filesystem, workspace

LEAST_BYTES = 100
RANGE_ROWS = 200_000  # index lines of a range, which a task holds
RUN = "run string, seq long, urlkey string, time string, id long, kind string, digest string, file string, place long, size long"
FIELDS = ["run", "seq", "urlkey", "time", "id", "kind", "digest", "file", "place", "size"]


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then path and query; scheme, user, port, www and fragment dropped."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\d*\.", "")
    path = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(low == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", time: str | Column | None = None,
    least: int = LEAST_BYTES,
) -> DataFrame:
    """Write the archives; returns the runs, one index line per record."""
    ws = workspace(pages.sparkSession, "warc")
    when = F.lit(None).cast("timestamp") if time is None else (F.col(f"`{time}`") if isinstance(time, str) else time)
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = plain(pages, id=key, url=url, time=F.date_format(when, "yyyyMMddHHmmss"), digest=F.sha2(body, 256), payload=body)
    rows = rows.withColumn("urlkey", url_key(F.col("url")))
    slim = ws.write(rows.select("id", "digest", F.octet_length("payload").alias("bytes")), "digests")
    first = slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("refers"))
    revisits = slim.where(F.col("bytes") >= least).select("id", "digest").distinct().join(first, "digest").where("id > refers")
    marked = rows.join(revisits, ["id", "digest"], "left").sortWithinPartitions("urlkey", "time", "id")
    marked = marked.select("id", "url", "time", "urlkey", "digest", "refers", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = uri_filesystem(folder)
        run, out, place, seq = uuid.uuid4().hex, None, 0, 0
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{root}/{run}.warc.gz", compression=None)
                kind, raw = record(r)
                packed = _gzip(raw)
                out.write(packed)
                lines.append((run, seq, r["urlkey"], r["time"], r["id"], kind, r["digest"], f"{run}.warc.gz", place, len(packed)))
                place, seq = place + len(packed), seq + 1
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), _types())], FIELDS)
        if out is not None:
            out.close()

    fs, root = uri_filesystem(folder)
    fs.create_dir(root, recursive=True)
    return ws.write(marked.mapInArrow(write, RUN), "runs")


def _types() -> list[pa.DataType]:
    return [pa.int64() if f in ("seq", "id", "place", "size") else pa.string() for f in FIELDS]


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def record(r: dict) -> tuple[str, bytes]:
    """Kind and bytes of a capture's record."""
    kind = "response" if r["refers"] is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (r["payload"] or "").encode() if kind == "response" else http
    t = r["time"] or "19700101000000"
    uri = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{r['digest']}",
        f"X-Capture-ID: {'' if r['id'] is None else r['id']}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if kind == "revisit":
        head.insert(2, f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Capture-ID: {r['refers']}")
    return kind, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return fields, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """k-way merge of sorted iterators: each inner node holds the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [0] * self.k
        winner = list(range(self.k))
        nodes = [0] * self.k + winner  # the players below each inner node, leaves last
        for node in range(self.k - 1, 0, -1):
            a, b = nodes[2 * node], nodes[2 * node + 1]
            nodes[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = nodes[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        one, two = self.heads[a], self.heads[b]
        return one is not None and (two is None or (one, a) <= (two, b))

    def __iter__(self) -> Iterator:
        while (item := self.heads[self.winner]) is not None:
            yield item
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def merge_runs(runs: DataFrame) -> DataFrame:
    """All index lines in order of URL key, time and id, with their place in that order."""
    ws = workspace(runs.sparkSession, "captures")
    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[list[dict]] = []
        for batch in batches:
            for r in batch.to_pylist():
                if not slices or slices[-1][-1]["run"] != r["run"]:
                    slices.append([])
                slices[-1].append(r)
        if not slices:
            return
        key = lambda r: (r["urlkey"], r["time"] or "", -(1 << 63) if r["id"] is None else r["id"], r["run"], r["seq"])
        tree = LoserTree([((key(r), r) for r in s) for s in slices])
        lines = [r for _, r in tree]
        cols = [pa.array([r[f] for r in lines], t) for f, t in zip(FIELDS, _types())]
        part = pa.array([TaskContext.get().partitionId()] * len(lines), pa.int32())
        yield pa.RecordBatch.from_arrays([*cols, part, pa.array(range(len(lines)), pa.int64())], [*FIELDS, "part", "local"])

    dealt = runs.repartitionByRange(ranges, "urlkey", "time", "id").sortWithinPartitions("run", "seq")
    merged = ws.write(dealt.mapInArrow(merge, RUN + ", part int, local long"), "merged")
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return merged.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("local")).drop("part", "local", "base", "seq")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(id, url, kind, refers_to, digest, payload_bytes, payload_digest, urlkey, time): the records that
    index lines point to. digest is the one the record states, payload_* are of what it holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = uri_filesystem(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = r["file"], fs.open_input_file(f"{root}/{r['file']}")
                f, payload = parse(zlib.decompress(source.read_at(r["size"], r["place"]), 31))
                who, refers = f["X-Capture-ID"], f.get("X-Refers-To-Capture-ID")
                out.append((
                    int(who) if who else None, f["WARC-Target-URI"], f["WARC-Type"], None if refers is None else int(refers),
                    f["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload), hashlib.sha256(payload).hexdigest(), r["urlkey"], r["time"],
                ))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        if source is not None:
            source.close()

    names = ["id", "url", "kind", "refers_to", "digest", "payload_bytes", "payload_digest", "urlkey", "time"]
    kinds = [pa.int64() if n in ("id", "refers_to", "payload_bytes") else pa.string() for n in names]
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_file = index.select("file", "place", "size", "urlkey", "time").repartitionByRange(tasks, "file", "place").sortWithinPartitions("file", "place")
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, kinds))
    return by_file.mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """The records with the size and digest of the full payload: a revisit has those of its response."""
    ws = workspace(records.sparkSession, "records")
    records = ws.write(records, "records")
    full = records.where("kind = 'response'").groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(
        F.max("payload_bytes").alias("full_bytes")
    )
    joined = records.join(full, ["refers_to", "digest"], "left")
    revisit = F.col("kind") == "revisit"
    return joined.select(
        "id", "url", "kind", "refers_to", "urlkey", "time",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit & F.col("full_bytes").isNotNull(), F.col("digest")).when(~revisit, F.col("payload_digest")).alias("payload_digest"),
    )
