"""WARC archives with deduplicated payloads, and their index: sorted runs merged by a loser tree.

Writing gives archives of gzip members, one record each. Reading an archive back gives its captures sorted by URL key
and timestamp, a run. Runs are cut at the same keys, and each task merges its stretch of all runs by a loser tree, so
that the parts, one after the other, are one index in the order of URL key, timestamp and page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import by_file, new_path, small, written

#: Bytes of an archive after which the next one begins; captures that a merging task gets, about.
ARCHIVE_BYTES, MERGE_ROWS = 16 << 20, 200_000
#: When captures were fetched if the table doesn't say.
FETCHED = datetime(2024, 1, 1, tzinfo=UTC)
_CAPTURE = "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"
_NAMES = re.findall(r"(\w+) \w+", _CAPTURE)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then port, path and query; '-' for none."""
    try:
        u = urlsplit((url or "").strip())
        host = ",".join(reversed(re.sub(r"^www\d*\.", "", (u.hostname or "").rstrip(".")).split(".")))
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:  # brackets or a port that can't be read
        return f"-){url}"
    return f"{host}{port}){u.path.lower() or '/'}{'?' + u.query.lower() if u.query else ''}" if host else f"-){url or ''}"


def _record(page: int | None, url: str | None, when: datetime, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit has the response's head only, which says how long the payload was."""
    name = lambda i: f"<urn:x-page:{'-' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {when.strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
        head.append("X-Target-Text: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file, which is read in pieces."""
    at, base, rest = 0, 0, b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    if out:
                        raise ValueError("the archive is cut short")
                    return
            out.append(z.decompress(rest))
            base += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield at, b"".join(out)
        at = base


def _capture(at: int, archive: str, record: bytes) -> tuple:
    """A row of _CAPTURE for a record, whose payload is held against its digest."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record at {at} of {archive} isn't what it was")
    page = lambda f: None if f is None or f == "<urn:x-page:->" else int(f[len("<urn:x-page:") : -1])
    url = base64.b64decode(fields["X-Target-Text"]).decode("utf-8", "surrogatepass") if "X-Target-Text" in fields else None
    when = re.sub(r"\D", "", fields["WARC-Date"])
    return url_key(url), when, page(fields["WARC-Record-ID"]), url, size, digest, kind, page(fields.get("WARC-Refers-To")), archive, at


def _order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[8], c[9]


class LoserTree:
    """Merges k sorted iterators: inner nodes keep the losers of their matches, so each row costs one path of matches."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.head = [self._next(i) for i in range(len(runs))] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _loses(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is None or y is not None and (y[0], b) < (x[0], a)

    def _play(self, i: int) -> None:
        """Run i goes up from its leaf; at a free node it waits for its match."""
        node = (i + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._loses(i, self.tree[node]):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.head[i := self.tree[0]] is not None:
            yield self.head[i][1]
            self.head[i] = self._next(i)
            self._play(i)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if k == "string" else pa.int64() for k in re.findall(r"\w+ (\w+)", _CAPTURE)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            for page, url, html, when, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:  # another attempt writes another file
                    name, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = _record(page, url, when or FETCHED, payload, base32_sha1(payload), refers_to, revisit)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= most:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [records]})

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, time_col: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record for every page; returns the folder and its manifest (archive, bytes, records).

    Of pages with equal payloads (UTF-8 of html, null: empty) of at least min_bytes, those with the largest page_id are
    responses and others revisit it. Null ids come below all others. Only archives in the manifest count, so a task
    that runs again leaves nothing wrong. Other columns are ignored.
    """
    folder = new_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    when = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", when.alias("fetched"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    keyed = written(rows.where(F.col("size") >= min_bytes).select("page_id", "sha1"), "digests")
    repeated = keyed.groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("sha1", "newest")
    # digests meet page ids without the payloads, and these only what revisits another page
    revisits = keyed.join(small(written(repeated, "repeated")), "sha1").where(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")))
    revisits = small(written(revisits.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "newest").distinct(), "revisits"))
    joined = rows.join(revisits, rows.page_id.eqNullSafe(revisits.p) & (rows.sha1 == revisits.s), "left")
    made = joined.select("page_id", "url", "html", "fetched", F.col("newest").isNotNull().alias("revisit"), F.col("newest").alias("refers_to"))
    return folder, written(made.mapInArrow(_write(folder, archive_bytes), "archive string, bytes long, records long"), "manifest")


def merged_index(folder: str, manifest: DataFrame) -> DataFrame:
    """The captures of all archives (_CAPTURE) in the order of url_key, timestamp and page_id, part after part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, _ = FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(archive, compression=None) as f:
                    run = sorted((_capture(at, archive, r) for at, r in _members(f)), key=_order)
                for k in range(0, len(run), 4096):
                    yield _batch(run[k : k + 4096])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[8], []).append(row)  # rows of one run come in its order
        held: list[tuple] = []
        for row in LoserTree([iter(r) for r in runs.values()], _order):
            held.append(row)
            if len(held) == 4096:
                yield _batch(held)
                held = []
        yield _batch(held)

    spark = manifest.sparkSession
    captures = written(by_file(manifest.select("archive")).mapInArrow(read, _CAPTURE), "runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // MERGE_ROWS))
    keys = ["url_key", "timestamp", "page_id"]
    cut = captures.repartitionByRange(parts, *keys).sortWithinPartitions("archive", *keys, "at")
    return cut.mapInArrow(merge, _CAPTURE)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives and reads them back through the merged index: a row of _CAPTURE for each page."""
    return merged_index(*write_archives(pages, min_bytes))
