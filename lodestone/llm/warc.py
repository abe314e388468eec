"""WARC archives of web pages and a two-level capture index over them.

Writing: each task streams its pages into archives of one gzip member a record. Of records with
equal payloads the one of the largest page_id is the response; the others are revisits of it. Only
digests are shuffled to find payloads that occur more than once. A bit map of fixed size marks their
digests: pages that it does not know are written where they are read, the others (copies, and a few
strangers) are staged and joined with the response of their digest.

Index: the captures are sorted by key (reversed host, then path) and page_id into range shards. A
shard file is a run of compressed blocks followed by a sparse directory with the first key and
page_id of each block. A look-up searches the list of shards, then the shard's directory, then one
block, and reads the record's byte range from its archive. One key may fill many shards.

Archives, shards and the shard list lie in a folder that all executors reach. File names are
unique to a task attempt and only names that a finished task returned are used, so lost or
repeated tasks do no harm (what they left is not listed).

Defined cases: null html is an empty payload; a null url is empty; line ends in a url are
percent-encoded; a null page_id comes before all others and is read back as null; rows with the same
page_id and url are separate captures, read back as often as they were written; of several records
of the largest page_id, or of none with an id, exactly one is the response (a revisit of a response
without an id refers to null); payloads of any length are written whole, a record at a time; an empty table gives no archives; extra columns are ignored; a page that
the index does not hold has no record, and is an error where all are said to be held.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bit_map, map_arrow, marked, shared_dir, stage

#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 1 << 28
#: Captures of one compressed index block.
BLOCK_ROWS = 512
#: Open files of a reading task.
OPEN_FILES = 64
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """The pyarrow file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def url_key(url: str) -> str:
    """com,example,blog)/path?query: reversed lower-case host without www, port 80/443 or fragment."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?([^#]*)", url)
    if not m:
        return url.partition("#")[0]
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    port = f":{m[2]}" if m[2] not in (None, "", "80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def place(key: str, page_id: int | None) -> tuple:
    """Where a capture stands in the index."""
    return key, page_id is not None, page_id or 0


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str, revisit: bool | None = None) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's HTTP header."""
    revisit = refers_to is not None if revisit is None else revisit
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Page-Id: {page_id}",
    ]
    body = _HTTP % len(payload)
    if not revisit:
        body += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields (lower-case names) of a record, its payload and its payload's full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"content-length: (\d+)", http, re.I)[1])
    return fields | {"payload": payload, "payload-length": length}


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, revisit and refers_to of each record."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("mark", F.xxhash64("sha"))
    often = rows.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("sha").alias("mark"))
    held = bit_map(often, "mark")

    def of(known: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                hit = marked(held, batch.column(4).to_numpy())
                yield batch.filter(pa.array(hit if known else ~hit))

        return rows.mapInArrow(run, rows.schema)

    copies = stage(of(True).withColumn("row", F.monotonically_increasing_id()), "payload-copies")
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "row"))
    keepers = copies.groupBy("sha").agg(last.alias("last")).select("sha", F.col("last.row").alias("kept"), F.col("last.page_id").alias("response_id"))
    revisit = F.col("row") != F.col("kept")
    copies = copies.join(stage(keepers, "responses"), "sha").select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("response_id")).alias("refers_to"))
    return of(False).select("page_id", "url", "payload", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to")).union(copies)


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the records; gives url_key, page_id, file, offset and length of each capture."""

    def run(batches):
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for lo in range(0, len(batch), 256):
                rows = {k: [] for k in ("url_key", "page_id", "file", "offset", "length")}
                for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, payload, refers_to, date, revisit), 6, mtime=0)
                    out.write(member)
                    for k, v in zip(rows, (url_key(url), page_id, name, at, len(member)), strict=True):
                        rows[k].append(v)
                    at += len(member)
                yield rows
        if out is not None:
            out.close()

    return stage(map_arrow(records, run, "url_key string, page_id long, file string, offset long, length long"), "captures")


@dataclass
class CaptureIndex:
    """The shard list: first and last (key, page_id) and file of each shard, one for each range partition."""

    folder: str
    shards: list[tuple[tuple[str, bool, int], tuple[str, bool, int], str]]


def build_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> CaptureIndex:
    """Sorts the captures by key into shards of compressed blocks with a sparse directory."""
    ordered = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")

    def run(batches):
        store, root = file_system(folder)
        name = f"{uuid.uuid4().hex}.cdx"
        out, directory, block, at, last = None, [], [], 0, None

        def flush():
            nonlocal at, last
            packed = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in block).encode("utf-8", "surrogatepass"), 6)
            out.write(packed)
            directory.append((*block[0][:2], at, len(packed)))
            at, last = at + len(packed), block[-1][:2]
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                block.append(row)
                if len(block) == block_rows:
                    flush()
        if block:
            flush()
        if out is not None:
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + struct.pack("<Q", len(packed)))
            out.close()
            yield {"first": [directory[0][0]], "first_id": [directory[0][1]], "last": [last[0]], "last_id": [last[1]], "file": [name]}

    shards = map_arrow(ordered, run, "first string, first_id long, last string, last_id long, file string").collect()
    return CaptureIndex(folder, sorted((place(r.first, r.first_id), place(r.last, r.last_id), r.file) for r in shards))


class IndexReader:
    """Look-ups of one task; remembers the directories it has opened and the last block."""

    def __init__(self, index: CaptureIndex):
        self.index, (self.store, self.root) = index, file_system(index.folder)
        self.firsts = [s[0] for s in index.shards]
        self.directories: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()
        self.block = (None, [])

    def open(self, name: str):
        if name not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.store.open_input_file(f"{self.root}/{name}")
        self.files.move_to_end(name)
        return self.files[name]

    def directory(self, name: str):
        if name not in self.directories:
            if len(self.directories) >= OPEN_FILES:
                self.directories.popitem(last=False)
            f = self.open(name)
            end = f.size()
            n = struct.unpack("<Q", f.read_at(8, end - 8))[0]
            found = json.loads(zlib.decompress(f.read_at(n, end - 8 - n)))
            self.directories[name] = ([place(*d[:2]) for d in found], [d[2:] for d in found])
        return self.directories[name]

    def rows(self, name: str, at: int, length: int) -> list:
        if self.block[0] != (name, at):
            raw = zlib.decompress(self.open(name).read_at(length, at)).decode("utf-8", "surrogatepass")
            self.block = ((name, at), [json.loads(x) for x in raw.split("\n")])
        return self.block[1]

    def captures(self, key: str):
        """All captures of a key: (url_key, page_id, file, offset, length)."""
        return self.search(key, lambda r: r[0])

    def capture(self, key: str, page_id: int | None) -> list:
        """The captures of one page: shards, blocks and rows are searched by (key, page_id)."""
        return list(self.search(place(key, page_id), lambda r: r))

    def search(self, want, part):
        """The rows whose part (of their place) is wanted; nothing wanted stands before the
        last shard or block that starts below it, nor from the first one on that starts above it."""
        shards = self.index.shards
        k = max(0, bisect.bisect_left(self.firsts, want, key=part) - 1)
        while k < len(shards) and part(self.firsts[k]) <= want:
            if part(shards[k][1]) >= want:
                firsts, directory = self.directory(shards[k][2])
                j = max(0, bisect.bisect_left(firsts, want, key=part) - 1)
                while j < len(firsts) and part(firsts[j]) <= want:
                    rows = self.rows(shards[k][2], *directory[j])
                    i = bisect.bisect_left(rows, want, key=lambda r: part(place(*r[:2])))
                    while i < len(rows) and part(place(*rows[i][:2])) == want:
                        yield rows[i]
                        i += 1
                    j += 1
            k += 1

    def record(self, file: str, offset: int, length: int) -> dict:
        return parse(gzip.decompress(self.open(file).read_at(length, offset)))


def read_back(requests: DataFrame, index: CaptureIndex, all_held: bool = False) -> DataFrame:
    """The records of all requested (url, page_id): what their archives hold, found through the index.

    With all_held, a requested page without a record is an error.
    Requests are sorted by key, so that a task searches few shards and decompresses a block once."""

    def keys(batches):
        for b in batches:
            yield {"url_key": [url_key(u or "") for u in b.column(0).to_pylist()], "page_id": b.column(1)}

    keyed = map_arrow(requests.select("url", F.col("page_id").cast("long")), keys, "url_key string, page_id long")
    # a fixed number of ranges: keys are short, but the records behind them are not
    ranges = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = keyed.distinct().repartitionByRange(ranges, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches):
        reader = IndexReader(index)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                found = []
                for key, page_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held = reader.capture(key, page_id)
                    if all_held and not held:
                        raise ValueError(f"the index does not hold page {page_id} of {key!r}")
                    found += [r[2:5] for r in held]
                rows = []
                for file, offset, length in sorted(found):
                    r = reader.record(file, offset, length)
                    named = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and (digest(r["payload"]) != named or len(r["payload"]) != r["payload-length"]):
                        raise ValueError(f"{file} at {offset}: the payload is damaged")
                    to = r.get("refers-to-page-id")
                    rows.append((None if r["page-id"] == "None" else int(r["page-id"]), r["payload-length"], named, r["warc-type"], None if to in (None, "None") else int(to), r["warc-target-uri"], r["payload"]))
                if rows:
                    yield dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"), map(list, zip(*rows, strict=True)), strict=True))

    return map_arrow(asked, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> CaptureIndex:
    """Writes archives and index of all pages below folder (default: a new one in the shared folder)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/lodestone/warc-{uuid.uuid4().hex}"
    return build_index(write_archives(plan_records(pages, id_col, url_col, html_col), folder), folder)
