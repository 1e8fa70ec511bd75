"""WARC archives with a two-level capture index.

Level one: sorted index lines (reversed-host URL key, identifier, place of the record) in compressed blocks. Level two: a
sparse directory with the first key and the place of each block, at the end of its index file. A look-up searches the
directory, reads one block, searches in it and reads just the bytes of the record.

Tasks write archives and index files to the shared folder under names that no other attempt uses, and return rows that name
them; these rows are written to Parquet at once. What a lost or repeated attempt leaves is never referred to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, scratch, staged

#: Index lines in a block, and blocks' level of compression.
BLOCK_LINES = 256
TAIL = ">QQ4s"
MAGIC = b"TCI1"
DATE = "2024-01-01T00:00:00Z"


def reversed_host_key(url: Column) -> Column:
    """Host labels from the last to the first, without port and user, then path and query: com,example,blog)/en?x=1.

    Lower-case host, no scheme and no fragment; a null URL is empty.
    """
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r"^.*@|:\d*$", ""))
    rest = F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder; a path without a scheme is local or mounted."""
    if "://" in folder or folder.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return arrow_fs.LocalFileSystem(), folder


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(row, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit carries the headers of its response, with the length it had, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row.record_type == "revisit"
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <urn:page:{row.ident}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(row.url)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row.refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(value: str | None) -> str:
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _gzip(data: bytes) -> bytes:
    """One gzip member, so that every record can be read alone."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (those of the HTTP response with the prefix "http:") and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not the start of a record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields |= {f"http:{k}": v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return fields, payload


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, key, ident, record_type and refers_to (an ident).

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id (null smallest; of a
    repeated one, that with the largest digest of its row) is the response and the others revisit it; shorter ones are all
    responses. Rows equal in every column have one ident and one type, and a record each. Null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    h = row_key(pages, 5)
    ident = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("-"), F.hex(h))
    rows = pages.select(
        "page_id", "url", payload.alias("html"), reversed_host_key(F.col("url")).alias("key"), ident.alias("ident"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"), h.alias("h"),
    )
    best = rows.groupBy("digest").agg(F.max(F.struct("page_id", "h", "ident")).alias("best")).select(F.col("digest").alias("of"), F.col("best.ident").alias("first"))
    joined = rows.join(best, F.col("digest") == F.col("of"))
    revisit = (F.col("size") >= least_bytes) & (F.col("ident") != F.col("first"))
    return joined.select("page_id", "url", "html", "key", "ident", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Writes the records of ``with_record_types`` as .warc.gz files; returns key, ident, file, at and size of each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for row in batch.itertuples(index=False):
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = _gzip(_record(row, row.html.encode()))
                    out.write(member)
                    found.append((row.key, row.ident, name, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(found, columns=["key", "ident", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return staged(records.mapInPandas(write, "key string, ident string, file string, at long, size long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorted index files over all captures; returns one row per index file: its first key and ident, its name and lines."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, at, lines, directory, total = f"{uuid.uuid4().hex}.tci", None, 0, [], [], 0

        def flush():
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            out.write(block)
            directory.append([lines[0][0], lines[0][1], at, len(block)])
            at += len(block)
            lines.clear()

        for batch in batches:
            if out is None and len(batch):
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            for row in batch.itertuples(index=False):
                lines.append([row.key, row.ident, row.file, int(row.at), int(row.size)])
                total += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed)
            out.write(struct.pack(TAIL, at, len(packed), MAGIC))
            out.close()
            yield pd.DataFrame([(directory[0][0], directory[0][1], name, total)], columns=["key", "ident", "file", "lines"])

    # compared as bytes by Spark and as code points by Python: the same order
    ordered = captures.repartitionByRange("key", "ident").sortWithinPartitions("key", "ident")
    return staged(ordered.mapInPandas(write, "key string, ident string, file string, lines long"), "capture-index")


class _Index:
    """Binary search over index files: which file, which block of it, which line of the block."""

    def __init__(self, folder: str, files: list[tuple[str, str, str]]):
        self.store, self.root = _open(folder)
        self.firsts = [(key, ident) for key, ident, _ in files]
        self.files = [name for _, _, name in files]
        self.opened: tuple[int, object, list] | None = None
        self.block: tuple[int, int, list] | None = None

    def _directory(self, n: int):
        if self.opened is None or self.opened[0] != n:
            handle = self.store.open_input_file(f"{self.root}/{self.files[n]}")
            size = handle.size()
            at, length, magic = struct.unpack(TAIL, handle.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
            if magic != MAGIC:
                raise ValueError(f"{self.files[n]} is not an index file")
            self.opened = (n, handle, json.loads(zlib.decompress(handle.read_at(length, at))))
        return self.opened

    def _lines(self, n: int, b: int) -> list:
        if self.block is None or self.block[:2] != (n, b):
            _, handle, directory = self._directory(n)
            _, _, at, length = directory[b]
            self.block = (n, b, [json.loads(line) for line in zlib.decompress(handle.read_at(length, at)).split(b"\n")])
        return self.block[2]

    def find(self, key: str, ident: str) -> Iterator[list]:
        """Lines of a key and ident; of all idents of the key where ``ident`` is empty."""
        wanted = (key, ident)
        n = max(bisect.bisect_left(self.firsts, wanted) - 1, 0)
        for n in range(n, len(self.files)):
            directory = self._directory(n)[2]
            b = max(bisect.bisect_left(directory, wanted, key=lambda e: (e[0], e[1])) - 1, 0)
            for b in range(b, len(directory)):
                lines = self._lines(n, b)
                for line in lines[bisect.bisect_left(lines, wanted, key=lambda e: (e[0], e[1])):]:
                    if line[0] != key or (ident and line[1] != ident):
                        return
                    yield line


def read_captures(requests: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Records of the requested captures: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    ``requests`` has key and ident; an empty or null ident asks for all captures of the key. Requests are distinct, sorted and
    dealt by range, so a task walks through a stretch of the index once. The driver reads the list of index files, one row
    per file and so as many as the range partitions that wrote them.
    """
    files = sorted((r["key"], r["ident"], r["file"]) for r in index.collect())

    def number(ident: str | None):
        head = (ident or "null").rpartition("-")[0].removeprefix("<urn:page:")
        return None if head in ("null", "") else int(head)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _Index(folder, files)
        open_files: dict[str, object] = {}

        def frame(rows: list[tuple]) -> pd.DataFrame:
            columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

        for batch in batches:
            found, held = [], 0
            for key, ident in zip(batch["key"], batch["ident"], strict=True):
                for _, _, name, at, size in search.find(key, ident):
                    if name not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        open_files[name] = search.store.open_input_file(f"{search.root}/{name}")
                    fields, payload = parse_record(open_files[name].read_at(size, at))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    found.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["http:Content-Length"]), digest, kind, refers, payload))
                    held += len(payload)
                    if held > 1 << 24:
                        yield frame(found)
                        found, held = [], 0
            if found:
                yield frame(found)

    wanted = requests.select("key", F.coalesce("ident", F.lit("")).alias("ident")).distinct().repartitionByRange("key", "ident").sortWithinPartitions("key", "ident")
    return wanted.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame, DataFrame]:
    """Writes archives and index of all pages; returns the folder, the captures and the list of index files."""
    folder = folder or scratch(pages.sparkSession, "warc")
    captures = write_archives(with_record_types(pages), folder)
    return folder, captures, write_index(captures, folder)


def look_up(urls: DataFrame, folder: str, index: DataFrame) -> DataFrame:
    """All captures of the URLs in column ``url``."""
    return read_captures(urls.select(reversed_host_key(F.col("url")).alias("key"), F.lit("").alias("ident")), index, folder)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes every page, then reads every record back through the index. An empty table gives no rows."""
    folder, captures, index = archive(pages)
    back = read_captures(captures.select("key", "ident"), index, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
