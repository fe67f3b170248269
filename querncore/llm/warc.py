"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

An archive is a row of records, each a gzip member of its own (or plain). Beside an archive lies an index: the records' byte offsets, 8 bytes each.

Reading. The driver lists archives and cuts them into byte ranges; a task owns the records that start in its range, found in the index by a search. Of each
record the headers are inflated and parsed first. Predicates on the record type and on other headers are pushed down to there: a record that fails one, or
whose payload no column asks for, is left behind at that point, its payload neither inflated nor decoded, and not even read where it is long. Archives from elsewhere, with no
index, are read as a stream, a task each. The schema a reader is given says which columns it makes.

Writing. A task writes archives under names of its own; a commit adds a manifest that names what the successful attempts wrote. Readers go by the manifests, so
a lost executor's half archive is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querncore.llm.common import new_path, small_batches
from querncore.llm.records import index_path, opened

#: Columns and the headers they come from; any other column of a given schema is the header of its name, with - for _.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_length": "Content-Length"}
#: Columns that need more than a record's own headers.
BEYOND = {"payload", "payload_bytes", "headers"}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, content_length long, source_id long, refers_to_source_id long, payload_bytes long, headers map<string,string>, payload binary"
#: Bytes of a partition, of what is read ahead, of a batch's payloads, of the first look into a record, and of an archive.
RANGE, AHEAD, BATCH, LOOK, ARCHIVE = 32 << 20, 1 << 20, 8 << 20, 4096, 1 << 30
END = b"\r\n\r\n"


# --- writing


def shown(value) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), str(value))


def head(first: str, headers: list[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {shown(v)}\r\n" for k, v in headers if v is not None), "\r\n"]).encode()


def record_id(source_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{source_id}:{digest}')}>"


def record(kind: str, source_id: int | None, uri: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])
    block = http + (payload or b"") if kind == "response" else http
    own: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", record_id(source_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Source-Id", source_id)]
    if kind == "revisit":
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Source-Id", refers_to)]
    own += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return head("WARC/1.1", own) + block + END


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Written(ds.WriterCommitMessage):
    archives: list[dict] = field(default_factory=list)


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows: record_type, source_id, target_uri, payload_digest (hex), payload_bytes, payload, refers_to_source_id."""

    def __init__(self, options: dict):
        self.top, self.level, self.most = options["path"].rstrip("/"), int(options.get("level", 4)), int(options.get("archive_bytes", ARCHIVE))
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = opened(self.top)
        fs.create_dir(top, recursive=True)
        done, out, index, at, n, name = Written(), None, None, 0, 0, ""

        def put(data: bytes):
            nonlocal at, n
            data = member(data, self.level) if self.level else data
            index.write(struct.pack("<Q", at))
            out.write(data)
            at, n = at + len(data), n + 1

        def close():
            out.close()
            index.close()
            done.archives.append({"name": name, "bytes": at, "records": n})

        for b in iterator:
            rows = zip(*(b.column(c).to_pylist() for c in ("record_type", "source_id", "target_uri", "payload_digest", "payload_bytes", "payload", "refers_to_source_id")))
            for row in rows:
                if out is not None and at >= self.most:
                    close()
                    out = None
                if out is None:
                    name, at, n = f"{uuid.uuid4().hex}.warc{'.gz' * bool(self.level)}", 0, 0
                    out, index = fs.open_output_stream(f"{top}/{name}", compression=None), fs.open_output_stream(index_of(f"{top}/{name}"))
                    about = b"software: querncore\r\nformat: WARC File Format 1.1\r\n"
                    put(head("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]) + about + END)
                put(record(*row, self.date))
        if out is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = opened(self.top)
        fs.create_dir(top, recursive=True)
        lines = [json.dumps(a) for m in messages if m for a in m.archives]
        with fs.open_output_stream(f"{top}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write("".join(x + "\n" for x in lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = opened(self.top)
        for a in (a for m in messages if m for a in m.archives):
            for path in (f"{top}/{a['name']}", index_of(f"{top}/{a['name']}")):
                fs.delete_file(path)


def index_of(path: str) -> str:
    return index_path(re.sub(r"\.warc(\.gz)?$", ".rec", path))


# --- reading


@dataclass
class Range(ds.InputPartition):
    """Records of an archive that start at ``start`` and before ``end``; end -1: the whole archive, which has no index."""

    path: str
    start: int
    end: int
    size: int


#: What pushed predicates test; a null value passes only where a test says so.
TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda f: lambda v: v is not None and v == f.value,
    ds.EqualNullSafe: lambda f: lambda v: v == f.value,
    ds.In: lambda f: lambda v, s=frozenset(f.value): v is not None and v in s,
    ds.IsNull: lambda f: lambda v: v is None,
    ds.IsNotNull: lambda f: lambda v: v is not None,
    ds.GreaterThan: lambda f: lambda v: v is not None and v > f.value,
    ds.GreaterThanOrEqual: lambda f: lambda v: v is not None and v >= f.value,
    ds.LessThan: lambda f: lambda v: v is not None and v < f.value,
    ds.LessThanOrEqual: lambda f: lambda v: v is not None and v <= f.value,
    ds.StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
    ds.StringEndsWith: lambda f: lambda v: v is not None and v.endswith(f.value),
    ds.StringContains: lambda f: lambda v: v is not None and f.value in v,
}


def tested(f: ds.Filter, columns: set[str]) -> tuple[str, Callable] | None:
    """(column, test) where the predicate can be told from a record's headers alone."""
    inner = f.child if isinstance(f, ds.Not) else f
    if type(inner) not in TESTS or len(inner.attribute) != 1 or inner.attribute[0] not in columns:
        return None
    if isinstance(inner, ds.In) and None in inner.value:
        return None
    test = TESTS[type(inner)](inner)
    if inner is f:
        return inner.attribute[0], test
    keeps_null = isinstance(inner, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
    return inner.attribute[0], lambda v: (v is not None or keeps_null) and not test(v)


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.top, self.range = options["path"].rstrip("/"), int(options.get("range_bytes", RANGE))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.schema, self.tests = schema, []
        self.columns = [(x.name, HEADERS.get(x.name, x.name.replace("_", "-")).lower(), x.dataType.simpleString() in ("int", "bigint")) for x in schema.fields]

    def pushFilters(self, filters: list[ds.Filter]):
        own = {name for name, _, _ in self.columns} - BEYOND
        for f in filters:
            if found := tested(f, own):
                self.tests.append(found)
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs as pafs

        fs, top = opened(self.top)
        scheme = self.top[: len(self.top) - len(top)] if self.top.endswith(top) else ""
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.File:
            return [Range(self.top, 0, -1, info.size)]
        found = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))}
        manifests = [n for n in found if n.startswith("manifest-") and n.endswith(".json")]
        named = [json.loads(line)["name"] for m in manifests for line in fs.open_input_stream(f"{top}/{m}").read().decode().splitlines()]
        out = []
        for name in sorted(named if manifests else (n for n in found if re.search(r"\.warc(\.gz)?$", n))):
            size, path = found[name].size, f"{scheme}{top}/{name}"
            if index_of(name) in found:
                out += [Range(path, at, min(at + self.range, size), size) for at in range(0, size, self.range)]
            else:
                out.append(Range(path, 0, -1, size))
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        shape, rows, held = to_arrow_schema(self.schema), [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(shape)], schema=shape)
        names = {name for name, _, _ in self.columns}
        whole = "payload" in names or self.verify
        for headers, body in (self.indexed if partition.end >= 0 else self.streamed)(partition):
            own = {name: told(headers.get(key), key, number) for name, key, number in self.columns if name not in BEYOND}
            if not all(test(own[name]) for name, test in self.tests):
                continue
            kind, payload, size = headers.get("warc-type"), None, None
            if whole and kind != "revisit":
                payload = body(None)
                if "http" in headers.get("content-type", ""):
                    payload = payload.split(END, 1)[-1]
                size = len(payload)
                if self.verify and (want := headers.get("warc-payload-digest")) and told(want, "warc-payload-digest", False) != hashlib.sha1(payload).hexdigest():
                    raise ValueError(f"{partition.path}: the payload of {headers.get('warc-record-id')} does not match its digest")
            elif "payload_bytes" in names:
                size = declared(body(LOOK)) if "http" in headers.get("content-type", "") else int(headers.get("content-length", 0))
            own |= {"payload": payload, "payload_bytes": size, "headers": list(headers.items())}
            rows.append([own[name] for name, _, _ in self.columns])
            held += 400 + len(payload or b"") * ("payload" in names)
            if held > BATCH:
                yield pack()
                rows, held = [], 0
        if rows:
            yield pack()

    def indexed(self, p: Range):
        fs, path = opened(p.path)
        with fs.open_input_stream(index_of(path)) as f:
            offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
        lo, hi = np.searchsorted(offsets, [p.start, p.end])
        ends = np.append(offsets[1:], p.size)
        with fs.open_input_file(path) as f:
            window, begins = b"", 0

            def get(at: int, n: int) -> bytes:
                nonlocal window, begins
                if not begins <= at <= at + n <= begins + len(window):
                    f.seek(at)
                    window, begins = f.read(max(n, min(AHEAD, p.size - at))), at
                return window[at - begins : at - begins + n]

            for at, end in zip(offsets[lo:hi].tolist(), ends[lo:hi].tolist()):
                yield one_record(at, end, get, path.endswith(".gz"))

    def streamed(self, p: Range):
        fs, path = opened(p.path)
        with fs.open_input_file(path) as f:
            stream = Stream(f, path.endswith(".gz"))
            while (raw := stream.until(END)) is not None:
                headers = parsed(raw)
                left = int(headers.get("content-length", 0))
                first, asked = b"", False

                def body(n: int | None) -> bytes:
                    nonlocal first, asked
                    first, asked = stream.take(left if n is None else min(n, left)), True
                    return first

                yield headers, body
                stream.skip(left - len(first) + len(END))


def one_record(at: int, end: int, get: Callable[[int, int], bytes], packed: bool):
    """(headers, a function that gives the first n bytes of the block, or all): of the record from at to end. Only the headers are inflated until it is called."""
    if not packed:
        raw, n = b"", LOOK
        while END not in raw and len(raw) < end - at:
            raw, n = get(at, min(n, end - at)), n * 4
        start = raw.index(END) + len(END)
        return parsed(raw[: start - len(END)]), lambda n: get(at + start, end - at - start - len(END) if n is None else min(n, end - at - start - len(END)))
    z, had, taken = zlib.decompressobj(31), b"", 0
    while END not in had and not z.eof:
        fed, taken = next_of(z, at, taken, end, LOOK, get)
        had += z.decompress(fed, LOOK)
    start = had.index(END) + len(END)
    headers = parsed(had[: start - len(END)])

    def body(n: int | None) -> bytes:
        nonlocal had, taken
        length = int(headers.get("content-length", 0)) if n is None else min(n, int(headers.get("content-length", 0)))
        while len(had) < start + length and not z.eof:
            fed, taken = next_of(z, at, taken, end, end if n is None else LOOK, get)
            had += z.decompress(fed) if n is None else z.decompress(fed, LOOK)
        if len(had) < start + length:
            raise ValueError("a record is cut off")
        return had[start : start + length]

    return headers, body


def next_of(z, at: int, taken: int, end: int, most: int, get: Callable[[int, int], bytes]) -> tuple[bytes, int]:
    """What to inflate next of the member from at to end, of which ``taken`` bytes were read, and how many are then."""
    if z.unconsumed_tail:
        return z.unconsumed_tail, taken
    fed = get(at + taken, min(most, end - at - taken))
    if not fed:
        raise ValueError("a record is cut off")
    return fed, taken + len(fed)


class Stream:
    """Bytes of a plain file, or of gzip members one behind the other, in order."""

    def __init__(self, f, packed: bool):
        self.f, self.packed, self.held, self.z = f, packed, b"", None

    def more(self) -> bool:
        if not self.packed:
            got = self.f.read(AHEAD)
            self.held += got
            return bool(got)
        fed = self.z.unconsumed_tail if self.z and not self.z.eof else self.z.unused_data if self.z else b""
        fed = fed or self.f.read(AHEAD)
        if not fed:
            return False
        if self.z is None or self.z.eof:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(fed, AHEAD)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.held:
            if not self.more():
                if self.held.strip():
                    raise ValueError("a record's headers are cut off")
                return None
        out, self.held = self.held.split(mark, 1)
        return out

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n:
            part, self.held = self.held[: n - got], self.held[n - got :]
            parts.append(part)
            got += len(part)
            if got < n and not self.held and not self.more():
                raise ValueError("a record is cut off")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Passes over n bytes: in a plain file without reading them."""
        had = min(n, len(self.held))
        self.held, n = self.held[had:], n - had
        if n and not self.packed:
            self.f.seek(self.f.tell() + n)
        while n and self.packed:
            if not self.held and not self.more():
                return
            had = min(n, len(self.held))
            self.held, n = self.held[had:], n - had


def parsed(raw: bytes) -> dict[str, str]:
    """Headers by lower-case name, of a record's head without its end."""
    lines = raw.lstrip(b"\r\n").decode(errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def told(value: str | None, key: str, number: bool):
    """A header's value as a column has it: ids without brackets, SHA-1 digests in lower-case hex."""
    if value is None:
        return None
    if number:
        return int(value)
    if value.startswith("<") and value.endswith(">"):
        return value[1:-1]
    if key.endswith("digest") and value.lower().startswith("sha1:"):
        bare = value[5:]
        return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()
    return value


def declared(block: bytes) -> int | None:
    """The Content-Length of an HTTP head."""
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", block.split(END, 1)[0], re.I)
    return int(m[1]) if m else None


class WarcSource(ds.DataSource):
    """Options: path; reading: verify (payloads against their digests), range_bytes; writing: level (of gzip; 0: plain), archive_bytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are added to a folder, never replaced")
        return WarcWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session, with predicates pushed down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, where: str | Column | None = None, verify: bool = False) -> DataFrame:
    """The records of the archives in a folder, or of one archive, for which ``where`` holds. Only the columns of ``schema`` are made; a payload that neither a
    column nor ``verify`` needs stays as it is. A revisit has no payload; its payload_bytes is what its HTTP head says. With verify, a payload that does not
    match its digest raises ValueError. An empty folder gives no rows.

    Conjuncts of ``where`` on header columns are tested by the source, the others by Spark. Give the predicates here: Spark keeps what was pushed to a
    Python source with the relation, so a second query that filters one ``load()`` otherwise may get the first one's rows. Each call here loads anew, and
    what comes behind it (an observed count, which Spark pushes no filter through) is not pushed.
    """
    df = registered(spark).read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)
    df = df if where is None else df.filter(where)
    return df.observe(f"records-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def write_warc(pages: DataFrame, path: str | None = None, least: int = 1000, payload: str = "html", page_id: str = "page_id", url: str = "url", **options) -> str:
    """Writes a record for each row, with the payload in UTF-8; returns the folder.

    Of the rows with equal payloads of ``least`` bytes and more, the one with the largest id is a response and the others are revisits, which refer to it and
    hold no payload. Equal payloads are found by SHA-1 and length: groups come from digests alone, counts combined before they are shuffled, and
    a payload moves at most once, beside its group's one row; a large group is split by adaptive execution, since that row is on the other side.
    Null payloads are empty and null urls left out; rows with null ids have no Source-Id, and are revisits where the group has an id, else all responses; rows
    that repeat the largest id are all responses; control characters in urls are percent-encoded; an empty table gives a folder of no archives. Other columns are not read.
    """
    spark = registered(pages.sparkSession)
    small_batches(spark)
    path = path or new_path(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("source_id"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("source_id").alias("top"), F.count("*").alias("n")).filter("n > 1 AND top IS NOT NULL").drop("n")
    told_of = rows.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("source_id").eqNullSafe(F.col("top"))
    out = told_of.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), "source_id", "target_uri", "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("top")).alias("refers_to_source_id"))
    out.write.format("warc").mode("append").options(**options).save(path)
    return path
