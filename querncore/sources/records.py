"""Record files: JSON lines, JSON documents, sitemaps, manifests, robots files, archives, image headers."""

from __future__ import annotations

import gzip
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, recursive: bool = False) -> DataFrame:
    """Strict JSON lines: a line that does not fit the schema fails the job and is named in the error."""
    r = spark.read.schema(schema).option("mode", "FAILFAST")
    return (r.option("recursiveFileLookup", True) if recursive else r).json(path)


def read_json_lines_numbered(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """row, file, line (from 1) and problem of every non-empty line; a line that does not parse has a null row. Whole files are read one to a
    row, since a line's number is known only from the start of its file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    lines = files.filter(F.trim("text") != "").select("file", (F.col("at") + 1).alias("line"), F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("text").isNull().alias("bad"))
    return lines.select("row", "file", "line", F.when(F.col("bad"), "not JSON").alias("problem"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


MANIFEST = "struct<name: string, short_name: string, icons: array<struct<src: string, sizes: string, type: string, purpose: string>>>"


def manifest_icons(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each icon of a web app manifest: keep, place, src, sizes, type, purpose (any where absent). Malformed manifests have none."""
    m = F.from_json(F.col(text), MANIFEST)
    rows = df.select(*keep, F.posexplode(m["icons"]).alias("place", "icon"))
    return rows.filter(F.coalesce(F.trim("icon.src"), F.lit("")) != "").select(*keep, "place", "icon.src", "icon.sizes", "icon.type", F.coalesce("icon.purpose", F.lit("any")).alias("purpose"))


ICONS = "struct<icons: array<struct<url: string, width: int, height: int, format: string, error: string>>>"


def service_icons(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each usable icon of an icon service's answer."""
    rows = df.select(*keep, F.posexplode(F.from_json(F.col(text), ICONS)["icons"]).alias("place", "icon"))
    ok = F.col("icon.error").isNull() & (F.coalesce("icon.url", F.lit("")) != "")
    size = F.concat(F.coalesce("icon.width", F.lit(0)), F.lit("x"), F.coalesce("icon.height", F.lit(0)))
    return rows.filter(ok).select(*keep, "place", "icon.url", size.alias("sizes"), F.concat(F.lit("image/"), F.coalesce("icon.format", F.lit(""))).alias("type"))


def fallback_icons(df: DataFrame, domain: str, templates: list[tuple[str, str]]) -> DataFrame:
    """domain, place, source, url from (source, template with {}) pairs, in their order."""
    made = [F.struct(F.lit(s).alias("source"), F.concat(F.lit(t.split("{}")[0]), F.url_encode(domain), F.lit(t.split("{}")[1])).alias("url")) for s, t in templates]
    return df.select(domain, F.posexplode(F.array(*made)).alias("place", "x")).select(domain, "place", "x.*")


def sitemap_entries(df: DataFrame, text: str, keep: list[str], most: int = 50_000) -> DataFrame:
    """A row for each entry of a sitemap: keep, kind (urlset or sitemapindex), place, loc, lastmod. Texts with a DTD or of another kind have none."""
    plain = F.regexp_replace(F.col(text), "<([/]?)[A-Za-z0-9]+:", "<$1")
    ok = ~F.lower(F.col(text)).contains("<!doctype") & ~F.lower(F.col(text)).contains("<!entity")
    kind = F.when(plain.rlike("<urlset[ >]"), "urlset").when(plain.rlike("<sitemapindex[ >]"), "sitemapindex")
    entry = "array<struct<loc: string, lastmod: string>>"
    parsed = F.from_xml(plain, f"struct<url: {entry}, sitemap: {entry}>")
    rows = df.filter(ok & kind.isNotNull()).select(*keep, kind.alias("kind"), F.posexplode(F.when(kind == "urlset", parsed["url"]).otherwise(parsed["sitemap"])).alias("place", "e"))
    return rows.filter((F.col("place") < most) & (F.coalesce(F.trim("e.loc"), F.lit("")) != "")).select(*keep, "kind", "place", F.trim("e.loc").alias("loc"), F.trim("e.lastmod").alias("lastmod"))


@F.pandas_udf(T.StringType())
def sitemap_text(content: pd.Series) -> pd.Series:
    """The text of sitemap bytes, unpacked if they are gzip (at most 50 MB); null for HTML and for what cannot be read."""

    def one(raw):
        if raw is None:
            return None
        raw = bytes(raw)
        try:
            if raw[:2] == b"\x1f\x8b":
                d = zlib.decompressobj(31)
                raw = d.decompress(raw, 50 << 20)
                if d.unconsumed_tail:
                    return None
            text = raw.decode("utf-8", "replace")
        except (zlib.error, gzip.BadGzipFile, OSError):
            return None
        return None if text.lstrip()[:15].lower().startswith(("<!doctype html", "<html")) else text

    return content.map(one)


def zip_directory(raw: bytes, most: int = 2000) -> list[tuple]:
    """(name, compression, packed, size, offset, safe) of the members in a ZIP's central directory; [] if there is none. Encrypted members,
    unsafe names (absolute, with .. or a backslash or NUL), other methods than store and deflate, and ratios above 200 are not safe."""
    end = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 65_557))
    if end < 0 or len(raw) < end + 22:
        return []
    n, _, start = struct.unpack_from("<HII", raw, end + 10)
    out = []
    for _ in range(min(n, most)):
        if raw[start : start + 4] != b"PK\x01\x02" or len(raw) < start + 46:
            break
        flags, method = struct.unpack_from("<HH", raw, start + 8)
        packed, size, name_n, extra, comment = struct.unpack_from("<IIHHH", raw, start + 20)
        offset = struct.unpack_from("<I", raw, start + 42)[0]
        name = raw[start + 46 : start + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        parts = name.split("/")
        safe = not flags & 1 and method in (0, 8) and not name.startswith("/") and ".." not in parts and not any(c in name for c in "\\\0:") and size <= 200 * max(packed, 1)
        out.append((name, method, packed, size, offset, safe))
        start += 46 + name_n + extra + comment
    return out


def zip_member(raw: bytes, entry: tuple, most: int = 10 << 20) -> bytes | None:
    """The bytes of a safe member of at most so many bytes; None if they cannot be had or do not have the size that is stated."""
    name, method, packed, size, offset, safe = entry
    if not safe or size > most or raw[offset : offset + 4] != b"PK\x03\x04":
        return None
    at = offset + 30 + sum(struct.unpack_from("<HH", raw, offset + 26))
    body = raw[at : at + packed]
    try:
        out = body if method == 0 else zlib.decompressobj(-15).decompress(body, most + 1)
    except zlib.error:
        return None
    return out if len(out) == size else None


def read_zip_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """From (path, content) as the binaryFile source gives them: a row for each member, with its bytes where it is safe."""

    def run(batches):
        for b in batches:
            rows = [(p, *e, zip_member(bytes(c), e)) for p, c in zip(b["p"], b["c"]) if c is not None for e in zip_directory(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "name", "method", "packed", "size", "offset", "safe", "bytes"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "path string, name string, method int, packed long, size long, offset long, safe boolean, bytes binary")


def image_header(raw: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from the first bytes of an image; for an icon file, of its largest frame, deeper ones first."""
    if not raw:
        return None, None, None
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return "png", *struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return "gif", *struct.unpack("<HH", raw[6:10])
    if raw[:4] == b"\0\0\1\0" and len(raw) >= 6:
        n = struct.unpack_from("<H", raw, 4)[0]
        frames = [(raw[k] or 256, raw[k + 1] or 256, struct.unpack_from("<H", raw, k + 6)[0]) for k in range(6, min(len(raw) - 15, 6 + 16 * n), 16)]
        if not frames:
            return "ico", None, None
        w, h, _ = max(frames, key=lambda f: (f[0] * f[1], f[2]))
        return "ico", w, h
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        if raw[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
        if raw[12:16] == b"VP8L":
            bits = int.from_bytes(raw[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if raw[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", raw[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", raw, at + 5)
                return "jpeg", w, h
            at += 2 + size
        return "jpeg", None, None
    if raw[4:12] in (b"ftypavif", b"ftypavis"):
        at = raw.find(b"ispe")
        return ("avif", *struct.unpack_from(">II", raw, at + 8)) if 0 < at <= len(raw) - 16 else ("avif", None, None)
    if b"<svg" in raw[:1024].lower():
        return "svg", None, None
    return None, None, None


@F.pandas_udf(T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def sniffed(content: pd.Series) -> pd.DataFrame:
    """Format and size of images from their bytes."""
    return pd.DataFrame([image_header(bytes(c) if c is not None else None) for c in content], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def assertion_status(records: DataFrame, keys: list[str], record: str, version: str = "v=bimi1") -> DataFrame:
    """Of a name's TXT records exactly one must be of the version: found, not_found or ambiguous, with the record."""
    own = F.lower(F.trim(F.col(record))).startswith(version)
    out = records.groupBy(*keys).agg(F.count_if(own).alias("n"), F.min(F.when(own, F.col(record))).alias("r"))
    return out.select(*keys, F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(F.col("n") == 1, F.col("r")).alias("record"))


def private_address(value: Column) -> Column:
    """Whether a host is an IP address that is not public (a name is not)."""
    import ipaddress

    @F.pandas_udf("boolean")
    def check(hosts: pd.Series) -> pd.Series:
        def one(h):
            try:
                a = ipaddress.ip_address((h or "").strip("[]"))
            except ValueError:
                return False
            mapped = getattr(a, "ipv4_mapped", None)
            return not (mapped or a).is_global or a.is_multicast

        return hosts.map(one)

    return check(value)


#: A page as a rendering browser has seen it.
OBSERVATION = "url string, domain string, company string, candidates array<struct<kind:string,url:string,inlineSvg:string,evidence:string>>"


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of rendered pages, one page a line of JSON: page, domain, company, at (a candidate's place, from 0), kind, url, inline_svg, css_background, evidence (JSON as it
    stands). Pages without candidates have no rows; candidates that are null are passed over; lines that do not parse fail the job. ``dedupe.merge_rendered`` takes it from here."""
    pages = read_jsonl(spark, path, OBSERVATION)
    rows = pages.select(F.col("url").alias("page"), "domain", "company", F.posexplode("candidates").alias("at", "c")).filter("c IS NOT NULL")
    return rows.select("page", "domain", "company", F.col("at").cast("long").alias("at"), "c.kind", "c.url", F.col("c.inlineSvg").alias("inline_svg"), F.get_json_object("c.evidence", "$.cssBackground").alias("css_background"), "c.evidence")
