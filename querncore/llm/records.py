"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard file holds frames, one for each document:

    length   8 bytes, little-endian unsigned: bytes of the payload
    check    4 bytes: masked crc32 of the length's bytes
    payload  1 byte flags (bit 0: the id is null; bit 1: ids take 4 bytes, else 2), 8 bytes signed id, then the token ids
    check    4 bytes: masked crc32 of the payload

A checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that a checksum stored among the data does not look
like the checksum of that data. The index file beside a shard holds the frames' byte offsets, 8 bytes each: frame k of a
shard is read by one seek.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querncore.llm.common import new_path, partitions, split_points

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
#: Entries of the memo of encoded words; it starts anew beyond that.
MEMO = 900_000


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    """ids: uint16 or uint32."""
    return struct.pack("<Bq", (doc_id is None) | (ids.dtype.itemsize == 4) << 1, doc_id or 0) + ids.tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def read_frame(f) -> bytes | None:
    """The next payload of an open shard, None at its end; a damaged or cut frame raises ValueError."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("a frame's head is cut off")
    size, check = HEAD.unpack(head)
    if masked(zlib.crc32(head[:8])) != check:
        raise ValueError("a frame's length does not match its checksum")
    body = f.read(size + 4)
    if len(body) < size + 4 or masked(zlib.crc32(body[:size])) != struct.unpack_from("<I", body, size)[0]:
        raise ValueError("a frame's payload does not match its checksum")
    return body[:size]


def read_at(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Document k of a shard, by its index: what a shuffled read does."""
    fs, p = opened(path)
    with fs.open_input_file(index_path(p)) as f:
        f.seek(8 * k)
        at = struct.unpack("<Q", f.read(8))[0]
    with fs.open_input_file(p) as f:
        f.seek(at)
        return parsed(read_frame(f))


def index_path(path: str) -> str:
    return path.removesuffix(".rec") + ".idx"


def opened(path: str):
    """The file system of a path (a local path, or a URI such as file:, hdfs: or s3:) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class WordEncoder:
    """Encodes by the tokenizers library, each distinct run of non-white-space once.

    Sound for tokenizers whose normaliser and pre-tokeniser never join or look across ASCII white space and drop it; that is
    examined when a tokenizer is loaded, on its own description. Others encode whole texts. For words of ASCII and of the Latin letters
    U+00C0 to U+017E the library's model is called on the pre-tokens themselves: there, NFC changes nothing and letters and
    digits are known without tables. All other words go through the library's whole course.
    """

    #: Words whose pre-tokens are found here, and these. U+00D7, U+00F7 are signs; U+0130 lowers to two characters.
    PLAIN = re.compile("(?!.*<[|])[!-~À-ÖØ-öø-įı-ž]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path) as f:
            kept = json.load(f)
        self.by_word = self._falls_apart(kept)
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.special = any(not self.PLAIN.fullmatch(t["content"]) is None for t in kept["added_tokens"])  # never, for strings with <|
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on, in order
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)}

    def encode_word(self, word: str) -> bytes | None:
        """The ids of a plain word; None where the library's whole course is needed."""
        if self.special or not self.PLAIN.fullmatch(word):
            return None
        out = []
        for part in self.PARTS.findall(word.lower()):
            got = self.parts.get(part)
            if got is None:
                if len(self.parts) > MEMO // 2:
                    self.parts = {}
                mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
                got = self.parts[part] = np.array([t.id for t in self.tok.model.tokenize(mapped)], self.dtype).tobytes()
            out.append(got)
        return b"".join(out)

    @staticmethod
    def _falls_apart(kept: dict) -> bool:
        flat = lambda x, many: [y for z in x[many] for y in flat(z, many)] if x and x["type"] == "Sequence" else [x] if x else []
        norms = flat(kept["normalizer"], "normalizers")
        pres = flat(kept["pre_tokenizer"], "pretokenizers")
        plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
        first = pres[0] if pres else {"type": ""}
        regex = first.get("pattern", {}).get("Regex", "") if first["type"] == "Split" else ""
        # every alternative is a class or a literal without white space; what no alternative matches is removed
        drops = first.get("behavior") == "Removed" and first.get("invert") is True and bool(regex) and all(a in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") or a.startswith("'") and a[1:].isalpha() for a in regex.split("|"))
        rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pres[1:])
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in kept["added_tokens"])
        return plain and drops and rest and added and kept["post_processor"] is None

    def encode(self, texts: list[str | None], end: int | None) -> list[np.ndarray]:
        """The ids of each whole text, without added special tokens, then the end id."""
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        whole = lambda many: [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(many, add_special_tokens=False)]
        if not self.by_word:
            return [np.frombuffer(b + tail, self.dtype) for b in whole([t or "" for t in texts])]
        out = []
        for i in range(0, len(texts), 256):
            if len(self.memo) > MEMO:
                self.memo = {}
            memo, words = self.memo, [(t or "").encode().split() for t in texts[i : i + 256]]  # bytes split at ASCII white space alone
            missing = set(chain.from_iterable(words)).difference(memo)
            rest = []
            for w in missing:
                got = self.encode_word(w.decode())
                if got is None:
                    rest.append(w)
                else:
                    memo[w] = got
            for j in range(0, len(rest), 4096):
                memo.update(zip(rest[j : j + 4096], whole([w.decode() for w in rest[j : j + 4096]])))
            out += [np.frombuffer(b"".join(map(memo.__getitem__, w)) + tail, self.dtype) for w in words]
            for w in missing:
                if len(w) > 256:
                    del memo[w]
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_records(docs: DataFrame, tokenizer_path: str, path: str | None = None, end: int | None = 1, shards: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes every whole text and writes shards of frames in ascending id order. Returns the manifest: a row for each shard with
    shard int, path string, n_docs long, n_ids long, start long (ids of all shards before it).

    The ids are cut into ranges of about equal numbers of rows; texts are encoded where they are read and only token ids are
    shuffled, to the range of their document. A shard's name is its attempt's own and the manifest tells which attempt's
    counts, so nothing is renamed and what a lost executor or a second attempt leaves is never read. Folders are written through pyarrow's file systems.
    Null texts count as empty (the end id alone); null ids come first; rows with equal ids are ordered by their token ids, and
    equal rows stay as many as they are; an empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "records")
    points = split_points(docs, doc_id, shards or partitions(spark))

    def encode(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            given = b.column(0).to_pylist()
            for i in range(0, len(given), 1024):
                own = given[i : i + 1024]
                ids = enc.encode(b.column(1).slice(i, len(own)).to_pylist(), end)
                at = np.searchsorted(points, [x or 0 for x in own], side="right") if len(points) else np.zeros(len(own), int)
                at = np.where([x is None for x in own], 0, at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["shard", "id", "ids"])

    def write(batches):
        fs, top = opened(path)
        fs.create_dir(top, recursive=True)
        dtype = encoder(tokenizer_path).dtype
        shard, out, index, name, n, n_ids, at = None, None, None, "", 0, 0, 0
        done = []

        def close():
            out.close()
            index.close()
            done.append((shard, f"{path}/{name}.rec", n, n_ids))

        for b in batches:
            for s, i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if s != shard:
                    if out:
                        close()
                    shard, name, n, n_ids, at = s, f"shard-{s:06d}-{uuid.uuid4().hex}", 0, 0, 0
                    out, index = fs.open_output_stream(f"{top}/{name}.rec"), fs.open_output_stream(f"{top}/{name}.idx")
                own = np.frombuffer(ids, dtype)
                framed = frame(payload_of(i, own))
                index.write(struct.pack("<Q", at))
                out.write(framed)
                at, n, n_ids = at + len(framed), n + 1, n_ids + len(own)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "n_docs", "n_ids"])

    encoded = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(encode, "shard int, id long, ids binary")
    dealt = encoded.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.asc_nulls_first("id"), "ids")
    manifest = dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long").collect()  # a row for each shard: as many as ranges
    start, rows = 0, []
    for r in sorted(manifest):
        rows.append((*r, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "shard int, path string, n_docs long, n_ids long, start long")


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads shards back, each by one task in a stream, checking every frame: doc_id, start long (ids of all documents before it),
    n_tokens long, ids_crc32 long (of the ids as little-endian unsigned 32-bit integers), ids binary (these integers)."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                fs, p = opened(path)
                with fs.open_input_stream(p, buffer_size=1 << 20) as f:
                    rows, held = [], 0
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = parsed(payload)
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw))
                        start, held = start + len(ids), held + len(raw)
                        if held > 1 << 23:
                            yield packed(rows)
                            rows, held = [], 0
                    yield packed(rows)

    def packed(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
