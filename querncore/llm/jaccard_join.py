"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct word shingles. Two sets are linked when 100 * intersection >= similarity * union. Exact, by index lists
of prefix shingles:

1. Equal sets become one. A set's order puts shingles that many sets share last and follows hashes otherwise; any two
   linked sets share a shingle within the first n - ceil(t n) + 1 of either.
2. Index lists hold, for each prefix shingle, its sets with the shingle's position in them. Neighbours in a list are compared
   first, which links highly similar sets at a cost in proportion to the lists.
3. The sets of a list that are not in one component by then are held against each other. They lie in blocks by size and position, and blocks (and
   smaller blocks inside them) that no position lets reach the similarity are skipped; single sets go by size, position and parity bitmap, each by its
   own, so that of sets that are near but not linked few pairs are left. A first round compares a set with the nearest of a block alone, and what it links
   has no pairs any more; the last round compares all that is left.

A list with a large share of all sets is dealt over several tasks. No list, component or group of copies has to fit in one task, and no pair
within a component is ever emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querncore.llm.common import free_name, most_frequent, partitions, removed, row_key, small_batches, written
from querncore.llm.hashing import shingles, slices

#: Sets that share a shingle from which on it goes to the end of the order, and how many such shingles are told to all tasks
#: (8 bytes each; the most frequent come first). Both steer the cost, never the result.
FREQUENT, TOLD = 24, 1 << 19
#: Sets of a list that a task gets of it: longer lists are dealt over tasks.
HOT = 50_000
#: Entries of a block of an index list, and of the blocks inside it; bits of a set's parity bitmap.
BLOCK, INSIDE, BITS = 2048, 64, 512
#: Tasks over which a set's entries are dealt where they are joined by set.
SALTS = 4


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection at which sets of these sizes are linked: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def sets_of(column: pa.Array, width: int):
    """(row, ascending distinct shingle hashes) of every text that has words."""
    for first, t in slices(column, fold=True):
        docs, h = shingles(t, width)
        order = np.lexsort((h, docs))
        docs, h = docs[order], h[order]
        fresh = np.r_[True, (docs[1:] != docs[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        docs, h = docs[fresh], h[fresh]
        at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(h) else np.zeros(0, int)
        for a, b in zip(at, np.r_[at[1:], len(h)]):
            yield first + int(docs[a]), h[a:b]


def set_id(h: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes()))))


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the hashes' numbers in BITS bins: two sets differ in at least as many hashes as their bitmaps do in bits."""
    return np.packbits(np.bincount((h >> np.uint64(13)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def _batch(names: str, rows: list, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names.split())


class _Seen:
    """Set ids that this task has met: copies are handled once a task, where memory allows; repeats elsewhere do no harm."""

    def __init__(self, most: int = 200_000):
        self.most, self.ids = most, set()

    def __call__(self, sid: int) -> bool:
        if sid in self.ids:
            return True
        if len(self.ids) < self.most:
            self.ids.add(sid)
        return False


def _scan_sets(width: int):
    def run(batches):
        for b in batches:
            n, sid, bits = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            for r, h in sets_of(b.column(1), width):
                n[r], sid[r], bits[r] = len(h), set_id(h), bitmap(h)
            more = range(3, b.num_columns)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), b.column(2), *(b.column(k) for k in more)], names=["doc_id", "n", "sid", "bits", "th", *(f"key{k - 3}" for k in more)])

    return run


def _scan_counts(width: int, percent: int):
    """(shingle, sets) over the part of a set from which prefixes can come: half as much again as the plain prefix."""

    def run(batches):
        seen, kept, held = _Seen(), [], 0

        def out():
            if kept:
                v, c = np.unique(np.concatenate(kept), return_counts=True)
                for i in range(0, len(v), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)].astype(np.int64))], names=["token", "sets"])

        for b in batches:
            for _, h in sets_of(b.column(0), width):
                if not seen(set_id(h)):
                    own = h[: int(prefix_length(len(h), percent) * 3 // 2) + 1]
                    kept.append(own)
                    held += len(own)
                    if held > 1 << 21:
                        yield from out()
                        kept, held = [], 0
        yield from out()

    return run


def _scan_postings(width: int, percent: int, frequent):
    """(token, sid, n, pos, salts): prefixes of sets; salts: over how many tasks the token's list is dealt."""
    names = ["token", "sid", "n", "pos", "salts"]

    def run(batches):
        seen, (last, sets) = _Seen(), frequent.value
        for b in batches:
            held, size = [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)

            for _, h in sets_of(b.column(0), width):
                sid = set_id(h)
                if seen(sid):
                    continue
                n, p = len(h), int(prefix_length(len(h), percent))
                salts = np.ones(p, np.int32)
                if len(last):
                    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
                    common = last[at] == h
                    h, at = np.r_[h[~common], h[common]], np.r_[np.full(n - int(common.sum()), -1), at[common]][:p]
                    salts[at >= 0] = -(-sets[at[at >= 0]] // HOT)
                held.append((h[:p].view(np.int64), np.full(p, sid), np.full(p, n, np.int32), np.arange(p, dtype=np.int32), salts))
                size += p
                if size > 1 << 18:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

    return run


def _lists(batches):
    """From postings in order of token, size, set: the entries of lists of two sets and more, each with its neighbour before it. Of a list that is dealt
    over tasks all entries stay."""
    carry = None  # the last entry so far, and whether it has been handed on
    for b in batches:
        if not b.num_rows:
            continue
        token, sid, n, pos, salts = (b.column(k).to_numpy() for k in range(5))
        if carry is not None:
            token, sid, n, pos, salts = (np.r_[c, x] for c, x in zip(carry[0], (token, sid, n, pos, salts)))
        given = np.zeros(len(token), bool)
        if carry is not None:
            given[0] = carry[1]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]
        token, sid, n, pos, salts, given = (x[fresh] for x in (token, sid, n, pos, salts, given))
        same = np.r_[False, token[1:] == token[:-1]]  # as the entry before
        more = np.r_[same[1:], False]
        out = (same | more | (salts > 1)) & ~given
        none = ~same[out]
        before = [pa.array(np.r_[x[:1], x[:-1]][out], mask=none) for x in (sid, n, pos)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in (token, sid, n, pos, salts)), *before], names=["token", "sid", "n", "pos", "salts", "before", "before_n", "before_pos"])
        carry = ([x[-1:] for x in (token, sid, n, pos, salts)], bool(out[-1] or given[-1]))


def _scan_tokens(width: int, bloom):
    """From texts and their hashes: set ids and sets of the texts whose hashes are in the filter; other texts are not cut into shingles."""

    def run(batches):
        seen, filt = _Seen(), np.frombuffer(bloom.value, np.uint8)
        for b in batches:
            spots = _spots(b.column(1).to_numpy())
            asked = (filt[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).all(axis=0)
            rows, held = [], 0
            for _, h in sets_of(b.column(0).filter(pa.array(asked)), width):
                sid = set_id(h)
                if not seen(sid):
                    rows.append((sid, h.tobytes()))
                    held += len(h)
                    if held > 1 << 19:
                        yield _batch("sid tokens", rows, (pa.int64(), pa.binary()))
                        rows, held = [], 0
            yield _batch("sid tokens", rows, (pa.int64(), pa.binary()))

    return run


#: Bits of the filter that spares texts which no pair asks for; of fixed size, so beyond some 100 million asked texts it spares fewer.
FILTER_BITS = 1 << 25


def _spots(hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in the filter."""
    u = hashes.astype(np.int64).view(np.uint64)
    return np.stack([(u * np.uint64(m) >> np.uint64(39)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)])


def _filter(hashes: DataFrame) -> bytes:
    """The filter of hashes, made in tasks and joined in a tree; the driver gets FILTER_BITS / 8 bytes."""

    def fill(batches):
        filt = np.zeros(FILTER_BITS, bool)
        for b in batches:
            filt[_spots(b.column(0).to_numpy()).ravel()] = True
        packed = np.packbits(filt, bitorder="little").reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["part", "bits"])

    def join(group: pa.Table) -> pa.Table:
        out = None
        for x in group.column("bits").to_pylist():
            y = np.frombuffer(x, np.uint8)
            out = y if out is None else out | y
        return pa.table({"part": group.column("part")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    few = hashes.coalesce(max(8, partitions(hashes.sparkSession) // 8))
    rows = few.mapInArrow(fill, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect()
    got = {r.part: bytes(r.bits) for r in rows}
    return b"".join(got.get(k, bytes(FILTER_BITS // 8 // 64)) for k in range(64))


def _alike(batches):
    """Pairs whose bitmaps differ in no more bits than linked sets can differ in hashes."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (3, 4))
        ok = np.bitwise_count(x ^ y).sum(axis=1) <= b.column(2).to_numpy()
        yield b.select(["a", "b"]).filter(pa.array(ok))


def _verify(batches):
    for b in batches:
        common, na, nb = [], [], []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.r_[x, y]
            both.sort()
            common.append(int((both[1:] == both[:-1]).sum()))
            na.append(len(x))
            nb.append(len(y))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (common, na, nb))], names=["a", "b", "common", "na", "nb"])


def compared(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], width: int) -> DataFrame:
    """pairs: a, b (set ids, each pair once) -> a, b, common, na, nb: the intersection and the sizes, by the whole sets, made again from the texts that
    pairs ask for. texts: (t, th), texts and their hashes, and (sid, th), a text for each set. Written."""
    spark = pairs.sparkSession
    pairs, kinds = written(pairs.select("a", "b"), "asked"), "a long, b long, common long, na long, nb long"
    if pairs.isEmpty():
        return written(spark.createDataFrame([], kinds), "compared")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts, of_set = texts
    bloom = spark.sparkContext.broadcast(_filter(asked.join(of_set, "sid").select("th")))
    found = texts.mapInArrow(_scan_tokens(width, bloom), "sid long, tokens binary").join(asked, "sid", "left_semi")
    found = written(found.groupBy("sid").agg(F.first("tokens").alias("tokens")), "tokens")
    left = pairs.join(found.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(found.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")
    out = written(both.mapInArrow(_verify, kinds), "compared")
    removed(found, pairs)
    return out


def _linked(percent: int):
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def _need(percent: int, na, nb):
    """``needed`` as a Column."""
    return F.ceil((na + nb) * percent / F.lit(100 + percent))


def components(links: DataFrame) -> DataFrame:
    """links: a, b. (node, root) of every node with links, root the smallest node of its component.

    Each partition first replaces its links by stars around its own roots; large-star and small-star steps follow until nothing
    changes, each written to the shared folder, as is the result. Minima are pre-aggregated before they are shuffled.
    """

    def contract(batches):
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars():
            rows = [(n, r) for n in parent if (r := find(n)) != n]
            return _batch("u v", rows, (pa.int64(), pa.int64()))

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:
                yield stars()
                parent = {}
        yield stars()

    edges = written(links.select("a", "b").mapInArrow(contract, "u long, v long").distinct(), "stars")  # u > v
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        before, edges = edges, written(small, "stars")
        removed(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = written(roots, "label")
    removed(edges)
    return out


#: Columns of a packed block and the types of what they hold.
PACKED = {"id": np.int64, "comp": np.int64, "n": np.int32, "reach": np.int32, "bits": np.uint64}
BLOCKS = "token long, least int, most int, best int, " + ", ".join(f"{c} binary" for c in PACKED)


def _pack(batches):
    """From entries in order of token, size class, position: blocks of a list, packed, with the least and largest size and the best reach (what a set
    can still have in common from the position on) that they span. Lists of one block within one component are left out."""

    def rows(token, cols, done):
        """Whole blocks of one list, and what is left of it unless it is done."""
        nonlocal begun
        salts, *cols = cols
        n = len(cols[0])
        to = n if done else n - n % BLOCK
        out = []
        if n and not (done and n <= BLOCK and begun != token and salts[0] == 1 and (cols[1] == cols[1][0]).all()):
            for at in range(0, to, BLOCK):
                part = [c[at : at + BLOCK] for c in cols]
                out.append((token, int(part[2].min()), int(part[2].max()), int(part[3].max()), *(c.tobytes() for c in part)))
        begun = token if out else begun
        return out, [c[to:] for c in (salts, *cols)]

    token, left, begun = None, None, None
    kinds = (pa.int64(), *(pa.int32(),) * 3, *(pa.binary(),) * len(PACKED))
    names = "token least most best " + " ".join(PACKED)
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(0).to_numpy()
        cols = [b.column(k + 1).to_numpy().astype(kind) for k, kind in enumerate([np.int32, *PACKED.values()][:-1])]
        cols.append(np.frombuffer(b"".join(b.column(len(PACKED) + 1).to_pylist()), np.uint64).reshape(len(t), -1))
        edges = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)]
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = [c[lo:hi] for c in cols]
            if left is not None and t[lo] == token:
                own = [np.concatenate(x) for x in zip(left, own)]
            elif left is not None and len(left[0]):
                out += rows(token, left, True)[0]
            token = int(t[lo])
            more, left = rows(token, own, False) if hi == len(t) else (rows(token, own, True)[0], None)
            out += more
        yield _batch(names, out, kinds)
    if left is not None and len(left[0]):
        yield _batch(names, rows(token, left, True)[0], kinds)


def least_need(a, b, percent: int):
    return needed(np.asarray(a, np.int64), np.asarray(b, np.int64), percent)


def _open_pairs(percent: int, best: bool):
    """Pairs of entries of different components that may hold linked sets. Of two blocks, smaller blocks are held against each other by their sizes and
    positions first; where none of their sets can be linked, they are skipped. best: of an entry's partners in a block the nearest by bitmap alone."""

    def nearest(p, q, differ):
        keep = np.zeros(len(p), bool)
        for own, other in ((p, q), (q, p)):
            order = np.lexsort((other, differ, own))
            keep[order[np.r_[True, own[order][1:] != own[order][:-1]]]] = True
        return keep

    def unpack(row, p):
        got = {c: np.frombuffer(row[p + c], kind) for c, kind in PACKED.items()}
        n = len(got["id"])
        got["bits"] = got["bits"].reshape(n, -1)
        for c in ("n", "reach"):
            got[c] = got[c].astype(np.int64)
        at = np.arange(0, n, INSIDE)
        got["at"], got["least"], got["most"], got["best"] = np.r_[at, n], np.minimum.reduceat(got["n"], at), np.maximum.reduceat(got["n"], at), np.maximum.reduceat(got["reach"], at)
        return got

    def fits(x_low, x_high, x_reach, y_low, y_high, y_reach):
        sizes = (100 * x_high >= percent * y_low) & (100 * y_high >= percent * x_low)
        return sizes & (np.minimum(x_reach, y_reach) >= least_need(x_low, y_low, percent))

    def found(x, k, y, m):
        """Of entries k of x and m of y, those that sizes, positions and components leave: the ones whose bitmaps are near enough, and how far they are."""
        differ = np.bitwise_count(x["bits"][k] ^ y["bits"][m]).sum(axis=1, dtype=np.int64)
        size = x["n"][k] + y["n"][m]
        near = differ <= size - 2 * needed(size, 0, percent)
        return x["id"][k[near]], y["id"][m[near]], differ[near]

    def short(cols, n):
        """Pairs within many short lists at once."""
        x = {c: np.frombuffer(b"".join(v), kind) for (c, kind), v in zip(PACKED.items(), cols)}
        x["bits"] = x["bits"].reshape(len(x["id"]), -1)
        for c in ("n", "reach"):
            x[c] = x[c].astype(np.int64)
        after = np.repeat(np.cumsum(n), n) - np.arange(int(n.sum())) - 1  # entries behind an entry in its list
        ends = np.cumsum(after)
        at = 0
        while at < len(after):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), side="right")))
            some = after[at:to]
            k = np.repeat(np.arange(at, to), some)
            m = k + 1 + np.arange(len(k)) - np.repeat(np.cumsum(some) - some, some)
            ok = (x["comp"][k] != x["comp"][m]) & fits(*(x[c][k] for c in ("n", "n", "reach")), *(x[c][m] for c in ("n", "n", "reach")))
            yield found(x, k[ok], x, m[ok])
            at = to

    def long(x, y, same):
        """Pairs between two blocks, or within one."""
        inside = fits(*(x[c][:, None] for c in ("least", "most", "best")), *(y[c][None, :] for c in ("least", "most", "best")))
        if same:
            inside = np.triu(inside)
        for i, j in zip(*np.nonzero(inside)):
            u, v = slice(x["at"][i], x["at"][i + 1]), slice(y["at"][j], y["at"][j + 1])
            ok = fits(*(x[c][u][:, None] for c in ("n", "n", "reach")), *(y[c][v][None, :] for c in ("n", "n", "reach")))
            ok &= x["comp"][u][:, None] != y["comp"][v][None, :]
            if same and i == j:
                ok = np.triu(ok, 1)
            k, m = np.nonzero(ok)
            if len(k):
                yield found(x, k + u.start, y, m + v.start)

    def pairs(some):
        some = list(some)
        if some:
            p, q, differ = (np.concatenate(z) for z in zip(*some))
            if best and len(p):
                keep = nearest(p, q, differ)
                p, q = p[keep], q[keep]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def run(batches):
        for b in batches:
            n = pc.binary_length(b.column(0)).to_numpy() // 8
            few = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) & (n <= INSIDE)
            if few.any():
                own = b.filter(pa.array(few))
                yield from pairs(short([own.column(k).to_pylist() for k in range(len(PACKED))], n[few]))
            for row in b.filter(pa.array(~few)).to_pylist():
                x = unpack(row, "x_")
                yield from pairs(long(x, x if row["same"] else unpack(row, "y_"), row["same"]))

    return run


def _met(entries: DataFrame, percent: int, best: bool) -> DataFrame:
    """entries: deal, token, salts, id, comp, n, reach, bits -> pairs (a, b) of ids of different components that share a list and may
    hold linked sets (best: the nearest of them alone). Written."""
    spark = entries.sparkSession
    parts = partitions(spark)
    size = F.floor(F.log("n") / F.lit(float(np.log(100 / percent) if percent < 100 else 1.0)))
    some = entries.withColumn("size", size).repartition(parts, "deal").sortWithinPartitions("token", "size", F.col("reach") / F.col("n"), "id")
    blocks = some.select("token", "salts", *PACKED).mapInArrow(_pack, BLOCKS)
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    side = lambda p: [F.col(c).alias(p + c) for c in PACKED]
    own = blocks.filter(F.length("id") > 8).select(*side("x_"), *(F.lit(None).cast("binary").alias("y_" + c) for c in PACKED), F.lit(True).alias("same"))
    several = blocks.groupBy("token").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("token")
    long = blocks.join(several, "token", "left_semi")
    x, y = (long.select("token", *side(p), *(F.col(c).alias(p + c) for c in ("least", "most", "best", "block"))) for p in ("x_", "y_"))
    # blocks of one list part by size and by position: those that cannot reach the similarity are not brought together
    c = F.col
    ok = (c("x_block") < c("y_block")) & (100 * c("x_most") >= percent * c("y_least")) & (100 * c("y_most") >= percent * c("x_least"))
    ok &= F.least("x_best", "y_best") >= _need(percent, c("x_least"), c("y_least"))
    across = x.join(y, "token").filter(ok).select(*(c(p + k) for p in ("x_", "y_") for k in PACKED), F.lit(False).alias("same")).repartition(parts)
    out = written(own.unionByName(across).mapInArrow(_open_pairs(percent, best), "a long, b long").distinct(), "met")
    removed(blocks)
    return out


def _by_set(entries: DataFrame, of_set: DataFrame, how: str = "inner") -> DataFrame:
    """Joins entries of lists with what is known of sets, by sid; a long set's many entries are dealt over SALTS keys."""
    salted = of_set.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return entries.withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(salted, ["sid", "salt"], how).drop("salt")


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles long (distinct shingles), component_id long (the smallest id reachable by
    links, itself included).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a set holds the distinct runs of ``width`` words, or all words as one run where there are
    fewer. Texts that are null or hold no words have an empty set and are linked with nothing. Repeated rows each get their row. Null ids are
    passed over for component_id, unless a component has no other: then it is null. A very long text is one set, whole. An empty table gives none;
    other columns are not read. Shingles are compared by 64-bit hashes.
    """
    sets, classes = _classes(docs, percent, width, text, doc_id)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(classes.drop("root"), "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _classes(docs: DataFrame, percent: int, width: int, text: str, doc_id: str, key=()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid, and the columns in key as key0, ...) of every row and (sid, root, component_id) of every set, root a set of its component.
    All that runs Python has run when this returns."""
    spark = docs.sparkSession
    small_batches(spark)
    names = [f"key{k}" for k in range(len(key))]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("th"), *(c.alias(n) for c, n in zip(key, names)))
    texts = own.select("t")
    parts = partitions(spark)
    kinds = "".join(f", {n} {own.schema[n].dataType.simpleString()}" for n in names)
    sets = written(own.mapInArrow(_scan_sets(width), "doc_id long, n long, sid long, bits binary, th long" + kinds), "sets")
    distinct = written(sets.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("n").cast("int").alias("n"), F.min("th").alias("th")), "distinct")
    known_texts = (own.select("t", "th"), distinct.select("sid", "th"))

    counts = texts.mapInArrow(_scan_counts(width, percent), "token long, sets long").groupBy("token").agg(F.sum("sets").alias("sets"))
    counts = written(counts.filter(F.col("sets") >= FREQUENT), "counts")
    frequent = most_frequent(counts, "sets", TOLD)[0]
    removed(counts)
    order = np.argsort(frequent.column("token").to_numpy().view(np.uint64))
    told = spark.sparkContext.broadcast((frequent.column("token").to_numpy().view(np.uint64)[order], frequent.column("sets").to_numpy()[order]))
    postings = texts.mapInArrow(_scan_postings(width, percent, told), "token long, sid long, n int, pos int, salts int")
    deal = lambda by: F.when(F.col("salts") > 1, F.xxhash64("token", F.pmod(by, F.col("salts")))).otherwise(F.col("token")).alias("deal")
    dealt = postings.withColumn("deal", deal("sid")).repartition(parts, "deal").sortWithinPartitions("token", "n", "sid").drop("deal")
    lists = written(dealt.mapInArrow(_lists, "token long, sid long, n int, pos int, salts int, before long, before_n int, before_pos int"), "lists")

    # 2. neighbours
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    need = _need(percent, F.col("n"), F.col("before_n"))
    reach = F.least(F.col("n") - F.col("pos"), F.col("before_n") - F.col("before_pos")) >= need  # what can still be common from here on
    near = lists.filter(F.col("before").isNotNull() & (F.col("before") != F.col("sid")) & reach).select(*pair("before", "sid"), (F.col("n") + F.col("before_n") - 2 * need).cast("long").alias("most")).distinct()
    bits = lambda c: distinct.select(F.col("sid").alias(c), F.col("bits").alias(c + "_bits"))
    near = near.join(bits("a"), "a").join(bits("b"), "b").select("a", "b", "most", "a_bits", "b_bits")
    near = written(near.mapInArrow(_alike, "a long, b long"), "near")
    first = compared(near, known_texts, width)
    removed(near)
    every = components(first.filter(_linked(percent)).select("a", "b"))

    # 3. sets of different components
    postings = _by_set(lists.select("token", "sid", "n", "salts", (F.col("n") - F.col("pos")).alias("reach")), distinct.select("sid", "bits"))
    entries = written(postings.select(deal("sid"), "token", "salts", F.col("sid").alias("id"), "n", "reach", "bits"), "entries")
    removed(lists)
    stars = lambda: every.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    answers = first
    for best in (True, False):  # nearest partners first: what they link has no pairs any more
        met = _met(_rooted(entries, every), percent, best)
        fresh = compared(met.join(answers, ["a", "b"], "left_anti"), known_texts, width)
        removed(met)
        links = fresh.filter(_linked(percent)).select("a", "b")
        if not links.isEmpty():
            every = components(stars().unionByName(links))
        answers = answers.unionByName(fresh)
    removed(entries)

    of = distinct.select("sid", "least").join(every.withColumnRenamed("node", "sid"), "sid")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.select("sid", "root").join(least, "root").select("sid", "root", "component_id")
    classes = distinct.select("sid", "least").join(classes, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return sets, classes


def _rooted(entries: DataFrame, every: DataFrame) -> DataFrame:
    """Entries of lists with the component that their sets are in by now."""
    roots = every.filter("node != root").withColumnRenamed("node", "sid")
    return _by_set(entries.withColumnRenamed("id", "sid"), roots, "left").withColumn("comp", F.coalesce("root", "sid")).drop("root").withColumnRenamed("sid", "id")


def keep_one(docs: DataFrame, percent: int = 90, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay when of every group of linked documents one stays: the one with the smallest id, a null id after all others; among
    rows with the same id the one with the smallest ``row_key``; of rows that repeat each other wholly any. Rows with no words are linked with nothing
    and all stay. A very long text is a set like any other. All columns are kept; an empty table gives none."""
    k1, k2 = row_key(docs)
    sets, classes = _classes(docs, percent, width, text, doc_id, (k1, k2))
    rows = sets.filter("sid is not null").groupBy("doc_id", "key0", "key1", "sid").agg(F.count("*").alias("n")).join(classes.select("sid", "root"), "sid")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key0"), F.col("key1"))
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    a, b, n = (free_name(docs, x) for x in ("_k1", "_k2", "_n"))
    told = written(rows.join(first, "root").select(F.col("key0").alias(a), F.col("key1").alias(b), "n", (order == F.col("first")).alias("stays")), "told")
    keyed = docs.select("*", k1.alias(a), k2.alias(b))
    kept = keyed.join(told.filter("not stays").select(a, b), [a, b], "left_anti")
    again = told.filter("stays and n > 1").select(a, b)
    if not again.isEmpty():
        marked = kept.join(again.withColumn(n, F.lit(1)), [a, b], "left")
        kept = marked.filter(F.col(n).isNull()).unionByName(marked.filter(F.col(n) == 1).dropDuplicates([a, b]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
