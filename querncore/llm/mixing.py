"""Mixing sources to target weights by balanced sampling with the cube method.

A document's expected number of copies is its source's target over its source's size. The whole copies are taken; the fraction
left is an inclusion probability, and the cube method settles it to 0 or 1: its flight moves a vector of probabilities along
directions that lie in the null space of the balancing constraints, so that both the sum of words and the number of documents of a
source stay what they were, until only as many fractions are left as there are constraints. That is done in blocks of
bounded size; the few fractions that blocks leave fly again together, level by level, and a small landing settles the last ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querncore.llm.common import WORD, free_name, partitions, removed, row_key, written

#: Documents that fly together; what a task holds of one group.
BLOCK = 4000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
EPS = 1e-9
#: Sources whose rows (some 50 bytes each) are broadcast; with more of them the joins shuffle.
FEW = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets of sources in the order given; weights repeat along it. share times the sum of the sizes is dealt by weight; a target
    stops at cap times its source's size and the excess is dealt again by weight among the others, until none is above."""
    size = np.array([s for _, s in sizes], float)
    weight = np.array([weights[k % len(weights)] for k in range(len(sizes))])
    target, open_, left = np.zeros(len(sizes)), size > 0, share * size.sum()
    while open_.any() and left > 0:
        got = left * weight / weight[open_].sum()
        above = open_ & (got > cap * size)
        if not above.any():
            target[open_] = got[open_]
            break
        target[above] = cap * size[above]
        left -= target[above].sum()
        open_ &= ~above
    return target.tolist()


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Moves the probabilities to 0 or 1, all but two at most, keeping sum(prob) and sum(prob * size). With land, the last ones are
    settled too: the number of documents is given up first, then a lone last one is drawn by its probability."""
    prob = prob.astype(float).copy()
    scale = max(float(size.max(initial=0)), 1.0)
    s = size / scale
    todo = [k for k in range(len(prob) - 1, -1, -1) if EPS < prob[k] < 1 - EPS]
    draws, used = rng.random(len(todo) + 4), 0

    def step(at: list[int], u: list[float]) -> list[int]:
        nonlocal used
        up = min((1 - prob[k]) / v if v > 0 else prob[k] / -v for k, v in zip(at, u) if v)
        down = min(prob[k] / v if v > 0 else (1 - prob[k]) / -v for k, v in zip(at, u) if v)
        move = up if draws[used] * (up + down) < down else -down
        used += 1
        kept = []
        for k, v in zip(at, u):
            prob[k] += move * v
            if prob[k] <= EPS or prob[k] >= 1 - EPS:
                prob[k] = round(prob[k])
            else:
                kept.append(k)
        return kept

    active: list[int] = []
    while todo or len(active) == 3:
        while todo and len(active) < 3:
            active.append(todo.pop())
        if len(active) < 3:
            break
        a, b, c = active
        u = [s[b] - s[c], s[c] - s[a], s[a] - s[b]]
        active = step(active, u if any(abs(x) > EPS for x in u) else [1.0, -1.0, 0.0])
    if land:
        if len(active) == 2:
            a, b = active
            u = [s[b], -s[a]]
            active = step(active, u if all(abs(x) > EPS for x in u) else [1.0, -1.0])
        for k in active:
            prob[k] = float(draws[used] < prob[k])
            used += 1
    return prob


def seed_of(*key) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big")


def _fly(level: int, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("id", "ascending"), ("size", "ascending"), ("rid", "ascending")])
        src, block = group.column("src")[0].as_py(), group.column("block")[0].as_py()
        land = group.column("blocks")[0].as_py() == 1
        rng = np.random.default_rng(seed_of(seed, src, block, level))
        p = flight(group.column("prob").to_numpy(), group.column("size").to_numpy().astype(float), rng, land)
        return group.set_column(group.schema.get_field_index("prob"), "prob", pa.array(p, pa.float64())).select(["rid", "id", "h", "src", "size", "prob"])

    return run


def _joined(rows: DataFrame, few: DataFrame, on) -> DataFrame:
    """An inner join with a row for each source, broadcast where they are FEW at most."""
    return rows.join(F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few, on)


def settle(units: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """units: rid long (unique), id long, h long, src long, size long, prob double. Returns rid and prob, now 0 or 1, of every unit.
    A source with any share of the rows is dealt over blocks of about ``block`` units; every level leaves at most two of a block, and a source that
    has a single block left lands."""
    schema = "rid long, id long, h long, src long, size long, prob double"
    out, left, level = None, units, 0
    while True:
        blocks = written(left.groupBy("src").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "blocks")
        if blocks.isEmpty():
            removed(blocks)
            return out if out is not None else units.select("rid", "prob").limit(0)
        dealt = _joined(left, blocks, "src").withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        flown = written(dealt.select("rid", "id", "h", "src", "size", "prob", "block", "blocks").groupBy("src", "block").applyInArrow(_fly(level, seed), schema), f"flight{level}")
        removed(blocks)
        settled = (F.col("prob") == 0) | (F.col("prob") == 1)
        done = flown.filter(settled).select("rid", "prob")
        out = done if out is None else out.unionByName(done)
        left, level = flown.filter(~settled), level + 1


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source string, n long -> src long (place in the order of code points, null last), source, source_size, target double: ``targets`` for any
    number of sources. Ranges of sources are ordered in their tasks, and a task's first place follows from the others' counts. The targets are
    min(cap * size, level * weight) for the level at which they sum up to what is shared; the driver sees that level alone, which only rises."""
    spark = sizes.sparkSession
    ordered = sizes.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    first, offsets = 0, []
    for p, n in sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect()):  # a row for each task
        offsets.append((p, first))
        first += n
    begin = F.broadcast(spark.createDataFrame(offsets, "part long, first long"))
    rows = ordered.withColumn("part", part.cast("long")).join(begin, "part").select((place + F.col("first")).alias("src"), "source", F.col("n").alias("source_size"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("src") % len(weights) + 1).cast("int"))
    rows = written(rows.withColumn("w", w), "targets")
    removed(ordered)
    some = F.col("source_size") > 0
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, top = 0.0, F.col("source_size") * F.lit(float(cap))
    while total:
        above = top < F.col("w") * F.lit(level)
        fixed, open_ = rows.filter(some).agg(F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("w")))).first()
        if not open_:
            level = float("inf")
            break
        now = (share * total - (fixed or 0.0)) / open_
        if now <= level * (1 + 1e-12):
            break
        level = now
    return rows.select("src", "source", "source_size", F.when(some, F.least(top, F.col("w") * F.lit(level))).otherwise(0.0).alias("target"))


def _drawn(docs: DataFrame, weights, share: float, cap: float, seed: int, text: str, doc_id: str, source: str, block: int, key=()) -> DataFrame:
    """A row for each row of docs: id, size, source_size, target, copies, and the columns in key."""
    if not 0 < cap <= 2:
        raise ValueError("cap must be above 0 and 2 at most: copies are 0, 1 or 2")
    names = [f"key{k}" for k in range(len(key))]
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), *(k.alias(n) for k, n in zip(key, names)))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    plan = source_targets(rows.groupBy("source").agg(F.sum("size").alias("n")), weights, share, cap).withColumnRenamed("source", "own")
    rows = _joined(rows, plan, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(expected + EPS)).withColumn("prob", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    units = rows.filter(F.col("prob") > EPS).select("rid", "id", F.xxhash64("id", "size").alias("h"), "src", "size", "prob")
    drawn = settle(units, seed, block).select("rid", F.col("prob").cast("int").alias("more"))
    return rows.join(drawn, "rid", "left").select("id", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("copies"), *names)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, size (words of the text), source_size, target double (its source's), taken long (words that
    the mix takes of the document, repeats counted), copies int.

    Sources are ordered by code point, null (a source of its own) last, and the weights repeat along that order; they share
    ``share`` times the sum of all sizes, no target above cap (at most 2) times its source's size, the excess dealt again.
    Null and empty texts have size 0; they are taken as often as their source's share says, which takes no words. A very long text is a unit like any
    other: it is taken whole, so a source's words meet its target but for two of its units at most. Repeated rows are documents of their own. An
    empty table gives none; other columns are not read. The same rows and seed give the same mix however they are dealt out: order comes from hashes of
    ids, rows equal in id and size are interchangeable.

    Texts are read once, for their sizes; a table of ids and sizes is written, and the flight shuffles that alone.
    """
    out = _drawn(docs, weights, share, cap, seed, text, doc_id, source, block)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: Copies of one row that a task makes from one array.
MADE = 4096


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows of docs with all their columns, each as often as ``mix`` takes it. Edge cases are those of ``mix``.

    Texts are not carried through the draw: rows are found again by their ``row_key``, in one join at the end. Of rows that repeat each other wholly, one
    is given as often as all of them are taken."""
    out = _drawn(docs, weights, share, cap, seed, text, doc_id, source, block, row_key(docs))
    a, b, times, rows = (free_name(docs, x) for x in ("_k1", "_k2", "_times", "_rows"))
    want = out.groupBy(F.col("key0").alias(a), F.col("key1").alias(b)).agg(F.sum("copies").alias(times), F.count("*").alias(rows)).filter(F.col(times) > 0)
    want = written(want, "copies")
    k1, k2 = row_key(docs)
    found = docs.select("*", k1.alias(a), k2.alias(b)).join(want, [a, b])
    if not want.filter(F.col(rows) > 1).isEmpty():
        repeated = found.filter(F.col(rows) > 1).dropDuplicates([a, b])
        found = found.filter(F.col(rows) == 1).unionByName(repeated)
    spans = F.sequence(F.lit(0), F.floor((F.col(times) - 1) / MADE))
    found = found.withColumn(b, F.explode(spans))
    return found.withColumn(a, F.explode(F.sequence(F.lit(1), F.least(F.lit(MADE), F.col(times) - F.col(b) * MADE)))).select(*(F.col(f"`{c}`") for c in docs.columns))
