"""Target-distribution importance resampling: documents are weighed by how much likelier their word runs are in a target than among all documents,
and drawn by weight plus Gumbel noise, without replacement.

Texts are cut into overlapping chunks at word boundaries. A chunk owns the places where runs start and carries the n - 1 words behind them, so every run
belongs to one chunk and a long text is many rows like any other; counts are summed over chunks, weights by document. Chunks are written once as the buckets
of their runs, some two bytes a word: texts are read and cut once, counted and weighed from that table, whose files part long texts among tasks.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.llm.common import partitions, removed, small_batches, written

#: What parts words: ASCII but for digits and (lower-case) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Starting places of a chunk.
PLACES = 4096


def lowered(text: Column) -> Column:
    """Only A to Z change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(words: Column, owned: Column, n: int) -> Column:
    """The runs of 1 to n words that start at the first ``owned`` of the words, joined by a space."""
    if n == 1:
        return words
    starts = lambda k: F.sequence(F.lit(1), F.least(owned, F.size(words) - (k - 1)))
    of = lambda k: F.when(F.least(owned, F.size(words) - (k - 1)) < 1, F.array().cast("array<string>")).otherwise(F.transform(starts(k), lambda at: F.array_join(F.slice(words, at, k), " ")))
    return F.concat(*map(of, range(1, n + 1)))


def chunks(docs: DataFrame, n: int, buckets: int, text: str = "text", doc_id: str = "doc_id", places: int = PLACES) -> DataFrame:
    """doc_id long, k1 long, k2 int (which tell rows apart by id and text), chunk int, n_words long, buckets array<int>: a row for each chunk; a text
    without words has one chunk with none."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    null = F.array(F.col("doc_id").isNull(), F.col("t").isNull())
    words = F.filter(F.split(lowered(F.coalesce("t", F.lit(""))), BETWEEN), lambda w: w != "")
    d = d.select("doc_id", F.xxhash64(null, "doc_id", "t").alias("k1"), F.hash(null, "doc_id", "t").alias("k2"), words.alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(places)), lambda at: F.struct((at / places).cast("int").alias("chunk"), F.greatest(F.least(F.size("w") - at, F.lit(places)), F.lit(0)).alias("owned"), F.slice("w", at + 1, places + n - 1).alias("w")))
    c = d.select("doc_id", "k1", "k2", F.explode(cut).alias("c")).select("doc_id", "k1", "k2", F.col("c.chunk"), F.col("c.owned"), F.col("c.w"))
    found = F.transform(runs(F.col("w"), F.col("owned"), n), lambda r: (F.crc32(r.cast("binary")) % buckets).cast("int"))
    return c.select("doc_id", "k1", "k2", "chunk", F.col("owned").cast("long").alias("n_words"), found.alias("buckets"))


def bucket_counts(c: DataFrame, buckets: int) -> list[int]:
    """How often each bucket stands in the chunks; what reaches the driver is bounded by the number of buckets."""
    got = dict(c.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect())
    return [got.get(b, 0) for b in range(buckets)]


def gains(s: list[int], t: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    all_s, all_t, n = sum(s), sum(t), len(s)
    return [math.floor(1000 * math.log(float(y + 1) * float(all_s + n) / (float(x + 1) * float(all_t + n)))) for x, y in zip(s, t)]


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least: int = 20, percent: int = 10, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", places: int = PLACES) -> DataFrame:
    """doc_id, n_features, weight, score, rank long: a row for each document, rank (from 1) for the floor(percent * N / 100) of the N documents of ``least``
    words and more that have the highest scores, ties to the smaller id.

    Features are all runs of 1 to n words, told apart by their crc32 modulo ``buckets``. weight: sum of the gains of a document's features; score: weight and
    a Gumbel term from sha256 of ``seed:id``.
    Nothing is grouped by a word or a bucket but counts that were combined before, and ranks come from a range partition of all scores: where a range starts
    is known by the rows of those before it. Null, empty and wordless texts have no features and weight 0; null ids hash as an empty id and rank behind
    others of the same score; rows that repeat an id or a whole document each count, and each has a row; an empty table gives no rows, an
    empty target has counts of 0. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = written(chunks(docs, n, buckets, text, doc_id, places), "chunks")
    aimed = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text"))
    gain = gains(bucket_counts(cut, buckets), bucket_counts(chunks(aimed, n, buckets, places=places), buckets))
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # one literal of ``buckets`` numbers
    own = cut.select("doc_id", "k1", "k2", "chunk", "n_words", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + known[b]).alias("weight"))
    # rows that repeat a document fall together here; each has a first chunk
    d = own.groupBy("doc_id", "k1", "k2").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    each = lambda c: F.expr(f"{c} div copies")  # noqa: E731  exact: all copies have the same
    d = d.select("doc_id", each("n_words").alias("n_words"), each("n_features").alias("n_features"), each("weight").alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    d = d.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least).alias("able"))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    dealt = d.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # a partition's number and the row's place in it
    ranked = written(dealt.select("*", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")), "ranked")
    removed(cut)
    parts = sorted(ranked.groupBy("part").agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect())  # a row for each partition
    starts = spark.createDataFrame([(p.part, start) for p, start in zip(parts, accumulate((p.n for p in parts), initial=0))], "part int, start long")
    rank = F.col("start") + F.col("at") + 1
    drawn = percent * sum(p.able for p in parts) // 100
    return ranked.join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))
