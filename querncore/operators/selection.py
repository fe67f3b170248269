"""Selections after scoring: the order of a role's candidates, siblings, instances mapped to candidates, outcomes, population figures, costs, label gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querncore.operators import ranking
from querncore.operators.percentiles import exact_percentiles, with_percentiles


def role_order(role: str, preference: Column, score: Column, tie: str) -> list[Column]:
    """Best first: padded wordmarks last (icons only), then the preference's points, the score (for icons ``scoring.icon_effective``, else the role's own),
    bytes; the tie's column makes it total."""
    padded = [F.coalesce(F.col("padded_wordmark"), F.lit(False)).asc()] if role == "icon" else []
    return [*padded, preference.desc(), F.coalesce(score, F.lit(0.0)).desc(), F.desc("bytes"), F.asc(tie)]


def unique_by_priority(df: DataFrame, keys: list[str], url: str, priority: str, tie: str, limit: int) -> DataFrame:
    """Of rows with one URL the one of highest priority, then the first ``limit`` of each group by priority and URL. Adds rank."""
    once = ranking.top(df, [*keys, url], [F.desc(priority), F.asc(tie)])
    return ranking.top(once, keys, [F.desc(priority), F.asc(url)], limit)


def latest_snapshot(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each key's row in the latest snapshot."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def chunked(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Adds chunk_index (from 1) and chunk_count."""
    out = ranking.ranked(df, keys, order, "_at").withColumn("chunk_index", F.floor((F.col("_at") - 1) / size).cast("int") + 1)
    return out.withColumn("chunk_count", F.max("chunk_index").over(Window.partitionBy(*keys))).drop("_at")


def smallest_descendant(df: DataFrame, keys: list[str], area: Column, strength: str, class_name: str, tie: str) -> DataFrame:
    return ranking.top(df, keys, [area.asc(), F.desc(strength), F.length(class_name).desc(), F.asc(tie)])


def transparent_siblings(chosen: DataFrame, members: DataFrame, family: list[str], index: str) -> DataFrame:
    """For each chosen row that has a theme and a color: the first member of its family that may take the row's role, with a transparent background, the
    same theme and color, and a shape within 1 %. Columns of both: family, index, theme, color, width, height; of chosen: role; of members: background,
    predicted_roles. Gives index and sibling."""
    told = lambda c: c.isNotNull() & (c != "unknown")
    own = chosen.filter(told(F.col("theme")) & told(F.col("color")) & (F.col("width") >= 1) & (F.col("height") >= 1))
    own = own.select(*family, "theme", "color", F.col("role").alias("_role"), F.col(index).alias("_own"), (F.col("width") / F.col("height")).alias("_shape"))
    others = members.filter((F.col("background") == "transparent") & (F.col("width") > 0) & (F.col("height") > 0))
    others = others.select(*family, "theme", "color", index, "predicted_roles", (F.col("width") / F.col("height")).alias("_other"))
    met = own.join(others, [*family, "theme", "color"]).filter((F.col(index) != F.col("_own")) & F.array_contains("predicted_roles", F.col("_role")) & (F.abs(F.col("_other") / F.col("_shape") - 1) <= 0.01))
    return met.groupBy(F.col("_own").alias(index)).agg(F.min(index).alias("sibling"))


def mapped_instances(instances: DataFrame, candidates: DataFrame, keys: list[str], candidate: str, url: str = "url", content: str = "hash") -> DataFrame:
    """Adds candidate and confidence: exact by URL, else derived by hash, else unmapped. Of several candidates with one URL or hash, the smallest."""

    def lookup(col: str, name: str) -> DataFrame:
        return candidates.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.min(candidate).alias(name))

    out = instances.join(lookup(url, "_exact"), [*keys, url], "left").join(lookup(content, "_derived"), [*keys, content], "left")
    confidence = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_derived").isNotNull(), "derived").otherwise("unmapped")
    return out.withColumn(candidate, F.coalesce("_exact", "_derived")).withColumn("confidence", confidence).drop("_exact", "_derived")


def role_correct(role: Column | str) -> Column:
    return F.coalesce((F.col("identity") == "correct") & F.array_contains("roles", role), F.lit(False))


def outcomes(entities: DataFrame, selections: DataFrame, labels: DataFrame, entity: str, candidate: str, roles: list[str]) -> DataFrame:
    """A row for each entity and role: candidate, identity, correct, outcome, and the label's usability columns. labels: entity, candidate, identity, roles,
    usability_light, usability_dark."""
    slots = entities.select(entity).distinct().withColumn("role", F.explode(F.array(*map(F.lit, roles))))
    out = slots.join(selections.select(entity, "role", candidate), [entity, "role"], "left").join(labels, [entity, candidate], "left")
    correct = role_correct(F.col("role"))
    told = F.when(F.col(candidate).isNull(), "no_selection").when(correct, "correct_role").when(F.col("identity") == "correct", "correct_brand_wrong_role").when(F.col("identity") == "ambiguous", "ambiguous")
    return out.select(entity, "role", candidate, "identity", correct.alias("correct"), told.otherwise("wrong").alias("outcome"), "usability_light", "usability_dark")


def usability(c: str) -> Column:
    """1 for good, a half for conditional."""
    return F.when(F.lower(c) == "good", 1.0).when(F.lower(c) == "conditional", 0.5).otherwise(0.0)


def population(entities: DataFrame, candidates: DataFrame, rows: DataFrame, labels: DataFrame, entity: str, candidate: str) -> DataFrame:
    """One row: entities, with_candidates, with_any_positive, correct_domains, wrong_domains, and the parts and total of the 90-point subtotal. rows: what
    ``outcomes`` gives. Parts over no entity are null."""
    any_of = lambda c: F.max(c.cast("int"))
    held = candidates.select(entity, candidate).join(labels, [entity, candidate], "left")
    positive = F.coalesce((F.col("identity") == "correct") & (F.size("roles") > 0), F.lit(False))
    held = held.groupBy(entity).agg(F.lit(1).alias("some"), any_of(positive).alias("positive"), any_of(role_correct("icon")).alias("icon"), any_of(role_correct("wide")).alias("wide"))
    main = F.col("role") != "favicon"
    usable = F.when(main & F.col("correct"), (usability("usability_light") + usability("usability_dark")) / 2).otherwise(0.0)
    wrong = main & F.coalesce(F.col("identity") == "wrong", F.lit(False))
    got = rows.groupBy(entity).agg(any_of(F.col("correct")).alias("right"), any_of(wrong).alias("wrong"), F.sum(main.cast("int") * F.col("correct").cast("int")).alias("roles_right"), F.sum(usable).alias("usable"))
    every = entities.select(entity).distinct().join(held, entity, "left").join(got, entity, "left")
    sums = {"with_candidates": "some", "with_any_positive": "positive", "correct_domains": "right", "wrong_domains": "wrong", "_icon": "icon", "_wide": "wide", "_right": "roles_right", "_usable": "usable"}
    out = every.agg(F.count("*").alias("entities"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    share = lambda n: F.when(F.col("entities") > 0, F.col(n) / F.col("entities"))
    out = out.withColumn("candidate_set_coverage", 15 * share("_icon") + 15 * share("_wide")).withColumn("top1_role_correctness", 15 * share("_right")).withColumn("visual_usability", 10 * share("_usable"))
    out = out.withColumn("wrong_brand_safety", 10 * F.greatest(F.lit(0.0), 1 - share("wrong_domains") / 0.1))
    total = F.col("candidate_set_coverage") + F.col("top1_role_correctness") + F.col("visual_usability") + F.col("wrong_brand_safety")
    return out.withColumn("total", total).drop("_icon", "_wide", "_right", "_usable")


def variant_costs(rows: DataFrame, variant: str) -> DataFrame:
    """By variant: misses, answers, reviews, verdicts and costs. rows: proposal (null: none), verdict, requests, bytes, latency_ms. Precision is told only
    where every proposal has been reviewed."""
    reviewed, answered, correct = F.count("verdict"), F.count("proposal"), F.count(F.when(F.col("verdict") == "correct", 1))
    n = F.count("*")
    whole = reviewed == answered
    counts = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("correct", "wrong_brand", "related_brand", "not_logo", "ambiguous")]
    sums = rows.groupBy(variant).agg(
        n.alias("audited_misses"), answered.alias("answered"), (answered / n).alias("answer_rate"), reviewed.alias("reviewed"), *counts,
        F.when(whole & (answered > 0), correct / answered).alias("strict_precision"), F.when(whole, 100 * correct / n).alias("correct_gains_per_100"),
        F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"), F.floor(F.sum("latency_ms") / n + 0.5).alias("mean_latency_ms"),
        F.max("requests").alias("max_requests"), F.max("bytes").alias("max_bytes"), F.max("latency_ms").alias("max_latency_ms"),
    )
    return with_percentiles(sums, exact_percentiles(rows, [variant], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}), [variant])


def label_gaps(selections: DataFrame, labels: DataFrame, entity: str, candidate: str) -> DataFrame:
    """One row: selected slots, slots whose candidate has no label for their role, candidates without any label."""
    exact = labels.select(entity, candidate, "role").distinct().withColumn("_exact", F.lit(1))
    any_ = labels.select(entity, candidate).distinct().withColumn("_any", F.lit(1))
    rows = selections.filter(F.col(candidate).isNotNull()).join(exact, [entity, candidate, "role"], "left").join(any_, [entity, candidate], "left")
    bare = F.count_distinct(F.when(F.col("_any").isNull(), F.struct(entity, candidate)))
    return rows.agg(F.count("*").alias("selected_slots"), F.count(F.when(F.col("_exact").isNull(), 1)).alias("missing_role_slots"), bare.alias("candidates_without_any_label"))


def availability(rows: DataFrame, candidate: str) -> DataFrame:
    """The mean of the shares of entities that have an icon and a wide mark, in percent with one decimal. rows: what ``outcomes`` gives."""
    found = F.avg(F.col(candidate).isNotNull().cast("double"))
    return rows.filter(F.col("role").isin("icon", "wide")).agg((F.floor(found * 1000 + 0.5) / 10).alias("availability"))


def grouped_means(df: DataFrame, keys: list[str], means: list[str], highest: list[str]) -> DataFrame:
    """n, means of what is not null (0 where all is null) and maxima by group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in means), *(F.max(c).alias(c) for c in highest))


def controls(df: DataFrame, name: str, seed: str, k: int) -> DataFrame:
    """The k rows with the smallest sha256 of seed and name: the same on every run."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(name)), 256), name).limit(k)


def allowed_event(name: Column, fields: Column, allowed: dict[str, dict[str, list[str]]]) -> Column:
    """The fields of an event (a map) that may leave: of known events the known fields with known values. Null for an unknown event."""
    known = lambda rules: lambda k, v: F.coalesce(_any_of_rules(k, v, rules), F.lit(False))
    out = F.when(F.lit(False), fields)
    for event, rules in allowed.items():
        out = out.when(name == event, F.map_filter(fields, known(rules)))
    return out


def _any_of_rules(k: Column, v: Column, rules: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for field, values in rules.items():
        out = out | ((k == field) & v.isin(*values))
    return out
