"""Role metrics of stored selections, experiment profiles, stage gating."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Profile = Callable[[DataFrame], DataFrame]


def role_metrics(entities: DataFrame, candidates: DataFrame, selections: DataFrame, roles: list[str]) -> DataFrame:
    """The seventeen figures of each role. entities: entity. candidates: entity, candidate, role, correct, best, identity, any_theme, both_themes (a
    labelled candidate's row for each role). selections: entity, role, candidate. A ratio over nothing is null."""
    spark = entities.sparkSession
    grid = entities.select("entity").distinct().join(F.broadcast(spark.createDataFrame([(r,) for r in roles], "role string")))
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    truth = candidates.groupBy("entity", "role").agg(F.bool_or(t("correct")).alias("available"), F.bool_or(t("correct") & t("best")).alias("has_best"))
    chosen = selections.select("entity", "role", "candidate", F.lit(True).alias("chosen")).join(candidates.select("entity", "role", "candidate", "correct", "best", "identity", "any_theme", "both_themes"), ["entity", "role", "candidate"], "left")
    rows = grid.join(truth, ["entity", "role"], "left").join(chosen, ["entity", "role"], "left")
    n = lambda c: F.count_if(c)
    ok = t("correct")
    out = rows.groupBy("role").agg(
        F.count("*").alias("entities"),
        n(t("available")).alias("ground_truth_available_entities"),
        n(t("has_best")).alias("ground_truth_best_entities"),
        n(t("chosen")).alias("selected"),
        n(F.col("identity") == "correct").alias("identity_correct"),
        n(ok).alias("role_correct"),
        n(F.col("identity") == "wrong").alias("wrong_identity"),
        n(F.col("identity") == "ambiguous").alias("ambiguous_identity"),
        n(ok & t("best")).alias("best_selected"),
        n(ok & t("any_theme")).alias("usable_on_any_theme"),
        n(ok & t("both_themes")).alias("usable_on_both_themes"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.select(
        "*",
        ratio("selected", "entities").alias("answer_rate"),
        ratio("identity_correct", "selected").alias("identity_precision"),
        ratio("role_correct", "selected").alias("role_precision"),
        ratio("ground_truth_available_entities", "entities").alias("discovery_recall"),
        ratio("role_correct", "ground_truth_available_entities").alias("conditional_rank_recall"),
        ratio("role_correct", "entities").alias("end_to_end_recall"),
        ratio("best_selected", "ground_truth_best_entities").alias("best_hit_rate"),
    )


def reason_points(reasons: Column) -> Column:
    """The confidence that a list of reasons like "home linked +12" adds up to."""
    return F.aggregate(F.transform(reasons, lambda r: F.coalesce(F.regexp_extract(r, "([+-][0-9]+)$", 1).try_cast("int"), F.lit(0))), F.lit(0), lambda s, p: s + p)


def reranked(candidates: DataFrame, profile: Profile, keys: list[str], order: list[Column]) -> DataFrame:
    """The winners under a profile: a function of the candidates that changes scores or drops rows."""
    from querncore.operators.ranking import top

    return top(profile(candidates), keys, order)


def staged(entities: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], key: str) -> DataFrame:
    """Runs recovery stages in order; each sees only entities that no stage before has satisfied. Adds stage (from 1)."""
    left, out = entities, None
    for k, stage in enumerate(stages):
        found = stage(left).withColumn("stage", F.lit(k + 1))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(key).distinct(), key, "left_anti")
    return out


def treatment_unless_displacing(control: DataFrame, treatment: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per entity (the first key): the treatment's winners if every winner of the control is still one, else the control's. Adds arm."""
    entity = keys[0]
    moved = control.join(treatment.select(*keys, F.col(value).alias("_t")), keys, "left").filter(~F.col(value).eqNullSafe(F.col("_t"))).select(entity).distinct()
    kept = control.join(moved, entity, "left_semi").withColumn("arm", F.lit("control"))
    return treatment.join(moved, entity, "left_anti").withColumn("arm", F.lit("treatment")).unionByName(kept)


def crop_gate() -> Column:
    """Why a rendered crop is not taken; empty if it is. Columns: crop_path, box_width, box_height, viewport_width, identity_evidence."""
    w, h = F.col("box_width"), F.col("box_height")
    no = lambda ok, why: F.when(~F.coalesce(ok, F.lit(False)), why)
    return F.array_compact(
        F.array(
            no(F.coalesce("crop_path", F.lit("")) != "", "missing-crop"),
            no((w > 0) & (w <= 400), "width-out-of-range"),
            no((h > 0) & (h <= 120), "height-out-of-range"),
            no(w < F.col("viewport_width") * 0.8, "viewport-width-limit"),
            no((w / h).between(1.8, 12), "ratio-out-of-range"),
            no(F.col("identity_evidence"), "missing-identity-evidence"),
        )
    )


def failure_kind(status: Column, message: Column) -> Column:
    """The class of a failed attempt, first rule that holds."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403, 429, 503), "blocked_interstitial")
        .when(m.rlike("timed out|timeout|aborterror"), "timeout")
        .when(m.rlike("enotfound|eai_again|dns"), "dns")
        .when(m.rlike("certificate|cert_|tls|ssl|self[- ]signed|hostname.*match"), "tls")
        .when(m.contains("too many redirects"), "redirect")
        .when(status.isNotNull(), "http_status")
        .otherwise("transport")
    )


def describes_embedded_logo(text: Column) -> Column:
    """A logo named inside a description of a scene: at least four words (or a comma) before the mark, a place after it."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\r\n]+", " "))
    found = F.regexp_extract(t, "^(.*?)\\b(logo|wordmark|brand mark)\\b(.*)$", 2) != ""
    before, after = F.regexp_extract(t, "^(.*?)\\b(?:logo|wordmark|brand mark)\\b(.*)$", 1), F.regexp_extract(t, "^(.*?)\\b(?:logo|wordmark|brand mark)\\b(.*)$", 2)
    words = F.size(F.regexp_extract_all(before, F.lit("([a-z0-9]+)"), F.lit(1)))
    return found & (before.contains(",") | (words >= 4)) & after.rlike("\\b(in|on|at|inside|corner|center|centre|middle|top|bottom|background|image|photo|shot)\\b")
