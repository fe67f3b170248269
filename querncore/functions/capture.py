"""Captured instances and landed claims: kinds and roles of what was seen, boxes, dates with a precision, small text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sources of icons and of structured data.
ICON_SOURCES = ("manifest", "apple", "mask-icon", "ms-tile", "html-icon", "besticon")
STRUCTURED_SOURCES = ("schema", "og-logo", "microdata")
#: Patterns that a recovered file's title gains or loses by.
NO_LOGO = r"\b(icon|symbol|favicon|app[ _-]?icon|seal|emblem|monogram)\b"
NOT_CURRENT = r"\b(old|former|obsolete|legacy|historic|history|construction|store|building|headquarters|screenshot|photo|advert|sponsor|foundation)\b"
DATED = r"\b(19\d{2}|200\d|201[0-6])\b"


def source_kind(source: Column) -> Column:
    """The kind of an observed source; the first rule that holds counts."""
    s = F.lower(F.coalesce(source, F.lit("")))
    inline = s.contains("inline")
    return (
        F.when(s.contains("picture"), "picture")
        .when(inline, "inline_svg")
        .when(s.isin(*STRUCTURED_SOURCES), "structured_data")
        .when(s.contains("background"), "css_background")
        .when(s.contains("mask"), "css_mask")
        .when(s == "manifest", "manifest")
        .when(s.contains("favicon") | s.isin(*ICON_SOURCES), "favicon")
        .when(s.contains("img") | s.contains("image"), "img")
        .when(s.contains("text"), "text_only")
        .otherwise("other")
    )


def visual_role(kind: Column, source: Column, width: Column, height: Column) -> Column:
    ratio = F.when((width > 0) & (height > 0), width / height)
    return (
        F.when(kind == "text", "other")
        .when(kind == "mask", "symbol")
        .when((kind == "favicon") | F.lower(source).contains("favicon"), "favicon")
        .when(ratio >= 1.8, "horizontal_lockup")
        .when(ratio.between(0.72, 1.4), "symbol")
        .otherwise("other")
    )


def visibility(visible: Column, width: Column, height: Column, theme: Column) -> Column:
    return F.when(~visible | (width < 2) | (height < 2), "unusable").when(theme.isin("dark", "light"), "good").otherwise("conditional")


def clamped_box(x: Column, y: Column, width: Column, height: Column, full_width: Column, full_height: Column) -> Column:
    """The part of a box inside a picture; what is null or negative counts as 0."""
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    w, h = zero(full_width), zero(full_height)
    left, top = F.least(w, zero(x)), F.least(h, zero(y))
    return F.struct(left.alias("x"), top.alias("y"), F.least(w - left, zero(width)).alias("width"), F.least(h - top, zero(height)).alias("height"))


def visual_key(entity: Column, kind: Column, url: Column, svg_hash: Column, region: Column, box: list[Column]) -> Column:
    """What is the same instance in another view; halves of box edges round up."""
    rounded = [F.floor(F.coalesce(c, F.lit(0.0)) + 0.5).cast("string") for c in box]
    seen = F.coalesce(url, F.concat(F.lit("svg:"), F.coalesce(svg_hash, F.lit(""))))
    return F.concat_ws("\0", entity.cast("string"), F.coalesce(kind, F.lit("other")), seen, F.coalesce(region, F.lit("unknown")), *rounded)


def success_class(told: Column, asked_host: Column, final_host: Column) -> Column:
    """How a page that loaded counts: as told, else by whether its host belongs to the one asked for. Empty hosts tell nothing."""
    under = lambda a, b: a.endswith(F.concat(F.lit("."), b))
    related = (asked_host == final_host) | under(asked_host, final_host) | under(final_host, asked_host)
    return F.coalesce(told, F.when((asked_host != "") & (final_host != "") & ~related, "redirected_off_domain").otherwise("live_html"))


def title_score(title: Column, mime: Column, width: Column, height: Column, agrees: Column) -> Column:
    """Points of a recovered file by its title, type and shape."""
    ratio = F.when((width > 0) & (height > 0), width / height).otherwise(0.0)
    has = lambda pattern: title.rlike("(?i)" + pattern)
    terms = [
        F.when(agrees, 50).otherwise(-100),
        F.when(has("wordmark"), 30),
        F.when(has("logo|logotype"), 15),
        F.when(mime == "image/svg+xml", 18).when(mime.rlike("image/(png|webp)"), 8),
        F.when(ratio >= 2, 22).when(ratio >= 1.35, 14).when(ratio >= 0.8, 4).otherwise(-20),
        F.when(has(NO_LOGO), -55),
        F.when(has(NOT_CURRENT), -45),
        F.when(title.rlike(DATED), -18),
    ]
    return reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) for x in terms))


def precision_interval(time: Column, precision: Column) -> Column:
    """first and last date that a time of so much precision (9: year, 10: month, 11: day) may mean; null where it means none."""
    part = lambda at, n: F.substring(time, at, n)
    month = F.when(precision >= 10, part(7, 2)).otherwise("01")
    day = F.when(precision >= 11, part(10, 2)).otherwise("01")
    ok = precision.between(9, 11) & time.rlike(r"^\+\d{4}-\d{2}-\d{2}T") & (part(2, 4) > "0000")
    first = F.when(ok, F.concat_ws("-", part(2, 4), month, day).try_cast("date"))
    last = F.when(precision == 9, F.date_sub(F.add_months(first, 12), 1)).when(precision == 10, F.last_day(first)).otherwise(first)
    return F.when(first.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def claim_disposition(rank: Column, value: Column, end_cause: Column, start: Column, end: Column, has_start: Column, has_end: Column, point_in_time: Column, now: Column) -> Column:
    """What a claim is at a date: invalid, ended, future, historical_point_in_time or current. start, end: precision intervals."""
    return (
        F.when((F.coalesce(rank, F.lit("")) == "deprecated") | value.isNull(), "invalid")
        .when(end_cause, "ended")
        .when((has_start & start.isNull()) | (has_end & end.isNull()), "invalid")
        .when(start["first"] > now, "future")
        .when(end["last"] < now, "ended")
        .when(point_in_time & start.isNull() & end.isNull(), "historical_point_in_time")
        .otherwise("current")
    )


def camel_split(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def percent_decoded(c: Column) -> Column:
    """Null where a percent sign starts no byte; plus signs stay."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def data_url_bytes(c: Column) -> Column:
    """The bytes of a base64 data URL; null for anything else."""
    body = F.regexp_extract(c, "^data:[^,]*;base64,(.*)$", 1)
    return F.when(c.rlike("^data:[^,]*;base64,"), F.try_to_binary(body, F.lit("base64")))
