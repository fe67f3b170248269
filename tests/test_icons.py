"""The whole pick of an icon: an entity for each way it may go."""

from __future__ import annotations

import pytest

from querncore.operators import icons

SCHEMA = """entity string, id int, url string, resolved_url string, source string, score double, bytes int, width double, height double, role_scores struct<icon:double,wide:double,favicon:double>, predicted_roles array<string>, effective double, padded_wordmark boolean,
points int, usable boolean, rejected array<string>, home_linked boolean, dom_region string, positive_token boolean, agrees_with_company boolean, exact_company_label boolean, generic_reason string, manifest_agrees boolean, family string, favicon_rank double, bimi_shape_ok boolean"""
BASE = {"url": "https://a.test/mark.png", "source": "dom-img", "score": 60.0, "bytes": 10, "width": 64.0, "height": 64.0, "icon": 60.0, "roles": ["icon"], "points": 0, "usable": True, "family": None, "favicon_rank": 1.0}


def row(entity, k, **told):
    c = BASE | {"effective": told.get("icon", 60.0)} | told
    return (entity, k, c["url"], c.get("resolved_url"), c["source"], c["score"], c["bytes"], c["width"], c["height"], (c["icon"], 0.0, 0.0), c["roles"], c["effective"], c.get("padded"), c["points"], c["usable"], c.get("rejected"), c.get("home"), c.get("region"), c.get("positive"), c.get("agrees"), c.get("exact"), c.get("generic"), c.get("manifest"), c["family"] or f"f{k}", c["favicon_rank"], c.get("bimi_ok"))


MARK = {"region": "header", "positive": True}
APPLE = {"source": "apple", "icon": 50.0}
APP = {"source": "apple", "url": "https://a.test/i/app_ico.png"}
DRAWN, TWIN = {"source": "inline-svg"}, {"source": "browser-inline-svg", "roles": ["icon"], "usable": True, "icon": 56.0, "score": 90.0}
#: rows of an entity; winner, action, other.
CASES = {
    "best": ([{}, {"icon": 70.0, "home": True}, {"icon": 90.0, "roles": ["wide"]}, {"icon": 95.0, "usable": False}, {"icon": 99.0, "source": "social-banner"}], 1, "ranked", None),
    "padded last": ([{"icon": 90.0, "padded": True, "home": True}, {"icon": 40.0, "home": True}], 1, "ranked", None),
    "wish first": ([{"icon": 90.0, "home": True}, {"icon": 40.0, "home": True, "points": 2}], 1, "ranked", None),
    "bytes": ([{"home": True}, {"home": True, "bytes": 11}], 1, "ranked", None),
    "overall": ([{"home": True}, {"home": True, "score": 61.0}], 1, "ranked", None),
    "tie": ([{"home": True}, {"home": True}], 0, "ranked", None),
    "displaced": ([{}, APPLE], 1, "declared-icon-displaced-page-mark", 0),
    "declared too weak": ([{}, APPLE | {"icon": 48.0}], 0, "ranked", None),
    "home mark stays": ([{"home": True}, APPLE], 0, "ranked", None),
    "abstained": ([MARK, APPLE], 0, "declared-icon-abstained", 1),
    "agreed": ([MARK, APPLE | {"agrees": True}], 1, "declared-icon-displaced-page-mark", 0),
    "manifest agreed": ([MARK, APPLE | {"manifest": True}], 1, "declared-icon-displaced-page-mark", 0),
    "family agreed": ([MARK, APPLE | {"family": "x"}, {"source": "schema", "icon": 10.0, "family": "x"}], 1, "declared-icon-displaced-page-mark", 0),
    "family rejected": ([MARK, APPLE | {"family": "x"}, {"source": "schema", "icon": 10.0, "family": "x", "rejected": ["small"]}], 0, "declared-icon-abstained", 1),
    "family of the mark itself": ([MARK | {"family": "x"}, APPLE | {"family": "x"}], 1, "declared-icon-displaced-page-mark", 0),
    "twin": ([DRAWN, TWIN | {"effective": 56.0, "roles": ["icon"], "icon": 56.0}], 1, "rendered-twin-selected", 0),
    "twin too weak": ([DRAWN, TWIN | {"effective": 54.9}], 0, "ranked", None),
    "twin too large": ([DRAWN, TWIN | {"width": 73.0}], 0, "ranked", None),
    "twin generic": ([DRAWN, TWIN | {"generic": "x"}], 0, "ranked", None),
    "first twin alone": ([DRAWN, TWIN | {"effective": 10.0}, TWIN | {"score": 80.0}], 0, "ranked", None),
    "application": ([APP], None, "icon-abstained", 0),
    "application at home": ([APP | {"home": True}], 0, "ranked", None),
    "application named": ([APP | {"exact": True}], 0, "ranked", None),
    "application in a family": ([APP | {"family": "x"}, {"source": "schema", "roles": [], "family": "x"}], 0, "ranked", None),
    "application beside a corporate icon": ([APP, {"source": "schema", "icon": 10.0}], 0, "ranked", None),
    "application beside another": ([APP, {"source": "schema", "icon": 10.0, "roles": ["wide"]}], None, "icon-abstained", 0),
    "no application": ([APP | {"url": "https://a.test/happy-icon.png"}], 0, "ranked", None),
    "fallback": ([{"roles": ["favicon"], "source": "html-icon"}, {"roles": ["favicon"], "source": "html-icon", "favicon_rank": 2.0}, {"roles": ["wide"]}], 1, "favicon-fallback-selected", None),
    "fallback too small": ([{"roles": ["favicon"], "height": 13.0}, {"roles": ["favicon"], "bimi_ok": False}], None, "none", None),
    "nothing": ([{"roles": None, "usable": None}], None, "none", None),
}


@pytest.fixture(scope="module")
def picked(spark):
    rows = [row(e, k, **told) for e, (many, *_) in CASES.items() for k, told in enumerate(many)]
    return {r.entity: r for r in icons.pick_icons(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


@pytest.mark.parametrize("entity", CASES)
def test_pick(picked, entity):
    r, (_, winner, action, other) = picked[entity], CASES[entity]
    assert (r.winner, r.action, r.other) == (winner, action, other)


def test_no_candidates(spark):
    assert icons.pick_icons(spark.createDataFrame([], SCHEMA)).count() == 0
