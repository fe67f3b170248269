"""The lookup in a knowledge base: a domain for each way it ends."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querncore.operators import knowledge

CLAIM = "entity string, property string, statement string, rank string, value string, start_time string, start_precision int, end_time string, end_precision int, point_in_time boolean, end_cause boolean"
OK_FILE = ("https://upload.wikimedia.org/wikipedia/commons/a.svg", "https://commons.wikimedia.org/wiki/File:A.svg", 100, 100, "PD", "https://l", None)


def claim(entity, prop, value, rank="normal", start=None, end=None, point=False, cause=False, precision=11):
    return (entity, prop, f"s-{entity}-{value}", rank, value, start, precision, end, precision, point, cause)


def site(entity, value, **k):
    return claim(entity, knowledge.WEBSITE, value, **k)


def logo(entity, value, **k):
    return claim(entity, knowledge.LOGO, value, **k)


#: domain: hits by name, hits by website, whether that search was cut off, status, reason.
CASES = {
    "ok.com": (["Q1"], [], False, "ok", None),
    "late.com": (["Q90"], ["Q2"], False, "ok", None),
    "early.com": (["Q3"], ["Q4"], True, "ok", None),
    "cut.com": (["Q90"], ["Q5"], True, "search_candidates_truncated", None),
    "none.com": ([], [], False, "no_search_candidates", None),
    "many.com": (["Q6", "Q91", "Q92", "Q93"], [], False, "search_candidates_truncated", None),
    "manynone.com": (["Q90", "Q91", "Q92", "Q93"], [], False, "no_verified_current_logo", "no_domain_match"),
    "two.com": (["Q7", "Q8"], [], False, "ambiguous_entities", "multiple_domain_matches"),
    "product.com": (["Q9"], [], False, "no_verified_current_logo", "no_domain_match"),
    "nologo.com": (["Q10"], [], False, "no_verified_current_logo", "no_current_logo_claim"),
    "twologos.com": (["Q11"], [], False, "ambiguous_logo_claims", None),
    "preferred.com": (["Q12"], [], False, "ok", None),
    "samefile.com": (["Q13"], [], False, "ok", None),
    "ended.com": (["Q14"], [], False, "no_verified_current_logo", "no_current_logo_claim"),
    "missing.com": (["Q15"], [], False, "unsafe_or_missing_file", "missing_page"),
    "unsafe.com": (["Q16"], [], False, "unsafe_or_missing_file", "unsafe_url"),
    "nolicense.com": (["Q17"], [], False, "unsafe_or_missing_file", "insufficient_license"),
    "shape.com": (["Q18"], [], False, "unsafe_or_missing_file", "incompatible_role"),
    "moved.com": (["Q19"], [], False, "ok", None),
    "lang.com": (["Q20"], [], False, "ok", None),
    "oldsite.com": (["Q21"], [], False, "no_verified_current_logo", "no_domain_match"),
}
FRONT = {"Q2": "late", "Q3": "early", "Q4": "early", "Q5": "cut", "Q6": "many", "Q7": "two", "Q8": "two", "Q10": "nologo", "Q11": "twologos", "Q12": "preferred", "Q13": "samefile", "Q14": "ended", "Q15": "missing", "Q16": "unsafe", "Q17": "nolicense", "Q18": "shape", "Q19": "moved"}
CLAIMS = (
    [site(e, f"https://www.{n}.com/") for e, n in FRONT.items()]
    + [logo(e, "A.svg") for e in ("Q1", "Q2", "Q3", "Q4", "Q5", "Q6", "Q7", "Q8", "Q9", "Q20", "Q21")]
    + [site("Q1", "http://OK.com"), site("Q9", "https://www.product.com/music"), site("Q9", "https://shop.product.com/"), site("Q9", "https://product.com/?x=1"), site("Q9", "https://u:p@product.com/"), site("Q9", None), site("Q9", "https://qq.product.com")]
    + [logo("Q10", "A.svg", rank="deprecated"), logo("Q10", " "), logo("Q11", "A.svg"), logo("Q11", "B.svg"), logo("Q12", "A.svg", rank="preferred"), logo("Q12", "B.svg"), logo("Q13", "A.svg"), logo("Q13", "file:a.SVG ")]
    + [logo("Q14", "A.svg", end="+2000-01-01T00:00:00Z"), logo("Q14", "B.svg", start="+2090-00-00T00:00:00Z", precision=9), logo("Q14", "C.svg", point=True), logo("Q14", "D.svg", cause=True), logo("Q14", "E.svg", start="someday")]
    + [logo("Q15", "Gone.svg"), logo("Q16", "Unsafe.svg"), logo("Q17", "Free.svg"), logo("Q18", "Wide.svg"), logo("Q19", "Old name.svg")]
    + [site("Q20", "https://de-at.lang.com/en"), site("Q21", "https://oldsite.com", end="+2001-02-00T00:00:00Z", precision=10)]
)
FILES = [
    ("File:A.svg", None, *OK_FILE),
    ("File:Unsafe.svg", None, "https://upload.wikimedia.org.evil.test/wikipedia/commons/a.svg", *OK_FILE[1:]),
    ("File:Free.svg", None, *OK_FILE[:4], "PD", None, None),
    ("File:Wide.svg", None, *OK_FILE[:2], 400, 100, *OK_FILE[4:]),
    ("File:Old_name.svg", "File:A.svg", *[None] * 7),
]


@pytest.fixture(scope="module")
def told(spark):
    tables = {
        "asked": spark.createDataFrame([(d, ["icon"], "x") for d in CASES] + [("ok.com", ["wide"], "y"), (None, ["icon"], "z")], "domain string, roles array<string>, entity string"),
        "hits": spark.createDataFrame([(d, e, k) for d, c in CASES.items() for k, e in enumerate(c[0])] + [("ok.com", "Q1", 9)], "domain string, entity string, place long"),
        "site_hits": spark.createDataFrame([(d, e) for d, c in CASES.items() for e in c[1]], "domain string, entity string"),
        "site_searches": spark.createDataFrame([(d, c[2]) for d, c in CASES.items()], "domain string, truncated boolean"),
        "claims": spark.createDataFrame(CLAIMS, CLAIM),
        "files": spark.createDataFrame(FILES, "title string, redirect_to string, url string, description_url string, width int, height int, license_name string, license_url string, usage_terms string"),
        "suffixes": spark.createDataFrame([("com",)], "rule string"),
    }
    out = knowledge.lookup(**tables, now=F.to_date(F.lit("2020-06-01")), most=3)
    return {r.domain: r for r in out.collect()}


def test_each_way_it_ends(told):
    assert {d: (r.status, r.reason) for d, r in told.items()} == {d: c[3:] for d, c in CASES.items()}


def test_what_is_told(told):
    assert told["ok.com"].eligible_roles == ["icon", "wide"] and told["ok.com"].entity == "Q1" and told["ok.com"].url == OK_FILE[0]
    assert told["samefile.com"].statements == ["s-Q13-A.svg", "s-Q13-file:a.SVG "] and told["preferred.com"].file == "a.svg"
    assert told["moved.com"].url == OK_FILE[0] and told["moved.com"].file == "old name.svg"
    assert all((r.url is not None) == (r.status == "ok") and (r.entity is None) == (r.status not in ("ok", "unsafe_or_missing_file")) for r in told.values())
