"""HTML pages to rows: image candidates, links, manifests, the title. One narrow pass of Python over html, by the standard parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LOGO = re.compile(r"(?:^|[^a-z])(?:logo|brand|wordmark|logotype)s?(?:[^a-z]|$)", re.I)
NEGATIVE = re.compile(r"(?:^|[^a-z])(?:partner|client|customer|sponsor|testimonial|award|avatar|payment)s?(?:[^a-z]|$)", re.I)
INTENT = re.compile(r"press|media|brand|logo|newsroom|company|about", re.I)
PAGES = re.compile(r"brand|press[-_]?kit|media[-_]?kit|logos?(?:/|$)", re.I)
SCHEMA = "kind string, source string, url string, sizes string, type string, purpose string, alt string, region string, home_linked boolean, positive_token boolean, negative_context boolean, anchor_text string, place int"


def resolved(value: str | None, base: str) -> str | None:
    """The absolute http(s) URL of a reference; None for empty, null-like, credentialed or other references."""
    v = (value or "").strip()
    if not v or v.lower() in ("null", "undefined", "none", "#", "about:blank"):
        return None
    try:
        url = urljoin(base, v)
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or parts.username or parts.password or not host or host == "localhost" or host.endswith(".local"):
        return None
    return url.split("#")[0]


def srcset(value: str | None) -> list[tuple[str, str]]:
    """(url, descriptor) of every entry."""
    out = []
    for part in re.split(r",\s+|,(?=https?:)", value or ""):
        words = part.split()
        if words:
            out.append((words[0].rstrip(","), words[1] if len(words) > 1 else ""))
    return out


def organisation_logos(value) -> Iterator[str]:
    """Logo URLs of organisations anywhere in a JSON-LD value."""
    if isinstance(value, list):
        for v in value:
            yield from organisation_logos(v)
    elif isinstance(value, dict):
        kinds = value.get("@type")
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if any(isinstance(k, str) and (k.endswith("Organization") or k in ("Corporation", "Brand", "LocalBusiness")) for k in kinds):
            for logo in value.get("logo") if isinstance(value.get("logo"), list) else [value.get("logo")]:
                if isinstance(logo, str):
                    yield logo
                elif isinstance(logo, dict):
                    found = logo.get("url") or logo.get("contentUrl")
                    if isinstance(found, str):
                        yield found
        for k, v in value.items():
            if k != "logo":
                yield from organisation_logos(v)


class Page(HTMLParser):
    """Collects rows while it reads. Malformed markup and scripts that are no JSON are passed over."""

    def __init__(self, base: str, inside_noscript: bool = False):
        super().__init__(convert_charrefs=True)
        self.base, self.page, self.inside = base, base, inside_noscript
        self.rows: list[dict] = []
        self.open: list[tuple[str, dict]] = []
        self.title, self.script, self.noscript, self.anchor, self.svg = [], None, None, None, None

    def add(self, kind: str, source: str, url: str | None, **more) -> None:
        url = resolved(url, self.base)
        if url:
            region = next((t for t, _ in reversed(self.open) if t in ("header", "nav", "footer")), "body")
            text = " ".join([str(more.get("alt") or ""), more.pop("semantic", ""), url.rsplit("/", 1)[-1]])
            around = " ".join(f"{a.get('class', '')} {a.get('id', '')}" for _, a in self.open[-4:])
            home = self.anchor is not None and self.anchor["home"]
            self.rows.append({"kind": kind, "source": source, "url": url, "region": region, "home_linked": home, "positive_token": bool(LOGO.search(text)), "negative_context": bool(NEGATIVE.search(f"{around} {text}")), **more})

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.noscript is not None:
            self.noscript.append(self.get_starttag_text() or "")
            return
        if tag == "base" and a.get("href") and self.base == self.page:
            self.base = urljoin(self.page, a["href"])
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            more = {"sizes": a.get("sizes", ""), "type": a.get("type", "")}
            if "mask-icon" in rel:
                self.add("candidate", "mask-icon", a.get("href"), **more)
            elif any(r.startswith("apple-touch-icon") for r in rel):
                self.add("candidate", "apple", a.get("href"), **more)
            elif "icon" in rel:
                self.add("candidate", "html-icon", a.get("href"), **more)
            elif "manifest" in rel:
                self.add("manifest", "manifest", a.get("href"))
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            source = {"og:logo": "og-logo", "og:image": "social-banner", "og:image:url": "social-banner", "twitter:image": "social-banner", "msapplication-tileimage": "ms-tile", "logo": "microdata"}.get(name)
            if source:
                self.add("candidate", source, a.get("content"))
        elif tag == "img":
            source = "noscript-img" if self.inside else "dom-img"
            more = {"alt": a.get("alt", ""), "sizes": f"{a['width']}x{a['height']}" if a.get("width", "").isdigit() and a.get("height", "").isdigit() else "", "semantic": f"{a.get('class', '')} {a.get('id', '')}"}
            if "logo" in a.get("itemprop", "").lower().split():
                source = "microdata"
            for value in dict.fromkeys([a.get("src"), a.get("data-src"), a.get("data-lazy-src"), a.get("data-original"), *(u for u, _ in srcset(a.get("srcset") or a.get("data-srcset")))]):
                self.add("candidate", source, value, **more)
        elif tag == "source" and any(t == "picture" for t, _ in self.open):
            for u, _ in srcset(a.get("srcset")):
                self.add("candidate", "dom-picture", u, type=a.get("type", ""))
        elif tag == "svg" and self.svg is None:
            self.svg = {"depth": len(self.open), "a": a, "text": []}
        elif tag == "script":
            self.script = (a.get("type", "").lower(), [])
            if a.get("src"):
                self.add("script", "script", a["src"])
        elif tag == "noscript" and not self.inside:
            self.noscript = []
        elif tag == "a":
            url = resolved(a.get("href"), self.base)
            home = bool(url) and urlsplit(url).hostname == urlsplit(self.page).hostname and urlsplit(url).path in ("", "/") and not urlsplit(url).query
            self.anchor = {"url": a.get("href"), "home": home, "text": [a.get("aria-label", ""), a.get("title", "")]}
        if tag not in VOID:
            self.open.append((tag, a))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.noscript is not None:
            if tag == "noscript":
                inner, text, self.noscript = Page(self.base, True), "".join(self.noscript), None
                inner.open = list(self.open)
                inner.feed(text)
                self.rows += inner.rows
            else:
                self.noscript.append(f"</{tag}>")
                return
        if tag == "script" and self.script is not None:
            kind, text = self.script
            self.script = None
            if kind == "application/ld+json":
                try:
                    for url in dict.fromkeys(organisation_logos(json.loads("".join(text)))):
                        self.add("candidate", "schema", url)
                except (ValueError, RecursionError):
                    pass
        elif tag == "a" and self.anchor is not None:
            text = " ".join(" ".join(self.anchor["text"]).split())
            self.add("link", "anchor", self.anchor["url"], anchor_text=text[:240])
            self.anchor = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.svg is not None and k <= self.svg["depth"]:
                    a, label = self.svg["a"], " ".join(self.svg["text"])
                    words = f"{a.get('class', '')} {a.get('id', '')} {a.get('aria-label', '')} {label}"
                    if LOGO.search(words) or (self.anchor and self.anchor["home"]):
                        n = sum(r["source"] == "inline-svg" for r in self.rows)
                        self.rows.append({"kind": "candidate", "source": "inline-svg", "url": f"{self.page}#svg-{n}", "type": "image/svg+xml", "alt": (a.get("aria-label") or label)[:120], "home_linked": bool(self.anchor and self.anchor["home"]), "positive_token": bool(LOGO.search(words)), "negative_context": bool(NEGATIVE.search(words))})
                    self.svg = None
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.noscript is not None:
            self.noscript.append(data)
            return
        if self.script is not None:
            self.script[1].append(data)
        elif self.svg is not None:
            self.svg["text"].append(data.strip())
        elif self.open and self.open[-1][0] == "title" and self.svg is None:
            self.title.append(data)
        if self.anchor is not None and self.script is None:
            self.anchor["text"].append(data)


def page_rows(html: str | None, url: str) -> list[dict]:
    """All rows of one page, places from 0; a page that cannot be read gives what was read of it."""
    page = Page(url)
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):
        pass
    rows = page.rows
    title = " ".join("".join(page.title).split())
    if title:
        rows.append({"kind": "title", "source": "title", "url": url, "alt": title[:600]})
    for r in rows:
        if r["kind"] == "link" and INTENT.search(f"{r['anchor_text']} {urlsplit(r['url']).path}"):
            r["source"] = "brand-page" if PAGES.search(f"{r['anchor_text']} {urlsplit(r['url']).path}") else "high-intent"
    return [r | {"place": k} for k, r in enumerate(rows)]


def parse_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each candidate, link, manifest, script and title of each page. Null pages give none."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(i, r) for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3))) for r in page_rows(h, u or "")]
            cols = [pa.array([i for i, _ in rows], b.column(0).type), *(pa.array([r.get(n) for _, r in rows], k) for n, k in fields)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(n for n, _ in fields)])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return rows.withColumnRenamed("id", id_col)
