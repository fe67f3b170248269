"""A policy for SVG files: whole, inert, standalone documents only."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that may occur.
ELEMENTS = set(
    "svg g defs symbol use switch title desc metadata path rect circle ellipse line polyline polygon lineargradient radialgradient stop pattern clippath mask marker filter "
    "feblend fecolormatrix fecomponenttransfer fecomposite feconvolvematrix fediffuselighting fedisplacementmap fedistantlight fedropshadow feflood fefunca fefuncb fefuncg fefuncr "
    "fegaussianblur feimage femerge femergenode femorphology feoffset fepointlight fespecularlighting fespotlight fetile feturbulence image text tspan textpath style view".split()
)
# Namespaces, references inside the document, embedded pictures.
NAMESPACES = {"xmlns": "http://www.w3.org/2000/svg", "xmlns:xlink": "http://www.w3.org/1999/xlink"}
INSIDE = re.compile(r"#[A-Za-z_][\w:.-]*\Z")
DATA = re.compile(r"data:image/(?:png|gif|jpe?g|webp);base64,[A-Za-z0-9+/]+={0,2}\Z", re.I)
LOCAL_URL = re.compile(r"url\(\s*(['\"]?)#[A-Za-z_][\w:.-]*\1\s*\)", re.I)
# Functions that style values may call, and properties that styles may set.
CALLS = set(
    "rgb rgba hsl hsla hwb lab lch oklab oklch calc min max clamp matrix matrix3d translate translatex translatey translate3d scale scalex scaley scale3d "
    "rotate rotatex rotatey rotatez skew skewx skewy perspective rect".split()
)
PROPERTIES = set(
    "alignment-baseline baseline-shift clip clip-path clip-rule color color-interpolation color-interpolation-filters color-rendering direction display "
    "dominant-baseline fill fill-opacity fill-rule filter flood-color flood-opacity font-family font-size font-stretch font-style font-variant font-weight "
    "letter-spacing lighting-color marker-end marker-mid marker-start mask opacity overflow paint-order pointer-events shape-rendering stop-color stop-opacity "
    "stroke stroke-dasharray stroke-dashoffset stroke-linecap stroke-linejoin stroke-miterlimit stroke-opacity stroke-width text-anchor text-decoration "
    "text-rendering transform transform-origin unicode-bidi vector-effect visibility word-spacing writing-mode".split()
)
# Attributes that may occur, besides aria- and data- ones.
ATTRIBUTES = set(
    "accent-height alignment-baseline baseline-shift cap-height class clip clip-path clip-rule color color-interpolation color-interpolation-filters "
    "color-profile color-rendering cursor cx cy d direction display dominant-baseline dx dy edgeMode elevation enable-background fill fill-opacity "
    "fill-rule filter filterUnits flood-color flood-opacity font-family font-size font-size-adjust font-stretch font-style font-variant font-weight fx fy "
    "glyph-name glyph-orientation-horizontal glyph-orientation-vertical gradientTransform gradientUnits height href id image-rendering in in2 intercept k "
    "k1 k2 k3 k4 kernelMatrix kernelUnitLength letter-spacing lighting-color limitingConeAngle marker-end marker-mid marker-start markerHeight markerUnits "
    "markerWidth mask maskContentUnits maskUnits mode numOctaves offset opacity operator order orient orientation origin overflow paint-order pathLength "
    "patternContentUnits patternTransform patternUnits pointer-events points preserveAlpha preserveAspectRatio primitiveUnits r radius refX refY "
    "rendering-intent result role rotate rx ry scale seed shape-rendering slope spacing specularConstant specularExponent spreadMethod stdDeviation "
    "stitchTiles stop-color stop-opacity stroke stroke-dasharray stroke-dashoffset stroke-linecap stroke-linejoin stroke-miterlimit stroke-opacity "
    "stroke-width style surfaceScale systemLanguage tableValues targetX targetY text-anchor text-decoration text-rendering transform transform-origin type "
    "unicode-bidi vector-effect version viewBox visibility width word-spacing writing-mode x x1 x2 xChannelSelector xlink:href xml:space xmlns xmlns:xlink "
    "y y1 y2 yChannelSelector z zoomAndPan".lower().split()
)
DEPTH = 256


class Unsafe(Exception):
    pass


def css_value(v: str) -> None:
    if re.search(r"[\\@<>{}]|/\*", v):
        raise Unsafe("style")
    rest = LOCAL_URL.sub("", v)
    if re.search(r"url\s*\(", rest, re.I) or any(f.lower() not in CALLS for f in re.findall(r"([A-Za-z][\w-]*)\s*\(", rest)):
        raise Unsafe("style")


def css(v: str) -> None:
    """Declarations, or rules with plain selectors around them."""
    bodies = [v]
    if "{" in v:
        rules = re.findall(r"([^{}]*)\{([^{}]*)\}", v)
        if re.sub(r"[^{}]*\{[^{}]*\}", "", v).strip() or any(not re.fullmatch(r"[\w\s.,#*-]*", s) for s, _ in rules):
            raise Unsafe("style")
        bodies = [b for _, b in rules]
    for body in bodies:
        for d in filter(str.strip, body.split(";")):
            name, colon, value = d.partition(":")
            if not colon or name.strip().lower() not in PROPERTIES:
                raise Unsafe("style")
            css_value(value)


def verdict(raw: bytes | None, attributes: set[str] = ATTRIBUTES) -> str:
    """safe, or why not: empty, malformed, root, doctype, element, handler, attribute, namespace, reference, style, depth. attributes: the attributes (lower
    case) that may occur besides aria- and data- ones."""
    if not raw:
        return "empty"
    parser = expat.ParserCreate("utf-8")
    stack: list[str] = []
    sheet: list[str] = []

    def start(name, attrs):
        low = name.lower()
        if not stack and name != "svg":
            raise Unsafe("root")
        if ":" in name or low not in ELEMENTS:
            raise Unsafe("element")
        stack.append(low)
        if len(stack) > DEPTH:
            raise Unsafe("depth")
        for key, value in attrs.items():
            k = key.lower()
            if k.startswith("on"):
                raise Unsafe("handler")
            if k not in attributes and not re.fullmatch(r"(aria|data)-[a-z0-9_.:-]+", k):
                raise Unsafe("attribute")
            if k in NAMESPACES:
                if value != NAMESPACES[k] or key != k or (k == "xmlns" and low != "svg"):
                    raise Unsafe("namespace")
            elif ":" in k and k not in ("xlink:href", "xml:space"):
                raise Unsafe("namespace")
            elif k in ("href", "xlink:href", "src"):
                v = re.sub(r"[\x00-\x20\x7f]+", "", value)
                if v and not INSIDE.match(v) and not (low in ("image", "feimage") and DATA.match(v)):
                    raise Unsafe("reference")
            elif k == "style":
                css(value)
            else:
                css_value(value)

    def end(name):
        if stack.pop() == "style":
            css("".join(sheet))
            sheet.clear()

    def text(data):
        if stack and stack[-1] == "style":
            sheet.append(data)

    def refuse(*_):
        raise Unsafe("doctype")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    try:
        parser.Parse(raw.decode("utf-8"), True)
    except Unsafe as e:
        return str(e)
    except (expat.ExpatError, UnicodeDecodeError, ValueError):
        return "malformed"
    return "safe"


@F.pandas_udf(T.StringType())
def svg_verdict(content: pd.Series) -> pd.Series:
    return content.map(lambda c: verdict(bytes(c) if c is not None else None))


def svg_verdict_with(attributes: set[str]):
    """Column -> Column: the verdict where only these attributes may occur."""

    @F.pandas_udf(T.StringType())
    def judged(content: pd.Series) -> pd.Series:
        return content.map(lambda c: verdict(bytes(c) if c is not None else None, attributes))

    return judged
