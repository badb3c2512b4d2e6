"""What a coordinate reference system is written like, and whether its coordinates are degrees."""

from __future__ import annotations

import json
import re

# Codes of the EPSG register between 4001 and 4881 that aren't geographic (projected, geocentric), as ranges, ends included; beyond, even ones are geocentric ...
NOT_GEOGRAPHIC = (
    (4037, 4038), (4048, 4051), (4056, 4063), (4071, 4071), (4082, 4083), (4087, 4088), (4093, 4096), (4217, 4217), (4328, 4331), (4333, 4385), (4390, 4394), (4396, 4462),
    (4465, 4465), (4467, 4467), (4471, 4471), (4473, 4474), (4479, 4479), (4481, 4481), (4484, 4489), (4491, 4554), (4556, 4556), (4559, 4559), (4568, 4589), (4647, 4647),
    (4652, 4656), (4766, 4800), (4822, 4822), (4826, 4826), (4839, 4839), (4855, 4881), (4910, 4920),
)
# ... and geographic ones in use outside 4001 to 4999.
GEOGRAPHIC = (
    3819, 3821, 3824, 3889, 3906, 5132, 5228, 5229, 5233, 5246, 5252, 5264, 5324, 5340, 5354, 5360, 5365, 5371, 5373, 5381, 5393, 5451, 5464, 5467, 5489, 5524, 5527, 5546, 5561, 5593,
    5681, 5886, 6135, 6207, 6311, 6318, 6322, 6325, 6365, 6668, 6706, 6783, 6881, 6882, 6883, 6892, 6894, 6980, 6983, 6987, 6990, 7035, 7073, 7084, 7088, 7133, 7136, 7139, 7373, 7683,
    7686, 7798, 7844, 7881, 7886, 8042, 8043, 8086, 8232, 8237, 8240, 8246, 8249, 8252, 8255, 9000, 9057, 9755, 9777, 9784,
)
#: Names that stand for WGS 84 and its kin, and the words that WKT begins with.
NAMES = {"wgs84", "wgs 84", "crs84", "nad27", "nad83", "crs83", "crs27"}
WKT_GEOGRAPHIC = ("GEOGCS", "GEOGCRS", "GEOGRAPHICCRS")
WKT_OTHER = ("PROJCS", "PROJCRS", "PROJECTEDCRS", "GEOCCS", "GEODCRS", "GEODETICCRS", "LOCAL_CS", "ENGCRS", "ENGINEERINGCRS", "VERT_CS", "VERTCRS")
WKT_WRAPPED = ("COMPD_CS", "COMPOUNDCRS", "BOUNDCRS", "DERIVEDPROJCRS")

_CODE = re.compile(r"(?:urn:ogc:def:crs:|https?://www\.opengis\.net/def/crs/)?([A-Za-z]+)[:/](?:[0-9.]*[:/])?([A-Za-z0-9]+)")


def geographic_code(code: int) -> bool:
    if 4001 <= code <= 4999:
        return not any(a <= code <= b for a, b in NOT_GEOGRAPHIC) and not (code > 4881 and code % 2 == 0)
    return code in GEOGRAPHIC


def is_geographic(crs: object) -> bool:
    """Whether coordinates are in degrees, for an EPSG code, authority:code, URN, PROJ string, WKT, PROJJSON or an object that says so itself.

    Anything else raises ValueError.
    """
    own = getattr(crs, "is_geographic", None)
    if isinstance(own, bool):
        return own
    if isinstance(crs, int) and not isinstance(crs, bool):
        return geographic_code(crs)
    if isinstance(crs, dict):
        return _json(crs)
    bad = ValueError(f"Not a coordinate reference system: {crs!r}")
    text = crs.to_wkt() if hasattr(crs, "to_wkt") else crs
    if not isinstance(text, str):
        raise bad
    text = text.strip()
    if text.startswith("{"):
        try:
            return _json(json.loads(text))
        except json.JSONDecodeError:
            raise bad from None
    if text.lower() in NAMES:
        return True
    if text.startswith("+") or "+proj=" in text:
        proj = re.search(r"\+proj=([a-z_0-9]+)", text)
        if proj:
            return proj[1] in ("longlat", "latlong", "latlon", "lonlat")
        init = re.search(r"\+init=([A-Za-z]+):([0-9]+)", text)
        if init:
            return geographic_code(int(init[2]))
        raise bad
    word = re.match(r"([A-Za-z_]+)\s*[\[(]", text)
    if word:
        kind = word[1].upper()
        if kind in WKT_GEOGRAPHIC:
            return True
        if kind in ("GEODCRS", "GEODETICCRS"):
            return "ellipsoidal" in text.lower()
        if kind in WKT_WRAPPED:
            return not any(f"{w}[" in text.upper() for w in WKT_OTHER[:3]) and any(f"{w}[" in text.upper() for w in WKT_GEOGRAPHIC)
        if kind in WKT_OTHER:
            return False
        raise bad
    code = _CODE.fullmatch(text)
    if code is None:
        raise bad
    authority, number = code[1].upper(), code[2]
    if authority == "OGC":
        if number.upper() not in ("CRS84", "CRS84H", "CRS83", "CRS27"):
            raise bad
        return True
    if authority == "EPSG" and not number.isdigit():
        raise bad
    if authority not in ("EPSG", "ESRI", "IAU", "IGNF"):
        raise bad
    return number.isdigit() and geographic_code(int(number)) if authority == "EPSG" else authority == "ESRI" and number.startswith("104")


def _json(found: dict) -> bool:
    kind = found.get("type", "")
    if kind in ("GeographicCRS",):
        return True
    if kind == "BoundCRS":
        return _json(found.get("source_crs", {}))
    if kind == "CompoundCRS":
        return any(_json(c) for c in found.get("components", []) if c.get("type") != "VerticalCRS")
    if not kind.endswith("CRS"):
        raise ValueError("Not a coordinate reference system: no PROJJSON")
    return False
