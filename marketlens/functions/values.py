"""Column expressions over prices, years, URLs, keys and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import DEPRECIATION


def present(x: Column) -> Column:
    """Neither null, empty nor zero: how missing values are told apart."""
    return F.coalesce((x.cast("string") != "") & (F.coalesce(x.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))


def sane_price(prix: Column, low: float = 1, high: float = 1_000_000) -> Column:
    return F.when(prix.between(low, high), prix)


def valid_price(prix: Column) -> Column:
    """The range that analytics and reports take."""
    return (prix > 0) & (prix < 500_000)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding as JavaScript does: halves towards positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, (new - old) / old * 100)


def parsed_price(text: Column) -> Column:
    """A written price: the right-most separator is decimal, unless three digits follow it, which makes it thousands."""
    x = F.regexp_replace(text, "[^0-9,.]", "")
    comma, dot = F.length(x) - F.instr(F.reverse(x), ","), F.length(x) - F.instr(F.reverse(x), ".")
    both = F.contains(x, F.lit(",")) & F.contains(x, F.lit("."))
    one = F.when(x.rlike("^[0-9]+([,.][0-9]{3})+$"), F.regexp_replace(x, "[,.]", "")).otherwise(F.replace(x, F.lit(","), F.lit(".")))
    plain = F.when(both & (comma > dot), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(x, F.lit(","), F.lit(""))).otherwise(one)
    return plain.try_cast("double")


def guarded_number(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9.]+$"), text.try_cast("double"))


def currency(text: Column) -> Column:
    x = F.upper(text)
    return F.when(x.rlike("US\\$|USD"), "USD").when(x.rlike("€|EUR"), "EUR").when(x.rlike("£|GBP"), "GBP").when(x.rlike("\\$|CAD"), "CAD")


def formatted_price(prix: Column) -> Column:
    """1234.5 as ``1 234.50 $``."""
    return F.concat(F.replace(F.format_number(prix, 2), F.lit(","), F.lit(" ")), F.lit(" $"))


def year_in_text(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")


def year_in_url(url: Column) -> Column:
    """A year between separators, one of 2010 to 2029 first."""
    near = F.regexp_extract(url, r"[/-](20[12][0-9])(?:[/-]|\.html|$)", 1).try_cast("int")
    far = F.regexp_extract(url, r"[/-]((?:19|20)[0-9]{2})(?:[/-]|\.html|$)", 1).try_cast("int")
    return F.coalesce(near, F.when(far.between(1990, 2100), far))


def host(url: Column) -> Column:
    """Host in lower case without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)", 1)), r"^www\.", "")


TRACKING = "utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|ref"


def url_key(url: Column) -> Column:
    """A URL without fragment, tracking parameters, page numbers and a slash at the end, in lower case up to the path."""
    x = F.regexp_replace(url, "#.*$", "")
    x = F.regexp_replace(x, rf"([?&])(?:(?:{TRACKING}|page)=[^&]*&?)+", "$1")
    return F.regexp_replace(F.regexp_replace(x, "[?&]+$", ""), "/+$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_language(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url_path(url), "^/(fr|en|es|de)(?:/|$)", 1), F.lit(""))


def short_md5(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 12)


def unit_key(vin: Column, stock: Column, url: Column, name: Column, color: Column) -> Column:
    """Identity of a physical unit: VIN, stock number, number at the URL's end, URL, digest of name and colour."""
    v, s, u = F.upper(F.trim(vin)), F.nullif(F.trim(stock), F.lit("")), F.nullif(F.regexp_replace(url, "/+$", ""), F.lit(""))
    tail = F.nullif(F.lower(F.regexp_extract(u, "(?i)-([a-z]{0,8}[0-9]{1,10})$", 1)), F.lit(""))
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.when(F.length(v) >= 10, v), s, tail, u, short_md5(F.concat(text(name), F.lit("|"), text(color))))


def state_family(etat: Column) -> Column:
    """neuf, occasion or null, of any label."""
    x = F.lower(F.coalesce(etat, F.lit("")))
    return F.when(x.rlike("occas|usag|used|pre.?owned|d[ée]mo"), "occasion").when(x.rlike("neuf|new"), "neuf")


# URL and name signals of each vehicle type, tried in order.
VEHICLE_URLS = [
    ("velo-electrique", "/velos?-electriques?"),
    ("3-roues", "/moto-trois-roues|/three-wheel"),
    ("moto", "/motocyclette|/motorcycle|/motocyclettes-"),
    ("vtt", "/vtt[/-]|/atv[/-]"),
    ("cote-a-cote", "/cotes?-a-cotes?|/side-by-side"),
    ("motoneige", "/motoneige|/snowmobile"),
    ("motomarine", "/motomarine|/watercraft"),
    ("ponton", "/ponton|/pontoon"),
    ("bateau", "/bateau|/boat"),
    ("moteur-hors-bord", "/moteur-hors-bord|/outboard"),
    ("equipement", "/equipement-mecanique|/produits-mecaniques|/power-equipment"),
    ("remorque", "/remorque|/trailer"),
    ("vtt", "/argo/"),
]
VEHICLE_NAMES = [
    ("vtt", r"\bargo\b"),
    ("moto", r"\b(?:ninja|z900|versys|klx|klr|vulcan|kx[0-9]|scrambler|duke|ibex|street|bonneville)\b"),
    ("vtt", r"\b(?:brute force|cforce|kfx|outlander|kingquad)\b"),
    ("cote-a-cote", r"\b(?:teryx|mule|uforce|zforce|maverick|ranger|rzr|defender|ridge)\b"),
    ("motomarine", r"\b(?:jet ski|ultra 310)\b"),
]


def vehicle_type(url: Column, name: Column) -> Column:
    u, n = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    rules = [(kind, u.rlike(p)) for kind, p in VEHICLE_URLS] + [(kind, n.rlike(p)) for kind, p in VEHICLE_NAMES]
    out = F.lit("autre")
    for kind, test in reversed(rules):
        out = F.when(test, kind).otherwise(out)
    return out


def depreciated(age: Column, phases: str = "powersport") -> Column:
    """Share of the price that is left after so many years, phase by phase."""
    out, before = F.lit(1.0), 0
    for until, rate in DEPRECIATION[phases]:
        out = out * F.pow(F.lit(1 - rate), F.greatest(F.lit(0), F.least(age, F.lit(until)) - before))
        before = until
    return out
