"""Variants (options and trims) named in an offer, by a table of aliases for each kind of vehicle. One pass or two over a text, no Python over rows."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hits import plain, plain_column

Variants = Mapping[str, tuple[list[str], float]]

# Variants with their aliases and premiums; those of any kind, then those of each. A space at an alias's end stands for a space in the text.
COMMON: Variants = {
    "eps": (["eps"], 500),
    "winch": (["treuil", "winch"], 600),
    "roof": (["toit", "roof"], 700),
    "windshield": (["pare brise", "pare-brise", "windshield"], 400),
    "tracks": (["chenilles", "track kit", "tracks"], 2500),
    "premium": (["premium", "le"], 200),
    "crew": (["crew"], 1500),
    "limited": (["limited", "ltd"], 1200),
    "turbo": (["turbo"], 2500),
    "xmr": (["xmr", "x mr"], 1000),
    "xt": (["xt"], 600),
    "xtp": (["xtp", "x tp"], 900),
}
QUADS: Variants = {"northstar": (["northstar", "north star"], 3000), "xp": (["xp"], 900), "ranger": (["ranger"], 0)}
KINDS: Mapping[str, Variants] = {
    "moto": {"grande-roue": (["grande roue", "19/16", "1916"], 300), "petite-roue": (["petite roue", "17/14", "1714"], 0), "factory": (["factory", "factory edition"], 1200), "heritage": (["heritage"], 500)},
    "vtt": {**COMMON, **QUADS},
    "sxs": {**COMMON, **QUADS, "defender": (["defender"], 0), "maverick": (["maverick"], 1500)},
    "motoneige": {"turbo": (["turbo"], 2500), "adrenaline": (["adrenaline"], 1200), "xrs": (["x-rs", "xrs", "x rs"], 1200), "summit": (["summit"], 0)},
    "nautique": COMMON,
}


def alias_pattern(alias: str) -> str:
    """Finds an alias in a normalised text with a space at both ends: as whole words, and with a space beside it where the alias asks for one."""
    front, back = alias.startswith(" "), alias.endswith(" ")
    if front or back:
        return ("(?<= )" if front else "") + re.escape(plain(alias)) + ("(?= )" if back else "")
    return rf"(?<![a-z0-9_]){re.escape(plain(alias))}(?![a-z0-9_])"


def passes(variants: Variants) -> list[list[tuple[str, str, str]]]:
    """(alias, its plain form, variant) in lists in which no form begins another, so that a place in a text has at most one hit of each list."""
    out: list[list[tuple[str, str, str]]] = []
    for key, (aliases, _) in variants.items():
        for alias in aliases:
            form = plain(alias)
            if not form or any(form == f and alias_pattern(alias) == alias_pattern(a) and key == k for group in out for a, f, k in group):
                continue
            free = next((g for g in out if not any(f.startswith(form) or form.startswith(f) for _, f, _ in g)), None)
            if free is None:
                out.append(free := [])
            free.append((alias, form, key))
    return out


def looked_up(words: Column, table: Mapping[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(words, lambda w: known[w])


def keys_of(text: Column, variants: Variants) -> Column:
    """The variants, in the table's order, of which an alias stands in a normalised text with a space at both ends."""
    hits = F.array().cast("array<string>")
    for group in passes(variants):
        pattern = "(?=(" + "|".join(alias_pattern(a) for a, _, _ in group) + "))"
        hits = F.concat(hits, looked_up(F.regexp_extract_all(text, F.lit(pattern), 1), {form: key for _, form, key in group}))
    return F.array_intersect(F.array(*map(F.lit, variants)), hits) if variants else hits


def variant_keys(kind: Column, *parts: Column, kinds: Mapping[str, Variants] = KINDS, other: Variants = COMMON) -> Column:
    """The variants that an offer's parts (name, address, site) name, by its kind's table; kinds without a table have ``other``. Null parts are empty."""
    text = F.concat(F.lit(" "), plain_column(F.concat_ws(" ", *parts)), F.lit(" "))
    out = keys_of(text, other)
    for name, table in kinds.items():
        out = F.when(kind == name, keys_of(text, table)).otherwise(out)
    return out


def premium(kind: Column, keys: Column, kinds: Mapping[str, Variants] = KINDS, other: Variants = COMMON) -> Column:
    """The summed premiums of variants of a kind."""
    price = lambda table: F.create_map(*(F.lit(x) for k, (_, p) in table.items() for x in (k, float(p))))
    prices = price(other)
    for name, table in kinds.items():
        prices = F.when(kind == name, price(table)).otherwise(prices)
    return F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.coalesce(F.try_element_at(prices, k), F.lit(0.0)))
