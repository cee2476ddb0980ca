"""Column expressions over names, models and titles. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import ACCENTS, AT, AVAILABILITY, BRAND_ALIASES, BRANDS, CANONICAL_BRANDS, CATEGORIES, COLORS, DEALER_WORDS, KINDS_IN_FRONT, OFFERED, ORDINALS, POWERSPORT_WORDS, PREORDERS, SHOP_WORDS, STATES, TITLE_NOISE, TRIMS, VEHICLE_WORDS

DASHES = "\\-–—"


def mapping(of: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in of.items() for x in pair))


def squeezed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_accents(x: Column) -> Column:
    """Of lower-case Latin text."""
    return F.translate(x, *ACCENTS)


def deep_normalize(x: Column) -> Column:
    """Lower case without accents and punctuation; a space between letters and digits; runs of single letters as one word."""
    x = strip_accents(F.lower(F.trim(F.coalesce(x, F.lit("")))))
    x = F.regexp_replace(x, r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    x = F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))
    return F.regexp_replace(x, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def without_words(x: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(F.split(x, " "), lambda w: ~w.isin(words)), " ")


def remove_colors(x: Column) -> Column:
    """The deep-normalised text without colour words."""
    return without_words(deep_normalize(x), COLORS)


def strip_trims(model: Column) -> Column:
    """A normalised model without trim words."""
    return squeezed(F.regexp_replace(model, r"(?i)\b(?:" + "|".join(TRIMS) + r")\b", ""))


def model_core(model: Column) -> Column:
    """A model up to its first number, or its first word."""
    upto = F.regexp_extract(model, r"^(.*?\b[0-9]+)\b", 1)
    return F.when(upto != "", squeezed(upto)).otherwise(F.split(model, " ")[0])


def one_of(phrases: list[str], space: str = " ", hyphen: str = "-") -> str:
    """A pattern for any of the phrases; ``space`` and ``hyphen`` say what may stand for theirs."""
    return "(?:" + "|".join(p.replace(" ", space).replace("-", hyphen) for p in phrases) + ")"


def status_tags(phrases: list[str] = AVAILABILITY) -> str:
    return r"(?i)\b" + one_of(phrases, r"\s+", r"[\s-]?") + r"\b"


def clean_name(name: Column) -> Column:
    """A product name without availability tags and the separators they leave."""
    x = F.regexp_replace(name, status_tags(), "")
    x = F.regexp_replace(x, rf"^[\s{DASHES}]+|[\s{DASHES}]+$", "")
    x = F.regexp_replace(x, rf"\s[{DASHES}]\s", " ")
    return F.trim(F.regexp_replace(x, r"\s{2,}", " "))


def product_name_key(name: Column) -> Column:
    """Lower case, odd spaces as spaces, quotes gone."""
    x = F.regexp_replace(F.lower(name), "[ ​‌‍﻿]", " ")
    return squeezed(F.regexp_replace(x, "[\"'“”‘’«»]", ""))


def title_words(x: Column) -> Column:
    """Each word with a capital after anything but a letter."""
    parts = F.split(F.lower(x), r"(?<![a-zà-ÿ])(?=[a-zà-ÿ])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def canonical_brand(raw: Column) -> Column:
    return F.when(F.trim(raw) != "", F.coalesce(mapping(CANONICAL_BRANDS)[F.lower(F.trim(raw))], title_words(F.trim(raw))))


def canonical_category(raw: Column) -> Column:
    key = F.lower(F.trim(raw))
    return F.when(key != "", F.coalesce(mapping(CATEGORIES)[key], key))


def identifier(value: Column) -> Column:
    """A product identifier without spaces and dashes, in capitals; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(value, r"[\s-]", "")), F.lit(""))


def title_key(title: Column) -> Column:
    """A title in lower case without prices, signs and filler words."""
    x = strip_accents(F.lower(title))
    x = F.regexp_replace(F.regexp_replace(x, r"\$[0-9,]+\.?[0-9]*", ""), r"[^a-z0-9_\s\-.]", " ")
    return without_words(squeezed(x), TITLE_NOISE)


def let(x: Column, of: Callable[[Column], Column]) -> Column:
    """A function of a column that names it more than once, without a copy of its expression for each."""
    return F.get(F.transform(F.array(x), of), 0)


def brand_in(text: Column) -> Column:
    """The first known brand, longest first, that the normalised text contains."""
    known = F.array(*(F.lit(b) for b in sorted(BRANDS, key=lambda b: (len(b), b), reverse=True)))
    return F.get(F.filter(known, lambda b: F.contains(text, b)), 0)


def aliased_brand(brand: Column) -> Column:
    return F.coalesce(mapping(BRAND_ALIASES)[brand], brand)


def fixed_mojibake(x: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text as it is."""
    # a lead byte of two, or the first two of three, as Latin-1 shows them
    broken = x.rlike("[ÂÃ][\u0080-¿]|â[\u0080-¿]{2}") & ~x.rlike("[^\u0000-ÿ]")
    return F.when(broken, F.coalesce(F.try_validate_utf8(F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")), x)).otherwise(x)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(F.lower(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def phrase(words: Column, at: Column | int, n: int) -> Column:
    """n words from a place, counted from 0, as one text."""
    return F.array_join(F.slice(words, F.lit(at) + 1, n), " ")


def sized(phrases: list[str]) -> dict[int, list[str]]:
    """The phrases by their number of words, most first."""
    return {n: [p for p in phrases if len(p.split()) == n] for n in sorted({len(p.split()) for p in phrases}, reverse=True)}


def before_offer(words: Column) -> Column:
    """The words before the first that begins an offer (some phrase, then where) or names a dealer's place."""

    def begins(word: Column, at: Column) -> Column:
        test = word.isin(DEALER_WORDS)
        for n, phrases in sized(OFFERED).items():
            test |= phrase(words, at, n).isin(phrases) & F.coalesce(F.get(words, at + n).isin(AT), F.lit(False))
        return test

    first = F.array_min(F.filter(F.transform(words, lambda word, at: F.when(begins(word, at), at)), lambda at: at.isNotNull()))
    return F.when(first.isNull(), words).otherwise(F.slice(words, F.lit(1), first))


def without_dealer(words: Column) -> Column:
    """Without two words at the end that make a dealer's name, as one of them says: what it sells, behind or in front, or that it is a shop."""
    for place, kinds in ((1, POWERSPORT_WORDS), (2, VEHICLE_WORDS), (1, SHOP_WORDS)):
        words = let(words, lambda w: F.when((F.size(w) >= 2) & F.get(w, F.size(w) - place).isin(kinds), F.slice(w, F.lit(1), F.size(w) - 2)).otherwise(w))
    return words


def without_kinds(words: Column) -> Column:
    """Without kinds of vehicle in front of something, at most one of each group in their order."""

    def rest(w: Column, group: list[str]) -> Column:
        return F.coalesce(*(F.when((F.size(w) > n) & phrase(w, 0, n).isin(phrases), F.slice(w, F.lit(n + 1), F.size(w))) for n, phrases in sized(group).items()), w)

    for group in KINDS_IN_FRONT:
        words = let(words, lambda w: rest(w, group))
    return words


def without_preorders(words: Column) -> Column:
    alone, ends = [p for p in PREORDERS if " " not in p], [p.split()[1] for p in PREORDERS if " " in p]
    is_pre, is_end = (lambda x: F.coalesce(x == "pre", F.lit(False))), (lambda x: F.coalesce(x.isin(ends), F.lit(False)))
    return F.filter(words, lambda x, at: ~(x.isin(alone) | is_pre(x) & is_end(F.get(words, at + 1)) | is_end(x) & is_pre(F.get(words, at - 1))))


def with_anniversaries(words: Column) -> Column:
    """A number, its ending and any form of anniversary as the number and one form."""
    is_form, is_number = (lambda x: F.coalesce((x == "anniv") | F.startswith(x, F.lit("annivers")), F.lit(False))), (lambda x: F.coalesce(x.try_cast("decimal(38,0)").isNotNull(), F.lit(False)))
    is_ending = lambda x: F.coalesce(x.isin(ORDINALS), F.lit(False))
    formed = F.transform(words, lambda x, at: F.when(is_form(x) & is_ending(F.get(words, at - 1)) & is_number(F.get(words, at - 2)), F.lit("anniversaire")).otherwise(x))
    return let(formed, lambda w: F.filter(w, lambda x, at: ~(is_ending(x) & is_form(F.get(w, at + 1)) & is_number(F.get(w, at - 1)))))


def cleaned_model(model: Column, colors: bool = True) -> Column:
    """A normalised model without offers, dealers, kinds of vehicle in front, states, pre-orders and (unless told) colours."""
    words = let(F.filter(F.split(model, " "), lambda x: x != ""), before_offer)
    words = let(without_kinds(without_dealer(words)), lambda w: F.filter(w, lambda x: ~x.isin(STATES)))
    words = let(words, without_preorders)
    if colors:
        words = let(words, lambda w: F.filter(w, lambda x: ~x.isin(COLORS)))
    return F.array_join(let(words, with_anniversaries), " ")


def product_key(marque: Column, modele: Column, name: Column, colors: bool = True) -> tuple[Column, Column]:
    """Brand and model of a listing, each from its name where the field is empty: the first known brand there, and the rest without it and the year.

    Where the name holds no known brand, the brand of the field is taken off its beginning or end.
    """
    brand = deep_normalize(F.regexp_replace(marque, r"(?i)^(?:manufacturier|fabricant|marque|brand)\s*:\s*", ""))
    model = deep_normalize(F.regexp_replace(modele, r"(?i)^(?:mod[èe]le|model)\s*:\s*", ""))
    year = r"\b(?:19|20)[0-9]{2}\b"

    def named(x: Column) -> Column:
        found = F.coalesce(brand_in(x["full"]), F.lit(""))
        return F.struct(x["brand"].alias("brand"), x["model"].alias("model"), x["full"].alias("full"), found.alias("found"), squeezed(F.regexp_replace(x["full"], year, "")).alias("plain"))

    def parted(x: Column) -> Column:
        brand, plain, found = x["brand"], x["plain"], x["found"]
        ahead, behind = F.concat(brand, F.lit(" ")), F.concat(F.lit(" "), brand)
        alone = F.when((brand != "") & F.startswith(plain, ahead), F.substr(plain, F.length(ahead) + 1)).when((brand != "") & F.endswith(plain, behind), F.substr(plain, F.lit(1), F.length(plain) - F.length(behind))).otherwise(plain)
        rest = F.when(found != "", squeezed(F.regexp_replace(F.replace(x["full"], found, F.lit(" ")), year, ""))).otherwise(alone)
        return F.struct(F.when(brand != "", brand).otherwise(found).alias("brand"), F.when(x["model"] != "", x["model"]).otherwise(rest).alias("model"))

    key = let(let(F.struct(brand.alias("brand"), model.alias("model"), deep_normalize(name).alias("full")), named), parted)
    return aliased_brand(key["brand"]), cleaned_model(key["model"], colors)


def model_tokens(model: Column) -> Column:
    """A model's runs of letters and of digits, as written."""
    return F.regexp_extract_all(F.coalesce(model, F.lit("")), F.lit("([A-Za-z]+|[0-9]+)"))


def precise_model(model: Column) -> Column:
    """Whether a model is two to four tokens of which a number and a word both tell it from others, so that a match needs all of them."""
    return let(model_tokens(model), lambda x: F.size(x).between(2, 4) & F.exists(x, lambda w: w.rlike("^[0-9]+$")) & F.exists(x, lambda w: w.rlike("^[A-Za-z]+$")))
