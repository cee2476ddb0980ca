"""Scores of search hits as users see them, addresses that are no product's, configured competitors, and which pricing strategy holds for a kind of vehicle."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, squeezed, strip_accents
from .contents import by_content
from .selection import percentiles

# Weights of the parts of a score, what stands for a part that can't be told, points lost by a year, kilometres to a point, a new vehicle's
# kilometres, the part of a query's words that must be there, the score and the distance below the median of a deal.
WEIGHTS = {"text": 0.35, "year": 0.20, "mileage": 0.15, "price": 0.15, "variant": 0.15}
UNKNOWN, NO_YEAR, YEAR_STEP, KM_STEP, NEW_KM, MOST_WORDS, DEAL_SCORE, DEAL_BELOW = 50, 30, 15, 500, 500, 0.6, 70, -0.08
# Wheels by their names and sizes.
WHEELS = {"grande roue": (r"19\s*/?\s*16", "grande roue"), "petite roue": (r"17\s*/?\s*14", "petite roue")}


@dataclass(frozen=True)
class Asked:
    """A parsed query: its words, year, kilometres, whether it asks for used vehicles, and hints of a variant."""

    text: str = ""
    year: int | None = None
    mileage: int | None = None
    used: bool = False
    variants: tuple[str, ...] = field(default=())


def plain(x: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[-_]+", " ", flat).split())


def plain_column(x: Column) -> Column:
    return squeezed(F.regexp_replace(strip_accents(F.lower(F.coalesce(x, F.lit("")))), "[-_]+", " "))


def clamped(x: Column) -> Column:
    """Rounded half up, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5))).cast("long")


def words_match(asked: Asked, text: Column) -> Column:
    """Whether enough of a query's words stand in a text: all if it is short and has a number, else most. A number must stand alone, a word may be within others or across spaces."""
    words = [w for w in re.findall(r"[a-z]+|\d+", plain(asked.text)) if len(w) >= 2]
    if not words:
        return F.lit(True)
    tight = F.replace(text, F.lit(" "), F.lit(""))
    hit = lambda w: text.rlike(rf"(^|[^0-9]){w}([^0-9]|$)") if w.isdigit() else F.contains(text, F.lit(w)) | F.contains(tight, F.lit(w))
    found = sum((F.when(hit(w), 1).otherwise(0) for w in words), F.lit(0))
    whole = any(w.isdigit() for w in words) and len(words) <= 4
    return found >= (1 if whole else MOST_WORDS) * len(words)


def year_score(asked: Asked, year: Column) -> Column:
    if not asked.year:
        return F.lit(UNKNOWN)
    return F.when(year.isNull(), NO_YEAR).otherwise(clamped(100 - F.abs(asked.year - year) * YEAR_STEP))


def mileage_score(asked: Asked, km: Column, state: Column) -> Column:
    if asked.mileage is None:
        return F.lit(UNKNOWN)
    low = asked.mileage < NEW_KM
    return F.when(plain_column(state).isin("neuf", "new"), 100 if low else 60).when(km.isNull(), 90 if low else 60).otherwise(clamped(100 - F.abs(asked.mileage - km) / KM_STEP))


def variant_score(asked: Asked, text: Column) -> Column:
    """The part of the hints that a name has, as written, without spaces, or as a wheel's sizes."""
    if not asked.variants:
        return F.lit(UNKNOWN)
    tight = F.replace(text, F.lit(" "), F.lit(""))
    found = F.lit(0)
    for hint in map(plain, asked.variants):
        test = F.contains(text, F.lit(hint)) | F.contains(tight, F.lit(hint.replace(" ", "")))
        for form in WHEELS.get(hint, ()):
            test |= text.rlike(form)
        found += F.when(test, 1).otherwise(0)
    return clamped(found / len(asked.variants) * 100)


def scored_hits(rows: DataFrame, asked: Asked, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Rows (name, marque, modele, annee, kilometrage, etat, prix, score, is_approximate) that match the query's words or are approximate, with eval_score, is_deal and price_vs_median.

    Weights of the parts that count are renormalised: the price never counts, kilometres do if a used vehicle with kilometres is asked for.
    """
    own = {"_name": F.col("name"), "_marque": F.col("marque"), "_modele": F.col("modele")}
    text = plain_column(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in own)))
    # a text is made plain once, and what is looked for in it is found once for all rows that have it
    read = lambda contents: contents.withColumns({"_words": let(text, lambda x: words_match(asked, x)), "_variant": let(plain_column(F.col("_name")), lambda x: variant_score(asked, x))})
    kept = by_content(rows, own, read, ["_words", "_variant"]).where(F.coalesce("is_approximate", F.lit(False)) | F.col("_words"))
    use = {k: max(0.0, v) for k, v in weights.items() if k != "price" and (k != "mileage" or asked.used and asked.mileage is not None)}
    total = max(0.001, sum(use.values()))
    parts = {"text": clamped(F.coalesce("score", F.lit(0.0)) * 100), "year": year_score(asked, F.col("annee")), "mileage": mileage_score(asked, F.col("kilometrage"), F.col("etat")), "variant": F.col("_variant")}
    value = clamped(sum((parts[k] * (w / total) for k, w in use.items()), F.lit(0.0)))
    middle = percentiles(kept.where("prix > 0").select(F.lit(0).alias("all_hits"), "prix"), ["all_hits"], "prix", {"middle": 0.5}).where("n >= 2").select("middle")
    # one row or none
    met = kept.withColumn("eval_score", value).join(F.broadcast(middle), F.lit(True), "left")
    gap = F.when((F.col("prix") > 0) & (F.col("middle") > 0), F.col("prix") / F.col("middle") - 1)
    return met.withColumn("price_vs_median", F.coalesce(gap, F.lit(0.0))).withColumn("is_deal", (F.col("eval_score") >= DEAL_SCORE) & F.coalesce(gap <= DEAL_BELOW, F.lit(False))).drop("middle", "_words", "_variant")


# Parts of addresses that are no product's page, how such addresses end, and paths that are a site's front.
NO_PRODUCT = (
    "/blog/ /blogue/ /service/ /service-entretien/ /services/ /contact/ /nous-joindre/ /team/ /equipe/ /a-propos/ /about/ /sell-your- /vendez-votre- /parts/ /pieces/ "
    "/entretien-et-reparation /maintenance-and-repair /faq/ /aide/ /help/ /login/ /connexion/ /register/ /inscription/ /account/ /compte/ /cart/ /panier/ /checkout/ "
    "/politique/ /privacy/ /cgv/ /mentions-legales/ /search/ /recherche/ /carriere/ /careers/ /emploi/ /snowmobile-maintenance /atv-maintenance /motorcycle-maintenance "
    "/termes-et-conditions /terms-of-use /terms-and-conditions /politique-de-confidentialite /privacy-policy /financement/ /financing/ /promotion/local- /promotions/local-"
).split()
NO_PRODUCT_ENDS, FRONTS = ["/blog", "/promotions"], ["", "/fr", "/en"]


def no_product(url: Column) -> Column:
    """Whether an address is clearly no product's: by a part of it, its end, or as a site's front page."""
    low = F.lower(url)
    bare = F.rtrim(low, F.lit("/"))
    test = F.exists(F.array(*map(F.lit, NO_PRODUCT)), lambda part: F.contains(low, part))
    for end in NO_PRODUCT_ENDS:
        test |= F.endswith(bare, F.lit(end))
    path = F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return test | path.isin(FRONTS)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def configured_sites(config: DataFrame) -> DataFrame:
    """(user, domain, url, is_reference): each user's sites once a host, of config (user, reference_url, competitor_urls); the reference first, then competitors in their order."""
    every = F.concat(F.array("reference_url"), F.coalesce("competitor_urls", F.array().cast("array<string>")))
    rows = config.select("user", F.posexplode(every).alias("at", "url")).withColumn("domain", host(F.col("url"))).where("domain <> ''")
    first = rows.groupBy("user", "domain").agg(F.min(F.struct("at", "url")).alias("x"))
    return first.select("user", "domain", "x.url", (F.col("x.at") == 0).alias("is_reference"))


def rank_of_reference(retailers: DataFrame, reference: int) -> DataFrame:
    """(rank, n): the reference's place among the retailers (site, aggressivity), the least aggressive first; 1 where it isn't among them. Its place is one more than those before it, so nothing is sorted."""
    mark = retailers.where(F.col("site") == reference).select(F.col("aggressivity").alias("own"))
    met = retailers.join(F.broadcast(mark), F.lit(True), "left")
    before = (F.col("aggressivity") < F.col("own")) | (F.col("aggressivity") == F.col("own")) & (F.col("site") < reference)
    return met.agg((F.sum(F.when(before, 1).otherwise(0)) + 1).alias("rank"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).select(F.coalesce("rank", F.lit(1)).cast("long").alias("rank"), F.col("n").cast("long").alias("n"))


# Strategies that there are, and the one that holds where none is set.
STRATEGIES, DEFAULT = ("lowest_minus_amount", "market_average", "match_lowest"), ("lowest_minus_amount", 1.0)


def strategy(key: Column, amount: Column) -> Column:
    """(key, amount) of a rule as given: an unknown key is the default's, an amount counts for the first strategy alone and is never below 0."""
    known = F.when(key.isin(*STRATEGIES), key).otherwise(DEFAULT[0])
    finite = F.when(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")), DEFAULT[1]).otherwise(amount)
    return F.struct(known.alias("key"), F.when(known == DEFAULT[0], F.greatest(F.lit(0.0), finite)).alias("amount"))


def strategy_for(rules: Column, kind: Column, default_key: Column, default_amount: Column) -> Column:
    """The rule of a kind of vehicle in a map of (key, amount), if it has a key, else the default one."""
    own = F.try_element_at(rules, kind)
    return F.when(own["key"] != "", strategy(own["key"], own["amount"])).otherwise(strategy(default_key, default_amount))
