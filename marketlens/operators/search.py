"""Product search: parsed queries, scores of listings, per-source top-k, strict hits before relaxed ones, and greedy coverage of sources."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import year_in_text
from .kept import kept
from .resolve import fuzzy_contains


@dataclass(frozen=True)
class Query:
    """``words`` are the model's, ``keywords`` the rest. A query is ``generic`` when nothing says it asks for a vehicle."""

    words: tuple[str, ...] = field(default=())
    brand: str | None = None
    year: int | None = None
    max_price: float | None = None
    state: str | None = None
    years: tuple[int, int] | None = None
    min_price: float | None = None
    color: str | None = None
    kind: str | None = None
    keywords: tuple[str, ...] = field(default=())
    sku: str | None = None
    generic: bool = False

    @property
    def precise(self) -> bool:
        """Two to four tokens, numbers and letters among them: all must be there, since part of them names another model."""
        parts = tokens(self.words)
        return 2 <= len(parts) <= 4 and any(p.isdigit() for p in parts) and any(not p.isdigit() for p in parts)


# Points of brand, year (equal, one off, within a range), model words, price, colour, state and keywords; what a price over 1.1 times the
# limit and another state leave of the points before them.
BRAND, YEAR, NEAR_YEAR, IN_YEARS, WORDS, PRICE, COLOR, STATE, KEYWORDS = 0.3, 0.2, 0.1, 0.15, 0.3, 0.1, 0.05, 0.05, 0.05
OVER, OVER_LEAVES, OTHER_STATE_LEAVES = 1.1, 0.5, 0.7
# What an approximate pass gives for a year further off (alone, or beyond a range) and for part of a precise model, what a missing brand
# leaves, and the part of the strict threshold that it asks.
FAR_YEAR, FAR_STEP, FAR_RANGE_STEP, PART_WORDS, NO_BRAND, RELAXED = 0.05, 0.005, 0.01, 0.15, 0.5, 0.5
# Points of a generic product, and its own limit.
SKU, SKU_IN_TEXT, G_BRAND, G_WORDS, G_CATEGORY, G_OVER = 0.5, 0.3, 0.2, 0.4, 0.1, 1.2


def points(test: Column, weight: float) -> Column:
    return F.when(test, F.lit(weight)).otherwise(F.lit(0.0))


def tokens(words: Iterable[str]) -> list[str]:
    """Runs of letters and of digits."""
    return [t for w in words for t in re.findall(r"[^\W\d_]+|\d+", w.lower())]


def found(text: Column, word: str, typos: bool = False) -> Column:
    """A number stands alone among digits, other words anywhere; with ``typos`` words of four letters or more may differ a little."""
    if word.isdigit():
        return text.rlike(rf"(?<!\d){word}(?!\d)")
    there = F.contains(text, F.lit(word))
    return there | fuzzy_contains(F.lit(word), text) if typos and len(word) >= 4 else there


def shared(text: Column, words: list[str], typos: bool) -> Column:
    """The part of the words that the text has."""
    return sum((points(found(text, w, typos), 1.0) for w in words), F.lit(0.0)) / len(words)


def by_price(total: Column, q: Query, weight: float, over: float) -> Column:
    if not (q.min_price or q.max_price):
        return total
    low, high = F.lit(q.min_price or 0.0), F.lit(q.max_price or float("inf"))
    cut = F.when(F.col("prix") > q.max_price * over, total * OVER_LEAVES).otherwise(total) if q.max_price else total
    return F.when(F.col("prix").between(low, high), total + weight).otherwise(cut)


def score(q: Query, approximate: bool = False, typos: bool = False) -> Column:
    """0 to 1. A brand that isn't there, a year out of reach or a precise model that is there in part rule a listing out; in an approximate pass they cost points.

    Points add up in order (brand, year, model, price, colour, state, keywords); a price over the limit and another state cut what has come before them.
    """
    if q.generic:
        return generic_score(q, approximate, typos)
    text = F.lower(F.concat_ws(" ", "name", "modele", "marque"))
    total, out, last = F.lit(0.0), F.lit(False), F.lit(1.0)
    if q.brand:
        has = F.coalesce(F.lower("marque") == q.brand, F.lit(False)) | F.coalesce(found(F.lower("name"), q.brand, typos), F.lit(False))
        total += points(has, BRAND)
        out, last = ~has, F.when(has, 1.0).otherwise(NO_BRAND)
    year = F.coalesce("annee", year_in_text(F.col("name")))
    if q.year:
        gap = F.abs(year - q.year)
        far = F.greatest(F.lit(0.0), FAR_YEAR - (gap - 2) * FAR_STEP) if approximate else F.lit(0.0)
        total += F.when(gap.isNull(), 0.0).when(gap == 0, YEAR).when(gap == 1, NEAR_YEAR).otherwise(far)
        out = out | F.coalesce(gap > 1, F.lit(False))
    elif q.years:
        gap = F.greatest(q.years[0] - year, year - q.years[1], F.lit(0))
        far = F.greatest(F.lit(0.0), FAR_YEAR - gap * FAR_RANGE_STEP) if approximate else F.lit(0.0)
        total += F.when(year.isNull(), 0.0).when(gap == 0, IN_YEARS).otherwise(far)
        out = out | F.coalesce((gap > 0) & year.isNotNull(), F.lit(False))
    if q.words:
        share = shared(text, tokens(q.words), typos)
        if q.precise:
            total += F.when(share == 1, WORDS).otherwise(share * PART_WORDS)
            out = out | (share < 1)
        else:
            total += share * WORDS
            out = out if q.brand else out | (share == 0)
    total = by_price(total, q, PRICE, OVER)
    if q.color:
        total += points(found(text, q.color, typos), COLOR)
    if q.state:
        total = F.when(F.coalesce(F.col("etat"), F.lit("")) == "", total).when(F.lower("etat") == q.state, total + STATE).otherwise(total * OTHER_STATE_LEAVES)
    if q.keywords:
        total += shared(text, [w.lower() for w in q.keywords], False) * KEYWORDS
    total = F.least(F.lit(1.0), total)
    return total * last if approximate else F.when(out, 0.0).otherwise(total)


def generic_score(q: Query, approximate: bool = False, typos: bool = False) -> Column:
    """0 to 1 for products that are no vehicles: article number, brand, words, category, price, state. Only a precise model that is there in part rules out."""
    text = F.lower(F.concat_ws(" ", "name", "category", "marque", "sku"))
    # letters and digits that touch are apart, as the query's are
    apart = F.regexp_replace(F.regexp_replace(text, r"([a-z])([0-9])", "$1 $2"), r"([0-9])([a-z])", "$1 $2")
    total, out = F.lit(0.0), F.lit(False)
    if q.sku:
        total += F.when(F.lower("sku") == q.sku.lower(), SKU).when(F.contains(text, F.lit(q.sku.lower())), SKU_IN_TEXT).otherwise(0.0)
    if q.brand:
        total += points(F.coalesce(F.lower("marque") == q.brand, F.lit(False)) | F.coalesce(found(F.lower("name"), q.brand, typos), F.lit(False)), G_BRAND)
    words = tokens((*q.words, *q.keywords))
    if words:
        share = shared(apart, words, typos)
        total += share * G_WORDS
        out = share < 1 if q.precise and not approximate else out
    if q.kind:
        total += points(F.contains(F.lower("category"), F.lit(q.kind.lower())), G_CATEGORY)
    total = by_price(total, q, PRICE, G_OVER)
    if q.state:
        total += points(F.lower("etat") == q.state, STATE)
    return F.when(out, 0.0).otherwise(F.least(F.lit(1.0), total))


def strict_or_relaxed(rows: DataFrame, q: Query, least: float = 0.4) -> DataFrame:
    """Strict hits of the sources that have any; of the others the approximate ones, at half the threshold. Adds score and is_approximate."""
    both = rows.withColumns({"strict": F.round(score(q), 6), "loose": F.round(score(q, True), 6)})
    # a flag for each source, found by grouping: a source with a third of all offers is no single task
    own = both.join(both.groupBy("site").agg((F.max((F.col("strict") >= least).cast("int")) == 1).alias("any_strict")), "site")
    kept = own.where(F.when(F.col("any_strict"), F.col("strict") >= least).otherwise(F.col("loose") >= least * RELAXED))
    return kept.withColumns({"score": F.when(F.col("any_strict"), F.col("strict")).otherwise(F.col("loose")), "is_approximate": ~F.col("any_strict")}).drop("strict", "loose", "any_strict")


AMOUNT = r"\$?\s*(\d[\d ,]*(?:\.\d+)?)\s*(k)?\b\s*\$?"
NEAR_BRAND = 0.86
# Words that a model name doesn't take.
FILLERS = "de du le la les the and et or ou with avec for pour".split()


def amount(digits: str, thousands: str | None) -> float:
    return float(re.sub(r"[ ,]", "", digits)) * (1000 if thousands else 1)


def parse(text: str, brands: Iterable[str], as_of: int = 2025, kinds: dict[str, str] | None = None, colors: Iterable[str] = ()) -> Query:
    """A free-text query: years, prices, kind, state, colour and brand (also one mistyped a little) are taken out one after another.

    Of what is left, tokens that look like a model's (numbers, capitals, up to four letters; five at most) are ``words``, the others ``keywords``.
    A query without kind, known brand and year is ``generic``. An empty text gives an empty query.
    """
    rest = " ".join(text.split())
    if not rest:
        return Query()

    def take(pattern: str) -> re.Match | None:
        nonlocal rest
        m = re.search(pattern, rest, re.IGNORECASE)
        if m:
            rest = f"{rest[: m.start()]} {rest[m.end() :]}"
        return m

    def take_first(terms: Iterable[str]) -> str | None:
        return next((t for t in sorted(terms, key=lambda t: (-len(t), t)) if take(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])")), None)

    low = high = None
    if m := take(rf"(?:entre|between)\s+{AMOUNT}\s*(?:et|and|-)\s*{AMOUNT}"):
        low, high = sorted((amount(m[1], m[2]), amount(m[3], m[4])))
    else:
        if m := take(rf"(?:(?<!\w)(?:moins de|max|under|sous)|<)\s*{AMOUNT}"):
            high = amount(m[1], m[2])
        if m := take(rf"(?:(?<!\w)(?:plus de|min|over|à partir de)|>)\s*{AMOUNT}"):
            low = amount(m[1], m[2])
    # years come after prices that a word announces, and before bare ones
    known = [int(y) for y in re.findall(r"\b((?:19|20)\d{2})\b", rest) if 1970 <= int(y) <= as_of + 1]
    years = (min(known), max(known)) if len(set(known)) > 1 else None
    take(r"\b(?:19|20)\d{2}\s*(?:-|–|à|to)\s*(?:19|20)\d{2}\b")
    for y in set(known):
        take(rf"\b{y}\b")
    if low is None and high is None and (m := re.search(r"(\d{1,3}(?:[ ,]\d{3})+|\d+)\s*(k)?\s*\$", rest)) and amount(m[1], m[2]) >= 100:
        take(re.escape(m[0]))
        high = amount(m[1], m[2])
    kind = take_first(kinds or {})
    state = "neuf" if take(r"\b(?:neuf|neuve|new)\b") else "occasion" if take(r"\b(?:occasion|usag[ée]e?|used)\b") else None
    color = take_first(colors)
    brands = list(brands)
    brand = take_first(brands)
    if brand is None:
        near = [(SequenceMatcher(None, w.lower(), b).ratio(), len(w), b, w) for w in re.findall(r"[^\W\d_]\w+", rest) if len(w) >= 4 for b in brands if abs(len(b) - len(w)) <= 3]
        best = max(near, default=(0.0, 0, "", ""))
        if best[0] >= NEAR_BRAND:
            brand = best[2]
            take(rf"\b{re.escape(best[3])}\b")
    left = [w for w in re.sub(r"[,;:]", " ", rest).split() if w.lower() not in FILLERS]
    modelish = [w for w in left if any(c.isdigit() for c in w) or w[0].isupper() or len(w) <= 4]
    others = [w for w in left if w not in modelish]
    words, keywords = (tuple(w.lower() for w in part) for part in (modelish[:5], modelish[5:] + others))
    one = known[0] if known and years is None else None
    return Query(words, brand, one, high, state, years, low, color, (kinds or {}).get(kind) if kind else None, keywords, generic=not (kind or brand or known))


def federated(rows: DataFrame, q: Query, least: float = 0.4, per_source: int = 3, limit: int = 50) -> DataFrame:
    """The best of each source, then of all; the per-source cut comes before the global order, so little of each source moves."""
    top = Window.partitionBy("site").orderBy(F.desc("score"), "ord", "unit_key")
    hits = rows.withColumn("score", F.round(score(q), 6)).where(F.col("score") >= least)
    return hits.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= per_source).drop("_at").orderBy(F.desc("score"), "unit_key").limit(limit)


#: Sources whose gains are found out at once, and that the driver takes over at once.
BATCH, PAGE = 32, 1024
RUN_BITS = 15


def greedy_coverage(pairs: DataFrame, who: str, what: str, k: int) -> DataFrame:
    """k sources that one after another add most items (whole numbers) not yet covered (ties: the smaller).

    What a source has is lists of places in runs of ``2 ** RUN_BITS`` items, made in one pass over the pairs, so it takes as much room as its items however far apart
    they lie. A gain can only fall, so an old one is a bound: only the sources with the largest bounds are counted again, until the first of them is up to
    date. The driver holds the bounds of the sources looked at, which come in order of their number of items.
    """
    spark = pairs.sparkSession
    item = F.col(what).cast("long")
    run, place = F.shiftright(item, RUN_BITS), F.pmod(item, F.lit(1 << RUN_BITS)).cast("int")
    lists = kept(pairs.where(item.isNotNull() & F.col(who).isNotNull()).groupBy(F.col(who).cast("long").alias("who"), run.alias("run")).agg(F.collect_set(place).alias("items")))
    ordered = kept(lists.groupBy("who").agg(F.sum(F.size("items")).alias("n")).orderBy(F.desc("n"), "who"))
    rest = ordered.toLocalIterator()
    covered, chosen, bounds = spark.createDataFrame([], "run long, had array<int>"), [], []
    ahead = next(rest, None)
    for step in range(1, k + 1):
        while True:
            while ahead is not None and (not bounds or ahead.n >= -bounds[0][0]):
                for _ in range(PAGE):
                    if ahead is None:
                        break
                    heapq.heappush(bounds, (-ahead.n, ahead.who, 1))
                    ahead = next(rest, None)
            if not bounds or bounds[0][2] == step:
                break
            stale = [heapq.heappop(bounds)[1] for _ in range(min(BATCH, len(bounds))) if bounds[0][2] < step]
            met = lists.where(F.col("who").isin(stale)).join(covered, "run", "left")
            fresh = F.size(F.array_except("items", F.coalesce("had", F.array().cast("array<int>"))))
            for r in met.groupBy("who").agg(F.sum(fresh).alias("n")).collect():
                heapq.heappush(bounds, (-r.n, r.who, step))
        if not bounds or not bounds[0][0]:
            break
        gain, source, _ = heapq.heappop(bounds)
        chosen.append((step, source, -gain))
        own = lists.where(F.col("who") == source).select("run", F.col("items").alias("had"))
        covered = kept(covered.unionByName(own).groupBy("run").agg(F.array_distinct(F.flatten(F.collect_list("had"))).alias("had")))
    return spark.createDataFrame(chosen, f"step int, {who} long, gain long")


def completions(names: DataFrame, most: int = 20) -> DataFrame:
    """(prefix, completion): for every prefix of up to ``most`` letters, in lower case, the shortest name (name, first_seen) that goes on after it, then the first seen.

    One aggregation with a map side, so a prefix that very many names have is combined before it is shuffled; the result is an index to look up.
    """
    own = names.where("name <> ''").groupBy("name").agg(F.min("first_seen").alias("first_seen")).withColumn("n", F.length("name"))
    every = own.where("n > 1").select("name", "n", "first_seen", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("n") - 1))).alias("k"))
    best = every.groupBy(F.lower(F.substring("name", F.lit(1), F.col("k"))).alias("prefix")).agg(F.min(F.struct("n", "first_seen", "name")).alias("x"))
    return best.select("prefix", F.col("x.name").alias("completion"))
