"""Which of many phrases a text holds, in one pass over the text; a taxonomy with aliases; shop platforms by their marks in a page. No Python over rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let


def found_in(text: Column, phrases: Iterable[str]) -> Column:
    """The distinct phrases that stand anywhere in a text, overlapping ones too: at each place the longest that begins there, and the phrases that it begins with.

    The phrases are a constant of the plan, so they should be a table of some hundreds.
    """
    known = sorted({p for p in phrases if p}, key=lambda p: (-len(p), p))
    if not known:
        return F.array().cast("array<string>")
    pattern = "(?=(" + "|".join(re.escape(p) for p in known) + "))"
    hits = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))
    begun = {p: [q for q in known if p.startswith(q)] for p in known}
    if several := {p: q for p, q in begun.items() if len(q) > 1}:
        more = F.create_map(*(x for p, q in several.items() for x in (F.lit(p), F.array(*map(F.lit, q)))))
        hits = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(more, h), F.array(h)))))
    return hits


def holds_word(text: Column, terms: Iterable[str]) -> Column:
    """Whether a normalised text holds one of the terms: one of several words anywhere, a single word as a word."""
    parts = [re.escape(t) if " " in t else rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])" for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t]
    return text.rlike("|".join(parts)) if parts else F.lit(False)


# --- taxonomy ----------------------------------------------------------------------------------------------------------------------------
Node = tuple[str, str, str | None, list[str]]
# Nodes of vehicles and what belongs to them (slug, name, parent, aliases); results depend on these words being as they are. Other branches are a parameter.
NODES: list[Node] = [
    ("vehicule", "Véhicule", None, ["véhicule", "vehicules", "véhicules"]),
    ("moto", "Moto", "vehicule", ["motocyclette", "motorcycle", "ktm", "yamaha", "kawasaki", "suzuki", "husqvarna", "ducati", "harley", "harley-davidson", "triumph", "aprilia", "indian", "royal enfield", "bmw moto"]),
    ("vtt", "VTT / Quad", "vehicule", ["atv", "quad", "polaris sportsman", "can-am outlander", "yamaha grizzly"]),
    ("motoneige", "Motoneige", "vehicule", ["snowmobile", "ski-doo", "skidoo", "polaris rmk", "arctic cat"]),
    ("nautique", "Nautique", "vehicule", ["bateau", "boat", "sea-doo", "seadoo", "yacht", "ponton"]),
    ("scooter-vehicule", "Scooter / Mobylette", "vehicule", ["scooter", "mobylette", "vespa", "piaggio"]),
    ("remorque", "Remorque", "vehicule", ["trailer", "remorque utilitaire", "remorque fermée"]),
    ("accessoire", "Accessoire", None, ["accessoires", "accessory", "gear", "équipement"]),
    ("accessoire-moto", "Accessoire moto", "accessoire", ["casque moto", "gants moto", "veste moto", "bottes moto", "intercom", "motorcycle jacket", "motorcycle gear", "riding jacket", "motorcycle gloves"]),
    ("accessoire-motoneige", "Accessoire motoneige", "accessoire", ["chenille", "manchon motoneige", "cabine motoneige", "snowmobile", "snowmobile jacket", "snowmobile gloves", "ski-doo jacket", "skidoo jacket"]),
    ("piece", "Pièce détachée", None, ["pieces", "parts", "pièce"]),
    ("piece-moto", "Pièce moto", "piece", ["filtre huile moto", "bougie", "chaîne moto", "pignon", "carburateur"]),
    ("piece-motoneige", "Pièce motoneige", "piece", ["courroie motoneige", "ski"]),
]
# Words too general to tell a category.
GENERAL = {"accessoire", "accessoires", "accessory", "piece", "pieces", "parts", "vehicule", "vehicle", "mode", "sport", "manteau", "jacket"}


def closure(spark: SparkSession, nodes: list[Node] = NODES) -> DataFrame:
    """(ancestor, slug, depth, path): every node under every one of its ancestors, itself with depth 0; path is the node's whole one."""
    rows = spark.createDataFrame([(s, p) for s, _, p, _ in nodes], "slug string, parent string")
    walk = "WITH RECURSIVE up AS (SELECT slug AS ancestor, slug, 0 AS depth FROM {nodes} UNION ALL SELECT n.parent, up.slug, up.depth + 1 FROM up JOIN {nodes} n ON n.slug = up.ancestor WHERE n.parent IS NOT NULL) SELECT * FROM up"
    every = spark.sql(walk, nodes=rows)
    path = every.groupBy("slug").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "ancestor")))), lambda x: x["ancestor"]), ".").alias("path"))
    return every.join(path, "slug")


def paths(nodes: list[Node]) -> dict[str, str]:
    above, out = {s: p for s, _, p, _ in nodes}, {}
    for slug in above:
        line, at = [], slug
        while at is not None:
            line.append(at)
            at = above.get(at)
        out[slug] = ".".join(reversed(line))
    return out


def category_of(text: Column, nodes: list[Node] = NODES) -> Column:
    """The path of the node, roots apart, whose longest alias, name or slug (hyphens also as spaces) stands in the text; of equals the first in order; null if none does."""
    path, best = paths(nodes), {}
    order = 0
    for slug, name, parent, aliases in nodes:
        for word in [*aliases, name.lower(), slug] if parent else []:
            order += 1
            for form in {word, word.replace("-", " ")}:
                best[form] = max(best.get(form, (0, 0, "")), (len(word), -order, path[slug]))
    ranks = F.create_map(*(x for form, (n, at, p) in best.items() for x in (F.lit(form), F.struct(F.lit(n).alias("n"), F.lit(at).alias("at"), F.lit(p).alias("path")))))
    return F.array_max(F.transform(found_in(F.lower(text), best), lambda h: ranks[h]))["path"]


def terms_of(nodes: list[Node], slug: str) -> list[str]:
    """A node's name, slug and aliases, normalised, without general words."""
    import unicodedata

    plain = lambda x: " ".join(re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFD", x.lower()).encode("ascii", "ignore").decode()).split())
    own = next((n for n in nodes if n[0] == slug), None)
    return [] if own is None else [t for t in dict.fromkeys(plain(x) for x in (own[1], slug.replace("-", " "), *own[3])) if t and t not in GENERAL]


def fits(text: Column, path: str, identity: Column, nodes: list[Node] = NODES) -> Column:
    """Whether a product of normalised text may belong to a category: its own terms, or an identity with what is asked for, outweigh everything; a sibling's terms veto; else it may.

    Roots and unknown nodes let everything pass.
    """
    slug = path.rpartition(".")[2]
    parent = next((p for s, _, p, _ in nodes if s == slug), None)
    if "." not in path or slug not in paths(nodes):
        return F.lit(True)
    siblings = [t for s, _, p, _ in nodes if p == parent and s != slug for t in terms_of(nodes, s)]
    return holds_word(text, terms_of(nodes, slug)) | F.coalesce(identity, F.lit(False)) | ~holds_word(text, siblings)


# --- shop platforms ----------------------------------------------------------------------------------------------------------------------
#: (platform, marks in a page, generators that it names, beginnings of cookies, marks in a page or its address)
Platform = tuple[str, list[str], list[str], list[str], list[str]]
# What tells platforms of shops, the first of equally likely ones first. A mark that is named twice counts twice.
PLATFORMS: list[Platform] = [
    ("PrestaShop", ["product-miniature", "product-price-and-shipping"], ["PrestaShop"], ["PrestaShop-"], ["/module/", "/index.php?controller="]),
    ("FacetWP (WordPress)", ["FWP_JSON", "fwp_paged", "facetwp-", "facetwp-facet", "facetwp-template"], [], [], ["fwp_paged=", "fwp_per_page="]),
    ("WooCommerce", ["woocommerce", "wp-content", "woocommerce", "products", "product"], [], [], ["/wp-json/wc/", "/product-category/", "/shop/"]),
    ("Shopify", ["Shopify.theme", "cdn.shopify.com", "shopify-section"], [], [], ["/collections/", "/products/"]),
    ("Magento / Adobe Commerce", ["Magento", "mage/cookies", "mage-init", "checkout/cart", "product-item-info", "products-grid", "product-image-wrapper"], [], ["mage-cache-storage", "X-Magento-Vary", "PHPSESSID"], ["/catalog/", "/customer/account/", "?p="]),
    ("BigCommerce", ["BCData", "bigcommerce.com/s-", "stencil-utils", "cdn11.bigcommerce.com", "card-figure", "productView", "productGrid"], [], [], ["/products/", "/categories/"]),
    ("Squarespace", ["squarespace.com", "static1.squarespace.com", "Static.SQUARESPACE_CONTEXT", "sqs-block", "sqs-block", "ProductList", "ProductItem", "product-block"], [], [], ["/shop/", "/store/"]),
    ("Wix Stores", ["wix.com", "wixstatic.com", "_wix_browser_sess", "wixCodeBootstrap", "data-mesh-id", "wixui-", "data-product-gallery"], [], ["XSRF-TOKEN", "ssr-caching", "svSession"], ["/product-page/"]),
    ("Webflow E-commerce", ["webflow.com", "wf-loaded", "data-wf-page", "uploads-ssl.webflow.com", "w-commerce-commerceaddtocartform", "w-commerce-commercelayoutmain", "w-dyn-list", "w-dyn-item"], [], [], ["/product/", "/category/"]),
    ("D2C Media / eDealer", ["d2cmedia", "edealer", "d2c-", "edealer-", "vehicle-card", "inventory-listing", "vdp-", "srp-"], [], [], ["/new/", "/used/", "/inventory/"]),
    ("Dealer.com", ["dealer.com", "dealercom", "ddc-", "ddc-content", "inventory-listing"], [], [], ["dealer.com"]),
    ("DealerInspire", ["dealerinspire", "di-page", "flavor-", "di-page", "flavor-inventory"], [], [], []),
    ("eDealer", ["edealer", "e-dealer"], [], [], ["/inventory/", "/new/", "/used/"]),
    ("DealerSocket / Iframe tiers", ["dealersocket", "dealercity", "dealer.com", "iframe"], [], [], []),
]
# The platform told by one mark of each of two groups, what others are called, and the least part of its marks that a platform must show.
POWERGO, POWERGO_MARKS, GENERIC, LEAST = "PowerGO / Next.js", (("__next_data__", "_next/static"), ("powergo", "pg-vehicle")), "Générique", 0.2


def named(generator: str) -> tuple[str, str]:
    """How a page names its generator."""
    return f'generator" content="{generator.lower()}', f"generator' content='{generator.lower()}"


def platform_of(html: Column, url: Column, cookies: Column | None = None, platforms: list[Platform] = PLATFORMS) -> Column:
    """(name, ratio): the platform that shows the largest part of its marks, the first of equals; a generator that is only mentioned counts half.

    The page is read once for all marks; only the few that it has are counted per platform.
    """
    lower = lambda marks: [m.lower() for m in marks]
    in_page = [x for p in platforms for x in (*lower(p[1]), *lower(p[2]), *lower(p[4]), *(y for g in p[2] for y in named(g)))] + [m for group in POWERGO_MARKS for m in group]
    has = F.struct(
        found_in(F.lower(html), in_page).alias("page"),
        found_in(F.lower(url), [m for p in platforms for m in lower(p[4])]).alias("url"),
        (found_in(F.lower(cookies), [m for p in platforms for m in lower(p[3])]) if cookies is not None else F.array().cast("array<string>")).alias("cookies"),
    )

    def rated(x: Column) -> Column:
        is_in = lambda where, mark: F.array_contains(x[where], mark)
        one = lambda test: F.when(test, 1.0).otherwise(0.0)
        rows = []
        for k, (name, marks, generators, starts, addresses) in enumerate(platforms):
            score = sum((one(is_in("page", m)) for m in lower(marks)), F.lit(0.0))
            score = sum((F.when(is_in("page", named(g)[0]) | is_in("page", named(g)[1]), 1.0).when(is_in("page", g.lower()), 0.5).otherwise(0.0) for g in generators), score)
            score = sum((one(is_in("cookies", m)) for m in lower(starts)), score)
            score = sum((one(is_in("page", m) | is_in("url", m)) for m in lower(addresses)), score)
            rows.append(F.struct((score / (len(marks) + len(generators) + len(starts) + len(addresses))).alias("ratio"), F.lit(-k).alias("at"), F.lit(name).alias("name")))
        best = F.array_max(F.array(*rows))
        powergo = F.lit(True)
        for group in POWERGO_MARKS:
            powergo &= F.arrays_overlap(x["page"], F.array(*map(F.lit, group)))
        return F.struct(F.when(powergo, POWERGO).when(best["ratio"] >= LEAST, best["name"]).otherwise(GENERIC).alias("name"), F.when(powergo, 1.0).otherwise(best["ratio"]).alias("ratio"))

    return let(has, rated)
