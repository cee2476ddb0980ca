"""Whether a product is new, used or a demonstrator, and from which part of a site it comes, by its addresses, names, page and kilometres."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of addresses by the section of a site.
USED_SECTION = "occasion used pre-owned usag d-occasion pre-possede pre_possede seconde-main vehicules-occasion vehicule-occasion inventaire-usage".split()
CATALOGUE_SECTION = "catalogue catalog showroom gamme /models/ /modeles/".split()
# Parts of addresses by the state of the product.
USED_ADDRESS = "/usage/ /used/ /occasion/ /pre-owned/ /usag /d-occasion/ /pre-possede/ -usage- -used- -occasion- vehicules-occasion vehicule-occasion inventaire-usage inventaire-occasion /pre_possede/".split()
DEMO_ADDRESS = "/demo/ /demonstrat/ -demo- -demonstr- demonstrateur".split()
NEW_ADDRESS = "/neuf/ /new/ -neuf- -new- inventaire-neuf".split()
SURE_USED_ADDRESS = "/usage/ /used/ /occasion/ usag -usage- -used- d-occasion pre-possede pre-owned vehicules-occasion inventaire-usage".split()
# Words of a state, in a stated condition (anywhere) and in a page's titles and badges (as words).
DEMO_NAMES = "démo démonstrateur demonstrateur demo".split()
STATED_USED, STATED_DEMO, STATED_NEW = ["occasion", "usage", "usagé", "used", "pre-owned"], ["demo", "démo"], ["neuf", "neuve", "brand new"]
SHOWN_USED = ["usage", "usagé", "usagee", "usagée", "occasion", "used", "pre-owned", "pré-possédé", "pré-possédée"]
SHOWN_DEMO, SHOWN_NEW = ["démonstrateur", "demonstrateur", "demo unit", "démo"], ["neuf", "neuve", "brand new"]
# Classes of elements that state a condition, and parts of the classes of badges and paths.
FIELD_CLASSES, BADGE_CLASSES = ["condition", "etat"], ["badge", "label", "tag", "state", "status", "breadcrumb", "type-vehicle", "vehicle-type"]


def holds(text: Column, parts: Iterable[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda part: F.contains(text, part))


def words_pattern(words: Iterable[str]) -> str:
    """A pattern that finds one of the words where no letter, digit or _ is beside it; the same in Java and RE2."""
    return rf"(^|[^\p{{L}}0-9_])({'|'.join(words)})($|[^\p{{L}}0-9_])"


def low(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def section(product_url: Column, page_url: Column, given: Column) -> Column:
    """vehicules_occasion, catalogue or inventaire: as given, else by both addresses."""
    both = F.concat_ws(" ", low(product_url), low(page_url))
    return F.coalesce(F.nullif(given, F.lit("")), F.when(holds(both, USED_SECTION), "vehicules_occasion").when(holds(both, CATALOGUE_SECTION), "catalogue").otherwise("inventaire"))


def by_address(url: Column) -> Column:
    u = low(url)
    return F.when(holds(u, USED_ADDRESS), "occasion").when(holds(u, DEMO_ADDRESS), "demonstrateur").when(holds(u, NEW_ADDRESS), "neuf")


def stated(field: Column) -> Column:
    """The state that a page's own field says."""
    x = low(field)
    return F.when(holds(x, STATED_USED), "occasion").when(holds(x, STATED_DEMO), "demonstrateur").when(holds(x, STATED_NEW), "neuf")


def shown(text: Column) -> Column:
    """The state that titles, badges and descriptions name."""
    x = low(text)
    return F.when(x.rlike(words_pattern(SHOWN_USED)), "occasion").when(x.rlike(words_pattern(SHOWN_DEMO)), "demonstrateur").when(x.rlike(words_pattern(SHOWN_NEW)), "neuf")


def product_condition(name: Column, model: Column, product_url: Column, page_url: Column, field: Column, text: Column, km: Column, source: Column, given: Column) -> Column:
    """neuf, occasion or demonstrateur.

    As given; else the first that tells: a demonstrator's word in the name or model, the product's address, the page's, the page's field, its titles and badges,
    kilometres above 0, its section (``source``, see ``section``). Used is believed only with kilometres above 0, an address of used vehicles, or a field
    that says so (if the state wasn't settled before the field was looked at); else it is new. Kilometres may be text, whose digits count. Nulls tell nothing.
    """
    went = F.coalesce(F.regexp_replace(km.cast("string"), r"(\.0+$)|[^0-9]", "").try_cast("long"), F.lit(0)) > 0
    demo = F.when(F.concat_ws(" ", low(name), low(model)).rlike(words_pattern(DEMO_NAMES)), "demonstrateur")
    early = F.coalesce(F.nullif(given, F.lit("")), demo, by_address(product_url), by_address(page_url))
    last = F.when(went | (source == "vehicules_occasion"), "occasion").otherwise("neuf")
    sure = went | holds(F.concat_ws(" ", low(product_url), low(page_url)), SURE_USED_ADDRESS) | (early.isNull() & F.coalesce(stated(field) == "occasion", F.lit(False)))
    state = F.coalesce(early, stated(field), shown(text), last)
    return F.when((state == "occasion") & ~sure, "neuf").otherwise(state)


# --- a page's parts ----------------------------------------------------------------------------------------------------------------------------
# An element of a condition's class with its content; a label with the word and the element after it.
FIELD = rf'(?is)<(?:li|dd|div|span|p)[^>]*class="(?:[^"]* )?(?:{"|".join(FIELD_CLASSES)})(?: [^"]*)?"[^>]*>(.*?)</(?:li|dd|div|p)>'
LABELLED = r"(?is)<(?:span|th|dt|strong|b)[^>]*>[^<]*condition[^<]*</(?:span|th|dt|strong|b)>[^<]*<(?:span|td|dd)[^>]*>([^<]*)"
TITLES = r"(?is)<title[^>]*>([^<]*)"
DESCRIPTIONS = r'(?is)<meta[^>]* name="[^"]*"[^>]* content="([^"]*)"'
BADGES = rf'(?is)<[a-z]+[^>]* class="[^"]*(?:{"|".join(BADGE_CLASSES)})[^"]*"[^>]*>([^<]*)'


def page_field(html: Column) -> Column:
    """What a page says of a product's condition in an element of its own, without tags; else after a label; empty if neither."""
    own = F.trim(F.regexp_replace(F.regexp_extract(html, FIELD, 1), "<[^>]*>", " "))
    return F.coalesce(F.nullif(own, F.lit("")), F.regexp_extract(html, LABELLED, 1))


def page_text(html: Column) -> Column:
    """A page's title, badges and descriptions."""
    return F.concat_ws(" ", *(F.array_join(F.regexp_extract_all(html, F.lit(p), 1), " ") for p in (TITLES, BADGES, DESCRIPTIONS)))
