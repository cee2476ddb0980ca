"""Page operators on the standard library's HTML parser, as Arrow functions over batches of pages."""

from __future__ import annotations

import json
import re
import statistics
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is dropped with its content, attributes that go, script types that stay.
DROPPED = {"script", "style", "noscript", "iframe", "svg"}
JSON_TYPES = {"application/ld+json", "application/json"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Cleaner(HTMLParser):
    """Writes a page again without scripts (but JSON), styles, comments, style and data attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kind = dict(attrs).get("type") or ""
        if self.inside or tag in DROPPED and not (tag == "script" and kind.lower() in JSON_TYPES):
            if tag not in VOID:
                self.inside.append(tag)
            return
        kept = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in attrs if k not in ("style",) and not k.startswith(("data-", "on")))
        self.out.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag: str) -> None:
        if self.inside:
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
        else:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


class Paths(HTMLParser):
    """The set of ``parent>tag.class`` keys of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.keys: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        name = tag + "".join(f".{c}" for c in sorted((dict(attrs).get("class") or "").split()))
        self.keys.add(f"{self.open[-1] if self.open else ''}>{name}")
        if tag not in VOID:
            self.open.append(name)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].split(".")[0] == tag:
                del self.open[k:]
                break


def cleaned(page: str | None) -> str:
    p = Cleaner()
    p.feed(page or "")
    p.close()
    return "".join(p.out)


def keys(page: str | None) -> list[str]:
    p = Paths()
    p.feed(page or "")
    p.close()
    return sorted(p.keys)


#: Bytes of pages that are Python objects at a time.
PIECE = 1 << 20


def in_pieces(pages: pa.Array, of: Callable[[str | None], str]) -> pa.Array:
    """A function of each page. A batch goes piece by piece, so that beside it and its result only some ``PIECE`` bytes, or one longer page, are held."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [pa.array([], pa.string())], 0
    while at < len(pages):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        out.append(pa.array(list(map(of, pages.slice(at, to - at).to_pylist())), pa.string()))
        at = to
    return pa.concat_arrays(out)


def clean(pages: str) -> Column:
    """The cleaned page."""
    return F.arrow_udf(lambda x: in_pieces(x, cleaned), "string")(pages)


def signature(pages: str) -> Column:
    """The page's path keys."""
    return F.pandas_udf(lambda x: x.map(keys), "array<string>")(pages)


class Facts(HTMLParser):
    """What a page says about a product: JSON-LD blocks, itemprop values, og: values, headings, and the text of list items and table rows."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[str] = []
        self.items: dict[str, str] = {}
        self.graph: dict[str, str] = {}
        self.headings: list[str] = []
        self.rows: list[str] = []
        self.into: list[tuple[str, str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("property", "").startswith("og:"):
            self.graph.setdefault(a["property"][3:], a.get("content", ""))
        if "itemprop" in a:
            if a.get("content"):
                self.items.setdefault(a["itemprop"], a["content"])
            elif tag not in VOID:
                self.into.append((tag, f"item:{a['itemprop']}", []))
                return
        kind = {"h1": "heading", "title": "heading", "li": "row", "tr": "row"}.get(tag)
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            kind = "json"
        if kind:
            self.into.append((tag, kind, []))

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.into:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.into) - 1, -1, -1):
            if self.into[k][0] == tag:
                _, kind, parts = self.into.pop(k)
                text = " ".join("".join(parts).split()) if kind != "json" else "".join(parts)
                if kind.startswith("item:"):
                    self.items.setdefault(kind[5:], text)
                else:
                    {"heading": self.headings, "row": self.rows, "json": self.blocks}[kind].append(text)
                return


def nodes(x: object) -> list[dict]:
    """Product nodes in parsed JSON at any depth, in the order of the text."""
    out, todo = [], [x]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if x.get("@type") in ("Product", "Vehicle", "Car", "Motorcycle"):
                out.append(x)
            x = list(x.values())
        if isinstance(x, list):
            todo += [y for y in reversed(x) if isinstance(y, dict | list)]
    return out


def number(x: object) -> float | None:
    m = re.search(r"[0-9][0-9,]*(?:\.[0-9]+)?", str(x or "").replace(" ", ""))
    return float(m[0].replace(",", "")) if m else None


def product(page: str | None) -> dict:
    """Name, price and the layer that gave the name: JSON-LD, microdata, OpenGraph, heading; the price is the first that a layer has."""
    f = Facts()
    f.feed(page or "")
    f.close()
    layers: list[tuple[str, object, object]] = []
    for block in f.blocks:
        try:
            found = nodes(json.loads(re.sub(r",\s*([}\]])", r"\1", block)))
        except ValueError:
            continue
        for n in found:
            offer = n.get("offers") or {}
            offer = offer[0] if isinstance(offer, list) and offer else offer
            layers.append(("json-ld", n.get("name"), offer.get("price") if isinstance(offer, dict) else None))
    layers += [("microdata", f.items.get("name"), f.items.get("price")), ("opengraph", f.graph.get("title"), f.graph.get("price:amount")), ("heading", next(iter(f.headings), None), None)]
    name = next(((layer, str(n)) for layer, n, _ in layers if n), ("none", None))
    return {"name": name[1], "price": next((p for _, _, x in layers if x and (p := number(x)) is not None), None), "layer": name[0]}


def listed_items(page: str | None, most: int = 100) -> list[dict]:
    """List items and table rows with some text, with a year and a price if they state them."""
    f = Facts()
    f.feed(page or "")
    f.close()
    out = []
    for k, text in enumerate([x for x in f.rows if len(x) > 3][:most]):
        year, price = re.search(r"\b(?:19|20)[0-9]{2}\b", text), re.search(r"([0-9][0-9 ,]*(?:\.[0-9]{2})?)\s*\$", text)
        out.append({"position": k, "text": text, "year": int(year[0]) if year else None, "price": number(price[1]) if price else None})
    return out


def extracted(pages: str) -> Column:
    """struct of name, price and layer."""
    kind = "name string, price double, layer string"
    return F.pandas_udf(lambda x: pd.DataFrame([product(p) for p in x], columns=["name", "price", "layer"]).astype({"price": "float64"}), kind)(pages)


def items(pages: str) -> Column:
    """array of (position, text, year, price)."""
    return F.pandas_udf(lambda x: x.map(listed_items), "array<struct<position:int,text:string,year:int,price:double>>")(pages)


# --- a page as a tree: repeated siblings, listed products, templates ------------------------------------------------------------------
@dataclass
class Node:
    """An element with what its subtree holds: size in characters, texts, the first link, whether there is an image."""

    tag: str
    attrs: dict[str, str]
    children: list[Node] = field(default_factory=list)
    size: int = 0
    texts: list[str] = field(default_factory=list)
    link: str | None = None
    image: bool = False

    @property
    def text(self) -> str:
        return " ".join(self.texts)

    @property
    def classes(self) -> list[str]:
        return [c for c in self.attrs.get("class", "").split() if not built(c)]


# How long the names are that a build step gives to classes, and how long the endings that it adds to a name.
BUILT, ENDING = 16, 6


def built(name: str) -> bool:
    """Whether a build step seems to have named a class: such names differ between pages of one template."""
    if name.startswith("css-"):
        return True
    stem, _, ending = name.partition("__")
    if stem.isalpha() and len(ending) >= ENDING and ending.isalnum():
        return name.isascii()
    return len(name) >= BUILT and name.isascii() and all(c in "_-" or c.isdigit() or c.islower() for c in name)


# Elements whose end may be left out, what each beginning of one ends, and what it doesn't reach beyond.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
WITHIN = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body"}


class Tree(HTMLParser):
    """Elements in the order they close, each with its children; an element that is left open closes with what is around it."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[Node] = [Node("", {})]
        self.all: list[Node] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended = ENDS.get(tag, set())
        while inner := next((n for n in reversed(self.open) if n.tag in ended or n.tag in WITHIN), None):
            if inner.tag not in ended:
                break
            while self.open[-1] is not inner:
                self.shut()
            self.shut()
        node = Node(tag, {k: v or "" for k, v in attrs}, size=len(self.get_starttag_text() or ""), image=tag == "img")
        node.link = node.attrs.get("href") if tag == "a" else None
        self.open.append(node)
        if tag in VOID:
            self.shut()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut()

    def shut(self) -> None:
        node = self.open.pop()
        up = self.open[-1]
        up.children.append(node)
        up.size += node.size
        up.link = up.link if up.link is not None else node.link
        up.image = up.image or node.image
        if node.tag not in DROPPED:
            up.texts.extend(node.texts)
        self.all.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open[-1].tag != tag:
                self.shut()
            self.open[-1].size += len(tag) + 3
            self.shut()

    def handle_data(self, data: str) -> None:
        self.open[-1].size += len(data)
        if data.strip():
            self.open[-1].texts.append(" ".join(data.split()))

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self.shut()
        self.all.append(self.open[0])


def tree(page: str | None) -> Tree:
    t = Tree()
    t.feed(page or "")
    t.close()
    return t


#: A price with its sign before or after.
PRICED = re.compile(r"\$\s?[\d,.]+|\d[\d\s,.]*\$|€\s?[\d,.]+")
# The number of siblings that make a listing, the number that are looked at for signals and that fill the volume, the weights of volume, even
# size, links, images, prices, links within the site, a hint and product attributes, the text below which an item is no product or half of one, the least score.
FEWEST, LOOKED_AT, FULL = 4, 30, 20
VOLUME, EVEN, LINK, IMAGE, PRICE, INSIDE, HINT, MARKED = 0.3, 0.15, 0.10, 0.10, 0.10, 0.05, 0.15, 0.05
NO_PRODUCT, HALF_PRODUCT, LEAST_SCORE = 20, 40, 0.40
PRODUCT_ATTRS = {"data-product-id", "data-product-handle", "data-vehicle-id", "data-listing-id"}


def sibling_score(items: list[Node], hints: list[str], domain: str) -> float:
    """How much siblings look like a listing: 0 without links within the site, with one target for all, or with hardly any text."""
    some = items[:LOOKED_AT]
    inside = [n.link for n in some if n.link and (n.link.startswith("/") or (domain and domain in n.link))]
    targets = {re.split("[?#]", x)[0].rstrip("/") for x in inside}
    length = statistics.mean(len(n.text) for n in some)
    if not inside or len(targets) == 1 or length < NO_PRODUCT:
        return 0.0
    sizes = [n.size for n in items]
    uneven = statistics.stdev(sizes) / statistics.mean(sizes) if len(sizes) > 1 and any(sizes) else 1.0
    share = lambda test: sum(map(test, some)) / len(some)
    signals = LINK * share(lambda n: n.link is not None) + IMAGE * share(lambda n: n.image) + PRICE * share(lambda n: bool(PRICED.search(n.text))) + INSIDE * len(inside) / len(some)
    first = items[0]
    hinted = any(h.lower().lstrip(".#") in first.attrs.get("class", "").lower() or h.lower() == first.tag for h in hints)
    total = VOLUME * min(1.0, len(items) / FULL) + EVEN * max(0.0, 1 - uneven) + signals * (0.5 if length < HALF_PRODUCT else 1.0)
    return total + HINT * hinted + MARKED * bool(PRODUCT_ATTRS & {k for k, v in first.attrs.items() if v})


def repeated(page: str | None, hints: list[str] | None = None, domain: str = "", fewest: int = FEWEST) -> list[tuple[float, str, list[Node]]]:
    """(score, selector, items) of all groups of siblings with one tag and up to three classes in common, best first."""
    out = []
    for parent in tree(page).all:
        groups: dict[tuple, list[Node]] = {}
        for child in parent.children:
            groups.setdefault((child.tag, *sorted(child.classes)[:3]), []).append(child)
        for (tag, *_), items in groups.items():
            if len(items) >= fewest:
                classes = items[0].classes[:3]
                around = ".".join([parent.tag, *parent.classes[:2]]) if parent.tag not in ("", "html") else ""
                selector = ".".join([tag, *classes]) if classes else f"{around} > {tag}" if around else tag
                out.append((sibling_score(items, hints or [], domain), selector, items))
    return sorted(out, key=lambda x: -x[0])


def listed_products(page: str | None, most: int = 100) -> list[dict]:
    """Products of a listing page, a hundred at most: those of a JSON-LD ItemList, else the items of its best group of siblings with a score of 0.4 or more."""
    f = Facts()
    f.feed(page or "")
    f.close()
    for block in f.blocks:
        try:
            top = json.loads(block)
        except ValueError:
            continue
        todo, found = [top], []
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(reversed(x))
            elif isinstance(x, dict):
                if x.get("@type") == "ItemList":
                    found += [e.get("item") if isinstance(e, dict) and isinstance(e.get("item"), dict) else e for e in x.get("itemListElement") or []]
                else:
                    todo.extend(reversed([y for y in x.values() if isinstance(y, dict | list)]))
        rows = [x for x in found if isinstance(x, dict) and x.get("name")]
        if rows:
            offer = lambda x: (x.get("offers") or [{}])[0] if isinstance(x.get("offers"), list) else x.get("offers") or {}
            return [{"position": k, "name": str(x["name"]), "price": number(offer(x).get("price")), "year": year(str(x["name"])), "url": x.get("url"), "layer": "itemlist"} for k, x in enumerate(rows[:most])]
    best = next(iter(repeated(page)), None)
    if best is None or best[0] < LEAST_SCORE:
        return []
    out = []
    for k, n in enumerate(best[2][:most]):
        name = next((t for t in n.texts if not PRICED.search(t)), n.text)
        out.append({"position": k, "name": name, "price": last_price(" ".join(t for t in n.texts if PRICED.search(t))), "year": year(n.text), "url": n.link, "layer": "siblings"})
    return out


def year(text: str) -> int | None:
    m = re.search(r"\b(?:19|20)[0-9]{2}\b", text)
    return int(m[0]) if m else None


#: A number as shops write it: groups of three after a space, comma or point, then two decimals or none.
NUMBER = r"[0-9]+(?:[\s\u00a0\u202f,.][0-9]{3}(?![0-9]))*(?:[.,][0-9]{2}(?![0-9]))?"
WRITTEN = re.compile(NUMBER)
# What a price can be.
LEAST_PRICE, MOST_PRICE = 1, 1_000_000


def written_price(number: str) -> float:
    """A sign before two last digits is decimal, the others part groups."""
    whole, cents = (number[:-3], number[-2:]) if len(number) > 3 and number[-3] in ",." else (number, "0")
    return float("".join(c for c in whole if c.isdigit()) + "." + cents)


def last_price(text: str | None) -> float | None:
    """The last number in a text that can be a price: the one that counts stands after the one crossed out."""
    values = (written_price(x) for x in WRITTEN.findall(text or ""))
    return next((x for x in reversed([*values]) if LEAST_PRICE <= x <= MOST_PRICE), None)



def template(page: str | None) -> list[str]:
    """Keys of a product page's template: main containers with their classes and data attributes, blocks of its structure, JSON-LD types."""
    t = tree(page)
    found: set[str] = set()
    counts = {"dl": 0, "table": 0, "section": 0}
    for n in t.all:
        counts[n.tag] = counts.get(n.tag, 0) + 1
        classes = n.attrs.get("class", "").split()
        if n.tag in ("main", "article") or (n.tag == "section" and classes) or n.attrs.get("role") == "main" or PRODUCT_CLASSES & set(classes):
            found |= {f"tag:{n.tag}", *(f"cls:{c.lower()}" for c in n.classes[:5])}
        if n.tag in ("body", "main", "article") or {"data-template", "data-page-type"} & n.attrs.keys():
            found |= {f"attr:{k}" for k in n.attrs if re.match(r"data-[a-z][a-z0-9-]+$", k)}
    found |= {f"struct:{k}-{min(counts[k], most)}" for k, most in (("dl", 3), ("table", 3), ("section", 5))}
    if counts.get("h1"):
        found.add("struct:h1")
    f = Facts()
    f.feed(page or "")
    f.close()
    for block in f.blocks:
        found |= {f"jsonld:{x.lower()}" for x in re.findall(r'"@type"\s*:\s*"(\w+)"', block) if x.lower() in JSON_LD_TYPES}
    return sorted(found)


# Classes of product containers, and the JSON-LD types that tell templates apart.
PRODUCT_CLASSES = {"product", "vehicle", "vdp", "product-detail", "product-info", "product-page", "vehicle-detail"}
JSON_LD_TYPES = {"vehicle", "car", "automotivevehicle", "product", "individualproduct", "residence", "house", "jobposting"}
# Pages looked at and needed for a site's templates, and the likeness of one template.
SAMPLE, NEEDED, ALIKE = 20, 4, 0.70


def leaders(signatures: list[set[str]], alike: float = ALIKE) -> list[tuple[list[int], set[str]]]:
    """(members, keys of at least half of them), largest first. Each page joins the first cluster that is alike enough as it stands, else begins one; lone pages go if there are others."""
    clusters: list[tuple[list[int], dict[str, int]]] = []

    def shared(members: list[int], counts: dict[str, int]) -> set[str]:
        return {k for k, n in counts.items() if n >= max(1, len(members) // 2)}

    for k, own in enumerate(signatures):
        for members, counts in clusters:
            middle = shared(members, counts)
            if len(own & middle) >= alike * len(own | middle):
                break
        else:
            members, counts = [], {}
            clusters.append((members, counts))
        members.append(k)
        for key in own:
            counts[key] = counts.get(key, 0) + 1
    clusters.sort(key=lambda c: -len(c[0]))
    return [(m, shared(m, counts)) for m, counts in clusters if len(m) > 1 or len(clusters) == 1]


def template_clusters(pages: DataFrame, site: str, url: str, html: str, sample: int = SAMPLE, needed: int = NEEDED) -> DataFrame:
    """(site, template, n_pages, keys) of each site's pages: ``sample`` of them, evenly spaced by URL, which is the operator's own limit and bounds its groups.

    Sites with fewer than ``needed`` pages of more than 1000 characters among these give nothing.
    """
    order = Window.partitionBy("site").orderBy("url")
    rows = pages.select(F.col(site).alias("site"), F.col(url).alias("url"), F.col(html).alias("html")).where("site is not null and url is not null")
    at = rows.select("site", "url").distinct().withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("site"))})
    # page i is the first of its step: numbers floor(k * n / sample)
    chosen = at.where((F.col("n") <= sample) | (F.floor(F.col("i") * sample / F.col("n")) != F.floor((F.col("i") - 1) * sample / F.col("n")))).select("site", "url")
    keyed = rows.join(chosen, ["site", "url"]).where(F.length("html") > 1000).groupBy("site", "url").agg(F.min("html").alias("html"))
    signed = keyed.select("site", "url", F.pandas_udf(lambda x: x.map(template), "array<string>")("html").alias("keys"))

    def cluster(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("url")
        found = leaders([set(k) for k in df["keys"]]) if len(df) >= needed else []
        return pd.DataFrame([(df["site"].iloc[0], f"tpl_{chr(97 + i)}", len(m), sorted(keys)) for i, (m, keys) in enumerate(found)], columns=["site", "template", "n_pages", "keys"])

    return signed.groupBy("site").applyInPandas(cluster, "site string, template string, n_pages int, keys array<string>")


def products(pages: str | Column) -> Column:
    """array of (position, name, price, year, url, layer)."""
    return F.pandas_udf(lambda x: x.map(listed_products), "array<struct<position:int,name:string,price:double,year:int,url:string,layer:string>>")(pages)


def best_siblings(pages: str | Column) -> Column:
    """struct of the selector, number and score of a page's best group of siblings; nulls where none scores."""

    def best(page: str | None) -> tuple:
        top = next(iter(repeated(page)), None)
        return (top[1], len(top[2]), top[0]) if top and top[0] > 0 else (None, None, None)

    return F.pandas_udf(lambda x: pd.DataFrame([best(p) for p in x], columns=["selector", "n", "score"]).astype({"n": "Int64", "score": "float64"}), "selector string, n int, score double")(pages)


def price_in(text: Column) -> Column:
    """The last number in a text that can be a price, as ``last_price`` finds it, by built-in expressions."""

    def value(x: Column) -> Column:
        decimal = x.rlike("[,.][0-9]{2}$") & (F.length(x) > 3)
        whole = F.regexp_replace(F.when(decimal, F.substr(x, F.lit(1), F.length(x) - 3)).otherwise(x), "[^0-9]", "")
        return F.concat(whole, F.when(decimal, F.concat(F.lit("."), F.right(x, F.lit(2)))).otherwise(F.lit(""))).try_cast("double")

    values = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), value)
    return F.try_element_at(F.filter(values, lambda x: x.between(LEAST_PRICE, MOST_PRICE)), F.lit(-1))


def mileage(page: Column, digits: int = 6) -> Column:
    """The distance that a page states after its label, tags between them or not; null if it has more digits, by default from a million on, or is no int."""
    text = F.regexp_replace(F.lower(page), "<[^>]*>", " ")
    stated = F.regexp_replace(F.regexp_extract(text, r"(?:kilom[eé]trage|mileage|odom[eè]tre|odometer)[\s:]*([0-9][0-9\s,.\u00a0]*)", 1), "[^0-9]", "")
    return F.when(F.length(stated).between(1, digits), stated.try_cast("int"))


# How pages announce their number of results, tried in order, and between which numbers one is believed.
TOTALS = [r"(\d+)\s*(?:r[ée]sultats?|results?|produits?|items?|v[ée]hicules?|articles?)", r"(?:showing|affichage)\s+\d+\s*[-–]\s*\d+\s+(?:of|de|sur)\s+(\d+)", r"(?:total|found|trouv[ée]s?)\s*[:\s]*(\d+)", r"(\d+)\s*(?:found|trouv[ée]s?)"]


def announced_total(page: Column) -> Column:
    """The number of results that a page announces, between 10 and 50,000; the first pattern with such a number counts."""
    stated = [F.regexp_extract(F.lower(page), p, 1).try_cast("int") for p in TOTALS]
    return F.coalesce(*(F.when((n > 10) & (n < 50_000), n) for n in stated))


def listing_nodes(block: str | None) -> list[dict]:
    """Every object at any depth of a JSON text that has a name or title and a price (a number, a text or an object with one), in the order of the text."""
    try:
        todo: list[object] = [json.loads(block or "null")]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            name, price = x.get("name") or x.get("title"), x.get("price")
            price = price.get("amount", price.get("value")) if isinstance(price, dict) else price
            if isinstance(name, str) and (value := number(price)) is not None:
                out.append({"name": name, "price": value, "url": x.get("url") if isinstance(x.get("url"), str) else None})
        todo.extend(reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []))
    return out


def embedded_listings(page: Column) -> Column:
    """array of (name, price, url) from the JSON that a page carries for its scripts."""
    block = F.regexp_extract(page, '(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return F.pandas_udf(lambda x: x.map(listing_nodes), "array<struct<name:string,price:double,url:string>>")(block)


def escaped(x: Column) -> Column:
    """A text as HTML shows it."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def reports(rows: DataFrame, by: str, title: Column, columns: dict[str, Column], order: list[Column], most: int) -> DataFrame:
    """(by, html): a table for each group, of its first ``most`` rows, which is the report's own limit and bounds what is gathered. Nulls are empty cells."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in columns.values()]
    top = rows.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_at") <= most)
    top = top.select(by, "_at", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("_row"), title.alias("_title"))
    head = "".join(f"<th>{c}</th>" for c in columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda x: x["_row"]), "")
    return top.groupBy(by).agg(F.concat(F.lit("<h1>"), escaped(F.first("_title")), F.lit(f"</h1><table><tr>{head}</tr>"), body, F.lit("</table>")).alias("html"))
