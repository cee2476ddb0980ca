"""Change sheets, exports, kept copies, states, variants, models, vehicle numbers and site scans against literal cases."""

import datetime as dt

from pyspark.sql import functions as F

from marketlens.functions import condition
from marketlens.functions.text import model_tokens, precise_model
from marketlens.operators import html, resolve, scan, sheets, variants

ITEM = "product_key string, reference_url string, old_price double, recommended_price double, strategy string, reliability string, basis_state string"


def sheet(spark, items, asked, manual):
    rows = [(*x, 100.0, 90.0, "match_lowest", "good", "neuf") for x in items]
    out = sheets.change_sheet(spark.createDataFrame(rows, ITEM), spark.createDataFrame([(k,) for k in asked], "key string"), spark.createDataFrame(manual, "key string, price double, at int"))
    return {(r.product_key, r.reference_url): (r.new_price, r.difference, r.original_price) for r in out.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys(spark):
    cases = {
        "ref:https://WWW.Shop.example/A/b//": "ref:https://shop.example/A/b",
        "HTTP://www.shop.example/": "http://shop.example",
        "https://shop.example/x/?a=1#b": "https://shop.example/x",
        "Brand|Model/": "brand|model",
        "ref:Not An Address/": "ref:not an address",
        "ref:https://www.shop example/a/": "ref:https://shop example/a",
    }
    for key, want in cases.items():
        assert one(spark, sheets.price_key(F.lit(key))) == want
    assert one(spark, sheets.price_key(F.lit(None).cast("string"))) is None


def test_change_sheet_by_any_key(spark):
    items = [("A", "https://shop.example/a"), ("B", None), ("C", "https://shop.example/c"), ("D", ""), ("A", "https://shop.example/a")]
    got = sheet(spark, items, ["ref:https://www.shop.example/a/", "b/", None, ""], [])
    assert got == {("A", "https://shop.example/a"): (90.0, -10.0, None), ("B", None): (90.0, -10.0, None)}
    # the item's own key goes before its address; of one key the last counts; halves go up; bad numbers don't count
    manual = [("a", 70.5, 1), ("https://shop.example/a", 60.0, 9), ("b", 10.0, 1), ("B/", 20.0, 2), ("c", -1.0, 1), ("c", float("nan"), 1), ("c", float("inf"), 1), ("ref:https://shop.example/c", 0.0, 1), ("", 5.0, 1), (None, 5.0, 1)]
    got = sheet(spark, items, ["a", "b", "c", "d"], manual)
    assert got == {("A", "https://shop.example/a"): (71.0, -29.0, 90.0), ("B", None): (20.0, -80.0, 90.0), ("C", "https://shop.example/c"): (0.0, -100.0, 90.0), ("D", ""): (90.0, -10.0, None)}
    # a manual price alone asks for nothing
    assert sheet(spark, items, [], manual) == {} and sheet(spark, [], ["a"], manual) == {}


def test_change_sheet_keeps_repeated_items_and_labels(spark):
    rows = [("a", None, 1.0, 2.0, "match_lowest", "low", "usagé"), ("a", None, 1.0, 2.0, "match_lowest", "good", None), ("z", None, None, None, None, None, None)]
    out = sheets.change_sheet(spark.createDataFrame(rows, ITEM), spark.createDataFrame([("A",), ("a",), ("z",)], "key string"), spark.createDataFrame([], "key string, price double, at int"))
    assert sorted((str(r.strategy_label), r.applied) for r in out.collect()) == [("None", False), ("match_lowest", False), ("match_lowest · moins fiable (basé usagé)", False)]


def test_comparison_and_export(spark, tmp_path):
    rows = [("p", 100.0, "x", 112.4, 2), ("p", 100.0, "x", 1.0, 3), ("p", 100.0, "y", 100.0, 1), ("p", 100.0, "z", 97.2, 1), ("q", None, "x", 5.0, 1), ("r", 7.0, None, None, 1)]
    wide = sheets.comparison(spark.createDataFrame(rows, "product string, reference double, dealer string, price double, at int"), ["product"], ["x", "y", "z"])
    assert wide.columns == ["product", "reference", "x price", "x delta", "y price", "y delta", "z price", "z delta"]
    assert sorted(map(tuple, wide.collect())) == [("p", 100.0, 112.4, "+12 $", 100.0, "= 0 $", 97.2, "-3 $"), ("q", None, 5.0, None, None, None, None, None), ("r", 7.0, None, None, None, None, None, None)]
    sheets.write_export(wide, ["x", "y", "z"], str(tmp_path), "tests")
    back = spark.read.option("header", True).csv(f"{tmp_path}/comparison")
    assert back.columns == wide.columns and back.count() == 3
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/info").collect()] == [("tests", "3", "3")]


def test_merged_sources(spark):
    now = dt.datetime(2024, 5, 1, 12)
    ago = lambda h: now - dt.timedelta(hours=h)
    sites = spark.createDataFrame([("fresh", "u1", None), ("own", "u2", 48.0), ("late", "u3", None), ("stale", "u4", None), ("new", "u5", None), ("none", "u6", None), ("untimed", "u7", None)], "domain string, site_url string, max_hours double")
    cached = spark.createDataFrame([("fresh", "", ago(6), 1), ("fresh", "s", ago(90), 2), ("own", None, ago(47), 3), ("late", None, ago(7), 4), ("stale", None, ago(7), 5), ("untimed", None, None, 6), ("other", None, now, 7)], "domain string, source_site string, scraped_at timestamp_ntz, id int")
    fresh = spark.createDataFrame([("late", None, 14), ("new", "n", 15), ("own", None, 16)], "domain string, source_site string, id int")
    at = F.lit(now).cast("timestamp_ntz")
    run = lambda locked: sorted((r.domain, r.outcome, r.id, r.source_site) for r in sheets.merged_sources(sites, cached, fresh, at, locked, 6.0).collect())
    kept = [("fresh", "cache", 1, "u1"), ("fresh", "cache", 2, "s"), ("own", "cache", 3, "u2")]
    assert run(False) == sorted([*kept, ("late", "refreshed", 14, "u3"), ("stale", "stale", 5, "u4"), ("new", "fallback", 15, "n"), ("untimed", "stale", 6, "u7")])
    assert run(True) == sorted([*kept, ("late", "locked", 4, "u3"), ("stale", "locked", 5, "u4"), ("untimed", "locked", 6, "u7")])


def test_condition(spark):
    def state(name=None, model=None, url=None, page=None, field=None, text=None, km=None, source="inventaire", given=None):
        return one(spark, condition.product_condition(*(F.lit(x).cast("string") for x in (name, model, url, page, field, text, km, source, given))))

    assert state() == "neuf"
    assert state(name="KTM 85 démo") == "demonstrateur" and state(name="Demosthene") == "neuf"
    # the product's address goes before the page's
    assert state(url="https://x/neuf/1", page="https://x/used/") == "neuf" and state(url="https://x/p/1", page="https://x/used/") == "occasion"
    # badges and the section alone aren't believed, fields and kilometres are
    assert state(text="Used!") == "neuf" and state(source="vehicules_occasion") == "neuf"
    assert state(field="Véhicule d'occasion") == "occasion" and state(text="usagé", km="1 200 km") == "occasion" and state(km="12.0") == "occasion"
    assert state(text="refused, unused") == "neuf" and state(text="modèle démonstrateur") == "demonstrateur"
    # a state as given is kept but for a used one without a sign
    assert state(given="demonstrateur", url="https://x/used/1") == "demonstrateur" and state(given="occasion") == "neuf" and state(given="occasion", km="5") == "occasion"
    # once the address has told, the field isn't looked at
    assert state(given="occasion", field="occasion") == "neuf"


def test_page_parts(spark):
    page = '<html><title>Moto <b>x</title><meta name="description" content="Une moto neuve"><span class="my-badge hot">Vendu</span><ul><li class="spec condition"><span>Condition</span> <span class="value">Usagé</span></li></ul></html>'
    assert one(spark, condition.page_field(F.lit(page))).split() == ["Condition", "Usagé"]
    assert one(spark, condition.page_text(F.lit(page))) == "Moto  Vendu Une moto neuve"
    assert one(spark, condition.page_field(F.lit("<tr><th>Condition :</th> <td>Neuf</td></tr>"))) == "Neuf"
    assert one(spark, condition.page_field(F.lit(""))) == "" and one(spark, condition.page_field(F.lit(None).cast("string"))) is None


def test_variants(spark):
    def keys(kind, *parts, **more):
        return one(spark, variants.variant_keys(F.lit(kind).cast("string"), *(F.lit(p).cast("string") for p in parts), **more))

    assert keys("vtt", "Outlander XT-P 850 Toît", None) == ["roof", "xt"]
    assert keys("vtt", "Outlander x tp", "https://x.example/offre/eps-ltd") == ["eps", "limited", "xtp"]
    assert keys("moto", "EXC Factory Edition 19/16") == ["grande-roue", "factory"]
    assert keys("moto", "EXC 119/16 factory-made") == ["factory"]
    assert keys(None, "crewcab ledger") == [] and keys("nobody", "Crew LE") == ["premium", "crew"] and keys("vtt", None) == []
    # an alias with spaces wants spaces, one without wants no letter beside it; one that begins another counts too
    own = {"auto": {"lt": ([" lt ", "lt premium"], 5000.0), "st": ([" st-line"], 1.0), "sr": (["sr"], 2.0), "spaced": ([" sr "], 3.0)}}
    assert keys("auto", "Silverado LT Premium", kinds=own) == ["lt"] and keys("auto", "lt", kinds=own) == ["lt"] and keys("auto", "(lt) xlt", kinds=own) == []
    assert keys("auto", "Edge ST Lineup", kinds=own) == ["st"] and keys("auto", "(sr)", kinds=own) == ["sr"] and keys("auto", "sr", kinds=own) == ["sr", "spaced"]
    total = variants.premium(F.lit("vtt"), F.array(F.lit("winch"), F.lit("xt"), F.lit("unknown")))
    assert one(spark, total) == 1200.0 and one(spark, variants.premium(F.lit("vtt"), F.array().cast("array<string>"))) == 0.0


def test_precise_models(spark):
    for model, want in {"TC 85": True, "150 SX": True, "YZ250F": True, "Summit 850": True, "850": False, "Ninja": False, "a 1 b 2 c": False, "": False}.items():
        assert one(spark, precise_model(F.lit(model))) is want
    assert one(spark, model_tokens(F.lit("YZ250F"))) == ["YZ", "250", "F"] and one(spark, precise_model(F.lit(None).cast("string"))) is False


def test_vin_matches(spark):
    catalogue = spark.createDataFrame([(5, {"vin_prefix": "JKAEX8A1XYZ"}), (3, {"vin_prefix": "JKAEX8A1XYZ"}), (1, {"size": "2"}), (2, None)], "c_id int, c_specs map<string,string>")
    listings = spark.createDataFrame([(1, "jkaex8a1-xyz 000042"), (2, "JKAEX8A1XY"), (3, None), (4, "JKAEX8A1XYQ000042"), (5, "JKAEX8A1XYZ"), (5, "JKAEX8A1XYZ")], "l_id int, vin string")
    assert sorted(map(tuple, resolve.vin_matches(listings, catalogue).collect())) == [(1, 3, "JKAEX8A1XYZ", 0.99), (5, 3, "JKAEX8A1XYZ", 0.99), (5, 3, "JKAEX8A1XYZ", 0.99)]


def test_site_scan_same_as_page_by_page(spark):
    page = '<html><body><h1>KTM 85</h1><span class="price">4 500 $</span>{}</body></html>'
    used = '<ul><li class="condition">Usagé</li></ul>'
    rows = [("https://www.a.example/p/1?x=1", page.format(used)), ("https://a.example/p/1/", page.format("")), ("https://a.example/catalogue/2", page.format("")), ("https://a.example/panier/3", page.format("")), ("https://a.example/used/4", page.format("")), ("https://b.example/5", ""), (None, page.format("")), ("https://b.example/6", None), ("b.example/7", page.format(""))]
    pages = spark.createDataFrame(rows, "url string, html string")
    found = html.product(page.format(""))
    name, price = found["name"], found["price"]
    got = sorted((r.page, r.url, r.name, r.price, r.source, r.etat) for r in scan.site_scan(pages).collect())
    assert got == [
        ("https://a.example/catalogue/2", "https://a.example/catalogue/2", name, price, "catalogue", "neuf"),
        ("https://a.example/p/1", "https://a.example/p/1/", name, price, "inventaire", "neuf"),
        ("https://a.example/used/4", "https://a.example/used/4", name, price, "vehicules_occasion", "occasion"),
    ]
    inventory = scan.site_scan(pages, inventory_only=True)
    assert {r.page for r in inventory.collect()} == {"https://a.example/p/1", "https://a.example/used/4"}
    assert {r.page for r in scan.site_scan(pages, F.col("url").contains("/used/")).collect()} == {"https://a.example/used/4"}
    assert [tuple(r) for r in scan.scan_info(inventory).collect()] == [("a.example", 2, 2 if price else 0, 1)]
