"""Registered sources: lookups, three formats through one reader, pruned partitions, federated search."""

import json

import pytest

from marketlens.sources import plugins
from marketlens.sources.plugins import Source

CAR, MOTO = ("vehicule.auto",), ("vehicule.moto",)


@pytest.fixture(scope="module")
def registry(tmp_path_factory):
    root = tmp_path_factory.mktemp("feeds")
    (root / "a").mkdir()
    for k in range(3):
        rows = [{"id": 10 * k + j, "name": f"Ninja {k}{j}", "brand": "Kawasaki", "price": 1000 + 10 * k + j, "url": f"https://a.com/p/{j % 2}?x={k}"} for j in range(4)]
        (root / "a" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n[1]\n")
    (root / "b.csv").write_text('sku,title,price\n1,"Ninja, red",900\n2,Civic,5\n')
    (root / "c.xml").write_text('<f xmlns="urn:x"><p><id>7</id><name>Ninja é</name><price>n/a</price></p><p><id>8</id><name>NINJA</name><price>1001.5</price><url>https://c.com/8</url></p></f>')
    return plugins.Registry([
        Source("a-shop", "A Shop", "a.com", f"{root}/a", "json", MOTO),
        Source("b-motors", "B Motors", "b.ca", f"file://{root}/b.csv", "csv", ("vehicule",), fields=(("id", "sku"), ("name", "title"))),
        Source("c-auto", "Chez C", "c.com", f"{root}/c.xml", "xml", CAR, tag="p"),
        Source("gone", "Gone", "gone.com", f"{root}/nowhere", "json", MOTO),
    ])


def test_lookups(registry):
    slug = lambda s: s and s.slug
    assert slug(registry.by_slug("b-motors")) == "b-motors" and registry.by_slug("x") is None
    assert slug(registry.by_url("https://www.a.com/x?y")) == "a-shop" and slug(registry.by_url("http://B.CA/")) == "b-motors"
    assert registry.by_url("https://other.com") is None and registry.by_url("a.com") is None
    assert [s.slug for s in registry.search(" MOTO ")] == ["b-motors"] and [s.slug for s in registry.search("chez")] == ["c-auto"]
    assert {s.slug for s in registry.serving("vehicule.moto")} == {"a-shop", "b-motors", "gone"}
    assert {s.slug for s in registry.serving("vehicule")} == {"a-shop", "b-motors", "c-auto", "gone"}


def test_three_formats_through_one_reader(spark, registry):
    rows = {(r.slug, r.id): (r.name, r.price) for r in registry.read(spark).select("slug", "id", "name", "price").collect()}
    assert len(rows) == 16
    assert rows["b-motors", "1"] == ("Ninja, red", "900") and rows["c-auto", "7"] == ("Ninja é", "n/a") and rows["a-shop", "21"] == ("Ninja 21", "1021")


def test_filters_prune_files(spark, registry):
    every = registry.read(spark)
    one = every.where("slug = 'b-motors'")
    some = every.where("domain in ('a.com', 'c.com') and price > '1000'")
    assert every.rdd.getNumPartitions() == 5 and one.rdd.getNumPartitions() == 1 and some.rdd.getNumPartitions() == 4
    assert one.count() == 2 and every.where("slug = 'nothing'").count() == 0


def test_federated_search(spark, registry):
    got = [(r.slug, r.id) for r in plugins.federated(spark, registry, "vehicule.moto", ["ninja"], 3).collect()]
    assert got == [("b-motors", "1"), ("a-shop", "0"), ("a-shop", "1")]
