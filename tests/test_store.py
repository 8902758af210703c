"""The stored graph, closures of any depth, and queries as text."""

import random

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from terrace.functions import terms as t
from terrace.operators import compare, texts
from terrace.plans.fixture import BASE, REF, star_graph, stored_star
from terrace.plans.graph import QUAD, closure
from terrace.plans.store import GraphStore
from terrace.sources.turtle import value_lists

DIR = "/root/testdata/sf0.001"


def rows_of(spark, layer, *facts):
    return spark.createDataFrame([(s, "iri", p, o, k, dt, lang, f"urn:graph:{layer}") for s, p, o, k, dt, lang in facts], QUAD)


def fact(s, o, k="lit", dt=None, lang=None, p=t.LABEL):
    return s, p, o, k, dt, lang


def triples(ctx):
    return sorted(map(tuple, ctx.triples().select("s", "o").collect()))


def test_layers_are_sets_and_their_union_too(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.current() == {} and store.context().triples().count() == 0
    store.load("v", rows_of(spark, "v", fact("n#a", "x"), fact("n#a", "x"), fact("n#b", "y"), fact("n#b", "y", lang="en")))
    store.load("ref", rows_of(spark, "ref", fact("r#1", "one"), fact("n#a", "x")))
    ctx = store.context()
    assert list(ctx.layers) == ["ref", "v"] and ctx.namespaces["v"] == "n#"
    assert ctx.quads().count() == 5 and triples(ctx) == [("n#a", "x"), ("n#b", "y"), ("r#1", "one")]
    # The layer that had the shared triple first loses it: the other's mark goes.
    store.load("ref", rows_of(spark, "ref", fact("r#1", "one")))
    assert triples(store.context()) == [("n#a", "x"), ("n#b", "y"), ("r#1", "one")]
    assert triples(ctx) == [("n#a", "x"), ("n#b", "y"), ("r#1", "one")]
    store.clean()
    assert triples(store.context()) == [("n#a", "x"), ("n#b", "y"), ("r#1", "one")]


def test_a_load_that_fails_leaves_the_graph(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.load("v", rows_of(spark, "v", fact("n#a", "x")))
    with pytest.raises(ValueError):
        store.load("v", rows_of(spark, "v", fact("a", "x")))
    with pytest.raises(ValueError):
        store.load("no-name", rows_of(spark, "v", fact("n#a", "x")))
    with pytest.raises(Exception, match="boom"):
        store.load("v", rows_of(spark, "v", fact("n#z", "z")).withColumn("s", F.raise_error(F.lit("boom"))))

    def stopped(layers):
        raise OSError("stopped before the switch")

    monkeypatch.setattr(store, "_switch", stopped)
    with pytest.raises(OSError):
        store.load("v", rows_of(spark, "v", fact("n#z", "z")))
    assert triples(GraphStore(spark, str(tmp_path / "g")).context()) == [("n#a", "x")]


def test_a_pattern_reads_its_predicate_alone(spark):
    ctx, plain = stored_star(spark, DIR), star_graph(spark, DIR)
    assert ctx.namespaces == plain.namespaces
    assert ctx.triples().exceptAll(plain.triples()).isEmpty() and plain.triples().exceptAll(ctx.triples()).isEmpty()
    plan = ctx.triples().where(F.col("p") == t.LABEL).select("s", "o")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "Exchange" not in plan and "Aggregate" not in plan
    own = ctx.layers["building"][1]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(g" in own and "= urn:graph:building)]" in own


def plain_closure(edges, roots):
    below, out = {}, set()
    for child, parent in edges:
        below.setdefault(parent, set()).add(child)
    for root in roots:
        depth, front, seen = 0, {root}, {}
        while front:
            depth, front = depth + 1, {c for x in front for c in below.get(x, ())} - set(seen)
            seen |= dict.fromkeys(front, depth)
        out |= {(root, n, d) for n, d in seen.items()}
    return out


@pytest.mark.parametrize(("nodes", "n", "roots"), [(6, 8, 1), (30, 29, 2), (60, 90, 4)])
def test_closure_of_random_graphs(spark, nodes, n, roots):
    rng = random.Random(nodes)
    edges, tops = [(str(rng.randrange(nodes)), str(rng.randrange(nodes))) for _ in range(n)], [str(i) for i in range(roots)]
    got = closure(spark.createDataFrame([*edges, (None, "0"), ("1", None)], "child string, parent string"), spark.createDataFrame([(r,) for r in tops], "root string"))
    assert {tuple(r) for r in got.collect()} == plain_closure(edges, tops)


def test_long_chains_and_lists_take_few_rounds(spark, monkeypatch):
    from terrace.plans import graph

    rounds, jumped = [], graph._jumped
    monkeypatch.setattr(graph, "_jumped", lambda chain: rounds.append(1) or jumped(chain))
    n = 20000
    cells = spark.range(n).select(F.concat(F.lit("_:"), "id").alias("s"), F.col("id"))
    first = cells.select("s", F.lit(t.RDF + "first").alias("p"), F.col("id").cast("string").alias("o"))
    rest = cells.select("s", F.lit(t.RDF + "rest").alias("p"), F.when(F.col("id") == n - 1, t.RDF + "nil").otherwise(F.concat(F.lit("_:"), (F.col("id") + 1).cast("string"))).alias("o"))
    got = value_lists(first.union(rest))
    assert got.where("head = '_:0' and place = cast(value as int)").count() == got.count() == n
    assert len(rounds) <= 16


def test_texts_give_the_builders_rows(spark):
    ctx = stored_star(spark, DIR)
    text, built = texts.TextEngine(ctx), compare.Engine(ctx)
    given = {"VENDOR": f"{BASE}building#", "FROM": f"{BASE}building#", "TO": f"{BASE}machinery#", "REF_CONCEPT": f"{REF}N3", "OTHER": "ignored"}
    assert set(compare.CATALOG) < set(text.queries)
    for name in compare.CATALOG:
        assert text.run(name, given).collect() == built.run(name, given).collect()
        assert {"name": name, "params": sorted(compare.CATALOG[name].params)}.items() <= next(q for q in text.list_queries() if q["name"] == name).items()
    with pytest.raises(KeyError):
        text.run("nothing")
    with pytest.raises(ValueError, match="FROM, TO"):
        text.run("migration_diff")


def test_a_folder_of_texts(spark, tmp_path):
    ctx = stored_star(spark, DIR)
    (tmp_path / "named.sql").write_text("-- Terms of a name: it's :ASIDE here\nSELECT s FROM {triples} WHERE p = :rdfs_label AND o = :NAME AND s <> ':QUOTED' AND startswith(s, :ref_) AND s::string IS NOT NULL\n")
    (tmp_path / "broken.sql").write_text("-- x\nSELECT * FROM {triples} WHERE p = = :rdfs_label\n")
    engine = texts.TextEngine(ctx, str(tmp_path))
    assert engine.list_queries()[1] == {"name": "named", "params": ["NAME"], "about": "Terms of a name: it's :ASIDE here"}
    assert [r.s for r in engine.run("named", {"NAME": "ASIA"}).collect()] == [f"{REF}R2"]
    assert engine.run("named", {"NAME": "x' OR '1' = '1"}).count() == 0
    with pytest.raises(ParseException, match="line 2"):
        engine.run("broken")
    for text, told in (("SELECT * FROM {nothing}", "line 1, column 15"), ("SELECT :foaf_name", "line 1, column 8"), ("DROP TABLE x", "SELECT or WITH"), ("SELECT {", "bad")):
        with pytest.raises(texts.TextError, match=told):
            engine.queries["bad"] = texts.read_text("bad", text)
            engine.run("bad")
