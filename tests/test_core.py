"""Terms, patterns, rules and stores on hand-made quads."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import scalars as S
from quadrille.functions import terms as t
from quadrille.functions.scratch import affordable, written
from quadrille.operators import patterns as pat
from quadrille.plans import rulesets as R
from quadrille.plans.rules import Closure, Eval, Repeat, Rule, Ruleset, With, closure
from quadrille.plans.store import Status, Store
from quadrille.plans.transforms import strongly_connected
from quadrille.sources import nquads
from quadrille.streaming.ingest import ingest

G = "<urn:g:1>"


def q(spark, *triples, g=G):
    return pat.values(spark, list("spog"), [(*x, g) for x in triples])


def triples(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


def u(x):
    return f"<urn:{x}>"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_terms(spark):
    lit = F.lit
    r = one(
        spark,
        iri=t.str_(lit("<urn:a>")), text=t.str_(lit('"a\\"b\\n"@en')), lang=t.lang(lit('"a"@en-US')), kind=t.datatype(lit('"5"^^' + t.xsd("integer"))), n=t.num(lit('"5"^^' + t.xsd("integer"))),
        bad=t.num(lit('"x"^^' + t.xsd("integer"))), plain=t.num(lit('"5"')), match=t.lang_matches(lit("en-us"), "en"), no=t.lang_matches(lit("english"), "en"), node=t.str_(lit("_:b")),
        back=t.literal(lit('a"b\n\\')), less=t.compare(lit('"9"^^' + t.xsd("integer")), "<", lit('"10"^^' + t.xsd("double"))), odd=t.compare(lit("<urn:a>"), "<", lit('"1"')),
    )
    assert r["iri"] == "urn:a" and r["text"] == 'a"b\n' and r["lang"] == "en-us" and r["kind"] == t.xsd("integer") and r["n"] == 5
    assert r["bad"] is None and r["plain"] is None and r["match"] and not r["no"] and r["node"] is None
    assert r["back"] == '"a\\"b\\n\\\\"' and r["less"] is True and r["odd"] is None


def test_scalars(spark):
    r = one(
        spark, before=S.strbefore(F.lit("abc"), "b"), none=S.strbefore(F.lit("abc"), "x"), after=S.strafter(F.lit("abc"), "b"), uri=S.encode_for_uri(F.lit("a b~*é")), half=S.round_half_up(F.lit(-2.5)),
        zero=S.divide(F.lit(1), F.lit(0)), zone=S.timezone(F.lit("2020-01-01T00:00:00-08:30")), tz=S.tz_of(F.lit("2020-01-01T00:00:00")), if_=S.if_(F.lit(None).cast("boolean"), F.lit(1), F.lit(2)),
    )
    assert (r["before"], r["none"], r["after"], r["uri"], r["half"], r["zero"], r["zone"], r["tz"], r["if_"]) == ("a", "", "c", "a%20b~%2A%C3%A9", -2, None, "-PT8H30M", "", None)


def test_repeated_variable_and_constant(spark):
    quads = q(spark, (u("a"), u("p"), u("a")), (u("a"), u("p"), u("b")))
    assert [r["x"] for r in pat.match(quads, ("?x", "?p", "?x")).collect()] == [u("a")]
    assert pat.match(quads, (u("a"), u("p"), u("b"))).count() == 1


def test_minus_and_not_exists_differ_without_shared_variables(spark):
    left, right = pat.values(spark, ["a"], [("1",)]), pat.values(spark, ["b"], [("2",)])
    assert pat.minus(left, right).count() == 1


def test_compatible_join_and_optional_condition(spark):
    left = pat.values(spark, ["a", "b"], [("1", None), ("2", "x")])
    right = pat.values(spark, ["b", "c"], [("x", "k"), ("y", "l")])
    got = {tuple(r) for r in pat.join(left, right, maybe_unbound=["b"]).select("a", "b", "c").collect()}
    assert got == {("1", "x", "k"), ("1", "y", "l"), ("2", "x", "k")}
    kept = pat.optional(pat.values(spark, ["a"], [("1",)]), pat.values(spark, ["a", "c"], [("1", "k")]), on=F.col("c") == "no")
    assert [tuple(r) for r in kept.select("a", "c").collect()] == [("1", None)]


def test_left_compatible_join_keeps_rows_that_nothing_agrees_with(spark):
    left = pat.values(spark, ["a", "b", "c"], [("1", None, "p"), ("2", "x", None), ("3", "z", "q"), ("4", None, None), ("3", "z", "q")])
    right = pat.values(spark, ["b", "c", "d"], [("x", "p", "k"), ("y", None, "l")])
    got = sorted(tuple(r) for r in pat.optional(left, right, maybe_unbound=["b", "c"]).select("a", "b", "c", F.coalesce("d", F.lit("-"))).fillna("-").collect())
    assert got == sorted([("1", "x", "p", "k"), ("1", "y", "p", "l"), ("2", "x", "p", "k"), ("3", "z", "q", "-"), ("3", "z", "q", "-"), ("4", "x", "p", "k"), ("4", "y", "-", "l")])


def test_describe_follows_blank_nodes(spark):
    quads = q(spark, (u("a"), u("p"), "_:b"), ("_:b", u("p"), "<urn:bnode:c>"), ("<urn:bnode:c>", u("p"), "_:b"), ("<urn:bnode:c>", u("p"), u("z")), (u("z"), u("p"), u("a")), ("_:other", u("p"), u("a")))
    assert triples(pat.describe(quads, u("a"))) == triples(quads.where("s not in ('<urn:z>', '_:other')"))


def test_in_with_errors(spark):
    bad = F.lit(None).cast("int")
    got = one(spark, a=S.in_(F.lit(1), F.lit(1), bad), b=S.in_(F.lit(2), F.lit(1), bad), c=S.not_in(F.lit(2), F.lit(1)), d=S.in_(F.lit(2)))
    assert tuple(got) == (True, None, True, False)


def test_malformed_lines_zip_and_silent_load(spark, tmp_path):
    import io
    import zipfile

    line = f"{u('a')} {u('p')} {u('b')} .\n"
    (tmp_path / "x.nq").write_text(line + "\n# note\nbroken\n" + f'"lit" {u("p")} {u("o")} .\n')
    assert sorted(r["value"] for r in nquads.malformed(spark, f"file://{tmp_path}/x.nq").collect()) == [f'"lit" {u("p")} {u("o")} .', "broken"]
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in.nq", line.replace("urn:a", "urn:c"))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.nq", line)
        z.writestr("deep.zip", inner.getvalue())
    (tmp_path / "x.zip").write_bytes(outer.getvalue())
    assert triples(nquads.read_zipped(spark, f"file://{tmp_path}/x.zip")) == {(u("a"), u("p"), u("b")), (u("c"), u("p"), u("b"))}
    store = Store(spark)
    store.load_file(f"file://{tmp_path}/x.nq", G)
    with pytest.warns(UserWarning, match="not loaded"):
        store.load_file(f"file://{tmp_path}/missing.nq", silent=True)
    assert store.size() == 1
    store.set_namespace("ex", "urn:")
    assert store.get_namespace("ex") == "urn:" and store.get_namespace("no") is None
    store.clear_namespaces()
    assert not store.namespaces


def test_digest_tells_conditions_and_plans_apart():
    def made(limit, plan=None):
        return Ruleset("r", (Rule("a", (("?x", u("q"), "?y"),), (("?x", u("p"), "?y"),), where=lambda c: c("y") > limit),), plan)

    assert made(1).digest() == made(1).digest()
    assert len({made(1).digest(), made(2).digest(), made(1, Eval(("a",))).digest(), made(1, Eval(())).digest()}) == 4


def test_task_parameters_by_expression(spark):
    quads = q(spark, (u("a"), u("p"), u("b")))
    rules = Ruleset("r", (Rule("a", (("?x", "?prop", "?y"),), (("?x", u("p"), "?y"),)),), With({"base": lambda v: "urn:q", "prop": lambda v: f"<{v['base']}{v['n']}>"}, Eval()), {"n": "7", "prop": None, "base": None})
    assert triples(closure(rules, quads, prop="", base="")) == {(u("a"), u("q7"), u("b"))}


def test_nquads_round_trip_and_bad_lines(spark, tmp_path):
    quads = pat.values(spark, list("spog"), [(u("a"), u("p"), '"x\\"y \\\\ . z"@en', G), (u("a"), u("p"), '"5"^^' + t.xsd("integer"), G)])
    path = f"file://{tmp_path}/nq"
    nquads.write_nquads(quads, path)
    spark.createDataFrame([("# note",), ("broken line .",), (f"_:n1 {u('p')} _:n2 .",), (f'"lit" {u("p")} {u("o")} .',)], "value string").write.mode("append").text(path)
    back = nquads.read_nquads(spark, path, graph=u("default"))
    assert triples(back) == triples(quads) | {("<urn:bnode:n1>", u("p"), "<urn:bnode:n2>")}
    assert {r["g"] for r in back.collect()} == {G, u("default")}


def test_rules_need_bound_heads_and_parameters():
    with pytest.raises(ValueError):
        Ruleset("bad", (Rule("r", (("?x", u("p"), "?y"),), (("?x", u("p"), "?z"),)),))
    with pytest.raises(ValueError):
        Ruleset("twice", (Rule("r", (("?x", u("p"), "?x"),), (("?x", u("p"), "?z"),)),) * 2)


def test_missing_parameter(spark):
    rules = Ruleset("p", (Rule("r", (("?x", u("is"), "?v"),), (("?x", u("p"), "?v"),)),), Eval(), {"v": None})
    with pytest.raises(ValueError):
        Closure(rules, q(spark, (u("a"), u("p"), u("b"))))


def test_predicates_can_be_parameters(spark):
    """No rule names the predicate as a constant, so the first look at the quads does not ask for it."""
    rule = Rule("r", (("?x", u("is"), u("v")),), (("?x", "?prop", "?y"), ("?y", u("q"), "?z")))
    quads = q(spark, (u("a"), u("p"), u("b")), (u("b"), u("q"), u("c")), (u("d"), u("p2"), u("b")))
    once = Ruleset("p", (rule,), Eval(), {"prop": None})
    assert triples(closure(once, quads, prop=u("p"))) == {(u("a"), u("is"), u("v"))}
    each = Repeat(lambda d: pat.values(spark, ["prop"], [(u("p"),), (u("p2"),), (u("none"),)]), Eval())
    assert triples(closure(Ruleset("r", (rule,), each, {"prop": u("none")}), quads)) == {(u("a"), u("is"), u("v")), (u("d"), u("is"), u("v"))}


def test_literal_subjects_are_dropped(spark):
    found = closure(R.rdfs_ruleset(), q(spark, (u("p"), R.RANGE, u("C")), (u("a"), u("p"), '"text"'), (u("a"), u("p"), u("b"))), full="false", axioms="false")
    got = triples(found)
    assert (u("b"), R.TYPE, u("C")) in got and not any(s.startswith('"') for s, _, _ in got)


def test_genuine_negation(spark):
    rules = Ruleset("n", (Rule("r", (("?x", u("root"), u("yes")),), (("?x", u("p"), "?y"),), unless=(("?z", u("p"), "?x"),)),), Eval())
    assert triples(closure(rules, q(spark, (u("a"), u("p"), u("b")), (u("b"), u("p"), u("c"))))) == {(u("a"), u("root"), u("yes"))}


@pytest.mark.parametrize("axioms", ["false", "true"])
def test_rdfs_closure_is_idempotent(spark, axioms):
    base = q(spark, (u("A"), R.SUBCLASS, u("B")), (u("B"), R.SUBCLASS, u("C")), (u("C"), R.SUBCLASS, u("A")), (u("x"), R.TYPE, u("A")))
    first = closure(R.rdfs_ruleset(), base, axioms=axioms)
    got = triples(first)
    assert {(u("x"), R.TYPE, u(c)) for c in "BC"} <= got
    assert closure(R.rdfs_ruleset(), base.unionByName(first), axioms=axioms).count() == 0


def owl_closure(spark, *facts):
    return triples(closure(R.owl2rl_ruleset(), q(spark, *facts), axioms="false"))


def cells(name, *members):
    out = []
    for i, m in enumerate(members):
        out += [(f"_:{name}{i}", R.FIRST, m), (f"_:{name}{i}", R.REST, f"_:{name}{i + 1}" if i + 1 < len(members) else R.NIL)]
    return out


def test_owl_properties(spark):
    o = t.owl
    got = owl_closure(
        spark,
        (u("anc"), R.TYPE, o("TransitiveProperty")), (u("a"), u("anc"), u("b")), (u("b"), u("anc"), u("c")),
        (u("near"), R.TYPE, o("SymmetricProperty")), (u("a"), u("near"), u("d")),
        (u("child"), o("inverseOf"), u("parent")), (u("k"), u("child"), u("m")),
        (u("grand"), o("propertyChainAxiom"), "_:g0"), *cells("g", u("anc"), u("near"), u("parent")),
        (u("d"), u("parent"), u("z")), (u("y"), u("anc"), u("a")),
        (u("mail"), R.TYPE, o("InverseFunctionalProperty")), (u("p1"), u("mail"), u("e")), (u("p2"), u("mail"), u("e")), (u("p1"), u("likes"), u("t")),
    )
    for want in [(u("a"), u("anc"), u("c")), (u("d"), u("near"), u("a")), (u("m"), u("parent"), u("k")), (u("y"), u("grand"), u("z")), (u("p2"), R.SAME, u("p1")), (u("p2"), u("likes"), u("t"))]:
        assert want in got, want


def test_owl_classes(spark):
    o = t.owl
    one = f'"1"^^{t.xsd("nonNegativeInteger")}'
    got = owl_closure(
        spark,
        (u("Both"), o("intersectionOf"), "_:i0"), *cells("i", u("A"), u("B"), u("C")), *((u("x"), R.TYPE, u(c)) for c in "ABC"), (u("w"), R.TYPE, u("A")), (u("v"), R.TYPE, u("Both")),
        (u("Either"), o("unionOf"), "_:u0"), *cells("u", u("A"), u("D")), (u("Few"), o("oneOf"), "_:f0"), *cells("f", u("f1"), u("f2")),
        (u("R"), o("someValuesFrom"), u("A")), (u("R"), R.ON_PROPERTY, u("has")), (u("h"), u("has"), u("w")),
        (u("V"), o("hasValue"), u("red")), (u("V"), R.ON_PROPERTY, u("color")), (u("c1"), R.TYPE, u("V")), (u("c2"), u("color"), u("red")),
        (u("All"), o("allValuesFrom"), u("E")), (u("All"), R.ON_PROPERTY, u("eats")), (u("an"), R.TYPE, u("All")), (u("an"), u("eats"), u("food")),
        (u("M"), o("maxCardinality"), one), (u("M"), R.ON_PROPERTY, u("mother")), (u("kid"), R.TYPE, u("M")), (u("kid"), u("mother"), u("ma")), (u("kid"), u("mother"), u("mum")),
        (u("Person"), o("hasKey"), "_:k0"), *cells("k", u("first"), u("last")), *((u(x), R.TYPE, u("Person")) for x in ("j1", "j2", "j3")),
        *((u(x), u("first"), '"J"') for x in ("j1", "j2", "j3")), (u("j1"), u("last"), '"D"'), (u("j2"), u("last"), '"D"'), (u("j3"), u("last"), '"E"'),
    )
    wanted = [
        (u("x"), R.TYPE, u("Both")), (u("v"), R.TYPE, u("B")), (u("w"), R.TYPE, u("Either")), (u("f2"), R.TYPE, u("Few")), (u("h"), R.TYPE, u("R")), (u("c1"), u("color"), u("red")), (u("c2"), R.TYPE, u("V")),
        (u("food"), R.TYPE, u("E")), (u("ma"), R.SAME, u("mum")), (u("j1"), R.SAME, u("j2")),
    ]
    for want in wanted:
        assert want in got, want
    assert (u("w"), R.TYPE, u("Both")) not in got and (u("j1"), R.SAME, u("j3")) not in got


def test_owl_violations(spark):
    o = t.owl
    zero = f'"0"^^{t.xsd("nonNegativeInteger")}'
    got = owl_closure(
        spark,
        (u("A"), o("disjointWith"), u("B")), (u("x"), R.TYPE, u("A")), (u("x"), R.TYPE, u("B")), (u("n"), R.TYPE, R.NOTHING),
        (u("ir"), R.TYPE, o("IrreflexiveProperty")), (u("x"), u("ir"), u("x")), (u("as"), R.TYPE, o("AsymmetricProperty")), (u("a"), u("as"), u("b")), (u("b"), u("as"), u("a")),
        (u("s"), R.SAME, u("d")), (u("d"), R.DIFFERENT, u("s")), (u("Z"), o("maxCardinality"), zero), (u("Z"), R.ON_PROPERTY, u("no")), (u("z"), R.TYPE, u("Z")), (u("z"), u("no"), u("y")),
        ("_:adc", R.TYPE, o("AllDisjointClasses")), ("_:adc", o("members"), "_:m0"), *cells("m", u("P"), u("Q")), (u("pq"), R.TYPE, u("P")), (u("pq"), R.TYPE, u("Q")),
    )
    told = {x for _, p, x in got if p == t.rdfs("label")}
    for name in ("disjointWith", "Nothing", "IrreflexiveProperty", "AsymmetricProperty", "differentFrom", "maxCardinality 0", "AllDisjointClasses"):
        assert f'"owl:{name} violated"' in told, name


def test_strongly_connected(spark):
    edges = pat.values(spark, ["src", "dest"], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", None), ("g", "a")])
    got = {r["node"]: r["comp"] for r in strongly_connected(edges, "c:").collect()}
    assert got == {"a": "c:a", "b": "c:a", "c": "c:a", "d": "c:d", "e": "c:d", "f": "c:f", "g": "c:g"}


def test_components_of_a_random_graph(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)}
    reach = {i: {i} for i in range(60)}
    for _ in range(60):
        for a, b in edges:
            reach[a] |= reach[b]
    name = lambda i: f"n{i:02d}"
    want = {name(i): name(min(j for j in reach[i] if i in reach[j])) for i in {x for e in edges for x in e}}
    got = {r["node"]: r["comp"] for r in strongly_connected(pat.values(spark, ["src", "dest"], [(name(a), name(b)) for a, b in edges])).collect()}
    assert got == want and len(set(want.values())) < len(want) - 3


def test_chains_are_contracted_before_colours(spark, monkeypatch):
    """Rings are found in a logarithm of their length, with no colour spread; an open chain follows its first node."""
    from quadrille.plans import transforms

    tables = []
    monkeypatch.setattr(transforms, "written", lambda df, name="table": tables.append(name) or written(df, name))
    ring = lambda x, n: [(f"{x}{i:02d}", f"{x}{(i + 1) % n:02d}") for i in range(n)]
    rings = ring("p", 40) + ring("q", 2) + [("p07", "dead"), ("source", "q00"), ("q01", "q00"), ("self", "self")]
    got = {r["node"]: r["comp"] for r in strongly_connected(pat.values(spark, ["src", "dest"], rings)).collect()}
    assert got == {x: x if len(x) > 3 else x[0] + "00" for x in {x for e in rings for x in e}}
    assert "colours" not in tables and len(tables) < 80
    # Two rings through h share no other node; a chain from one ring to the next lies in neither.
    chains = [("h", "a1"), ("a1", "a2"), ("a2", "a3"), ("a3", "h"), ("h", "b1"), ("b1", "b2"), ("b2", "h"), ("h", "c1"), ("c1", "c2"), ("c2", "k"), ("k", "d1"), ("d1", "k"), ("d1", "d2"), ("d2", "k")]
    got = {r["node"]: r["comp"] for r in strongly_connected(pat.values(spark, ["src", "dest"], chains)).collect()}
    assert got == {**dict.fromkeys(("h", "a1", "a2", "a3", "b1", "b2"), "a1"), "c1": "c1", "c2": "c2", **dict.fromkeys(("k", "d1", "d2"), "d1")}


def test_nodes_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from quadrille.plans import transforms

    monkeypatch.setattr(transforms, "_number", lambda name, seed: F.xxhash64(F.col(name), F.lit(seed)) % (2 if seed == 0 else 1 << 40))
    edges = pat.values(spark, ["src", "dest"], [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c")])
    assert {r["node"]: r["comp"] for r in strongly_connected(edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def rules():
    return Ruleset("sub", tuple(r for r in R.rdfs_rules() if r.name == "rdfs9"))


def test_store_status_modes_and_guard(spark, tmp_path):
    store = Store(spark, rules())
    store.add(q(spark, (u("A"), R.SUBCLASS, u("B")), (u("x"), R.TYPE, u("A"))))
    store.add(q(spark, (u("y"), R.TYPE, u("A")), g="<urn:inf:main>"))  # dropped: only rules write there
    assert store.status is Status.POSSIBLY_INCOMPLETE and store.size(inferred=False) == 2
    assert store.has(u("x"), R.TYPE, u("B")) and not store.has(u("x"), R.TYPE, u("B"), inferred=False)
    assert store.status is Status.CURRENT
    store.add(q(spark, (u("z"), R.TYPE, u("A"))))
    assert store.status is Status.POSSIBLY_INCOMPLETE and store.has(u("z"), R.TYPE, u("B"))
    store.remove(q(spark, (u("x"), R.TYPE, u("A"))))
    assert store.status is Status.STALE and not store.has(u("x")) and store.has(u("z"), R.TYPE, u("B"))
    path = f"file://{tmp_path}/store"
    store.save(path)
    again = Store(spark, rules())
    again.load(path)
    assert again.status is Status.CURRENT and triples(again.read()) == triples(store.read())
    store.read_only = True
    with pytest.raises(PermissionError):
        store.clear()


def test_stream(spark, tmp_path):
    quads = q(spark, (u("A"), R.SUBCLASS, u("B")), (u("x"), R.TYPE, u("A")))
    quads.write.parquet(f"file://{tmp_path}/in")
    store = Store(spark, rules())
    stream = spark.readStream.schema(quads.schema).parquet(f"file://{tmp_path}/in")
    ingest(stream, store, f"file://{tmp_path}/check").awaitTermination(120)
    assert store.status is Status.CURRENT and store.has(u("x"), R.TYPE, u("B"))


def test_star_is_the_join_of_its_patterns(spark):
    from quadrille.sources.relational import TableMap, predicate, star, table_quads

    df = spark.createDataFrame([(1, "a", 7), (2, None, 8), (3, "c", None)], "k long, name string, up long")
    m = TableMap("t", ("k",), {"up": "u"})
    joined = pat.bgp(table_quads(df, m), [("?x", predicate("name"), "?n"), ("?x", predicate("up"), "?u")])
    got = star(df, m, "x", {"n": "name", "u": "up"})
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in joined.select("x", "n", "u").collect()] == [("<urn:t:t/1>", '"a"', "<urn:t:u/7>")]


@pytest.mark.parametrize("most, joins", [(0, False), (100, True)])
def test_closures_broadcast_only_sides_that_were_counted(spark, monkeypatch, most, joins):
    """Files that Spark takes for small are not broadcast beyond what a round may broadcast in all."""
    from quadrille.plans import rules as module

    plans = []

    def kept(df, name="table"):
        if name == "inferred":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df, name)

    monkeypatch.setattr(module, "written", kept)
    monkeypatch.setattr(module, "affordable", lambda sides: most, raising=False)
    data = q(spark, (u("a"), R.TYPE, u("A")), (u("A"), R.SUBCLASS, u("B")), (u("B"), R.SUBCLASS, u("C")))
    rules = Ruleset("sub", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs9", "rdfs11")))
    got = triples(closure(rules, data))
    assert got == {(u("a"), R.TYPE, u("B")), (u("a"), R.TYPE, u("C")), (u("A"), R.SUBCLASS, u("C"))}
    assert any("Join" in p for p in plans) and any("BroadcastHashJoin" in p for p in plans) == joins


def test_broadcast_sides_of_a_round_keep_within_one_budget():
    assert affordable([], 10) == 0 and affordable([3, 50, 7], 10) == 7 and affordable([6, 6], 10) == 5 and affordable([11], 10) == 0


def test_a_deleted_pattern_is_filtered_and_additions_are_not_hashed_before_the_shuffle(spark):
    from quadrille.operators import graphs as G_

    quads = q(spark, (u("a"), u("p"), u("x")), (u("b"), u("p"), u("b")), (u("a"), u("r"), u("x")), ('"l"', u("p"), u("y")))
    quads = quads.unionByName(q(spark, (u("a"), u("q"), u("x")), g=u("to"))).unionByName(q(spark, (u("a"), u("p"), u("x")), g="<urn:g:2>"))
    for at in (("?s", u("p"), "?o", "?g"), ("?s", u("p"), "?s", "?g")):
        insert = [("?s", u("q"), "?o" if at[2] == "?o" else "?s", u("to"))]
        got = G_.modify(quads, [at], [at], insert)
        want = G_.modify(quads, lambda x: pat.match(x, at), [at], insert)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert got.where("s = '<urn:b>' and p = '<urn:p>'").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_rounds_hash_what_they_find(spark, monkeypatch):
    """Sets of rules and graphs are of fixed width: no round sorts all that its rules state before it is made distinct."""
    from quadrille.plans import rules as module

    plans = []

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df, name)

    monkeypatch.setattr(module, "written", kept)
    data = q(spark, (u("a"), u("p"), u("b")), (u("p"), R.DOMAIN, u("A")), (u("p"), R.RANGE, u("B")))
    rules = Ruleset("domain-range", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs2", "rdfs3")))
    assert triples(closure(rules, data)) == {(u("a"), R.TYPE, u("A")), (u("b"), R.TYPE, u("B"))}
    assert plans and not any("ObjectHashAggregate" in p or "SortAggregate" in p for p in plans)


def test_rounds_run_in_lean_tasks(spark, monkeypatch):
    """Tasks of a closure take on so many bytes at most, whatever the input; the session's settings come back, smaller ones hold."""
    from quadrille.plans import rules as module

    keys, seen = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"), []

    def kept(df, name="table"):
        seen.append(tuple(int(spark.conf.get(k)) for k in keys))
        return written(df, name)

    monkeypatch.setattr(module, "written", kept)
    before = [spark.conf.get(k) for k in keys]
    rules = Ruleset("sub", tuple(r for r in R.rdfs_rules() if r.name == "rdfs9"))
    for given, most in (("64MB", 16 << 20), ("2048k", 2 << 20), ("1g", 16 << 20), ("5000000b", 5000000)):
        spark.conf.set(keys[1], given)
        seen.clear()
        assert triples(closure(rules, q(spark, (u("a"), R.TYPE, u("A")), (u("A"), R.SUBCLASS, u("B"))))) == {(u("a"), R.TYPE, u("B"))}
        assert seen and set(seen) == {(16 << 20, most)} and spark.conf.get(keys[1]) == given
    spark.conf.set(keys[1], before[1])
    assert [spark.conf.get(k) for k in keys] == before
