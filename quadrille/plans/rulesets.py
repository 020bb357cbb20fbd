"""Rulesets as data: RDFS entailment and the OWL 2 RL rules of the W3C profile, Tables 4 to 9.

Rules keep the names of the W3C tables. Lists (rdf:first/rest) are walked by auxiliary
rules that hand the class or property on from cell to cell. Constraint rules state an
Inconsistency node whose name is a hash of what it is about.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions.terms import bnode, is_literal, owl, rdf, rdfs, str_
from quadrille.plans.rules import Eval, Fixpoint, Rule, Ruleset, Sequence_, register

TYPE, FIRST, REST, NIL, PROPERTY = rdf("type"), rdf("first"), rdf("rest"), rdf("nil"), rdf("Property")
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = rdfs("subClassOf"), rdfs("subPropertyOf"), rdfs("domain"), rdfs("range")
CLASS, RESOURCE, DATATYPE, LITERAL, MEMBER, CMP = rdfs("Class"), rdfs("Resource"), rdfs("Datatype"), rdfs("Literal"), rdfs("member"), rdfs("ContainerMembershipProperty")
SAME, DIFFERENT, EQ_CLASS, EQ_PROPERTY = owl("sameAs"), owl("differentFrom"), owl("equivalentClass"), owl("equivalentProperty")
THING, NOTHING, ON_PROPERTY = owl("Thing"), owl("Nothing"), owl("onProperty")
INCONSISTENCY = "<urn:sys:Inconsistency>"


def ne(*names: str):
    """All named variables differ from each other."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def condition(c):
        out = F.lit(True)
        for a, b in pairs:
            out = out & (c(a) != c(b))
        return out

    return condition


def rule(name: str, head, *body, where=None, **more) -> Rule:
    heads = head if isinstance(head[0], tuple) else (head,)
    return Rule(name, tuple(heads), tuple(body), where, **more)


# --- RDFS -------------------------------------------------------------------------------

def axioms() -> tuple[tuple, tuple]:
    """(the RDF and RDFS axiomatic triples, those that only say Resource)."""
    terms = "type subject predicate object first rest value".split()
    core = [(rdf(x), TYPE, PROPERTY) for x in terms] + [(NIL, TYPE, rdf("List")), (rdf("_1"), TYPE, PROPERTY)]
    ranges = {
        TYPE: CLASS, DOMAIN: CLASS, RANGE: CLASS, SUBPROPERTY: PROPERTY, SUBCLASS: CLASS, rdf("rest"): rdf("List"),
        rdfs("comment"): LITERAL, rdfs("label"): LITERAL,
    }
    domains = {DOMAIN: PROPERTY, RANGE: PROPERTY, SUBPROPERTY: PROPERTY, SUBCLASS: CLASS, rdf("subject"): rdf("Statement"), rdf("predicate"): rdf("Statement"), rdf("object"): rdf("Statement"), FIRST: rdf("List"), REST: rdf("List")}
    subclasses = {rdf("Alt"): rdfs("Container"), rdf("Bag"): rdfs("Container"), rdf("Seq"): rdfs("Container"), CMP: PROPERTY, rdf("XMLLiteral"): LITERAL, DATATYPE: CLASS}
    core += [(p, RANGE, c) for p, c in ranges.items()] + [(p, DOMAIN, c) for p, c in domains.items()]
    core += [(a, SUBCLASS, b) for a, b in subclasses.items()] + [(rdfs("isDefinedBy"), SUBPROPERTY, rdfs("seeAlso")), (rdf("XMLLiteral"), TYPE, DATATYPE), (rdf("_1"), TYPE, CMP)]
    loose = [(p, DOMAIN, RESOURCE) for p in (TYPE, MEMBER, rdfs("seeAlso"), rdfs("isDefinedBy"), rdfs("comment"), rdfs("label"), rdf("value"), rdf("_1"))]
    loose += [(p, RANGE, RESOURCE) for p in (rdf("subject"), rdf("predicate"), rdf("object"), MEMBER, FIRST, rdfs("seeAlso"), rdfs("isDefinedBy"), rdf("value"), rdf("_1"))]
    return tuple(core), tuple(loose)


_FULL = lambda v: v.get("full", "true") == "true"
_AXIOMS = lambda v: v.get("axioms", "true") == "true"


def rdfs_rules() -> tuple[Rule, ...]:
    core, loose = axioms()
    return (
        Rule("axioms", core, when=_AXIOMS),
        Rule("axioms_full", loose, when=lambda v: _AXIOMS(v) and _FULL(v)),
        rule("rdf1", ("?p", TYPE, PROPERTY), ("?s", "?p", "?o")),
        rule("rdfs2", ("?s", TYPE, "?x"), ("?p", DOMAIN, "?x"), ("?s", "?p", "?o"), where=lambda c: c("x") != RESOURCE),
        rule("rdfs3", ("?o", TYPE, "?x"), ("?p", RANGE, "?x"), ("?s", "?p", "?o"), where=lambda c: (c("x") != RESOURCE) & ~is_literal(c("o"))),
        rule("rdfs4a", ("?s", TYPE, RESOURCE), ("?s", "?p", "?o"), when=_FULL),
        rule("rdfs4b", ("?o", TYPE, RESOURCE), ("?s", "?p", "?o"), where=lambda c: ~is_literal(c("o")), when=_FULL),
        rule("rdfs5", ("?p", SUBPROPERTY, "?r"), ("?p", SUBPROPERTY, "?q"), ("?q", SUBPROPERTY, "?r"), where=ne("p", "q", "r")),
        rule("rdfs6", ("?p", SUBPROPERTY, "?p"), ("?p", TYPE, PROPERTY)),
        rule("rdfs7", ("?s", "?q", "?o"), ("?p", SUBPROPERTY, "?q"), ("?s", "?p", "?o"), where=ne("p", "q")),
        rule("rdfs8", ("?s", SUBCLASS, RESOURCE), ("?s", TYPE, CLASS), when=_FULL),
        rule("rdfs9", ("?s", TYPE, "?y"), ("?x", SUBCLASS, "?y"), ("?s", TYPE, "?x"), where=lambda c: (c("x") != c("y")) & (c("y") != RESOURCE)),
        rule("rdfs10", ("?s", SUBCLASS, "?s"), ("?s", TYPE, CLASS)),
        rule("rdfs11", ("?x", SUBCLASS, "?z"), ("?x", SUBCLASS, "?y"), ("?y", SUBCLASS, "?z"), where=ne("x", "y", "z")),
        rule("rdfs12", ("?p", SUBPROPERTY, MEMBER), ("?p", TYPE, CMP)),
        rule("rdfs13", ("?o", SUBCLASS, LITERAL), ("?o", TYPE, DATATYPE)),
    )


def rdfs_ruleset() -> Ruleset:
    """Schema fixpoints come first, so that the data is passed over with a finished schema."""
    plan = Sequence_((Eval(("axioms", "axioms_full")), Fixpoint(Eval(("rdfs5", "rdfs11"))), Fixpoint(Eval())))
    return Ruleset("rdfs", rdfs_rules(), plan, {"full": "true", "axioms": "true"})


# --- OWL 2 RL ---------------------------------------------------------------------------

def violation(name: str, label: str, about: tuple[str, ...], *body, where=None) -> Rule:
    key = lambda c: bnode(F.concat_ws(" ", F.lit(label), *[c(a) for a in about]))
    head = (("?b", TYPE, INCONSISTENCY), ("?b", rdfs("label"), f'"{label} violated"'), *(("?b", rdfs("seeAlso"), f"?{a}") for a in about))
    return Rule(name, head, tuple(body), where, {"b": key})


def list_members(name: str, source: str, target: str, kind: str | None = None) -> tuple[Rule, ...]:
    """(x target m) for every member m of the list that (x source list) names, one cell at a time."""
    cell = f"<urn:sys:cell:{name}>"
    start = (("?x", TYPE, kind),) if kind else ()
    return (
        rule(f"{name}-start", ("?x", cell, "?l"), *start, ("?x", source, "?l")),
        rule(f"{name}-next", ("?x", cell, "?r"), ("?x", cell, "?l"), ("?l", REST, "?r"), where=lambda c: c("r") != NIL),
        rule(f"{name}-member", ("?x", target, "?m"), ("?x", cell, "?l"), ("?l", FIRST, "?m")),
    )


def equality_rules() -> tuple[Rule, ...]:
    return (
        rule("eq-sym", ("?y", SAME, "?x"), ("?x", SAME, "?y"), where=ne("x", "y")),
        rule("eq-trans", ("?x", SAME, "?z"), ("?x", SAME, "?y"), ("?y", SAME, "?z"), where=ne("x", "y", "z")),
        rule("eq-rep-s", ("?s2", "?p", "?o"), ("?s1", SAME, "?s2"), ("?s1", "?p", "?o"), where=ne("s1", "s2")),
        rule("eq-rep-p", ("?s", "?p2", "?o"), ("?p1", SAME, "?p2"), ("?s", "?p1", "?o"), where=ne("p1", "p2")),
        rule("eq-rep-o", ("?s", "?p", "?o2"), ("?o1", SAME, "?o2"), ("?s", "?p", "?o1"), where=ne("o1", "o2")),
        violation("eq-diff1", "owl:differentFrom", ("x", "y"), ("?x", SAME, "?y"), ("?x", DIFFERENT, "?y"), where=lambda c: str_(c("x")) < str_(c("y"))),
        *list_members("diff-members", owl("members"), "<urn:sys:distinctMember>", owl("AllDifferent")),
        *list_members("diff-distinct", owl("distinctMembers"), "<urn:sys:distinctMember>", owl("AllDifferent")),
        violation("eq-diff23", "owl:AllDifferent", ("i1", "i2"), ("?x", "<urn:sys:distinctMember>", "?i1"), ("?x", "<urn:sys:distinctMember>", "?i2"), ("?i1", SAME, "?i2"), where=lambda c: str_(c("i1")) < str_(c("i2"))),
    )


def reflexive_rules() -> tuple[Rule, ...]:
    """eq-ref, which triples every term; on by the parameter reflexive."""
    on = lambda v: v.get("reflexive", "false") == "true"
    return tuple(rule(f"eq-ref-{x}", (f"?{x}", SAME, f"?{x}"), ("?s", "?p", "?o"), when=on) for x in "spo")


def property_rules() -> tuple[Rule, ...]:
    chain1, chain2 = "<urn:sys:chainFirst>", "<urn:sys:chainRest>"
    return (
        rule("prp-dom", ("?x", TYPE, "?c"), ("?p", DOMAIN, "?c"), ("?x", "?p", "?y")),
        rule("prp-rng", ("?y", TYPE, "?c"), ("?p", RANGE, "?c"), ("?x", "?p", "?y")),
        rule("prp-fp", ("?y1", SAME, "?y2"), ("?p", TYPE, owl("FunctionalProperty")), ("?x", "?p", "?y1"), ("?x", "?p", "?y2"), where=ne("y1", "y2")),
        rule("prp-ifp", ("?x1", SAME, "?x2"), ("?p", TYPE, owl("InverseFunctionalProperty")), ("?x1", "?p", "?y"), ("?x2", "?p", "?y"), where=ne("x1", "x2")),
        rule("prp-symp", ("?y", "?p", "?x"), ("?p", TYPE, owl("SymmetricProperty")), ("?x", "?p", "?y")),
        rule("prp-trp", ("?x", "?p", "?z"), ("?p", TYPE, owl("TransitiveProperty")), ("?x", "?p", "?y"), ("?y", "?p", "?z")),
        rule("prp-spo1", ("?x", "?q", "?y"), ("?p", SUBPROPERTY, "?q"), ("?x", "?p", "?y"), where=ne("p", "q")),
        rule("prp-eqp1", ("?x", "?q", "?y"), ("?p", EQ_PROPERTY, "?q"), ("?x", "?p", "?y"), where=ne("p", "q")),
        rule("prp-eqp2", ("?x", "?p", "?y"), ("?p", EQ_PROPERTY, "?q"), ("?x", "?q", "?y"), where=ne("p", "q")),
        rule("prp-inv1", ("?y", "?q", "?x"), ("?p", owl("inverseOf"), "?q"), ("?x", "?p", "?y")),
        rule("prp-inv2", ("?y", "?p", "?x"), ("?p", owl("inverseOf"), "?q"), ("?x", "?q", "?y")),
        # A chain of n properties is its first one and a property of the rest, named after the list cell.
        rule("chain-one", ("?p1", SUBPROPERTY, "?p"), ("?p", owl("propertyChainAxiom"), "?l"), ("?l", FIRST, "?p1"), ("?l", REST, NIL)),
        Rule(
            "chain-split", (("?p", chain1, "?u0"), ("?u0", chain1, "?p1"), ("?u0", chain2, "?u"), ("?u", owl("propertyChainAxiom"), "?r")),
            (("?p", owl("propertyChainAxiom"), "?l"), ("?l", FIRST, "?p1"), ("?l", REST, "?r")), lambda c: c("r") != NIL,
            {"u": lambda c: F.concat(F.lit("<urn:sys:chain:"), F.md5(c("r")), F.lit(">")), "u0": lambda c: F.concat(F.lit("<urn:sys:split:"), F.md5(c("l")), F.lit(">"))},
        ),
        rule("prp-spo2", ("?x", "?p", "?z"), ("?p", chain1, "?u0"), ("?u0", chain2, "?u"), ("?u0", chain1, "?p1"), ("?x", "?p1", "?y"), ("?y", "?u", "?z")),
        violation("prp-irp", "owl:IrreflexiveProperty", ("x", "p"), ("?p", TYPE, owl("IrreflexiveProperty")), ("?x", "?p", "?x")),
        violation("prp-asyp", "owl:AsymmetricProperty", ("x", "y", "p"), ("?p", TYPE, owl("AsymmetricProperty")), ("?x", "?p", "?y"), ("?y", "?p", "?x"), where=lambda c: str_(c("x")) <= str_(c("y"))),
        violation("prp-pdw", "owl:propertyDisjointWith", ("x", "y", "p1", "p2"), ("?p1", owl("propertyDisjointWith"), "?p2"), ("?x", "?p1", "?y"), ("?x", "?p2", "?y")),
        *list_members("adp", owl("members"), "<urn:sys:disjointProperty>", owl("AllDisjointProperties")),
        violation("prp-adp", "owl:AllDisjointProperties", ("x", "y", "p1", "p2"), ("?d", "<urn:sys:disjointProperty>", "?p1"), ("?d", "<urn:sys:disjointProperty>", "?p2"), ("?x", "?p1", "?y"), ("?x", "?p2", "?y"), where=lambda c: str_(c("p1")) < str_(c("p2"))),
        violation("prp-npa1", "owl:NegativePropertyAssertion", ("s", "p", "o"), ("?x", owl("sourceIndividual"), "?s"), ("?x", owl("assertionProperty"), "?p"), ("?x", owl("targetIndividual"), "?o"), ("?s", "?p", "?o")),
        violation("prp-npa2", "owl:NegativePropertyAssertion", ("s", "p", "o"), ("?x", owl("sourceIndividual"), "?s"), ("?x", owl("assertionProperty"), "?p"), ("?x", owl("targetValue"), "?o"), ("?s", "?p", "?o")),
    ) + key_rules()


def key_rules() -> tuple[Rule, ...]:
    """Keys of any length: two members of a class that agree on each property of the list, cell by cell."""
    agree = "<urn:sys:keyAgree:"
    pair = lambda c: F.concat(F.lit(agree), F.md5(F.concat_ws(" ", c("x"), c("y"), c("k"))), F.lit(">"))
    at, one, other = "<urn:sys:keyAt>", "<urn:sys:keyOne>", "<urn:sys:keyOther>"
    return (
        Rule(
            "prp-key-start", (("?b", one, "?x"), ("?b", other, "?y"), ("?b", at, "?r")),
            (("?c", owl("hasKey"), "?k"), ("?k", FIRST, "?p"), ("?k", REST, "?r"), ("?x", TYPE, "?c"), ("?y", TYPE, "?c"), ("?x", "?p", "?v"), ("?y", "?p", "?v")), lambda c: c("x") < c("y"), {"b": pair},
        ),
        rule("prp-key-next", ("?b", at, "?r"), ("?b", at, "?l"), ("?l", FIRST, "?p"), ("?l", REST, "?r"), ("?b", one, "?x"), ("?b", other, "?y"), ("?x", "?p", "?v"), ("?y", "?p", "?v")),
        rule("prp-key", ("?x", SAME, "?y"), ("?b", at, NIL), ("?b", one, "?x"), ("?b", other, "?y")),
    )


def class_rules() -> tuple[Rule, ...]:
    some, all_, has, on = owl("someValuesFrom"), owl("allValuesFrom"), owl("hasValue"), ON_PROPERTY
    zero = [f'"0"^^<http://www.w3.org/2001/XMLSchema#{t}>' for t in ("nonNegativeInteger", "integer")]
    one = [f'"1"^^<http://www.w3.org/2001/XMLSchema#{t}>' for t in ("nonNegativeInteger", "integer")]
    at, member = "<urn:sys:partAt>", "<urn:sys:partOf>"
    part = lambda c: F.concat(F.lit("<urn:sys:part:"), F.md5(F.concat_ws(" ", c("x"), c("c"))), F.lit(">"))
    return (
        # An individual is in an intersection once it has been found in the class of every cell.
        Rule("cls-int1-start", (("?b", member, "?c"), ("?b", "<urn:sys:partWho>", "?x"), ("?b", at, "?r")), (("?c", owl("intersectionOf"), "?l"), ("?l", FIRST, "?c1"), ("?l", REST, "?r"), ("?x", TYPE, "?c1")), None, {"b": part}),
        rule("cls-int1-next", ("?b", at, "?r"), ("?b", at, "?l"), ("?l", FIRST, "?c1"), ("?l", REST, "?r"), ("?b", "<urn:sys:partWho>", "?x"), ("?x", TYPE, "?c1")),
        rule("cls-int1", ("?x", TYPE, "?c"), ("?b", at, NIL), ("?b", member, "?c"), ("?b", "<urn:sys:partWho>", "?x")),
        *list_members("int", owl("intersectionOf"), SUBCLASS),  # cls-int2 and scm-int
        *list_members("uni", owl("unionOf"), "<urn:sys:unionMember>"),
        rule("cls-uni", ("?m", SUBCLASS, "?c"), ("?c", "<urn:sys:unionMember>", "?m")),  # and scm-uni
        *list_members("one-of", owl("oneOf"), "<urn:sys:oneOfMember>"),
        rule("cls-oo", ("?m", TYPE, "?c"), ("?c", "<urn:sys:oneOfMember>", "?m")),
        violation("cls-com", "owl:complementOf", ("x", "c1", "c2"), ("?c1", owl("complementOf"), "?c2"), ("?x", TYPE, "?c1"), ("?x", TYPE, "?c2")),
        violation("cls-nothing2", "owl:Nothing", ("x",), ("?x", TYPE, NOTHING)),
        rule("cls-svf1", ("?u", TYPE, "?r"), ("?r", some, "?c"), ("?r", on, "?p"), ("?u", "?p", "?v"), ("?v", TYPE, "?c")),
        rule("cls-svf2", ("?u", TYPE, "?r"), ("?r", some, THING), ("?r", on, "?p"), ("?u", "?p", "?v")),
        rule("cls-avf", ("?v", TYPE, "?c"), ("?r", all_, "?c"), ("?r", on, "?p"), ("?u", TYPE, "?r"), ("?u", "?p", "?v")),
        rule("cls-hv1", ("?u", "?p", "?v"), ("?r", has, "?v"), ("?r", on, "?p"), ("?u", TYPE, "?r")),
        rule("cls-hv2", ("?u", TYPE, "?r"), ("?r", has, "?v"), ("?r", on, "?p"), ("?u", "?p", "?v")),
        violation("cls-maxc1", "owl:maxCardinality 0", ("u", "p"), ("?r", owl("maxCardinality"), "?n"), ("?r", on, "?p"), ("?u", TYPE, "?r"), ("?u", "?p", "?y"), where=lambda c: c("n").isin(zero)),
        rule("cls-maxc2", ("?y1", SAME, "?y2"), ("?r", owl("maxCardinality"), "?n"), ("?r", on, "?p"), ("?u", TYPE, "?r"), ("?u", "?p", "?y1"), ("?u", "?p", "?y2"), where=lambda c: c("n").isin(one) & (c("y1") != c("y2"))),
        violation("cls-maxqc1", "owl:maxQualifiedCardinality 0", ("u", "p", "c"), ("?r", owl("maxQualifiedCardinality"), "?n"), ("?r", on, "?p"), ("?r", owl("onClass"), "?c"), ("?u", TYPE, "?r"), ("?u", "?p", "?y"), ("?y", TYPE, "?c"), where=lambda c: c("n").isin(zero)),
        violation("cls-maxqc2", "owl:maxQualifiedCardinality 0", ("u", "p"), ("?r", owl("maxQualifiedCardinality"), "?n"), ("?r", on, "?p"), ("?r", owl("onClass"), THING), ("?u", TYPE, "?r"), ("?u", "?p", "?y"), where=lambda c: c("n").isin(zero)),
        rule("cls-maxqc3", ("?y1", SAME, "?y2"), ("?r", owl("maxQualifiedCardinality"), "?n"), ("?r", on, "?p"), ("?r", owl("onClass"), "?c"), ("?u", TYPE, "?r"), ("?u", "?p", "?y1"), ("?u", "?p", "?y2"), ("?y1", TYPE, "?c"), ("?y2", TYPE, "?c"), where=lambda c: c("n").isin(one) & (c("y1") != c("y2"))),
        rule("cls-maxqc4", ("?y1", SAME, "?y2"), ("?r", owl("maxQualifiedCardinality"), "?n"), ("?r", on, "?p"), ("?r", owl("onClass"), THING), ("?u", TYPE, "?r"), ("?u", "?p", "?y1"), ("?u", "?p", "?y2"), where=lambda c: c("n").isin(one) & (c("y1") != c("y2"))),
        rule("cax-sco", ("?x", TYPE, "?d"), ("?c", SUBCLASS, "?d"), ("?x", TYPE, "?c"), where=ne("c", "d")),
        rule("cax-eqc1", ("?x", TYPE, "?d"), ("?c", EQ_CLASS, "?d"), ("?x", TYPE, "?c"), where=ne("c", "d")),
        rule("cax-eqc2", ("?x", TYPE, "?c"), ("?c", EQ_CLASS, "?d"), ("?x", TYPE, "?d"), where=ne("c", "d")),
        violation("cax-dw", "owl:disjointWith", ("x", "c1", "c2"), ("?c1", owl("disjointWith"), "?c2"), ("?x", TYPE, "?c1"), ("?x", TYPE, "?c2")),
        *list_members("adc", owl("members"), "<urn:sys:disjointClass>", owl("AllDisjointClasses")),
        violation("cax-adc", "owl:AllDisjointClasses", ("x", "c1", "c2"), ("?d", "<urn:sys:disjointClass>", "?c1"), ("?d", "<urn:sys:disjointClass>", "?c2"), ("?x", TYPE, "?c1"), ("?x", TYPE, "?c2"), where=lambda c: str_(c("c1")) < str_(c("c2"))),
    )


def schema_rules() -> tuple[Rule, ...]:
    some, all_, has, on = owl("someValuesFrom"), owl("allValuesFrom"), owl("hasValue"), ON_PROPERTY
    both = lambda n, k, head, *body: rule(n, head, ("?r1", k, "?t1"), ("?r1", on, "?p1"), *body, where=ne("r1", "r2"))
    return (
        rule("scm-cls", (("?c", SUBCLASS, "?c"), ("?c", EQ_CLASS, "?c"), ("?c", SUBCLASS, THING), (NOTHING, SUBCLASS, "?c")), ("?c", TYPE, owl("Class"))),
        rule("scm-op", (("?p", SUBPROPERTY, "?p"), ("?p", EQ_PROPERTY, "?p")), ("?p", TYPE, owl("ObjectProperty"))),
        rule("scm-dp", (("?p", SUBPROPERTY, "?p"), ("?p", EQ_PROPERTY, "?p")), ("?p", TYPE, owl("DatatypeProperty"))),
        rule("scm-sco", ("?c", SUBCLASS, "?e"), ("?c", SUBCLASS, "?d"), ("?d", SUBCLASS, "?e"), where=ne("c", "d", "e")),
        rule("scm-eqc1", (("?c", SUBCLASS, "?d"), ("?d", SUBCLASS, "?c")), ("?c", EQ_CLASS, "?d"), where=ne("c", "d")),
        rule("scm-eqc2", ("?c", EQ_CLASS, "?d"), ("?c", SUBCLASS, "?d"), ("?d", SUBCLASS, "?c"), where=ne("c", "d")),
        rule("scm-spo", ("?p", SUBPROPERTY, "?r"), ("?p", SUBPROPERTY, "?q"), ("?q", SUBPROPERTY, "?r"), where=ne("p", "q", "r")),
        rule("scm-eqp1", (("?p", SUBPROPERTY, "?q"), ("?q", SUBPROPERTY, "?p")), ("?p", EQ_PROPERTY, "?q"), where=ne("p", "q")),
        rule("scm-eqp2", ("?p", EQ_PROPERTY, "?q"), ("?p", SUBPROPERTY, "?q"), ("?q", SUBPROPERTY, "?p"), where=ne("p", "q")),
        rule("scm-dom1", ("?p", DOMAIN, "?d"), ("?p", DOMAIN, "?c"), ("?c", SUBCLASS, "?d"), where=ne("c", "d")),
        rule("scm-dom2", ("?p", DOMAIN, "?c"), ("?q", DOMAIN, "?c"), ("?p", SUBPROPERTY, "?q"), where=ne("p", "q")),
        rule("scm-rng1", ("?p", RANGE, "?d"), ("?p", RANGE, "?c"), ("?c", SUBCLASS, "?d"), where=ne("c", "d")),
        rule("scm-rng2", ("?p", RANGE, "?c"), ("?q", RANGE, "?c"), ("?p", SUBPROPERTY, "?q"), where=ne("p", "q")),
        both("scm-hv", has, ("?r1", SUBCLASS, "?r2"), ("?r2", has, "?t1"), ("?r2", on, "?p2"), ("?p1", SUBPROPERTY, "?p2")),
        both("scm-svf1", some, ("?r1", SUBCLASS, "?r2"), ("?r2", some, "?t2"), ("?r2", on, "?p1"), ("?t1", SUBCLASS, "?t2")),
        both("scm-svf2", some, ("?r1", SUBCLASS, "?r2"), ("?r2", some, "?t1"), ("?r2", on, "?p2"), ("?p1", SUBPROPERTY, "?p2")),
        both("scm-avf1", all_, ("?r1", SUBCLASS, "?r2"), ("?r2", all_, "?t2"), ("?r2", on, "?p1"), ("?t1", SUBCLASS, "?t2")),
        both("scm-avf2", all_, ("?r2", SUBCLASS, "?r1"), ("?r2", all_, "?t1"), ("?r2", on, "?p2"), ("?p1", SUBPROPERTY, "?p2")),
    )


def owl_axioms() -> Rule:
    notes = "label comment seeAlso isDefinedBy".split()
    head = [(THING, TYPE, owl("Class")), (NOTHING, TYPE, owl("Class"))] + [(rdfs(n), TYPE, owl("AnnotationProperty")) for n in notes]
    head += [(owl(n), TYPE, owl("AnnotationProperty")) for n in "deprecated versionInfo priorVersion backwardCompatibleWith incompatibleWith".split()]
    return Rule("owl-axioms", tuple(head), when=_AXIOMS)


def owl2rl_ruleset() -> Ruleset:
    rules = (owl_axioms(), *equality_rules(), *reflexive_rules(), *property_rules(), *class_rules(), *schema_rules())
    return Ruleset("owl2rl", rules, Sequence_((Eval(("owl-axioms",)), Fixpoint(Eval()))), {"axioms": "true", "reflexive": "false"})


register(rdfs_ruleset())
register(owl2rl_ruleset())
