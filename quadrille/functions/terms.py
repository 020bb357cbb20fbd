"""RDF terms as strings in canonical N-Triples form, and Column functions over them.

An IRI is ``<...>``, a blank node ``_:id``, a literal ``"text"``, ``"text"@lang`` or
``"text"^^<datatype>``; plain and xsd:string literals coincide. Equal terms are equal
strings, so patterns join by plain equality. Type errors give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

NUMERIC = ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def rdf(name: str) -> str:
    return f"<{RDF}{name}>"


def rdfs(name: str) -> str:
    return f"<{RDFS}{name}>"


def owl(name: str) -> str:
    return f"<{OWL}{name}>"


def xsd(name: str) -> str:
    return f"<{XSD}{name}>"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\x00")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


# --- constructors -----------------------------------------------------------------------

def iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def bnode(key: Column) -> Column:
    """The same node for the same key, always."""
    return F.concat(F.lit("_:b"), F.md5(key))


def literal(text: Column, lang: Column | str | None = None, datatype: str | None = None) -> Column:
    out = F.concat(F.lit('"'), escape(text.cast("string")), F.lit('"'))
    if lang is not None:
        return F.concat(out, F.lit("@"), F.lower(F.lit(lang) if isinstance(lang, str) else lang))
    return F.concat(out, F.lit(f"^^{datatype}")) if datatype and datatype != xsd("string") else out


def typed(value: Column, kind: str) -> Column:
    """A Spark value as a literal; kind is its Spark type's simple name."""
    names = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "double", "float": "double", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}
    if kind.startswith("decimal"):
        names[kind] = "decimal"
    if kind.startswith("timestamp"):
        value = F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return literal(value, datatype=xsd(names[kind])) if kind in names else literal(value)


# --- tests and accessors ----------------------------------------------------------------

def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def same_term(a: Column, b: Column) -> Column:
    return a == b


def str_(t: Column) -> Column:
    """The text of an IRI or a literal; null for a blank node."""
    return F.when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).when(is_literal(t), unescape(F.regexp_extract(t, _LITERAL, 1)))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.lower(F.regexp_extract(t, _LITERAL, 2)))


def datatype(t: Column) -> Column:
    stated = F.regexp_extract(t, _LITERAL, 3)
    plain = F.when(F.regexp_extract(t, _LITERAL, 2) != "", rdf("langString")).otherwise(xsd("string"))
    return F.when(is_literal(t), F.when(stated != "", iri(stated)).otherwise(plain))


def lang_matches(tag: Column, wanted: Column | str) -> Column:
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    low, want = F.lower(tag), F.lower(wanted)
    return F.when(want == "*", low != "").otherwise((low == want) | low.startswith(F.concat(want, F.lit("-"))))


def is_numeric(t: Column) -> Column:
    return F.coalesce(datatype(t).isin([xsd(n) for n in NUMERIC]) & F.expr("true"), F.lit(False)) & num(t, checked=False).isNotNull()


def num(t: Column, checked: bool = True) -> Column:
    value = F.regexp_extract(t, _LITERAL, 1).try_cast("double")
    return F.when(datatype(t).isin([xsd(n) for n in NUMERIC]), value) if checked else value


def timestamp(t: Column) -> Column:
    return F.when(datatype(t) == xsd("dateTime"), F.regexp_extract(t, _LITERAL, 1).try_cast("timestamp"))


def boolean(t: Column) -> Column:
    return F.when(datatype(t) == xsd("boolean"), F.regexp_extract(t, _LITERAL, 1).isin("true", "1"))


# --- comparison and order ---------------------------------------------------------------

def compare(a: Column, op: str, b: Column) -> Column:
    """=, !=, <, <=, > or >= by typed value: numbers, times, truth values, plain text; IRIs and others by = and != only."""
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    f = ops[op]
    text = (datatype(a) == xsd("string")) & (datatype(b) == xsd("string"))
    out = F.when(num(a).isNotNull() & num(b).isNotNull(), f(num(a), num(b)))
    out = out.when(timestamp(a).isNotNull() & timestamp(b).isNotNull(), f(timestamp(a), timestamp(b)))
    out = out.when(boolean(a).isNotNull() & boolean(b).isNotNull(), f(boolean(a), boolean(b)))
    out = out.when(text, f(str_(a), str_(b)))
    return out.when(a.isNotNull() & b.isNotNull(), f(a, b)) if op in ("=", "!=") else out


def order_key(t: Column) -> list[Column]:
    """Sort keys in the order unbound, blank, IRI, literal; numbers by value."""
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    return [kind, num(t), t]
