"""Personal data: patterns for base entities, and information-theoretic sanitisation of what reveals them.

Base entities (email, ip, card, phone) are found by pattern, and so are two more kinds that
need protection: secrets (long runs of letters and digits mixed) and account numbers (12 to 19
digits that are no card). A term near an entity can give it away even when the entity itself
is masked. How much it does is estimated on the corpus, for the entity and for the classes
that it belongs to (its kind; the domain of an address, the prefix of a phone number, the
network of an ip). With stretches of three lines as contexts, IC(e) = -log2 p(e), and a term
t discloses PMI(e; t) = log2 p(e, t) / (p(e) p(t)) of it. Terms that surely disclose at least a
set share of IC(e) become spans too: they are removed if they disclose all of an entity, else
generalised to the kind that they speak of. Sure is a lower bound: n different contexts that
show both count as n of n + 1 (Wilson's bound of n hits in n at one standard error), so one
is enough where the entity is rare, as personal data is, and not where a bit of doubt is a
large share of IC(e). All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import materialize, numbered, small

#: Kinds in the order of the report, with patterns whose possessive quantifiers match what the
#: greedy ones of the definition do, without deep recursion on long runs, and that start only where
#: a run starts or the last match ended, since all starts in a run fail alike; and a cheap test
#: that every text with a match passes.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that are protected beside the base ones.
MORE = ("secret", "account")
ALL = KINDS + MORE
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z0-9]{20,}+",
    "account": r"[0-9](?:[\x20-]?[0-9])++",
}
MAYBE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9]{20}"),
    "account": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
}
TERM = r"[\p{L}\p{N}]++"
#: A term is disclosing if the lower bound of PMI(e; t) >= SHARE * IC(e), and removed if PMI(e; t) >= REMOVE * IC(e).
SHARE, REMOVE = 0.9, 0.999
#: Lines of a context, and characters of one at most (and the rest of a word): longer lines are several.
CONTEXT_LINES, CONTEXT_CHARS = 3, 4000

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op=lambda a, b: a + b) -> Column:
    """For each of an array of ints, op over all values before it, from 0 on.

    The array is cut into about as many chunks as a chunk has values, so that long arrays cost
    their length to the power of 1.5, where going back from each value would square it.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: op(a, b).cast("int"))

    def chunked(v: Column, width: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        return _let(chunks, lambda cs: _let(F.transform(cs, fold), lambda sums: F.flatten(F.transform(cs, lambda c, k: inside(c, fold(F.slice(sums, F.lit(1), k)))))))

    def inside(chunk: Column, before: Column) -> Column:
        return _let(before, lambda b: F.transform(chunk, lambda _, j: op(b, fold(F.slice(chunk, F.lit(1), j))).cast("int")))

    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(chunked(v, F.ceil(F.sqrt(F.size(v))).cast("int"))))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point offsets, from the matches and what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, between, lambda v, b: F.struct(v.alias("v"), F.length(b).alias("gap"), F.length(v).alias("n"))), lambda x: x["v"].isNotNull())

    def one(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        return F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["v"].alias("value"))

    return _let(pairs, lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + x["n"])), one)).cast(_SPANS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return (acc + F.when(i % 2 == 1, twice).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _part_fits(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part_fits),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "secret": lambda v: (F.regexp_count(v, F.lit("[0-9]")) >= 4) & (F.regexp_count(v, F.lit("[A-Za-z]")) >= 4),
    "account": lambda v: F.length(_digits(v)).between(12, 19) & ~_VALID["card"](v),
}


def base_spans(text: Column, kind: str) -> Column:
    hits = F.filter(located(text, PATTERNS[kind]), lambda x: _VALID[kind](x["value"]))
    return F.when(MAYBE[kind](text), hits).otherwise(F.array().cast(_SPANS))


def _told(spans: Column, kind: Column | str) -> Column:
    """kind:start:end of each span."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def contexts(text: Column) -> Column:
    """The contexts of a text: runs of CONTEXT_LINES lines, cut where they are long."""
    runs = _let(
        F.split(text, "\n"),
        lambda lines: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / CONTEXT_LINES).cast("int")),
            lambda k: F.concat(F.array_join(F.slice(lines, k * CONTEXT_LINES + 1, F.lit(CONTEXT_LINES)), "\n"), F.lit("\n")),
        ),
    )
    return F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(rf"(?s).{{1,{CONTEXT_CHARS}}}+\S{{0,96}}+"), F.lit(0))))


def _entities(kind: Column, value: Column) -> Column:
    """An entity and the classes it belongs to, as strings that tell them apart."""
    value = F.lower(value)
    group = (
        F.when(kind == "email", F.concat(F.lit("domain "), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.concat(F.lit("network "), F.substring_index(value, ".", 2)))
        .when(kind == "phone", F.concat(F.lit("prefix "), F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 4)))
    )
    return F.filter(F.array(F.concat(F.lit("one "), value), F.concat(F.lit("kind "), kind), group), lambda x: x.isNotNull())


def _hits(text: Column) -> Column:
    """All protected entities of a context: (start, end, kind, value)."""
    of = lambda k: F.transform(base_spans(text, k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind"), x["value"].alias("value")))
    return F.concat(*(of(k) for k in ALL))


def disclosing_terms(forms: DataFrame, docs_text: DataFrame, total: int) -> DataFrame:
    """(form, term, kind, remove): terms of a context that disclose an entity in it or its class.

    forms: a written table of the distinct contexts with entities (form, n, context, hits);
    docs_text: the one column `text` of the whole corpus; total: its number of contexts.
    """
    masked = F.col("context")
    for kind in ALL:
        masked = F.regexp_replace(masked, PATTERNS[kind], " ")
    keys = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(_entities(x["kind"], x["value"]), lambda e: F.struct(e.alias("entity"), x["kind"].alias("kind"))))))
    each = forms.select("form", "n", F.explode(keys).alias("of"), _terms(masked).alias("terms")).select("form", "n", "of.entity", "of.kind", "terms")
    met = materialize(each.select("form", "n", "entity", "kind", F.explode("terms").alias("term")), "met")
    pairs = materialize(met.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("forms")), "pairs")
    alone = materialize(each.groupBy("entity").agg(F.sum("n").alias("with_entity")), "alone")
    wanted = materialize(pairs.select("term").distinct(), "terms")
    # Marginals: every context of every text, each term once; only terms in question go on.
    every = docs_text.select(F.explode(contexts(F.col("text"))).alias("context")).select(F.explode(_terms(F.col("context"))).alias("term"))
    marginal = materialize(every.join(small(wanted, 40), "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term")), "marginal")
    ic = F.log2(F.lit(float(max(total, 1))) / F.col("with_entity"))
    pmi = F.log2(F.col("together") * float(max(total, 1)) / (F.col("with_entity") * F.col("with_term")))
    told = pairs.join(small(alone, 60), "entity").join(small(marginal, 48), "term")
    bound = pmi + F.log2(F.col("forms") / (F.col("forms") + 1.0))
    remove = F.col("entity").startswith("one ") & (pmi >= REMOVE * ic)
    told = materialize(told.where((ic > 0) & (bound >= SHARE * ic)).select("entity", "term", remove.alias("remove")), "disclosing")
    return met.join(small(told, 100), ["entity", "term"]).groupBy("form", "term").agg(F.min("kind").alias("kind"), F.max("remove").alias("remove"))


def _found(own: DataFrame) -> DataFrame:
    """own (row, doc_id, text, null texts empty) as (row, doc_id, spans of each kind, term)."""
    found = own.select("row", "doc_id", "text", *(base_spans(F.col("text"), k).alias(k) for k in ALL))
    any_ = sum((F.size(k) for k in ALL[1:]), F.size(ALL[0])) > 0
    found = materialize(found.select("row", "doc_id", *ALL, F.when(any_, F.col("text")).alias("text"), F.size(contexts(F.col("text"))).cast("long").alias("contexts")), "base")
    total = found.agg(F.sum("contexts")).first()[0] or 0
    held = found.where("text is not null").select("row", contexts(F.col("text")).alias("c"))
    # Of a line end that the last context has beyond the text nothing comes after.
    starts = running(F.transform("c", F.length))
    pieces = held.select("row", F.explode(F.arrays_zip(starts.alias("at"), F.col("c").alias("context"))).alias("x")).select("row", "x.at", "x.context")
    pieces = pieces.withColumn("hits", _hits(F.col("context"))).where(F.size("hits") > 0).withColumn("form", F.unhex(F.sha2("context", 256)))
    pieces = materialize(pieces, "contexts")
    # Copies of a context are one form, however many rows hold them.
    forms = materialize(pieces.groupBy("form").agg(F.count("*").alias("n"), F.first("context").alias("context"), F.first("hits").alias("hits")), "forms")
    told = disclosing_terms(forms, own.select("text"), int(total))
    by_form = told.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("kind", "remove")))).alias("terms"))
    free = lambda w: ~F.exists("hits", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    words = F.filter(located(F.col("context"), TERM), lambda w: F.element_at("terms", F.lower(w["value"])).isNotNull() & free(w))
    words = materialize(forms.join(by_form, "form").select("form", "terms", words.alias("words")).where(F.size("words") > 0), "words")
    spans = pieces.select("row", "at", "form").join(words, "form").select("row", "at", "terms", F.explode("words").alias("w"))
    about = F.element_at("terms", F.lower("w.value"))
    spans = spans.select("row", F.struct((F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"), F.col("w.value").alias("value"), about["kind"].alias("kind"), about["remove"].alias("remove")).alias("term"))
    spans = materialize(spans.groupBy("row").agg(F.array_sort(F.collect_list("term")).alias("term")), "term-spans")
    return found.join(spans, "row", "left").select("row", "doc_id", *ALL, "term")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, email[], ip[], card[], phone[], secret[], account[], term[]) for every row.

    Spans have code-point offsets, ends exclusive; term spans also say the kind they speak of and
    whether to remove or generalise. row is a number of the row. Null texts count as empty and
    have no spans; rows that repeat an id, or have none, are each searched; an empty table
    gives no rows; other columns are ignored. An entity that a cut of a long line divides is a
    span, but no evidence.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _found(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text")))


def report(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, all spans, and
    the numbers of the added ones."""
    base = F.concat(*(_told(F.col(k), k) for k in KINDS))
    term = F.coalesce("term", F.array().cast("array<struct<start:int,end:int,value:string,kind:string,remove:boolean>>"))
    added = F.concat(*(_told(F.col(k), k) for k in MORE), _told(term, "term"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in MORE),
        F.size(term).cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with protected entities replaced by their kind, and disclosing terms removed or generalised
    to the kind they speak of (as [PHONE-RELATED]). Overlapping spans are replaced from the first
    on; the rest of an overlapped one is dropped with it. Null texts stay null; all columns and
    rows stay."""
    held = numbered(docs)
    text = F.col("doc")[text_col]
    found = _found(held.select("row", F.col("doc")[id_col].alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")))
    shape = "array<struct<start:int,end:int,put:string>>"
    masked = lambda kind: F.transform(kind, lambda x: F.struct(x["start"], x["end"], F.lit(f"[{kind.upper()}]"))).cast(shape)
    general = lambda x: F.when(x["remove"], "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("-RELATED]")))
    terms = F.coalesce(F.transform("term", lambda x: F.struct(x["start"], x["end"], general(x))).cast(shape), F.array().cast(shape))
    cuts = found.select("row", F.array_sort(F.concat(*(masked(k) for k in ALL), terms)).alias("cuts")).where(F.size("cuts") > 0)
    cuts = cuts.withColumn("after", running(F.transform("cuts", lambda x: x["end"]), F.greatest))
    piece = lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), x["put"])).otherwise("")
    last = F.array_max(F.transform("cuts", lambda x: x["end"]))
    new = F.concat(F.array_join(F.zip_with("cuts", "after", piece), ""), F.substring(text, last + 1, F.length(text)))
    out = held.join(cuts, "row", "left").withColumn("new", F.when(F.col("cuts").isNotNull(), new).otherwise(text))
    return out.select(*(F.col("new").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
