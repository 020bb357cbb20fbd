"""The registered queries over the test tables seen as quads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import scalars as S
from quadrille.functions import terms as t
from quadrille.operators import graphs as G
from quadrille.operators import paths as P
from quadrille.operators import patterns as pat
from quadrille.plans import rulesets as R
from quadrille.plans.rules import Closure, Eval, Fixpoint, Repeat, Rule, Ruleset, Sequence_, closure
from quadrille.plans.store import Store
from quadrille.plans.transforms import strongly_connected
from quadrille.sources import nquads
from quadrille.sources import relational
from quadrille.sources.relational import MAPS, predicate, quads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def pr(c: str) -> str:
    return predicate(c)


def text(c: str):
    return t.str_(F.col(c))


def number(c: str):
    return t.num(F.col(c))


def whole(c: str):
    return t.num(F.col(c)).cast("long")


def key(c: str):
    """The key at the end of a row's IRI."""
    return F.regexp_extract(c, r"/([0-9-]+)>$", 1)


def world(spark: SparkSession, sf_dir: str, *columns: str, tables=("region", "nation", "customer"), with_type=False) -> DataFrame:
    return quads(spark, sf_dir, tables, columns or None, with_type)


def star(spark: SparkSession, sf_dir: str, table: str, var: str, **variables: str) -> DataFrame:
    return relational.star(spark.read.parquet(f"{sf_dir}/{table}.parquet"), MAPS[table], var, variables)


_GEO = """
    WITH q AS (
        SELECT '<urn:t:region/' || r_regionkey || '>' AS s, 'r_name' AS p, r_name AS o, 'region' AS g FROM region
        UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', 'n_name', n_name, 'nation' FROM nation
        UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', 'n_regionkey', '<urn:t:region/' || n_regionkey || '>', 'nation' FROM nation)
"""


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world(spark, sf_dir, "r_name", "n_name", "n_regionkey", tables=("region", "nation"))


def plain(df: DataFrame) -> DataFrame:
    """Quads with short predicates and graphs, and literals as text."""
    return df.select("s", F.regexp_extract("p", "urn:c:(.*)>", 1).alias("p"), F.when(t.is_iri(F.col("o")), F.col("o")).otherwise(text("o")).alias("o"), F.regexp_extract("g", "urn:g:(.*)>", 1).alias("g"))


# --- scans and graphs -------------------------------------------------------------------

@query(_GEO + "SELECT s, p, o, g FROM q")
def scan_pattern(spark, d):
    return plain(geo(spark, d))


@query("SELECT count(*) > 0 AS has FROM nation WHERE n_name = 'x'")
def has_statement(spark, d):
    found = pat.match(geo(spark, d), ("?s", pr("n_name"), '"x"'))
    return found.limit(1).agg((F.count("*") > 0).alias("has"))


@query("SELECT (SELECT count(*) FROM region) + 2 * (SELECT count(*) FROM nation) AS n")
def size(spark, d):
    return geo(spark, d).agg(F.count("*").alias("n"))


@query("SELECT 'region' AS g UNION ALL SELECT 'nation'")
def list_graphs(spark, d):
    return G.graphs(geo(spark, d)).select(F.regexp_extract("g", "urn:g:(.*)>", 1).alias("g"))


@query("SELECT n_name AS name, 'nation' AS g FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def graph_variable(spark, d):
    names = geo(spark, d).where(F.col("p").isin(pr("n_name"), pr("r_name")))
    return pat.match(names, ("?s", "?p", "?name", "?g")).select(text("name").alias("name"), F.regexp_extract("g", "urn:g:(.*)>", 1).alias("g"))


@query("SELECT count(*) AS n FROM nation")
def default_graph_merge(spark, d):
    """A statement in two graphs counts once in the merged default graph."""
    one = world(spark, d, "n_name", tables=("nation",))
    return pat.default_graph(nquads.set_graphs(one, "<urn:g:a>", "<urn:g:b>")).agg(F.count("*").alias("n"))


# --- projection, filter, extension ------------------------------------------------------

@query("SELECT c_name AS name, c_acctbal AS balance FROM customer")
def project(spark, d):
    q = world(spark, d, "c_name", "c_acctbal", tables=("customer",))
    return pat.bgp(q, [("?c", pr("c_name"), "?name"), ("?c", pr("c_acctbal"), "?balance")]).select(text("name").alias("name"), number("balance").alias("balance"))


@query("SELECT p_size::BIGINT AS size, p_retailprice AS price FROM part WHERE p_size > 20 AND p_retailprice < p_size * 40")
def filter_theta(spark, d):
    both = star(spark, d, "part", "p", size="p_size", price="p_retailprice")
    return both.select(whole("size").alias("size"), number("price").alias("price")).where("size > 20 and price < size * 40")


@query("SELECT o_orderkey::VARCHAR AS k, upper(o_orderpriority) AS loud, round(o_totalprice / 2, 4) AS half FROM orders")
def bind(spark, d):
    both = star(spark, d, "orders", "o", p="o_orderpriority", t="o_totalprice")
    return both.select(key("o").alias("k"), F.upper(text("p")).alias("loud"), F.round(number("t") / 2, 4).alias("half"))


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation WHERE n_regionkey = 1")
def param_bind(spark, d):
    """A parameter takes the place of a variable before planning, so it is pushed to the scan."""
    rule = Rule("r", (("?n", "<urn:name>", "?name"),), (("?n", pr("n_regionkey"), "?region"), ("?n", pr("n_name"), "?name"))).bound({"region": "<urn:t:region/1>"})
    return pat.bgp(geo(spark, d), rule.body).select(key("n").alias("k"), text("name").alias("name"))


@query("""SELECT '<urn:t:nation/' || n_nationkey || '>' AS s, 'in' AS p, '<urn:t:region/' || n_regionkey || '>' AS o FROM nation
          UNION ALL SELECT '<urn:t:region/' || n_regionkey || '>', 'has', '<urn:t:nation/' || n_nationkey || '>' FROM nation""")
def construct_multi(spark, d):
    found = pat.match(geo(spark, d), ("?n", pr("n_regionkey"), "?r"))
    made = pat.construct(found, [("?n", "<urn:in>", "?r"), ("?r", "<urn:has>", "?n"), ('"a literal"', "<urn:no>", "?n")])
    return made.select("s", F.regexp_extract("p", "urn:(.*)>", 1).alias("p"), "o")


# --- joins ------------------------------------------------------------------------------

@query("""SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def customers_per_region(spark, d):
    q = world(spark, d, "c_nationkey", "n_regionkey", "r_name")
    return pat.bgp(q, [("?c", pr("c_nationkey"), "?n"), ("?n", pr("n_regionkey"), "?r"), ("?r", pr("r_name"), "?name")]).groupBy(text("name").alias("region")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey::VARCHAR AS k, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey""")
def bgp_chain(spark, d):
    stars = [star(spark, d, "orders", "o", c="o_custkey"), star(spark, d, "customer", "c", customer="c_name", n="c_nationkey"), star(spark, d, "nation", "n", nation="n_name")]
    found = pat.join(pat.join(stars[0], stars[1]), stars[2])
    return found.select(key("o").alias("k"), text("customer").alias("customer"), text("nation").alias("nation"))


@query("SELECT p_partkey::VARCHAR AS k, p_brand AS brand, p_size::BIGINT AS size FROM part WHERE p_size < 20")
def bgp_star(spark, d):
    q = world(spark, d, "p_brand", "p_size", tables=("part",))
    found = pat.bgp(q, [("?p", pr("p_brand"), "?b"), ("?p", pr("p_size"), "?z")])
    return found.select(key("p").alias("k"), text("b").alias("brand"), whole("z").alias("size")).where("size < 20")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
def cartesian(spark, d):
    q = world(spark, d, "r_name", tables=("region",))
    return pat.join(pat.match(q, ("?x", pr("r_name"), "?a")), pat.match(q, ("?y", pr("r_name"), "?b"))).select(text("a").alias("a"), text("b").alias("b"))


@query("SELECT p, count(*) AS n FROM (SELECT 'n_name' AS p FROM nation UNION ALL SELECT 'n_regionkey' FROM nation) GROUP BY p")
def var_predicate_join(spark, d):
    schema = pat.values(spark, ["p", "kind"], [(pr("n_name"), "a"), (pr("n_regionkey"), "b")])
    return pat.join(pat.match(geo(spark, d), ("?s", "?p", "?o")), schema).groupBy(F.regexp_extract("p", "urn:c:(.*)>", 1).alias("p")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS c, o_orderkey::VARCHAR AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def optional(spark, d):
    q = world(spark, d, "c_name", "o_custkey", tables=("customer", "orders"))
    left = pat.match(q, ("?c", pr("c_name"), "?name"))
    return pat.optional(left, pat.match(q, ("?o", pr("o_custkey"), "?c"))).select(key("c").alias("c"), key("o").alias("o"))


@query("SELECT c_custkey::VARCHAR AS c, o_orderkey::VARCHAR AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20")
def optional_condition(spark, d):
    q = world(spark, d, "c_acctbal", "o_custkey", "o_totalprice", tables=("customer", "orders"))
    left = pat.match(q, ("?c", pr("c_acctbal"), "?b"))
    right = pat.bgp(q, [("?o", pr("o_custkey"), "?c"), ("?o", pr("o_totalprice"), "?t")])
    return pat.optional(left, right, on=number("t") > number("b") * 20).select(key("c").alias("c"), key("o").alias("o"))


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists(spark, d):
    q = world(spark, d, "c_name", "o_custkey", tables=("customer", "orders"))
    return pat.exists(pat.match(q, ("?c", pr("c_name"), "?name")), pat.match(q, ("?o", pr("o_custkey"), "?c"))).select(key("c").alias("c"))


@query("SELECT c_custkey::VARCHAR AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists(spark, d):
    q = world(spark, d, "c_name", "o_custkey", tables=("customer", "orders"))
    return pat.not_exists(pat.match(q, ("?c", pr("c_name"), "?name")), pat.match(q, ("?o", pr("o_custkey"), "?c"))).select(key("c").alias("c"))


@query("SELECT c_custkey::VARCHAR AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def exists_value(spark, d):
    q = world(spark, d, "c_name", "o_custkey", tables=("customer", "orders"))
    return pat.exists_flag(pat.match(q, ("?c", pr("c_name"), "?name")), pat.match(q, ("?o", pr("o_custkey"), "?c")), "buys").select(key("c").alias("c"), "buys")


@query("SELECT n_name AS name, v.r AS r, v.note AS note FROM nation JOIN (VALUES (0, 'a'), (1, 'b'), (NULL, 'any')) v(r, note) ON v.r IS NULL OR v.r = n_regionkey".replace("v.r AS r", "n_regionkey::VARCHAR AS r"))
def compat_join(spark, d):
    """An unbound value of the inline table agrees with every region."""
    rows = pat.values(spark, ["r", "note"], [("<urn:t:region/0>", "a"), ("<urn:t:region/1>", "b"), (None, "any")])
    left = pat.bgp(geo(spark, d), [("?n", pr("n_regionkey"), "?r"), ("?n", pr("n_name"), "?name")])
    return pat.join(left, rows, maybe_unbound=["r"]).select(text("name").alias("name"), key("r").alias("r"), "note")


@query("SELECT n_nationkey::VARCHAR AS n FROM nation WHERE n_regionkey <> 2")
def minus(spark, d):
    q = geo(spark, d)
    return pat.minus(pat.match(q, ("?n", pr("n_regionkey"), "?r")), pat.match(q, ("?n", pr("n_regionkey"), "<urn:t:region/2>"))).select(key("n").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS n FROM nation")
def minus_no_shared(spark, d):
    q = geo(spark, d)
    return pat.minus(pat.match(q, ("?n", pr("n_name"), "?x")), pat.match(q, ("?other", pr("r_name"), "?y"))).select(key("n").alias("n"))


@query("SELECT s_name AS name, 's' AS kind, NULL::DOUBLE AS balance FROM supplier UNION ALL SELECT c_name, NULL, c_acctbal FROM customer")
def union_diff_vars(spark, d):
    q = world(spark, d, "s_name", "c_name", "c_acctbal", tables=("supplier", "customer"))
    a = pat.match(q, ("?s", pr("s_name"), "?name")).select(text("name").alias("name"), F.lit("s").alias("kind"))
    b = pat.bgp(q, [("?c", pr("c_name"), "?name"), ("?c", pr("c_acctbal"), "?b")]).select(text("name").alias("name"), number("b").alias("balance"))
    return pat.union(a, b)


@query("SELECT DISTINCT c_mktsegment AS segment FROM customer")
def distinct(spark, d):
    return pat.match(world(spark, d, "c_mktsegment", tables=("customer",)), ("?c", pr("c_mktsegment"), "?m")).select(text("m").alias("segment")).distinct()


# --- aggregation ------------------------------------------------------------------------

def _priced(spark, d):
    found = star(spark, d, "orders", "o", f="o_orderstatus", q="o_totalprice", s="o_custkey")
    return found.select(text("f").alias("flag"), number("q").alias("q"), F.col("s"))


@query("SELECT o_orderstatus AS flag, count(*) AS n FROM orders GROUP BY 1")
def group_count(spark, d):
    return _priced(spark, d).groupBy("flag").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS flag, count(DISTINCT o_custkey) AS suppliers FROM orders GROUP BY 1")
def count_distinct(spark, d):
    return _priced(spark, d).groupBy("flag").agg(F.countDistinct("s").alias("suppliers"))


@query("SELECT o_orderstatus AS flag, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def sum_min_max_avg(spark, d):
    return _priced(spark, d).groupBy("flag").agg(F.round(F.sum("q"), 2).alias("total"), F.min("q").alias("low"), F.max("q").alias("high"), F.round(F.avg("q"), 6).alias("mean"))


@query("SELECT o_orderstatus AS flag, round(sum(DISTINCT o_totalprice), 2) AS total FROM orders GROUP BY 1")
def agg_distinct(spark, d):
    return _priced(spark, d).groupBy("flag").agg(F.round(F.sum_distinct("q"), 2).alias("total"))


@query("SELECT n_regionkey::VARCHAR AS r, min(n_name) AS name FROM nation GROUP BY 1")
def sample_min(spark, d):
    found = pat.bgp(geo(spark, d), [("?n", pr("n_regionkey"), "?r"), ("?n", pr("n_name"), "?name")])
    return found.groupBy(key("r").alias("r")).agg(F.min(text("name")).alias("name"))


@query("SELECT n_regionkey::VARCHAR AS r, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_concat(spark, d):
    found = pat.bgp(geo(spark, d), [("?n", pr("n_regionkey"), "?r"), ("?n", pr("n_name"), "?name")])
    return found.groupBy(key("r").alias("r")).agg(F.array_join(F.array_sort(F.collect_list(text("name"))), ";").alias("names"))


@query("SELECT o_orderstatus AS flag, max(o_totalprice) + 1 AS more FROM orders GROUP BY 1 HAVING count(*) > 10")
def having_expression(spark, d):
    return _priced(spark, d).groupBy("flag").agg((F.max("q") + 1).alias("more"), F.count("*").alias("n")).where("n > 10").drop("n")


@query("SELECT p_name AS name, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def order_limit_offset(spark, d):
    q = world(spark, d, "p_name", "p_retailprice", tables=("part",))
    found = pat.bgp(q, [("?p", pr("p_name"), "?n"), ("?p", pr("p_retailprice"), "?r")])
    return found.orderBy(number("r").desc(), key("p").cast("long")).offset(5).limit(10).select(text("n").alias("name"), number("r").alias("price"))


@query("SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 1000")
def ask(spark, d):
    q = world(spark, d, "o_totalprice", tables=("orders",))
    return pat.match(q, ("?o", pr("o_totalprice"), "?t")).where(number("t") > 1000).limit(1).agg((F.count("*") > 0).alias("answer"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'region' AS kind FROM region UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'customer' FROM customer) GROUP BY kind")
def types(spark, d):
    q = world(spark, d, "r_name", with_type=True)
    return pat.match(q, ("?s", t.rdf("type"), "?k")).groupBy(F.regexp_extract("k", "urn:t:(.*)>", 1).alias("kind")).agg(F.count("*").alias("n"))


@query(_GEO + "SELECT s, p, o FROM q WHERE s = '<urn:t:nation/3>'")
def describe(spark, d):
    return plain(pat.describe(geo(spark, d), "<urn:t:nation/3>")).drop("g")


@query("""SELECT n_nationkey::VARCHAR AS n, c_custkey::VARCHAR AS c, substr(c_mktsegment, 1, 1) AS m FROM customer JOIN nation ON c_custkey % 10 = 0 OR c_nationkey = n_nationkey
    WHERE n_nationkey % 5 = 0 OR substr(c_mktsegment, 1, 1) < 'H'""")
def compat_join_two(spark, d):
    """Two variables that either side may leave unbound: customers without a nation, nations without a limit."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    left = c.select(F.col("c_custkey").cast("string").alias("c"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey").cast("string")).alias("n"), F.substring("c_mktsegment", 1, 1).alias("m"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    letters = pat.values(spark, ["m"], [(x,) for x in "ABCDEFG"])
    some = n.where("k % 5 != 0").crossJoin(letters)
    right = n.where("k % 5 = 0").select("k", F.lit(None).cast("string").alias("m")).unionByName(some.select("k", "m")).select(F.col("k").cast("string").alias("n"), "m")
    return pat.join(left, right, maybe_unbound=["n", "m"]).select("n", "c", "m")


@query("SELECT n_nationkey::VARCHAR AS n, r_name AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def select_star(spark, d):
    """All variables of the patterns, with those of the optional part."""
    q = geo(spark, d)
    names = pat.match(q.where(F.col("s") != "<urn:t:region/2>"), ("?r", pr("r_name"), "?label"))
    out = pat.optional(pat.match(q, ("?n", pr("n_regionkey"), "?r")), names)
    assert sorted(out.columns) == ["label", "n", "r"]
    return out.select(key("n").alias("n"), text("label").alias("name"))


@query("SELECT o_orderkey::VARCHAR AS a, n_regionkey::VARCHAR AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def path_orders(spark, d):
    """From every order along any edge, of those whose end is a region."""
    q = world(spark, d, "o_custkey", "c_nationkey", "n_regionkey", tables=("orders", "customer", "nation"))
    reach = P.one_or_more(q.select(F.col("s").alias("src"), F.col("o").alias("dst")))
    return _pairs(reach.where(F.col("src").startswith("<urn:t:orders/") & F.col("dst").startswith("<urn:t:region/")))


# --- paths ------------------------------------------------------------------------------

def cycle(spark, d):
    """Edges nation i -> nation (7 i + 3) mod 25."""
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey")
    s, o = (F.concat(F.lit("<urn:t:nation/"), x.cast("string"), F.lit(">")) for x in (F.col("n_nationkey"), (F.col("n_nationkey") * 7 + 3) % 25))
    return n.select(s.alias("s"), F.lit("<urn:next>").alias("p"), o.alias("o"), F.lit("<urn:g:cycle>").alias("g"))


_REACH = """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 7 + 3) % 25)::BIGINT AS b FROM nation),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


def _pairs(path):
    return path.select(key("src").alias("a"), key("dst").alias("b"))


@query("SELECT c_custkey::VARCHAR AS a, n_regionkey::VARCHAR AS b FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_sequence(spark, d):
    q = world(spark, d, "c_nationkey", "n_regionkey", tables=("customer", "nation"))
    return _pairs(P.sequence(P.step(q, pr("c_nationkey")), P.step(q, pr("n_regionkey"))))


@query("SELECT n_regionkey::VARCHAR AS a, n_nationkey::VARCHAR AS b FROM nation")
def path_inverse(spark, d):
    return _pairs(P.inverse(P.step(geo(spark, d), pr("n_regionkey"))))


@query("SELECT c_custkey::VARCHAR AS a, c_nationkey::VARCHAR AS b FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier")
def path_alternative(spark, d):
    q = world(spark, d, "c_nationkey", "s_nationkey", tables=("customer", "supplier"))
    return _pairs(P.either(P.step(q, pr("c_nationkey")), P.step(q, pr("s_nationkey"))))


@query("SELECT n_nationkey::VARCHAR AS a, n_regionkey::VARCHAR AS b FROM nation")
def path_negated(spark, d):
    return _pairs(P.other_than(geo(spark, d), pr("n_name"), pr("r_name")))


@query("SELECT n_nationkey::VARCHAR AS a, ((n_nationkey * 7 + 3) % 25)::VARCHAR AS b FROM nation UNION SELECT n_nationkey::VARCHAR, n_nationkey::VARCHAR FROM nation")
def path_zero_or_one(spark, d):
    q = cycle(spark, d)
    return _pairs(P.zero_or_one(P.step(q, "<urn:next>"), P.nodes(q)))


@query(_REACH + " SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM r")
def path_plus(spark, d):
    return _pairs(P.one_or_more(P.step(cycle(spark, d), "<urn:next>")))


@query(_REACH + " SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM r UNION SELECT n_nationkey::VARCHAR, n_nationkey::VARCHAR FROM nation")
def path_star(spark, d):
    q = cycle(spark, d)
    return _pairs(P.zero_or_more(P.step(q, "<urn:next>"), P.nodes(q)))


@query(_REACH + " SELECT a::VARCHAR AS a, b::VARCHAR AS b FROM r WHERE a = 4")
def path_from(spark, d):
    starts = pat.values(spark, ["start"], [("<urn:t:nation/4>",)])
    return P.reachable(starts, P.step(cycle(spark, d), "<urn:next>")).select(key("start").alias("a"), key("dst").alias("b"))


# --- scalar functions -------------------------------------------------------------------

@query("""SELECT p_partkey::VARCHAR AS k, length(p_name)::INT AS len, substr(p_name, 2, 3) AS sub, upper(p_name) AS up, lower(p_brand) AS low,
          starts_with(p_name, 'p') AS starts, contains(p_type, 'E') AS has, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS before,
          CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after, p_name || '/' || p_brand AS both FROM part""")
def fn_string(spark, d):
    q = world(spark, d, "p_name", "p_brand", "p_type", tables=("part",))
    f = pat.bgp(q, [("?p", pr("p_name"), "?n"), ("?p", pr("p_brand"), "?b"), ("?p", pr("p_type"), "?t")])
    n, b = text("n"), text("b")
    return f.select(
        key("p").alias("k"), S.strlen(n).alias("len"), S.substr(n, 2, 3).alias("sub"), F.upper(n).alias("up"), F.lower(b).alias("low"), n.startswith("p").alias("starts"),
        text("t").contains("E").alias("has"), S.strbefore(n, " ").alias("before"), S.strafter(n, " ").alias("after"), F.concat(n, F.lit("/"), b).alias("both"),
    )


@query("""SELECT c_custkey::VARCHAR AS k, abs(c_acctbal) AS a, floor(c_acctbal + 0.5)::BIGINT AS r, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f,
          round(c_acctbal / 3, 6) AS d FROM customer""")
def fn_numeric(spark, d):
    f = pat.match(world(spark, d, "c_acctbal", tables=("customer",)), ("?c", pr("c_acctbal"), "?b"))
    b = number("b")
    return f.select(key("c").alias("k"), F.abs(b).alias("a"), S.round_half_up(b).alias("r"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(S.divide(b, F.lit(3)), 6).alias("d"))


@query("""SELECT o_orderkey::VARCHAR AS k, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, hour(o_orderdate)::INT AS h, 'Z' AS tz, 'PT0S' AS zone FROM orders""")
def fn_date(spark, d):
    f = pat.match(world(spark, d, "o_orderdate", tables=("orders",)), ("?o", pr("o_orderdate"), "?d"))
    x = S.wall(text("d"))
    return f.select(key("o").alias("k"), F.year(x).alias("y"), F.month(x).alias("m"), F.day(x).alias("d"), F.hour(x).alias("h"), S.tz_of(text("d")).alias("tz"), S.timezone(text("d")).alias("zone"))


@query("SELECT n_nationkey::VARCHAR AS k, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
def fn_hash(spark, d):
    f = pat.match(geo(spark, d), ("?n", pr("n_name"), "?x"))
    return f.select(key("n").alias("k"), F.md5(text("x")).alias("m"), F.sha2(text("x"), 256).alias("s"))


@query(_GEO + """SELECT s, p, p = 'n_regionkey' AS iri, p <> 'n_regionkey' AS lit, false AS blank, CASE WHEN p <> 'n_regionkey' THEN '' END AS lang,
          CASE WHEN p <> 'n_regionkey' THEN 'string' END AS kind FROM q""")
def fn_term(spark, d):
    o = F.col("o")
    kind = F.regexp_extract(t.datatype(o), "#(.*)>", 1)
    return geo(spark, d).select("s", F.regexp_extract("p", "urn:c:(.*)>", 1).alias("p"), t.is_iri(o).alias("iri"), t.is_literal(o).alias("lit"), t.is_blank(o).alias("blank"), t.lang(o).alias("lang"), kind.alias("kind"))


@query("SELECT p_partkey::VARCHAR AS k, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, p_size IN (1, 2, 3) AS tiny FROM part")
def fn_conditional(spark, d):
    f = pat.match(world(spark, d, "p_size", tables=("part",)), ("?p", pr("p_size"), "?z"))
    big = t.compare(F.col("z"), ">", F.lit(f'"25"^^{t.xsd("integer")}'))
    return f.select(key("p").alias("k"), S.if_(big, F.lit("big"), F.lit("small")).alias("kind"), whole("z").isin(1, 2, 3).alias("tiny"))


@query("SELECT p_partkey::VARCHAR AS k, regexp_replace(p_type, '[AEIOU]', '-', 'g') AS r, regexp_matches(p_name, '(?i)A') AS m FROM part")
def fn_regex(spark, d):
    f = pat.bgp(world(spark, d, "p_type", "p_name", tables=("part",)), [("?p", pr("p_type"), "?t"), ("?p", pr("p_name"), "?n")])
    return f.select(key("p").alias("k"), S.replace(text("t"), "[AEIOU]", "-").alias("r"), S.regex(text("n"), "A", "i").alias("m"))


@query("SELECT o_orderkey::VARCHAR AS k, replace(o_orderpriority, ' ', '%20') AS e FROM orders")
def fn_encode_uri(spark, d):
    f = pat.match(world(spark, d, "o_orderpriority", tables=("orders",)), ("?o", pr("o_orderpriority"), "?p"))
    return f.select(key("o").alias("k"), S.encode_for_uri(text("p")).alias("e"))


@query("SELECT p_partkey::VARCHAR AS k, p_size IN (1, 2, 3) AS a, p_size NOT IN (1, 2, 3) AS b, CASE WHEN p_size = 7 THEN true END AS c, CASE WHEN p_size = 7 THEN false END AS d FROM part")
def fn_in(spark, d):
    """With an error among the values, what is not found is an error too."""
    f = pat.match(world(spark, d, "p_size", tables=("part",)), ("?p", pr("p_size"), "?z"))
    few, odd = [F.lit(n) for n in (1, 2, 3)], [F.lit(7), F.lit(None).cast("long")]
    return f.select(key("p").alias("k"), S.in_(whole("z"), *few).alias("a"), S.not_in(whole("z"), *few).alias("b"), S.in_(whole("z"), *odd).alias("c"), S.not_in(whole("z"), *odd).alias("d"))


# --- changes and stores -----------------------------------------------------------------

@query(_GEO + "SELECT count(*) AS n, count(DISTINCT s || p || o || g) AS different FROM q")
def add_dedup(spark, d):
    q = geo(spark, d)
    return G.add(q, q.unionByName(q)).agg(F.count("*").alias("n"), F.countDistinct(F.concat("s", "p", "o", "g")).alias("different"))


@query(_GEO + "SELECT s, p, o, g FROM q WHERE p <> 'n_name'")
def remove_pattern(spark, d):
    return plain(G.remove_matching(geo(spark, d), None, pr("n_name")))


@query(_GEO + "SELECT s, p, o, g FROM q UNION ALL SELECT o, 'holds', s, 'default' FROM q WHERE p = 'n_regionkey'")
def insert_where(spark, d):
    q = geo(spark, d)
    out = G.modify(q, lambda x: pat.match(x, ("?n", pr("n_regionkey"), "?r")), insert=[("?r", pr("holds"), "?n")])
    return plain(out)


@query(_GEO + "SELECT s, CASE WHEN p = 'n_name' THEN 'label' ELSE p END AS p, o, CASE WHEN p = 'n_name' THEN 'labels' ELSE g END AS g FROM q")
def delete_insert(spark, d):
    out = G.modify(geo(spark, d), lambda x: pat.match(x, ("?n", pr("n_name"), "?v", "?g")), delete=[("?n", pr("n_name"), "?v", "?g")], insert=[("?n", pr("label"), "?v", "<urn:g:labels>")])
    return plain(out)


@query(_GEO + "SELECT s, p, o, 'both' AS g FROM q UNION ALL SELECT s, p, o, g FROM q WHERE g = 'nation'")
def copy_move_add_graph(spark, d):
    q = G.copy(geo(spark, d), "<urn:g:region>", "<urn:g:tmp>")
    q = G.add_graph(G.move(q, "<urn:g:tmp>", "<urn:g:both>"), "<urn:g:nation>", "<urn:g:both>")
    return plain(G.clear(q, "<urn:g:region>"))


@query(_GEO + "SELECT s, p, o, g FROM q WHERE g <> 'nation'")
def clear_graph(spark, d):
    return plain(G.clear(geo(spark, d), "<urn:g:nation>"))


@query(_GEO + "SELECT s, p, o, g FROM q")
def nquads_roundtrip(spark, d):
    from quadrille.functions.scratch import folder
    import uuid

    path = f"{folder(spark)}/nquads-{uuid.uuid4().hex}"
    nquads.write_nquads(geo(spark, d), path, "gzip")
    return plain(nquads.read_nquads(spark, path))


@query(_GEO + "SELECT DISTINCT 'default' AS g, s, p, o FROM q")
def null_context_remap(spark, d):
    return plain(G.in_graph(geo(spark, d).withColumn("g", F.lit(None).cast("string"))))


# --- rules ------------------------------------------------------------------------------

def places(spark, d):
    """Nations below their region, regions below Place; customers typed by their nation."""
    q = world(spark, d, "n_regionkey", "c_nationkey", tables=("nation", "customer"))
    sub = pat.match(q, ("?n", pr("n_regionkey"), "?r"))
    tbox = pat.construct(sub, [("?n", R.SUBCLASS, "?r"), ("?r", R.SUBCLASS, "<urn:Place>")], "<urn:g:schema>").distinct()
    return tbox.unionByName(pat.construct(pat.match(q, ("?c", pr("c_nationkey"), "?n")), [("?c", R.TYPE, "?n")], "<urn:g:data>"))


_PLACES = """WITH abox AS (SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS n, 'region/' || n_regionkey AS r
        FROM customer JOIN nation ON c_nationkey = n_nationkey) """


def short(c: str):
    return F.regexp_replace(F.regexp_replace(c, "^<urn:(t:)?", ""), ">$", "")


@query(_PLACES + "SELECT s, r AS o FROM abox UNION ALL SELECT s, 'Place' FROM abox")
def rdfs9(spark, d):
    rules = Ruleset("rdfs9", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs9", "rdfs11")))
    return closure(rules, places(spark, d)).where(F.col("p") == R.TYPE).select(short("s").alias("s"), short("o").alias("o"))


@query("SELECT DISTINCT 'nation/' || n_nationkey AS s, 'Place' AS o FROM nation")
def rdfs11(spark, d):
    rules = Ruleset("rdfs11", tuple(r for r in R.rdfs_rules() if r.name == "rdfs11"))
    return closure(rules, places(spark, d)).select(short("s").alias("s"), short("o").alias("o"))


@query(_PLACES + """SELECT count(*) AS n FROM (SELECT s, r AS o FROM abox UNION SELECT s, 'Place' FROM abox
        UNION SELECT 'nation/' || n_nationkey, 'Place' FROM nation UNION SELECT k, 'Property' FROM (VALUES ('subClassOf'), ('type'), ('subPropertyOf')) v(k)
        UNION SELECT k, k FROM (VALUES ('subClassOf'), ('type'), ('subPropertyOf')) v(k))""")
def rdfs_closure(spark, d):
    return closure(R.rdfs_ruleset(), places(spark, d), full="false", axioms="false").agg(F.count("*").alias("n"))


@query("SELECT 'customer/' || c_custkey AS s, 'Buyer' AS o FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'orders/' || o_orderkey, 'Order' FROM orders")
def rdfs2_rdfs3(spark, d):
    q = world(spark, d, "o_custkey", tables=("orders",))
    schema = pat.values(spark, list("spog"), [(pr("o_custkey"), R.DOMAIN, "<urn:Order>", "<urn:g:schema>"), (pr("o_custkey"), R.RANGE, "<urn:Buyer>", "<urn:g:schema>")])
    rules = Ruleset("domain-range", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs2", "rdfs3")))
    return closure(rules, q.unionByName(schema)).where(F.col("p") == R.TYPE).select(short("s").alias("s"), short("o").alias("o"))


@query("SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS o FROM customer")
def rdfs7(spark, d):
    q = world(spark, d, "c_nationkey", tables=("customer",))
    schema = pat.values(spark, list("spog"), [(pr("c_nationkey"), R.SUBPROPERTY, "<urn:locatedIn>", "<urn:g:schema>")])
    rules = Ruleset("rdfs7", tuple(r for r in R.rdfs_rules() if r.name == "rdfs7"))
    return closure(rules, q.unionByName(schema)).select(short("s").alias("s"), short("o").alias("o"))


_LOCATED = """SELECT 'customer/' || c_custkey AS s, 'region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def located(spark, d):
    q = world(spark, d, "n_regionkey", "c_nationkey", tables=("nation", "customer"))
    edges = q.withColumn("p", F.lit("<urn:locatedIn>"))
    return edges.unionByName(pat.values(spark, list("spog"), [("<urn:locatedIn>", R.TYPE, t.owl("TransitiveProperty"), "<urn:g:schema>")]))


@query(_LOCATED)
def owl_transitive(spark, d):
    rules = Ruleset("trp", tuple(r for r in R.property_rules() if r.name == "prp-trp"))
    return closure(rules, located(spark, d)).select(short("s").alias("s"), short("o").alias("o"))


@query("SELECT 'nation/' || n_nationkey AS s, 'customer/' || c_custkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def owl_inverse(spark, d):
    q = world(spark, d, "c_nationkey", tables=("customer",)).unionByName(pat.values(spark, list("spog"), [("<urn:holds>", t.owl("inverseOf"), pr("c_nationkey"), "<urn:g:schema>")]))
    return closure(Ruleset("inv", R.property_rules()), q).where("p = '<urn:holds>'").select(short("s").alias("s"), short("o").alias("o"))


@query(_LOCATED)
def owl_chain(spark, d):
    q = world(spark, d, "n_regionkey", "c_nationkey", tables=("nation", "customer"))
    schema = pat.values(spark, list("spog"), [
        ("<urn:inRegion>", t.owl("propertyChainAxiom"), "_:l1", "<urn:g:s>"), ("_:l1", R.FIRST, pr("c_nationkey"), "<urn:g:s>"), ("_:l1", R.REST, "_:l2", "<urn:g:s>"),
        ("_:l2", R.FIRST, pr("n_regionkey"), "<urn:g:s>"), ("_:l2", R.REST, R.NIL, "<urn:g:s>"),
    ])
    return closure(Ruleset("chain", R.property_rules()), q.unionByName(schema)).where("p = '<urn:inRegion>'").select(short("s").alias("s"), short("o").alias("o"))


@query("SELECT a.n_nationkey::VARCHAR AS a, b.n_nationkey::VARCHAR AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey::VARCHAR <> b.n_nationkey::VARCHAR")
def owl_sameas(spark, d):
    """Nations of one region are taken for one: an inverse functional property, then symmetry and transitivity."""
    q = world(spark, d, "n_regionkey", tables=("nation",)).unionByName(pat.values(spark, list("spog"), [(pr("n_regionkey"), R.TYPE, t.owl("InverseFunctionalProperty"), "<urn:g:s>")]))
    rules = tuple(r for r in (*R.property_rules(), *R.equality_rules()) if r.name in ("prp-ifp", "eq-sym", "eq-trans"))
    return closure(Ruleset("same", rules), q).where(F.col("p") == R.SAME).select(key("s").alias("a"), key("o").alias("b"))


@query("SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def owl_inconsistency(spark, d):
    """Each nation of region 1 is also typed with a class disjoint from it."""
    q = world(spark, d, "n_regionkey", tables=("nation",))
    typed = pat.construct(pat.match(q, ("?n", pr("n_regionkey"), "?r")), [("?n", R.TYPE, "?r")], "<urn:g:d>")
    extra = pat.construct(pat.match(q, ("?n", pr("n_regionkey"), "<urn:t:region/1>")), [("?n", R.TYPE, "<urn:Odd>"), ("<urn:Odd>", t.owl("disjointWith"), "<urn:t:region/1>")], "<urn:g:d>")
    return closure(Ruleset("dw", R.class_rules()), typed.unionByName(extra)).where(F.col("o") == R.INCONSISTENCY).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS n FROM nation WHERE n_regionkey IN (1, 2)")
def owl_list_expand(spark, d):
    """A class that is the union of two regions' classes, given as a list."""
    q = world(spark, d, "n_regionkey", tables=("nation",))
    typed = pat.construct(pat.match(q, ("?n", pr("n_regionkey"), "?r")), [("?n", R.TYPE, "?r")], "<urn:g:d>")
    schema = pat.values(spark, list("spog"), [
        ("<urn:Two>", t.owl("unionOf"), "_:l1", "<urn:g:s>"), ("_:l1", R.FIRST, "<urn:t:region/1>", "<urn:g:s>"), ("_:l1", R.REST, "_:l2", "<urn:g:s>"),
        ("_:l2", R.FIRST, "<urn:t:region/2>", "<urn:g:s>"), ("_:l2", R.REST, R.NIL, "<urn:g:s>"),
    ])
    return closure(Ruleset("union", R.class_rules()), typed.unionByName(schema)).where((F.col("o") == "<urn:Two>") & (F.col("p") == R.TYPE)).select(key("s").alias("n"))


@query("SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation WHERE n_regionkey <> 0")
def rule_emit_flags(spark, d):
    """An atom is left out where its flag finds a match: nations of region 0 are marked already."""
    q = geo(spark, d)
    done = pat.construct(pat.match(q, ("?n", pr("n_regionkey"), "<urn:t:region/0>")), [("?n", "<urn:done>", "<urn:yes>")], "<urn:g:d>")
    rule = Rule("emit", (("?n", "<urn:in>", "?r"),), (("?n", pr("n_regionkey"), "?r"),), emit=(("?n", "<urn:done>", "<urn:yes>"),))
    return closure(Ruleset("emit", (rule,), Eval()), q.unionByName(done)).select(short("s").alias("s"), short("o").alias("o"))


@query("SELECT 'nation/' || n_nationkey AS s FROM nation WHERE n_regionkey = 2")
def rule_params(spark, d):
    rule = Rule("p", (("?n", "<urn:is>", "<urn:wanted>"),), (("?n", pr("n_regionkey"), "?region"),), when=lambda v: v["on"] == "yes")
    return closure(Ruleset("p", (rule,), Eval(), {"region": None, "on": "yes"}), geo(spark, d), region="<urn:t:region/2>").select(short("s").alias("s"))


@query("SELECT 'nation/' || n_nationkey AS s FROM nation WHERE n_regionkey = 2")
def rule_predicate_params(spark, d):
    """The predicate of a body pattern is a parameter, which no rule names as a constant."""
    rule = Rule("p", (("?n", "<urn:is>", "<urn:wanted>"),), (("?n", "?prop", "<urn:t:region/2>"),))
    return closure(Ruleset("pp", (rule,), Fixpoint(Eval()), {"prop": None}), geo(spark, d), prop=pr("n_regionkey")).select(short("s").alias("s"))


@query("SELECT r_name AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def task_repeat(spark, d):
    """The task runs once for each region, its IRI bound."""
    rule = Rule("of", (("?n", "<urn:of>", "?region"),), (("?n", pr("n_regionkey"), "?region"),))
    plan = Repeat(lambda q: pat.match(q, ("?region", pr("r_name"), "?x")).select("region").orderBy("region"), Sequence_((Eval(("of",)),)))
    q = geo(spark, d)
    found = closure(Ruleset("repeat", (rule,), plan, {"region": "<urn:none>"}), q).select(F.col("o").alias("r"))
    return pat.join(found, pat.match(q, ("?r", pr("r_name"), "?name"))).groupBy(text("name").alias("name")).agg(F.count("*").alias("n"))


@query(_REACH + " SELECT count(*) AS n FROM (SELECT a, b FROM r EXCEPT SELECT a, b FROM e)")
def task_fixpoint(spark, d):
    rule = Rule("next", (("?x", "<urn:next>", "?z"),), (("?x", "<urn:next>", "?y"), ("?y", "<urn:next>", "?z")))
    return closure(Ruleset("fix", (rule,), Fixpoint(Eval())), cycle(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT 'first' AS rule, count(*) AS n FROM nation UNION ALL SELECT 'second', count(*) FROM nation")
def rule_triggers(spark, d):
    """The first rule wakes the second; a third is never woken, since no rule triggers it after its first turn."""
    rules = (
        Rule("first", (("?n", "<urn:a>", "?r"),), (("?n", pr("n_regionkey"), "?r"),), triggers=("second",)),
        Rule("second", (("?n", "<urn:b>", "?r"),), (("?n", "<urn:a>", "?r"),), triggers=()),
        Rule("third", (("?n", "<urn:c>", "?r"),), (("?n", "<urn:none>", "?r"),), triggers=()),
    )
    c = Closure(Ruleset("t", rules, Fixpoint(Eval())), geo(spark, d))
    c.run()
    return spark.createDataFrame(sorted(c.counts.items()), "rule string, n long")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
    SELECT n_nationkey::VARCHAR AS node, regexp_extract(coalesce(least('/' || n_nationkey || '>', (SELECT min('/' || b || '>') FROM m WHERE m.a = n_nationkey)), '/' || n_nationkey || '>'), '[0-9]+') AS comp FROM nation""")
def transform_scc(spark, d):
    edges = P.step(cycle(spark, d), "<urn:next>").withColumnRenamed("dst", "dest")
    return strongly_connected(edges).select(key("node").alias("node"), key("comp").alias("comp"))


# --- the store --------------------------------------------------------------------------

def stored(spark, d, **options):
    rules = Ruleset("rdfs9", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs9", "rdfs11")))
    store = Store(spark, rules, **options)
    store.add(places(spark, d))
    return store


@query(_PLACES + "SELECT (SELECT count(*) FROM abox) + (SELECT count(*) + count(DISTINCT n_regionkey) FROM nation) AS without, 3 * (SELECT count(*) FROM abox) + (SELECT 2 * count(*) + count(DISTINCT n_regionkey) FROM nation) AS with_inferred")
def store_modes(spark, d):
    store = stored(spark, d)
    return spark.createDataFrame([(store.size(False), store.size(True))], "without long, with_inferred long")


@query("SELECT 'STALE' AS after_remove, 'CURRENT' AS after_closure, 0::BIGINT AS customers")
def closure_after_remove(spark, d):
    """Removing the data and bringing the closure up to date leaves nothing inferred about it."""
    store = stored(spark, d)
    store.update_closure()
    store.remove_matching(None, R.TYPE)
    status = store.status.name
    left = store.read().where(F.col("p") == R.TYPE).count()
    return spark.createDataFrame([(status, store.status.name, left)], "after_remove string, after_closure string, customers long")


@query("SELECT 'POSSIBLY_INCOMPLETE' AS after_add, (SELECT count(*) FROM nation) AS places")
def closure_after_add(spark, d):
    store = stored(spark, d)
    store.update_closure()
    store.add(pat.values(spark, list("spog"), [("<urn:x>", R.TYPE, "<urn:t:nation/1>", "<urn:g:data>"), ("<urn:y>", R.TYPE, "<urn:Odd>", "<urn:inf:main>")]))
    status = store.status.name
    n = store.read().where((F.col("o") == "<urn:Place>") & (F.col("p") == R.SUBCLASS) & F.col("s").contains("nation")).count()
    return spark.createDataFrame([(status, n)], "after_add string, places long")


@query(_PLACES + "SELECT (SELECT count(*) FROM abox) + (SELECT count(*) + count(DISTINCT n_regionkey) FROM nation) + 1 AS n")
def void_count(spark, d):
    return stored(spark, d).statistics().select(whole("o").alias("n"))


# --- closures graph by graph ------------------------------------------------------------

def in_graphs(spark, d):
    """The schema in a global graph; the customers of each nation in a graph of their own."""
    q = places(spark, d)
    return q.withColumn("g", F.when(F.col("p") == R.TYPE, F.concat(F.lit("<urn:g:of-"), key("o"), F.lit(">"))).otherwise(F.lit("<urn:g:schema>")))


@query(_PLACES + """SELECT s, r AS o, 'urn:g:of-' || substr(n, 8) AS g FROM abox UNION ALL SELECT s, 'Place', 'urn:g:of-' || substr(n, 8) FROM abox
    UNION ALL SELECT DISTINCT 'nation/' || n_nationkey, 'Place', 'urn:g:schema' FROM nation""")
def rdfs_global_import(spark, d):
    """What follows from the schema alone is concluded once, beside the schema, not in every graph."""
    from quadrille.plans.scopes import global_import

    rules = Ruleset("sub", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs9", "rdfs11")))
    found = global_import(rules, in_graphs(spark, d), "<urn:g:schema>")
    return found.select(short("s").alias("s"), short("o").alias("o"), F.url_decode(F.regexp_extract("g", "urn:inf:(.*)>", 1)).alias("g"))


@query(_PLACES + """SELECT s, r AS o, 'urn:g:of-' || substr(n, 8) AS g FROM abox UNION ALL SELECT s, 'Place', 'urn:g:of-' || substr(n, 8) FROM abox""")
def rdfs_separate_global(spark, d):
    """The whole of RDFS in every graph; of what it infers, the types of customers."""
    from quadrille.plans import scopes

    found = scopes.rdfs_separate_global(in_graphs(spark, d), "<urn:g:schema>", full="false")
    found = found.where((F.col("p") == R.TYPE) & F.col("s").startswith("<urn:t:customer"))
    return found.select(short("s").alias("s"), short("o").alias("o"), F.url_decode(F.regexp_extract("g", "urn:inf:(.*)>", 1)).alias("g"))


@query(_PLACES + """SELECT s, r AS o, 'data' AS g FROM abox UNION ALL SELECT s, 'Place', 'data' FROM abox
    UNION ALL SELECT DISTINCT 'nation/' || n_nationkey, 'Place', 'regions' FROM nation""")
def rdfs_graph_import(spark, d):
    """data imports nations; nations and regions import each other and are one scope."""
    from quadrille.plans.scopes import graph_import

    rules = Ruleset("sub", tuple(r for r in R.rdfs_rules() if r.name in ("rdfs9", "rdfs11")))
    q = places(spark, d)
    graph = F.when(F.col("p") == R.TYPE, "<urn:g:data>").when(F.col("o") == "<urn:Place>", "<urn:g:regions>").otherwise("<urn:g:nations>")
    links = [("<urn:g:data>", "<urn:g:nations>"), ("<urn:g:nations>", "<urn:g:regions>"), ("<urn:g:regions>", "<urn:g:nations>")]
    imports = pat.values(spark, list("spog"), [(a, t.owl("imports"), b, a) for a, b in links])
    found = graph_import(rules, q.withColumn("g", graph).unionByName(imports))
    name = F.regexp_extract(F.url_decode(F.regexp_extract("g", "urn:inf:(.*)>", 1)), "urn:g:(.*)", 1)
    return found.select(short("s").alias("s"), short("o").alias("o"), F.when(name == "nations", "regions").otherwise(name).alias("g"))


# --- the same operators over tables that grow -------------------------------------------

def order_quads(spark, d):
    return world(spark, d, "o_custkey", "o_orderstatus", "o_orderpriority", tables=("orders",))


_ORDERS = """
    WITH q AS (
        SELECT '<urn:t:orders/' || o_orderkey || '>' AS s, 'o_custkey' AS p, '<urn:t:customer/' || o_custkey || '>' AS o, 'orders' AS g FROM orders
        UNION ALL SELECT '<urn:t:orders/' || o_orderkey || '>', 'o_orderstatus', o_orderstatus, 'orders' FROM orders
        UNION ALL SELECT '<urn:t:orders/' || o_orderkey || '>', 'o_orderpriority', o_orderpriority, 'orders' FROM orders)
"""


@query(_ORDERS + "SELECT s, p, o, g FROM q WHERE o IS NOT NULL")
def nquads_orders(spark, d):
    """Every quad of the orders through gzipped N-Quads and back."""
    import uuid

    from quadrille.functions.scratch import folder

    path = f"{folder(spark)}/nquads-{uuid.uuid4().hex}"
    nquads.write_nquads(order_quads(spark, d), path, "gzip")
    return plain(nquads.read_nquads(spark, path))


@query(_ORDERS + "SELECT s, CASE WHEN p = 'o_orderstatus' THEN 'status' ELSE p END AS p, o, CASE WHEN p = 'o_orderstatus' THEN 'states' ELSE g END AS g FROM q WHERE o IS NOT NULL")
def delete_insert_orders(spark, d):
    status = ("?x", pr("o_orderstatus"), "?v", "?g")
    return plain(G.modify(order_quads(spark, d), [status], delete=[status], insert=[("?x", pr("status"), "?v", "<urn:g:states>")]))


@query(_ORDERS + "SELECT s, p, o, g FROM q WHERE o IS NOT NULL UNION ALL SELECT s, p, o, 'copy' FROM q WHERE o IS NOT NULL")
def copy_orders(spark, d):
    return plain(G.copy(order_quads(spark, d), "<urn:g:orders>", "<urn:g:copy>"))


@query("""SELECT 'lineitem/' || l_orderkey || '-' || l_linenumber AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION SELECT 'orders/' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION SELECT 'customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 1""")
def path_from_region(spark, d):
    """From one region backwards along any edge: nations, customers, orders and their lines, each once (lines may share a key)."""
    q = world(spark, d, "l_orderkey", "o_custkey", "c_nationkey", "n_regionkey", tables=("lineitem", "orders", "customer", "nation"))
    starts = pat.values(spark, ["start"], [("<urn:t:region/1>",)])
    edges = P.inverse(q.select(F.col("s").alias("src"), F.col("o").alias("dst")))
    return P.reachable(starts, edges).select(short("dst").alias("x"))


@query("SELECT 'orders/' || o_orderkey AS node, min('orders/' || o_orderkey || '>') OVER (PARTITION BY o_custkey) AS least FROM orders UNION ALL SELECT DISTINCT 'customer/' || o_custkey, 'customer/' || o_custkey || '>' FROM orders")
def scc_orders(spark, d):
    """A customer's orders are a ring in the order of their keys, each with an edge to the customer."""
    from pyspark.sql import Window

    q = world(spark, d, "o_custkey", tables=("orders",)).withColumn("k", key("s").cast("long"))
    ring = Window.partitionBy("o")
    after = F.lead("s").over(ring.orderBy("k"))
    first = F.first("s").over(ring.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = q.select(F.col("s").alias("src"), F.coalesce(after, first).alias("dest")).unionByName(q.select(F.col("s").alias("src"), F.col("o").alias("dest")))
    return strongly_connected(edges).select(short("node").alias("node"), F.regexp_replace("comp", "^<urn:t:", "").alias("least"))


@query(_PLACES + "SELECT s, r AS o FROM abox UNION ALL SELECT s, 'Place' FROM abox UNION ALL SELECT s, 'Resource' FROM abox")
def rdfs_closure_full(spark, d):
    """RDFS with its defaults, axioms and the types of every resource included; of what it infers, the types of customers."""
    found = closure(R.rdfs_ruleset(), places(spark, d))
    found = found.where((F.col("p") == R.TYPE) & F.col("s").startswith("<urn:t:customer"))
    return found.select(short("s").alias("s"), F.regexp_replace(short("o"), "^.*#", "").alias("o"))


@query("""WITH c AS (SELECT 'customer/' || c_custkey AS s, 'nation/' || n_nationkey AS n, 'region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT s, 'locatedIn' AS p, n AS o FROM c UNION ALL SELECT s, 'locatedIn', r FROM c UNION ALL SELECT n, 'holds', s FROM c
    UNION ALL SELECT s, 'type', 'Customer' FROM c UNION ALL SELECT s, 'type', 'Agent' FROM c""")
def owl2rl_closure(spark, d):
    """The whole OWL 2 RL ruleset: a sub-property that is transitive, an inverse, a domain and an equivalent class."""
    q = world(spark, d, "n_regionkey", "c_nationkey", tables=("nation", "customer"))
    schema = [
        (pr("c_nationkey"), R.SUBPROPERTY, "<urn:locatedIn>"), (pr("n_regionkey"), R.SUBPROPERTY, "<urn:locatedIn>"),
        ("<urn:locatedIn>", R.TYPE, t.owl("TransitiveProperty")), ("<urn:holds>", t.owl("inverseOf"), pr("c_nationkey")),
        (pr("c_nationkey"), R.DOMAIN, "<urn:Customer>"), ("<urn:Customer>", R.EQ_CLASS, "<urn:Agent>"),
    ]
    found = closure(R.owl2rl_ruleset(), q.unionByName(pat.values(spark, list("spog"), [(*x, "<urn:g:schema>") for x in schema])))
    about = F.col("p").isin("<urn:locatedIn>", "<urn:holds>") | (F.col("p") == R.TYPE) & F.col("o").isin("<urn:Customer>", "<urn:Agent>")
    customers = F.col("s").startswith("<urn:t:customer") | (F.col("p") == "<urn:holds>")
    return found.where(about & customers).select(short("s").alias("s"), F.regexp_replace(short("p"), "^.*#", "").alias("p"), short("o").alias("o"))
