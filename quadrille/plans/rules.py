"""Forward rules over quads and the closure plans that run them.

A rule has a head and a body of patterns, conditions as functions of Columns, and negated
patterns. An evaluation runs all active rules as one union over one snapshot, keeps what is
new, and appends it; a fixpoint repeats that until nothing is new. Rules without negation are
evaluated semi-naively: at least one body pattern reads only what the last round added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from types import CodeType, FunctionType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.scratch import Pile, affordable, lean_tasks, sided, written
from quadrille.operators.patterns import Pattern, bgp, construct, exists_flag, match, not_exists, variables

Condition = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Rule:
    """body ⇒ head.

    where: conditions over the body's variables. bind: name -> Column function, after the
    body. unless: patterns that must have no match (genuine negation: such a rule is always
    evaluated in full). emit: for each head atom, patterns whose presence leaves the atom
    out. when: a condition on parameters. transform: a function of the solutions. triggers:
    rules to activate when this one finds something new; None stands for all.
    """

    name: str
    head: tuple[Pattern, ...]
    body: tuple[Pattern, ...] = ()
    where: Condition | None = None
    bind: dict[str, Condition] = field(default_factory=dict)
    unless: tuple[Pattern, ...] = ()
    emit: tuple[Pattern | None, ...] = ()
    when: Callable[[dict], bool] | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    triggers: tuple[str, ...] | None = None

    def scoped(self) -> Rule:
        """The rule within each graph: all its patterns and heads share one graph variable."""
        lift = lambda p: (*p[:3], "?__g")
        return replace(self, head=tuple(map(lift, self.head)), body=tuple(map(lift, self.body)), unless=tuple(map(lift, self.unless)), emit=tuple(lift(p) if p else None for p in self.emit))

    def bound(self, parameters: dict[str, str]) -> Rule:
        """Parameters put in the place of variables of their names."""
        put = lambda p: tuple(parameters.get(x[1:], x) if x.startswith("?") else x for x in p)
        return replace(self, head=tuple(map(put, self.head)), body=tuple(map(put, self.body)), unless=tuple(map(put, self.unless)), emit=tuple(put(p) if p else None for p in self.emit))


@dataclass(frozen=True)
class Eval:
    rules: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Sequence_:
    tasks: tuple


@dataclass(frozen=True)
class Fixpoint:
    task: object


@dataclass(frozen=True)
class Repeat:
    """Runs the task once for each row of a small query's result, its columns bound as parameters."""

    over: Callable[[DataFrame], DataFrame]
    task: object


@dataclass(frozen=True)
class With:
    """Runs the task with more parameters, each worked out from those around it, in order."""

    bind: dict[str, Callable[[dict], str]]
    task: object


def told(x) -> str:
    """A text that is the same for values that say the same, in every process; a function is told by
    its code, its defaults and what it refers to outside."""
    if isinstance(x, (str, int, float, bool, bytes, type(None))):
        return repr(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{told(k)}:{told(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(told, x)) + "]"
    if isinstance(x, (set, frozenset)):
        return "(" + ",".join(sorted(map(told, x))) + ")"
    if is_dataclass(x) and not isinstance(x, type):
        return type(x).__name__ + told([getattr(x, f.name) for f in fields(x)])
    if isinstance(x, CodeType):
        return told([x.co_code, x.co_consts, x.co_names, x.co_varnames])
    if isinstance(x, FunctionType):
        held = [c.cell_contents for c in x.__closure__ or ()]
        return "function" + told([x.__code__, x.__defaults__, [h if not isinstance(h, FunctionType) or h is not x else "itself" for h in held]])
    return f"{getattr(x, '__module__', '')}.{getattr(x, '__qualname__', type(x).__qualname__)}"


@dataclass(frozen=True)
class Ruleset:
    """parameters: defaults; None marks one that must be given."""

    name: str
    rules: tuple[Rule, ...]
    plan: object = None
    parameters: dict[str, str | None] = field(default_factory=dict)

    def __post_init__(self):
        names = [r.name for r in self.rules]
        if len(set(names)) != len(names):
            raise ValueError("rule names repeat")
        for r in self.rules:
            free = {v for p in r.head for v in variables(p)} - {v for p in r.body for v in variables(p)} - set(r.bind) - set(self.parameters)
            if free and r.transform is None:
                raise ValueError(f"{r.name}: head variables {sorted(free)} are bound nowhere")


    def digest(self) -> str:
        """Tells rulesets apart by all that their rules say, functions included, their plan and defaults."""
        return hashlib.md5(told([self.rules, self.plan, sorted(self.parameters.items(), key=str)]).encode()).hexdigest()


RULESETS: dict[str, Ruleset] = {}


def register(ruleset: Ruleset) -> None:
    RULESETS[ruleset.name] = ruleset


def unregister(name: str) -> None:
    """The built-in rulesets stay."""
    if name in ("rdfs", "owl2rl"):
        raise ValueError(f"{name} is built in")
    RULESETS.pop(name, None)


@dataclass(frozen=True)
class Vocabulary:
    """How many rows of a set of quads have the constants in a ruleset's patterns: predicates, and predicate-object pairs.

    It is no larger than the ruleset. It tells rules that cannot match from the others before
    anything is planned, and which side of a join is small.
    """

    counts: dict  # (predicate, object or None) -> rows; the predicate None stands for all others
    objects: frozenset  # those that pairs were looked up for
    names: frozenset  # the predicates that were looked up

    @staticmethod
    def asked(rules: Sequence[Rule]) -> tuple[list[str], list[str]]:
        patterns = [p for r in rules for p in (*r.body, *r.unless, *filter(None, r.emit))]
        names = sorted({p[1] for p in patterns if not p[1].startswith("?")})
        return names, sorted({p[2] for p in patterns if not p[2].startswith("?") and not p[1].startswith("?")})

    @classmethod
    def keys(cls, rules: Sequence[Rule]) -> list[Column]:
        """What to group quads by for `read`: the groups are at most the pairs that the rules name."""
        names, objects = cls.asked(rules)
        named = F.col("p").isin(names) if names else F.lit(False)
        return [F.when(named, F.col("p")).alias("__p"), F.when(named & F.col("o").isin(objects) if objects else F.lit(False), F.col("o")).alias("__o")]

    @classmethod
    def read(cls, found: list, rules: Sequence[Rule]) -> Vocabulary:
        """found: the groups, each with its rows as n."""
        names, objects = cls.asked(rules)
        return cls({(r["__p"], r["__o"]): r["n"] for r in found}, frozenset(objects), frozenset(names))

    @classmethod
    def of(cls, quads: DataFrame, rules: Sequence[Rule]) -> Vocabulary:
        return cls.read(quads.groupBy(*cls.keys(rules)).agg(F.count("*").alias("n")).collect(), rules)

    def __or__(self, other: Vocabulary) -> Vocabulary:
        """Of both sets of quads, which have no row in common."""
        return Vocabulary({k: self.counts.get(k, 0) + other.counts.get(k, 0) for k in self.counts.keys() | other.counts.keys()}, self.objects, self.names)

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def rows(self, pattern: Pattern) -> int:
        """No more rows than these match the pattern."""
        if pattern[1] not in self.names:  # a variable, or a bound parameter that was not looked up
            return self.total
        if pattern[2] in self.objects:
            return self.counts.get((pattern[1], pattern[2]), 0)
        return sum(n for (p, _), n in self.counts.items() if p == pattern[1])


@dataclass(frozen=True)
class Sides:
    """What is known of the sides of a round's joins: rows in all quads and in those that are new, and the largest to broadcast."""

    known: Vocabulary
    fresh: Vocabulary | None
    most: int

    def of(self, body: Sequence[Pattern], place: int | None = None) -> list[int]:
        return [(self.fresh if i == place else self.known).rows(p) for i, p in enumerate(body)]

    def side(self, quads: DataFrame, pattern: Pattern) -> DataFrame:
        return sided(match(quads, pattern), self.known.rows(pattern), self.most)


def solutions(rule: Rule, quads: DataFrame, delta: DataFrame | None = None, places: Sequence[int] | None = None, sides: Sides | None = None) -> DataFrame:
    """The rule's body over quads; with delta, those solutions that use a delta quad somewhere.

    places: the body patterns that delta can match at all; None stands for all. sides: how the
    joins are to be made; without it Spark decides.
    """
    sized = lambda place=None: {"rows": sides.of(rule.body, place), "most": sides.most} if sides else {}
    if not rule.body:
        out = quads.sparkSession.range(1).drop("id").select(F.lit(1).alias("__hit"))
    elif delta is None or len(rule.body) == 1:
        out = bgp(quads if delta is None else delta, rule.body, **sized())
    else:
        parts = [bgp(quads, rule.body, {i: delta}, **sized(i)) for i in (range(len(rule.body)) if places is None else places)]
        out = reduce(lambda a, b: a.unionByName(b), parts)
    for name, f in rule.bind.items():
        out = out.withColumn(name, f(F.col))
    if rule.where is not None:
        out = out.where(rule.where(F.col))
    for p in rule.unless:
        out = not_exists(out, sides.side(quads, p) if sides else match(quads, p))
    return rule.transform(out) if rule.transform else out


def derive(rule: Rule, quads: DataFrame, graph: str, delta: DataFrame | None = None, places: Sequence[int] | None = None, sides: Sides | None = None) -> DataFrame:
    """(s, p, o, g) that the rule's head states, in the inference graph unless the atom names its own."""
    out, flags = solutions(rule, quads, delta, places, sides), []
    for i, p in enumerate(rule.emit):
        if p is None:
            flags.append(None)
        else:
            out = exists_flag(out, sides.side(quads, p) if sides else match(quads, p), f"__has{i}").withColumn(f"__emit{i}", ~F.col(f"__has{i}"))
            flags.append(f"__emit{i}")
    if not rule.body:
        flags = []
    return construct(out, rule.head, graph, flags)


@dataclass
class Closure:
    """The state of one closure: asserted and inferred quads, and what each rule has done.

    scoped: rules hold within each graph on its own, and conclude in it; else all graphs are
    merged, and what is inferred goes to the inference graph.
    """

    ruleset: Ruleset
    quads: DataFrame
    graph: str = "<urn:inf:main>"
    parameters: dict[str, str] = field(default_factory=dict)
    scoped: bool = False

    def __post_init__(self):
        missing = [k for k, v in self.ruleset.parameters.items() if v is None and k not in self.parameters]
        if missing:
            raise ValueError(f"parameters without a value: {missing}")
        self.values = {k: v for k, v in self.ruleset.parameters.items() if v is not None} | self.parameters
        self.columns = ["s", "p", "o", "g"] if self.scoped else ["s", "p", "o"]
        with lean_tasks(self.quads.sparkSession):
            self.triples = written(self.quads.select(*self.columns).distinct(), "triples")
            self.has = [Vocabulary.of(self.triples, self.ruleset.rules)]  # of the asserted quads and of each batch
        self.inferred: list[DataFrame] = []
        self.batches: list[tuple[DataFrame, int]] = []  # what each round added, with its row count
        self.pile = Pile()  # the same rows, merged as they pile up
        self.seen: dict[str, int] = {}  # rule -> batches it has read
        self.counts: dict[str, int] = {}
        self.active: set[str] | None = None

    def run(self) -> DataFrame:
        """The inferred quads, after the plan has run."""
        with lean_tasks(self.quads.sparkSession):
            self._task(self.ruleset.plan or Fixpoint(Eval()), self.values)
        return self.result()

    def result(self) -> DataFrame:
        empty = self.quads.sparkSession.createDataFrame([], "s string, p string, o string, g string")
        return reduce(lambda a, b: a.unionByName(b), self.inferred, empty)

    def _all(self) -> DataFrame:
        return self.triples.unionByName(self.pile.table()) if self.pile.levels else self.triples

    def _task(self, task, values: dict) -> int:
        if isinstance(task, Eval):
            return self._eval(task, values)
        if isinstance(task, Sequence_):
            return sum(self._task(t, values) for t in task.tasks)
        if isinstance(task, Fixpoint):
            total = 0
            while n := self._task(task.task, values):
                total += n
            return total
        if isinstance(task, With):
            for name, f in task.bind.items():
                values = values | {name: f(values)}
            self.seen.clear()  # other bindings: every rule starts anew
            return self._task(task.task, values)
        rows = task.over(self._all()).collect()  # a handful of bindings by definition
        total = 0
        for r in rows:
            self.seen.clear()  # other bindings: every rule starts anew
            total += self._task(task.task, values | {k: v for k, v in r.asDict().items() if v is not None})
        return total

    @staticmethod
    def _marks(rules: Sequence[Rule], rule: Rule) -> list[Column]:
        """The rule's bit among all, 60 to a column: fixed width, so that sets of rules are hashed, not sorted."""
        at = [r.name for r in rules].index(rule.name)
        return [F.lit(1 << at % 60 if at // 60 == i else 0).cast("long").alias(f"rules{i}") for i in range(1 + (len(rules) - 1) // 60)]

    def _eval(self, task: Eval, values: dict) -> int:
        rules = [r for r in self.ruleset.rules if task.rules is None or r.name in task.rules]
        rules = [r for r in rules if (r.when is None or r.when(values)) and (self.active is None or r.name in self.active or self.seen.get(r.name) is None)]
        now = len(self.batches)
        ready, sides = [], []
        everything, known = self._all(), reduce(lambda a, b: a | b, self.has)
        for rule in rules:
            since = self.seen.get(rule.name)
            self.seen[rule.name] = now
            bound = rule.bound(values).scoped() if self.scoped else rule.bound(values)
            if since == now or (since is not None and not rule.body) or not all(map(known.rows, bound.body)):
                continue
            delta = places = fresh = None
            if since is not None and not rule.unless and not any(rule.emit):
                fresh = reduce(lambda a, b: a | b, self.has[since + 1 :])
                places = [i for i, p in enumerate(bound.body) if fresh.rows(p)]
                if not places:
                    continue
                delta = reduce(lambda a, b: a.unionByName(b), [b for b, _ in self.batches[since:]])
            ready.append((rule, bound, delta, places, fresh))
            if len(bound.body) > 1:
                sides += [n for at in ([None] if places is None else places) for n in Sides(known, fresh, 0).of(bound.body, at)]
            sides += [known.rows(p) for p in (*bound.unless, *filter(None, bound.emit))]
        if not ready:
            return 0
        parts, most = [], affordable(sides)
        for rule, bound, delta, places, fresh in ready:
            if self.scoped and not rule.body:
                stated = derive(rule.bound(values), everything, self.graph).drop("g")
                heads = stated.crossJoin(everything.select("g").distinct())  # a ruleset's axioms in every scope
            else:
                heads = derive(bound, everything, self.graph, delta, places, Sides(known, fresh, most))
            parts.append(heads.select("s", "p", "o", F.coalesce("g", F.lit(self.graph)).alias("g"), *self._marks(rules, rule)))
        found = reduce(lambda a, b: a.unionByName(b), parts)
        # Graphs differ only where a head names its own; one of them is kept then.
        own = not self.scoped and any(len(p) > 3 for r in rules for p in r.head)
        found = found.groupBy(*self.columns).agg(*([F.min("g").alias("g")] if own else []), *[F.bit_or(m).alias(m) for m in found.columns[4:]])
        found = found if own or self.scoped else found.withColumn("g", F.lit(self.graph))
        new = written(found.join(sided(everything, known.total, affordable([known.total])), self.columns, "left_anti"), "inferred")
        # One pass over what is new: its size, each rule's share, and which constants it has.
        shares = [F.count_if(F.col(f"rules{i // 60}").bitwiseAND(F.lit(1 << i % 60).cast("long")) != 0).alias(f"rule{i}") for i in range(len(rules))]
        told_ = new.groupBy(*Vocabulary.keys(self.ruleset.rules)).agg(F.count("*").alias("n"), *shares).collect()
        n = sum(x["n"] for x in told_)
        by_rule = {r.name: k for i, r in enumerate(rules) if (k := sum(x[f"rule{i}"] for x in told_))}
        if n:
            self.inferred.append(new.select("s", "p", "o", "g"))
            self.batches.append((new.select(*self.columns), n))
            self.pile.add(*self.batches[-1])
            self.has.append(Vocabulary.read(told_, self.ruleset.rules))
        for k, v in by_rule.items():
            self.counts[k] = self.counts.get(k, 0) + v
        wake: set[str] | None = set()
        for r in rules:
            if by_rule.get(r.name):
                if r.triggers is None:
                    wake = None
                    break
                wake |= set(r.triggers)
        self.active = wake if n else self.active
        return n


def closure(ruleset: Ruleset, quads: DataFrame, graph: str = "<urn:inf:main>", **parameters: str) -> DataFrame:
    """The quads that the ruleset adds to quads."""
    return Closure(ruleset, quads, graph, parameters).run()
