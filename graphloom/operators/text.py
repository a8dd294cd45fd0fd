"""Queries as text: a subset of SPARQL over triples, parsed on the driver and built from ``operators.triples``.

``SELECT [DISTINCT] ?x (expr AS ?y) | * WHERE { triples, FILTER, BIND, OPTIONAL, MINUS, UNION, nested groups } [GROUP BY]
[ORDER BY] [LIMIT] [OFFSET]``, ``ASK { }``, ``INSERT { } WHERE { }`` and ``DELETE { } WHERE { }``. Terms are ``?variable``,
``<name>``, a bare name, ``"text"`` or a number. A comparison is numeric where a side is a number or arithmetic, and of
text otherwise; what is no number then is an error, which no FILTER accepts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import triples as t
from graphloom.operators.pattern import Pattern

_TOKEN = re.compile(r"""\s*(?:(?P<var>\?\w+)|<(?P<iri>[^<>\s=]*)>|"(?P<str>(?:[^"\\]|\\.)*)"|(?P<num>\d+(?:\.\d+)?)|(?P<op>&&|\|\||!=|<=|>=|[{}().,;=<>!+*/-])|(?P<word>[A-Za-z_][\w:^-]*))""")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class QueryError(ValueError):
    """The text is no query, or breaks a rule of grouping or of variables."""


@dataclass
class Query:
    """``form``: select, ask, insert or delete; ``items``: (name, expression) of a select, None for ``*``."""

    form: str
    where: list
    items: list[tuple[str, tuple]] | None = None
    template: list[tuple[str, str, str]] = field(default_factory=list)
    distinct: bool = False
    group: list[str] | None = None
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def next(self) -> tuple[str | None, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else (None, "")

    def takes(self, *words: str) -> str | None:
        kind, value = self.peek()
        if kind in ("word", "op") and value.upper() in words:
            self.at += 1
            return value.upper()
        return None

    def want(self, word: str) -> None:
        if not self.takes(word):
            raise QueryError(f"expected {word}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.next()
        if kind != "var":
            raise QueryError(f"expected a variable, found {value!r}")
        return value[1:]

    def integer(self) -> int:
        kind, value = self.next()
        if kind != "num" or "." in value:
            raise QueryError(f"expected a whole number, found {value!r}")
        return int(value)

    def query(self) -> Query:
        form = self.takes("SELECT", "ASK", "INSERT", "DELETE")
        if form is None:
            raise QueryError("a query begins with SELECT, ASK, INSERT or DELETE")
        q = Query(form.lower(), [])
        if form == "SELECT":
            q.distinct = self.takes("DISTINCT") is not None
            q.items = None if self.takes("*") else self.items()
        elif form != "ASK":
            self.want("{")
            q.template = self.triples()
            self.want("}")
        if form in ("INSERT", "DELETE"):
            self.want("WHERE")
        else:
            self.takes("WHERE")
        q.where = self.block()
        if self.takes("GROUP"):
            self.want("BY")
            q.group = [self.name()]
            while self.peek()[0] == "var":
                q.group.append(self.name())
        if self.takes("ORDER"):
            self.want("BY")
            q.order = self.ordering()
        while word := self.takes("LIMIT", "OFFSET"):
            n = self.integer()
            if word == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.peek()[0] is not None:
            raise QueryError(f"unexpected at the end: {self.peek()[1]!r}")
        return q

    def items(self) -> list[tuple[str, tuple]]:
        out = []
        while True:
            if self.peek()[0] == "var":
                name = self.name()
                out.append((name, ("var", name)))
            elif self.takes("("):
                e = self.expression()
                self.want("AS")
                out.append((self.name(), e))
                self.want(")")
            else:
                break
        if not out:
            raise QueryError("nothing is selected")
        return out

    def ordering(self) -> list[tuple[tuple, bool]]:
        out = []
        while self.peek()[0] == "var" or self.peek()[1] == "(" or self.peek()[1].upper() in ("ASC", "DESC"):
            down = self.takes("ASC", "DESC") == "DESC"
            out.append((self.primary(), down))
        return out

    def term(self) -> str:
        kind, value = self.next()
        if kind not in ("var", "iri", "str", "num", "word"):
            raise QueryError(f"expected a term, found {value!r}")
        return re.sub(r"\\(.)", r"\1", value) if kind == "str" else value

    def triples(self) -> list[tuple[str, str, str]]:
        """Triples up to something else; ``;`` goes on with the subject, ``,`` with subject and predicate."""
        out = []
        while self.peek()[0] in ("var", "iri", "str", "num", "word") and self.peek()[1].upper() not in ("FILTER", "BIND", "OPTIONAL", "MINUS", "UNION"):
            s, p, o = self.term(), self.term(), self.term()
            out.append((s, p, o))
            while sep := self.takes(";", ","):
                p = self.term() if sep == ";" else p
                out.append((s, p, self.term()))
            if not self.takes("."):
                break
        return out

    def block(self) -> list:
        self.want("{")
        out: list = []
        while not self.takes("}"):
            if self.peek()[0] is None:
                raise QueryError("a group is not closed")
            if self.takes("."):
                continue
            if self.takes("FILTER"):
                out.append(("filter", self.primary()))
            elif self.takes("BIND"):
                self.want("(")
                e = self.expression()
                self.want("AS")
                out.append(("bind", self.name(), e))
                self.want(")")
            elif word := self.takes("OPTIONAL", "MINUS"):
                out.append((word.lower(), self.block()))
            elif self.peek()[1] == "{" and self.peek()[0] == "op":
                parts = [self.block()]
                while self.takes("UNION"):
                    parts.append(self.block())
                out.append(("union", parts))
            else:
                found = self.triples()
                if not found:
                    raise QueryError(f"unexpected in a group: {self.peek()[1]!r}")
                out.append(("bgp", found))
        return out

    def expression(self, level: int = 0) -> tuple:
        levels = (("||",), ("&&",), ("=", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/"))
        if level == len(levels):
            return self.primary()
        left = self.expression(level + 1)
        while op := self.takes(*levels[level]):
            left = ("op", op, left, self.expression(level + 1))
        return left

    def primary(self) -> tuple:
        if self.takes("("):
            e = self.expression()
            self.want(")")
            return e
        if self.takes("!"):
            return ("not", self.primary())
        if self.takes("-"):
            return ("op", "-", ("num", 0.0), self.primary())
        kind, value = self.next()
        if kind == "var":
            return ("var", value[1:])
        if kind == "num":
            return ("num", float(value))
        if kind == "str":
            return ("str", re.sub(r"\\(.)", r"\1", value))
        if kind == "iri":
            return ("str", value)
        if kind == "word" and self.takes("("):
            distinct = self.takes("DISTINCT") is not None
            args = [("star",)] if self.takes("*") else [self.expression()]
            while self.takes(","):
                args.append(self.expression())
            self.want(")")
            return ("call", value.upper(), args, distinct)
        raise QueryError(f"expected an expression, found {value!r}")


def parse(text: str) -> Query:
    """The query of a text, checked: a QueryError says what is wrong."""
    q = _Parser(text).query()
    found = list(_triples(q.where))
    verbs = {p for _, p, _ in found if p.startswith("?")}
    both = verbs & {x for s, _, o in found for x in (s, o)}
    if both:
        raise QueryError(f"{sorted(both)[0]} is both a predicate and a subject or object")
    grouped = q.group is not None or any(_aggregates(e) for _, e in q.items or [])
    if grouped and q.items is None:
        raise QueryError("* can not be selected from groups")
    for name, e in (q.items or []) if grouped else []:
        free = _free(e) - set(q.group or [])
        if free:
            raise QueryError(f"?{name}: ?{sorted(free)[0]} is neither grouped nor aggregated")
    return q


def _triples(where: list):
    for part in where:
        if part[0] == "bgp":
            yield from part[1]
        elif part[0] in ("optional", "minus"):
            yield from _triples(part[1])
        elif part[0] == "union":
            for x in part[1]:
                yield from _triples(x)


def _aggregates(e: tuple) -> bool:
    return e[0] == "call" and e[1] in AGGREGATES or e[0] == "op" and (_aggregates(e[2]) or _aggregates(e[3]))


def _free(e: tuple) -> set[str]:
    """Variables outside aggregates."""
    match e[0]:
        case "var":
            return {e[1]}
        case "op":
            return _free(e[2]) | _free(e[3])
        case "not":
            return _free(e[1])
        case "call":
            return set() if e[1] in AGGREGATES else set().union(*map(_free, e[2]))
    return set()


def _value(e: tuple, known: list[str]) -> tuple[str, Column]:
    """(kind, column) of an expression; the kind is text, number or truth. An unbound variable is null."""
    match e[0]:
        case "var":
            return "text", F.col(e[1]) if e[1] in known else F.lit(None).cast("string")
        case "num":
            return "number", F.lit(e[1])
        case "str":
            return "text", F.lit(e[1])
        case "not":
            return "truth", ~_truth(e[1], known)
        case "op" if e[1] in ("&&", "||"):
            a, b = _truth(e[2], known), _truth(e[3], known)
            return "truth", a & b if e[1] == "&&" else a | b
        case "op" if e[1] in ("+", "-", "*", "/"):
            a, b = _number(e[2], known), _number(e[3], known)
            return "number", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e[1]]()
        case "op":
            (ka, a), (kb, b) = _value(e[2], known), _value(e[3], known)
            if ka != kb:
                a, b = _number(e[2], known), _number(e[3], known)
            return "truth", {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[e[1]]()
        case "call":
            args = [_value(x, known)[1].cast("string") for x in e[2]]
            made = {"CONTAINS": (2, "truth", F.contains), "STRSTARTS": (2, "truth", F.startswith), "STRENDS": (2, "truth", F.endswith), "REGEX": (2, "truth", F.regexp_like), "BOUND": (1, "truth", lambda x: x.isNotNull()), "STR": (1, "text", lambda x: x), "LCASE": (1, "text", F.lower), "UCASE": (1, "text", F.upper), "STRLEN": (1, "number", lambda x: F.length(x).cast("double"))}
            if e[1] not in made or made[e[1]][0] != len(args):
                raise QueryError(f"unknown function: {e[1]} of {len(args)}")
            _, kind, f = made[e[1]]
            return kind, f(*args)
    raise QueryError(f"no expression: {e[0]}")


def _truth(e: tuple, known: list[str]) -> Column:
    kind, c = _value(e, known)
    if kind != "truth":
        raise QueryError("a condition is expected")
    return c


def _number(e: tuple, known: list[str]) -> Column:
    kind, c = _value(e, known)
    if kind == "truth":
        raise QueryError("a number is expected")
    return c if kind == "number" else c.try_cast("double")


def solutions(triples: DataFrame, where: list) -> DataFrame:
    """Bindings of a group: patterns are joined as they are written, filters hold for the whole group."""
    out: DataFrame | None = None
    filters, maybe = [], set()
    for part in where:
        match part[0]:
            case "filter":
                filters.append(part[1])
                continue
            case "bgp":
                new, unbound = t.bgp(triples, part[1]), set()
            case "union":
                parts = [solutions(triples, x) for x in part[1]]
                new = reduce(t.union, parts)
                unbound = {c for c in new.columns if any(c not in x.columns for x in parts)}
            case "bind":
                if out is None or part[1] in out.columns:
                    raise QueryError(f"?{part[1]} is bound already, or nothing is before BIND")
                out = out.withColumn(part[1], _value(part[2], out.columns)[1].cast("string"))
                continue
            case kind:
                if out is None:
                    raise QueryError(f"nothing is before {kind.upper()}")
                new = solutions(triples, part[1])
                if kind == "minus":
                    out = t.minus(out, new)
                else:
                    maybe |= set(new.columns) - set(out.columns)
                    out = t.optional(out, new)
                continue
        shared = set(new.columns) & set(out.columns) if out is not None else set()
        out = new if out is None else t.compatible(out, new) if shared & (maybe | unbound) else t.join(out, new)
        maybe |= unbound
    if out is None:
        raise QueryError("the group has no pattern")
    for e in filters:
        out = out.where(_truth(e, out.columns))
    return out


def run(triples: DataFrame, text: str) -> DataFrame:
    """The result of a query: solutions, (answer) of ASK, or the triples after INSERT or DELETE."""
    q = parse(text)
    found = solutions(triples, q.where)
    if q.form == "ask":
        return t.ask(found)
    if q.form in ("insert", "delete"):
        return (t.insert if q.form == "insert" else t.delete)(triples, t.construct(found, q.template))
    items = q.items if q.items is not None else [(c, ("var", c)) for c in found.columns]
    if q.group is not None or any(_aggregates(e) for _, e in items):
        found, items = _grouped(found, items, q.group or [])
    known = found.columns
    unbound = [n for n, e in items if e[0] == "var" and e[1] not in known]
    found = found.withColumns({n: F.lit(None).cast("string") for n in unbound})
    made = {n: _value(e, known)[1] for n, e in items if e != ("var", n)}
    out = found.withColumns(made) if made else found
    names = [n for n, _ in items]
    keys = [k for e, down in q.order for k in _order(e, out, down)]
    if q.distinct:
        out = out.select(*names).distinct()
    if keys:
        out = out.orderBy(*keys, *[F.col(c) for c in names])  # ties by all that is selected, so that a limit is determined
    out = out.offset(q.offset) if q.offset else out
    return (out.limit(q.limit) if q.limit is not None else out).select(*names)


def _order(e: tuple, df: DataFrame, down: bool) -> list[Column]:
    """Numbers before text; a variable is ordered by its number first."""
    if e[0] == "var" and e[1] in df.columns and dict(df.dtypes)[e[1]] != "string":
        keys = [F.col(e[1])]
    else:
        kind, c = _value(e, df.columns)
        keys = [c] if kind != "text" else [c.try_cast("double"), c]
    return [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]


def _grouped(found: DataFrame, items: list[tuple[str, tuple]], keys: list[str]) -> tuple[DataFrame, list[tuple[str, tuple]]]:
    """Groups with one column for each aggregate, and the items over those columns."""
    what: dict[str, tuple[str, str]] = {}

    def lift(e: tuple, name: str | None = None) -> tuple:
        if e[0] == "op":
            return ("op", e[1], lift(e[2]), lift(e[3]))
        if e[0] != "call" or e[1] not in AGGREGATES:
            return e
        if len(e[2]) != 1 or e[2][0][0] not in ("var", "star"):
            raise QueryError("an aggregate is of one variable or *")
        out = name or f"_a{len(what)}"
        what[out] = (e[1].lower() + ("_distinct" if e[3] else ""), "*" if e[2][0][0] == "star" else e[2][0][1])
        return ("var", out)

    lifted = [(n, lift(e, n)) for n, e in items]
    return t.aggregate(found, keys, **what) if what else found.select(*keys).distinct(), lifted


def of_pattern(p: Pattern, k: int) -> str:
    """The text of a pattern: its edges, ranked by the sum of its nodes, the k best."""
    names = [f"?v{u}" for u in range(p.nodes)]
    edges = " . ".join(f'?v{a} "{r}" ?v{b}' for a, r, b in p.edges)
    return f"SELECT {' '.join(names)} WHERE {{ {edges} }} ORDER BY DESC({' + '.join(names)}) LIMIT {k}"
