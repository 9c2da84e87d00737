"""Names, types and implicit conversions; lowers syntax trees to Spark SQL text with every conversion explicit.

Catalyst gets one declarative statement for a whole query: joins, subqueries and aggregates stay visible to it, and no
Python runs per row.  Each source gets an alias of its own, so correlated references and repeated names can't be confused,
and a query's output columns are c1, c2, ... until the outermost level gives them their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from decimal import Decimal

from .. import types as ty
from ..errors import TsqlError
from ..functions import convert, registry
from ..types import SqlType
from .parser import Node


@dataclass
class Bound:
    """A bound expression: Spark SQL text, type, and what is known of it before execution."""

    sql: str
    type: SqlType
    literal: object = None  # value of a literal
    digits: int = 0  # digits of an integer literal
    is_null: bool = False
    collation: str | None = None
    aggregate: bool = False


@dataclass
class Source:
    names: list[str]  # exposed name, last part of it
    alias: str
    columns: list[tuple[str, SqlType, str]]  # name, type, SQL
    parts: list[str] = field(default_factory=list)


@dataclass
class Scope:
    sources: list[Source]
    outer: Scope | None = None

    def find(self, parts: list[str]) -> tuple[tuple[str, SqlType, str], int]:
        """The column and how many levels out it is."""
        scope, depth = self, 0
        name = parts[-1].lower()
        known = False
        while scope is not None:
            hits = []
            for s in scope.sources:
                if len(parts) > 1:
                    if not s.names or s.names[0].lower() != parts[-2].lower():
                        continue
                    known = True
                hits += [c for c in s.columns if c[0].lower() == name]
            if len(hits) > 1:
                raise TsqlError(209, f"Ambiguous column name '{parts[-1]}'.")
            if hits:
                return hits[0], depth
            scope, depth = scope.outer, depth + 1
        if len(parts) > 1 and not known:
            raise TsqlError(4104, f"The multi-part identifier \"{'.'.join(parts)}\" could not be bound.")
        raise TsqlError(207, f"Invalid column name '{parts[-1]}'.")


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


AGGREGATES = {"COUNT", "COUNT_BIG", "SUM", "AVG", "MIN", "MAX"}
WINDOWS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "PERCENT_RANK", "CUME_DIST"}


class Binder:
    """Binds against ``session``, which resolves tables, variables and server functions."""

    def __init__(self, session):
        self.session = session
        self.serial = 0
        self.ctes: list[dict] = []

    def fresh(self) -> str:
        self.serial += 1
        return f"t{self.serial}"

    # -- queries -----------------------------------------------------------------------------------------------------
    def query(self, q: Node, outer: Scope | None = None, top: bool = False) -> tuple[str, list[tuple[str, SqlType]]]:
        """SQL with columns c1.. and their names and types."""
        self.ctes.append({})
        try:
            for name, columns, inner in q.ctes:
                sql, cols = self.query(inner, None)
                self.ctes[-1][name.lower()] = (sql, [(n, t) for n, (_, t) in zip(columns or [c[0] for c in cols], cols, strict=True)])
            if q.body.kind == "query_spec":
                return self.select(q.body, q.order, outer, q.skip, q.fetch, top)
            sql, cols = self.body(q.body, outer)
            if not q.order and not q.skip:
                return sql, cols
            keys = []
            for e, desc in q.order:
                keys.append(f"{self.output_key(e, cols)}{' DESC' if desc else ''}")
            return f"SELECT * FROM ({sql}) {self.fresh()} ORDER BY {', '.join(keys)}{self.limits(q.skip, q.fetch)}", cols
        finally:
            self.ctes.pop()

    def limits(self, skip: Node | None, fetch: Node | None) -> str:
        out = f" LIMIT {self.whole_number(fetch)}" if fetch is not None else ""
        return out + (f" OFFSET {self.whole_number(skip)}" if skip is not None else "")

    def whole_number(self, e: Node) -> int:
        value = self.session.constant(self, e)
        if value is None:
            raise TsqlError(1060, "The number of rows provided for a TOP or FETCH clause must not be null.")
        if int(value) < 0:
            raise TsqlError(127, "A TOP N or FETCH rowcount value may not be negative.")
        return int(value)

    def body(self, b: Node, outer: Scope | None) -> tuple[str, list[tuple[str, SqlType]]]:
        if b.kind == "query":
            return self.query(b, outer)
        if b.kind == "query_spec":
            return self.select(b, [], outer)
        if b.kind == "values":
            rows = [[self.value(e, Scope([], outer)) for e in row] for row in b.rows]
            if len({len(r) for r in rows}) > 1:
                raise TsqlError(10709, "The number of columns for each row in a table value constructor must be the same.")
            types = [self.common([r[i] for r in rows]) for i in range(len(rows[0]))]
            lines = ["SELECT " + ", ".join(f"{self.to(v, t).sql} AS c{i + 1}" for i, (v, t) in enumerate(zip(r, types, strict=True))) for r in rows]
            if len(rows) > 1 and all(v.literal is not None or v.is_null for r in rows for v in r):
                tuples = ", ".join("(" + ", ".join(self.to(v, t).sql for v, t in zip(r, types, strict=True)) + ")" for r in rows)
                return f"SELECT * FROM VALUES {tuples} AS {self.fresh()}({', '.join(f'c{i + 1}' for i in range(len(types)))})", [("", t) for t in types]
            return " UNION ALL ".join(lines), [("", t) for t in types]
        # set operators: a run of the same UNION is typed as one
        operands = self.flattened(b)
        bound = [self.body(x, outer) for x in operands]
        if len({len(c) for _, c in bound}) > 1:
            raise TsqlError(205, "All queries combined using a UNION, INTERSECT or EXCEPT operator must have an equal number of expressions in their target lists.")
        width = len(bound[0][1])
        literals = [self.item_literals(x, width) for x in operands]
        types = []
        for i in range(width):
            column = [Bound("", c[i][1], digits=d[i], is_null=c[i][1].name == "null") for (_, c), d in zip(bound, literals, strict=True)]
            types.append(self.common(column))
        parts = []
        for sql, cols in bound:
            if [t for _, t in cols] != types:
                a = self.fresh()
                sql = f"SELECT {', '.join(f'{self.to(Bound(f'{a}.c{i + 1}', cols[i][1]), types[i]).sql} AS c{i + 1}' for i in range(width))} FROM ({sql}) {a}"
            a = self.fresh()
            parts.append(f"(SELECT * FROM ({sql}) {a})")
        word = f" {b.op}{' ALL' if b.all and b.op == 'UNION' else ''} "
        out = [(n, t) for (n, _), t in zip(bound[0][1], types, strict=True)]
        if self.session.spark_collation(None) and any(t.is_string for t in types) and not (b.all and b.op == "UNION"):
            if b.op == "UNION":
                return self.distinct(" UNION ALL ".join(parts), [Bound("", t) for t in types]), out
            columns = ", ".join(f"{self.collated(Bound(f'c{i + 1}', t)).sql} AS c{i + 1}" for i, t in enumerate(types))
            parts = [f"(SELECT {columns} FROM {p} {self.fresh()})" for p in parts]
        return f"SELECT * FROM ({word.join(parts)}) {self.fresh()}", out

    def flattened(self, b: Node) -> list[Node]:
        out = []
        for side in (b.left, b.right):
            out += self.flattened(side) if side is b.left and side.kind == "set_op" and side.op == b.op and side.all == b.all and b.op == "UNION" else [side]
        return out

    @staticmethod
    def item_literals(x: Node, width: int) -> list[int]:
        """Digits of the select items that are bare integer literals."""
        if x.kind != "query_spec" or len(x.items) != width:
            return [0] * width
        values = [i.get("value") for i in x.items]
        return [len(v.value.lstrip("0") or "0") if v is not None and v.kind == "lit" and v.kind_ == "num" and v.value.isdigit() else 0 for v in values]

    def output_key(self, e: Node, cols: list[tuple[str, SqlType]]) -> str:
        """A sort key of a set operation: a position or an output name."""
        if e.kind == "lit" and e.kind_ == "num":
            n = int(e.value)
            if not 1 <= n <= len(cols):
                raise TsqlError(108, f"The ORDER BY position number {n} is out of range of the number of items in the select list.")
            return f"c{n}"
        if e.kind == "col" and len(e.parts) == 1:
            for i, (name, _) in enumerate(cols):
                if name.lower() == e.parts[0].lower():
                    return f"c{i + 1}"
        raise TsqlError(104, "ORDER BY items must appear in the select list if the statement contains a UNION, INTERSECT or EXCEPT operator.")

    def select(self, s: Node, order: list, outer: Scope | None, skip=None, fetch=None, top_level=False) -> tuple[str, list[tuple[str, SqlType]]]:
        sources, from_sql = [], None
        if s.source is not None:
            from_sql, sources = self.from_tree(s.source, outer)
            names = [x.names[0].lower() for x in sources if x.names]
            if len(set(names)) < len(names):
                raise TsqlError(1013, "The objects in the FROM clause have the same exposed names. Use correlation names to distinguish them.")
        scope = Scope(sources, outer)
        where = self.condition(s.where, scope) if s.where is not None else None
        items = self.items(s, scope)
        grouped = s.group is not None or s.having is not None or any(self.has_aggregate(e) for _, e in items) or any(self.has_aggregate(e) for e, _ in order)
        keys = []
        if s.group is not None:
            for e in s.group:
                if self.has_aggregate(e):
                    raise TsqlError(144, "Cannot use an aggregate or a subquery in an expression used for the group by list of a GROUP BY clause.")
                keys.append(self.value(e, scope))
        if s.where is not None and self.has_aggregate(s.where):
            raise TsqlError(147, "An aggregate may not appear in the WHERE clause unless it is in a subquery contained in a HAVING clause or a select list.")
        group = Grouping({k.sql: k.sql if self.collated(k) is k else f"min({k.sql})" for k in keys}) if grouped else None
        bound = [(name, self.value(e, scope, group) if not isinstance(e, Bound) else e) for name, e in items]
        cols = [(name, b.type if b.type.name != "null" else ty.INT) for name, b in bound]
        select = ", ".join(f"{b.sql} AS c{i + 1}" for i, (_, b) in enumerate(bound)) or "1"
        having = self.condition(s.having, scope, group) if s.having is not None else None
        sort = []
        for e, desc in order:
            sort.append((self.sort_key(e, bound, items, scope, group, s.distinct), desc))
        tail = f" FROM {from_sql}" if from_sql else ""
        if where:
            tail += f" WHERE {where}"
        if s.group is not None:
            # a constant is a key like any other, not a position
            tail += " GROUP BY " + ", ".join(self.collated(k).sql for k in keys)
        if having:
            if s.group is None and not any(self.has_aggregate(e) for _, e in items if not isinstance(e, Bound)) and not self.has_aggregate(s.having):
                tail += " GROUP BY ()"
            tail += f" HAVING {having}"
        sql = f"SELECT {'DISTINCT ' if s.distinct else ''}{select}{tail}"
        if s.distinct and any(self.collated(b) is not b for _, b in bound):
            sql = self.distinct(f"SELECT {select}{tail}", [b for _, b in bound])
        by = f" ORDER BY {', '.join(k + (' DESC' if d else '') for k, d in sort)}" if sort else ""
        if s.top is not None:
            return self.top(s, sql, select, tail, sort, by, bound, outer), cols
        if skip is not None or fetch is not None:
            return sql + by + self.limits(skip, fetch), cols
        if by and not top_level and outer is None and not self.session.keeps_order:
            by = ""  # without TOP the order of an inner query means nothing
        return sql + by, cols

    def distinct(self, sql: str, values: list[Bound]) -> str:
        """One row for each set of rows that the collation makes equal."""
        a = self.fresh()
        plain = [replace(v, sql=f"{a}.c{i + 1}") for i, v in enumerate(values)]
        out = ", ".join(f"{v.sql if self.collated(v) is v else f'min({v.sql})'} AS c{i + 1}" for i, v in enumerate(plain))
        return f"SELECT {out} FROM ({sql}) {a} GROUP BY {', '.join(self.collated(v).sql for v in plain)}"

    def top(self, s: Node, sql: str, select: str, tail: str, sort: list, by: str, bound: list, outer: Scope | None) -> str:
        t = s.top
        if t.ties and not sort:
            raise TsqlError(1062, "The TOP N WITH TIES clause is not allowed without a corresponding ORDER BY clause.")
        if t.percent:
            share = self.session.constant(self, t.count)
            if share is None or not 0 <= float(share) <= 100:
                raise TsqlError(1031, "Percent values must be between 0 and 100.")
            rows = self.session.spark.sql(f"SELECT count(*) AS n FROM ({sql}) {self.fresh()}").first()[0]
            exact = Decimal(rows) * Decimal(str(share)) / 100
            return f"{sql}{by} LIMIT {int(exact) + (exact != int(exact))}"
        n = self.whole_number(t.count)
        if not t.ties or n == 0:
            return f"{sql}{by} LIMIT {n}"
        over = ", ".join(f"k{i + 1}{' DESC' if d else ''}" for i, (_, d) in enumerate(sort))
        keys = [f"k{i + 1}" for i in range(len(sort))]
        inner = f"SELECT {'DISTINCT ' if s.distinct else ''}{select}, {', '.join(re.sub(r"(?<![\\w.`'])c([0-9]+)(?![\\w`'])", lambda m: bound[int(m[1]) - 1][1].sql, k) + f' AS k{i + 1}' for i, (k, _) in enumerate(sort))}{tail}"
        columns = ", ".join(f"c{i + 1}" for i in range(len(bound)))
        # the n-th row's keys by a top-n, then every row up to them; a null key ties with none
        back = ", ".join(f"k{i + 1}{'' if d else ' DESC'}" for i, (_, d) in enumerate(sort))
        a, z = self.fresh(), self.fresh()
        last = f"(SELECT {', '.join(keys)} FROM (SELECT {', '.join(keys)} FROM ({inner}) {self.fresh()} ORDER BY {over} LIMIT {n}) {self.fresh()} ORDER BY {back} LIMIT 1)"
        upto = "TRUE"
        for k, (_, d) in reversed(list(zip(keys, sort, strict=True))):
            less = f"({a}.{k} > {z}.{k} OR ({a}.{k} IS NOT NULL AND {z}.{k} IS NULL))" if d else f"({a}.{k} < {z}.{k} OR ({a}.{k} IS NULL AND {z}.{k} IS NOT NULL))"
            upto = f"({less} OR ({a}.{k} <=> {z}.{k} AND {upto}))"
        known = " AND ".join(f"{z}.{k} IS NOT NULL" for k in keys)
        tied = f"SELECT {', '.join(f'{a}.c{i + 1}' for i in range(len(bound)))}, {', '.join(f'{a}.{k}' for k in keys)} FROM ({inner}) {a} CROSS JOIN {last} {z} WHERE {known} AND {upto}"
        plain = f"SELECT {columns}, {', '.join(keys)} FROM (SELECT * FROM ({inner}) {self.fresh()} ORDER BY {over} LIMIT {n}) {a} CROSS JOIN {last} {z} WHERE NOT ({known})".replace(f"SELECT {columns}, {', '.join(keys)}", f"SELECT {', '.join(f'{a}.c{i + 1}' for i in range(len(bound)))}, {', '.join(f'{a}.{k}' for k in keys)}", 1)
        return f"SELECT {columns} FROM ({tied} UNION ALL {plain}) {self.fresh()} ORDER BY {over}"

    def items(self, s: Node, scope: Scope) -> list[tuple[str, object]]:
        out = []
        for i in s.items:
            if i.kind == "star":
                picked = [x for x in scope.sources if not i.prefix or x.names and x.names[0].lower() == i.prefix[-1].lower()]
                if not picked:
                    raise TsqlError(107 if i.prefix else 263, "The column prefix does not match with a table name or alias name used in the query.")
                out += [(c[0], Node("bound_col", source=x, column=c)) for x in picked for c in x.columns]
            elif i.kind == "assign":
                out.append((i.var, i.value))
            else:
                name = i.name if i.name is not None else i.value.parts[-1] if i.value.kind == "col" else ""
                out.append((name, i.value))
        return out

    def sort_key(self, e: Node, bound: list, items: list, scope: Scope, group, distinct: bool) -> str:
        if e.kind == "lit" and e.kind_ == "num" and e.value.isdigit():
            n = int(e.value)
            if not 1 <= n <= len(bound):
                raise TsqlError(108, f"The ORDER BY position number {n} is out of range of the number of items in the select list.")
            return f"c{n}"
        if e.kind == "lit":
            raise TsqlError(408, "A constant expression was encountered in the ORDER BY list.")
        if e.kind == "col" and len(e.parts) == 1:
            hits = [i for i, (name, _) in enumerate(bound) if name.lower() == e.parts[0].lower()]
            if len(hits) > 1 and len({bound[i][1].sql for i in hits}) > 1:
                raise TsqlError(209, f"Ambiguous column name '{e.parts[0]}'.")
            if hits:
                return self.collated(replace(bound[hits[0]][1], sql=f"c{hits[0] + 1}")).sql
        key = self.value(e, scope, group)
        for i, (_, b) in enumerate(bound):
            if b.sql == key.sql:
                return self.collated(replace(key, sql=f"c{i + 1}")).sql
        if distinct:
            raise TsqlError(145, "ORDER BY items must appear in the select list if SELECT DISTINCT is specified.")
        return self.collated(key).sql

    # -- FROM --------------------------------------------------------------------------------------------------------
    def from_tree(self, f: Node, outer: Scope | None) -> tuple[str, list[Source]]:
        if f.kind == "join":
            left_sql, left = self.from_tree(f.left, outer)
            right_sql, right = self.from_tree(f.right, outer)
            if f.kind_ == "CROSS":
                return f"{left_sql} CROSS JOIN {right_sql}", left + right
            on = self.condition(f.on, Scope(left + right, outer))
            right_sql = f"({right_sql})" if f.right.kind == "join" else right_sql
            return f"{left_sql} {f.kind_} JOIN {right_sql} ON {on}", left + right
        if f.kind == "apply":
            left_sql, left = self.from_tree(f.left, outer)
            sql, cols = self.query(f.right.query, Scope(left, outer))
            a = self.fresh()
            source = self.derived(f.right.alias, f.right.columns, cols, a)
            return f"{left_sql} {'LEFT JOIN' if f.outer else 'INNER JOIN'} LATERAL ({sql}) {a} ON TRUE", [*left, source]
        if f.kind == "derived":
            if not f.alias:
                raise TsqlError(102, "A derived table needs an alias.")
            sql, cols = self.query(f.query, None)
            a = self.fresh()
            return f"({sql}) {a}", [self.derived(f.alias, f.columns, cols, a)]
        a = self.fresh()
        for level in reversed(self.ctes):
            if len(f.parts) == 1 and f.parts[0].lower() in level:
                sql, cols = level[f.parts[0].lower()]
                return f"({sql}) {a}", [self.derived(f.alias or f.parts[0], None, cols, a)]
        view, columns = self.session.resolve(f.parts)
        name = f.alias or f.parts[-1]
        sql = f"{view} {a}"
        return sql, [Source([name], a, [(c, t, f"{a}.`{c}`") for c, t in columns], f.parts)]

    @staticmethod
    def derived(alias: str, columns: list[str] | None, cols: list[tuple[str, SqlType]], a: str) -> Source:
        names = columns or [c[0] for c in cols]
        if len(names) != len(cols):
            raise TsqlError(8158 if len(cols) > len(names) else 8159, f"'{alias}' has a different number of columns than were specified in the column list.")
        for n in names:
            if not n:
                raise TsqlError(8155, f"No column name was specified for a column of '{alias}'.")
        if len({n.lower() for n in names}) < len(names):
            raise TsqlError(8156, f"A column was specified multiple times for '{alias}'.")
        return Source([alias], a, [(n, t, f"{a}.c{i + 1}") for i, (n, (_, t)) in enumerate(zip(names, cols, strict=True))])

    # -- predicates --------------------------------------------------------------------------------------------------
    def condition(self, e: Node, scope: Scope, group=None) -> str:
        v = lambda x: self.value(x, scope, group)
        if e.kind in ("and", "or"):
            return f"({self.condition(e.left, scope, group)} {e.kind.upper()} {self.condition(e.right, scope, group)})"
        if e.kind == "not":
            return f"(NOT {self.condition(e.value, scope, group)})"
        if e.kind == "compare":
            return self.compare(e.op, v(e.left), v(e.right))
        if e.kind == "is_null":
            return f"({v(e.value).sql} IS {'NOT ' if e.negated else ''}NULL)"
        if e.kind == "between":
            x, low, high = v(e.value), v(e.low), v(e.high)
            inside = f"({self.compare('>=', x, low)} AND {self.compare('<=', x, high)})"
            return f"(NOT {inside})" if e.negated else inside
        if e.kind == "in":
            x, options = v(e.value), [v(o) for o in e.options]
            t = self.common([x, *options])
            if all(o.literal is not None for o in options):
                inside = f"{self.collated(self.to(x, t)).sql} IN ({', '.join(self.collated(self.to(o, t)).sql for o in options)})"
            else:
                inside = " OR ".join(self.compare("=", x, o) for o in options)
            return f"(NOT ({inside}))" if e.negated else f"({inside})"
        if e.kind == "like":
            return self.like(v(e.value), v(e.pattern), v(e.escape) if e.escape is not None else None, e.negated)
        if e.kind == "exists":
            sql, _ = self.query(e.query, scope)
            return f"EXISTS ({sql})"
        if e.kind == "in_query":
            sql, cols = self.query(e.query, scope)
            if len(cols) != 1:
                raise TsqlError(116, "Only one expression can be specified in the select list when the subquery is not introduced with EXISTS.")
            x = v(e.value)
            t = self.common([x, Bound("", cols[0][1])])
            a = self.fresh()
            theirs = self.collated(self.to(Bound(f"{a}.c1", cols[0][1], collation=x.collation), t))
            if theirs.sql != f"{a}.c1":
                sql = f"SELECT {theirs.sql} FROM ({sql}) {a}"
            return f"({self.collated(self.to(x, t)).sql} {'NOT ' if e.negated else ''}IN ({sql}))"
        if e.kind == "quantified":
            return self.quantified(e, scope, group)
        raise TsqlError(4145, "An expression of non-boolean type specified in a context where a condition is expected.")

    def quantified(self, e: Node, scope: Scope, group) -> str:
        """``= ANY`` is IN and ``<> ALL`` NOT IN; other forms ask for the comparison's value among the rows."""
        if (e.op, e.every) in (("=", False), ("<>", True)):
            return self.condition(Node("in_query", value=e.value, query=e.query, negated=e.every), scope, group)
        sql, cols = self.query(e.query, scope)
        if len(cols) != 1:
            raise TsqlError(116, "Only one expression can be specified in the select list when the subquery is not introduced with EXISTS.")
        x = self.value(e.value, scope, group)
        a = self.fresh()
        t = self.common([x, Bound("", cols[0][1])])
        if e.op in ("<", "<=", ">", ">="):
            # the extreme decides, with nulls and the empty set told apart
            largest = (e.op in (">", ">=")) == e.every
            y = self.collated(self.to(Bound(f"{a}.c1", cols[0][1], collation=x.collation), t)).sql
            pick = f"(SELECT struct({'max' if largest else 'min'}({y}) AS v, count(*) AS n, count({y}) AS k) FROM ({sql}) {a})"
            test = f"({self.collated(self.to(x, t)).sql} {e.op} {pick}.v)"
            if e.every:
                return f"(CASE WHEN {pick}.n = 0 THEN TRUE WHEN NOT {test} THEN FALSE WHEN {pick}.k < {pick}.n THEN NULL ELSE {test} END)"
            return f"(CASE WHEN {pick}.n = 0 THEN FALSE WHEN {test} THEN TRUE WHEN {pick}.k < {pick}.n THEN NULL ELSE {test} END)"
        y = self.collated(self.to(Bound(f"{a}.c1", cols[0][1], collation=x.collation), t)).sql
        pick = f"(SELECT struct(min({y}) AS lo, max({y}) AS hi, count(*) AS n, count({y}) AS k) FROM ({sql}) {a})"
        own = self.collated(self.to(x, t)).sql
        if e.every:  # = ALL
            return f"(CASE WHEN {pick}.n = 0 THEN TRUE WHEN {own} <> {pick}.lo OR {own} <> {pick}.hi THEN FALSE WHEN {pick}.k < {pick}.n THEN NULL ELSE {own} = {pick}.lo END)"
        return f"(CASE WHEN {pick}.n = 0 THEN FALSE WHEN {own} <> {pick}.lo OR {own} <> {pick}.hi THEN TRUE WHEN {pick}.k < {pick}.n THEN NULL ELSE {own} <> {pick}.lo END)"

    def compare(self, op: str, a: Bound, b: Bound) -> str:
        t = self.common([a, b])
        x, y = self.to(a, t), self.to(b, t)
        if t.is_string:
            x, y = self.collated(replace(x, collation=a.collation or b.collation)), self.collated(replace(y, collation=a.collation or b.collation))
        if t.is_binary and op in ("=", "<>"):
            # the shorter side counts as padded with zero bytes
            x, y = (replace(z, sql=f"rtrim('0', hex({z.sql}))") for z in (x, y))
        if t.name == "bit" and op in ("=", "<>") and b.literal is not None and a.type.name == "bit" and b.type.name == "bit":
            return f"({a.sql} {op} {b.sql})"
        return f"({x.sql} {op} {y.sql})"

    def collated(self, x: Bound) -> Bound:
        if not x.type.is_string:
            return x
        name = self.session.spark_collation(x.collation)
        return x if name is None else replace(x, sql=f"collate({x.sql}, '{name}')")

    def like(self, x: Bound, pattern: Bound, escape: Bound | None, negated: bool) -> str:
        no = "NOT " if negated else ""
        text = self.to_string(x)
        if pattern.is_null or x.is_null:
            return "CAST(NULL AS BOOLEAN)"
        mark = escape.literal if escape is not None and not escape.is_null else None
        if mark is not None and len(str(mark)) != 1:
            raise TsqlError(506, "The invalid escape character was specified in a LIKE predicate.")
        insensitive = self.session.insensitive(x.collation or pattern.collation)
        if escape is not None and mark is None and not escape.is_null:
            raise TsqlError(50000, "ESCAPE needs a constant character.")
        if not isinstance(pattern.literal, str):
            return f"({no}rlike({text.sql}, concat({quote('(?is)^' if insensitive else '(?s)^')}, {like_regex_sql(self.to_string(pattern).sql, mark)}, ' *$')))"
        simple = "[" not in pattern.literal and mark is None and "\\" not in pattern.literal
        if simple and not insensitive and pattern.literal.endswith("%"):
            return f"({text.sql} {no}LIKE {quote(pattern.literal)})"
        body = like_regex(pattern.literal, mark)
        return f"({no}rlike({text.sql}, {quote(('(?is)' if insensitive else '(?s)') + '^' + body + ' *$')}))"

    # -- values ------------------------------------------------------------------------------------------------------
    def value(self, e: Node, scope: Scope, group: Grouping | None = None) -> Bound:
        if group is not None and e.kind not in ("lit", "var", "bound_col") and not self.has_aggregate(e) and e.kind != "scalar":
            try:
                plain = self.value(e, scope)
            except TsqlError:
                plain = None
            if plain is not None and plain.sql in group.keys:
                # of the spellings that a collation makes equal the smallest stands for the group
                return replace(plain, sql=group.keys[plain.sql])
        kind = e.kind
        if kind == "lit":
            return literal(e)
        if kind == "bound_col":
            name, t, sql = e.column
            if group is not None and not group.inside and sql not in group.keys:
                raise TsqlError(8120, f"Column '{name}' is invalid in the select list because it is not contained in either an aggregate function or the GROUP BY clause.")
            return Bound(sql, t)
        if kind == "col":
            (name, t, sql), depth = scope.find(e.parts)
            if group is not None and depth == 0 and not group.inside and sql not in group.keys:
                raise TsqlError(8120, f"Column '{name}' is invalid in the select list because it is not contained in either an aggregate function or the GROUP BY clause.")
            return Bound(sql, t)
        if kind == "var":
            return self.session.variable(e.name)
        if kind == "binary":
            return self.binary(e.op, self.value(e.left, scope, group), self.value(e.right, scope, group))
        if kind == "unary":
            return self.unary(e.op, self.value(e.value, scope, group))
        if kind == "case":
            tests = [self.condition(t, scope, group) for t, _ in e.arms]
            results = [self.value(r, scope, group) for _, r in e.arms]
            other = self.value(e.other, scope, group) if e.other is not None else Bound("NULL", ty.NULL, is_null=True)
            if all(r.is_null for r in [*results, other]):
                raise TsqlError(8133, "At least one of the result expressions in a CASE specification must be an expression other than the NULL constant.")
            t = self.common([*results, other])
            arms = " ".join(f"WHEN {c} THEN {self.to(r, t).sql}" for c, r in zip(tests, results, strict=True))
            return Bound(f"(CASE {arms} ELSE {self.to(other, t).sql} END)", t)
        if kind == "cast":
            x = self.value(e.value, scope, group)
            target = ty.named(*e.type, cast=True)
            style = self.value(e.style, scope, group).literal if e.style is not None else None
            return convert.convert(self, x, target, int(style) if style is not None else None, e.try_)
        if kind == "collate":
            self.session.spark_collation(e.name)
            return replace(self.value(e.value, scope, group), collation=e.name)
        if kind == "scalar":
            sql, cols = self.query(e.query, scope)
            if len(cols) != 1:
                raise TsqlError(116, "Only one expression can be specified in the select list when the subquery is not introduced with EXISTS.")
            return Bound(f"({sql})", cols[0][1])
        if kind == "call":
            return self.call(e, scope, group)
        if kind in ("compare", "and", "or", "not"):
            raise TsqlError(102, "Incorrect syntax near a predicate.")
        raise TsqlError(50000, f"{kind} is not implemented here.")

    def common(self, values: list[Bound]) -> SqlType:
        """Common type; an integer literal enters with its own digits where a decimal is among the others."""
        types = [v.type for v in values if not v.is_null]
        if any(t.name == "decimal" for t in types):
            types = [ty.decimal(v.digits, 0) if v.digits and v.type.is_integer else v.type for v in values if not v.is_null]
        top = ty.common(types) if types else ty.INT
        if top.is_date and any(t.is_binary for t in types) or top.name == "uniqueidentifier" and any(t.is_numeric for t in types):
            raise TsqlError(206, "Operand type clash.")
        return top

    def to(self, x: Bound, t: SqlType) -> Bound:
        return x if x.type == t and not x.is_null else convert.convert(self, x, t, None, False, implicit=True)

    def to_string(self, x: Bound) -> Bound:
        return x if x.type.is_string else convert.convert(self, x, ty.varchar(ty.MAX), None, False)

    def unary(self, op: str, x: Bound) -> Bound:
        if op == "~":
            if x.type.name == "bit":
                return Bound(f"(NOT {x.sql})", ty.BIT)
            if not x.type.is_integer:
                raise TsqlError(8117, f"Operand data type {x.type.name} is invalid for '~' operator.")
            return Bound(f"(~ {x.sql})", x.type)
        if x.is_null:
            return x
        if not x.type.is_numeric or x.type.name == "bit":
            raise TsqlError(8117, f"Operand data type {x.type.name} is invalid for minus operator.")
        if op == "+":
            return x
        value = -x.literal if isinstance(x.literal, (int, float, Decimal)) else None
        t = ty.SqlType("smallint") if x.type.name == "tinyint" else x.type
        return Bound(f"(- {x.sql})", t, literal=value, digits=x.digits)

    def binary(self, op: str, a: Bound, b: Bound) -> Bound:
        ta, tb = a.type, b.type
        if a.is_null or b.is_null:
            known = tb if a.is_null else ta
            t = known if not (a.is_null and b.is_null) else ty.INT
            return Bound(f"CAST(NULL AS {t.spark()})", t)
        if op == "+" and (ta.is_string or ta.is_binary) and (tb.is_string or tb.is_binary) and ta.is_string == tb.is_string:
            t = ty.common([ta, tb])
            cap = 4000 if t.name in ("nchar", "nvarchar") else 8000
            if ta.is_string:
                size = ty.MAX if ty.MAX in (ta.n, tb.n) else min(cap, ta.n + tb.n)
                t = SqlType({"char": "varchar", "nchar": "nvarchar"}.get(t.name, t.name), n=size)
                return Bound(f"concat({a.sql}, {b.sql})", t, collation=a.collation or b.collation)
            return Bound(f"concat({a.sql}, {b.sql})", SqlType("varbinary", n=ty.MAX if ty.MAX in (ta.n, tb.n) else ta.n + tb.n))
        if ta.is_string and tb.is_numeric or tb.is_string and ta.is_numeric:
            if ta.is_string:
                a = self.to(a, tb)
            else:
                b = self.to(b, ta)
            ta = tb = a.type if ta.is_string else b.type
        if ta.is_string and tb.is_string:
            raise TsqlError(8117 if op != "%" else 402, f"Operand data type {ta.name} is invalid for {op} operator.")
        if op in "&|^":
            if not all(t.is_integer or t.name == "bit" for t in (ta, tb)):
                raise TsqlError(402, f"The data types {ta.name} and {tb.name} are incompatible in the '{op}' operator.")
            t = ty.common([ta, tb])
            if t.name == "bit":
                word = {"&": f"({a.sql} AND {b.sql})", "|": f"({a.sql} OR {b.sql})", "^": f"({a.sql} <> {b.sql})"}[op]
                return Bound(word, t)
            return Bound(f"({self.to(a, t).sql} {op} {self.to(b, t).sql})", t)
        if ta.is_date or tb.is_date:
            legacy = ("datetime", "smalldatetime")
            if op in "+-" and (ta.name in legacy and tb.is_numeric or tb.name in legacy and ta.is_numeric and op == "+"):
                day, n = (a, b) if ta.is_date else (b, a)
                sign = "-" if op == "-" else ""
                return Bound(f"timestampadd(MICROSECOND, CAST(round({sign}({self.to(n, ty.FLOAT).sql}) * 86400000000D) AS BIGINT), {day.sql})", day.type)
            raise TsqlError(206 if op in "+-" else 402, f"Operand type clash: {ta.name} is incompatible with {tb.name}.")
        if ta.name == "bit" and tb.name == "bit" or not (ta.is_numeric and tb.is_numeric):
            raise TsqlError(402 if ta.name == "bit" else 8117, f"The data types {ta.name} and {tb.name} are incompatible in the operator.")
        if ta.is_float or tb.is_float:
            if op == "%":
                raise TsqlError(402, "The data types are incompatible in the modulo operator.")
            t = ty.common([ta, tb])
            x, y = self.to(a, t).sql, self.to(b, t).sql
            return Bound(f"({x} {op} {y})" if op != "/" else f"CAST({x} / {y} AS {t.spark()})", t)
        if "decimal" in (ta.name, tb.name):
            ea = (a.digits, 0) if a.digits and ta.is_integer else ta.exact()
            eb = (b.digits, 0) if b.digits and tb.is_integer else tb.exact()
            t = ty.exact_result(op, ea, eb)
            x = a.sql if ta.name == "decimal" else f"CAST({a.sql} AS DECIMAL({ea[0]},{ea[1]}))" if ta.name != "bit" else f"CAST(CAST({a.sql} AS INT) AS DECIMAL(1,0))"
            y = b.sql if tb.name == "decimal" else f"CAST({b.sql} AS DECIMAL({eb[0]},{eb[1]}))" if tb.name != "bit" else f"CAST(CAST({b.sql} AS INT) AS DECIMAL(1,0))"
            if op == "/":
                return Bound(truncated_quotient(x, y, t), t)
            return Bound(f"CAST(({x} {op} {y}) AS {t.spark()})", t)
        t = ty.common([ta, tb])
        x, y = self.to(a, t).sql, self.to(b, t).sql
        if t.name in ty.MONEY:
            return Bound(truncated_quotient(x, y, t) if op == "/" else f"CAST(({x} {op} {y}) AS {t.spark()})", t)
        word = "div" if op == "/" else op
        sql = f"({x} {word} {y})"
        return Bound(f"CAST({sql} AS {t.spark()})" if word == "div" and t.name != "bigint" else sql, t)

    # -- calls -------------------------------------------------------------------------------------------------------
    def call(self, e: Node, scope: Scope, group: Grouping | None) -> Bound:
        name = e.name
        if e.over is not None:
            return self.window(e, scope, group)
        if name in AGGREGATES:
            if group is None:
                # an aggregate whose columns are all of an enclosing query is computed there
                raise TsqlError(147, "An aggregate may not appear here.")
            if group.inside:
                raise TsqlError(130, "Cannot perform an aggregate function on an expression containing an aggregate or a subquery.")
            return self.aggregate(name, e, scope)
        if name in WINDOWS:
            raise TsqlError(10753, f"The function '{name}' must have an OVER clause.")
        function = registry.SCALARS.get(name)
        if function is None:
            raise TsqlError(195, f"'{name}' is not a recognized built-in function name.")
        low, high, fn, lazy = function
        if not low <= len(e.args) <= high:
            raise TsqlError(174 if low == high else 189, f"The {name.lower()} function requires {low} argument(s).")
        if lazy:  # the first argument is a date part
            part = e.args[0]
            word = part.parts[0] if part.kind == "col" and len(part.parts) == 1 else None
            if word is None:
                raise TsqlError(1023, f"Invalid parameter 1 specified for {name.lower()}.")
            return fn(self, word.lower(), *[self.value(x, scope, group) for x in e.args[1:]])
        return fn(self, *[self.value(x, scope, group) for x in e.args])

    def aggregate(self, name: str, e: Node, scope: Scope) -> Bound:
        if e.star:
            if name not in ("COUNT", "COUNT_BIG"):
                raise TsqlError(102, "Incorrect syntax near '*'.")
            return Bound("CAST(count(1) AS INT)" if name == "COUNT" else "count(1)", ty.INT if name == "COUNT" else ty.BIGINT, aggregate=True)
        if len(e.args) != 1:
            raise TsqlError(174, f"The {name.lower()} function requires 1 argument(s).")
        if self.has_aggregate(e.args[0]):
            raise TsqlError(130, "Cannot perform an aggregate function on an expression containing an aggregate or a subquery.")
        x = self.value(e.args[0], scope, Grouping({}, inside=True))
        if x.is_null:
            raise TsqlError(8117, f"Operand data type NULL is invalid for {name.lower()} operator.")
        d = "DISTINCT " if e.distinct else ""
        t = x.type
        if name in ("COUNT", "COUNT_BIG"):
            arg = self.collated(x).sql if e.distinct else x.sql
            return Bound(f"CAST(count({d}{arg}) AS INT)" if name == "COUNT" else f"count({d}{arg})", ty.INT if name == "COUNT" else ty.BIGINT)
        if name in ("MIN", "MAX"):
            if t.name == "bit":
                raise TsqlError(8117, f"Operand data type bit is invalid for {name.lower()} operator.")
            fn = name.lower()
            c = self.collated(x)
            return Bound(f"{fn}({x.sql})" if c is x else f"{fn}_by({x.sql}, {c.sql})", t)
        if not t.is_numeric or t.name == "bit":
            raise TsqlError(8117, f"Operand data type {t.name} is invalid for {name.lower()} operator.")
        if t.is_integer:
            r = ty.BIGINT if t.name == "bigint" else ty.INT
            if name == "SUM":
                return Bound(f"CAST(sum({d}{x.sql}) AS {r.spark()})", r)
            total = f"CAST(sum({d}CAST({x.sql} AS DECIMAL(19,0))) AS DECIMAL(38,0))"
            return Bound(f"CAST(({total} div count({d}{x.sql})) AS {r.spark()})", r)
        if t.name in ty.MONEY:
            r = SqlType("money")
            total = f"CAST(sum({d}{x.sql}) AS DECIMAL(19,4))"
            return Bound(total if name == "SUM" else truncated_quotient(total, f"CAST(count({d}{x.sql}) AS DECIMAL(19,0))", r), r)
        if t.name == "decimal":
            total = f"sum({d}CAST({x.sql} AS DECIMAL(38,{t.s})))"
            total = f"CAST({total} AS DECIMAL(38,{t.s}))"
            if name == "SUM":
                return Bound(total, ty.decimal(38, t.s))
            r = ty.exact_result("/", (38, t.s), (10, 0))
            return Bound(truncated_quotient(total, f"CAST(count({d}{x.sql}) AS DECIMAL(10,0))", r), r)
        return Bound(f"{name.lower()}({d}CAST({x.sql} AS DOUBLE))", ty.FLOAT)

    def window(self, e: Node, scope: Scope, group: Grouping | None) -> Bound:
        parts = [self.collated(self.value(x, scope, group)).sql for x in e.over.parts]
        order = [f"{self.collated(self.value(x, scope, group)).sql}{' DESC' if d else ''}" for x, d in e.over.order]
        frame = f" {e.over.frame}" if e.over.frame else ""
        over = f"OVER ({'PARTITION BY ' + ', '.join(parts) if parts else ''}{' ORDER BY ' + ', '.join(order) if order else ''}{frame})"
        if e.name in AGGREGATES:
            plain = self.aggregate(e.name, e, scope)
            # the window goes to the aggregate calls inside the result's conversions
            return Bound(re.sub(r"\b(sum|count|avg|min|max)(\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\))", rf"\1\2 {over}", plain.sql), plain.type)
        if e.name not in WINDOWS:
            raise TsqlError(195, f"'{e.name}' is not a recognized built-in function name.")
        args = [self.value(x, scope, group) for x in e.args]
        sql = f"{e.name.lower()}({', '.join(a.sql for a in args)}) {over}"
        if e.name in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE"):
            return Bound(f"CAST({sql} AS BIGINT)", ty.BIGINT)
        return Bound(sql, ty.FLOAT if e.name in ("PERCENT_RANK", "CUME_DIST") else args[0].type)

    def has_aggregate(self, e) -> bool:
        """Whether an aggregate stands in the expression, outside subqueries."""
        if isinstance(e, (list, tuple)):
            return any(self.has_aggregate(x) for x in e)
        if not isinstance(e, Node) or e.kind in ("query", "bound_col", "over"):
            return False
        if e.kind == "call" and e.name in AGGREGATES and e.over is None:
            return True
        return any(self.has_aggregate(x) for x in e.__dict__.values() if isinstance(x, (Node, list, tuple)))


@dataclass
class Grouping:
    keys: dict[str, str]  # key -> what stands for it in the result
    inside: bool = False  # within an aggregate's argument


def truncated_quotient(x: str, y: str, t: SqlType) -> str:
    """x / y cut, not rounded, at the scale of ``t``.

    Operands that are long, so that nesting would repeat them again and again, or differ from one evaluation to the next
    are evaluated once.
    """
    if len(x) + len(y) > 400 or "uuid()" in x + y or "rand(" in x + y:
        return f"transform(array(struct({x} AS x, {y} AS y)), o -> {truncated_quotient('o.x', 'o.y', t)})[0]"
    q = f"CAST(({x} / {y}) AS {t.spark()})"
    unit = f"CAST('{Decimal(1).scaleb(-t.s):f}' AS DECIMAL({max(t.s, 1)},{t.s}))"
    return f"CAST(CASE WHEN abs({q} * {y}) > abs({x}) THEN {q} - CAST(signum({q}) AS DECIMAL(1,0)) * {unit} ELSE {q} END AS {t.spark()})"


def literal(e: Node) -> Bound:
    k, v = e.kind_, e.value
    if k == "null":
        return Bound("NULL", ty.NULL, is_null=True)
    if k in ("str", "nstr"):
        n = max(1, len(v))
        return Bound(quote(v), ty.nvarchar(n) if k == "nstr" else ty.varchar(n), literal=v)
    if k == "bin":
        digits = v[2:] if len(v) % 2 == 0 else "0" + v[2:]
        return Bound(f"X'{digits}'", SqlType("varbinary", n=max(1, len(digits) // 2)), literal=bytes.fromhex(digits))
    if k == "money":
        return Bound(f"CAST('{v[1:]}' AS DECIMAL(19,4))", SqlType("money"), literal=Decimal(v[1:].rstrip(".")))
    if "e" in v.lower():
        return Bound(f"CAST('{v}' AS DOUBLE)", ty.FLOAT, literal=float(v))
    if v.isdigit():
        digits = v.lstrip("0") or "0"
        if int(v) < 2**31:
            return Bound(str(int(v)), ty.INT, literal=int(v), digits=len(digits))
        if len(digits) > 38:
            raise TsqlError(1007, f"The number '{v}' is out of the range for numeric representation.")
        return Bound(f"CAST('{digits}' AS DECIMAL({len(digits)},0))", ty.decimal(len(digits), 0), literal=int(v))
    whole, _, part = v.partition(".")
    whole = whole.lstrip("0")
    p, s = max(1, len(whole) + len(part)), len(part)
    if p > 38:
        raise TsqlError(1007, f"The number '{v}' is out of the range for numeric representation.")
    return Bound(f"CAST('{whole or '0'}.{part or '0'}' AS DECIMAL({p},{s}))", ty.decimal(p, s), literal=Decimal(v))


def like_regex(pattern: str, escape: str | None) -> str:
    """A LIKE pattern as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if escape is not None and c == escape and i + 1 < len(pattern):
            out += re.escape(pattern[i + 1])
            i += 2
            continue
        if c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("]",) else i + 1)
            if end < 0:
                return out + "(?!)"
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = body[negated:]
            inner = re.sub(r"([\\\[\]^&])", r"\\\1", body)
            out += f"[{'^' if negated else ''}{inner}]" if inner else "(?!)"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def like_regex_sql(pattern: str, escape: str | None) -> str:
    """The same of a pattern that only the row knows, as an expression: its pieces are told apart and rewritten one by one."""
    pieces = r"\[\]?[^\]]*\]|[\s\S]"
    if escape is not None:
        pieces = rf"\Q{escape}\E[\s\S]|{pieces}"
    body = "substring(p, 2, length(p) - 2)"
    inner = f"regexp_replace(if(startswith({body}, '^'), substring({body}, 2), {body}), {quote(r'([\\\[\]^&])')}, {quote(r'\\$1')})"
    plain = lambda c: f"regexp_replace({c}, {quote(r'([^A-Za-z0-9\s])')}, {quote(r'\\$1')})"
    escaped = f"WHEN length(p) = 2 AND startswith(p, {quote(escape)}) THEN {plain('substring(p, 2)')} " if escape is not None else ""
    case = f"CASE {escaped}WHEN p = '%' THEN '.*' WHEN p = '_' THEN '.' WHEN p = '[' OR length(p) > 1 AND {inner} = '' THEN '(?!)' WHEN length(p) > 1 THEN concat(if(startswith({body}, '^'), '[^', '['), {inner}, ']') ELSE {plain('p')} END"
    return f"array_join(transform(regexp_extract_all({pattern}, {quote(pieces)}, 0), p -> {case}), '')"
