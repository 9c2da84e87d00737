"""INSERT, UPDATE, DELETE and their constraints, as transformations from one version of a table to the next.

A version is a list of Parquet folders in the session's shared folder, each written with its rows' numbers.  INSERT adds a
folder, and folders are put together once there are more than ``PIECES``; UPDATE and DELETE find rows by folder and
number, and write the next version once.  Statements never see their own writes, and a failed one leaves nothing behind.
Constraints are checked on the changed rows, uniqueness among them and against the others.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..errors import TsqlError
from ..plans.binder import Binder, Bound, Scope, Source
from ..plans.parser import Node
from ..sources.catalog import Table


#: Folders of a version; more are put together.
PIECES = 32


def stored(session, df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, with ``__rid``, a number of each row of the folder.

    On a cluster the folder must be shared; without ``spark.checkpoint.dir`` it raises there.
    """
    root = session.spark.sparkContext.getConf().get("spark.checkpoint.dir") or session.folder
    if root is None:
        if not session.spark.sparkContext.master.startswith("local["):
            raise TsqlError(50000, "Set spark.checkpoint.dir to a folder that all executors share.")
        root = session.folder = tempfile.mkdtemp(prefix="tsqlspark-")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}-table"
    df = df.withColumn("__rid", F.monotonically_increasing_id())
    df.write.parquet(path)
    return session.spark.read.schema(df.schema).parquet(path)


def source_of(table: Table, name: str, alias: str) -> Source:
    return Source([name], alias, [(c.name, c.type, f"{alias}.`{c.name}`") for c in table.columns])


def whole(pieces: tuple[DataFrame, ...]) -> DataFrame:
    """The rows of all pieces, without their numbers."""
    df = pieces[0].drop("__rid")
    for p in pieces[1:]:
        df = df.unionByName(p.drop("__rid"))
    return df


def rows_of(session, table: Table) -> tuple[tuple[DataFrame, ...], DataFrame]:
    """The pieces of a table, written now if it is a frame of the user's, and its rows with ``__piece`` and ``__rid``."""
    pieces = table.pieces or (stored(session, table.df),)
    df = pieces[0].withColumn("__piece", F.lit(0))
    for i, p in enumerate(pieces[1:], 1):
        df = df.unionByName(p.withColumn("__piece", F.lit(i)))
    return pieces, df


def publish(session, table: Table, pieces: tuple[DataFrame, ...] | DataFrame, **changes) -> Table:
    df = pieces if isinstance(pieces, DataFrame) else whole(pieces)
    new = replace(table, df=df, view=session.new_view(df), pieces=pieces if isinstance(pieces, tuple) else (), **changes)
    session.tables[new.key] = new
    return new


def violations(session, table: Table, df: DataFrame, changed: DataFrame | None = None, columns: set[str] | None = None, added: bool = False) -> None:
    """Raises for a row of ``df``, the table's next version, that breaks a constraint.

    ``changed``: its rows that may, all without it, and ``columns``, those whose values changed.  ``added``: the changed
    rows come on top of the table's, so that keys that others refer to are all still there.
    """
    fresh = df if changed is None else changed
    touched = lambda names: columns is None or bool(columns & set(names))
    view = session.new_view(fresh)
    a = "row0"
    tests, raised = [], []
    for c in table.columns:
        if not c.nullable and touched([c.name]):
            tests.append(f"max({a}.`{c.name}` IS NULL)")
            raised.append(TsqlError(515, f"Cannot insert the value NULL into column '{c.name}', table '{table.name}'; column does not allow nulls."))
    for check in table.checks:
        tests.append(f"max(coalesce(NOT {Binder(session).condition(check.test, Scope([source_of(table, table.name, a)]))}, FALSE))")
        raised.append(TsqlError(547, f"The statement conflicted with the CHECK constraint \"{check.name}\"."))
    if tests:
        # all conditions on single rows in one pass
        for failed, error in zip(session.spark.sql(f"SELECT {', '.join(tests)} FROM {view} {a}").first(), raised, strict=True):
            if failed:
                raise error
    for k in table.keys:
        if not k.unique or not touched(k.columns):
            continue
        names = [f"k{i}" for i in range(len(k.columns))]
        keyed = lambda x, k=k, names=names: x.select(*[session.key_column(x, c).alias(n) for c, n in zip(k.columns, names, strict=True)])
        mine = keyed(fresh if added else df)
        twice = mine.groupBy(*names).count().where("count > 1").limit(1).count()
        if not twice and added:
            old = keyed(table.df)
            twice = mine.join(old, [mine[n].eqNullSafe(old[n]) for n in names], "left_semi").limit(1).count()
        if twice:
            number = 2601 if k.kind == "index" else 2627
            raise TsqlError(number, f"Violation of {'PRIMARY KEY' if k.kind == 'primary' else 'UNIQUE KEY'} constraint '{k.name}'. Cannot insert duplicate key in object '{table.schema}.{table.name}'.")
    for f in table.foreign:
        if touched(f.columns):
            orphans(session, fresh, f.columns, df if f.parent == table.key else session.tables[f.parent].df, f.parent_columns, f.name)
    if not added:
        for other in session.tables.values():
            for f in other.foreign:
                if f.parent == table.key and touched(f.parent_columns):
                    orphans(session, df if other.key == table.key else other.df, f.columns, df, f.parent_columns, f.name)


def orphans(session, child: DataFrame, columns, parent: DataFrame, parent_columns, name: str) -> None:
    """Raises for a key of ``child`` that ``parent`` lacks under the session's collation."""
    own = child.select(*[session.key_column(child, c).alias(f"a{i}") for i, c in enumerate(columns)]).dropna()
    theirs = parent.select(*[session.key_column(parent, c).alias(f"b{i}") for i, c in enumerate(parent_columns)])
    on = [F.col(f"a{i}") == F.col(f"b{i}") for i in range(len(columns))]
    if own.join(theirs, on, "left_anti").limit(1).count():
        raise TsqlError(547, f"The statement conflicted with the FOREIGN KEY constraint \"{name}\".")


def with_computed(session, table: Table, df: DataFrame, *others: str) -> DataFrame:
    """All columns in order, computed ones evaluated, then ``others`` as they are."""
    b = Binder(session)
    a = b.fresh()
    view = session.new_view(df)
    scope = Scope([Source([table.name], a, [(c.name, c.type, f"{a}.`{c.name}`") for c in table.columns if c.computed is None])])
    parts = [f"{b.to(b.value(c.computed, scope), c.type).sql if c.computed is not None else f'{a}.`{c.name}`'} AS `{c.name}`" for c in table.columns]
    return session.spark.sql(f"SELECT {', '.join([*parts, *others])} FROM {view} {a}")


def numbered(session, df: DataFrame, first: int, step: int, name: str) -> tuple[DataFrame, int]:
    """``df`` with identity values in row order; only one count per partition reaches the driver."""
    placed = stored(session, df).withColumnRenamed("__rid", "__at")
    part = F.shiftright("__at", 33)
    total, offsets = 0, {}
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):
        offsets[p] = total
        total += n
    table = session.spark.createDataFrame(list(offsets.items()) or [(0, 0)], "__p long, __before long")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(table), part == F.col("__p")).withColumn(name, F.lit(first) + rank * step)
    return out.drop("__at", "__p", "__before"), total


def insert(session, s: Node) -> int:
    table = session.table(s.table)
    binder = Binder(session)
    explicit = session.identity_insert == table.key
    if s.columns is None:
        targets = [c for c in table.columns if c.computed is None and (c.identity is None or explicit)]
    else:
        targets = [table.column(n) for n in s.columns]
        if len({c.name for c in targets}) < len(targets):
            raise TsqlError(264, "A column name is specified more than once in the column list of an INSERT.")
        for c in targets:
            if c.computed is not None:
                raise TsqlError(271, f"The column \"{c.name}\" cannot be modified because it is a computed column.")
            if c.identity is not None and not explicit:
                raise TsqlError(544, f"Cannot insert explicit value for identity column in table '{table.name}' when IDENTITY_INSERT is set to OFF.")
    if s.source is None:
        targets, sql, cols = [], "SELECT 1 AS c0", []
    else:
        if s.source.body.kind == "values":
            defaults = lambda c: c.default if c.default is not None else Node("lit", kind_="null", value=None)
            for row in s.source.body.rows:
                if len(row) != len(targets):
                    raise TsqlError(110 if len(row) > len(targets) else 109, "The number of columns in the INSERT statement does not match the number of values.")
                for i, e in enumerate(row):
                    if e is None:
                        row[i] = defaults(targets[i])
        sql, cols = binder.query(s.source)
        if len(cols) != len(targets):
            raise TsqlError(121 if len(cols) > len(targets) else 120, "The select list of the INSERT statement does not match its column list.")
    a = binder.fresh()
    names = {c.name for c in targets}
    parts = []
    for i, c in enumerate(targets):
        parts.append(f"{assigned(binder, Bound(f'{a}.c{i + 1}', cols[i][1]), c).sql} AS `{c.name}`")
    identity = None
    for c in table.columns:
        if c.name in names or c.computed is not None:
            continue
        if c.identity is not None:
            identity = c
            continue
        value = binder.value(c.default, Scope([])) if c.default is not None else Bound("NULL", ty.NULL, is_null=True)
        parts.append(f"{binder.to(value, c.type).sql} AS `{c.name}`")
    rows = session.spark.sql(f"SELECT {', '.join(parts) or '1 AS __none'} FROM ({sql}) {a}")
    changes = {}
    if identity is not None:
        rows, n = numbered(session, rows, table.next_identity, identity.identity[1], identity.name)
        rows = rows.withColumn(identity.name, F.col(identity.name).cast(identity.type.spark()))
        if n:
            last = table.next_identity + (n - 1) * identity.identity[1]
            changes = {"next_identity": last + identity.identity[1], "last_identity": last}
            session.identity = last
    rows = stored(session, with_computed(session, table, rows))
    count = rows.count()
    for c in table.columns:
        if c.identity is not None and explicit and count:
            top = rows.agg(F.max(c.name)).first()[0]
            changes = {"next_identity": max(table.next_identity, int(top) + c.identity[1]), "last_identity": int(top)}
            session.identity = int(top)
    before = table.pieces or (table.df.withColumn("__rid", F.lit(None).cast("long")),)
    pieces = (*before, rows)
    violations(session, table, whole(pieces), rows.drop("__rid"), added=True)
    if not table.pieces or len(pieces) > PIECES:
        pieces = (stored(session, whole(pieces)),)
    publish(session, table, pieces, **changes)
    return count


def assigned(binder: Binder, x: Bound, c) -> Bound:
    """A value for a column: text that doesn't fit raises instead of being cut."""
    t = c.type
    if t.is_string and t.n != ty.MAX and not (x.type.is_string and x.type.n != ty.MAX and x.type.n <= t.n) and not x.is_null:
        text = binder.to_string(x)
        return Bound(f"(CASE WHEN length(rtrim({text.sql})) > {t.n} THEN raise_error('Msg 2628: String or binary data would be truncated.') ELSE left({text.sql}, {t.n}) END)", t)
    return binder.to(x, t) if x.type != t or x.is_null else x


def _target(session, s: Node) -> tuple[Table, str | None]:
    """The table that an UPDATE or DELETE writes, and its exposed name in FROM."""
    if s.source is not None:
        def walk(f):
            if f.kind in ("join", "apply"):
                yield from walk(f.left)
                yield from walk(f.right)
            elif f.kind == "table":
                yield f

        for f in walk(s.source):
            name = f.alias or f.parts[-1]
            if name.lower() == s.target[-1].lower() or f.parts[-1].lower() == s.target[-1].lower():
                return session.table(f.parts), name
    return session.table(s.target), None


def _matched(session, s: Node, table: Table, name: str | None, binder: Binder) -> tuple[str, list[Source], str, DataFrame]:
    """FROM text with the target's ``__piece`` and ``__rid``, its sources, the target's alias, and its numbered rows."""
    numbered = rows_of(session, table)[1]
    numbered_view = session.new_view(numbered)
    if s.source is None or name is None:
        a = binder.fresh()
        target = source_of(table, table.name, a)
        if s.source is None:
            return f"{numbered_view} {a}", [target], a, numbered
        sql, sources = binder.from_tree(s.source, None)
        return f"{numbered_view} {a} CROSS JOIN {sql}", [target, *sources], a, numbered
    sql, sources = binder.from_tree(s.source, None)
    for x in sources:
        if x.names[0].lower() == name.lower():
            return sql.replace(f"{table.view} {x.alias}", f"{numbered_view} {x.alias}", 1), sources, x.alias, numbered
    raise TsqlError(208, f"Invalid object name '{name}'.")


def update(session, s: Node) -> int:
    table, name = _target(session, s)
    binder = Binder(session)
    sql, sources, a, numbered = _matched(session, s, table, name, binder)
    scope = Scope(sources)
    where = f" WHERE {binder.condition(s.where, scope)}" if s.where is not None else ""
    seen, parts = set(), []
    for column, value in s.sets:
        c = table.column(column)
        if c.name in seen:
            raise TsqlError(264, f"The column name '{c.name}' is specified more than once in the SET clause.")
        seen.add(c.name)
        if c.identity is not None:
            raise TsqlError(8102, f"Cannot update identity column '{c.name}'.")
        if c.computed is not None:
            raise TsqlError(271, f"The column \"{c.name}\" cannot be modified because it is a computed column.")
        value = value if value is not None else c.default if c.default is not None else Node("lit", kind_="null", value=None)
        bound = binder.value(value, scope)
        parts.append((c.name, assigned(binder, bound, c).sql))
    values = ", ".join(f"{v} AS `{n}`" for n, v in parts)
    # of several partners of a row the one with the smallest values wins
    changes = session.spark.sql(f"SELECT {a}.__piece, {a}.__rid, struct({values}) AS __new FROM {sql}{where}")
    if s.source is not None:
        changes = changes.groupBy("__piece", "__rid").agg(F.min("__new").alias("__new"))
    changes = stored(session, changes.withColumnRenamed("__rid", "__row")).drop("__rid")
    count = changes.count()
    rows = numbered.withColumnRenamed("__rid", "__row").join(changes.withColumn("__hit", F.lit(True)), ["__piece", "__row"], "left")
    new = rows.select(*[F.when(F.col("__hit"), F.col(f"__new.`{c.name}`")).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in seen else F.col(f"`{c.name}`") for c in table.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
    computed = [c.name for c in table.columns if c.computed is not None]
    new = stored(session, with_computed(session, table, new, "__hit"))
    after = new.drop("__hit")
    violations(session, table, after.drop("__rid"), new.where("__hit").drop("__hit", "__rid"), {*seen, *computed})
    publish(session, table, (after,))
    return count


def delete(session, s: Node) -> int:
    table, name = _target(session, s)
    binder = Binder(session)
    sql, sources, a, numbered = _matched(session, s, table, name, binder)
    where = f" WHERE {binder.condition(s.where, Scope(sources))}" if s.where is not None else ""
    gone = stored(session, session.spark.sql(f"SELECT DISTINCT {a}.__piece, {a}.__rid AS __row FROM {sql}{where}")).drop("__rid")
    count = gone.count()
    rows = numbered.withColumnRenamed("__rid", "__row").join(gone, ["__piece", "__row"], "left_anti")
    new = stored(session, rows.select(*[F.col(f"`{c.name}`") for c in table.columns]))
    # what is left broke nothing before; only keys that others refer to can be missing
    violations(session, replace(table, keys=(), checks=(), foreign=(), columns=()), new.drop("__rid"))
    publish(session, table, (new,))
    return count


def truncate(session, s: Node) -> None:
    table = session.table(s.table)
    if any(f.parent == table.key for t in session.tables.values() for f in t.foreign if t.key != table.key):
        raise TsqlError(4712, f"Cannot truncate table '{table.name}' because it is being referenced by a FOREIGN KEY constraint.")
    first = next((c.identity[0] for c in table.columns if c.identity), None)
    publish(session, table, (stored(session, table.df.limit(0)),), next_identity=first, last_identity=None)


__all__ = ["delete", "insert", "numbered", "publish", "stored", "truncate", "update", "violations", "with_computed"]
