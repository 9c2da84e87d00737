"""A T-SQL session on a SparkSession: batches, variables, control flow, DDL, transactions and procedures."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from . import types as ty
from .errors import TsqlError
from .functions import convert
from .operators import dml
from .plans.binder import Binder, Bound, Scope, quote
from .plans.parser import Node, Parser, parse
from .sources import procedures
from .sources.catalog import Catalog, Check, Column, Foreign, Key, Table, column_type, view_rows
from .types import SqlType

CONF = {"spark.sql.ansi.enabled": "true", "spark.sql.groupByOrdinal": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.decimalOperations.allowPrecisionLoss": "true", "spark.sql.caseSensitive": "false", "spark.sql.legacy.timeParserPolicy": "CORRECTED"}
BINARY = "Latin1_General_100_BIN2"
_COLLATION = re.compile(r"^(SQL_)?Latin1_General(_100|_CP1)?_(BIN2?|(CI|CS)_(AI|AS)(_KS)?(_WS)?(_SC)?(_UTF8)?)$", re.I)


@dataclass
class Result:
    """What one statement sends: rows, a count, a message or an error."""

    kind: str
    df: DataFrame | None = None
    count: int = 0
    text: str = ""
    number: int = 0


class _Return(Exception):
    pass


#: Errors that end their statement only, without XACT_ABORT.
STATEMENT_ERRORS = {220, 512, 515, 535, 536, 537, 547, 2601, 2627, 2628, 3623, 8115, 8134}


class ResultFrame(ClassicFrame):
    """A result set whose errors while rows are read have the dialect's numbers; the session's @@ERROR sees them."""

    @classmethod
    def of(cls, df: DataFrame, session: TsqlSession) -> ResultFrame:
        found = cls(df._jdf, df.sparkSession)
        found._tsql = session
        return found


def _reading(name: str):
    plain = getattr(ClassicFrame, name)

    def action(self, *args, **kwargs):
        try:
            return plain(self, *args, **kwargs)
        except PySparkException as e:
            error = runtime_error(e)
            if "_tsql" in self.__dict__:
                self._tsql.error = error.number
            raise error from e

    action.__name__, action.__doc__ = name, plain.__doc__
    return action


for _name in ("collect", "count", "first", "foreach", "foreachPartition", "head", "isEmpty", "show", "tail", "take", "toArrow", "toLocalIterator", "toPandas"):
    setattr(ResultFrame, _name, _reading(_name))


class TsqlSession:
    """``sql`` runs a batch and gives its last result set; ``execute`` gives everything that it sends."""

    def __init__(self, spark: SparkSession, collation: str = "SQL_Latin1_General_CP1_CI_AS", database: str = "master"):
        self.spark = spark.newSession()
        for k, v in CONF.items():
            self.spark.conf.set(k, v)
        self.collation = collation
        self.spark_collation(collation)
        self.catalog = Catalog()
        self.catalog.databases.setdefault(database, {})
        self.database = database
        self.folder: str | None = None
        self.options: dict[str, str] = {"ANSI_NULLS": "ON", "QUOTED_IDENTIFIER": "ON", "NOCOUNT": "OFF", "XACT_ABORT": "OFF", "ANSI_WARNINGS": "ON", "ARITHABORT": "ON"}
        self.date_first = 7
        self.variables: dict[str, tuple[SqlType, object]] = {}
        self._rows: int | DataFrame = 0
        self._unread: DataFrame | None = None
        self.error = 0
        self.identity: int | None = None
        self.identity_insert: str | None = None
        self.transactions: list[tuple[str | None, dict]] = []
        self.saves: dict[str, dict] = {}
        self.prepared: dict[int, tuple[str, str]] = {}
        self.level = 0
        self.serial = 0
        self.keeps_order = False
        self.results: list[Result] = []
        self.now = datetime.now(UTC)

    @property
    def rowcount(self) -> int:
        """Rows of the last statement; those of a result set are counted once, when they are asked for."""
        if not isinstance(self._rows, int):
            self._rows = self._rows.count()
        return self._rows

    @rowcount.setter
    def rowcount(self, n: int | DataFrame) -> None:
        self._rows = n

    def read(self) -> None:
        """Evaluate the last result set, whose errors a later statement asks for."""
        df, self._unread = self._unread, None
        if df is None or df.isStreaming:
            return
        try:
            df.write.format("noop").mode("overwrite").save()
        except PySparkException as e:
            raise runtime_error(e) from e

    # -- tables ------------------------------------------------------------------------------------------------------
    @property
    def tables(self) -> dict[str, Table]:
        return self.catalog.databases[self.database]

    def new_view(self, df: DataFrame) -> str:
        self.serial += 1
        name = f"v{id(self) % 10**8}_{self.serial}"
        df.createOrReplaceTempView(name)
        return name

    def register(self, name: str, df: DataFrame, types: dict[str, SqlType] | None = None) -> None:
        """Make a frame, of files or a stream, a table of the current database."""
        schema, _, bare = name.rpartition(".")
        columns = tuple(Column(f.name, (types or {}).get(f.name) or ty.from_spark(f.dataType), f.nullable) for f in df.schema)
        local = self._own(df)
        table = Table(schema or "dbo", bare, self.catalog.next_id(), columns, local, self.new_view(local))
        self.tables[table.key] = table

    def _own(self, df: DataFrame) -> DataFrame:
        """The same plan under this session, so that this session's settings hold for it."""
        if df.sparkSession is self.spark:
            return df
        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().logical())
        return DataFrame(jdf, self.spark)

    def load(self, folder: str, names: list[str]) -> TsqlSession:
        """Register Parquet tables of a folder."""
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def table(self, parts: list[str]) -> Table:
        tables, schema = self.tables, "dbo"
        if len(parts) == 3:
            base = next((d for d in self.catalog.databases if d.lower() == parts[0].lower()), None)
            if base is None:
                raise TsqlError(208, f"Invalid object name '{'.'.join(parts)}'.")
            tables = self.catalog.databases[base]
        if len(parts) > 1 and parts[-2]:
            schema = parts[-2]
        found = tables.get(f"{schema}.{parts[-1]}".lower())
        if found is None:
            raise TsqlError(208, f"Invalid object name '{'.'.join(parts)}'.")
        return found

    def resolve(self, parts: list[str]) -> tuple[str, list[tuple[str, SqlType]]]:
        """View and columns of a table or catalogue view."""
        if len(parts) > 1 and parts[-2].lower() in ("sys", "information_schema"):
            found = view_rows(self.catalog, self.database, f"{parts[-2]}.{parts[-1]}".lower(), self.collation)
            if found is None:
                raise TsqlError(208, f"Invalid object name '{'.'.join(parts)}'.")
            names, rows = found
            kinds = [column_type(n) for n in names]
            schema = ", ".join(f"`{n}` {k.spark()}" for n, k in zip(names, kinds, strict=True))
            values = [tuple(v if k != ty.nvarchar(4000) or v is None else str(v) for v, k in zip(r, kinds, strict=True)) for r in rows]
            return self.new_view(self.spark.createDataFrame(values, schema)), list(zip(names, kinds, strict=True))
        table = self.table(parts)
        return table.view, [(c.name, c.type) for c in table.columns]

    def object_id(self, name: str) -> int | None:
        parts = [t.value for t in Parser(str(name)).tokens if t.kind in ("id", "qid")]
        try:
            return self.table(parts).object_id
        except TsqlError:
            return None

    def object_name(self, n: int) -> str | None:
        return next((t.name for t in self.tables.values() if t.object_id == n), None)

    def ident_current(self, name: str) -> int | None:
        try:
            t = self.table(str(name).split("."))
        except TsqlError:
            return None
        return t.last_identity if t.last_identity is not None else t.next_identity

    # -- collation ---------------------------------------------------------------------------------------------------
    def known_collation(self, name: str) -> bool:
        return bool(_COLLATION.match(str(name)))

    def insensitive(self, name: str | None) -> bool:
        return "_CI_" in f"{name or self.collation}_".upper()

    def spark_collation(self, name: str | None) -> str | None:
        """The Spark collation of comparisons; None for plain binary order."""
        name = name or self.collation
        if not self.known_collation(name):
            raise TsqlError(448, f"Invalid collation '{name}'.")
        upper = f"{name.upper()}_"
        if "_BIN" in upper:
            return None
        if "_CI_AI_" in upper:
            return "UNICODE_CI_AI_RTRIM"
        if "_CS_AI_" in upper:
            return "UNICODE_AI_RTRIM"
        return "UTF8_LCASE_RTRIM" if "_CI_" in upper else "UTF8_BINARY_RTRIM"

    def key_column(self, df: DataFrame, name: str):
        c = F.col(f"`{name}`")
        collation = self.spark_collation(None)
        return F.collate(c, collation) if collation and dict(df.dtypes)[name].startswith("string") else c

    # -- variables and constants -------------------------------------------------------------------------------------
    def variable(self, name: str) -> Bound:
        key = name.lower()
        if key.startswith("@@"):
            return self._global(key)
        if key not in self.variables:
            raise TsqlError(137, f"Must declare the scalar variable \"{name}\".")
        t, value = self.variables[key]
        return self.typed(t, value)

    def typed(self, t: SqlType, value) -> Bound:
        """A value of a type as an expression."""
        if value is None:
            return Bound(f"CAST(NULL AS {t.spark()})", t)
        if t.is_string or t.name in ("uniqueidentifier", "time"):
            return Bound(quote(value), t, literal=value)
        if t.is_binary:
            return Bound(f"X'{bytes(value).hex()}'", t, literal=bytes(value))
        if t.name == "bit":
            return Bound("TRUE" if value else "FALSE", t)
        if t.is_date:
            return Bound(f"CAST('{value}' AS {t.spark()})", t)
        plain = t.name in ("int",)
        return Bound(str(value) if plain else f"CAST('{value}' AS {t.spark()})", t, literal=value if t.is_integer or isinstance(value, Decimal) else None)

    def _global(self, name: str) -> Bound:
        if name == "@@rowcount":
            return self.typed(ty.INT, self.rowcount)
        if name == "@@error":
            try:
                self.read()
            except TsqlError as e:
                self.fail(e)
        values = {
            "@@error": (ty.INT, self.error), "@@trancount": (ty.INT, len(self.transactions)), "@@identity": (ty.decimal(38, 0), self.identity), "@@spid": (SqlType("smallint"), 51),
            "@@servername": (ty.nvarchar(128), "localhost"), "@@servicename": (ty.nvarchar(128), "MSSQLSERVER"), "@@version": (ty.nvarchar(300), "T-SQL on Spark"), "@@max_precision": (SqlType("tinyint"), 38),
            "@@lock_timeout": (ty.INT, int(self.options.get("LOCK_TIMEOUT", -1))), "@@microsoftversion": (ty.INT, 268435456), "@@datefirst": (SqlType("tinyint"), self.date_first), "@@nestlevel": (ty.INT, self.level), "@@language": (ty.nvarchar(128), "us_english"),
        }
        if name not in values:
            raise TsqlError(137, f"Must declare the scalar variable \"{name}\".")
        return self.typed(*values[name])

    def now_sql(self, zone: str) -> str:
        """The statement's time as a timestamp literal: "local" or "utc", with milliseconds or, as "precise", all digits."""
        kind, _, digits = zone.partition(" ")
        stamp = self.now.astimezone() if kind == "local" else self.now
        part = f"{stamp.microsecond:06d}" if digits else f"{stamp.microsecond // 1000:03d}"
        return f"TIMESTAMP_NTZ'{stamp:%Y-%m-%d %H:%M:%S}.{part}'"

    def constant(self, binder: Binder, e: Node):
        """The value of an expression without columns."""
        b = binder.value(e, Scope([]))
        if b.literal is not None or b.is_null:
            return b.literal
        return self.value_of(b)

    def value_of(self, b: Bound):
        try:
            return self.spark.sql(f"SELECT {b.sql} AS v").first()[0]
        except PySparkException as e:
            raise runtime_error(e) from e

    # -- running -----------------------------------------------------------------------------------------------------
    def sql(self, text: str) -> DataFrame | None:
        """The last result set of a batch; an error ends it."""
        found = None
        for r in self.execute(text):
            if r.kind == "error":
                raise TsqlError(r.number, r.text)
            if r.kind == "rows":
                found = r.df
        return found

    def execute(self, text: str) -> list[Result]:
        """Everything a text sends; ``GO`` lines part it into batches, and a syntax error voids its batch."""
        self.results = []
        for batch in re.split(r"(?im)^\s*GO\s*;?\s*$", text):
            self.variables = {}
            try:
                self.run(parse(batch))
            except TsqlError as e:
                self.fail(e)
            except _Return:
                pass
        return self.results

    def fail(self, e: TsqlError) -> None:
        self.error = e.number
        if self.options.get("XACT_ABORT") == "ON" and self.transactions:
            self._rollback(None)
        self.results.append(Result("error", text=e.message, number=e.number))

    def run(self, statements: list[Node]) -> None:
        program, labels = compile_program(statements)
        at = 0
        while at < len(program):
            op, node, target = program[at]
            at += 1
            if op == "jump":
                at = labels[target] if isinstance(target, str) else target
            elif op == "unless":
                if not self.test(node):
                    at = target
            else:
                self.now = datetime.now(UTC)
                try:
                    self.statement(node)
                except TsqlError as e:
                    if e.number not in STATEMENT_ERRORS or self.options.get("XACT_ABORT") == "ON":
                        raise
                    self.fail(e)

    def test(self, e: Node) -> bool:
        """A condition; one that fails isn't true."""
        try:
            binder = Binder(self)
            return self.spark.sql(f"SELECT CASE WHEN {binder.condition(e, Scope([]))} THEN 1 ELSE 0 END AS v").first()[0] == 1
        except TsqlError as err:
            self.fail(err)
        except PySparkException as err:
            self.fail(runtime_error(err))
        return False

    def statement(self, s: Node) -> None:
        handler = getattr(self, f"do_{s.kind}", None)
        if handler is None:
            raise TsqlError(50000, f"{s.kind} is not implemented.")
        before = self.catalog.snapshot()
        try:
            handler(s)
        except PySparkException as e:
            self.catalog.databases = before
            raise runtime_error(e) from e
        except TsqlError:
            if s.kind not in ("exec", "exec_text", "rollback", "commit"):
                self.catalog.databases = before
            raise
        if s.kind not in ("label", "goto"):
            self.error = 0

    def counted(self, n: int) -> None:
        self.rowcount = n
        if self.options["NOCOUNT"] != "ON":
            self.results.append(Result("count", count=n))

    # -- statements --------------------------------------------------------------------------------------------------
    def frame(self, q: Node) -> DataFrame:
        """The rows of a query under its own column names."""
        binder = Binder(self)
        sql, cols = binder.query(q, None, top=True)
        try:
            df = self.spark.sql(sql)
        except PySparkException as e:
            raise runtime_error(e) from e
        return ResultFrame.of(df.toDF(*[n for n, _ in cols]), self)

    def do_select(self, s: Node) -> None:
        spec = s.query.body
        if spec.kind == "query_spec" and any(i.kind == "assign" for i in spec.items):
            return self._assign(s.query)
        if spec.kind == "query_spec" and spec.into:
            return self._into(s.query)
        df = self.frame(s.query)
        self._unread = df
        if self.transactions and self.options.get("XACT_ABORT") == "ON":
            self.read()  # an error would end the transaction
        self.results.append(Result("rows", df=df))
        self.rowcount = df

    def _assign(self, q: Node) -> None:
        spec = q.body
        if not all(i.kind == "assign" for i in spec.items):
            raise TsqlError(141, "A SELECT statement that assigns a value to a variable must not be combined with data-retrieval operations.")
        targets = [i.var.lower() for i in spec.items]
        for t in targets:
            self.variable(t)
        if any(mentions(i.value, set(targets)) for i in spec.items) and spec.source is not None:
            return self._fold(q)
        binder = Binder(self)
        sql, cols = binder.query(q, None, top=True)
        if spec.source is None:
            rows = self.spark.sql(sql).take(1)
            n = len(rows)
        elif q.order or spec.group is None and not any(binder.has_aggregate(i.value) for i in spec.items):
            df = self.spark.sql(sql)
            rows, n = df.tail(1), df.count()
        else:
            rows = self.spark.sql(sql).collect() if spec.group is None else self.spark.sql(sql).tail(1)
            n = len(rows)
        if rows:
            for i, name in enumerate(targets):
                self._store(name, Bound("", cols[i][1]), rows[-1][i])
        self.rowcount = n

    def _fold(self, q: Node) -> None:
        """Assignments that read their own variables: an ordered fold over the rows, run by Spark."""
        spec = q.body
        binder = Binder(self)
        sql_from, sources = binder.from_tree(spec.source, None)
        scope = Scope(sources)
        names = [i.var.lower() for i in spec.items]
        columns: list[str] = []

        class Row(Binder):
            def value(inner, e, sc, group=None):
                if e.kind == "var" and e.name.lower() in names:
                    t = self.variables[e.name.lower()][0]
                    return Bound(f"acc.v{names.index(e.name.lower())}", t)
                if e.kind == "col":
                    b = Binder.value(inner, e, sc, group)
                    if b.sql not in columns:
                        columns.append(b.sql)
                    return replace(b, sql=f"x.c{columns.index(b.sql)}")
                return Binder.value(inner, e, sc, group)

        row = Row(self)
        steps = [row.to(row.value(i.value, scope), self.variables[n][0]).sql for n, i in zip(names, spec.items, strict=True)]
        where = f" WHERE {binder.condition(spec.where, scope)}" if spec.where is not None else ""
        keys = [(binder.collated(binder.value(e, scope)).sql, d) for e, d in q.order]
        start = ", ".join(f"{self.variable(n).sql} AS v{i}" for i, n in enumerate(names))
        # later assignments of a row see the earlier ones
        body = "acc"
        for i, step in enumerate(steps):
            fields = ", ".join(f"{step if k == i else f'acc.v{k}'} AS v{k}" for k in range(len(names)))
            body = f"transform(array({body}), acc -> struct({fields}))[0]" if i else f"struct({fields})"
        inner = f"SELECT {', '.join(f'{c} AS c{i}' for i, c in enumerate(columns)) or '1 AS c0'}{''.join(f', {k} AS k{i}' for i, (k, _) in enumerate(keys))} FROM {sql_from}{where}"
        # the rows of a fold are one value; they are put in order within it
        picked = f"struct({', '.join([*(f'c{i}' for i in range(max(1, len(columns)))), *(f'k{i}' for i in range(len(keys)))])})"
        gathered = f"collect_list({picked})"
        if keys:
            compare = "0"
            for i, (_, d) in reversed(list(enumerate(keys))):
                less, more = (1, -1) if d else (-1, 1)
                compare = f"CASE WHEN l.k{i} <=> r.k{i} THEN {compare} WHEN l.k{i} IS NULL THEN {less} WHEN r.k{i} IS NULL THEN {more} WHEN l.k{i} < r.k{i} THEN {less} ELSE {more} END"
            gathered = f"array_sort({gathered}, (l, r) -> {compare})"
        out = self.spark.sql(f"SELECT aggregate({gathered}, struct({start}), (acc, x) -> {body}) AS v, count(*) AS n FROM ({inner})").first()
        for i, n in enumerate(names):
            t, _ = self.variables[n]
            self.variables[n] = (t, out["v"][i])
        self.rowcount = out["n"]

    def _store(self, name: str, b: Bound, value) -> None:
        """Convert a fetched value to a variable's type."""
        t = self.variables[name][0]
        if value is None:
            self.variables[name] = (t, None)
            return
        if b.type == t:
            self.variables[name] = (t, value)
            return
        self.variables[name] = (t, self.value_of(convert.convert(Binder(self), self.typed(b.type, value), t, None, False)))

    def _into(self, q: Node) -> None:
        target = q.body.into
        if f"{target[-2] if len(target) > 1 else 'dbo'}.{target[-1]}".lower() in self.tables:
            raise TsqlError(2714, f"There is already an object named '{target[-1]}' in the database.")
        binder = Binder(self)
        sql, cols = binder.query(q)
        names = [n for n, _ in cols]
        if any(not n for n in names):
            raise TsqlError(1038, "An object or column name is missing or empty.")
        if len({n.lower() for n in names}) < len(names):
            raise TsqlError(2705, "Column names in each table must be unique.")
        piece = dml.stored(self, self.spark.sql(sql).toDF(*names))
        df = piece.drop("__rid")
        table = Table(target[-2] if len(target) > 1 else "dbo", target[-1], self.catalog.next_id(), tuple(Column(n, t) for n, t in cols), df, self.new_view(df), pieces=(piece,))
        self.tables[table.key] = table
        self.counted(df.count())

    def do_insert(self, s: Node) -> None:
        self.counted(dml.insert(self, s))

    def do_update(self, s: Node) -> None:
        self.counted(dml.update(self, s))

    def do_delete(self, s: Node) -> None:
        self.counted(dml.delete(self, s))

    def do_truncate(self, s: Node) -> None:
        dml.truncate(self, s)
        self.rowcount = 0

    def do_declare(self, s: Node) -> None:
        for name, kind, value in s.items:
            key = name.lower()
            if key in self.variables:
                raise TsqlError(134, f"The variable name '{name}' has already been declared.")
            self.variables[key] = (ty.named(*kind), None)
            if value is not None:
                self._set(key, value)
                self.rowcount = 1

    def _set(self, key: str, value: Node) -> None:
        if key not in self.variables:
            raise TsqlError(137, f"Must declare the scalar variable \"{key}\".")
        t = self.variables[key][0]
        binder = Binder(self)
        b = binder.value(value, Scope([]))
        x = convert.convert(binder, b, t, None, False) if b.type != t or b.is_null else b
        self.variables[key] = (t, self.value_of(x))

    def do_set(self, s: Node) -> None:
        self._set(s.var.lower(), s.value)
        self.rowcount = 1

    def do_set_option(self, s: Node) -> None:
        for n in s.names:
            if n == "IDENTITY_INSERT":
                self.identity_insert = self.table(s.table).key if s.value == "ON" else None
            elif n == "DATEFIRST":
                if s.value not in "1234567":
                    raise TsqlError(2744, "DATEFIRST must be from 1 to 7.")
                self.date_first = int(s.value)
            self.options[n] = str(s.value)
        self.rowcount = 0

    def do_print(self, s: Node) -> None:
        binder = Binder(self)
        value = self.value_of(binder.to_string(binder.value(s.value, Scope([]))))
        self.results.append(Result("message", text=value if value is not None else ""))
        self.rowcount = 0

    def do_return(self, s: Node) -> None:
        raise _Return

    def do_use(self, s: Node) -> None:
        for d in self.catalog.databases:
            if d.lower() == s.name.lower():
                self.database = d
                return
        raise TsqlError(911, f"Database '{s.name}' does not exist.")

    # transactions
    def do_begin_tran(self, s: Node) -> None:
        self.transactions.append((s.name, self.catalog.snapshot()))

    def do_commit(self, s: Node) -> None:
        if not self.transactions:
            raise TsqlError(3902, "The COMMIT TRANSACTION request has no corresponding BEGIN TRANSACTION.")
        self.transactions.pop()

    def do_rollback(self, s: Node) -> None:
        if s.name and s.name.lower() in self.saves:
            self.catalog.databases = {n: dict(t) for n, t in self.saves[s.name.lower()].items()}
            return
        self._rollback(s.name)

    def _rollback(self, name) -> None:
        if not self.transactions:
            raise TsqlError(3903, "The ROLLBACK TRANSACTION request has no corresponding BEGIN TRANSACTION.")
        self.catalog.databases = self.transactions[0][1]
        self.transactions, self.saves = [], {}

    def do_save(self, s: Node) -> None:
        self.saves[s.name.lower()] = self.catalog.snapshot()

    # definitions
    def do_create_database(self, s: Node) -> None:
        if any(d.lower() == s.name.lower() for d in self.catalog.databases):
            raise TsqlError(1801, f"Database '{s.name}' already exists.")
        self.catalog.databases[s.name] = {}

    def do_drop_database(self, s: Node) -> None:
        for parts in s.names:
            found = next((d for d in self.catalog.databases if d.lower() == parts[-1].lower()), None)
            if found is None and not s.exists:
                raise TsqlError(3701, f"Cannot drop the database '{parts[-1]}', because it does not exist.")
            if found == self.database:
                raise TsqlError(3702, f"Cannot drop database \"{found}\" because it is currently in use.")
            self.catalog.databases.pop(found, None)

    def do_alter_database(self, s: Node) -> None:
        """Settings of a database have no meaning here; the database must be there."""
        name = s.get("name")
        if name and name.upper() != "CURRENT" and not any(d.lower() == name.lower() for d in self.catalog.databases):
            raise TsqlError(5011, f"User does not have permission to alter database '{name}', the database does not exist, or the database is not in a state that allows access checks.")

    def do_create_schema(self, s: Node) -> None:
        if s.name.lower() in ("dbo", "sys", "information_schema", *[n.lower() for n in self.catalog.schemas.get(self.database, [])]):
            raise TsqlError(2714, f"There is already an object named '{s.name}' in the database.")
        self.catalog.schemas.setdefault(self.database, []).append(s.name)

    def _column(self, c: Node, constraints: list[Node], table: str) -> Column:
        if c.type is None:
            return Column(c.name, ty.INT, True, computed=c.computed)
        t = ty.named(*c.type)
        default = next((k for k in constraints if k.kind == "default" and k.column == c.name), None)
        primary = any(k.kind == "primary" and c.name.lower() in [n.lower() for n, _ in k.columns] for k in constraints)
        nullable = c.nullable if c.nullable is not None else not primary and c.identity is None
        return Column(c.name, t, nullable and not primary, c.identity, default.value if default else None, (default.name or f"DF__{table}__{c.name}") if default else None)

    def _keys(self, t: Table, constraints: list[Node]) -> Table:
        keys, foreign, checks = list(t.keys), list(t.foreign), list(t.checks)
        for k in constraints:
            if k.kind in ("primary", "unique"):
                names = tuple(t.column(n).name for n, _ in k.columns)
                if k.kind == "primary" and any(x.kind == "primary" for x in keys):
                    raise TsqlError(1779, f"Table '{t.name}' already has a primary key defined on it.")
                keys.append(Key(k.name or f"{'PK' if k.kind == 'primary' else 'UQ'}__{t.name}__{len(keys) + 1}", k.kind, names))
            elif k.kind == "foreign":
                parent = t if k.parent[-1].lower() == t.name.lower() else self.table(k.parent)
                theirs = k.parent_columns or next((list(x.columns) for x in (keys if parent is t else parent.keys) if x.kind == "primary"), None)
                if theirs is None:
                    raise TsqlError(1773, f"Foreign key '{k.name}' has implicit reference to object '{parent.name}' which does not have a primary key defined on it.")
                foreign.append(Foreign(k.name or f"FK__{t.name}__{len(foreign) + 1}", tuple(t.column(n).name for n in k.columns), parent.key, tuple(parent.column(n).name for n in theirs)))
            elif k.kind == "check":
                checks.append(Check(k.name or f"CK__{t.name}__{len(checks) + 1}", k.test, k.text))
        return replace(t, keys=tuple(keys), foreign=tuple(foreign), checks=tuple(checks))

    def do_create_table(self, s: Node) -> None:
        schema = s.table[-2] if len(s.table) > 1 else "dbo"
        if f"{schema}.{s.table[-1]}".lower() in self.tables:
            raise TsqlError(2714, f"There is already an object named '{s.table[-1]}' in the database.")
        if len({c.name.lower() for c in s.columns}) < len(s.columns):
            raise TsqlError(2705, "Column names in each table must be unique.")
        columns = tuple(self._column(c, s.constraints, s.table[-1]) for c in s.columns)
        columns = self._typed_computed(columns)
        df = self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type.spark()}" for c in columns))
        first = next((c.identity[0] for c in columns if c.identity), None)
        t = Table(schema, s.table[-1], self.catalog.next_id(), columns, df, self.new_view(df), next_identity=first)
        self.tables[t.key] = self._keys(t, s.constraints)

    def _typed_computed(self, columns: tuple[Column, ...]) -> tuple[Column, ...]:
        from .plans.binder import Source

        scope = Scope([Source([""], "x", [(c.name, c.type, f"x.`{c.name}`") for c in columns if c.computed is None])])
        return tuple(replace(c, type=Binder(self).value(c.computed, scope).type) if c.computed is not None else c for c in columns)

    def do_drop_table(self, s: Node) -> None:
        for parts in s.names:
            try:
                t = self.table(parts)
            except TsqlError:
                if s.exists:
                    continue
                raise TsqlError(3701, f"Cannot drop the table '{'.'.join(parts)}', because it does not exist or you do not have permission.") from None
            if any(f.parent == t.key for o in self.tables.values() for f in o.foreign if o.key != t.key):
                raise TsqlError(3726, f"Could not drop object '{t.name}' because it is referenced by a FOREIGN KEY constraint.")
            del self.tables[t.key]

    def do_alter_add(self, s: Node) -> None:
        t = self.table(s.table)
        df, columns = t.df, list(t.columns)
        for c in s.columns:
            if any(x.name.lower() == c.name.lower() for x in columns):
                raise TsqlError(2705, "Column names in each table must be unique.")
            new = self._column(c, s.constraints, t.name)
            if new.computed is not None:
                new = self._typed_computed((*columns, new))[-1]
            columns.append(new)
            if new.identity is not None:
                df, n = dml.numbered(self, df, new.identity[0], new.identity[1], new.name)
                df = df.withColumn(new.name, F.col(new.name).cast(new.type.spark()))
                t = replace(t, next_identity=new.identity[0] + n * new.identity[1], last_identity=new.identity[0] + (n - 1) * new.identity[1] if n else None)
            elif new.computed is None:
                if new.default is not None and not new.nullable:
                    binder = Binder(self)
                    df = df.withColumn(new.name, F.expr(binder.to(binder.value(new.default, Scope([])), new.type).sql))
                else:
                    df = df.withColumn(new.name, F.lit(None).cast(new.type.spark()))
                    if not new.nullable and df.limit(1).count():
                        raise TsqlError(4901, "ALTER TABLE only allows columns to be added that can contain nulls, or have a DEFAULT definition.")
        for k in s.constraints:
            if k.kind == "default":
                columns = [replace(x, default=k.value, default_name=k.name or f"DF__{t.name}__{x.name}") if x.name.lower() == (k.column or "").lower() else x for x in columns]
            if k.kind == "primary":
                names = [n.lower() for n, _ in k.columns]
                if any(x.nullable for x in columns if x.name.lower() in names):
                    raise TsqlError(8111, f"Cannot define PRIMARY KEY constraint on nullable column in table '{t.name}'.")
        t = self._keys(replace(t, columns=tuple(columns)), s.constraints)
        new = dml.with_computed(self, t, df)
        dml.violations(self, t, new)
        dml.publish(self, t, (dml.stored(self, new),))

    def do_alter_drop(self, s: Node) -> None:
        t = self.table(s.table)
        for name in s.names:
            low = name.lower()
            if s.what == "column":
                c = t.column(name)
                if any(c.name in k.columns for k in t.keys) or any(c.name in f.columns for f in t.foreign) or c.default is not None:
                    raise TsqlError(5074, f"The object is dependent on column '{name}'.")
                t = replace(t, columns=tuple(x for x in t.columns if x is not c), df=t.df.drop(c.name))
                continue
            known = [k.name.lower() for k in (*t.keys, *t.foreign, *t.checks)] + [(c.default_name or "").lower() for c in t.columns]
            if low not in known:
                raise TsqlError(3728, f"'{name}' is not a constraint.")
            t = replace(t, keys=tuple(k for k in t.keys if k.name.lower() != low), foreign=tuple(k for k in t.foreign if k.name.lower() != low), checks=tuple(k for k in t.checks if k.name.lower() != low), columns=tuple(replace(c, default=None, default_name=None) if (c.default_name or "").lower() == low else c for c in t.columns))
        dml.publish(self, t, t.df)

    def do_create_index(self, s: Node) -> None:
        t = self.table(s.table)
        if any(k.name.lower() == s.name.lower() for k in t.keys):
            raise TsqlError(1913, f"The operation failed because an index with name '{s.name}' already exists on table '{t.name}'.")
        key = Key(s.name, "index", tuple(t.column(n).name for n, _ in s.columns), s.unique, tuple(t.column(n).name for n in s.include))
        t = replace(t, keys=(*t.keys, key))
        try:
            dml.violations(self, replace(t, checks=(), foreign=()), t.df)
        except TsqlError as e:
            raise TsqlError(1505, e.message) from None
        self.tables[t.key] = t

    def do_drop_index(self, s: Node) -> None:
        t = self.table(s.table)
        if not any(k.name.lower() == s.name.lower() and k.kind == "index" for k in t.keys):
            if s.exists:
                return
            raise TsqlError(3701, f"Cannot drop the index '{s.name}', because it does not exist.")
        self.tables[t.key] = replace(t, keys=tuple(k for k in t.keys if k.name.lower() != s.name.lower()))

    # procedures
    def do_exec_text(self, s: Node) -> None:
        self.nested(self.value_of(Binder(self).to_string(Binder(self).value(s.text, Scope([])))), {})

    def nested(self, text: str, variables: dict) -> dict:
        """Run a text in a level of its own: its variables and SET options end with it."""
        if self.level >= 32:
            raise TsqlError(217, "Maximum stored procedure, function, trigger, or view nesting level exceeded (limit 32).")
        outer, options, database, first = self.variables, dict(self.options), self.database, self.date_first
        self.variables, self.level = dict(variables), self.level + 1
        try:
            self.run(parse(text or ""))
        except _Return:
            pass
        finally:
            inner = self.variables
            self.variables, self.options, self.database, self.date_first, self.level = outer, options, database, first, self.level - 1
        return inner

    def do_exec(self, s: Node) -> None:
        name = s.proc[-1].lower()
        args = [(label, None if v is None else Binder(self).value(v, Scope([])), v, out) for label, v, out in s.args]
        literal = lambda i: None if len(args) <= i or args[i][1] is None else (args[i][1].literal if args[i][1].literal is not None else self.value_of(args[i][1]))
        if name == "sp_executesql":
            return self._parameterized(literal(0), literal(1) or "", args[2:])
        if name in ("sp_prepare", "sp_prepexec"):
            handle = len(self.prepared) + 1
            self.prepared[handle] = (literal(1) or "", literal(2))
            if args and args[0][2].kind == "var":
                self.variables[args[0][2].name.lower()] = (ty.INT, handle)
            if name == "sp_prepexec":
                self._parameterized(self.prepared[handle][1], self.prepared[handle][0], args[3:])
            return None
        if name == "sp_execute":
            if literal(0) not in self.prepared:
                raise TsqlError(8179, f"Could not find prepared statement with handle {literal(0)}.")
            params, text = self.prepared[literal(0)]
            return self._parameterized(text, params, args[1:])
        if name == "sp_unprepare":
            self.prepared.pop(literal(0), None)
            return None
        if name == "sp_describe_first_result_set":
            _, cols = Binder(self).query(parse(literal(0))[0].query)
            rows = [(i + 1, n, t.text()) for i, (n, t) in enumerate(cols)]
            return self.rows(["column_ordinal", "name", "system_type_name"], rows, "column_ordinal int, name string, system_type_name string")
        queries = {
            "sp_tables": "SELECT TABLE_CATALOG AS TABLE_QUALIFIER, TABLE_SCHEMA AS TABLE_OWNER, TABLE_NAME, 'TABLE' AS TABLE_TYPE FROM INFORMATION_SCHEMA.TABLES ORDER BY TABLE_NAME",
            "sp_databases": "SELECT name AS DATABASE_NAME FROM sys.databases ORDER BY name",
            "sp_who": "SELECT session_id AS spid, status, login_name AS loginame FROM sys.dm_exec_sessions",
            "sp_who2": "SELECT session_id AS spid, status, login_name AS loginame FROM sys.dm_exec_sessions",
            "sp_helpdb": "SELECT name, database_id AS dbid FROM sys.databases ORDER BY name",
        }
        named = {"sp_columns": ("INFORMATION_SCHEMA.COLUMNS", "TABLE_NAME, COLUMN_NAME, DATA_TYPE AS TYPE_NAME, NUMERIC_PRECISION, CHARACTER_MAXIMUM_LENGTH, IS_NULLABLE, ORDINAL_POSITION"), "sp_pkeys": ("INFORMATION_SCHEMA.KEY_COLUMN_USAGE", "TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION AS KEY_SEQ, CONSTRAINT_NAME AS PK_NAME"), "sp_help": ("INFORMATION_SCHEMA.COLUMNS", "COLUMN_NAME AS Column_name, DATA_TYPE AS Type, IS_NULLABLE AS Nullable")}
        named["sp_columns_100"] = named["sp_columns"]
        if name in queries:
            return self.nested(queries[name], {})
        if name in named and args:
            view, columns = named[name]
            return self.nested(f"SELECT {columns} FROM {view} WHERE TABLE_NAME = {quote(str(literal(0)))}", {})
        if name == "sp_server_info":
            return self.rows(["attribute_id", "attribute_name", "attribute_value"], [(1, "DBMS_NAME", "T-SQL on Spark")], "attribute_id int, attribute_name string, attribute_value string")
        if name.removesuffix("_100") in procedures.PARAMETERS:
            places = procedures.PARAMETERS[name.removesuffix("_100")].split()
            if len(args) > len(places):
                raise TsqlError(8144, f"Procedure or function {name} has too many arguments specified.")
            schema, found = procedures.result(self.catalog, self.database, name, {(label or places[i]).lower(): literal(i) for i, (label, _, _, _) in enumerate(args)})
            return self.rows([c.split()[0] for c in schema.split(", ")], found, schema)
        if name == "sp_describe_undeclared_parameters":
            return self._undeclared(literal(0) or "", literal(1) or "")
        raise TsqlError(2812, f"Could not find stored procedure '{'.'.join(s.proc)}'.")

    def _undeclared(self, text: str, params: str) -> None:
        """The variables of a text that it doesn't declare, with the type of what each is compared with."""
        declared = {n.lower() for n, _, _ in (parse(f"DECLARE {params}")[0].items if params.strip() else [])}
        found: dict[str, str | None] = {}
        columns = {c.name.lower(): c.type for t in self.tables.values() for c in t.columns}

        def walk(e) -> None:
            if isinstance(e, (list, tuple)):
                for x in e:
                    walk(x)
            elif isinstance(e, Node):
                if e.kind == "declare":
                    declared.update(n.lower() for n, _, _ in e.items)
                if e.kind == "var" and not e.name.startswith("@@") and e.name.lower() not in declared:
                    found.setdefault(e.name, None)
                sides = [e.get(n) for n in ("left", "right", "value", "low", "high", "pattern")]
                names = [x.name for x in sides if isinstance(x, Node) and x.kind == "var" and x.name.lower() not in declared]
                types = [columns.get(x.parts[-1].lower()) for x in sides if isinstance(x, Node) and x.kind == "col"]
                for n in names:
                    found[n] = found.get(n) or next((t.text() for t in types if t is not None), None)
                walk([x for x in e.__dict__.values() if isinstance(x, (Node, list, tuple))])

        walk(parse(text))
        rows = [(i + 1, n, t or "sql_variant") for i, (n, t) in enumerate(found.items())]
        self.rows(["parameter_ordinal", "name", "suggested_system_type_name"], rows, "parameter_ordinal int, name string, suggested_system_type_name string")

    def rows(self, names, rows, schema) -> None:
        self.results.append(Result("rows", df=self.spark.createDataFrame(rows, schema).toDF(*names)))

    def _parameterized(self, text: str, params: str, args: list) -> None:
        declared = parse(f"DECLARE {params}")[0].items if params.strip() else []
        values = {n.lower(): (ty.named(*k), None) for n, k, _ in declared}
        back = {}
        for i, (label, bound, node, out) in enumerate(args):
            name = (label or declared[i][0]).lower()
            if name not in values:
                raise TsqlError(8145, f"{name} is not a parameter for the statement.")
            t = values[name][0]
            if bound is not None:
                x = convert.convert(Binder(self), bound, t, None, False) if bound.type != t or bound.is_null else bound
                values[name] = (t, self.value_of(x))
            if out and node is not None and node.kind == "var":
                back[name] = node.name.lower()
        missing = [n for i, (n, _, _) in enumerate(declared) if i >= len(args) and n.lower() not in [(a[0] or "").lower() for a in args]]
        if missing:
            raise TsqlError(8178, f"The parameterized query expects the parameter '{missing[0]}', which was not supplied.")
        inner = self.nested(text, values)
        for name, target in back.items():
            self._store(target, Bound("", inner[name][0]), inner[name][1])


def mentions(e, names: set[str]) -> bool:
    if isinstance(e, (list, tuple)):
        return any(mentions(x, names) for x in e)
    if not isinstance(e, Node):
        return False
    return e.kind == "var" and e.name.lower() in names or any(mentions(x, names) for x in e.__dict__.values() if isinstance(x, (Node, list, tuple)))


def compile_program(statements: list[Node]) -> tuple[list[tuple], dict[str, int]]:
    """A flat program with jumps: GOTO can leave and enter blocks."""
    program: list[list] = []
    labels: dict[str, int] = {}
    loops: list[tuple[int, list[int]]] = []
    gotos: list[str] = []

    def emit(s: Node) -> None:
        if s.kind == "block":
            for x in s.body:
                emit(x)
        elif s.kind == "if":
            at = len(program)
            program.append(["unless", s.test, None])
            emit(s.then)
            if s.other is not None:
                over = len(program)
                program.append(["jump", None, None])
                program[at][2] = len(program)
                emit(s.other)
                program[over][2] = len(program)
            else:
                program[at][2] = len(program)
        elif s.kind == "while":
            at = len(program)
            program.append(["unless", s.test, None])
            loops.append((at, []))
            emit(s.body)
            program.append(["jump", None, at])
            _, breaks = loops.pop()
            for k in (at, *breaks):
                program[k][2] = len(program)
        elif s.kind in ("break", "continue"):
            if not loops:
                raise TsqlError(135 if s.kind == "break" else 136, f"Cannot use a {s.kind.upper()} statement outside the scope of a WHILE statement.")
            if s.kind == "break":
                loops[-1][1].append(len(program))
            program.append(["jump", None, loops[-1][0]])
        elif s.kind == "label":
            if s.name.lower() in labels:
                raise TsqlError(132, f"The label '{s.name}' has already been declared.")
            labels[s.name.lower()] = len(program)
        elif s.kind == "goto":
            gotos.append(s.name.lower())
            program.append(["jump", None, s.name.lower()])
        else:
            program.append(["run", s, None])

    for s in statements:
        emit(s)
    for g in gotos:
        if g not in labels:
            raise TsqlError(133, f"A GOTO statement references the label '{g}' but the label has not been declared.")
    return [tuple(p) for p in program], labels


def runtime_error(e: PySparkException) -> TsqlError:
    """The dialect's number for an error that Spark raised."""
    text = str(e)
    if m := re.search(r"Msg (\d+): ([^\n]*)", text):
        return TsqlError(int(m[1]), m[2])
    for mark, number, message in (
        ("DIVIDE_BY_ZERO", 8134, "Divide by zero error encountered."), ("REMAINDER_BY_ZERO", 8134, "Divide by zero error encountered."), ("CAST_INVALID_INPUT", 245, "Conversion failed when converting a value."), ("CAST_OVERFLOW", 8115, "Arithmetic overflow error."),
        ("ARITHMETIC_OVERFLOW", 8115, "Arithmetic overflow error."), ("NUMERIC_VALUE_OUT_OF_RANGE", 8115, "Arithmetic overflow error."), ("SCALAR_SUBQUERY_TOO_MANY_ROWS", 512, "Subquery returned more than 1 value."), ("DATETIME_FIELD_OUT_OF_BOUNDS", 289, "Cannot construct data type date, some of the arguments have values which are not valid."),
        ("CANNOT_PARSE_TIMESTAMP", 241, "Conversion failed when converting date and/or time from character string."),
    ):
        if mark in text:
            return TsqlError(number, message)
    return TsqlError(50000, text.split("\n")[0][:400])


__all__ = ["BINARY", "Result", "ResultFrame", "TsqlSession"]
