"""The dialect's types, their precedence, and the result types of arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .errors import TsqlError

#: Coercion order, weakest first.
PRECEDENCE = [
    "null", "binary", "varbinary", "char", "varchar", "nchar", "nvarchar", "uniqueidentifier", "bit", "tinyint", "smallint", "int", "bigint",
    "smallmoney", "money", "decimal", "real", "float", "time", "date", "smalldatetime", "datetime", "datetime2", "datetimeoffset",
]
INTEGERS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
MONEY = {"money": (19, 4), "smallmoney": (10, 4)}
STRINGS = ("char", "varchar", "nchar", "nvarchar")
BINARIES = ("binary", "varbinary")
DATES = ("date", "time", "datetime", "smalldatetime", "datetime2", "datetimeoffset")
MAX = -1


@dataclass(frozen=True)
class SqlType:
    name: str
    p: int = 0
    s: int = 0
    n: int = 0  # length of strings and binaries, MAX for (max)

    @property
    def rank(self) -> int:
        return PRECEDENCE.index(self.name)

    @property
    def is_integer(self) -> bool:
        return self.name in INTEGERS

    @property
    def is_exact(self) -> bool:
        return self.is_integer or self.name in MONEY or self.name == "decimal"

    @property
    def is_float(self) -> bool:
        return self.name in ("float", "real")

    @property
    def is_numeric(self) -> bool:
        return self.is_exact or self.is_float or self.name == "bit"

    @property
    def is_string(self) -> bool:
        return self.name in STRINGS

    @property
    def is_date(self) -> bool:
        return self.name in DATES

    @property
    def is_binary(self) -> bool:
        return self.name in BINARIES

    def spark(self) -> str:
        """The Spark SQL type that holds it."""
        if self.name == "decimal":
            return f"DECIMAL({self.p},{self.s})"
        return {
            "null": "INT", "bit": "BOOLEAN", "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "money": "DECIMAL(19,4)", "smallmoney": "DECIMAL(10,4)",
            "float": "DOUBLE", "real": "FLOAT", "binary": "BINARY", "varbinary": "BINARY", "date": "DATE", "datetime": "TIMESTAMP_NTZ", "smalldatetime": "TIMESTAMP_NTZ",
            "datetime2": "TIMESTAMP_NTZ", "datetimeoffset": "TIMESTAMP_NTZ",
        }.get(self.name, "STRING")

    def exact(self) -> tuple[int, int]:
        """Precision and scale of an exact number."""
        if self.name == "decimal":
            return self.p, self.s
        if self.name == "bit":
            return 1, 0
        return MONEY.get(self.name) or (INTEGERS[self.name], 0)

    def text(self) -> str:
        if self.name == "decimal":
            return f"decimal({self.p},{self.s})"
        if self.is_string or self.is_binary:
            return f"{self.name}({'max' if self.n == MAX else self.n})"
        return f"{self.name}({self.s})" if self.name in ("time", "datetime2", "datetimeoffset") else self.name


NULL, BIT, INT, BIGINT, FLOAT, DATE, DATETIME = (SqlType(n) for n in ("null", "bit", "int", "bigint", "float", "date", "datetime"))
DATETIME2 = SqlType("datetime2", s=6)


def decimal(p: int, s: int) -> SqlType:
    return SqlType("decimal", p, s)


def varchar(n: int) -> SqlType:
    return SqlType("varchar", n=n if 0 < n <= 8000 else MAX)


def nvarchar(n: int) -> SqlType:
    return SqlType("nvarchar", n=n if 0 < n <= 4000 else MAX)


#: Other names of types.
SYNONYMS = {"integer": "int", "dec": "decimal", "numeric": "decimal", "character": "char", "sysname": "nvarchar", "rowversion": "?", "timestamp": "?"}


def named(name: str, args: list, cast: bool = False) -> SqlType:
    """The type of a declaration or CAST target."""
    name = SYNONYMS.get(name.lower(), name.lower())
    if name == "double":
        name = "float"
    first = args[0] if args else None
    if name == "decimal":
        p, s = (int(args[0]) if args else 18), (int(args[1]) if len(args) > 1 else 0)
        if not 1 <= p <= 38 or s > p:
            raise TsqlError(1001 if s > p else 2716, "bad precision or scale")
        return decimal(p, s)
    if name == "float":
        return SqlType("real") if first is not None and int(first) <= 24 else FLOAT
    if name in STRINGS or name in BINARIES:
        if first == "max":
            return SqlType(name, n=MAX)
        return SqlType(name, n=int(first) if first is not None else (30 if cast else 1))
    if name in ("time", "datetime2", "datetimeoffset"):
        return SqlType(name, s=int(first) if first is not None else 7)
    if name in PRECEDENCE and name != "null":
        return SqlType(name)
    raise TsqlError(2715, f"Cannot find data type {name}.")


def from_spark(kind: T.DataType) -> SqlType:
    """The dialect's type of a column that was read from files."""
    if isinstance(kind, T.DecimalType):
        return decimal(kind.precision, kind.scale)
    if isinstance(kind, T.StringType):
        return SqlType("nvarchar", n=MAX)
    return {
        T.BooleanType: BIT, T.ByteType: SqlType("smallint"), T.ShortType: SqlType("smallint"), T.IntegerType: INT, T.LongType: BIGINT, T.FloatType: SqlType("real"), T.DoubleType: FLOAT,
        T.DateType: DATE, T.TimestampNTZType: DATETIME2, T.TimestampType: DATETIME2, T.BinaryType: SqlType("varbinary", n=MAX),
    }.get(type(kind), SqlType("nvarchar", n=MAX))


def common(types: list[SqlType]) -> SqlType:
    """The type that values of these types meet in."""
    known = [t for t in types if t.name != "null"]
    if not known:
        return INT if types else NULL
    top = max(known, key=lambda t: t.rank)
    if top.is_string or top.is_binary:
        sizes = [t.n for t in known if t.is_string or t.is_binary]
        return replace(top, n=MAX if MAX in sizes else max(sizes))
    if top.name == "decimal":
        exact = [t.exact() for t in known if t.is_exact or t.name == "bit"]
        s = max(e[1] for e in exact)
        whole = max(e[0] - e[1] for e in exact)
        return decimal(min(38, whole + s), min(s, 38 - min(38, whole)) if whole + s > 38 else s)
    if top.name in ("time", "datetime2", "datetimeoffset"):
        return replace(top, s=max(t.s for t in known if t.name == top.name))
    return top


def _reduced(p: int, s: int, multiplied: bool) -> SqlType:
    if p <= 38:
        return decimal(p, s)
    whole = p - s
    if multiplied:
        return decimal(38, min(s, 38 - whole) if whole < 32 else min(s, 6))
    return decimal(38, max(0, 38 - whole))


def exact_result(op: str, a: tuple[int, int], b: tuple[int, int]) -> SqlType:
    """The type of an operation of two exact numbers given as (precision, scale)."""
    (p1, s1), (p2, s2) = a, b
    if op in "+-":
        s = max(s1, s2)
        return _reduced(s + max(p1 - s1, p2 - s2) + 1, s, False)
    if op == "*":
        return _reduced(p1 + p2 + 1, s1 + s2, True)
    if op == "/":
        s = max(6, s1 + p2 + 1)
        return _reduced(p1 - s1 + s2 + s, s, True)
    s = max(s1, s2)
    return _reduced(min(p1 - s1, p2 - s2) + s, s, False)
