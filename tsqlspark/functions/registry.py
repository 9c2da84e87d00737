"""The scalar library: name -> (fewest arguments, most arguments, function, whether the first argument is a date part)."""

from __future__ import annotations

from dataclasses import replace

from .. import types as ty
from ..errors import TsqlError
from ..types import SqlType

SCALARS: dict[str, tuple] = {}


def scalar(name: str, low: int, high: int | None = None, part: bool = False):
    def add(fn):
        SCALARS[name] = (low, low if high is None else high, fn, part)
        return fn

    return add


def bound(sql: str, t: SqlType, **more):
    from ..plans.binder import Bound

    return Bound(sql, t, **more)


def text(b, x):
    """A string argument; other types become strings."""
    return b.to_string(x) if not x.is_null else bound("CAST(NULL AS STRING)", ty.varchar(1))


def number(b, x, t=ty.INT):
    return b.to(x, t)


def numeric(name, x):
    if x.is_null or not (x.type.is_numeric or x.type.is_string):
        raise TsqlError(8116, f"Argument data type {x.type.name} is invalid for argument 1 of {name} function.")


# -- null handling -------------------------------------------------------------------------------------------------------


@scalar("ISNULL", 2)
def _isnull(b, x, y):
    t = x.type if not x.is_null else y.type
    return bound(f"coalesce({b.to(x, t).sql}, {b.to(y, t).sql})", t)


@scalar("COALESCE", 2, 99)
def _coalesce(b, *xs):
    if all(x.is_null for x in xs):
        raise TsqlError(4127, "At least one of the arguments to COALESCE must be an expression that is not the NULL constant.")
    t = b.common(list(xs))
    return bound(f"coalesce({', '.join(b.to(x, t).sql for x in xs)})", t)


@scalar("NULLIF", 2)
def _nullif(b, x, y):
    if x.is_null:
        raise TsqlError(4151, "The type of the first argument to NULLIF cannot be the NULL constant.")
    return bound(f"(CASE WHEN {b.compare('=', x, y)} THEN NULL ELSE {x.sql} END)", x.type)


# -- strings -------------------------------------------------------------------------------------------------------------


@scalar("LEN", 1)
def _len(b, x):
    s = text(b, x)
    return bound(f"length(rtrim({s.sql}))", ty.BIGINT if s.type.n == ty.MAX and x.type.is_string else ty.INT)


@scalar("DATALENGTH", 1)
def _datalength(b, x):
    t = x.type
    if t.is_string:
        sql = f"octet_length(encode({x.sql}, 'UTF-16LE'))" if t.name in ("nchar", "nvarchar") else f"length({x.sql})"
    elif t.is_binary:
        sql = f"octet_length({x.sql})"
    else:
        size = {"bit": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "real": 4, "float": 8, "money": 8, "smallmoney": 4, "date": 3, "datetime": 8, "smalldatetime": 4, "uniqueidentifier": 16}.get(t.name)
        if size is None:
            size = (5 if t.p < 10 else 9 if t.p < 20 else 13 if t.p < 29 else 17) if t.name == "decimal" else {"time": 3, "datetime2": 6, "datetimeoffset": 8}[t.name] + (t.s > 2) + (t.s > 4)
        sql = f"(CASE WHEN {x.sql} IS NULL THEN NULL ELSE {size} END)"
    return bound(sql, ty.INT)


def _side(name, number_):
    @scalar(name, 2)
    def fn(b, x, n):
        s = text(b, x)
        k = number(b, n).sql
        if isinstance(n.literal, int) and n.literal < 0:
            raise TsqlError(number_, f"Invalid length parameter passed to the {name} function.")
        if not isinstance(n.literal, int):
            k = f"(CASE WHEN {k} < 0 THEN CAST(raise_error('Msg {number_}: Invalid length parameter passed to the {name} function.') AS INT) ELSE {k} END)"
        return bound(f"{name.lower()}({s.sql}, {k})", vary(s.type))

    return fn


def vary(t: SqlType, n: int | None = None) -> SqlType:
    name = "nvarchar" if t.name in ("nchar", "nvarchar") else "varchar"
    return SqlType(name, n=t.n if n is None else n)


_side("LEFT", 536)
_side("RIGHT", 536)


@scalar("SUBSTRING", 3)
def _substring(b, x, start, size):
    s = x if x.type.is_string or x.type.is_binary else text(b, x)
    a, n = number(b, start).sql, number(b, size).sql
    if isinstance(size.literal, int) and size.literal < 0:
        raise TsqlError(537, "Invalid length parameter passed to the SUBSTRING function.")
    if not isinstance(size.literal, int):
        n = f"(CASE WHEN {n} < 0 THEN CAST(raise_error('Msg 537: Invalid length parameter passed to the SUBSTRING function.') AS INT) ELSE {n} END)"
    if isinstance(start.literal, int) and start.literal >= 1:
        return bound(f"substring({s.sql}, {a}, {n})", vary(s.type) if s.type.is_string else s.type)
    return bound(f"substring({s.sql}, greatest({a}, 1), greatest(0, {a} + {n} - greatest({a}, 1)))", vary(s.type) if s.type.is_string else s.type)


for _name in ("UPPER", "LOWER", "LTRIM", "RTRIM", "REVERSE"):

    def _same(b, x, word=_name.lower()):
        s = text(b, x)
        return bound(f"{word}({s.sql})", vary(s.type) if word != "reverse" else s.type)

    scalar(_name, 1)(_same)


@scalar("CHARINDEX", 2, 3)
def _charindex(b, needle, hay, start=None):
    n, h = text(b, needle), text(b, hay)
    a, c = (f"lower({n.sql})", f"lower({h.sql})") if b.session.insensitive(hay.collation or needle.collation) else (n.sql, h.sql)
    at = f"greatest({number(b, start).sql}, 1)" if start is not None else "1"
    return bound(f"(CASE WHEN {n.sql} = '' THEN 0 ELSE locate({a}, {c}, {at}) END)", ty.INT)


@scalar("PATINDEX", 2)
def _patindex(b, pattern, hay):
    from ..plans.binder import like_regex, like_regex_sql, quote

    h = text(b, hay)
    if not isinstance(pattern.literal, str):
        # the pattern without its outer percent signs; where the text may begin and end tells which there were
        p = text(b, pattern).sql
        regex = "concat({mode}, if(startswith(p, '%'), '', '^'), {body}, if(endswith(p, '%') AND p <> '%', '', ' *$'))".format(mode=quote("(?is)" if b.session.insensitive(hay.collation or pattern.collation) else "(?s)"), body=like_regex_sql("regexp_replace(p, '^%|%$', '')", None))
        at = f"transform(array(struct({h.sql} AS h, {p} AS p)), x -> transform(array(x.p), p -> regexp_instr(x.h, {regex}))[0])[0]"
        return bound(f"(CASE WHEN {p} IN ('', '%') THEN CASE WHEN {h.sql} IS NULL THEN NULL WHEN {p} = '%' THEN 1 WHEN rtrim({h.sql}) = '' THEN 1 ELSE 0 END ELSE {at} END)", ty.INT)
    p = pattern.literal
    mode = "(?is)" if b.session.insensitive(hay.collation or pattern.collation) else "(?s)"
    body = like_regex(p[1:] if p.startswith("%") else p, None)
    body = body[:-2] if p.endswith("%") and body.endswith(".*") else body + " *$"
    regex = mode + ("" if p.startswith("%") else "^") + body
    if p.strip("%") == "":
        return bound(f"(CASE WHEN {h.sql} IS NULL THEN NULL WHEN {h.sql} = '' THEN 0 ELSE 1 END)", ty.INT)
    return bound(f"regexp_instr({h.sql}, {quote(regex)})", ty.INT)


@scalar("REPLACE", 3)
def _replace(b, x, old, new):
    s, o, n = text(b, x), text(b, old), text(b, new)
    if b.session.insensitive(x.collation or old.collation):
        sql = f"collate(replace(collate({s.sql}, 'UTF8_LCASE'), collate({o.sql}, 'UTF8_LCASE'), collate({n.sql}, 'UTF8_LCASE')), 'UTF8_BINARY')"
    else:
        sql = f"replace({s.sql}, {o.sql}, {n.sql})"
    return bound(f"(CASE WHEN {o.sql} = '' THEN {s.sql} ELSE {sql} END)", vary(s.type, ty.MAX if s.type.n == ty.MAX else 8000 if s.type.name[0] != "n" else 4000))


@scalar("REPLICATE", 2)
def _replicate(b, x, n):
    s = text(b, x)
    k = number(b, n).sql
    cap = 4000 if s.type.name[0] == "n" else 8000
    body = f"repeat({s.sql}, {k})" if s.type.n == ty.MAX else f"left(repeat({s.sql}, {k}), {cap})"
    return bound(f"(CASE WHEN {k} < 0 THEN NULL ELSE {body} END)", vary(s.type, s.type.n if s.type.n == ty.MAX else cap))


@scalar("STUFF", 4)
def _stuff(b, x, start, size, new):
    s = text(b, x)
    a, n = number(b, start).sql, number(b, size).sql
    put = text(b, new).sql
    valid = f"{a} >= 1 AND {a} <= length({s.sql}) AND {n} >= 0"
    return bound(f"(CASE WHEN {valid} THEN concat(left({s.sql}, {a} - 1), coalesce({put}, ''), substring({s.sql}, {a} + {n})) ELSE NULL END)", vary(s.type, 8000))


@scalar("CONCAT", 2, 254)
def _concat(b, *xs):
    parts = [text(b, x) for x in xs]
    wide = any(p.type.name[0] == "n" for p in parts)
    return bound(f"concat_ws('', {', '.join(p.sql for p in parts)})", ty.nvarchar(4000) if wide else ty.varchar(8000))


#: Characters of code page 1252 at 0x80 to 0x9F; a blank is unassigned.
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


@scalar("CHAR", 1)
def _char(b, x):
    n = number(b, x).sql
    low = f"substring('{CP1252}', {n} - 127, 1)"
    return bound(f"(CASE WHEN {n} NOT BETWEEN 0 AND 255 THEN NULL WHEN {n} BETWEEN 128 AND 159 AND {low} <> ' ' THEN {low} ELSE chr({n}) END)", SqlType("char", n=1))


@scalar("ASCII", 1)
def _ascii(b, x):
    s = text(b, x).sql
    c = f"left({s}, 1)"
    return bound(f"(CASE WHEN {s} = '' THEN NULL WHEN ascii({s}) < 256 THEN ascii({s}) WHEN locate({c}, '{CP1252}') > 0 THEN locate({c}, '{CP1252}') + 127 ELSE 63 END)", ty.INT)


@scalar("NCHAR", 1)
def _nchar(b, x):
    n = number(b, x).sql
    return bound(f"(CASE WHEN {n} BETWEEN 0 AND 65535 THEN decode(unhex(lpad(hex({n}), 4, '0')), 'UTF-16BE') ELSE NULL END)", SqlType("nchar", n=1))


@scalar("UNICODE", 1)
def _unicode(b, x):
    s = text(b, x).sql
    return bound(f"(CASE WHEN {s} = '' THEN NULL ELSE CAST(conv(left(hex(encode(left({s}, 1), 'UTF-16BE')), 4), 16, 10) AS INT) END)", ty.INT)


@scalar("QUOTENAME", 1, 2)
def _quotename(b, x, mark=None):
    from ..plans.binder import quote

    pairs = {"[": "[]", "]": "[]", "'": "''", '"': '""', "(": "()", ")": "()", "<": "<>", ">": "<>", "{": "{}", "}": "{}", "`": "``"}
    m = mark.literal if mark is not None else "["
    if m not in pairs:
        return bound("CAST(NULL AS STRING)", ty.nvarchar(258))
    o, c = pairs[m]
    s = text(b, x).sql
    return bound(f"(CASE WHEN length({s}) > 128 THEN NULL ELSE concat({quote(o)}, replace({s}, {quote(c)}, {quote(c * 2)}), {quote(c)}) END)", ty.nvarchar(258))


# -- mathematics ---------------------------------------------------------------------------------------------------------


def _math_type(b, name, x):
    numeric(name, x)
    if x.type.is_string or x.type.name == "bit":
        return b.to(x, ty.FLOAT)
    if x.type.name in ("tinyint", "smallint"):
        return b.to(x, ty.INT)
    return b.to(x, ty.FLOAT) if x.type.name == "real" else x


@scalar("ABS", 1)
def _abs(b, x):
    x = _math_type(b, "abs", x)
    return bound(f"abs({x.sql})", x.type)


def _whole(name, word):
    @scalar(name, 1)
    def fn(b, x):
        x = _math_type(b, name.lower(), x)
        t = ty.decimal(x.type.p, 0) if x.type.name == "decimal" else x.type
        return bound(x.sql if x.type.is_integer else f"CAST({word}({x.sql}) AS {t.spark()})", t)

    return fn


_whole("CEILING", "ceil")
_whole("FLOOR", "floor")


@scalar("ROUND", 2, 3)
def _round(b, x, n, cut=None):
    x = _math_type(b, "round", x)
    k = number(b, n)
    truncate = cut is not None and not (isinstance(cut.literal, int) and cut.literal == 0)
    if not isinstance(k.literal, int):
        # a shift by a power of ten, as Spark rounds at constant places only
        wide = x.sql if not x.type.is_integer else f"CAST({x.sql} AS DECIMAL(20,0))"
        step = f"pow(10D, {k.sql})"
        if x.type.is_float:
            whole = f"round({wide} * {step})" if not truncate else f"(signum({wide}) * floor(abs({wide} * {step})))"
            return bound(f"CAST({whole} / {step} AS {x.type.spark()})", x.type)
        places = x.type.s if x.type.name == "decimal" else 4 if x.type.name in ty.MONEY else 0
        options = range(-20, places + 1)
        one = (lambda p: f"round({wide}, {p})") if not truncate else (lambda p: f"signum({wide}) * floor(abs({wide}), {p})")
        arms = " ".join(f"WHEN {p} THEN CAST({one(p)} AS {x.type.spark()})" for p in options)
        return bound(f"(CASE WHEN {k.sql} IS NULL OR {wide} IS NULL THEN NULL ELSE CASE greatest(least({k.sql}, {places}), -20) {arms} END END)", x.type)
    if not truncate:
        return bound(f"CAST(round({x.sql}, {k.literal}) AS {x.type.spark()})", x.type)
    d = x.sql if not x.type.is_float else f"CAST({x.sql} AS DECIMAL(38,12))"
    return bound(f"CAST(signum({x.sql}) * floor(abs({d}), {k.literal}) AS {x.type.spark()})", x.type)


@scalar("POWER", 2)
def _power(b, x, y):
    x = _math_type(b, "power", x)
    t = ty.decimal(38, x.type.s) if x.type.name == "decimal" else x.type
    p = f"pow(CAST({x.sql} AS DOUBLE), {b.to(y, ty.FLOAT).sql})"
    if x.type.is_integer:
        p = f"(CASE WHEN {p} < 0 THEN ceil({p}) ELSE floor({p}) END)"
    return bound(f"CAST({p} AS {t.spark()})", t)


@scalar("SQRT", 1)
def _sqrt(b, x):
    f = b.to(x, ty.FLOAT).sql
    return bound(f"(CASE WHEN {f} < 0 THEN raise_error('Msg 3623: An invalid floating point operation occurred.') ELSE sqrt({f}) END)", ty.FLOAT)


@scalar("SIGN", 1)
def _sign(b, x):
    x = _math_type(b, "sign", x)
    return bound(f"CAST(signum({x.sql}) AS {x.type.spark()})", x.type)


@scalar("RAND", 0, 1)
def _rand(b, seed=None):
    return bound(f"rand({seed.literal})" if seed is not None and isinstance(seed.literal, int) else "rand()", ty.FLOAT)


@scalar("PI", 0)
def _pi(b):
    return bound("pi()", ty.FLOAT)


# -- dates ---------------------------------------------------------------------------------------------------------------

#: Names of the date parts.
PARTS = {
    "year": "year", "yy": "year", "yyyy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter", "month": "month", "mm": "month", "m": "month", "dayofyear": "dayofyear", "dy": "dayofyear", "y": "dayofyear",
    "day": "day", "dd": "day", "d": "day", "week": "week", "wk": "week", "ww": "week", "weekday": "weekday", "dw": "weekday", "w": "weekday", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "n": "minute",
    "second": "second", "ss": "second", "s": "second", "millisecond": "millisecond", "ms": "millisecond", "microsecond": "microsecond", "mcs": "microsecond", "nanosecond": "nanosecond", "ns": "nanosecond",
    "iso_week": "iso_week", "isowk": "iso_week", "isoww": "iso_week", "tzoffset": "tzoffset", "tz": "tzoffset",
}


def part_of(word: str, name: str) -> str:
    if word not in PARTS:
        raise TsqlError(155, f"'{word}' is not a recognized {name} option.")
    return PARTS[word]


def dated(b, x):
    """A date argument; strings and numbers become datetimes."""
    if x.type.is_date:
        if x.type.name == "time":
            return replace(x, sql=f"CAST(concat('1900-01-01 ', {x.sql}) AS TIMESTAMP_NTZ)")
        return x
    if x.is_null:
        return bound("CAST(NULL AS TIMESTAMP_NTZ)", ty.DATETIME)
    return b.to(x, SqlType("datetime2", s=7) if x.type.is_string else ty.DATETIME)


def _part_sql(b, part, d):
    sql = d.sql
    first = b.session.date_first
    if part == "weekday":
        return f"((dayofweek({sql}) + 6 - {first % 7}) % 7 + 1)"
    if part == "week":
        jan = f"((dayofweek(make_date(year({sql}), 1, 1)) + 6 - {first % 7}) % 7)"
        return f"CAST(floor((dayofyear({sql}) + {jan} - 1) / 7) + 1 AS INT)"
    if part == "iso_week":
        return f"weekofyear({sql})"
    if part in ("millisecond", "microsecond", "nanosecond"):
        us = f"(CAST(extract(SECOND FROM {sql}) * 1000000 AS BIGINT) % 1000000)"
        return f"CAST({us} {'div 1000' if part == 'millisecond' else '* 1000' if part == 'nanosecond' else '* 1'} AS INT)"
    if part == "tzoffset":
        return "0"
    return f"{part}({sql})"


@scalar("DATEPART", 2, part=True)
def _datepart(b, word, x):
    part = part_of(word, "datepart")
    d = dated(b, x)
    if d.type.name == "date" and part in ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond"):
        raise TsqlError(9810, f"The datepart {part} is not supported by date function datepart for data type date.")
    return bound(_part_sql(b, part, d), ty.INT)


@scalar("DATENAME", 2, part=True)
def _datename(b, word, x):
    part = part_of(word, "datename")
    d = dated(b, x)
    form = {"month": "MMMM", "weekday": "EEEE"}.get(part)
    return bound(f"date_format({d.sql}, '{form}')" if form else f"CAST({_part_sql(b, part, d)} AS STRING)", ty.nvarchar(30))


for _name in ("YEAR", "MONTH", "DAY"):

    def _ymd(b, x, word=_name.lower()):
        return bound(f"{word}({dated(b, x).sql})", ty.INT)

    scalar(_name, 1)(_ymd)


@scalar("DATEADD", 3, part=True)
def _dateadd(b, word, n, x):
    part = part_of(word, "dateadd")
    d = dated(b, x)
    t = d.type if x.type.is_date else ty.DATETIME
    k = f"CAST({number(b, n).sql} AS INT)" if not n.type.is_integer else n.sql
    unit = {"dayofyear": "DAY", "weekday": "DAY", "nanosecond": "MICROSECOND"}.get(part, part.upper())
    if part in ("iso_week", "tzoffset"):
        raise TsqlError(9810, f"The datepart {part} is not supported by date function dateadd.")
    if t.name == "date" and unit in ("HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"):
        raise TsqlError(9810, f"The datepart {part} is not supported by date function dateadd for data type date.")
    if part == "nanosecond":
        k = f"({k} div 1000)"
    stamp = f"CAST({d.sql} AS TIMESTAMP_NTZ)" if d.type.name == "date" else d.sql
    sql = f"timestampadd({unit}, {k}, {stamp})"
    if t.name == "date":
        sql = f"CAST({sql} AS DATE)"
    elif t.name == "time":
        sql = f"date_format({sql}, 'HH:mm:ss{'.' + 'S' * min(t.s, 6) if t.s else ''}')"
    return bound(sql, t)


@scalar("DATEDIFF", 3, part=True)
def _datediff(b, word, x, y):
    part = part_of(word, "datediff")
    a, c = dated(b, x), dated(b, y)
    s, e = a.sql, c.sql
    if part == "year":
        sql = f"(year({e}) - year({s}))"
    elif part in ("quarter", "month"):
        index = (lambda d: f"(year({d}) * 4 + quarter({d}))") if part == "quarter" else (lambda d: f"(year({d}) * 12 + month({d}))")
        sql = f"({index(e)} - {index(s)})"
    elif part in ("day", "dayofyear", "weekday"):
        sql = f"datediff({e}, {s})"
    elif part in ("week", "iso_week"):
        # weeks begin on Sunday, whatever DATEFIRST says
        sunday = lambda d: f"floor((datediff({d}, DATE'1899-12-31')) / 7)"
        sql = f"CAST({sunday(e)} - {sunday(s)} AS INT)"
    else:
        unit = {"nanosecond": "MICROSECOND"}.get(part, part.upper())
        over = "Msg 535: The datediff function resulted in an overflow. The number of dateparts separating two date/time instances is too large."
        cut = lambda d: f"CAST(date_trunc('{unit}', CAST({d} AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)"
        wide = f"(timestampdiff({unit}, {cut(s)}, {cut(e)}){' * 1000' if part == 'nanosecond' else ''})"
        sql = f"CAST({wide} AS INT)" if part in ("hour", "minute") else f"CAST(CASE WHEN abs({wide}) > 2147483647 THEN raise_error('{over}') ELSE {wide} END AS INT)"
    return bound(sql, ty.INT)


@scalar("EOMONTH", 1, 2)
def _eomonth(b, x, n=None):
    d = dated(b, x).sql
    k = f"coalesce({number(b, n).sql}, 0)" if n is not None else "0"
    return bound(f"last_day(add_months(CAST({d} AS DATE), {k}))", ty.DATE)


@scalar("DATEFROMPARTS", 3)
def _datefromparts(b, y, m, d):
    return bound(f"make_date({', '.join(number(b, v).sql for v in (y, m, d))})", ty.DATE)


def _clock(name, sql, t):
    scalar(name, 0)(lambda b: bound(b.session.now_sql(sql), t))


_clock("GETDATE", "local", ty.DATETIME)
_clock("CURRENT_TIMESTAMP", "local", ty.DATETIME)
_clock("GETUTCDATE", "utc", ty.DATETIME)
_clock("SYSDATETIME", "local precise", SqlType("datetime2", s=7))
_clock("SYSUTCDATETIME", "utc precise", SqlType("datetime2", s=7))


# -- session and metadata ------------------------------------------------------------------------------------------------


@scalar("ISNUMERIC", 1)
def _isnumeric(b, x):
    if x.type.is_numeric:
        return bound(f"(CASE WHEN {x.sql} IS NULL THEN 0 ELSE 1 END)", ty.INT)
    s = text(b, x).sql
    return bound(f"(CASE WHEN trim({s}) RLIKE '^[+-]?[$]?([0-9,]+\\\\.?[0-9]*|\\\\.[0-9]+)([eE][+-]?[0-9]+)?$' OR trim({s}) IN ('+', '-', '.', '$', ',') THEN 1 ELSE 0 END)", ty.INT)


@scalar("ISDATE", 1)
def _isdate(b, x):
    if x.type.is_date:
        return bound(f"(CASE WHEN {x.sql} IS NULL THEN 0 ELSE 1 END)", ty.INT)
    s = text(b, x).sql
    return bound(f"(CASE WHEN coalesce(try_to_timestamp(trim({s})), try_to_timestamp(trim({s}), 'yyyyMMdd'), try_to_timestamp(trim({s}), 'M/d/yyyy')) IS NULL THEN 0 ELSE 1 END)", ty.INT)


@scalar("NEWID", 0)
def _newid(b):
    return bound("upper(uuid())", SqlType("uniqueidentifier"))


@scalar("SQL_VARIANT_PROPERTY", 2)
def _variant(b, x, what):
    t = x.type
    p, s = t.exact() if t.is_exact or t.name == "bit" else (0, t.s)
    known = {"BASETYPE": f"'{t.name}'", "PRECISION": str(p), "SCALE": str(s), "MAXLENGTH": str(t.n)}
    sql = known.get(str(what.literal).upper())
    return bound(sql or "CAST(NULL AS STRING)", ty.nvarchar(128) if sql is None or sql.startswith("'") else ty.INT)


def _session(name, low, high, fn, t=None):
    """A function that the session answers at once from literal arguments."""

    def call(b, *xs):
        from ..plans.binder import quote

        value = fn(b.session, *[x.literal for x in xs])
        if value is None:
            return bound(f"CAST(NULL AS {(t or ty.nvarchar(128)).spark()})", t or ty.nvarchar(128))
        return bound(str(value), t or ty.INT, literal=value) if isinstance(value, int) else bound(quote(value), t or ty.nvarchar(128), literal=value)

    scalar(name, low, high)(call)


def register_session_functions() -> None:
    for name in ("CURRENT_USER", "SESSION_USER", "SYSTEM_USER", "USER", "SUSER_SNAME", "ORIGINAL_LOGIN", "USER_NAME"):
        _session(name, 0, 1, lambda s, *a, name=name: "sa" if name in ("SYSTEM_USER", "SUSER_SNAME", "ORIGINAL_LOGIN") else "dbo")
    _session("HOST_NAME", 0, 0, lambda s: "localhost")
    _session("APP_NAME", 0, 0, lambda s: "tsqlspark")
    _session("DB_NAME", 0, 1, lambda s, *a: s.catalog.database_name(a[0] if a else None, s.database))
    _session("DB_ID", 0, 1, lambda s, *a: s.catalog.database_id(a[0] if a else s.database), ty.INT)
    _session("SCHEMA_NAME", 0, 1, lambda s, *a: {1: "dbo", 3: "INFORMATION_SCHEMA", 4: "sys"}.get(a[0] if a else 1))
    _session("SCHEMA_ID", 0, 1, lambda s, *a: {"dbo": 1, "information_schema": 3, "sys": 4}.get(str(a[0] if a else "dbo").lower()), ty.INT)
    _session("OBJECT_ID", 1, 2, lambda s, name, *a: s.object_id(name), ty.INT)
    _session("OBJECT_NAME", 1, 2, lambda s, n, *a: s.object_name(n))
    _session("SCOPE_IDENTITY", 0, 0, lambda s: s.identity, ty.decimal(38, 0))
    _session("IDENT_CURRENT", 1, 1, lambda s, name: s.ident_current(name), ty.decimal(38, 0))
    _session("XACT_STATE", 0, 0, lambda s: 1 if s.transactions else 0, SqlType("smallint"))
    _session("SERVERPROPERTY", 1, 1, lambda s, n: {"PRODUCTVERSION": "16.0.0.0", "EDITION": "Spark", "SERVERNAME": "localhost", "COLLATION": s.collation}.get(str(n).upper()))
    _session("DATABASEPROPERTYEX", 2, 2, lambda s, d, n: {"COLLATION": s.collation, "STATUS": "ONLINE", "RECOVERY": "SIMPLE"}.get(str(n).upper()))
    _session("COLLATIONPROPERTY", 2, 2, lambda s, c, n: {"CODEPAGE": 1252, "LCID": 1033, "COMPARISONSTYLE": 196609, "VERSION": 0}.get(str(n).upper()) if s.known_collation(c) else None, ty.INT)
    for name in ("HAS_DBACCESS", "IS_SRVROLEMEMBER", "IS_MEMBER", "HAS_PERMS_BY_NAME"):
        _session(name, 1, 3, lambda s, *a: 1, ty.INT)
    for name in ("FULLTEXTSERVICEPROPERTY", "FULLTEXTCATALOGPROPERTY", "FILEPROPERTY"):
        _session(name, 1, 2, lambda s, *a: 0, ty.INT)
    _session("CONNECTIONPROPERTY", 1, 1, lambda s, n: {"NET_TRANSPORT": "TCP", "PROTOCOL_TYPE": "TSQL", "AUTH_SCHEME": "SQL"}.get(str(n).upper()))
    _session("SESSIONPROPERTY", 1, 1, lambda s, n: int(s.options.get(str(n).upper(), "ON") == "ON"), ty.INT)
    _session("SUSER_SID", 0, 1, lambda s, *a: "0x01")
    _session("SID_BINARY", 1, 1, lambda s, *a: "0x01")


register_session_functions()
