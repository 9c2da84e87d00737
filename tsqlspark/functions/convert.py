"""CAST and CONVERT: rounding, truncation, padding and date styles as Spark SQL expressions."""

from __future__ import annotations

from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal

from .. import types as ty
from ..errors import TsqlError
from ..types import SqlType

#: Date part and clock part of the output styles, as Spark patterns.
DATE_FORMS = {
    1: "MM/dd/yy", 101: "MM/dd/yyyy", 2: "yy.MM.dd", 102: "yyyy.MM.dd", 3: "dd/MM/yy", 103: "dd/MM/yyyy", 4: "dd.MM.yy", 104: "dd.MM.yyyy", 5: "dd-MM-yy", 105: "dd-MM-yyyy",
    6: "dd MMM yy", 106: "dd MMM yyyy", 7: "MMM dd, yy", 107: "MMM dd, yyyy", 10: "MM-dd-yy", 110: "MM-dd-yyyy", 11: "yy/MM/dd", 111: "yyyy/MM/dd", 12: "yyMMdd", 112: "yyyyMMdd", 23: "yyyy-MM-dd",
    31: "yyyy-dd-MM", 32: "MM-dd-yyyy", 33: "MM-yyyy-dd", 34: "dd-MM-yyyy", 35: "dd-yyyy-MM",
}
CLOCK_FORMS = {8: "HH:mm:ss", 24: "HH:mm:ss", 108: "HH:mm:ss", 115: "HHmmss"}
BOTH_FORMS = {20: ("yyyy-MM-dd", " "), 120: ("yyyy-MM-dd", " "), 21: ("yyyy-MM-dd", " "), 25: ("yyyy-MM-dd", " "), 121: ("yyyy-MM-dd", " "), 126: ("yyyy-MM-dd", "T"), 127: ("yyyy-MM-dd", "T"), 13: ("dd MMM yyyy", " "), 113: ("dd MMM yyyy", " "), 26: ("yyyy-dd-MM", " "), 27: ("MM-dd-yyyy", " "), 28: ("MM-yyyy-dd", " "), 29: ("dd-MM-yyyy", " "), 30: ("dd-yyyy-MM", " ")}
RANGES = {"tinyint": (0, 255), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def convert(binder, x, t: SqlType, style: int | None, try_: bool, implicit: bool = False):
    """``x`` as type ``t``."""
    from ..plans.binder import Bound

    f = x.type
    if x.is_null or f.name == "null":
        return Bound(f"CAST(NULL AS {t.spark()})", t)
    cast = "TRY_CAST" if try_ else "CAST"
    plain = lambda sql: f"{cast}({sql} AS {t.spark()})"
    out = Bound(x.sql, t, collation=x.collation)
    if t.is_string:
        text = to_text(x, style)
        literal = x.literal if f.is_string and isinstance(x.literal, str) else None
        if t.n != ty.MAX and not (f.is_string and f.n != ty.MAX and f.n <= t.n):
            text = text if literal is not None and len(literal) <= t.n else cut(text, f, t)
        if t.name in ("char", "nchar") and not implicit:
            text = f"rpad({text}, {t.n}, ' ')"
        return replace(out, sql=text, literal=literal if literal is None or t.n == ty.MAX or len(literal) <= t.n else None)
    if f.is_string and f.name != t.name:
        return replace(out, sql=from_text(x, t, style, try_, cast))
    if t.name == "bit":
        if f.name == "bit":
            return out
        if not f.is_numeric:
            raise TsqlError(529, f"Explicit conversion from data type {f.name} to bit is not allowed.")
        return replace(out, sql=f"({x.sql} <> 0)", literal=None)
    if f.name == "bit" and t.is_numeric:
        return replace(out, sql=plain(f"CAST({x.sql} AS INT)"))
    if t.is_integer:
        if f.is_date and f.name not in ("datetime", "smalldatetime"):
            raise TsqlError(529, f"Explicit conversion from data type {f.name} to {t.name} is not allowed.")
        if f.is_date:
            return replace(out, sql=plain(f"round(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1900-01-01 00:00:00', {x.sql}) / 86400000000D)"))
        if f.is_binary:
            return replace(out, sql=f"CAST(conv(hex({x.sql}), 16, -10) AS {t.spark()})")
        if isinstance(x.literal, int) and RANGES[t.name][0] <= x.literal <= RANGES[t.name][1]:
            return replace(out, sql=str(x.literal) if t.name == "int" else f"CAST({x.literal} AS {t.spark()})", literal=x.literal, digits=x.digits)
        sql = f"round({x.sql})" if f.name in ty.MONEY else x.sql
        if t.name == "tinyint" and f.name != "tinyint":
            inner = f"CAST({sql} AS INT)"
            bad = "NULL" if try_ else "raise_error('Msg 8115: Arithmetic overflow error converting expression to data type tinyint.')"
            return replace(out, sql=f"CAST(CASE WHEN {inner} NOT BETWEEN 0 AND 255 THEN {bad} ELSE {inner} END AS SMALLINT)")
        if f.is_float and f.name != t.name:
            sql = f"CAST({sql} AS DECIMAL(38,0))" if False else f"(CASE WHEN {sql} < 0 THEN ceil({sql}) ELSE floor({sql}) END)"
        return replace(out, sql=plain(sql))
    if t.name == "decimal" or t.name in ty.MONEY:
        if f.is_date:
            raise TsqlError(529 if f.name not in ("datetime", "smalldatetime") else 50000, "This conversion is not allowed.")
        p, s = t.exact()
        if isinstance(x.literal, (int, Decimal)):
            value = Decimal(x.literal).quantize(Decimal(1).scaleb(-s), ROUND_HALF_UP)
            if len(value.as_tuple().digits) <= p:
                return replace(out, sql=f"CAST('{value:f}' AS DECIMAL({p},{s}))", literal=value)
        return replace(out, sql=plain(x.sql))
    if t.is_float:
        if f.is_date:
            return replace(out, sql=f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1900-01-01 00:00:00', {x.sql}) / 86400000000D)")
        return replace(out, sql=plain(x.sql))
    if t.is_date:
        return replace(out, sql=to_date(x, t, plain))
    if t.is_binary:
        if f.is_binary:
            sql = x.sql if t.n == ty.MAX or f.n != ty.MAX and f.n <= t.n else f"substring({x.sql}, 1, {t.n})"
            return replace(out, sql=f"rpad({sql}, {t.n}, X'00')" if t.name == "binary" else sql)
        if f.is_integer:
            width = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[f.name]
            digits = f"right(lpad(hex(CAST({x.sql} AS BIGINT)), 16, '0'), {2 * width})"
            size = 2 * (t.n if t.n != ty.MAX else width)
            return replace(out, sql=f"unhex({f'lpad({digits}, {size}, {chr(39)}0{chr(39)})' if t.name == 'binary' else digits if t.n == ty.MAX or t.n >= width else f'right({digits}, {size})'})")
    if t.name == f.name:
        return out
    if t.name == "uniqueidentifier" and f.is_binary:
        h = f"hex({x.sql})"
        order = [7, 5, 3, 1, 0, 11, 9, 0, 15, 13, 0, 17, 19, 0, 21, 23, 25, 27, 29, 31]
        return replace(out, sql="concat(" + ", ".join("'-'" if k == 0 else f"substring({h}, {k}, 2)" for k in order) + ")")
    raise TsqlError(529, f"Explicit conversion from data type {f.name} to {t.name} is not allowed.")


def cut(text: str, f: SqlType, t: SqlType) -> str:
    """Text that is longer than its target: strings are cut, integers become a star, other numbers overflow."""
    if f.is_integer:
        return f"(CASE WHEN length({text}) > {t.n} THEN '*' ELSE {text} END)"
    if f.name == "decimal" or f.name in ty.MONEY:
        return f"(CASE WHEN length({text}) > {t.n} THEN raise_error('Msg 8115: Arithmetic overflow error converting numeric to data type varchar.') ELSE {text} END)"
    return f"left({text}, {t.n})"


def to_text(x, style: int | None) -> str:
    f, sql = x.type, x.sql
    if f.is_string or f.name == "uniqueidentifier":
        return sql
    if f.name == "bit":
        return f"CAST(CAST({sql} AS INT) AS STRING)"
    if f.name in ty.MONEY:
        if style == 1:
            return f"format_number({sql}, 2)"
        return f"CAST({sql} AS STRING)" if style in (2, 126) else f"CAST(CAST({sql} AS DECIMAL(19,2)) AS STRING)"
    if f.is_float:
        # six significant digits, without trailing zeros; the exponent has three
        whole = f"CAST({sql} AS DOUBLE)"
        scale = f"greatest(0, 5 - CAST(floor(log10(abs({whole}))) AS INT))"
        short = f"regexp_replace(format_string(concat('%.', {scale}, 'f'), {whole}), '(\\\\.[0-9]*?)0+$|\\\\.$', '$1')"
        return f"(CASE WHEN {sql} = 0 THEN '0' WHEN abs({whole}) >= 1000000 OR abs({whole}) < 0.0001D THEN regexp_replace(regexp_replace(format_string('%.5e', {whole}), '\\\\.?0+e', 'e'), 'e([+-])([0-9][0-9])$', 'e$10$2') ELSE regexp_replace({short}, '\\\\.$', '') END)"
    if f.is_binary:
        return f"concat('0x', hex({sql}))" if style == 1 else f"hex({sql})" if style == 2 else f"decode({sql}, 'UTF-8')"
    if f.name == "time":
        return sql
    if f.is_date:
        return date_text(x, style)
    return f"CAST({sql} AS STRING)"


def date_text(x, style: int | None) -> str:
    f, sql = x.type, x.sql
    legacy = f.name in ("datetime", "smalldatetime")
    only_date = f.name == "date"
    if style is None:
        style = 0 if legacy else 121
    ms = "SSS" if f.name in ("datetime", "datetime2", "datetimeoffset") and (legacy or f.s == 3) else "S" * min(6, f.s) if f.name in ("datetime2", "datetimeoffset") else "SSS"
    clock = lambda mark: "HH:mm:ss" + (f"{mark}{ms}" if ms and f.name != "smalldatetime" else "")
    if style in DATE_FORMS:
        return f"date_format({sql}, \"{DATE_FORMS[style]}\")"
    if style in CLOCK_FORMS:
        return f"date_format({sql}, '{CLOCK_FORMS[style]}')"
    if style in (14, 114):
        return f"date_format({sql}, '{clock(':' if legacy else '.')}')"
    if style in BOTH_FORMS:
        day, gap = BOTH_FORMS[style]
        if only_date:
            return f"date_format({sql}, '{day}')"
        if style in (20, 120):
            return f"date_format({sql}, '{day} HH:mm:ss')"
        mark = ":" if style in (13, 113) and legacy else "."
        time = clock(mark)
        if f.name == "smalldatetime":
            time = "HH:mm:ss"
        return f"concat(date_format({sql}, '{day}'), '{gap}', date_format({sql}, '{time}'))" + ("" if style != 127 else "")
    if style in (0, 100, 9, 109, 22):
        if style == 22:
            return f"concat(date_format({sql}, 'MM/dd/yy'), ' ', lpad(date_format({sql}, 'h'), 2, ' '), date_format({sql}, ':mm:ss a'))"
        day = f"concat(date_format({sql}, 'MMM'), ' ', lpad(day({sql}), 2, ' '), date_format({sql}, ' yyyy'))"
        if only_date:
            return day
        rest = ":mma" if style in (0, 100) else f":mm:ss{':' if legacy else '.'}{ms or 'SSS'}a"
        return f"concat({day}, ' ', lpad(date_format({sql}, 'h'), 2, ' '), date_format({sql}, '{rest}'))"
    raise TsqlError(281, f"{style} is not a valid style number when converting from {f.name} to a character string.")


def from_text(x, t: SqlType, style: int | None, try_: bool, cast: str) -> str:
    sql = x.sql
    if t.is_integer or t.name == "bit":
        blank = f"trim({sql})"
        if t.name == "bit":
            known = f"CASE lower({blank}) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE ELSE {cast}({blank} AS INT) <> 0 END"
            return f"({known})"
        return f"(CASE WHEN {blank} = '' THEN CAST(0 AS {t.spark()}) ELSE {cast}({blank} AS {t.spark()}) END)"
    if t.name in ty.MONEY:
        return f"{cast}(regexp_replace(trim({sql}), '[$,]', '') AS {t.spark()})"
    if t.name == "decimal" or t.is_float:
        return f"{cast}(trim({sql}) AS {t.spark()})"
    if t.name == "time":
        return f"date_format({cast}(concat('1970-01-01 ', trim({sql})) AS TIMESTAMP_NTZ), 'HH:mm:ss{'.' + 'S' * min(t.s, 6) if t.s else ''}')"
    if t.is_date:
        form = DATE_FORMS.get(style) if style is not None else None
        if form and style != 23:
            text = f"{'try_' if try_ else ''}to_timestamp(trim({sql}), '{form}')"
            return to_date(replace(x, sql=f"CAST({text} AS TIMESTAMP_NTZ)", type=ty.DATETIME2), t, lambda s: f"CAST({s} AS {t.spark()})")
        blank = f"trim({sql})"
        text = f"(CASE WHEN {blank} = '' THEN '1900-01-01' WHEN {blank} RLIKE '^[0-9]{{8}}$' THEN concat(substring({blank}, 1, 4), '-', substring({blank}, 5, 2), '-', substring({blank}, 7, 2)) WHEN {blank} RLIKE '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$' THEN date_format(to_date({blank}, 'M/d/yyyy'), 'yyyy-MM-dd') ELSE {blank} END)"
        if isinstance(x.literal, str) and x.literal[:4].isdigit() and "-" in x.literal:
            text = sql
        return to_date(replace(x, sql=f"{cast}({text} AS TIMESTAMP_NTZ)", type=ty.DATETIME2), t, lambda s: f"CAST({s} AS {t.spark()})")
    if t.is_binary:
        if style in (1, 2):
            return f"unhex({f'substring({sql}, 3)' if style == 1 else sql})"
        return f"CAST({sql} AS BINARY)" if t.n == ty.MAX else f"substring(CAST({sql} AS BINARY), 1, {t.n})"
    if t.name == "uniqueidentifier":
        return f"upper(regexp_extract({sql}, '^\\\\{{?([0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}})', 1))"
    raise TsqlError(529, f"Explicit conversion from data type {x.type.name} to {t.name} is not allowed.")


def to_date(x, t: SqlType, plain) -> str:
    f, sql = x.type, x.sql
    if f.is_numeric:
        if t.name not in ("datetime", "smalldatetime"):
            raise TsqlError(529, f"Explicit conversion from data type {f.name} to {t.name} is not allowed.")
        return f"timestampadd(MICROSECOND, CAST(round(CAST({sql} AS DOUBLE) * 86400000000D) AS BIGINT), TIMESTAMP_NTZ'1900-01-01 00:00:00')"
    if f.name == "time":
        sql = f"CAST(concat('1900-01-01 ', {sql}) AS TIMESTAMP_NTZ)"
    if t.name == "time":
        return f"date_format({sql}, 'HH:mm:ss{'.' + 'S' * min(t.s, 6) if t.s else ''}')"
    if t.name == "date":
        return sql if f.name == "date" else f"CAST({sql} AS DATE)"
    stamp = f"CAST({sql} AS TIMESTAMP_NTZ)" if f.name == "date" else sql
    if t.name == "smalldatetime" and f.name not in ("date", "smalldatetime"):
        return f"date_trunc('MINUTE', timestampadd(SECOND, 30, {stamp}))"
    if t.name == "datetime" and f.name in ("datetime2", "datetimeoffset", "time"):
        # to the nearest 1/300 of a second, shown in milliseconds
        us = f"CAST(extract(SECOND FROM {stamp}) * 1000000 AS BIGINT) % 1000000"
        ms = f"CAST(round(round(({us}) * 300 / 1000000D) * 1000 / 300) AS INT)"
        return f"timestampadd(MILLISECOND, {ms}, CAST(date_trunc('SECOND', {stamp}) AS TIMESTAMP_NTZ))"
    if t.name in ("datetime2", "datetimeoffset") and t.s < 6 and (f.name in ("datetime2", "datetimeoffset") and f.s > t.s):
        unit = 10 ** (6 - t.s)
        us = f"CAST(extract(SECOND FROM {stamp}) * 1000000 AS BIGINT) % 1000000"
        return f"timestampadd(MICROSECOND, CAST(round(({us}) / {unit}D) * {unit} AS BIGINT), CAST(date_trunc('SECOND', {stamp}) AS TIMESTAMP_NTZ))"
    return stamp
