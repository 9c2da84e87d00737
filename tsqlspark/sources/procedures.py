"""Catalogue procedures: the result sets that drivers and tools ask for by name."""

from __future__ import annotations

from ..errors import TsqlError
from ..types import MAX, SqlType
from .catalog import TYPE_IDS, Catalog, Table, _precision, _size

#: The columns of the result sets.
COLUMNS = {
    "sp_fkeys": "PKTABLE_QUALIFIER string, PKTABLE_OWNER string, PKTABLE_NAME string, PKCOLUMN_NAME string, FKTABLE_QUALIFIER string, FKTABLE_OWNER string, FKTABLE_NAME string, FKCOLUMN_NAME string, KEY_SEQ smallint, UPDATE_RULE smallint, DELETE_RULE smallint, FK_NAME string, PK_NAME string, DEFERRABILITY smallint",
    "sp_statistics": "TABLE_QUALIFIER string, TABLE_OWNER string, TABLE_NAME string, NON_UNIQUE smallint, INDEX_QUALIFIER string, INDEX_NAME string, TYPE smallint, SEQ_IN_INDEX smallint, COLUMN_NAME string, COLLATION string, CARDINALITY int, PAGES int, FILTER_CONDITION string",
    "sp_special_columns": "SCOPE smallint, COLUMN_NAME string, DATA_TYPE smallint, TYPE_NAME string, PRECISION int, LENGTH int, SCALE smallint, PSEUDO_COLUMN smallint",
    "sp_datatype_info": "TYPE_NAME string, DATA_TYPE smallint, PRECISION int, LITERAL_PREFIX string, LITERAL_SUFFIX string, CREATE_PARAMS string, NULLABLE smallint, CASE_SENSITIVE smallint, SEARCHABLE smallint, UNSIGNED_ATTRIBUTE smallint, MONEY smallint, AUTO_INCREMENT smallint, LOCAL_TYPE_NAME string",
    "sp_stored_procedures": "PROCEDURE_QUALIFIER string, PROCEDURE_OWNER string, PROCEDURE_NAME string, NUM_INPUT_PARAMS int, NUM_OUTPUT_PARAMS int, NUM_RESULT_SETS int, REMARKS string, PROCEDURE_TYPE smallint",
    "sp_sproc_columns": "PROCEDURE_QUALIFIER string, PROCEDURE_OWNER string, PROCEDURE_NAME string, COLUMN_NAME string, COLUMN_TYPE smallint, DATA_TYPE smallint, TYPE_NAME string, PRECISION int, LENGTH int, SCALE smallint, RADIX smallint, NULLABLE smallint, REMARKS string",
    "sp_spaceused": "name string, rows string, reserved string, data string, index_size string, unused string",
}
#: The ODBC numbers of the types.
ODBC = {"tinyint": -6, "smallint": 5, "int": 4, "bigint": -5, "bit": -7, "decimal": 3, "money": 3, "smallmoney": 3, "float": 6, "real": 7, "char": 1, "varchar": 12, "nchar": -8, "nvarchar": -9, "binary": -2, "varbinary": -3, "date": -9, "time": -9, "datetime": 11, "smalldatetime": 11, "datetime2": -9, "datetimeoffset": -9, "uniqueidentifier": -11}


def _length(t: SqlType) -> int:
    return 0 if (t.is_string or t.is_binary) and t.n == MAX else _size(t)


def result(catalog: Catalog, database: str, name: str, args: dict) -> tuple[str, list[tuple]] | None:
    """Schema and rows of a procedure's result set; ``args`` by lower-case name.  None for a procedure that isn't here."""
    name = name.removesuffix("_100")
    if name not in COLUMNS:
        return None
    tables = sorted(catalog.databases[database].values(), key=lambda t: (t.schema, t.name))
    by_key = {t.key: t for t in tables}

    def wanted(t: Table, word: str, owner: str) -> bool:
        return all(args.get(a) is None or str(args[a]).lower() == v.lower() for a, v in ((word, t.name), (owner, t.schema)))

    rows: list[tuple] = []
    if name == "sp_fkeys":
        if args.get("@pktable_name") is None and args.get("@fktable_name") is None:
            raise TsqlError(15252, "The primary or foreign key table name must be given.")
        for t in tables:
            for f in t.foreign:
                parent = by_key[f.parent]
                key = next((k.name for k in parent.keys if set(k.columns) == set(f.parent_columns)), None)
                if wanted(parent, "@pktable_name", "@pktable_owner") and wanted(t, "@fktable_name", "@fktable_owner"):
                    rows += [(database, parent.schema, parent.name, b, database, t.schema, t.name, a, i + 1, 1, 1, f.name, key, 7) for i, (a, b) in enumerate(zip(f.columns, f.parent_columns, strict=True))]
    elif name == "sp_statistics":
        for t in tables:
            if wanted(t, "@table_name", "@table_owner"):
                rows.append((database, t.schema, t.name, None, None, None, 0, None, None, None, None, None, None))
                for k in t.keys:
                    if (args.get("@index_name") or k.name).lower() in (k.name.lower(), "%") and (k.unique or str(args.get("@is_unique") or "N").upper() != "Y"):
                        rows += [(database, t.schema, t.name, int(not k.unique), t.name, k.name, 1 if k.kind == "primary" else 3, i + 1, c, "A", None, None, None) for i, c in enumerate(k.columns)]
    elif name == "sp_special_columns":
        for t in tables:
            key = next((k for kind in ("primary", "unique", "index") for k in t.keys if k.kind == kind and k.unique), None)
            if wanted(t, "@table_name", "@table_owner") and key is not None and str(args.get("@col_type") or "R").upper() == "R":
                rows += [(1, c.name, ODBC[c.type.name], c.type.name, _precision(c.type) or _length(c.type), _length(c.type), c.type.exact()[1] if c.type.is_exact else None, 1) for c in (t.column(x) for x in key.columns)]
    elif name == "sp_datatype_info":
        kind = args.get("@data_type")
        for n, (_, size) in sorted(TYPE_IDS.items(), key=lambda x: (ODBC[x[0]], x[0])):
            if kind in (None, 0, ODBC[n]):
                t = SqlType(n)
                mark = "'" if t.is_string or t.is_date or n == "uniqueidentifier" else "0x" if t.is_binary else None
                create = "length" if n in ("char", "nchar", "binary") else "max length" if n in ("varchar", "nvarchar", "varbinary") else "precision,scale" if n == "decimal" else None
                rows.append((n, ODBC[n], 38 if n == "decimal" else _precision(t) or size or (4000 if n[0] == "n" else 8000), mark, "'" if mark == "'" else None, create, 1, int(t.is_string), 3 if t.is_string else 2, int(n == "tinyint") if t.is_numeric else None, int("money" in n), 0 if t.is_exact else None, n))
    elif name == "sp_spaceused":
        found = [t for t in tables if args.get("@objname") is None or str(args["@objname"]).split(".")[-1].strip("[]").lower() == t.name.lower()]
        if not found and args.get("@objname") is not None:
            raise TsqlError(15009, f"The object '{args['@objname']}' does not exist in database '{database}' or is invalid for this operation.")
        rows = [(t.name, str(t.df.count()), "0 KB", "0 KB", "0 KB", "0 KB") for t in found]
    return COLUMNS[name], rows


#: The parameters of the procedures in order.
PARAMETERS = {
    "sp_fkeys": "@pktable_name @pktable_owner @pktable_qualifier @fktable_name @fktable_owner @fktable_qualifier",
    "sp_statistics": "@table_name @table_owner @table_qualifier @index_name @is_unique @accuracy",
    "sp_special_columns": "@table_name @table_owner @table_qualifier @col_type @scope @nullable @odbcver",
    "sp_datatype_info": "@data_type @odbcver",
    "sp_stored_procedures": "@sp_name @sp_owner @sp_qualifier @fusepattern",
    "sp_sproc_columns": "@procedure_name @procedure_owner @procedure_qualifier @column_name @odbcver",
    "sp_spaceused": "@objname @updateusage @mode @oneresultset",
}
