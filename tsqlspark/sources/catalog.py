"""Databases, tables, constraints and indexes, and the catalogue views over them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame

from .. import types as ty
from ..errors import TsqlError
from ..types import SqlType

CREATED = datetime(2000, 1, 1)


@dataclass(frozen=True)
class Column:
    name: str
    type: SqlType
    nullable: bool = True
    identity: tuple[int, int] | None = None
    default: object = None  # syntax tree
    default_name: str | None = None
    computed: object = None


@dataclass(frozen=True)
class Key:
    name: str
    kind: str  # primary, unique, index
    columns: tuple[str, ...]
    unique: bool = True
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Foreign:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    name: str
    test: object
    text: str


@dataclass(frozen=True)
class Table:
    """One version of a table; writes replace it by another."""

    schema: str
    name: str
    object_id: int
    columns: tuple[Column, ...]
    df: DataFrame
    view: str
    keys: tuple[Key, ...] = ()
    foreign: tuple[Foreign, ...] = ()
    checks: tuple[Check, ...] = ()
    next_identity: int | None = None
    last_identity: int | None = None
    #: The frames that make up ``df``, each written with its rows' numbers ``__rid``; none for a frame of the user's.
    pieces: tuple[DataFrame, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}".lower()

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise TsqlError(207, f"Invalid column name '{name}'.")


@dataclass
class Catalog:
    databases: dict[str, dict[str, Table]] = field(default_factory=lambda: {"master": {}})
    serial: int = 100
    schemas: dict[str, list[str]] = field(default_factory=dict)

    def next_id(self) -> int:
        self.serial += 1
        return 1_000_000 + self.serial * 16

    def database_name(self, which, current: str) -> str | None:
        if which is None:
            return current
        names = list(self.databases)
        return names[int(which) - 1] if isinstance(which, int) and 0 < which <= len(names) else None

    def database_id(self, name: str) -> int | None:
        for i, n in enumerate(self.databases):
            if n.lower() == str(name).lower():
                return i + 1
        return None

    def snapshot(self) -> dict[str, dict[str, Table]]:
        return {n: dict(t) for n, t in self.databases.items()}


OBJECT = ["name", "object_id", "principal_id", "schema_id", "parent_object_id", "type", "type_desc", "create_date", "modify_date", "is_ms_shipped", "is_published", "is_schema_published"]
_INTS = {"object_id", "principal_id", "schema_id", "parent_object_id", "column_id", "database_id", "index_id", "system_type_id", "user_type_id", "max_length", "precision", "scale", "type_id", "ORDINAL_POSITION", "CHARACTER_MAXIMUM_LENGTH", "CHARACTER_OCTET_LENGTH", "NUMERIC_PRECISION", "NUMERIC_PRECISION_RADIX", "NUMERIC_SCALE", "DATETIME_PRECISION", "index_column_id", "key_ordinal", "referenced_object_id", "key_index_id", "constraint_object_id", "constraint_column_id", "parent_column_id", "referenced_column_id", "unique_index_id", "seed_value", "increment_value", "last_value", "partition_ordinal", "rows", "partition_number", "session_id", "compatibility_level", "role_principal_id", "member_principal_id", "owning_principal_id", "grantee_principal_id", "file_id", "data_space_id", "state", "size", "max_size", "growth", "request_id", "blocking_session_id", "class", "major_id", "allocation_unit_id", "container_id", "total_pages", "used_pages", "cpu_count", "physical_memory_kb", "default_object_id", "rule_object_id"}
#: Type ids and sizes in bytes.
TYPE_IDS = {"tinyint": (48, 1), "smallint": (52, 2), "int": (56, 4), "bigint": (127, 8), "bit": (104, 1), "decimal": (106, 17), "money": (60, 8), "smallmoney": (122, 4), "float": (62, 8), "real": (59, 4), "char": (175, 0), "varchar": (167, 0), "nchar": (239, 0), "nvarchar": (231, 0), "binary": (173, 0), "varbinary": (165, 0), "date": (40, 3), "time": (41, 5), "datetime": (61, 8), "smalldatetime": (58, 4), "datetime2": (42, 8), "datetimeoffset": (43, 10), "uniqueidentifier": (36, 16)}


def _size(t: SqlType) -> int:
    if t.is_string or t.is_binary:
        return -1 if t.n == ty.MAX else t.n * (2 if t.name[0] == "n" else 1)
    return TYPE_IDS[t.name][1]


def _precision(t: SqlType) -> int:
    return t.exact()[0] if t.is_exact or t.name == "bit" else {"float": 53, "real": 24}.get(t.name, 0)


#: Further columns of the views, which are the same for every row.
CONSTANT = {
    "sys.databases": {"source_database_id": None, "owner_sid": "0x01", "user_access": 0, "user_access_desc": "MULTI_USER", "is_read_only": 0, "is_auto_close_on": 0, "is_auto_shrink_on": 0, "state": 0, "is_in_standby": 0, "snapshot_isolation_state": 0, "snapshot_isolation_state_desc": "OFF", "is_read_committed_snapshot_on": 0, "recovery_model": 3, "recovery_model_desc": "SIMPLE", "page_verify_option": 2, "page_verify_option_desc": "CHECKSUM", "is_auto_create_stats_on": 1, "is_ansi_nulls_on": 1, "is_quoted_identifier_on": 1, "is_broker_enabled": 0, "is_encrypted": 0, "containment": 0, "containment_desc": "NONE"},
    "sys.tables": {"lob_data_space_id": 0, "filestream_data_space_id": None, "max_column_id_used": 0, "lock_on_bulk_load": 0, "uses_ansi_nulls": 1, "is_replicated": 0, "has_replication_filter": 0, "is_merge_published": 0, "is_sync_tran_subscribed": 0, "has_unchecked_assembly_data": 0, "text_in_row_limit": 0, "large_value_types_out_of_row": 0, "is_tracked_by_cdc": 0, "lock_escalation": 0, "lock_escalation_desc": "TABLE", "is_filetable": 0, "is_memory_optimized": 0, "durability": 0, "durability_desc": "SCHEMA_AND_DATA", "temporal_type": 0, "temporal_type_desc": "NON_TEMPORAL_TABLE", "history_table_id": None, "is_remote_data_archive_enabled": 0, "is_external": 0, "is_node": 0, "is_edge": 0},
    "sys.columns": {"is_ansi_padded": 1, "is_rowguidcol": 0, "is_filestream": 0, "is_replicated": 0, "is_non_sql_subscribed": 0, "is_merge_published": 0, "is_dts_replicated": 0, "is_xml_document": 0, "xml_collection_id": 0, "default_object_id": 0, "rule_object_id": 0, "is_sparse": 0, "is_column_set": 0, "generated_always_type": 0, "generated_always_type_desc": "NOT_APPLICABLE", "is_hidden": 0, "is_masked": 0},
    "sys.identity_columns": {"is_not_for_replication": 0, "is_identity": 1},
    "sys.indexes": {"data_space_id": 1, "ignore_dup_key": 0, "fill_factor": 0, "is_padded": 0, "is_disabled": 0, "is_hypothetical": 0, "is_ignored_in_optimization": 0, "allow_row_locks": 1, "allow_page_locks": 1, "has_filter": 0, "filter_definition": None, "auto_created": 0},
    "sys.index_columns": {"column_store_order_ordinal": 0},
    "sys.foreign_keys": {"key_index_id": 1, "is_disabled": 0, "is_not_for_replication": 0, "is_not_trusted": 0, "delete_referential_action": 0, "update_referential_action": 0, "is_system_named": 0},
    "sys.check_constraints": {"is_disabled": 0, "is_not_for_replication": 0, "is_not_trusted": 0, "parent_column_id": 0, "uses_database_collation": 1, "is_system_named": 0},
    "sys.default_constraints": {"is_system_named": 0},
    "sys.partitions": {"hobt_id": 0, "rows": 0, "filestream_filegroup_id": 0, "data_compression": 0, "data_compression_desc": "NONE"},
    "sys.dm_exec_sessions": {"login_time": None, "host_process_id": None, "client_version": 7, "client_interface_name": "TDS", "language": "us_english", "date_format": "mdy", "date_first": 7, "quoted_identifier": 1, "ansi_nulls": 1, "transaction_isolation_level": 2, "lock_timeout": -1, "database_id": 1, "open_transaction_count": 0, "is_user_process": 1},
    "information_schema.columns": {"CHARACTER_SET_CATALOG": None, "CHARACTER_SET_SCHEMA": None, "COLLATION_CATALOG": None, "COLLATION_SCHEMA": None, "DOMAIN_CATALOG": None, "DOMAIN_SCHEMA": None, "DOMAIN_NAME": None},
    "information_schema.schemata": {"DEFAULT_CHARACTER_SET_CATALOG": None, "DEFAULT_CHARACTER_SET_SCHEMA": None, "DEFAULT_CHARACTER_SET_NAME": "iso_1"},
    "information_schema.views": {"VIEW_DEFINITION": None, "CHECK_OPTION": "NONE", "IS_UPDATABLE": "NO"},
}


def view_rows(catalog: Catalog, database: str, name: str, collation: str) -> tuple[list[str], list[tuple]] | None:
    """Columns and rows of a catalogue view, by its lower-case qualified name; None for an unknown one."""
    found = _view_rows(catalog, database, name, collation)
    more = CONSTANT.get({"sys.all_columns": "sys.columns"}.get(name, name))
    if found is None or more is None:
        return found
    names, rows = found
    more = {c: v for c, v in more.items() if c not in names}
    return [*names, *more], [(*r, *more.values()) for r in rows]


def _view_rows(catalog: Catalog, database: str, name: str, collation: str) -> tuple[list[str], list[tuple]] | None:
    tables = list(catalog.databases[database].values())

    def obj(name_, id_, parent, kind, desc):
        return (name_, id_, None, 1, parent, kind, desc, CREATED, CREATED, 0, 0, 0)

    def constraint_id(t: Table, n: int) -> int:
        return t.object_id + 1 + n

    constraints = []  # (table, kind, constraint, id)
    for t in tables:
        n = 0
        for kind, group in (("PK", [k for k in t.keys if k.kind == "primary"]), ("UQ", [k for k in t.keys if k.kind == "unique"]), ("F", t.foreign), ("C", t.checks), ("D", [c for c in t.columns if c.default is not None])):
            for c in group:
                constraints.append((t, kind, c, constraint_id(t, n)))
                n += 1
    desc = {"PK": "PRIMARY_KEY_CONSTRAINT", "UQ": "UNIQUE_CONSTRAINT", "F": "FOREIGN_KEY_CONSTRAINT", "C": "CHECK_CONSTRAINT", "D": "DEFAULT_CONSTRAINT"}
    cname = lambda kind, c: c.default_name if kind == "D" else c.name
    if name == "sys.databases":
        return ["name", "database_id", "create_date", "compatibility_level", "collation_name", "state_desc"], [(n, i + 1, CREATED, 160, collation, "ONLINE") for i, n in enumerate(catalog.databases)]
    if name == "sys.schemas":
        return ["name", "schema_id", "principal_id"], [("dbo", 1, 1), ("INFORMATION_SCHEMA", 3, 3), ("sys", 4, 4), *[(n, i + 5, 1) for i, n in enumerate(catalog.schemas.get(database, []))]]
    if name == "sys.types":
        rows = [(n, i, i, 4, None, s or 8000, 0, 0, collation if "char" in n else None, 1, 0, 0, 0, 0, 0) for n, (i, s) in TYPE_IDS.items()]
        return ["name", "system_type_id", "user_type_id", "schema_id", "principal_id", "max_length", "precision", "scale", "collation_name", "is_nullable", "is_user_defined", "is_assembly_type", "default_object_id", "rule_object_id", "is_table_type"], rows
    if name in ("sys.objects", "sys.all_objects"):
        return OBJECT, [obj(t.name, t.object_id, 0, "U", "USER_TABLE") for t in tables] + [obj(cname(k, c), i, t.object_id, k, desc[k]) for t, k, c, i in constraints]
    if name == "sys.tables":
        return OBJECT, [obj(t.name, t.object_id, 0, "U", "USER_TABLE") for t in tables]
    if name in ("sys.columns", "sys.all_columns"):
        rows = [(t.object_id, c.name, i + 1, *(TYPE_IDS[c.type.name][0],) * 2, _size(c.type), _precision(c.type), c.type.exact()[1] if c.type.is_exact else c.type.s, collation if c.type.is_string else None, int(c.nullable), int(c.identity is not None), int(c.computed is not None)) for t in tables for i, c in enumerate(t.columns)]
        return ["object_id", "name", "column_id", "system_type_id", "user_type_id", "max_length", "precision", "scale", "collation_name", "is_nullable", "is_identity", "is_computed"], rows
    if name == "sys.identity_columns":
        return ["object_id", "name", "column_id", "seed_value", "increment_value", "last_value"], [(t.object_id, c.name, i + 1, *c.identity, t.last_identity) for t in tables for i, c in enumerate(t.columns) if c.identity]
    if name == "sys.indexes":
        rows = [(t.object_id, k.name, i + 1, 1 if k.kind == "primary" else 2, "CLUSTERED" if k.kind == "primary" else "NONCLUSTERED", int(k.unique), int(k.kind == "primary"), int(k.kind == "unique")) for t in tables for i, k in enumerate(t.keys)]
        return ["object_id", "name", "index_id", "type", "type_desc", "is_unique", "is_primary_key", "is_unique_constraint"], rows
    if name == "sys.index_columns":
        place = lambda t, c: [x.name.lower() for x in t.columns].index(c.lower()) + 1
        return ["object_id", "index_id", "index_column_id", "column_id", "key_ordinal", "partition_ordinal", "is_descending_key", "is_included_column"], [(t.object_id, i + 1, j + 1, place(t, c), j + 1, 0, 0, 0) for t in tables for i, k in enumerate(t.keys) for j, c in enumerate(k.columns)]
    if name == "sys.key_constraints":
        return [*OBJECT, "unique_index_id", "is_system_named", "is_enforced"], [(*obj(c.name, i, t.object_id, k, desc[k]), 1 + t.keys.index(c), 0, 1) for t, k, c, i in constraints if k in ("PK", "UQ")]
    by_key = {t.key: t for t in tables}
    if name == "sys.foreign_keys":
        return [*OBJECT, "referenced_object_id", "delete_referential_action_desc", "update_referential_action_desc"], [(*obj(c.name, i, t.object_id, k, desc[k]), by_key[c.parent].object_id, "NO_ACTION", "NO_ACTION") for t, k, c, i in constraints if k == "F"]
    if name == "sys.foreign_key_columns":
        at = lambda t, c: [x.name.lower() for x in t.columns].index(c.lower()) + 1
        return ["constraint_object_id", "constraint_column_id", "parent_object_id", "parent_column_id", "referenced_object_id", "referenced_column_id"], [(i, j + 1, t.object_id, at(t, a), by_key[c.parent].object_id, at(by_key[c.parent], b)) for t, k, c, i in constraints if k == "F" for j, (a, b) in enumerate(zip(c.columns, c.parent_columns, strict=True))]
    if name == "sys.check_constraints":
        return [*OBJECT, "definition"], [(*obj(c.name, i, t.object_id, k, desc[k]), f"({c.text})") for t, k, c, i in constraints if k == "C"]
    if name == "sys.default_constraints":
        return [*OBJECT, "parent_column_id"], [(*obj(cname(k, c), i, t.object_id, k, desc[k]), 1 + t.columns.index(c)) for t, k, c, i in constraints if k == "D"]
    if name == "sys.partitions":
        return ["object_id", "index_id", "partition_number"], [(t.object_id, 1 if t.keys else 0, 1) for t in tables]
    if name in ("sys.views", "sys.procedures", "sys.triggers", "sys.synonyms", "sys.sequences", "sys.table_types", "sys.sql_modules", "sys.parameters", "sys.extended_properties"):
        return OBJECT, []
    plain = _plain_views(database, len(catalog.databases)).get(name)
    if plain is not None:
        return plain
    if name == "sys.allocation_units":
        return ["allocation_unit_id", "type", "type_desc", "container_id", "data_space_id", "total_pages", "used_pages"], [(t.object_id + 1, 1, "IN_ROW_DATA", t.object_id, 1, 0, 0) for t in tables]
    if name == "sys.dm_exec_sessions":
        return ["session_id", "login_name", "host_name", "program_name", "status"], [(51, "sa", "localhost", "tsqlspark", "running")]
    if name == "sys.configurations":
        return ["name", "description"], [("max degree of parallelism", "maximum degree of parallelism")]
    if name == "information_schema.tables":
        return ["TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME", "TABLE_TYPE"], [(database, t.schema, t.name, "BASE TABLE") for t in tables]
    if name == "information_schema.columns":
        rows = []
        for t in tables:
            for i, c in enumerate(t.columns):
                k = c.type
                text = k.is_string or k.is_binary
                rows.append((database, t.schema, t.name, c.name, i + 1, None, "YES" if c.nullable else "NO", k.name, k.n if text else None, (_size(k) if text else None), _precision(k) if k.is_exact or k.is_float else None, (2 if k.is_float else 10) if k.is_exact or k.is_float else None, k.exact()[1] if k.is_exact else None, {"datetime": 3, "date": 0, "smalldatetime": 0}.get(k.name, k.s) if k.is_date else None, ("UNICODE" if k.name[0] == "n" else "iso_1") if k.is_string else None, collation if k.is_string else None))
        return ["TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION", "COLUMN_DEFAULT", "IS_NULLABLE", "DATA_TYPE", "CHARACTER_MAXIMUM_LENGTH", "CHARACTER_OCTET_LENGTH", "NUMERIC_PRECISION", "NUMERIC_PRECISION_RADIX", "NUMERIC_SCALE", "DATETIME_PRECISION", "CHARACTER_SET_NAME", "COLLATION_NAME"], rows
    if name == "information_schema.schemata":
        return ["CATALOG_NAME", "SCHEMA_NAME", "SCHEMA_OWNER"], [(database, s, s) for s in ("dbo", "INFORMATION_SCHEMA", "sys", *catalog.schemas.get(database, []))]
    if name == "information_schema.table_constraints":
        word = {"PK": "PRIMARY KEY", "UQ": "UNIQUE", "F": "FOREIGN KEY", "C": "CHECK"}
        return ["CONSTRAINT_CATALOG", "CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME", "CONSTRAINT_TYPE", "IS_DEFERRABLE", "INITIALLY_DEFERRED"], [(database, t.schema, c.name, database, t.schema, t.name, word[k], "NO", "NO") for t, k, c, _ in constraints if k != "D"]
    if name == "information_schema.key_column_usage":
        return ["CONSTRAINT_CATALOG", "CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION"], [(database, t.schema, c.name, database, t.schema, t.name, x, j + 1) for t, k, c, _ in constraints if k in ("PK", "UQ", "F") for j, x in enumerate(c.columns)]
    if name == "information_schema.referential_constraints":
        rows = [(database, t.schema, c.name, database, by_key[c.parent].schema, next((k2.name for k2 in by_key[c.parent].keys if k2.columns == c.parent_columns), None), "SIMPLE", "NO ACTION", "NO ACTION") for t, k, c, _ in constraints if k == "F"]
        return ["CONSTRAINT_CATALOG", "CONSTRAINT_SCHEMA", "CONSTRAINT_NAME", "UNIQUE_CONSTRAINT_CATALOG", "UNIQUE_CONSTRAINT_SCHEMA", "UNIQUE_CONSTRAINT_NAME", "MATCH_OPTION", "UPDATE_RULE", "DELETE_RULE"], rows
    if name in ("information_schema.views", "information_schema.routines", "information_schema.parameters"):
        return ["TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME"], []
    return None


def _plain_views(database: str, databases: int) -> dict[str, tuple[list[str], list[tuple]]]:
    """Views whose rows don't depend on tables."""
    principal = ["name", "principal_id", "sid", "type", "type_desc", "default_schema_name", "create_date", "modify_date", "owning_principal_id", "is_fixed_role"]
    roles = ("db_owner", "db_accessadmin", "db_securityadmin", "db_ddladmin", "db_backupoperator", "db_datareader", "db_datawriter", "db_denydatareader", "db_denydatawriter")
    ids = (16384, 16385, 16386, 16387, 16389, 16390, 16391, 16392, 16393)
    users = [("public", 0, None, "R", "DATABASE_ROLE", None, CREATED, CREATED, 1, 0), ("dbo", 1, "0x01", "S", "SQL_USER", "dbo", CREATED, CREATED, None, 0), ("guest", 2, "0x00", "S", "SQL_USER", "guest", CREATED, CREATED, None, 0), ("INFORMATION_SCHEMA", 3, None, "S", "SQL_USER", None, CREATED, CREATED, None, 0), ("sys", 4, None, "S", "SQL_USER", None, CREATED, CREATED, None, 0)]
    users += [(r, i, None, "R", "DATABASE_ROLE", None, CREATED, CREATED, 1, 1) for r, i in zip(roles, ids, strict=True)]
    login = ["name", "principal_id", "sid", "type", "type_desc", "is_disabled", "create_date", "modify_date", "default_database_name", "is_fixed_role"]
    logins = [("sa", 1, "0x01", "S", "SQL_LOGIN", 0, CREATED, CREATED, "master", 0), ("public", 2, "0x02", "R", "SERVER_ROLE", 0, CREATED, CREATED, None, 0), ("sysadmin", 3, "0x03", "R", "SERVER_ROLE", 0, CREATED, CREATED, None, 1)]
    files = ["database_id", "file_id", "type", "type_desc", "data_space_id", "name", "physical_name", "state", "state_desc", "size", "max_size", "growth", "is_read_only"]
    of = lambda d: [(d, 1, 0, "ROWS", 1, "data", "data", 0, "ONLINE", 0, -1, 0, 0), (d, 2, 1, "LOG", 0, "log", "log", 0, "ONLINE", 0, -1, 0, 0)]
    space = ["name", "data_space_id", "type", "type_desc", "is_default", "is_system"]
    return {
        "sys.database_principals": (principal, users),
        "sys.server_principals": (login, logins),
        "sys.sql_logins": (login, logins[:1]),
        "sys.database_role_members": (["role_principal_id", "member_principal_id"], [(16384, 1)]),
        "sys.server_role_members": (["role_principal_id", "member_principal_id"], [(3, 1)]),
        "sys.database_permissions": (["class", "class_desc", "major_id", "grantee_principal_id", "permission_name", "state_desc"], [(0, "DATABASE", 0, 1, "CONNECT", "GRANT")]),
        "sys.database_files": (files[1:], [r[1:] for r in of(1)]),
        "sys.master_files": (files, [r for d in range(1, databases + 1) for r in of(d)]),
        "sys.data_spaces": (space, [("PRIMARY", 1, "FG", "ROWS_FILEGROUP", 1, 0)]),
        "sys.filegroups": ([*space, "is_read_only"], [("PRIMARY", 1, "FG", "ROWS_FILEGROUP", 1, 0, 0)]),
        "sys.dm_exec_requests": (["session_id", "request_id", "status", "command", "database_id", "blocking_session_id", "wait_type"], [(51, 0, "running", "SELECT", 1, 0, None)]),
        "sys.dm_exec_connections": (["session_id", "net_transport", "protocol_type", "encrypt_option", "auth_scheme", "client_net_address"], [(51, "TCP", "TSQL", "FALSE", "SQL", "127.0.0.1")]),
        "sys.dm_os_sys_info": (["cpu_count", "physical_memory_kb"], [(1, 0)]),
        "sys.dm_os_host_info": (["host_platform", "host_distribution", "host_release"], [("Linux", "Linux", "")]),
    }


_CONSTANT_INTS = {c for columns in CONSTANT.values() for c, v in columns.items() if isinstance(v, int)} | {"source_database_id", "history_table_id", "filestream_data_space_id", "host_process_id"}


def column_type(name: str) -> SqlType:
    if name in _INTS or name in _CONSTANT_INTS or name.startswith("is_"):
        return ty.INT
    return ty.DATETIME2 if name.endswith("_date") else ty.nvarchar(4000)
