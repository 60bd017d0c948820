"""System, session, privilege, identifier and hash functions."""

from pelorus.types import TYPE_NAMES, TYPE_OIDS

_OID = "CAST(pmod(xxhash64(CAST($1 AS STRING)), 1000000) + 16384 AS BIGINT)"
_UUID = "rlike($1, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')"
_ROLE = "CASE WHEN {r} IN ('pg_read_server_files', 'pg_write_server_files', 'pg_execute_server_program') THEN false ELSE true END"
_SYSTEM = "({t} LIKE 'pg_%' OR {t} LIKE 'information_schema%')"


def _lookup(view: str, key: str, value: str, wanted: str, where: str = "true") -> str:
    """A catalog view's value for a key; inner names are such that none of the caller's is caught."""
    return f"(SELECT max(value_) FROM (SELECT {key} AS key_, {value} AS value_ FROM {view} WHERE {where}) WHERE key_ = {wanted})"


_SHOWN = "map(" + ", ".join(f"{k}, '{shown}', {many}, '{shown}[]'" for k, many, shown in TYPE_OIDS.values()) + ")"
_NAMED = "map(" + ", ".join(f"'{n}', {TYPE_OIDS[x][0]}, '{n}[]', {TYPE_OIDS[x][1]}" for n, x in ({n: n for n in TYPE_OIDS} | TYPE_NAMES).items()) + ")"

TEMPLATES = {
    "version": {0: "concat('PostgreSQL 16.0 (pelorus, Spark ', version(), ')')"},
    "current_database": {0: "'main'"},
    "current_schema": {0: "'public'"},
    "current_schemas": {1: "CASE WHEN $1 THEN array('pg_catalog', 'public') ELSE array('public') END"},
    "current_user": {0: "'postgres'"},
    "session_user": {0: "'postgres'"},
    "pg_backend_pid": {0: "1"},
    "pg_is_in_recovery": {0: "false"},
    "pg_database_size": {1: "8192L"},
    "pg_postmaster_start_time": {0: "current_timestamp()"},
    "pg_conf_load_time": {0: "current_timestamp()"},
    "inet_client_addr": {0: "'127.0.0.1'"},
    "inet_client_port": {0: "0"},
    "inet_server_addr": {0: "'127.0.0.1'"},
    "inet_server_port": {0: "5432"},
    "pg_has_role": {2: _ROLE.format(r="$1"), 3: _ROLE.format(r="$2")},
    "has_database_privilege": {2: "true", 3: "true"},
    "has_schema_privilege": {2: "true", 3: "true"},
    "has_table_privilege": {
        2: f"CASE WHEN {_SYSTEM.format(t='$1')} THEN upper($2) = 'SELECT' ELSE true END",
        3: f"CASE WHEN {_SYSTEM.format(t='$2')} THEN upper($3) = 'SELECT' WHEN $1 = 'postgres' THEN true ELSE upper($3) = 'SELECT' END",
    },
    "pg_get_userbyid": {1: "'postgres'"},
    "pg_table_is_visible": {1: "true"},
    "to_regclass": {1: _lookup("pg_class", "relname", "oid", "regexp_replace(CAST($1 AS STRING), '^(public|pg_catalog)[.]', '')")},
    "to_regtype": {1: f"coalesce(CAST(try_element_at({_NAMED}, lower($1)) AS BIGINT), {_lookup('pg_type', 'typname', 'oid', 'lower($1)')})"},
    "format_type": {
        2: "CASE WHEN $2 > 4 AND $1 IN (1042, 1043) THEN concat(CASE $1 WHEN 1042 THEN 'character(' ELSE 'character varying(' END, $2 - 4, ')')"
        " WHEN $2 > 4 AND $1 = 1700 THEN concat('numeric(', shiftright(CAST($2 - 4 AS INT), 16), ',', CAST($2 - 4 AS INT) & 65535, ')')"
        f" WHEN $1 IS NOT NULL THEN coalesce(try_element_at({_SHOWN}, CAST($1 AS INT)), {_lookup('pg_type', 'oid', 'typname', '$1')}, '???') END"
    },
    "set_config": {3: "CAST($2 AS STRING)"},
    "obj_description": {n: _lookup("pg_description", "objoid", "description", "$1", "objsubid = 0") for n in (1, 2)},
    "col_description": {2: "(SELECT max(value_) FROM (SELECT objoid AS key_, objsubid AS sub_, description AS value_ FROM pg_description WHERE objsubid > 0) WHERE key_ = $1 AND sub_ = $2)"},
    "pg_get_constraintdef": {n: _lookup("pg_constraint", "oid", "consrc", "$1") for n in (1, 2)},
    "pg_get_indexdef": {n: f"coalesce({_lookup('pg_indexes', 'indexoid_', 'indexdef', '$1')}, '')".replace("pg_indexes", "(SELECT c_.oid AS indexoid_, i_.indexdef FROM pg_indexes AS i_ JOIN pg_class AS c_ ON c_.relname = i_.indexname)") for n in (1, 3)},
    "pg_get_expr": {2: "CAST($1 AS STRING)", 3: "CAST($1 AS STRING)"},
    "pg_size_pretty": {
        0: "CAST(NULL AS STRING)",
        1: "CASE WHEN $1 < 1024 THEN concat($1, ' bytes') WHEN $1 < 1048576 THEN concat(CAST(($1) div 1024 AS STRING), ' kB') WHEN $1 < 1073741824 THEN concat(CAST(($1) div 1048576 AS STRING), ' MB')"
        " WHEN $1 < 1099511627776 THEN concat(CAST(($1) div 1073741824 AS STRING), ' GB') ELSE concat(CAST(($1) div 1099511627776 AS STRING), ' TB') END",
    },
    "gen_random_uuid": {0: "uuid()"},
    "uuid_generate_v4": {0: "uuid()"},
    "is_valid_uuid": {1: f"coalesce({_UUID}, false)"},
    "uuid_normalize": {1: f"CASE WHEN {_UUID} THEN lower($1) END"},
    "hash": {1: "xxhash64(CAST($1 AS STRING))"},
    "oid_hash": {1: _OID},
}
