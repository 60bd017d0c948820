"""PostgreSQL types: their Spark types, literals, and checks on the way in."""

from __future__ import annotations

import re

# PostgreSQL type names and their Spark SQL types.
SPARK_TYPES = {
    "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "int2": "SMALLINT", "smallint": "SMALLINT", "int4": "INT", "int": "INT", "integer": "INT", "int8": "BIGINT", "bigint": "BIGINT",
    "smallserial": "SMALLINT", "serial": "INT", "serial4": "INT", "bigserial": "BIGINT", "serial8": "BIGINT",
    "float4": "FLOAT", "real": "FLOAT", "float8": "DOUBLE", "double precision": "DOUBLE", "float": "DOUBLE", "double": "DOUBLE",
    "money": "DECIMAL(18,2)", "text": "STRING", "varchar": "STRING", "character varying": "STRING", "char": "STRING", "character": "STRING", "bpchar": "STRING", "name": "STRING", "string": "STRING",
    "bytea": "BINARY", "date": "DATE", "time": "TIME(6)", "time without time zone": "TIME(6)", "timetz": "TIME(6)", "time with time zone": "TIME(6)",
    "timestamp": "TIMESTAMP_NTZ", "timestamp without time zone": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP",
    "interval": "INTERVAL DAY TO SECOND", "uuid": "STRING", "json": "STRING", "jsonb": "STRING", "inet": "STRING", "cidr": "STRING", "macaddr": "STRING", "macaddr8": "STRING",
    "bit": "STRING", "varbit": "STRING", "bit varying": "STRING", "int4range": "STRING", "int8range": "STRING", "numrange": "STRING", "tsvector": "STRING", "tsquery": "STRING",
    "regconfig": "STRING", "regclass": "BIGINT", "oid": "BIGINT",
}
SERIAL = ("smallserial", "serial", "serial4", "bigserial", "serial8")
# PostgreSQL's identifiers of types and of their arrays, and the names that format_type shows.
TYPE_OIDS = {
    "bool": (16, 1000, "boolean"), "bytea": (17, 1001, "bytea"), "name": (19, 1003, "name"), "int8": (20, 1016, "bigint"), "int2": (21, 1005, "smallint"), "int4": (23, 1007, "integer"), "text": (25, 1009, "text"), "oid": (26, 1028, "oid"),
    "json": (114, 199, "json"), "cidr": (650, 651, "cidr"), "float4": (700, 1021, "real"), "float8": (701, 1022, "double precision"), "macaddr8": (774, 775, "macaddr8"), "money": (790, 791, "money"), "macaddr": (829, 1040, "macaddr"), "inet": (869, 1041, "inet"),
    "bpchar": (1042, 1014, "character"), "varchar": (1043, 1015, "character varying"), "date": (1082, 1182, "date"), "time": (1083, 1183, "time without time zone"), "timestamp": (1114, 1115, "timestamp without time zone"), "timestamptz": (1184, 1185, "timestamp with time zone"),
    "interval": (1186, 1187, "interval"), "timetz": (1266, 1270, "time with time zone"), "bit": (1560, 1561, "bit"), "varbit": (1562, 1563, "bit varying"), "numeric": (1700, 1231, "numeric"), "regclass": (2205, 2210, "regclass"), "uuid": (2950, 2951, "uuid"),
    "tsvector": (3614, 3643, "tsvector"), "tsquery": (3615, 3645, "tsquery"), "jsonb": (3802, 3807, "jsonb"), "int4range": (3904, 3905, "int4range"), "numrange": (3906, 3907, "numrange"), "int8range": (3926, 3927, "int8range"),
}
#: Other spellings of those names.
TYPE_NAMES = {shown: name for name, (_, _, shown) in TYPE_OIDS.items()} | {
    "int": "int4", "serial": "int4", "serial4": "int4", "smallserial": "int2", "bigserial": "int8", "serial8": "int8", "decimal": "numeric", "float": "float8", "double": "float8", "char": "bpchar", "string": "text"
}
_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
# What the text of a checked type looks like.
PATTERNS = {
    "uuid": r"(?i)^\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$",
    "inet": rf"^({_OCTET}\.){{3}}{_OCTET}(/(3[0-2]|[12]?\d))?$|^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(/\d{{1,3}})?$",
    "cidr": rf"^({_OCTET}\.){{3}}{_OCTET}/(3[0-2]|[12]?\d)$|^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*/\d{{1,3}}$",
    "macaddr": r"(?i)^([0-9a-f]{2}[:-]){5}[0-9a-f]{2}$",
    "macaddr8": r"(?i)^([0-9a-f]{2}[:-]){7}[0-9a-f]{2}$",
    "bit": "^[01]*$",
    "varbit": "^[01]*$",
    "int4range": r"^(empty|[\[(]\s*-?\d*\s*,\s*-?\d*\s*[\])])$",
    "int8range": r"^(empty|[\[(]\s*-?\d*\s*,\s*-?\d*\s*[\])])$",
    "numrange": r"^(empty|[\[(]\s*(-?[\d.]+)?\s*,\s*(-?[\d.]+)?\s*[\])])$",
}


class PgType:
    """A declared type: base name, modifiers in parentheses, array depth."""

    def __init__(self, text: str):
        m = re.fullmatch(r"\s*([a-z_][\w ]*?)\s*(?:\(([\d\s,]*)\))?\s*((?:with(?:out)? time zone)?)\s*((?:\[\d*\])*)\s*", text, re.I)
        if not m:
            raise ValueError(f"type {text!r} is not understood")
        self.base = re.sub(r"\s+", " ", f"{m[1]} {m[3]}".strip().lower())
        self.args = [int(x) for x in m[2].split(",")] if m[2] and m[2].strip() else []
        self.depth = m[4].count("[")

    @property
    def oid(self) -> int | None:
        """PostgreSQL's identifier, or None where it is no built-in type."""
        own = TYPE_OIDS.get(TYPE_NAMES.get(self.base, self.base))
        return None if own is None else own[bool(self.depth)]

    @property
    def modifier(self) -> int:
        """atttypmod: a length, or precision and scale, as PostgreSQL packs them."""
        if not self.args:
            return -1
        return ((self.args[0] << 16) + (self.args + [0])[1] if self.base in ("numeric", "decimal") else self.args[0]) + 4

    @property
    def scalar(self) -> str:
        if self.base in ("numeric", "decimal"):
            p, s = (self.args + [0])[:2] if self.args else (38, 9)
            return f"DECIMAL({p},{s})"
        return SPARK_TYPES.get(self.base, "STRING")

    @property
    def spark(self) -> str:
        out = self.scalar
        for _ in range(self.depth):
            out = f"ARRAY<{out}>"
        return out

    def check(self, column: str) -> str:
        """The column as this type; what doesn't fit raises."""
        fail = lambda bad, what: f"CASE WHEN {bad} THEN CAST(raise_error('{what}') AS {self.spark}) ELSE CAST({column} AS {self.spark}) END"
        if self.depth:
            return f"CAST({column} AS {self.spark})"
        if self.base in ("numeric", "decimal") and self.args:
            p, s = (self.args + [0])[:2]
            wide = f"CAST({column} AS DECIMAL(38,12))"
            return fail(f"{wide} <> round({wide}, {s}) OR abs({wide}) >= power(10, {p - s})", "numeric field overflow (22003)")
        if self.base in ("varchar", "character varying") and self.args:
            return fail(f"length(CAST({column} AS STRING)) > {self.args[0]}", f"value too long for type character varying({self.args[0]}) (22001)")
        if self.base in ("char", "character", "bpchar"):
            n = self.args[0] if self.args else 1
            return f"CASE WHEN length(rtrim(CAST({column} AS STRING))) > {n} THEN raise_error('value too long for type character({n}) (22001)') ELSE rpad(CAST({column} AS STRING), {n}, ' ') END"
        if self.base in PATTERNS:
            pattern = PATTERNS[self.base].replace("\\", "\\\\")
            return fail(f"{column} IS NOT NULL AND NOT rlike(CAST({column} AS STRING), '{pattern}')", f"invalid input for type {self.base} (22P02)")
        if self.base == "money":
            return f"CAST(regexp_replace(CAST({column} AS STRING), '[$,]', '') AS DECIMAL(18,2))"
        if self.base == "bytea":
            return f"CASE WHEN CAST({column} AS STRING) LIKE '\\\\\\\\x%' THEN unhex(substr(CAST({column} AS STRING), 3)) ELSE CAST({column} AS BINARY) END"
        if self.base in ("json", "jsonb"):
            return fail(f"{column} IS NOT NULL AND try_parse_json(CAST({column} AS STRING)) IS NULL", "invalid input for type json (22P02)")
        return f"CAST({column} AS {self.spark})"


def array_literal(text: str) -> list:
    """``{1,2,{3}}`` as nested lists of text; NULL is None."""
    at = 0

    def items() -> list:
        nonlocal at
        out, word, quoted, was = [], "", False, False
        at += 1
        while True:
            c = text[at]
            if quoted:
                if c == "\\":
                    at += 1
                    word += text[at]
                elif c == '"':
                    quoted = False
                else:
                    word += c
            elif c == '"':
                quoted = was = True
            elif c == "{":
                out.append(items())
                word = None
            elif c in ",}":
                if word is not None and (word.strip() or was):
                    out.append(word if was else None if word.strip().upper() == "NULL" else word.strip())
                word, was = "", False
                if c == "}":
                    return out
            elif word is not None:
                word += c
            at += 1

    return items()


def range_parts(text: str) -> tuple[str | None, str | None, bool, bool]:
    """``[a,b)`` as (lower, upper, lower included, upper included)."""
    low, high = text[1:-1].split(",")
    return low.strip() or None, high.strip() or None, text[0] == "[", text[-1] == "]"
