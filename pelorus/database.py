"""A database of named DataFrames that PostgreSQL-flavoured statements read and change.

SELECT goes through the dialect to ``spark.sql``.  INSERT, UPDATE and DELETE make
a new version of a table, a DataFrame over the last one; with ``storage`` set each
version is written as Parquet there, which cuts the plan.  Transactions keep the
map of names to versions, so a rollback puts it back.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelorus import session
from pelorus.catalog import Catalog, Column, Constraint, Table
from pelorus.dialect import Node, Translator, Typed, literal, nest, split, statements, tokens
from pelorus.functions import jsons
from pelorus.operators import theta
from pelorus.sources.tables import Portal
from pelorus.types import PgType, array_literal


class IntegrityError(ValueError):
    """A constraint is violated."""


class FailedTransaction(RuntimeError):
    """The current transaction is aborted; commands are ignored until it ends."""


@dataclass
class Result:
    """A command tag, and rows where there are some."""

    tag: str
    df: DataFrame | None = None

    def rows(self) -> list:
        return [] if self.df is None else self.df.collect()


def _text(nodes: list[Node]) -> str:
    """Nodes back as SQL text."""
    show = {"paren": ("(", ")"), "bracket": ("[", "]")}
    return " ".join(f"{show[n.kind][0]}{_text(n.inner)}{show[n.kind][1]}" if n.kind in show else n.text for n in nodes)


def _bare(n: Node) -> str:
    return n.text.strip('"').lower() if n.kind == "word" else n.text[1:-1]


class Database:
    def __init__(self, spark: SparkSession, storage: str | None = None):
        self.spark = session.configure(spark)
        self.storage = storage
        self.catalog = Catalog()
        self.data: dict[str, DataFrame] = {}
        self.prepared: dict[str, str] = {}
        self.portals: dict[str, Portal] = {}
        self._saved: tuple[Catalog, dict[str, DataFrame], dict[str, str]] | None = None
        self._points: list[tuple[str, tuple]] = []
        self.views: dict[str, str] = {}
        self._typed = Typed()
        self._failed = False
        self._version = 0
        jsons.register(spark)

    # tables

    def attach(self, name: str, df: DataFrame, declared: dict[str, str] | None = None) -> None:
        """Registers a DataFrame as a table; ``declared`` gives PostgreSQL types of columns, as json or tsvector."""
        known = {"bigint": "int8", "int": "int4", "smallint": "int2", "double": "float8", "float": "float4", "string": "text", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "binary": "bytea"}
        columns = []
        for n, t in df.dtypes:
            kind = (declared or {}).get(n) or known.get(t, re.sub(r"^decimal", "numeric", t) if t.startswith("decimal") else "text" + "[]" * t.startswith("array"))
            columns.append(Column(n, PgType(kind), kind))
        self.catalog.tables[name] = Table(name, columns)
        self._put(name, df)

    def _put(self, name: str, df: DataFrame) -> None:
        if self.storage:
            self._version += 1
            path = f"{self.storage}/{name}/v{self._version}"
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self.data[name] = df
        df.createOrReplaceTempView(name)
        for view, query in self.views.items():  # views read the tables as they are now
            if view != name and view in self.data:
                self.data[view] = self._select(query)
                self.data[view].createOrReplaceTempView(view)

    def table(self, name: str) -> DataFrame:
        return self.data[name]

    # statements

    def sql(self, text: str, params: list | tuple | dict | None = None) -> DataFrame:
        """The rows of the last statement."""
        done = self.execute(text, params)
        if done.df is None:
            raise ValueError(f"{done.tag} returns no rows")
        return done.df

    def execute(self, text: str, params: list | tuple | dict | None = None) -> Result:
        done = Result("EMPTY")
        for statement in statements(text):
            done = self._guarded(statement, params)
        return done

    def _guarded(self, text: str, params) -> Result:
        head = tokens(text)[0].low
        if self._failed and head not in ("rollback", "abort", "commit", "end"):
            raise FailedTransaction("current transaction is aborted, commands ignored until end of transaction block")
        try:
            return self._run(text, params)
        except Exception:
            self._failed = self._saved is not None
            raise

    def _run(self, text: str, params) -> Result:
        nodes = nest(tokens(text))
        words = [n.low for n in nodes[:4]] + [""] * 4
        head = words[0]
        method = getattr(self, f"_{head}", None) if head in ("insert", "update", "delete", "create", "drop", "alter", "comment", "set", "show", "reset", "truncate", "prepare", "execute", "deallocate", "declare", "fetch", "close", "explain") else None
        if head in ("begin", "start"):
            self._saved, self._points = self._state(), []
            return Result("BEGIN")
        if head == "savepoint" and self._saved:
            self._points.append((_bare(nodes[1]), self._state()))
        if head in ("rollback", "release") and (words[1] in ("to", "savepoint") or head == "release") and self._saved:
            return self._to_savepoint(head, _bare(nodes[-1]))
        if head in ("commit", "end", "rollback", "abort"):
            return self._finish(head in ("commit", "end"))
        if head in ("grant", "revoke", "analyze", "vacuum", "reindex", "lock", "discard", "savepoint", "release"):
            return Result(head.upper())
        if method:
            return method(nodes, params)
        if head == "with" and (k := next((i for i, n in enumerate(nodes) if n.low in ("insert", "update", "delete")), None)):
            return self._with(nodes[:k], nodes[k:], params)
        for n, call in zip(nodes, nodes[1:]):
            if n.low == "set_config" and call.kind == "paren" and all(c[0].kind == "text" for c in split(call.inner)[:2]):
                name, value = (literal(c[0].text) for c in split(call.inner)[:2])
                self.catalog.settings[name.lower()] = value
        return Result("SELECT", self._select(text, params))

    def translator(self) -> Translator:
        return Translator(self.catalog.kind_of, self.catalog.labels, self._typed)

    def _select(self, text: str, params=None) -> DataFrame:
        spark_text = self.translator().write(nest(tokens(text)))
        self._introspect(f"{text} {self._typed.render(spark_text)}".lower())
        df = self._spark_sql(spark_text, params)
        return theta.counted(df) if "count" in text.lower() and ("<" in text or ">" in text) else df

    def _introspect(self, low: str) -> None:
        """Makes the catalog views that a statement names."""
        if "pg_" not in low and "information_schema" not in low:
            return
        for name in self.catalog.relations():
            if name.replace("information_schema_", "information_schema.") in low or name in low:
                self.catalog.frame(self.spark, name).createOrReplaceTempView(name)
        if re.search(r"\bpg_stats\b", low):
            self._statistics().createOrReplaceTempView("pg_stats")

    def _statistics(self) -> DataFrame:
        """pg_stats, from one pass over each table when it is read; as in ANALYZE, a count of
        distinct values above a tenth of the rows is shown as a negative share of them."""
        out = self.spark.createDataFrame([], "schemaname string, tablename string, attname string, inherited boolean, null_frac double, n_distinct double")
        for t in self.catalog.tables.values():
            df = self.data.get(t.name)
            if t.kind != "r" or df is None or not df.columns:
                continue
            kinds = dict(df.dtypes)
            cells = [F.struct(F.lit(c).alias("attname"), F.count(F.col(f"`{c}`")).alias("some"), F.lit(None).cast("long").alias("apart") if kinds[c].startswith(("map", "variant")) else F.approx_count_distinct(F.col(f"`{c}`")).alias("apart")) for c in df.columns]
            rows = df.agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("cells")).select("n", F.inline("cells"))
            share = F.when(F.col("apart") > 0.1 * F.col("n"), -F.least(F.col("apart") / F.col("n"), F.lit(1.0))).otherwise(F.col("apart").cast("double"))
            out = out.unionByName(rows.where("n > 0").select(F.lit("public").alias("schemaname"), F.lit(t.name).alias("tablename"), "attname", F.lit(False).alias("inherited"), (1 - F.col("some") / F.col("n")).alias("null_frac"), share.alias("n_distinct")))
        return out

    def _spark_sql(self, text: str, params=None) -> DataFrame:
        """Translated text, operators that depend on types written out."""
        return self._run_sql(self._typed.resolve(text, lambda probe: self._analysed(probe, params)), params)

    def _analysed(self, text: str, params) -> str:
        try:
            return self._run_sql(text, params)._jdf.queryExecution().analyzed().toJSON()
        except AnalysisException:  # the statement itself will tell
            return ""

    def _run_sql(self, text: str, params) -> DataFrame:
        if not params:
            return self.spark.sql(text)
        named = {f"p{i + 1}": v for i, v in enumerate(params)} if isinstance(params, (list, tuple)) else dict(params)
        return self.spark.sql(text, args={k: v for k, v in named.items() if re.search(rf":{k}\b", text)})

    def _state(self) -> tuple:
        return copy.deepcopy(self.catalog), dict(self.data), dict(self.views)

    def _restore(self, state: tuple) -> None:
        for name in self.data.keys() - state[1].keys():
            self.spark.catalog.dropTempView(name)
        self.catalog, self.data, self.views = copy.deepcopy(state[0]), dict(state[1]), dict(state[2])
        for name, df in self.data.items():
            df.createOrReplaceTempView(name)

    def _to_savepoint(self, head: str, name: str) -> Result:
        """Back to the last savepoint of the name, which stays, or its release."""
        at = max((i for i, (n, _) in enumerate(self._points) if n == name), default=None)
        if at is None:
            raise ValueError(f'savepoint "{name}" does not exist (3B001)')
        if head == "rollback":
            self._restore(self._points[at][1])
            self._failed = False
        del self._points[at + (head == "rollback") :]
        return Result(head.upper())

    def _finish(self, keep: bool) -> Result:
        if self._saved and (not keep or self._failed):
            self._restore(self._saved)
            keep = False
        self._saved, self._failed, self._points = None, False, []
        return Result("COMMIT" if keep else "ROLLBACK")

    # changes

    def _returning(self, nodes: list[Node]) -> tuple[list[Node], list[Node] | None]:
        k = next((i for i, n in enumerate(nodes) if n.low == "returning"), None)
        return (nodes, None) if k is None else (nodes[:k], nodes[k + 1 :])

    def _returned(self, tag: str, rows: DataFrame, what: list[Node] | None, alias: str) -> Result:
        if what is None:
            return Result(tag)
        rows.createOrReplaceTempView("_returned")
        return Result(tag, self._spark_sql(f"SELECT {self.translator().write(what)} FROM _returned AS {alias}"))

    def _insert(self, nodes: list[Node], params) -> Result:
        nodes, what = self._returning(nodes)
        name = _bare(nodes[2])
        t, i = self.catalog.tables[name], 3
        names = [c.name for c in t.columns]
        if nodes[i].kind == "paren" and nodes[i + 1].low in ("values", "select", "with", "default"):
            names = [_bare(c[0]) for c in split(nodes[i].inner)]
            i += 1
        conflict = next((k for k, n in enumerate(nodes) if n.low == "on" and nodes[k + 1].low == "conflict"), None)
        body, tail = (nodes[i:conflict], nodes[conflict:]) if conflict else (nodes[i:], [])
        if body[0].low == "values":
            defaults = {c.name: c.default for c in t.columns}
            rows = []
            for group in split(body[1:]):
                cells = [self._value(t, n, c, defaults) for n, c in zip(names, split(group[0].inner))]
                rows.append(f"({', '.join(cells)})")
            new = self._spark_sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({', '.join(f'`{n}`' for n in names)})", params)
        else:
            new = self._select(_text(body), params).toDF(*names)
        new = self._checked(t, new, names)
        if tail:
            return self._upsert(t, new, tail, what)
        self._keys(t, new, self.data[name])
        self._put(name, self.data[name].unionByName(new))
        return self._returned("INSERT", new, what, name)

    def _with(self, tables: list[Node], change: list[Node], params) -> Result:
        """WITH ... INSERT INTO t SELECT ...: the common tables go before the SELECT."""
        k = next((i for i, n in enumerate(change) if n.low == "select"), None)
        if change[0].low != "insert" or k is None:
            raise NotImplementedError("WITH before UPDATE or DELETE is not supported; use FROM or USING (0A000)")
        return self._insert([*change[:k], *tables, *change[k:]], params)

    def _value(self, t: Table, name: str, nodes: list[Node], defaults: dict) -> str:
        if len(nodes) == 1 and nodes[0].low == "default":
            return defaults.get(name) or "NULL"
        c = next(c for c in t.columns if c.name == name)
        if c.type.depth and len(nodes) == 1 and nodes[0].kind == "text":
            return self.translator()._array_of(array_literal(literal(nodes[0].text)), c.type.spark)
        return self.translator().write(nodes)

    def _checked(self, t: Table, new: DataFrame, names: list[str]) -> DataFrame:
        """New rows with all columns of the table, converted, filled and checked row by row as they are read."""
        out = []
        new.createOrReplaceTempView("_incoming")
        for c in t.columns:
            if c.name in names:
                value = f"`{c.name}`"
                labels = self.catalog.labels(c.declared)
                shown = ", ".join("'" + x.replace("'", "\\'") + "'" for x in labels or ())
                checked = c.type.check(value) if labels is None else f"CASE WHEN {value} IS NULL OR {value} IN ({shown}) THEN CAST({value} AS STRING) ELSE raise_error('invalid input value for enum {c.declared} (22P02)') END"
            elif c.serial:
                start = t.next_serial.get(c.name, 1)
                checked = f"CAST(row_number() OVER (ORDER BY monotonically_increasing_id()) + {start - 1} AS {c.type.spark})"
            else:
                checked = f"CAST({self.translator().write(nest(tokens(c.default))) if c.default else 'NULL'} AS {c.type.spark})"
            if c.not_null and not c.serial:
                checked = f"CASE WHEN ({checked}) IS NULL THEN CAST(raise_error('null value in column \"{c.name}\" violates not-null constraint (23502)') AS {c.type.spark}) ELSE {checked} END"
            out.append(f"{checked} AS `{c.name}`")
        done = self._spark_sql(f"SELECT {', '.join(out)} FROM _incoming")
        rows = session.checkpoint(done)  # evaluated once: defaults may be random
        for c in t.columns:
            if c.serial:
                top = rows.agg(F.max(c.name)).first()[0]
                t.next_serial[c.name] = max(t.next_serial.get(c.name, 1), (top or 0) + 1)
        for k in t.constraints:
            if k.kind == "c":
                rows.createOrReplaceTempView("_incoming")
                if not self._spark_sql(f"SELECT 1 FROM _incoming WHERE NOT ({self.translator().write(nest(tokens(k.check)))}) LIMIT 1").isEmpty():
                    raise IntegrityError(f'new row violates check constraint "{k.name}" (23514)')
        return rows

    def _keys(self, t: Table, new: DataFrame, old: DataFrame) -> None:
        """Keys by grouping, foreign keys by an anti join."""
        for k in t.constraints:
            if k.kind in "pu":
                both = old.select(*k.columns).unionByName(new.select(*k.columns)).dropna()
                if not both.groupBy(*k.columns).count().where("count > 1").isEmpty():
                    raise IntegrityError(f'duplicate key value violates unique constraint "{k.name}" (23505)')
            elif k.kind == "f":
                target = self.data[k.target].select(*[F.col(b).alias(a) for a, b in zip(k.columns, k.target_columns)])
                if not new.select(*k.columns).dropna().join(target, k.columns, "left_anti").isEmpty():
                    raise IntegrityError(f'insert or update violates foreign key constraint "{k.name}" (23503)')

    def _upsert(self, t: Table, new: DataFrame, tail: list[Node], what) -> Result:
        """ON CONFLICT (columns) DO NOTHING or DO UPDATE SET ... EXCLUDED.x."""
        keys = [_bare(c[0]) for c in split(tail[2].inner)] if tail[2].kind == "paren" else next(k.columns for k in t.constraints if k.kind in "pu")
        old = self.data[t.name]
        # the first of new rows of one key counts; rows with a null in the key never conflict
        new = session.checkpoint(new.withColumn("_n", F.monotonically_increasing_id()))
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_n"))
        first = new.where(whole).withColumn("_nth", nth).where("_nth = 1").drop("_nth").unionByName(new.where(~whole)).drop("_n")
        nothing, new = any(n.low == "nothing" for n in tail), new.drop("_n")
        if not nothing and first.count() < new.count():
            raise IntegrityError("ON CONFLICT DO UPDATE command cannot affect row a second time (21000)")
        fresh = session.checkpoint(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))
        if nothing:
            self._keys(t, fresh, old)
            self._put(t.name, old.unionByName(fresh))
            return self._returned("INSERT", fresh, what, t.name)
        k = next(i for i, n in enumerate(tail) if n.low == "set")
        part = self._clauses(tail[k:], ("set", "where"))
        changes = {_bare(p[0]): self.translator().write(p[2:]) for p in split(part["set"])}
        hit = f"excluded.`{keys[0]}` IS NOT NULL AND coalesce({self.translator().write(part['where']) if part.get('where') else 'true'}, false)"
        old.createOrReplaceTempView("_old")
        new.createOrReplaceTempView("_new")
        on = " AND ".join(f"{t.name}.`{c}` = excluded.`{c}`" for c in keys)
        cells = ", ".join(f"CASE WHEN {hit} THEN {changes[c]} ELSE {t.name}.`{c}` END AS `{c}`" if c in changes else f"{t.name}.`{c}`" for c in old.columns)
        merged = self._spark_sql(f"SELECT {cells}, {hit} AS _hit FROM _old AS {t.name} LEFT JOIN _new AS excluded ON {on}")
        both = session.checkpoint(merged.unionByName(fresh.withColumn("_hit", F.lit(True))))
        touched = both.where("_hit").select(*old.columns)
        self._keys(t, touched, both.where("NOT _hit").select(*old.columns))
        self._put(t.name, both.select(*old.columns))
        return self._returned("INSERT", touched, what, t.name)

    def _clauses(self, nodes: list[Node], marks: tuple[str, ...]) -> dict[str, list[Node]]:
        out, now = {"": []}, ""
        for n in nodes:
            if n.low in marks:
                now = n.low
                out[now] = []
            else:
                out[now].append(n)
        return out

    def _values_source(self, nodes: list[Node]) -> str:
        """``(VALUES ...) AS v(a, b)`` or a table, as Spark SQL."""
        return self.translator().write(nodes)

    def _update(self, nodes: list[Node], params) -> Result:
        nodes, what = self._returning(nodes)
        part = self._clauses(nodes[1:], ("set", "from", "where"))
        name = _bare(part[""][0])
        alias = _bare(part[""][-1]) if len(part[""]) > 1 else name
        t, old = self.catalog.tables[name], self.data[name]
        write = self.translator().write
        sets = {_bare(p[0]): write(p[2:]) for p in split(part["set"])}
        where = write(part["where"]) if part.get("where") else "true"
        several = part.get("from") or re.search(r"\bselect\b", self._typed.render(f"{where} {' '.join(sets.values())}").lower())
        marked = old.withColumn("_row", F.monotonically_increasing_id())
        (session.checkpoint(marked) if several else marked).createOrReplaceTempView("_target")  # read twice: its row numbers must stand
        if part.get("from"):
            # the last match of a row counts, as one of several would in any order
            cells = ", ".join(f"{v} AS `_{c}`" for c, v in sets.items())
            hit = self._spark_sql(f"SELECT {alias}._row AS _hit, {cells} FROM _target AS {alias}, {self._values_source(part['from'])} WHERE {where}", params).dropDuplicates(["_hit"])
            base = self.spark.table("_target").join(hit, F.col("_row") == F.col("_hit"), "left").withColumn("_changed", F.col("_hit").isNotNull())
            for c in sets:
                base = base.withColumn(c, F.when(F.col("_changed"), F.col(f"_{c}").cast(old.schema[c].dataType)).otherwise(F.col(c)))
            changed = base
        elif several:
            cells = ", ".join(f"{v} AS `_{c}`" for c, v in sets.items())
            hit = self._spark_sql(f"SELECT {alias}._row AS _hit, {cells} FROM _target AS {alias} WHERE {where}", params)
            changed = self.spark.table("_target").join(hit, F.col("_row") == F.col("_hit"), "left").withColumn("_changed", F.col("_hit").isNotNull())
            for c in sets:
                changed = changed.withColumn(c, F.when(F.col("_changed"), F.col(f"_{c}").cast(old.schema[c].dataType)).otherwise(F.col(c)))
        else:
            cells = ", ".join(f"CASE WHEN coalesce({where}, false) THEN CAST({sets[c]} AS {old.schema[c].dataType.simpleString()}) ELSE `{c}` END AS `{c}`" if c in sets else f"`{c}`" for c in old.columns)
            changed = self._spark_sql(f"SELECT {cells}, coalesce({where}, false) AS _changed FROM _target AS {alias}", params)
        changed = changed.select(*old.columns, "_changed")
        changed = session.checkpoint(changed)
        touched = changed.where("_changed").drop("_changed")
        if t.constraints or any(c.type.args or self.catalog.labels(c.declared) for c in t.columns if c.name in sets):
            self._checked(t, touched, old.columns)
            self._keys(t, touched, changed.where("NOT _changed").drop("_changed"))
        self._put(name, changed.drop("_changed"))
        return self._returned("UPDATE", touched, what, alias)

    def _delete(self, nodes: list[Node], params) -> Result:
        nodes, what = self._returning(nodes)
        part = self._clauses(nodes[2:], ("using", "where"))
        name = _bare(part[""][0])
        alias = _bare(part[""][-1]) if len(part[""]) > 1 else name
        old = self.data[name]
        where = self.translator().write(part["where"]) if part.get("where") else "true"
        marked = old.withColumn("_row", F.monotonically_increasing_id())
        several = part.get("using") or "select" in self._typed.render(where).lower()
        marked = session.checkpoint(marked) if several else marked  # read twice: its row numbers must stand
        marked.createOrReplaceTempView("_target")
        if several:
            source = f", {self._values_source(part['using'])}" if part.get("using") else ""
            hit = self._spark_sql(f"SELECT DISTINCT {alias}._row FROM _target AS {alias}{source} WHERE {where}", params)
            gone, rest = marked.join(hit, "_row", "left_semi").drop("_row"), marked.join(hit, "_row", "left_anti").drop("_row")
        else:
            gone = self._spark_sql(f"SELECT * FROM _target AS {alias} WHERE {where}", params).drop("_row")
            rest = self._spark_sql(f"SELECT * FROM _target AS {alias} WHERE NOT coalesce({where}, false)", params).drop("_row")
        rest = rest.select(*old.columns)
        self._put(name, rest)
        return self._returned("DELETE", gone.select(*old.columns), what, alias)

    def _truncate(self, nodes: list[Node], params) -> Result:
        for n in nodes[1:]:
            if n.kind in ("word", "quoted") and _bare(n) in self.data:
                self._put(_bare(n), self.data[_bare(n)].limit(0))
        return Result("TRUNCATE TABLE")

    # definitions

    def _create(self, nodes: list[Node], params) -> Result:
        low = [n.low for n in nodes]
        rest = [n for n in nodes[1:] if n.low not in ("or", "replace", "temp", "temporary", "unique", "concurrently")]
        what = rest[0].low
        soft = "exists" in low[:6]
        rest = [n for n in rest[1:] if n.low not in ("if", "not", "exists")] if soft else rest[1:]
        if what in ("database", "user", "role", "extension", "schema", "trigger"):
            return Result(f"CREATE {what.upper()}")
        name = _bare(rest[0])
        if what == "type":
            labels = [literal(x[0].text) for x in split(rest[-1].inner)]
            if name in self.catalog.enums:
                raise ValueError(f'type "{name}" already exists')
            self.catalog.enums[name] = [(float(i + 1), x) for i, x in enumerate(labels)]
            return Result("CREATE TYPE")
        if what == "index":
            k = low.index("on")
            self.catalog.indexes[name] = (_bare(nodes[k + 1]), _text(nodes))
            return Result("CREATE INDEX")
        if what == "view":
            query = rest[next(i for i, n in enumerate(rest) if n.low == "as") + 1 :]
            df = self._select(_text(query), params)
            self.attach_view(name, df, _text(query))
            if not params:
                self.views[name] = _text(query)
            return Result("CREATE VIEW")
        if name in self.catalog.tables:
            if soft:
                return Result("CREATE TABLE")
            raise ValueError(f'relation "{name}" already exists')
        if len(rest) > 1 and rest[1].low == "as":
            self.attach(name, self._select(_text(rest[2:]), params))
            return Result("SELECT")
        t = self._definition(name, rest[1].inner)
        self.catalog.tables[name] = t
        self._put(name, self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type.spark}" for c in t.columns)))
        return Result("CREATE TABLE")

    def attach_view(self, name: str, df: DataFrame, definition: str) -> None:
        self.attach(name, df)
        self.catalog.tables[name].kind, self.catalog.tables[name].definition = "v", definition

    def _definition(self, name: str, inner: list[Node]) -> Table:
        t = Table(name, [])
        for part in split(inner):
            label = None
            if part[0].low == "constraint":
                label, part = _bare(part[1]), part[2:]
            head = part[0].low
            groups = [n for n in part if n.kind == "paren"]
            if head in ("primary", "unique", "foreign", "check") and (groups and (head in ("unique", "check") and part[1].kind == "paren" or head in ("primary", "foreign"))):
                self._constraint(t, label, head, [_bare(c[0]) for c in split(groups[0].inner)] if head != "check" else [], part, groups)
                continue
            kind, i = self.translator()._type(part, 1)
            column = Column(_bare(part[0]), PgType(kind) if self.catalog.labels(kind) is None else PgType("text"), kind.lower())
            t.columns.append(column)
            while i < len(part):
                low = part[i].low
                if low == "constraint":
                    label, i = _bare(part[i + 1]), i + 2
                elif low == "not":
                    column.not_null, i = True, i + 2
                elif low == "null":
                    i += 1
                elif low == "default":
                    j = i + 1
                    while j < len(part) and part[j].low not in ("not", "primary", "unique", "check", "references", "constraint"):
                        j += 1
                    column.default, i = _text(part[i + 1 : j]), j
                elif low in ("primary", "unique"):
                    self._constraint(t, label, low, [column.name], part, [])
                    i += 2 if low == "primary" else 1
                elif low == "check":
                    self._constraint(t, label, "check", [column.name], part, [part[i + 1]])
                    i += 2
                elif low == "references":
                    target = [_bare(c[0]) for c in split(part[i + 2].inner)] if i + 2 < len(part) and part[i + 2].kind == "paren" else []
                    self._foreign(t, label, [column.name], _bare(part[i + 1]), target)
                    i = len(part) if not any(x.low in ("not", "default", "check") for x in part[i + 2 :]) else next(k for k in range(i + 2, len(part)) if part[k].low in ("not", "default", "check"))
                else:
                    i += 1
        return t

    def _constraint(self, t: Table, label: str | None, head: str, columns: list[str], part: list[Node], groups: list[Node]) -> None:
        if head == "primary":
            for c in t.columns:
                c.not_null |= c.name in columns
            t.constraints.append(Constraint(label or f"{t.name}_pkey", "p", columns))
        elif head == "unique":
            t.constraints.append(Constraint(label or f"{t.name}_{'_'.join(columns)}_key", "u", columns))
        elif head == "check":
            n = sum(c.kind == "c" for c in t.constraints)
            t.constraints.append(Constraint(label or f"{t.name}_{(columns or ['row'])[0]}_check{n or ''}", "c", columns, _text(groups[0].inner)))
        else:
            k = next(i for i, x in enumerate(part) if x.low == "references")
            self._foreign(t, label, columns, _bare(part[k + 1]), [_bare(c[0]) for c in split(groups[1].inner)] if len(groups) > 1 else [])

    def _foreign(self, t: Table, label: str | None, columns: list[str], target: str, target_columns: list[str]) -> None:
        other = self.catalog.tables[target] if target != t.name else t
        target_columns = target_columns or next(k.columns for k in other.constraints if k.kind == "p")
        t.constraints.append(Constraint(label or f"{t.name}_{'_'.join(columns)}_fkey", "f", columns, target=target, target_columns=target_columns))

    def _drop(self, nodes: list[Node], params) -> Result:
        what, soft = nodes[1].low, any(n.low == "exists" for n in nodes)
        for part in split([n for n in nodes[2:] if n.low not in ("if", "exists", "cascade", "restrict", "concurrently")]):
            name = _bare(part[0])
            if what in ("table", "view"):
                if name not in self.data and not soft:
                    raise ValueError(f'relation "{name}" does not exist')
                self.catalog.tables.pop(name, None)
                if self.data.pop(name, None) is not None:
                    self.spark.catalog.dropTempView(name)
            elif what == "type":
                if self.catalog.enums.pop(name, None) is None and not soft:
                    raise ValueError(f'type "{name}" does not exist')
            elif what == "index":
                self.catalog.indexes.pop(name, None)
        return Result(f"DROP {what.upper()}")

    def _alter(self, nodes: list[Node], params) -> Result:
        low = [n.low for n in nodes]
        name = _bare(nodes[2])
        if low[1] == "type":
            texts = [literal(n.text) for n in nodes if n.kind == "text"]
            if "rename" in low:
                self.catalog.enums[name] = [(o, texts[1] if x == texts[0] else x) for o, x in self.catalog.enums[name]]
            else:
                place = "before" if "before" in low else "after" if "after" in low else ""
                self.catalog.add_label(name, texts[0], place, texts[1] if place else "", "exists" in low)
            return Result("ALTER TYPE")
        if low[1] != "table":
            return Result(f"ALTER {low[1].upper()}")
        t, df = self.catalog.tables[name], self.data[name]
        action, rest = low[3], [n for n in nodes[4:] if n.low not in ("column", "if", "exists", "not") or n.low == "not"]
        if action == "add" and rest[0].low in ("constraint", "primary", "unique", "check", "foreign"):
            other = self._definition(name, rest)
            for k in other.constraints:
                t.constraints.append(k)
            self._keys(t, df.limit(0), df)
        elif action == "add":
            c = self._definition(name, rest).columns[0]
            t.columns.append(c)
            default = self.translator().translate(c.default) if c.default else "NULL"
            self._put(name, df.withColumn(c.name, F.expr(f"CAST({default} AS {c.type.spark})")))
        elif action == "drop":
            gone = _bare(rest[-1])
            if rest[0].low == "constraint":
                t.constraints = [k for k in t.constraints if k.name != gone]
            else:
                t.columns = [c for c in t.columns if c.name != gone]
                self._put(name, df.drop(gone))
        elif action == "rename":
            if rest[0].low == "to":
                new = _bare(rest[1])
                self.catalog.tables[new] = self.catalog.tables.pop(name)
                self.catalog.tables[new].name = new
                self.data[new] = self.data.pop(name)
                self.spark.catalog.dropTempView(name)
                self.data[new].createOrReplaceTempView(new)
            else:
                old, new = _bare(rest[0]), _bare(rest[2])
                next(c for c in t.columns if c.name == old).name = new
                self._put(name, df.withColumnRenamed(old, new))
        elif action == "alter":
            c = next(c for c in t.columns if c.name == _bare(rest[0]))
            said = [n.low for n in rest[1:]]
            if "type" in said:
                kind, _ = self.translator()._type(rest, 2 + ("data" in said) * 2)
                c.type, c.declared = PgType(kind), kind
                self._put(name, df.withColumn(c.name, F.expr(c.type.check(f"`{c.name}`"))))
            elif "default" in said:
                c.default = None if said[0] == "drop" else _text(rest[3:])
            elif "null" in said:
                c.not_null = said[0] == "set"
        return Result("ALTER TABLE")

    def _comment(self, nodes: list[Node], params) -> Result:
        what = nodes[2].low
        k = next(i for i, n in enumerate(nodes) if n.low == "is")
        path = [_bare(n) for n in nodes[3:k] if n.kind in ("word", "quoted")]
        key = (what, path[0] if what != "column" else path[-2], path[-1] if what == "column" else "")
        if nodes[k + 1].low == "null":
            self.catalog.comments.pop(key, None)
        else:
            self.catalog.comments[key] = literal(nodes[k + 1].text)
        return Result("COMMENT")

    def comment_of(self, table: str, column: str = "") -> str | None:
        """obj_description and col_description."""
        return self.catalog.comments.get(("column" if column else "table", table, column))

    # session

    def _set(self, nodes: list[Node], params) -> Result:
        rest = [n for n in nodes[1:] if n.low not in ("session", "local")]
        if rest[0].low == "time" and rest[1].low == "zone":
            key, value = "timezone", rest[2]
        else:
            key, value = _bare(rest[0]), rest[-1]
        shown = literal(value.text) if value.kind == "text" else value.text
        self.catalog.settings[key] = shown
        if key == "timezone":
            self.spark.conf.set("spark.sql.session.timeZone", shown)
        return Result("SET")

    def _reset(self, nodes: list[Node], params) -> Result:
        fresh = Catalog().settings
        for key in list(self.catalog.settings) if nodes[1].low == "all" else [_bare(nodes[1])]:
            self.catalog.settings[key] = fresh.get(key, "")
        self.spark.conf.set("spark.sql.session.timeZone", self.catalog.settings["timezone"])
        return Result("RESET")

    def _show(self, nodes: list[Node], params) -> Result:
        key = "timezone" if nodes[1].low == "time" else _bare(nodes[1])
        if key == "all":
            return Result("SHOW", self.spark.createDataFrame(sorted(self.catalog.settings.items()), "name string, setting string"))
        return Result("SHOW", self.spark.createDataFrame([(self.catalog.settings.get(key, ""),)], f"`{key}` string"))

    def _explain(self, nodes: list[Node], params) -> Result:
        body = nodes[1:] if nodes[1].kind != "paren" else nodes[2:]
        text = self.translator().write([n for n in body if n.low not in ("analyze", "verbose")])
        return Result("EXPLAIN", self.spark.sql(f"EXPLAIN FORMATTED {self._typed.resolve(text, lambda probe: self._analysed(probe, None))}"))

    def _prepare(self, nodes: list[Node], params) -> Result:
        k = next(i for i, n in enumerate(nodes) if n.low == "as")
        self.prepared[_bare(nodes[1])] = _text(nodes[k + 1 :])
        return Result("PREPARE")

    def _execute(self, nodes: list[Node], params) -> Result:
        given = params
        if len(nodes) > 2 and nodes[2].kind == "paren":
            shown = ", ".join(self.translator().write(a) for a in split(nodes[2].inner))
            given = list(self._spark_sql(f"SELECT {shown}").first())
        return self._run(self.prepared[_bare(nodes[1])], given)

    def _deallocate(self, nodes: list[Node], params) -> Result:
        if nodes[-1].low == "all":
            self.prepared.clear()
        else:
            self.prepared.pop(_bare(nodes[-1]), None)
        return Result("DEALLOCATE")

    def portal(self, text: str, params=None) -> Portal:
        """A suspended result, fetched a number of rows at a time."""
        return Portal(self.sql(text, params))

    def _declare(self, nodes: list[Node], params) -> Result:
        k = next(i for i, n in enumerate(nodes) if n.low == "for")
        self.portals[_bare(nodes[1])] = self.portal(_text(nodes[k + 1 :]), params)
        return Result("DECLARE CURSOR")

    def _fetch(self, nodes: list[Node], params) -> Result:
        many = next((int(n.text) for n in nodes if n.kind == "number"), 0 if any(n.low == "all" for n in nodes) else 1)
        p = self.portals[_bare(nodes[-1])]
        rows = p.fetch(many)
        return Result("FETCH", self.spark.createDataFrame(rows, p.columns) if rows else self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in p.columns)))

    def _close(self, nodes: list[Node], params) -> Result:
        self.portals.pop(_bare(nodes[-1]), None)
        return Result("CLOSE CURSOR")
