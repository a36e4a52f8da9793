"""An embedded database of the dialect over the version log.

``Database.execute`` reads a statement, checks privileges, fences every table
where its name is resolved (row security, valid time, transaction time), emits
Spark SQL and leaves the rest to Catalyst. Fences sit below joins, subqueries
and views alike: what a role may not see it sees nowhere.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import casts
from tidemark.functions.typed import Typed, name, of_spark, text_literal
from tidemark.plans.emit import AGGREGATES, Emitter, Field, Relation, Scope
from tidemark.plans.lexer import SqlError
from tidemark.plans.parser import parse, parse_expression, split_statements
from tidemark.plans.syntax import Binary, ColumnDef, Func, Lit, Query, Select, SetOp, Statement, TableRef
from tidemark.session import Scratch
from tidemark.store.catalog import Column, Policy, Role, Table
from tidemark.store.log import ROW, STATEMENT, Log

ROOT_ROLE = "root"
PRIVILEGES = ("select", "insert", "update", "delete", "truncate")
#: A recursive query that finds more rows than this is taken to be endless.
MOST_RECURSIVE_ROWS = 1_000_000
#: Hits of one key that a pass of ON CONFLICT DO UPDATE folds.
FOLD = 1_000


class ConstraintError(SqlError):
    pass


class PermissionDenied(SqlError):
    pass


@dataclass
class Outcome:
    """What a statement gave: rows as a DataFrame, or how many rows it touched, or a message."""

    kind: str  # rows, mutation, ddl, message
    frame: DataFrame | None = None
    count: int = 0
    message: str = ""
    fields: list[Field] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []


class Database:
    """``root`` is a folder that all executors share. One explicit transaction may be open at a time."""

    def __init__(self, spark: SparkSession, root: str, role: str = ROOT_ROLE):
        self.spark = spark
        self.log = Log(spark, root)
        self.root = root
        self.role = self.login = role
        self.valid_time: Typed | None = None
        self.transaction_time: int | None = None
        self.vector_index = False
        self.attached: dict[str, DataFrame] = {}
        self.explicit = False
        self._travels = True
        self._indexes: dict[str, Any] = {}
        self._views: list[str] = []
        if ROOT_ROLE not in self.log.catalog.roles:
            self.log.catalog.roles[ROOT_ROLE] = Role(ROOT_ROLE, superuser=True, login=True)

    # entry
    def execute(self, sql: str, params: list | None = None) -> Outcome:
        """One statement."""
        tree = parse(sql)
        # time travel is for reads: what a write reads is the latest state
        self._travels = isinstance(tree, Query) or tree.kind in ("explain", "copy")
        try:
            self.log.refresh()
            if isinstance(tree, Query):
                self._check_read(tree)
                return self._rows(tree, params)
            rule = getattr(self, f"_do_{tree.kind}", None)
            if rule is None:
                raise SqlError(f"{tree.kind} is not supported")
            self._authorize(tree)
            if tree.kind in ("begin", "commit", "rollback", "set", "explain", "analyze", "vacuum") or (tree.kind == "copy" and tree.out):
                return rule(tree, params)
            own = self.log.staged is None
            if own:
                self.log.begin()
            before = None if own else self.log.catalog.to_dict()
            try:
                out = rule(tree, params)
            except BaseException:
                if own:
                    self.log.rollback()
                else:  # the statement undoes itself, the transaction goes on
                    self.log.staged = type(self.log.catalog).of(before)
                raise
            if own:
                self.log.commit()
            return out
        finally:
            for v in self._views:
                self.spark.catalog.dropTempView(v)
            self._views = []

    def script(self, sql: str) -> list[Outcome]:
        return [self.execute(s) for s in split_statements(sql)]

    def sql(self, sql: str, params: list | None = None) -> DataFrame:
        """The rows of a query."""
        out = self.execute(sql, params)
        if out.frame is None:
            raise SqlError("the statement gives no rows")
        return out.frame

    def attach(self, table: str, frame: DataFrame) -> None:
        """Make a DataFrame readable under a name; it is not versioned and can't be written to."""
        self.attached[table] = frame

    def txid_current(self) -> int:
        return self.log.committed.next_xid

    # relations
    def _emitter(self, params: list | None = None) -> Emitter:
        who = Typed(text_literal(self.role), "text")
        session = {
            "current_user": who, "current_role": who, "session_user": Typed(text_literal(self.login), "text"), "txid_current": Typed(f"{self.txid_current()}L", "int"),
        }
        return Emitter(self._relation, session, params)

    def _view(self, df: DataFrame) -> str:
        v = f"tidemark_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(v)
        self._views.append(v)
        return v

    def _frame_relation(self, df: DataFrame, fields: list[Field] | None = None) -> Relation:
        if fields is None:
            fields = [Field(f.name, *of_spark(f.dataType)) for f in df.schema]
            wide = [F.col(f"`{f.name}`").cast({"int": "bigint", "timestamp": "timestamp_ntz"}[x.type]).alias(f.name) if x.type in ("int", "timestamp") else F.col(f"`{f.name}`") for f, x in zip(df.schema, fields)]
            df = df.select(*wide)
        return Relation(name(self._view(df)), fields)

    def _relation(self, table: str, command: str = "select", latest: bool = False) -> Relation:
        catalog = self.log.catalog
        if table in ("information_schema.tables", "information_schema.columns", "pg_fault_log"):
            return self._frame_relation(self._system(table))
        if table in self.attached:
            rel = self._frame_relation(self.attached[table])
            return self._fence(rel, table, None, command, latest)
        if table in catalog.views:
            return self._expand(table)
        if table not in catalog.tables:
            raise SqlError(f"unknown table {table}")
        t = catalog.tables[table]
        point = None if latest or not self._travels or self.explicit else self.transaction_time
        df = self.log.read(t, point)
        return self._fence(self._frame_relation(df.select(*(F.col(f"`{c}`") for c in t.names)), t.fields), table, t, command, latest)

    def _expand(self, view: str) -> Relation:
        sql, fields = self._emitter().query(parse(self.log.catalog.views[view]["text"]))
        return Relation(f"({sql})", fields)

    def _fence(self, rel: Relation, table: str, t: Table | None, command: str, latest: bool) -> Relation:
        guards = []
        columns = {f.name for f in rel.fields}
        if self.valid_time is not None and self._travels and not latest and {"valid_from", "valid_to"} <= columns:
            at = self.valid_time.sql
            guards.append(f"(valid_from <= {at} AND (valid_to IS NULL OR {at} < valid_to))")
        if t is not None and (policy := self._policy_guard(t, command, "using")) is not None:
            guards.append(f"({policy})")
        # without the alias Spark reads "WHERE (name)" as an alias with columns
        return Relation(f"(SELECT * FROM {rel.sql} AS fenced WHERE {' AND '.join(guards)})", rel.fields) if guards else rel

    def _system(self, table: str) -> DataFrame:
        catalog = self.log.catalog
        seen = [n for n in catalog.tables if self._may("select", n)]
        if table == "pg_fault_log":  # storage is the object store's: it heals its own faults
            return self.spark.createDataFrame([], "seq bigint, page bigint, kind string")
        if table.endswith("tables"):
            rows = [(n, "BASE TABLE") for n in seen] + [(n, "VIEW") for n in catalog.views] + [(n, "BASE TABLE") for n in self.attached]
            return self.spark.createDataFrame(rows, "table_name string, table_type string")
        rows = [(n, c.name, i, c.type.upper(), "NO" if c.not_null else "YES") for n in seen for i, c in enumerate(catalog.tables[n].columns, 1)]
        for n, df in self.attached.items():
            rows += [(n, f.name, i, of_spark(f.dataType)[0].upper(), "YES") for i, f in enumerate(df.schema, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position bigint, data_type string, is_nullable string")

    # queries
    def _rows(self, q: Query, params: list | None = None) -> Outcome:
        if q.recursive and any(self._refers(sub.body, cte) for cte, sub in q.ctes):
            return self._recursive(q, params)
        if self.vector_index and (hit := self._indexed(q)) is not None:
            return hit
        sql, fields = self._emitter(params).query(q)
        return Outcome("rows", self.spark.sql(sql), fields=fields)

    @classmethod
    def _refers(cls, node, cte: str) -> bool:
        if isinstance(node, SetOp):
            return cls._refers(node.left, cte) or cls._refers(node.right, cte)
        return cte in tables_of(node)

    def _recursive(self, q: Query, params: list | None) -> Outcome:
        """Recursive queries to their fixpoint; every round is written, so its lineage is one read long."""
        scratch = Scratch(self.spark, "recursive")
        emitter = self._emitter(params)
        emitter.ctes.append({})
        for cte, sub in q.ctes:
            if not self._refers(sub.body, cte):
                sql, fields = emitter.query(sub)
                emitter.ctes[-1][cte] = Relation(f"({sql})", fields)
                continue
            body = sub.body
            if not isinstance(body, SetOp) or body.op != "union" or self._refers(body.left, cte):
                raise SqlError("a recursive query is an anchor UNION [ALL] a recursive part")
            sql, fields = emitter.set_op(body.left, None)
            names = [f.name for f in fields]
            work = self.spark.sql(sql).toDF(*names)
            work = scratch.write(f"{cte}-0", work if body.all else work.distinct())
            found, total, step = [work], work.count(), 0
            while True:
                if total > MOST_RECURSIVE_ROWS:
                    raise SqlError(f"the recursive query {cte} gives more than {MOST_RECURSIVE_ROWS} rows")
                step += 1
                emitter.ctes[-1][cte] = Relation(name(self._view(work)), fields)
                sql, _ = emitter.set_op(body.right, None)
                fresh = self.spark.sql(sql).toDF(*names)
                fresh = fresh.select(*(F.col(f"`{f.name}`").cast(w.dataType).alias(f.name) for f, w in zip(fields, work.schema)))
                if not body.all:
                    fresh = fresh.distinct().subtract(_union(found))
                work = scratch.write(f"{cte}-{step}", fresh)
                n = work.count()
                if not n:
                    break
                total += n
                found.append(work)
            emitter.ctes[-1][cte] = Relation(name(self._view(_union(found))), fields)
        rest = Query(q.body, q.order, q.limit, q.offset)
        sql, fields = emitter.query(rest)
        return Outcome("rows", self.spark.sql(sql), fields=fields)

    def _indexed(self, q: Query) -> Outcome | None:
        """A nearest-neighbour query of the indexable shape, answered from cells near the query and ranked exactly."""
        from tidemark.operators import ann

        s = q.body
        plain = isinstance(s, Select) and isinstance(s.source, TableRef) and s.source.name in self.log.catalog.tables and not (s.where or s.group or s.having or s.distinct)
        if not plain or q.ctes or q.offset or q.limit is None or len(q.order) != 1 or q.order[0][1] or self.transaction_time is not None or self.valid_time is not None:
            return None
        e = q.order[0][0]
        if not isinstance(e, Binary) or e.op not in ann.METRICS or not isinstance(e.right, Lit) or any(isinstance(x, Func) and (x.over or x.name in AGGREGATES) for x, _ in s.items):
            return None
        t = self.log.catalog.tables[s.source.name]
        column = getattr(e.left, "name", None)
        c = t.column(column) if column else None
        if c is None or c.type != "vector" or self._policy_guard(t, "select", "using") is not None:
            return None
        if self.log.staged is not None:
            return None  # the index knows committed files only
        index = self._vector_index(t, column, e.op)
        query = [float(x) for x in str(e.right.value).strip("[] ").split(",")]
        near = index.candidates(query).drop("_key")
        self._views_for = self._frame_relation(near, t.fields)
        emitter = self._emitter()
        emitter.relation = lambda _n, rel=self._views_for: rel
        sql, fields = emitter.query(q)
        return Outcome("rows", self.spark.sql(sql), fields=fields)

    def _vector_index(self, t: Table, column: str, metric: str):
        """The inverted file of a column, kept beside the log: files committed since the last search are put in or taken out.

        A table whose files were replaced has its index built anew.
        """
        from tidemark.operators import ann

        folder = f"index-{t.name}-{column}-{ann.METRICS.index(metric)}"
        key = F.concat_ws(":", STATEMENT, ROW).alias("_key")
        rows = lambda df: df.select(key, *(F.col(f"`{n}`") for n in t.names))
        now = {"names": list(t.names), "inserts": [p for _, _, p in t.inserts], "deletes": [p for _, _, p in t.deletes], "cuts": t.cuts}
        known = json.loads(self.log.files.read(f"{folder}/state.json") or "null")
        if known and known["names"] == now["names"] and known["cuts"] == now["cuts"] and set(known["inserts"]) <= set(now["inserts"]) and set(known["deletes"]) <= set(now["deletes"]):
            now["path"] = known["path"]
            index = self._indexes.get(now["path"]) or ann.IvfIndex(self.spark, f"{self.log.files.root}/{now['path']}")
            fresh = [p for p in now["inserts"] if p not in known["inserts"]]
            ended = [p for p in now["deletes"] if p not in known["deletes"]]
            if fresh:
                index.insert(rows(self.log.rows_of(t, fresh)))
            if ended:
                index.remove(self.log.ended_by(ended).select(key))
        else:
            fresh = ended = [""]
            now["path"] = f"{folder}/{uuid.uuid4().hex[:8]}"
            index = ann.IvfIndex.build(rows(self.log.read(t)), column, "_key", metric, f"{self.log.files.root}/{now['path']}")
        if fresh or ended:
            self.log.files.replace(f"{folder}/state.json", json.dumps(now))
        self._indexes = {now["path"]: index}
        return index

    def knn(self, table: str, column: str, query: list[float], k: int, metric: str = "<->") -> DataFrame:
        """The ``k`` rows of ``table`` nearest to ``query``; the fences of the role hold."""
        text = "[" + ",".join(map(str, query)) + "]"
        return self.sql(f"SELECT * FROM {table} ORDER BY \"{column}\" {metric} VECTOR '{text}' LIMIT {k}")

    # privileges
    def _roles(self, role: str | None = None) -> set[str]:
        out, todo = {"public"}, [role or self.role]
        while todo:
            r = todo.pop()
            if r not in out:
                out.add(r)
                todo += self.log.catalog.roles[r].member_of if r in self.log.catalog.roles else []
        return out

    def _super(self) -> bool:
        r = self.log.catalog.roles.get(self.role)
        return r is not None and r.superuser

    def _may(self, privilege: str, table: str) -> bool:
        t = self.log.catalog.tables.get(table)
        return t is None or self._super() or t.owner in self._roles() or any(privilege in t.grants.get(r, ()) for r in self._roles())

    def _demand(self, privilege: str, table: str) -> None:
        if not self._may(privilege, table):
            raise PermissionDenied(f"permission denied: {privilege.upper()} on {table}")

    def _own(self, table: str) -> None:
        t = self.log.catalog.tables.get(table)
        if t is not None and not self._super() and t.owner not in self._roles():
            raise PermissionDenied(f"only the owner may change {table}")

    def _check_read(self, tree) -> None:
        for table in sorted(tables_of(tree)):
            if table in self.log.catalog.views:
                self._check_read(parse(self.log.catalog.views[table]["text"]))
            else:
                self._demand("select", table)

    def _authorize(self, s: Statement) -> None:
        kind = s.kind
        if kind in ("insert", "update", "delete", "truncate"):
            self._demand(kind, s.table)
            if kind == "insert" and s.query is not None:
                self._check_read(s.query)
            if kind == "insert" and s.conflict and s.conflict["do"] == "update":
                self._demand("update", s.table)
            if kind in ("update", "delete") and (s.where is not None or s.returning):
                self._demand("select", s.table)
            for sub in ([s.where] if kind in ("update", "delete") else []) + ([e for _, e in s.set] if kind == "update" else []):
                for table in sorted(tables_of(sub)):
                    self._demand("select", table)
        elif kind == "copy":
            self._demand("select" if s.out else "insert", s.table)
        elif kind in ("create_as", "explain"):
            self._check_read(s.query)
        elif kind in ("add_column", "drop_column", "rename_column", "rename_table", "row_security", "create_index", "create_policy"):
            self._own(s.table)
        elif kind in ("drop_table",):
            self._own(s.name)
        elif kind == "drop_policy":
            self._own(s.table)
        elif kind in ("create_role", "alter_role", "drop_role"):
            mine = self.log.catalog.roles.get(self.role)
            if not self._super() and not (mine and mine.createrole) or (s.parts.get("options", {}).get("superuser") and not self._super()):
                raise PermissionDenied(f"permission denied: {kind.replace('_', ' ').upper()}")
        elif kind in ("grant", "revoke"):
            if s.table is not None:
                self._own(s.table)
            elif not self._super() and not getattr(self.log.catalog.roles.get(self.role), "createrole", False):
                raise PermissionDenied("permission denied: GRANT of a role")

    def _policy_guard(self, t: Table, command: str, which: str) -> str | None:
        """The policies' condition as Spark SQL, or None where no policy binds the role."""
        me = self.log.catalog.roles.get(self.role)
        if not t.rls or (me and (me.superuser or me.bypassrls)) or (t.owner in self._roles() and not t.force):
            return None
        scope = Scope([("", t.fields)])
        mine = self._roles()
        parts = []
        for p in t.policies:
            if p.command in ("all", command) and {r.lower() if r.lower() == "public" else r for r in p.to} & mine:
                text = (p.check or p.using) if which == "check" else p.using
                if text is not None:
                    parts.append(self._emitter().truth(parse_expression(text), scope))
        return " OR ".join(f"coalesce({p}, false)" for p in parts) if parts else "false"

    # writing
    def _coerce(self, x: Typed, c: Column) -> str:
        """The conversions a write makes by itself; any other mix of types is an error."""
        ok = x.type in (c.type, "null") or (x.type, c.type) in {
            ("text", "date"), ("text", "timestamp"), ("text", "json"), ("text", "decimal"), ("text", "vector"), ("date", "timestamp"), ("int", "decimal"), ("float", "decimal"), ("int", "float"), ("json", "text"),
        }
        if not ok:
            raise SqlError(f"column {c.name} is {c.type.upper()}, not {x.type.upper()}")
        if x.type == "text" and c.type in ("date", "timestamp", "json", "vector"):
            sql = casts.cast(x, c.type).sql
        elif c.type == "decimal" and x.type in ("text", "float"):
            sql = casts.cast(x, "decimal", (38, c.scale)).sql
        else:
            sql = x.sql
        sql = f"CAST({sql} AS {c.spark})"
        if c.type == "vector" and c.width:
            wrong = f"CAST(raise_error('column {c.name} takes vectors of width {c.width}') AS {c.spark})"
            sql = f"CASE WHEN {sql} IS NULL OR size({sql}) = {c.width} THEN {sql} ELSE {wrong} END"
        return sql

    def _table(self, table: str) -> Table:
        if table not in self.log.catalog.tables:
            raise SqlError(f"unknown table {table}" if table not in self.attached else f"{table} is read only")
        return self.log.catalog.tables[table]

    def _fill(self, t: Table, given: list[str]) -> dict[str, str]:
        """Defaults of the columns that aren't given, as Spark SQL."""
        out = {}
        for c in t.columns:
            if c.name not in given and not c.serial:
                x = self._emitter().expr(parse_expression(c.default), Scope([])) if c.default else Typed("NULL", "null")
                out[c.name] = self._coerce(x, c)
        return out

    def _serials(self, t: Table, rows: DataFrame, given: list[str]) -> DataFrame:
        """The next numbers for SERIAL columns that aren't given, dense, counted per partition."""
        missing = [c.name for c in t.columns if c.serial and c.name not in given]
        if not missing:
            return rows
        scratch = Scratch(self.spark, "serial")
        held = scratch.write("rows", rows.withColumn("_n", F.monotonically_increasing_id()))
        part = F.shiftright("_n", 33)
        counts = sorted((r[0], r[1]) for r in held.groupBy(part.alias("p")).count().collect())  # one row per partition
        offsets, total = [], 0
        for p, n in counts:
            offsets.append((p, total))
            total += n
        table = F.broadcast(self.spark.createDataFrame(offsets or [(0, 0)], "_p bigint, _offset bigint"))
        held = held.join(table, part == F.col("_p")).withColumn("_at", F.col("_offset") + F.col("_n").bitwiseAND((1 << 33) - 1) + 1)
        now = self._peaks(t, missing)
        for m in missing:
            held = held.withColumn(m, F.col("_at") + F.lit(now[m] or 0))
        return held.drop("_n", "_p", "_offset", "_at")

    def _peaks(self, t: Table, columns: list[str]) -> dict[str, int]:
        """The greatest number held in SERIAL columns: kept with the table, and looked up again only after rows were ended."""
        if t.peaks.get("at") != [len(t.inserts), len(t.deletes), len(t.cuts)] or not set(columns) <= set(t.peaks["of"]):
            every = [c.name for c in t.columns if c.serial]
            got = self.log.read(t).agg(*(F.max(f"`{c}`").alias(c) for c in every)).first()
            t.peaks = {"at": [len(t.inserts), len(t.deletes), len(t.cuts)], "of": {c: got[c] or 0 for c in every}}
        return t.peaks["of"]

    def _raise_peaks(self, t: Table, added: DataFrame) -> None:
        """After an insert: the peaks with the new rows, if they were known before it."""
        if t.peaks.get("at") == [len(t.inserts) - 1, len(t.deletes), len(t.cuts)]:
            of = t.peaks["of"]
            got = added.agg(*(F.max(f"`{c}`").alias(c) for c in of)).first()
            t.peaks = {"at": [len(t.inserts), len(t.deletes), len(t.cuts)], "of": {c: max(n, got[c] or 0) for c, n in of.items()}}

    def _do_insert(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        given = s.columns or t.names
        columns = [t.column(c) for c in given]
        if None in columns:
            raise SqlError(f"unknown column {given[columns.index(None)]}")
        emitter = self._emitter(params)
        fill = self._fill(t, given)
        if s.rows is not None:
            structs = []
            for row in s.rows:
                if len(row) != len(columns):
                    raise SqlError(f"{len(row)} values for {len(columns)} columns")
                cells = [self._coerce(emitter.expr(e, Scope([])), c) for e, c in zip(row, columns)]
                pairs = [f"{text_literal(c.name)}, {x}" for c, x in zip(columns, cells)] + [f"{text_literal(c)}, {x}" for c, x in fill.items()]
                structs.append(f"named_struct({', '.join(pairs)})")
            rows = self.spark.sql(f"SELECT inline(array({', '.join(structs)}))")
        else:
            sql, fields = emitter.query(s.query)
            if len(fields) != len(columns):
                raise SqlError(f"{len(fields)} columns for {len(columns)}")
            listed = [f"{self._coerce(Typed(name(f.name), f.type, f.scale), c)} AS {name(c.name)}" for f, c in zip(fields, columns)]
            rows = self.spark.sql(f"SELECT {', '.join(listed + [f'{x} AS {name(c)}' for c, x in fill.items()])} FROM ({sql})")
        rows = self._serials(t, rows, given)
        return self._add_rows(t, rows, s.conflict, s.returning, emitter)

    def _add_rows(self, t: Table, rows: DataFrame, conflict: dict | None, returning: list | None, emitter: Emitter) -> Outcome:
        n, path, staged = self.log.stage(t, rows)
        updated: DataFrame | None = None
        count = None
        if conflict is not None:
            self._not_null(t, staged)
            kept, updated, count = self._conflict(t, staged, conflict, emitter)
            old = path
            n, path, staged = self.log.stage(t, kept)
            self.log.files.delete(old)
        self._check_rows(t, staged, "insert")
        self._check_unique(t, staged, self.log.read(t))
        self.log.add(t, n, path)
        self._raise_peaks(t, staged)
        affected = staged if updated is None else staged.select(t.names).union(updated.select(t.names))
        return self._mutation(t, affected, returning, emitter, staged.count() + (count or 0))

    def _mutation(self, t: Table, affected: DataFrame, returning: list | None, emitter: Emitter, count: int) -> Outcome:
        if returning is None:
            return Outcome("mutation", count=count)
        rel = self._frame_relation(affected.select(*(F.col(f"`{c}`") for c in t.names)), t.fields)
        inner = Emitter(lambda _: rel, emitter.session, emitter.params)
        sql, fields = inner.query(Query(Select(returning, TableRef(t.name, None, None))))
        return Outcome("rows", self.spark.sql(sql), count=count, fields=fields)

    def _not_null(self, t: Table, rows: DataFrame) -> None:
        must = [c.name for c in t.columns if c.not_null]
        if must:
            bad = rows.agg(*(F.max(F.col(f"`{c}`").isNull()).alias(c) for c in must)).first()
            for c in must:
                if bad[c]:
                    raise ConstraintError(f"column {c} of {t.name} can't be null")

    def _check_rows(self, t: Table, rows: DataFrame, command: str) -> None:
        """NOT NULL, CHECK, FOREIGN KEY and policies, over the rows as they were written."""
        self._not_null(t, rows)
        scope = Scope([("", t.fields)])
        tests = [(self._emitter().truth(parse_expression(c), scope), f"check {c} of {t.name} fails") for c in t.checks]
        tests = [(f"NOT coalesce({x}, true)", m) for x, m in tests]
        guard = self._policy_guard(t, command, "check")
        if guard is not None:
            tests.append((f"NOT coalesce({guard}, false)", f"new row of {t.name} violates its row security policy"))
        if tests:
            bad = rows.agg(*(F.max(F.expr(x)).alias(f"t{i}") for i, (x, _) in enumerate(tests))).first()
            for i, (_, message) in enumerate(tests):
                if bad[f"t{i}"]:
                    raise ConstraintError(message) if "policy" not in message else PermissionDenied(message)
        for fk in t.foreign:
            parent = self._table(fk.table)
            target = fk.target or (parent.primary[0] if parent.primary else parent.names[0])
            keys = rows.select(F.col(f"`{fk.column}`").alias("k")).filter("k is not null")
            there = self.log.read(parent).select(F.col(f"`{target}`").alias("k")).join(keys, "k", "left_semi")
            if parent.name == t.name:
                there = there.union(rows.select(F.col(f"`{target}`").alias("k")))
            if (miss := keys.join(there, "k", "left_anti").first()) is not None:
                raise ConstraintError(f"{fk.column} = {miss[0]} of {t.name} is not in {fk.table}")

    def _check_unique(self, t: Table, rows: DataFrame, others: DataFrame, changed: set[str] | None = None) -> None:
        """No full key of ``rows`` may occur twice in them or in ``others``; keys without a changed column aren't looked at.

        The new keys are the side that is built or sent, so a large table is
        scanned but not shuffled for a small write.
        """
        for cols in t.uniques:
            if changed is not None and not changed & set(cols):
                continue
            key = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)]
            ks = [f"k{i}" for i in range(len(cols))]
            fresh = rows.select(*key).dropna()
            hit = fresh.groupBy(*ks).count().filter("count > 1").first() or others.select(*key).join(fresh, ks, "left_semi").first()
            if hit is not None:
                raise ConstraintError(f"duplicate key ({', '.join(cols)}) = ({', '.join(str(hit[k]) for k in ks)}) in {t.name}")

    @staticmethod
    def _held(now: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
        """The keys of ``rows`` that ``now`` has: as small as the write, whatever the size of the table."""
        keys = [F.col(f"`{c}`") for c in cols]
        return now.select(*keys).join(rows.select(*keys).dropna(), cols, "left_semi").distinct()

    def _conflict(self, t: Table, staged: DataFrame, conflict: dict, emitter: Emitter) -> tuple[DataFrame, DataFrame | None, int]:
        """The rows to add, the rows updated, and how many."""
        targets = [conflict["target"]] if conflict["target"] else t.uniques
        if conflict["do"] != "nothing" and not targets:
            raise SqlError("ON CONFLICT needs a target")
        for cols in targets:
            for c in cols:
                if t.column(c) is None:
                    raise SqlError(f"unknown column {c}")
        rows, now = staged, self.log.read(t)
        if conflict["do"] == "nothing":
            for cols in targets:
                rows = self._first_of(rows, cols)
                rows = rows.join(self._held(now, rows, cols), cols, "left_anti").select(staged.columns)
            return rows, None, 0
        cols = targets[0]
        if conflict["do"] == "assert":
            self._assert(t, rows, now, cols)
            first = self._first_of(rows, cols)
            return first.join(self._held(now, first, cols), cols, "left_anti").select(staged.columns), None, 0
        there = Scratch(self.spark, "held").write("keys", self._held(now, rows, cols))
        fresh = rows.join(there, cols, "left_anti").select(staged.columns)
        full = fresh.dropna(subset=cols)
        if (twice := full.groupBy(*cols).count().filter("count > 1").first()) is not None:
            raise SqlError(f"ON CONFLICT DO UPDATE can't touch the new row {tuple(twice)[:-1]} twice")
        hits = rows.join(there, cols, "left_semi").select(*(F.col(f"`{c}`") for c in t.names), ROW)
        updated, count = self._upsert(t, hits, now, cols, conflict, emitter)
        return fresh, updated, count

    def _first_of(self, rows: DataFrame, cols: list[str]) -> DataFrame:
        """Of rows with equal full keys the first; keys with a null never conflict."""
        some = F.greatest(*(F.col(f"`{c}`").isNull().cast("int") for c in cols)) == 1 if len(cols) > 1 else F.col(f"`{cols[0]}`").isNull()
        best = rows.filter(~some).groupBy(*cols).agg(F.min(ROW).alias(ROW)).select(ROW)
        return rows.join(best, ROW, "left_semi").select(rows.columns).union(rows.filter(some).select(rows.columns))

    def _assert(self, t: Table, rows: DataFrame, now: DataFrame, cols: list[str]) -> None:
        """Every row must equal what is held under its key, or the first of its key in the statement."""
        others = [c for c in t.names if c not in cols]
        held = now.select(*(F.col(f"`{c}`") for c in t.names)).join(rows.select(*cols).distinct(), cols, "left_semi").select(*(F.col(f"`{c}`") for c in t.names))
        first = self._first_of(rows, cols).join(held.select(*cols), cols, "left_anti").select(*(F.col(f"`{c}`") for c in t.names))
        base = held.union(first).select(*cols, *(F.col(f"`{c}`").alias(f"was {c}") for c in others))
        for c in others:
            bad = rows.join(base, cols).filter(~F.col(f"`{c}`").eqNullSafe(F.col(f"`was {c}`"))).select(*cols, F.col(f"`was {c}`"), F.col(f"`{c}`")).first()
            if bad is not None:
                key = ", ".join(f"{k} = {bad[i]}" for i, k in enumerate(cols))
                raise ConstraintError(f"contradiction in {c} of ({key}): held {bad[len(cols)]!r}, asserted {bad[len(cols) + 1]!r}")

    def _upsert(self, t: Table, hits: DataFrame, now: DataFrame, cols: list[str], conflict: dict, emitter: Emitter) -> tuple[DataFrame | None, int]:
        """DO UPDATE on held rows. Hits of one row apply in the order of the statement, up to FOLD of them in one pass over its key.

        A pass folds the hits of a key from the held row on. Only where a
        policy must see every row between two hits, or an expression asks
        another table, a pass takes one hit of each key.
        """
        guard = self._policy_guard(t, "update", "using")
        at_once = 1 if guard is not None or _asks_tables([e for _, e in conflict["set"]] + [conflict["where"]]) else FOLD
        scratch = Scratch(self.spark, "upsert")
        hits = scratch.write("hits", hits.withColumn("_pass", F.floor((F.row_number().over(_window(cols, ROW)) - 1) / at_once)))
        passes = hits.agg(F.max("_pass")).first()[0]
        if passes is None:
            return None, 0
        keys = hits.select(*cols).distinct()
        held = now.join(keys, cols, "left_semi").withColumn("_touched", F.lit(False))
        current = scratch.write("current", held.select(*(F.col(f"`{c}`") for c in t.names), ROW, STATEMENT, "_touched"))
        for i in range(passes + 1):
            new = hits.filter(F.col("_pass") == i)
            if guard is not None and current.join(new.select(*cols), cols, "left_semi").filter(F.expr(f"NOT coalesce({guard}, false)")).first() is not None:
                raise PermissionDenied(f"a held row of {t.name} is outside of its row security policy")
            step = self._fold(t, current, new, cols, conflict, emitter) if at_once > 1 else self._apply(t, current, new, cols, conflict, emitter)
            current = scratch.write(f"current{i}", step)
        touched = scratch.write("touched", current.filter("_touched").drop("_touched"))
        count = touched.count()
        if count:
            self._replace(t, touched, now, {c for c, _ in conflict["set"]})
        return touched, count

    def _values(self, t: Table, conflict: dict, emitter: Emitter, held: str, new: str) -> tuple[dict[str, str], str]:
        """What DO UPDATE makes of each column, and when, over a held and a new row under these names."""
        outer = Scope([(t.name, t.fields), ("excluded", t.fields)])

        class Held(Scope):
            def find(self, table: str | None, column: str) -> Typed:
                found = outer.find(table or t.name, column)
                return Typed(f"{held if (table or t.name) != 'excluded' else new}.{name(column)}", found.type, found.scale)

        scope = Held(outer.tables)
        values = {c: f"{held}.{name(c)}" for c in t.names}
        for c, e in conflict["set"]:
            column = t.column(c)
            if column is None:
                raise SqlError(f"unknown column {c}")
            values[c] = f"CAST({self._coerce(emitter.expr(e, scope), column)} AS {column.spark})"
        return values, f"coalesce({emitter.expr(conflict['where'], scope).sql}, false)" if conflict["where"] is not None else "true"

    def _fold(self, t: Table, current: DataFrame, new: DataFrame, cols: list[str], conflict: dict, emitter: Emitter) -> DataFrame:
        """Each held row after its hits of one pass, at most FOLD of them, in order."""
        values, when = self._values(t, conflict, emitter, "_held", "_new")
        row = F.struct(F.col(ROW).alias("_order"), *(F.col(f"`{c}`") for c in t.names))
        listed = new.groupBy(*cols).agg(F.sort_array(F.collect_list(F.struct(F.col(ROW).alias("_order"), row.alias("_hit")))).alias("_hits"))
        start = "named_struct(" + ", ".join(f"{text_literal(c)}, {name(c)}" for c in t.names) + ", '_touched', _touched)"
        after = "named_struct(" + ", ".join(f"{text_literal(c)}, {x}" for c, x in values.items()) + ", '_touched', true)"
        step = f"aggregate(transform(_hits, h -> h._hit), {start}, (_held, _new) -> IF({when}, {after}, _held))"
        both = current.join(listed, cols, "left")
        folded = both.withColumn("_after", F.expr(f"IF(_hits IS NULL, {start}, {step})"))
        return folded.select(*(F.col(f"_after.`{c}`").alias(c) for c in t.names), ROW, STATEMENT, "_after._touched")

    def _apply(self, t: Table, current: DataFrame, new: DataFrame, cols: list[str], conflict: dict, emitter: Emitter) -> DataFrame:
        """Each held row after at most one hit."""
        values, when = self._values(t, conflict, emitter, name(t.name), "excluded")
        left, right = self._view(current), self._view(new.select(*(F.col(f"`{c}`") for c in t.names)))
        on = " AND ".join(f"{name(t.name)}.{name(c)} = excluded.{name(c)}" for c in cols)
        listed = ", ".join(f"{x} AS {name(c)}" for c, x in values.items())
        ids = f"{name(t.name)}.{ROW}, {name(t.name)}.{STATEMENT}"
        step = self.spark.sql(f"SELECT {listed}, {ids}, true AS _touched FROM {left} AS {name(t.name)} JOIN {right} AS excluded ON {on} WHERE {when}")
        return current.join(step.select(ROW, STATEMENT), [ROW, STATEMENT], "left_anti").select(step.columns).union(step)

    def _replace(self, t: Table, rows: DataFrame, now: DataFrame, changed: set[str]) -> tuple[int, DataFrame]:
        """End the versions of ``rows`` and add their new values, with the checks and referential actions that ``changed`` columns call for."""
        old = now.join(rows.select(ROW, STATEMENT), [ROW, STATEMENT], "left_semi").select(now.columns)
        n, path, staged = self.log.stage(t, rows)
        self._check_rows(t, staged, "update")
        rest = now.join(rows.select(ROW, STATEMENT), [ROW, STATEMENT], "left_anti").select(now.columns)
        self._check_unique(t, staged, rest, changed)
        self._children(t, old, rows, "update", changed)
        self.log.end(t, rows)
        self.log.add(t, n, path)
        return n, staged

    def _children(self, t: Table, old: DataFrame, new: DataFrame | None, event: str, changed: set[str] | None = None) -> None:
        """Referential actions for keys of ``t`` that go away or change."""
        for child in list(self.log.catalog.tables.values()):
            for fk in child.foreign:
                if fk.table != t.name:
                    continue
                target = fk.target or (t.primary[0] if t.primary else t.names[0])
                if changed is not None and target not in changed:
                    continue
                gone = old.select(F.col(f"`{target}`").alias("_key"), ROW, STATEMENT).filter("_key is not null")
                if new is not None:
                    moved = gone.join(new.select(F.col(f"`{target}`").alias("_to"), ROW, STATEMENT), [ROW, STATEMENT]).filter("not _key <=> _to").select("_key", "_to")
                else:
                    moved = gone.select("_key", F.lit(None).cast(gone.schema["_key"].dataType).alias("_to"))
                if moved.first() is None:
                    continue
                rows = self.log.read(child)
                if child.name == t.name and new is None:  # rows that go away themselves don't object
                    rows = rows.join(old.select(ROW, STATEMENT), [ROW, STATEMENT], "left_anti").select(rows.columns)
                hit = rows.join(moved, F.col(f"`{fk.column}`") == F.col("_key"))
                action = fk.on_delete if event == "delete" else fk.on_update
                if action in ("no action", "restrict"):
                    if (bad := hit.first()) is not None:
                        raise ConstraintError(f"{t.name}.{target} = {bad['_key']} is referenced by {child.name}.{fk.column}")
                    continue
                scratch = Scratch(self.spark, "children")
                hit = scratch.write("hit", hit)
                if not hit.count():
                    continue
                if action == "cascade" and event == "delete":
                    self._remove(child, hit.select(rows.columns))
                    continue
                value: SparkColumn = F.col("_to") if action == "cascade" else F.lit(None).cast(child.column(fk.column).spark)
                after = hit.withColumn("_value", value).select(*(F.col("_value").alias(c) if c == fk.column else F.col(f"`{c}`") for c in child.names), ROW, STATEMENT)
                n, path, staged = self.log.stage(child, after)
                self._not_null(child, staged)
                self._children(child, hit.select(rows.columns), after, "update", {fk.column})
                self.log.end(child, after)
                self.log.add(child, n, path)

    def _remove(self, t: Table, rows: DataFrame) -> None:
        self._children(t, rows, None, "delete")
        self.log.end(t, rows)

    def _matched(self, t: Table, where, command: str, emitter: Emitter) -> DataFrame:
        df = self.log.read(t)
        guard = self._policy_guard(t, command, "using")
        parts = [emitter.truth(where, Scope([(t.name, t.fields)]))] if where is not None else []
        if guard is not None:
            parts.append(f"({guard})")
        v = self._view(df)
        sql = f"SELECT * FROM {v} AS {name(t.name)}" + (f" WHERE {' AND '.join(parts)}" if parts else "")
        return self.spark.sql(sql)

    def _do_update(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        emitter = self._emitter(params)
        rows = self._matched(t, s.where, "update", emitter)
        scope = Scope([(t.name, t.fields)])
        values = {c: f"{name(t.name)}.{name(c)}" for c in t.names}
        for c, e in s.set:
            column = t.column(c)
            if column is None:
                raise SqlError(f"unknown column {c}")
            values[c] = self._coerce(emitter.expr(e, scope), column)
        v = self._view(rows)
        listed = ", ".join(f"{x} AS {name(c)}" for c, x in values.items())
        scratch = Scratch(self.spark, "update")
        new = scratch.write("new", self.spark.sql(f"SELECT {listed}, {ROW}, {STATEMENT} FROM {v} AS {name(t.name)}"))
        count = new.count()
        affected = new
        if count:
            _, affected = self._replace(t, new, self.log.read(t), {c for c, _ in s.set})
        return self._mutation(t, affected, s.returning, emitter, count)

    def _do_delete(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        emitter = self._emitter(params)
        scratch = Scratch(self.spark, "delete")
        rows = scratch.write("old", self._matched(t, s.where, "delete", emitter))
        count = rows.count()
        if count:
            self._remove(t, rows)
        return self._mutation(t, rows, s.returning, emitter, count)

    def _do_truncate(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        rows = self.log.read(t)
        count = rows.count()
        if count:
            self._children(t, rows, None, "delete")
            self.log.cut(t)
        return Outcome("mutation", count=count)

    def _do_copy(self, s: Statement, params: list | None) -> Outcome:
        from tidemark.sources import csv

        if s.out:
            rel = self._relation(s.table)
            df = self.spark.sql(f"SELECT * FROM {rel.sql}")
            count = csv.write_csv(df, rel.fields, s.path, s.header)
            return Outcome("message", count=count, message=f"COPY {count}")
        t = self._table(s.table)
        raw = csv.read_csv(self.spark, s.path, t.names, s.header)
        listed = []
        for c in t.columns:
            x = Typed(f"nullif({name(c.name)}, '')", "text")
            listed.append(f"{self._coerce(x if c.type in ('text', 'json', 'date', 'timestamp', 'decimal', 'vector') else casts.cast(x, c.type), c)} AS {name(c.name)}")
        rows = self.spark.sql(f"SELECT {', '.join(listed)} FROM {self._view(raw)}")
        return self._add_rows(t, rows, None, None, self._emitter())

    # definitions
    def _taken(self, table: str) -> bool:
        return table in self.log.catalog.tables or table in self.log.catalog.views or table in self.attached

    def _do_create_table(self, s: Statement, params: list | None) -> Outcome:
        if self._taken(s.table):
            if s.missing:
                return Outcome("ddl", message="exists")
            raise SqlError(f"{s.table} exists")
        defs: list[ColumnDef] = s.columns
        if len({d.name for d in defs}) < len(defs):
            raise SqlError("a column is named twice")
        t = Table(s.table, [Column.of(d) for d in defs], self.role)
        for d in defs:
            if d.primary:
                t.primary = [d.name]
            if d.unique:
                t.uniques.append([d.name])
            if d.check:
                t.checks.append(d.check)
            if d.references:
                t.foreign.append(d.references)
        for cols, primary in s.uniques:
            t.uniques.append(cols)
            if primary:
                t.primary = cols
                for c in t.columns:
                    c.not_null |= c.name in cols
        t.checks += s.checks
        t.foreign += s.foreign
        for c in {c for cols in t.uniques for c in cols} | {fk.column for fk in t.foreign}:
            if t.column(c) is None:
                raise SqlError(f"unknown column {c}")
        for fk in t.foreign:
            parent = t if fk.table == t.name else self._table(fk.table)
            if fk.target and parent.column(fk.target) is None:
                raise SqlError(f"unknown column {fk.table}.{fk.target}")
        for c in t.checks:
            self._emitter().truth(parse_expression(c), Scope([("", t.fields)]))
        self.log.catalog.tables[t.name] = t
        return Outcome("ddl", message=f"created {t.name}")

    def _do_create_as(self, s: Statement, params: list | None) -> Outcome:
        if self._taken(s.table):
            if s.missing:
                return Outcome("ddl", message="exists")
            raise SqlError(f"{s.table} exists")
        out = self._rows(s.query, params)
        columns = [Column(f.name, "int" if f.type == "null" else f.type, f.name, f.scale) for f in out.fields]
        t = Table(s.table, columns, self.role)
        self.log.catalog.tables[t.name] = t
        n, path, staged = self.log.stage(t, out.frame)
        self.log.add(t, n, path)
        return Outcome("mutation", count=staged.count())

    def _do_create_view(self, s: Statement, params: list | None) -> Outcome:
        if self._taken(s.name):
            raise SqlError(f"{s.name} exists")
        self._emitter().query(parse(s.text))
        self.log.catalog.views[s.name] = {"text": s.text, "owner": self.role}
        return Outcome("ddl", message=f"created {s.name}")

    def _do_create_index(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        for c in s.columns:
            if t.column(c) is None:
                raise SqlError(f"unknown column {c}")
        if any(s.name in x.indexes for x in self.log.catalog.tables.values()):
            raise SqlError(f"{s.name} exists")
        if s.unique:
            t.uniques.append(s.columns)
            rows = self.log.read(t)
            self._check_unique(t, rows, rows.limit(0))
        t.indexes[s.name] = {"columns": s.columns, "unique": s.unique}
        return Outcome("ddl", message=f"created {s.name}")

    def _do_drop_table(self, s: Statement, params: list | None) -> Outcome:
        if s.name not in self.log.catalog.tables:
            if s.there:
                return Outcome("ddl", message="not there")
            raise SqlError(f"unknown table {s.name}")
        for other in self.log.catalog.tables.values():
            if other.name != s.name and any(fk.table == s.name for fk in other.foreign):
                raise ConstraintError(f"{s.name} is referenced by {other.name}")
        del self.log.catalog.tables[s.name]
        return Outcome("ddl", message=f"dropped {s.name}")

    def _do_drop_view(self, s: Statement, params: list | None) -> Outcome:
        if s.name not in self.log.catalog.views and not s.there:
            raise SqlError(f"unknown view {s.name}")
        self.log.catalog.views.pop(s.name, None)
        return Outcome("ddl", message=f"dropped {s.name}")

    def _bound(self, t: Table, column: str) -> bool:
        """Whether a constraint names the column."""
        checks = any(column in {tok for tok in _words(c)} for c in t.checks)
        keys = any(fk.column == column for fk in t.foreign) or any(fk.table == t.name and (fk.target or (t.primary or t.names)[0]) == column for x in self.log.catalog.tables.values() for fk in x.foreign)
        return checks or keys

    def _rewrite(self, t: Table, rows: DataFrame) -> None:
        """The table's rows into fresh files; its history ends here."""
        t.inserts, t.deletes, t.cuts, t.peaks = [], [], [], {}
        n, path, _ = self.log.stage(t, rows)
        self.log.add(t, n, path)

    def _do_add_column(self, s: Statement, params: list | None) -> Outcome:
        t, d = self._table(s.table), s.column
        if t.column(d.name):
            raise SqlError(f"{d.name} exists")
        old = self.log.read(t)
        c = Column.of(d, f"{d.name}_{self.log.catalog.next_statement}")
        x = self._emitter().expr(parse_expression(d.default), Scope([])) if d.default else Typed("NULL", "null")
        rows = old.withColumn(d.name, F.expr(self._coerce(x, c)))
        t.columns.append(c)
        if c.not_null:
            self._not_null(t, rows)
        if d.unique:
            t.uniques.append([d.name])
        if d.check:
            t.checks.append(d.check)
        if d.references:
            t.foreign.append(d.references)
        if d.default or d.serial:
            self._rewrite(t, rows)  # else files without the column read as null
        return Outcome("ddl", message=f"added {d.name}")

    def _do_drop_column(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        if t.column(s.name) is None:
            if s.there:
                return Outcome("ddl", message="not there")
            raise SqlError(f"unknown column {s.name}")
        if self._bound(t, s.name):
            raise ConstraintError(f"a constraint names {s.name}")
        if len(t.columns) == 1:
            raise SqlError("a table keeps one column")
        t.columns = [c for c in t.columns if c.name != s.name]  # the files keep it, and no read asks for it
        t.uniques = [u for u in t.uniques if s.name not in u]
        t.primary = [] if s.name in t.primary else t.primary
        t.indexes = {k: v for k, v in t.indexes.items() if s.name not in v["columns"]}
        t.peaks = {}
        return Outcome("ddl", message=f"dropped {s.name}")

    def _do_rename_column(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        c = t.column(s.name)
        if c is None or t.column(s.to):
            raise SqlError(f"unknown column {s.name}" if c is None else f"{s.to} exists")
        if self._bound(t, s.name):
            raise ConstraintError(f"a constraint names {s.name}")
        c.name, t.peaks = s.to, {}
        swap = lambda cols: [s.to if x == s.name else x for x in cols]
        t.uniques, t.primary = [swap(u) for u in t.uniques], swap(t.primary)
        for v in t.indexes.values():
            v["columns"] = swap(v["columns"])
        return Outcome("ddl", message=f"renamed {s.name}")

    def _do_rename_table(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        if self._taken(s.to):
            raise SqlError(f"{s.to} exists")
        if any(fk.table == t.name for x in self.log.catalog.tables.values() for fk in x.foreign):
            raise ConstraintError(f"{t.name} is referenced")
        del self.log.catalog.tables[t.name]
        t.name = s.to
        self.log.catalog.tables[s.to] = t
        return Outcome("ddl", message=f"renamed {s.table}")

    # roles
    def _do_create_role(self, s: Statement, params: list | None) -> Outcome:
        if s.name in self.log.catalog.roles:
            raise SqlError(f"role {s.name} exists")
        self.log.catalog.roles[s.name] = Role(s.name)
        return self._do_alter_role(s, params)

    def _do_alter_role(self, s: Statement, params: list | None) -> Outcome:
        from tidemark.store.secrets import password_record

        role = self.log.catalog.roles.get(s.name)
        if role is None:
            raise SqlError(f"unknown role {s.name}")
        for k, v in s.options.items():
            setattr(role, k, password_record(v) if k == "password" else v)
        return Outcome("ddl", message=f"role {s.name}")

    def _do_drop_role(self, s: Statement, params: list | None) -> Outcome:
        if s.name not in self.log.catalog.roles and not s.there:
            raise SqlError(f"unknown role {s.name}")
        if any(t.owner == s.name for t in self.log.catalog.tables.values()):
            raise SqlError(f"role {s.name} owns tables")
        self.log.catalog.roles.pop(s.name, None)
        for r in self.log.catalog.roles.values():
            r.member_of = [m for m in r.member_of if m != s.name]
        for t in self.log.catalog.tables.values():
            t.grants.pop(s.name, None)
        return Outcome("ddl", message=f"dropped {s.name}")

    def _grantee(self, r: str) -> str:
        if r.lower() == "public":
            return "public"
        if r not in self.log.catalog.roles:
            raise SqlError(f"unknown role {r}")
        return r

    def _do_grant(self, s: Statement, params: list | None, give: bool = True) -> Outcome:
        for r in map(self._grantee, s.to):
            if s.table is None:
                for what in s.what:
                    if what not in self.log.catalog.roles:
                        raise SqlError(f"unknown role {what}")
                    if give and r in self._roles(what):
                        raise SqlError(f"{what} is a member of {r}")
                    members = self.log.catalog.roles[r].member_of
                    self.log.catalog.roles[r].member_of = [*dict.fromkeys([*members, what])] if give else [m for m in members if m != what]
                continue
            what = set(PRIVILEGES) if "all" in s.what else set(s.what)
            if what - set(PRIVILEGES):
                raise SqlError(f"unknown privilege {sorted(what - set(PRIVILEGES))[0]}")
            t = self._table(s.table)
            held = set(t.grants.get(r, ()))
            t.grants[r] = sorted(held | what if give else held - what)
        return Outcome("ddl", message="granted" if give else "revoked")

    def _do_revoke(self, s: Statement, params: list | None) -> Outcome:
        return self._do_grant(s, params, False)

    def _do_row_security(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        t.rls = t.rls if s.rls is None else s.rls
        t.force = t.force if s.force is None else s.force
        return Outcome("ddl", message=f"row security of {t.name}")

    def _do_create_policy(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        if any(p.name == s.name for p in t.policies):
            raise SqlError(f"policy {s.name} exists")
        if s.parts["for"] not in ("all", "select", "insert", "update", "delete"):
            raise SqlError(f"unknown command {s.parts['for']}")
        for text in (s.using, s.check):
            if text is not None:
                self._emitter().truth(parse_expression(text), Scope([("", t.fields)]))
        t.policies.append(Policy(s.name, s.parts["for"], s.to, s.using, s.check))
        return Outcome("ddl", message=f"policy {s.name}")

    def _do_drop_policy(self, s: Statement, params: list | None) -> Outcome:
        t = self._table(s.table)
        if not s.there and not any(p.name == s.name for p in t.policies):
            raise SqlError(f"unknown policy {s.name}")
        t.policies = [p for p in t.policies if p.name != s.name]
        return Outcome("ddl", message=f"dropped {s.name}")

    # session and transactions
    def _do_set(self, s: Statement, params: list | None) -> Outcome:
        v = s.value
        if s.name == "valid_time":
            if v is False:
                self.valid_time = None
            else:
                x = self._emitter(params).expr(v, Scope([]))
                self.valid_time = x if x.type == "timestamp" else casts.cast(x, "timestamp")
        elif s.name == "transaction_time":
            if v is not False and not (isinstance(v, Lit) and v.type == "int"):
                raise SqlError("transaction_time takes a whole number")
            self.transaction_time = None if v is False else v.value
        elif s.name == "vector_index":
            if not isinstance(v, bool):
                raise SqlError("vector_index is on or off")
            self.vector_index = v
        elif s.name == "role":
            to = self.login if v is False else v
            if to not in self.log.catalog.roles:
                raise SqlError(f"unknown role {to}")
            me = self.log.catalog.roles[self.login]
            if not me.superuser and to not in self._roles(self.login):
                raise PermissionDenied(f"{self.login} is not a member of {to}")
            self.role = to
        else:
            raise SqlError(f"unknown setting {s.name}")
        return Outcome("message", message=f"set {s.name}")

    def _do_begin(self, s: Statement, params: list | None) -> Outcome:
        if self.explicit:
            raise SqlError("a transaction is open")
        self.log.begin()
        self.explicit = True
        return Outcome("message", message="begin")

    def _do_commit(self, s: Statement, params: list | None) -> Outcome:
        if not self.explicit:
            raise SqlError("no transaction is open")
        self.explicit = False
        self.log.commit()
        return Outcome("message", message="commit")

    def _do_rollback(self, s: Statement, params: list | None) -> Outcome:
        if not self.explicit:
            raise SqlError("no transaction is open")
        self.log.rollback()
        self.explicit = False
        return Outcome("message", message="rollback")

    def _do_explain(self, s: Statement, params: list | None) -> Outcome:
        df = self._rows(s.query, params).frame
        mode = self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        lines = df._jdf.queryExecution().explainString(mode).splitlines()
        if s.analyze:
            began = time.time()
            n = df.count()
            lines.append(f"rows={n} ms={(time.time() - began) * 1000:.0f}")
        return Outcome("rows", self.spark.createDataFrame([(x,) for x in lines], "plan string"), fields=[Field("plan", "text")])

    def _do_analyze(self, s: Statement, params: list | None) -> Outcome:
        from tidemark.operators.stats import column_stats

        tables = [self._table(s.table)] if s.table else list(self.log.catalog.tables.values())
        frames = [column_stats(self.log.read(t).select(*(F.col(f"`{c}`") for c in t.names)), t.name) for t in tables]
        return Outcome("rows", _union(frames) if frames else None)

    def _do_vacuum(self, s: Statement, params: list | None) -> Outcome:
        """Rewrite tables to their live rows; what was ended can't be travelled to any more."""
        if self.explicit:
            raise SqlError("VACUUM can't run in a transaction")
        old = [p for t in self.log.committed.tables.values() for _, _, p in t.inserts + t.deletes]
        self.log.begin()
        for t in [self._table(s.table)] if s.table else list(self.log.catalog.tables.values()):
            self._rewrite(t, self.log.read(t))
        self.log.commit()
        kept = {p for t in self.log.committed.tables.values() for _, _, p in t.inserts + t.deletes}
        for p in old:
            if p not in kept:
                self.log.files.delete(p)
        return Outcome("message", message="vacuum")

    # dump, restore
    def _ordered(self) -> list[Table]:
        """Tables with those they refer to before them."""
        out: list[Table] = []
        todo = sorted(self.log.catalog.tables.values(), key=lambda t: t.name)
        while todo:
            ready = [t for t in todo if all(fk.table == t.name or any(o.name == fk.table for o in out) for fk in t.foreign)]
            if not ready:
                raise SqlError("tables refer to each other in a circle")
            out += ready
            todo = [t for t in todo if t not in ready]
        return out

    def schema_sql(self) -> list[str]:
        """Statements that make the tables, indexes and views again, in an order that works."""
        out = []
        for t in self._ordered():
            parts = []
            for c in t.columns:
                kind = "SERIAL" if c.serial else {"decimal": f"DECIMAL(38,{c.scale})", "vector": f"VECTOR({c.width})" if c.width else "VECTOR"}.get(c.type, c.type.upper())
                parts.append(f'"{c.name}" {kind}' + " NOT NULL" * c.not_null + (f" DEFAULT {c.default}" if c.default else ""))
            indexed = [v["columns"] for v in t.indexes.values() if v["unique"]]
            for u in t.uniques:
                if u not in indexed:
                    parts.append(("PRIMARY KEY" if u == t.primary else "UNIQUE") + " (" + ", ".join(f'"{c}"' for c in u) + ")")
            parts += [f"CHECK ({c})" for c in t.checks]
            for fk in t.foreign:
                target = f' ("{fk.target}")' if fk.target else ""
                parts.append(f'FOREIGN KEY ("{fk.column}") REFERENCES "{fk.table}"{target} ON DELETE {fk.on_delete.upper()} ON UPDATE {fk.on_update.upper()}')
            out.append(f'CREATE TABLE "{t.name}" ({", ".join(parts)})')
        for t in self._ordered():
            for n, v in t.indexes.items():
                cols = ", ".join(f'"{c}"' for c in v["columns"])
                out.append(f'CREATE {"UNIQUE " * v["unique"]}INDEX "{n}" ON "{t.name}" ({cols})')
        return out + [f'CREATE VIEW "{n}" AS {v["text"]}' for n, v in self.log.catalog.views.items()]

    def dump(self) -> DataFrame:
        """The script that rebuilds the database, a row per statement, ``step`` giving the order; rows are written where they lie."""
        frames = []
        schema = self.schema_sql()
        tables = [s for s in schema if s.startswith("CREATE TABLE")]
        for i, s in enumerate(tables):
            frames.append(self.spark.createDataFrame([(i, s)], "step int, statement string"))
        for i, t in enumerate(self._ordered()):
            quoted = "concat('''', replace({0}, '''', ''''''), '''')"
            cells = []
            for c in t.columns:
                text = casts.as_text(Typed(name(c.name), c.type, c.scale))
                word = "" if c.type in ("int", "float", "bool") else quoted
                cells.append(f"coalesce({word.format(text) if word else text}, 'NULL')")
            cols = ", ".join(f'"{c}"' for c in t.names)
            row = "concat_ws(', ', " + ", ".join(cells) + ")"
            df = self.log.read(t)
            head = text_literal(f'INSERT INTO "{t.name}" ({cols}) VALUES (')
            frames.append(df.select(F.lit(len(tables) + i).alias("step"), F.expr(f"concat({head}, {row}, ')')").alias("statement")))
        for s in schema[len(tables) :]:
            frames.append(self.spark.createDataFrame([(10_000, s)], "step int, statement string"))
        return _union(frames) if frames else self.spark.createDataFrame([], "step int, statement string")

    def restore_as_of(self, root: str, point: int | None = None) -> "Database":
        """A fresh database under ``root`` with the rows committed before ``point`` (now if None), checked as they are written."""
        other = Database(self.spark, root)
        for s in self.schema_sql():
            if s.startswith("CREATE TABLE"):
                other.execute(s)
        for t in self._ordered():
            rows = self.log.read(t, point).select(*(F.col(f"`{c}`") for c in t.names))
            other.log.begin()
            other._add_rows(other._table(t.name), rows, None, None, other._emitter())
            other.log.commit()
        for s in self.schema_sql():
            if not s.startswith("CREATE TABLE"):
                other.execute(s)
        return other

    def backup(self, root: str) -> "Database":
        return self.restore_as_of(root, None)

    def dbstat(self) -> DataFrame:
        """Per table: live rows, files and bytes."""
        frames = []
        for t in self._ordered():
            df = self.log.read(t)
            size = sum(self.log.files.size(p) for _, _, p in t.inserts + t.deletes)
            frames.append(df.agg(F.count("*").alias("rows")).select(F.lit(t.name).alias("table_name"), "rows", F.lit(len(df.inputFiles())).alias("files"), F.lit(size).cast("bigint").alias("bytes")))
        return _union(frames) if frames else self.spark.createDataFrame([], "table_name string, rows bigint, files int, bytes bigint")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _asks_tables(x: Any) -> bool:
    """Whether an expression, or any in a list, holds a query."""
    if isinstance(x, (list, tuple)):
        return any(map(_asks_tables, x))
    return isinstance(x, Query) or (is_dataclass(x) and any(_asks_tables(getattr(x, f.name)) for f in fields(x)))


def _window(cols: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols).orderBy(order)


def _words(text: str) -> list[str]:
    from tidemark.plans.lexer import tokenize

    return [t.text for t in tokenize(text) if t.kind in ("word", "quoted")]


def tables_of(node) -> set[str]:
    """The table names a tree reads, without those of its own common table expressions."""
    found: set[str] = set()
    if isinstance(node, TableRef):
        return {node.name} if node.query is None else tables_of(node.query)
    if isinstance(node, Query):
        own = {n for n, _ in node.ctes}
        for _, sub in node.ctes:
            found |= tables_of(sub)
        rest = Query(node.body, node.order)
        for part in (rest.body, rest.order):
            found |= tables_of(part)
        return found - own
    if isinstance(node, (list, tuple)):
        for x in node:
            found |= tables_of(x)
    elif hasattr(node, "__dataclass_fields__"):
        for f in node.__dataclass_fields__:
            found |= tables_of(getattr(node, f))
    return found
