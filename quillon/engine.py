"""The engine's front: a database of versioned tables over a Spark session.

A table's current version is a DataFrame. Statements that change a table put a new version in place;
a transaction works on its own versions and publishes them at commit, so readers never see half of a
change and rollback only forgets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.errors import EngineError, of_spark
from quillon.functions import semantics
from quillon.operators import dml, forjson, relational
from quillon.plans import dialect, syntax, translate
from quillon.session import TABLES, table
from quillon.sources import tables as sources


@dataclass
class Result:
    """A lazy result: columns, rows, first, scalar, and streaming."""

    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> list[Row]:
        return self.df.collect()

    def first(self) -> Row | None:
        return self.df.first()

    def scalar(self):
        row = self.df.first()
        return None if row is None else row[0]

    def each(self, visit: Callable[[Row], bool | None]) -> None:
        """Streams rows to a callback until it returns False."""
        for row in sources.each(self.df):
            if visit(row) is False:
                return

    def __iter__(self) -> Iterator[Row]:
        return sources.each(self.df)

    def to_json(self, order: list[str], **options) -> str:
        """The result as one JSON document."""
        return forjson.for_json_path(self.df, order, **options).first()["json"]

    def explain(self) -> None:
        """The plan that will run."""
        self.df.explain("formatted")


@dataclass
class Statement:
    """A prepared statement: parameters are bound by position (from 1) or name; unbound ones are NULL."""

    database: Database
    text: str
    bound: dict = field(default_factory=dict)

    @property
    def parameters(self) -> list[str]:
        return [t.text for t in dialect.tokens(self.text) if t.kind == "parameter"]

    @property
    def column_names(self) -> list[str]:
        return self.exec().columns

    def bind(self, *positional, **named) -> Statement:
        self.bound |= {f"p{i + 1}": v for i, v in enumerate(positional)} | named
        return self

    def clear(self) -> Statement:
        self.bound.clear()
        return self

    def exec(self) -> Result:
        wanted = {p[1:] if p[0] in ":@$" else f"p{p[1:] or i + 1}" for i, p in enumerate(self.parameters)}
        return self.database.exec(self.text, {k: self.bound.get(k) for k in wanted})


def _qualified(e, table: str, columns: list[str]):
    """An expression whose bare columns name the target table."""
    if isinstance(e, (list, tuple)):
        return type(e)(_qualified(x, table, columns) for x in e)
    if not isinstance(e, syntax.Expr):
        return e
    if e.op == "column" and len(e.args) == 1 and e.args[0].lower() in {c.lower() for c in columns}:
        return syntax.Expr("column", [table, e.args[0]])
    return syntax.Expr(e.op, [_qualified(a, table, columns) for a in e.args], e.text)


def _changed(before: DataFrame, after: DataFrame) -> int:
    """Rows that differ between two versions: rows that both have cancel out by their counts, in one pass."""
    keys = [F.struct(*(F.col(f"`{n}`") for n in df.columns)) for df in (before, after)]
    both = before.select(F.xxhash64(F.lit(1), keys[0]).alias("h"), F.xxhash64(keys[0]).alias("g"), F.lit(-1).alias("n")).unionByName(
        after.select(F.xxhash64(F.lit(1), keys[1]).alias("h"), F.xxhash64(keys[1]).alias("g"), F.lit(1).alias("n")))
    net = both.groupBy("h", "g").agg(F.sum("n").alias("n"))
    added, gone = net.agg(F.sum(F.greatest("n", F.lit(0))), F.sum(F.greatest(-F.col("n"), F.lit(0)))).first()
    return max(added or 0, gone or 0)


class Transaction:
    """Changes that are published together at commit; leaving the block by an error forgets them."""

    def __init__(self, database: Database):
        self.database, self.versions, self.points = database, dict(database.versions), {}
        self.saved = dict(database.rules), dict(database.indexes)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.database.transaction is self:
            self.commit() if kind is None else self.rollback()

    def commit(self) -> None:
        self.database.versions, self.database.transaction = self.versions, None

    def rollback(self) -> None:
        self.database.transaction = None
        self.database.rules, self.database.indexes = self.saved

    def savepoint(self, name: str) -> None:
        self.points[name] = dict(self.versions)

    def rollback_to(self, name: str) -> None:
        if name not in self.points:
            raise EngineError(f"no such savepoint: {name}")
        self.versions = dict(self.points[name])

    def release(self, name: str) -> None:
        if self.points.pop(name, None) is None:
            raise EngineError(f"no such savepoint: {name}")


class Database:
    """Tables by name, queried through SQL or as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.versions: dict[str, DataFrame] = {}
        self.transaction: Transaction | None = None
        self.rules: dict[str, syntax.Rules] = {}
        self.indexes: dict[str, tuple[str, list[str], bool]] = {}
        self.foreign_keys = False
        self.user_version = 0
        self._rowid: tuple[DataFrame, str] | None = None
        self._total: list[tuple[DataFrame, DataFrame]] = []
        self._views: dict[str, tuple[DataFrame, str]] = {}
        self._registered = False
        self._last: tuple[DataFrame, DataFrame] | None = None
        if folder:
            self.attach(folder)

    def attach(self, folder: str, names: Sequence[str] = TABLES, schema: str = "") -> None:
        """Makes a folder's parquet tables known, with a prefix for other schemas than main."""
        for name in names:
            self.put(f"{schema}_{name}" if schema else name, table(self.spark, folder, name))

    def detach(self, schema: str) -> None:
        current = self._current()
        for name in [n for n in current if n.startswith(f"{schema}_")]:
            del current[name]

    def _current(self) -> dict[str, DataFrame]:
        return self.transaction.versions if self.transaction else self.versions

    def put(self, name: str, df: DataFrame) -> None:
        """Puts a table's new version in place."""
        self._current()[name.lower()] = df

    def get(self, name: str) -> DataFrame:
        """A table's current version."""
        found = self._current().get(name.lower())
        if found is None:
            raise EngineError(f"no such table: {name}", "no such table")
        return found

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self._current().pop(name.lower(), None) is None and not if_exists:
            raise EngineError(f"no such table: {name}", "no such table")

    def exec(self, text: str, parameters: Sequence | dict | None = None) -> Result:
        """Runs a batch of statements in the dialect and returns the last one's result."""
        named = parameters if isinstance(parameters, dict) else {f"p{i + 1}": v for i, v in enumerate(parameters or ())}
        out = None
        for found in dialect.statements(text):
            out = self._one(found, named)
        if out is None:
            raise EngineError("no statement", "misuse")
        return out

    def _one(self, found: list[dialect.Token], named: dict) -> Result:
        found, json = dialect.split_for_json(found)
        tree = syntax.parse(found)
        if isinstance(tree, syntax.Change):
            return self._change(tree, named)
        df = self.select(tree, named)
        if json is None:
            return Result(df)
        if json["mode"] == "auto":
            return Result(self._json_auto(tree, df, json))
        return Result(forjson.for_json_path(df, df.columns, root=json["root"], nulls=json["nulls"], wrapper=json["wrapper"]))

    def _json_auto(self, tree: syntax.Select, df: DataFrame, json: dict) -> DataFrame:
        """FOR JSON AUTO of one SELECT over one or two sources: columns of the second nest in the first.
        Rows follow ORDER BY, else all columns from left to right."""
        core = tree.cores[0]
        source = core.source
        shown = [(e, n) for (e, _), n in zip(core.items, df.columns, strict=False)]
        if source is None or any(e.op != "column" for e, _ in shown):
            raise EngineError("FOR JSON AUTO needs plain columns of FROM sources", "misuse")
        order = [e.args[-1] for e, _, _ in tree.order if e.op == "column" and e.args[-1] in df.columns] or df.columns
        order = [*order, *(c for c in df.columns if c not in order)]
        if source.kind != "join":
            return forjson.for_json_path(df, order, df.columns, json["root"], json["nulls"], json["wrapper"])
        if source.left.kind == "join":
            raise EngineError("FOR JSON AUTO over more than two sources: use quillon.operators.forjson", "misuse")
        known = {c.lower() for c in self.get(source.left.name).columns} if source.left.kind == "table" else set()
        first = (source.left.alias or source.left.name).lower()
        outer = [n for e, n in shown if (e.args[0].lower() == first if len(e.args) == 2 else e.args[0].lower() in known)]
        inner = [n for _, n in shown if n not in outer]
        return forjson.for_json_auto(df, outer, inner, source.right.alias or source.right.name, order, json["root"], json["nulls"], json["wrapper"])

    def _translator(self, named: dict) -> translate.Translator:
        if not self._registered:
            translate.register(self.spark)
            self._registered = True
        known = {}
        for name, df in self._current().items():
            known[name] = (self._view(name, df), {f.name: translate.kind_of(f.dataType) for f in df.schema.fields})
        out = translate.Translator(known)
        kinds = {bool: "integer", int: "integer", float: "real", str: "text", bytes: "blob"}
        translate.Translator.parameters = {k: kinds.get(type(v), "null") for k, v in named.items()}
        translate.Translator.counters = {"changes": lambda: self.changes, "total_changes": lambda: self.total_changes, "last_insert_rowid": lambda: self.last_insert_rowid}
        return out

    def _view(self, name: str, df: DataFrame) -> str:
        """The temp view of a table's version."""
        held = self._views.get(name)
        if held is None or held[0] is not df:
            view = f"quillon_{id(self):x}_{len(self._views)}_{name}" if held is None else held[1]
            df.createOrReplaceTempView(view)
            self._views[name] = held = (df, view)
        return held[1]

    def select(self, tree: syntax.Select, named: dict | None = None) -> DataFrame:
        """The DataFrame of a parsed query. A recursive CTE that drops repeated rows (UNION) or has a LIMIT is
        followed round by round here; all else is one translated query."""
        named = named or {}
        if tree.recursive and any(("UNION" in q.operations or q.limit is not None) and name.lower() in translate.shape_sources(q) for name, _, q in tree.ctes):
            return self._fixpoint(tree, named)
        sql, _ = self._translator(named).query(tree)
        try:
            return self.spark.sql(sql, args={k: int(v) if isinstance(v, bool) else v for k, v in named.items()} or None)
        except (PySparkException, Py4JJavaError) as e:
            raise of_spark(e) from e

    def _fixpoint(self, tree: syntax.Select, named: dict) -> DataFrame:
        scratch = Database(self.spark)
        scratch.attach_frames(self._current())
        for name, columns, q in tree.ctes:
            if name.lower() in translate.shape_sources(q):
                first, again = (syntax.Select([c], []) for c in q.cores)
                seed = scratch.select(first, named)
                seed = seed.toDF(*(columns or seed.columns))

                def step(new: DataFrame, name=name, again=again) -> DataFrame:
                    scratch.put(name, new)
                    return scratch.select(again, named)

                limit, offset = (None if e is None else scratch.select(syntax.Select([syntax.Core(items=[(e, "n")])], []), named).first()[0] for e in (q.limit, q.offset))
                if q.order and limit is not None:
                    raise EngineError("ORDER BY with LIMIT in a recursive query isn't supported", "error")
                done = relational.recursive(seed, step, q.operations == ["UNION"], limit=None if limit is None or limit < 0 else limit, offset=max(0, offset or 0))
            else:
                done = scratch.select(q, named)
                done = done.toDF(*(columns or done.columns))
            scratch.put(name, done)
        return scratch.select(syntax.Select(tree.cores, tree.operations, [], False, tree.order, tree.limit, tree.offset), named)

    def _change(self, c: syntax.Change, named: dict) -> Result:
        """Applies a change or definition; its result has the changed rows for RETURNING, else their number."""
        p, none = c.parts, Result(self.spark.createDataFrame([], "changes long"))
        if c.kind in ("begin", "commit", "end", "rollback", "savepoint", "release", "rollback to"):
            self._control(c)
            return none
        if c.kind == "pragma":
            return Result(self.pragma(c.name, *p["args"]))
        if c.kind == "explain":
            plan = self.select(p["query"], named)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return Result(self.spark.createDataFrame([(i, line) for i, line in enumerate(plan.split("\n"))], "id int, detail string"))
        if c.kind in ("vacuum", "attach", "detach", "analyze", "reindex"):
            self._maintain(c)
            return none
        if c.kind.startswith(("create", "drop", "rename", "add")):
            self._define(c, named)
            return none
        current = self._current()
        saved = dict(current)
        try:
            for name, _, _ in p.get("ctes", ([], False))[0]:
                tree = syntax.Select([syntax.Core(items=[(syntax.Expr("star"), None)], source=syntax.Source("table", name))], [], *p["ctes"])
                current[name.lower()] = self.select(tree, named)
            before = self.get(c.name)
            if c.kind == "insert":
                after = self._insert(c, before, named)
            elif c.kind == "delete":
                after = self._deleted(c, before, named)
            else:
                after = self._updated(c, before, named)
            after = after.select(*before.columns)
            if c.name.lower() in self.rules:
                after = self._fixed(after)
            for name, _, _ in p.get("ctes", ([], False))[0]:
                current.pop(name.lower())
                current |= {name.lower(): saved[name.lower()]} if name.lower() in saved else {}
            self.put(c.name, after)
            self._refer(c.name, before, after, c.kind)
        except BaseException:
            current.clear()
            current.update(saved)
            raise
        self._last = (before, after)
        self._total.append(self._last)
        if "returning" not in p:
            return none
        if c.kind == "delete":
            changed = before.exceptAll(after)
        else:
            changed = after.exceptAll(before)
        scratch = Database(self.spark)
        scratch.put(c.name, changed)
        return Result(scratch.select(syntax.Select([syntax.Core(items=p["returning"], source=syntax.Source("table", c.name))], []), named))

    def _deleted(self, c: syntax.Change, before: DataFrame, named: dict) -> DataFrame:
        if "limit" in c.parts:
            keyed, chosen = self._chosen(c, before, named)
            return keyed.join(chosen, "q_row", "left_anti")
        return before.limit(0) if c.parts["where"] is None else self._kept(c.name, c.parts["where"], named)

    def _chosen(self, c: syntax.Change, before: DataFrame, named: dict) -> tuple[DataFrame, DataFrame]:
        """The table with row numbers (q_row), and the numbers of the rows that ORDER BY and LIMIT choose."""
        keyed = self._fixed(before.withColumn("q_row", F.monotonically_increasing_id()))
        scratch = Database(self.spark)
        scratch.attach_frames(self._current() | {c.name.lower(): keyed})
        core = syntax.Core(items=[(syntax.Expr("column", ["q_row"]), "q_row")], source=syntax.Source("table", c.name), where=c.parts["where"])
        return keyed, scratch.select(syntax.Select([core], [], order=c.parts.get("order", []), limit=c.parts["limit"], offset=c.parts["offset"]), named)

    def _fixed(self, df: DataFrame) -> DataFrame:
        """The rows written to the shared folder (see relational.checkpoint_folder): row numbers stay, plans stay short."""
        relational.checkpoint_folder(self.spark)
        return df.checkpoint()

    def _kept(self, name: str, where: syntax.Expr, named: dict) -> DataFrame:
        stays = syntax.Expr("not", [syntax.Expr("call", ["coalesce", [where, syntax.Expr("integer", [0])]])])
        return self.select(syntax.Select([syntax.Core(items=[(syntax.Expr("star"), None)], source=syntax.Source("table", name), where=stays)], []), named)

    def _rules(self, name: str) -> syntax.Rules:
        return self.rules.get(name.lower()) or syntax.Rules()

    def _constant(self, e: syntax.Expr):
        return F.expr(translate.Translator({}).expr(e, translate.Scope()).value())

    def _generated(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with their generated columns computed."""
        made = self._rules(name).generated
        if not made:
            return rows
        scratch = Database(self.spark)
        scratch.put(name, rows)
        items = [(made.get(n.lower(), syntax.Expr("column", [n])), n) for n in rows.columns]
        return dml.conform(scratch.select(syntax.Select([syntax.Core(items=items, source=syntax.Source("table", name))], [])), rows)

    def _judged(self, name: str, rows: DataFrame) -> DataFrame | None:
        """Rows with ``q_said``, the first NOT NULL or CHECK that each breaks (NULL: none); None if there are no such rules."""
        rules = self._rules(name)
        if not rules.not_null and not rules.checks:
            return None
        scratch = Database(self.spark)
        scratch.put(name, rows)
        items = [(syntax.Expr("star"), None), *((e, f"q_check{i}") for i, (_, e) in enumerate(rules.checks))]
        checked = scratch.select(syntax.Select([syntax.Core(items=items, source=syntax.Source("table", name))], []))
        said = [F.when(F.col(f"`{n}`").isNull(), F.lit(f"NOT NULL constraint failed: {name}.{n}")) for n in rules.not_null]
        said += [F.when(F.col(f"q_check{i}").cast("double") == 0, F.lit(f"CHECK constraint failed: {label}")) for i, (label, _) in enumerate(rules.checks)]
        return checked.withColumn("q_said", F.coalesce(*said)).select(*rows.columns, "q_said")

    def _checked(self, name: str, rows: DataFrame, ignore: bool = False) -> DataFrame:
        """The rows, if they keep NOT NULL and CHECK; those that don't are left out or are an error."""
        judged = self._judged(name, rows)
        if judged is None:
            return rows
        if ignore:
            return judged.where("q_said is null").drop("q_said")
        bad = judged.where("q_said is not null").select("q_said").first()
        if bad:
            raise EngineError(bad[0], "constraint", "check" if bad[0].startswith("CHECK") else "not null")
        return rows

    def _unique(self, name: str, table: DataFrame | None, rows: DataFrame) -> None:
        """An error if new rows share a unique key with each other or with the table's."""
        for keys in self._rules(name).keys:
            new = rows.select(*keys)
            met = new if table is None else table.join(new.distinct(), keys, "left_semi").select(*keys).unionByName(new)
            if dml.unique_violations(met, keys).first():
                raise EngineError("UNIQUE constraint failed: " + ", ".join(f"{name}.{k}" for k in keys), "constraint", "primary key" if keys == self._rules(name).primary else "unique")

    def _refer(self, name: str, before: DataFrame, after: DataFrame, kind: str) -> None:
        """Foreign keys, while they are on: the table's own references, and what other tables' references to rows that
        are gone ask for."""
        if not self.foreign_keys:
            return
        failed = EngineError("FOREIGN KEY constraint failed", "constraint", "foreign key")
        if kind != "delete":
            for ref in self._rules(name).references:
                keys = ref.keys or self._rules(ref.parent).primary
                if dml.foreign_key_violations(after, ref.columns, self.get(ref.parent).select(*keys).alias("parent"), keys).first():
                    raise failed
        if kind == "insert":
            return
        for child_name, rules in list(self.rules.items()):
            for ref in rules.references:
                if ref.parent.lower() != name.lower() or child_name not in self._current():
                    continue
                keys = ref.keys or self._rules(name).primary
                fresh = [f"q_{k}" for k in keys]
                gone = before.select(*keys).join(after.select(*keys), keys, "left_anti").distinct().toDF(*fresh)
                child = self.get(child_name)
                hit = child.join(gone, [child[c] == gone[k] for c, k in zip(ref.columns, fresh, strict=True)], "left_semi").first()
                action = ref.on_delete if kind == "delete" else ref.on_update
                if hit is None:
                    continue
                if action in ("no action", "restrict"):
                    raise failed
                if kind != "delete" and action == "cascade":
                    raise EngineError("ON UPDATE CASCADE isn't supported", "error")
                defaults = {c: self._constant(rules.defaults[c.lower()]) for c in ref.columns if c.lower() in rules.defaults}
                new = dml.on_delete(child, ref.columns, gone, fresh, action, defaults)
                new = self._fixed(new)
                self.put(child_name, new)
                self._refer(child_name, child, new, "delete" if action == "cascade" else "update")

    def _insert(self, c: syntax.Change, before: DataFrame, named: dict) -> DataFrame:
        p, rules, exact = c.parts, self._rules(c.name), {n.lower(): n for n in before.columns}
        if p["query"] is None:
            rows = self.spark.range(1).select()
        else:
            rows = self.select(p["query"], named)
            names = p["columns"] or [n for n in before.columns if n.lower() not in rules.generated]
            for n in names:
                if n.lower() not in exact:
                    raise EngineError(f"table {c.name} has no column named {n}", "no such column")
                if n.lower() in rules.generated:
                    raise EngineError(f'cannot INSERT into generated column "{n}"', "error")
            if len(names) != len(rows.columns):
                raise EngineError(f"table {c.name} has {len(before.columns)} columns but {len(rows.columns)} values were supplied", "error")
            rows = rows.toDF(*(exact[n.lower()] for n in names))
        rows = dml.conform(rows, before, {exact[n]: self._constant(e) for n, e in rules.defaults.items()})
        if rules.rowid:
            column = exact[rules.rowid.lower()]
            top = before.select(column).unionByName(rows.select(column)).agg(F.max(column)).first()[0]
            rows = dml.numbered(self._fixed(rows), column, max(0, top or 0))
            self._rowid = (rows, column)
        rows = self._checked(c.name, self._generated(c.name, rows), p["conflict"] == "ignore")
        keys = rules.primary
        if p["upsert"] is not None:
            target, assignments, where = p["upsert"]
            target = target or keys
            if not target:
                raise EngineError("ON CONFLICT needs a PRIMARY KEY or UNIQUE constraint", "error")
            if assignments is None:
                return dml.insert(before, rows, target, "ignore")
            scratch = Database(self.spark)
            scratch.attach_frames({c.name: before, "excluded": rows})
            hit = " AND ".join(f'{c.name}."{k}" = excluded."{k}"' for k in target)
            items = [(syntax.Expr("column", [c.name, n]), n) for n in before.columns]
            chosen = dict(assignments)
            source = syntax.Source("join", left=syntax.Source("table", c.name), right=syntax.Source("table", "excluded"), join="INNER", on=syntax.parse(f"SELECT {hit}").cores[0].items[0][0])
            items = [(chosen.get(n, e), n) for e, n in items]
            qualified = [(_qualified(e, c.name, before.columns), n) for e, n in items]
            condition = None if where is None else _qualified(where, c.name, before.columns)
            updated = dml.conform(scratch.select(syntax.Select([syntax.Core(items=qualified, source=source, where=condition)], []), named), before)
            fresh = rows.join(before, target, "left_anti").select(*before.columns)
            updated = self._checked(c.name, self._generated(c.name, updated))
            return before.join(updated, target, "left_anti").select(*before.columns).unionByName(updated).unionByName(fresh)
        if p["conflict"] not in ("ignore", "replace"):
            self._unique(c.name, before, rows)
            return before.unionByName(rows)
        if not rules.keys:
            return before.unionByName(rows)
        numbered, wide = rows.withColumn("q_at", F.monotonically_increasing_id()), before
        for keys in rules.keys:  # by each key in turn
            whole = " and ".join(f"`{k}` is not null" for k in keys)
            pick = dml.latest if p["conflict"] == "ignore" else dml.final
            one = pick(numbered.where(whole), keys, [F.col("q_at")])
            one = one.join(wide, keys, "left_anti").select(*numbered.columns) if p["conflict"] == "ignore" else one
            wide = wide if p["conflict"] == "ignore" else wide.join(one, keys, "left_anti").select(*before.columns)
            numbered = one.unionByName(numbered.where(f"not ({whole})"))
        return wide.unionByName(numbered.select(*before.columns))

    def _updated(self, c: syntax.Change, before: DataFrame, named: dict) -> DataFrame:
        p, chosen = c.parts, {n.lower(): e for n, e in c.parts["set"]}
        unknown = [n for n in chosen if n not in {x.lower() for x in before.columns}]
        if unknown:
            raise EngineError(f"no such column: {unknown[0]}", "no such column")
        rules = self._rules(c.name)
        made = [n for n in chosen if n in rules.generated]
        if made:
            raise EngineError(f'cannot UPDATE generated column "{made[0]}"', "error")
        after = self._assigned(c, before, named, chosen)
        after = self._checked(c.name, self._generated(c.name, dml.conform(after, before)))
        if any(k.lower() in chosen for keys in rules.keys for k in keys):
            self._unique(c.name, None, after)
        return after

    def _assigned(self, c: syntax.Change, before: DataFrame, named: dict, chosen: dict[str, syntax.Expr]) -> DataFrame:
        p = c.parts
        if p["from"] is None:
            hit, scratch = p["where"] or syntax.Expr("integer", [1]), self
            if "limit" in p:
                keyed, rows = self._chosen(c, before, named)
                scratch = Database(self.spark)
                scratch.attach_frames(self._current() | {c.name.lower(): keyed.join(rows.withColumn("q_hit", F.lit(1)), "q_row", "left")})
                hit = syntax.Expr("column", ["q_hit"])
            items = [(syntax.Expr("case", [None, [(hit, chosen[n.lower()])], syntax.Expr("column", [n])]) if n.lower() in chosen else syntax.Expr("column", [n]), n) for n in before.columns]
            return scratch.select(syntax.Select([syntax.Core(items=items, source=syntax.Source("table", c.name))], []), named)
        keyed = before.withColumn("q_row", F.monotonically_increasing_id())
        scratch = Database(self.spark)
        scratch.attach_frames(self._current() | {c.name.lower(): self._fixed(keyed)})
        items = [(chosen.get(n.lower(), syntax.Expr("column", [c.name, n])), n) for n in before.columns] + [(syntax.Expr("column", [c.name, "q_row"]), "q_row")]
        source = syntax.Source("join", left=syntax.Source("table", c.name), right=p["from"], join="CROSS")
        changed = scratch.select(syntax.Select([syntax.Core(items=items, source=source, where=p["where"])], []), named)
        changed = dml.latest(changed, ["q_row"], [F.col(n) for n in before.columns])
        rest = scratch.get(c.name).join(changed, "q_row", "left_anti").select(*before.columns)
        return rest.unionByName(dml.conform(changed, before))

    def _maintain(self, c: syntax.Change) -> None:
        """VACUUM INTO copies, ATTACH makes a folder's tables known as schema.table, ANALYZE fills the
        statistics table; parquet needs no REINDEX or VACUUM."""
        if c.kind == "vacuum" and c.name:
            self.vacuum_into(c.name)
        elif c.kind == "attach":
            self.attach(c.parts["folder"], schema=c.name)
        elif c.kind == "detach":
            self.detach(c.name)
        elif c.kind == "analyze":
            stats = None
            for name in [c.name] if c.name else [n for n in self.tables() if n != "sqlite_stat1"]:
                keys = self._rules(name).primary or self.get(name).columns[:1]
                row = dml.index_statistics(self.get(name), name, f"{name}_key", keys)
                stats = row if stats is None else stats.unionByName(row)
            if stats is not None:
                self.put("sqlite_stat1", stats)

    def _define(self, c: syntax.Change, named: dict) -> None:
        p, name = c.parts, c.name
        if c.kind in ("create table", "create view"):
            if name.lower() in self._current():
                if p["maybe"]:
                    return
                raise EngineError(f"table {name} already exists", "error")
            rules = p.get("rules")
            if "query" in p:
                df = self.select(p["query"], named)
                self.put(name, df if rules is None else df.toDF(*(n for n, _ in rules.columns)))
                return
            kinds = {"INTEGER": "bigint", "REAL": "double", "NUMERIC": "double", "TEXT": "string", "BLOB": "binary"}
            empty = self.spark.createDataFrame([], ", ".join(f"`{n}` {kinds[semantics.affinity(k)]}" for n, k in rules.columns))
            untyped = {n: rules.generated[n.lower()] for n, k in rules.columns if n.lower() in rules.generated and not k}
            if untyped:  # a generated column without a type has its expression's
                scratch = Database(self.spark)
                scratch.put(name, empty)
                items = [(untyped.get(n, syntax.Expr("column", [n])), n) for n in empty.columns]
                empty = self.spark.createDataFrame([], scratch.select(syntax.Select([syntax.Core(items=items, source=syntax.Source("table", name))], [])).schema)
            self.put(name, empty)
            self.rules[name.lower()] = rules
        elif c.kind == "create index":
            self._index(c)
        elif c.kind == "drop index":
            table, columns, unique = self.indexes.pop(name.lower(), (None, [], False))
            if table is None and not p["maybe"]:
                raise EngineError(f"no such index: {name}", "error")
            if unique:
                rules = self._rules(table)
                self.rules[table] = replace(rules, uniques=[k for k in rules.uniques if k is not columns])
        elif c.kind in ("drop table", "drop view"):
            self.drop(name, p["maybe"])
            self.rules.pop(name.lower(), None)
        elif c.kind == "rename table":
            self.put(p["new"], self.get(name))
            self.drop(name)
            if name.lower() in self.rules:
                self.rules[p["new"].lower()] = self.rules.pop(name.lower())
        elif c.kind in ("rename column", "drop column") and p["old"].lower() in self._rules(name).names() | {n.lower() for n in self._rules(name).not_null}:
            raise EngineError(f'cannot {c.kind} "{p["old"]}": a constraint names it', "error")
        elif c.kind == "rename column":
            self.change(name, lambda t: dml.rename_column(t, p["old"], p["new"]))
        elif c.kind == "drop column":
            self.change(name, lambda t: dml.drop_column(t, p["old"]))
        elif c.kind == "add column":
            kinds = {"INTEGER": "bigint", "REAL": "double", "NUMERIC": "double", "TEXT": "string", "BLOB": "binary"}
            default = None if p["default"] is None else F.expr(translate.Translator({}).expr(p["default"], translate.Scope()).value())
            self.change(name, lambda t: dml.add_column(t, p["new"], kinds[semantics.affinity(p["type"])], default))

    def _index(self, c: syntax.Change) -> None:
        """An index needs no storage; a unique one is a constraint, which the table must keep already."""
        p, name, table = c.parts, c.name.lower(), c.parts["table"].lower()
        if name in self.indexes:
            if p["maybe"]:
                return
            raise EngineError(f"index {c.name} already exists", "error")
        exact = {n.lower(): n for n in self.get(table).columns}
        plain = all(e.op == "column" for e in p["terms"])
        if p["unique"] and (not plain or p["where"] is not None):
            raise EngineError("a unique index on expressions or part of a table isn't supported", "error")
        columns = [exact.get(e.args[-1].lower(), e.args[-1]) if e.op == "column" else e.text for e in p["terms"]]
        missing = [n for n in columns if plain and n not in exact.values()]
        if missing:
            raise EngineError(f"no such column: {missing[0]}", "no such column")
        if p["unique"]:
            if dml.unique_violations(self.get(table), columns).first():
                raise EngineError("UNIQUE constraint failed: " + ", ".join(f"{p['table']}.{k}" for k in columns), "constraint", "unique")
            rules = self._rules(table)
            self.rules[table] = replace(rules, uniques=[*rules.uniques, columns])
        self.indexes[name] = (table, columns, p["unique"])

    def _control(self, c: syntax.Change) -> None:
        if c.kind == "begin":
            self.begin()
            return
        if c.kind == "savepoint" and self.transaction is None:
            self.begin()
        if self.transaction is None:
            raise EngineError("cannot commit - no transaction is active" if c.kind != "rollback" else "cannot rollback - no transaction is active", "misuse")
        act = {"commit": self.transaction.commit, "end": self.transaction.commit, "rollback": self.transaction.rollback}
        if c.kind in act:
            act[c.kind]()
        else:
            {"savepoint": self.transaction.savepoint, "release": self.transaction.release, "rollback to": self.transaction.rollback_to}[c.kind](c.name)

    def pragma(self, name: str, *args: str) -> DataFrame:
        """The informative pragmas."""
        make = self.spark.createDataFrame
        if name in ("table_info", "table_xinfo"):
            return self.table(args[0])
        if name == "table_list":
            return make([("main", n, "table", len(df.columns)) for n, df in sorted(self._current().items())], "schema string, name string, type string, ncol int")
        if name == "database_list":
            return make([(0, "main", "")], "seq int, name string, file string")
        if name == "index_list":
            rules, own = self._rules(args[0]), [(n, u) for n, (t, _, u) in self.indexes.items() if t == args[0].lower()]
            keys = [k for k in rules.keys if [k] != [[rules.rowid]] and not any(k is c for _, c, _ in self.indexes.values())]
            auto = [(f"sqlite_autoindex_{args[0]}_{i + 1}", 1, "pk" if k == rules.primary else "u") for i, k in enumerate(keys)]
            rows = [(n, int(u), "c") for n, u in own[::-1]] + auto[::-1]
            return make([(i, n, u, o, 0) for i, (n, u, o) in enumerate(rows)], "seq int, name string, unique int, origin string, partial int")
        if name == "index_info":
            table, columns, _ = self.indexes.get(args[0].lower(), (None, [], False))
            at = [n.lower() for n in self.get(table).columns] if table else []
            return make([(i, at.index(n.lower()), n) for i, n in enumerate(columns) if n.lower() in at], "seqno int, cid int, name string")
        if name == "foreign_keys":
            if args and not self.in_transaction:
                self.foreign_keys = args[0].lower() in ("1", "on", "true", "yes")
            return make([(int(self.foreign_keys),)], "foreign_keys int")
        if name == "foreign_key_list":
            rows = [
                (i, k, r.parent, c, r.keys[k] if r.keys else None, r.on_update.upper(), r.on_delete.upper(), "NONE")
                for i, r in enumerate(self._rules(args[0]).references[::-1]) for k, c in enumerate(r.columns)
            ]
            return make(rows, "id int, seq int, `table` string, `from` string, `to` string, on_update string, on_delete string, match string")
        if name == "foreign_key_check":
            return self._orphans(args[0] if args else None)
        if name == "function_list":
            return make(sorted({(n,) for n, _ in translate._SIMPLE} | {(n,) for n in translate._MATH | translate._AGGREGATES | translate._RANKING}), "name string")
        if name == "integrity_check":
            return make([(x,) for x in self._damage() or ["ok"]], "integrity_check string")
        if name == "user_version":
            if args:
                self.user_version = int(args[0])
            return make([(self.user_version,)], "user_version int")
        raise EngineError(f"unknown pragma: {name}", "misuse")

    def _orphans(self, name: str | None) -> DataFrame:
        """The rows without a parent, by table and foreign key."""
        out = self.spark.createDataFrame([], "`table` string, parent string, fkid int")
        for child in [name.lower()] if name else sorted(self.rules):
            for i, ref in enumerate(self._rules(child).references[::-1]):
                keys = ref.keys or self._rules(ref.parent).primary
                bad = dml.foreign_key_violations(self.get(child), ref.columns, self.get(ref.parent).select(*keys).alias("parent"), keys)
                out = out.unionByName(bad.select(F.lit(child).alias("table"), F.lit(ref.parent).alias("parent"), F.lit(i).alias("fkid")))
        return out

    def _damage(self) -> list[str]:
        """What integrity_check says of tables whose rows break NOT NULL, CHECK or unique keys (one line for each rule)."""
        out = []
        for name in sorted(set(self.rules) & set(self._current())):
            judged = self._judged(name, self.get(name))
            if judged is not None:
                out += sorted(r[0] for r in judged.where("q_said is not null").select("q_said").distinct().collect())
            out += [f"non-unique entry in {name}({', '.join(k)})" for k in self._rules(name).keys if dml.unique_violations(self.get(name), k).first()]
        return out

    def attach_frames(self, frames: dict[str, DataFrame]) -> None:
        """Makes DataFrames known as tables."""
        for name, df in frames.items():
            self.put(name, df)

    def prepare(self, text: str) -> Statement:
        return Statement(self, text)

    def begin(self) -> Transaction:
        if self.transaction:
            raise EngineError("cannot start a transaction within a transaction", "misuse")
        self.transaction = Transaction(self)
        return self.transaction

    def change(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces a table by a function of it (see quillon.operators.dml)."""
        self.put(name, make(self.get(name)))

    @property
    def in_transaction(self) -> bool:
        return self.transaction is not None

    @property
    def changes(self) -> int:
        """Rows that the last INSERT, UPDATE or DELETE changed, counted when asked."""
        return 0 if self._last is None else _changed(*self._last)

    @property
    def total_changes(self) -> int:
        """Rows changed since the database was opened."""
        return sum(_changed(before, after) for before, after in self._total)

    @property
    def last_insert_rowid(self) -> int:
        """The largest number of the last INSERT into a table with an INTEGER PRIMARY KEY."""
        if self._rowid is None:
            return 0
        rows, column = self._rowid
        return rows.agg(F.max(column)).first()[0] or 0

    def tables(self) -> list[str]:
        return sorted(self._current())

    def table(self, name: str) -> DataFrame:
        """pragma table_info of a table."""
        return sources.table_info(self.get(name))

    def schema(self) -> DataFrame:
        return sources.schema_table(self.spark, self._current())

    def vacuum_into(self, folder: str) -> None:
        """Copies every table into a folder."""
        for name, df in self._current().items():
            sources.copy_to(df, f"{folder}/{name}.parquet")

    def interrupt(self, tag: str) -> None:
        """Stops the jobs that run under a tag (SparkSession.addTag)."""
        self.spark.interruptTag(tag)

    def row_count(self, name: str) -> int:
        """count(*), from the files' footers where there are any."""
        return self.get(name).agg(F.count("*")).first()[0]
