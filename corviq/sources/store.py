"""Versioned tables in Parquet: copy-on-write changes, an operation ledger, constraints."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corviq.errors import EngineError
from corviq.policy import TENANT, VISIBILITY, Policy

#: Rows of a statement up to which they are broadcast.
FEW = 10_000

SYSTEM = T.StructType([T.StructField(TENANT, T.StringType()), T.StructField(VISIBILITY, T.StringType()), T.StructField("id", T.LongType())])


def _part() -> Column:
    """The part that a row is read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/[^/]*$", 1)


def _ledger_name(key: str) -> str:
    digest = hashlib.sha256(key.encode()).hexdigest()
    return f"{digest[:3]}/{digest}"


class Store:
    """A folder of tables on storage that driver and executors share (any file system Spark can write).

    A table is a list of parts, each a folder of Parquet that never changes. An insert adds a part; changes and deletes
    rewrite only the parts that hold rows they touch; ``ranges`` says between which ids a part's rows count (low, high],
    if not all do. Numbered catalog files say which parts are current: a commit writes
    the catalog under a temporary name and renames it to the next number, which fails if another writer was first
    (40001). Readers keep the parts that they planned on. :meth:`compact` joins small parts. The ledger of operations is
    a folder with a small file each, which counts if the commit that it names was made; so a commit costs the same
    however many operations there were before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.number = max([int(m[1]) for f in self._fs.listStatus(self._path(self.root)) if (m := re.fullmatch(r"catalog-(\d+)\.json", f.getPath().getName()))], default=0)
        self.catalog = self._text(f"catalog-{self.number}.json") if self.number else {"tables": {}}
        self.staged: dict | None = None
        self.claims: dict[str, str] = {}  # of operations that aren't committed yet
        self.failed = False

    def _text(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write_text(self, path, content: dict) -> None:
        out = self._fs.create(path, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    # -- transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise EngineError("25001", "a transaction is open")
        self.staged = json.loads(json.dumps(self.catalog))

    def commit(self) -> None:
        if self.staged is None:
            raise EngineError("25P01", "no transaction is open")
        if self.failed:
            self.rollback()
            raise EngineError("25P02", "the transaction failed and was rolled back")
        self._save(self.staged)
        self.staged = None

    def rollback(self) -> None:
        self.staged, self.claims, self.failed = None, {}, False

    def _state(self) -> dict:
        if self.failed:
            raise EngineError("25P02", "the transaction has failed")
        return self.catalog if self.staged is None else self.staged

    def _copy(self) -> dict:
        """The state to change: what readers and other statements see stays as it is until the commit."""
        return json.loads(json.dumps(self._state()))

    def _put(self, state: dict) -> None:
        if self.staged is None:
            self._save(state)
        else:
            self.staged = state

    def _save(self, state: dict) -> None:
        commit = uuid.uuid4().hex
        for key, digest in self.claims.items():
            self._write_text(self._path(f"{self.root}/_ledger/{_ledger_name(key)}/{commit}"), {"key": key, "digest": digest, "number": self.number + 1})
        temporary, target = self._path(f"{self.root}/_{commit}"), self._path(f"{self.root}/catalog-{self.number + 1}.json")
        self._write_text(temporary, {**state, "commit": commit})
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            self.claims = {}
            raise EngineError("40001", "another writer committed first")
        self.number += 1
        self.catalog, self.claims = {**state, "commit": commit}, {}

    def _known(self, key: str) -> str | None:
        """The digest of an operation that was committed, or is about to be in this transaction."""
        if key in self.claims:
            return self.claims[key]
        folder = self._path(f"{self.root}/_ledger/{_ledger_name(key)}")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
            entry = self._text(f"_ledger/{_ledger_name(key)}/{f.getPath().getName()}")
            if entry["key"] == key and entry["number"] <= self.number and self._text(f"catalog-{entry['number']}.json").get("commit") == f.getPath().getName():
                return entry["digest"]
        return None

    def _publish(self, name: str, df: DataFrame | None, ledger: tuple[str, str] | None = None, keep: Sequence[str] = (), entry: dict | None = None) -> None:
        """The table becomes the parts ``keep`` and a new one with the rows of ``df`` (None: no rows)."""
        new = self._copy()
        entry = json.loads(json.dumps(entry or new["tables"][name]))
        entry["parts"] = list(keep)
        if df is not None:
            part = uuid.uuid4().hex
            df.write.parquet(f"{self.root}/{name}/{part}")
            entry["parts"].append(part)
        if ranges := {p: r for p, r in entry.pop("ranges", {}).items() if p in entry["parts"]}:
            entry["ranges"] = ranges
        entry["generation"] = entry.get("generation", 0) + 1
        new["tables"][name] = entry
        if ledger:
            self.claims[ledger[0]] = ledger[1]
        self._put(new)

    def _split(self, name: str, hit: Column | DataFrame, on: Sequence[str] = ()) -> tuple[list[str], list[str]]:
        """(parts with rows that ``hit`` holds for, or that match a DataFrame by ``on``; the other parts)."""
        parts = self._entry(name)["parts"]
        if len(parts) < 2:
            return parts, []
        rows = self.raw(name).withColumn("_part", _part())
        rows = rows.where(hit) if isinstance(hit, Column) else rows.join(hit, list(on), "left_semi")
        found = {r[0] for r in rows.select("_part").distinct().collect()}
        return [p for p in parts if p in found], [p for p in parts if p not in found]

    def compact(self, name: str, files: int | None = None) -> None:
        """All parts as one, in ``files`` files (by default one per 256 MB), without a shuffle."""
        if files is None:
            size = sum(self._fs.getContentSummary(self._path(f"{self.root}/{name}/{p}")).getLength() for p in self._entry(name)["parts"])
            files = max(1, -(-size // (256 << 20)))
        self._publish(name, self.raw(name).coalesce(files))

    # -- definition

    def create(self, name: str, schema: T.StructType, key: Sequence[str] = ("id",), unique: Sequence[Sequence[str]] = (), not_null: Sequence[str] = (), check: Sequence[str] = (), foreign: Sequence[tuple[str, str, str, str]] = (), defaults: dict | None = None) -> None:
        """``foreign``: (column, parent table, parent column, on delete: restrict, cascade, set_null, set_default)."""
        if name in self._state()["tables"]:
            raise EngineError("42P07", f"{name} exists")
        whole = T.StructType([*SYSTEM.fields, *schema.fields])
        entry = {"schema": whole.json(), "key": list(key), "unique": [list(u) for u in unique], "not_null": list(not_null), "check": list(check), "foreign": [list(f) for f in foreign], "defaults": defaults or {}}
        self._publish(name, None, entry=entry)

    def drop(self, name: str) -> None:
        self._entry(name)
        new = self._copy()
        del new["tables"][name]
        self._put(new)

    def _changed(self, name: str) -> dict:
        """A table's entry to change."""
        return json.loads(json.dumps(self._entry(name)))

    def add_column(self, name: str, column: T.StructField, default=None) -> None:
        raw, entry = self.raw(name), self._changed(name)
        if column.name in raw.columns:
            raise EngineError("42701", f"{column.name} exists")
        entry.setdefault("defaults", {})[column.name] = default
        entry["schema"] = T.StructType([*T.StructType.fromJson(json.loads(entry["schema"])).fields, column]).json()
        if default is None and column.name not in entry.get("dropped", ()):
            self._publish(name, None, keep=entry["parts"], entry=entry)  # files without the column read as null
        else:
            self._publish(name, raw.withColumn(column.name, F.lit(default).cast(column.dataType)), entry=entry)

    def retype(self, name: str, column: str, kind: T.DataType) -> None:
        """ALTER COLUMN ... TYPE: every value must convert."""
        raw, entry = self.raw(name), self._changed(name)
        if column not in raw.columns:
            raise EngineError("42703", f"no column {column}")
        entry["schema"] = T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in raw.schema.fields]).json()
        self._publish(name, raw.withColumn(column, F.col(column).cast(kind)), entry=entry)

    def nullable(self, name: str, column: str) -> None:
        """ALTER COLUMN ... DROP NOT NULL."""
        entry = self._changed(name)
        if column in entry["key"]:
            raise EngineError("42P16", f"{column} is in the primary key")
        entry["not_null"] = [c for c in entry["not_null"] if c != column]
        self._publish(name, None, keep=entry["parts"], entry=entry)

    def add_rule(self, name: str, kind: str, rule) -> None:
        """primary, unique, check, not_null or foreign; rows that break it refuse the change."""
        entry = self._changed(name)
        if kind == "primary":
            entry["key"] = list(rule)
            entry["not_null"] = sorted({*entry["not_null"], *rule} - {"id"})
        else:
            entry[kind].append(list(rule) if isinstance(rule, tuple) else rule)
        self._check(name, self.raw(name), entry)
        self._check_unique(name, self.raw(name), entry=entry)
        self._publish(name, None, keep=entry["parts"], entry=entry)

    def drop_rule(self, name: str, rule: str) -> None:
        """By the conventional name: table_pkey, table_column_key, table_check (the n-th: table_checkN), table_column_fkey."""
        entry = self._changed(name)
        if rule == f"{name}_pkey":
            entry["key"] = ["id"]
        elif hit := [u for u in entry["unique"] if rule == f"{name}_{'_'.join(u)}_key"]:
            entry["unique"].remove(hit[0])
        elif hit := [f for f in entry["foreign"] if rule == f"{name}_{f[0]}_fkey"]:
            entry["foreign"].remove(hit[0])
        elif hit := [c for n, c in enumerate(entry["check"]) if rule in (f"{name}_check{n or ''}", f"{name}_check{n + 1}")]:
            entry["check"].remove(hit[0])
        else:
            raise EngineError("42704", f"no constraint {rule}")
        self._publish(name, None, keep=entry["parts"], entry=entry)

    def drop_column(self, name: str, column: str) -> None:
        raw, entry = self.raw(name), self._changed(name)
        if column not in raw.columns:
            raise EngineError("42703", f"no column {column}")
        entry["schema"] = T.StructType([f for f in raw.schema.fields if f.name != column]).json()
        entry.setdefault("dropped", []).append(column)  # files keep it; a new column of the name rewrites them
        self._publish(name, None, keep=entry["parts"], entry=entry)

    def put_object(self, name: str, text: str | None) -> None:
        """Keeps the statement that makes a view, function, index or type, in the order they were made; None forgets it."""
        new = self._copy()
        objects = new.setdefault("objects", {})
        objects.pop(name, None)
        if text is not None:
            objects[name] = text
        self._put(new)

    def _entry(self, name: str) -> dict:
        try:
            return self._state()["tables"][name]
        except KeyError:
            raise EngineError("42P01", f"no table {name}") from None

    # -- reading

    def raw(self, name: str) -> DataFrame:
        return self._read(name, self._entry(name)["parts"])

    def _read(self, name: str, parts: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._entry(name)["schema"]))
        if not parts:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in parts])
        for part, (low, high) in self._entry(name).get("ranges", {}).items():
            if part in parts:  # of which a partitioned change left some rows only
                inside = (F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high)
                df = df.where((_part() != part) | F.coalesce(inside, F.lit(high is None)))
        return df

    def label(self, name: str, part: str) -> str:
        """A name for the rows of a part that count."""
        low, high = self._entry(name).get("ranges", {}).get(part, (None, None))
        return part if low is None and high is None else f"{part}_{low}_{high}"

    def read(self, name: str, policy: Policy) -> DataFrame:
        return policy.read(self.raw(name))

    def get(self, name: str, policy: Policy, tenant: str, row_id: int) -> DataFrame:
        """A point read; an invisible row is as absent as one that never was."""
        return self.read(name, policy).where((F.col(TENANT) == tenant) & (F.col("id") == row_id))

    # -- writing

    def _claim(self, policy: Policy, table: str, operation: str | None, content: str) -> tuple[str, str]:
        if not operation:
            raise EngineError("23502", "an operation id is required")
        if len(operation) > 256:
            raise EngineError("54000", "operation id is longer than 256")
        key, digest = f"{policy.tenant}/{table}/{operation}", hashlib.sha256(content.encode()).hexdigest()
        known = self._known(key)
        if known is not None:
            raise EngineError("23505" if known == digest else "22023", "operation id was used before")
        return key, digest

    def _guard(self, action):
        """One statement: all of it or nothing, what it does to other tables included."""
        own = self.staged is None
        if own:
            self.begin()
        try:
            out = action()
        except BaseException:
            if own:
                self.rollback()
            else:
                self.failed = True
            raise
        if own:
            self.commit()
        return out

    def _rows(self, name: str, policy: Policy, rows: Sequence[dict], visibility: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._entry(name)["schema"]))
        fixed, defaults = {TENANT: policy.tenant, VISIBILITY: visibility}, self._entry(name).get("defaults", {})
        if unknown := {c for r in rows for c in r} - set(schema.names):
            raise EngineError("42703", f"no column {sorted(unknown)[0]}")
        data = [tuple({**defaults, **r, **fixed}.get(f.name) for f in schema.fields) for r in rows]
        return self.spark.createDataFrame(data, schema)

    def load(self, name: str, policy: Policy, df: DataFrame, operation: str | None, visibility: str = "public", on_conflict: str = "error", key: Sequence[str] = ("id",)) -> int:
        """Appends a DataFrame of any size (columns by name; missing ones take their defaults) and returns how many rows.

        Nothing of it passes the driver: values convert and constraints are checked on the executors. What makes two
        loads the same operation is a digest over all of its rows.
        """
        schema, defaults = T.StructType.fromJson(json.loads(self._entry(name)["schema"])), self._entry(name).get("defaults", {})
        if unknown := set(df.columns) - set(schema.names):
            raise EngineError("42703", f"no column {sorted(unknown)[0]}")
        fixed = {TENANT: policy.tenant, VISIBILITY: visibility}
        columns = [F.lit(fixed[f.name]) if f.name in fixed else F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)) for f in schema.fields]
        whole = df.select(*[c.cast(f.dataType).alias(f.name, metadata=f.metadata) for c, f in zip(columns, schema.fields, strict=True)])
        part = uuid.uuid4().hex  # written once; the checks and the commit take it from there
        path = f"{self.root}/{name}/{part}"
        whole.write.parquet(path)
        written = self.spark.read.schema(schema).parquet(path)
        digest = written.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(*) as decimal(38,0)))").alias("sum"), F.expr("bit_xor(xxhash64(*))").alias("xor")).first()
        try:
            self.insert(name, policy, written, operation, visibility, on_conflict, key, frame=f"{digest['n']},{digest['sum']},{digest['xor']}", part=part)
        finally:
            now = self.catalog if self.staged is None else self.staged
            if part not in now["tables"][name]["parts"]:
                self._fs.delete(self._path(path), True)
        return digest["n"]

    def insert(self, name: str, policy: Policy, rows: Sequence[dict] | DataFrame, operation: str | None, visibility: str = "public", on_conflict: str = "error", key: Sequence[str] = ("id",), sets: dict[str, tuple] | None = None, frame: str = "", part: str | None = None) -> DataFrame:
        """Rows of one statement, all or none. ``on_conflict``: error, nothing, or update (by ``key`` among owned rows).

        ``rows`` may be a DataFrame of whole rows, as :meth:`load` makes them; it is read several times.

        Returns the written rows. A key twice in one statement is refused. ``sets`` limits an update to some columns:
        ("excluded", column of the new row) or ("lit", value).
        """

        def act() -> DataFrame:
            content = frame if isinstance(rows, DataFrame) else json.dumps([sorted(r.items()) for r in rows], default=str)
            claim = self._claim(policy, name, operation, json.dumps([content, visibility, on_conflict, list(key), sorted((sets or {}).items(), key=str)], default=str))
            new, old = rows if isinstance(rows, DataFrame) else self._rows(name, policy, rows, visibility), self.raw(name)
            if new.groupBy(*key).count().where("count > 1").limit(1).count():
                raise EngineError("21000", "a key stands twice in the statement")
            few = F.broadcast if not isinstance(rows, DataFrame) and len(rows) <= FEW else (lambda df: df)
            mine = old.where(policy.owned())
            clash = mine.join(few(new.select(*key)), list(key), "left_semi")
            keep, rest = self._entry(name)["parts"], None
            if on_conflict == "error":
                if clash.limit(1).count():
                    raise EngineError("23505", "duplicate key")
                written = new
            elif on_conflict == "nothing":
                written = new.join(clash.select(*key), list(key), "left_anti").select(*new.columns)
            else:
                if clash.where(~policy.visible()).limit(1).count():
                    raise EngineError("42501", "the row can't be written")
                types = dict(old.dtypes)
                before = clash.select(*key, F.struct(*old.columns).alias("_old"))
                joined = new.alias("n").join(before, list(key), "left")

                def after_update(c: str) -> Column:
                    was, now = F.col(f"_old.{c}"), F.col(f"n.{c}")
                    if c in ("id", VISIBILITY) and c not in key or sets is not None and c not in sets and c not in key:
                        changed = was  # a row that is updated keeps its id and visibility
                    elif sets is not None and c in sets:
                        how, value = sets[c]
                        changed = F.col(f"n.{value}") if how == "excluded" else F.lit(value).cast(types[c])
                    else:
                        changed = now
                    return F.when(F.col("_old").isNull(), now).otherwise(changed).alias(c)

                written = joined.select(*[after_update(c) for c in new.columns])
                gone = new.select(*key).withColumn(TENANT, F.lit(policy.tenant))
                touched, keep = self._split(name, few(gone), [*key, TENANT])
                rest = self._read(name, touched).join(few(gone), [*key, TENANT], "left_anti").select(*old.columns)
            self._check(name, written)
            others = old if rest is None else self._read(name, keep).unionByName(rest)
            self._check_unique(name, written, few, others)
            if rest is not None:
                self._publish(name, rest.unionByName(written), claim, keep)
            elif part is not None and on_conflict == "error":
                self._publish(name, None, claim, [*keep, part])
            else:
                self._publish(name, written, claim, keep)
            return written

        return self._guard(act)

    def _change(self, name: str, hit: Column, values: dict[str, Column], claim: tuple[str, str] | None = None) -> DataFrame:
        """Sets columns where ``hit`` holds, in the parts that have such rows; returns the changed rows."""
        touched, keep = self._split(name, hit)
        after, changed = self._after(name, touched, hit, values)
        self._check(name, changed)
        entry = self._entry(name)
        if any(set(values) & set(columns) for columns in (entry["key"], *entry["unique"])):
            self._check_unique(name, self._read(name, keep).unionByName(after))
        self._publish(name, after if touched else None, claim, keep)
        return changed

    def _after(self, name: str, parts: Sequence[str], hit: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
        """(all rows of ``parts`` with columns set where ``hit`` holds, only the changed ones)."""
        old = self._read(name, parts)
        marked = old.withColumn("_hit", F.coalesce(hit, F.lit(False)))
        after = marked.select(*[F.when(F.col("_hit"), values[c].cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in old.dtypes], "_hit")
        return after.drop("_hit"), after.where("_hit").drop("_hit")

    def update(self, name: str, policy: Policy, where: Column, values: dict[str, Column], operation: str | None) -> DataFrame:
        """Owned and visible rows for which ``where`` is true; returns them as they are now."""

        def act() -> DataFrame:
            claim = self._claim(policy, name, operation, f"{where}{ {k: str(v) for k, v in values.items()} }")
            return self._change(name, where & policy.owned() & policy.visible(), values, claim)

        return self._guard(act)

    def _remove(self, name: str, hit: Column, claim: tuple[str, str] | None = None) -> DataFrame:
        touched, keep = self._split(name, hit)
        old = self._read(name, touched)
        self._referenced(name, old.where(hit))
        self._publish(name, old.where(~F.coalesce(hit, F.lit(False))) if touched else None, claim, keep)
        return old.where(hit)

    def delete(self, name: str, policy: Policy, where: Column, operation: str | None) -> DataFrame:
        """Removes owned and visible rows for which ``where`` is true; returns them as they were."""

        def act() -> DataFrame:
            claim = self._claim(policy, name, operation, f"delete {where}")
            return self._remove(name, where & policy.owned() & policy.visible(), claim)

        return self._guard(act)

    def truncate(self, name: str, policy: Policy) -> None:
        """Removes all rows that the tenant owns."""
        self._guard(lambda: self._remove(name, policy.owned()))

    def _chunks(self, name: str, policy: Policy, where: Column, chunk: int, cancelled, values: dict[str, Column] | None) -> int:
        """Chunks in id order, each a commit of its own; every row is met once, the predicate holds anew in each chunk.

        What comes of a row depends on no other row, unless a rule looks at several of them. So the rows after all
        chunks are written once, and a chunk's commit says up to which id they count; rules are checked on all chunks
        before the first, on fewer and fewer if they refuse. Chunks that depend on each other are changed one by one.
        """
        if self.staged is not None:
            raise EngineError("25001", "not inside a transaction")
        mine, cursor, done = where & policy.owned() & policy.visible(), -(1 << 63), 0
        while ends := self._ends(name, mine & (F.col("id") > cursor), chunk):
            at, most = 0, len(ends) if self._independent(name, values) else 1
            before, number = done, self.number
            while at < len(ends) and self.number == number:
                run = ends[at : at + most]
                hit = mine & (F.col("id") > cursor) & (F.col("id") <= run[-1][0])
                ready = None
                try:
                    if len(run) > 1:
                        try:
                            ready = self._prepared(name, hit, values)
                        except EngineError:
                            most = len(run) // 2
                            continue
                    for n, (last, upto) in enumerate(run, 1):
                        if cancelled():
                            raise EngineError("VD002", f"cancelled after {done} rows")
                        if self.number != number:
                            break  # this session wrote meanwhile: what was prepared may be old
                        try:
                            if ready is None:
                                self._guard(lambda h=hit: self._remove(name, h) if values is None else self._change(name, h, values))
                            else:
                                self._guard(lambda e=last if n < len(run) else None, r=ready: self._advance(name, *r, e))
                        except EngineError as e:
                            raise EngineError("VD001", f"ended after {done} rows: {e}") if done else e from None
                        cursor, done, at, number = last, before + upto, at + 1, number + 1
                finally:
                    if ready is not None and ready[2] not in self._entry(name)["parts"]:
                        self._fs.delete(self._path(f"{self.root}/{name}/{ready[2]}"), True)
            if at == len(ends) and self.number == number:
                break
        return done

    def _ends(self, name: str, hit: Column, chunk: int) -> list[tuple[int, int]]:
        """(last id, rows up to it) of each chunk of the rows that ``hit`` holds for; rows of one id are in one chunk.

        The ids are sorted once, into a file a partition; a row's place is its file's and its place there.
        """
        path = f"{self.root}/_chunks-{uuid.uuid4().hex}"
        self.raw(name).where(hit).select("id").orderBy("id").write.parquet(path)
        ids = self.spark.read.schema("id long").parquet(path).select("id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        files = ids.groupBy("file").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        earlier = F.sum("n").over(Window.orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1))
        files = files.select("file", F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("n").over(Window.partitionBy()).alias("all"))
        placed = ids.join(F.broadcast(files), "file").select("id", (F.col("earlier") + F.col("row") + 1).alias("place"), "all")
        end = (F.col("place") % chunk == 0) | (F.col("place") == F.col("all"))
        found = placed.groupBy("id").agg(F.max("place").alias("place"), F.max(end).alias("end")).where("end").collect()
        self._fs.delete(self._path(path), True)
        return sorted((r["id"], r["place"]) for r in found)

    def _independent(self, name: str, values: dict[str, Column] | None) -> bool:
        """Whether no rule makes what comes of a row depend on rows of other chunks, or on other tables' changes."""
        entry = self._entry(name)
        if values is None:
            return not any(parent == name for e in self._state()["tables"].values() for _, parent, _, _ in e["foreign"])
        return not any(set(values) & set(columns) for columns in (entry["key"], *entry["unique"])) and not any(parent == name for _, parent, _, _ in entry["foreign"])

    def _prepared(self, name: str, hit: Column, values: dict[str, Column] | None) -> tuple[list[str], list[str], str]:
        """(parts with rows that ``hit`` holds for, the others, a new part with the former's rows after the change)."""
        touched, keep = self._split(name, hit)
        if values is None:
            after = self._read(name, touched).where(~F.coalesce(hit, F.lit(False)))
        else:
            after, changed = self._after(name, touched, hit, values)
            self._check(name, changed)
        part = uuid.uuid4().hex
        after.write.parquet(f"{self.root}/{name}/{part}")
        return touched, keep, part

    def _advance(self, name: str, touched: Sequence[str], keep: Sequence[str], part: str, end: int | None) -> None:
        """Up to the id ``end`` the rows of ``part`` count, from there on those of the parts ``touched``; None: no more."""
        new = self._copy()
        entry = new["tables"][name]
        ranges = entry.pop("ranges", {})
        ranges.pop(part, None)  # all of its rows count, once the last chunk is through
        if end is not None:
            ranges |= {p: [end if (low := ranges.get(p, [None, None])[0]) is None else max(low, end), ranges.get(p, [None, None])[1]] for p in touched} | {part: [None, end]}
        some = [p for p in touched if end is not None and (ranges[p][1] is None or ranges[p][0] < ranges[p][1])]
        entry["parts"] = [*keep, *some, part]
        if kept := {p: r for p, r in ranges.items() if p in entry["parts"]}:
            entry["ranges"] = kept
        entry["generation"] = entry.get("generation", 0) + 1
        self._put(new)

    def partitioned_update(self, name: str, policy: Policy, where: Column, values: dict[str, Column], operation: str, chunk: int = 1000, cancelled=lambda: False) -> int:
        """An update in chunks; sending it again after a stop goes on with the rows that still fit."""
        return self._chunks(name, policy, where, chunk, cancelled, values)

    def partitioned_delete(self, name: str, policy: Policy, where: Column, operation: str, chunk: int = 1000, cancelled=lambda: False) -> int:
        """A delete in chunks; sending it again after a stop goes on with the rest."""
        return self._chunks(name, policy, where, chunk, cancelled, None)

    # -- constraints

    def _check(self, name: str, df: DataFrame, entry: dict | None = None) -> None:
        """The rules that a row obeys or breaks by itself or by its parents."""
        entry = entry or self._entry(name)
        for column in entry["not_null"]:
            if df.where(F.col(column).isNull()).limit(1).count():
                raise EngineError("23502", f"{column} is null")
        for rule in entry["check"]:
            from corviq.plans.engine import Engine
            from corviq.sql.compiler import predicate  # rules are in the dialect, like everything that users write

            if df.where(~predicate(rule, df, Engine(self.raw, Policy("")))).limit(1).count():
                raise EngineError("23514", f"{rule} is violated")
        for column, parent, target, _ in entry["foreign"]:
            keys = self.raw(parent).select(F.col(target).alias("_p"), F.col(TENANT).alias("_t"))
            orphans = df.where(F.col(column).isNotNull()).join(keys, (F.col(column) == F.col("_p")) & (F.col(TENANT) == F.col("_t")), "left_anti")
            if orphans.limit(1).count():
                raise EngineError("23503", f"{column} has no parent")

    def _check_unique(self, name: str, df: DataFrame, few=None, others: DataFrame | None = None, entry: dict | None = None) -> None:
        """Keys among ``df``, and between it and ``others``: new rows are looked up there, the table isn't grouped."""
        entry = entry or self._entry(name)
        for columns in (entry["key"], *entry["unique"]):
            known = df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(TENANT, *columns)
            twice = known.groupBy(TENANT, *columns).count().where("count > 1").limit(1).count()
            if twice or others is not None and others.join(few(known), [TENANT, *columns], "left_semi").limit(1).count():
                raise EngineError("23505", f"duplicate {', '.join(columns)}")

    def _referenced(self, name: str, gone: DataFrame, depth: int = 0) -> None:
        """What a delete does to the rows that point at it."""
        if depth > 16:
            raise EngineError("54001", "references are nested too deeply")
        for child, entry in list(self._state()["tables"].items()):
            for column, parent, target, action in entry["foreign"]:
                if parent != name:
                    continue
                keys = gone.select(F.col(target).alias("_p"), F.col(TENANT).alias("_t")).distinct()
                rows = self.raw(child)
                match = (F.col(column) == F.col("_p")) & (F.col(TENANT) == F.col("_t"))
                hit = rows.join(keys, match, "left_semi")
                if not hit.limit(1).count():
                    continue
                if action == "restrict":
                    raise EngineError("23503", f"{child} still points at {name}")
                if action == "cascade":
                    self._referenced(child, hit, depth + 1)
                    self._publish(child, rows.join(keys, match, "left_anti"))
                else:
                    default = entry.get("defaults", {}).get(column) if action == "set_default" else None
                    marked = rows.join(keys.withColumn("_h", F.lit(True)), match, "left")
                    self._publish(child, marked.withColumn(column, F.when(F.col("_h"), F.lit(default).cast(dict(rows.dtypes)[column])).otherwise(F.col(column))).select(*rows.columns))
