"""Versioned datasets: Parquet folders for each table, and a manifest that names the files of each version.

A version is written completely before its manifest appears, so readers keep the version that they opened and an
interrupted change leaves nothing behind. Appends add files and a list of deleted row ids; ``compact`` rewrites. All
file access goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.values import ValidationError, coerce, literal
from tabulon.operators.filters import as_value
from tabulon.operators.links import Link, check_links
from tabulon.operators.orders import ROW_ID, out_of_order, sort_columns, with_row_ids
from tabulon.sources.scratch import persist


class Files:
    """A few operations on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        path = self._path("")
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        return self._fs.rename(self._path(a), self._path(b))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by partial aggregates; nulls are keys of their own."""
    names = [c for c in rows.columns if c != order]
    packed = F.max_by(F.struct(*(F.col(f"`{c}`") for c in names)), F.col(order))
    kept = rows.groupBy(*(f"`{k}`" for k in keys)).agg(packed.alias("_r"), F.max(order).alias(order))
    return kept.select("_r.*", order)


class Dataset:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.version = self._latest() if version is None else version
        if self.version is None or not self.files.exists(f"manifest-{self.version:09d}.json"):
            raise ValidationError(f"no dataset at {path}")
        self.manifest = json.loads(self.files.read(f"manifest-{self.version:09d}.json"))

    # -- versions
    def _latest(self) -> int | None:
        found = [int(n[9:18]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")]
        return max(found, default=None)

    def changed(self) -> bool:
        return self._latest() != self.version

    def refresh(self) -> Dataset:
        return Dataset(self.spark, self.path) if self.changed() else self

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], options: dict[str, dict] | None = None, links: list[dict] | None = None, metadata: dict | None = None) -> Dataset:
        """``options``: for each table ``sortedBy`` and ``partitionBy``."""
        files = Files(spark, path)
        if files.names():
            raise ValidationError(f"{path} is not empty")
        made = {}
        for name, df in tables.items():
            made[name] = _write_table(spark, path, name, df, (options or {}).get(name, {}))
        for link in links or []:
            Link.of(link).check(tables)
        _commit(files, 0, {"tables": made, "links": links or [], "shapes": {}, "metadata": metadata or {}})
        return cls(spark, path)

    # -- reading
    def table(self, name: str) -> DataFrame:
        """The table's rows with their ids; deleted ones are left out by one anti join with the lists of all appends."""
        return self._read(self._table(name))

    def _read(self, t: dict) -> DataFrame:
        schema = T.StructType.fromJson(t["schema"])
        wide = T.StructType([*schema.fields, T.StructField(ROW_ID, T.LongType())])
        parts = [self.spark.read.schema(wide).parquet(f"{self.path}/{s['path']}").withColumn(ROW_ID, F.col(ROW_ID) + s["base"]) for s in t["segments"]]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if t["deletes"]:
            gone = self.spark.read.schema(f"{ROW_ID} long").parquet(*(f"{self.path}/{d}" for d in t["deletes"]))
            df = df.join(gone, ROW_ID, "left_anti")
        return df.select(*schema.names, ROW_ID)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.manifest["tables"]}

    def _table(self, name: str) -> dict:
        if name not in self.manifest["tables"]:
            raise ValidationError(f"unknown table {name!r}")
        return self.manifest["tables"][name]

    def check_links(self, limit: int = 10) -> list[dict]:
        return check_links([Link.of(x) for x in self.manifest["links"]], self.tables(), limit)

    def get(self, name: str, row_id: int) -> dict:
        rows = self.table(name).where(F.col(ROW_ID) == row_id).collect()
        if not rows:
            raise LookupError(f"no row {row_id}")
        return rows[0].asDict(recursive=True)

    # -- rewriting
    def update(self, name: str, insert: Any = None, upsert: Any = None, key_columns: list[str] | None = None, delete: Any = None, set_: dict | None = None, where: Any = None, sorted_by: list | None = None) -> dict:
        """One new version with all changes; upserts replace in place, and take precedence over deletes."""
        return self.update_tables({name: {"insert": insert, "upsert": upsert, "key_columns": key_columns, "delete": delete, "set_": set_, "where": where, "sorted_by": sorted_by}})[name]

    def update_tables(self, changes: dict[str, dict]) -> dict[str, dict]:
        """Changes of several tables, each as the arguments of ``update``, in one new version."""
        done = {name: self._rewrite(name, **what) for name, what in changes.items()}
        self._next({**self.manifest, "tables": {**self.manifest["tables"], **{n: made for n, (made, _) in done.items()}}})
        return {n: counts for n, (_, counts) in done.items()}

    def _rewrite(self, name: str, insert: Any = None, upsert: Any = None, key_columns: list[str] | None = None, delete: Any = None, set_: dict | None = None, where: Any = None, sorted_by: list | None = None) -> tuple[dict, dict]:
        t, df = self._table(name), self.table(name)
        schema = T.StructType.fromJson(t["schema"])
        counts = {"inserted": 0, "updated": 0, "deleted": 0}
        before = t["rows"]
        fresh = [self._rows(insert, schema)] if insert is not None else []
        rows = df.withColumn("_keep", F.lit(True)).withColumn("_order", F.lit(0))
        if set_ is not None:
            if where is None:
                raise ValidationError("set needs where")
            if t["options"].get("partitionBy") in set_:
                raise ValidationError("the partition column can't be set")
            hit = as_value(where, df)
            changes = {c: F.when(F.col("_hit"), F.lit(None).cast(schema[c].dataType) if v is None else literal(coerce(v, schema[c].dataType, c), schema[c].dataType).cast(schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c, v in set_.items() if _known(c, schema)}
            rows = rows.withColumn("_hit", hit)
            counts["updated"] += rows.where("_hit").count()
            rows = rows.withColumns(changes).drop("_hit")
        if delete is not None:
            rows = rows.withColumn("_keep", ~as_value(delete, rows))
        if upsert is not None:
            keys = key_columns or []
            if not keys or not set(keys) <= set(schema.names):
                raise ValidationError("upsert needs key columns of the table")
            new = last_per_key(self._rows(upsert, schema, "_place"), keys, "_place").withColumn("_new", F.lit(True))
            firsts = rows.groupBy(*(f"`{k}`" for k in keys)).agg(F.min(ROW_ID).alias("_first"))
            hits = persist(new.alias("n").join(firsts.alias("f"), reduce(lambda a, b: a & b, [F.col(f"n.`{k}`").eqNullSafe(F.col(f"f.`{k}`")) for k in keys]), "left").select("n.*", "_first"), "hits")
            matched = hits.where("_first is not null")
            replaced = matched.select(*(F.col(f"`{c}`") for c in schema.names), F.col("_first").alias(ROW_ID), F.lit(True).alias("_keep"), F.lit(0).alias("_order"))
            others = rows.alias("o").join(matched.select(*(F.col(f"`{k}`").alias(f"_m{i}") for i, k in enumerate(keys))), reduce(lambda a, b: a & b, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]), "left_anti")
            rows = others.select(*replaced.columns).unionByName(replaced)
            fresh.append(hits.where("_first is null").orderBy("_place").select(*(F.col(f"`{c}`") for c in schema.names)))
            counts["updated"] += matched.count()
        kept = rows.where("_keep").select(*schema.names, ROW_ID, "_order")
        for i, extra in enumerate(fresh, 1):
            added = persist(extra.select(*schema.names).withColumn(ROW_ID, F.monotonically_increasing_id()).withColumn("_order", F.lit(i)), "added")
            counts["inserted"] += added.count()
            kept = kept.unionByName(added)
        options = dict(t["options"]) | ({"sortedBy": sorted_by} if sorted_by is not None else {})
        made = _write_table(self.spark, self.path, name, kept, options, order=["_order", ROW_ID])
        counts["rowCount"] = made["rows"]
        counts["deleted"] = before + counts["inserted"] - made["rows"]
        return made, counts

    def _rows(self, rows: Any, schema: T.StructType, order: str | None = None) -> DataFrame:
        """Given rows in the table's schema; unknown columns and nulls in required ones are errors."""
        if not isinstance(rows, DataFrame):
            rows = [dict(r) for r in rows]
            for i, r in enumerate(rows):
                for c, v in r.items():
                    _known(c, schema)
                    r[c] = v if v is None or schema[c].dataType.typeName() in ("array", "struct", "binary") else coerce(v, schema[c].dataType, f"row {i}: {c}")
                for f in schema.fields:
                    if not f.nullable and r.get(f.name) is None:
                        raise ValidationError(f"row {i}: {f.name} is required")
            loose = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields] + [T.StructField("_place", T.LongType())])
            rows = self.spark.createDataFrame([{**r, "_place": i} for i, r in enumerate(rows)], loose)
        elif unknown := set(rows.columns) - set(schema.names) - {ROW_ID}:
            raise ValidationError(f"unknown columns {sorted(unknown)}")
        if "_place" not in rows.columns:
            rows = rows.withColumn("_place", F.monotonically_increasing_id())
        cols = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        return rows.select(*cols, *([F.col("_place").alias(order)] if order else []))

    # -- appending: the cost follows the change
    def append(self, name: str, insert: Any = None, upsert: Any = None, key_columns: list[str] | None = None, delete: Any = None) -> dict:
        return self.begin().add(name, insert, upsert, key_columns, delete).commit()[name]

    def lock(self, stale: float = 3600.0) -> Lock:
        """Hold the dataset's writer lock over several changes: ``with data.lock(): ...``."""
        return Lock(self.files, stale)

    def begin(self) -> Transaction:
        return Transaction(self)

    def _append(self, manifest: dict, name: str, insert: Any, upsert: Any, key_columns: list[str] | None, delete: Any) -> dict:
        t = manifest["tables"][name]
        df = self._read(t)  # without what earlier calls of the transaction delete
        schema, new, gone = T.StructType.fromJson(t["schema"]), [], []
        if delete is not None:
            gone.append(df.where(as_value(delete, df)).select(ROW_ID))
        replaced = 0
        if upsert is not None:
            keys = key_columns or []
            if not keys or not set(keys) <= set(schema.names):
                raise ValidationError("upsert needs key columns of the table")
            rows = persist(last_per_key(self._rows(upsert, schema, "_place"), keys, "_place"), "upserts")
            hit = df.alias("o").join(rows.select(*(F.col(f"`{k}`").alias(f"_m{i}") for i, k in enumerate(keys))), reduce(lambda a, b: a & b, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]), "left_semi")
            replaced = hit.select(*(f"`{k}`" for k in keys)).distinct().count()
            gone.append(hit.select(ROW_ID))
            new.append(rows.select(*schema.names, F.col("_place")))
        if insert is not None:
            new.append(self._rows(insert, schema, "_place"))
        segments, deletes, added = list(t["segments"]), list(t["deletes"]), 0
        if new:
            rows = new[0] if len(new) == 1 else new[0].withColumn("_call", F.lit(0)).unionByName(new[1].withColumn("_call", F.lit(1)))
            made = _write_rows(self.spark, self.path, name, rows, [c for c in ("_call", "_place") if c in rows.columns])
            added = made["rows"]
            if t["options"].get("sortedBy"):
                self._check_after(df, self.spark.read.parquet(f"{self.path}/{made['path']}"), t["options"]["sortedBy"])
            if added:
                segments.append({**made, "base": t["next"]})
        lost = 0
        if gone:
            ids = reduce(lambda a, b: a.unionAll(b), gone).distinct()
            path = f"data/{name}-deletes-{uuid.uuid4().hex}"
            lost = _observed(ids, f"{self.path}/{path}")["rows"]
            if lost:
                deletes.append(path)
        manifest["tables"][name] = {**t, "segments": segments, "deletes": deletes, "next": t["next"] + added, "rows": t["rows"] + added - lost, "deleted": t["deleted"] + lost, "appends": t["appends"] + 1}
        return {"inserted": added - replaced, "updated": replaced, "deleted": lost - replaced, "rowCount": t["rows"] + added - lost}

    def _check_after(self, df: DataFrame, new: DataFrame, keys: list) -> None:
        """Appended rows must be in order and sort at or after the table's last row, by the declared keys of any kind."""
        late = ValidationError("appended rows must sort at or after the last row")
        if not out_of_order(new, keys).isEmpty():
            raise late
        edge = lambda rows, at: rows.orderBy(F.col(ROW_ID).desc() if at < 0 else F.col(ROW_ID)).limit(1)
        names = [k["column"] if isinstance(k, dict) else k.removeprefix("-") for k in keys]
        both = edge(df, -1).select(*names, F.lit(0).cast("long").alias(ROW_ID)).unionByName(edge(new, 1).select(*names, F.lit(1).cast("long").alias(ROW_ID)))
        if not out_of_order(both, keys).isEmpty():
            raise late

    def compact(self, name: str, regroup: bool = False) -> None:
        """Rewrite without deleted rows, in one segment; ``regroup`` puts each partition's rows together."""
        t = self._table(name)
        options = dict(t["options"])
        order = [options["partitionBy"], ROW_ID] if regroup and options.get("partitionBy") else [ROW_ID]
        made = _write_table(self.spark, self.path, name, self.table(name), options, order)
        self._next({**self.manifest, "tables": {**self.manifest["tables"], name: made}})

    def needs_compacting(self, name: str, ratio: float = 0.25, appends: int = 100) -> bool:
        t = self._table(name)
        return t["appends"] >= appends or t["deleted"] >= ratio * max(1, t["rows"] + t["deleted"])

    # -- tables, metadata, templates
    def add_table(self, name: str, df: DataFrame, options: dict | None = None) -> None:
        if name in self.manifest["tables"]:
            raise ValidationError(f"table {name!r} exists")
        self._next({**self.manifest, "tables": {**self.manifest["tables"], name: _write_table(self.spark, self.path, name, df, options or {})}})

    def remove_table(self, name: str) -> None:
        self._table(name)
        if any(name in (x["from"]["table"], x["to"]["table"]) for x in self.manifest["links"]):
            raise ValidationError(f"a link uses table {name!r}")
        shapes = {k: s for k, s in self.manifest["shapes"].items() if s["table"] != name}
        self._next({**self.manifest, "tables": {k: v for k, v in self.manifest["tables"].items() if k != name}, "shapes": shapes})

    def rename_table(self, old: str, new: str) -> None:
        self._table(old)
        if new in self.manifest["tables"]:
            raise ValidationError(f"table {new!r} exists")
        swap = lambda t: new if t == old else t
        links = [{**x, "from": {**x["from"], "table": swap(x["from"]["table"])}, "to": {**x["to"], "table": swap(x["to"]["table"])}} for x in self.manifest["links"]]
        shapes = {k: {**s, "table": swap(s["table"])} for k, s in self.manifest["shapes"].items()}
        self._next({**self.manifest, "tables": {swap(k): v for k, v in self.manifest["tables"].items()}, "links": links, "shapes": shapes})

    def merge_metadata(self, more: dict) -> None:
        self._next({**self.manifest, "metadata": {**self.manifest["metadata"], **more}})

    def save_shapes(self, shapes: dict) -> None:
        self._next({**self.manifest, "shapes": shapes})

    def _next(self, manifest: dict) -> None:
        _commit(self.files, self.version + 1, manifest)
        self.version, self.manifest = self.version + 1, manifest

    # -- introspection
    def storage(self) -> dict:
        used = {s["path"] for t in self.manifest["tables"].values() for s in t["segments"]} | {d for t in self.manifest["tables"].values() for d in t["deletes"]}
        there = [f"data/{n}" for n in self.files.names("data")]
        size = {n: self.files.size(n) for n in there}
        rows = {n: {"rows": t["rows"], "deleted": t["deleted"], "appends": t["appends"]} for n, t in self.manifest["tables"].items()}
        return {"used": sum(v for k, v in size.items() if k in used), "unused": sum(v for k, v in size.items() if k not in used), "tables": rows}

    def vacuum(self, keep: int = 1) -> None:
        """Delete files that the last ``keep`` versions don't name."""
        versions = sorted(int(n[9:18]) for n in self.files.names() if n.startswith("manifest-"))[-keep:]
        used = set()
        for v in versions:
            for t in json.loads(self.files.read(f"manifest-{v:09d}.json"))["tables"].values():
                used |= {s["path"] for s in t["segments"]} | set(t["deletes"])
        for n in self.files.names("data"):
            if f"data/{n}" not in used:
                self.files.delete(f"data/{n}")

    def verify(self, quick: bool = False) -> list[str]:
        """Problems found: files that are missing, segments whose rows or checksum, and tables whose row counts, differ from the manifest."""
        out = []
        for name, t in self.manifest["tables"].items():
            for path in [s["path"] for s in t["segments"]] + t["deletes"]:
                if not self.files.exists(path):
                    out.append(f"{name}: {path} is missing")
            for s in [] if quick or out else t["segments"]:
                rows = self.spark.read.parquet(f"{self.path}/{s['path']}")
                found = rows.agg(*_digest(rows)).first().asDict()
                if "checksum" in s and (found["rows"], found["checksum"]) != (s["rows"], s["checksum"]):
                    out.append(f"{name}: {s['path']} holds other rows than were written")
            if not out and not quick and (n := self.table(name).count()) != t["rows"]:
                out.append(f"{name}: {n} rows, not {t['rows']}")
        return out

    def inspect(self) -> dict:
        return {"version": self.version, "metadata": self.manifest["metadata"], "links": self.manifest["links"], "shapes": list(self.manifest["shapes"]), "tables": {n: {"rows": t["rows"], "options": t["options"], "columns": [{"name": f["name"], "type": f["type"], "nullable": f["nullable"]} for f in t["schema"]["fields"]]} for n, t in self.manifest["tables"].items()}}


def _known(column: str, schema: T.StructType) -> bool:
    if column not in schema.names:
        raise ValidationError(f"unknown or hidden column {column!r}")
    return True


def _commit(files: Files, version: int, manifest: dict) -> None:
    """The manifest appears under its number by one rename, under a lock file that one writer at a time can make."""
    name, draft = f"manifest-{version:09d}.json", f"draft-{uuid.uuid4().hex}.json"
    lock = Lock(files)
    with lock:
        if files.exists(name):
            raise ValidationError("the dataset was changed meanwhile")
        files.write(draft, json.dumps(manifest))
        if not files.rename(draft, name):
            files.delete(draft)
            raise ValidationError("the dataset was changed meanwhile")


class Lock:
    """The single writer of a dataset: a lock file made exclusively, with its owner; one older than ``stale`` seconds is taken over.

    A writer may hold it over several changes; ``commit`` takes it for itself where the process doesn't hold it yet.
    """

    _held: dict[str, int] = {}

    def __init__(self, files: Files, stale: float = 3600.0) -> None:
        self._files, self._stale = files, stale

    def _make(self) -> bool:
        try:
            self._files.write("writer.lock", json.dumps({"owner": f"{socket.gethostname()}-{os.getpid()}", "since": time.time()}))
            return True
        except Py4JJavaError as e:
            if self._files.exists("writer.lock"):
                return False
            raise e

    def __enter__(self) -> Lock:
        root = self._files.root
        if not self._held.get(root):
            if not self._make():
                holder = json.loads(self._files.read("writer.lock") or "{}")
                if time.time() - holder.get("since", 0) < self._stale:
                    raise ValidationError(f"the dataset is locked by {holder.get('owner')}")
                self._files.delete("writer.lock")
                if not self._make():
                    raise ValidationError("the dataset is locked")
        self._held[root] = self._held.get(root, 0) + 1
        return self

    def __exit__(self, *_) -> None:
        root = self._files.root
        self._held[root] -= 1
        if not self._held[root]:
            del self._held[root]
            self._files.delete("writer.lock")


def _digest(df: DataFrame) -> list:
    """Aggregates for the number of rows and a checksum that doesn't depend on their order."""
    plain = [f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*plain).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")]


def _observed(df: DataFrame, target: str) -> dict:
    """Write, and count and digest the rows on their way."""
    seen = Observation()
    df.observe(seen, *_digest(df)).write.parquet(target)
    return seen.get


def _write_rows(spark: SparkSession, path: str, name: str, df: DataFrame, order: list) -> dict:
    target = f"data/{name}-{uuid.uuid4().hex}"
    numbered = with_row_ids(df.withColumnRenamed(ROW_ID, "_old_id") if ROW_ID in df.columns else df, *[("_old_id" if isinstance(c, str) and c == ROW_ID else c) for c in order])
    keep = [c for c in numbered.columns if c not in ("_old_id", "_order", "_place", "_call")]
    return {"path": target, **_observed(numbered.select(*keep), f"{path}/{target}")}


def _write_table(spark: SparkSession, path: str, name: str, df: DataFrame, options: dict, order: list[str] | None = None) -> dict:
    """A table in one segment, sorted as declared, with new row ids."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (ROW_ID, "_order", "_place")])
    if order is None:
        if ROW_ID not in df.columns:
            df = persist(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "placed")  # the place in the input is fixed before rows move
        order = [ROW_ID]
    keys = sort_columns(df, options["sortedBy"]) if options.get("sortedBy") else []
    made = _write_rows(spark, path, name, df, [*keys, *order])
    return {"schema": schema.jsonValue(), "options": options, "segments": [{**made, "base": 0}], "deletes": [], "next": made["rows"], "rows": made["rows"], "deleted": 0, "appends": 0}


class Transaction:
    """Calls collected, then one manifest; a call must not depend on rows that an earlier call adds."""

    def __init__(self, dataset: Dataset) -> None:
        self._dataset, self._calls, self._open = dataset, [], True

    def add(self, name: str, insert: Any = None, upsert: Any = None, key_columns: list[str] | None = None, delete: Any = None) -> Transaction:
        if not self._open:
            raise ValidationError("the transaction has ended")
        self._dataset._table(name)
        schema = T.StructType.fromJson(self._dataset._table(name)["schema"])
        for earlier, e_insert, e_upsert, _, _ in self._calls:
            if earlier != name:
                continue
            for rows in (e_insert, e_upsert):
                if rows is None:
                    continue
                pending = self._dataset._rows(rows, schema)
                if delete is not None and pending.where(as_value(delete, pending)).limit(1).count():
                    raise ValidationError("the call deletes a row that an earlier call adds")
                if upsert is not None:
                    new = self._dataset._rows(upsert, schema).alias("n")
                    on = reduce(lambda a, b: a & b, [F.col(f"p.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in key_columns or []])
                    if pending.alias("p").join(new, on, "left_semi").limit(1).count():
                        raise ValidationError("the call replaces a row that an earlier call adds")
        self._calls.append((name, insert, upsert, key_columns, delete))
        return self

    def commit(self) -> dict[str, dict]:
        manifest = json.loads(json.dumps(self._dataset.manifest))
        out: dict[str, dict] = {}
        for name, *call in self._calls:
            made = self._dataset._append(manifest, name, *call)
            out[name] = {k: made[k] if k == "rowCount" else out.get(name, {}).get(k, 0) + v for k, v in made.items()}
        self._dataset._next(manifest)
        self._open = False
        return out

    def rollback(self) -> None:
        self._calls, self._open = [], False


class GroupWriter:
    """Rows of many callers, from any thread, in few appends.

    Rows wait until there are ``max_rows``, ``max_delay`` seconds have passed since the first of them, or ``flush`` is
    called. A batch that fails is halved, so that only the calls at fault fail. ``close`` flushes; so does ``with``.
    """

    def __init__(self, dataset: Dataset, name: str, max_rows: int = 10_000, max_delay: float | None = None) -> None:
        self._dataset, self._name, self._most, self._delay = dataset, name, max_rows, max_delay
        self._calls: list[list[dict]] = []
        self._guard, self._writing, self._timer = threading.Lock(), threading.Lock(), None
        self.failed: list[tuple[list[dict], Exception]] = []

    def insert(self, rows: Iterable[dict]) -> None:
        with self._guard:
            self._calls.append(list(rows))
            full = sum(map(len, self._calls)) >= self._most
            if not full and self._delay is not None and self._timer is None:
                self._timer = threading.Timer(self._delay, self.flush)
                self._timer.daemon = True
                self._timer.start()
        if full:
            self.flush()

    def flush(self) -> None:
        with self._writing:
            with self._guard:
                calls, self._calls = self._calls, []
                if self._timer is not None:
                    self._timer.cancel()
                    self._timer = None
            self._try(calls)

    close = flush

    def __enter__(self) -> GroupWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _try(self, calls: list[list[dict]]) -> None:
        if not calls:
            return
        try:
            self._dataset.append(self._name, insert=[r for c in calls for r in c])
        except Exception as e:
            if len(calls) == 1:
                self.failed.append((calls[0], e))
                return
            self._try(calls[: len(calls) // 2])
            self._try(calls[len(calls) // 2 :])
