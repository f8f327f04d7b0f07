"""A versioned store of tables as sharded CSV: atomic commits with optimistic locking, snapshots, maintenance.

A version is one file ``_log/<n>.json``, created exclusively, that names each table's manifest; a manifest lists the
table's shards with row count, sha, key range, header and the folder that holds the data. Data folders are never changed
once written, so readers of a version are never disturbed, a snapshot is a copy of a version's file, and a commit that
is lost leaves nothing visible. Changes are declarations (rows to add, updates and deletions by ``where``): where another
writer was first they are applied again to what is there now, and so neither side's rows or counts are lost.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import re
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import iso, text_of
from ..operators import dml
from ..operators.layout import parse_shard_path, path_column, plan_merge, route, shard_path, with_family
from ..operators.manifest import columns_of, contents, entries, with_sha
from ..plans import query
from ..plans.predicates import compile_where, families
from ..plans.spec import TABLES, StoreConfig, TableSpec, table_spec
from . import csvio
from .files import Files, qualified


class ConflictError(Exception):
    """Another writer published first, each time it was tried."""


class Store:
    def __init__(self, spark: SparkSession, root: str, config: StoreConfig | None = None, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC), sleep: Callable[[float], None] = time.sleep):
        self.spark, self.config, self.clock, self.sleep = spark, config or StoreConfig(), clock, sleep
        self.root = qualified(spark, f"{root.rstrip('/')}/{self.config.store_dir}")
        self.files = Files(spark, self.root)
        self.counters = defaultdict(int)
        self._daily: str | None = None

    # versions

    def version(self) -> int:
        """The latest version; -1 for an empty store."""
        return max((int(x[:-5]) for x in self.files.list("_log") if re.fullmatch(r"\d+\.json", x)), default=-1)

    def state(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if n < 0:
            return {"version": -1, "manifests": {}}
        text = self.files.read(f"_log/{n:020d}.json")
        if text is None:
            raise ValueError(f"no version {n}")
        return json.loads(text)

    def manifest(self, table: str, version: int | None = None) -> dict[str, dict]:
        return self._entries(self.state(version), table)

    def _entries(self, state: dict, table: str) -> dict[str, dict]:
        name = state["manifests"].get(table_spec(table).name)
        return csvio.decode_manifest(self.files.read(name)) if name else {}

    def manifest_frame(self, table: str, version: int | None = None) -> DataFrame:
        rows = [(p, parse_shard_path(p)[1], parse_shard_path(p)[2], e["row_count"], e["sha"], e["min_key"], e["max_key"]) for p, e in self.manifest(table, version).items()]
        return self.spark.createDataFrame(rows, "shard_path string, family string, suffix int, row_count bigint, sha string, min_key string, max_key string")

    # reading

    def read(self, table: str, where: dict | None = None, version: int | None = None) -> DataFrame:
        """A table's rows, from the shards that ``where`` can concern (the caller still filters by it)."""
        return self._read(table_spec(table), self.manifest(table, version), families(table_spec(table), where, self.config.shard_hash_len)).drop("shard_path")

    def _read(self, spec: TableSpec, held: dict[str, dict], only: set[str] | None = None, paths: set[str] | None = None) -> DataFrame:
        groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
        for path, e in held.items():
            if (only is None or parse_shard_path(path)[1] in only) and (paths is None or path in paths):
                groups[tuple(json.loads(e["columns"]))].append(f"{self.root}/{e['place']}")
        rows = csvio.read_groups(self.spark, groups)
        if rows is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*spec.columns, "shard_path"]]))
        place = F.regexp_extract("__file", r"family=([^/]+)/suffix=(\d+)/", 1)
        suffix = F.regexp_extract("__file", r"family=([^/]+)/suffix=(\d+)/", 2).cast("int")
        return rows.withColumn("shard_path", path_column(spec.name, F.replace(F.url_decode(place), F.lit("~"), F.lit("/")), suffix)).drop("__file")

    def shards(self, table: str, where: dict | None = None, version: int | None = None) -> list[str]:
        """Paths of the shards that ``read`` reads."""
        only = families(table_spec(table), where, self.config.shard_hash_len)
        return sorted(p for p in self.manifest(table, version) if only is None or parse_shard_path(p)[1] in only)

    def select(self, table: str, where: dict | None = None, version: int | None = None, **options) -> DataFrame:
        return query.select(self.read(table, where, version), where, primary_key=table_spec(table).primary_key, **options)

    def count(self, table: str, where: dict | None = None, group: list[str] | None = None, version: int | None = None) -> DataFrame:
        return query.count(self.read(table, where, version), where, group)

    def get(self, table: str, key: str, version: int | None = None) -> DataFrame:
        spec = table_spec(table)
        return query.get(self.read(table, {spec.primary_key: key}, version), key, spec.primary_key)

    def shard_of(self, table: str, key: str) -> str | None:
        """The path of the shard that holds a primary key."""
        spec = table_spec(table)
        rows = self._read(spec, self.manifest(table), families(spec, {spec.primary_key: key}, self.config.shard_hash_len))
        found = rows.where(F.col(spec.primary_key) == key).select("shard_path").limit(1).collect()
        return found[0][0] if found else None

    # writing

    def begin(self) -> "Transaction":
        return Transaction(self)

    def add(self, table: str, rows: DataFrame | list[dict], **options) -> list[str]:
        txn = self.begin()
        ids = txn.add(table, rows, **options)
        txn.commit()
        return ids

    def update(self, table: str, patch, where: dict | None) -> int:
        return self.begin().update(table, patch, where).commit()

    def delete(self, table: str, where: dict | None) -> int:
        return self.begin().delete(table, where).commit()

    def publish(self, base: int, manifests: dict[str, str], message: str, marks: dict[str, int] | None = None) -> bool:
        """Make version base + 1; False if it is there already. ``marks``: the last batch of each stream that it holds."""
        made = {"version": base + 1, "parent": base, "time": iso(self.clock()), "message": message, "manifests": manifests, "marks": marks or {}}
        return self.files.create(f"_log/{base + 1:020d}.json", json.dumps(made, sort_keys=True))

    def attempt(self, change: Callable[[dict], dict[str, str] | None], message: str, mark: tuple[str, int] | None = None) -> int:
        """Apply ``change`` to the latest version until its result could be published; None from it means no change.

        ``mark``: a stream and the number of its batch; a version that holds that batch already is not changed.
        """
        for n in range(self.config.max_retries):
            state = self.state()
            marks = state.get("marks", {})
            if mark and marks.get(mark[0], -1) >= mark[1]:
                return state["version"]
            manifests = change(state)
            if manifests is None:
                return state["version"]
            if n:
                self.counters["retries"] += 1
            marks = marks | dict([mark]) if mark else marks
            if self.publish(state["version"], manifests, message, *([marks] if marks else [])):
                self.counters["commits"] += 1
                return state["version"] + 1
            self.counters["conflicts"] += 1
            self.sleep((self.config.retry_base_ms * 2**n + random.random() * 100) / 1000)
        self.counters["failures"] += 1
        self.counters["rollbacks"] += 1
        raise ConflictError(f"{message}: lost to other writers {self.config.max_retries} times")

    def write_manifest(self, table: str, held: dict[str, dict]) -> str:
        name = f"_manifests/{table}-{uuid.uuid4().hex}.csv"
        text = csvio.encode_manifest([{**e, "shard_path": p, "sha": e["sha"] or ""} for p, e in held.items()])
        self.files.create(name, text)
        return name

    def write_shards(self, spec: TableSpec, rows: DataFrame, known: dict[str, dict] | None = None) -> dict[str, dict]:
        """Rows (with family and suffix) as one folder of files for each shard; their manifest entries.

        The rows are computed once. A shard whose content is in ``known`` (entries by sha) is not written again.
        """
        rows, held = self._staged(rows)
        try:
            return self._write(spec, rows, known or {})
        finally:
            self.files.remove(held)

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        name = f"_staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}"), name

    def _write(self, spec: TableSpec, rows: DataFrame, known: dict[str, dict]) -> dict[str, dict]:
        place = f"data/{spec.name}/{uuid.uuid4().hex}"
        names = columns_of(spec, [c for c in rows.columns if c not in ("family", "suffix", "shard_path")])
        extras = [c for c in names if c not in spec.columns]
        whole = rows.withColumn("shard_path", path_column(spec.name, F.col("family"), F.col("suffix")))
        # a shard's header has the further columns that its own rows use
        used = whole.groupBy("shard_path").agg(*[F.max(F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", 1).otherwise(0)).alias(f"__u{i}") for i, c in enumerate(extras)], F.count("*").alias("__n"))
        stats = {r.shard_path: r for r in entries(whole, spec).join(used, "shard_path").collect()}
        by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
        for path, r in stats.items():
            by_header[tuple(c for c in names if c in spec.columns or r[f"__u{extras.index(c)}"])].append(path)
        out: dict[str, dict] = {}
        now = iso(self.clock())
        for i, (header, paths) in enumerate(sorted(by_header.items())):
            mine = whole if len(by_header) == 1 else self._only(whole, paths)
            shas = {r.shard_path: r.sha for r in with_sha(contents(mine, spec, list(header))).select("shard_path", "sha").collect()}
            for path in [p for p in paths if shas[p] in known]:
                r, same = stats[path], known[shas[path]]
                out[path] = {"row_count": r.row_count, "sha": shas[path], "updated_at": now, "min_key": r.min_key, "max_key": r.max_key, "place": same["place"], "columns": same["columns"]}
            fresh = [p for p in paths if p not in out]
            if not fresh:
                continue
            if len(fresh) < len(paths):
                mine, paths = self._only(whole, fresh), fresh
            dealt = mine.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header], F.replace("family", F.lit("/"), F.lit("~")).alias("family"), "suffix")
            # a file costs more than its rows: tasks by the number of files, which coalescing by bytes would put in one
            tasks = min(len(fresh), max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism))
            csvio.write_csv(dealt.repartition(tasks, "family", "suffix").sortWithinPartitions("family", "suffix", spec.primary_key), f"{self.root}/{place}/{i}", ["family", "suffix"])
            for path in paths:
                _, family, suffix = parse_shard_path(path)
                r = stats[path]
                folder = f"{place}/{i}/family={_escaped(family)}/suffix={suffix}"
                out[path] = {"row_count": r.row_count, "sha": shas[path], "updated_at": now, "min_key": r.min_key, "max_key": r.max_key, "place": folder, "columns": json.dumps(list(header))}
        return out

    def _only(self, rows: DataFrame, paths: list[str]) -> DataFrame:
        """Rows of some shards; short lists are broadcast."""
        names = self.spark.createDataFrame([(p,) for p in paths], "shard_path string")
        return rows.join(F.broadcast(names) if len(paths) <= 100_000 else names, "shard_path", "left_semi")

    def known(self, held: dict[str, dict]) -> dict[str, dict]:
        """Entries by content address."""
        return {e["sha"]: e for e in held.values() if e["sha"]}

    def blob(self, sha: str, version: int | None = None) -> str | None:
        """The text of the shard with a content address, in the latest or a given version; None if there is none."""
        state = self.state(version)
        for table in state["manifests"]:
            held = self._entries(state, table)
            for path, e in held.items():
                if e["sha"] == sha:
                    spec = table_spec(table)
                    found = contents(self._read(spec, held, paths={path}), spec, json.loads(e["columns"])).collect()
                    return found[0].content if found else None
        return None

    # snapshots

    def create_snapshot(self, date: str | None = None) -> str | None:
        """Name the latest version; None for an empty store. A snapshot of the same date is replaced."""
        state = self.state()
        if state["version"] < 0 or not any(self._entries(state, t) for t in state["manifests"]):
            return None
        date = _date(date or self.clock().date().isoformat())
        self.files.remove(f"_snapshots/{date}.json")
        self.files.create(f"_snapshots/{date}.json", json.dumps(state, sort_keys=True))
        return date

    def snapshots(self) -> list[str]:
        return sorted((x[:-5] for x in self.files.list("_snapshots") if x.endswith(".json")), reverse=True)

    def snapshot_files(self, date: str) -> list[tuple[str, str]]:
        """(path, sha) of all that a snapshot holds, by path."""
        state = self._snapshot(date)
        return sorted((p, e["sha"]) for t in state["manifests"] for p, e in self._entries(state, t).items())

    def snapshot_csv(self, date: str) -> str:
        """A snapshot as the text of a ``path,sha`` file, for tools that read that form."""
        return csvio.encode_rows([{"path": p, "sha": sha} for p, sha in self.snapshot_files(date)], ["path", "sha"])

    def import_snapshot(self, date: str, text: str) -> str:
        """A ``path,sha`` text as the snapshot of a date, as :meth:`snapshot_csv` writes it; a shard is found by its content address.

        Raises if no version or snapshot holds one of the shards; a snapshot of the same date is replaced.
        """
        _date(date)
        wanted = [(r["path"], r["sha"]) for r in csvio.decode_rows(text)]
        tables = {p: parse_shard_path(p) for p, _ in wanted}
        if odd := [p for p, t in tables.items() if t is None or t[0] not in TABLES]:
            raise ValueError(f"no shard paths: {', '.join(odd[:5])}")
        log = sorted((int(x[:-5]) for x in self.files.list("_log") if re.fullmatch(r"\d+\.json", x)), reverse=True)
        found: dict[tuple[str, str], dict] = {}
        seen: set[str] = set()
        for state in (read(x) for read, names in ((self.state, log), (self._snapshot, self.snapshots())) for x in names):
            for table, name in state["manifests"].items():
                if name not in seen:
                    seen.add(name)
                    for e in self._entries(state, table).values():
                        found.setdefault((table, e["sha"]), e)
            if all((tables[p][0], sha) in found for p, sha in wanted):
                break
        if lost := [p for p, sha in wanted if (tables[p][0], sha) not in found]:
            raise ValueError(f"no version holds the content of {', '.join(lost[:5])}")
        held: dict[str, dict[str, dict]] = defaultdict(dict)
        for p, sha in wanted:
            held[tables[p][0]][p] = found[tables[p][0], sha]
        manifests = {t: self.write_manifest(t, entries_) for t, entries_ in held.items()}
        made = {"version": self.version(), "parent": -1, "time": iso(self.clock()), "message": "imported", "manifests": manifests, "marks": {}}
        self.files.remove(f"_snapshots/{_date(date)}.json")
        self.files.create(f"_snapshots/{date}.json", json.dumps(made, sort_keys=True))
        return date

    def _snapshot(self, date: str) -> dict:
        text = self.files.read(f"_snapshots/{_date(date)}.json")
        if text is None:
            raise ValueError(f"no snapshot {date}")
        return json.loads(text)

    def prune_snapshots(self, keep: int | None = None) -> list[str]:
        """Remove all but the newest ``keep`` snapshots; none if it is 0 or less."""
        keep = self.config.snapshot_keep if keep is None else keep
        gone = self.snapshots()[keep:] if keep > 0 else []
        for date in gone:
            self.files.remove(f"_snapshots/{date}.json")
        return gone

    def restore(self, date: str) -> int:
        """A new version with exactly a snapshot's state; what has not been committed is not touched by it."""
        manifests = self._snapshot(date)["manifests"]
        return self.attempt(lambda state: manifests, f"restore {date}")

    def maybe_run_daily(self) -> bool:
        """Snapshot and prune once a day after the set hour; a day counts as done only after success."""
        now = self.clock()
        day = now.date().isoformat()
        if now.hour < self.config.snapshot_hour or self._daily == day or day in self.snapshots():
            return False
        self.create_snapshot(day)
        self.prune_snapshots()
        self._daily = day
        return True

    # maintenance

    def compact(self, table: str) -> dict[str, int]:
        """Merge the families whose shards fit in one."""
        spec, result = table_spec(table), {"merged": 0, "removed": 0}

        def change(state):
            held = self._entries(state, table)
            by: dict[str, dict[int, int]] = defaultdict(dict)
            for p, e in held.items():
                _, family, suffix = parse_shard_path(p)
                by[family][suffix] = e["row_count"]
            merge = {f for f, counts in by.items() if plan_merge(counts, self.config.shard_max_rows)}
            if not merge:
                return None
            rows = with_family(self._read(spec, held, merge).drop("shard_path"), spec, self.config.shard_hash_len).withColumn("suffix", F.lit(0))
            gone = {p for p in held if parse_shard_path(p)[1] in merge}
            result.update(merged=len(merge), removed=len(gone) - len(merge))
            kept = {p: e for p, e in held.items() if p not in gone} | self.write_shards(spec, rows)
            return state["manifests"] | {table: self.write_manifest(table, kept)}

        self.attempt(change, f"compact {table}")
        return result

    def rebuild(self, table: str, unlisted: bool = False) -> dict[str, int]:
        """Make the manifest agree with the data that is there: counts, keys and shas anew; vanished shards go.

        ``unlisted``: shards that are there, but in no version's manifest, come in too, where the manifest has no shard
        of their path. Use it while nobody writes: a writer's shards are unlisted until they are committed.
        """
        spec, result = table_spec(table), {"changed": 0, "removed": 0}

        def change(state):
            listed = self._entries(state, table)
            held = (self._unlisted(spec) if unlisted else {}) | listed
            there = {p: e for p, e in held.items() if self._exists(e["place"])}
            kept = {}
            groups = defaultdict(set)
            for p, e in there.items():
                groups[e["columns"]].add(p)
            for columns, paths in groups.items():
                rows = self._read(spec, there, paths=paths)
                for r in entries(rows, spec).join(with_sha(contents(rows, spec, json.loads(columns))).select("shard_path", "sha"), "shard_path").collect():
                    kept[r.shard_path] = there[r.shard_path] | {"row_count": r.row_count, "min_key": r.min_key, "max_key": r.max_key, "sha": r.sha}
            result.update(changed=sum(p not in listed or kept[p]["sha"] != held[p]["sha"] or kept[p]["row_count"] != held[p]["row_count"] for p in kept), removed=len(listed) - sum(p in kept for p in listed))
            return state["manifests"] | {table: self.write_manifest(table, kept)} if result["changed"] or result["removed"] else None

        self.attempt(change, f"rebuild {table}")
        return result

    def _unlisted(self, spec: TableSpec) -> dict[str, dict]:
        """Entries, still without counts, of shard folders that no version names."""
        if spec.name not in self.files.list("data"):
            return {}
        versions = [self.state(int(x[:-5])) for x in self.files.list("_log") if re.fullmatch(r"\d+\.json", x)]
        named = {e["place"] for s in versions for e in self._entries(s, spec.name).values()}
        out: dict[str, dict] = {}
        for columns, files in csvio.header_groups(self.spark, f"{self.root}/data/{spec.name}").items():
            for file in files:
                m = re.search(rf"/(data/{spec.name}/[^/]+/\d+/family=([^/]+)/suffix=(\d+))/[^/]+$", file)
                if m and (place := unquote(m[1])) not in named and m[1] not in named:
                    path = shard_path(spec.name, unquote(unquote(m[2])).replace("~", "/"), int(m[3]))
                    out[path] = {"row_count": 0, "sha": None, "updated_at": iso(self.clock()), "min_key": "", "max_key": "", "place": place, "columns": json.dumps(list(columns))}
        return out

    def _exists(self, place: str) -> bool:
        return any(x.endswith(".csv") for x in self.files.list(place))

    def reset(self, keep_snapshots: bool = True, confirm: bool = False) -> int:
        """Drop the history: a new version with the latest state, all versions before it gone, and the data that only they used.

        What other writers commit meanwhile stays, and so does what they are about to commit: only folders and manifests
        that a dropped version or snapshot names, and no other, are removed.
        """
        if not confirm:
            raise ValueError("reset drops all history; call it with confirm=True")
        state = self.state()
        if state["version"] < 0:
            return -1
        version = self.attempt(lambda s: s["manifests"], "reset")
        numbers = lambda: sorted(int(x[:-5]) for x in self.files.list("_log") if re.fullmatch(r"\d+\.json", x))
        used = lambda states: ({m for s in states for m in s["manifests"].values()}, {"/".join(e["place"].split("/")[:3]) for s in states for t in s["manifests"] for e in self._entries(s, t).values()})
        old = [n for n in numbers() if n < version]
        gone = [self.state(n) for n in old]
        if not keep_snapshots:
            for date in self.snapshots():
                gone.append(self._snapshot(date))
                self.files.remove(f"_snapshots/{date}.json")
        manifests, places = used(gone)
        for n in old:
            self.files.remove(f"_log/{n:020d}.json")
        kept = used([*(self.state(n) for n in numbers()), *(self._snapshot(d) for d in self.snapshots())])
        for x in [*(manifests - kept[0]), *(places - kept[1])]:
            self.files.remove(x)
        return version

    def tree(self) -> DataFrame:
        """(path, size): every data file there is."""
        files = self.spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.csv").load(f"{self.root}/data")
        return files.select("path", F.col("length").alias("size"))

    def stats(self) -> dict:
        state = self.state()
        held = {t: self._entries(state, t) for t in state["manifests"]}
        return {"version": state["version"], "shards": {t: len(h) for t, h in held.items()}, "rows": {t: sum(e["row_count"] for e in h.values()) for t, h in held.items()}, "snapshots": len(self.snapshots()), **self.counters}

    def export_csv(self, table: str, path: str) -> None:
        """The table as plain CSV below ``path``, one header for all."""
        spec = table_spec(table)
        rows = self.read(table)
        csvio.write_csv(rows.select(*columns_of(spec, rows.columns)), path)


class Transaction:
    """Changes that become visible together, or not at all. They apply in the order they were staged."""

    def __init__(self, store: Store):
        self.store, self.staged, self.mark = store, [], None

    def seen(self, stream: str, batch: int) -> bool:
        """Whether the store holds this batch of a stream; the commit will then hold it, or change nothing if another one does by then."""
        self.mark = stream, batch
        return self.store.state().get("marks", {}).get(stream, -1) >= batch

    def add(self, table: str, rows: DataFrame | list[dict], dedup: bool | None = None) -> list[str] | DataFrame:
        """Stage new rows under new ids and return these (a DataFrame of them for a DataFrame).

        Comments sent again within the dedup window are not added; the id of the one that is there is returned.
        """
        spec, store = table_spec(table), self.store
        listed = isinstance(rows, list)
        if listed:
            names = sorted({k for r in rows for k in r} - {spec.primary_key}) or [spec.shard_key]
            rows = store.spark.createDataFrame([(str(i), *(text_of(r.get(n)) for n in names)) for i, r in enumerate(rows)], T.StructType([T.StructField(n, T.StringType()) for n in ("__nth", *names)]))
        rows = rows.drop(spec.primary_key)
        now = store.clock()
        # ids are drawn once, and kept with their rows, so that a retry writes the same ones
        place = f"{store.root}/_staged/{uuid.uuid4().hex}"
        rows = dml.add(rows.limit(0).withColumn(spec.primary_key, F.lit("")), rows, spec, now=now)
        rows.write.parquet(place)
        rows = store.spark.read.parquet(place)
        if (table == "Comment" and store.config.dedup_window_seconds > 0) if dedup is None else dedup:
            rows = self._fresh(rows, spec, now)
        self.staged.append(("add", table, rows.drop("__nth"), None))
        own = F.coalesce("__same", spec.primary_key) if "__same" in rows.columns else F.col(spec.primary_key)
        if not listed:
            return rows.select(own.alias(spec.primary_key))
        return [r[1] for r in sorted(rows.select(F.col("__nth").cast("int"), own).collect())]

    def _fresh(self, rows: DataFrame, spec: TableSpec, now: dt.datetime) -> DataFrame:
        """``rows`` with ``__same``: the id of the row, here or in the store, that a row repeats."""
        store, key = self.store, spec.primary_key
        mark = dml.dedup_hash(F.col("mail"), F.col("url"), F.col("comment"))
        urls = [r[0] for r in rows.select("url").distinct().limit(1001).collect()]
        since = now - dt.timedelta(seconds=store.config.dedup_window_seconds)
        held = store.read("Comment", {"url": ["IN", urls]} if len(urls) <= 1000 else None)
        recent = held.where(F.try_to_timestamp("insertedAt") >= F.lit(since)).select(mark.alias("__h"), F.col(key).alias("__old")).groupBy("__h").agg(F.min("__old").alias("__old"))
        hashed = rows.withColumn("__h", mark)
        first = hashed.where("__h is not null").groupBy("__h").agg(F.min(key).alias("__first"))
        joined = hashed.join(recent, "__h", "left").join(first, "__h", "left")
        same = F.coalesce("__old", F.when(F.col("__first") != F.col(key), F.col("__first")))
        return joined.withColumn("__same", same).drop("__h", "__old", "__first")

    def update(self, table: str, patch, where: dict | None) -> Transaction:
        self.staged.append(("update", table, patch, where))
        return self

    def delete(self, table: str, where: dict | None) -> Transaction:
        self.staged.append(("delete", table, None, where))
        return self

    def stage(self, kind: str, table: str, value=None, where: dict | None = None):
        if kind not in ("add", "update", "delete"):
            raise ValueError(f"no operation {kind!r}")
        return self.add(table, value) if kind == "add" else self.update(table, value, where) if kind == "update" else self.delete(table, where)

    def commit(self) -> int:
        """Publish what was staged; the new version. Raises ConflictError, with nothing visible, if others keep winning."""
        staged, self.staged = self.staged, []
        if not staged:
            return self.store.version()
        message = ", ".join(f"{kind} {table}" for kind, table, _, _ in staged)
        tables = list(dict.fromkeys(t for _, t, _, _ in staged))

        def change(state):
            manifests, changed = dict(state["manifests"]), False
            for table in tables:
                held = self.store._entries(state, table)
                after = self._apply(table_spec(table), held, [s for s in staged if s[1] == table])
                if after is not None:
                    manifests[table] = self.store.write_manifest(table, after)
                    changed = True
            return manifests if changed else None

        return self.store.attempt(change, message, self.mark)

    def _apply(self, spec: TableSpec, held: dict[str, dict], staged: list) -> dict[str, dict] | None:
        changed = False
        for kind, _, value, where in staged:
            after = self._insert(spec, held, value) if kind == "add" else self._change(spec, held, kind, value, where)
            if after is not None:
                held, changed = after, True
        return held if changed else None

    def _insert(self, spec: TableSpec, held: dict[str, dict], rows: DataFrame) -> dict[str, dict] | None:
        if "__same" in rows.columns:
            rows = rows.where("__same is null").drop("__same")
        return self._place(spec, held, rows)

    def _place(self, spec: TableSpec, held: dict[str, dict], rows: DataFrame) -> dict[str, dict] | None:
        """``held`` with ``rows`` routed into its shards; shards that get rows are written anew, together with theirs."""
        store = self.store
        counts = [(parse_shard_path(p)[1], parse_shard_path(p)[2], e["row_count"]) for p, e in held.items()]
        frame = store.spark.createDataFrame(counts, "family string, suffix int, row_count bigint")
        routed = route(with_family(rows, spec, store.config.shard_hash_len), frame, store.config.shard_max_rows, spec.primary_key)
        routed, staged = store._staged(routed)
        touched = {r[0] for r in routed.select(path_column(spec.name, F.col("family"), F.col("suffix"))).distinct().collect()}
        if not touched:
            store.files.remove(staged)
            return None
        old = store._read(spec, held, paths=touched & set(held))
        place = old.withColumn("suffix", F.coalesce(F.nullif(F.regexp_extract("shard_path", r"-(\d+)\.csv$", 1), F.lit("")).cast("int"), F.lit(0)))
        place = place.withColumn("family", F.regexp_extract("shard_path", r"^\w+/([^/]+/[^/]+?)(?:-\d+)?\.csv$", 1)).drop("shard_path")
        written = store.write_shards(spec, place.unionByName(routed, allowMissingColumns=True), store.known(held))
        store.files.remove(staged)
        return {p: e for p, e in held.items() if p not in touched} | written

    def _change(self, spec: TableSpec, held: dict[str, dict], kind: str, patch, where: dict | None) -> dict[str, dict] | None:
        """Shards with rows of ``where`` written anew; rows whose key changed move to their new family."""
        store = self.store
        rows = store._read(spec, held, families(spec, where, store.config.shard_hash_len))
        hit = compile_where(rows, where)
        hit = F.lit(True) if hit is None else F.coalesce(hit, F.lit(False))
        paths = {r[0] for r in rows.where(hit).select("shard_path").distinct().collect()}
        if not paths:
            return None
        rows = store._read(spec, held, paths=paths)
        hit = compile_where(rows, where)
        hit = F.lit(True) if hit is None else F.coalesce(hit, F.lit(False))
        if kind == "delete":
            return self._rewrite(spec, held, rows.where(~hit), paths)
        given = dict(patch(rows) if callable(patch) else patch)
        changed = dml.update(rows, given, where, spec, now=store.clock(), where_column=hit)
        if spec.shard_key not in given:
            return self._rewrite(spec, held, changed, paths)
        moved = with_family(changed, spec, store.config.shard_hash_len)
        own = F.regexp_extract("shard_path", r"^\w+/([^/]+/[^/]+?)(?:-\d+)?\.csv$", 1)
        stay = moved.where(F.col("family") == own).drop("family")
        leave = moved.where(F.col("family") != own).drop("family", "shard_path")
        leave, staged = store._staged(leave)
        rewritten = self._rewrite(spec, held, stay, paths)
        placed = self._place(spec, rewritten, leave) or rewritten
        store.files.remove(staged)
        return placed

    def _rewrite(self, spec: TableSpec, held: dict[str, dict], rows: DataFrame, paths: set[str]) -> dict[str, dict]:
        own = rows.withColumn("suffix", F.coalesce(F.nullif(F.regexp_extract("shard_path", r"-(\d+)\.csv$", 1), F.lit("")).cast("int"), F.lit(0)))
        own = own.withColumn("family", F.regexp_extract("shard_path", r"^\w+/([^/]+/[^/]+?)(?:-\d+)?\.csv$", 1)).drop("shard_path")
        return {p: e for p, e in held.items() if p not in paths} | self.store.write_shards(spec, own, self.store.known(held))


def _escaped(family: str) -> str:
    """A family as the writer's folder name: ``/`` as ``~``, and what Hadoop escapes in partition values."""
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\{[]^' or ord(c) < 32 or ord(c) == 127 else c for c in family.replace("/", "~"))


def _date(text: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"a date is YYYY-MM-DD, not {text!r}")
    return text
