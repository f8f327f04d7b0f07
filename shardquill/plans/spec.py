"""Tables, their columns and keys, and the store's settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from dataclasses import replace as _replace

#: Canonical columns in the order of a file's header, keys and fields compared as times.
COLUMNS = {
    "Comment": ["objectId", "user_id", "comment", "insertedAt", "ip", "link", "mail", "nick", "pid", "rid", "status", "ua", "url", "createdAt", "updatedAt"],
    "Counter": ["objectId", "time", "url", "createdAt", "updatedAt"],
    "Users": ["objectId", "display_name", "email", "password", "type", "url", "avatar", "label", "github", "twitter", "facebook", "google", "weibo", "qq", "oidc", "createdAt", "updatedAt"],
}
SHARD_KEYS = {"Comment": "url", "Counter": "url", "Users": "objectId"}
TIME_FIELDS = frozenset(["insertedAt", "createdAt", "updatedAt"])
MANIFEST_COLUMNS = ["shard_path", "row_count", "sha", "updated_at", "min_key", "max_key"]


@dataclass(frozen=True)
class TableSpec:
    """``hashed``: families are prefixes of the key's SHA-1 rather than of the key. ``counters``: columns merged as sums."""

    name: str
    columns: tuple[str, ...]
    shard_key: str
    primary_key: str = "objectId"
    hashed: bool = True
    counters: tuple[str, ...] = ()
    times: frozenset = TIME_FIELDS


TABLES = {
    name: TableSpec(name, tuple(columns), SHARD_KEYS[name], hashed=SHARD_KEYS[name] != "objectId", counters=("time",) if name == "Counter" else ())
    for name, columns in COLUMNS.items()
}


def table_spec(name: str) -> TableSpec:
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(sorted(TABLES))}")
    return TABLES[name]


@dataclass(frozen=True)
class StoreConfig:
    """Settings, each also read from an environment variable of its name in capitals; empty ones keep the default."""

    store_dir: str = "data"
    shard_max_rows: int = 2000
    shard_hash_len: int = 2
    max_retries: int = 3
    retry_base_ms: int = 300
    dedup_window_seconds: int = 60
    snapshot_keep: int = 30
    snapshot_hour: int = 3

    @classmethod
    def from_env(cls, env=None, **changes) -> StoreConfig:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get({"store_dir": "CSV_STORE_DIR", "snapshot_keep": "SNAPSHOT_KEEP_DAYS"}.get(f.name, f.name.upper()))
            if raw is None or not str(raw).strip():
                continue
            try:
                found[f.name] = int(str(raw).strip()) if isinstance(f.default, int) else raw
            except ValueError:
                raise ValueError(f"{f.name.upper()} must be an integer, not {raw!r}") from None
        return _replace(cls(), **found, **changes)
