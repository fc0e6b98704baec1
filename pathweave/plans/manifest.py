"""Build status as a JSON document, and the pointer to the published build."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import date, datetime

from pyspark.sql import SparkSession

from pathweave.plans import storage


@dataclass
class Manifest:
    """What a build has finished; tables are stored by stage, so a new run starts after the last finished one."""

    dump_date: str = ""
    vertexes_loaded: bool = False
    redirects_resolved: bool = False
    edges_resolved: bool = False
    edges_sorted: bool = False
    build_complete: bool = False
    vertex_count: int = 0
    edge_count: int = 0
    resolved_edge_count: int = 0
    #: distinct edges without self-loops
    distinct_edge_count: int = 0
    #: into which the blocks are dealt
    buckets: int = 0
    stage_seconds: dict[str, float] = field(default_factory=dict)
    stage_rows: dict[str, int] = field(default_factory=dict)

    def rates(self) -> dict[str, int]:
        """Rows a second of each stage."""
        return {name: round(rows / max(self.stage_seconds[name], 0.001)) for name, rows in self.stage_rows.items()}

    def date(self) -> date | None:
        try:
            return datetime.strptime(self.dump_date, "%Y%m%d").date()
        except ValueError:
            return None


def load(spark: SparkSession, folder: str) -> Manifest:
    path = f"{folder}/status.json"
    if not storage.exists(spark, path):
        return Manifest()
    return Manifest(**json.loads(storage.read_bytes(spark, path)))


def save(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    storage.write_bytes(spark, f"{folder}/status.json", json.dumps(asdict(manifest), indent=2).encode())


def publish(spark: SparkSession, base: str, dump_date: str, clean: bool = False) -> list[str]:
    """Point ``current`` to a build; ``clean`` removes the other dated folders, which are returned."""
    storage.write_bytes(spark, f"{base}/current", dump_date.encode())
    old = [name for name in storage.children(spark, base) if name != dump_date and Manifest(dump_date=name).date() and len(name) == 8] if clean else []
    for name in old:
        storage.delete(spark, f"{base}/{name}")
    return old


def current(spark: SparkSession, base: str) -> str | None:
    path = f"{base}/current"
    return storage.read_bytes(spark, path).decode() if storage.exists(spark, path) else None
