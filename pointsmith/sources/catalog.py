"""Collections as versioned Parquet tables under one folder: catalog, aliases, payload indexes, snapshots.

Every write goes to a new version folder, and then the next numbered catalog file is created. Creating it fails if
another writer has made that number, so no update is lost; the one with the largest number counts, so a writer that is
lost on its way leaves the old state, whole. All paths are Hadoop paths; nothing is opened with local file calls.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import time
import urllib.request
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsmith.operators import mutate
from pointsmith.operators.points import INDEX_TYPES, POINTS, CollectionConfig


class Files:
    """Small files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Whole or not at all: written beside, then renamed over."""
        beside = f"{path}.{uuid.uuid4().hex}.new"
        self._put(beside, data)
        fs, p = self._at(path)
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(self.jvm.org.apache.hadoop.fs.Path(beside), p):
            raise OSError(f"cannot write {path}")

    def _put(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def create(self, path: str, data: bytes) -> bool:
        """False if the file is there. Written beside, then renamed to a name that no one has: readers see it whole."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        # A claim decides between writers on file systems whose rename replaces files.
        try:
            fs.create(self.jvm.org.apache.hadoop.fs.Path(f"{path}.claim"), False).close()
        except Exception:  # noqa: BLE001  another writer has it
            return False
        beside = f"{path}.{uuid.uuid4().hex}.new"
        self._put(beside, data)
        return bool(fs.rename(self.jvm.org.apache.hadoop.fs.Path(beside), p))


class Conflict(RuntimeError):
    """Another writer has changed the catalog meanwhile; the state is theirs, nothing of this write counts."""


#: How long a claim without a catalog file, of a writer that was lost, holds others up.
CLAIM_SECONDS = 30


#: One file that is read on the driver, at most.
MAX_IMPORT_BYTES = 256 << 20

#: Fixed answers of the service calls; there is no service, so they have no state.
SERVICE = {
    "health": {"status": "ok"},
    "ready": {"status": "ready"},
    "cluster": {"status": "disabled"},
    "issues": {"issues": []},
    "telemetry": {"collections": {}},
}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # -- names
    def _numbers(self) -> list[int]:
        return sorted(int(n[8:-5]) for n in self.files.names(f"{self.root}/catalog") if n.startswith("catalog-") and n.endswith(".json"))

    def _meta(self) -> dict:
        """The state of the largest number. A file that a writer has just removed is looked up again."""
        for _ in range(5):
            numbers = self._numbers()
            if not numbers:
                return {"collections": {}, "aliases": {}, "number": 0}
            try:
                return json.loads(self.files.read(f"{self.root}/catalog/catalog-{numbers[-1]:012d}.json")) | {"number": numbers[-1]}
            except Exception:  # noqa: BLE001
                if self._numbers()[-1:] == numbers[-1:]:
                    raise
        raise Conflict("the catalog changes faster than it can be read")

    def _save(self, meta: dict) -> None:
        """The state after `meta`'s number; Conflict if there is one already. The last five states stay."""
        number = meta["number"] + 1
        path = f"{self.root}/catalog/catalog-{number:012d}.json"
        data = json.dumps(meta | {"number": number}, indent=1, sort_keys=True).encode()
        began = time.time()
        while not self.files.create(path, data):
            if self.files.exists(path):
                raise Conflict(f"catalog state {number} is another writer's")
            if time.time() - began > CLAIM_SECONDS:  # a writer was lost between its claim and its file
                self.files.delete(f"{path}.claim")
                began = time.time()
            time.sleep(0.2)
        for old in self._numbers()[:-5]:
            for tail in ("", ".claim"):
                self.files.delete(f"{self.root}/catalog/catalog-{old:012d}.json{tail}")

    def resolve(self, name: str) -> str:
        """A collection's own name; a direct name comes before an alias."""
        meta = self._meta()
        if name in meta["collections"]:
            return name
        if name in meta["aliases"]:
            return meta["aliases"][name]
        raise KeyError(f"no such collection: {name}")

    def create_collection(self, config: CollectionConfig) -> None:
        meta = self._meta()
        if config.name in meta["collections"]:
            raise ValueError(f"collection exists: {config.name}")
        meta["collections"][config.name] = asdict(config) | {"version": 0, "path": None, "operations": 0}
        self._save(meta)

    def collection_exists(self, name: str) -> bool:
        try:
            self.resolve(name)
        except KeyError:
            return False
        return True

    def list_collections(self) -> list[str]:
        return sorted(self._meta()["collections"])

    def get_config(self, name: str) -> CollectionConfig:
        own = self._meta()["collections"][self.resolve(name)]
        return CollectionConfig(**{k: own[k] for k in CollectionConfig.__dataclass_fields__})

    def update_collection(self, name: str, **changes) -> None:
        meta = self._meta()
        meta["collections"][self.resolve(name)] |= {k: v for k, v in changes.items() if k in CollectionConfig.__dataclass_fields__ and k != "name"}
        self._save(meta)

    def delete_collection(self, name: str) -> None:
        """The collection goes, with the aliases that name it."""
        meta, own = self._meta(), self.resolve(name)
        del meta["collections"][own]
        meta["aliases"] = {a: c for a, c in meta["aliases"].items() if c != own}
        self._save(meta)
        self.files.delete(f"{self.root}/data/{own}")

    def create_alias(self, alias: str, name: str) -> None:
        meta = self._meta()
        meta["aliases"][alias] = self.resolve(name)
        self._save(meta)

    def delete_alias(self, alias: str) -> bool:
        meta = self._meta()
        found = meta["aliases"].pop(alias, None) is not None
        self._save(meta)
        return found

    def rename_alias(self, old: str, new: str) -> None:
        meta = self._meta()
        meta["aliases"][new] = meta["aliases"].pop(old)
        self._save(meta)

    def list_aliases(self, name: str | None = None) -> dict[str, str]:
        own = self.resolve(name) if name else None
        return {a: c for a, c in sorted(self._meta()["aliases"].items()) if own in (None, c)}

    # -- payload indexes: typed hints, kept with the collection
    def create_payload_index(self, name: str, field: str, kind: str = "keyword") -> None:
        if kind.lower() not in INDEX_TYPES:
            raise ValueError(f"index type must be one of {INDEX_TYPES}")
        indexes = self.get_config(name).payload_indexes | {field: kind.lower()}
        self.update_collection(name, payload_indexes=indexes)

    def delete_payload_index(self, name: str, field: str) -> None:
        self.update_collection(name, payload_indexes={k: v for k, v in self.get_config(name).payload_indexes.items() if k != field})

    def get_payload_indexes(self, name: str) -> dict[str, str]:
        return self.get_config(name).payload_indexes

    # -- data
    def points(self, name: str) -> DataFrame:
        own = self._meta()["collections"][self.resolve(name)]
        return self.spark.read.parquet(own["path"]) if own["path"] else self.spark.createDataFrame([], POINTS)

    def write(self, name: str, points: DataFrame, batch: tuple[str, int] | None = None, since: int | None = None) -> int:
        """points become the collection's next version; returns the operation's number. The last two versions stay.

        batch (stream, number) is kept in the same catalog entry, so a batch and its number are committed at once.
        since: the collection's version that points were made from; Conflict if it has moved on meanwhile.
        """
        own = self.resolve(name)
        path = f"{self.root}/data/{own}/v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        points.write.parquet(path)
        for attempt in range(20):
            meta = self._meta()
            entry = meta["collections"][own]
            if since is not None and entry["version"] != since:
                self.files.delete(path)
                raise Conflict(f"{own} has moved on from version {since} to {entry['version']}")
            entry |= {"path": path, "version": entry["version"] + 1, "operations": entry["operations"] + 1}
            if batch:
                entry["batches"] = entry.get("batches", {}) | {batch[0]: batch[1]}
            try:
                self._save(meta)
                break
            except Conflict:  # of another collection's change: its state is read and ours added
                if attempt == 19:
                    raise
        for old in self.files.names(f"{self.root}/data/{own}")[:-2]:
            self.files.delete(f"{self.root}/data/{own}/{old}")
        return entry["operations"]

    def last_batch(self, name: str, stream: str) -> int:
        """The number of the stream's last batch that is in the collection, -1 for none."""
        return self._meta()["collections"][self.resolve(name)].get("batches", {}).get(stream, -1)

    def upsert(self, name: str, incoming: DataFrame, order_col: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """The whole batch or nothing: a vector of a wrong length fails the write before the catalog moves.

        The collection is rewritten by one aggregate over ids, so few large batches are better than many small ones.
        """
        from pointsmith.operators.points import check_dimension

        version = self._meta()["collections"][self.resolve(name)]["version"]
        checked = check_dimension(incoming, self.get_config(name).vector_dim)
        current = self.points(name)
        if current.isEmpty() and set(checked.columns) - set(current.columns):
            current = self.spark.createDataFrame([], checked.schema)
        return self.write(name, mutate.upsert(current, checked, order_col=order_col), batch, version)

    # -- snapshots
    def _snapshots(self, name: str) -> str:
        return f"{self.root}/snapshots/{self.resolve(name)}"

    def create_snapshot(self, name: str) -> str:
        """A full copy with its configuration and a checksum over rows, committed by its manifest."""
        own = self.resolve(name)
        label = f"{own}-{time.strftime('%Y-%m-%d-%H-%M-%S')}-{uuid.uuid4().hex[:6]}.snapshot"
        path = f"{self._snapshots(own)}/{label}"
        self.points(own).write.parquet(f"{path}/points")
        manifest = {"config": asdict(self.get_config(own)), **self._checksum(self.spark.read.parquet(f"{path}/points"))}
        self.files.write(f"{path}/manifest.json", json.dumps(manifest).encode())
        return label

    @staticmethod
    def _checksum(df: DataFrame) -> dict:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"sum(cast(xxhash64(to_json(struct({', '.join(f'`{c}`' for c in sorted(df.columns))}))) as decimal(38,0)))").alias("x")).first()
        return {"rows": row["n"], "checksum": str(row["x"])}

    def list_snapshots(self, name: str | None = None) -> list[str]:
        names = [self.resolve(name)] if name else self.list_collections()
        return [s for n in names for s in self.files.names(f"{self.root}/snapshots/{n}") if self.files.exists(f"{self.root}/snapshots/{n}/{s}/manifest.json")]

    def load_snapshot(self, path: str) -> tuple[CollectionConfig, DataFrame]:
        """Configuration and points; fails on a missing manifest or a wrong checksum."""
        if not self.files.exists(f"{path}/manifest.json"):
            raise ValueError(f"not a whole snapshot: {path}")
        manifest = json.loads(self.files.read(f"{path}/manifest.json"))
        points = self.spark.read.parquet(f"{path}/points")
        if self._checksum(points) != {k: manifest[k] for k in ("rows", "checksum")}:
            raise ValueError(f"checksum does not match: {path}")
        return CollectionConfig(**manifest["config"]), points

    def delete_snapshot(self, name: str, snapshot: str) -> None:
        self.files.delete(f"{self._snapshots(name)}/{snapshot}")

    def recover_snapshot(self, name: str, snapshot: str) -> None:
        """The collection becomes what the snapshot holds; created if it isn't there. snapshot: a label or a path."""
        path = snapshot if "/" in snapshot else f"{self.root}/snapshots/{self._own_or(name)}/{snapshot}"
        config, points = self.load_snapshot(path)
        if not self.collection_exists(name):
            config.name = name
            self.create_collection(config)
        self.write(name, points)

    def _own_or(self, name: str) -> str:
        return self.resolve(name) if self.collection_exists(name) else name

    def export_json(self, name: str, path: str) -> None:
        """Points as gzipped JSON lines, for other tools."""
        self.points(name).write.mode("overwrite").json(path, compression="gzip")

    def import_bytes(self, name: str, data: bytes, checksum: str | None = None) -> str:
        """A snapshot file from elsewhere: gzipped or plain JSON {config, points}, or a tar with a config only.

        Returns what it was: json or config. One file is one driver-side read; large data comes as a folder.
        """
        import gzip

        if checksum and hashlib.sha256(data).hexdigest() != checksum.lower():
            raise ValueError("checksum does not match")
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        if data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                member = next((m for m in t.getmembers() if m.name.endswith("config.json")), None)
                config = json.loads(t.extractfile(member).read()) if member else {}
            if not self.collection_exists(name):
                own = config.get("params", {}).get("vectors", {})
                self.create_collection(CollectionConfig(name, own.get("size", 128), {"Euclid": "Euclidean"}.get(own.get("distance"), own.get("distance") or "Cosine")))
            return "config"
        from pointsmith.operators.points import points_from_records

        body = json.loads(data)
        if not self.collection_exists(name):
            config = body.get("config", {})
            self.create_collection(CollectionConfig(name, config.get("vector_dim", 0), config.get("distance", "Cosine")))
        points = points_from_records(self.spark, body.get("points", []))
        self.write(name, points.withColumn("version", F.coalesce("version", F.lit(0)).cast("bigint")))
        return "json"

    def upload_snapshot(self, name: str, data: bytes, checksum: str | None = None) -> str:
        """A snapshot file that a client sends: kept beside the collection's snapshots, then imported."""
        if checksum and hashlib.sha256(data).hexdigest() != checksum.lower():
            raise ValueError("checksum does not match")
        own = self._own_or(name)
        self.files.write(f"{self.root}/snapshots/{own}/uploads/{hashlib.sha256(data).hexdigest()[:16]}.snapshot", data)
        return self.import_bytes(name, data)

    def import_url(self, name: str, url: str, checksum: str | None = None, most: int = MAX_IMPORT_BYTES) -> str:
        """A snapshot file from a URL of at most `most` bytes, or of any path that Hadoop knows."""
        if url.startswith(("http://", "https://")):
            with urllib.request.urlopen(url) as r:
                data = r.read(most + 1)
            if len(data) > most:
                raise ValueError(f"more than {most} bytes: give large data as a folder that Spark reads")
            return self.import_bytes(name, data, checksum)
        return self.import_bytes(name, self.files.read(url), checksum)

    # -- the whole database
    def save_all(self, path: str) -> None:
        """Every collection's current version under path, in a folder of this dump; the manifest is written last and
        commits it. The dump before stays whole until then, and goes afterwards."""
        part = f"dump-{time.time_ns()}"
        meta = self._meta()
        for name in sorted(meta["collections"]):
            self.points(name).write.parquet(f"{path}/{part}/{name}")
        self.files.write(f"{path}/manifest.json", json.dumps(meta | {"part": part}).encode())
        for old in self.files.names(path):
            if old.startswith("dump-") and old != part:
                self.files.delete(f"{path}/{old}")

    def load_all(self, path: str) -> None:
        if not self.files.exists(f"{path}/manifest.json"):
            raise ValueError(f"not a whole dump: {path}")
        meta = json.loads(self.files.read(f"{path}/manifest.json"))
        for name, entry in meta["collections"].items():
            if self.collection_exists(name):
                self.delete_collection(name)
            self.create_collection(CollectionConfig(**{k: entry[k] for k in CollectionConfig.__dataclass_fields__}))
            self.write(name, self.spark.read.parquet(f"{path}/{meta['part']}/{name}"))
        now = self._meta()
        now["aliases"] |= meta["aliases"]
        self._save(now)

    def metrics(self) -> str:
        """Totals in the Prometheus text format."""
        names = self.list_collections()
        points = sum(self.points(n).count() for n in names)
        return f"# TYPE collections_total gauge\ncollections_total {len(names)}\n# TYPE points_total gauge\npoints_total {points}\n"
