"""The client's operations as queries and log entries over one namespace.

``Store`` holds four tables: ops (the log), chunks (id, data), locations (id,
node) and nodes.  Writes append log entries and new chunks; reads are queries over
the folded log.  Nothing is collected but what a call returns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunks, cluster, oplog, versions
from tessera.sources import stores

CLAIMS = "upload long, idx long, id string, size long"


class NotFound(LookupError):
    pass


class Refused(ValueError):
    """The log refused the operation; the reason is the argument."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    ops: DataFrame
    chunks: DataFrame
    locations: DataFrame
    nodes: DataFrame
    chunk_size: int = 4 << 20
    quotas: tuple[tuple[str, int], ...] = ()
    retain: int = 2

    @staticmethod
    def empty(spark: SparkSession, **settings) -> Store:
        return Store(
            spark, spark.createDataFrame([], oplog.OPS), spark.createDataFrame([], "id string, size long, data binary"), spark.createDataFrame([], "id string, node long"),
            spark.createDataFrame([], "node long, rack long, used long, alive boolean, slow boolean, admin string"), **settings,
        )

    # --- the log ---------------------------------------------------------------------------------------

    def results(self) -> DataFrame:
        return oplog.fold(self.ops, dict(self.quotas), self.retain)

    def versions(self) -> DataFrame:
        return oplog.accepted_versions(self.ops, self.results())

    def _append(self, *entries: dict) -> tuple[Store, list]:
        last = self.ops.agg(F.max("log_index")).first()[0] or 0
        base = {"log_index": 0, "op": "", "request": "", "path": "", "ns": "", "expected": -1, "upload": 0, "idx": 0, "id": "", "n_chunks": 0, "size": 0, "version": 0, "epochs": 0}
        rows = [tuple((base | {"log_index": last + 1 + i} | e).values()) for i, e in enumerate(entries)]
        new = replace(self, ops=self.ops.unionByName(self.spark.createDataFrame(rows, oplog.OPS)))
        got = new.results().filter(F.col("log_index") > last).orderBy("log_index").collect()
        for r in got:
            if not r.accepted:
                raise Refused(r.reason)
        return new, got

    @staticmethod
    def _space(path: str) -> str:
        return path.split("/")[1] if path.count("/") else ""

    # --- operations ------------------------------------------------------------------------------------

    def put(self, path: str, data: bytes, expected: int = -1, request: str = "") -> Store:
        """Begin, claim and commit; chunks that are stored already are not stored again."""
        new, got = self._append({"op": "begin", "request": request or f"{path}#{self.ops.count()}", "path": path, "ns": self._space(path), "expected": expected, "n_chunks": -(-len(data) // self.chunk_size), "size": len(data)})
        upload = got[0].upload
        return new._claim(upload, 0, data).commit(upload)

    def _claim(self, upload: int, first: int, data: bytes) -> Store:
        """Claims of the chunks of ``data`` from place ``first`` on; chunks that are stored already are not stored again."""
        file = self.spark.createDataFrame([("", "", data, len(data))], "path string, ns string, content binary, size long")
        pieces = chunks.chunk_scan(file, self.chunk_size).collect()  # ids of one file
        if not pieces:
            return self
        parts = [(p.id, p.size, data[p.idx * self.chunk_size : (p.idx + 1) * self.chunk_size]) for p in pieces]
        fresh = stores.put_chunks(self.chunks, self.spark.createDataFrame(parts, "id string, size long, data binary"))
        new, _ = self._append(*({"op": "claim", "upload": upload, "idx": first + p.idx, "id": p.id, "size": p.size} for p in pieces))
        return replace(new, chunks=new.chunks.unionByName(fresh))

    def _upload_of(self, path: str, version: int) -> int | None:
        """The upload whose chunks a version has; an undelete leads back to the version that it restored."""
        r = self.results().filter("accepted")
        made = self.ops.filter("op in ('commit', 'undelete')").select("log_index", "op", "path", F.col("version").alias("asked"), F.col("upload").alias("u"))
        begun = self.ops.filter("op = 'begin'").join(r.filter("reason = ''").select("log_index", F.col("upload").alias("u")), "log_index").select("u", F.col("path").alias("p"))
        own = made.join(r.select("log_index", F.col("version").alias("v")), "log_index").join(begun, "u", "left").filter(F.coalesce("p", "path") == path)
        rows = {x.v: x for x in own.collect()}  # the versions of one path
        while version in rows and rows[version].op == "undelete":
            version = rows[version].asked or max((v for v in rows if v < version), default=0)
        return rows[version].u if version in rows else None

    def manifest(self, path: str, version: int = 0) -> DataFrame:
        """(idx, id, size) of a version; 0 is the live one."""
        asked = versions.lookup(self.versions(), self.spark.createDataFrame([(path, version)], "path string, v long")).select("v").first()
        upload = self._upload_of(path, asked.v) if asked else None
        return self.ops.filter((F.col("op") == "claim") & (F.col("upload") == (upload if upload is not None else -1))).select("idx", "id", "size").distinct().orderBy("idx")

    def get(self, path: str, version: int = 0) -> bytes:
        """The bytes of a version, every chunk checked against its id."""
        if versions.lookup(self.versions(), self.spark.createDataFrame([(path, version)], "path string, v long")).isEmpty():
            raise NotFound(path)
        parts = self.manifest(path, version).join(self.chunks.select("id", "data"), "id").orderBy("idx").withColumn("ok", F.sha2("data", 256) == F.col("id")).collect()
        if not all(p.ok for p in parts):
            raise ValueError("a chunk does not hash to its id")
        return b"".join(bytes(p.data) for p in parts)

    def list(self, prefix: str) -> DataFrame:
        return versions.live(self.versions()).filter(F.col("path").startswith(prefix)).select("path", "v", "size").orderBy("path")

    def log(self, path: str) -> DataFrame:
        return versions.version_log(self.versions().filter(F.col("path") == path), self.retain).orderBy("v")

    def delete(self, path: str, expected: int = 0) -> Store:
        return self._append({"op": "delete", "path": path, "ns": self._space(path), "expected": expected})[0]

    def undelete(self, path: str, version: int = 0, expected: int = 0) -> Store:
        """A new version with the content of ``version``; 0 is the last that was no tombstone."""
        return self._append({"op": "undelete", "path": path, "ns": self._space(path), "expected": expected, "version": version})[0]

    # --- resumable uploads -----------------------------------------------------------------------------

    def begin(self, path: str, size: int, expected: int = -1, request: str = "") -> tuple[Store, int]:
        """The store with a pending upload, and its number; a request that was begun before gives the same number."""
        new, got = self._append({"op": "begin", "request": request or f"{path}#{self.ops.count()}", "path": path, "ns": self._space(path), "expected": expected, "n_chunks": -(-size // self.chunk_size), "size": size})
        return new, got[0].upload

    def offset(self, upload: int) -> int:
        """Bytes of the leading run of claimed chunks."""
        rows = self.ops.filter((F.col("op") == "claim") & (F.col("upload") == upload)).select("idx", "size").distinct().orderBy("idx").collect()  # one upload
        return sum(r.size for i, r in enumerate(rows) if r.idx == i)

    def append(self, upload: int, offset: int, data: bytes) -> Store:
        """Whole chunks at the upload's offset; only the last of a file may be short."""
        if offset != self.offset(upload) or offset % self.chunk_size:
            raise Refused("offset")
        size = self.ops.filter("op = 'begin'").join(self.results().filter(F.col("upload") == upload).select("log_index"), "log_index").select("size").first()
        if size is None:
            raise Refused("not found")
        if not data or offset + len(data) > size[0] or (len(data) % self.chunk_size and offset + len(data) != size[0]):
            raise Refused("invalid")
        return self._claim(upload, offset // self.chunk_size, data)

    def commit(self, upload: int) -> Store:
        return self._append({"op": "commit", "upload": upload})[0]

    def abort(self, upload: int) -> Store:
        return self._append({"op": "abort", "upload": upload})[0]

    # --- administration ---------------------------------------------------------------------------------

    def node_admin(self, node: int, state: str) -> Store:
        """Active, draining or decommissioned; the last only after draining, and never back to draining from it."""
        now = self.nodes.filter(F.col("node") == node).select("admin").first()
        if now is None:
            raise NotFound(str(node))
        if state not in ("active", "draining", "decommissioned") or (state == "decommissioned" and now.admin == "active") or (state == "draining" and now.admin == "decommissioned"):
            raise Refused("invalid")
        return replace(self, nodes=self.nodes.withColumn("admin", F.when(F.col("node") == node, state).otherwise(F.col("admin"))))

    def stat(self, path: str) -> DataFrame:
        """(path, v, size, idx, id, replicas) of the live version, a row a chunk."""
        live = versions.live(self.versions()).filter(F.col("path") == path).select("path", "v", "size")
        held = self.locations.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("replicas"))
        return live.crossJoin(self.manifest(path).select("idx", "id")).join(held, "id", "left").orderBy("idx")  # one file

    def deleted(self) -> DataFrame:
        return versions.deleted(self.versions())

    def set_retention(self, path: str, epochs: int) -> Store:
        return self._append({"op": "retention", "path": path, "epochs": epochs})[0]

    def advance_epoch(self) -> Store:
        return self._append({"op": "epoch"})[0]

    def status(self, upload: int) -> DataFrame:
        """Claimed and durable leading runs of a pending upload."""
        claims = self.ops.filter((F.col("op") == "claim") & (F.col("upload") == upload)).select(F.col("upload").alias("version"), "idx", "id").distinct()
        return versions.resume_offset(claims, self.chunks)

    def cluster(self, factor: int = 3) -> DataFrame:
        return cluster.health(cluster.replicas(self.chunks.select("id", "size"), self.locations, self.nodes), factor)
