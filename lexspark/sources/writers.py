"""Writers: chunk store, versioned indexes, submissions, failure log."""

from __future__ import annotations

import json
import os
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Old rows without those of new keys, and the new rows; columns in `keep` (such as created_at) stay as they were."""
    if keep:
        before = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(before, key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


def without_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of other documents than these."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def pending_documents(found: DataFrame, state: DataFrame) -> DataFrame:
    """Found documents (document_id, checksum, ...) that aren't done: a completed or failed state with the same checksum
    counts as done, a completed one only if it is in the store (`stored`)."""
    done = state.where((F.col("status") == "failed") | ((F.col("status") == "completed") & F.col("stored")))
    return found.join(done.select("document_id", "checksum"), ["document_id", "checksum"], "left_anti")


class IndexVersions:
    """Versions of an index under a folder, each a folder of Parquet tables; CURRENT names the published one.

    Small files are read and written through Hadoop's file system, so any store that Spark reaches will do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Writes a new file beside the old one and moves it there."""
        to, new = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.new")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(to):
            self._fs.delete(to, False)
        if not self._fs.rename(new, to):
            raise OSError(f"{to} could not be written")

    def next_version(self) -> str:
        """v1, v2 and so on: one more than the largest there is."""
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return f"v{1 + max((int(n[1:]) for n in names if re.fullmatch(r'v[0-9]+', n)), default=0)}"

    def write(self, version: str, tables: dict[str, DataFrame], manifest: dict, keep: dict[str, str] | None = None) -> dict:
        """Writes the tables of a version and a manifest with status building, then ready or failed after its checks.

        `keep` names tables that stay as they are and the version that has them: the manifest then points at that version's
        files, which are neither read nor written, so a version that changes one half costs that half alone.
        """
        if not _VERSION.fullmatch(version):
            raise ValueError(f"not a version name: {version}")
        kept = {name: self.place(source, name) for name, source in (keep or {}).items() if name not in tables}
        own = {name: f"{version}/{name}" for name in tables}
        if any(place in kept.values() for place in own.values()):
            raise ValueError(f"{version} would write over tables that it keeps")
        counts = {name: self.manifest(source)["counts"][name] for name, source in (keep or {}).items() if name in kept}
        self._write(f"{version}/manifest.json", json.dumps(manifest | {"version": version, "status": "building", "tables": own | kept}))
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{own[name]}")
        counts |= {name: self.read(version, name).count() for name in tables}
        manifest = manifest | {"version": version, "counts": counts, "tables": own | kept}
        manifest["issues"] = manifest_issues(manifest)
        manifest["status"] = "failed" if manifest["issues"] else "ready"
        self._write(f"{version}/manifest.json", json.dumps(manifest))
        return manifest

    def place(self, version: str, name: str) -> str:
        """Where a version's table lies: in its own folder, or in that of the version whose table it keeps."""
        return ((self.manifest(version) or {}).get("tables") or {}).get(name, f"{version}/{name}")

    def read(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.place(version, name)}")

    def report(self, version: str, found: dict) -> None:
        """Puts an ingestion's report (counts, failures, times) beside its version's manifest, in one move."""
        self._write(f"{version}/report.json", json.dumps(found | {"version": version}, indent=2, sort_keys=True))

    def read_report(self, version: str) -> dict | None:
        text = self._read(f"{version}/report.json")
        return json.loads(text) if text else None

    def fingerprint(self, folder: str = "") -> dict[str, tuple[int, int]]:
        """Size and time of change of every file under a folder, by name; journals that readers leave behind don't count.

        Take it before and after a job that must not change what it reads, and compare.
        """
        root, out = self._path(f"{self.root}/{folder}".rstrip("/")), {}
        files = self._fs.listFiles(root, True) if self._fs.exists(root) else None
        while files is not None and files.hasNext():
            status = files.next()
            name = status.getPath().toUri().getPath()[len(self._path(self.root).toUri().getPath()) + 1 :]
            if not name.endswith(("-shm", "-wal", "-journal", ".crc")):
                out[name] = (status.getLen(), status.getModificationTime())
        return out

    def stage(self, version: str, tables: dict[str, DataFrame], changes: dict | None = None) -> dict:
        """A new version of the current one with these tables in place of its own, not published; the others are kept."""
        now = self.current()
        if now is None:
            raise ValueError("there is no current version to build on")
        if self.manifest(version):
            raise ValueError(f"{version} is there already")
        old = self.manifest(now)
        named = old.get("tables") or {name: f"{now}/{name}" for name in old["counts"]}
        base = {k: v for k, v in old.items() if k not in ("version", "status", "counts", "tables", "issues")}
        return self.write(version, tables, base | (changes or {}) | {"built_on": now}, keep={name: now for name in named})

    def readiness(self, version: str) -> list[str]:
        """What keeps a version from being searched, table by table: a missing folder, an unfinished write, another row count."""
        manifest = self.manifest(version)
        if not manifest:
            return [f"{version} has no manifest"]
        out = [] if manifest["status"] == "ready" else [f"{version} is {manifest['status']}"]
        for name, rows in manifest.get("counts", {}).items():
            place = f"{self.root}/{self.place(version, name)}"
            if not self._fs.exists(self._path(place)):
                out.append(f"{name} is missing")
            elif not self._fs.exists(self._path(f"{place}/_SUCCESS")):
                out.append(f"{name} is unfinished")
            elif (found := self.read(version, name).count()) != rows:
                out.append(f"{name} has {found} rows instead of {rows}")
        return out

    def unused(self) -> list[str]:
        """Table folders that no version's manifest points at, such as those of a build that was cut short."""
        root, used, there = self._path(self.root), set(), set()
        for version in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if not version.isDirectory():
                continue
            name = version.getPath().getName()
            manifest = self.manifest(name) or {}
            used |= set((manifest.get("tables") or {t: f"{name}/{t}" for t in manifest.get("counts", {})}).values())
            there |= {f"{name}/{t.getPath().getName()}" for t in self._fs.listStatus(version.getPath()) if t.isDirectory()}
        return sorted(there - used)

    def manifest(self, version: str) -> dict | None:
        text = self._read(f"{version}/manifest.json")
        return json.loads(text) if text else None

    def publish(self, version: str) -> None:
        """Makes a ready version without issues the current one (an older one, too: that rolls back)."""
        manifest = self.manifest(version)
        if not manifest or manifest["status"] != "ready" or manifest.get("issues"):
            raise ValueError(f"{version} is not ready")
        self._write("CURRENT", version)

    def current(self) -> str | None:
        # the new file alone is there if the driver was lost while CURRENT was being replaced
        name = (self._read("CURRENT") or self._read("CURRENT.new") or "").strip()
        manifest = self.manifest(name) if name else None
        return name if manifest and manifest["status"] == "ready" else None


def manifest_issues(manifest: dict) -> list[str]:
    """What is wrong with a manifest: totals, emptiness, dimension, and counts that should agree."""
    out, counts = [], manifest.get("counts", {})
    total, valid, failed = (manifest.get(k, 0) for k in ("documents_total", "documents_valid", "documents_failed"))
    if total != valid + failed:
        out.append("documents_total is not the sum of valid and failed")
    if valid and not counts.get("children", 0):
        out.append("there are documents but no children")
    if manifest.get("dimension", 1) <= 0:
        out.append("the dimension must be positive")
    for name in ("vectors", "lexical"):
        if name in counts and counts[name] != counts.get("children"):
            out.append(f"{name} and children differ in number")
    return out


def submission_text(answers: DataFrame, ascii_only: bool = False) -> str:
    """The one JSON object that a submission is, in the order of the ids. Answers are few: one for each question."""
    rows = answers.orderBy("question_id").select(F.col("question_id").cast("string"), "answer").collect()
    return json.dumps({r[0]: {"answer": r[1]} for r in rows}, indent=4, ensure_ascii=ascii_only) + "\n"


def read_submission(text: str) -> dict[str, dict]:
    """Parses a submission; repeated keys, other keys than answer, and blank answers raise an error."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=once)
    if not isinstance(found, dict):
        raise ValueError("a submission is an object")
    for key, value in found.items():
        if not isinstance(value, dict) or set(value) != {"answer"} or not isinstance(value["answer"], str) or not value["answer"].strip():
            raise ValueError(f"{key} needs an answer and nothing else")
    return found


def write_submission(answers: DataFrame, path: str, expected: list[str] | None = None, ascii_only: bool = False) -> dict:
    """Writes a submission beside its place, reads it back, checks it and moves it there."""
    text = submission_text(answers, ascii_only)
    with open(f"{path}.new", "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    with open(f"{path}.new", encoding="utf-8") as f:
        found = read_submission(f.read())
    if expected is not None and set(found) != set(expected):
        raise ValueError(f"missing: {sorted(set(expected) - set(found))[:5]}, unexpected: {sorted(set(found) - set(expected))[:5]}")
    os.replace(f"{path}.new", path)
    return found


def package_submission(answers: DataFrame, path: str, expected: list[str], allow_missing: bool = False, member: str = "submission.json") -> dict[str, int]:
    """Zips a submission; returns the shortest, the upper median and the longest answer's characters."""
    text = submission_text(answers)
    found = read_submission(text)
    if set(expected) - set(found) and not allow_missing:
        raise ValueError(f"missing: {sorted(set(expected) - set(found))[:5]}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, text)
    sizes = sorted(len(v["answer"]) for v in found.values()) or [0]
    return {"min": sizes[0], "median": sizes[len(sizes) // 2], "max": sizes[-1]}


def failure_type(error: Column) -> Column:
    """The class of a failure by its message."""
    e = F.lower(error)
    return (
        F.when(e.contains("out of memory") | e.contains("cuda_oom"), "CUDA_OOM").when(e.contains("cuda"), "CUDA_ERROR").when(e.contains("failed validation"), "VALIDATION").otherwise("GENERATION_ERROR")
    )
