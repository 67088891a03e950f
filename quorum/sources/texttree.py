"""The tree of bill texts, {congress}/{type}/{number}/manifest.json beside {code}.txt, as a table that is read and written.

A manifest is a list of entries {version_code, version_label, package, path, fetched_at, source_url, last_modified, sha256,
lines}. Files are reached by pyarrow's file systems, so the root may be a path or the address of an object store. A write
has two phases: tasks put texts and entries aside, each attempt under a name of its own; the driver then names the attempts
that count in one small file; and `published` moves what these hold into place, a bill at a time, in tasks that may be
repeated. So a task that runs twice, or a job that dies, leaves the tree as it was or as it should be.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..functions import tables
from ..operators.eventlog import latest_per_key

SCHEMA = "bill_id string, version_code string, version_label string, body string, line_count int, sha256 string, package string, source_url string, last_modified timestamp, fetched_at timestamp"
_MOMENT = pa.timestamp("us", "UTC")
_ARROW = pa.schema([("bill_id", pa.string()), ("version_code", pa.string()), ("version_label", pa.string()), ("body", pa.string()), ("line_count", pa.int32()), ("sha256", pa.string()), ("package", pa.string()), ("source_url", pa.string()), ("last_modified", _MOMENT), ("fetched_at", _MOMENT)])
#: A batch of rows is handed on when it holds so many code points of text.
BATCH = 1 << 24
STAGED, COMMITS = "_staging", "_commits"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root.rstrip("/"))


def read_text(fs: pafs.FileSystem, path: str) -> str | None:
    """A file's text, or None if there is none or it isn't UTF-8."""
    try:
        with fs.open_input_stream(path) as f:
            return f.read().decode()
    except (FileNotFoundError, UnicodeDecodeError):
        return None


def put_text(fs: pafs.FileSystem, path: str, text: str) -> None:
    """The file appears whole or not at all."""
    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(text.encode())
    fs.move(aside, path)


def folders(fs: pafs.FileSystem, path: str) -> list[str]:
    """Names of the folders in a folder, those of our own and hidden ones aside."""
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory and not i.base_name.startswith(("_", ".")))


def manifest_entries(fs: pafs.FileSystem, folder: str) -> list[dict]:
    """A bill's entries by version, of repeated ones the last; none if the manifest is missing or no list."""
    text = read_text(fs, f"{folder}/manifest.json")
    try:
        listed = json.loads(text) if text else []
    except json.JSONDecodeError:
        listed = []
    named = [e for e in listed if isinstance(e, dict) and e.get("version_code")] if isinstance(listed, list) else []
    return list({e["version_code"]: e for e in named}.values())


def moment(text: str | None) -> datetime | None:
    """An ISO moment; a naive one is UTC."""
    try:
        at = datetime.fromisoformat(str(text or ""))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def entry_row(bill_id: str, e: dict, now: datetime) -> dict:
    code = e["version_code"]
    lines = e.get("lines")
    return {
        "bill_id": bill_id, "version_code": code, "version_label": tables.resolved_label(code, e.get("version_label")), "line_count": int(lines) if str(lines or "").isdigit() else 0, "sha256": e.get("sha256") or "",
        "package": e.get("package") or "", "source_url": e.get("source_url") or "", "last_modified": moment(e.get("last_modified")), "fetched_at": moment(e.get("fetched_at")) or now,
    }


@dataclass
class Bills(InputPartition):
    """Some bills of a folder {congress}/{type}: those whose number's checksum is part modulo of, or the one named."""

    folder: str
    part: int = 0
    of: int = 1
    number: str | None = None


class TreeReader(DataSourceReader):
    """Options: path; bodies (true): whether texts are read; tasks (8): parts of each folder of one congress and type.

    A condition on bill_id, equality or a list, leaves only the folders of these bills; no other folder is listed then.
    """

    def __init__(self, options: dict):
        self.root, self.bodies = options["path"], str(options.get("bodies", "true")).lower() == "true"
        self.tasks, self.bills = int(options.get("tasks", 8)), None
        self.now = moment(options.get("now")) or datetime.now(UTC)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("bill_id",):
                self.bills = set(wanted) if self.bills is None else self.bills & set(wanted)
            yield f  # Spark checks all conditions again

    def partitions(self) -> list[Bills]:
        if self.bills is not None:
            parts = [str(b).split(":") for b in sorted(self.bills)]
            return [Bills(f"{p[0]}/{p[1]}", number=p[2]) for p in parts if len(p) == 3]
        fs, root = opened(self.root)
        return [Bills(f"{c}/{t}", k, self.tasks) for c in folders(fs, root) for t in folders(fs, f"{root}/{c}") for k in range(self.tasks)]

    def read(self, partition: Bills | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a tree without folders
            return
        fs, root = opened(self.root)
        base = f"{root}/{partition.folder}"
        numbers = [partition.number] if partition.number else [n for n in folders(fs, base) if zlib.crc32(n.encode()) % partition.of == partition.part]
        rows, size = [], 0
        for n in numbers:
            for e in manifest_entries(fs, f"{base}/{n}"):
                body = read_text(fs, f"{base}/{n}/{e['version_code']}.txt") if self.bodies else None
                if self.bodies and body is None:
                    continue
                rows.append(entry_row(f"{partition.folder}/{n}".replace("/", ":"), e, self.now) | {"body": body})
                size += len(body or "") + 256
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        fs, root = opened(self.root)
        attempt = f"{self.run}/{uuid.uuid4().hex}"  # of its own, so a second try of the task meets nothing of the first
        at, entries, rows = None, [], 0

        def flushed() -> None:
            if entries:
                put_text(fs, f"{root}/{STAGED}/{attempt}/{at}/entries-{rows}.json", json.dumps(entries))
                entries.clear()

        for r in iterator:
            folder = str(r.bill_id).replace(":", "/")
            if folder != at:
                flushed()
                at = folder
                fs.create_dir(f"{root}/{STAGED}/{attempt}/{at}")
            put_text(fs, f"{root}/{STAGED}/{attempt}/{at}/{r.version_code}.txt", r.body)
            entries.append({
                "version_code": r.version_code, "version_label": r.version_label, "package": r.package, "path": f"{self.root.rstrip('/')}/{at}/{r.version_code}.txt", "fetched_at": r.fetched_at and r.fetched_at.isoformat(),
                "source_url": r.source_url, "last_modified": r.last_modified and r.last_modified.isoformat(), "sha256": hashlib.sha256(r.body.encode()).hexdigest(), "lines": len(r.body.splitlines()),
            })
            rows += 1
        flushed()
        return Staged(attempt, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        """Names the attempts that count, one a task, in one file."""
        fs, root = opened(self.root)
        fs.create_dir(f"{root}/{COMMITS}")
        put_text(fs, f"{root}/{COMMITS}/{datetime.now(UTC):%Y%m%d%H%M%S%f}-{self.run}.json", json.dumps([m.attempt for m in messages if m and m.rows]))

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.root)
        if fs.get_file_info(f"{root}/{STAGED}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{STAGED}/{self.run}")


class TextTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options)


def tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """All versions of a tree that have a manifest's entry and a text; without bodies (bodies=False) all entries."""
    spark.dataSource.register(TextTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("text_tree").options(path=root, **options).load()


def first_text(df: DataFrame, paths: list[str], text: str, found: str) -> DataFrame:
    """df with the text of the first of its rows' files (columns of whole paths, in order) that there is, and which one; both null without any.

    Rows travel to Python and back with their files' texts, a batch at a time; nothing else of the folders is listed or read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = ", ".join(f"`{k}` {v}" for k, v in (kinds | {text: "string", found: "string"}).items())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, which = [], []
            for each in rows[paths].itertuples(index=False):
                hit = next(((t, p) for p in each if p and (t := read_text(*opened(p))) is not None), (None, None))
                texts.append(hit[0])
                which.append(hit[1])
            yield rows.assign(**{text: texts, found: which})

    return df.mapInPandas(read, out)


def ingested(spark: SparkSession, root: str, held: DataFrame | None = None, **options) -> DataFrame:
    """The rows of the tree that a table of texts (bill_id, version_code, sha256) doesn't hold: manifests tell what is new, and only the texts of these are opened.

    An entry without a digest is always new, one whose text is missing is left out.
    """
    listed = tree(spark, root, bodies=False, **options)
    if held is not None:
        known = held.filter("sha256 <> ''").select("bill_id", "version_code", "sha256").distinct()
        listed = listed.join(known, ["bill_id", "version_code", "sha256"], "left_anti")
    where = F.concat(F.lit(root.rstrip("/") + "/"), F.replace("bill_id", F.lit(":"), F.lit("/")), F.lit("/"), "version_code", F.lit(".txt"))
    read = first_text(listed.drop("body").withColumn("__path", where), ["__path"], "body", "__found")
    return read.filter("body IS NOT NULL").select(*_ARROW.names)


def staged(texts: DataFrame, root: str) -> None:
    """Phase one: texts (columns of SCHEMA, of repeated versions the last modified), put aside and named. A row without an id of three parts, a version or a body isn't written."""
    spark = texts.sparkSession
    spark.dataSource.register(TextTree)
    fit = texts.filter(F.col("bill_id").rlike("^[^:/]+:[^:/]+:[^:/]+$") & F.col("version_code").rlike("^[^/]+$") & F.col("body").isNotNull())
    once = latest_per_key(fit.select(*_ARROW.names), ["bill_id", "version_code"], [F.col("last_modified"), F.col("fetched_at"), F.col("sha256")])
    once.repartition("bill_id").sortWithinPartitions("bill_id").write.format("text_tree").mode("append").option("path", root).save()


def _placed(fs: pafs.FileSystem, root: str, bill: str, attempts: list[str]) -> int:
    """One bill's texts moved into place and its manifest replaced. What an earlier try has moved is there already."""
    folder, entries = f"{root}/{bill}", []
    fs.create_dir(folder)
    for a in attempts:
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/{STAGED}/{a}/{bill}")):
            if info.base_name.endswith(".txt"):
                fs.move(info.path, f"{folder}/{info.base_name}")
            elif info.base_name.endswith(".json"):
                entries += json.loads(read_text(fs, info.path))
    versions = {e["version_code"]: e for e in manifest_entries(fs, folder) + entries}
    put_text(fs, f"{folder}/manifest.json", json.dumps(sorted(versions.values(), key=lambda e: tables.stage_key(e["version_code"])), indent=2))
    return len(entries)


def published(spark: SparkSession, root: str) -> int:
    """Phase two: everything named and not yet in place, run by run; how many versions that were. It may be repeated after any failure."""
    fs, base = opened(root)
    if fs.get_file_info(f"{base}/{COMMITS}").type != pafs.FileType.Directory:
        return 0
    total = 0
    for info in sorted(fs.get_file_info(pafs.FileSelector(f"{base}/{COMMITS}")), key=lambda i: i.base_name):
        if not info.base_name.endswith(".json"):
            continue
        attempts = json.loads(read_text(fs, info.path))

        def bills(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = opened(root)
            for rows in batches:
                for a in rows["attempt"]:
                    at = f"{base}/{STAGED}/{a}"
                    yield pd.DataFrame([(a, f"{c}/{t}/{n}") for c in folders(fs, at) for t in folders(fs, f"{at}/{c}") for n in folders(fs, f"{at}/{c}/{t}")], columns=["attempt", "bill"])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = opened(root)
            for rows in batches:
                yield pd.DataFrame({"n": [_placed(fs, base, b, sorted(a)) for b, a in zip(rows["bill"], rows["attempts"], strict=True)]})

        if attempts:
            each = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts)).mapInPandas(bills, "attempt string, bill string")
            total += each.groupBy("bill").agg(F.collect_list("attempt").alias("attempts")).mapInPandas(place, "n long").agg(F.sum("n")).first()[0] or 0
        fs.delete_file(info.path)
        run = info.base_name.removesuffix(".json").split("-")[-1]
        if fs.get_file_info(f"{base}/{STAGED}/{run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{STAGED}/{run}")
    return total


def write_tree(texts: DataFrame, root: str) -> int:
    """texts into the tree, each version in the place of its namesake, manifests in the order of a bill's way; how many versions."""
    staged(texts, root)
    return published(texts.sparkSession, root)
