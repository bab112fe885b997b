"""Tag documents: the JSON file of a tag store, read strictly and written the same way every time."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

VERSION = 1  # fixed value: the newest format that is understood
ENTRIES = "root string, rel string, fp string, mtime_ns long, size long, tags array<string>"


class TagDocumentError(ValueError):
    pass


def parse_document(text: str | bytes, where: str = "tag document") -> dict[str, dict]:
    """rel to {fp, mtime_ns, size, tags}. The version is checked before the shape; tags come out sorted."""
    try:
        raw = json.loads(text)
    except (ValueError, UnicodeDecodeError) as problem:
        raise TagDocumentError(f"{where} is not valid JSON: {problem}") from None
    version = raw.get("version") if isinstance(raw, dict) else None
    if type(version) is not int or version < 0:
        raise TagDocumentError(f"{where}: missing or invalid version")
    if version > VERSION:
        raise TagDocumentError(f"{where}: format version {version} is newer than {VERSION}")
    if "entries" not in raw:
        raise TagDocumentError(f"{where}: missing entries object")
    kinds = {"fp": str, "mtime_ns": int, "size": int, "tags": list}
    out = {}
    if not isinstance(raw["entries"], dict):
        raise TagDocumentError(f"{where}: malformed entries")
    for rel, entry in raw["entries"].items():
        fine = isinstance(entry, dict) and all(type(entry.get(k)) is t for k, t in kinds.items())
        if not fine or entry["size"] < 0 or not all(isinstance(t, str) for t in entry["tags"]):
            raise TagDocumentError(f"{where}: malformed entry: {rel}")
        out[rel] = {k: entry[k] for k in kinds} | {"tags": sorted(entry["tags"], key=str.encode)}
    return out


def dump_document(entries: dict[str, dict]) -> str:
    """Keys in byte order, two spaces, text as it is, a line feed at the end."""
    keys = ("fp", "mtime_ns", "size", "tags")
    ordered = {rel: {k: entries[rel][k] for k in keys} for rel in sorted(entries, key=str.encode)}
    return json.dumps({"entries": ordered, "version": VERSION}, indent=2, ensure_ascii=False) + "\n"


def save_document(path: str, entries: dict[str, dict]) -> None:
    """Whole or not at all."""
    part = f"{path}.tmp.{os.getpid()}"
    try:
        with open(part, "w", encoding="utf-8") as f:
            f.write(dump_document(entries))
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except OSError:
        if os.path.exists(part):
            os.remove(part)
        raise


def read_documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Entries of the stores of several trees; each file is read where a task runs."""
    from pyspark.sql import functions as F

    @F.udf("array<struct<rel: string, fp: string, mtime_ns: bigint, size: bigint, tags: array<string>>>")
    def entries(where, text):
        return [(rel, e["fp"], e["mtime_ns"], e["size"], e["tags"]) for rel, e in parse_document(text, where).items()]

    files = [f"{r.rstrip('/')}/.tagstore/index.json" for r in roots]
    if not files:
        return spark.createDataFrame([], ENTRIES)
    lines = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    own = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    rows = lines.select(F.substring(own, F.lit(1), F.length(own) - len("/.tagstore/index.json")).alias("root"), F.explode(entries("file", "value")).alias("e"))
    return rows.select("root", "e.rel", "e.fp", "e.mtime_ns", "e.size", "e.tags")


def _entry_text(rel: str, entry: dict) -> str:
    """An entry as it stands in a document, without the comma."""
    return "\n".join(json.dumps({"entries": {rel: entry}}, indent=2, ensure_ascii=False).split("\n")[2:-2])


def write_documents(entries: DataFrame) -> DataFrame:
    """Write the store of each root of a table of entries, in the tasks; (root, n), a row for each document that was written.

    A document is written line by line from sorted rows, so a large one needs no
    memory, and is put in place whole; it has the same bytes as dump_document
    gives. A store is locked meanwhile. Roots without entries aren't looked at.
    A task that runs again writes the same document again.
    """
    import pyarrow as pa

    def put(batches):
        from .store import lock

        root, n, out, held = None, 0, None, None

        def close():
            out.write(f'\n  }},\n  "version": {VERSION}\n}}\n')
            out.flush()
            os.fsync(out.fileno())
            out.close()
            os.replace(out.name, f"{root}/.tagstore/index.json")
            held.__exit__(None, None, None)
            return pa.RecordBatch.from_arrays([pa.array([root]), pa.array([n])], names=["root", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["root"] != root:
                    if root is not None:
                        yield close()
                    root, n = row["root"], 0
                    os.makedirs(f"{root}/.tagstore", exist_ok=True)
                    held = lock(f"{root}/.tagstore")
                    held.__enter__()
                    out = open(f"{root}/.tagstore/index.json.tmp.{os.getpid()}", "w", encoding="utf-8")
                    out.write('{\n  "entries": {\n')
                own = {k: row[k] for k in ("fp", "mtime_ns", "size")} | {"tags": sorted(row["tags"], key=str.encode)}
                out.write((",\n" if n else "") + _entry_text(row["rel"], own))
                n += 1
        if root is not None:
            yield close()

    rows = entries.select("root", "rel", "fp", "mtime_ns", "size", "tags").repartition("root").sortWithinPartitions("root", "rel")
    return rows.mapInArrow(put, "root string, n long")
