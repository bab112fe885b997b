"""Previews: kind by extension, texts by content."""

from __future__ import annotations

import io
import itertools
import os
import shutil
import subprocess
import tarfile
import zipfile
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, markdown, paths

# How much of a text, archive and folder is shown. The headings and the lines on what was left out, below, are fixed texts too.
MOST_BYTES = 50_000
MOST_MEMBERS = 50
MOST_CHILDREN = 80

# Extensions by kind.
KINDS = {
    "image": "png jpg jpeg gif bmp webp svg tiff ico",
    "pdf": "pdf",
    "audio": "mp3 flac wav ogg m4a aac opus wma",
    "video": "mp4 mkv avi mov webm flv wmv",
    "archive": "zip jar war apk tar gz tgz bz2 xz 7z rar zst",
    "binary": "exe dll so dylib o obj a bin dat db sqlite sqlite3 class pyc pyo whl ttf otf woff woff2",
    "markdown": "md markdown",
}
ZIPS, TARS = ("zip", "jar", "war", "apk"), {"tar": "tar", "gz": "tar.gz", "tgz": "tar.gz"}
TOOLS = {"7z": "7z", "rar": "unrar"}


def kind(path: Column, is_dir: Column) -> Column:
    ext = F.lower(F.coalesce(paths.extension(path), F.lit("")))
    out = F.when(is_dir, "directory")
    for label, extensions in KINDS.items():
        out = out.when(ext.isin(*extensions.split()), label)
    return out.otherwise("text")


def info_text(path: Column, size: Column, label: Column) -> Column:
    """What image, pdf and binary files show: name, type and size."""
    shown = formats.size_text(size)
    return (
        F.when(label == "image", F.concat(paths.name(path), F.lit("\nSize: "), shown))
        .when(label == "pdf", F.concat(F.lit("PDF Document\nSize: "), shown))
        .when(label == "binary", F.concat(F.lit("Binary File\n\nName: "), paths.name(path), F.lit("\nType: "), F.coalesce(paths.extension(path), F.lit("unknown")), F.lit("\nSize: "), shown))
    )


def looks_binary(content: Column) -> Column:
    """More than a tenth of the first 512 bytes are control characters other than tab, line feed and return."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(512)))
    n = F.length(head) / 2
    odd = F.length(F.regexp_replace(F.regexp_replace(head, "(..)", "$1 "), "(0[0-8BCEF]|1[0-9A-F]) |(.. )", "$1")) / 2
    return (n > 0) & (odd * 10 > n)


def _size_text(n: int) -> str:
    for unit, label in ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= unit:
            return f"{n / unit:.1f} {label}"
    return f"{n} B"


def text_of(content: bytes, total: int | None = None) -> str:
    total = len(content) if total is None else total
    head = content[:MOST_BYTES]
    probe = head[:512]
    if sum(b < 32 and b not in (9, 10, 13) for b in probe) * 10 > len(probe):
        return f"Binary file ({_size_text(total)})\n\nThis file appears to contain binary data."
    text = head.decode("utf-8", errors="replace")
    return f"{text}\n\n--- Truncated (showing 50KB of {_size_text(total)}) ---" if total > MOST_BYTES else text


def _opened(content: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(content) if isinstance(content, bytes) else content


def _member(name: str, size: int, is_dir: bool) -> str:
    return f"  [dir]     {name}" if is_dir else f"  {_size_text(size):>8}  {name}"


def zip_listing(content: bytes | BinaryIO) -> str:
    try:
        members = zipfile.ZipFile(_opened(content)).infolist()
    except (zipfile.BadZipFile, OSError, ValueError) as problem:
        return f"Unable to read ZIP archive: {problem}"
    lines = [f"ZIP Archive: {len(members)} entries\n"]
    lines += [_member(m.filename, m.file_size, m.is_dir()) for m in members[:MOST_MEMBERS]]
    if len(members) > MOST_MEMBERS:
        lines.append(f"\n... and {len(members) - MOST_MEMBERS} more entries")
    return "\n".join(lines)


def tar_listing(content: bytes | BinaryIO, label: str) -> str:
    lines, n = [f"{label.upper()} Archive:\n"], 0
    try:
        with tarfile.open(fileobj=_opened(content), mode="r|gz" if label == "tar.gz" else "r|") as archive:
            for member in archive:
                if n == MOST_MEMBERS:
                    break
                # tarfile strips the slash that ends a folder's stored name
                lines.append(_member(member.name + "/" * member.isdir(), member.size, member.isdir()))
                n += 1
    except (tarfile.TarError, OSError, EOFError):
        pass  # what was read until then is shown
    if not n:
        lines.append("  (empty archive)")
    elif n == MOST_MEMBERS:
        lines.append(f"\n... showing first {MOST_MEMBERS} entries")
    return "\n".join(lines)


def zstd_listing(content: bytes | BinaryIO) -> str:
    """Of a compressed tar: its first members."""
    try:
        import zstandard
    except ImportError:
        return "This archive needs the zstandard package to be listed"
    lines = ["ZSTD Archive:\n"]
    try:
        with zstandard.ZstdDecompressor().stream_reader(_opened(content)) as plain, tarfile.open(fileobj=plain, mode="r|") as archive:
            for member in itertools.islice(archive, MOST_MEMBERS):
                lines.append(_member(member.name + "/" * member.isdir(), member.size, member.isdir()))
    except (tarfile.TarError, zstandard.ZstdError, OSError, EOFError):
        pass  # what was read until then is shown
    return "\n".join(lines)


def listed_by_tool(path: str, tool: str) -> str:
    """What an installed program lists of an archive on disk."""
    if not os.path.exists(path) or shutil.which(tool) is None:
        return f"This archive needs {tool} to be listed"
    try:
        done = subprocess.run([tool, "l", path], capture_output=True, timeout=30, check=False)
    except (OSError, subprocess.TimeoutExpired) as problem:
        return f"{tool} failed: {problem}"
    if done.returncode:
        return f"{tool} failed: {done.stderr.decode('utf-8', 'replace').strip()}"
    return "\n".join(done.stdout.decode("utf-8", "replace").splitlines()[: MOST_MEMBERS + 5])


def archive_listing(path: str, content: bytes | BinaryIO) -> str:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ext in ZIPS:
        return zip_listing(content)
    if ext in TARS:
        return tar_listing(content, TARS[ext])
    if ext == "zst":
        return zstd_listing(content)
    return listed_by_tool(path, TOOLS[ext]) if ext in TOOLS else f"Unsupported archive format: .{ext}"


def _shown(path: str, label: str, size: int, content: bytes | BinaryIO) -> str:
    if label == "archive":
        return archive_listing(path, content)
    head = content if isinstance(content, bytes) else content.read(MOST_BYTES + 1)
    if label == "markdown":
        return markdown.to_html(head.decode("utf-8", errors="replace"), path.rpartition("/")[0])
    return text_of(head, size)


def _unreadable(label: str, problem: OSError) -> str:
    return f"Unable to read file: {problem.strerror or problem}"


def _finished(files: DataFrame, read) -> DataFrame:
    labelled = files.withColumn("preview_type", kind(F.col("path"), F.col("is_dir")))
    plain = labelled.filter(F.col("preview_type").isin("image", "pdf", "binary", "audio", "video"))
    plain = plain.withColumn("text", F.coalesce(info_text(F.col("path"), F.col("size"), F.col("preview_type")), F.concat(F.lit("Media file: "), "path")))
    texts = labelled.filter(F.col("preview_type").isin("archive", "markdown", "text")).withColumn("text", read)
    out = plain.unionByName(texts).withColumn("image_path", F.when(F.col("preview_type") == "image", F.col("path")).otherwise(F.lit("")))
    return out.select("path", "preview_type", "text", "image_path")


def previews(files: DataFrame) -> DataFrame:
    """path, preview_type, text, image_path of rows (path, is_dir, size, content); folders get their text from folder_text."""

    @F.pandas_udf("string")
    def shown(path: pd.Series, label: pd.Series, size: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([_shown(p, k, int(n), b"" if c is None else bytes(c)) for p, k, n, c in zip(path, label, size, content)])

    return _finished(files, shown("path", "preview_type", "size", "content"))


def preview_files(files: DataFrame) -> DataFrame:
    """As previews, for rows (path, is_dir, size) of files that the executors can open.

    Of a text only its beginning is read, of an archive its directory or first
    members; no content travels through the plan.
    """

    @F.pandas_udf("string")
    def shown(path: pd.Series, label: pd.Series, size: pd.Series) -> pd.Series:
        def one(p: str, k: str, n: int) -> str:
            try:
                with open(p, "rb") as f:
                    return _shown(p, k, n, f)
            except OSError as problem:
                return _unreadable(k, problem)

        return pd.Series([one(p, k, int(n)) for p, k, n in zip(path, label, size)])

    return _finished(files, shown("path", "preview_type", "size"))


def folder_lines(children: DataFrame) -> DataFrame:
    """(folder, place, line, total): a folder's children (folder, name, is_dir, size), folders first, each kind by its lower-cased line; 80 at most."""
    from pyspark.sql import Window

    line = F.when(F.col("is_dir"), F.concat(F.lit("[dir]  "), "name", F.lit("/"))).otherwise(F.concat(F.lpad(formats.size_text(F.col("size")), 8, " "), F.lit("  "), "name"))
    own = Window.partitionBy("folder")
    placed = children.select("folder", "is_dir", line.alias("line")).withColumns(
        {"place": F.row_number().over(own.orderBy(F.desc("is_dir"), F.lower("line"), "line")), "total": F.count("*").over(own)}
    )
    return placed.filter(F.col("place") <= MOST_CHILDREN).select("folder", "place", "line", "total")


def folder_text(children: DataFrame) -> DataFrame:
    """(folder, text)"""
    lines = folder_lines(children).groupBy("folder").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("rows"))
    head = F.concat(F.col("total").cast("string"), F.lit(" items\n\n"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    more = F.when(F.col("total") > MOST_CHILDREN, F.concat(F.lit("\n\n... and "), (F.col("total") - MOST_CHILDREN).cast("string"), F.lit(" more items"))).otherwise("")
    return lines.select("folder", F.concat(head, body, more).alias("text"))


MEDIA = """format struct<filename: string, format_long_name: string, duration: string, size: string, bit_rate: string, tags: map<string, string>>,
streams array<struct<codec_type: string, codec_name: string, sample_rate: string, channels: bigint, width: bigint, height: bigint, r_frame_rate: string, tags: map<string, string>>>"""
MEDIA_TAGS = ("title", "artist", "album", "genre", "date", "track", "comment")  # fixed values: shown in this order


def media_text(json: Column, path: Column) -> Column:
    """Lines of a media probe's JSON; of anything else the path.

    The JSON is parsed once a row: the lines are made in a lambda, whose variable is the parsed value.
    """
    shown = F.transform(F.array(F.from_json(json, f"struct<{MEDIA}>")), _media_lines)
    return F.coalesce(F.get(F.filter(shown, lambda text: text != ""), F.lit(0)), F.concat(F.lit("Media file: "), path))


def _media_lines(v: Column) -> Column:
    """Lines of a parsed probe; null of none."""
    f = v["format"]
    absent = F.lit(None).cast("string")
    labelled = lambda label, x: F.concat(F.lit(label), x)
    tag = lambda k: F.coalesce(F.try_element_at(f["tags"], F.lit(k)), F.try_element_at(f["tags"], F.lit(k.upper())))
    seconds = f["duration"].try_cast("double")
    lines = [
        labelled("File: ", paths.name(f["filename"])),
        labelled("Format: ", f["format_long_name"]),
        labelled("Duration: ", formats.duration_text(seconds)),
        labelled("Size: ", formats.size_text(f["size"].try_cast("long"))),
        F.concat(F.lit("Bitrate: "), F.floor(f["bit_rate"].try_cast("long") / 1000).cast("string"), F.lit(" kbps")),
        F.when(f["tags"].isNotNull(), F.lit("")),
        *(labelled(f"{k.capitalize()}: ", tag(k)) for k in MEDIA_TAGS),
        F.when(v["streams"].isNotNull(), F.lit("\nStreams:")),
    ]
    or_ = lambda x, other: F.coalesce(x.cast("string"), F.lit(other))

    def stream(s):
        name = or_(s["codec_name"], "unknown")
        return (
            F.when(s["codec_type"] == "audio", F.concat(F.lit("  Audio: "), name, F.lit(" ("), or_(s["sample_rate"], "?"), F.lit("Hz, "), or_(s["channels"], "0"), F.lit(" ch)")))
            .when(s["codec_type"] == "video", F.concat(F.lit("  Video: "), name, F.lit(" ("), or_(s["width"], "0"), F.lit("x"), or_(s["height"], "0"), F.lit(", "), or_(s["r_frame_rate"], "?"), F.lit(")")))
            .when(s["codec_type"] == "subtitle", F.concat(F.lit("  Subtitle: "), name, F.lit(" ("), or_(F.try_element_at(s["tags"], F.lit("language")), "unknown"), F.lit(")")))
            .otherwise(absent)
        )

    streams = F.coalesce(F.transform(v["streams"], stream), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(F.array(*lines), streams), lambda x: x.isNotNull()), "\n")
