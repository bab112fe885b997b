"""A catalog in blocks sorted by path, each with a signature of its trigrams: a search reads only the blocks that may hold a match.

A block is one Parquet file. Its signature is a bitmap with a bit set for each
trigram (by CRC-32) that a path component in it has, made by
`bitmap_construct_agg`. Neighbours by path share most of their trigrams, so a
block has few of them and a text that occurs in few folders is looked for in
few blocks. Signatures never decide: rows are always those of the whole
predicate, and a query without trigrams reads all blocks.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import compile as plan
from ..plans.language import Query, parse
from .index import needed_trigrams, path_trigrams

PAGE = 1 << 15  # bits of one bitmap of bitmap_construct_agg
SIGNATURES = "file string, page int, bits binary, rows long, first string, last string"


def bit_of(trigram: bytes, pages: int) -> tuple[int, int]:
    """(page, bit) of a trigram."""
    return divmod(zlib.crc32(trigram) % (PAGE * pages), PAGE)


def signatures(rows: DataFrame, pages: int = 1) -> DataFrame:
    """(file, page, bits, rows, first, last) of rows with a column `file`: of each file and page the bitmap, or an empty one for a page without bits."""
    spot = F.crc32("trigram") % (PAGE * pages)
    grams = rows.select("file", F.explode(path_trigrams(F.col("path"))).alias("trigram"))
    spots = grams.select("file", F.floor(spot / PAGE).cast("int").alias("page"), (spot % PAGE).alias("bit")).distinct()  # bitmaps are made over sorted rows: only over those that differ
    bits = spots.groupBy("file", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    facts = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("path").alias("first"), F.max("path").alias("last"))
    every = facts.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    return every.join(bits, ["file", "page"], "left").select("file", "page", F.coalesce("bits", F.to_binary(F.lit(""))).alias("bits"), "rows", "first", "last")


def has_bit(bits: Column, bit: int) -> Column:
    """Whether a bitmap has a bit; an empty one has none."""
    byte = F.conv(F.hex(F.substring(bits, bit // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(1 << bit % 8) != 0, F.lit(False))


@dataclass
class Blocks:
    """Blocks below a folder: `rows` has the files, `signatures` what they hold.

    held: up to so many blocks (4 KB each and page) their signatures are kept on
    the driver and looked through there; more of them are filtered by Spark, and
    only the names of the blocks to be read come back.
    """

    spark: SparkSession
    folder: str
    schema: str
    held: int = 1 << 12
    pages: int = 1
    _kept: tuple | None = field(default=None, repr=False)

    @classmethod
    def create(cls, catalog: DataFrame, folder: str, block_rows: int = 4096, pages: int = 1, held: int = 1 << 12) -> Blocks:
        """Write a catalog in blocks of at most block_rows rows. The folder must not have one."""
        out = cls(catalog.sparkSession, folder.rstrip("/"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in catalog.schema), held, pages)
        out._add(catalog, block_rows)
        return out

    def _add(self, rows: DataFrame, block_rows: int) -> None:
        part = f"{self.folder}/rows/{uuid.uuid4().hex}"
        rows.repartitionByRange("path").sortWithinPartitions("path").write.option("maxRecordsPerFile", block_rows).parquet(part)
        written = self.spark.read.schema(self.schema).parquet(part).select("path", F.col("_metadata.file_path").alias("file"))
        signatures(written, self.pages).write.mode("append").parquet(f"{self.folder}/signatures")
        self._kept = None

    def append(self, rows: DataFrame, block_rows: int = 4096) -> None:
        """Put rows of new paths into blocks of their own; the other blocks and their signatures stay as they are."""
        self._add(rows, block_rows)

    def signatures(self) -> DataFrame:
        return self.spark.read.schema(SIGNATURES).parquet(f"{self.folder}/signatures")

    def _load(self) -> tuple | None:
        """(files, rows, bitmaps by page) on the driver, where there are few enough."""
        if self._kept is None:
            if self.signatures().limit(self.held * self.pages + 1).count() > self.held * self.pages:
                return None
            got = self.signatures().orderBy("file", "page").toArrow()  # at most `held` blocks, by the count
            bits = np.zeros((got.num_rows, PAGE // 8), dtype=np.uint8)
            for i, raw in enumerate(got["bits"].to_pylist()):
                bits[i, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
            self._kept = got["file"].to_pylist()[:: self.pages], got["rows"].to_numpy()[:: self.pages], bits.reshape(-1, self.pages, PAGE // 8)
        return self._kept

    def find(self, query: Query | str) -> list[tuple[str, int]]:
        """(file, rows) of the blocks that may hold a match."""
        query = parse(query) if isinstance(query, str) else query
        needed = [[bit_of(t, self.pages) for t in alternative] for alternative in needed_trigrams(query)]
        kept = self._load()
        if kept is not None:
            files, rows, bits = kept
            hit = np.full(len(files), not needed)
            for alternative in needed:
                hit |= np.all([bits[:, page, bit // 8] >> (bit % 8) & 1 for page, bit in alternative], axis=0).astype(bool)
            return [(files[i], int(rows[i])) for i in np.flatnonzero(hit)]
        met = F.lit(not needed)
        for i, alternative in enumerate(needed):
            met = met | (F.sum(sum((F.when((F.col("page") == page) & has_bit(F.col("bits"), bit), 1).otherwise(0) for page, bit in alternative), F.lit(0))) == len(alternative))
        found = self.signatures().groupBy("file").agg(F.first("rows").alias("rows"), met.alias("met")).filter("met")
        return [(r.file, r.rows) for r in found.select("file", "rows").collect()]  # names of files to be read

    def read(self, files: list[str] | None = None) -> DataFrame:
        """Rows of the given blocks, or of all."""
        reader = self.spark.read.schema(self.schema)
        if files is None:
            return reader.option("recursiveFileLookup", "true").parquet(f"{self.folder}/rows")
        return reader.parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def candidates(self, query: Query | str) -> DataFrame:
        """All rows of the blocks that may hold a match."""
        return self.read([file for file, _ in self.find(query)])

    def search(self, query: Query | str) -> DataFrame:
        """The catalog's rows that match."""
        query = parse(query) if isinstance(query, str) else query
        return self.candidates(query).filter(plan.row_filter(query))

    def report(self, query: Query | str) -> dict[str, int]:
        """How much a search reads: blocks and rows, of how many."""
        found = self.find(query)
        every = self.signatures().filter("page = 0").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        return {"blocks": len(found), "rows": sum(n for _, n in found), "all_blocks": every.blocks, "all_rows": every.rows}
