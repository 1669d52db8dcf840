"""Operator 10: line dedup over levelled sorted runs of line hashes.

Method: a run is a table of line hashes sorted by hash, with the number of
documents holding the line and the largest of their ids.  A new batch is
merge-anti-joined with the runs: keys that none of them holds become its own
run at level 0, so every key lies in one run only; keys that are held add
their counts beside it (folder ``fresh=false``).  When a level holds ``fanout``
runs they are merged, with the counts that belong to them, into one run of
the next level.  The totals of a key are the sums over its run and counts.

Cases: null or empty text is one empty line; a null ``doc_id`` is never
counted and its document loses no line; several rows with one id count as one
document; empty tables give empty results; other columns pass through, but
those named like a new one are replaced.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import narrowed, widened
from .scratch import shared_folder, ship, stored, table

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def hash_of(key: Column) -> Column:
    """16 bytes of MD5: equal for equal keys, different otherwise for all practical purposes."""
    return F.unhex(F.md5(key))


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, h): the distinct keys of at least ``min_chars`` code points of every document."""
    key = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.explode(lines_of(F.col("text"))).alias("line")).select("doc_id", key_of(F.col("line")).alias("key"))
    return key.where(F.length("key") >= min_chars).select("doc_id", hash_of(F.col("key")).alias("h")).distinct()


class LineRuns:
    """Levelled sorted runs of (h, n_docs, max_doc) below one shared folder, and the counts added to their keys."""

    def __init__(self, spark: SparkSession, fanout: int = 2, name: str = "line-runs"):
        self.spark, self.fanout = spark, fanout
        self.root = shared_folder(spark, name)
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.root}/level-{level}/run-{self.written:06d}"
        self.written += 1
        rows.repartitionByRange("h").sortWithinPartitions("fresh", "h").write.partitionBy("fresh").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _all(self, paths: list[str]) -> DataFrame:
        """Runs (fresh) and added counts (not fresh)."""
        parts = [self.spark.read.schema("h binary, n_docs bigint, max_doc bigint, fresh boolean").parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def keys(self) -> DataFrame:
        """h of all runs; every key once."""
        return self._all(self.paths()).where("fresh").select("h")

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose hash no run holds."""
        return keys.join(self.keys(), "h", "left_anti") if self.paths() else keys

    def add(self, keys: DataFrame) -> None:
        """Add one batch of distinct (doc_id, h); no document may come in two batches."""
        batch = keys.groupBy("h").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if self.paths():  # one merge tells the anti-join's rows from those that are held
            held = self.keys().withColumn("held", F.lit(True))
            batch = batch.join(held, "h", "left").select("h", "n_docs", "max_doc", F.col("held").isNull().alias("fresh"))
        else:
            batch = batch.withColumn("fresh", F.lit(True))
        self._write(batch, 0)
        self.compact()

    def compact(self) -> None:
        for level, paths in enumerate(self.levels):
            if len(paths) >= self.fanout:
                # A key is in one of the runs, or in none: then its counts belong to a run of another level.
                merged = self._all(paths).groupBy("h").agg(
                    F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("fresh").alias("fresh"))
                self._write(merged, level + 1)
                self.levels[level] = []

    def totals(self, min_docs: int) -> DataFrame:
        """(h, n_docs, max_doc) of the keys found in at least ``min_docs`` documents."""
        return self._all(self.paths()).groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")).where(
            F.col("n_docs") >= min_docs)


def frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> tuple[DataFrame, DataFrame]:
    """The hashes of all documents, and those of at least ``min_docs`` documents with their largest id."""
    keys = stored(line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")),
                  "line-keys", partition_by="batch")
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", "h"))
    # A table of its own: the join below then shuffles both sides and can split a hot line.
    return keys, stored(runs.totals(min_docs), "line-totals")


KEPT = "n_kept bigint, kept string"


def kept_lines(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """The lines of every text whose key is not dropped; in time linear to lines and drops.  Null without drops."""
    white = WHITE.encode()
    counts, texts = [], []
    for t, d in zip(text, drops):
        if d is None:
            counts.append(None)
            texts.append(None)
            continue
        gone = {bytes(h) for h in d}
        # bytes.lower() changes A-Z only, and no byte of a longer character is white space or a line break.
        kept = [line for line in (t or "").encode().split(b"\n") if hashlib.md5(line.strip(white).lower()).digest() not in gone]
        counts.append(len(kept))
        texts.append(b"\n".join(kept).decode())
    return pd.DataFrame({"n_kept": pd.Series(counts, dtype="Int64"), "kept": texts})


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """``docs`` with n_lines (before dropping), n_dropped and kept_text.

    A key of at least ``min_chars`` code points in at least ``min_docs``
    documents loses all its lines except in the largest id holding it.
    """
    ship(docs.sparkSession)
    keys, frequent = frequent_lines(docs, min_chars, min_docs, batches)
    drops = (keys.join(frequent, "h").where(F.col("doc_id") < F.col("max_doc"))
             .groupBy(F.col("doc_id").alias("__line_doc")).agg(F.collect_set("h").alias("__line_drop")))
    joined = docs.join(drops, docs["doc_id"] == drops["__line_doc"], "left")
    # Only texts that lose lines go through Python.
    some = F.col("__line_drop").isNotNull()
    kept = F.pandas_udf(kept_lines, KEPT)(F.when(some, F.coalesce("text", F.lit(""))), F.col("__line_drop"))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return (joined.withColumn("__line_kept", kept)
            .withColumn("n_lines", n_lines)
            .withColumn("n_dropped", F.when(some, F.col("n_lines") - F.col("__line_kept.n_kept")).otherwise(F.lit(0).cast("long")))
            .withColumn("kept_text", F.when(some, F.col("__line_kept.kept")).otherwise(F.coalesce("text", F.lit(""))))
            .drop("__line_doc", "__line_drop", "__line_kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their repeated lines dropped."""
    out = dedup_lines(narrowed(docs))
    return widened(out, docs.columns, F.when(F.col("text").isNotNull(), F.col("kept_text")))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id < f.max_doc AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
