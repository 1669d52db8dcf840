"""Operator 9: quality classifier by importance resampling.

Method: two generative models over hashed n-grams (words, pairs of words and
byte trigrams, BUCKETS buckets): one of target text, the documents labelled
as good, and one of the raw corpus, all documents.  A document's log
importance weight is the sum over its n-grams of log p_target - log p_raw,
taken to a text of LENGTH n-grams (sum * LENGTH / (n + PRIOR), so that long
documents do not differ by their length and very short ones stay near 0).
Documents are drawn without replacement by Gumbel top-k: the k largest of
weight + Gumbel noise, the noise being a function of the document id.

k is the number of documents whose weight reaches a cutoff.  The cutoff
separates labelled documents that the target model has not seen; rejecting a
good one counts COST times as much as keeping a bad one.  At most
``max_labels`` labelled documents are used, those with the smallest hash of
their id (a documented bound; all counts, weights and k cover all documents).

Cases: null and empty texts have weight 0; null labels are ignored; without
good or bad labels every document is kept; several rows with one id get the
same noise; documents tied at the k-th place are all kept; a null id gets the
noise of a null; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .arrays import chunks, combined, mix, slice_hashes, text_buffer, words
from .columns import ROW
from .scratch import frugal, stored, table

BUCKETS, COST, MAX_LABELS = 1 << 16, 25, 20_000
LENGTH, PRIOR = 100, 20
SHIFT = np.uint64(64 - 16)
#: Bytes of text whose n-grams are made at a time; they and their hashes take some 80 bytes for each.
PART = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text of each."""
    starts, ends, before = words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    h = slice_hashes(data, starts, ends)
    low, high = int(offsets[0]), int(offsets[-1])
    own = data[low:high].astype(np.uint64)
    grams = mix((own[:-2] << np.uint64(16)) | (own[1:-1] << np.uint64(8)) | own[2:]) if high - low > 2 else np.empty(0, np.uint64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[:-2] == of[2:] if len(of) > 2 else np.empty(0, bool)
    pairs = combined([h[:-1], h[1:]], 2) if len(h) > 1 else np.empty(0, np.uint64)
    same = text[:-1] == text[1:] if len(h) > 1 else np.empty(0, bool)
    return (np.concatenate([h >> SHIFT, pairs[same] >> SHIFT, grams[inside] >> SHIFT]).astype(np.int64),
            np.concatenate([text, text[1:][same] if len(h) > 1 else text[:0], of[2:][inside] if len(of) > 2 else of[:0]]))


def parts(batches):
    """The batches in slices of about PART bytes of text: the slice, buckets of its n-grams, and the text of each."""
    for batch in batches:
        for part in chunks(batch, "text", PART):
            yield part, *features(*text_buffer(part.column("text")))


def label_sample(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """At most ``max_labels`` rows (label_id, good, fold): fold 0 fits the model, fold 1 the cutoff."""
    h = F.xxhash64("doc_id")
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .orderBy(h, "doc_id").limit(max_labels)
            .select(F.col("doc_id").alias("label_id"), (F.col("quality") > 0).alias("good"),
                    F.pmod(h.bitwiseXOR(F.shiftright(h, 17)), F.lit(2)).cast("int").alias("fold")))


def counts(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Counts of every bucket in all documents (row 0) and in the target documents (row 1)."""
    # The sample is at most max_labels rows, so it is sent to all tasks.
    marked = docs.select("doc_id", "text").join(F.broadcast(sample.where("fold = 0 AND good")), F.col("doc_id") == F.col("label_id"), "left")

    def work(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for part, bucket, text in parts(batches):
            target = np.asarray(part.column("label_id").is_valid())[text]
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[target], minlength=BUCKETS)
        model, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(model, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[model, bucket], pa.int64())],
                              ["model", "bucket", "n"])

    rows = (marked.select("text", "label_id").mapInArrow(frugal(work), "model int, bucket int, n bigint")
            .groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas())  # at most 2 x BUCKETS rows
    out = np.zeros((2, BUCKETS))
    out[rows["model"].to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def log_ratio(count: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of every bucket, with one added to each count; 0 without target text."""
    if not count[1].any():
        return np.zeros(BUCKETS)
    p = (count + 1) / (count.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with n_features and log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles
    keep = docs.drop("n_features", "log_weight")

    def work(batches):
        for part, bucket, text in parts(batches):
            n = np.bincount(text, minlength=part.num_rows)
            weight = np.bincount(text, shared.value[bucket], minlength=part.num_rows) * LENGTH / (n + PRIOR)
            yield pa.record_batch([*part.columns, pa.array(n, pa.int64()), pa.array(weight.round(6) + 0.0, pa.float64())],
                                  [*part.schema.names, "n_features", "log_weight"])

    return keep.mapInArrow(frugal(work), StructType([*keep.schema.fields, StructField("n_features", LongType()), StructField("log_weight", DoubleType())]))


def gumbel(seed: int = 0) -> Column:
    """Standard Gumbel noise from the document id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12)
    return -F.log(-F.log((bits.cast("double") + 0.5) / float(1 << 52)))


def best_cutoff(weights: np.ndarray, good: np.ndarray) -> float | None:
    """The weight that separates good from bad at the least cost, in the middle of its gap; None with one class only."""
    if good.all() or not good.any():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.append(0, np.cumsum(g)) * COST + np.append(np.cumsum((~g)[::-1])[::-1], 0)  # rejecting the first i
    cut = np.flatnonzero(np.append(True, np.append(w[1:] != w[:-1], True)))  # ties stay together
    i = cut[np.argmin(lost[cut])]
    if i == 0:
        return float(w[0]) - 1.0
    return float(w[-1]) + 1.0 if i == len(w) else float(w[i - 1] + w[i]) / 2


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float | None:
    """The k-th largest value: histograms of ``bins`` cells, refined until ``few`` rows or one value are left."""
    if k < 1:
        return None
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) / bins
        inside = df.where(F.col(column).between(low, high))
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("cell")
        rows = inside.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["cell"]):  # at most ``bins`` rows
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= few:
            found = df.where(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(few).select(column).collect()
            return found[k - 1][0]
    return low


def keyed(docs: DataFrame, ratio: np.ndarray, temperature: float, seed: int) -> DataFrame:
    """``docs`` with n_features, log_weight and gumbel_key."""
    return weigh(docs, ratio).withColumn("gumbel_key", F.round(F.col("log_weight") / temperature + gumbel(seed), 6))


def resample(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, temperature: float = 0.25, seed: int = 0) -> DataFrame:
    """``docs`` with n_features, log_weight, gumbel_key and kept; of doc_id and text alone the text is left out."""
    sample = stored(label_sample(labels, max_labels), "labels")
    ratio = log_ratio(counts(docs, sample))
    weights = stored(keyed(docs.select("doc_id", "text"), ratio, temperature, seed).drop("text"), "weights")
    held = weights.join(F.broadcast(sample.where("fold = 1")), F.col("doc_id") == F.col("label_id")).select("log_weight", "good").toPandas()
    cutoff = best_cutoff(held["log_weight"].to_numpy(float), held["good"].to_numpy(bool)) if len(held) else None
    if cutoff is None:
        kept = F.lit(True)
    else:
        k = weights.where(F.col("log_weight") >= cutoff).count()
        least = kth_largest(weights, "gumbel_key", k)
        kept = F.col("gumbel_key") >= least if least is not None else F.lit(False)
    # Rows that carry more than id and text are weighed again rather than joined to their weights.
    rows = weights if set(docs.columns) == {"doc_id", "text"} else keyed(docs, ratio, temperature, seed)
    return rows.withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_features, log_weight, gumbel_key, kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the resampling keeps."""
    # The other columns pass Python in one, where no name can clash, and the text passes once.
    rest = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != "text"]).alias(ROW)
    kept = resample(docs.select("doc_id", "text", rest), table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*[(F.col("text") if c == "text" else F.col(ROW).getField(c)).alias(c) for c in docs.columns])
