"""Operator 6: document fingerprints by randomised edit embedding.

Method: a random walk reads the code points of a text; at step j it writes the
character at its place and moves on or stays, as a random bit of (j, character)
says, for 3n/2 steps over n code points (it moves three times in four).  The
bits are shared by all texts, so that walks over two texts that differ by few
edits fall into step again soon after each edit, and edit distance becomes
Hamming distance of the walks' outputs.  A fingerprint is a sample of the
output: at every step of the first octave, and then at fixed steps, SAMPLES per
octave, 4 bits of a hash of the character written.  It is a hex string: 8
digits for n, FIRST digits for the first octave, then SAMPLES digits an octave.

``likeness`` of two fingerprints estimates the share of equal steps: octave by
octave the share of equal samples, corrected for chance, weighted by the steps
in it up to the end of the longer walk.  ``similar_documents`` samples the
digits into bands, buckets documents by band, links every bucket to its
smallest member and compares what it then holds in different components block
by block; every link is verified by likeness.

Every text is walked whole, all texts of a batch in step.  Cases: null and
empty texts have the fingerprint of n = 0, likeness 1 to each other and 0 to
all others; equal texts have equal fingerprints; every step
of short texts is written, so different ones of one length share theirs only
where all characters that differ share a digit (a chance of 1/16 each) or lie
behind the last step of a walk that stayed often; very long texts take time in
proportion to their length and memory of a few bytes a character; repeated
rows are fingerprinted alike; other columns pass through; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .arrays import mix
from .components import components
from .scratch import discard, release, ship, stored, table

SAMPLES, FIRST = 32, 64  # samples an octave behind the first; steps in the first octave, all of them written
LAP, CLASSES = 4096, 256  # rows of random bits; later laps use them in another order, for other characters
#: Code points of texts walked at a time.
CHUNK = 1 << 23
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def walk_steps(n):
    """Steps over n code points: three moves in four steps read the whole text in about 4n / 3 of them."""
    return (3 * n + 1) // 2


def random_moves(lap: int, seed: int = 0) -> np.ndarray:
    """Moves (1, with a chance of 3/4) or stays (0) for the steps of a lap and all classes of characters."""
    x = np.arange(LAP * CLASSES, dtype=np.uint64) + np.uint64((seed * 65537 + lap) * 0x9E3779B97F4A7C15 % 2**64)
    return ((mix(x) >> np.uint64(62)) > 0).astype(np.uint8).reshape(LAP, CLASSES)


_OF_POINT: list[np.ndarray] = []


def of_points() -> tuple[np.ndarray, np.ndarray]:
    """Class and nibble of every code point."""
    if not _OF_POINT:
        h = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0xABCDEF))
        _OF_POINT.extend([(h >> np.uint64(56)).astype(np.uint8), (h & np.uint64(15)).astype(np.uint8)])
    return _OF_POINT[0], _OF_POINT[1]


def octaves(steps: int) -> int:
    """Octaves that a walk of so many steps touches: [0, FIRST), [FIRST, 2 FIRST), [2 FIRST, 4 FIRST) ..."""
    return 0 if steps <= 0 else 1 + max(0, (steps - 1) // FIRST).bit_length()


def octave_range(k: int) -> tuple[int, int]:
    return (0, FIRST) if k == 0 else (FIRST << (k - 1), FIRST << k)


def digits_before(k: int) -> int:
    """Digits of a fingerprint, behind its length, before those of an octave."""
    return 0 if k == 0 else FIRST + (k - 1) * SAMPLES


def sample_steps(k: int, seed: int = 0) -> np.ndarray:
    """The written steps of an octave, ascending, the same for all texts."""
    low, high = octave_range(k)
    if k == 0:
        return np.arange(low, high)
    draws = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1000 * (k + 1) + seed))
    return np.sort(low + (draws % np.uint64(high - low)).astype(np.int64))


def fingerprints(texts: list[str], seed: int = 0) -> list[str]:
    """Fingerprints of some texts, walked in step."""
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")  # the longest first: those still walking are a prefix
    lengths = n[order]
    steps = walk_steps(lengths)
    most = int(steps[0]) if len(steps) else 0
    flat = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes, nibbles = of_points()
    kinds = np.zeros(len(flat) + most + 1, np.uint8)  # walks may run on behind their text; nothing is sampled there
    kinds[: len(flat)] = classes[flat]
    at = np.cumsum(lengths) - lengths
    last = at + lengths
    top = octaves(most)
    wanted = np.concatenate([sample_steps(k, seed) for k in range(top)]) if top else np.empty(0, np.int64)
    out = np.zeros((len(texts), digits_before(top)), np.uint8)
    live, s, j = len(texts), 0, 0
    while j < most:
        if j % LAP == 0:
            moves = random_moves(j // LAP, seed)
        while live and steps[live - 1] <= j:
            live -= 1
        own = at[:live]
        while s < len(wanted) and wanted[s] == j:
            ok = own < last[:live]
            out[:live, s][ok] = nibbles[flat[own[ok]]] + 1  # 0 stays where a walk has ended
            s += 1
        to = min(most, (j // LAP + 1) * LAP, j + 64, int(wanted[s]) if s < len(wanted) else most)
        for move in moves[j % LAP: j % LAP + to - j]:
            own += move.take(kinds.take(own))
        j = to
    made = [""] * len(texts)
    ended = (mix(wanted.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)  # the digits where a walk has ended
    digits = HEX[np.where(out > 0, out - 1, ended[None, :])] if top else np.empty((len(texts), 0), np.uint8)
    for place, i in enumerate(order.tolist()):
        made[i] = f"{n[i]:08x}" + digits[place, : digits_before(octaves(int(steps[place])))].tobytes().decode()
    return made


def likeness(a: str, b: str) -> float:
    """Estimated share of equal steps of two walks, 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    na, nb = int(a[:8], 16), int(b[:8], 16)
    x, y = np.frombuffer(a[8:].encode(), np.uint8), np.frombuffer(b[8:].encode(), np.uint8)
    longer, both, total = walk_steps(max(na, nb)), walk_steps(min(na, nb)), 0.0
    for k in range(octaves(both)):
        low, high = octave_range(k)
        steps = sample_steps(k)
        inside = np.flatnonzero(steps < both) + digits_before(k)
        if len(inside):
            share = float((x[inside] == y[inside]).mean())
            total += max(0.0, (share - 1 / 16) * 16 / 15) * (min(high, both) - low)
    return round(total / longer, 6) if longer else 0.0


def batches_of(texts: list[str], limit: int = CHUNK):
    """Ranges of texts of about ``limit`` code points."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def with_fingerprint(df: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of a text column."""
    ship(df.sparkSession)
    keep = df.drop(out)

    def work(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            for a, b in batches_of(texts):
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.array(fingerprints(texts[a:b]), pa.string())], [*part.schema.names, out])

    return keep.mapInArrow(work, StructType([*keep.schema.fields, StructField(out, StringType())]))


#: Bands of so many digits each; members of a bucket that meet in one block; rows that a task compares, about.
BANDS, DIGITS, BLOCK, TASK_ROWS = 20, 10, 512, 20_000


def band_places(size: int, band: int) -> np.ndarray:
    """The digits of a band: sampled places of the octaves that hold most steps of texts of one size."""
    low, high = digits_before(max(0, size - 3)), digits_before(size)
    draws = mix(np.arange(DIGITS, dtype=np.uint64) + np.uint64(100 * band + 7919 * size))
    return low + (draws % np.uint64(high - low)).astype(np.int64)


def band_keys(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the buckets of all bands of some fingerprints: size, band and digits in one number.

    A text indexes its own size and the next smaller one, so that it meets texts
    up to twice as short or long; an empty one has no bands.
    """
    _, digits = parsed(prints)
    values = np.where(digits >= 97, digits - 87, digits - 48).astype(np.int64)  # of hexadecimal digits
    tops = np.array([1 + (len(f) - 8 - FIRST) // SAMPLES if len(f) > 8 else 0 for f in prints], np.int64)
    places = 1 << 4 * np.arange(DIGITS - 1, -1, -1, dtype=np.int64)
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for top in np.unique(tops[tops > 0]).tolist():
        own = np.flatnonzero(tops == top)
        for size in sorted({max(1, top - 1), top}):
            for b in range(BANDS):
                rows.append(own)
                keys.append(((size * BANDS + b) << 4 * DIGITS) | values[own[:, None], band_places(size, b)] @ places)
    return np.concatenate(rows), np.concatenate(keys)


def parsed(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and digits (rows, padded) of fingerprints."""
    n = np.array([int(f[:8], 16) for f in prints], np.int64)
    digits = np.full((len(prints), max((len(f) - 8 for f in prints), default=0)), 255, np.uint8)
    for i, f in enumerate(prints):
        digits[i, : len(f) - 8] = np.frombuffer(f[8:].encode(), np.uint8)
    return n, digits


def likeness_to(i: int, js: np.ndarray, n: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """``likeness`` of row i to rows js, side by side."""
    longer, both = walk_steps(np.maximum(n[js], n[i])), walk_steps(np.minimum(n[js], n[i]))
    most = octaves(int(both.max(initial=0)))
    equal = np.zeros((len(js), digits_before(most) + 1), np.int16)
    np.cumsum(digits[js, : digits_before(most)] == digits[i, : digits_before(most)], axis=1, out=equal[:, 1:])
    total, row = np.zeros(len(js)), np.arange(len(js))
    for k in range(most):
        low, high = octave_range(k)
        inside = np.searchsorted(sample_steps(k), both)  # the samples before the end of the shorter walk come first
        some = inside > 0
        share = np.where(some, (equal[row, digits_before(k) + inside] - equal[row, digits_before(k)]) / np.maximum(inside, 1), 0.0)
        total += np.where(some, np.maximum(0.0, (share - 1 / 16) * 16 / 15) * (np.minimum(high, both) - low), 0.0)
    out = np.round(total / np.maximum(longer, 1), 6)
    return np.where((n[js] == n[i]) & (digits[js] == digits[i]).all(1), 1.0, out)


def star_links(lists: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest node and its other members that are alike, stored."""
    hubs = stored(lists.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"), "band-hubs")
    pairs = lists.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    both = (pairs.join(classes.select(F.col("node").alias("a"), F.col("fingerprint").alias("fa")), "a")
            .join(classes.select(F.col("node").alias("b"), F.col("fingerprint").alias("fb")), "b").select("a", "b", "fa", "fb"))

    def alike(rows):
        for batch in rows:
            ok = [likeness(a, b) >= least for a, b in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = stored(both.mapInArrow(alike, "a bigint, b bigint"), "star-links")
    discard(hubs)
    return found


def open_links(lists: DataFrame, classes: DataFrame, roots: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between what buckets still hold in different components: block by block, a spanning forest of each, stored."""
    members = stored(lists.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "band-members")
    counts = stored(members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")), "band-roots")
    # The largest component of a bucket stays; members of the others are compared with all.
    several = counts.groupBy("band").agg(F.count(F.lit(1)).alias("r"), F.max_by("root", F.struct("n", "root")).alias("main"),
                                         F.sum("n").alias("m"), F.max("n").alias("most")).where("r > 1")
    several = stored(several.select("band", "main", F.ceil((F.col("m") - F.col("most")) / block).cast("int").alias("nl"),
                                    F.ceil(F.col("m") / block).cast("int").alias("nr")), "open-bands")
    rows = members.join(several, "band")
    zero = F.lit(0)

    def own_block(n):
        return F.pmod(F.xxhash64("node"), n).cast("int")

    left = rows.where("root <> main").select("band", "node", "root", own_block(F.col("nl")).alias("i"),
                                             F.explode(F.sequence(zero, F.col("nr") - 1)).alias("j"), F.lit(True).alias("is_left"))
    right = rows.select("band", "node", "root", F.explode(F.sequence(zero, F.col("nl") - 1)).alias("i"), own_block(F.col("nr")).alias("j"), F.lit(False).alias("is_left"))
    met = stored(left.unionByName(right), "band-blocks")
    discard(members, counts, several)
    release(met.sparkSession)
    deals = max(1, -(-met.count() // TASK_ROWS))
    # A block is dealt whole: at most 2 * block rows of one key.
    dealt = met.join(classes.select("node", "fingerprint"), "node").withColumn("deal", F.pmod(F.xxhash64("band", "i", "j"), F.lit(deals)).cast("int"))

    def compare(rows):
        rows = rows.sort_by([(k, "ascending") for k in ("band", "i", "j")])
        key = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in ("band", "i", "j")])
        node, root = (rows.column(k).to_numpy() for k in ("node", "root"))
        is_left = rows.column("is_left").to_numpy()
        n, digits = parsed(rows.column("fingerprint").to_pylist())
        cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        edges = []
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(node)]):
            of = np.arange(low, high)
            rights = of[~is_left[low:high]]
            for x in of[is_left[low:high]].tolist():
                js = rights[root[rights] != root[x]]
                if not len(js):
                    continue
                for r in js[likeness_to(x, js, n, digits) >= least].tolist():
                    a, b = find(int(root[x])), find(int(root[r]))
                    if a != b:  # the forest joins components of the first round, whose members are linked already
                        parent[a] = b
                        edges.append((int(node[x]), int(node[r])))
        a, b = zip(*edges) if edges else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = stored(dealt.groupBy("deal").applyInArrow(lambda rows: compare(rows), "a bigint, b bigint"), "more-links")
    discard(met)
    return found


def components_by_fingerprint(prints: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(fingerprint, component_id): components of documents that are alike, from ``prints`` (doc_id, fingerprint).

    Equal fingerprints are one class.  Bands put classes into buckets; every
    bucket is linked to its smallest member, and what it then still holds in
    different components is compared block by block.  component_id is the smallest
    doc_id of a component (null ids do not count; null if there is no other).
    """
    spark = prints.sparkSession
    ship(spark)
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "print-classes")

    def band_rows(rows):
        for batch in rows:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                rows, keys = band_keys(part.column("fingerprint").to_pylist())
                yield pa.record_batch([pa.array(keys), part.column("node").take(pa.array(rows))], ["band", "node"])

    every = stored(classes.select("fingerprint", "node").mapInArrow(band_rows, "band bigint, node bigint"), "bands")
    # The bands are many times the fingerprints: their shuffles go as soon as the next table is written.
    release(spark)
    shared = stored(every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "shared-bands")
    release(spark)
    lists = stored(every.join(shared, "band", "left_semi"), "band-lists")
    discard(every, shared)
    release(spark)
    edges = star_links(lists, classes, least)
    release(spark)
    roots = stored(components(edges), "star-roots")
    more = open_links(lists, classes, roots, least, block)
    discard(lists)
    release(spark)
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    ends = stored(components(known.unionByName(more)), "roots")
    named = stored(classes.join(ends, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root")), "class-roots")
    ids = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return stored(named.join(ids, "root").select("fingerprint", "component_id"), "print-components")


def similar_documents(prints: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of every row of ``prints`` (doc_id, fingerprint); documents that are alike share a component."""
    found = components_by_fingerprint(prints, least, block)
    return prints.join(found, "fingerprint").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def id_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Bounds that cut the ids into at most ``parts`` ranges of about equal size."""
    cuts = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)
    return np.unique(np.array(cuts, np.int64))


def with_next(docs: DataFrame, most_parts: int = 4096) -> DataFrame:
    """Rows (part, role, doc_id, text), sorted inside the partitions by part, role and id.

    Role 0 are the documents; the one row of role 1 closes a part: the first
    document of the next part, or for the last part the very first.  Parts are
    ranges of ids, about four a shuffle partition.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    bounds = id_bounds(docs, min(most_parts, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        # Null ids sort first, as Spark sorts them.
        out = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(ids.isna(), 0, out).astype(np.int32))

    dealt = docs.withColumn("part", part_of("doc_id"))
    # At most ``most_parts`` rows; a null id counts as smaller than all others.
    heads = sorted((r["part"], r["first"]) for r in dealt.select("part", F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id").alias("k"))
                   .groupBy("part").agg(F.min("k").alias("first")).collect())
    before = dict(zip([p for p, _ in heads], [p for p, _ in heads[-1:] + heads[:-1]]))
    firsts = {p: first["doc_id"] for p, first in heads}

    @F.pandas_udf("int")
    def part_before(ids: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([before[p] if (None if pd.isna(i) else int(i)) == firsts[p] else None for i, p in zip(ids, parts)], dtype="Int32")

    places = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("role")), F.struct(F.col("before").alias("part"), F.lit(1).alias("role")))
    rows = dealt.withColumn("before", part_before("doc_id", "part")).select(F.explode(places).alias("p"), "doc_id", "text").where("p.part IS NOT NULL")
    return rows.select("p.part", "p.role", "doc_id", "text").repartition("part").sortWithinPartitions("part", "role", "doc_id", "text")


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint against its edited text's and its next document's (COMPARED)."""
    ship(docs.sparkSession)

    def work(batches):
        def done(rows, following):
            """Rows with the row behind each of them."""
            texts = [r[3] for r in rows] + [edited(r[3], f[3]) for r, f in zip(rows, following)]
            later = {i: f[3] for i, f in enumerate(following) if i + 1 >= len(rows) or rows[i + 1] is not f}
            prints = fingerprints(texts + list(later.values()))
            own, changed = prints[: len(rows)], prints[len(rows): 2 * len(rows)]
            after = dict(zip(later, prints[2 * len(rows):]))
            out = []
            for i, r in enumerate(rows):
                behind = after[i] if i in after else own[i + 1]
                out.append((r[2], len(r[3]), hashlib.sha256(texts[len(rows) + i].encode()).hexdigest(), own[i], changed[i],
                            likeness(own[i], changed[i]), likeness(own[i], behind)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in COMPARED.split(", ")])

        rows, following, size, last = [], [], 0, None
        for batch in batches:
            for part, role, doc, text in zip(*(batch.column(k).to_pylist() for k in ("part", "role", "doc_id", "text"))):
                row = (part, role, doc, text or "")
                if last is not None and last[0] == row[0] and last[1] == 0:
                    rows.append(last)
                    following.append(row)
                    size += 2 * len(last[3])
                    if size >= CHUNK:
                        yield done(rows, following)
                        rows, following, size = [], [], 0
                last = row
        if rows:
            yield done(rows, following)

    return with_next(docs).mapInArrow(work, COMPARED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = stored(compared_with_next(table(spark, sf_dir, "documents")), "compared")
    release(spark)  # the shuffle of the texts
    found = components_by_fingerprint(compared.select("doc_id", "fingerprint"))
    return compared.join(found, "fingerprint").select(*compared.columns, F.coalesce("component_id", "doc_id").alias("component_id"))
