"""Operator 5: exact n-gram Jaccard join with token-combination prefixes.

A document is its set of word shingles, as 64-bit hashes.  Method:

1.  Documents of equal sets form a class (128-bit hash of the set).  Tokens
    common within a stretch of the corpus are summed to the hot list.
2.  Tokens are dealt to buckets by hash and counted; only tokens that at least
    two documents hold go back to their documents.  A document with fewer than
    its least overlap (75 of 100) of those links with nothing and drops out.
3.  Prefixes: tokens are ordered by document frequency, the rare ones first.
    Two sets that link share at least m tokens of their prefixes extended by m
    (n - ceil(0.75 n) + m tokens).  A document whose plain prefix holds rare
    tokens only is indexed by those.  The others extend their prefix by
    m = g + 1 and index its rare tokens singly and pairs of its frequent tokens
    that fall into the same of g groups: of g + 1 shared frequent tokens two
    fall into one group.  g depends on the size of the set; a document uses
    the values of all sizes it can link with.
4.  Every index list links its members to one of them, another one in each of
    STARS rounds, where the sets verify.  What the lists then still hold in different components is compared
    block by block, by a sketch that bounds the symmetric difference from
    below (no link is lost) and then by the sets; a task tells which
    components it joined.  Nothing is expanded into all pairs of a group.

Result: components over links, one row per document.  Tokens are told apart by
64 bits, of words hashed with a seed that is drawn for every run: no texts can
be chosen that collide, and the chance that a pair of documents is miscounted
by one is below 1e-9.

Cases: words are runs without space and U+0009-U+000D, A-Z in lower case;
fewer than five words are one shingle; null, empty and blank texts have none
and link with nothing; a null id is never a component's id unless its document
is alone; repeated rows are one class; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import UPPER_TO_LOWER, binaries, chunks, combined, mix, seeded_hashes, text_buffer, words
from .columns import ROW, narrowed, widened
from .components import components
from .scratch import discard, frugal, give_back, release, ship, stored, table

WIDTH, NEED, OF = 5, 75, 100
#: Tokens and documents that one stretch of a task holds at most.
FLUSH_TOKENS, FLUSH_DOCS = 1 << 20, 60_000
#: Documents of a stretch are numbered in 16 bits: it is ended before a chunk would take it past so many.
NUMBERS = 1 << 16
#: Tokens in a bucket, about.  Up to BUCKETS of them are ranges of a token's upper 16 bits; beyond, each is cut by the next bits.
BUCKET, BUCKETS = 1 << 20, 1 << 16
#: Hot: held by HOT_SHARE of a stretch's classes (8 at least), HOT_FROM in all; the list is bounded.
HOT_SHARE, HOT_FROM, MAX_HOT = 0.02, 1000, 1 << 18
#: Tokens of so many documents are indexed in pairs.
FREQUENT = 256
#: Rounds in which lists are linked to one of their members.
STARS = 2
BLOCK = 2048
#: Rows of open lists that a task compares, about, and bytes of their sets; bytes of sets in a block.
TASK_ROWS, TASK_BYTES, BLOCK_BYTES = 30_000, 1 << 27, 1 << 25
#: Sets that one set is held against at a time, and pairs that do not link which a task remembers.
TRIES, MAX_APART = 16, 1 << 19
LOW48 = np.uint64((1 << 48) - 1)


def least_overlap(n):
    """The fewest tokens that a set of n shares with a set it links with."""
    return -(-NEED * n // OF)


def links(na, nb, shared):
    return OF * shared >= NEED * (na + nb - shared)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, their number before each text, and the class of each (16 bytes)."""
    low = int(offsets[0])
    data, offsets = UPPER_TO_LOWER[data[low:int(offsets[-1])]], offsets - low
    starts, ends, before = words(data, offsets)
    h = seeded_hashes(data, starts, ends, [seed])[0]
    n_words = np.diff(before)
    text = np.repeat(np.arange(len(n_words)), n_words)
    if len(h) >= WIDTH:
        all_ = combined([h[k:len(h) - WIDTH + 1 + k] for k in range(WIDTH)], WIDTH)
        inside = text[: len(all_)] == text[WIDTH - 1:]
        tokens, owner = all_[inside], text[: len(all_)][inside]
    else:
        tokens, owner = h[:0], text[:0]
    for k in range(1, WIDTH):  # the whole sequence of a short text
        few = np.flatnonzero(n_words == k)
        if len(few):
            tokens = np.append(tokens, combined([h[before[few] + j] for j in range(k)], k))
            owner = np.append(owner, few)
    order = np.argsort(owner, kind="stable")
    tokens, cut = tokens[order], np.searchsorted(owner[order], np.arange(len(n_words) + 1))
    sets = [np.unique(tokens[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else tokens
    ends = np.append(0, np.cumsum(sizes))
    classes = np.empty((len(sizes), 2), "<u8")
    for lane, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        sums = np.append(np.uint64(0), np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64))
        classes[:, lane] = mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return flat, ends, classes.view("V16").reshape(-1)


def class_array(classes: np.ndarray) -> pa.Array:
    """Classes (16 bytes each) as a binary column."""
    return binaries(np.ascontiguousarray(classes).view(np.uint8), np.arange(len(classes) + 1), 16)


def stretches(batches, with_ids: bool, seed: int = 0):
    """The texts of a task in stretches: (ids, sizes, classes of all texts; tokens, ends, classes of distinct ones).

    ``ids`` are the other columns of the batches, row by row, if they are asked for.
    """
    ids, sizes, of, seen = [], [], [], set()
    tokens, lengths, classes, n_tokens = [], [], [], 0

    def parts(batch):
        for part in chunks(batch, "text"):
            for at in range(0, part.num_rows, NUMBERS):
                yield part.slice(at, NUMBERS)

    def out():
        return (ids, np.concatenate(sizes), np.concatenate(of), np.concatenate(tokens) if tokens else np.empty(0, np.uint64),
                np.append(0, np.cumsum(lengths)).astype(np.int64), np.frombuffer(b"".join(classes), "V16"))

    for batch in batches:
        for part in parts(batch):
            if sizes and sum(map(len, sizes)) + part.num_rows > NUMBERS:
                yield out()
                ids, sizes, of, seen, tokens, lengths, classes, n_tokens = [], [], [], set(), [], [], [], 0
            flat, ends, own = shingle_sets(*text_buffer(part.column("text")), seed)
            n = np.diff(ends)
            sizes.append(n)
            of.append(own)
            ids += list(zip(*(part.column(k).to_pylist() for k in ("doc_id", "row_hash")))) if with_ids else []
            packed = own.tobytes()
            for i, c in enumerate(packed[k:k + 16] for k in range(0, len(packed), 16)):
                if n[i] and c not in seen:
                    seen.add(c)
                    tokens.append(flat[ends[i]:ends[i + 1]])
                    lengths.append(n[i])
                    classes.append(c)
                    n_tokens += n[i]
            if n_tokens >= FLUSH_TOKENS or sum(map(len, sizes)) >= FLUSH_DOCS:
                yield out()
                ids, sizes, of, seen, tokens, lengths, classes, n_tokens = [], [], [], set(), [], [], [], 0
    if sizes:
        yield out()


def classes(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, row_hash, n_shingles, class) of every row; further rows (token, seen) of tokens common in a stretch."""
    names = ["doc_id", "row_hash", "n_shingles", "class", "token", "seen"]

    def work(batches):
        for ids, sizes, of, tokens, ends, own in stretches(batches, True, seed):
            n = len(sizes)
            docs, rows = zip(*ids)
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), class_array(of),
                                   pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            token, seen = np.unique(tokens, return_counts=True)
            hot = seen >= max(8, HOT_SHARE * len(own))
            n = int(hot.sum())
            yield pa.record_batch([*[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.binary()), pa.array(token[hot].view(np.int64)), pa.array(seen[hot], pa.int64())], names)

    # row_hash tells rows of one id apart.
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(
        frugal(work), "doc_id bigint, row_hash bigint, n_shingles bigint, class binary, token bigint, seen bigint")


def pack48(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


DEALT = "bucket int, stretch bigint, tokens binary, docs binary, freqs binary, classes binary, sizes binary"
FIELDS = [f.split()[0] for f in DEALT.split(", ")]
ARROW = pa.schema([("bucket", pa.int32()), ("stretch", pa.int64()), *[(n, pa.binary()) for n in FIELDS[2:]]])


def shared_tokens(docs: DataFrame, buckets: int, cuts: int, hot: np.ndarray, hot_freqs: np.ndarray, seed: int) -> DataFrame:
    """Rows by stretch: its documents (classes, sizes, and hot tokens), and tokens that several documents hold.

    Tokens are dealt to ``buckets`` by their upper 16 bits, and inside each to ``cuts`` by the next ones.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((hot, hot_freqs))  # at most MAX_HOT tokens

    def token_ids(tokens):
        """Bucket (from the upper 16 bits) above the lower 48 bits."""
        return (((tokens >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)), tokens & LOW48

    def dealt(b, low):
        """The number of the bucket and cut."""
        return (b * np.uint64(cuts) + ((low >> np.uint64(16)) * np.uint64(cuts) >> np.uint64(32))).astype(np.int64)

    def deal(batches):
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        hot, freqs = known.value
        for _, _, _, tokens, ends, own in stretches(batches, False, seed):
            stretch, count = task * (1 << 24) + count, count + 1
            doc = np.repeat(np.arange(len(own), dtype=np.uint16), np.diff(ends))
            at = np.searchsorted(hot, tokens)
            is_hot = np.zeros(len(tokens), bool) if not len(hot) else hot[np.minimum(at, len(hot) - 1)] == tokens
            b, low = token_ids(tokens)
            full = (b << np.uint64(48) | low)[is_hot]
            rows = [(stretch % (buckets * cuts), stretch, full.astype("<u8").tobytes(), doc[is_hot].tobytes(),
                     freqs[at[is_hot]].astype("<u4").tobytes() if len(hot) else b"", own.tobytes(), np.diff(ends).astype("<u4").tobytes())]
            b, low, doc = dealt(b[~is_hot], low[~is_hot]), low[~is_hot], doc[~is_hot]
            order = np.argsort(b, kind="stable")
            b, low, doc = b[order], low[order], doc[order]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, int)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
                rows.append((int(b[i]), stretch, pack48(low[i:j]), doc[i:j].tobytes(), None, None, None))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    def count(rows):
        own = rows.column("classes").is_valid().to_numpy()
        passed = rows.filter(pa.array(own))
        rest = rows.filter(pa.array(~own))
        if not rest.num_rows:
            return passed
        bucket = rest.column("bucket")[0].as_py()
        parts = [unpack48(x.as_py()) for x in rest.column("tokens")]
        tokens = np.concatenate(parts)
        source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        doc = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rest.column("docs")])
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        freq = np.diff(np.append(heads, len(tokens)))
        many = np.repeat(freq > 1, freq)
        freq = np.repeat(freq, freq)[many]
        tokens, source, doc = tokens[many], source[order][many], doc[order][many]
        back = np.argsort(source, kind="stable")
        tokens, source, doc, freq = tokens[back] | np.uint64(bucket // cuts << 48), source[back], doc[back], freq[back]
        stretch = rest.column("stretch").to_numpy()
        cut = np.searchsorted(source, np.arange(len(parts) + 1))
        found = [(bucket, int(stretch[k]), tokens[i:j].astype("<u8").tobytes(), doc[i:j].tobytes(), freq[i:j].astype("<u4").tobytes(), None, None)
                 for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]
        made = pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), ARROW)], schema=ARROW) if found else ARROW.empty_table()
        return pa.concat_tables([passed.cast(ARROW), made])

    return docs.select("doc_id", "text").mapInArrow(frugal(deal), DEALT).groupBy("bucket").applyInArrow(count, DEALT)


CANDIDATES = "class binary, n int, tokens binary, freqs binary"


def candidates(shared: DataFrame) -> DataFrame:
    """Classes that hold enough shared tokens to link with anything: their shared tokens (ascending) and frequencies."""
    schema = pa.schema([("class", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary()), ("freqs", pa.binary())])

    def gather(rows):
        head = rows.filter(rows.column("classes").is_valid())
        own = head.column("classes")[0].as_py()
        sizes = np.frombuffer(head.column("sizes")[0].as_py(), "<u4").astype(np.int64)
        tokens = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in rows.column("tokens")])
        doc = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in rows.column("docs")])
        freq = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows.column("freqs")])
        order = np.lexsort((tokens, doc))
        tokens, doc, freq = tokens[order], doc[order], freq[order]
        cut = np.searchsorted(doc, np.arange(len(sizes) + 1))
        found = []
        for i in np.flatnonzero(np.diff(cut) >= least_overlap(sizes)).tolist():
            a, b = cut[i], cut[i + 1]
            found.append((own[16 * i:16 * i + 16], int(sizes[i]), tokens[a:b].tobytes(), freq[a:b].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema) if found else schema.empty_table()

    return stored(shared.groupBy("stretch").applyInArrow(gather, CANDIDATES), "candidates")


def groups_of(n: int) -> int:
    """g: the number of groups that frequent tokens of a set of n fall into."""
    return 1 << max(0, (n // 4).bit_length() - 1)


def index_keys(n: int, tokens: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Index keys of a set of n tokens whose shared ones are given; any two sets that link have one in common."""
    order = np.lexsort((tokens, freqs))
    tokens, frequent = tokens[order], freqs[order] >= FREQUENT
    least = least_overlap(n)

    def prefix(m):  # unshared tokens come first in the order, so that many fewer are left
        return max(0, len(tokens) - least + m)

    if not frequent[: prefix(1)].any():
        return mix(tokens[: prefix(1)])
    keys = []
    for g in {groups_of(k) for k in (least, n, n * OF // NEED)}:
        m = prefix(min(g + 1, least))
        keys.append(mix(tokens[:m][~frequent[:m]]))
        often = tokens[:m][frequent[:m]]
        if g + 1 > least:  # too small to extend: frequent tokens singly
            keys.append(mix(often ^ np.uint64(g)))
            continue
        h = mix(often)
        group = h % np.uint64(g)
        for k in np.unique(group):
            one = np.sort(h[group == k])
            i, j = np.triu_indices(len(one), 1)
            keys.append(combined([one[i], one[j]], g))
    return np.unique(np.concatenate(keys))


def index(found: DataFrame) -> DataFrame:
    """(key, class) of the index lists."""
    def work(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = zip(*(part.column(k).to_pylist() for k in ("n", "tokens", "freqs")))
                keys = [index_keys(n, np.frombuffer(tokens, "<u8"), np.frombuffer(freqs, "<u4")) for n, tokens, freqs in sets]
                owner = part.column("class").take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), owner], ["key", "class"])

    return found.mapInArrow(frugal(work), "key bigint, class binary")


EDGES = "a binary, b binary"


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    sets = found.select("class", "n", "tokens")
    a = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    near = F.least("na", "nb") * OF >= F.greatest("na", "nb") * NEED
    both = pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "na", "nb", "ta", "tb")

    def work(batches):
        for batch in batches:
            ok = [links(na, nb, len(np.intersect1d(np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8"), assume_unique=True)))
                  for na, nb, ta, tb in zip(*(batch.column(k).to_pylist() for k in ("na", "nb", "ta", "tb")))]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(frugal(work), EDGES)


def sketch_words(n: int) -> int:
    """64-bit words of the sketch of a set of n: 16, 64, 256 or 1024."""
    return 16 << 2 * int(np.searchsorted([512, 2048, 8192], n))


def sketch(tokens: np.ndarray, n_words: int) -> np.ndarray:
    """Odd sketch: the parity of the tokens at every bit; two differ in at most as many bits as the sets in tokens."""
    bit = np.bincount((mix(tokens) % np.uint64(64 * n_words)).astype(np.int64), minlength=64 * n_words) & 1
    return np.packbits(bit.astype(np.uint8), bitorder="little").view("<u8")


def folded(s: np.ndarray, n_words: int) -> np.ndarray:
    """Sketches (rows) as if made with fewer words."""
    return np.bitwise_xor.reduce(s.reshape(len(s), -1, n_words), axis=1)


def rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The index with the component of every member, as far as links are known."""
    known = roots.select(F.col("node").alias("class"), "root")
    return stored(lists.join(known, "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")


def star_pairs(rows: DataFrame, number: int) -> DataFrame:
    """Distinct pairs of a list's hub, another one in every round, with the members of other components."""
    hubs = stored(rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("class", F.lit(number)).alias("h"), "class", "root")).alias("hub"),
                                          F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "hub"), "hubs")
    return rows.join(hubs, "key").where("root <> hub.root").select(
        F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()


def shared_with(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many tokens of ``own`` each of the others holds; all are sorted and not empty."""
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit, np.append(0, np.cumsum([len(t) for t in others[:-1]])).astype(np.int64), dtype=np.int64)


def open_pairs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of roots of components that members of one list of ``rows`` (key, class, root, bytes) link.

    Tasks compare what the sketch cannot rule out by the sets themselves and tell each root that they have joined
    with others once, with the smallest of them, so that a group of near copies gives fewer pairs than members.
    """
    def sketches(batches):
        for batch in batches:
            n = batch.column("n").to_pylist()
            tokens = [np.frombuffer(t, "<u8") for t in batch.column("tokens").to_pylist()]
            yield pa.record_batch([batch.column("class"), batch.column("n"), batch.column("tokens"),
                                   pa.array([sketch(t, sketch_words(k)).tobytes() for k, t in zip(n, tokens)], pa.binary())],
                                  ["class", "n", "tokens", "sketch"])

    counts = stored(rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.sum("bytes").alias("bytes")), "list-roots")
    # Lists with several components: the largest stays, the members of the others are compared with all.
    # Of two members one was the hub of the first round, and that pair has been verified.
    several = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("r"), F.max(F.struct("n", "root", "bytes")).alias("main"), F.sum("n").alias("m"),
        F.min("low").alias("low"), F.sum("bytes").alias("bytes")).where("r > 1 AND m > 2")

    def blocks_of(n, size):
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")

    load = several.select("key", "low", "m", "bytes", F.col("main.root").alias("main"), blocks_of(F.col("m"), F.col("bytes")).alias("nr"),
                          blocks_of(F.col("m") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("nl"))
    # Lists of much the same members have the same smallest member; in one task each of their pairs is compared once.
    load = stored(load.withColumn("load", F.col("nl") * F.greatest(F.col("m") / TASK_ROWS, F.col("bytes") / TASK_BYTES)), "open-lists")
    deals = max(1, math.ceil(load.agg(F.sum("load")).first()[0] or 0))
    load = load.withColumn("deal", F.pmod(F.xxhash64("low"), F.lit(deals)))
    shares = load.groupBy("deal").agg(F.ceil(F.sum("load")).alias("shares"))
    dealt = stored(load.join(shares, "deal").select("key", "main", "nl", "nr", "deal", "shares"), "dealt-lists")
    members = rows.join(dealt, "key").select("key", "class", "root", (F.col("root") != F.col("main")).alias("minor"), "nl", "nr", "deal", "shares")
    members = stored(members, "open-rows")

    def block(n):
        return F.pmod(F.xxhash64("class"), n).cast("int")

    # A list of one block is one group; of a longer one every block of minor members meets every block of members.
    one = (F.col("nl") == 1) & (F.col("nr") == 1)
    zero = F.lit(0)
    whole = members.where(one).select("*", zero.alias("i"), zero.alias("j"), F.col("minor").alias("is_left"), F.lit(True).alias("is_right"))
    left = members.where(~one & F.col("minor")).select("*", block(F.col("nl")).alias("i"), F.explode(F.sequence(zero, F.col("nr") - 1)).alias("j"),
                                                       F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    right = members.where(~one).select("*", F.explode(F.sequence(zero, F.col("nl") - 1)).alias("i"), block(F.col("nr")).alias("j"),
                                       F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
    blocks = whole.unionByName(left).unionByName(right).select(
        "key", "i", "j", "is_left", "is_right", "class", "root", "deal", F.pmod(F.xxhash64("key", "i", "j"), F.col("shares")).alias("share"))
    # A task gets the set of a class once, however many of its lists hold it.
    held = blocks.select("deal", "share", "class", "root").distinct().toDF("set_deal", "set_share", "class", "set_root")
    sets = held.join(found.select("class", "n", "tokens").mapInArrow(sketches, "class binary, n int, tokens binary, sketch binary"), "class").select(
        "set_deal", "set_share", F.col("class").alias("set"), "set_root", "n", "tokens", "sketch")

    def compare(rows, sets):
        rows = rows.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in ("key", "i", "j")])
        at = {x: i for i, x in enumerate(sets.column("set").to_pylist())}
        member = np.array([at[x] for x in rows.column("class").to_pylist()], np.int64)
        is_left, is_right = rows.column("is_left").to_numpy(), rows.column("is_right").to_numpy()
        coded = sets.column("set_root").combine_chunks().dictionary_encode()
        first, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        root = first.copy()
        n = sets.column("n").to_numpy().astype(np.int64)
        tokens = [np.frombuffer(t, "<u8") for t in sets.column("tokens").to_pylist()]
        alone = n - np.array([len(t) for t in tokens], np.int64)
        raw = sets.column("sketch").to_pylist()
        width = np.array([len(x) // 8 for x in raw], np.int64)
        cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        apart_ones = set()

        def join(x, near):
            """Join the component of x with those of the members of ``near`` that it links with, the likeliest first."""
            while len(near):
                some = [r for r in near[:TRIES].tolist() if (min(r, x), max(r, x)) not in apart_ones]
                linked = links(n[some], n[x], shared_with(tokens[x], [tokens[r] for r in some])).tolist() if some else []
                for r, ok in zip(some, linked):
                    if ok and root[r] != root[x]:
                        root[root == root[r]] = root[x]
                    elif not ok and len(apart_ones) < MAX_APART:  # beyond, other lists compare them again
                        apart_ones.add((min(r, x), max(r, x)))
                near = near[TRIES:]
                near = near[root[near] != root[x]]

        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(member)]):
            of = member[lo:hi]
            rights, lefts = of[is_right[lo:hi]], of[is_left[lo:hi]]
            sizes = {w: rights[width[rights] == w] for w in (16, 64, 256, 1024)}
            made = {w: np.frombuffer(b"".join(raw[r] for r in s.tolist()), "<u8").reshape(len(s), w) for w, s in sizes.items() if len(s)}
            for x in lefts.tolist():
                own = np.frombuffer(raw[x], "<u8")
                near, likeness = [], []
                for w, s in sizes.items():
                    if not len(s) or not len(own) // 4 <= w <= len(own) * 4:
                        continue
                    fit = (root[s] != root[x]) & (np.minimum(n[s], n[x]) * OF >= np.maximum(n[s], n[x]) * NEED)
                    s2 = s[fit]
                    if not len(s2):
                        continue
                    least = min(w, len(own))
                    apart = np.bitwise_count(folded(made[w][fit], least) ^ folded(own[None, :], least)).sum(1)
                    shared = (n[s2] + n[x] - alone[s2] - alone[x] - apart) // 2
                    ok = links(n[s2], n[x], shared)
                    near.append(s2[ok])
                    likeness.append(shared[ok] / (n[s2][ok] + n[x] - shared[ok]))
                if near:
                    join(x, np.concatenate(near)[np.argsort(-np.concatenate(likeness), kind="stable")])
        _, one = np.unique(first, return_index=True)
        least = {}
        for k, of in zip(names, root[one].tolist()):
            least[of] = min(least.get(of, k), k)
        pairs = [(k, least[of]) for k, of in zip(names, root[one].tolist()) if k != least[of]]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def joined(rows, sets):
        out = compare(rows, sets)
        give_back()
        return out

    return blocks.drop("root").groupBy("deal", "share").cogroup(sets.groupBy("set_deal", "set_share")).applyInArrow(joined, EDGES)


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_shingles, class, root) of every row of ``docs`` (doc_id, text): root is one class of its component."""
    spark = docs.sparkSession
    ship(spark)
    seed = secrets.randbits(64)
    first = stored(classes(docs, seed), "classes")
    rows = first.where("class IS NOT NULL").select("doc_id", "row_hash", "n_shingles", "class")
    top = (first.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= HOT_FROM)
           .orderBy(F.desc("seen"), "token").limit(MAX_HOT).toPandas())
    hot = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    wanted = -(-(rows.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET)
    buckets, cuts = min(BUCKETS, max(1, wanted)), max(1, -(-wanted // BUCKETS))
    shared = candidates(shared_tokens(docs, buckets, cuts, hot[order], top["seen"].to_numpy(np.int64)[order], seed))
    found = stored(shared.dropDuplicates(["class"]), "sets")  # a class may come from several stretches
    release(spark)  # the two shuffles of tokens are the largest of the join
    discard(shared)
    every = stored(index(found), "index")
    # Lists of one member link nothing.
    several = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "list-keys")
    lists = stored(every.join(several, "key", "left_semi"), "lists")
    discard(every, several)

    edges = spark.createDataFrame([], EDGES)
    roots = spark.createDataFrame([], "node binary, root binary")
    for number in range(STARS):
        members = rooted(lists, roots)
        new = stored(verified(star_pairs(members, number), found), "star-links")
        discard(members)
        edges = stored(edges.unionByName(new), "links")
        roots = stored(components(edges), "star-roots")
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    sizes = found.select("class", F.octet_length("tokens").cast("long").alias("bytes"))
    members = rooted(lists.join(sizes, "class"), roots)
    discard(lists)
    more = stored(open_pairs(members, found), "more-links")
    discard(members, found)
    roots = components(edges.unionByName(more))
    return rows.join(roots, rows["class"] == roots["node"], "left").select(
        *rows.columns, F.coalesce("root", "class").alias("root"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = stored(grouped(docs), "grouped")
    ids = stored(rows.where("n_shingles > 0").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id")), "component-ids")
    out = rows.join(ids, rows["root"] == ids["of"], "left")
    return out.select("doc_id", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(
        F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near copies stays.

    It is the row with the smallest doc_id, null ids last; of several with that
    id the one of the smallest class and text hash, and of equal rows one.  Rows
    are told apart by id and text, so another text under a dropped id stays.
    Rows without words link with nothing and all stay.
    """
    rows = stored(grouped(docs.select("doc_id", "text")).where("n_shingles > 0"), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "class", "row_hash")
    kept = stored(rows.groupBy("root").agg(F.min(place).alias("p")).select(
        F.col("p.doc_id").alias("kept_id"), F.col("p.row_hash").alias("kept_hash")), "kept")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("row_hash").eqNullSafe(F.col("kept_hash"))
    gone = rows.join(kept, is_kept, "left_anti").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    columns = docs.columns
    narrow = narrowed(docs).withColumn("row_hash", F.xxhash64("text"))
    left = narrow.join(stored(gone, "gone"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left_anti")
    again = stored(rows.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")), "repeated-rows")
    if again.limit(1).count():
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))
        one = left.join(again, same, "left_semi").groupBy("doc_id", "row_hash").agg(F.first("text").alias("text"), F.first(ROW).alias(ROW))
        left = left.join(again, same, "left_anti").unionByName(one.select(*left.columns))
    return widened(left, columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
           ELSE array_to_string(w[i:i + 4], ' ') END AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""
