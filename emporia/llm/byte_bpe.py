"""Operator 4: byte-level BPE encoding and decoding without regular expressions.

Method: every code point gets a class (letter, number, other, white space, and
by looking ahead: a space or white space before something else, an apostrophe
that opens a contraction).  A class is a function from the state of the
pre-tokeniser to its next state; functions compose associatively, so blocks of
characters are composed side by side, the few blocks that do not lead all states
to one are followed in turn, and one more pass yields all token boundaries.  The slices between boundaries are
looked up in a cache of merged slices, by a hash whose seeds every worker draws
and a second one that must agree (128 bits in all); slices not in it are
merged together, all words in step, the lowest rank of each word first (words
over LONG bytes use a heap).  Byte offsets of all ids are kept, so any range
of ids can be decoded and placed in its text.

Result: ``ids`` and ``starts`` are little-endian unsigned 32-bit integers in
binary columns (id, and the byte where it starts in the text); ``unpacked``
turns them into arrays.  Ids are those of the tiktoken library for the same
ranks and the pattern of ``public_tokenizers``; strings of special tokens are
ordinary text.

Cases: null and empty texts have no ids; texts are taken whole; a batch of
rows is worked through in chunks of about two million bytes and the text scan in
windows, so that memory is bounded by the longest text; repeated rows, extra
columns and empty tables pass through.  The cache of slices is a cache only:
it is emptied when it holds CACHED slices.
"""

from __future__ import annotations

import base64
import json
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrays import binaries, chunks, ragged, seeded_hashes, text_buffer
from .scratch import ship, table

WINDOW, CACHED, LONG, BLOCK = 1 << 20, 300_000, 64, 64
#: Slices that are looked up at a time; bits of the places of the cache, which holds up to CACHED + SIDE slices.
SIDE, PLACES = 1 << 18, 20
INF = np.int32(2**31 - 1)

# Classes of characters.  Fixed values: the 25 code points of Unicode's White_Space.
LETTER, NUMBER, OTHER, SHORT, LONGER, SPACE, LAST, WHITE, START = range(9)
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# States of the pre-tokeniser: what the token at hand is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, PREFIX, ONE_MORE, TWO_MORE = range(8)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here" for class * 8 + state; class + START is the same at a text's start."""
    follow = np.zeros((2 * START, 8), np.uint8)
    begins = np.ones((2 * START, 8), np.uint8)
    for c, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (WHITE, IN_WHITE)):
        follow[c] = own
        begins[c, own] = 0
        if c != WHITE:
            begins[c, PREFIX] = 0
    follow[LETTER, TWO_MORE], follow[LETTER, ONE_MORE] = ONE_MORE, FRESH
    begins[LETTER, [TWO_MORE, ONE_MORE]] = 0
    for c, opened in ((SHORT, ONE_MORE), (LONGER, TWO_MORE)):  # apostrophes of contractions
        follow[c] = opened
        follow[c, [IN_OTHER, PREFIX]] = IN_OTHER
        begins[c, [IN_OTHER, PREFIX]] = 0
    follow[SPACE], follow[LAST] = PREFIX, IN_WHITE
    follow[START:] = follow[:START, FRESH][:, None]
    return follow.reshape(-1), begins.reshape(-1)


FOLLOW, BEGINS = transitions()


def class_table() -> np.ndarray:
    """The class of every code point, without looking ahead (surrogates count as other)."""
    import regex

    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, chars):
            a, b = ord(chars[m.start()]), ord(chars[m.end() - 1]) + 1
            out[a:b] = c  # surrogates lie between two that are neither
    out[WHITE_SPACE] = WHITE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and values of the code points of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int32)
    wide = np.flatnonzero(lead >= 0xC0)
    for low, high, extra, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
        i = wide[(lead[wide] >= low) & (lead[wide] < high)]
        if len(i):
            value = (cp[i] & mask)
            for k in range(1, extra + 1):
                value = (value << 6) | (data[at[i] + k] & 0x3F)
            cp[i] = value
    return at, cp


def ahead(cp: np.ndarray, kinds: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Classes with what the next characters of the same text say; ``last``: a text's last character."""
    out = kinds.copy()
    n = len(cp)
    white = np.flatnonzero((kinds == WHITE) & ~last)
    white = white[white + 1 < n]
    before = white[kinds[white + 1] != WHITE]
    out[before] = np.where(cp[before] == 32, SPACE, LAST)
    quote = np.flatnonzero((cp == 39) & ~last)
    quote = quote[quote + 1 < n]
    one = cp[quote + 1]
    out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    quote, one = quote[quote + 2 < n], one[: np.count_nonzero(quote + 2 < n)]
    two = cp[quote + 2]
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[quote[pair & ~last[quote + 1]]] = LONGER
    return out


def scan(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Token starts (as flags) of a run of classes from ``state`` on, and the state behind it."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK), np.uint8)
    padded.reshape(-1)[:n] = symbols
    columns = np.ascontiguousarray(padded.T)
    # Blocks holding a class that leads every state to the same one need one lane, the others all eight.
    fixed = ((columns == SPACE) | (columns == LAST) | (columns >= START)).any(0)
    lane = np.zeros(blocks, np.uint8)
    for c in columns:
        lane = FOLLOW.take((c << 3) + lane)
    states = np.append(np.uint8(state), lane[:-1])
    open_ = np.flatnonzero(~fixed)
    if len(open_):
        part = np.broadcast_to(np.arange(8, dtype=np.uint8), (len(open_), 8))
        for c in columns[:, open_]:
            part = FOLLOW.take((c[:, None] << 3) + part)
        at, behind = int(open_[0]), int(states[open_[0]])
        for i, to in zip(open_.tolist(), part.tolist()):  # runs of such blocks one by one
            behind = to[behind if i == at else int(states[i])]
            at = i + 1
            if at < blocks:
                states[at] = behind
    flags = np.empty((BLOCK, blocks), np.uint8)
    end = n - 1 - (blocks - 1) * BLOCK
    after = state
    for j, c in enumerate(columns):
        at = (c << 3) + states
        flags[j] = BEGINS.take(at)
        states = FOLLOW.take(at)
        if j == end:
            after = int(states[-1])
    return flags.T.reshape(-1)[:n], after


class Slices:
    """Token boundaries of a buffer of texts."""

    def __init__(self):
        self.kinds = class_table()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where tokens start; texts lie between ``offsets`` and begin tokens."""
        heads = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
        tails = np.append(heads[1:], offsets[-1])
        found, state, low = [], FRESH, int(offsets[0])
        while low < offsets[-1]:
            high = min(low + WINDOW, int(offsets[-1]))
            while high < offsets[-1] and data[high] & 0xC0 == 0x80:
                high += 1
            seen = min(high + 16, int(offsets[-1]))
            while seen < offsets[-1] and data[seen] & 0xC0 == 0x80:
                seen += 1
            at, cp = code_points(data[low:seen])
            at = at + low
            first = np.zeros(len(at), bool)
            first[np.searchsorted(at, heads[(heads >= low) & (heads < seen)])] = True
            last = np.empty(len(at), bool)
            last[:-1] = first[1:]
            last[-1] = seen in (offsets[-1],) or bool(np.isin(seen, tails))
            symbols = ahead(cp, self.kinds[cp], last)
            symbols[first] += START
            n = int(np.searchsorted(at, high))
            flags, state = scan(symbols[:n], state)
            found.append(at[:n][flags != 0])
            low = high
        return np.concatenate(found) if found else np.empty(0, np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a .tiktoken file, or of the vocabulary of a byte-level .json file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # The public byte alphabet: printable bytes stand for themselves, the others for 256 and up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        return {bytes(to_byte[c] for c in t): i for t, i in vocabulary.items() if all(c in to_byte for c in t)
                and not (t.startswith("<|") and t.endswith("|>"))}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Pair merging by ranks, over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(10, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, INF, np.int32)
        at = self.place(keys)
        while len(keys):  # open addressing: the first of each place gets in, the others try the next
            free = self.keys[at] == -1
            _, one = np.unique(at[free], return_index=True)
            i = np.flatnonzero(free)[one]
            self.keys[at[i]], self.values[at[i]] = keys[i], values[i]
            rest = np.ones(len(keys), bool)
            rest[i] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], INF)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: a heap of (rank, position) over a linked list."""
        import heapq

        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1)) + [n + 1]  # of the part that starts here
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:end[i]]])
            i = end[i]
        return out

    def merge_all(self, data: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words lying one behind the other in ``data``, and how many each word has."""
        ids, first = self.byte_ids[data], np.cumsum(counts) - counts
        kept = np.ones(len(ids), bool)
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)  # the parts next to each
        width = 2
        while width < 2 * counts.max(initial=0):  # words of much the same length side by side
            rows = np.flatnonzero((counts > width // 2) & (counts <= width))
            start, end = first[rows], first[rows] + counts[rows]
            rank = np.full((len(rows), width), INF, np.int32)  # of the pair of a part and the next one
            row, place = np.nonzero(np.arange(1, width + 1) < counts[rows][:, None])
            rank[row, place] = self.pair_ranks(ids[start[row] + place], ids[start[row] + place + 1])
            while len(rank):
                k = rank.argmin(1)  # the leftmost of the lowest
                least = rank[np.arange(len(k)), k]
                row = np.flatnonzero(least < INF)
                if 4 * len(row) < 3 * len(k):
                    rank, start, end, k, least = rank[row], start[row], end[row], k[row], least[row]
                    row = np.arange(len(row))
                low, high = start[row], end[row]
                left = low + k[row]
                right = after[left]
                ids[left] = least[row]
                kept[right] = False
                then = after[right]
                after[left] = then
                rank[row, k[row]] = rank[row, right - low] = INF
                more = then < high
                before[then[more]] = left[more]
                ahead_of = before[left]
                some = ahead_of >= low
                one, two = np.append(left[more], ahead_of[some]), np.append(then[more], left[some])
                rank[np.append(row[more], row[some]), one - np.append(low[more], low[some])] = self.pair_ranks(ids[one], ids[two])
            width *= 2
        sums = np.append(0, np.cumsum(kept))
        return ids[kept], sums[first + counts] - sums[first]


class Encoder:
    """Encodes buffers of UTF-8 texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merger, self.slices = Merger(ranks), Slices()
        self.lengths = np.zeros(self.merger.size, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        self.whole = ranks
        self.clear()

    def clear(self) -> None:
        self.seeds = [int.from_bytes(os.urandom(8), "little") for _ in range(2)]
        self.check = np.empty(0, np.uint64)  # the second hash, by slot
        self.keys = np.zeros(1 << PLACES, np.uint64)  # hashes of slices, by open addressing
        self.slot = np.full(1 << PLACES, -1, np.int32)
        self.first, self.count, self.ids = array("q"), array("q"), array("I")

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, check: np.ndarray) -> None:
        """Merge the given slices and keep their ids."""
        sizes = ends - starts
        short = sizes <= LONG
        s, n = starts[short], sizes[short]
        ids, counts = self.merger.merge_all(data[ragged(s, n)], n)
        base = len(self.ids)
        self.first.frombytes((base + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.count.frombytes(counts.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        for a, b in zip(starts[~short].tolist(), ends[~short].tolist()):
            word = data[a:b].tobytes()
            own = [self.whole[word]] if word in self.whole else self.merger.merge_long(word)
            self.first.append(len(self.ids))
            self.count.append(len(own))
            self.ids.extend(own)
        fresh = np.concatenate([hashes[short], hashes[~short]])
        self.check = np.concatenate([self.check, check[short], check[~short]])
        slots = np.arange(len(self.first) - len(fresh), len(self.first), dtype=np.int32)
        at = (fresh >> np.uint64(64 - PLACES)).astype(np.int64)
        while len(fresh):  # the first of each place gets in, the others try the next
            free = self.slot[at] == -1
            _, one = np.unique(at[free], return_index=True)
            i = np.flatnonzero(free)[one]
            self.keys[at[i]], self.slot[at[i]] = fresh[i], slots[i]
            rest = np.ones(len(fresh), bool)
            rest[i] = False
            fresh, slots, at = fresh[rest], slots[rest], (at[rest] + 1) & ((1 << PLACES) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The cache slots of hashes; -1 for those that are new."""
        at = (hashes >> np.uint64(64 - PLACES)).astype(np.int64)
        slot = self.slot[at]
        open_ = np.flatnonzero((slot >= 0) & (self.keys[at] != hashes))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << PLACES) - 1)
            slot[open_] = self.slot[at[open_]]
            open_ = open_[(slot[open_] >= 0) & (self.keys[at[open_]] != hashes[open_])]
        return slot

    def slots(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray | None:
        """The cache slots of slices, merging those that are new; None if two slices share one of their hashes only."""
        if len(self.count) > CACHED:
            self.clear()
        every, check = seeded_hashes(data, s, e, self.seeds)
        slot = self.find(every)
        new = np.flatnonzero(slot < 0)
        if len(new):
            hashes, one = np.unique(every[new], return_index=True)
            i = new[one]
            self.learn(data, s[i], e[i], hashes, check[i])
            slot[new] = self.find(every[new])
        return slot if (self.check[slot] == check).all() else None

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the byte where each starts in ``data``, and the number of ids before every text (and at the end)."""
        starts = self.slices.starts(data, offsets)
        ids, places, before = [], [], [0]
        texts = np.searchsorted(starts, offsets)
        counts_of = np.empty(len(starts), np.int64)
        for low in range(0, len(starts), SIDE):
            s = starts[low:low + SIDE]
            e = np.append(starts[low + 1:low + SIDE + 1], offsets[-1] if low + SIDE >= len(starts) else [])[: len(s)].astype(np.int64)
            slot = self.slots(data, s, e)
            while slot is None:  # two slices agree in one hash only: other seeds
                self.clear()
                slot = self.slots(data, s, e)
            first, count = np.array(self.first)[slot], np.array(self.count)[slot]
            got = np.array(self.ids, np.uint32)[ragged(first, count)]
            sizes = self.lengths[got]
            heads = np.cumsum(sizes) - sizes + s[0]  # slices lie side by side, and so do their ids
            counts_of[low:low + len(s)] = count
            ids.append(got)
            places.append(heads)
        total = np.append(0, np.cumsum(counts_of))
        empty = np.empty(0, np.int64)
        return (np.concatenate(ids) if ids else empty.astype(np.uint32), np.concatenate(places) if places else empty, total[texts])


_ENCODERS: dict[int, Encoder] = {}


def encoder(ranks_of) -> Encoder:
    """The worker's encoder for a broadcast of ranks."""
    key = ranks_of.id if hasattr(ranks_of, "id") else id(ranks_of)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks_of.value)
    return _ENCODERS[key]


def broadcast_ranks(spark: SparkSession, path: str):
    """The vocabulary (tens of thousands of tokens, a fixed size) for all tasks; only the driver reads the file."""
    ship(spark)
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``starts`` (packed 32-bit integers) of the text column."""
    ranks = broadcast_ranks(df.sparkSession, path)

    def work(batches):
        own = encoder(ranks)
        for batch in batches:
            for part in chunks(batch, column):
                data, offsets = text_buffer(part.column(column))
                ids, places, before = own.encode(data, offsets)
                places = (places - np.repeat(offsets[:-1], np.diff(before))).astype(np.uint32)
                yield pa.record_batch([*part.columns, binaries(ids, before), binaries(places, before)],
                                      [*part.schema.names, "ids", "starts"])

    keep = df.drop("ids", "starts")
    schema = StructType([*keep.schema.fields, StructField("ids", BinaryType()), StructField("starts", BinaryType())])
    return keep.mapInArrow(work, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the packed ids stand for (null ids: null)."""
    ranks = broadcast_ranks(df.sparkSession, path)
    keep = df.drop(out)

    def work(batches):
        by_id = sorted((i, t) for t, i in ranks.value.items())
        tokens = [b""] * (by_id[-1][0] + 1)
        for i, t in by_id:
            tokens[i] = t
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.array([len(t) for t in tokens])
        first = np.cumsum(sizes) - sizes
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            column = batch.column(ids)
            parts = []
            for packed in column:
                if packed.is_valid:
                    i = np.frombuffer(packed.as_buffer(), "<u4")
                    parts.append(flat[ragged(first[i], sizes[i])].tobytes())
                else:
                    parts.append(None)
            yield pa.record_batch([*batch.columns, pa.array(parts, pa.binary())], [*batch.schema.names, out])

    return keep.mapInArrow(work, StructType([*keep.schema.fields, StructField(out, BinaryType())]))


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def unpacked(packed: bytes) -> list[int]:
    """A packed value as a list of integers."""
    return np.frombuffer(packed, "<u4").tolist()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(ids, path).select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                                    F.sha2("decoded", 256).alias("decoded_sha256"))
