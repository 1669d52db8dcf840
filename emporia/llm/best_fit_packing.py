"""Operator 8: best-fit packing by a grouping genetic algorithm.

Method: documents are tokenised, closed with id 0 and cut into pieces of at
most ``capacity`` ids (only documents longer than that; the first piece is the
shorter one).  Pieces are dealt to shards at random; every shard is evolved on
several islands.  A chromosome is a packing.  Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold
duplicates of their pieces and best-fits the displaced pieces, after one or two
of them were exchanged for smaller ones of a bin wherever that fills it better;
mutation dissolves badly filled bins.  After an epoch the elite of each island
migrates to the next one.  A shard whose plain best fit needs no more sequences
than its ids fill is optimal and is not searched.  The best packing of each shard closes its well-filled bins;
the pieces of the others are pooled, dealt again and packed the same way.

Ids equal those of the tokenizers library for the vocabulary file (checked in
the tests); they are made by the encoder of operator 4, which is several times
faster.  Strings of special tokens are ordinary text.

Cases: null and empty texts are the one id 0; a null id stays null; repeated
rows are packed each on their own; pieces of one length are interchangeable (ties by id); an empty
table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import chunks, text_buffer
from .byte_bpe import broadcast_ranks, encoder, vocabulary
from .scratch import frugal, stored, table

CAPACITY, END = 2048, 0
#: Pieces in a shard, islands, epochs, chromosomes and children of an epoch.
SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 2, 2, 4, 8
#: Bins filled at least so far are closed after the first round.
CLOSED = 0.98

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents (PIECES)."""
    ranks = broadcast_ranks(docs.sparkSession, path)
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def work(batches):
        own = encoder(ranks)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, _, before = own.encode(*text_buffer(part.column("text")))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), before[:-1].tolist(), before[1:].tolist()):
                    full = ids[a:b].astype("<u4").tobytes() + END.to_bytes(4, "little")
                    n, at, k = b - a + 1, 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        rows.append((doc, k, at, size, zlib.crc32(full[4 * at:4 * (at + size)])))
                        at, k = at + size, k + 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return docs.select("doc_id", "text").mapInArrow(frugal(work), PIECES)


class Packing:
    """Bins under construction: best fit finds the fullest bin with room through a bit mask of free sizes."""

    def __init__(self, lengths: Sequence[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def offer(self, b: int) -> None:
        r = self.free[b]
        self.by_free[r].append(b)
        self.mask |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.capacity - sum(self.lengths[i] for i in items))
        self.offer(len(self.bins) - 1)

    def refill(self, b: int, items: list[int]) -> None:
        """Give bin ``b`` other pieces."""
        held = self.by_free[self.free[b]]
        held.remove(b)
        if not held:
            self.mask ^= 1 << self.free[b]
        self.bins[b], self.free[b] = items, self.capacity - sum(self.lengths[i] for i in items)
        self.offer(b)

    def best_fit(self, items: Sequence[int]) -> None:
        lengths = self.lengths
        for i in items:
            size = lengths[i]
            fits = self.mask >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = self.by_free[r].pop()
                if not self.by_free[r]:
                    self.mask ^= 1 << r
                self.bins[b].append(i)
                self.free[b] = r - size
                self.offer(b)
            else:
                self.add_bin([i])

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins as unevenly filled as can be."""
        return -len(self.bins), sum((1 - f / self.capacity) ** 2 for f in self.free)


def rebuilt(bins: list[list[int]], lengths: Sequence[int], capacity: int) -> Packing:
    p = Packing(lengths, capacity)
    for b in bins:
        p.add_bin(list(b))
    return p


def exchanged(p: Packing, loose: list[int]) -> list[int]:
    """One or two pieces of a bin exchanged for one or two loose ones that fill it better, as far as that goes; the loose pieces left."""
    lengths = p.lengths
    loose = sorted(loose, key=lambda i: lengths[i])
    for b in sorted(range(len(p.bins)), key=lambda b: -p.free[b]):
        while p.free[b] and loose:
            own, room, best = sorted(p.bins[b], key=lambda i: lengths[i])[:8], p.free[b], (0, (), ())
            for out in [(i,) for i in own] + [(i, j) for k, i in enumerate(own) for j in own[k + 1:]]:
                size = sum(lengths[i] for i in out)
                low, high = 0, len(loose) - 1
                while high >= 0 and lengths[loose[high]] > size + room:
                    high -= 1
                if high >= 0 and lengths[loose[high]] - size > best[0]:
                    best = (lengths[loose[high]] - size, out, (loose[high],))
                while low < high:  # the pair with the largest sum that fits
                    total = lengths[loose[low]] + lengths[loose[high]]
                    if total > size + room:
                        high -= 1
                        continue
                    if total - size > best[0]:
                        best = (total - size, out, (loose[low], loose[high]))
                    low += 1
                if best[0] == room:
                    break
            gain, out, into = best
            if not gain:
                break
            p.refill(b, [i for i in p.bins[b] if i not in out] + list(into))
            loose = sorted([i for i in loose if i not in into] + list(out), key=lambda i: lengths[i])
    return loose


def finished(bins: list[list[int]], loose: list[int], like: Packing, rng: random.Random | None = None) -> Packing:
    """A packing of some bins and loose pieces: exchanges first, then best fit, the largest (about, with ``rng``) first."""
    p = rebuilt(bins, like.lengths, like.capacity)
    p.best_fit(sorted(exchanged(p, loose), key=lambda i: -like.lengths[i] * (rng.uniform(0.7, 1.3) if rng else 1.0)))
    return p


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Well-filled bins of ``a`` injected into ``b``; displaced pieces are exchanged and best-fitted."""
    good = [x for x, free in zip(a.bins, a.free) if free <= a.capacity // 100]
    injected = rng.sample(good, (len(good) + 1) // 2) if good else []
    held = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in b.bins:
        if held.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in held]
    return finished(injected + kept, displaced, b)


def mutated(p: Packing, rng: random.Random) -> Packing:
    """The emptiest bins and a few others dissolved, their pieces exchanged and packed again."""
    order = sorted(range(len(p.bins)), key=lambda b: -p.free[b])
    gone = set(order[: 1 + len(order) // 50]) | set(rng.sample(order, min(len(order), 3)))
    return finished([x for b, x in enumerate(p.bins) if b not in gone], [i for b in gone for i in p.bins[b]], p, rng)


def evolve(lengths: list[int], capacity: int, seed: int, elite: list[list[int]] | None = None,
           population: int = POPULATION, children: int = CHILDREN) -> Packing:
    """The best packing of one island's epoch; ``lengths`` descend, ``elite`` came from another island."""
    rng = random.Random(seed)
    start = Packing(lengths, capacity)
    start.best_fit(range(len(lengths)))
    living = [start]
    if elite is not None:
        living.append(rebuilt(elite, lengths, capacity))
    bound = -(-sum(lengths) // capacity)
    while len(living) < population and -max(p.fitness() for p in living)[0] > bound:
        other = Packing(lengths, capacity)
        other.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(0.7, 1.3)))
        living.append(other)
    for _ in range(children):
        living.sort(key=Packing.fitness, reverse=True)
        if len(living[0].bins) <= bound or len(living) < 2:
            break
        a, b = rng.sample(living, 2)
        living.append(mutated(crossover(a, b, rng), rng))
        living.sort(key=Packing.fitness, reverse=True)
        living = living[:population]
    return max(living, key=Packing.fitness)


def flat(p: Packing) -> bytes:
    """A packing as the bin number of every piece."""
    out = np.zeros(len(p.lengths), np.int32)
    for b, items in enumerate(p.bins):
        out[items] = b
    return out.tobytes()


def unflat(packed: bytes) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(np.frombuffer(packed, np.int32).tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


ORDER = ["length", "doc_id", "piece", "ids_crc32"]
#: Set where the id is null: pandas would turn a column of ids with nulls into floating point.
ITEMS = PIECES + ", no_id boolean"
ISLAND = "shard int, island int, bins binary, n_bins int, fill double, bound bigint"


def sorted_items(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(ORDER, ascending=[False, True, True, True], kind="stable", ignore_index=True)


def sharded(items: DataFrame, n_items: int, number: int) -> DataFrame:
    """The items with a shard drawn at random, so that no id decides a shard's size; to be stored before it is used."""
    return items.withColumn("shard", F.floor(F.rand(number) * max(1, round(n_items / SHARD))).cast("int"))


def searched(loose: DataFrame, started: DataFrame, number: int, capacity: int, islands: int, epochs: int, result) -> DataFrame:
    """The best packings of all islands and shards of ``loose``; every island starts from the plain best fit."""
    copies = loose.select("shard", *ORDER, F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    state = started.drop("island").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).select(*started.columns)

    def later(epoch):
        def run(key, pdf, guests):
            lengths = sorted_items(pdf)["length"].tolist()
            elite = max(guests.itertuples(), key=lambda g: (-g.n_bins, g.fill, -g.from_island))
            return result(*key, evolve(lengths, capacity, seed=(int(key[0]) * 1009 + int(key[1])) * 31 + epoch, elite=unflat(elite.bins)))
        return run

    for epoch in range(epochs):
        # The elite of an island goes to the next; an island keeps what it has as a guest of its own.
        moved = state.withColumn("from_island", F.col("island")).withColumn("island", F.explode(
            F.array(F.col("island"), ((F.col("island") + 1) % islands).cast("int"))))
        state = stored(copies.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(later(epoch), ISLAND),
                       f"epoch-{number}-{epoch}")
    return state


def packed_round(items: DataFrame, n_items: int, number: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """One round over all shards: the items with shard, bin (inside the shard) and offset."""
    dealt = stored(sharded(items, n_items, number), f"dealt-{number}")
    # Full pieces fill a sequence each; they need no search.
    loose = dealt.where(F.col("length") < capacity)
    def result(shard, island, best, bound=0):
        n, fill = best.fitness()
        return pd.DataFrame({"shard": [shard], "island": [island], "bins": [flat(best)], "n_bins": [-n], "fill": [fill], "bound": [bound]})

    def plain(key, pdf):
        lengths = sorted_items(pdf)["length"].tolist()
        best = Packing(lengths, capacity)
        best.best_fit(range(len(lengths)))
        return result(key[0], 0, best, -(-sum(lengths) // capacity))

    started = stored(loose.select("shard", *ORDER).groupBy("shard").applyInPandas(plain, ISLAND), f"best-fit-{number}")
    done, state = started.where("n_bins <= bound"), started.where("n_bins > bound")
    if state.limit(1).count():
        state = searched(loose.select("shard", *ORDER).join(state.select("shard"), "shard"), state, number, capacity, islands, epochs, result)
    state = done.unionByName(state)

    out = ITEMS + ", shard int, bin int, fill bigint, offset bigint"

    def assign(key, pdf, states):
        full = pdf[pdf["length"] >= capacity].reset_index(drop=True)
        rest = sorted_items(pdf[pdf["length"] < capacity])
        n = 0
        if len(rest):
            best = max(states.itertuples(), key=lambda g: (-g.n_bins, g.fill, -g.island))
            rest["bin"], n = np.frombuffer(best.bins, np.int32), best.n_bins
            rest["fill"] = rest.groupby("bin")["length"].transform("sum")
            rest["offset"] = rest.groupby("bin")["length"].cumsum() - rest["length"]
        full["bin"], full["fill"], full["offset"] = np.arange(n, n + len(full), dtype=np.int32), full["length"], 0
        both = pd.concat([x for x in (rest, full) if len(x)], ignore_index=True)
        return both[[c.split()[0] for c in out.split(", ")]]

    return dealt.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(assign, out)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """All pieces of ``docs`` with their sequence and place (PLACED)."""
    made = pieces(docs, path, capacity).withColumn("no_id", F.col("doc_id").isNull())
    items = stored(made.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), "pieces")
    placed = stored(packed_round(items, items.count(), 0, capacity, islands, epochs), "packed")
    closed = placed.where(F.col("fill") >= CLOSED * capacity)
    left = placed.where(F.col("fill") < CLOSED * capacity).select(*items.columns)
    again = packed_round(left, left.count(), 1, capacity, islands, epochs)

    def sequence(df, sign):
        number = F.col("shard").cast("long") * (1 << 24) + F.col("bin")
        return df.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32",
                         (number if sign > 0 else -number - 1).alias("sequence_id"), "offset")

    return sequence(closed, 1).unionByName(sequence(again, -1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the pieces of all documents in sequences."""
    return pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
