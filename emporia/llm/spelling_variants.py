"""Operator 11: spelling variants by permuterm rotations.

Method: every word is closed with a terminator and rotated to every place.  A
rotation that skips the edited character, ``v$u`` of ``u c v``, is a prefix of
the rotations of all words that hold another character there, and the whole
rotation of the word ``u v`` that lacks it.  So the rows (prefix, character
behind it) of all words, sorted by prefix, put each group of words that differ
by one replacement side by side, and with them the one word that differs by
the missing character.  One scan over the sorted rows counts and ranks the
neighbours.  A replacement is met in one group only; an insertion into a run
of equal characters counts at the first of them only.  A group holds at most
one word for each character of the alphabet, and every member leaves it with
its number of neighbours and the best of them: no pairs are formed.

Prefixes of more than LONG code points are replaced by a hash modulo a prime
of 127 bits, with a base drawn for each run, worked out for all rotations from
prefix sums; rows of such words carry a name instead of the word, so a word of
a million letters costs a million short rows.

A word's form is its near word of largest n (ties: the smallest in code-point
order) if that n is at least ``ratio`` times its own.  n grows with every form,
so forms lead to a last one, the root; it is found by doubling the steps.

Cases: null and empty texts hold no words; texts are taken whole, long ones in
pieces cut between runs; a null id counts as the empty string where ids are
hashed; repeated rows add occurrences; runs shorter than ``least`` after the
deletion are no words; an empty table gives an empty result; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import release, ship, stored, table

# Fixed values of the contract.
LEAST, OCCURRENCES, RATIO, EVERY = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"  # the terminator: no letter
#: Code points of a prefix kept as text.
LONG = 64
PRIME = 2**127 - 1
#: Code points of a text searched at a time; distinct words a task counts before it lets go of them; words rotated at a time.
PIECE, HELD, TURNED = 1 << 22, 1 << 18, 2000


def pieces(text: str, size: int = PIECE):
    """A text in pieces of about ``size`` code points that cut no run."""
    outside, at = re.compile("[^A-Za-zÀ-ÿ]"), 0
    while at < len(text):
        gap = outside.search(text, min(len(text), at + size))
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def lowered(run: str, fold=str.maketrans(UPPER, LOWER)) -> str:
    """A-Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else run.translate(fold)


def words(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, every: int = EVERY) -> DataFrame:
    """(word, n): the distinct words of ``docs`` (doc_id, text) and their occurrences.

    Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at crc32 % length.
    """
    ship(docs.sparkSession)

    def work(batches):
        run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)  # a shorter run holds no match, a longer one is a match
        counts, read = Counter(), 0

        def out():
            held = dict(counts)
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                head = f"{'' if doc is None else doc}:".encode()
                for piece in pieces(text or ""):
                    own = Counter(map(lowered, run.findall(piece)))
                    for w in [w for w in own if zlib.crc32(head + w.encode()) % every == 0]:
                        at, n = zlib.crc32(head + w.encode()) % len(w), own.pop(w)
                        if len(w) > least:  # added below: it may equal a run that is left alone
                            counts[w[:at] + w[at + 1:]] += n
                    counts.update(own)
                    read += len(piece)
                    if len(counts) >= HELD or read >= 16 * PIECE:
                        yield out()
                        counts, read = Counter(), 0
        if counts:
            yield out()

    found = docs.select("doc_id", "text").mapInArrow(work, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


ROTATED = "key string, c string, n bigint, first boolean, name string"


def name_of(word: str, long: int = LONG) -> str:
    """The word, or for a long one a name that no word has."""
    return word if len(word) <= long else "#" + hashlib.sha256(word.encode()).hexdigest()


def long_prefixes(word: str, base: int) -> tuple[list[str], list[str]]:
    """Hashes of ``v$u`` at every cut, and with the character at the cut skipped."""
    n = len(word)
    power, sums = [1], [0]
    for c in word:
        power.append(power[-1] * base % PRIME)
        sums.append((sums[-1] * base + ord(c)) % PRIME)
    end = ord(END)

    def joined(cut, skip):  # hash of word[cut + skip:] + END + word[:cut]
        back = (sums[n] - sums[cut + skip] * power[n - cut - skip]) % PRIME
        return f"#{((back * base + end) * power[cut] + sums[cut]) % PRIME:032x}"

    return [joined(i, 0) for i in range(n + 1)], [joined(i, 1) for i in range(n)]


def rotations(vocabulary: DataFrame, base: int, long: int = LONG) -> DataFrame:
    """(key, c, n, first, name) of all rotations: c empty for whole ones, else the character that ``key`` skips.

    ``first``: the skipped character is the first of a run of equal ones.  ``name`` is given where the key is a hash.
    """
    def work(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, TURNED):
                part = batch.slice(low, TURNED)
                keys, chars, ns, firsts, names = [], [], [], [], []
                for w, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                    size = len(w)
                    whole = [w[i:] + END + w[:i] for i in range(size + 1)] if size < long else None
                    skipped = [w[i + 1:] + END + w[:i] for i in range(size)] if size <= long else None
                    if whole is None or skipped is None:
                        hashed, hashed_skipped = long_prefixes(w, base)
                    keys += whole or hashed
                    keys += skipped or hashed_skipped
                    chars += [""] * (size + 1)
                    chars += w
                    ns += [n] * (2 * size + 1)
                    firsts += [False] * (size + 1)
                    firsts += [i == 0 or w[i - 1] != c for i, c in enumerate(w)]
                    name = name_of(w, long)
                    names += [None if whole else name] * (size + 1) + [None if skipped else name] * size
                    if len(keys) >= 1 << 16:
                        yield rotated(keys, chars, ns, firsts, names)
                        keys, chars, ns, firsts, names = [], [], [], [], []
                if keys:
                    yield rotated(keys, chars, ns, firsts, names)

    def rotated(keys, chars, ns, firsts, names):
        return pa.record_batch([pa.array(keys, pa.string()), pa.array(chars, pa.string()), pa.array(ns, pa.int64()),
                                pa.array(firsts, pa.bool_()), pa.array(names, pa.string())], ["key", "c", "n", "first", "name"])

    return vocabulary.mapInArrow(work, ROTATED)


NEIGHBOURS = "name string, n_near bigint, best_n bigint, best string"


def group_rows(key: str, members: list[tuple[str, int, bool, str | None]]):
    """What every member (c, n, first, name) of a group learns: (name, neighbours, n of the best, the best)."""
    back, _, front = key.partition(END)
    whole, extended = None, []
    for c, n, first, name in members:
        if name is None:
            name = front + c + back
        if c == "":
            whole = (n, name)
        else:
            extended.append((-n, c, first, name))
    extended.sort()  # the largest n first, then by the character at hand: the words differ in nothing else
    for k, (n, c, first, name) in enumerate(extended):
        if len(extended) > 1:
            best = extended[1 if k == 0 else 0]
            yield name, len(extended) - 1, -best[0], best[3]
        if first and whole:
            yield name, 1, *whole
    if whole:
        firsts = [e for e in extended if e[2]]
        if firsts:
            yield whole[1], len(firsts), -firsts[0][0], firsts[0][3]


def scan(batches):
    """Neighbours of the members of every group; the rows come sorted by key."""
    names = ["name", "n_near", "best_n", "best"]

    def done(rows: pa.Table):
        keys = rows.column("key")
        same = pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        several = np.append(same, False) | np.append(False, same)
        rows = rows.filter(pa.array(several))
        columns = [rows.column(k).to_pylist() for k in ("key", "c", "n", "first", "name")]
        found, group, at = [], [], None
        for key, *member in zip(*columns):
            if key != at:
                if group:
                    found += group_rows(at, group)
                group, at = [], key
            group.append(tuple(member))
        if group:
            found += group_rows(at, group)
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types], names)

    open_ = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([open_, rows]) if open_ is not None else rows
        if not rows.num_rows:
            continue
        tail = pc.index(rows.column("key").combine_chunks(), rows.column("key")[-1]).as_py()  # a group has fewer rows than the alphabet
        if tail:
            yield done(rows.slice(0, tail))
        open_ = rows.slice(tail)
    if open_ is not None:
        yield done(open_)


def near_words(vocabulary: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n, n_near, best_n, best) of every word of ``vocabulary`` (word, n): its near words and the best of them."""
    ship(vocabulary.sparkSession)
    turned = rotations(vocabulary, secrets.randbelow(PRIME - 2) + 2, long)
    found = stored(turned.repartition("key").sortWithinPartitions("key").mapInArrow(scan, NEIGHBOURS), "neighbours")
    release(vocabulary.sparkSession)  # the shuffle of the rotations is the largest
    name = F.when(F.length("word") <= long, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256)))
    named = vocabulary.withColumn("name", name)
    counted = found.groupBy("name").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"))
    # Best words known by a name only are few; they get their text before the ties are settled.
    by_name = F.startswith("best", F.lit("#"))
    texts = named.where(F.length("word") > long).select(F.col("name").alias("best"), F.col("word").alias("text"))
    told = found.where(~by_name).select("name", "best_n", "best").unionByName(
        found.where(by_name).join(texts, "best").select("name", "best_n", F.col("text").alias("best")))
    best = told.groupBy("name").agg(F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select("name", F.col("b.best").alias("best"))
    return named.join(counted.join(best, "name"), "name", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best_n", "best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that (word, form) lead to; forms must not lead back."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, long: int = LONG, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text)."""
    vocabulary = stored(words(docs, **options), "vocabulary")
    known = stored(near_words(vocabulary, long), "near-words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = known.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    ends = roots(known.where(F.col("form").isNotNull()).select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 step by step over the UTF-8 bytes (from their hexadecimal digits), half a byte at a time: sixteen remainders of the public polynomial.
SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce([0, 1, 2, 3], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS r FROM range(16) x(i))
), found AS (
  SELECT doc_id, translate(w, '{UPPER}', '{LOWER}') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
), runs AS (
  SELECT doc_id, w, count(*) AS n FROM found WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
  SELECT doc_id, w, n, xor(4294967295, list_reduce(
    list_transform(range(octet_length(encode(s))), lambda k: CAST('0x' || hex(encode(s))[2 * k + 1:2 * k + 2] AS BIGINT)),
    lambda c, b: xor((xor((xor(c, b) >> 4), bits.t[(xor(c, b) & 15) + 1]) >> 4), bits.t[(xor((xor(c, b) >> 4), bits.t[(xor(c, b) & 15) + 1]) & 15) + 1]),
    CAST(4294967295 AS BIGINT))) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM runs), bits
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, left(word, i) AS u, substr(word, i + 1, 1) AS c, substr(word, i + 2) AS v, i
  FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), links AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cuts a JOIN cuts b ON a.u = b.u AND a.v = b.v AND a.c <> b.c
  UNION SELECT cuts.word, w.word, w.n FROM cuts JOIN words w ON w.word = u || v
  UNION SELECT w.word, cuts.word, cuts.n FROM cuts JOIN words w ON w.word = u || v
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM links GROUP BY word
), known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN m END AS form_n,
         CASE WHEN m >= 10 * w.n THEN (SELECT min(near) FROM links l WHERE l.word = w.word AND l.m = best.m) END AS form
  FROM words w LEFT JOIN best USING (word)
), r AS (
  SELECT word, word AS root, 0 AS steps FROM known
  UNION ALL
  SELECT r.word, k.form, r.steps + 1 FROM r JOIN known k ON k.word = r.root WHERE k.form IS NOT NULL
)
SELECT word, form, e.root, n, n_near, form_n FROM known JOIN (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY word) e USING (word)
"""
