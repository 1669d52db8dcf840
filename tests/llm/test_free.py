"""Operators 2, 3, 4, 5, 6, 8 and 9: fixtures against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from emporia.llm import best_fit_packing, byte_bpe, components, embedding_dedup, fingerprints, ngram_join, quality_resampling, warc_bundles

DOCS = "doc_id bigint, text string, ids string, n int"


def public(name):
    return pytest.importorskip("public_tokenizers").path(name)


# -- components


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 2: WARC


def pages(spark):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/\r\n1", long, 1), (3, "http://b", long, 2), (9, None, long, 3), (1, "u", None, 4), (2, "u", "", 5), (4, "u", "short", 6),
            (6, "u", "short", 7), (7, "é", "é" * 60, 8), (8, "u", "é" * 60, 9), (3, "http://b", long, 10), (None, "u", "y" * 300, 11),
            (10, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20, 12), (11, "u", "z" * 3_000_000, 13)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, frame int")


def test_warc_round_trip(spark):
    df = pages(spark)
    index = warc_bundles.archive(df, frame_bytes=500)
    rows = df.collect()
    got = warc_bundles.read_bundles(index).collect()
    want = []
    for r in rows:
        data = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        again = len(data) >= 100 and r.page_id is not None and r.page_id != min(same)
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted(map(repr, ((g.record_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got))) == sorted(map(repr, want))
    assert {(g.record_id, bytes(g.payload)) for g in got if g.record_type == "response"} == {
        (r.page_id, (r.html or "").encode()) for r, w in zip(rows, want) if w[3] == "response"}


def test_warc_random_access_and_seek_table(spark):
    index = warc_bundles.archive(pages(spark), frame_bytes=300)
    found = {r.record_id: bytes(r.payload) for r in warc_bundles.read_records(index.where("record_id IN (4, 7, 11)")).collect()}
    assert found == {4: b"short", 7: ("é" * 60).encode(), 11: b"z" * 3_000_000}
    name = index.first()["file"]
    reader = warc_bundles.BundleReader(name)
    fs, path = warc_bundles.file_system(name)
    import zstandard

    whole = b"".join(reader.frame(i) for i in range(len(reader.sizes)))
    stream = zstandard.ZstdDecompressor().stream_reader(fs.open_input_file(path), read_across_frames=True)  # any reader skips the table
    assert stream.read() == whole and len(reader.sizes) > 1
    assert warc_bundles.read_bundles(warc_bundles.archive(pages(spark).limit(0))).count() == 0


def test_warc_reads_a_file_a_task(spark):
    index = warc_bundles.archive(pages(spark).repartition(4), file_bytes=1, frame_bytes=100)
    files = index.select("file").distinct().count()
    got = warc_bundles.read_bundles(index)
    assert files > 4 and got.rdd.getNumPartitions() == files
    spread = got.selectExpr("spark_partition_id() AS p", "record_id").distinct().groupBy("p").count().count()
    assert spread == files and got.count() == 13


# -- 3: embeddings


def brute_vectors(rows, threshold=0.95):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.asarray(v, float)
    ids = sorted(usable)
    near = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            if i < j and len(usable[i]) == len(usable[j]):
                if usable[i] @ usable[j] / (np.sqrt(usable[i] @ usable[i]) * np.sqrt(usable[j] @ usable[j])) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += near[x]
    return {i: (len(near.get(i, ())), comp.get(i, i)) for i, _ in rows if i is not None}


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.25, size=24) * (i % 5)).tolist()) for i in range(300)]
    rows += [(400 + k, rows[0][1]) for k in range(30)]  # equal vectors
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] + [1.0] * 23), (504, [float("inf")] + [1.0] * 23),
             (505, [None] + [1.0] * 23), (506, (2.0 * np.array(rows[1][1])).tolist()), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [-0.0, 1.0]), (510, [0.0, 1.0])]
    rows += [(k, rows[k][1]) for k in (3, 4)]  # repeated rows
    return rows


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, v string")
    want = brute_vectors(rows)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)  # many tiles and blocks
    monkeypatch.setattr(embedding_dedup, "SQUARE", 5)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == want


def test_embedding_empty_and_float(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id bigint, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_scales_do_not_matter(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 20))
    rows = [(10 * k + e, (base[k] + rng.normal(scale=0.02, size=20)) * scale) for k in range(6) for e, scale in enumerate((1.0, 1e200, 1e-200, 1e307))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (3, i - i % 10) for i, _ in rows}
    exact = rng.normal(size=(50, 20))
    assert (embedding_dedup.scaled(exact * 2.0 ** 900) == embedding_dedup.scaled(exact)).all()


def test_embedding_classes_are_128_bits(spark):
    df = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(10)], "vec_id bigint, embedding array<double>")
    names = [bytes(r["class"]) for r in embedding_dedup.with_class(df).collect()]
    assert {len(x) for x in names} == {16} and len({x[:8] for x in names}) == len({x[8:] for x in names}) == 5
    assert all(x[:8] != x[8:] for x in names)


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_squares_with_many_survivors(spread):
    rng = np.random.default_rng(2)
    a = embedding_dedup.unit(rng.normal(size=64) + rng.normal(scale=spread, size=(150, 64)))
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(a @ a.T >= 0.95, 1)))))
    i, j = embedding_dedup.tile_links(a, a, 0.95, True)
    assert want <= set(zip(i.tolist(), j.tolist()))
    i, j = embedding_dedup.verified(a, i, j, 0.95)
    assert want == set(zip(i.tolist(), j.tolist()))
    nodes, roots = embedding_dedup.forest(i, j)
    assert (roots < nodes).all() and set(nodes.tolist()) | set(roots.tolist()) == {x for p in want for x in p}


def test_tiles_stop_early_but_lose_nothing():
    rng = np.random.default_rng(1)
    a = embedding_dedup.unit(rng.normal(size=(200, 64)) * np.linspace(3, 0.1, 64))
    b = np.concatenate([a[:20] + rng.normal(scale=0.01, size=(20, 64)), rng.normal(size=(150, 64))])
    b = embedding_dedup.unit(b)
    i, j = embedding_dedup.tile_links(a, b, 0.95, False)
    want = set(zip(*np.nonzero(a @ b.T >= 0.95)))
    assert want <= set(zip(i.tolist(), j.tolist())) and len(want) >= 15


# -- 4: byte-level BPE


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = public("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    assert ranks == byte_bpe.load_ranks(public("byte_bpe_50k.json"))
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    parts = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "!", "　", "😀", "ve", "don't", "日本", "\x85", "\r\n", "word", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "a" * 3000, " " * 2000 + "x", "x" * 70, "the quick brown fox " * 20_000, texts[0]]
    df = spark.createDataFrame([(i, t, "mine", i) for i, t in enumerate(texts)], DOCS)
    rows = byte_bpe.decode(byte_bpe.encode(df, path), path).collect()
    assert len(rows) == len(texts) and all(r.n == r.doc_id for r in rows)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = byte_bpe.unpacked(r.ids)
        assert ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        starts = byte_bpe.unpacked(r.starts)
        for k in rng.sample(range(len(ids)), min(3, len(ids))):
            token = enc.decode_single_token_bytes(ids[k])
            assert text.encode()[starts[k]:starts[k] + len(token)] == token
    assert byte_bpe.encode(df.limit(0), path).count() == 0


def test_bpe_windows_do_not_matter(monkeypatch):
    enc = byte_bpe.Encoder(byte_bpe.load_ranks(public("byte_bpe_50k.tiktoken")))
    rng = random.Random(8)
    text = "".join(rng.choice(["a", " ", "\n", "'ll", "é", "1", "...", "  ", "'s"]) for _ in range(5000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = enc.slices.starts(data, offsets).tolist()
    monkeypatch.setattr(byte_bpe, "WINDOW", 97)
    assert enc.slices.starts(data, offsets).tolist() == whole


# -- 5: n-gram join


def brute_sets(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate(fold)) if w]
        sets[i] = frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    hot = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(hot + [word() for _ in range(rng.choice([2, 5, 10, 100]))])) for k in range(40)]  # a common passage
    n = len(rows)
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \n\t"), (n + 4, "one two"), (n + 5, "One\x0btwo"), (n + 6, "a b c d e"), (n + 7, "A B C D E"),
             (n + 8, "b a a b b a a b a b " * 30), (n + 9, "x " * 20_000), (0, rows[0][1]), (n + 10, "  \u0085"), (n + 11, "É é É é É")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_equals_brute_force(spark, monkeypatch, small):
    if small:  # many stretches, buckets, hot and frequent tokens and blocks
        for name, value in dict(FLUSH_TOKENS=2000, BUCKET=1 << 11, HOT_FROM=20, FREQUENT=6, BLOCK=8, TASK_ROWS=50, STARS=1).items():
            monkeypatch.setattr(ngram_join, name, value)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, key string, class int")
    got = ngram_join.join(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_sets(rows)


def test_stretches_end_before_their_numbers_do(spark):
    """More short texts than 16 bits number, in one partition and in batches that stop short of FLUSH_DOCS."""
    n = 70_000
    texts = [f"{i % 35_000} short" for i in range(n)] + ["A  b"] + [f"word {i}" for i in range(n)] + ["a b"]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.record_batch([ids, pa.array(texts), ids], ["doc_id", "text", "row_hash"])
    for cut in (len(texts), 59_999, 10_000):
        seen = []
        for ids, sizes, of, tokens, ends, own in ngram_join.stretches((batch.slice(at, cut) for at in range(0, len(texts), cut)), True):
            assert len(own) <= 1 << 16 and len(ids) == len(sizes) == len(of) and len(ends) == len(own) + 1 and ends[-1] == len(tokens)
            seen += ids
        assert seen == [(i, i) for i in range(len(texts))]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:  # texts of one word pair; equal ones (after folding) are one component, all others are alone
        spark.conf.set(setting, "100000")
        rows = [(i, f"x{i} y") for i in range(n)] + [(n + i, f"X{i * 7_000}\tY") for i in range(10)]
        path = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).coalesce(1)
        got = {r.doc_id: r.component_id for r in ngram_join.join(path).collect()}
    finally:
        spark.conf.set(setting, before)
    assert got == {i: i for i in range(n)} | {n + i: i * 7_000 for i in range(10)}


def test_index_keys_meet_for_every_link(monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        every = np.unique(rng.integers(1, 1 << 40, 2 * n + 20).astype(np.uint64))
        rng.shuffle(every)
        freq = {int(t): int(rng.choice([2, 3, 4, 9])) for t in every}
        a = set(every[:n].tolist())
        b = set(a)
        while True:
            c = set(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.discard(int(rng.choice(sorted(c))))
            else:
                c.add(int(rng.choice(every)))
            if not ngram_join.links(len(a), len(c), len(a & c)):
                break
            b = c
            if rng.random() < 0.05:
                break
        keys = [set(ngram_join.index_keys(len(s), np.array(sorted(s), np.uint64), np.array([freq[t] for t in sorted(s)], np.uint32)).tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for n in (10, 600, 3000):
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        b = np.append(a[n // 10:], rng.integers(0, 1 << 60, n // 8).astype(np.uint64))
        w = ngram_join.sketch_words(n)
        sa, sb = (ngram_join.sketch(x, 4 * w)[None, :] for x in (a, b))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert (ngram_join.folded(sa, w) == ngram_join.sketch(a, w)).all()
        assert int(np.bitwise_count(sa ^ sb).sum()) <= apart
        assert int(np.bitwise_count(ngram_join.folded(sa, w) ^ ngram_join.folded(sb, w)).sum()) <= apart


def test_ngram_stage_and_empty(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, root string, class int")
    out = ngram_join.stage(spark, df, "")
    assert out.columns == df.columns
    want = brute_sets(rows)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert ngram_join.join(df.limit(0)).count() == 0


# -- 6: fingerprints


def walk(text):
    """A walk, step by step, and its fingerprint."""
    classes, nibbles = fingerprints.of_points()
    steps, at, out = fingerprints.walk_steps(len(text)), 0, []
    for j in range(steps):
        if j % fingerprints.LAP == 0:
            moves = fingerprints.random_moves(j // fingerprints.LAP)
        out.append(int(nibbles[ord(text[at])]) if at < len(text) else None)
        at += int(moves[j % fingerprints.LAP][classes[ord(text[at])]]) if at < len(text) else 0
    made = f"{len(text):08x}"
    for k in range(fingerprints.octaves(steps)):
        for s in fingerprints.sample_steps(k):
            value = out[s] if s < steps else None
            made += "0123456789abcdef"[value if value is not None else int(fingerprints.mix(np.array([s], np.uint64))[0] & np.uint64(15))]
    return made


def test_fingerprints_equal_single_walks():
    rng = random.Random(3)
    texts = ["", "a", "é😀", "ab" * 40] + ["".join(rng.choice("abc d😀") for _ in range(rng.randint(1, 3000))) for _ in range(20)]
    assert fingerprints.fingerprints(texts) == [walk(t) for t in texts]


def test_short_fingerprints_tell_texts_apart():
    nibbles = fingerprints.of_points()[1]
    rng = random.Random(8)
    letters = {int(nibbles[ord(c)]): c for c in "abcdefghijklmnopqrstuvwxyz"}  # one a digit: unequal letters are told apart
    texts = [("hello", "world"), ("a", "b" if nibbles[ord("a")] != nibbles[ord("b")] else "c")]
    for n in range(1, 11):
        for _ in range(60):
            a, b = ("".join(rng.choice(list(letters.values())) for _ in range(n)) for _ in range(2))
            texts += [(a, b)] if a != b else []
    told = [fingerprints.likeness(*fingerprints.fingerprints([a, b])) for a, b in texts]
    # A walk that stays often may not reach the last characters; the first one is always written.
    assert not [t for t, x in zip(texts, told) if x == 1.0 and t[0][0] != t[1][0]]
    assert np.mean([x == 1.0 for x in told]) < 0.02
    assert np.mean(told[-60:]) < 0.4
    for text in ("hello", "a b", "0123456789"):  # all steps are written
        assert fingerprints.fingerprints([text])[0] == walk(text)
        assert list(fingerprints.sample_steps(0)) == list(range(fingerprints.FIRST))


def test_fingerprint_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "x", "same text here", "same text here"] + ["".join(rng.choice("abcdef ghi") for _ in range(rng.randint(5, 900))) for _ in range(60)]
    ids = rng.sample(range(10_000), len(texts))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    order = sorted(zip(ids, [t or "" for t in texts]))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        fp, fe, fn = fingerprints.fingerprints([t, changed, after])
        assert (r.fingerprint, r.edited_fingerprint) == (fp, fe)
        assert r.near_edited == fingerprints.likeness(fp, fe) and r.near_next == fingerprints.likeness(fp, fn)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in got.values() if r.n_chars > 50]) > 0.9


def test_fingerprint_one_document_repeats_and_none(spark, tmp_path):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string")
    r = fingerprints.compared_with_next(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and r.near_next == 1.0
    assert fingerprints.compared_with_next(one.limit(0)).count() == 0
    rows = fingerprints.compared_with_next(one.union(one).union(spark.createDataFrame([(None, "zz")], one.schema))).collect()
    assert len(rows) == 3 and sorted(x.n_chars for x in rows) == [2, 8, 8]


def test_similar_documents(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij klmn") for _ in range(1500)) for _ in range(8)]
    texts = base + [b[:700] + "X" + b[701:] for b in base] + base[:2] + ["", None, ""]
    names = "doc_id bigint, text string, root string, band int, node int, least int, fa string"
    df = fingerprints.with_fingerprint(spark.createDataFrame([(i, t, "r", 1, 2, 3, "x") for i, t in enumerate(texts)] + [(None, base[3], "r", 1, 2, 3, "x")], names))
    got = {r.doc_id: r.component_id for r in fingerprints.similar_documents(df, least=0.6).collect()}
    assert got[16] == 0 and got[17] == 1 and got[None] == 3  # equal texts
    assert (got[18], got[19], got[20]) == (18, 18, 18)  # empty ones
    assert all(got[8 + k] == k for k in range(8))
    assert len({got[k] for k in range(8)}) == 8
    assert fingerprints.similar_documents(df.limit(0)).count() == 0


def test_likeness_side_by_side():
    rng = random.Random(2)
    base = "".join(rng.choice("abc de") for _ in range(900))
    texts = ["", "", "a", "hello", base, base[:450], base[:300] + "zz" + base[300:], base * 3, base[:60]]
    prints = fingerprints.fingerprints(texts)
    n, digits = fingerprints.parsed(prints)
    for i in range(len(texts)):
        js = np.array([j for j in range(len(texts)) if j != i])
        assert fingerprints.likeness_to(i, js, n, digits).tolist() == [fingerprints.likeness(prints[i], prints[j]) for j in js]


def test_band_keys_hold_their_digits():
    prints = fingerprints.fingerprints(["", "a", "short one", "x" * 500, "ab " * 4000])
    rows, keys = fingerprints.band_keys(prints)
    assert np.bincount(rows, minlength=5).tolist() == [0] + [fingerprints.BANDS] * 2 + [2 * fingerprints.BANDS] * 2
    for row, key in zip(rows.tolist(), keys.tolist()):
        size, band = divmod(key >> 4 * fingerprints.DIGITS, fingerprints.BANDS)
        want = "".join(prints[row][8 + p] for p in fingerprints.band_places(size, band))
        assert f"{key & (1 << 4 * fingerprints.DIGITS) - 1:0{fingerprints.DIGITS}x}" == want


def test_template_family_has_recall(spark):
    """Texts about three quarters alike, with near copies among them: links that the hub of a bucket does not see."""
    rng = random.Random(5)
    alphabet = "abcdefghijklmnop "
    template = [rng.choice(alphabet) for _ in range(400)]

    def changed(chars, share):
        return [rng.choice(alphabet) if rng.random() < share else c for c in chars]

    texts = []
    for _ in range(500):
        own = changed(template, 0.22)
        texts += ["".join(own), "".join(changed(own, 0.02))]
    prints = fingerprints.fingerprints(texts)
    n, digits = fingerprints.parsed(prints)
    links = [(i, j) for i in range(len(texts)) for j in (i + 1 + np.flatnonzero(fingerprints.likeness_to(i, np.arange(i + 1, len(texts)), n, digits) >= 0.8)).tolist()
             if i + 1 < len(texts)]
    assert len(links) > 250
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id bigint, fingerprint string")
    for block in (512, 16):
        got = {r.doc_id: r.component_id for r in fingerprints.similar_documents(df, 0.8, block).collect()}
        assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    # No link is made up: components are those of a subset of the brute-force links.
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert all(find(i) == find(c) for i, c in got.items())


# -- 8: packing


def test_packing_pieces_and_places(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    path = public("byte_bpe_50k.json")
    rng = random.Random(11)
    texts = [None, "", "one"] + [" ".join(rng.choice(["the", "of", "über", "1234", "x"]) for _ in range(rng.randint(1, 900))) for _ in range(120)] + ["word " * 5000, "word " * 2047]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (2**60 + 1, "a large id")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, shard string, length int")
    done = best_fit_packing.pack(df, path).collect()
    got = pd.DataFrame([r.asDict() for r in done], dtype=object).astype({"length": int, "offset": int, "sequence_id": int})
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        sizes = ([len(ids) % 2048] if len(ids) % 2048 else []) + [2048] * (len(ids) // 2048)
        at = 0
        for k, size in enumerate(sizes):
            want.append((i, k, at, size, zlib.crc32(ids[at:at + size].tobytes())))
            at += size
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in done), key=repr) == sorted(want, key=repr)
    bins = got.sort_values(["sequence_id", "offset"])
    assert (bins.groupby("sequence_id").length.cumsum() - bins.length == bins.offset).all()
    assert bins.groupby("sequence_id").length.sum().max() <= 2048
    assert bins.sequence_id.nunique() <= -(-bins.length.sum() // 2048) + 1
    assert best_fit_packing.pack(df.limit(0), path).count() == 0


def test_no_id_decides_the_size_of_a_shard(spark):
    n = 10 * best_fit_packing.SHARD
    items = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 0 END AS doc_id", "0 AS piece")
    sizes = [r["count"] for r in best_fit_packing.sharded(items, n, 0).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == n and max(sizes) < 1.2 * best_fit_packing.SHARD


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 2048) for _ in range(300)), reverse=True)
    a, b = best_fit_packing.Packing(lengths, 2048), best_fit_packing.Packing(lengths, 2048)
    a.best_fit(range(300))
    b.best_fit(rng.sample(range(300), 300))
    child = best_fit_packing.mutated(best_fit_packing.crossover(a, b, rng), rng)
    assert sorted(i for x in child.bins for i in x) == list(range(300))
    assert all(sum(lengths[i] for i in x) + f == 2048 and f >= 0 for x, f in zip(child.bins, child.free))
    best = best_fit_packing.evolve(lengths, 2048, 1, best_fit_packing.unflat(best_fit_packing.flat(b)))
    assert len(best.bins) <= min(len(a.bins), len(b.bins))


def hard_lengths(seed, bins, capacity=200):
    """Lengths that fill ``bins`` bins exactly, three to a bin: best fit needs more."""
    rng, lengths = random.Random(seed), []
    for _ in range(bins):
        x = rng.randint(40, 90)
        y = rng.randint(40, min(90, capacity - x - 30))
        lengths += [x, y, capacity - x - y]
    return sorted(lengths, reverse=True)


def fewest_bins(lengths, capacity):
    """Brute force: branch over the bins of every piece."""
    best = [len(lengths)]

    def place(k, free):
        if len(free) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(free)
            return
        for r in {r for r in free if r >= lengths[k]}:
            i = free.index(r)
            place(k + 1, free[:i] + [r - lengths[k]] + free[i + 1:])
        place(k + 1, free + [capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_the_search_beats_its_start_and_reaches_the_optimum():
    started = evolved = 0
    for seed in range(20):
        lengths = hard_lengths(seed, 8 + seed)
        start = best_fit_packing.Packing(lengths, 200)
        start.best_fit(range(len(lengths)))
        best = best_fit_packing.evolve(lengths, 200, seed, children=200)
        assert sorted(i for x in best.bins for i in x) == list(range(len(lengths))) and all(f >= 0 for f in best.free)
        assert all(sum(lengths[i] for i in x) + f == 200 for x, f in zip(best.bins, best.free))
        started, evolved = started + len(start.bins), evolved + len(best.bins)
    optimum = sum(8 + seed for seed in range(20))
    assert started > optimum + 20 and evolved <= started - 8
    for seed in range(12):
        rng = random.Random(seed)
        lengths = sorted(([rng.randint(20, 120) for _ in range(9)] if seed % 2 else hard_lengths(seed, 3)), reverse=True)
        assert len(best_fit_packing.evolve(lengths, 200, seed, children=40).bins) == fewest_bins(lengths, 200)


def test_shards_are_searched_only_where_best_fit_is_not_optimal(spark, monkeypatch):
    monkeypatch.setattr(best_fit_packing, "SHARD", 10_000)
    hard, easy = hard_lengths(3, 20), [100] * 40
    for lengths in (hard, easy):
        rows = [(i, 0, 0, n, i, False) for i, n in enumerate(lengths)]
        items = spark.createDataFrame(rows, best_fit_packing.ITEMS)
        calls = []
        real = best_fit_packing.searched
        monkeypatch.setattr(best_fit_packing, "searched", lambda *a: calls.append(1) or real(*a))
        out = best_fit_packing.packed_round(items, len(rows), 0, 200, 2, 2).collect()
        monkeypatch.setattr(best_fit_packing, "searched", real)
        assert sorted(r.doc_id for r in out) == list(range(len(rows))) and bool(calls) == (lengths is hard)
        start = best_fit_packing.Packing(sorted(lengths, reverse=True), 200)
        start.best_fit(range(len(lengths)))
        assert len({r.bin for r in out}) <= len(start.bins) if lengths is hard else len({r.bin for r in out}) == 20


# -- 9: quality


def quality_tables(spark):
    rng = random.Random(7)
    words = [("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8)))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        good = i % 6 != 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(good), "x"))
    rows += [(1000, None), (1001, ""), (3, rows[3][1])]
    return (spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, kept string, log_weight int"),
            spark.createDataFrame(labels + [(None, 1, "x"), (7, None, "x"), (99999, 0, "x")], "doc_id bigint, quality int, text string"))


def test_quality_held_out_accuracy_and_top_k(spark):
    docs, labels = quality_tables(spark)
    rows = {r.doc_id: r for r in quality_resampling.resample(docs.select("doc_id", "text"), labels).collect()}
    labelled = {r.doc_id for r in labels.collect()}
    held = [i for i in range(600) if i not in labelled]
    right = [rows[i].kept == (i % 6 != 0) for i in held]
    assert len(held) > 100 and np.mean(right) > 0.98
    assert rows[1000].log_weight == 0 and rows[1001].n_features == 0
    least = min(r.gumbel_key for r in rows.values() if r.kept)
    assert all(r.kept == (r.gumbel_key >= least) for r in rows.values())


def test_quality_model_equals_counts(spark):
    docs, labels = quality_tables(spark)
    sample = quality_resampling.label_sample(labels)
    got = quality_resampling.counts(docs.select("doc_id", "text"), sample)
    target = {r.label_id for r in sample.where("fold = 0 AND good").collect()}
    want = np.zeros_like(got)
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        bucket, _ = quality_resampling.features(data, np.array([0, len(data)]))
        np.add.at(want[0], bucket, 1)
        if r.doc_id in target:
            np.add.at(want[1], bucket, 1)
    assert (got == want).all()


def test_quality_stage_and_cases(spark, tmp_path):
    docs, labels = quality_tables(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = quality_resampling.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and 490 <= out.count() <= 515
    assert quality_resampling.resample(docs.select("doc_id", "text"), labels.limit(0)).where("kept").count() == docs.count()
    assert quality_resampling.resample(docs.select("doc_id", "text").limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(0, 5), 2) for _ in range(3000)] + [1.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 700, 1500, 3500):
        assert quality_resampling.kth_largest(df, "x", k, bins=16, few=50) == sorted(values, reverse=True)[k - 1]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The stages one after another, each against a brute-force version on what came before."""
    import corpus_pipeline
    from tests.llm.test_native import base_spans, brute_lines

    path = public("byte_bpe_50k.json")
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7)))
    line = "This licence line stands in a good many of the documents here."
    rows, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randint(30, 90)))
        if i % 4 == 0:
            text = line + "\n" + text
        if i % 9 == 0 and i:
            text = rows[i - 1][1] + " more"
        if i % 11 == 0:
            text += "\npassword: hunter2" + "x" * (i % 7)
        good = i % 8 != 0
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", "src", len(text)))
        if i % 3:
            labels.append((i, int(good), 0))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    verdict = quality_resampling.query(spark, d).where("kept").collect()
    kept = {r.doc_id for r in verdict}
    now = [(i, t) for i, t, *_ in rows if i in kept]
    now = [(i, t) for i, _, _, t in brute_lines(now)]
    sets = brute_sets(now)
    now = [(i, t) for i, t in now if sets[i][1] == i]
    final = []
    for i, t in now:
        out, at = "", 0
        for a, _, b in base_spans(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        final.append((i, out + t[at:]))
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    tok = Tokenizer.from_file(path)
    want = sorted((i, zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in final)
    got = corpus_pipeline.run(spark, d)
    assert sorted((r.doc_id, r.ids_crc32) for r in got.collect()) == want
    assert 150 < len(want) < 240


# -- texts that collide under a polynomial hash modulo 2^64


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_hashes_tell_thue_morse_words_apart(spark):
    from emporia.llm.arrays import seeded_hashes

    texts = [w for n in (1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n, "b", "a"))]
    tiktoken = pytest.importorskip("tiktoken")
    path = public("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=pytest.importorskip("public_tokenizers").PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for r in byte_bpe.decode(byte_bpe.encode(df, path), path).collect():
        assert byte_bpe.unpacked(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
    spaced = spark.createDataFrame([(i, " ".join([w] * 7 + [f"end{i // 2}"])) for i, w in enumerate(texts)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(spaced).collect()} == {i: i for i in range(len(texts))}
    rng = np.random.default_rng(1)
    data = np.frombuffer(("".join(texts) + "x" * 70).encode(), np.uint8)
    starts = rng.integers(0, len(data) - 100, 5000)
    ends = starts + rng.integers(0, 90, 5000)
    h = seeded_hashes(data, starts, ends, [3, 2**64 - 1])
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    for lane in h:
        assert len({(w, x) for w, x in zip(words, lane.tolist())}) == len(set(words)) == len(set(lane.tolist()))


def test_cache_starts_again_if_one_hash_agrees():
    """Slices that share the first hash only: the encoder draws other seeds."""
    enc = byte_bpe.Encoder(byte_bpe.load_ranks(public("byte_bpe_50k.tiktoken")))
    real, calls = byte_bpe.seeded_hashes, []

    def weak(data, starts, ends, seeds):
        h = real(data, starts, ends, seeds)
        calls.append(seeds)
        if len(calls) == 1:
            h[0] = 7
        return h

    byte_bpe.seeded_hashes = weak
    try:
        data = np.frombuffer(b"one two three", np.uint8)
        ids, _, _ = enc.encode(data, np.array([0, len(data)]))
    finally:
        byte_bpe.seeded_hashes = real
    plain = byte_bpe.Encoder(byte_bpe.load_ranks(public("byte_bpe_50k.tiktoken")))
    assert len(calls) == 2 and ids.tolist() == plain.encode(data, np.array([0, len(data)]))[0].tolist()


def test_ngram_stage_keeps_clean_rows_of_dropped_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, a), (3, c), (3, c), (3, c.upper()), (None, " "), (None, None), (5, ""), (5, ""), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame([(i, t, k, 1) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row_hash int, root int")
    out = ngram_join.stage(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert [t.lower() for i, t in got if i == 3] == [c] and (1, a) in got and (2, b) in got and (2, a) not in got and (None, a) not in got
    assert sorted(map(repr, (g for g in got if g[0] != 3))) == sorted(map(repr, [(1, a), (2, b), (None, " "), (None, None), (5, ""), (5, ""), (None, "only here")]))


def test_ngram_join_with_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 1 << 9)
    monkeypatch.setattr(ngram_join, "BUCKETS", 4)  # every bucket is cut
    rows = near_rows()
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_sets(rows)


def near_group(n):
    """Classes of one group of near copies, most pairs of which link, and of loners with half its tokens: (class, n, tokens)."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    sets = {}
    for i in range(n + n // 4):
        keep = base[rng.random(len(base)) < (0.92 if i < n else 0.6)]
        own = rng.integers(1, 1 << 62, 3 if i < n else 90).astype(np.uint64)
        sets[i.to_bytes(16, "big")] = (np.unique(np.concatenate([keep, own])), keep)
    return sets


@pytest.mark.parametrize("block", [2048, 16])
def test_open_pairs_of_a_group_grow_with_its_members(spark, monkeypatch, block):
    """All pairs of the group link; what is told joins it with fewer pairs than members, not with a pair for each two."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets, n = near_group(80), 80
    found = spark.createDataFrame([(c, len(all_), bytearray(kept.tobytes())) for c, (all_, kept) in sets.items()], "class binary, n int, tokens binary")
    lists = spark.createDataFrame([(k, c, c, len(sets[c][1]) * 8) for c in sets for k in (1, 2)], "key bigint, class binary, root binary, bytes bigint")
    pairs = {(bytes(r.a), bytes(r.b)) for r in ngram_join.open_pairs(lists, found).collect()}
    near = set()
    for a in sets:
        near |= {(a, b) for b in sets if a < b and ngram_join.links(len(sets[a][0]), len(sets[b][0]), len(np.intersect1d(sets[a][1], sets[b][1])))}
    assert len(near) > 20 * n

    def component(edges):
        of = {c: c for c in sets}
        for a, b in edges:
            low, high = sorted((of[a], of[b]))
            of = {c: low if r == high else r for c, r in of.items()}
        return of

    assert component(pairs) == component(near)
    assert len(pairs) < len(sets) * (1 if block > n else 4)  # a task may join what another one has joined


def test_classifier_makes_ngrams_of_few_bytes_at_a_time(spark):
    """A batch of many texts is cut before its n-grams are made, and the pipeline's stage sends each text to Python once."""
    import tracemalloc

    texts = ["some words of text " * 100] * 4000
    batch = pa.record_batch([pa.array(texts)], ["text"])
    whole = sum(map(len, texts))
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part, _, _ in quality_resampling.parts([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and whole > 7_000_000
    assert peak < 40_000_000


def test_classifier_stage_sends_a_text_once(spark, monkeypatch, tmp_path):
    seen = []
    resample = quality_resampling.resample
    monkeypatch.setattr(quality_resampling, "resample", lambda docs, labels: (seen.append(docs.schema), resample(docs, labels))[1])
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a", 7, "é"), (2, None, 8, "x")], "doc_id bigint, text string, n_features int, `odd.na``me` string")
    out = quality_resampling.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    assert sum(f.simpleString().count("text:string") for f in seen[0].fields) == 1


# -- memory, files and disk that a job holds


def test_fingerprint_components_let_their_tables_go(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(6)]
    rows = [(10 * i + k, t[:-3 * k - 1] + "x" * k) for i, t in enumerate(texts) for k in range(4)]
    prints = fingerprints.with_fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string"))
    real, made, freed = fingerprints.stored, [], []
    monkeypatch.setattr(fingerprints, "stored", lambda df, name: made.append((name, out := real(df, name))) or out)
    monkeypatch.setattr(fingerprints, "release", lambda session: freed.append(made[-1][0]))
    got = fingerprints.components_by_fingerprint(prints.select("doc_id", "fingerprint"), 0.6)
    assert got.select("component_id").distinct().count() == 6
    names = {n for n, _ in made}
    left = {n for n, df in made if os.path.exists(df._emporia_path.removeprefix("file:"))}
    assert {"bands", "shared-bands", "band-lists", "band-hubs", "band-members", "band-roots", "open-bands", "band-blocks"} == names - left
    assert {"bands", "shared-bands", "band-lists", "star-links", "band-blocks", "more-links"} <= set(freed)


def test_bpe_looks_up_new_pairs_only(monkeypatch):
    """A merge asks for the ranks of the two pairs it makes, not for all pairs of the word again."""
    ranks = byte_bpe.load_ranks(public("byte_bpe_50k.tiktoken"))
    merger, real, asked = byte_bpe.Merger(ranks), byte_bpe.Merger.pair_ranks, []
    monkeypatch.setattr(byte_bpe.Merger, "pair_ranks", lambda self, a, b: asked.append(len(a)) or real(self, a, b))
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 64))).encode() for _ in range(300)] + ["é漢🙂".encode(), b"a" * 64, b"x"]
    counts = np.array([len(w) for w in words])
    ids, made = merger.merge_all(np.frombuffer(b"".join(words), np.uint8), counts)
    assert sum(asked) <= counts.sum() + 2 * (counts.sum() - len(ids))
    cut = np.append(0, np.cumsum(made)).tolist()
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [merger.merge_long(w) for w in words]
    assert [x.tolist() for x in merger.merge_all(np.empty(0, np.uint8), np.empty(0, np.int64))] == [[], []]


def test_bpe_follows_long_runs_over_blocks():
    """Texts whose blocks hold no space: their states are followed block by block, as one character after the other."""
    rng = random.Random(5)
    symbols = np.array([rng.choice([byte_bpe.LETTER] * 8 + [byte_bpe.NUMBER, byte_bpe.OTHER, byte_bpe.SHORT, byte_bpe.LONGER, byte_bpe.WHITE]) for _ in range(4000)], np.uint8)
    symbols[[500, 2900, 2901]] = byte_bpe.SPACE
    for first in range(8):
        state, flags = first, []
        for c in symbols.tolist():
            flags.append(int(byte_bpe.BEGINS[8 * c + state]))
            state = int(byte_bpe.FOLLOW[8 * c + state])
        got, after = byte_bpe.scan(symbols, first)
        assert got.tolist() == flags and after == state


def test_components_write_few_files(spark, monkeypatch):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in conf}
    real, files = components.stored, []

    def counted(df, name):
        out = real(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(components, "stored", counted)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 7) for i in range(400)], "a int, b int")
        got = {r.node: r.root for r in components.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i % 7 for i in range(7, 407)}
    assert len(files) > 4 and all(n == 1 for name, n in files if name != "edges")


def test_frugal_work_gives_memory_back(monkeypatch):
    from emporia.llm import scratch

    calls = []
    monkeypatch.setattr(scratch, "give_back", lambda: calls.append(1))
    assert list(scratch.frugal(lambda batches: (2 * b for b in batches))([1, 2, 3])) == [2, 4, 6] and calls == [1]
