"""The training-data operators against brute force, exact round trips and held-out accuracy, with the odd cases of each."""

import collections
import functools
import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from pelorus.llm import exact_dedup, fingerprints, html_extract, language_id, packing, piece_lattice, queries, secret_scan, simhash, simhash_similar, spans, substring_dedup, token_counts
from pelorus.llm.common import Scratch, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from it today"),
    (2, "the Quick brown fox jumps over the lazy dog and runs far away from it today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "The quick brown fox jumps over the lazy dog and runs far away from it today"),
    (6, "The quick brown fox jumps over the lazy dog and runs far away from it today"),
    (None, "a row without an id é 日本 😀"),
    (8, "one two"),
    (9, "Σ'S don't I'll x'" + "y" * 3000),
    (10, "word " * 4000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "salt", "fp", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, salt string, fp string, nth double").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    s = lambda n: Scratch(spark, n)
    assert packing.pack(none).count() == token_counts.token_counts(none).count() == 0
    assert exact_dedup.exact_dedup(none, exact_dedup.DigestIndex(spark, f"{s('e').root}/i"), s("e")).count() == 0
    assert simhash.simhash_components(none, s("f")).count() == substring_dedup.repeats(none, s("g")).count() == 0
    assert language_id.identify(none, language_id.fit([])).count() == secret_scan.scan(none).count() == piece_lattice.encode(none).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), s("h")).count() == 0


# 1 packing


def test_packing(spark, odd, docs):
    for df in (odd, docs):
        rows = packing.pack(df).collect()
        enc = packing.byte_encoder(packing._default_path())
        want = collections.Counter()
        for r in df.collect():
            ids = [*enc.library.encode(r.text or "", add_special_tokens=False).ids, 0]
            want[r.doc_id, len(ids)] += len(ids)
        got = collections.Counter()
        for r in rows:
            got[r.doc_id, r.doc_tokens] += r.length
        assert got == want
        seq = collections.defaultdict(list)
        for r in rows:
            seq[r.sequence_id].append((r.offset, r.length))
        for parts in seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= packing.WINDOW


def test_packed_ids(spark, docs):
    enc = packing.byte_encoder(packing._default_path())
    text = texts(docs)
    for r in packing.pack(docs).where("doc_id % 37 = 0").collect():
        ids = [*enc.library.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_best_fit_is_tightest():
    rng = random.Random(0)
    sizes = [rng.randint(1, 64) for _ in range(400)]
    placed, made = packing.pack_pieces(sizes, 64)
    room: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        w, at = placed[i]
        if fits:
            assert room[w] == min(fits) and at == 64 - room[w]
        else:
            assert w == len(room) and at == 0
            room.append(64)
        room[w] -= sizes[i]
    assert made == len(room)


ALPHABET = ["'", "s", "t", "r", "e", "v", "l", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "½", ",", "日", "😀", "<|endoftext|>", "<|startoftext|>", "́", "\x1c", "Σ", "İ", " ", "ﬁ"]


def mixed(n, seed=1, size=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_byte_encoder_is_the_librarys():
    enc, cases = packing.byte_encoder(packing._default_path()), mixed(1500)
    ids, bounds = enc.encode(cases)
    for i, t in enumerate(cases):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.library.encode(t, add_special_tokens=False).ids, t


def thue_morse(swap=False):
    """Of 1,024 letters; with its complement it breaks polynomial hashes modulo 2**64."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(1024))


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    words = [thue_morse(), thue_morse(True), "one", "two", "three"]
    cases = [*words, " ".join(words)]
    weak = lambda cp, start, end, seed=0: np.asarray(end - start, np.uint64) % np.uint64(2)
    for hashes in (spans.hashes, weak):
        monkeypatch.setattr(spans, "hashes", hashes)
        enc = packing.ByteEncoder(packing._default_path())
        ids, bounds = enc.encode(cases)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [enc.library.encode(t, add_special_tokens=False).ids for t in cases]
        counter = token_counts.PrefixCounter(token_counts._default_path())
        _, total, (bounds, _, extra) = counter.batch(cases)
        lib = Tokenizer.from_file(token_counts._default_path())
        assert (total[bounds[1:]] - total[bounds[:-1]]).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in cases]
        pieces = piece_lattice.Encoder(piece_lattice._default_path())
        text = [pieces.pieces.normalise(t) for t in cases]
        got = [ids.tolist() for ids, _ in pieces.encode(text, 1)]
        assert [pieces.pieces.decode(x) for x in got] == cases
        sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice._default_path())
        assert all(sp.decode(x) == t for x, t in zip(got, cases))
    monkeypatch.undo()
    run = [f"w{i}" for i in range(6)]
    docs = spark.createDataFrame([(1, " ".join([*run, words[0], *run])), (2, " ".join([*run, words[1], *run]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.repeats(docs, Scratch(spark, "ttm")).collect()] == [0, 0]


# 2 fingerprints


def shingles(t, k=5):
    w = WORD.findall(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_op2(spark, df, monkeypatch, tmp_path):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 20_000)
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()
    rows = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()), key=lambda r: -r[0])
    edited = collections.Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited[i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    return got, edited


def test_fingerprints(spark, docs, monkeypatch, tmp_path):
    got, edited = check_op2(spark, docs, monkeypatch, tmp_path)
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited
    ids = sorted(texts(docs).items(), reverse=True)
    by = {r.doc_id: r for r in got}
    for (i, t), (_, n) in list(zip(ids, ids[1:] + ids[:1]))[:60]:
        half = len(t) // 2
        assert abs(by[i].near_edited - jaccard(shingles(t), shingles(t[: len(t) - half] + n[:half]))) < 0.2
        assert abs(by[i].near_next - jaccard(shingles(t), shingles(n))) < 0.2


def test_fingerprints_odd(spark, monkeypatch, tmp_path):
    rows = [r for r in ODD if r[0] != 6]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sketch string, tie int")
    got, edited = check_op2(spark, df, monkeypatch, tmp_path)
    assert collections.Counter((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == ""
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    got, edited = check_op2(spark, one, monkeypatch, tmp_path)
    assert got[0].near_next == 1.0


def brute_sketch(t, k=fingerprints.K):
    """The k least hashes of the shingles, by the chained hash of Spark's xxhash64."""
    out = set()
    for shingle in shingles(t):
        h = 42
        for w in shingle:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)[:k]


def brute_likeness(a, b, k=fingerprints.K):
    both = sorted(set(a) | set(b))[:k]
    return len([h for h in both if h in a and h in b]) / len(both) if both else 1.0


def brute_op2(rows):
    """All columns of op2's rows but the sketch of repeated ids, whose order is that of a hash."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        s, x, y = brute_sketch(t), brute_sketch(e), brute_sketch(n)
        text = lambda a: "".join(f"{h % (1 << 64):016x}" for h in a)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(s), text(x), round(brute_likeness(s, x), 9), round(brute_likeness(s, y), 9)))
    return sorted(out)


@pytest.mark.parametrize("size", [3_000, 1 << 40])
def test_op2_is_brute_force(spark, docs, monkeypatch, tmp_path, size):
    """Exact bottom-k sketches; ids that no double holds, and ranges of a few rows."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    for name, base in (("a", 0), ("b", (1 << 62) + 1)):
        rows = [(base + i, t) for i, t in texts(docs).items()]
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = fingerprints.op2_fingerprints(spark, f"{tmp_path}/{name}").collect()
        assert sorted((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == brute_op2(rows)


def test_op2_hot_id_repeats_and_empty(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    rows = [(7, f"{k:04} is hot {k:04}") for k in range(300)] + [(i, f"text {i}") for i in range(20) if i != 7] + [(3, "text 3")] * 4 + [(None, "no id")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, _ = check_op2(spark, df, monkeypatch, tmp_path)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    got = fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == collections.Counter((i, len(t)) for i, t in rows)
    edited = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.edited_sha256)
    assert by[8][0] in {edited("text 8", t) for i, t in rows if i == 7} and edited("text 6", "text 5") in by[6]
    assert sorted(by[3]) == sorted([edited("text 3", "text 3")] * 4 + [edited("text 3", "text 2")])
    assert sorted(by[None]) == sorted([edited("no id", "no id"), edited("no id", "text 19")])
    last = [x for x in by[7] if x in {edited(t, "text 6") for i, t in rows if i == 7}]
    assert len(last) == 1 and len(set(by[7])) == 300  # a chain through all texts of the hot id
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    none = fingerprints.op2_fingerprints(spark, str(tmp_path))
    assert none.count() == 0 and none.columns[:2] == ["doc_id", "n_chars"]


def test_sketch_algebra(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    k = [F.col(f"s{x}") for x in "abc"]
    df = df.select(*(fingerprints.sketch(F.col(x)).alias(f"s{x}") for x in "abc"))
    r = df.select(
        fingerprints.resemblance(k[0], k[1]).alias("j"), fingerprints.containment(k[0], k[1]).alias("c"), fingerprints.distinct_shingles(k[0]).alias("n"),
        (fingerprints.resemblance(fingerprints.merge(k[0], k[1]), k[2])).alias("m"), F.size("sa").alias("k"),
    ).first()
    assert abs(r.j - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and 1500 < r.n < 2600 and r.m > 0.9 and r.k == fingerprints.K
    assert rng


# 3 token counts


def test_prefix_counts_are_the_librarys():
    from tokenizers import Tokenizer

    path = token_counts._default_path()
    lib, own = Tokenizer.from_file(path), token_counts.prefix_counter(path)
    cases = mixed(1500, 2) + ["", "a" * 300, "the" * 60]
    end, total, (bounds, _, extra) = own.batch(cases)
    assert (total[bounds[1:]] - total[bounds[:-1]] + extra[:-1]).tolist() == [len(x.ids) for x in lib.encode_batch(cases, add_special_tokens=False)]
    for t in mixed(300, 3, 15):
        t = own.normalise(t)
        if "<|" not in t and own.normalise(t) == t:
            assert own.prefixes(t) == [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]


def test_a_long_word_takes_linear_memory():
    import tracemalloc

    from tokenizers import Tokenizer

    rng = random.Random(8)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    counter = token_counts.PrefixCounter(token_counts._default_path())
    for n in (1000, 200_000):
        tracemalloc.start()
        _, total, _ = counter.batch([word[:n]])
        assert tracemalloc.get_traced_memory()[1] < 15_000_000 + 120 * n
        tracemalloc.stop()
    _, total, _ = counter.batch([word])
    assert total[-1] == len(Tokenizer.from_file(token_counts._default_path()).encode(word, add_special_tokens=False).ids)


def test_token_counts(spark, odd):
    rows = token_counts.token_counts(odd, prefixes=True)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[5].n_tokens == got[3].n_bytes == 0 and got[10].n_tokens == 4000 and got[5].n_bytes == 4
    assert rows.count() == len(ODD)
    cut = {r.doc_id: r for r in token_counts.truncate_at(rows, 3).collect()}
    assert cut[10].n_words == 3 and cut[10].n_code_points == 14 and cut[4].n_code_points == 0


# 4 exact dedup


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i))
    return {d: (sorted(g, key=lambda x: (x[0], x[1], x[2] or 0))[0][2], len(g)) for d, g in groups.items()}


def test_exact_dedup_odd(spark, odd):
    s = Scratch(spark, "t4")
    index = exact_dedup.DigestIndex(spark, f"{s.root}/index", 4)
    first = exact_dedup.exact_dedup(odd, index, s)
    rows = first.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("d")).collect()
    want = brute_dedup(ODD)
    assert len(rows) == len(ODD) and all((r.keep_id, r.group_size) == want[r.d] for r in rows)
    assert collections.Counter(r.d for r in rows if r.kept) == collections.Counter(list(want))
    again = exact_dedup.exact_dedup(odd, exact_dedup.DigestIndex(spark, f"{s.root}/index", 4), Scratch(spark, "t4b"))  # the index persists by its path
    assert again.where("kept").count() == 0 and again.where("keep_id IS NULL").count() == 1
    more = spark.createDataFrame([(99, "brand new"), (98, "The quick brown fox jumps over the lazy dog and runs far away from it today")], "doc_id long, text string")
    late = {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup.exact_dedup(more, index, Scratch(spark, "t4c")).collect()}
    assert late == {99: (True, 99), 98: (False, 1)}


def test_exact_stage_keeps_columns_and_one_of_repeats(spark, odd):
    out = exact_dedup.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == len(brute_dedup(ODD))


def test_index_keeps_its_buckets_and_batches(spark, monkeypatch):
    s = Scratch(spark, "t4i")
    rows = spark.createDataFrame([(i, f"text {i % 20}") for i in range(60)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"{s.root}/index", 4)
    assert exact_dedup.exact_dedup(rows, index, Scratch(spark, "t4j"), "first").where("kept").count() == 20
    index.close()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, f"{s.root}/index")
        assert again.buckets == 4
        assert exact_dedup.exact_dedup(rows, again, Scratch(spark, "t4k"), "second").where("kept").count() == 0
        # the first batch again, as if its caller had crashed: whole, and in part
        assert exact_dedup.exact_dedup(rows, again, Scratch(spark, "t4l"), "first").where("kept").count() == 20
        assert again.rows().count() == 20
        again.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    half = exact_dedup.DigestIndex(spark, f"{s.root}/half", 3)
    exact_dedup.exact_dedup(rows.where("doc_id < 10"), half, Scratch(spark, "t4m"), "b").count()
    got = exact_dedup.exact_dedup(rows, half, Scratch(spark, "t4n"), "b")
    assert sorted(r.doc_id for r in got.where("kept").collect()) == list(range(20)) and half.rows().count() == 20
    with pytest.raises(ValueError, match="3 buckets"):
        exact_dedup.DigestIndex(spark, f"{s.root}/half", 5)


CLASHES = "id n d k_id k_n k_d __id __n __d __text row copies salt fp text2 least part here".split()


def test_stages_keep_clashing_and_map_columns(spark):
    names = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, {"a": str(k)}, *(f"{c}{k}" for c in CLASHES)) for k, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, m map<string,string>, {names}").repartition(3)
    for stage in (exact_dedup.stage, simhash.stage, simhash_similar.stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            k = r.m["a"]
            assert rows[int(k)][0] == r.doc_id and all(r[c] == f"{c}{k}" for c in CLASHES)


def test_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 7)
    docs = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text")).repartition(3)
    s = Scratch(spark, "t4r")
    rows = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, f"{s.root}/index"), s).collect()
    assert len(rows) == 100 and sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {100}
    assert exact_dedup.stage(spark, docs, "").count() == 1


# 5 language ID


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(0)
    model = language_id.Crf(["a", "b", "c"], {}, np.zeros((1, 3), np.float32), rng.normal(size=(3, 3)))
    sizes = np.array([1, 2, 63, 64, 65, 200, 5])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32) * 3
    got, at, t = model.marginals(scores, sizes), 0, np.exp(model.transitions)
    for n in sizes:
        e = np.exp(scores[at : at + n].astype(float))
        a, b = [np.ones(3)], [np.ones(3)]
        for k in range(n):
            a.append((a[-1] @ t) * e[k] / ((a[-1] @ t) * e[k]).sum())
            b.append(t @ (e[n - 1 - k] * b[-1]) / (t @ (e[n - 1 - k] * b[-1])).sum())
        for k in range(n):
            p = a[k + 1] * b[n - 1 - k]
            assert np.allclose(got[at + k], p / p.sum(), atol=1e-6)
        at += n


def test_crf_gradient():
    rng = np.random.default_rng(1)
    scores, sizes, y, t = rng.normal(size=(7, 2)), np.array([4, 3]), rng.integers(0, 2, 7), rng.normal(size=(2, 2))

    def nll(scores, t):
        total, at = 0.0, 0
        for n in sizes:
            logs = []
            for path in itertools.product(range(2), repeat=int(n)):
                s = np.log(np.exp(t[:, path[0]]).sum()) + sum(scores[at + k, c] for k, c in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))
                logs.append((s, path))
            own = next(s for s, p in logs if list(p) == y[at : at + n].tolist())
            total += np.logaddexp.reduce([s for s, _ in logs]) - own
            at += n
        return total

    wrong, moved = language_id._gradient(t, scores, sizes, y)
    for arr, grad, put in ((scores, wrong, lambda a: nll(a, t)), (t, moved, lambda a: nll(scores, a))):
        for i in np.ndindex(arr.shape):
            d = np.zeros_like(arr)
            d[i] = 1e-5
            assert abs((put(arr + d) - put(arr - d)) / 2e-5 - grad[i]) < 1e-4


def test_language_accuracy_and_odd(spark, docs, odd, data):
    rows = language_id.op5_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    model = language_id.fit(language_id.sample_chains(docs))
    got = language_id.identify(odd, model, segments=True).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5}
    mix = spark.createDataFrame([(1, "the and of that with for this was from are. und der die das nicht ist ein auch sich auf")], "doc_id long, text string")
    assert {s.lang for s in language_id.identify(mix, model, segments=True).first().segments} == {"en", "de"}
    no_labels = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.stage(spark, no_labels, "").count() == docs.count()
    assert language_id.stage(spark, docs, "").columns == docs.columns


def test_op5_is_brute_force(spark, docs, data, tmp_path):
    """Every document's words, marginals by a plain pass from end to end, and shares of letters."""
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()] + [(7001, None, None), (7002, "1 2 3 ...", "en"), (None, "no id but words", None), (7003, "der die the and " * 300, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.fit(language_id.sample_chains(made))
    step = np.exp(model.transitions)
    want = []
    for i, t, _ in rows:
        words = regex.findall(r"\p{L}+", t or "")
        pred, score = "und", 0.0
        if words:
            e = np.exp(model.emissions(words).astype(float))
            ahead, behind = [np.ones(len(model.langs))], [np.ones(len(model.langs))]
            for k in range(len(words)):
                a, b = (ahead[-1] @ step) * e[k], step @ (e[len(words) - 1 - k] * behind[-1])
                ahead.append(a / a.sum())
                behind.append(b / b.sum())
            post = np.array([ahead[k + 1] * behind[len(words) - 1 - k] for k in range(len(words))])
            mass = (post / post.sum(axis=1, keepdims=True) * np.array([[len(w)] for w in words])).sum(axis=0)
            pred, score = model.langs[int(mass.argmax())], float(mass.max() / mass.sum())
        want.append((i, pred, score))
    got = {r.doc_id: r for r in language_id.op5_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, pred, score in want:
        assert got[i].lang_pred == pred and abs(got[i].score - score) < 1e-5 and got[i].held_out == (None if i is None else zlib.crc32(str(i).encode()) % 3 == 1)


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 20)
    x, y = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    same = [(x, "one text of one id", "en")] * 400 + [(x, f"text number {'abcdefghij'[i % 10]} {'abcdefghij'[i // 10 % 10]} {'abcdefghij'[i // 100]}", "en") for i in range(500)]
    none = [(None, f"ein Text {'abcdefghij'[i % 10]} {'abcdefghij'[i // 10 % 10]} {'abcdefghij'[i // 100]}", "de") for i in range(500)]
    df = spark.createDataFrame([*same, *none, (y, "long " * 1000, "es")], "doc_id long, text string, lang string").repartition(4)
    n = collections.Counter(lang for _, lang in language_id.sample_chains(df))
    assert n["en"] == n["de"] == 20 and n["es"] == math.ceil(1000 / language_id.CHAIN_WORDS)


def test_every_language_is_learned(spark, monkeypatch):
    r = random.Random(4)
    words = {f"l{k:02}": ["".join(chr(0x4E00 + 12 * k + r.randrange(12)) for _ in range(5)) for _ in range(30)] for k in range(70)}
    rows = [(70 * j + k, " ".join(r.choices(words[lang], k=20)), lang) for j in range(12) for k, lang in enumerate(sorted(words))]
    docs = spark.createDataFrame([*rows, (9999, "qqq www eee", "rare")], "doc_id long, text string, lang string")
    assert not zlib.crc32(b"9999") % 3 == 1
    chains = language_id.sample_chains(docs)
    assert {lang for _, lang in chains} == {*words, "rare"}
    model = language_id.fit(chains)
    of = {i: lang for i, _, lang in rows}
    got = language_id.identify(docs, model).where("doc_id < 9999").collect()
    assert np.mean([x.lang_pred == of[x.doc_id] for x in got]) > 0.95
    monkeypatch.setattr(language_id, "SAMPLE_ALL", 71)
    assert {lang for _, lang in language_id.sample_chains(docs)} == {*words, "rare"}


def test_marginals_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([200, 3, 70, 1])
    model = language_id.Crf(list("abc"), {}, np.zeros((4, 3)), rng.normal(size=(3, 3)))
    scores = rng.normal(size=(int(sizes.sum()), 3))
    want = model.marginals(scores, sizes)
    monkeypatch.setattr(language_id, "MOST_MOVES", 1)
    assert np.allclose(model.marginals(scores, sizes), want)


# 6 secrets


def test_forest_on_held_out_findings():
    found = secret_scan.findings_fixture(800, 77)
    p = secret_scan.default_forest().predict(np.array([secret_scan.features(*f[:5]) for f in found]))
    y = np.array([f[5] for f in found])
    assert ((p >= 0.5) == y).mean() > 0.96 and ((p >= 0.5) & (y == 0)).sum() / (y == 0).sum() < 0.03


def test_secret_scan(spark, odd, docs, data):
    text = texts(docs)
    want = {i: len(re.findall(r'token = "[0-9a-f]{40}"', t, re.I)) for i, t in text.items()}
    assert {r.doc_id: r.n_secrets for r in secret_scan.op6_secret_scan(spark, data).collect()} == want
    assert secret_scan.scan(odd).where("size(findings) > 0").count() == 0
    t = 'é😀 password: "changeme" and token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" or commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 done'
    one = spark.createDataFrame([(1, t, len(t))], "doc_id long, text string, n_chars long")
    r = secret_scan.stage(spark, one, "").first()
    assert r.text == t.replace('"9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', '"[SECRET]"') and r.n_chars == len(r.text)
    assert secret_scan.scan(one, redact=True).first().text == r.text


def test_secrets_are_taken_whole(spark):
    r = random.Random(3)
    key = "MIIE" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1600))
    rows = [f'private_key = "{key}" next', f"private_key={key} next", f"client-key-data: {key}\nnext", f"one {key} two", 'password = "Xk9$mQ2(vL7pR4" next']
    want = [rows[0].replace(key, "[SECRET]"), rows[1].replace(key, "[SECRET]"), rows[2].replace(key, "[SECRET]"), rows[3].replace(key, "[SECRET]"), 'password = "[SECRET]" next']
    got = secret_scan.stage(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "").collect()
    assert [x.text for x in sorted(got)] == want
    for text, value in (("pwd = 'a, b; c(d)' x", "a, b; c(d)"), ('token = "open1234 x', "open1234"), ('secret: "q\\"uoted1" x', 'q\\"uoted1')):
        assert [text[a:b] for a, b, _ in secret_scan.candidates(text)] == [value]
    assert secret_scan.candidates("x" * 30 + "1@example.org") == []


def test_kinds_of_findings_not_seen_in_training():
    """False findings of a kind that the forest never saw: paths, identifiers and dates are known for what they are."""
    share = lambda forest, rows: (forest.predict(np.array([secret_scan.features(*f[:5]) for f in rows])) >= 0.5).mean()
    wrong = []
    for kind in range(9):
        forest = secret_scan.train(secret_scan.findings_fixture(1500, without=(kind,)))
        found = secret_scan.findings_fixture(600, 77, tuple(k for k in range(9) if k != kind))
        wrong.append(share(forest, [f for f in found if not f[5]]))
        assert share(forest, [f for f in found if f[5]]) > 0.97
    assert max(wrong[k] for k in (3, 4, 6, 7)) < 0.05 and np.mean(wrong) < 0.3


def test_findings_from_a_table(spark):
    rows, want = [], []
    for value, rule, before, after, path, label in secret_scan.findings_fixture(300, 9):
        rows.append((before + value + after, len(before), len(before) + len(value), secret_scan.RULES[rule], path, label))
        want.append((value, rule, before, after, path, label))
    rows += [(None, 0, 1, None, None, 1), ("text", 2, 2, None, None, 1), ("text", 0, 2, None, None, None)]
    df = spark.createDataFrame(rows, "text string, start long, end long, rule string, path string, label int")
    got = secret_scan.labelled_findings(df)
    assert sorted(got) == sorted(want) and len(secret_scan.labelled_findings(df, 50)) == 50
    assert secret_scan.train(got).trees


def brute_candidates(text):
    """By trying every name at every place behind the value before."""
    found, upto = [], 0
    names = re.compile(r"token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key", re.I)
    for m in re.finditer(r"[\w.-]+", text):
        if m.start() < upto or not names.search(m[0]):
            continue
        sign = re.match(r"[\"']?\s*(?:=>|:=|=|:)\s*", text[m.end() :])
        if not sign:
            continue
        at = m.end() + sign.end()
        rest = text[at:]
        if rest[:1] in ("'", '"', "`") and rest.find(rest[0], 9) > 0 and "\n" not in rest[1 : rest.find(rest[0], 9)] and rest.find(rest[0], 1) >= 9:
            found.append((at + 1, at + rest.find(rest[0], 1)))
            upto = found[-1][1] + 1
        elif bare := re.match(r"[\"'`]?([^\s\"'`,;<>|(){}\[\]]{8,})", rest):
            found.append((at + bare.start(1), at + bare.end(1)))
            upto = found[-1][1]
    return found


def test_candidates_are_brute_force():
    rng = random.Random(10)
    parts = ["token", "my_secret.key", "x" * 60 + "_password", "pwd" + "y" * 50, " = ", ": ", "=>", ' := "', '"', "'", "value1234", "ab", " ", "\n", "z9" * 400, ", ", "author"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        want = brute_candidates(text)
        got = [(a, b) for a, b, rule in secret_scan.candidates(text) if rule == 1]
        assert want == got, text


def test_op6_is_brute_force(spark, tmp_path):
    """Of whole texts: every candidate, its places, score and digest, odd rows and all."""
    rows = [*ODD, (11, 'é😀 my.password = "Xk9$mQ2(vL7pR4" and ' + "token = '" + "a1" * 300 + "'"), (12, "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8"), (12, "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8")]
    spark.createDataFrame([(i, t, "src/config") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    forest = secret_scan.default_forest()
    for i, t in rows:
        found = secret_scan.scan_text(t or "", "src/config", forest)
        good = [(a, b, secret_scan.RULES[k], round(s, 6), hashlib.sha256(t[a:b].encode()).hexdigest()) for a, b, k, s in found if s >= 0.5]
        want.append((-1 if i is None else i, len(found), len(good), good))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_candidates, r.n_secrets, [tuple(s) for s in r.secrets]) for r in secret_scan.op6_secret_scan(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) == 2


# 7 pages


def extract(page):
    return html_extract.extract_page(page)


def extract_host(pages):
    """Of the pages of one host, under the wrapper of all of them, however they are put together."""
    rule = html_extract.rule_of(html_extract.infer(pages))
    halves = [html_extract.Wrapper.loads(html_extract.infer(x).dumps()) for x in (pages[: len(pages) // 2], pages[len(pages) // 2 :]) if x]
    other = html_extract.rule_of(functools.reduce(html_extract.Wrapper.add, halves))
    out = [html_extract.extract_page(p, rule) for p in pages]
    assert out == [html_extract.extract_page(p, other) for p in pages]
    return out


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a&nbsp;&amp; b\n c<br>d<p>e", "a & b c d\ne"),
        ('<body><header>H</header><nav><a href="/">Home</a></nav><main><article><header><h1>T</h1></header><p>x <b>y</b></p><ul><li>1<li>2</ul><div class="comments"><p>bad</p></div></article></main><aside>s</aside><footer>f</footer>', "T\nx y\n1\n2"),
        ('<article><p>keep</p><form>f</form><script>if (a < b) "</p>";</script><style>p{}</style><!-- c <p> --><div class="ad">buy</div></article>', "keep"),
        ('<div id="top-menu"><a href=1>a</a></div><div class="content"><h2>Head</h2><p>long enough text of the page</p></div><div class="cookie-notice">ok?</div>', "Head\nlong enough text of the page"),
        ('<body class="x"><div class="page no-sidebar"><div class="post-header"><h1>T</h1></div><p>text of the page</p></div><div class="site-header">s</div>', "T\ntext of the page"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
    ],
)
def test_pages(page, want):
    assert extract(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><h2 id="related-work">Related</h2><section id="discussion"><p>seen</p></section><p id="search-results">found</p><div class="side-effects">none</div></article>', "Related\nseen\nfound\nnone"),
        ('<main><h2 id="social-effects">Effects</h2><p>text</p><div class="share">tell</div><div role="search">find</div></main>', "Effects\ntext"),
        ('<article><p>text</p><div class="related-posts"><a href="/1">one</a> <a href="/2">two</a></div></article>', "text"),
        ('<div itemprop="articleBody"><p class="side-note">noted</p><p>text</p></div>', "noted\ntext"),
        ('<div class="content"><h2 id="related-work">Related</h2><p>text of the page, long enough</p></div>', "Related\ntext of the page, long enough"),
    ],
)
def test_names_in_the_main_element(page, want):
    assert extract(page) == want


def test_template_in_the_main_element():
    pages = [f'<article><p>text {i}</p><div class="share-box">Tell your friends</div><div class="ad-hoc">word {i}</div></article>' for i in range(4)]
    assert extract_host(pages) == [f"text {i}\nword {i}" for i in range(4)]


@pytest.mark.parametrize("pages", [1, 2, 3, 4])
def test_text_without_an_article_stays(pages):
    lead = "the same words of a lead " * 10
    assert extract_host([f"<body><div>{lead}<br>ends with {i}</div>" for i in range(pages)]) == [f"{lead}ends with {i}" for i in range(pages)]
    assert extract_host([f"<body><div>{lead * 3}end</div>"] * pages) == [f"{lead * 3}end"] * pages
    assert extract_host(["<body><div>a short page</div>"] * pages) == ["a short page"] * pages
    long = [f"<body><div>an intro {i}</div><div><p>{'long text ' * 90}{i}</p></div>" for i in range(pages)]
    assert extract_host(long) == [f"an intro {i}\n{'long text ' * 90}{i}" for i in range(pages)]
    dated = [f"<body><div>date {i}</div><p>{lead}</p><p>{lead}</p><p>{lead}</p>" for i in range(pages)]
    assert extract_host(dated) == [f"date {i}\n" + "\n".join([lead.strip()] * 3) for i in range(pages)]


def test_wrapper_tells_template_without_names():
    """Boxes without names: what is the same in all pages of the host, or links, isn't text; copies of pages don't count twice."""
    rng = random.Random(4)
    menu = "".join(f"<li><a href=/{w}>{w} pages</a></li>" for w in ("home", "news", "about"))

    def page(i, extra=""):
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(20, 60)))
        body = "".join(f"<p>{words} {i} {k}</p>" for k in range(rng.randint(2, 6)))
        text = "\n".join(f"{words} {i} {k}" for k in range(body.count("<p>")))
        return f"<body><div>Daily Example</div><div><ul>{menu}</ul></div>{extra}<div><h2>Story {i}</h2>{body}</div><div>All rights of the Example kept, since 1990</div>", f"Story {i}\n{text}"

    made = [page(i) for i in range(6)]
    assert extract_host([p for p, _ in made]) == [t for _, t in made]
    assert extract_host([p for p, _ in made for _ in range(5)]) == [t for _, t in made for _ in range(5)]
    two = [made[0]] * 9 + [made[1]]  # two different pages don't show a template
    assert all(t in got for got, (_, t) in zip(extract_host([p for p, _ in two]), two))


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="search-results"><article><p>found it</p></article></div>', "found it"),
        ('<article class="a"><p>one</p></article><article class="b"><p>two</p></article>', "one\ntwo"),
        ('<main><p>text</p><div class="side">beside</div></main>', "text\nbeside"),
        ('<article><p>text</p><section class="comments"><article><p>reader</p></article></section><article class="comment"><p>me too</p></article></article>', "text"),
        ("<div>" * 120 + "<nav>menu</nav><p>deep text</p>" + "</div>" * 120, "deep text"),
        ("<div>" * 5000 + "<nav>menu</nav><p>deep text</p>", "deep text"),
        ('<div class="notice"><p>all there is</p></div><nav>menu</nav>', "all there is"),
        ('<p>a <a title="x > y">link</a> b</p>', "a link b"),
        ("<p>1 < 2 and <b", "1 < 2 and <b"),
    ],
)
def test_odd_pages(page, want):
    assert extract(page) == want


def test_long_pages_take_time_in_proportion():
    for page, want in [("<a " * 400_000, 1_199_999), ("<p>word " * 120_000, 5 * 120_000 - 1), ("<article>" + "x" * 5_000_000, 5_000_000), ('<i ="' * 100_000, None), ("< " * 300_000 + ">", None)]:
        start = time.monotonic()
        got = extract(page)
        assert time.monotonic() - start < 20 and want in (None, len(got))


def test_headings_between_texts_stay():
    def page(i, title="Results"):
        return f"<body><div>My site</div><h1>T{i}</h1><p>lead {i} of a story with many words</p><h2>{title}</h2><p>found {i * 7} more of them in the sea</p><h2>Comments</h2><div class=comments>c{i}</div><div>all rights</div></body>"

    assert extract_host([page(i) for i in range(6)]) == [f"T{i}\nlead {i} of a story with many words\nResults\nfound {i * 7} more of them in the sea" for i in range(6)]
    nested = [f"<body><p>lead {i} of a story with many words</p><div><h2>Results</h2><h3>All</h3><p>found {i} more</p></div><div><h3>Links</h3><ul><li><a href=1>one of them</a></ul></div></body>" for i in range(6)]
    assert extract_host(nested) == [f"lead {i} of a story with many words\nResults\nAll\nfound {i} more" for i in range(6)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>a</p><button>Share</button><p>b <video>no video</video>c <label>name</label> d</p></article>", "a\nb c d"),
        ("<article><p>a <canvas>c</canvas><audio>d</audio><object>e</object>b</p></article>", "a b"),
        ('<article><section class="search"><p>how to look</p></section><p class="related">and more</p><h2 class="social">Of people</h2></article>', "how to look\nand more\nOf people"),
        ('<article><section class="related"><p>other</p></section><p class="ad">buy</p><p>text</p></article>', "text"),
    ],
)
def test_controls_and_names_in_text(page, want):
    assert extract(page) == want


def test_wrapper_resolves_mismatches():
    of = lambda *pages: html_extract.expression(html_extract.infer(list(pages)).root)
    text = lambda t: hashlib.blake2b(t.encode(), digest_size=8).hexdigest()
    a, b = "<div><h1>One</h1><p>x</p><p>y</p></div>", "<div><h1>Two</h1><table><tr><td>1</table><p>z</p></div>"
    want = f"<html>(<div>(<h1>#TEXT</h1>)(<table>(<tr>(<td>{text('1')}</td>)</tr>)</table>)?(<p>#TEXT</p>)+</div>)</html>"
    assert of(a, b) == want
    assert "(<table>" in of(b, a) and "</table>)?" in of(b, a)
    assert of("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>c<dt>d<dd>e</dl>") == "<html>(<dl>((<dt>#TEXT</dt>)+?(<dd>#TEXT</dd>)+?)+</dl>)</html>"


def test_wrappers_stay_small():
    pages = ["<body>" + "".join(f'<div class="c{"abcdefghij"[k]}{"abcdefghij"[i % 10]}{"abcdefghij"[i // 10]}"><p>{i} {k}</p></div>' for k in range(9)) + "<ul><li>menu</ul>" for i in range(100)]
    w = html_extract.infer(pages * 4)
    assert len(html_extract.preorder(w.root)) < 2 * html_extract.NODES
    assert len(html_extract.rule_of(w)) < 1000


def test_extract_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "x", "<p>hi</p>"), (-1, "x", "<p>hi</p>")], "page_id long, url string, html string")
    got = html_extract.extract(pages.unionByName(odd), Scratch(spark, "t7")).collect()
    assert len(got) == pages.count() + 3 and sorted(r.text for r in got if r.page_id in (None, -1)) == ["", "hi", "hi"]
    want = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        if r.page_id in want:
            body = re.search(r"<article>(.*?)</article>", want[r.page_id], re.S)[1]
            lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if "br" in m[0] else "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
            assert r.text == "\n".join(x for x in lines if x)
    # the same pages without the tags that say what is what: the host's wrapper leaves out the menu that all its pages have
    menu = "<div><ul><li><a href='/a'>first</a><li><a href='/b'>second</a></ul></div><div>the one notice of this host</div>"
    made = [(i, f"http://one.example/{i}", re.sub(r".*<article>(.*?)</article>.*", rf"<body>{menu}<div>\1</div>", h, flags=re.S)) for i, h in want.items()]
    plain = html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string").repartition(3), Scratch(spark, "t7b")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(plain) == len(made) and all(r.text == by[r.page_id] for r in plain)


def test_pages_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "FAN_IN", 2)
    made = [(i, f"http://h{i % 3}.example/{i}", f"<body><div>Site of host {i % 3}</div><div><p>text number {i} of the page</p></div>") for i in range(90)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").repartition(9)
    got = html_extract.extract(pages, Scratch(spark, "t7c")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text number {i} of the page" for i, _, _ in made}


# 8 SimHash


def brute_simhash(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, distance=4):
    up = {i: i for i in range(len(fps))}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= distance and find(i) != find(j):
            up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(spark, request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    fps = [brute_simhash(t) for _, t in rows]
    root = roots(fps)
    least = collections.defaultdict(lambda: 1 << 70)
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least[root[k]], 1 << 69 if i is None else i)
    want = collections.Counter((i, fps[k], None if least[root[k]] == 1 << 69 else least[root[k]]) for k, (i, _) in enumerate(rows))
    got = simhash.simhash_components(df, Scratch(spark, "t8")).collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_ball_hashing_finds_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base[:60] for n in (1, 2, 3, 4, 5)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    a, b = zip(*(simhash.collide(fps, k, 3, 2) for k in range(8)))
    node, to = simhash.forest(np.concatenate(a), np.concatenate(b))
    root = dict(zip(node.tolist(), to.tolist()))
    want = roots([int(x) for x in fps])
    assert [root.get(int(x), int(x)) for x in fps] == [int(fps[r]) for r in want]


def test_buckets_stay_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "BUCKET_FINGERPRINTS", 400)
    for n in (2_000, 20_000):
        fps = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        bits, passes = simhash.bucket_bits(n, 2)
        assert passes <= 5
        copies, largest = 0, 0
        for nth in range(1 << passes):
            buckets, own = simhash.deal(fps, bits, passes, nth, 2)
            assert set((buckets & ((1 << passes) - 1)).tolist()) <= {nth} and len(set(buckets.tolist())) == len(buckets)
            copies += sum(map(len, own))
            largest = max([largest, *map(len, own)])
        assert largest < 2 * simhash.BUCKET_FINGERPRINTS and copies <= len(simhash.flips(2)) * len(fps)


def test_links_over_many_passes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_FINGERPRINTS", 60)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base[:20] for n in (1, 3, 4, 5)]]))
    bits, passes = simhash.bucket_bits(len(fps), 2)
    assert bits > simhash.LEAST_BITS and passes
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), Scratch(spark, "t8p")).collect()
    node, to = simhash.forest(np.array([r.a for r in links], np.int64).view(np.uint64), np.array([r.b for r in links], np.int64).view(np.uint64))
    root = dict(zip(node.tolist(), to.tolist()))
    assert [root.get(int(x), int(x)) for x in fps] == [int(fps[r]) for r in roots([int(x) for x in fps])]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    up: dict[int, int] = {}
    find = lambda i: i if up.setdefault(i, i) == i else find(up[i])
    for x, y in edges:
        up[max(find(x), find(y))] = min(find(x), find(y))
    got = {r.node: r.root for r in components(df, Scratch(spark, "tc")).collect()}
    assert all(got.get(i, i) == find(i) for i in up)


def test_simhash_stage(spark, odd, docs):
    out = simhash.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == len(set(roots([brute_simhash(t or "") for _, t in ODD])))
    assert simhash.stage(spark, docs, "").count() == simhash.simhash_components(docs, Scratch(spark, "t8s")).select("component_id").distinct().count()


def word_shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}


def similar_roots(rows, similarity=0.8):
    """Of (id, text) the least id that links of the similarity reach, by comparing all pairs; and how many links there are."""
    own = {i: word_shingles(t) for i, t in rows}
    group = {i: i for i in own}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = 0
    for a, b in itertools.combinations(sorted(own), 2):
        common = len(own[a] & own[b])
        if common and common >= similarity * (len(own[a]) + len(own[b]) - common):
            pairs += 1
            group[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in own}, pairs


def test_similar_stage_is_all_pairs(spark, odd, docs):
    r = random.Random(6)
    rows = [(i, t) for i, t in sorted(texts(docs).items())]
    base = [r.choices([f"w{k}" for k in range(500)], k=250) for _ in range(30)]
    for k, words in enumerate(base):
        for e in range(1, 5):  # e words changed, so up to 5 * e of 246 shingles
            other = list(words)
            for at in r.sample(range(250), e):
                other[at] = "changed"
            rows.append((10_000 + 10 * k + e, " ".join(other)))
        rows.append((10_000 + 10 * k, " ".join(words)))
    group, pairs = similar_roots(rows)
    got = simhash_similar.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert pairs > 150 and sorted(x.doc_id for x in got) == sorted(set(group.values()))
    out = simhash_similar.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == len({b" ".join((t or "").encode().lower().split()) for _, t in ODD})


def test_recall_at_the_least_similarity():
    rng = random.Random(7)
    bits = simhash_similar.drawn(*simhash_similar.shape(200_000))
    found = near = 0
    for n in (120, 250, 900):
        for _ in range(150):
            m = 4 + math.ceil((n - 4) * 1.6 / 1.8)
            a = [f"a{rng.randrange(10**9)}" for _ in range(n)]
            b = a[:m] + [f"b{rng.randrange(10**9)}" for _ in range(n - m)]
            x, y = word_shingles(" ".join(a)), word_shingles(" ".join(b))
            near += 0.8 <= len(x & y) / len(x | y) < 0.84
            (lx, _), (ly, _) = simhash_similar.sketch(" ".join(a)), simhash_similar.sketch(" ".join(b))
            least = np.bitwise_count(simhash_similar.short(lx[None], bits) ^ simhash_similar.short(ly[None], bits)).min()
            found += least <= 2 * simhash_similar.RADIUS and np.bitwise_count(lx[: simhash_similar.CHECK_WORDS] ^ ly[: simhash_similar.CHECK_WORDS]).sum() <= simhash_similar.CHECK_BITS
    assert near == 450 and found >= 0.97 * near


def test_candidates_of_large_groups_are_few(spark, monkeypatch):
    """A group of m near copies has candidates in proportion to m; and short fingerprints over many buckets and slices are as good as in one."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(600):
        other = list(words)
        other[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(other)))
    rows += [(1000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(100))) for i in range(200)]
    nodes = Scratch(spark, "t8n").settle(simhash_similar.sketches(spark.createDataFrame(rows, "doc_id long, text string")).select("fp", "long", "shingles"), "n")
    for size, variants, each in ((1 << 20, 1 << 20, 30), (100, 300, 90)):
        monkeypatch.setattr(simhash_similar, "BUCKET_FINGERPRINTS", size)
        monkeypatch.setattr(simhash_similar, "SLICE_VARIANTS", variants)
        pairs = simhash_similar.candidate_links(nodes, Scratch(spark, "t8c")).collect()
        assert 599 <= len(pairs) < each * 600
        up = {}
        find = lambda i: i if up.setdefault(i, i) == i else find(up[i])
        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        sizes = sorted(collections.Counter(find(i) for i in list(up)).values())
        assert sizes == [600]


@pytest.mark.parametrize("template, families", [(130, 700), (120, 300)])
def test_pairs_in_families_are_found(spark, template, families):
    """Texts that share a template (others at 0.59 and 0.68) fill the variants' groups; each has a copy at 0.88, which is still found."""
    r, rows = random.Random(template), []
    for i in range(families):
        words = [f"t{k}" for k in range(template)] + [f"q{r.randrange(10**9)}" for _ in range(160 - template)]
        other = list(words)
        for at in r.sample(range(160), 2):
            other[at] = f"z{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    shared = word_shingles(rows[0][1]) & word_shingles(rows[2][1])
    assert len(shared) / len(word_shingles(rows[0][1]) | word_shingles(rows[2][1])) > 0.55
    near = [len(a & b) / len(a | b) for a, b in ((word_shingles(rows[2 * i][1]), word_shingles(rows[2 * i + 1][1])) for i in range(families))]
    kept = {x.doc_id for x in simhash_similar.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    pairs = [i for i in range(families) if near[i] >= 0.8]
    assert len(pairs) > 0.9 * families and sum(2 * i + 1 not in kept for i in pairs) >= 0.97 * len(pairs)
    assert all(2 * i in kept for i in range(families))


def test_no_pair_is_lost_in_a_large_group(spark):
    """1,200 texts of one template, most at 0.68 to each other, and a copy of each: the groups are those of all pairs' comparison."""
    r, rows = random.Random(3), []
    for i in range(600):
        words = [f"t{k}" for k in range(130)] + [f"q{r.randrange(10**9)}" for _ in range(30)]
        other = list(words)
        for at in r.sample(range(160), 3):
            other[at] = f"z{r.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    group, pairs = similar_roots(rows)
    scratch = Scratch(spark, "t8r")
    nodes = scratch.settle(simhash_similar.sketches(spark.createDataFrame(rows, "doc_id long, text string")).select("fp", "long", "shingles"), "n")
    cut = nodes.select("fp")
    none = spark.createDataFrame([], "a long, b long")
    assert pairs > 300 and simhash_similar.rest_links(nodes, cut, none, scratch).count() == pairs  # without any links before: all of them
    kept = {x.doc_id for x in simhash_similar.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == set(group.values())


def test_bits_are_counted():
    v = np.random.default_rng(0).integers(0, 1 << 63, (1000, 3)).astype(np.uint64)
    assert (simhash_similar.bit_counts(v) == np.unpackbits(v.view(np.uint8).reshape(1000, -1), axis=1, bitorder="little").sum(axis=0).reshape(3, 64)).all()


# 9 pieces


def test_nbest_against_all_paths():
    p = piece_lattice.pieces(piece_lattice._default_path())
    enc = piece_lattice.encoder(piece_lattice._default_path())
    rng = random.Random(3)

    def paths(w):
        out = []

        def go(i, s):
            if i == len(w):
                out.append(s)
                return
            for j in range(i + 1, min(len(w), i + p.longest) + 1):
                if w[i:j] in p.piece:
                    go(j, s + p.score[p.piece[w[i:j]]])
            if w[i] not in p.piece:
                go(i + 1, s + p.unknown)

        go(0, 0.0)
        return sorted(out, reverse=True)

    for _ in range(300):
        t = "".join(rng.choice([*"therani sé", "日", "\n", "😀", "the", "ing", "▁"]) for _ in range(rng.randint(0, 7)))
        w = p.normalise(t)
        ids, ranked = next(enc.encode([w], 4))
        assert [s for s, _ in ranked] == (paths(w)[:4] if w else [0.0])
        assert p.decode(ids.tolist()) == t.replace("▁", " ")


def test_pieces_round_trip(spark, odd, docs):
    for df in (odd, docs):
        enc = piece_lattice.encode(df)
        got = collections.Counter(r.text for r in piece_lattice.decode(enc).collect())
        assert got == collections.Counter((r.text or "") for r in df.collect())


# 10 substrings


@pytest.mark.parametrize("which, levels", [("docs", 1), ("odd", 1), ("made", 1), ("docs", 2), ("odd", 2), ("made", 2)])
def test_repeats(spark, request, which, levels, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 60_000 if which == "docs" else 300)
    if levels == 2:  # by way of groups of some chunks
        monkeypatch.setattr(substring_dedup, "FAN_BITS", 2)
        monkeypatch.setattr(substring_dedup, "PART_KEYS", 5000 if which == "docs" else 20)
    if which == "made":
        rng = random.Random(7)
        run = " ".join(f"r{i}" for i in range(13))
        rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randint(0, 40))) + (f" x{i} {run}" if i % 3 == 0 else "") + f" y{i}") for i in range(40)]
        rows += [(100 + k, " ".join(["a"] * k)) for k in (12, 13, 14, 30)] + [(200, run), (201, run[:-1] + "9"), (202, "z " + run + " z " + run)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    rows = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, WORD.findall(r.text or "")) for r in df.collect()]
    first: dict[tuple, int] = {}
    for i, w in sorted(rows, key=lambda r: r[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = collections.Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = substring_dedup.repeats(df, Scratch(spark, "t10")).collect()
    assert collections.Counter(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert all(sum(s.behind - s.first for s in r.spans) == r.n_removed for r in got)


# queries and pipeline


def test_registered():
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", n)[0] for n in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    want = db.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, data).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy().tolist())) == sorted(map(tuple, want.astype(str).to_numpy().tolist()))


def test_pipeline(spark, data, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    model = language_id.fit(language_id.sample_chains(docs))
    good = {r.doc_id for r in language_id.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE}
    left = {i: t for i, t in left.items() if i in good}
    keep = {k for k, _ in brute_dedup(left.items()).values()}
    group, _ = similar_roots([(i, left[i]) for i in keep])
    ids = sorted(set(group.values()))
    enc = packing.byte_encoder(packing._default_path())
    hide = lambda t: re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", t, flags=re.I)
    want = {i: len(enc.library.encode(hide(left[i]), add_special_tokens=False).ids) + 1 for i in ids}
    out = corpus_pipeline.run(spark, data)
    assert {r.doc_id: r.doc_tokens for r in out.select("doc_id", "doc_tokens").distinct().collect()} == want


CLASHING = ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture()
def odd_documents(spark, tmp_path):
    rows = [(i, t, ("en", "de", None)[k % 3], "src/config", len(t or ""), *(f"{c}{k}" for c in CLASHES)) for k, (i, t) in enumerate(ODD)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_on_odd_rows(spark, odd_documents):
    for stage in (language_id.stage, exact_dedup.stage, simhash_similar.stage, secret_scan.stage):
        for df in (odd_documents, odd_documents.limit(0)):
            out = stage(spark, df, "")
            assert out.schema == df.schema
            rows = collections.Counter(tuple(r) for r in out.collect())
            assert not rows - collections.Counter(tuple(r) for r in df.collect())
    kept = {r.doc_id for r in language_id.stage(spark, odd_documents, "").collect()}
    assert not kept & {3, 4, 5} and None in kept
    assert secret_scan.stage(spark, odd_documents, "").count() == len(ODD)


def test_pipeline_on_odd_rows(spark, odd_documents, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = collections.defaultdict(int)
    for r in got:
        left[r.doc_id] += r.length
    enc = packing.byte_encoder(packing._default_path())
    text = {i: t for i, t in ODD if t and t.strip()}
    # the language stage drops texts without letters, and of 1, 2 and 6 one has the longest text and the least id
    assert set(left) == set(text) - {2, 6} and all(n == len(enc.library.encode(text[i], add_special_tokens=False).ids) + 1 for i, n in left.items())
    odd_documents.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_very_long_text(spark):
    """A text of over 400,000 characters, one of them without a space, in every operator."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    run = " ".join(f"r{k}" for k in range(20))
    long = " ".join(rng.choices(vocabulary, k=80_000)) + " " + run
    whole = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300_000))
    rows = [(1, "a start " + run), (2, long), (3, whole), (4, long.replace(" ", "\n"))]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(2)
    text = dict(rows)
    enc = packing.byte_encoder(packing._default_path())
    tokens = collections.Counter()
    for r in packing.pack(df).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(enc.library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    lib = Tokenizer.from_file(token_counts._default_path())
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(df).collect()} == {i: brute_simhash(t) for i, t in rows}
    assert {r.doc_id for r in exact_dedup.stage(spark, df, "").collect()} == {1, 2, 3}
    assert {r.doc_id for r in simhash_similar.stage(spark, df, "").collect()} == {1, 2, 3}
    removed = {r.doc_id: r.n_removed for r in substring_dedup.repeats(df, Scratch(spark, "tl")).collect()}
    assert removed == {1: 0, 2: 20, 3: 0, 4: 80_020}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice._default_path())
    encoded = piece_lattice.encode(df.where("doc_id < 3"))
    assert {r.doc_id: r.text for r in piece_lattice.decode(encoded).collect()} == {i: sp.normalize(text[i])[1:].replace("▁", " ") for i in (1, 2)}
    model = language_id.fit([(["the", "and", "of"], "en"), (["der", "und", "die"], "de")] * 4)
    assert language_id.identify(df, model).count() == 4
    assert [(f.start, f.end) for r in secret_scan.scan(df.where("doc_id = 3")).collect() for f in r.findings] == [(0, 300_000)]


def test_spans_words():
    cases = mixed(200, 9) + ["", " ", "a\x0bb\x0cc\x1cd"]
    cp, starts = spans.code_points(cases)
    s, e, first = spans.words(cp, starts)
    text = "".join(cases)
    assert [[text[a:b] for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] for i in range(len(cases))] == [WORD.findall(t) for t in cases]
