"""Tokens, packing and deduplication against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import bpe, exact_dedup, packing, simhash, token_files, tokens
from larkspur.llm.common import components, new_path

WORD, BYTE, MULTI = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, ids string, n int"


def rows():
    r = random.Random(5)
    words = ["Alpha", "beta,", "it's", "<|endoftext|>", "naïve", "x=1;", " ", "é", "日本", "end.", "A^B", "１２"]
    texts = [None, "", " ", "\n\n", "one", "One  two \n three\t", "a" * 5000, "a b " * 3000, "x  y  z", " lead", "tail \n ", "É é   q"]
    texts += ["".join(r.choice(words) + r.choice([" ", "  ", "\n", " \n ", "\t", ""]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts += texts[20:30] + ["one", "o n e", "one\n"]
    return [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3 * (i % 5 > 0)}", "clash", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PIECES = st.lists(
    st.sampled_from(["a", "B", "\u00e9", "e\u0301", "1", "\u00bd", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\ufeff", "\u2014", "\u2028", "\x1c", "\x85", "\x00", ".", ",", "'s", "'", "=\u0338", "^", " ^ ", "<|endoftext|>", "\u65e5", "\u3042", "\u0130", "\u03a3", "\u00df", "\u01c4", "\u00d7", "\u0250", "\U0001f642", "word", " Word"]), max_size=25
).map("".join)


def ids_of(enc, texts):
    ids, ends = enc.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    parts = [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []
    assert all(p[-1] == tokens.END_ID for p in parts) and sum(map(len, parts)) == len(ids)
    return [p[:-1] for p in parts]


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_chunks_give_the_ids_of_whole_texts(path, drops):
    enc, plain = tokens.ChunkEncoder(path, drops, limit=50), library(path)

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.one_of(st.none(), PIECES), min_size=0, max_size=4))
    def check(texts):
        assert ids_of(enc, texts) == [plain(t) for t in texts]

    check()


def test_texts_are_encoded_in_slices(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 40)
    texts = [t for _, t, *_ in rows()]
    for path, drops in ((WORD, True), (BYTE, False)):
        enc, plain = tokens.ChunkEncoder(path, drops, limit_bytes=200), library(path)
        assert ids_of(enc, texts) == [plain(t) for t in texts]


def test_token_files_round_trip(spark, docs):
    plain, folder = library(WORD), new_path(spark, "t")
    token_files.save(docs, WORD, folder)
    got = sorted(token_files.digest(spark, folder).collect())
    start, want = 0, []
    for i, t, *_ in rows():
        ids = [*plain(t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    table = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in table] == list(range(len(table)))
    assert all(a["count"] >= b["count"] for a, b in zip(table, table[1:], strict=False))


def test_token_files_of_an_empty_table_and_null_ids(spark, docs):
    folder = new_path(spark, "t")
    token_files.save(docs.limit(0), WORD, folder)
    assert token_files.digest(spark, folder).collect() == []
    folder = new_path(spark, "t")
    token_files.save(spark.createDataFrame([(None, "a"), (3, None), (3, None)], "doc_id long, text string"), WORD, folder)
    assert sorted((r.doc_id is not None, r.n_tokens) for r in token_files.digest(spark, folder).collect()) == [(False, 2), (True, 1), (True, 1)]


def test_token_files_with_long_texts_and_repeated_ids(spark, monkeypatch):
    """Texts longer than a file and a block; rows that repeat an id lie in the same order whatever the input's."""
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    data = [(i % 20, " ".join(f"w{(i * k) % 97}" for k in range(i * i % 700))) for i in range(40)]
    got = []
    for parts in (1, 4):
        folder = new_path(spark, "t")
        token_files.save(spark.createDataFrame(data, "doc_id long, text string").repartition(parts), WORD, folder)
        got.append(sorted(map(tuple, token_files.digest(spark, folder).collect())))
    assert got[0] == got[1] and len(got[0]) == 40
    assert [s for _, s, *_ in sorted(got[0], key=lambda r: r[1])] == np.r_[0, np.cumsum([n for _, _, n, _ in sorted(got[0], key=lambda r: r[1])])[:-1]].tolist()
    ids = [i for i, *_ in sorted(got[0], key=lambda r: r[1])]
    assert ids == sorted(ids)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=64))
def test_variable_length_code(values):
    values = np.array(values[: len(values) // 4 * 4], np.uint32)
    control, data = token_files.encode(values)
    assert len(control) == len(values) // 4
    assert token_files.decode(control, data).tolist() == values.tolist()


def test_byte_bpe(spark, docs, monkeypatch):
    enc = bpe.encoding(MULTI, public_tokenizers.PATTERN)
    whole = {i: enc.encode_ordinary(t or "") for i, t, *_ in rows()}
    got = {r.doc_id: r for r in bpe.encoded(docs, MULTI, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows():
        assert np.frombuffer(got[i].ids, "<u4").tolist() == whole[i]
        assert bytes(got[i].decoded) == (t or "").encode()
    digests = bpe.encoded(docs, MULTI, public_tokenizers.PATTERN, digests=True).collect()
    assert all(r.n_tokens == len(whole[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(whole[r.doc_id], "<u4").tobytes()).hexdigest() for r in digests)
    assert isinstance(enc, tiktoken.Encoding)
    assert bpe.encoded(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_odd_rows(spark):
    """Long texts with and without white space, repeated and missing ids, columns of the operator's names."""
    enc = bpe.encoding(MULTI, public_tokenizers.PATTERN)
    data = [(1, "ab" * 100_000, 7), (2, "ab cd\n" * 30_000, 7), (2, "x", 7), (2, "x", 7), (None, None, 7), (3, "", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.encoded(docs, MULTI, public_tokenizers.PATTERN).collect())
    assert got == sorted((i or 0, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in data)


def test_simhash_dedup_of_clashing_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3), (5, None, 4), (6, "", 5)], "doc_id long, text string, gone int")
    left = simhash.dedup(docs)
    assert left.columns == docs.columns and sorted(r.gone for r in left.collect()) == [2, 3, 4]


@settings(max_examples=200, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_long_texts_are_cut_at_safe_places(text, long):
    enc = bpe.encoding(MULTI, public_tokenizers.PATTERN)
    parts = list(bpe.pieces(text, long))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.floats(0.1, 9)), min_size=1, max_size=6), st.booleans())
def test_schedule_places_every_token_once(queues, natural):
    totals = [n for n, _ in queues]
    s = packing.Schedule(totals, None if natural else [w for _, w in queues], window=64, grain=8)
    spans = []
    for q, n in enumerate(totals):
        cuts = sorted({0, n, *(random.Random(n).randint(0, n) for _ in range(4))})
        start, size = np.array(cuts[:-1]), np.diff(cuts)
        row, off, k, pos = packing.place_pieces(s, np.full(len(start), q), start, size, 64)
        assert [int(size[r]) for r in range(len(start))] == [int(k[row == r].sum()) for r in range(len(start))]
        assert (pos // 64 == (pos + k - 1) // 64).all()
        spans += zip(pos.tolist(), k.tolist(), strict=True)
    at = 0
    for pos, k in sorted(spans):
        assert pos == at
        at += k
    assert at == sum(totals)


def test_windows_hold_the_target_proportions():
    totals, weights = [40_000, 30_000, 20_000], [1, 1, 2]
    s = packing.Schedule(totals, weights, window=256, grain=32)
    fill = np.zeros((400, 3))
    for q, n in enumerate(totals):
        _, _, k, pos = packing.place_pieces(s, np.array([q]), np.array([0]), np.array([n]), 256)
        np.add.at(fill[:, q], pos // 256, k)
    early = np.cumsum(fill, axis=0)[:150]
    share = early / early.sum(axis=1, keepdims=True)
    assert np.abs(early - np.arange(1, 151)[:, None] * 256 * np.array([0.25, 0.25, 0.5])).max() <= 3 * 32 + 3
    assert np.abs(share[100] - [0.25, 0.25, 0.5]).max() < 0.01


@pytest.mark.parametrize("weights", [None, {"s1": 3.0, "s2": 1.0}])
def test_packing(spark, docs, weights):
    plain = library(BYTE)
    got = packing.pieces(docs, BYTE, weights, with_ids=True).cache()
    by_doc, by_seq = {}, {}
    for r in got.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t, *_ in rows():
        ids, at = [*plain(t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.ids_crc32, bytes(r.ids)) == (zlib.crc32(part), part)
            at += r.length
        assert at == len(ids)
    for q, seq in by_seq.items():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or q == max(by_seq)
    full = {r.sequence_id: r for r in packing.sequences(got).collect()}
    assert all(len(r.ids) == 2048 or len(r.ids) & len(r.ids) - 1 == 0 for r in full.values())
    assert sum(r.n for r in full.values()) == sum(r.length for r in got.collect())


def test_packing_of_an_empty_table(spark, docs):
    assert packing.pieces(docs.limit(0), BYTE).count() == 0


def exact(data):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in data}


@pytest.mark.parametrize("cells", [exact_dedup.MAX_CELLS, exact_dedup.SEGMENT])
def test_exact_dedup(spark, docs, cells):
    want = exact(rows())
    got = {r.doc_id: r for r in exact_dedup.decide(docs, max_cells=cells).collect()}
    assert {i: (r.keep_id, r.group_size, r.text_sha256) for i, r in got.items()} == want
    assert all(r.kept == (r.keep_id == i) for i, r in got.items())
    stay = exact_dedup.dedup(docs, max_cells=cells)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({k for k, _, _ in want.values()})


def test_exact_dedup_beyond_one_filter(spark, monkeypatch):
    """More rows than the largest filter is made for: ranges of hashes, and a filter of what repeats."""
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1 << 10)
    data = [(i, f"text {i % 700}" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    hashes = docs.selectExpr("xxhash64(text) as h")
    bits = exact_dedup.repeated_filter(hashes, 1 << 13)
    assert len(bits) * 8 <= 1 << 13
    seen = docs.select("doc_id", "text", exact_dedup.may_repeat(spark, bits)(exact_dedup.F.xxhash64("text")).alias("again")).collect()
    count = {}
    for _, t in data:
        count[t] = count.get(t, 0) + 1
    assert all(r.again for r in seen if count[r.text] > 1)
    assert sum(not r.again for r in seen) > 0.5 * sum(n == 1 for n in count.values())
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.decide(docs, max_cells=1 << 13).collect()}
    want = exact(data)
    assert got == {i: want[i][:2] for i, _ in data}
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs, max_cells=1 << 13).collect()) == sorted({k for k, *_ in want.values()})


def test_exact_dedup_of_repeated_ids(spark):
    """An id with two texts: each text is judged by itself; columns of any names stay; the smallest long has no smaller one."""
    low = -(1 << 63)
    docs = spark.createDataFrame([(1, "a", 1), (1, "bb", 2), (2, "a", 3), (3, "bb ", 4), (low, "c", 5), (7, "c", 6), (9, "same", 7), (9, "same", 7)], "doc_id long, text string, __h int").withColumn("again", exact_dedup.F.lit("x")).withColumn("best", exact_dedup.F.lit(0))
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns and sorted(r["__h"] for r in left.collect()) == [1, 4, 5, 7]
    assert {r.doc_id: r.keep_id for r in exact_dedup.decide(docs).collect()}[7] == low


def test_exact_dedup_of_odd_tables(spark, docs):
    assert exact_dedup.decide(docs.limit(0)).count() == 0 == exact_dedup.dedup(docs.limit(0)).count()
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (2, "a "), (2, "a ")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(odd).collect()) == [(0, 2, 4, False), (0, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True)]


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def plain_groups(fps):
    ids = sorted(fps)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if low[a] < low[b] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    low[b], changed = low[a], True
    return low


def test_simhash(spark, docs):
    base = " ".join(f"word{i}" for i in range(400))
    more = [(1000 + k, base.replace(f"word{k * 7} ", "changed "), None, None, "", 0) for k in range(20)]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    fps = {i: plain_fingerprint(t) for i, t, *_ in [*rows(), *more]}
    want = plain_groups(fps)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(both).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    stay = simhash.dedup(both)
    assert stay.columns == both.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values()))
    assert simhash.groups(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.groups(odd).collect()) == [(0, 0), (4, 4), (4, 4)]
    assert simhash.dedup(odd).count() == 3


def test_dense_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base, bits = int(rng.integers(0, 2**63)), [int(b) for b in rng.permutation(63)[:11]]
    fps = {base ^ sum(1 << bits[k] for k in range(11) if x >> k & 1) for x in rng.integers(0, 2048, 900).tolist()} | {int(x) for x in rng.integers(0, 2**63, 600)}
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).distinct().collect()
    assert all(bin(a ^ b).count("1") <= 3 for a, b in got)
    at = {x: i for i, x in enumerate(sorted(fps))}
    root = {r.node: r.root for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
    u, low = np.array(sorted(fps), np.uint64), list(range(len(fps)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            low[b] = a
    assert all(at[root.get(x, x)] == find(at[x]) for x in fps)
