"""The corpus operators against brute force on a small corpus with nulls, copies, ties, long texts and shared passages."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chunk_store, common, graph, mixing, near_dups, pu_quality, quality_rules, rans_codec, repeats, spm_codec, substring_dedup, suffix_dedup, token_counts

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, words string"


def corpus() -> list[tuple]:
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "é", "in"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(70))
    base = [" ".join(word() for _ in range(r.choice([3, 40, 60, 120, 300]))) for _ in range(40)]
    texts = [*base, base[5], base[5], base[6] + " more", base[7].replace(" ", "\n", 3), None, None, "", " \t\n", "a b c", "x" * 5000, "ab " * 3000, "the the the " * 60]
    for i in range(8):
        texts.append(" ".join(word() for _ in range(r.randint(5, 60))) + " " + passage + " " + " ".join(word() for _ in range(r.randint(5, 60))))
    near = base[20].split() + base[21].split() + base[22].split()
    for i in range(10):
        copy = list(near)
        for _ in range(i):
            copy[r.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], ["a", "b", None, "c"][min(i % 7, 3)], len(t or ""), "clash", 7, "w") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[-1]]  # repeated rows


ROWS = corpus()
EMPTY = "empty"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def no_sf(spark, none, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def result(df) -> dict:
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == len(ROWS)
    return {r["doc_id"]: r for r in rows}


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def test_op1_counts(spark, sf):
    found = result(quality_rules.op1_quality_rules(spark, sf))
    for i, text, *_ in ROWS:
        w, t = words(text), text or ""
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_op1_distance_is_symmetric_and_bounded(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), [0.0, 1.0]).alias("far"), quality_rules.js_distance(F.array(F.lit(0.3), F.lit(0.7)), [0.3, 0.7]).alias("same")).first()
    assert row.far == pytest.approx(1.0) and row.same == pytest.approx(0.0)


def near_groups(rows, size=4):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().translate(near_dups.LOWER).split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sets, {i: root(i) for i in sets}


def test_op2_components(spark, sf):
    found, (sets, groups) = result(near_dups.op2_near_dups(spark, sf)), near_groups(ROWS)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (len(sets[i]), groups[i], groups[i] == i) for i in sets}


@pytest.mark.parametrize("copies", [0, 1000])
def test_op2_large_families(spark, sf, monkeypatch, copies):
    """Families cut into many blocks, the rest of them met block by block or by shingles."""
    monkeypatch.setattr(near_dups, "UNIT_BYTES", 6000)
    monkeypatch.setattr(near_dups, "MOST_COPIES", copies)
    found, (_, groups) = result(near_dups.op2_near_dups(spark, sf)), near_groups(ROWS)
    assert {i: r["component_id"] for i, r in found.items()} == groups


def test_op2_one_loose_family(spark, monkeypatch):
    """Documents that share boilerplate only, with a few similar pairs and one tight group among them."""
    r = random.Random(8)
    word = lambda: "w" + str(r.randrange(10_000))
    common = [word() for _ in range(60)]
    texts = [common + [word() for _ in range(40)] for _ in range(60)]
    texts += [t[:-1] + [word()] for t in texts[:10]] + [texts[20][:k] + [word()] + texts[20][k + 1 :] for k in range(0, 90, 3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_groups(rows)[1]
    monkeypatch.setattr(near_dups, "bands", lambda low: np.arange(32, dtype=np.int64))  # all in one family
    monkeypatch.setattr(near_dups, "UNIT_BYTES", 4000)
    for copies in (0, 1000):
        monkeypatch.setattr(near_dups, "MOST_COPIES", copies)
        assert {x.doc_id: x.component_id for x in near_dups.link_components(docs).collect()} == want


def test_op2_odd_sketch_estimates():
    """The filter's recall at the limit of similarity, and what it leaves out far below."""
    r = np.random.default_rng(1)

    def estimate(n, union):  # sets with n shingles in common of so many
        every = np.unique(r.integers(0, 1 << 63, union + 50, np.uint64))[:union]
        r.shuffle(every)
        half = (union - n) // 2
        a, b = np.sort(every[: n + half]), np.sort(np.concatenate([every[:n], every[n + half :]]))
        return near_dups.estimated_similarity(near_dups.odd_sketch(near_dups.signature(a)), near_dups.odd_sketch(near_dups.signature(b)))

    close = np.array([estimate(800, 1000) for _ in range(1000)] + [estimate(40, 50) for _ in range(1000)])
    far = np.array([estimate(100, 1000) for _ in range(300)])
    assert abs(close.mean() - 0.8) < 0.02 and close.std() < 0.07
    assert (close >= near_dups.LEAST_ESTIMATE).all() and close.mean() - 6 * close.std() > near_dups.LEAST_ESTIMATE
    assert (far < near_dups.LEAST_ESTIMATE).mean() > 0.95


def test_keep_first_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 5, "x", 1, 2), (2, "a b c d e f g", 6, "y", 3, 4), (None, "q", 7, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_ int, row string, component_id int, `gone.x` int")
    assert sorted(map(tuple, near_dups.keep_first(docs, 5).collect()), key=str) == sorted([rows[0], rows[2]], key=str)


@pytest.mark.parametrize("finish", [0, 1_000_000])
def test_components_of_paths(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH_EDGES", finish)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 100: 90}
    assert graph.components(edges.where("u < 0")).count() == 0


def test_op3_files(spark, sf):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = [r.asDict() for r in rans_codec.op3_rans_tokens(spark, sf).collect()]
    assert len(found) == len(ROWS)
    start, starts = 0, sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in found)
    for s, _, n in starts:
        assert s == start
        start += n
    assert [d for _, d, _ in starts] == sorted(r[0] for r in ROWS)
    text = {r[0]: r[1] for r in ROWS}
    for r in found:
        ids = np.array([*t.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 70_000])
def test_op3_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    blob = rans_codec.encode_ids(ids)
    assert np.array_equal(rans_codec.decode_ids(blob), ids)
    if n:
        with pytest.raises(ValueError, match="damaged"):
            rans_codec.decode_ids(blob[:-2] + bytes([blob[-2] ^ 1, blob[-1]]))


def test_op3_blocks_alone_and_wide_ids():
    ids = np.concatenate([np.arange(150_000, dtype=np.uint32) % 977, np.array([0xFFFFFFFF], np.uint32)])
    blob = rans_codec.encode_ids(ids)
    whole = rans_codec.decode_ids(blob)
    assert np.array_equal(whole, ids)
    assert np.array_equal(rans_codec.decode_ids(blob, [1]), ids[len(rans_codec.decode_ids(blob, [0])) :][: len(rans_codec.decode_ids(blob, [1]))])


def test_op3_ids_are_the_librarys_on_whole_texts(monkeypatch):
    e, r = byte_bpe.ByteEncoder(token_counts.tokenizer_json("byte_bpe_50k.json")), random.Random(1)
    assert e.plain
    parts = ["a", "b", "'", "'s", "'re", "'ll", "'v", "e", " ", "  ", "\n", "\t", "\u3000", "1", "²", "Ⅷ", "é", "日", "🙂", "!", "-", "\x1c", "\x85", "\u200b", "\u0301", "ǅ", "\0", "'S", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    texts += ["a" + chr(p) + "b " + chr(p) + chr(p) + " 1" + chr(p) + "!" for p in [*range(0x3000), *range(0x3000, 0x110000, 61)] if not 0xD800 <= p < 0xE000]
    texts += [" ".join(map(str, range(300_000))), "word " * 300_000, "x" * 100_000, " " * 50_000 + "y"]  # very long ones
    want = e.whole(texts)
    assert all(np.array_equal(a, b) for a, b in zip(e.many(texts), want, strict=True))
    monkeypatch.setattr(byte_bpe, "MOST_ENTRIES", 3000)  # a table that fills up, and batches that do not fit at all
    small = byte_bpe.ByteEncoder(token_counts.tokenizer_json("byte_bpe_50k.json"))
    assert all(np.array_equal(a, b) for i in range(0, len(texts), 200) for a, b in zip(small.many(texts[i : i + 200]), want[i : i + 200], strict=True))


def test_op3_other_files_go_whole():
    e = byte_bpe.ByteEncoder(token_counts.tokenizer_json("word_bpe_49k.json"))
    assert not e.plain and [x.tolist() for x in e.many(["a b", ""])] == [x.tolist() for x in e.whole(["a b", ""])]


def test_op4_media(spark, sf):
    found = result(chunk_store.op4_chunk_media(spark, sf))
    same = defaultdict(set)
    for i, text, *_ in ROWS:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        same[payload].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())


def test_op4_cuts_follow_content():
    r = np.random.default_rng(2)
    data = r.integers(0, 256, 60_000, np.uint8).tobytes()
    h = 0
    for i, b in enumerate(data[:500]):
        h = ((h << 1) + int(chunk_store.GEAR[b])) & 0xFFFFFFFF
        assert h == chunk_store.gear_hashes(data)[i]
    a, b = chunk_store.cut(data), chunk_store.cut(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and max(map(len, a)) <= chunk_store.MAX_CHUNK
    assert len(set(a) & set(b)) > len(a) // 2
    assert [len(c) for c in chunk_store.cut(b"\0" * 40_000)][:2] in ([512, 512], [16384, 16384])


def test_op4_damage_is_found():
    data = b"x" * 64
    manifest = chunk_store.MAGIC + chunk_store.ENTRY.pack(chunk_store.digest(data), 64)
    assert chunk_store.rebuild(chunk_store.digest(data), manifest, b"\0", data, {}) == data
    with pytest.raises(ValueError, match="damaged"):
        chunk_store.rebuild(chunk_store.digest(data), manifest, b"\0", b"y" * 64, {})


def test_op4_form_depends_on_the_payload_alone(spark, tmp_path):
    r = np.random.default_rng(5)
    text = "".join(map(chr, r.integers(97, 123, 40_000)))
    forms = []
    for i, more in enumerate(([], [(2, text[:30_000] + "x"), (3, text + "y")])):
        spark.createDataFrame([(1, text), *more], "doc_id long, text string").write.parquet(f"{tmp_path}/{i}/documents.parquet")
        row = chunk_store.op4_chunk_media(spark, f"{tmp_path}/{i}").where("doc_id = 1").first()
        forms.append((row.media_bytes, row.media_sha256, row.feature))
    assert forms[0] == forms[1]


def test_op4_hot_chunks_and_payloads(spark, sf, monkeypatch):
    want = sorted(map(str, chunk_store.op4_chunk_media(spark, sf).collect()))
    monkeypatch.setattr(chunk_store, "join_counted", lambda *a: common.join_counted(*a, most=1))
    assert sorted(map(str, chunk_store.op4_chunk_media(spark, sf).collect())) == want


def suffix_brute(rows):
    seen, out = set(), {}
    for i, text in sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0]):
        d = (text or "").encode()
        cov = bytearray(len(d))
        for p in range(len(d) - 99):
            if d[p : p + 100] in seen:
                cov[p : p + 100] = b"\1" * 100
            seen.add(d[p : p + 100])
        kept = bytes(b for b, c in zip(d, cov, strict=True) if not c)
        runs = sum(1 for k, c in enumerate(cov) if c and not (k and cov[k - 1]))
        out[i] = (len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_op5_removed_bytes(spark, sf):
    found = result(suffix_dedup.op5_suffix_dedup(spark, sf))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found.items()} == suffix_brute(ROWS)


def spans_of(df):
    return {(r.doc, tuple(r.starts), tuple(r.stops)) for r in df.collect()}


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_hot_anchors_are_split(spark, docs, module):
    from dataclasses import replace

    want = spans_of(repeats.repeated_spans(docs, module.SPEC))
    for most, levels in ((1, 4), (2, 2), (1, 1)):
        assert spans_of(repeats.repeated_spans(docs, replace(module.SPEC, most_segments=most, levels=levels, anew=most == 2))) == want


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_repeats_without_broadcasts(spark, docs, monkeypatch, module):
    want = spans_of(repeats.repeated_spans(docs, module.SPEC))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert spans_of(repeats.repeated_spans(docs, module.SPEC)) == want


def test_anchors_do_not_depend_on_the_documents_length():
    r = np.random.default_rng(3)
    long = r.integers(1, 1 << 63, 300_000, np.uint64)
    for spec in (suffix_dedup.SPEC, substring_dedup.SPEC):
        place, first, last, g, s = repeats.anchors(long, spec)
        for at in (0, 65_400, 65_500, 131_000, 200_000):
            p, f, _, h, _ = repeats.anchors(long[at : at + 1000], spec)
            inner = (f > 0) & (f < 500)
            assert set(zip((p + at)[inner].tolist(), (f + at)[inner].tolist(), h[inner].tolist(), strict=True)) <= set(zip(place.tolist(), first.tolist(), g.tolist(), strict=True))


def test_op7_repeats_are_maximal(spark):
    r = random.Random(6)
    word = lambda: "w" + str(r.randrange(100_000))
    passage = [word() for _ in range(700)]
    texts = [[word() for _ in range(30)] + passage + [word() for _ in range(90)], [word() for _ in range(80)] + passage[100:] + [word()], passage[:300] + [word()] + passage[301:] + [word()]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc: sorted((m.start, m.stop, m.source, m.at) for m in x.matches) for x in repeats.repeats(docs, substring_dedup.SPEC).collect()}
    assert got == {1: [(80, 680, 0, 130)], 2: [(0, 300, 0, 30), (301, 700, 0, 331)]}


def test_op5_groups_have_all_occurrences(spark):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = noise(5000)
    docs = spark.createDataFrame([(i, noise(39 + i) + chr(65 + i) + passage + chr(65 + i) + noise(60)) for i in range(12)] + [(20, noise(900))], "doc_id long, text string")
    found = suffix_dedup.groups(docs).collect()
    assert {(g.source, g.at, g.doc, g.start) for g in found if g["size"] == 5000} == {(0, 40, i, 40 + i) for i in range(12)}
    assert {g["size"] for g in found} == {5000}


def test_op7_repeats_inside_the_first_document(spark):
    """A passage many times in the first document is compared once; all its places take part in what an even earlier one shares."""
    r = random.Random(9)
    word = lambda: "w" + str(r.randrange(100_000))
    line = [word() for _ in range(120)]
    rows = [(1, [word() for _ in range(20)] + line[30:100] + [word() for _ in range(20)]), (2, line * 40), (3, [word()] + line * 3), (4, line[:60] + [word()])]
    rows = [(i, " ".join(t)) for i, t in rows]
    found = {x.doc: (x.starts, x.stops) for x in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"), substring_dedup.SPEC).collect()}
    want = word_brute(rows)
    for i, text in rows:
        assert substring_dedup.kept_words(text, *found.get(i, (None, None)))[0] == want[i][0], i


def test_op5_maximal_repeats():
    strings = [b"xabcabcq", b"yabcabcr", b"zabcs", b"aaaa"]
    text = b"\0".join(strings) + b"\0"
    got = {(n, tuple(sorted(p.tolist()))) for n, p in suffix_dedup.maximal_repeats(strings, 2)}
    want = set()
    pieces = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 2, len(s) + 1)}
    for x in pieces:
        at = [i for i in range(len(text)) if text[i : i + len(x)] == x]
        left = {text[i - 1] if i and text[i - 1] else -i - 1 for i in at}
        right = {text[i + len(x)] or -i - 1 for i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(x), tuple(at)))
    assert got == want


def test_op6_counts_and_cache(spark, sf, tmp_path):
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    found = result(token_counts.op6_token_counts(spark, sf))
    for i, text, *_ in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), n, n > 2048)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cache = f"file://{tmp_path}/cache"
    token_counts.count_tokens(docs.where("doc_id < 20"), cache).count()
    before = spark.read.parquet(cache).count()
    token_counts.count_tokens(docs, cache).count()
    after = spark.read.parquet(cache).count()
    token_counts.count_tokens(docs, cache).count()
    assert before < after == spark.read.parquet(cache).count() == spark.read.parquet(cache).select("digest").distinct().count()


def test_op6_second_run_hits_the_cache(spark, sf, tmp_path, monkeypatch):
    spark.conf.set("spark.tessera.tokenCache", f"file://{tmp_path}/kept")
    try:
        first = sorted(map(str, token_counts.op6_token_counts(spark, sf).collect()))
        size = spark.read.parquet(f"file://{tmp_path}/kept").count()
        assert sorted(map(str, token_counts.op6_token_counts(spark, sf).collect())) == first
        assert spark.read.parquet(f"file://{tmp_path}/kept").count() == size > 0
    finally:
        spark.conf.unset("spark.tessera.tokenCache")


def test_op6_other_tokenizers_count_whole_texts(spark, docs, tmp_path):
    assert token_counts.drops_gaps(token_counts.tokenizer_json("word_bpe_49k.json")) and not token_counts.drops_gaps(token_counts.tokenizer_json("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, f"file://{tmp_path}/bytes", "byte_bpe_50k.json").collect()}
    assert found == {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS}


def test_op6_words_alone():
    t, c = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), token_counts.WordCounter(token_counts.tokenizer_json("word_bpe_49k.json"))
    texts = ["", "a|b | c", "x\x1cy\x1fz", "it's  'll", "é é ́x", "İstanbul ΣΑΣ", "a <|startoftext|> b", " a b　"]
    assert c.many(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def word_brute(rows):
    seen, out = {}, {}
    for i, text in sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0]):
        w = words(text)
        cov = bytearray(len(w))
        mine = [tuple(w[p : p + 50]) for p in range(len(w) - 49)]
        for p, g in enumerate(mine):
            if g in seen:
                cov[p : p + 50] = b"\1" * 50
        for g in mine:
            seen.setdefault(g, i)
        out[i] = [x for x, c in zip(w, cov, strict=True) if not c], len(w)
    return out


def test_op7_removed_words(spark, sf):
    found, want = result(substring_dedup.op7_substring_dedup(spark, sf)), word_brute(ROWS)
    assert any(r["n_removed"] for r in found.values())
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == {i: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, (k, n) in want.items()}


def test_op8_targets(spark, sf):
    found = [r.asDict() for r in mixing.op8_mix_sources(spark, sf).collect()]
    assert len(found) == len(ROWS)
    sizes, weights = Counter(), {}
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), set(order)
    total = 1.5 * sum(sizes.values())
    while True:
        free = total - sum(2 * sizes[s] for s in order if s not in left)
        share = {s: free * weights[s] / sum(weights[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            break
        left -= over
    target = {s: share[s] if s in left else 2.0 * sizes[s] for s in order}
    source = {r[0]: r[3] for r in ROWS}
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    longest = max(len(words(r[1])) for r in ROWS)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    assert sorted(map(str, found)) == sorted(str(r.asDict()) for r in mixing.op8_mix_sources(spark, sf).collect())


def test_op8_rows(spark, docs):
    plan = Counter({(r.doc_id, r.size): 0 for r in mixing.mix_plan(docs).collect()})
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({k: v for k, v in plan.items() if isinstance(k, int) and v})


def test_op9_ids(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = result(spm_codec.op9_sentencepiece(spark, sf))
    for i, text, *_ in ROWS:
        ids = [lib.bos_id(), *lib.encode(text or ""), lib.eos_id()]
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


ODD_TEXTS = ["", "  a  b ", "▁x ▁▁ y", "\n\t x\ny", "é 日本 🙂  ", "a▁", "▁", "  ", " ", "x  ", "<s> </s>", "héllo  日wörld", "abacabé", "ab  ab", "zz q"]


def check_spans(codec, texts):
    for text in texts:
        ids, starts, ends = codec.encode(text)
        pieces = codec.lib.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in pieces], text
        for p, a, b in zip(pieces, starts, ends, strict=True):
            if codec.lib.id_to_piece(p.id)[:3] != "<0x":
                assert (p.begin, p.end) == (a, b), (text, p.piece)


def test_op9_spans():
    codec = spm_codec.OffsetCodec(spm_codec.model_bytes("piece_bpe_32k.model"))
    assert codec.own and codec.by_run
    check_spans(codec, [*ODD_TEXTS, *[r[1] for r in ROWS if r[1]]])
    for text in ODD_TEXTS:
        _, starts, ends = codec.encode(text)
        assert b"".join(text.encode()[a:b] for a, b in zip(starts, ends, strict=True)) == text.encode()


def trie(entries):
    """A small double array for the tests: breadth-first, each node at a base of its own."""
    targets, offsets = b"", {}
    for source, target in entries.items():
        offsets[source] = len(targets)
        targets += target + b"\0"
    units, free = {}, 256
    prefixes = sorted({s[:k] for s in entries for k in range(len(s) + 1)}, key=len)
    bases = {}
    for p in prefixes:
        bases[p], free = free, free + 512
    place = {b"": 0}
    for p in prefixes:
        if p:
            place[p] = bases[p[:-1]] ^ p[-1]
    for p in prefixes:
        step = place[p] ^ bases[p]
        label = p[-1] if p else 0
        packed = (step >> 8 << 10 | 1 << 9) if step & 0xFF == 0 and step >= 1 << 21 else step << 10
        units[place[p]] = packed | (1 << 8 if p in entries else 0) | label
        if p in entries:
            units[bases[p]] = 0x80000000 | offsets[p]
    array = [units.get(i, 0) for i in range((max(units) // 256 + 1) * 256)]
    blob = struct.pack(f"<{len(array)}I", *array)
    return struct.pack("<I", len(blob)) + blob + targets


MAP = {b"a": b"1", b"ab": b"23", "é".encode(): b"e", b"\t": b" ", b"\n": b" ", "日".encode(): b"ni chi", b"q": b""}


def test_op9_longest_prefix_map():
    m = spm_codec.CharMap(trie(MAP))
    assert m.longest(b"abc", 0) == (2, b"23") and m.longest(b"ac", 0) == (1, b"1") and m.longest("é".encode(), 0) == (2, b"e") and m.longest(b"zz", 0) is None
    codec = spm_codec.OffsetCodec(spm_codec.model_bytes("piece_bpe_32k.model"))
    codec.map = m
    data, align = codec.normalise("xab é")
    assert data.decode() == "▁x23▁e" and align.tolist() == [0, 0, 0, 0, 1, 1, 3, 3, 3, 4, 6]


@pytest.mark.parametrize(("dummy", "squeeze"), [(True, False), (True, True), (False, True), (False, False)])
def test_op9_models_with_a_map(dummy, squeeze):
    """Ids and spans of our normalising against the library's own, for models that have a map and squeeze spaces."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    proto = schema.ModelProto()
    proto.ParseFromString(spm_codec.model_bytes("piece_bpe_32k.model"))
    proto.normalizer_spec.precompiled_charsmap, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = trie(MAP), dummy, squeeze
    codec = spm_codec.OffsetCodec(proto.SerializeToString())
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "ab", "b", "é", " ", "  ", "\t", "日", "q", "x", "▁", "🙂"]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    for text in [*ODD_TEXTS, *texts]:
        assert codec.encode(text)[0] == codec.lib.encode(text), (text, codec.normalise(text))
        for a, b in zip(*codec.encode(text)[1:], strict=True):
            assert 0 <= a <= b <= len(text.encode())


def test_op10_scores(spark, sf):
    found = result(pu_quality.op10_pu_quality(spark, sf))
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op10_learns_from_positives():
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 0.5, (600, 4)), r.normal(-1, 0.5, (200, 4))
    model = pu_quality.fit(good[:300], np.concatenate([good[300:], bad]), 0.6)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95
    assert pu_quality.fit(good[:0], good, 0.5) is None


def test_op10_labels_held_out_are_not_read(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = pu_quality.train(docs, labels), pu_quality.train(docs, flipped)
    assert a[1] == b[1] and all(np.array_equal(x, y) for x, y in zip(a[0].weights, b[0].weights, strict=True))


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, no_sf, name):
    from tessera.llm.queries import queries

    query = next(f for k, f in queries().items() if k.startswith(name + "_"))
    assert query(spark, no_sf).count() == 0


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_null_ids(spark, tmp_path, name):
    from tessera.llm.queries import queries

    spark.createDataFrame([(None, None, None, None, None), (None, "a b " * 80, None, None, 3), (1, "a b " * 80, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    query = next(f for k, f in queries().items() if k.startswith(name + "_"))
    assert sorted(r.doc_id or 0 for r in query(spark, str(tmp_path)).select("doc_id").collect()) == [0, 0, 1]


CLASHES = "gone_ gone row size words doc twin d_ t_ s_ c_ salt copies digest normal key node family label score payload label_ n rank hash starts stops kept component_id n_words base_failed ids spans".split()
LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(1_000_000))


@pytest.fixture(scope="module")
def odd_sf(spark, tmp_path_factory):
    """A text of a million words, an earlier copy of its end, one word of a million letters; columns with names that the operators use."""
    path, tail = tmp_path_factory.mktemp("odd"), LONG[-3000:].split(" ", 1)[1]
    texts = ["start " + tail, LONG, "x" * 1_000_000, None, "", LONG]
    rows = [(i if i != 4 else None, t, ["en", None][i % 2], ["a", None][i % 2], 5, *["c"] * len(CLASHES)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0, "c"), (1, 0, 0, "c")], "doc_id long, quality int, toxic int, label string").write.parquet(f"{path}/labels.parquet")
    return str(path), texts


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_long_texts_and_clashing_columns(spark, odd_sf, name):
    from tessera.llm.queries import queries

    path, texts = odd_sf
    query = next(f for k, f in queries().items() if k.startswith(name + "_"))
    found = {r["doc_id"]: r.asDict() for r in query(spark, path).collect()}
    assert set(found) == {0, 1, 2, 3, None, 5}
    tail = texts[0].split()[1:]
    if name == "op1":
        assert [found[i]["n_words"] for i in (0, 1, 2, 3, None)] == [len(tail) + 1, 1_000_000, 1, 0, 0]
    if name == "op2":
        assert [found[i]["component_id"] for i in (0, 1, 2, 3, 5)] == [0, 1, 2, 3, 1]
    if name == "op3":
        t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        ids = np.array([*t.encode(LONG, add_special_tokens=False).ids, 0], "<u4")
        assert found[1]["ids_crc32"] == found[5]["ids_crc32"] == zlib.crc32(ids.tobytes()) and found[5]["start"] - found[1]["start"] > len(ids)
    if name == "op4":
        assert found[1]["payload_sha256"] == hashlib.sha256(LONG.encode() + b"\0" * (-len(LONG) % 64)).hexdigest()
    if name == "op5":
        assert found[5]["n_removed"] == len(LONG) and found[1]["n_removed"] >= len(" ".join(tail))
    if name == "op6":
        t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
        assert found[1]["n_tokens"] == len(t.encode(LONG, add_special_tokens=False).ids)
    if name == "op7":
        assert found[5]["n_removed"] == 1_000_000 and found[1]["n_removed"] >= len(tail) and found[0]["n_removed"] == 0
    if name == "op8":
        assert found[1]["size"] == 1_000_000 and found[2]["size"] == 1
    if name == "op9":
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        assert found[1]["ids_sha256"] == hashlib.sha256(np.array([lib.bos_id(), *lib.encode(LONG), lib.eos_id()], "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_stages_keep_the_columns(spark, odd_sf, no_sf, which):
    import corpus_pipeline as c

    path = odd_sf[0] if which == "odd" else no_sf
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        after = common.materialize(stage(spark, frame, path), "stage")
        assert after.schema.simpleString() == frame.schema.simpleString(), name
        frame = after
    assert c.run(spark, path).count() == frame.count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_op10_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = pu_quality.op10_pu_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_op10_prior_needs_positives_only(spark, sf, docs):
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 0.5, (4000, 4)), r.normal(-1, 0.5, (1500, 4))
    assert abs(pu_quality.estimate_prior(good[:1500], np.concatenate([good[1500:], bad])[r.permutation(4000)]) - 0.625) < 0.08
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    a, b = pu_quality.train(docs, labels), pu_quality.train(docs, labels.where("quality = 1"))
    assert a[1] == b[1] < 1 and all(np.array_equal(x, y) for x, y in zip(a[0].weights, b[0].weights, strict=True))


def test_op10_tiny_shares_still_draw(spark):
    """A share far below 2**-20 keeps its resolution; samples are bounded by rows, copies of a row count once."""
    rows = spark.range(200_000).selectExpr("id as doc_id", "cast(id as string) as text", "0 as label")
    assert 20 < pu_quality.drawn(rows, "u", 60).count() < 120
    assert pu_quality.drawn(rows.withColumn("doc_id", F.lit(1).cast("long")).withColumn("text", F.lit("same")), "u", 300_000).count() == 1
    assert int(1e-12 * (1 << 63)) > 1_000_000


def test_pipeline_matches_brute_force(spark, sf, docs):
    import corpus_pipeline as c

    kept = {r.doc_id: r.text for r in quality_rules.keep_good(docs).collect()}
    assert set(kept) == {r.doc_id for r in quality_rules.op1_quality_rules(spark, sf).where("kept").collect()}
    _, groups = near_groups([(i, t) for i, t in kept.items()], size=5)
    first = {i: t for i, t in kept.items() if groups[i] == i}
    cut = {i: (k, n) for i, (k, n) in word_brute([(i, t) for i, t in first.items()]).items()}
    texts = {i: first[i] if n == len(k) else b" ".join(k).decode() for i, (k, n) in cut.items() if k}
    frame = docs
    for name, stage in c.STAGES[:3]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs.columns, name
    assert {(r.doc_id, r.text) for r in frame.collect()} == set(texts.items())
    mixed = Counter(r.doc_id for r in c.STAGES[3][1](spark, frame, sf).collect())
    assert Counter(r.doc_id for r in c.run(spark, sf).collect()) == mixed and set(mixed) <= set(texts)
    plan = Counter()
    for r in mixing.mix_plan(frame).collect():
        plan[r.doc_id] += r.copies
    assert mixed == +plan
