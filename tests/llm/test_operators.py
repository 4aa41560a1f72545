"""Every operator against a plain version of its contract, on the small tables and on awkward rows."""

import base64
import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from ledgerlake.llm import ann, bpe, langid, lines, matroska, packing, quality, simhash, substrings, token_counts
from ledgerlake.llm import queries as q
from ledgerlake.llm.common import join_by_key, read_table, shared_dir, text_chunks
from ledgerlake.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, fp string, score double"
LONG = " ".join(f"w{k % 977}é" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
AWKWARD = [
    (1, None, "en", None, None, "c", None, 0.5),
    (2, "", None, "s", 0, "c", "f", None),
    (3, " \t\n ", "en", "s", 4, None, None, None),
    (4, LONG, "xx", "s", len(LONG), None, None, None),
    (5, LONG, "xx", "s", len(LONG), None, None, None),
    (6, "one two", "en", "s", 7, None, None, None),
    (6, "one two", "en", "s", 7, None, None, None),
    (None, "ONE two", "en", "s", 7, None, None, None),
    (7, "1234 !!! ***", "en", "s", 12, None, None, None),
    (8, "first " + PASSAGE + " last\nx\ny\nz\nx\ny\nz", "en", "s", 9, None, None, None),
    (9, "other " + PASSAGE + " end\u0085of it <|endoftext|> \x1c é ẛ̣", "en", "s", 9, None, None, None),
    (10, "s" * 70_000, "en", "s", 70_000, None, None, None),
    (11, "\n".join(f"line {k}" for k in range(40)), "en", "s", 1, None, None, None),
    (12, "new line\n" + "\n".join(f"line {k}" for k in range(40)) + "\nend", "en", "s", 1, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@pytest.fixture(params=["docs", "awkward"])
def table(request):
    return request.getfixturevalue(request.param)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: tuple((x is None, x) for x in r))


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_words_are_ascii_white_space():
    for text in (r["text"] for r in [{"text": t[1]} for t in AWKWARD]):
        assert words(text) == re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_id(spark, sf_dir, docs, awkward):
    model = langid.fit_language_model(docs)
    got = langid.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in langid.identify_language(awkward, model).collect():
        text = next(t[1] for t in AWKWARD if t[0] == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    empty = docs.limit(0)
    assert langid.identify_language(awkward, langid.fit_language_model(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify_language(empty, model).count() == 0


def test_byte_bpe(table):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in table.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bpe.digests(bpe.encode_decode(table, path, public_tokenizers.PATTERN, chunk_bytes=50_000))
    assert rows_of(got) == sorted(expected, key=lambda r: tuple((x is None, x) for x in r))
    assert bpe.digests(bpe.encode_decode(table.limit(0), path, public_tokenizers.PATTERN)).count() == 0


def plain_fingerprint(text, size):
    ws = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [" ".join(ws[k : k + size]) for k in range(len(ws) - size + 1)] if len(ws) >= size else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, linked):
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(table):
    rows = [(r["doc_id"], plain_fingerprint(r["text"], 3)) for r in table.collect()]
    root = groups({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for i, f in rows:
        least[root[f]] += [] if i is None else [i]
    expected = [(i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in rows]
    for shard in (20_000, 16):
        assert rows_of(simhash.near_duplicates(table, shard_rows=shard)) == sorted(expected, key=lambda r: tuple((x is None, x) for x in r))
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_vantage_search_misses_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1500).astype(np.uint64)
    near = base[:700].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    prints = np.unique(np.concatenate([base, near]))
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    for bits in (1, 3, 6):
        df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
        got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, bits, shard_rows=100), "fp", "rep").collect()}
        pairs = [(a, b) for a, b in zip(*np.nonzero(far <= bits), strict=True) if a < b]
        label = simhash._united(np.arange(len(prints)), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        signed = prints.view(np.int64)
        expected = {}
        for k in range(len(prints)):
            members = np.flatnonzero(label == label[k])
            if len(members) > 1:
                expected[int(signed[k])] = int(signed[members].min())
        assert got == expected


def test_levels_beyond_the_sample_lose_no_ball():
    """A tree far deeper than its sample allows: whatever lies within the radius is asked in the leaf where it lives."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    prints = np.concatenate([base, near])
    for mask in (*simhash._HALVES, simhash._ALL):
        tree = simhash.VantageTree(base[:40], mask, 9, 1)
        assert tree.fitted < 5
        row, leaf, home = tree.route(prints, 1)
        lives = dict(zip(row[home].tolist(), leaf[home].tolist(), strict=True))
        assert len(lives) == home.sum() == 800 and len(set(lives.values())) > 100
        asked = set(zip(row.tolist(), leaf.tolist(), strict=True))
        assert all((k + 400, lives[k]) in asked and (k, lives[k + 400]) in asked for k in range(400))


def test_components_on_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_keep_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(3000)]
    texts = [[str(w) for w in rng.choice(vocabulary, 300)] for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(10):  # near copies: two words differ
        copy = list(texts[k])
        copy[50], copy[200] = "changed", "again"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200, rows[0][1]), (None, rows[1][1]), (300, None), (301, ""), (302, "  ")]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=4).collect()}
    assert kept == set(range(40)) | {300}


def test_near_duplicates_are_decided_on_the_sets(spark):
    """Against brute force, over pairs of a similarity of 0.7 to 0.9 and texts with long repeated passages."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(150):
        text = [f"w{x}" for x in rng.integers(0, 5000, int(rng.choice([5, 9, 40, 200, 400])))]
        copy = list(text)
        for _ in range(1 + len(text) // 50):
            copy[int(rng.integers(len(copy)))] = f"new{rng.integers(9)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy if k % 3 else [*text, *text[:20] * 9]))]
    sets = [{tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    scores = [(len(a & sets[j]) / len(a | sets[j]), i, j) for i, a in enumerate(sets) for j in range(i)]
    for score, i, j in scores:
        if score >= 0.8:
            one, two = root[i], root[j]
            root = [min(one, two) if x in (one, two) else x for x in root]
    assert sum(0.7 <= s < 0.8 for s, _, _ in scores) > 10 < sum(0.8 <= s < 0.9 for s, _, _ in scores)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one_of_each_group(table).collect()} == set(root)


def test_blocks_of_a_large_group_find_all_links(spark):
    text = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*text[3 * k :], *(f"n{x}" for x in range(3 * k))])) for k in range(30)]  # a chain of links
    stamped = simhash.with_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 5, "fp", "wide", "size", "vertex").selectExpr("*", "1L AS component")
    plain, dealt = (connected_components(simhash.exact_links(simhash.with_blocks(stamped, rows=n), 5, 256, 0.8), "vertex", "rep") for n in (1000, 4))
    assert plain.count() == 30 and rows_of(plain) == rows_of(dealt)


def test_token_counts(spark, table, tmp_path):
    import sentencepiece

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows_of(token_counts.count_tokens(table, path, cache))
    expected = [(r["doc_id"], len((r["text"] or "").encode()), n := len(plain.encode(r["text"] or "")), n > 4096) for r in table.collect()]
    assert got == sorted(expected, key=lambda r: tuple((x is None, x) for x in r))
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len({r["text"] or "" for r in table.collect()})
    assert rows_of(token_counts.count_tokens(table, path, cache)) == got
    assert token_counts.read_cache(spark, cache).count() == stored  # nothing was encoded again
    assert token_counts.count_tokens(table.limit(0), path, cache).count() == 0


def test_the_query_goes_on_with_a_named_cache(spark, sf_dir, tmp_path):
    spark.conf.set("spark.ledgerlake.token_counts", str(tmp_path / "kept"))
    try:
        first = rows_of(q.op4_token_counts(spark, sf_dir))
        stored = token_counts.read_cache(spark, str(tmp_path / "kept")).count()
        assert stored > 0 and rows_of(q.op4_token_counts(spark, sf_dir)) == first
        assert token_counts.read_cache(spark, str(tmp_path / "kept")).count() == stored
    finally:
        spark.conf.unset("spark.ledgerlake.token_counts")
    assert rows_of(q.op4_token_counts(spark, sf_dir)) == first


def test_stored_counts_are_used_and_versions_kept_apart(spark, awkward, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    honest = rows_of(token_counts.count_tokens(awkward, path, cache))
    other = token_counts.read_cache(spark, cache).selectExpr("digest", "'another tokenizer' AS version", "n_tokens + 1 AS n_tokens").collect()
    spark.createDataFrame(other, token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert rows_of(token_counts.count_tokens(awkward, path, cache)) == honest
    marked = str(tmp_path / "marked")
    token_counts.read_cache(spark, cache).where("version <> 'another tokenizer'").selectExpr("digest", "version", "n_tokens + 1000000 AS n_tokens").write.parquet(marked)
    assert all(r["n_tokens"] >= 1_000_000 for r in token_counts.count_tokens(awkward, path, marked).collect())


def test_packing(table):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    pieces = packing.pack_documents(table, path, windows=4).collect()
    texts = Counter()
    for r in table.collect():
        texts[r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"] > 0
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for (ident, total), own in by_doc.items():
        at, filled = 0, Counter()
        for p in own:
            filled[p["start"]] += 1
            at += p["length"]
        copies = [k for k in texts if k[0] == ident and len(k[1]) == total]
        assert at == total * sum(texts[k] for k in copies)
        if sum(texts[k] for k in copies) == 1:
            ids = b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: p["start"]))
            assert tuple(np.frombuffer(ids, "<u4").tolist()) == copies[0][1]
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    used = sum(p["length"] for p in pieces)
    assert len(sequences) * 4096 - used < 4096 + 0.02 * used
    assert packing.pack_documents(table.limit(0), path).count() == 0


def plain_repeats(texts, window):
    where = defaultdict(list)
    split = [words(t) for t in texts]
    for d, ws in enumerate(split):
        for k in range(len(ws) - window + 1):
            where[" ".join(ws[k : k + window])].append((d, k))
    gone = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, k in places:
                gone[d] |= set(range(k, k + window))
    return split, gone


def test_substrings(table):
    rows = table.collect()
    split, gone = plain_repeats([r["text"] for r in rows], 35)
    expected = [(r["doc_id"], len(ws), len(gone[d]), " ".join(w for k, w in enumerate(ws) if k not in gone[d])) for d, (r, ws) in enumerate(zip(rows, split, strict=True))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert rows_of(substrings.remove_repeats(table)) == sorted(expected, key=key)
    assert substrings.remove_repeats(table.limit(0)).count() == 0


def test_substrings_in_many_chunks(docs, monkeypatch):
    whole = rows_of(substrings.remove_repeats(docs))
    kind = "doc_id long, n_words long, n_removed long, kept string"
    import pyarrow as pa

    def make(t, covered):
        kept = [b" ".join(w for w, c in zip((x or "").encode().split(), m.tolist(), strict=True) if not c).decode() for x, m in zip(t.column("text").to_pylist(), covered, strict=True)]
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array([len(m) for m in covered], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in covered], pa.int64()), "kept": pa.array(kept, pa.string())})

    for depth, cells in ((1, 1), (2, 4)):
        assert rows_of(substrings.repeated_spans(docs.select("doc_id", "text"), 35, make, kind, chunk_bytes=20_000, depth=depth, cells_per_window=cells)) == whole


def test_cut_passages_keeps_the_rest(awkward):
    got = {r["doc_id"]: r for r in substrings.drop_repeats_from_texts(awkward.where("doc_id in (1, 8, 9)"), 50).collect()}
    assert got[8]["text"].startswith("first last\nx") and got[9]["text"].startswith("other end\u0085of")
    assert got[8]["n_chars"] == len(got[8]["text"]) and got[1]["text"] is None and got[9]["chunk"] is None


def plain_chunks(ls):
    """(first, after) by six chunkings: a chunk of two lines or more ends where bit 7 * c of the hash of the last two lines is zero."""
    hashes = [xxhash.xxh64_intdigest(x.encode(), 7) for x in ls]
    turned = lambda x: (x << 1 | x >> 63) & (2**64 - 1)
    out = set()
    for c in range(6):
        first = 0
        for k, h in enumerate(hashes):
            own = h ^ (turned(hashes[k - 1]) if k else 0)
            if k > first and (k == len(ls) - 1 or (own >> (7 * c)) % 2 == 0):
                out.add((first, k + 1))
                first = k + 1
    return sorted(out)


def plain_line_dedup(rows):
    """(doc_id, lines removed, text) of rows with ids of their own, in order: what was seen before goes."""
    seen, out = {}, []
    for ident, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out.append((ident, 0, None))
            continue
        ls, gone = text.split("\n"), set()
        for a, b in plain_chunks(ls):
            first = seen.setdefault(tuple(ls[a:b]), (ident, b))
            if first != (ident, b) and not (first[0] == ident and a < first[1]):
                gone |= set(range(a, b))
        out.append((ident, len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return out


def test_line_dedup(spark, table):
    """The text of every row, at two sizes of chunks of documents."""
    rows = list({r["doc_id"]: (r["doc_id"], r["text"]) for r in table.collect()}.values())
    rows += [(10_000_001, rows[-1][1]), (10_000_002, "a\nb\nc\nd\na\nb\nc\nd\n\n\n\n"), (10_000_003, "\n" * 9), (10_000_004, "x\ra\u2028b\x85\nc")]
    want = sorted(plain_line_dedup(rows), key=str)
    unique = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (20_000, 24_000_000):
        got = lines.dedup_lines(unique, counts="lines_removed", chunk_bytes=size, stable=size > 20_000)
        assert sorted(((r["doc_id"], r["lines_removed"], r["text"]) for r in got.collect()), key=str) == want
    assert sum(n for _, n, _ in want) > 20
    assert lines.dedup_lines(table.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows_and_clashing_columns(spark):
    text = "\n".join(f"row {k}" for k in range(12))
    rows = [(20, text, 1, len(text)), (20, text, 2, len(text)), (None, text, 3, len(text)), (21, text + "\nmore", 4, 0), (None, None, 5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, chunk long, n_chars long")
    got = rows_of(lines.dedup_lines(table, counts="CHUNK", chunk_bytes=50))
    assert sorted(got[0].asDict()) == ["CHUNK", "doc_id", "n_chars", "text"]
    kept = [r for r in got if r["text"] and r["text"].startswith("row 0")]
    assert len(got) == 5 and len(kept) == 1 and kept[0]["doc_id"] == 20 and kept[0]["CHUNK"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    spread = {r[0] for r in text_chunks(spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string"), "text", 100, True)[0].select("chunk").collect()}
    assert len(spread) > 15  # repeated rows do not meet in one chunk


def test_line_chunk_boundaries_resist_shifts():
    text = "\n".join(f"line {k * k}" for k in range(200))
    for c in range(6):
        one = lambda t: {tuple(ls[a:b]) for ls in [t.split(b"\n")] for a, b in lines.line_chunks(ls, c + 1)}  # noqa: E731, B023
        assert len(one(text.encode()) - one(b"inserted\n" + text.encode())) <= 3 * (c + 1)
    hashes = lines.rolling_hashes(text.encode().split(b"\n"))
    assert lines.rolling_hashes(text.encode().split(b"\n")[50:])[1:] == hashes[51:]  # two lines and no others


def test_share_of_repeated_lines_that_goes(spark):
    """Passages in the middle of different texts, and runs of one line, against a brute-force count of repeated runs."""
    rng = np.random.default_rng(4)
    share = {}
    for size in (4, 6, 10, 20):
        passages = [[f"p{size} {k} {x}" for x in range(size)] for k in range(100)]
        own = lambda: [f"own {x}" for x in rng.integers(0, 1 << 60, int(rng.integers(1, 6)))]
        texts = [[*own(), *p, *own()] for p in passages for _ in range(2)]
        first, repeated = set(), 0
        for ls in texts:
            pairs = list(zip(ls, ls[1:], strict=False))
            repeated += len({k for at, x in enumerate(pairs) if x in first for k in (at, at + 1)})
            first |= set(pairs)
        assert repeated == 100 * size
        table = spark.createDataFrame([(k, "\n".join(ls)) for k, ls in enumerate(texts)], "doc_id long, text string")
        share[size] = sum(r["n"] for r in lines.dedup_lines(table, counts="n").collect()) / repeated
    # measured over 400 passages of each size: 0.17, 0.41, 0.64, 0.82
    assert share[4] > 0.65 and share[6] > 0.75 and share[10] > 0.88 and share[20] > 0.94, share
    runs = spark.createDataFrame([(k, "\n".join([f"head {k}", *[f"again {k % 5}"] * (20 + k)])) for k in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in lines.dedup_lines(runs, counts="n").collect()}
    assert sum(got.values()) > 0.8 * sum(20 + k for k in range(20))


def test_nine_tenths_of_repeated_lines_go(spark):
    """Lines of sf0.1 in runs of two or more that stand in an earlier place, against those that go."""
    docs = read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    seen, repeated = {}, 0
    for ident, text in sorted(map(tuple, docs.where("text IS NOT NULL").collect())):
        ls, here = text.split("\n"), set()
        for at, pair in enumerate(zip(ls, ls[1:], strict=False)):
            first = seen.setdefault(pair, (ident, at))
            here |= {at, at + 1} if first[0] != ident or at > first[1] + 1 else set()
        repeated += len(here)
    gone = sum(r["n"] for r in lines.dedup_lines(docs, counts="n", stable=True).collect())
    assert repeated > 10_000 and 0.9 < gone / repeated <= 1


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def test_nearest(spark, sf_dir):
    table = read_table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in table.collect()]
    ids = np.array([i for i, _ in rows])
    matrix = np.stack([v for _, v in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    hits = total = 0
    got = defaultdict(list)
    for r in ann.nearest(table, leaf_rows=64, leaves=24).collect():
        got[r["query_id"]].append(r)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for query, found in got.items():
        found.sort(key=lambda r: r["rank"])
        scores = unit @ unit[ids == query][0]
        order = [int(i) for i in ids[np.lexsort((ids, -scores))] if i != query][:5]
        hits += len(set(order) & {r["vec_id"] for r in found})
        total += 5
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        for r in found:
            assert abs(r["score"] - float(scores[ids == r["vec_id"]][0])) < 1e-12
    assert hits / total >= 0.9


def test_nearest_on_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (50, [0.0, 1.0]), (7, [1.0, 0.0]), (8, []), (7, [1.0, 0.0])]
    got = rows_of(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 1.0), (0, 4, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0), (50, 4, 7, 0.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_other_lengths_have_neighbours_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.0, 1.0]), (100, [1.0]), (150, [2.0, 0.0, 0.0])]
    got = rows_of(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (50, 1, 150), (50, 2, 51), (150, 1, 50), (150, 2, 51)]


def test_queries_with_few_vectors_in_their_leaves_get_all_their_rows(spark):
    """One leaf of one vector or so is opened: what is missing comes from the whole table."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(table, trees=1, leaf_rows=1, leaves=1, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: len(x) for q, x in got.items()} == {q: 5 for q in (0, 50, 100, 150)}
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    exact = sum([v for _, v, _ in sorted(got[q])] == [int(x) for x in np.argsort(-(unit @ unit[q])) if x != q][:5] for q in got)
    assert exact >= 3  # a leaf that holds five others may miss a nearer one
    few = ann.nearest(table.where("vec_id < 3"), trees=1, leaf_rows=1, leaves=1, k=5).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]


def test_vectors_of_one_direction_are_dealt_into_blocks(spark):
    """A third of all vectors differ in length only, so that no plane parts them: every block is asked."""
    rng = np.random.default_rng(9)
    spot = rng.normal(size=16)
    matrix = np.concatenate([spot * 2.0 ** np.arange(-450, 450)[:, None], rng.normal(size=(2100, 16))])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    tree = ann.ProjectionTree(unit, 6, 5)
    assert max(tree.blocks(leaf, 3000, 100) for leaf in tree.share) >= 10
    got = defaultdict(set)
    for r in ann.nearest(table, leaf_rows=50, block_rows=100).collect():
        got[r["query_id"]].add((r["vec_id"], round(r["score"], 12)))
    hits = 0
    for query in range(0, 3000, 50):
        scores = unit @ unit[query]
        scores[query] = -9
        fifth = np.sort(scores)[-5]
        assert len(got[query]) == 5 and len({i for i, _ in got[query]}) == 5
        hits += sum(s >= fifth - 1e-11 for _, s in got[query])
    assert hits / 300 >= 0.9


def test_recall_without_opening_all_leaves(spark):
    """The registered parameters but for smaller leaves, on vectors without structure and on copies with noise."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(150, 64))
    for name, matrix in (("isotropic", rng.normal(size=(12_000, 64))), ("noisy copies", centres[rng.integers(0, 150, 12_000)] + 0.4 * rng.normal(size=(12_000, 64)))):
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        trees = [ann.ProjectionTree(unit, 9, 5 + t) for t in range(8)]
        block = unit[:3200:50]
        truth = [(j, unit[i]) for j, q in enumerate(range(0, 3200, 50)) for i in np.argsort(-(unit @ unit[q]))[1:6]]
        leaves = ann.leaves_for(0.95, trees, block, truth, 16 * 10)
        assert leaves < 8 * 512, name
        homes = np.stack([t.leaves(unit) for t in trees], axis=1)
        hits = 0
        for query in range(6000, 12_000, 100):  # not those that the number of leaves was fitted on
            opened = set(ann.search_leaves(trees, unit[query], leaves))
            hits += sum(any((t, int(leaf)) in opened for t, leaf in enumerate(homes[i])) for i in np.argsort(-(unit @ unit[query]))[1:6])
        assert hits / 300 >= 0.9, (name, leaves, hits)


def test_leaves_follow_from_measured_recall(spark):
    """Many small leaves: 16 a level hold too few neighbours, so the search must widen by itself."""
    matrix = np.random.default_rng(6).normal(size=(4000, 64))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(table, leaf_rows=4).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    hits = sum(len(set(np.argsort(-(unit @ unit[q]))[1:6].tolist()) & got[q]) for q in range(0, 4000, 50))
    assert hits / (5 * 80) >= 0.9


def test_quality(spark, sf_dir, awkward):
    big = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, big, "documents"), read_table(spark, big, "labels")
    model = quality.fit_quality_model(docs, labels)
    got = quality.classify_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    for r in quality.classify_quality(awkward, model).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert quality.classify_quality(docs.limit(0), model).count() == 0
    blank = quality.fit_quality_model(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify_quality(awkward, blank).collect()} == {0.5}


def frames_of(data):
    """An independent reader: the samples of an audio file, element by element, by the published layout."""

    def number(at, keep):
        width = next(w for w in range(1, 9) if data[at] >> (8 - w))
        value = int.from_bytes(data[at : at + width], "big")
        return (value if keep else value & ((1 << (7 * width)) - 1)), at + width

    out, counts, todo = [], Counter(), [(0, len(data))]
    while todo:
        at, end = todo.pop()
        if at == end:
            continue
        ident, body = number(at, True)
        size, body = number(body, False)
        todo.append((body + size, end))
        counts[ident] += 1
        if ident in (0x18538067, 0x1F43B675):  # segment, cluster
            todo.append((body, body + size))
        elif ident == 0xA3:
            assert data[body] == 0x81
            lacing, at, stop = data[body + 3] >> 1 & 3, body + 4, body + size
            sizes, n = [], 1
            if lacing:
                n, at = data[at] + 1, at + 1
            if lacing == 1:
                for _ in range(n - 1):
                    total = 0
                    while data[at] == 255:
                        total, at = total + 255, at + 1
                    sizes.append(total + data[at])
                    at += 1
            elif lacing == 3:
                first, at = number(at, False)
                sizes.append(first)
                for _ in range(n - 2):
                    start = at
                    step, at = number(at, False)
                    sizes.append(sizes[-1] + step - ((1 << (7 * (at - start) - 1)) - 1))
            elif lacing == 2:
                sizes = [(stop - at) // n] * (n - 1)
            for x in [*sizes, stop - at - sum(sizes)]:
                out.append((body, data[at : at + x]))
                at += x
            assert at == stop
    return b"".join(x for _, x in out), counts, len(out)


def test_matroska(spark, table):
    """The stored bytes, read by another reader, give the payload; the query's columns describe those bytes."""
    stored = matroska.store_texts(table, batch_bytes=50_000)
    files = Counter((r["doc_id"], r["n_bytes"], bytes(r["media"])) for r in stored.collect())
    texts = Counter((r["doc_id"], r["text"] or "") for r in table.collect())
    want, seen = Counter(), Counter()
    for (ident, n, media), times in files.items():
        payload, elements, packets = frames_of(media)
        assert len(payload) % 64 == 0 < len(payload) and not payload[n:].strip(b"\0") and len(payload) - n <= 64
        assert elements[0x1C53BB6B] == elements[0x1654AE6B] == 1
        seen[ident, payload[:n].decode()] += times
        samples = np.frombuffer(payload, np.uint8)
        p = np.bincount(samples)[np.bincount(samples) > 0] / len(samples)
        feature = {"tracks": 1, "clusters": elements[0x1F43B675], "packets": packets, "mean": round(float(samples.mean()), 4), "entropy": round(float(-(p * np.log2(p)).sum()), 4)}
        want[ident, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature, sort_keys=True), None] += times
    assert seen == texts
    got = Counter()
    for r in matroska.read_features(stored).collect():
        told = json.loads(r["feature"])
        assert told["cues_ok"] and told["cues"] == told["clusters"]
        told = {k: told[k] for k in ("tracks", "clusters", "packets", "mean", "entropy")}
        got[r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], json.dumps(told, sort_keys=True), r["error"]] += 1
    assert got == want
    assert matroska.read_features(matroska.store_texts(table.limit(0))).count() == 0


def test_hostile_files_give_error_rows(spark):
    good = matroska.write_matroska(bytes(range(256)) * 100)
    nested = b""
    for _ in range(3000):
        nested = matroska.element(matroska.BLOCK_GROUP, nested)
    late = matroska.element(matroska.CLUSTER, bytes.fromhex("e788ffffffffffffffff") + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0\0abc"))
    slow = matroska.element(matroska.INFO, bytes.fromhex("2ad7b1887fffffffffffffff")) + matroska.element(matroska.CLUSTER, bytes.fromhex("e7887fffffffffffffff") + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x7f\xff\0abc"))
    odd = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, matroska.element(matroska.AUDIO, matroska.element(matroska.RATE, b"\1\2\3"))))
    bad = [nested, late, slow, odd, None, b"\0", good[:-1], b"\x1a\x45\xdf\xa3\x90"]
    files = spark.createDataFrame([(k, 0, x) for k, x in enumerate([*bad, good])], "doc_id long, n_bytes long, media binary")
    told = {r["doc_id"]: r for r in matroska.read_features(files).collect()}
    assert all(told[k]["error"] and told[k]["payload_sha256"] is None for k in range(len(bad))) and told[len(bad)]["error"] is None
    assert {r["doc_id"] for r in matroska.packet_table(files).where("error IS NOT NULL").collect()} == set(range(len(bad)))
    rng = np.random.default_rng(2)
    for _ in range(3000):  # cut and flipped bytes
        data = bytearray(good[: int(rng.integers(1, len(good)))])
        for at in rng.integers(0, min(len(data), 300), 3):
            data[at] = int(rng.integers(256))
        try:
            matroska.packets_of(matroska.parse_matroska(bytes(data)))
        except ValueError:
            pass


def test_matroska_packets(spark):
    payload = bytes(range(256)) * 1100
    m = matroska.parse_matroska(matroska.write_matroska(payload, frame=700, lace=5, blocks=4))
    assert b"".join(matroska.write_matroska(payload, frame=700, lace=5, blocks=4)[s : s + n] for *_, s, n in m.packets) == payload
    assert m.doc_type == "matroska" and m.tracks == [{"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "depth": 8, "duration": 87_500_000}]
    assert [c for _, _, c in m.cues] == m.clusters
    times = [t for _, t, *_ in m.packets]
    assert times == sorted(times) and times[-1] >= 1000 * (len(payload) - 700) // 8000 - 1
    laced = matroska.parse_matroska(matroska.write_matroska(bytes(8192)))
    assert [t for _, t, *_ in laced.packets] == [128 * k for k in range(8)]
    # without a default duration, plain samples say how long they last; a reference before or after its block ends its key flag
    audio = matroska.element(matroska.AUDIO, matroska.element(matroska.RATE, b"\x45\xfa\x00\x00") + matroska.element(matroska.CHANNELS, 2) + matroska.element(matroska.DEPTH, 16))
    tracks = [matroska.element(matroska.TRACK, matroska.element(matroska.TRACK_NUMBER, 2) + (matroska.element(matroska.CODEC, "A_PCM/INT/LIT") if pcm else b"") + audio) for pcm in (True, False)]
    lace = matroska.element(matroska.BLOCK, b"\x82\x00\x05\x04\x01" + bytes(2 * 640))
    groups = [matroska.element(matroska.BLOCK_GROUP, x) for x in (lace, lace + matroska.element(matroska.REFERENCE, 1), matroska.element(matroska.REFERENCE, 1) + lace)]
    for track, steps in zip(tracks, (20, 0), strict=True):
        m = matroska.parse_matroska(matroska.element(matroska.SEGMENT, matroska.element(matroska.TRACKS, track) + matroska.element(matroska.CLUSTER, b"".join(groups))))
        assert [p[1:3] for p in m.packets] == [(5, True), (5 + steps, True), (5, False), (5 + steps, False), (5, False), (5 + steps, False)]
    # a cluster and a segment of unknown size, a block group, an element to skip
    block = matroska.element(matroska.BLOCK, b"\x82\x00\x05\x00abc")
    body = matroska.element(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, block + matroska.element(0x9B, 3)) + matroska.element(0xEC, b"xx")
    data = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, "webm")) + bytes.fromhex("18538067ff1f43b675ff") + body + bytes.fromhex("1f43b675ff") + body
    assert [(p[0], p[1], data[p[4] : p[4] + p[5]]) for p in matroska.parse_matroska(data).packets] == [(2, 12, b"abc")] * 2
    files = spark.createDataFrame([(1, data), (2, data[:-6]), (3, None), (4, b"")], "doc_id long, media binary")
    found = rows_of(matroska.packet_table(files))
    assert [(r["doc_id"], r["error"] is None, r["length"]) for r in found] == [(1, True, 3), (1, True, 3), (2, False, None), (3, False, None)]


def test_hot_keys_are_broadcast_and_others_shuffled(spark):
    rows = spark.createDataFrame([(k, 7 if k % 3 == 0 else None if k == 1 else k) for k in range(3000)], "r long, k long")
    named = rows.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    got = join_by_key(rows, named, "k", "n", 3000)
    assert sorted(got.columns) == ["k", "r", "v"] and got.count() == 2999 and got.where("v <> 2 * k").count() == 0


def test_the_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert {k.split("_")[0] for k in q.queries()} == {f"op{n}" for n in range(1, 14)}
    assert {*q.queries(), "pipeline"} <= entry.queries().keys()
    assert set(q.oracle_sql()) <= set(q.queries())
