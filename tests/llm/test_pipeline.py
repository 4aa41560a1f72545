"""Every stage of the pipeline against a plain version, on rows of all awkward kinds, and the stages in a row."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import test_operators as plain

import corpus_pipeline as p
from ledgerlake.llm import quality
from ledgerlake.llm.common import read_table, staged

#: Columns with the names that stages use inside, beside those of documents.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk long, fp string, wide string, size string, row long, vertex long"


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    some = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").where("doc_id > 100").collect()]
    passage = " ".join(f"passage{k}" for k in range(70))
    texts = [(t[0], t[1]) for t in plain.AWKWARD] + some
    texts += [(5000, some[0][1]), (5001, some[0][1] + " and one more"), (5002, f"before {passage} after"), (5003, f"other {passage}\nend"), (None, some[3][1]), (None, None), (5004, some[5][1]), (5004, some[5][1])]
    return [(i, x, "en", "s", None if x is None else len(x), 0.5, 7, "f", None, "z", 3, 4) for i, x in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return staged(spark.createDataFrame(rows, SCHEMA))


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def check_columns(df, docs):
    assert df.schema.simpleString() == docs.schema.simpleString()
    same = df.where("score = 0.5 AND chunk = 7 AND fp = 'f' AND wide IS NULL AND size = 'z' AND row = 3 AND vertex = 4")
    assert same.count() == df.count() == df.where("text IS NULL OR n_chars = length(text)").count()


def test_quality_stage(spark, docs, rows, sf_dir):
    out = p.accept_quality(spark, docs, sf_dir)
    check_columns(out, docs)
    model = quality.fit_quality_model(docs, read_table(spark, sf_dir, "labels"))

    def score(text):
        """The network by its description: mean word and index vectors of tokens and shapes, ratios, two layers, a temperature."""
        ids, ratios = quality._document(text, quality._Buckets(14))
        pooled = model.vectors[ids.ravel()].astype(np.float64).sum(0) / max(1, 2 * len(ids))
        x = np.clip((np.concatenate([pooled, ratios]) - model.mean) / model.scale, -8, 8)
        return 1 / (1 + np.exp(-(np.tanh(x @ model.w1 + model.b1) @ model.w2 + model.b2) / model.temperature)) if model.w1.any() else model.prior

    scores = {x: score(x) for _, x, *_ in rows}
    assert all(abs(s - 0.7) > 1e-5 for s in scores.values())
    assert kept(out) == Counter((i, x) for i, x, *_ in rows if scores[x] >= 0.7)


def test_line_stage(spark, docs, rows, sf_dir):
    out = p.dedup_lines(spark, docs, sf_dir)
    check_columns(out, docs)
    times = Counter(i for i, *_ in rows)
    want = {i: x for i, _, x in plain.plain_line_dedup([(i, x) for i, x, *_ in rows])}
    got = kept(out)
    for i, x in want.items():
        if times[i] == 1:
            assert got[i, x] == (x is None or x != "")
    assert got[None, None] == 1 and sum(n for (i, _), n in got.items() if i == 6) == 2
    # an earlier document holds what these two rows repeat
    assert got[5004, want[5004]] == 2 * (want[5004] != "")


def test_near_duplicate_stage(spark, docs, rows, sf_dir):
    out = p.drop_near_duplicates(spark, docs, sf_dir)
    check_columns(out, docs)

    def shingles(text):
        ws = plain.words("".join(c.lower() if c.isascii() else c for c in text or ""))
        return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()

    sets = [shingles(x) for _, x, *_ in rows]
    alike = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    groups = defaultdict(list)
    for k, root in plain.groups(range(len(rows)), alike).items():
        groups[root].append(rows[k][0])
    want = Counter(min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values())
    assert Counter(i for i, _ in kept(out).elements()) == want and len(groups) < len(rows)


def test_groups_of_the_corpus_keep_one_document_each(spark):
    """All 1,000 documents of the next larger table: every exact group, by all pairs, keeps its first document and no other."""
    big = "/root/testdata/sf0.01"
    docs = read_table(spark, big, "documents")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    number: dict[tuple, int] = {}
    sets = []
    for _, text in texts:
        ws = plain.words("".join(c.lower() if c.isascii() else c for c in text or ""))
        own = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
        sets.append(np.array(sorted(number.setdefault(x, len(number)) for x in own), np.int64))
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for x in own.tolist():
            holders[x].append(k)
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, own in enumerate(sets):
        common = Counter(j for x in own.tolist() for j in holders[x] if j < k)
        near = [j for j, n in common.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)] + [j for j in range(k) if not len(own) and not len(sets[j])]
        for j in near:
            a, b = find(k), find(j)
            root[max(a, b)] = min(a, b)
    want = sorted(texts[k][0] for k in range(len(texts)) if find(k) == k)
    assert sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, docs, big).select("doc_id").collect()) == want


def test_substring_stage(spark, docs, rows, sf_dir):
    out = p.cut_repeated_passages(spark, docs, sf_dir)
    check_columns(out, docs)
    split, gone = plain.plain_repeats([x for _, x, *_ in rows], 50)
    want = Counter()
    for d, (i, x, *_) in enumerate(rows):
        if x is None or not gone[d]:
            want[i, x] += x is None or x != ""
        elif len(gone[d]) < len(split[d]):
            want[i, tuple(w for k, w in enumerate(split[d]) if k not in gone[d])] += 1
    touched = {(i, tuple(plain.words(x))) for i, x in want if isinstance(x, str)} | {k for k in want if isinstance(k[1], tuple)}
    got = Counter()
    for (i, x), n in kept(out).items():
        got[(i, x) if want[i, x] else (i, tuple(plain.words(x)))] += n
    assert got == +want and touched and any(isinstance(x, tuple) for _, x in want)


def test_packing_stage(spark, docs, rows, sf_dir):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    total, sequences = Counter(), defaultdict(list)
    for r in p.pack(spark, docs, sf_dir).collect():
        total[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, x, *_ in rows:
        want[i] += len(encode(x or "", add_special_tokens=False).ids) + 1
    assert total == want
    for pieces in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [at for at, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 4096


def test_stages_pass_documents_on(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = staged(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns, name
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        assert 0 < out.count() <= before
        docs, before = out, out.count()
    packed = p.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_empty_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
