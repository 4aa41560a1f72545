"""Whitening, spelling variants and license scans against plain versions, on the small tables and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ledgerlake.llm import licenses, spellings, whitening
from ledgerlake.llm import queries as q
from ledgerlake.llm.common import read_table

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, row long, words string, label string, n int, id string"


def some_docs(spark, texts):
    """Rows with other columns of clashing names; the ids are places, the last one is null."""
    rows = [(k, t, 1, "w", "l", None, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows[:-1], (None, *rows[-1][1:])], DOCS)


# whitening


def test_products_are_exact_at_any_magnitude():
    rng = np.random.default_rng(1)
    for top in (100, 2**30, 2**60):
        a = rng.integers(-top, top, (50, 5))
        assert (whitening._products(a) == a.astype(object).T @ a.astype(object)).all()
    assert [n for n in range(9, 3000, 2) if whitening._is_prime(n)] == [n for n in range(11, 3000, 2) if all(n % k for k in range(3, int(n**0.5) + 1, 2))]


def plain_polynomial(m):
    """Faddeev and LeVerrier, with fractions: coefficients of det(x - m), the constant first."""
    d = len(m)
    m = [[Fraction(int(x)) for x in row] for row in m]
    c, n = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        n = [[sum(m[i][h] * n[h][j] for h in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(m[i][h] * n[h][i] for i in range(d) for h in range(d)) / k)
    return [int(x) for x in reversed(c)]


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-(10**6), 10**6, (9, 7)).astype(object)
    blocks = np.array([[2, 1, 0, 0, 0], [1, 2, 0, 0, 0], [0, 0, 3, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 1]], object)
    for m in (a.T @ a, blocks, a[:3].T @ a[:3]):
        assert whitening.characteristic_polynomial(spark, m) == plain_polynomial(m)
        roots, shift = whitening.largest_roots(plain_polynomial(m), 4)
        want = np.linalg.eigvalsh(m.astype(float))[::-1]
        want = want[want > want[0] * 1e-9][:4]
        assert np.allclose([r / 2**shift for r in roots], want, rtol=1e-9)
    assert whitening.largest_roots(plain_polynomial(blocks), 9)[0][:2] == [3 << whitening.largest_roots(plain_polynomial(blocks), 9)[1]] * 2  # a root of multiplicity two
    pair = whitening.null_vectors(blocks, 3 << 10, 10, 2)
    assert np.allclose(pair @ pair.T, np.eye(2)) and np.allclose(blocks.astype(float) @ pair.T, 3 * pair.T)


def plain_whitening(vectors, components):
    """(grid rows, whitened up to sign, explained, deviations) by numpy over the distinct grid rows."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    v = centred.T @ centred / len(fit)
    e, w = (y[..., ::-1] for y in np.linalg.eigh(v))
    keep = int((e > e[0] * 1e-9).sum()) if len(e) else 0
    e, w = e[: min(components, keep)], w[:, : min(components, keep)]
    sums = [sum(int(c) for c in column) for column in fit.T]
    far = [sum((len(fit) * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return (x - fit.mean(axis=0)) @ w / np.sqrt(e), e / np.trace(v), far


def test_whitening(spark, sf_dir):
    table = read_table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    got = q.op11_whitening(spark, sf_dir).toPandas()
    whitened, explained, far = plain_whitening([r["embedding"] for r in table], 16)
    by = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert list(by.shape) == [len(table), 16] and set(got["n"]) == {len({tuple(np.floor(64 * np.array(r["embedding"], float))) for r in table})}
    assert np.abs(by * np.sign((by * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().tolist() == far
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    good = [[*map(float, rng.normal(size=3)), 5.0] for _ in range(40)]  # a constant dimension has no component
    odd = [None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [1.0], []]
    rows = [(k, v, "g", 1.0) for k, v in enumerate(good)] + [(100 + k, v, "g", 1.0) for k, v in enumerate(odd)] + [(7, good[7], "g", 1.0), (None, good[8], "g", 1.0), (201, good[0], None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grid string, whitened double")
    got = whitening.whitened_rows(table).toPandas()
    whitened, explained, far = plain_whitening([*good, good[7], good[8], good[0]], 16)
    assert set(got["component"]) == {1, 2, 3} and len(got) == 3 * 43 and set(got["n"]) == {40}
    assert sorted(got["deviation"].tolist()) == sorted(far * 3)
    assert np.allclose(got.groupby("component")["explained"].first(), explained) and got["identity_error"].max() < 1e-9
    model = whitening.fit_whitening(table)
    kept = whitening.with_whitened(table, model, whitened="WHITENED").collect()
    assert len(kept) == len(rows) and sum(r["WHITENED"] is None for r in kept) == len(odd) and {r["grid"] for r in kept} == {"g", None}
    for few in (table.limit(0), table.where("vec_id = 3"), table.where("vec_id = 100"), table.where("vec_id = 106")):
        assert whitening.whitened_rows(few).collect() == []


def test_whitening_of_equal_and_wide_eigenvalues(spark):
    """Equal eigenvalues have components at right angles; entries of 2^50 stay exact."""
    cross = [[s * 2.0 * (i == j) for j in range(5)] for i in range(5) for s in (-1, 1)]
    got = whitening.whitened_rows(spark.createDataFrame(list(enumerate(cross)), "vec_id long, embedding array<double>")).toPandas()
    assert np.allclose(got["explained"], 0.2) and got["identity_error"].max() < 1e-9
    wide = [(k, [float(2**50 + 17 * k), float((-1) ** k), 1e-3 * k]) for k in range(30)]
    got = whitening.whitened_rows(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).toPandas()
    far = plain_whitening([v for _, v in wide], 3)[2]
    assert sorted(got["deviation"].tolist()) == sorted(far * 3) and got["identity_error"].max() < 1e-6


# spelling variants


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    best = {w: min(x, key=lambda v: (-counts[v], v)) if x else None for w, x in near.items()}
    form = {w: b if b and counts[b] >= 2 * counts[w] else None for w, b in best.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def test_trie_nodes_stand_for_one_beginning_each():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abéß") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    for parts in (1, 3, 40, len(words)):
        cuts = [0, *sorted(rng.sample(range(1, len(words)), parts - 1)), len(words)]
        node, beginning, last = {}, {}, None
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            last = spellings.Range(k, words[a], words[b - 1], last)
            for word, ids in zip(words[a:b], last.nodes(words[a:b]), strict=True):
                assert len(ids) == len(word) + 1
                for j, x in enumerate(ids):
                    assert node.setdefault(word[:j], x) == x and beginning.setdefault(x, word[:j]) == word[:j]


def test_spelling_variants_of_random_words(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): int(2 ** rng.uniform(0, 12)) for _ in range(500)}
    counts |= {"x" * 3000: 9, "x" * 2999: 40, "x" * 1500 + "y" + "x" * 1499: 3}
    table = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    for size in (60, 4_000_000):  # many ranges, and one
        assert sorted(map(tuple, spellings.spelling_variants(table, part_chars=size).collect())) == plain_variants(counts)
    assert spellings.spelling_variants(table.limit(0)).collect() == []


def plain_counts(rows):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[word] += len(word) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def test_words_of_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    want = plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert dict(map(tuple, spellings.word_counts(docs).collect())) == want
    texts = [None, "", " \n ", "ÀÉx×÷Word-word_WORDS words9words", "Straße straße STRASSE strasse " * 5, "a" * 50_000 + " " + "long" * 9_000, *["house houses hause mouse house"] * 200, "Ω house"]
    table = some_docs(spark, texts)
    want = plain_counts([(r["doc_id"], r["text"]) for r in table.collect()])
    assert dict(map(tuple, spellings.word_counts(table).collect())) == want and len(want) == 7
    got = spellings.spelling_variants(spellings.word_counts(table)).collect()
    assert sorted(map(tuple, got)) == plain_variants(want) and sum(r["form"] is not None for r in got) >= 1


# licenses


def plain_scan(text, k=4, share=0.8, slack=4, gap=12):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    between = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words_of = lambda t: [w for w in re.split(between, (t or "").translate(LOWERED)) if w]
    words = words_of(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    where = defaultdict(list)
    for i in range(len(words) - k + 1):
        where[tuple(words[i : i + k])].append(i)
    best, own = 0.0, set()
    for label, template in licenses.TEMPLATES:
        t = words_of(template)
        diagonals = defaultdict(list)
        for j in range(len(t) - k + 1):
            for i in where.get(tuple(t[j : j + k]), ()):
                diagonals[i - j].append((i, j))
        spans, last = [], None
        for d in sorted(diagonals):
            at = [i for i, _ in diagonals[d]]
            low, high = (min(i for x in diagonals if x < d for i, _ in diagonals[x]), max(i for x in diagonals if x < d for i, _ in diagonals[x])) if last is not None else (0, 0)
            if last is None or d - last > slack or min(at) > high + k + gap or max(at) + k + gap < low:
                spans.append(set())
            spans[-1] |= {j + x for _, j in diagonals[d] for x in range(k)}
            last = d
        for s in spans:
            best = max(best, len(s) / len(t))
            own |= {label} if len(s) / len(t) >= share else set()
    base = sorted({label for _, label in places})
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *own})), best


def test_license_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    want = sorted((r["doc_id"], *plain_scan(r["text"])) for r in docs.collect())
    assert sorted(map(tuple, q.op13_license_scan(spark, sf_dir).collect())) == want
    assert {r[6] for r in want} >= {"", "mit", "apache", "cc-by-nc"}


def test_license_scan_of_awkward_texts(spark):
    mit, apache = licenses.TEMPLATES[1][1], licenses.TEMPLATES[3][1]
    changed = mit.replace("free of charge", "entirely free of any charge").replace("sublicense", "").replace("THE", "the")
    texts = [
        None, "", " .. ", "MIT License", "mit License, MITé license. mit-license MIT", "general public license " * 3, "license", "the mit",
        mit, mit.upper(), changed, f"text {mit} and then\n\n{apache} end", mit[: len(mit) // 2], f"{mit} {mit}", "Released under the MIT License. " * 2000,
        "word " * 60_000 + apache + " word" * 10, "Licensed under CC BY-NC 4.0.", mit, "K MIT License", "last \x00 apache\x7flicense",
    ]
    table = some_docs(spark, texts)
    got = licenses.scan_licenses(table).collect()
    ident = lambda k: None if k == len(texts) - 1 else k
    assert sorted(map(tuple, got), key=str) == sorted(((ident(k), *plain_scan(t)) for k, t in enumerate(texts)), key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[10]["labels"] == "mit" and 0.8 <= by[10]["score"] < 1 and by[11]["labels"] == "apache,mit" and by[12]["labels"] == ""
    assert licenses.scan_licenses(table.limit(0)).collect() == []
    spans = sorted((r["doc_id"], r["label"], r["first_word"], r["after_word"]) for r in licenses.license_spans(table.where("doc_id IN (11, 13)")).collect())
    words = {label: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWERED))) for label, t in (("mit", mit), ("apache", apache))}
    assert (11, "mit", 1, 1 + words["mit"]) in spans and [s for s in spans if s[0] == 13] == [(13, "mit", 0, words["mit"]), (13, "mit", words["mit"], 2 * words["mit"])]


def test_license_scan_has_no_python(spark, sf_dir):
    plan = q.op13_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan) and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_license_scan"])
def test_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
