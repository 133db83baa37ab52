"""Exact duplicates, spelling variants and whitening against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from repolumen.llm import exact_dedup, queries, quotient_filter, spelling, whitening
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


# --- exact duplicates -------------------------------------------------------------


def multiset(rng, n, bits, most):
    prints = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
    return prints, rng.integers(1, most, len(prints))


@pytest.mark.parametrize("n, bits, most", [(0, 40, 2), (1, 40, 2), (1000, 12, 5), (5000, 45, 1 << 36), (300, 62, 3)])
def test_filter_round_trip(n, bits, most):
    rng = np.random.default_rng(n)
    prints, counts = multiset(rng, n, bits, min(most, 1 << (bits // 2)))
    found, numbers, width = quotient_filter.decode(quotient_filter.encode(prints, counts, bits))
    assert width == bits and found.tolist() == prints.tolist() and numbers.tolist() == counts.tolist()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(5)
    parts = [multiset(rng, n, 14, 9) for n in (3000, 10, 0, 900)]
    whole = Counter()
    for prints, counts in parts:
        whole.update(dict(zip(prints.tolist(), counts.tolist())))
    merged = quotient_filter.merge([quotient_filter.encode(*p, 14) for p in parts])
    prints, counts, _ = quotient_filter.decode(merged)
    assert dict(zip(prints.tolist(), counts.tolist())) == whole and prints.tolist() == sorted(whole)


def test_repeated_prints_over_blocks(spark):
    rng = random.Random(2)
    values = [rng.randrange(1 << 40) for _ in range(3000)]
    values += rng.choices(values, k=900) + [values[0]] * 2000
    df = spark.createDataFrame([(v,) for v in values], "print long").repartition(7)
    found = {r.print for r in exact_dedup.repeated_prints(df, 40, 3).collect()}
    assert found == {v for v, n in Counter(values).items() if n > 1}


def expected_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = {}
    for (i, _), t in zip(rows, norm):
        ids.setdefault(t, []).append(i)
    low = {t: min((i for i in group if i is not None), default=None) for t, group in ids.items()}
    return Counter((i, low[t], len(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm))


ODD_ROWS = [
    (5, "a  b"), (3, "a\tb"), (3, "a b"), (9, " a b"), (None, "a b"), (None, None), (2, ""), (1, None), (4, " "), (6, "\n\x0b"),
    (7, "a b"), (8, "a b" * 30000), (10, "a b" * 30000), (None, "only here"), (None, "only here"), (11, "alone"),
]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(i, t, -1, "x") for i, t in ODD_ROWS], "doc_id long, text string, row int, sha string")
    found = exact_dedup.exact_duplicates(df.repartition(3)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected_groups(ODD_ROWS)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_colliding_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "print_bits", lambda rows: (3, 1))
    rows = [(i, f"text {i % 40}") for i in range(60)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected_groups(rows)


def test_op11_equals_sql(spark):
    found = queries.op11_exact_dedup(spark, SF)
    assert differences(found, connect(SF), queries.OP11_SQL) is None


# --- spelling variants --------------------------------------------------------------


def brute_words(rows, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return counts


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, length=6, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, n, forms[w], words.get(forms[w]), len(near[w]), root))
    return rows


def as_set(df):
    return {(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect()}


def test_neighbours_of_random_words(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 8))): rng.choice([5, 5, 6, 30, 200]) for _ in range(700)}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), 4, 5, 5, every=10**9)
    assert as_set(found) == brute_variants(words, 4)


def test_chains_of_forms_and_ties(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "xbcdgg": 700, "zzzzzz": 5, "zzzzzy": 25, "zzzzyz": 25, "aaaaaa": 5, "aaaaaaa": 5}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    found = as_set(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), every=10**9))
    assert found == brute_variants(words)
    assert ("abcdef", 5, "abcdeg", 25, 1, "xbcdgg") in found and ("zzzzzz", 5, "zzzzyz", 25, 2, "zzzzyz") in found


def test_words_of_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "×÷ÀÿĀ Straße STRASSE İi"), (2, "×÷ÀÿĀ Straße STRASSE İi"), (None, "ab_cd 12 é"), (3, "lang" * 40000)]
    df = spark.createDataFrame([(*r, 0, "w") for r in rows], "doc_id long, text string, n int, word string")
    for every in (1, 2, 199):
        assert {(r.word, r.n) for r in spelling.word_counts(df, every).collect()} == set(brute_words(rows, every).items())
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_op12_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = brute_words(rows)
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(words) > 500
    assert as_set(queries.op12_spelling_variants(spark, SF)) == brute_variants(words)


# --- whitening ----------------------------------------------------------------------


def brute_whitening(vectors, k=16):
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (x - s / n) @ axes / np.sqrt(values), values / np.cov(fit.T, bias=True).trace()


def check_whitening(found, ids, vectors, k=16):
    n, deviation, whitened, explained = brute_whitening(vectors, k)
    rows = sorted(found, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, j + 1) for i in sorted(ids) for j in range(k)]
    order = np.argsort(ids, kind="stable")
    assert [r.deviation for r in rows] == [deviation[i] for i in order for _ in range(k)]
    assert {r.n for r in rows} == {n}
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    signs = np.sign((got * whitened[order]).sum(0))
    assert np.abs(got - whitened[order] * signs).max() < 1e-7
    assert np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_op13_equals_dense_solution(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(queries.op13_whitening(spark, SF).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_whitening_of_copies_and_broken_vectors(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((200, 9)) * np.arange(1, 10)).astype(np.float32).tolist()
    good += [good[0]] * 150
    bad = [None, [], [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], good[0][:5]]
    rows = [(i, v, 0, "p") for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, point string").repartition(5)
    check_whitening(whitening.whiten(df).collect(), list(range(len(good))), good, 9)
    check_whitening(whitening.whiten(df, components=4).collect(), list(range(len(good))), good, 4)
    assert whitening.whiten(df.limit(0)).count() == 0
    same = df.where("vec_id = 1").unionByName(df.where("vec_id = 1"))
    assert whitening.whiten(same).count() == 0
    flat = spark.createDataFrame([(i, [float((i or 0) % 7), 2.0 * ((i or 0) % 7), 1e30]) for i in [*range(30), None]], "vec_id long, embedding array<double>")
    found = whitening.whiten(flat).collect()
    assert len(found) == 31 and {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)


def spectrum(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [np.arange(300.0) ** 2, np.geomspace(1, 1e-9, 200), np.r_[np.full(5, 7.0), np.full(150, 1.0)], np.r_[3.0, np.zeros(40)], 1 + np.arange(400) * 1e-3],
    ids=["spread", "falling", "tied", "one", "clustered"],
)
def test_jacobi_davidson_residuals(values):
    a = spectrum(values)
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return a @ block

    found, vectors = whitening.leading_components(product, len(a), 16)
    top = np.sort(values)[::-1][:16]
    assert np.abs(found - top).max() <= 1e-12 * top[0]
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * top[0]
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert len(passes) < 200
