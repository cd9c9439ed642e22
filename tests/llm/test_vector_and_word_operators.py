"""Whitening, exact duplicates and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from relrank.llm import treemerge, variants, whitening
from relrank.llm.queries import op11_whitening, op12_exact_dedup, op13_spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Whitening -----------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, component string")


@pytest.mark.parametrize("n", [1, 2, 5, 33])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    wide = rng.standard_normal((4 * n, n)) * 10.0 ** rng.uniform(-4, 4, n)
    for a in (wide.T @ wide, np.eye(n), np.zeros((n, n)), np.ones((n, n)), q @ np.diag(np.arange(n) // 3 * 1.0) @ q.T, q @ np.diag(np.arange(n) - n // 2) @ q.T):
        values, columns = whitening.eigen(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert (np.diff(values) <= 1e-12 * size).all() and np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size, rtol=0)
        assert np.linalg.norm(a @ columns - columns * values) < 1e-13 * size * n and np.abs(columns.T @ columns - np.eye(n)).max() < 1e-13


def test_sign_of_a_symmetric_matrix():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))[0]
    values = np.array([1e-9, -1e-9, 3, -4, 1e-3, -1, 2, 5, -1e-6, 7, 8, -9])
    assert np.abs(whitening.polar_sign(q @ np.diag(values) @ q.T) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-5


def brute_whitening(rows):
    """Per row: n, exact deviation; and numpy's own whitening up to the sign of each component."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(sums) / n
    centred = np.array(fit) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    white = (np.array([x for _, x in kept]) - mean) @ axes / np.sqrt(values)
    away = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept]
    return kept, n, away, white, values / values.sum()


def test_whitening_is_as_numpy_has_it(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(20) * np.arange(1, 21)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000, None), (2001, [None] + rows[3][1][1:]), (2002, [math.nan] + rows[3][1][1:])]
    rows += [(2003, [math.inf] + rows[3][1][1:]), (None, rows[9][1]), (5, rows[11][1]), (2004, [])]
    got = defaultdict(dict)
    frame = vectors(spark, [(*r, 1, "x", "y") for r in rows]).repartition(5)
    out = whitening.whiten(frame).collect()
    kept, n, away, white, explained = brute_whitening(rows)
    assert len(out) == 16 * len(kept) and {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1
    assert out[0]["identity_error"] < 1e-9
    want = Counter((i, c + 1, a, round(abs(w[c]), 6), round(explained[c], 9)) for (i, _), a, w in zip(kept, away, white) for c in range(16))
    assert Counter((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9)) for r in out) == want
    for r in out:
        got[r["component"]].setdefault(r["vec_id"], r["whitened"])
    signs = {c: {np.sign(got[c + 1][i] * w[c]) for (i, _), w in zip(kept, white) if i not in (5,) and abs(w[c]) > 1e-6} for c in range(16)}
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def test_whitening_of_little_or_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1, "", "")])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1, "", ""), (2, [1.0, 2.0], 1, "", "")])).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in one)
    mixed = [(i, [float(i % 3), float(i % 5)], 1, "", "") for i in range(15)] + [(99, [1.0, 2.0, 3.0], 1, "", "")]
    got = whitening.whiten(vectors(spark, mixed)).collect()
    assert len(got) == 30 and 99 not in {r["vec_id"] for r in got}
    huge = [(i, [1e9 * (i % 3), 1.0 * (i % 7)], 1, "", "") for i in range(21)]
    sums = [sum(x) for x in zip(*{(math.floor(64 * float(np.float32(a))) + 10**6, math.floor(64 * b) + 10**6) for _, (a, b), *_ in huge})]
    for r in whitening.whiten(vectors(spark, huge)).collect():
        a, b = huge[r["vec_id"]][1]
        exact = (21 * (math.floor(64 * float(np.float32(a))) + 10**6) - sums[0]) ** 2 + (21 * (math.floor(64 * b) + 10**6) - sums[1]) ** 2
        assert r["deviation"] == (exact if exact < 1 << 63 else None)


def test_whitening_query(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    out = op11_whitening(spark, small).collect()
    kept, n, away, white, explained = brute_whitening(rows)
    want = {i: (a, w) for (i, _), a, w in zip(kept, away, white)}
    for r in out:
        a, w = want[r["vec_id"]]
        assert r["deviation"] == a and abs(abs(w[r["component"] - 1]) - abs(r["whitened"])) < 1e-8
    assert len(out) == 16 * len(kept)


# Exact duplicates ----------------------------------------------------------------------------------------------------


def brute_duplicates(rows, pick=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = pick(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: i != stays):
            out.append((i, stays, len(ids), bool(left and i == stays), sha))
            left -= left and i == stays
    return Counter(out)


def texts(spark, rows, parts):
    full = [(*r, "s", 7, 3) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, sha string, run int, keep_id int").repartition(parts)


@pytest.mark.parametrize("parts", [1, 12])
def test_exact_duplicates(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a", "A", "Ab", "aB", "é", "É", "ÉA", "éa", "", None, "İ", "ı", "x" * 200_000, "same TEXT"])) for i in range(400)]
    rows += [(i, "Hot COPY" if i % 2 else "hot copy") for i in range(1000, 1600)] + [(i, f"own {i}") for i in range(5000, 5100)]
    rows += [(7, "same text"), (7, "other"), (None, "same text"), (None, "nobody"), (None, "nobody"), (3, "twice"), (3, "twice"), (-4, "twice")]
    rng.shuffle(rows)
    frame = texts(spark, rows, parts)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = treemerge.exact_duplicates(frame)
    assert got.columns == columns and Counter(map(tuple, got.collect())) == brute_duplicates(rows)
    got = treemerge.exact_duplicates(frame, keep="smallest", fan=2)
    assert Counter(map(tuple, got.collect())) == brute_duplicates(rows, min)


def test_exact_duplicates_of_nothing(spark):
    assert treemerge.exact_duplicates(texts(spark, [], 2)).count() == 0
    for bad in ({"keep": "any"}, {"fan": 1}):
        with pytest.raises(ValueError):
            treemerge.exact_duplicates(texts(spark, [], 1), **bad)


def test_exact_duplicates_stay_in_the_jvm(spark, small):
    plan = op12_exact_dedup(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Spelling variants ---------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    forms, rows = {}, {}
    for w, n in words.items():
        around = [x for size in (-1, 0, 1) for x in by_size[len(w) + size] if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        rows[w] = (n, len(around), words[best] if forms[w] else None)
    out = set()
    for w, (n, k, m) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, k, m))
    return out


def docs(spark, rows):
    return spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, word string, n int")


def test_spelling_variants(spark):
    rng = random.Random(11)
    letters = "aeiouAEznßéÀ×ÿ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = base[min(int(rng.expovariate(0.15)), 59)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(w + rng.choice([" ", "1", "-", "Ā", "\n"]))
        rows.append((i, "".join(words)))
    chain = ["kettenwort", "kettenwor", "kettenwo", "kettenw"]
    rows += [(1000 + i, f"{w} " * n) for i, (w, n) in enumerate(zip(chain, (4000, 300, 25, 2)))]
    rows += [(2000, None), (2001, ""), (None, "kettenwort kettenwort"), (5, rows[5][1]), (5, "kettenwoRt"), (2002, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa abaaaaa abaaaaa")]
    got = variants.variant_groups(docs(spark, rows).repartition(5))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert ("kettenw", "kettenwo", "kettenwort") in {r[:3] for r in want}


def test_spelling_variants_of_long_runs_and_nothing(spark):
    assert variants.variant_groups(docs(spark, [])).count() == 0
    assert variants.variant_groups(docs(spark, [(1, None), (2, "short words only")])).count() == 0
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    rows = [(1, f"{long} " * 20), (2, f"{long[:70_000]}x{long[70_001:]} " * 2), (3, f"{long[:30_000]}{long[30_001:]} " * 2)]
    got = {(len(r["word"]), r["n_near"], r["n"], r["form_n"]) for r in variants.variant_groups(docs(spark, rows)).collect()}
    assert {(w, k, n, m) for w, _, _, n, k, m in ((len(x[0]), *x[1:]) for x in brute_variants(rows))} == got


def test_every_neighbour_once():
    """The made neighbourhood holds exactly the words one edit away that are not shorter, replacements upwards."""
    rng = random.Random(4)
    for length in (1, 2, 5, 9):
        for _ in range(20):
            word = [rng.randrange(3) for _ in range(length)]
            made = [k for _, keys in variants.edited(np.array([word]), 3) for k in keys.tolist()]
            around = {tuple(word)}
            around |= {tuple(word[:i] + [s] + word[i:]) for i in range(length + 1) for s in range(3)}
            around |= {tuple(word[:i] + [s] + word[i + 1 :]) for i in range(length) for s in range(word[i] + 1, 3)}
            want = [int(variants._named(variants._prefix(np.array([w]))[0][:, -1], len(w))[0]) for w in around]
            assert sorted(made) == sorted(want)


def test_spelling_query_runs(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert {tuple(r) for r in op13_spelling_variants(spark, small).select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(rows)
