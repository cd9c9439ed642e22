"""Word shingles, Jaccard join, passages, toxicity, quality and token counts against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relrank.llm import graph, jaccard, passages, quality, toxicity, trie
from relrank.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text) rows with further columns, some of which have names that operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def sentence(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    flat = [(i, s) for i, group in sets.items() for s in group]
    parent = {i: i for i in sets}
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in sets}


def near_copies(seed, groups=4, size=12, words=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = sentence(rng, words)
        rows += [(None, edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))) for _ in range(size)]
    common = sentence(rng, 60)
    rows += [(None, f"{common} {sentence(rng, 30)}") for _ in range(10)]  # a long passage in unlike documents
    rows += [(None, sentence(rng, words)) for _ in range(20)]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, (_, t) in enumerate(rows)]


def test_words_and_shingles():
    texts = ["A b\tc  D e F", None, "", " \n ", "é b c", "x", "a b c d e a b c d e"]
    column = pa.array(texts)
    for size in (1, 4, 1000):
        counts, digests = [], []
        for part in W.slices(column, size):
            sets = W.distinct(W.shingles(W.words(part)))
            counts += np.diff(sets.row_starts).tolist()
            digests += W.digests(sets)[0].tolist()
        assert counts == [len(shingle_set(t)) for t in texts]
        assert digests[1] == digests[2] == digests[3] and len(set(digests)) == 5
    assert W.column_bytes(column.slice(4, 2))[0].tobytes() == "é b cx".encode()


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 9), (None, 1), (20, 21), (21, 22), (22, 20), (5, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20}
    assert graph.components(edges.limit(0)).count() == 0
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in graph.components(chain).collect()} == {0}


@pytest.mark.parametrize("limits", [None, (8, 3, 4)])
def test_jaccard_components(spark, monkeypatch, limits):
    """Also where nearly all regions are split by document pivots again and again."""
    if limits:
        monkeypatch.setattr(jaccard, "REGION_ROWS", limits[0])
        monkeypatch.setattr(jaccard, "PIVOTS", limits[1])
        monkeypatch.setattr(jaccard, "CHUNK_ROWS", limits[2])
    rows = near_copies(5)
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "One TWO"), (1005, "two one"), (1, rows[0][1])]
    rows.append((1006, sentence(random.Random(1), 30_000)))
    want = brute_components(rows)
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] in [len(shingle_set(t)) for i, t in rows if i == r["doc_id"]] for r in got)


def test_jaccard_without_rows_or_ids(spark):
    docs = documents(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, None)])
    got = jaccard.jaccard_components(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(7, 7), (None, 7), (None, None)} and len(got) == 3
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_similar_at_the_threshold():
    assert jaccard.similar(3, 3, 4) and not jaccard.similar(299, 300, 400 - 1)
    sizes = np.array([3, 4, 5])
    tokens = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5])]
    links = jaccard.Region(sizes, tokens).spanning_links(np.zeros(3, np.int64))
    assert {frozenset(x) for x in links} == {frozenset((0, 1)), frozenset((1, 2))}


def test_compact_windows_hold_every_long_range():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 60).astype(np.uint64) << np.uint64(40)
    left, centre, right = passages.compact_windows(values, np.array([0, 45, 60]), shortest=6)
    for start, end in ((0, 45), (45, 60)):
        for i in range(start, end):
            for j in range(i + 5, end):
                holds = (left <= i) & (i <= centre) & (centre <= j) & (j <= right)
                assert holds.sum() == 1
                assert values[centre[holds.argmax()]] == values[i : j + 1].min()


def test_passages(spark):
    rng = random.Random(8)
    shared, other = sentence(rng, 60), sentence(rng, 80)
    changed = other.split()
    changed[40] = "changed"
    rows = [(i, f"{sentence(rng, 70)} {shared} {sentence(rng, 70)}") for i in range(3, 40)]
    rows += [(50, f"{sentence(rng, 40)} {other}"), (51, f"{' '.join(changed)} {sentence(rng, 30)}"), (52, sentence(rng, 300))]
    rows += [(60, None), (61, ""), (None, shared), (62, "x " * 200), (63, "x " * 150), (64, shared[:200])]
    docs = documents(spark, rows)
    spans = passages.duplicate_passages(docs).collect()
    texts = {i: WORD.findall(t or "") for i, t in rows}
    by_doc = {}
    for s in spans:
        assert s["first_doc_id"] < s["doc_id"] and s["end_word"] - s["start_word"] >= 50
        by_doc.setdefault(s["doc_id"], []).append(s)
    assert set(by_doc) == {*range(4, 40), 51, 63}
    for i in range(4, 40):
        covered = {w for s in by_doc[i] for w in range(s["start_word"], s["end_word"])}
        assert set(range(70, 130)) <= covered and len(covered) <= 64
        assert texts[i][70:130] == shared.split()
    cut = {r["doc_id"]: r for r in passages.drop_passages(docs, passages.duplicate_passages(docs)).collect()}
    assert set(cut) == {i for i, _ in rows} - {63}
    assert shared in cut[3]["text"] and shared not in cut[4]["text"] and len(cut[4]["text"].split()) >= 136
    assert cut[52]["text"] == dict(rows)[52]
    assert cut[60]["text"] is None and cut[61]["text"] == "" and cut[3]["node"] == "x"
    assert passages.duplicate_passages(docs.limit(0)).count() == 0


def test_passages_do_not_depend_on_the_first_of_a_group(spark):
    """Copies that share words, or a whole line, with an earlier document that is otherwise different."""
    rng = random.Random(31)
    line, body = sentence(rng, 30), sentence(rng, 60)
    inner = f"{sentence(rng, 35)} {line} {sentence(rng, 35)}"
    rows = [(i, f"{sentence(rng, 60)} {line} {sentence(rng, 60)}") for i in range(1, 8)]
    rows += [(20, inner), (21, f"{sentence(rng, 30)} {inner}"), (22, f"{inner} {body}"), (23, f"{body} {sentence(rng, 20)}")]
    # 31 has both 30 and 33's own words; 33 is not similar to 30.
    w = sentence(rng, 60).split()
    rows += [(30, " ".join(w))]
    rows += [(31, " ".join(w[:50] + ["a", "b", "c", "d"] + w[50:])), (33, " ".join(w[20:50] + ["a", "b", "c", "d"] + w[50:] + ["e"] * 8))]
    spans = passages.duplicate_passages(documents(spark, rows)).collect()
    pairs = {(s["doc_id"], s["first_doc_id"]) for s in spans}
    assert pairs >= {(21, 20), (22, 20), (23, 22), (31, 30)}
    assert not {i for i, _ in pairs} & set(range(1, 8)) and (20, 1) not in pairs


def test_passages_of_which_every_part_stands_in_an_earlier_document(spark):
    """Two near copies, all of whose short runs of words also stand in earlier documents of other content."""
    rng = random.Random(33)
    rows, number = [], 0
    for k in range(12):
        w = sentence(rng, 110).split()
        for i in range(0, 96, 8):
            rows.append((number, f"{sentence(rng, 40)} {' '.join(w[i : i + 26])} {sentence(rng, 40)}"))
            number += 1
        one, two = " ".join(w), " ".join([*w[:16], "a", *w[16:48], "b", *w[48:80], "c", *w[80:]])
        assert len(shingle_set(one) & shingle_set(two)) >= 0.75 * len(shingle_set(one) | shingle_set(two))
        rows += [(1000 + k, f"{sentence(rng, 40)} {one} {sentence(rng, 40)}")]
        rows += [(2000 + k, f"{sentence(rng, 40)} {two} {sentence(rng, 40)}")]
    spans = passages.duplicate_passages(documents(spark, rows)).collect()
    assert {(s["doc_id"], s["first_doc_id"]) for s in spans} == {(2000 + k, 1000 + k) for k in range(12)}


def test_passages_of_the_stated_similarity_are_found(spark):
    """Edited copies whose Jaccard similarity is 0.75 or more, against brute force; and one changed run of seven words."""
    rng = random.Random(32)
    rows, want = [], {}
    for k in range(150):
        words = [f"k{k}n{i}" for i in range(rng.randrange(50, 140))]
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(3, len(other) - 3)
            other[at : at + rng.randrange(2)] = [f"c{rng.randrange(10**6)}"] * rng.randrange(1, 3)
        if k == 0:
            words = [f"k{k}n{i}" for i in range(95)]
            other = words[:44] + [f"c{i}" for i in range(7)] + words[51:]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        want[1000 + k] = len(a & b) >= 0.75 * len(a | b)
        rows += [(k, f"{sentence(rng, 70)} {' '.join(words)} {sentence(rng, 30)}")]
        rows += [(1000 + k, f"{sentence(rng, 20)} {' '.join(other)} {sentence(rng, 80)}")]
    found = {s["doc_id"]: s["first_doc_id"] for s in passages.duplicate_passages(documents(spark, rows)).collect()}
    similar = {i for i, near in want.items() if near}
    assert 1000 in similar and len(similar) > 50
    assert similar <= set(found) and all(found[i] == i - 1000 for i in found)


def test_joint_windows_hold_every_long_range_once():
    rng = np.random.default_rng(4)
    one, two = (passages.compact_windows(rng.permutation(80).astype(np.uint64) << np.uint64(40), np.array([0, 50, 80]), 6) for _ in range(2))
    i, j = passages.joint_windows(one, two, 6)
    for start, end in ((0, 50), (50, 80)):
        for a in range(start, end):
            for b in range(a + 5, end):
                inside = [(l <= a) & (a <= c) & (c <= b) & (b <= r) for l, c, r in (one, two)]
                assert (inside[0][i] & inside[1][j]).sum() == 1
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i)


def test_passages_in_another_order_self_repeating_and_long(spark):
    """Recall on passages of 0.75 and more whose sentences are shuffled, that repeat themselves, or that are long."""
    rng = random.Random(41)
    rows, want = [], {}
    for k in range(90):
        own = [[f"k{k}s{i}w{j}" for j in range(25)] for i in range(8)]
        if k % 3 == 0:
            one, two = sum(own, []), sum(rng.sample(own, 8), [])
        elif k % 3 == 1:
            one = sum(own[:3] * 3, [])
            two = one[:40] + ["edit"] + one[41:]
        else:
            one = [f"k{k}w{j}" for j in range(600)]
            two = [f"e{j}" if j % 60 == 30 else w for j, w in enumerate(one)]
        a, b = shingle_set(" ".join(one)), shingle_set(" ".join(two))
        want[1000 + k] = len(a & b) >= 0.75 * len(a | b)
        rows += [(k, f"{sentence(rng, 70)} {' '.join(one)} {sentence(rng, 30)}")]
        rows += [(1000 + k, f"{sentence(rng, 20)} {' '.join(two)} {sentence(rng, 80)}")]
    found = {s["doc_id"] for s in passages.duplicate_passages(documents(spark, rows)).collect()}
    similar = {i for i, near in want.items() if near}
    missed = {kind: sum(i % 3 == (1000 + kind) % 3 for i in similar - found) for kind in range(3)}
    assert len(similar) > 80 and len(similar - found) <= 0.1 * len(similar), missed


def test_a_line_in_many_texts_pairs_nobody_but_copies(spark, monkeypatch):
    """Texts that share a line meet none of each other, two of them that also share a passage do."""
    rng = random.Random(43)
    line, body = sentence(rng, 40), sentence(rng, 60)
    rows = [(i, f"{sentence(rng, 60)} {line} {sentence(rng, 60)}") for i in range(400)]
    rows += [(500 + i, f"{sentence(rng, 60)} {line} {body}") for i in range(3)]
    compared = []
    near_pairs = passages._near_pairs

    def counted(pairs, around):
        compared.append(pairs.count())
        return near_pairs(pairs, around)

    monkeypatch.setattr(passages, "_near_pairs", counted)
    spans = passages.duplicate_passages(documents(spark, rows)).collect()
    assert {s["doc_id"] for s in spans} == {501, 502}
    assert compared[0] <= 10


def test_a_text_of_one_repeated_word_is_no_path(spark):
    rows = [(1, "x " * 200_000), (2, "y " * 100 + "x " * 150_000), (3, "a b c " * 50_000)]
    spans = passages.duplicate_passages(documents(spark, rows)).collect()
    assert {(s["doc_id"], s["first_doc_id"]) for s in spans} == {(2, 1)}


def labelled(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = sentence(rng, rng.randrange(20, 80)).split()
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["Idiot", "clown", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, rng.randrange(2), int(toxic)))
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, raw, labels = labelled(spark)
    docs = documents(spark, [*rows, (9000, None), (9001, ""), (None, "clown")])
    model = toxicity.fit(docs, labels.unionByName(labels.limit(5)))
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    truth = {i: t for i, _, t in raw}
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    hits = [(r["toxicity"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held]
    assert len(hits) > 100 and sum(hits) / len(hits) > 0.95
    assert len(got) == len(rows) + 3 and all(0 <= r["toxicity"] <= 1 and r["score"] == "y" for r in got)
    empty = {r["toxicity"] for r in got if r["doc_id"] in (9000, 9001)}
    assert len(empty) == 1


def test_toxicity_grams_are_those_of_each_text():
    texts = ["Ábc é", "", None, "bc", "ABCDEF"]
    part = next(W.slices(pa.array(texts)))
    found = [np.bincount(row, minlength=len(texts)) for row, _ in toxicity.grams(part)]
    want = [[max(0, len(t or "") - n + 1) for t in texts] for n in toxicity.SIZES]
    assert [x.tolist() for x in found] == want
    rows, buckets = toxicity.present(next(W.slices(pa.array(["xabcdefx", "ABCDEF"]))))
    assert set(buckets[rows == 1]) < set(buckets[rows == 0])


def test_toxicity_without_labels_or_rows(spark):
    rows, _, labels = labelled(spark, 40)
    docs = documents(spark, rows)
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)))
    assert none.agg(F.max("toxicity")).first()[0] < 0.01
    one_class = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_class).agg(F.max("toxicity")).first()[0] < 0.3
    assert toxicity.score(docs.limit(0), one_class).count() == 0


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)]


ODD = [
    None, "", "\n\n", "a\na\n\na", "a b c a b c", "x x x x x", "é ñ #*$%&|<> 日本", "one\r\none\r\n", "a b c\na b c\n", " lead\n lead\nlead",
]


def test_quality_counts_are_exact(spark):
    rng = random.Random(4)
    texts = [*ODD, *["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(80))) for _ in range(300)], "w \n" * 20_000]
    for size in (1, 50, 1 << 20):
        got = np.concatenate([quality.statistics(p)[0] for p in W.slices(pa.array(texts), size)])
        assert got.tolist() == [brute_counts(t) for t in texts]
    good = " ".join(f"word{i}" for i in range(60))
    docs = documents(spark, [(1, good), (2, None), (3, "a b c " * 40), (4, "short text"), (1, good)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.fit(docs, labels.limit(0))).collect()}
    assert {i: (r["base_failed"], r["kept"]) for i, r in got.items()} == {
        1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False),
    }
    assert quality.judge(docs.limit(0), quality.constant(0.5)).count() == 0


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    noisy = np.where(rng.random(3000) < 0.05, 1 - y, y)
    trees = quality.fit_trees(x[:2000], noisy[:2000], np.array([-1, 0, -1]))
    assert ((trees.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.95
    grid = np.repeat(x[:50], 40, 0)
    for falling in (0, 2):
        grid[:, falling] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(trees.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
        grid = np.repeat(x[:50], 40, 0)
    assert quality.fit_trees(x[:10], np.ones(10), np.zeros(3)).score(x).min() > 0.5


def test_token_counts(spark):
    scored = {"▁": -1.0, "▁a": -1.5, "ab": -1.0, "a": -2.0, "b": -2.0, "▁ab": -2.0, "c": -0.5, "bc": -1.5, "é": -3.0}
    pieces = trie.piece_table(scored)

    def brute(word):
        word = trie.MARK + word
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = []
            for j in range(max(0, i - pieces.longest), i):
                s = scored.get(word[j:i], pieces.unknown if i - j == 1 else None)
                if s is not None:
                    options.append((best[j][0] + s, -(best[j][1] + 1)))
            s, n = max(options, key=lambda o: (round(o[0], 7), o[1]))
            best.append((s, -n))
        return best[-1][1]

    rng = random.Random(6)
    texts = [None, "", " ", "zzz", *["".join(rng.choice("abcé z\n") for _ in range(rng.randrange(60))) for _ in range(300)]]
    counter = trie.Counter(pieces)
    got = np.concatenate([counter.count(p) for p in W.slices(pa.array(texts), 500)])
    assert got.tolist() == [sum(brute(w) for w in WORD.findall(t or "")) for t in texts]
    docs = documents(spark, [(1, "some words"), (2, None), (3, ""), (1, "some words")])
    rows = trie.token_counts(docs.withColumn("n_tokens", F.lit("old"))).collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert len({r["n_tokens"] for r in rows if r["doc_id"] == 1}) == 1 and trie.token_counts(docs.limit(0)).count() == 0


def test_pairs_of_the_last_step_are_documents_not_places(spark):
    """Two texts that share a passage share many places, but are one pair."""
    rows = [(doc, at, doc == 2, False, token) for doc in (1, 2) for at in range(20) for token in range(at, at + 60)]
    tokens = spark.createDataFrame(rows, "doc_id long, at int, unsettled boolean, repeats boolean, token long")
    assert [tuple(r) for r in passages._prefix_pairs(tokens).collect()] == [(2, 1)]


def test_the_fewest_different_shingles_of_a_passage_through_a_place():
    rng, short = np.random.default_rng(3), passages._SHORT
    for n, kinds in ((46, 3), (91, 30), (200, 1), (200, 20), (120, 1000)):
        hashes = rng.integers(0, kinds, n).astype(np.uint64)
        counts = [len(set(hashes[s : s + short].tolist())) for s in range(n - short + 1)]
        brute = [min(counts[max(0, p - short + 1) : min(p, n - short) + 1]) for p in range(n)]
        assert passages.fewest_different(hashes).tolist() == brute


def test_texts_that_repeat_some_words_and_share_one_line_are_no_pairs(spark, monkeypatch):
    """A word said twice is no reason to compare a text with everything that shares a line with it."""
    rng = random.Random(44)
    line, body = sentence(rng, 40), sentence(rng, 60)
    twice = [sentence(rng, 6) for _ in range(403)]
    rows = [(i, f"{sentence(rng, 60)} {twice[i]} {line} {twice[i]} {sentence(rng, 60)}") for i in range(400)]
    rows += [(500 + i, f"{sentence(rng, 60)} {twice[400 + i]} {line} {twice[400 + i]} {body}") for i in range(3)]
    compared = []
    near_pairs = passages._near_pairs

    def counted(pairs, around):
        compared.append(near_pairs(pairs, around).count())
        return near_pairs(pairs, around)

    monkeypatch.setattr(passages, "_near_pairs", counted)
    spans = passages.duplicate_passages(documents(spark, rows)).collect()
    assert {s["doc_id"] for s in spans} == {501, 502}
    assert compared[0] <= 10
