"""HTML, mixing, token-id files, packing, embeddings and the pipeline against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relrank.llm import embeddings, html, idfile, mixing, packing, tokens
from relrank.llm import words as W
from relrank.session import scratch_path
from tests.llm.test_text_operators import WORD, brute_components, documents, near_copies, sentence


def encode(text):
    from tokenizers import Tokenizer

    if not hasattr(encode, "own"):
        encode.own = Tokenizer.from_file(tokens.vocabulary_path())
    return encode.own.encode(text or "", add_special_tokens=False).ids


# HTML ----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="menu-open"><header><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">Cookies</div>
<!-- <p>gone</p> --><article class="post"><header class="entry-header"><h1>Head&nbsp;line</h1></header><p>One <b>bo</b>ld &lt;tag&gt;<br>two<p>three   four
<div class="ad-slot">Buy</div><aside>Side</aside><form><p>Mail</p></form><ul><li>a<li>b</ul><div class="comments"><p>First!</p></div>
<template><p>x</p></template></article><aside class="sidebar">More</aside><footer>&copy; us</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, subtree string")


def test_main_text_of_pages(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, None, PAGE), (3, "http://a.example/2", None), (4, "nonsense", ""), (1, "http://a.example/1", PAGE)]
    rows += [(5, "http://b.example", "plain text & <i>more</i> &am"), (6, "http://b.example", "<p class='x>open <b>q</b"), (7, "x", "<script>never closed <p>a")]
    rows.append((8, "http://c.example", "<article>" + "<p>long text</p>\n" * 20_000 + "</article>"))
    got = {r["page_id"]: r for r in html.main_text(pages(spark, [(*r, "extra") for r in rows])).collect()}
    want = "Head line One bold <tag> two three four a b"
    assert got[1]["main_text"] == got[2]["main_text"] == want and got[1]["subtree"] == "extra"
    assert got[3]["main_text"] == got[4]["main_text"] == got[7]["main_text"] == ""
    assert got[5]["main_text"] == "plain text & more &am" and got[8]["main_text"] == " ".join(["long text"] * 20_000)
    assert html.main_text(pages(spark, [])).count() == 0


def test_templates_go_and_articles_stay(spark):
    """Without any telling name, what most pages of a host share goes; what pages of other hosts share, too, stays."""
    rows = []
    for i in range(30):
        body = f"<div><section><p>Welcome to our site</p></section><div><p>Story number {i} of this site</p><p>Same closing words</p></div></div>"
        rows.append((i, f"https://One.example/{i}", f"<body>{body}</body>", None))
        rows.append((100 + i, f"https://host{i}.example/", f"<body>{body}</body>", None))
        rows.append((200 + i, "https://two.example/", "<body><article><p>A copied article</p></article></body>", None))
    got = {r["page_id"]: r["main_text"] for r in html.main_text(pages(spark, rows)).collect()}
    for i in range(30):
        assert got[i] == f"Story number {i} of this site"
        assert got[100 + i] == f"Welcome to our site Story number {i} of this site Same closing words"
        assert got[200 + i] == "A copied article"


def test_counts_alone_take_out_what_a_site_repeats(spark):
    """Pages put together from known blocks, without marks and names, on a large host where each block is on few pages."""
    rng = random.Random(12)
    blocks = [f"<div><p>Box {k}</p><ul><li>link {k}</li></ul></div>" for k in range(40)]
    rows, want, boxes = [], {}, Counter()
    for i in range(200):
        own = [f"Text {i} part {j}" for j in range(rng.randrange(1, 4))]
        shown = rng.sample(range(40), 2)
        boxes.update(shown)
        body = blocks[shown[0]] + "".join(f"<p>{x}</p>" for x in own) + blocks[shown[1]]
        rows.append((i, "http://large.example/x", f"<html><body>{body}</body></html>", None))
        want[i] = (own, shown)
    rows += [(1000 + k, "http://copies.example/", rows[0][2], None) for k in range(20)]
    frame = pages(spark, rows)
    got = {r["page_id"]: r["main_text"] for r in html.main_text(frame, marks=False).collect()}
    for i, (own, shown) in want.items():
        first, last = ("" if boxes[k] >= html.MIN_PAGES else f"Box {k} link {k}" for k in shown)
        assert got[i] == " ".join([first, *own, last]).strip()
    assert len({got[1000 + k] for k in range(20)}) == 1 and want[0][0][0] in got[1000] and "Box" in got[1000]
    found = {(r["host"], r["subtree"]): r["n_pages"] for r in html.site_templates(html.page_subtrees(frame)).collect()}
    brute = Counter()
    for host, source in {("large.example" if i < 1000 else "copies.example", h) for i, _, h, _ in rows}:
        brute.update({(host, d) for d in html.Page(source).digests})
    assert found == {k: n for k, n in brute.items() if n >= html.MIN_PAGES}


def test_what_holds_the_article_stays():
    article = "<article><h1>T</h1><p>Body of it.</p></article>"
    for around in ("<div class='has-sidebar'>{}</div>", "<form>{}<input></form>", "<div class=sidebar>{}</div>", "<div id=page-sidebar><div>{}</div></div>"):
        assert html.Page("<nav>menu</nav>" + around.format(article)).text() == "T Body of it."
        assert html.Page(article + around.format("<article><p>Teaser</p></article>")).text() in ("T Body of it.", "T Body of it. Teaser")
    assert html.Page(article + "<aside><article><p>Teaser</p></article></aside>").text() == "T Body of it."
    assert html.Page("<article><p>a</p><p class='market-share'>b</p><div class='ad-slot'>c</div></article>").text() == "a b"
    assert html.Page("<form><div>the long text of this page</div></form><div class='site-footer'>x</div>").text() == "the long text of this page"


def test_deep_and_odd_pages_take_linear_time():
    for source in ("<div>" * 60_000 + "x", "<a href=\"x>y" * 40_001, "<a b='\"" * 40_000, "<p>a<b>" * 30_000, "<ul><li>" * 30_000, "<a " * 40_000):
        began = time.monotonic()
        html.Page(source).text()
        assert time.monotonic() - began < 20


# Mixing --------------------------------------------------------------------------------------------------------------


def sources(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["big", "mid", None, "small"], [60, 25, 10, 5])[0]
        rows.append((i, " ".join(["w"] * rng.randrange(1, 30)), source))
    rows += [(1000, None, "big"), (1001, "", "mid"), (1002, "", "empty"), (None, "a b", "mid"), (5, *rows[5][1:])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_block", F.lit("x"))


def n_words(text):
    return len(WORD.findall(text or ""))


def weights_of(rows, exponent):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    total = sum(sizes.values())
    power = {s: (n / total) ** exponent for s, n in sizes.items() if n}
    return sizes, {s: p / sum(power.values()) for s, p in power.items()}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values())


@pytest.mark.parametrize("target", [{"max_repeats": 2.0}, {"max_repeats": 3.0, "budget": 5000}, {"entropy": 1.2, "budget": 2000}])
def test_mixing_draws_what_the_weights_ask_for(spark, target):
    rows, docs = sources(spark)
    target = mixing.Target(**target)
    sizes, natural = weights_of(rows, 1.0)
    shares = spark.createDataFrame([(math.log(w),) for w in natural.values()], "log_share double")
    total = sum(sizes.values())
    exponent = mixing.find_exponent(shares, target, total)
    _, weights = weights_of(rows, exponent)
    if target.entropy:
        assert math.isclose(entropy(weights), target.entropy, abs_tol=1e-9)
    else:
        budget = target.budget or total
        passes = [w * budget / sizes[s] for s, w in weights.items()]
        most = max(passes) if target.budget else max(passes) / min(passes)
        assert most <= target.max_repeats + 1e-9 and (exponent == 0 or most > target.max_repeats - 1e-6)
    drawn = mixing.mix(docs, target).collect()
    got = Counter()
    blocks = {}
    for r in drawn:
        got[r["source"]] += n_words(r["text"])
        blocks.setdefault((r["source"], r["mix_block"]), []).append((r["mix_order"], r["doc_id"]))
    budget = target.budget or max(sizes[s] / w for s, w in weights.items())
    for s, w in weights.items():
        assert got[s] <= w * budget + 1e-3 and got[s] > w * budget - 30
    count = Counter(s for _, _, s in rows)
    for (s, b), held in blocks.items():
        if (s, b + 1) in blocks:
            assert len(held) == count[s]  # whole passes before the last block
    orders = [[d for _, d in sorted(v, key=lambda x: x[0])] for k, v in sorted(blocks.items(), key=str) if k[0] == "small"]
    if len(orders) > 1 and len(orders[1]) > 3:
        assert orders[0][: len(orders[1])] != orders[1]
    if target.budget is None:
        assert {r["doc_id"] for r in drawn} == {i for i, _, _ in rows}


def test_mixing_without_tokens_or_rows(spark):
    _, docs = sources(spark)
    assert mixing.mix(docs.limit(0), mixing.Target(max_repeats=2.0)).count() == 0
    empty = docs.where("text is null or text = ''")
    assert mixing.mix(empty, mixing.Target(max_repeats=2.0)).count() == 3
    for bad in ({}, {"entropy": 1.0, "max_repeats": 2.0}, {"max_repeats": 0.5}, {"entropy": 1.0, "budget": -1}):
        with pytest.raises(ValueError):
            mixing.Target(**bad)


def test_mixing_plan_has_no_python(spark):
    _, docs = sources(spark)
    plan = mixing.mix(docs, mixing.Target(max_repeats=2.0))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Token ids -----------------------------------------------------------------------------------------------------------

ODD = [None, "", " ", "a", " a", "a ", "a  b", "x.y, z", "don't stop", "a \n b", " x  ", "a　 b", "\x1c a", "<|endoftext|> x", "日本 語", "end. The"]


def test_encoder_equals_the_library():
    rng = random.Random(3)
    alphabet = list(" \n\t 　ab1.,'é-×日<|")
    texts = [*ODD, *["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)]]
    for cache in (1 << 20, 50):  # a small one forgets all the time
        encoder = tokens.Encoder(cache=cache)
        for part in W.slices(pa.array(texts), 3000):
            ids, starts = encoder.encode(part)
            for i in range(part.rows):
                assert ids[starts[i] : starts[i + 1]].tolist() == encode(texts[part.first + i])


def test_rank_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        ranks = rng.integers(0, 1 << 32, n).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        control, data = idfile.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (idfile.decode_ranks(control, data, n) == ranks).all()
    ids = np.array([7, 70_000, 7, 7, 0, 70_000], np.uint32)
    by_rank, control, data = idfile.encode_block(ids)
    assert np.frombuffer(by_rank, "<u4").tolist() == [7, 70_000, 0] and len(data) == 6
    assert (idfile.decode_block(by_rank, control, data, 6) == ids).all()


@pytest.mark.parametrize("part_bytes", [500, 1 << 20])
def test_token_id_files(spark, part_bytes):
    rng = random.Random(9)
    rows = [(i * 7 % 1000, sentence(rng, rng.randrange(40))) for i in range(120)] + [(2000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (3000, rows[0][1]), (5000, sentence(rng, 5000))]
    docs = documents(spark, rows).repartition(3)
    path = scratch_path(spark, "ids-test")
    idfile.write_ids(docs, path, part_bytes=part_bytes)
    got = {r["doc_id"]: r for r in idfile.document_index(spark, path).collect()}
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*encode(text), 0], "<u4")
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    if part_bytes == 500:
        assert spark.read.parquet(path).select("part").distinct().count() > 3
    empty = scratch_path(spark, "ids-empty")
    idfile.write_ids(docs.limit(0), empty)
    assert idfile.document_index(spark, empty).count() == 0


def check_packing(rows, packed, capacity):
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, texts in rows.items():
        want = Counter()
        for text in texts:
            ids = np.array([*encode(text), 0], "<u4")
            rest = len(ids) % capacity or capacity
            for piece, end in enumerate(range(rest, len(ids) + 1, capacity)):
                start = 0 if piece == 0 else end - capacity
                want[piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc_id]) == want
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in packed)


def test_packing(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(1, 60))) for i in range(500)]
    rows += [(600 + i, "the same text") for i in range(300)] + [(1, rows[1][1]), (2000, None), (2001, ""), (None, "x"), (2002, sentence(rng, 3000))]
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    packed = packing.pack(documents(spark, rows), capacity=256, with_ids=True)
    n, total = check_packing(by_id, packed.collect(), 256)
    assert n <= math.ceil(total / 256) * 1.01 + 1
    held = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    assert len(held) == n and sum(map(len, held.values())) == total and max(map(len, held.values())) <= 256
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("counts", [{2048: 5}, {1: 10_000_000}, {1025: 1000}, {1000: 7, 1048: 9, 24: 3}, {700: 10**6, 3: 10**7}])
def test_packing_plans_place_every_piece(counts):
    histogram = np.zeros(2049, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    segments = packing.plan(histogram)
    assert len(segments) < 5000
    for length, n in counts.items():
        own = sorted((s.first, s.first + s.repeats * s.times) for s in segments if s.length == length)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    used = max(s.sequence + s.repeats for s in segments)
    total = sum(length * n for length, n in counts.items())
    # No sequence holds two pieces of over half its length, nor three of over a third.
    least = max(math.ceil(total / 2048), sum(n for k, n in counts.items() if k > 1024), sum(n for k, n in counts.items() if 682 < k <= 1024) // 2)
    assert used <= least * 1.03 + 1


# Embeddings ----------------------------------------------------------------------------------------------------------


def vector_rows(seed=4, n=160, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.standard_normal((6, d))
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(d) * rng.choice([0.02, 0.1, 0.14])
        rows.append((i * 2 + 3, v.tolist(), int(rng.integers(3))))
    v = rows[0][1]
    rows += [(1001, v, rows[0][2]), (1002, [2 * x for x in v], rows[0][2]), (1003, v, None), (1004, None, 1), (1005, [0.0] * d, 1)]
    rows += [(1006, [float("nan")] * d, 1), (1007, [None, *v[1:]], 1), (1008, [], 1), (1009, v[:5], 1), (rows[3][0], *rows[3][1:])]
    rows += [(1010, [1e-300 * x for x in v], rows[0][2]), (1011, [float("inf"), *v[1:]], 1)]
    return rows


def brute_links(rows, threshold):
    def unit(v):
        if v is None or None in v or not len(v):
            return None
        v = np.array(v, float)
        if not np.isfinite(v).all() or not v.any():
            return None
        v = v / np.abs(v).max()
        return v / np.sqrt(v @ v)

    units = [unit(v) for _, v, _ in rows]
    links = [0] * len(rows)
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is None or y is None or rows[a][2] is None or rows[a][2] != rows[b][2] or len(x) != len(y) or x @ y < threshold:
                continue
            links[a] += 1
            links[b] += 1
            old, new = label[a], label[b]
            label = [new if z == old else z for z in label]
    least = {z: min(rows[i][0] for i in range(len(rows)) if label[i] == z) for z in set(label)}
    return Counter((rows[i][0], links[i], least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [512, 16])
def test_embedding_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = embeddings.near_duplicates(frame).collect()
    assert Counter(tuple(r) for r in got) == brute_links(rows, embeddings.THRESHOLD)
    assert sum(r["n_links"] for r in got) > 500
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 64))
    x = np.concatenate([x, x + rng.standard_normal((300, 64)) * 0.14])
    x /= np.sqrt((x * x).sum(1))[:, None]
    codes, scale, rest = embeddings.quantise(x)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None]
    assert (np.abs(near - x @ x.T) <= rest[:, None] + rest[None] * (1 + rest[:, None])).all()
    a, b, unsure = embeddings.linked_pairs(x, x, 0.98, True)
    want = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
    assert 0 < len(want) and unsure < 5000


# Pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    """Stage by stage on documents with toxic rows, near copies and repeated passages."""
    rng = random.Random(20)
    rows = near_copies(9, groups=3, size=6, words=90)
    shared = sentence(rng, 70)
    rows += [(700 + i, f"{sentence(rng, 200)} {shared} {sentence(rng, 200)}") for i in range(4)]
    toxic = {800 + i for i in range(40)}
    rows += [(i, f"idiot moron {sentence(rng, 40)} clown idiot") for i in sorted(toxic)]
    rows += [(900 + i, sentence(rng, 60)) for i in range(120)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = scratch_path(spark, "pipeline-test")
    labels = [(i, 1, int(i in toxic)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "packing"]
    clean = {i: t for i, t in rows if i not in toxic}
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(clean)
    single = stages["ngram_jaccard"](spark, kept, folder)
    want = brute_components(sorted(clean.items()))
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in want.items() if i == c}
    cut = stages["substring_dedup"](spark, single, folder)
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and sum(shared in (r["text"] or "") for r in texts.values()) == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in texts.values())
    assert texts[905]["text"] == clean[905] and {r["doc_id"] for r in single.collect()} >= set(texts)
    mixed = stages["mixing"](spark, cut, folder)
    assert {r["doc_id"] for r in mixed.collect()} == set(texts) and mixed.columns == docs.columns
    by_id = {}
    for r in mixed.collect():
        by_id.setdefault(r["doc_id"], []).append(r["text"])
    n, total = check_packing(by_id, stages["packing"](spark, mixed, folder).collect(), packing.CAPACITY)
    assert n <= math.ceil(total / packing.CAPACITY) + 1
    whole = corpus_pipeline.run(spark, folder)
    assert whole.agg(F.sum("length")).first()[0] == total


def test_pipeline_rows_that_share_an_id(spark):
    """Repeated ids with equal and unequal texts and missing ids: one row of each copy stays, unique texts all do."""
    rng = random.Random(21)
    copy, unique, shared = sentence(rng, 80), sentence(rng, 80), sentence(rng, 70)
    rows = [(7, copy), (3, copy), (7, unique), (9, "same words here"), (9, "same words here"), (None, copy), (None, copy)]
    rows += [(11, f"{sentence(rng, 90)} {shared}"), (11, f"{shared} {sentence(rng, 30)}"), (11, sentence(rng, 20)), (None, None), (5, "")]
    frame = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    single = stages["ngram_jaccard"](spark, docs, "")
    assert sorted(r["text"] or "" for r in single.collect()) == sorted(t or "" for t in {t for _, t in rows})
    cut = stages["substring_dedup"](spark, single, "").collect()
    texts = [r["text"] or "" for r in cut]
    assert sum(shared in t for t in texts) == 1 and sum(copy in t for t in texts) == 1 and unique in texts
    assert len(cut) == single.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut)
    assert {r["doc_id"] for r in cut if r["text"] == unique} == {7}
