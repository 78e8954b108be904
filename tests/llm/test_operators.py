"""Each operator against brute force on small fixtures with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from inkscore import session
from inkscore.llm import bpe, chat_windows, cross_polytope, decontamination, links, ngram_join, packing, paragraph_dedup, quality_mil, token_counts, toxicity, warc
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, n_tokens string, score string, row string"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(2000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(n, base, edits):
    return [" ".join(rng.choice(WORDS) if rng.random() < edits else w for w in base.split()) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], DOCS)


ODD = [None, "", "   ", "a", "A  b\n\n c<|endoftext|>d", "naïve 你好 😀  ok", "x" * 5000, "don't 12 　 \x1c!"]


@pytest.fixture(scope="module")
def corpus(spark):
    hot = prose(40)
    texts = [prose(rng.randint(1, 60)) for _ in range(40)] + near(30, prose(50), 0.012) + [hot + " " + prose(30) for _ in range(12)] + ODD
    texts += [texts[0]] * 30
    return texts, frame(spark, texts)


def test_counts_equal_the_library(spark, corpus):
    texts, docs = corpus
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, limit=50).collect()}
    ids = bpe.library().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == {k: (len((t or "").encode()), len(e.ids), len(e.ids) > 50) for k, (t, e) in enumerate(zip(texts, ids, strict=True))}
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_packing_is_whole_and_gapless(spark, corpus):
    texts, docs = corpus
    rows = packing.pack_documents(docs, capacity=64, with_ids=True).collect()
    ids = [e.ids + [2] for e in bpe.library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    whole, places = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert own == bytes(r.ids) and zlib.crc32(own) == r.ids_crc32
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == 64 or r.piece == 0
    assert whole == {k: len(v) for k, v in enumerate(ids)}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.1 * sum(map(len, ids)) / 64 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_large_pieces_pair_at_most_twice():
    made = packing.plan({700: 3, 400: 4, 300: 5, 30: 50}, 1024)
    large = {}
    for size in (700, 400):
        for (rank, per, first, _), nxt in zip(made.rows[size], [*[r[0] for r in made.rows[size][1:]], made.used[size]], strict=True):
            for k in range(nxt - rank):
                large[first + k // per] = large.get(first + k // per, 0) + 1
    assert max(large.values()) <= 2


def test_windows_of_the_benchmark(spark, corpus):
    texts, docs = corpus
    items = [(1, texts[3]), (2, "one two"), (3, None), (4, " ".join(texts[45].split()[5:30])), (5, ""), (4, "one two"), (None, "a")]
    texts = [*texts, "zero ONE-two three", "one", "two one two"]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    window = {}
    for item, text in items:
        w = decontamination.words_of((text or "").encode())
        for k in range(max(1, len(w) - 9) if w else 0):
            window.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    for block in (200_000, 5):
        got = {r.doc_id: tuple(r)[1:] for r in decontamination.contamination(docs, bench, block=block).collect()}
        for k, text in enumerate(texts):
            w, hit, found = decontamination.words_of((text or "").encode()), set(), set()
            for own, names in window.items():
                for at in range(len(w) - len(own) + 1):
                    if tuple(w[at : at + len(own)]) == own:
                        hit |= set(range(at, at + len(own)))
                        found |= names
            assert got[k] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not v[4] for v in got.values())
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def expected_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return sorted((x, find(x)) for e in {x for a, b in edges if a != b for x in (a, b)} for x in [e])


@pytest.mark.parametrize("coalesce, held", [(False, 1 << 20), (True, 100), (False, 7)])
def test_components_of_paths_stars_and_cliques(spark, monkeypatch, coalesce, held):
    name = list(range(-400, 400))
    rng.shuffle(name)
    edges = [(name[k], name[k + 1]) for k in range(150)] + [(name[200], name[k]) for k in range(201, 330)] + [(name[a], name[b]) for a in range(340, 352) for b in range(340, 352)]
    edges += [(name[rng.randint(360, 700)], name[rng.randint(360, 700)]) for _ in range(260)] + [(5, 5)] + [(1 << 62, -(1 << 62))]
    edges += edges[:40]
    written, write = [], links.materialise
    monkeypatch.setattr(links, "materialise", lambda df, label: written.append(label) or write(df, label))
    monkeypatch.setattr(links, "_EDGES", held)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, coalesce)
    try:
        got = links.components(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert sorted(map(tuple, got.collect())) == expected_components(edges)
        assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    finally:
        spark.conf.set(key, before)
    assert written == ["edges", "components"] * 2 if held == 1 << 20 else 4 <= len(written) <= 14  # what one task holds takes one pass


@pytest.mark.parametrize("crowd", [4, 24])
def test_components_of_similar_documents(corpus, crowd):
    texts, docs = corpus
    sets = [shingles(t) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs, crowd=crowd).collect()}
    assert got == {k: (len(s), g) for k, (s, g) in enumerate(zip(sets, groups(sets), strict=True))}


def test_repeated_paragraphs_go(spark):
    shared = prose(60)
    texts = ["\n".join([prose(20), shared, "short line"]), "\n".join([shared.upper(), prose(15)]), shared + "\n" + shared, "short line\nshort line", None, ""]
    texts += ["\n".join([prose(14), p]) for p in near(8, prose(100), 0.005)]
    lines = [(k, n, x) for k, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if len(x.split()) >= 12]
    root = groups([shingles(x) for _, _, x in lines])
    gone = {(k, n) for (k, n, _), r, at in zip(lines, root, range(len(lines)), strict=True) if r != at}
    got = {r["row"]["doc_id"]: r for r in paragraph_dedup.without_repeats(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        assert {(k, x["paragraph"]) for x in got[k]["removed"] or []} == {g for g in gone if g[0] == k}
        assert got[k]["text"] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (k, n) not in gone))
    assert paragraph_dedup.without_repeats(frame(spark, [None, ""])).count() == 2


def test_repeated_passages_go(spark):
    run, other, lone = prose(70), prose(55), prose(60).split()
    texts = [prose(60) + " " + run + " " + prose(80), prose(90) + " " + run.upper().replace(" ", "\n", 30) + " " + prose(70)]  # inside long lines, wrapped
    texts += [" ".join([*lone[:30], *lone[30:]]) + " " + prose(9), " ".join(lone[:30]) + " " + run + " " + " ".join(lone[30:])]  # a cut makes neighbours
    texts += [prose(20) + " " + other + " " + prose(30) + " " + other + " " + prose(15), "a " * 300, prose(40) + " " + prose(40), None, ""]
    got = {r["row"]["doc_id"]: r for r in paragraph_dedup.without_repeats(frame(spark, texts)).collect()}
    seen = {}
    for k in sorted(got):
        w = (got[k]["text"] or "").lower().split()
        for n in range(len(w) - 49):
            d, at = seen.setdefault(tuple(w[n : n + 50]), (k, n))
            assert d == k and n - at < 50
    # nothing else goes, and what goes is kept once
    assert [got[k]["n_cut"] for k in range(9)] == [0, 70, 0, 130, 55, 250, 0, 0, 0]
    for k in (0, 2, 6, 7, 8):
        assert got[k]["text"] == texts[k]
    assert got[1]["text"].split() == texts[1].split()[:90] + texts[1].split()[160:]


@pytest.mark.parametrize("width", [1, 2, 3, 41, 64])
def test_least_of_a_window_is_its_first(width):
    values = np.random.default_rng(width).integers(0, 5, 3000).astype(np.uint64)
    places = paragraph_dedup._least(values, width)
    assert places.tolist() == [k + int(values[k : k + width].argmin()) for k in range(len(values) - width + 1)]


def test_windows_of_a_batch_are_not_copied():
    prints = np.random.default_rng(3).integers(0, 1 << 63, 100_000).astype(np.uint64)
    tracemalloc.start()
    try:
        paragraph_dedup._anchors(prints, np.array([0, len(prints)]))
        assert tracemalloc.get_traced_memory()[1] < 12_000_000
    finally:
        tracemalloc.stop()


def test_a_side_is_broadcast_by_its_bytes(spark):
    few = spark.range(10).select("id", F.sequence(F.lit(1), F.lit(1000)).alias("starts"))
    assert "BROADCAST" in links.bounded(few, 1_000_000)._jdf.queryExecution().toString().upper().split("== OPTIMIZED")[0]
    assert "RESOLVEDHINT" not in links.bounded(few, 100_000)._jdf.queryExecution().toString().upper()


def test_texts_reach_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.from_arrays([[batch.nbytes]], ["n"])

    before = spark.conf.get(session.BATCH_KEY)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 500).alias("text"))
    run = session.in_small_batches(lambda docs: session.materialise(docs.mapInArrow(sizes, "n bigint"), "sizes"))
    assert run(texts).agg(F.max("n")).first()[0] < 5_000_000
    assert spark.conf.get(session.BATCH_KEY) == before


def test_archives_round_trip(spark):
    pages = [(1, "a b", "é" * 300), (2, None, "é" * 300), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\n" * 40), (6, "u", "x\r\n\r\n" * 40), (7, "u", "WARC/1.1\r\n\r\n" * 9), (8, "u", "\n" * 101), (9, "u", "s"), (10, "u", "s")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, digest string")
    first, want = {}, {}
    for page, _, html in pages:
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        origin = first.setdefault(digest, page) if len(body) >= 100 else page
        want[page] = (len(body), digest, "response" if origin == page else "revisit", None if origin == page else origin)
    assert {r.page_id: tuple(r)[1:] for r in warc.archived(df, chunk=7).collect()} == want


def test_windows_give_every_turn_back(spark):
    marks = ["<|im_end|>", "<\\|x", "<|", "\n", "é", "assistant", "<", "|>", "word"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb\\n"]) if t else "system", None if rng.random() < 0.1 else " ".join(rng.choice(marks) for _ in range(rng.randint(0, 60)))) for c in (-1, 2) for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat_windows.windows(df, budget=600, history=100, block=32)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_windows.read_back(made).collect()}
    for c in (-1, 2):
        own = sorted(r for r in rows if r[0] == c)
        turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c] == (70, hashlib.sha256(turns).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_windows.windows(df.limit(0)).count() == 0


def test_neighbours_are_found_and_exact(spark):
    gen = np.random.default_rng(2)
    x = gen.normal(size=(400, 16)) * gen.uniform(0.5, 2, (400, 1))
    x[100:160] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        want = sorted(range(400), key=lambda k: (-score[k], k))[:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21)) and all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        hits += sum(score[v] >= score[want[-1]] - 1e-12 for _, v, _ in found)
    assert hits >= 0.9 * 20 * len(got)


def test_every_query_gets_its_neighbours(spark):
    gen = np.random.default_rng(5)
    x = gen.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1] *= 1e4  # one long vector
    y, z = gen.normal(size=(30, 4)), 1e-200 * gen.normal(size=(25, 300))  # rare lengths, far scales
    rows = [(k, v.tolist()) for k, v in enumerate([*x, *y, *z])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")

    def found(block, **more):
        out = {}
        for r in cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, block=block, **more).collect():
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out

    for got, least in ((found(4096), 1.0), (found(8), 0.9), (found(8, tables=1, probes=1), 0.0)):
        hits = wanted = 0
        for q, v in rows[::20]:
            near = sorted((-np.dot(w, v), k) for k, w in rows if len(w) == len(v) and k != q)[:20]
            assert len(set(got.get(q, []))) == len(got.get(q, [])) == len(near)
            hits, wanted = hits + len({k for _, k in near} & set(got[q])) if len(v) != 300 else hits, wanted + (len(near) if len(v) != 300 else 0)
        assert hits >= least * wanted


def test_neighbours_do_not_depend_on_a_size_switch(spark):
    """One search for every number of rows: what is found does not change where a table begins to fill more than a block."""
    x = np.random.default_rng(11).normal(size=(600, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    few = [sorted(map(tuple, cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, tables=1, block=b).select("query_id", "vec_id").collect())) for b in (599, 600)]
    assert few[0] == few[1] and len(few[0]) == 30 * 20


def test_neutral_mentions_move_no_score():
    bad = [f"{g} are {w}" for g in ("women", "muslims") for w in ("scum", "trash", "idiots")] * 10
    good = [f"{g} are {w}" for g in ("men", "christians") for w in ("kind", "late", "here")] * 30
    texts = bad + good
    labels = np.array([1.0] * len(bad) + [0.0] * len(good))
    pairs = [(a, b) for t in texts for a, b in toxicity.swaps(t)]
    split = toxicity.distinct_features
    sides = list(zip(split([a for a, _ in pairs]), split([b for _, b in pairs]), strict=True))

    def gap(fairness):
        model = toxicity.fit(split(texts), labels, sides, least_z=1.0, fairness=fairness)
        score = lambda t: model.weights[np.isin(model.names, split([t])[0])].sum()
        return abs(score("women are here") - score("men are here")), score("men are scum") - score("men are here")

    assert gap(1.0)[0] < 0.2 * gap(0.0)[0] and gap(1.0)[1] > 1


def test_classifiers_on_held_out_documents(spark):
    docs, labels = [], []
    for k in range(300):
        toxic, low = k % 5 == 1, k % 4 == 2
        text = prose(80) if not low else " ".join(rng.choice(WORDS) + "***" for _ in range(80))
        docs.append((k, text + (" scum idiot" if toxic else ""), "x", "y", "z"))
        labels.append((k, int(not low), int(toxic), "w"))
    docs += [(1000, None, "", "", ""), (1001, "", "", "", ""), (None, "text", "", "", "")]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")
    for found, at in ((toxicity.toxicity(d, lab), 2), (quality_mil.quality(d, lab), 1)):
        rows = {r.doc_id: r for r in found.collect()}
        assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows.values())
        held = [k for k in range(300) if rows[k].held_out]
        assert sum(rows[k].predicted == labels[k][at] for k in held) >= 0.95 * len(held) > 30
        assert rows[1000].score == rows[1001].score
    assert toxicity.toxicity(d, lab.limit(0)).filter("predicted = 1").count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(30) for _ in range(12)] + [None, "", "scum"]
    docs = frame(spark, texts + texts[:3])
    bench = [(1, texts[5])]
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(out.count())
    assert sizes == [18, 15, 15, 14, 14]


def test_only_texts_cut_last_are_searched_again(spark, monkeypatch):
    run, lone = prose(70), prose(60).split()
    texts = [prose(60) + " " + run, prose(90) + " " + run, prose(300), prose(200)]
    texts += [" ".join(lone), " ".join(lone[:30]) + " " + run + " " + " ".join(lone[30:])]  # a cut makes neighbours
    written, write = [], paragraph_dedup.materialise
    monkeypatch.setattr(paragraph_dedup, "materialise", lambda df, label: written.append((label, made := write(df, label))) or made)
    got = {r["row"]["doc_id"]: r["n_cut"] for r in paragraph_dedup.without_repeats(frame(spark, texts + texts[:1])).collect()}
    assert [got[k] for k in range(6)] == [0, 70, 0, 0, 0, 130]
    docs = [made.select("doc").distinct().count() for label, made in written if label == "anchors"]
    assert docs == [6, 2, 0]  # the last text is one repeated paragraph and goes; document 5 has no window left


def test_two_bands_meet_once(spark, monkeypatch):
    base = prose(100)
    texts = near(40, base, 0.03)
    given, group = [], paragraph_dedup.shared
    monkeypatch.setattr(paragraph_dedup, "shared", lambda keys: given.append(keys) or group(keys))
    docs = frame(spark, texts).withColumn("doc", F.col("doc_id"))
    paragraph_dedup.repeated_paragraphs(docs, crowd=2).count()
    assert len(given) == 2
    per_id = given[1].groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))
    assert per_id.count() and per_id.filter("n > 120 or n != keys").isEmpty()


def test_stages_end_in_small_batches(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, [prose(30) for _ in range(6)])
    spark.createDataFrame([(k, 1, 0) for k in range(3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(12))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, docs, str(tmp_path))
        assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty() and docs.exceptAll(out).isEmpty()


def test_a_text_travels_once(spark):
    docs = frame(spark, [*ODD, "a"])
    rows, whole = session.text_once(docs)
    assert "text" not in rows.schema["row"].dataType.fieldNames()
    assert rows.select(whole.alias("row")).select("row.*").exceptAll(docs).isEmpty()
    bytes_ = docs.withColumn("text", F.col("text").cast("binary"))
    rows, whole = session.text_once(bytes_)
    assert rows.select(whole.alias("row")).select("row.*").schema == bytes_.schema
