"""Structure repair, collocations and harmonic packing against brute force on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkscore.llm import bpe, collocations, harmonic, structure_repair

rng = random.Random(7)
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEEDED = {"": "u", "s": "u", "u": "a", "a": "u"}
FORBIDDEN = (structure_repair.BLANK, structure_repair.DUPLICATE)


def every_repair(rows):
    """Cost and edits of all repairs that are not dearer than deleting all rows."""
    found, bound = [], 4 * len(rows)

    def go(i, state, cost, edits):
        if cost > bound:
            return
        if i == len(rows) and state in ("", "a"):
            found.append((cost, edits))
        go(i, NEEDED[state], cost + 3, edits + "I")
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, state, cost + 4, edits + "D")
            if fault not in FORBIDDEN:
                extra = 3 * (fault == structure_repair.TRUNCATED)
                if (state, initial) in NEXT:
                    go(i + 1, NEXT[state, initial], cost + extra, edits + "K")
                go(i + 1, NEEDED[state], cost + extra + 3, edits + "R")

    go(0, "", 0, "")
    return min(found)


def whole_strings(rows):
    """The same by paths that are kept as complete strings."""

    def inserted(best):
        for state in ("", "s", "u", "a", "u"):
            if state in best:
                cost, edits = best[state]
                best[NEEDED[state]] = min(best.get(NEEDED[state], (1 << 60, "")), (cost + 3, edits + "I"))
        return best

    best = inserted({"": (0, "")})
    for initial, fault in rows:
        new = {}

        def offer(state, *path, new=new):
            new[state] = min(new.get(state, path), path)

        for state, (cost, edits) in best.items():
            offer(state, cost + 4, edits + "D")
            if fault not in FORBIDDEN:
                extra = 3 * (fault == structure_repair.TRUNCATED)
                if (state, initial) in NEXT:
                    offer(NEXT[state, initial], cost + extra, edits + "K")
                offer(NEEDED[state], cost + extra + 3, edits + "R")
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def searched(rows):
    search, out = structure_repair.Search(), b""
    for initial, fault in rows:
        out += search.step(initial, fault)
    cost, rest = search.finish()
    return cost, (out + rest).decode()


def test_search_finds_the_cheapest_least_edits():
    kinds = ["", "", structure_repair.TRUNCATED, *FORBIDDEN]
    for _ in range(1500):
        rows = [(rng.choice("uuaasst") if rng.random() < 0.95 else "", rng.choice(kinds)) for _ in range(rng.randint(0, 5))]
        assert searched(rows) == every_repair(rows) == whole_strings(rows)
    for letters, faults in itertools.product(("ua", "uast", "t", "u", "s"), (kinds, [""], [FORBIDDEN[0]])):
        rows = [(rng.choice(letters), rng.choice(faults)) for _ in range(300)]
        assert searched(rows) == whole_strings(rows)


def size_of(node):
    return 1 + len(node.edits) + sum(map(size_of, node.children))


def test_survivors_coalesce():
    search, most, out = structure_repair.Search(), 0, 0
    for _ in range(20_000):
        out += len(search.step(rng.choice("uuaas"), rng.choice(["", "", "", structure_repair.TRUNCATED, FORBIDDEN[0]])))
        most = max(most, size_of(search.root))
    assert out > 19_000 and most < 500
    search = structure_repair.Search()  # nothing is settled here, yet the tree stays a byte an edit and a few nodes
    for _ in range(5_000):
        search.step("t", "")
    nodes = 0
    stack = [search.root]
    while stack:
        node = stack.pop()
        nodes += 1
        stack += node.children
    assert nodes <= 8 and size_of(search.root) < 4 * 5_000


def expected_repair(turns, conv):
    rows = []
    for c, turn, role, text in turns:
        if c != conv:
            continue
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    cost, edits = whole_strings([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    lines, at, state = [], 0, ""
    for edit in edits:
        if edit == "I":
            state = NEEDED[state]
            lines.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            state = NEXT[state, role[:1]]
            lines.append(f"{role}:{text}")
        elif edit == "R":
            state = NEEDED[state]
            lines.append(f"{ {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    turns_left = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns_left) - min(turns_left) + 1 - len(set(turns_left)) if turns_left else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or len(a[1][:1]) != 1 for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TURNS = "conv_id bigint, turn bigint, role string, text string, place string, fault string, digest string"


def test_repair_equals_brute_force(spark):
    turns = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Well.", "Well. ", "no end", "", "  \n", None, "x" * 3000 + "!", "ça va?", " nbsp", f"t{turn}."])
            turns.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    turns += turns[:20]
    turns += [(77, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(3000)]  # one conversation with most rows
    df = spark.createDataFrame([(*t, "x", "y", "z") for t in turns], TURNS)
    made = structure_repair.repair_damaged(df)
    got = {r["conv_id"]: tuple(r[c] for c in made.columns[1:]) for r in made.collect()}
    assert made.columns[1:] == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got == {c: expected_repair(turns, c) for c in {t[0] for t in turns}}
    assert structure_repair.repair_damaged(df.limit(0)).count() == 0


def test_repaired_turns_are_a_table(spark):
    turns = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "So."), (1, 3, "user", "And?"), (2, 0, "assistant", "")]
    rows = structure_repair.rows_of(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    places = structure_repair.ordered(rows)
    made = structure_repair.repaired(rows, places, structure_repair.edits(places))
    got = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in made.orderBy("conv_id", "number").collect() if r["edit"]]
    assert got[:3] == [(1, "K", "user", "Hi."), (1, "D", None, None), (1, "R", "assistant", "So.")]
    assert [g for g in got if g[0] == 2] == [(2, "D", None, None)]
    assert re.fullmatch("(s?(ua)+)?", "".join(g[2][0] for g in got if g[2]))


def expected_phrases(docs, at_least, best):
    counts = {}
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3, 4):
                own.update(" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if " " not in p)
        rows = []
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) == 1 or a < at_least:
                continue
            longer = [f[q] for q in f if len(q.split(" ")) > len(words) and f[q] >= at_least and f" {phrase} " in f" {q} "]
            if any(100 * x >= 80 * a for x in longer):
                continue
            cuts = [(2_000_000 * a // (f[" ".join(words[:k])] + f[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.append((-score, -a, phrase.encode(), f[" ".join(words[:k])], f[" ".join(words[k:])]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    common = ["the", "Of", "and", "to", "in", "naïve", "schön", "x\xa0y", "\x1c"]
    made = []
    for k in range(120):
        words = [rng.choice(common) if rng.random() < 0.8 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 80))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!? "]) for w in words)
        made.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    made += [("en", "again and again and again " * 40), ("en", "same " * 500), ("en", "same\t" * 300), (None, None), ("de", ""), ("fr", "...")]
    made += [made[0]] * 30
    df = spark.createDataFrame([(k, lang, text, 0, "x") for k, (lang, text) in enumerate(made)], "doc_id bigint, lang string, text string, n int, phrase string")
    got = collocations.phrases(df, at_least=5, best=60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected_phrases(made, 5, 60)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    few_bits = collocations.phrases(df, at_least=5, best=60, bits=7)  # a full bitmap lets rare phrases through to be counted
    assert sorted(map(tuple, few_bits.collect())) == want
    assert collocations.phrases(df.limit(0)).count() == 0


def test_words_of_one_number_take_another_table(spark, monkeypatch):
    made = [("en", "ab ba cd ab ba cd, ab ba. " * 6), ("de", "ab cd ba " * 9)]
    df = spark.createDataFrame(made, "lang string, text string")
    alike = np.repeat(collocations.TABLES[0][:1], 256)  # all words of one length have one number
    chunks = collocations.parse(df)
    assert collocations.numbered(chunks, (alike, collocations.TABLES[1]))[1] is collocations.TABLES[1]
    with pytest.raises(ValueError):
        collocations.numbered(chunks, (alike,))
    monkeypatch.setattr(collocations.numbered, "__defaults__", ((alike, *collocations.TABLES),))
    assert sorted(map(tuple, collocations.phrases(df, at_least=5, best=60).collect())) == expected_phrases(made, 5, 60)


def test_words_that_are_names_of_languages_have_numbers_of_their_own(spark):
    made = [("en", "en de en fr, de en " * 6), ("de", "de en fr de, en " * 9), ("fr", "fr de und en " * 7), (None, "und fr en und " * 8)]
    df = spark.createDataFrame(made, "lang string, text string")
    assert collocations.numbered(collocations.parse(df))[1] is collocations.TABLES[0]  # words are counted once
    assert sorted(map(tuple, collocations.phrases(df, at_least=5, best=60).collect())) == expected_phrases(made, 5, 60)


def test_phrase_prints_are_joint_numbers(spark):
    batch = pa.RecordBatch.from_arrays([["en"], ["a b c d"], [1]], ["lang", "chunk", "n"])
    c = collocations.Chunks(batch, collocations.TABLES[0])
    names = collocations.PLACES[:3]
    row = spark.createDataFrame([tuple(c.ids[:3].view(np.int64).tolist())], ", ".join(f"{x} bigint" for x in names))
    for n in (1, 2, 3):
        assert row.select(collocations.joint(names[:n])).first()[0] == int(c.phrase_prints(n).view(np.int64)[0])


def test_phrases_are_counted_without_their_texts(spark, monkeypatch):
    schemas, over = [], collocations._over
    monkeypatch.setattr(collocations, "_over", lambda chunks, made, schema, *more: schemas.append(schema) or over(chunks, made, schema, *more))
    df = spark.createDataFrame([("en", "one two three four " * 20)], "lang string, text string")
    assert collocations.phrases(df, at_least=5).count() > 0
    assert [x.count("string") for x in schemas] == [2, 0, 0, 0] and [x.count("bigint") - 1 for x in schemas[1:]] == [2, 3, 4]


def test_a_parse_owns_each_word_once(spark):
    text = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(3000)) + " " + "same " * 700
    chunks = collocations.parse(spark.createDataFrame([("en", text)] * 3, "lang string, text string"))
    counted = {r["phrase"]: r["f"] for r in collocations.word_counts(chunks).collect()}
    assert counted == {w: 3 * n for w, n in Counter(text.split()).items()}
    assert chunks.count() < 800 and {r["n"] for r in chunks.filter("chunk not like '%same%'").collect()} == {3}


ODD = [None, "", "   ", "A  b\n\n c<|endoftext|>d", "naïve 你好 😀  ok é", "x" * 5000, "don't 12 　 \x1c!", "word " * 4000]


@pytest.mark.parametrize("group_ids", [1 << 22, 300])
def test_harmonic_packing_is_whole_gapless_and_without_padding(spark, group_ids):
    texts = [" ".join(rng.choice(["alpha", "betas", "gamma!", "12"]) for _ in range(rng.randint(0, 90))) for _ in range(150)] + ODD
    texts += [texts[0]] * 30
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id bigint, text string, start string, sequence_id string")
    rows = harmonic.pack_documents(docs.repartition(3), capacity=64, group_ids=group_ids, with_ids=True).collect()
    name = "word_bpe_49k.json"
    ids = [e.ids + [1] for e in bpe.library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    at, fill = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert own == bytes(r["ids"]) and zlib.crc32(own) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["start"] == at[r["doc_id"]] and r["length"] > 0
        at[r["doc_id"]] += r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {k: len(v) for k, v in enumerate(ids)}
    for pieces in fill.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 64 and total & (total - 1) == 0
    assert len(rows) < 1.6 * len(texts) + sum(map(len, ids)) / 64


def test_harmonic_packing_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] is None, r["length"], r["doc_tokens"]) for r in harmonic.pack_documents(docs).collect()))
    assert sum(g[1] for g in got) == 9 and {g[2] for g in got} == {1, 4}
    assert harmonic.pack_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        harmonic.pack_documents(docs, capacity=100)


def test_classes_hold_a_fixed_number():
    sizes = np.array([rng.randint(1, 127) for _ in range(4000)])
    doc, _, length, sequence, offset = harmonic.pack_group(sizes, 128)
    whole = length == sizes[doc]
    uncut = np.bincount(sequence[whole])
    opened = {s: int(n) for s, n, o in zip(sequence[whole], sizes[doc[whole]], offset[whole], strict=True) if o == 0}
    assert sum(uncut[s] >= 128 // n for s, n in opened.items()) > 0.95 * len(opened) > 100
    assert len(doc) < 1.5 * len(sizes)
