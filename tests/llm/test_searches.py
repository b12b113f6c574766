"""Decontamination, license scan and chat formatting against brute force."""

import random
from itertools import product

import numpy as np
import pytest
from conftest import DATA

from tandemlens.llm import chat, decontaminate, licenses

LARGER = "/root/testdata/sf0.01"


def plain_distance(item, text):
    """Least word edit distance between item and any stretch of text, row by row."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(400):
        item = rng.choices(range(4), k=rng.randint(1, 9))
        text = rng.choices(range(4), k=rng.randint(0, 25))
        got = decontaminate.edit_distance(decontaminate.pattern(np.array(item, np.uint64)), len(item), text)
        assert got == plain_distance(item, text)


def edited(words, edits, vocabulary, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        else:
            del words[at]
    return words


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(6)
    common = "the of and that with from is was".split()
    vocabulary = ["".join(rng.choices("aeioubcdfgst", k=rng.randint(3, 9))) for _ in range(3000)]
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [sentence(rng.randint(8, 70)) for _ in range(60)]
    docs, planted = [], {}
    for i in range(600):
        words = sentence(rng.randint(0, 300))
        if i % 2:
            k = rng.randrange(60)
            n = rng.randint(0, int(0.15 * len(items[k])))
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(items[k], n, vocabulary, rng)
            planted[i, k] = n
        docs.append((i, (" " if i % 3 else "\n").join(w.upper() if i % 7 == 0 else w + "," * (i % 5 == 0) for w in words)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    clean = [w.lower().replace(",", "").split() for _, w in docs]
    near = [p for p in planted if plain_distance(items[p[1]], clean[p[0]]) <= 0.2 * len(items[p[1]])]
    exact = [p for p in planted if planted[p] == 0]
    assert all(found.get(p) == 0 for p in exact) and len(exact) > 30
    assert sum(p in found for p in near) / len(near) >= 0.95
    for (i, k), distance in found.items():
        assert plain_distance(items[k], clean[i]) <= distance <= 0.2 * len(items[k])


def test_decontamination_query_finds_what_brute_force_finds(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()
    words = {r.doc_id: decontaminate.words_of(r.text, decontaminate.Chunks(decontaminate.symbols_of)).tolist() for r in docs}
    want = {}
    for r in items:
        item = decontaminate.words_of(r.text, decontaminate.Chunks(decontaminate.symbols_of))
        pattern = decontaminate.pattern(item)
        for doc_id, text in words.items():
            d = decontaminate.edit_distance(pattern, len(item), text)
            if d <= 0.2 * len(item):
                want[doc_id, r.item_id] = d
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.op2_decontamination(spark, LARGER).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) >= 20


def test_decontamination_edge_cases(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, text), (3, text), (None, "x " + text), (4, "one two " * 30_000), (5, "five six")],
        "doc_id bigint, text string",
    ).selectExpr("*", "1 as item_id", "'k' as row")
    bench = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "one two"), (5, "")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (3, 1, 0), (3, 2, 0)]
    kept = decontaminate.decontaminate(docs, bench).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4, 5] and kept[0].row == "k"
    assert decontaminate.leaks(docs.filter("false"), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.filter("false")).count() == 7


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def shingles(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_scan(docs, templates):
    out = {}
    for (doc_id, text), (t, _, wording) in product(docs, templates):
        own, parts = shingles(plain_words(wording)), shingles(plain_words(text))
        need = set(own)
        if need & set(parts):
            for j in range(-1, len(parts) // len(own) + 1):
                n = len(need & set(parts[max(0, j * len(own)) : (j + 2) * len(own)]))
                if n >= 0.8 * len(need):
                    out[doc_id, t] = max(n, out.get((doc_id, t), 0))
    return out


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(8)
    filler = ["".join(rng.choices("abcdefg", k=5)) for _ in range(500)]
    templates = [(i, name, text) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    docs = [(1000, None), (1001, ""), (1002, "the mit license"), (1003, "word " * 60_000)]
    for i in range(400):
        words = rng.choices(filler, k=rng.randint(0, 120))
        wording = rng.choice(templates)[2].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            wording[rng.randrange(len(wording))] = rng.choice(filler)
        at = rng.randrange(len(words) + 1)
        words[at:at] = wording
        text = " ".join(words)
        docs.append((i, text.upper() if i % 4 == 0 else text.replace(" ", "\n", i % 3)))
    want = plain_scan(docs, templates)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as pos")
    got = {(r.doc_id, r.template_id): r.n_shared for r in licenses.scan(frame, licenses.default_templates(spark)).collect()}
    assert set(got.items()) <= set(want.items())
    assert len(got) >= 0.97 * len(want) and len(want) > 250


def test_license_scan_repeats_nulls_and_empty(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, line), (1, line), (None, "x\n" + line)], "doc_id bigint, text string")
    own = licenses.default_templates(spark)
    got = sorted((r.doc_id or 0, r.license, r.n_shared, r.n_template) for r in licenses.scan(docs, own).collect())
    assert got == [(0, "MIT", 1, 1), (1, "MIT", 1, 1)]
    assert licenses.scan(docs.filter("false"), own).count() == licenses.scan(docs, own.filter("false")).count() == 0


@pytest.mark.parametrize("module", [chat.op1_chat_format, licenses.op3_license_scan])
def test_native_queries_run_no_python(spark, module):
    plan = module(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_chat(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            talks.setdefault(conv, set()).add((turn, role or "", text or ""))
    talks = {c: sorted(t) for c, t in talks.items()}
    out = {}
    for c, t in talks.items():
        steps = lambda x, upto: [y for y in x if y[0] <= upto]
        longer = [d for d, u in talks.items() if u[-1][0] > t[-1][0] and steps(u, t[-1][0]) == t]
        copies = [d for d, u in talks.items() if u == t]
        if not longer and c == min(copies):
            shown = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in t)
            out[c] = (len(t), len(copies), shown)
    return out


def test_chat_collapse_equals_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(300):
        base = rng.randrange(12)
        for turn in range(rng.choice([1, 2, 3, 5, 300]) if conv < 40 else rng.randint(1, 5)):
            text = f"{base} says {turn}" if rng.random() < 0.95 else f"other {rng.random()}"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += rng.choices(rows, k=200)  # repeated rows
    rows += [(None, 0, "user", "lost"), (5, None, "user", "lost"), (400, 0, None, None), (401, 0, "", ""), (402, 0, "user", "a"), (402, 0, "bot", "b")]
    rows += [(403, -3, "user", "below zero"), (404, -3, "user", "below zero"), (404, 2, "bot", "y" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as part", "2 as k1")
    got, parts = {}, {}
    for r in sorted(chat.render(frame).collect(), key=lambda r: (r.conv_id, r.part)):
        n, copies, shown = got.get(r.conv_id, (0, r.n_copies, ""))
        got[r.conv_id] = (n + r.n_turns, copies, shown + r.rendered)
        parts[r.conv_id] = max(r.n_turns, parts.get(r.conv_id, 0))
    assert got == plain_chat(rows)
    assert max(parts.values()) == 256
    assert chat.render(frame.filter("false")).count() == 0
