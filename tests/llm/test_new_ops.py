"""Chat formatting, vector codes and source divergence against brute force, and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dosewell.llm import chat, codes, divergence
from tests.llm.test_ops import LONG, odd

# --- chat formatting

BITS = st.lists(st.sampled_from(["\\", "\\\\", "### ", "### User: ", "### Assistant: ", "### System: ", "### Role a%20b: ", "### Role", "</turn>", "</turn", "\n", "#", "x", " ", "é", "日"]), max_size=12).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "User", "?", "a b:\n</turn>"]), BITS), BITS), max_size=5))
def test_turns_read_back_whatever_they_say(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(p for p, _, _ in pieces))[0] == turns
    for (_, text), (piece, start, length) in zip(turns, pieces):
        assert chat.unescape(piece[start : start + length]) == text
        assert piece[start + length :] == "\n</turn>\n"


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a \\ b \\n ### c")[0] == "### User: a \\ b \\n ### c\n</turn>\n"
    assert chat.render("user", "</turn> \\### User: x")[0] == "### User: \\</turn> \\\\### User: x\n</turn>\n"
    assert chat.render("tool call", "x")[0] == "### Role tool%20call: x\n</turn>\n"


def test_parser_finds_broken_text():
    assert chat.parse("### User: a### Assistant: b\n</turn>\n")[0] == [("user", "a"), ("assistant", "b")]
    assert chat.parse("stray\n")[0] == [("?", "stray\n")]
    assert chat.parse("a\n</turn>\n")[0] == [("?", "a")]


TURNS = "conv_id long, turn long, role string, text string, piece string, source int"


def test_chats_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, "user", "first"), (2, 0, None, "x"), (2, 0, None, "x"), (2, 0, "assistant", ""), (None, 0, "assistant", "ü"), (3, 0, "assistant", LONG), (4, 5, "tool: x\n", "### User: "), (4, 6, "Assistant", "not trained on")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    want = {1: [("user", "first"), ("user", ""), ("assistant", "b")], 2: [("", "x"), ("", "x"), ("assistant", "")], None: [("assistant", "ü")], 3: [("assistant", LONG)], 4: [("tool: x\n", "### User: "), ("Assistant", "not trained on")]}
    assert set(got) == set(want)
    for i, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i]["n_turns"] == len(turns)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[i]["formatted_chars"] == sum(len(chat.render(r, t)[0]) for r, t in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    only = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_turns(chat.with_planted(df.limit(0)))).collect()}
    assert only == {-7: 2}


def test_a_long_conversation_goes_through_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 500)
    df = spark.range(3000).select((F.col("id") % 3 * 0).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</turn> say "), F.col("id").cast("string")).alias("text"))
    [r] = chat.read_back(chat.format_turns(df)).collect()
    assert r["n_turns"] == 3000
    assert r["loss_sha256"] == hashlib.sha256("".join(f"</turn> say {k}" for k in range(1, 3000, 2)).encode()).hexdigest()


# --- vector codes


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """The plain method over (id, vector) rows in Python integers: (codes, errors, codebooks)."""
    x = [[int(np.floor(4096 * float(c))) for c in v] for _, v in vectors]
    w = len(x[0]) // parts
    x = [[tuple(v[m * w : (m + 1) * w]) for m in range(parts)] for v in x]
    first = sorted(range(len(x)), key=lambda k: (vectors[k][0] is None, vectors[k][0]))[:entries]
    book = [[x[k][m] for k in first] for m in range(parts)]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    assign = lambda: [[min(range(len(book[m])), key=lambda e: (far(v[m], book[m][e]), e)) for m in range(parts)] for v in x]
    for _ in range(rounds):
        code = assign()
        for m in range(parts):
            for e in range(len(book[m])):
                members = [v[m] for v, c in zip(x, code) if c[m] == e]
                if members:
                    book[m][e] = tuple(sum(p[k] for p in members) // len(members) for k in range(w))
    code = assign()
    return ["".join(f"{c:02x}" for c in r) for r in code], [sum(far(v[m], book[m][c[m]]) for m in range(parts)) for v, c in zip(x, code)], book


def vectors(kind, n=300):
    rng = np.random.default_rng(7)
    if kind == "noise":
        x = rng.standard_normal((n, 16)) * 0.2
    elif kind == "clusters":
        x = rng.standard_normal((5, 16))[rng.integers(0, 5, n)] + rng.standard_normal((n, 16)) * 0.01
    else:  # many ties and copies: components on a coarse grid
        x = rng.integers(-1, 2, (n, 16)) / 2.0
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n) - 20, x)]


@pytest.mark.parametrize("kind", ["noise", "clusters", "ties"])
def test_codes_are_those_of_the_plain_method(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(i, v, None if i % 7 == 0 else f"l{i % 3}", 5) for i, v in rows], "vec_id long, embedding array<double>, label string, code int").repartition(5)
    got = {r["vec_id"]: r for r in codes.compress(df).collect()}
    code, error, book = plain_codes(rows)
    assert [got[i]["code"] for i, _ in rows] == code
    assert [got[i]["error"] for i, _ in rows] == error
    label = collections.Counter()
    for (i, _), e in zip(rows, error):
        label[None if i % 7 == 0 else i % 3] += e
    assert all(got[i]["label_error"] == label[None if i % 7 == 0 else i % 3] for i, _ in rows)
    digest = hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}


def test_balls_leave_out_work(monkeypatch):
    """Stable balls are not looked at, and rings hold less than all entries."""
    rng = np.random.default_rng(3)
    centres = (np.arange(16)[:, None] * np.ones(4) * 1000).astype(np.int64)
    x = (centres[rng.integers(0, 16, 500)] + rng.integers(-20, 21, (500, 4)))[:, None, :]
    book = centres[None]
    code = codes.assigned(x, np.zeros((500, 1), np.uint8), book, codes.neighbours(book, np.full((1, 16), 1 << 60)), np.zeros((1, 16), bool))
    r2 = np.array([[codes._distances(x[code[:, 0] == e], code[code[:, 0] == e], book).max() for e in range(16)]])
    assert all(len(order) == 0 for order, _ in codes.neighbours(book, r2)[0])
    again = codes.assigned(np.full_like(x, 10**6), code, book, codes.neighbours(book, r2), np.ones((1, 16), bool))
    assert (again == code).all()  # nothing is computed for a stable ball


def test_codes_odd_rows(spark):
    v = [float(k) for k in range(8)]
    rows = [(5, v, 1), (5, v, 1), (None, v, None), (1, None, 1), (2, [None] + v[1:], 1), (3, [float("nan")] + v[1:], 1), (4, [float("inf")] + v[1:], 2), (6, v[:3], 2), (7, [], 2), (8, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit(1))
    got = collections.Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.compress(df).collect())
    # four usable rows: entries are the parts of 5, 5, 8, null; equal ones go to the lower index
    assert got == {(5, "00" * 8, 0, 0): 2, (8, "00" + "02" * 7, 0, 0): 1, (None, "00" * 8, 0, 0): 1}
    assert codes.compress(df.limit(0)).count() == 0
    wide = codes.compress(spark.createDataFrame([(k, [float(k)] * 5, k) for k in range(4)], "vec_id long, embedding array<double>, label int"), parts=2).collect()
    assert sorted(r["code"] for r in wide) == ["0000", "0101", "0202", "0303"]


def test_labels_of_all_frequencies(spark):
    """Frequent labels are looked up, rare ones joined: all rows are there with their label's sum."""
    rows = [(k, [float(k % 37), float(k % 11)] * 4, k if k % 2 else -1) for k in range(4000)]
    got = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=4, rounds=2).collect()
    assert len(got) == 4000
    even = sum(r["error"] for r in got if r["vec_id"] % 2 == 0)
    assert all(r["label_error"] == (r["error"] if r["vec_id"] % 2 else even) for r in got)


# --- source divergence


def plain_divergence(rows, least=10, top=10):
    """(text, lang, source) rows -> result rows, all terms and pairs met one by one."""
    docs = [(t or "", lang or "", s or "") for t, lang, s in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({b: b + 32 for b in range(65, 91)})) for t, _, _ in docs]
    df = collections.Counter((lang, w) for (_, lang, _), ws in zip(docs, words) for w in set(ws))
    kept = collections.defaultdict(set)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].add(w)
    count, groups = collections.Counter(), {(lang, s) for _, lang, s in docs}
    for (_, lang, s), ws in zip(docs, words):
        for w in ws:
            if w in kept[lang]:
                count[lang, s, w] += 1
                count[lang, None, w] += 1
    v = {lang: len(kept[lang]) for lang, _ in groups}
    total = collections.Counter()
    for (lang, s, _), n in count.items():
        total[lang, s] += n
    p = lambda lang, s, w: 1 + 10**9 * (count[lang, s, w] + 2) // (total[lang, s] + 2 * v[lang])
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, s in groups:
        pairs = [(sum(f(p(lang, s, w), p(lang, o, w)) for w in kept[lang]), o) for at, o in groups if at == lang and o != s]
        terms = [(f(p(lang, s, w), p(lang, None, w)), w) for w in kept[lang] if count[lang, s, w] and p(lang, s, w) > p(lang, None, w)]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def same_divergence(spark, rows, **more):
    df = spark.createDataFrame([(k, *r, 1, "h") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, h string")
    assert sorted(tuple(r) for r in divergence.divergence(df.repartition(3), **more).collect()) == plain_divergence(rows, **more)


def test_divergence_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = ["a", "ab", "abc", "abcd", "abcde", "abcdefghi", "abcdefghijklmnopqrstuvwxyz" * 3, "ABCD", "é", "éa", "日本", "日本語", "zz", "İ", "ſ"] + [f"w{'x' * k}{c}" for k in range(5) for c in "abcdef"]
    rows = []
    for k in range(240):
        words = [pool[i] for i in (len(pool) * rng.random(int(rng.integers(0, 25))) ** 2).astype(int)]
        rows.append((rng.choice([" ", "-1_", "\n", "[", "`"]).join(words), str(rng.choice(["en", "en", "fr", "ü"])), f"s{k % 5}" if k % 3 else "s0"))
    same_divergence(spark, rows)
    same_divergence(spark, rows, least=3, top=2)


def test_divergence_odd_rows(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd(spark).collect()]
    same_divergence(spark, rows, least=1)
    same_divergence(spark, rows, least=2)
    same_divergence(spark, rows)  # no term is kept: all pairs are 0
    rows = [("alpha beta", None, None)] * 12 + [("alpha" + "b" * 5000, "", "x")] * 11 + [(None, "de", "x"), ("", "de", "y"), ("1 2", "de", None), ("alpha", "nl", "only")]
    same_divergence(spark, rows)
    assert divergence.divergence(odd(spark).limit(0)).count() == 0


# --- mended operators


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2.0,mit"),
        ("// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\n MPL-2.0", "bsd-3-clause,gpl-2.0"),
        ("released as GNU GPL v3 or later", "gpl-3.0"),
        ("License GPLv2+", "gpl-2.0"),
        ("it is LGPL-2.1-or-later", "lgpl-2.1"),
        ("agpl 3.0", "agpl-3.0"),
        ("see the Unlicense.", "unlicense"),
        ("dedicated with CC0", "cc0-1.0"),
        ("the Llama 2 Community License", "llama-community"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy.", "mit"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy", "bsl-1.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files", "unicode-dfs-2016"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd"),
        ("gplus 3 or mygpl3 or gpl 3.1 and cc00", ""),
    ],
)
def test_common_forms_of_licenses(spark, text, labels):
    from dosewell.llm import licenses

    rows = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert rows[0]["labels"] == labels


def test_no_language_is_lost_to_shared_ids(spark):
    from dosewell.llm import langid

    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"the quick house and {i} other words", "en") for i in free] + [(i, f"le chat de la maison {i} encore", "fr") for i in free]
    for shared in (free[0], free[1], 7777):
        x = rows + [(shared, "zzq xxk wwv qqj", "xx")] * 3000
        df = spark.createDataFrame(x, "doc_id long, text string, lang string")
        sample = {r["lang"]: r["count"] for r in langid.training_sample(df, 50).groupBy("lang").count().collect()}
        assert sample == {"en": 50, "fr": 50, "xx": 1}
    few = langid.training_sample(spark.createDataFrame([(i, "t", f"l{i % 9}") for i in range(90)], "doc_id long, text string, lang string"), 50, most=4)
    assert {r[0] for r in few.select("lang").distinct().collect()} == {"l0", "l1", "l2", "l3"}


def test_machine_against_plain_solver():
    """The dual solved by projected gradient on the whole kernel matrix gives the same plane."""
    import pandas as pd

    from dosewell.llm import langid

    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        index = np.sort(rng.choice(40, 8, replace=False) + (0 if k % 3 else 15))
        value = np.full(8, 8**-0.5)
        rows.append(("a" if k % 3 else "b", index, value, k))
    w = np.array(langid._train(pd.DataFrame([("a", "b", n, i, v, o) for n, i, v, o in rows], columns=["a", "b", "name", "index", "value", "order"]))["w"][0])
    x = np.zeros((60, langid.FEATURES + 1))
    for r, (_, i, v, _) in zip(x, rows):
        r[i], r[-1] = v, 1.0
    y = np.array([1.0 if n == "a" else -1.0 for n, *_ in rows])
    top = np.where(y > 0, 5 / (y > 0).mean(), 5 / (y < 0).mean())
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(60)
    step = np.linalg.eigvalsh(q)[-1]
    for _ in range(40000):
        alpha = np.clip(alpha + (1 - q @ alpha) / step, 0, top)
    plain = (alpha * y) @ x
    cost = lambda v: 0.5 * v @ v + (top * np.maximum(0, 1 - y * (x @ v))).sum()
    assert cost(w.astype(float)) <= 1.02 * cost(plain)
    assert (np.sign(x @ w) == np.sign(x @ plain)).mean() >= 0.95


def test_votes_are_counted():
    from dosewell.llm import langid

    rng = np.random.default_rng(4)
    names = list("abcd")
    pairs = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :]]
    margins = {p: rng.standard_normal(200) for p in pairs}
    best, least = langid._decide(names, pairs, margins, 200)
    for r in range(200):
        won = {n: [m[r] if p[0] == n else -m[r] for p, m in margins.items() if n in p] for n in names}
        votes = {n: sum(v > 0 for v in vs) for n, vs in won.items()}
        top = [n for n in names if votes[n] == max(votes.values())]
        want = max(top, key=lambda n: sum(won[n]))
        assert names[best[r]] == want
        assert least[r] == min(won[want])


def test_long_texts_are_counted_in_slices(spark, monkeypatch):
    from dosewell.llm import tokens

    texts = ["word, and (more) 12 words.\n\nThen  some\ttabs —日本語。テキスト " * 400, "x" * 30000, "ab12" * 8000, " " * 20000 + "end", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoder = tokens.pieces(tokens.default_vocabulary())
    for t in texts[:4]:
        x = np.frombuffer(t.encode(), np.uint8)
        parts = list(encoder.slices(x, 3000))
        assert b"".join(p.tobytes() for p in parts) == t.encode()
        assert sum(int(encoder.counts(p, np.array([0, len(p)]))[0]) for p in parts) == len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)
    assert len(list(encoder.slices(np.frombuffer(texts[0].encode(), np.uint8), 3000))) > 5
    monkeypatch.setattr(tokens, "BATCH_BYTES", 3000)
    x = np.frombuffer(texts[0].encode(), np.uint8)
    ids, at = encoder.rows(x, np.array([0, len(x)]))
    assert ids.tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids and at.tolist() == [0, len(ids)]
    assert df.count() == 5
