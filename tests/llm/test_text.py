"""Language, quality, personal data, decontamination and licences."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import decontamination, language, licenses, pii, quality, registry

SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, lang string, windows string, keep string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, df.select(*columns).collect())) == sorted(str(r) for r in df.sparkSession.createDataFrame(cursor.fetchall(), df.select(*columns).schema).collect())


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(table, language.train(table)).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_edges(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(table)
    got = language.identify(docs(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the and of"), (None, "der und die"), (4, "the and of")]), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred == "und") for r in got) == [(0, False), (1, True), (2, True), (3, True), (4, False), (4, False)]
    none = language.train(docs(spark, [(1, "text")]))
    assert [r.lang_pred for r in language.identify(docs(spark, [(1, "text")]), none).collect()] == ["und"]
    assert language.identify(docs(spark, []), model).count() == 0


def test_quality_held_out(spark):
    table, rated = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), quality.ratings(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    half = rated.where("doc_id % 2 = 0")
    rows = quality.score(table, quality.train(table, half)).join(rated.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in rows if r.grade > 0], [r for r in rows if r.grade == 0]
    assert all(r.p_good >= r.p_best for r in rows)
    assert sum(r.keep for r in good) / len(good) > 0.99 and sum(not r.keep for r in bad) / len(bad) > 0.95


def test_quality_rejects_toxic_documents(spark):
    table, rated = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), quality.ratings(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = quality.train(table, rated.where("doc_id % 2 = 0"))
    held = rated.where("doc_id % 2 = 1")
    grade = {r.doc_id: r.grade for r in held.collect()}
    rows = quality.score(table, model).join(held.select("doc_id"), "doc_id").collect()
    toxic, best = [r for r in rows if grade[r.doc_id] == 1], [r for r in rows if grade[r.doc_id] == 2]
    assert all(r.keep or not r.clean for r in rows)
    assert sum(not r.clean for r in toxic) / len(toxic) > 0.9 and sum(r.clean for r in best) / len(best) > 0.96
    kept = {r.doc_id for r in quality.select(table.join(held.select("doc_id"), "doc_id"), model).collect()}
    assert kept == {r.doc_id for r in rows if r.clean}


def test_quality_edges(spark):
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (3, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality.ratings(one).collect()} == {(1, 2), (3, 0)}
    table = docs(spark, [(1, "a"), (2, None), (2, None)])
    assert quality.train(table, quality.ratings(one.limit(0))) is None
    assert [r.keep for r in quality.score(table, None).collect()] == [True] * 3
    model = quality.train(docs(spark, [(1, "fine words here"), (3, "BAD!! BAD!!")]), quality.ratings(one))
    assert quality.score(docs(spark, [(1, None), (None, ""), (7, "x " * 50_000)]), model).count() == 3
    assert quality.select(table, model).columns == table.columns


def test_quality_fit_takes_little_memory_on_the_driver(spark):
    table, rated = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), quality.ratings(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    tracemalloc.start()
    try:
        assert quality.train(table, rated).marks
        assert tracemalloc.get_traced_memory()[1] < 60e6  # a whole table of the rows' features: 110 MB
    finally:
        tracemalloc.stop()


def test_quality_products_of_rows():
    rng = np.random.default_rng(5)
    whole = (rng.random((2 * quality.ROWS_AT_ONCE + 7, 33)) * (rng.random((2 * quality.ROWS_AT_ONCE + 7, 33)) < 0.2)).astype(np.float32)
    whole[[0, 5, 6, quality.ROWS_AT_ONCE, -1], :-1] = 0
    whole[quality.ROWS_AT_ONCE : 2 * quality.ROWS_AT_ONCE, :-1] = 0  # no value in all rows of a part
    rows, at = np.nonzero(whole[:, :-1])
    some = quality.Rows(at.astype(np.int16), whole[rows, at], np.searchsorted(rows, np.arange(len(whole) + 1)), whole[:, -1].copy(), 32)
    order = rng.permutation(len(whole))[:200]
    for x, same in ((some, whole), (some.take(order), whole[order]), (some.take(order[:0]), whole[:0])):
        w, g = rng.random(33).astype(np.float32), rng.random(len(x)).astype(np.float32)
        assert x.shape == same.shape and np.allclose(x @ w, same @ w, atol=1e-5) and np.allclose(g @ x, g @ same, atol=1e-4)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(digits) <= 19 and luhn % 10 == 0) or name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="ab@.-0123456789 +(_%é١", max_size=40), st.text(alphabet="0123456789- ", min_size=14, max_size=25)))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs_take_no_time():
    assert pii.base_spans("a" * 200_000 + "@" * 1000 + "1." * 100_000) == pii.base_spans("a" * 200_000 + "@" * 1000) + [(201_000 + 8 * k, 1, 201_007 + 8 * k) for k in range(25_000)]


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    common = ["stone", "river", "cloud", "grass", "light", "paper"]

    def words(n):
        return " ".join(rng.choice(common) + "abcdefgh"[rng.randrange(8)] for _ in range(n))

    rows = [(i, f"{words(9)} zorblax {words(3)} jo@mail.example.com {words(9)}") for i in range(8)]
    rows += [(100 + i, f"{words(10)} stone river") for i in range(60)] + [(200, None), (201, ""), (202, "nobody")]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    for i in range(8):
        text = rows[i][1]
        assert {text[s.start : s.end] for s in got[i].spans if s.kind == "term"} == {"zorblax"} and [s.kind for s in got[i].base] == ["email"]
    assert all(not got[i].spans for i in (100, 200, 201, 202))
    clean = {r.doc_id: r for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "zorblax" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[200].text is None and clean[100].text == rows[8][1] and clean[0].keep == "clash"
    pii.MOST_SENT, before = 0, pii.MOST_SENT
    try:
        joined = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()}
    finally:
        pii.MOST_SENT = before
    assert joined == {k: r.spans for k, r in got.items()}
    assert pii.find(docs(spark, [])).count() == 0


def plain_terms(rows, share=0.75):
    """(doc_id, start, end) of terms, counted with plain loops."""
    n, spans, near, alone, mentions = len(rows), {}, {}, Counter(), Counter()
    word = re.compile(r"[^\W\d_]{2,}")
    for i, text in rows:
        spans[i] = base = plain_spans(text)
        taken = {p for s, _, e in base for p in range(s, e)}
        words = [(m.start(), m.end(), m[0].lower()) for m in word.finditer("".join("0" if p in taken else c for p, c in enumerate(text)))]
        alone.update({m[0].lower() for m in word.finditer(text)})
        by = {}
        for s, k, e in base:
            wide, close = by.setdefault((k, text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e])), (set(), set()))
            for own, reach in ((wide, 32), (close, 8)):
                own |= {w for *_, w in [x for x in words if x[1] <= s][-reach:] + [x for x in words if x[0] >= e][:reach]}
        for ent, (wide, close) in by.items():
            mentions[ent] += 1
            for w in wide:
                near.setdefault((ent, w), []).append(tuple(sorted(close)))
    out = {}
    for (ent, w), contexts in near.items():
        c, ic = len(set(contexts)), math.log2(n / mentions[ent])
        if ic > 0 and c / (c + 0.5) >= share and math.log2(n * len(contexts) / (alone[w] * mentions[ent])) * c / (c + 0.5) >= share * ic - 1e-12:
            out.setdefault(ent, set()).add(w)
    found = set()
    for i, text in rows:
        terms = set().union(*(out.get((k, text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e])), set()) for s, k, e in spans[i]))
        found |= {(i, m.start(), m.end()) for m in word.finditer(text) if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, _, e in spans[i])}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_terms_against_brute_force(spark, seed):
    rng = random.Random(seed)
    entities = ["jo@mail.example.com", "JO@mail.example.com", "ann.li@x.org", "10.0.0.1", "+49 30 1234 5678"]
    rows = []
    for i in range(300):
        body = [rng.choice(["of", "the", "River", "stone", "Li", "grün", "paper"]) + rng.choice(["", "a", "b", "cc"]) for _ in range(rng.randrange(5, 90))]
        for e in rng.sample(entities, rng.randrange(3) if i % 3 else 0):
            at = rng.randrange(len(body))
            body[at:at] = [rng.choice(["zorb", "mira", "of"]) + str(entities.index(e) // 2 * 11).translate({48: "x", 49: "y", 50: "z"}), "at", e] if rng.random() < 0.7 else [e, e]
        rows.append((i, " ".join(body)))
    rows += [(1000 + i, rows[5][1]) for i in range(10)]
    got = {(r.doc_id, s.start, s.end) for r in pii.find(docs(spark, rows)).collect() for s in r.spans if s.kind == "term"}
    assert got == plain_terms(rows) and got


@pytest.mark.parametrize("text", ["ab@cd.ef, " * 100_000, "word " + "ab@cd.ef, " * 100_000 + " word"])
def test_terms_near_many_mentions_take_linear_time(text):
    began = time.thread_time()
    spans = pii.base_spans(text)
    near = pii.near_terms(text, spans)
    assert len(spans) == 100_000 and len(near) == 1
    fast = time.thread_time() - began
    began = time.thread_time()
    small = text[: len(text) // 8]
    pii.near_terms(small, pii.base_spans(small))
    assert fast < 30 * (time.thread_time() - began) + 1


def test_op4(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pii.op4_pii(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got.values())
    for r in rows:
        spans, names = plain_spans(r.text or ""), list(PATTERNS)
        assert [got[r.doc_id][f"n_{k}"] for k in names] == [sum(names[k] == name for _, k, _ in spans) for name in names]
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= {*got[r.doc_id].spans.split(","), ""}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(text, items):
    w, hit, found = words_of(text), set(), set()
    for key, item in items:
        v = words_of(item)
        n = min(len(v), 10)
        for s in range(len(v) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("inline", [True, False])
def test_decontamination_against_brute_force(spark, monkeypatch, inline):
    rng = random.Random(4)
    long = [" ".join(rng.choice("abcd") for _ in range(14)) for _ in range(3)]
    items = [(1, long[0]), (2, long[1]), (2, long[1]), (11, "Éa bb. CC"), (5, "zz"), (6, ""), (7, None), (None, "q w e"), (9, long[0]), (12, "a b c d a b"), (13, "d d c c b"), (14, "a a b b c c d d a"), (15, "a b a b a b a b a b a b a b")]
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(60))) for i in range(15)]
    rows += [(20, f"x {long[0]} y! {long[1]}"), (21, None), (22, ""), (23, "éa bb cc"), (24, "Éa, BB\tcc -- zz"), (25, long[2] * 200), (26, "q w e"), (None, "zz"), (20, f"x {long[0]} y! {long[1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "MOST_INLINE", 20_000 if inline else 0)
    got = sorted(((r.doc_id or -1, r.n_words, r.n_hit, list(r.items)) for r in decontamination.find(docs(spark, rows), bench).collect()))
    kept = sorted(r.doc_id or -1 for r in decontamination.drop(docs(spark, rows), bench).collect())
    want = sorted((i or -1, *plain_hits(t, [x for x in items if x[0] is not None])) for i, t in rows)
    assert got == want and kept == sorted(i for i, _, n, _ in want if not n)
    assert decontamination.drop(docs(spark, rows), bench).schema == docs(spark, rows).schema
    assert decontamination.find(docs(spark, []), bench).count() == 0 and decontamination.drop(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"][0]
    rows = [(1, "text here\nReleased under the MIT Licence\nmore"), (2, "Copyright (c) 2020 Jo\n\n" + mit.upper().replace(",", " ")), (3, None), (4, ""), (5, "Licensed under the Apache License, version 2.0.\nAll rights reserved."), (6, "the mit license is nice"), (1, "again"), (None, "# SPDX-License-Identifier: GPL-3.0")]
    got = sorted(str((r.doc_id or -1, list(r.licenses), r.n_notices, r.text_license)) for r in licenses.scan(docs(spark, rows)).collect())
    want = [(1, ["MIT"], 1, None), (2, ["MIT"], 0, "MIT"), (3, [], 0, None), (4, [], 0, None), (5, ["Apache-2.0", "LicenseRef-all-rights-reserved"], 2, None), (6, [], 0, None), (1, [], 0, None), (-1, ["GPL-3.0"], 1, "GPL-3.0")]
    assert got == sorted(map(str, want))


def test_licenses_of_a_large_table(spark, monkeypatch):
    """The joined path finds what the one within rows finds; a given table may hold any texts."""
    mine = [("Own-1", "Do as you like\nwith it, but mention us."), ("Own-2", "do AS you like!! with it but mention us"), (None, "nobody's"), ("Own-3", ""), ("Own-4", "A line of its own.")]
    known = spark.createDataFrame(mine, "license string, text string")
    long = "filler words \n" * 30_000
    rows = [(1, "(c) 2020 Jo\nDo as you like -- with it, but mention us."), (2, long + "a LINE of its own\n" + long), (3, None), (4, "nobody's"), (2, "A line of its own."), (None, "A line of its own.\nA line of its own.")]
    got = []
    for most in (50_000, 0):
        monkeypatch.setattr(licenses, "MOST_INLINE", most)
        got.append(sorted(str((r.doc_id or -1, list(r.licenses), r.n_notices, r.text_license)) for r in licenses.scan(docs(spark, rows), known).collect()))
        assert licenses.scan(docs(spark, []), known).count() == 0 and licenses.scan(docs(spark, rows), known.limit(0)).where("size(licenses) > 0").count() == 0
    want = [(1, ["Own-1"], 1, "Own-1"), (2, ["Own-4"], 1, None), (3, [], 0, None), (4, [], 0, None), (2, ["Own-4"], 1, "Own-4"), (-1, ["Own-4"], 2, None)]
    assert got[0] == got[1] == sorted(map(str, want))


def test_whole_licenses(spark):
    rows = [(i, f"Copyright (c) 1999, Jo\n\n{texts[0].upper()}\n") for i, (_, texts) in enumerate(sorted(licenses.TEXTS.items()))]
    got = {r.doc_id: r.text_license for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == sorted(licenses.TEXTS)


def test_samples_take_each_document_once(spark):
    rows = [(i % 7 if i % 3 else None, f"t{i}", "en" if i % 2 else "de") for i in range(600)] + [(1000 + i, "x", "fr") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang) for r in language.sample_by_hash(df, "lang", 100).collect()]
    assert len(got) == len(set(got)) and {k for _, k in got} <= {"de", "en", "fr"} and 60 < sum(k == "fr" for _, k in got) < 220
    assert language.sample_by_hash(df.limit(0), "lang", 100).count() == 0


def test_op2_and_op8(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = language.op2_language(spark, SF).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    rows = quality.op8_quality(spark, SF).collect()
    assert len(rows) == n and all(1 >= r.p_good >= r.p_best >= 0 and abs(r.expected_grade - r.p_good - r.p_best) < 1e-9 for r in rows)


def test_quality_of_repeated_ids(spark):
    rated = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, "fine words here")] * 50 + [(1, "other fine words")] * 50 + [(2, "BAD!! BAD!!"), (2, None)])
    model = quality.train(table, quality.ratings(rated))
    again = quality.train(table.repartition(5), quality.ratings(rated))
    assert (model.weights == again.weights).all() and quality.score(table, model).count() == table.count()


def test_languages_of_very_long_and_repeated_texts(spark):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    long = "the and of this that " * 60_000
    got = [r.lang_pred for r in language.identify(docs(spark, [(1, long), (1, long), (2, "der die und das ist nicht " * 60_000)]), model).collect()]
    assert got[0] == got[1] != "und" and got[2] != "und"
