"""Token files, packing and separator scans against the library and plain loops."""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomlog.llm import packing, separators, token_files, tokens

TEXTS = [None, "", "  ", "One line.\nTwo  spaces\tand a tab, l'été ΑΣ ı İ.", "<|endoftext|> isn't special!!", "word " * 3000, "a\x00b", "x" * 5000, "é|\n|ﬁ́ ’ll", "One line.\nTwo  spaces\tand a tab, l'été ΑΣ ı İ."]
SCHEMA = "doc_id long, text string, file int, n_tokens string, rank int"


def docs(spark, texts=TEXTS, keys=None):
    rows = [(i if keys is None else keys[i], t, 9, "clash", 1) for i, t in enumerate(texts)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def library(name, literal=False):
    t = Tokenizer.from_file(tokens.tokenizer_file(name))
    if literal:
        t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PIECES = st.one_of(st.text(alphabet="aB .,'\n\t|!1éßΣı́İ中\x00😀", max_size=30), st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " ", "<|", "a"]))


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=4).map("".join), max_size=5))
def test_encoder_is_the_library(name, literal, texts):
    known = _ENCODERS.setdefault((name, literal), tokens.Encoder(name, 4, literal, most=2_000))
    assert known.kind != "whole"
    if (name, literal) not in _LIBRARIES:
        _LIBRARIES[name, literal] = library(name, literal)
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(texts)] == [_LIBRARIES[name, literal](t) for t in texts]
    assert sum(200 + 2 * len(k) + len(v) for x in (known.parts, known.parts.old) for k, v in x.items()) <= 2_400


_LIBRARIES, _ENCODERS = {}, {}


def test_a_separators_string_in_a_text():
    assert np.frombuffer(tokens.encoder("byte_bpe_50k.json", 4).encode(["<|endoftext|>"])[0], "<u4").tolist() == [50256]
    assert np.frombuffer(tokens.encoder("word_bpe_49k.json", 4).encode(["<|endoftext|>"])[0], "<u4").tolist() == [49407]
    assert 50256 not in np.frombuffer(tokens.encoder("byte_bpe_50k.json", 4, literal=True).encode(["<|endoftext|>"])[0], "<u4").tolist()


WORDS = st.lists(st.tuples(st.sampled_from([" ", "\n", "", " ", ","]), st.text(alphabet="abÀÖ×Øàö÷øȿɀɏʰªµº\xa0.,'-9", min_size=1, max_size=4)).map("".join), max_size=12).map("".join)


@pytest.mark.parametrize("strung", [2, 500])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(WORDS, max_size=6))
def test_strung_words_are_the_library(strung, texts):
    if strung not in _ENCODERS:
        _ENCODERS[strung], _LIBRARIES[strung] = tokens.Encoder("byte_bpe_50k.json", 4), library("byte_bpe_50k.json")
    known, ids_of = _ENCODERS[strung], _LIBRARIES[strung]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "STRUNG", strung)
        assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(texts)] == [ids_of(t) for t in texts]


def test_new_words_go_to_the_model_together():
    class Counting:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, text):
            self.calls += 1
            return self.model.tokenize(text)

    rnd = random.Random(3)
    texts = ["Start " + " ".join("".join(rnd.choices("aeilnorstéü", k=9)) + rnd.choice(["", ",", "."]) for _ in range(400)) for _ in range(10)]
    known, ids_of = tokens.Encoder("byte_bpe_50k.json", 4), library("byte_bpe_50k.json")
    known.parts.model = model = Counting(known.parts.model)
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(texts)] == [ids_of(t) for t in texts]
    assert model.calls < 10 and len(known.parts) < 10


@pytest.mark.parametrize("model", [{"merges": [["a", "Ġ"], ["Ġ", "b"], ["Ġb", "a"]]}, {"merges": [["Ġ", "b"]], "ignore_merges": True}])
def test_merges_over_spaces_and_words_without_merging(tmp_path, model):
    spec = json.loads(Path(tokens.tokenizer_file("byte_bpe_50k.json")).read_text())
    chars = [chr(c) for c in tokens._BYTE_CHARS.values()]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate([*chars, "aĠ", "Ġb", "Ġba", "Ġbab"])}} | model
    (path := tmp_path / "t.json").write_text(json.dumps(spec))
    texts = ["a ba bab a, ba ab aa", "", " ba bb é bab."]
    known, ids_of = tokens.Encoder(str(path), 4), library(str(path))
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(texts)] == [ids_of(t) for t in texts]


def test_token_files_round_trip(spark, tmp_path):
    path, ids_of = str(tmp_path / "t"), library("word_bpe_49k.json")
    token_files.write(docs(spark), path, "word_bpe_49k.json", docs_per_file=3)
    got = token_files.read(spark, path, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for i, r in enumerate(got):
        ids = [*ids_of(TEXTS[i]), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, start, len(ids), crc(ids), ids)
        start += len(ids)
    assert token_files.manifest(spark, path).count() > 1
    assert token_files.read_document(spark, path, 3) == [[*ids_of(TEXTS[3]), 1]] and token_files.read_document(spark, path, 99) == []


def test_token_files_null_and_repeated_ids_and_empty_tables(spark, tmp_path):
    token_files.write(docs(spark, ["b", "a", "c"], [None, 4, 4]), str(tmp_path / "n"), "word_bpe_49k.json")
    got = token_files.read(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 4, 4] and [r.start for r in got] == [0, 2, 4]
    assert len(token_files.read_document(spark, str(tmp_path / "n"), None)) == 1 and len(token_files.read_document(spark, str(tmp_path / "n"), 4)) == 2
    token_files.write(docs(spark, []), str(tmp_path / "e"), "word_bpe_49k.json")
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_id_are_spread_over_files(spark, tmp_path, key):
    path = str(tmp_path / "t")
    token_files.write(docs(spark, [f"text {i % 3}" for i in range(400)] + ["z"], [key] * 400 + [9]), path, "word_bpe_49k.json", docs_per_file=50)
    held = {r.file: r.docs for r in token_files.manifest(spark, path).collect()}
    assert len(held) > 5 and max(held.values()) < 120 and sum(held.values()) == 401
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [key] * 400 + [9]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(401)]
    assert len(token_files.read_document(spark, path, key)) == 400


@settings(max_examples=200, deadline=None)
@given(bounds=st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=6, unique=True), rows=st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), max_size=20))
def test_file_of(bounds, rows):
    bounds.sort()
    got = token_files.file_of(np.array(bounds, np.int64).reshape(-1, 2), *(np.array([r[i] for r in rows], np.int64) for i in (0, 1)))
    assert got.tolist() == [sum(b <= r for b in bounds) for r in rows]


def test_another_dictionary_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(docs(spark), path, "word_bpe_49k.json")
    spark.createDataFrame([(bytearray(b"other"),)], "value binary").selectExpr("cast(value as string) value").coalesce(1).write.mode("overwrite").text(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read(spark, path).collect()


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 20), max_size=60))
def test_packing_plans(sizes):
    counts = Counter(sizes)
    first = packing.best_fit(counts, 20)
    best = packing.improve(first, 20)
    held = Counter()
    for p, n in best.items():
        assert sum(p) <= 20 and n > 0
        for x in p:
            held[x] += n
    assert held == counts and sum(best.values()) <= sum(first.values())
    assert sum(sum(p) ** 2 * n for p, n in best.items()) >= sum(sum(p) ** 2 * n for p, n in first.items())


def test_local_search_finds_what_best_fit_misses():
    counts = {6: 2, 5: 2, 4: 4, 3: 2, 2: 2}  # 48 in bins of 12
    first = Counter({(6, 5): 2, (4, 4, 3): 2, (2, 2): 1})
    assert sum(packing.improve(first, 12).values()) == 4 == -(-sum(k * n for k, n in counts.items()) // 12)


def test_local_search_ends_only_where_no_step_helps():
    rng = random.Random(0)
    counts = Counter(rng.randint(350, 700) for _ in range(4000))
    plan = packing.plan(counts, 2048)
    got = Counter()
    for p, n in plan.items():
        assert sum(p) <= 2048
        for x in p:
            got[x] += n
    assert got == counts
    under = [p for p in plan if sum(p) < 2048]
    assert sum(plan.values()) == -(-sum(k * n for k, n in counts.items()) // 2048) or not any(packing._step(a, b, 2048) for a in under for b in under if sum(a) <= sum(b) and (a != b or plan[a] > 1))



def test_pack(spark):
    ids_of = library("byte_bpe_50k.json")
    got = packing.pack(docs(spark), most=64, with_ids=True)
    rows = got.collect()
    for i, text in enumerate(TEXTS):
        ids = [*ids_of(text), 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [t for r in own for t in r.ids] == ids and [r.length for r in own[1:]] == [64] * (len(own) - 1)
        assert all(r.start == sum(x.length for x in own[: r.piece]) and r.ids_crc32 == crc(r.ids) for r in own) and (len(ids) > 64 or len(own) == 1)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(got).collect()} == {k: sum(r.length for r in v) for k, v in by.items()}
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.integers(0, 3), max_size=40), block=st.integers(1, 9))
def test_scan(ids, block):
    want, n = [], 0
    for x in ids:
        n += 1
        if x == 0:
            want.append(n)
            n = 0
    counts, rest = separators.scan(np.array(ids, np.uint16), 0, block)
    assert counts.tolist() == want and rest == n


def test_flat_files(spark, tmp_path):
    path, ids_of = str(tmp_path / "f"), library("byte_bpe_50k.json", literal=True)
    separators.write_flat(docs(spark), path, "byte_bpe_50k.json", 50256, chunk=40, chunks=2)
    assert separators._read(spark, f"{path}/kind=ids").count() > 1
    counts = separators.count_tokens(spark, f"{path}/kind=ids", 50256, block=7).join(separators.doc_ids(spark, path), ["file", "ordinal"])
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {i: len(ids_of(t)) + 1 for i, t in enumerate(TEXTS)}


def test_flat_files_of_null_ids_and_empty_tables(spark, tmp_path):
    separators.write_flat(docs(spark, ["a b", None], [None, 7]), str(tmp_path / "n"), "byte_bpe_50k.json", 50256)
    got = separators.count_tokens(spark, str(tmp_path / "n/kind=ids"), 50256).join(separators.doc_ids(spark, str(tmp_path / "n")), ["file", "ordinal"])
    assert {(r.doc_id, r.n_tokens) for r in got.collect()} == {(None, 3), (7, 1)}
    separators.write_flat(docs(spark, []), str(tmp_path / "e"), "byte_bpe_50k.json", 50256)
    assert separators.count_tokens(spark, str(tmp_path / "e/kind=ids"), 50256).count() == separators.doc_ids(spark, str(tmp_path / "e")).count() == 0


def test_documents_across_files(spark, tmp_path):
    stream, ends = [5, 0, 5, 5, 5, 5, 0, 0, 5], [0, 3, 5, 9]
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        (tmp_path / f"part-{i}").write_bytes(np.array(stream[a:b], "<u2").tobytes())
    got = separators.count_tokens(spark, str(tmp_path), 0, across=True).orderBy("file", "ordinal").collect()
    assert [r.n_tokens for r in got] == [2, 5, 1, 1]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, plain):
    ids_of, start = library("word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in token_files.op1_token_files(spark, SF).collect()}
    assert set(got) == set(plain)
    for key in sorted(plain):
        ids = [*ids_of(plain[key]), 1]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op3(spark, plain):
    ids_of = library("byte_bpe_50k.json")
    rows = packing.op3_packing(spark, SF).collect()
    want, used = {}, Counter()
    for key, text in plain.items():
        ids = [*ids_of(text), 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, k] = (a, b - a, crc(ids[a:b]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) * 1.02 + 1


def test_op5(spark, plain):
    ids_of = library("byte_bpe_50k.json", literal=True)
    rows = separators.op5_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(ids_of(t)) + 1 for k, t in plain.items()} and len(rows) == len(plain)


def test_a_very_long_text(spark, tmp_path):
    long = "Long words, and more of them. " * 100_000
    table, ids_of = docs(spark, [long, "a", long]), library("byte_bpe_50k.json")
    path = str(tmp_path / "f")
    separators.write_flat(table, path, "byte_bpe_50k.json", 50256)
    counts = separators.count_tokens(spark, f"{path}/kind=ids", 50256).join(separators.doc_ids(spark, path), ["file", "ordinal"])
    n = len(ids_of(long))
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {0: n + 1, 1: 2, 2: n + 1}
    token_files.write(table, str(tmp_path / "t"), "byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in token_files.read(spark, str(tmp_path / "t")).collect()} == {0: n + 1, 1: 2, 2: n + 1}
    assert sum(r.length for r in packing.pack(table).collect()) == 2 * (n + 1) + 2
