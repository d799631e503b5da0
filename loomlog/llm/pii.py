"""Operator 4: personal data, and terms that give it away.

Base spans are e-mail addresses, IP addresses, payment cards and telephone numbers, found by pattern and check digit.
Their values are the protected entities. Around each mention, words are counted with the entity; over the whole
corpus, words are counted alone. With N documents, an entity e has the information IC(e) = log2(N / n(e)), and a term t
gives away PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e))) of it, n being documents. Few observations tell little, so what a
term gives away is discounted by c / (c + 1/2), c being the different surroundings in which it stands near the entity (copies
of a text count once). A term that gives away SHARE of an entity's information or more is a span too in every document
that mentions the entity. As PMI never exceeds IC, a term needs two surroundings at least.
Sanitising puts a name of the kind in place of base spans (they are generalised) and removes terms.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize, partitions_of, settle, small_batches
from .tokens import slices

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a mention that count as near it, those that make its surroundings, and letters that a term has at least.
NEAR, SURROUNDINGS, LETTERS = 32, 8, 2
#: Share of an entity's information from which on a term gives it away, and what is added to the surroundings to discount it.
SHARE, DISCOUNT = 0.75, 0.5
#: Bits of the map of candidate terms that the corpus count is limited to; it is exact in the end, as counts are joined by term.
BITS = 1 << 20
#: Pairs of entity and term up to which these are sent to all executors; more are joined.
MOST_SENT = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{%d,}" % LETTERS)

Span = tuple[int, int, int]  # start, number of the kind, end


def _emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches, but in a time that doesn't grow with the square of a run of letters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, 0, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for m in _NUMBERS.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, 1, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield m.start(), 2, m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.start(), 3, m.end()


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then by kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [*_ips(text), *_cards(text), *(_phones(text) if "+" in text else ())]
    return sorted(out)


def entity(text: str, span: Span) -> int:
    """A 63-bit name of the value: case doesn't matter for addresses, nor separators for numbers."""
    start, kind, end = span
    value = text[start:end].lower()
    if kind >= 2:
        value = "".join(c for c in value if c.isdigit())
    return int.from_bytes(hashlib.blake2b(f"{kind} {value}".encode(), digest_size=8).digest(), "little") >> 1


def near_terms(text: str, spans: list[Span]) -> dict[int, tuple[list[str], int]]:
    """For each entity the lower-case words within NEAR words of its mentions, sorted, and a checksum of those within SURROUNDINGS; words inside base spans are left out. One pass over the words, then two bisections a mention."""
    masked, at = [], 0
    for start, _, end in spans:
        if start > at:
            masked.append(text[at:start])
        masked.append("0" * (end - max(start, at)))
        at = max(at, end)
    words = list(_WORD.finditer("".join([*masked, text[at:]])))
    starts, ends = [m.start() for m in words], [m.end() for m in words]
    near: dict[int, tuple[set[int], set[int]]] = {}
    for span in spans:
        before, after = bisect.bisect_right(ends, span[0]), bisect.bisect_left(starts, span[2])
        for own, reach in zip(near.setdefault(entity(text, span), (set(), set())), (NEAR, SURROUNDINGS), strict=True):
            own.update(range(max(before - reach, 0), before), range(after, min(after + reach, len(words))))
    out = {}
    for key, numbers in near.items():
        terms, close = (sorted({words[i][0].lower() for i in own}) for own in numbers)
        out[key] = terms, zlib.crc32(" ".join(close).encode())
    return out


def term_spans(text: str, spans: list[Span], terms: frozenset[str]) -> list[Span]:
    """Occurrences of terms outside base spans."""
    out, k = [], 0
    upto = 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            upto = max(upto, spans[k][2])
            k += 1
        if m[0].lower() in terms and m.start() >= upto:
            out.append((m.start(), 4, m.end()))
    return out


def disclosing(docs: DataFrame) -> DataFrame:
    """entity and term of the pairs that exceed the threshold, counted over all rows of ``docs`` (text)."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in slices(batches):
            ents, terms, contexts = [], [], []
            for text in some:
                if spans := base_spans(text):
                    for ent, (words, context) in near_terms(text, spans).items():
                        ents.append(ent)
                        terms.append(words)
                        contexts.append(context)
            yield pa.record_batch({"entity": pa.array(ents, pa.int64()), "terms": pa.array(terms, pa.list_(pa.string())), "context": pa.array(contexts, pa.int64())})

    mentions = materialize(texts.mapInArrow(near, "entity long, terms array<string>, context long"), "mentions", partitions_of(texts))
    each = mentions.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = each.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("c"))
    pairs = materialize(pairs.where(F.col("c") / (F.col("c") + DISCOUNT) >= SHARE), "pairs")  # no other pair can reach it
    bit = F.crc32(F.col("term").cast("binary")) % BITS
    packed = pairs.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(crc32(CAST(term AS binary)) % {BITS} % 64 AS int))")).alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    for at, word in packed.collect():  # BITS / 64 rows at most
        table[at] = word
    bits = table.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, n = zlib.crc32, Counter()
        for _, some in slices(batches):
            for text in some:
                for word in {w.lower() for w in set(_WORD.findall(text))}:
                    b = crc(word.encode()) % BITS
                    if bits[b >> 3] >> (b & 7) & 1:
                        n[word] += 1
            if len(n) > 200_000:
                yield pa.record_batch({"term": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})
                n.clear()
        yield pa.record_batch({"term": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})

    if not any(bits):
        return pairs.select("entity", "term")
    alone = materialize(texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")), "terms")
    total = float(docs.count())
    known = materialize(mentions.groupBy("entity").agg(F.count("*").alias("n_e")), "entities")
    rows = pairs.join(alone, "term").join(known, "entity")
    information = F.log2(F.lit(total) / F.col("n_e"))
    given = F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    sure = F.col("c") / (F.col("c") + DISCOUNT)
    return materialize(rows.where((information > 0) & (given * sure >= SHARE * information)).select("entity", "term"), "disclosing")


def _apply(docs: DataFrame, pairs: DataFrame, schema: object, make: object) -> DataFrame:
    """mapInArrow over ``docs`` with make(batch, texts, spans): the spans of each text, terms included."""
    few = pairs.limit(MOST_SENT + 1).collect()
    if len(few) <= MOST_SENT:
        sent: dict[int, set[str]] = {}
        for r in few:
            sent.setdefault(r.entity, set()).add(r.term)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches):
                found = []
                for text in texts:
                    spans = base_spans(text)
                    terms = frozenset().union(*(sent.get(entity(text, s), ()) for s in spans)) if spans and sent else frozenset()
                    found.append(sorted(spans + term_spans(text, spans, terms)) if terms else spans)
                yield make(batch, texts, found)

        return settle(docs.mapInArrow(run, schema), partitions_of(docs))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            ents = [sorted({entity(t, s) for s in base_spans(t)}) for t in texts]
            yield batch.append_column("__loomlog_entities", pa.array(ents, pa.list_(pa.int64())))

    keyed = docs.withColumn("__loomlog_row", F.monotonically_increasing_id())
    keyed = materialize(keyed.mapInArrow(name, T.StructType([*keyed.schema.fields, T.StructField("__loomlog_entities", T.ArrayType(T.LongType()))])), "keyed", partitions_of(docs))
    of_row = keyed.select("__loomlog_row", F.explode("__loomlog_entities").alias("entity")).join(pairs, "entity").groupBy("__loomlog_row").agg(F.collect_set("term").alias("__loomlog_terms"))
    rows = keyed.drop("__loomlog_entities").join(materialize(of_row, "row-terms"), "__loomlog_row", "left").drop("__loomlog_row").select(*docs.columns, "__loomlog_terms")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = []
            for text, terms in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                spans = base_spans(text)
                found.append(sorted(spans + term_spans(text, spans, frozenset(terms))) if terms else spans)
            yield make(batch.select(range(batch.num_columns - 1)), texts, found)

    return settle(rows.mapInArrow(run_joined, schema))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (base spans) and spans (all) of every row of ``docs`` (doc_id, text; other columns are left out), repeated ones too.

    A span has kind, start and end (code points, end exclusive); spans are sorted by start and kind. Null counts as the empty text.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make(batch: pa.RecordBatch, texts: list[str], found: list[list[Span]]) -> pa.RecordBatch:
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in found]
        return pa.record_batch({"doc_id": batch.column(0), "base": pa.array([[x for x in r if x["kind"] != "term"] for r in rows], kind), "spans": pa.array(rows, kind)})

    span = "array<struct<kind:string,start:int,end:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _apply(rows, disclosing(rows), f"doc_id long, base {span}, spans {span}", make)


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with [KIND] in place of base spans (overlapping ones: of the first) and without terms."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], "" if KINDS[kind] == "term" else f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; n_chars, where there is such a column, is the new length. All other columns, and null texts, stay."""
    names = docs.columns

    def make(batch: pa.RecordBatch, texts: list[str], found: list[list[Span]]) -> pa.RecordBatch:
        at = names.index("text")
        old = batch.column(at).is_valid().to_pylist()
        new = [sanitised(t, s) if ok else None for t, s, ok in zip(texts, found, old, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([n if not s else len(t) for n, t, s in zip(columns[k].to_pylist(), new, found, strict=True)], columns[k].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _apply(docs, disclosing(docs), docs.schema, make)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest and all spans of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op4_pii": op4_pii}
ORACLE_SQL: dict[str, str] = {}
