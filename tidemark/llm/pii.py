"""Personal data: patterns, and terms that disclose the entities which patterns found.

Patterns find e-mail addresses, IP numbers, card numbers (Luhn) and phone numbers.  Their values
are the protected entities.  A term (a word of letters) of the same document may give an entity away
as well: the corpus tells by how much.  With

* P(e) the share of documents that mention entity e,
* P(e | t) the documents that hold t and mention e over the documents with t,

the information content of e is -log P(e), and t reveals PMI(t; e) = log(P(e | t) / P(e)) of it.
Terms that reveal at least ``remove`` of the information are removed, those that reveal at least
``generalise`` are replaced by their kind (name, term), wherever they stand: far from the mention and in
documents without it, too.  A pair counts only if it was seen in ``support`` different texts: copies of a
whole text are one, a passage (a signature) that different texts repeat counts in each.  Terms are runs of three or more
letters: shorter ones, among them most names in scripts without spaces, are not looked at.

Texts are read where they lie: a bit filter of the disclosing terms (of a fixed size) picks the words that may be among
them, and only those words' places are shuffled.

Counts cover all documents.  A term in more than n(e) (N / n(e)) ^ (1 - ``generalise``) of N documents
cannot reveal enough of an entity in n(e) of them, so such pairs are not made.  ``find`` gives base
spans, entities and terms per document, ``disclosing_terms`` the pairs over the thresholds, ``spans`` all
spans per document, and ``sanitise`` the texts with spans replaced.

Null texts count as empty.  Rows are told apart by a number given once to the found rows, so rows
that repeat an id keep their own spans.  An empty table gives an empty result; extra columns
are kept by ``sanitise`` (a column named ``sanitised`` is replaced) and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_BYTES, broadcast_if_small, shielded, stage, text_batches

#: Kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match of these always begins where its run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{3,}")

SPAN = "struct<kind:string,start:long,end:long>"
#: Size of the filter of disclosing terms (2 MB), and words whose test a task remembers; results depend on neither.
FILTER_BITS = 1 << 24
REMEMBERED = 500_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Only an @ can hold a match, and it begins where the run of local characters before it does."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind; matches that fail their rule are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, value: str) -> str:
    """A mention's value in one form."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _DIGITS.sub('', value)}"


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words of a text that no span touches."""
    i, end = 0, 0
    for m in _WORD.finditer(text):
        while i < len(spans) and spans[i][1] < m.end():
            end, i = max(end, spans[i][2]), i + 1
        if end <= m.start():
            yield m


def find(docs: DataFrame) -> DataFrame:
    """_row, doc_id, _h (hash of the text) and base (spans) of every document; entities and, of documents
    with an entity, terms: distinct values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        schema = pa.schema([
            ("doc_id", pa.int64()), ("_h", pa.int64()),
            ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
            ("entities", strings), ("terms", strings)])
        for b in text_batches(batches):
            base, names, terms = [], [], []
            for t in b.column("text").to_pylist():
                spans = base_spans(t or "")
                base.append([{"kind": k, "start": i, "end": j} for k, i, j in spans])
                names.append(sorted({entity(k, t[i:j]) for k, i, j in spans}))
                terms.append(sorted({m[0].lower() for m in outside(t, spans)}) if spans else [])
            yield pa.record_batch([b.column("doc_id"), b.column("_h"), pa.array(base, schema.field("base").type),
                                   pa.array(names, strings), pa.array(terms, strings)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("_h", F.xxhash64("text")) \
        .mapInArrow(run, f"doc_id long, _h long, base array<{SPAN}>, entities array<string>, terms array<string>") \
        .withColumn("_row", F.monotonically_increasing_id())


def _words():
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"\p{L}{3,}"), F.lit(0)))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = 3, generalise: float = 0.75,
                     remove: float = 0.9) -> DataFrame:
    """entity, term, action and revealed (share of the entity's information) of the pairs over the thresholds."""
    total = found.count()
    mentions = found.select("_row", "_h", F.explode("entities").alias("entity"))
    # equal texts (copies) are one
    entities = mentions.groupBy("entity", "_h").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= support)
    most = F.col("n_entity") * F.pow(F.lit(float(total)) / F.col("n_entity"), F.lit(1 - generalise)) + 1e-6
    entities = stage(entities.select("entity", "n_entity", most.alias("most")), "pii-entities")
    mentions = stage(mentions.join(broadcast_if_small(entities), "entity"), "pii-mentions")
    rows = stage(mentions.groupBy("_row").agg(F.max("most").alias("bound")), "pii-rows")
    held = found.join(broadcast_if_small(rows), "_row").select("_row", "bound", F.explode("terms").alias("term"))
    # documents with each term, over the whole corpus; terms of many documents are met without a shuffle
    counts = stage(docs.select(F.explode(_words()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
                   .where(F.col("n_term") >= support), "pii-terms")
    common = F.col("n_term") > total / 1000
    hot = broadcast_if_small(counts.where(common))
    held = held.join(hot, "term").unionByName(held.join(hot, "term", "left_anti").join(counts.where(~common), "term")) \
        .where(F.col("n_term") <= F.col("bound")).drop("bound")
    held = stage(held, "pii-held")
    both = mentions.join(held, "_row").where(F.col("n_term") <= F.col("most")) \
        .groupBy("entity", "term", "n_entity", "n_term", "_h").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_texts")) \
        .where(F.col("n_texts") >= support)
    # the patterns' letters may differ a little from the words counted: a term occurs where the pair does
    p_entity, p_given = F.col("n_entity") / F.lit(total), F.col("n_both") / F.greatest("n_term", "n_both")
    content = -F.log(p_entity)
    rows = both.withColumn("revealed", F.when(content > 0, F.log(p_given / p_entity) / content).otherwise(F.lit(0.0)))
    action = F.when(F.col("revealed") >= remove, "removed").when(F.col("revealed") >= generalise, "generalised")
    return rows.withColumn("action", action).where("action is not null").select("entity", "term", "action", "revealed")


def _term_bits(actions: DataFrame) -> np.ndarray:
    """A bit filter of the terms, of ``FILTER_BITS`` bits whatever their number: a set bit for the hash of each."""
    place = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    words = actions.groupBy(F.floor(place / 64).cast("int").alias("i")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words.column("i").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _occurrences(bits: np.ndarray):
    """Rows (_h, term, start, end) of the words outside base spans that pass the filter; texts go nowhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def may_disclose(word: str) -> bool:
            h = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 42) % FILTER_BITS  # Spark's xxhash64
            yes = bool(int(bits[h >> 6]) >> (h & 63) & 1)
            if len(known) < REMEMBERED:
                known[word] = yes
            return yes

        for b in text_batches(batches):
            rows: list[tuple[int, str, int, int]] = []
            for h, t in zip(b.column("_h").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    continue
                hits = {w for w in set(_WORD.findall(t)) if (known[w] if w in known else may_disclose(w))}
                if hits:
                    rows += [(h, m[0].lower(), m.start(), m.end()) for m in outside(t, base_spans(t)) if m[0] in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                                 names=["_h", "term", "start", "end"])
    return run


def spans(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """_row, doc_id and spans (base and added, by start, then kind, then end) of every found row."""
    # removed wins over generalised where a term discloses several entities
    actions = stage(terms.groupBy("term").agg(F.max("action").alias("action")), "pii-actions")
    texts = docs.select(F.col("text").cast("string").alias("text")).select(F.xxhash64("text").alias("_h"), "text")
    places = texts.mapInArrow(_occurrences(_term_bits(actions)), "_h long, term string, start long, end long")
    # equal texts have equal places: one of each stays
    added = places.join(broadcast_if_small(actions), "term").groupBy("_h", "start", "end").agg(F.max("action").alias("kind")) \
        .groupBy("_h").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    added = stage(added, "pii-added")
    rows = found.select("_row", "doc_id", "_h", "base").join(_small(added, "added"), "_h", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    keyed = F.transform(every, lambda s: F.struct(s.start.alias("start"), F.array_position(order, s.kind).alias("k"),
                                                  s.end.alias("end"), s.kind.alias("kind")))
    every = F.transform(F.array_sort(keyed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return rows.select("_row", "doc_id", "_h", "base", every.alias("spans"))


def _small(df: DataFrame, items: str) -> DataFrame:
    """``df`` with a broadcast hint if it is small: structs are counted as three items of an array."""
    n = df.agg(F.sum(F.size(items) * 3 * 32 + 64).alias("b")).first()["b"] or 0
    return F.broadcast(df) if 2 * n <= BROADCAST_BYTES else df


def digest(every: str):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count_kind(every: str, kind: str):
    return F.size(F.filter(every, lambda s: s.kind == kind)).cast("long")


def replace_spans(text: str, every: list[tuple[str, int, int]]) -> str:
    """The text with patterns and generalised terms replaced by their kind and removed terms left out;
    where spans overlap the first one stands."""
    out, at = [], 0
    for kind, a, b in every:
        if a < at:
            at = max(at, b)
            continue
        out.append(text[at:a])
        if kind == "generalised":
            out.append("[NAME]" if text[a].isupper() else "[TERM]")
        elif kind != "removed":
            out.append(f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, support: int = 3, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """``docs`` (doc_id, text, more) with ``sanitised``."""
    return shielded(docs, ("doc_id", "text"), lambda d: _sanitise(d, support, generalise, remove), ("sanitised",))


def _sanitise(docs: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    found = stage(find(docs), "pii-found")
    every = spans(docs, found, stage(disclosing_terms(docs, found, support, generalise, remove), "pii-disclosing"))
    # equal ids with equal texts have equal spans
    every = stage(every.where(F.size("spans") > 0).dropDuplicates(["doc_id", "_h"])
                  .select(F.col("doc_id").alias("_i"), "_h", "spans"), "pii-spans")
    rows = docs.withColumn("_k", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(broadcast_if_small(every), F.col("doc_id").cast("long").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_h")), "left")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            clean = [t if t is None or not x else replace_spans(t, [(y["kind"], y["start"], y["end"]) for y in x])
                     for t, x in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(clean, pa.string())], names=[*names, "sanitised"])

    schema = T.StructType([*docs.schema.fields, T.StructField("sanitised", T.StringType())])
    return rows.select(*names, "spans").mapInArrow(run, schema)
