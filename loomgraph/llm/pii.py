"""PII: base detectors, and information-theoretic sanitisation of what points to them.

Base detectors find e-mail addresses, IP addresses, card and phone numbers.  Each
distinct value is a protected entity.  Over the whole corpus, document counts
estimate how strongly a term in an entity's documents, wherever it stands, reveals
it: the pointwise mutual information of both, as a share of the entity's information content
log2(N / n(entity)).  A term that discloses at least ``generalise`` of it is
generalised in the documents that hold the entity; from ``remove`` on it is
removed.  A pair seen in fewer than ``support`` rows is judged too, by the lower
confidence bound of the term's rate in place of the rate, so that chance meetings
of rare terms and rare entities weigh less.  Entities that stand in just the same rows
disclose alike and are judged as one, so a page of thousands of addresses that no
other page has makes no more pairs than it has terms.

Defined cases: null or empty text has no spans; counts are over rows; rows that
share a doc_id share their disclosing terms, but one without a base span loses nothing; a row without doc_id has base spans
only; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import batched, stored

from . import _vec as V
from ._columns import free, map_rows, quoted
from ._memory import tidy

KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit before a match would belong to it, so none is looked for inside a run: linear on long runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")
_GAPS = ~V.byte_class([*range(65, 91), *range(97, 123), *range(128, 256)])
_VALUES = V.byte_values(4, fold_case=True)
#: Shortest term, in bytes.
TERM_BYTES = 3
#: Most terms, and most entities, whose counts go to all tasks.
FREQUENT = 100_000
#: Pairs that a task holds before it sends them on.
PAIR_ROWS = 1 << 16
#: Standard deviations either side of a rate in its 95 % interval.
Z = 1.96


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def entity_id(kind: int, value: str) -> int:
    """A signed 64-bit number of a protected value, alike for its spellings."""
    value = value.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def term_ids(terms: list[bytes]) -> np.ndarray:
    buf, _ = V.pack(terms)
    return V.words(buf, _GAPS, _VALUES)[2].astype(np.int64)


def _distinct_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct term of each text, sorted by both."""
    buf, begin = V.pack(texts)
    s, e, h = V.words(buf, _GAPS, _VALUES)
    row = np.searchsorted(begin, s, side="right") - 1
    long = e - s >= TERM_BYTES
    row, h = row[long], h[long]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the text if it has a base span, its base spans (flat kind, start, end) and its distinct entities."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [base_spans(t) for t in texts]
            entities = [sorted({entity_id(kind, t[a:b]) for kind, a, b in f}) for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t if f else None for t, f in zip(texts, found)], pa.string()), pa.array([[x for s in f for x in s] for f in found], pa.list_(pa.int32())), pa.array(entities, pa.list_(pa.int64()))],
                names=["doc_id", "text", "base", "entities"],
            )

    return batched(docs).select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, text string, base array<int>, entities array<long>")


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``detected``, stored, with a number for each row."""
    return stored(detected(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))


def _merged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found's rows that hold entities, with classes in their place, and (entity, n_entity) of the classes: entities of just the same rows are one."""
    each = found.select("row", F.explode("entities").alias("entity"))
    rows_of = [F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b")]
    classes = each.groupBy("entity").agg(F.count("*").alias("n_entity"), *rows_of).select("entity", "n_entity", F.xxhash64("n_entity", "a", "b").alias("class"))
    held = stored(each.join(classes, "entity").groupBy("row", F.col("class").alias("entity")).agg(F.first("n_entity").alias("n_entity")))
    rows = found.drop("entities").join(held.groupBy("row").agg(F.collect_list("entity").alias("entities")), "row")
    return rows, held.select("entity", "n_entity").distinct()


def _frequent(counts: DataFrame, key: str, n: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The keys, sorted, whose count is above a threshold that leaves fewer than ``most`` of them, with the counts; and the threshold."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(1, total // most)
    top = counts.where(F.col(n) > least).select(F.col(key).alias("k"), F.col(n).alias("n")).toArrow()
    k, c = top.column("k").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], c[order], least


def _known(keys: np.ndarray, counts: np.ndarray, of: np.ndarray, other: int) -> np.ndarray:
    """The counts of keys; ``other`` for those that aren't there."""
    if not len(keys):
        return np.full(len(of), other, np.int64)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, counts[at], other)


def _pairs(found: DataFrame, total: int, terms: DataFrame, entities: DataFrame, generalise: float) -> DataFrame:
    """(doc_id, entity, term) of every distinct term of a row with every entity of it, wherever they stand, unless it can't disclose so much.

    A term of t rows is the entity's, of e rows, in e of them at most, so its disclosure
    reaches g only if t <= N * (e / N) ** g.  The counts of frequent terms and entities,
    fewer than FREQUENT, go to all tasks; a term that isn't there is never left out.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "entity", "term")])
    tk, tn, _ = _frequent(terms, "term", "n_term", FREQUENT)
    ek, en, rest = _frequent(entities, "entity", "n_entity", FREQUENT)
    shared = found.sparkSession.sparkContext.broadcast((tk, tn, ek, en))

    def rows(ids: list, texts: list[bytes], held: list[list[int]]):
        tk, tn, ek, en = shared.value
        row, h = _distinct_terms(texts)
        h = h.astype(np.int64)
        often = _known(tk, tn, h, 0)
        at = V.slices(row, len(texts))
        for i, mine in enumerate(held):
            h_i, often_i = h[at[i] : at[i + 1]], often[at[i] : at[i + 1]]
            limits = total * (_known(ek, en, np.array(mine, np.int64), rest) / max(1, total)) ** generalise * (1 + 1e-9)
            for entity, limit in zip(mine, limits.tolist()):
                keep = h_i[often_i <= limit]
                doc = pa.nulls(len(keep), pa.int64()) if ids[i] is None else pa.array(np.full(len(keep), ids[i], np.int64))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.full(len(keep), entity, np.int64)), pa.array(keep)], schema=schema)

    def groups(batches):
        for batch in batches:
            held, size = ([], [], []), 0
            for doc, text, mine in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "entities"))):
                for x, y in zip(held, (doc, text.encode(), mine)):
                    x.append(y)
                size += len(held[1][-1])
                if size >= 1 << 20:
                    yield held
                    held, size = ([], [], []), 0
            if held[0]:
                yield held

    def run(batches):
        made, n = [], 0
        for held in groups(batches):
            for part in rows(*held):
                made.append(part)
                n += part.num_rows
                if n >= PAIR_ROWS:  # sent on as they are made: a page's pairs are never held together
                    yield from pa.Table.from_batches(made, schema).combine_chunks().to_batches(PAIR_ROWS)
                    made, n = [], 0
        if made:
            yield from pa.Table.from_batches(made, schema).combine_chunks().to_batches(PAIR_ROWS)

    return found.select("doc_id", "text", "entities").mapInArrow(tidy(run), "doc_id long, entity long, term long")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): rows that hold each term, over the whole corpus."""

    def run(batches):
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            at, size, counted = 0, 0, []
            for i, t in enumerate(texts):
                size += len(t)
                if size < 4 << 20 and i < len(texts) - 1:
                    continue
                _, h = _distinct_terms(texts[at : i + 1])
                counted.append(np.unique(h, return_counts=True))
                at, size = i + 1, 0
            if counted:
                h, which = np.unique(np.concatenate([x for x, _ in counted]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([y for _, y in counted]), minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _rate(both: Column, of: Column, support: int) -> Column:
    """The share of a term's rows that hold the entity; seen in fewer than ``support`` rows, the lower end of its 95 % interval (Wilson)."""
    low = (both + Z * Z / 2 - Z * F.sqrt(both * (of - both) / of + Z * Z / 4)) / (of + Z * Z)
    return F.when(both >= support, both / of).otherwise(low)


def disclosing(pairs: DataFrame, total: int, terms: DataFrame, entities: DataFrame, support: int, generalise: float) -> DataFrame:
    """(entity, term, share) of the pairs whose disclosure reaches the threshold; total: rows of the corpus."""
    known = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(entities, "entity").join(terms, "term")
    n = F.lit(total)
    ic = F.log2(n / F.col("n_entity"))
    share = F.when(ic > 0, F.log2(n * _rate(F.col("n_both"), F.col("n_term"), support) / F.col("n_entity")) / ic)
    return known.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", "share")


def disclosing_terms(docs: DataFrame, found: DataFrame, *, support: int = 3, generalise: float = 0.5, remove: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, generalised, removed): hashes of the terms that disclose an entity of the document; found: ``found_in`` docs."""
    total = found.count()
    terms = stored(term_frequencies(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    rows, entities = _merged(found)
    pairs = stored(_pairs(rows, total, terms, entities, generalise))
    flagged = disclosing(pairs, total, terms, entities, support, generalise)
    level = lambda c: F.collect_set(F.when(c, F.col("term")))
    return pairs.join(flagged, ["entity", "term"]).groupBy("doc_id").agg(level(F.col("share") < remove).alias("generalised"), level(F.col("share") >= remove).alias("removed"))


def _terms_in(text: str, base: list, generalised: list, removed: list) -> tuple[list, list]:
    """Spans of disclosing terms outside base spans: generalised ones, removed ones."""
    words = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    coded = [text[a:b].encode() for a, b in words]
    ids = term_ids(coded).tolist() if coded else []
    low, high = set(generalised or ()), set(removed or ())
    taken = sorted((a, b) for _, a, b in base)
    out, k = ([], []), 0
    for (a, b), t, c in zip(words, ids, coded):
        if len(c) < TERM_BYTES or (t not in low and t not in high):
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        out[t in high].append((4, a, b))
    return out


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined)."""
    found = found_in(docs, id_col, text_col)
    terms = disclosing_terms(docs, found, id_col=id_col, text_col=text_col, **thresholds)

    def finish(batches):
        names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"]
        for batch in batches:
            cols = [[] for _ in names]
            for doc, text, flat, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                base = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
                more = sorted(sum(_terms_in(text, base, low, high), [])) if base and (low or high) else []
                counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                for c, x in zip(cols, [doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)]):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(cols)], names=names)

    both = found.join(terms.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "base", "generalised", "removed")
    return both.mapInArrow(tidy(finish), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, low: list | None, high: list | None) -> str:
    """Base spans and generalised terms give way to their kind; removed terms go.

    What is left may hold a number that its neighbours hid, so this repeats until no base span is left.
    """
    while base := base_spans(text):
        general, gone = _terms_in(text, base, low, high) if low or high else ([], [])
        marks = [(a, b, f"<{KINDS[k].upper()}>") for k, a, b in base + general]
        marks += [(a, b, " " if text[a - 1 : a].isdigit() or text[b : b + 1].isdigit() else "") for _, a, b in gone]
        out, at = [], 0
        for a, b, mark in sorted(marks):
            if a >= at:  # of spans that overlap, the first gives its mark
                out += [text[at:a], mark]
            at = max(at, b)
        text = "".join([*out, text[at:]])
    return text


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """The table with its texts redacted; every row and every other column stays (null texts too)."""
    terms = disclosing_terms(docs, found_in(docs, id_col, text_col), id_col=id_col, text_col=text_col, **thresholds)
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches):
        for batch in batches:
            texts, low, high = (batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1))
            cols = batch.columns[:-2]
            cols[at] = pa.array([t and redact(t, a, b) for t, a, b in zip(texts, low, high)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    of, low, high = (free(docs.columns, c) for c in ("of", "low", "high"))
    keyed = terms.select(F.col("doc_id").alias(of), F.col("generalised").alias(low), F.col("removed").alias(high))
    return map_rows(docs.join(keyed, quoted(id_col).cast("long") == F.col(of), "left").drop(of), run, schema)
