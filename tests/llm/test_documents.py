"""Operators over documents against brute force, odd rows included."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _vec, byte_bpe, decontamination, ngram_join, pii, queries, substring_dedup, suffix_dedup, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
NULL_LAST = lambda r: (r[0] is None, r[0] or 0)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# 1 ---------------------------------------------------------------------------------------------


def components(rows, n=5, percent=80):
    sets = []
    for i, t in rows:
        w = SPLIT.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i, j = rows[a][0], rows[b][0]
        if None not in (i, j) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return ordered((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets))


def test_ngram_join(odd, odd_rows, empty, listed):
    assert listed(ngram_join.near_duplicates(odd), "doc_id", "n_shingles", "component_id") == components(odd_rows)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_large_room(spark, listed, monkeypatch):
    """More near copies than a block holds, many of them not linked with each other."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == components(rows)


@pytest.mark.parametrize("seed", range(5))
def test_trie_finds_all_links(seed):
    rng = random.Random(seed)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 30))), np.uint64) for _ in range(20)]
    for i in range(0, 20, 2):
        extra = set(sets[i].tolist()) ^ {rng.randrange(60)}
        sets.append(np.array(sorted(extra or {1}), np.uint64))
    sizes = np.array([len(s) for s in sets])
    got = {tuple(sorted((i, int(p)))) for i, many in ngram_join.Trie(sets, sizes).join(np.arange(len(sets)), 80) for p in many}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 80 * len({*sets[i].tolist()} | {*sets[j].tolist()})}
    assert got == want


def linked(rows, n=5, percent=80):
    """Per row with a doc_id the places of the other such rows that it's linked with."""
    sets = []
    for _, t in rows:
        w = SPLIT.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    good = lambda a, b: a != b and sets[a] and sets[b] and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    return [None if i is None else [b for b in range(len(rows)) if good(a, b)] for a, (i, _) in enumerate(rows)]


def near_family(n):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    return [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(9)}" for w in base)) for i in range(n)]


def test_ngram_links(spark, odd, odd_rows, empty, listed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    family = near_family(120)  # one room of many blocks, not all of which link
    for df, rows in ((odd, odd_rows), (spark.createDataFrame(family, "doc_id long, text string").repartition(3), family)):
        want = ordered((*c, None if x is None else len(x)) for c, x in zip(ordered_by_row(rows), linked(rows)))
        assert listed(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id", "n_links") == want
    pairs, members = (x.collect() for x in ngram_join.links(df))
    of = {}
    for r in members:
        of.setdefault((r.f1, r.f2), []).append(r.doc_id)
    got = sorted([tuple(sorted((a, b))) for r in pairs for a in of[r.f1, r.f2] for b in of[r.g1, r.g2]] + [p for x in of.values() for p in itertools.combinations(sorted(x), 2)])
    assert got == sorted((a, b) for a, x in enumerate(linked(family)) for b in x if a < b) and len(got) > 500


def test_ngram_join_of_near_copies_that_hardly_link(spark):
    """2,000 copies of one text, each with other words changed: one room, few links; counts against brute force, and disk in proportion."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        w = list(base)
        for k in rng.sample(range(150), 1 + i % 4):
            w[k] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(146)} for _, t in rows for w in [t.split()]]
    place = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((2000, len(place)), np.float32)
    for r, s in zip(m, sets):
        r[[place[g] for g in s]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    good = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(good, False)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i].n_links for i in range(2000)] == good.sum(axis=1).tolist() and 0 < good.sum() < 2000 * 1999 / 4
    for i, j in zip(*np.nonzero(good)):
        assert got[i].component_id == got[j].component_id <= i


def ordered_by_row(rows):
    """components() in the order of the rows."""
    of = {r[0]: r[2] for r in components(rows)}
    count = lambda t: len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if (w := SPLIT.findall((t or "").translate(LOWER))) else 0
    return [(i, count(t), of[i]) for i, t in rows]


# 2 ---------------------------------------------------------------------------------------------


def test_suffix_dedup(odd, odd_rows, empty, listed):
    seen, kept = set(), []
    for i, t in sorted((r for r in odd_rows if r[0] not in (60,)), key=NULL_LAST):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    got = listed(suffix_dedup.repeated_bytes(odd.where("doc_id is null or doc_id <> 60")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [r for r in got if r[0] is not None] == ordered(r for r in kept if r[0] is not None)
    assert sorted(r[1] for r in got if r[0] is None) == sorted(r[1] for r in kept if r[0] is None)
    assert suffix_dedup.repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_common_prefixes(seed):
    rng = random.Random(seed)
    text = [rng.choice([1, 2, 3]) if rng.random() < 0.9 else 0 for _ in range(rng.randint(1, 120))] + [0]
    n = rng.choice([2, 5, 9])
    order, shared = suffix_dedup.common_prefixes(np.array(text, np.int16), n)
    for i in range(1, len(order)):
        a, b = text[order[i - 1] : order[i - 1] + n], text[order[i] : order[i] + n]
        if len(a) == len(b) == n and 0 not in a and 0 not in b:
            assert shared[i] == (a == b)


# 3 and 10 ----------------------------------------------------------------------------------------


def fuzz():
    rng = random.Random(7)
    letters = "ab 'st \t\n\r\x1c\x1e\x85\xa0 　ÀéÉΣςσİıßǅ1٣²½Ⅷ中😀éÅ!?#.,-_\x00<|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["a" * 700, " " * 300, "<|startoftext|>x<|endoftext|>", "it's I'LL 'S"]


def test_byte_bpe_is_the_librarys():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own, lib = byte_bpe.ByteBpe(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = fuzz()
    coded = own.encode(texts)
    assert coded == [np.array(lib.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert [own.decode(c) for c in coded] == [t.encode() for t in texts]


def test_byte_bpe_of_long_runs():
    """Texts of one character, of two in turn and of random letters: as the library has them, in seconds for a megabyte."""
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own, lib = byte_bpe.ByteBpe(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["a" * 1_000_000, "ab" * 20_000, "=" * 30_001, "é" * 5_000, "".join(rng.choice("abcdest") for _ in range(30_000)), " " * 3_000, "the" * 200]
    began = time.monotonic()
    coded = own.encode(texts)
    assert time.monotonic() - began < 60
    assert coded == [np.array(lib.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert [own.decode(c) for c in coded] == [t.encode() for t in texts]


def test_byte_bpe_digests(odd, odd_rows, empty, listed):
    path = P.path("byte_bpe_50k.tiktoken")
    got = listed(byte_bpe.digests(odd, path, P.PATTERN), "doc_id", "decoded_sha256")
    assert got == ordered((i, sha((t or "").encode())) for i, t in odd_rows)
    assert byte_bpe.digests(empty, path, P.PATTERN).count() == 0
    out = byte_bpe.encode(odd.where("doc_id = 4"), path, P.PATTERN)
    assert out.columns == [*odd.columns, "ids", "decoded"] and out.first().decoded == "one two three"


def test_token_counts(odd, odd_rows, empty, listed):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), token_counts.Counter(path)
    texts = fuzz()
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in odd_rows]
    assert listed(token_counts.token_counts(odd, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == ordered(want)
    assert token_counts.token_counts(empty, path).count() == 0


# 4 ---------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_token_counts_of_long_runs(monkeypatch):
    """Runs without white space, and a cache that overflows within a text."""
    import tokenizers

    path = P.path("word_bpe_49k.json")
    want = tokenizers.Tokenizer.from_file(path)
    want.no_truncation()
    monkeypatch.setattr(token_counts, "CACHE", 3)
    rng = random.Random(2)
    count = token_counts.Counter(path)
    for t in ("a" * 30_000, "".join(rng.choice("abcdeé中") for _ in range(20_000)), "ab" * 9_999 + "!" * 5_000, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300))):
        assert count.count(t) == len(want.encode(t, add_special_tokens=False).ids)
        assert len(count) <= 3


def base(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("1234567890..@@ab-- +()%_é\n1111") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == base(t)
    assert pii.base_spans("9" * 100_000) == [] and pii.base_spans("a@" * 50_000) == []


def test_pii_terms_disclose(spark, odd, empty):
    who = "call zorblax about mail zed@x.org now"
    rows = [(i, f"{who} filler{i}") for i in range(4)] + [(100 + i, f"call about mail now filler word{i}") for i in range(60)] + [(200, "zorblax alone"), (201, None), (None, who)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    at = who.index("zorblax")
    assert f"term:{at}:{at + 7}" in got[0].spans and "term" not in got[200].spans and "term" not in got[None].spans
    assert got[0].n_email == 1 and got[0].base_sha256 == sha(f"email:{who.index('zed')}:{who.index(' now')}".encode())
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "<EMAIL>" in clean[0] and "zorblax" not in clean[0] and clean[200] == "zorblax alone" and clean[201] is None
    assert "call" in clean[0] and clean[100] == rows[4][1]
    assert pii.spans(odd).count() == odd.count() and pii.sanitise(odd).columns == odd.columns and pii.spans(empty).count() == 0


def test_pii_terms_disclose_from_afar(spark):
    far = "of it as well as the one to be in so " * 8
    texts = [f"zorblax came . {far}. mail zed@x.org", f"mail zed@x.org . {far}. a zorblax", f"zorblax zed@x.org {far}", f"zed@x.org {far} zorblax and zorblax"]
    rows = [*enumerate(texts), *((100 + i, f"came and {far} mail") for i in range(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.spans(df).collect()}
    for i, t in enumerate(texts):
        assert [x for x in got[i].split(",") if x.startswith("term")] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("zorblax", t)]
    assert all("zorblax" not in r.text for r in pii.sanitise(df).collect())


def test_pii_rare_entities_disclose(spark):
    more = [(100 + i, f"calls came in on day{i} as chance would have") for i in range(200)]
    rows = [(1, "quennel calls +1 555 010 9999"), (2, "day of quennel , +1 555 010 9999"), (3, "vorbin calls vo@x.org"), *((100 + i, "chance meeting") for i in range(20)), *more]
    got = {}
    for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.spans)
    assert got[1] == ["phone:14:29,term:0:7"] and got[2] == ["phone:17:32,term:7:14"]
    assert "term:0:6" in got[3][0] and "term:7:12" not in got[3][0]


def disclosed(rows, support=3, generalise=0.5, remove=0.9):
    """Per row the spans of ``pii.spans`` and the terms that go, by plain loops."""
    term = re.compile("[A-Za-z\x80-\U0010ffff]+")
    words = lambda t: {m[0].translate(LOWER) for m in term.finditer(t or "") if len(m[0].encode()) >= 3}
    ents = lambda t: {pii.entity_id(k, t[a:b]) for k, a, b in pii.base_spans(t or "")}
    n_term, n_ent, both = Counter(), Counter(), Counter()
    for _, t in rows:
        n_term.update(words(t))
        n_ent.update(ents(t))
        both.update((e, w) for e in ents(t) for w in words(t))
    total, share = len(rows), {}
    for (e, w), n in both.items():
        if (ic := math.log2(total / n_ent[e])) > 0:
            m = n_term[w]
            rate = n / m if n >= support else (n + 1.96**2 / 2 - 1.96 * math.sqrt(n * (m - n) / m + 1.96**2 / 4)) / (m + 1.96**2)
            share[e, w] = math.log2(total * rate / n_ent[e]) / ic
    flagged = {}
    for i, t in rows:
        for e in ents(t) if i is not None else ():
            flagged.setdefault(i, set()).update(w for w in words(t) if share.get((e, w), 0) >= generalise)
    out = []
    for i, t in rows:
        base = pii.base_spans(t or "")
        more = [(4, m.start(), m.end()) for m in term.finditer(t or "") if base and m[0].translate(LOWER) in flagged.get(i, ()) and len(m[0].encode()) >= 3 and not any(a < m.end() and m.start() < b for _, a, b in base)]
        out.append((i, pii.joined(base + more)))
    return ordered(out)


@pytest.mark.parametrize("seed", range(3))
def test_pii_terms_against_loops(spark, listed, monkeypatch, seed):
    """Shares of a random corpus with shared and missing ids, whatever the partitions, the batches and the number of counts sent to all tasks."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdkt" for b in "aeiou" for c in ("rn", "lx", "st")]
    people = ["zed@x.org", "ann@y.net", "+1 555 010 9999", "10.0.0.7"]
    rows = []
    for i in range(120):
        t = [rng.choice(vocabulary[: 1 + rng.randrange(len(vocabulary))]) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.4:
            k = min(rng.randrange(8), 3)
            t += [people[k], *(["quennel"] if k == 1 else ["vorbin"] if k == 0 and rng.random() < 0.8 else [])]
        rng.shuffle(t)
        rows.append((rng.choice([i, i, i, 5, None]), " ".join(t)))
    rows += [(1000, None), (1001, "")]
    want = disclosed(rows)
    assert any("term" in x for _, x in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts, batch, frequent in ((1, 10_000, 100_000), (3, 1, 100_000), (4, 7, 2), (2, 50, 1)):
        monkeypatch.setattr(pii, "FREQUENT", frequent)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert listed(pii.spans(df.repartition(parts)), "doc_id", "spans") == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pii_of_a_page_of_addresses(spark):
    """Addresses that only this page holds are judged as one; those of other rows too keep their own counts."""
    def word(i):
        return "w" + "".join(chr(97 + int(c)) for c in str(i))

    page = " ".join(f"{word(i)} u{i}@page.org {word(i + 20_000)}" for i in range(20_000))
    df = spark.createDataFrame([(1, page), (2, "zorblax u1@page.org"), (3, "zorblax u1@page.org"), *((i, f"plain words {word(i)}") for i in range(10, 400))], "doc_id long, text string")
    rows, classes = pii._merged(pii.found_in(df))
    assert sorted(r.n_entity for r in classes.collect()) == [1, 3] and rows.count() == 3
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    assert got[1].n_email == 20_000 and got[2].n_email == 1 and got[10].spans == ""


def test_pairs_are_sent_as_they_are_made(spark, listed, monkeypatch):
    rows = [(i, " ".join(f"word{chr(97 + (i * k) % 20)}" for k in range(9)) + f" u{i % 4}@x.org v{i % 3}@x.org") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = disclosed(rows)
    monkeypatch.setattr(pii, "PAIR_ROWS", 2)
    assert listed(pii.spans(df), "doc_id", "spans") == ordered(want)


def test_redaction_leaves_nothing():
    for t in ("4111 1111 1111 1111 1.2.3.4", "a@b.c@d.ef", "+1 (555) 010-9999 and 10.0.0.1.8.8.8.8"):
        assert not pii.base_spans(pii.redact(t, [], []))


# 5 ---------------------------------------------------------------------------------------------


def test_decontamination(spark, odd, odd_rows, empty, listed):
    text = dict(r for r in odd_rows if r[0] is not None)
    long = text[6].split()
    items = [(1, " ".join(long[10:40])), (2, "one two three"), (3, None), (4, "..."), (5, "never seen words at all"), (6, " ".join(long[100:113])), (6, "word"), (None, text[6]), (7, "a b c d e f g")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = find(t)
        for s in range(max(1, len(w) - 12)) if w and i is not None else ():
            windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    want = []
    for i, t in odd_rows:
        w, hit, found = find(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if i is not None and (got := windows.get(tuple(w[s : s + k]))):
                    hit |= {*range(s, s + k)}
                    found |= got
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert listed(decontamination.report(odd, bench), *cols) == ordered(want)
    clean = decontamination.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(not r[-1] for r in want)
    assert decontamination.report(empty, bench).count() == 0
    none = decontamination.report(odd, bench.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == odd.count()


def test_decontamination_of_one_repeated_word(spark):
    """A long text and an item of one word over and over; the shuffled joins give the same as the broadcast ones."""
    docs = spark.createDataFrame([(1, "word " * 60_000), (2, "word " * 12), (3, "other " + "word " * 13), (4, "word")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 600), (2, "Word " * 700), (3, "word other")], "item_id long, text string")
    for limit in (decontamination.BROADCAST_BYTES, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontamination, "BROADCAST_BYTES", limit)
            got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.report(docs, bench).collect()}
        assert got == {1: (60_000, 60_000, 2), 2: (12, 0, 0), 3: (14, 13, 2), 4: (1, 0, 0)}


def test_decontamination_of_templated_items(spark):
    """Items that differ in two numbers share their rarest terms; those that stand are found, in time that doesn't grow with items times places."""
    ask = lambda n, m: f"what is the zeta of {n} and {m} omega or not then say so now"
    bench = spark.createDataFrame([(f"t{i}", ask(i % 100, i // 100)) for i in range(10_000)] + [("copy", ask(7, 3))], "item_id string, text string")
    rows = [(i, " ".join(ask((i * 7 + k) % 130, k % 130) for k in range(100))) for i in range(40)]
    rows += [(100, ask(7, 3)), (101, ask(7, 300)), (102, None)]
    began = time.monotonic()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.report(spark.createDataFrame(rows, "doc_id long, text string"), bench, window=13).collect()}
    assert time.monotonic() - began < 120
    items = {tuple(ask(i % 100, i // 100).split()) for i in range(10_000)}
    windows = {}
    for w in items:
        for a in range(len(w) - 12):
            windows.setdefault(w[a : a + 13], set()).add(w)
    extra = ask(7, 3).split()
    for i, t in rows:
        w, hit, found = (t or "").split(), set(), set()
        for a in range(len(w) - 12):
            if x := windows.get(tuple(w[a : a + 13])):
                hit |= set(range(a, a + 13))
                found |= x
        assert got[i] == (len(w), len(hit), len(found) + (tuple(extra) in found)), i


def test_decontamination_of_rows_that_share_an_id(spark):
    bench = spark.createDataFrame([("x", "one two three"), ("y", "four five")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three four")] * 50 + [(1, "four five six")] * 50, "doc_id long, text string")
    got = Counter((r.n_words, r.n_hit, r.n_items) for r in decontamination.report(docs, bench).collect())
    assert got == {(4, 3, 1): 50, (3, 2, 1): 50}


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "d e f", 6, None)], "doc_id long, text string, `a.b` int, `__text` string")
    bench = spark.createDataFrame([(1, "A, b")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.clean(docs, bench).collect()] == [(2, "d e f", 6, None)]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x x x beta"), (3, "alpha"), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.pos) for r in decontamination.proximity_matches(df, "alpha", ["beta"], 2).collect()] == [(1, 0)]


# 9 ---------------------------------------------------------------------------------------------


def test_substring_dedup(odd, odd_rows, empty, listed):
    first, want = {}, []
    cut = {k: SPLIT.findall(t or "") for k, (_, t) in enumerate(odd_rows)}
    for k, (i, _) in enumerate(odd_rows):
        for s in range(len(cut[k]) - 49):
            if i is not None:
                w = tuple(cut[k][s : s + 50])
                first[w] = min(i, first.get(w, i))
    for k, (i, _) in enumerate(odd_rows):
        w, gone = cut[k], [False] * len(cut[k])
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        want.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    assert listed(substring_dedup.repeated_windows(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(want)
    assert substring_dedup.repeated_windows(empty).count() == 0


# hashing ---------------------------------------------------------------------------------------


def test_words_over_blocks(monkeypatch):
    texts = [b"a bb ccc", b"", b"x" * 300, b" lead and trail ", "é à".encode()] * 3
    buf, at = _vec.pack(texts)
    values = _vec.byte_values(0)
    whole = _vec.words(buf, _vec.SPACES, values)
    monkeypatch.setattr(_vec, "BLOCK", 16)
    for a, b in zip(whole, _vec.words(buf, _vec.SPACES, values)):
        assert (a == b).all()
    assert [bytes(buf[s:e]) for s, e in zip(whole[0], whole[1])] == [w for t in texts for w in t.split()]
    by = {}
    for s, e, h in zip(*whole):
        by.setdefault(bytes(buf[s:e]), set()).add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {"op1": "doc_id n_shingles component_id", "op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op9": "doc_id n_words n_removed kept_sha256"}
    for n, cols in want.items():
        name = next(q for q in queries.QUERIES if q.startswith(n + "_"))
        assert set(cols.split()) <= set(queries.QUERIES[name](spark, d).columns)
    assert spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*")).first()[0] > 0
