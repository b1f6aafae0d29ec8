"""Benchmark decontamination over a distributed positional inverted index.

DataFrame functions only.  The index holds a posting (term, document, position) for
each occurrence of a test term in the training documents.  Equal windows of the test
items are one phrase.  A phrase is looked up from its two rarest terms: their lists,
shifted by the terms' offsets in it, are intersected, and the starts that remain are
compared word by word with the document.  Phrases that have these terms at the same
distance are one look-up, however many they are, and which of them stands at a start
is told by a digest of the words there: templated items, which share their rarest
terms, cost no more than others.  Hits are counted by the lengths of merged intervals.
Item ids don't travel with matches: phrases of the same items bear the number of
their class, and a set of classes is turned into ids once for all documents.

Word frequencies come from all documents.  What comes from the benchmark, its terms
and phrases, is broadcast only when its size, which is measured, is at most
``BROADCAST_BYTES``; otherwise the same joins shuffle.  Candidate starts, which grow
with the corpus, always shuffle; the texts they meet are those that a bitmap of fixed
size lets through.

Defined cases: null or empty text has no words; an item of fewer words than a window
is one window; an item without words or without item_id matches nothing; rows that
share a doc_id are judged each by its own text; a row without doc_id has no matches;
repeated items count once; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut, stored

from ._columns import quoted

#: Most bytes of benchmark terms or phrases that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bits that tell documents without a candidate; their broadcast has a 64th as many rows at most.
FILTER_BITS = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case; null has none."""
    text = F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), "")


def _digest(ws: Column) -> Column:
    """Of an array of words; they hold no space, so joined by one they stay apart."""
    return F.md5(F.array_join(ws, " "))


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """A broadcast hint if the measured size allows it."""
    n = df.agg(F.sum((F.octet_length("term") if size is None else size) + 64)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(quoted(text_col).cast("string")).alias("w"))
    return rows.select("doc_id", "row", F.posexplode("w").alias("pos", "term"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of the given terms: (term, doc_id, row, pos); rows tell documents apart that share an id."""
    return _tokens(docs, id_col, text_col).join(_small(terms), "term").select("term", "doc_id", "row", "pos")


def phrases(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, words, items, class): the distinct windows, the items that have each, a number alike for the same items; an item of fewer words than a window is one."""
    rows = benchmark.where(quoted(id_col).isNotNull()).select(quoted(id_col).alias("item_id"), words(quoted(text_col).cast("string")).alias("w")).where(F.size("w") > 0).distinct()
    size = F.least(F.size("w"), F.lit(window))
    each = rows.select("item_id", "w", size.alias("k"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at")).select("item_id", F.expr("slice(w, at + 1, k)").alias("words")).distinct()
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(_digest(F.col("words")).alias("phrase"), "words", "items", F.md5(F.to_json("items")).alias("class"))


def _anchors(tests: DataFrame, frequency: DataFrame) -> DataFrame:
    """(size, term, off, term2, apart): the two rarest terms of phrases of so many words, by frequency, the first's offset and how far the second is from it.

    A phrase with a term that no document has can't occur and has no anchors.
    """
    terms = tests.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    order = F.struct("n", "at", "term")
    of = terms.join(frequency, "term").groupBy("phrase", "size").agg(F.count("*").alias("have"), F.slice(F.sort_array(F.collect_list(order)), 1, 2).alias("two")).where("have = size")
    a, b = F.element_at("two", 1), F.element_at("two", -1)
    return of.select("size", a["term"].alias("term"), a["at"].alias("off"), b["term"].alias("term2"), (b["at"] - a["at"]).alias("apart")).distinct()


def starts(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spots): the (start, size) at which the two rarest terms of some phrase stand as in it."""
    vocabulary = tests.select(F.explode("words").alias("term")).distinct()
    if (vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        frequency = postings(docs, vocabulary, id_col, text_col).groupBy("term").agg(F.count("*").alias("n"))
    else:  # counted in the map tasks, so that words are shuffled once for a task rather than for each occurrence
        frequency = _tokens(docs, id_col, text_col).groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term", "left_semi")
    anchors = cut(_anchors(tests, cut(frequency)))
    keys = anchors.select("term").union(anchors.select(F.col("term2").alias("term"))).distinct()
    index = stored(postings(docs, keys, id_col, text_col))
    # a posting asks for what stands at the few distances that its term's phrases have, not for each phrase
    first = index.join(_small(anchors.select("term", "apart").distinct()), "term").select("doc_id", "row", "term", "pos", "apart", (F.col("pos") + F.col("apart")).alias("pos2"))
    second = index.select(F.col("row").alias("r"), F.col("term").alias("term2"), F.col("pos").alias("p"))
    both = first.join(second, (F.col("row") == F.col("r")) & (F.col("pos2") == F.col("p")))
    found = both.join(_small(anchors, F.octet_length("term") + F.octet_length("term2")), ["term", "apart", "term2"])
    spots = found.select("doc_id", (F.col("pos") - F.col("off")).alias("start"), "size").where("start >= 0")
    return spots.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("spots"))


def candidates(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase, starts): where a phrase's two rarest terms stand as in it, and the words have its digest."""
    found = stored(starts(docs, tests, id_col, text_col).withColumnRenamed("doc_id", "of"))
    texts = _marked(docs.where(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("__id"), quoted(text_col).cast("string").alias("__text")), found).where("__may")
    read = texts.join(found, F.col("__id") == F.col("of")).select("of", "spots", F.array(words("__text")).alias("__words"))
    # the text is cut once, as below
    told = F.transform("__words", lambda ws: F.transform("spots", lambda s: F.struct(s["start"].alias("start"), _digest(F.slice(ws, s["start"] + 1, s["size"])).alias("phrase"))))
    each = read.select(F.col("of").alias("doc_id"), F.explode(told[0]).alias("x")).select("doc_id", "x.phrase", "x.start")
    return each.join(_small(tests.select("phrase"), F.octet_length("phrase")), "phrase", "left_semi").groupBy("doc_id", "phrase").agg(F.collect_set("start").alias("starts"))


def _marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``__may``: whether a row's ``__id`` may be one of ``of``, by a bitmap of hashes of fixed size, FILTER_BITS."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words_of = found.select(place("of").alias("h")).groupBy(F.expr("h div 64").alias("__at")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("__bits"))
    rows = rows.withColumn("__h", place("__id")).withColumn("__at", F.expr("__h div 64")).join(F.broadcast(words_of), "__at", "left")
    return rows.withColumn("__may", F.expr("coalesce((shiftright(__bits, cast(__h % 64 as int)) & 1L) = 1, false)")).drop("__h", "__at", "__bits")


def phrase_matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs: doc_id, n_words, the columns to keep, and ``matches``: array of (class, size, starts) of the phrases found, in word positions; tests: ``phrases``, cut."""
    found = candidates(docs, tests, id_col, text_col).join(_small(tests, F.octet_length(F.array_join("words", " ")) + 64).select("phrase", "words", "class"), "phrase")
    found = stored(found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("words", "class", "starts")).alias("maybe")))
    plain = docs.select(quoted(id_col).cast("long").alias("__id"), quoted(text_col).cast("string").alias("__text"), F.struct(*[quoted(c) for c in keep or []] or [F.lit(None)]).alias("kept"))
    # texts without a candidate needn't travel; the others meet their starts
    plain = _marked(plain, found)
    there = plain.where("__may").join(found, F.col("__id") == F.col("of"), "left")
    both = there.unionByName(plain.where("not __may"), True).withColumn("__words", F.array(words("__text")))
    # the text is cut once: its words are bound to a variable, not written out in each comparison
    matches = """
        filter(transform(maybe, c -> struct(c.class as class, size(c.words) as size, array_sort(filter(c.starts, s -> slice(ws, s + 1, size(c.words)) = c.words)) as starts)),
            m -> size(m.starts) > 0)"""
    both = both.select(F.col("__id").alias("doc_id"), "kept", F.expr(f"transform(__words, ws -> struct(size(ws) as n_words, if(maybe is null, null, {matches}) as matches))[0]").alias("x"))
    return both.select("doc_id", "kept", F.col("x.n_words").cast("long").alias("n_words"), F.col("x.matches").alias("matches"))


def proximity_matches(docs: DataFrame, first: str, others: list[str], within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos) of each occurrence of the first term that has all the others at most ``within`` words away."""
    terms = docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys([first, *others])], "term string")
    index = cut(postings(docs, terms, id_col, text_col))
    found = index.where(F.col("term") == first).select("doc_id", "pos")
    for t in others:
        other = index.where(F.col("term") == t).select(F.col("doc_id").alias("d"), F.col("pos").alias("p"))
        found = found.join(other, (F.col("doc_id") == F.col("d")) & F.col("p").between(F.col("pos") - within, F.col("pos") + within), "left_semi")
    return found


#: Words inside any match: the lengths of its intervals, in order, less what an earlier one covers.
_HIT = """
    coalesce(aggregate(array_sort(flatten(transform(matches, m -> transform(m.starts, s -> struct(cast(s as long) as a, cast(s + m.size as long) as b))))), struct(0L as n, 0L as e),
        (x, y) -> struct(x.n + greatest(0L, y.b - greatest(x.e, y.a)) as n, greatest(x.e, y.b) as e), x -> x.n), 0L)"""


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which fewer than one word in ``one_in`` is hit, with their columns."""
    m = phrase_matches(docs, cut(phrases(benchmark, window)), id_col, text_col, docs.columns).withColumn("n_hit", F.expr(_HIT))
    return m.where((F.col("n_hit") == 0) | (one_in * F.col("n_hit") < F.col("n_words"))).select("kept.*")


def _named(sets: DataFrame, tests: DataFrame) -> DataFrame:
    """(set, n_items, items_sha256): of each distinct set of classes the ids of their items, as strings, in order."""
    items = tests.groupBy("class").agg(F.first("items").alias("items"))
    each = sets.select("set", F.explode("classes").alias("class")).join(items, "class").select("set", F.explode("items").alias("item"))
    names = each.groupBy("set").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("names"))
    return names.select("set", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (one word in ``one_in`` or more is hit)."""
    tests = cut(phrases(benchmark, window))
    classes = F.expr("array_sort(array_distinct(transform(matches, m -> m.class)))")
    out = stored(phrase_matches(docs, tests, id_col, text_col).select("doc_id", "n_words", F.expr(_HIT).alias("n_hit"), classes.alias("classes")).withColumn("set", F.md5(F.array_join("classes", ","))))
    hit, rest = out.where("size(classes) > 0"), out.where("coalesce(size(classes), 0) <= 0")
    sets = hit.groupBy("set").agg(F.first("classes").alias("classes"))
    both = hit.join(_named(sets, tests), "set").unionByName(rest.withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit(""), 256)))
    return both.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
