"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A word's symbols form a linked list; a heap holds its adjacent pairs by rank and
place; the lowest is popped and merged until none is left.  The count is the
number of initial symbols less the merges.  Words repeat, so a worker keeps the
counts of recent ones.

Defined cases: null or empty text has no tokens; the file's special strings
inside a text count one each, as the library has it by default; a run without white
space is one word, whose lists take about 60 times its bytes while it is merged.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.session import batched

from ._memory import tidy
from .byte_bpe import SPACE

#: Words whose counts a worker keeps.
CACHE = 1_000_000
#: Characters of the longest word whose count is kept; bytes of the longest whose lists aren't packed.
LONG, SHORT = 256, 4096
_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split() alone
_SPACES = re.compile(f"[{SPACE}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + n))
        n += b not in shown
    return out


class Counter(dict):
    """Counts of words (runs without white space), filled as they are asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        shown, number = _byte_symbols(), {}
        of = lambda symbol: number.setdefault(symbol, len(number))
        #: Numbers of the symbols of a byte, within a word and at its end.
        self.first, self.last = [of(c) for c in shown], [of(c + suffix) for c in shown]
        #: Rank of each pair of numbers; the number of what each rank merges to.
        self.ranks = {of(a) << 32 | of(b): r for r, (a, b) in reversed([*enumerate(merges)])}
        self.result = [of(a + b) for a, b in merges]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = [s[:2] for s in special]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        raw = word.encode()
        n, ranks, result = len(raw), self.ranks, self.result
        if n == 1:
            return 1
        of = list if n <= SHORT else lambda x: array("i", x)  # a long run's numbers are packed
        symbols = of(map(self.first.__getitem__, raw))
        symbols[-1] = self.last[raw[-1]]
        after, before, merges = of(range(1, n + 1)), of(range(-1, n - 1)), 0
        after[-1] = -1
        # rank and place in one number
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = result[r], -1
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def __missing__(self, word: str) -> int:
        n = sum(map(self.merged, self.pattern.findall(word)))
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # by characters, without regard to a word's end
        else:
            text = text.lower()
        words = _SPACES.split(text) if _ODD.search(text) else text.split()
        return sum(map(self.__getitem__, words))

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than the limit)."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return batched(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
