"""Token counts by heap-and-linked-list byte-pair merging.

A word's bytes start as a doubly linked list of symbols. A heap holds the adjacent pairs that have a merge rank;
popping the lowest rank (leftmost on ties) joins two symbols and offers the two new neighbours. The count is the initial
symbols minus the merges made, so no token identifiers are ever built. Counts equal those of the public library for the
same vocabulary file, special strings inside a text included (one token each). Null texts count as empty; texts of any
length are counted whole; repeated rows stay repeated; other columns, whatever their names, are not read; an empty table
gives an empty result. Map-only; the memo of word counts has a fixed bound.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's memo before it starts anew.
MEMO = 500_000
#: White space as the vocabulary's own splitter sees it.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    text, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if text[i] != a or j < 0 or text[j] != b:
            continue  # one of the two has merged since
        merges += 1
        text[i] = joined = a + b
        text[j] = ""
        right[i] = after = right[j]
        if after >= 0:
            left[after] = i
            if (r := ranks.get((joined, text[after]))) is not None:
                heapq.heappush(heap, (r, i, joined, text[after]))
        before = left[i]
        if before >= 0 and (r := ranks.get((text[before], joined))) is not None:
            heapq.heappush(heap, (r, before, text[before], joined))
    return n - merges


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordCounter:
    """Counts tokens under a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        steps = spec["pre_tokenizer"]["pretokenizers"]
        blank = "".join(_BLANK)
        self.words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{blank}")).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.odd = regex.compile("[\x1c-\x1f]")
        self.symbols = byte_alphabet()
        self.memo: dict[str, int] = {}

    def word(self, w: str) -> int:
        symbols = [self.symbols[b] for b in w.encode("utf8", "surrogatepass")]
        symbols[-1] += self.end
        return merge_count(symbols, self.ranks)

    def piece(self, piece: str) -> int:
        plain = unicodedata.normalize("NFC", piece)
        plain = plain.lower() if plain.isascii() else "".join(map(str.lower, plain))
        n = sum(map(self.word, self.words(plain)))
        if len(piece) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special and "<|" in text:
            total, parts = len(self.special.findall(text)), self.special.split(text)
        get, piece = self.memo.get, self.piece
        for part in parts:
            for p in [part] if self.odd.search(part) else part.split():
                n = get(p)
                total += piece(p) if n is None else n
        return total


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. vocabulary: a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(vocabulary)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array([counter.count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
