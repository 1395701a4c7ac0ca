"""Evaluation passages inside a corpus: one Aho-Corasick automaton, one scan of the text.

The automaton reads words, not letters. Its patterns are the items cut into blocks of half the
least run: whatever ``n_words`` consecutive words of an item a text holds, one whole block is among
them. So it has a node a word of the items, where all runs of ``n_words`` words would have ten a
letter. From a block that is found the match is followed word by word to both sides. A document
is brought to the same normal form (words, lower-cased) and scanned once; only where something
matched are the hits mapped back to the characters of the original.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is an unbroken run of letters or digits.
WORD = re.compile(r"[^\W_]+")

#: Letters of the items of one automaton; a letter takes about 30 bytes of memory. More items than
#: that are scanned for in further passes over the corpus, each with its own automaton.
MAX_CHARS = 20_000_000


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Passages:
    """The automaton of some items, with their words by number (0 is any other word)."""

    def __init__(self, items: list[tuple[object, str | None]], n_words: int) -> None:
        self.n_words, block = n_words, (n_words + 1) // 2
        self.number: dict[str, int] = {}
        self.ids, self.words = [], []
        found: dict[bytes, array] = {}
        for item, text in items:
            own = array("I", [self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")])
            if len(own) < n_words:
                continue
            for at in range(0, len(own) - block + 1, block):
                found.setdefault(own[at : at + block].tobytes(), array("q")).extend((len(self.ids), at))
            self.ids.append(item)
            self.words.append(own)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in found.items():
            self.machine.add_word(tuple(array("I", key)), places)
        if found:
            self.machine.make_automaton()
        self.block = block

    def hits(self, text: str) -> dict[object, list[tuple[int, int]]]:
        """Of each item that ``text`` holds, the character spans in the original, merged."""
        said = tuple(map(self.number.get, " ".join(WORD.findall(text)).lower().split(" "), repeat(0)))
        followed: dict[tuple[int, int], int] = {}  # of an item and a shift: up to where in the text
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, places in self.machine.iter(said):
            start = end - self.block + 1
            for item, at in zip(places[::2], places[1::2], strict=True):
                if followed.get((item, start - at), 0) > start:
                    continue
                own, a, b = self.words[item], start, end + 1
                while a and at - (start - a) and said[a - 1] == own[at - (start - a) - 1]:
                    a -= 1
                while b < len(said) and at + b - start < len(own) and said[b] == own[at + b - start]:
                    b += 1
                followed[item, start - at] = b
                if b - a >= self.n_words:
                    runs[item].append((a, b))
        if not runs:
            return {}
        spans, out = [m.span() for m in WORD.finditer(text)], {}
        for item, found in runs.items():
            own: list[tuple[int, int]] = []
            for a, b in sorted(found):
                a, b = spans[a][0], spans[b - 1][1]
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
            out.setdefault(self.ids[item], []).extend(own)
        return out


def _blocks(items: DataFrame, max_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``max_chars`` characters (at least one item each)."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in items.toLocalIterator():
        if block and size + len(row[1]) > max_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n_words: int = 13, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(doc_id, item_id, start, end)``: every stretch of a document that is also in an item.

    A stretch is a longest chain of overlapping runs of ``n_words`` consecutive words; ``start``
    counts characters from 0, ``end`` is exclusive. Words are runs of letters or digits,
    lower-cased; everything else only separates them. The corpus is neither shuffled nor
    collected; the items, a stated list, go to the tasks as one automaton, built once, or where they
    have more than ``max_chars`` characters as several, one scan of the corpus each. Null or short texts, on either side, match nothing; a null
    item id or document id is carried as it is. Repeated rows give repeated results. Columns
    other than the four named are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema]}
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {kinds[item_id]}, start int, end int"
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    listed = items.select(F.col(item_id), F.col(item_text)).where(F.col(item_text).isNotNull())
    parts = []
    for block in _blocks(listed, max_chars):
        passages = Passages(block, n_words)
        if not passages.ids:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(passages)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc, item, a, b) for doc, body in zip(batch["doc_id"].tolist(), batch["text"], strict=True) for item, spans in sent.value.hits(body).items() for a, b in spans]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end"])

        parts.append(corpus.mapInPandas(scan, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
