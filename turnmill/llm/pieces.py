"""Splitting oversized texts at natural boundaries, with overlap between pieces.

Every boundary of a text is joined to its farthest legal successor: the last boundary of the best
kind (paragraph, line, sentence, word) that still fits a piece which begins ``overlap`` tokens
before the first. Which boundaries greedy cutting really uses follows from pointer doubling: the
successor table is squared again and again, and the set of cuts doubles with it, so that a text
of n cuts takes log2(n) array steps. Texts stay where they are read; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.tokens import RANKS, counts, encoding, splits

KINDS = ("none", "word", "sentence", "line", "paragraph", "end")

# White space, line ends, and what ends and closes a sentence.
_SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LINE_ENDS = [10, 11, 12, 0x85, 0x2028, 0x2029]
_STOPS, _WIDE_STOPS, _CLOSERS = ".!?…", "。！？", "\"'”’»)]」』"


def _member(codes: np.ndarray, members: list[int]) -> np.ndarray:
    table = np.zeros(0x10000, bool)
    table[members] = True
    return table[np.minimum(codes, 0xFFFF)]


def kinds(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind (index of :data:`KINDS`) of a cut before each character position in ``ends``."""
    n = len(codes)
    space = np.append(_member(codes, _SPACES), False)
    line = _member(codes, _LINE_ENDS) | ((codes == 13) & (np.append(codes[1:], 0) != 10))
    lines = np.append(0, np.cumsum(line))
    stop, wide, closer = (_member(codes, [ord(c) for c in x]) for x in (_STOPS, _WIDE_STOPS, _CLOSERS))
    # The end of the white space that begins at each position.
    after = np.where(space, n, np.arange(n + 1))
    after = np.minimum.accumulate(after[::-1])[::-1]
    breaks = lines[after[ends]] - lines[ends]
    last, prior = ends - 1, np.maximum(ends - 2, 0)
    word = (space[ends] | (ends == n)) & ~space[last]
    ended = stop[last] | wide[last] | (closer[last] & (stop[prior] | wide[prior]))
    kind = np.where(word, 1, 0)
    kind = np.where((word & ended) | wide[last] | (closer[last] & wide[prior]), 2, kind)
    kind = np.where(word & (breaks == 1), 3, kind)
    kind = np.where(word & (breaks > 1), 4, kind)
    kind[ends == n] = 5
    return kind


def _units(text: str, limit: int, ranks: str, by_bytes: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Lengths in characters and in tokens of the parts a text may be cut between, and whether
    the tokens are estimated.

    The parts are the tokenizer's own splits, so that tokens add up. Only a split too long to be
    a part is taken in short runs: at the tokens of the runs, or, to be safe, at their bytes,
    which no tokenization exceeds.
    """
    parts = splits(text)
    chars = np.fromiter(map(len, parts), np.int64, len(parts))
    cost = np.fromiter(map(counts(ranks).__getitem__, parts), np.int64, len(parts))
    most = max(1, limit // 8)
    if not (cost > most).any():
        return chars, cost, False
    out: list[tuple[int, int]] = []
    for part, n, c in zip(parts, chars.tolist(), cost.tolist(), strict=True):
        if c <= most:
            out.append((n, c))
            continue
        step = max(1, most // 4)
        runs = [part[i : i + step] for i in range(0, n, step)]
        out += [(len(run), len(run.encode()) if by_bytes else len(encoding(ranks).encode_ordinary(run))) for run in runs]
    both = np.array(out, np.int64)
    return both[:, 0], both[:, 1], True


def successors(total: np.ndarray, kind: np.ndarray, limit: int, overlap: int, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each boundary: where the piece after it begins, and the boundary at which it ends.

    ``total`` are the tokens before each boundary. An end of a better kind is taken only if the
    piece is at least ``fill`` of the limit long; every piece goes beyond the one before.
    """
    n = len(total) - 1
    here = np.arange(n + 1)
    words = np.flatnonzero((kind > 0) | (here == 0))
    begin = words[np.searchsorted(total[words], total - overlap, "right") - 1]
    plain = np.maximum(np.searchsorted(total, total - overlap, "right") - 1, 0)
    begin = np.where((total - overlap < 0) | (total - total[begin] > limit // 2), plain, begin)
    begin[0] = 0
    far = np.searchsorted(total, total[begin] + limit, "right") - 1
    nearest = np.maximum(np.searchsorted(total, total[begin] + int(limit * fill), "left"), here + 1)
    found = np.maximum(far, np.minimum(here + 1, n))
    done = found == n
    for k in (4, 3, 2, 1):
        at = np.flatnonzero(kind >= k)
        if not len(at):
            continue
        place = np.searchsorted(at, far, "right") - 1
        candidate = np.where(place >= 0, at[np.maximum(place, 0)], -1)
        better = ~done & (candidate >= nearest)
        found = np.where(better, candidate, found)
        done |= better
    found[n] = n
    return begin, found


def cuts(successor: np.ndarray) -> np.ndarray:
    """All boundaries that greedy cutting from the first one uses, by pointer doubling."""
    reached = np.zeros(len(successor), bool)
    reached[0] = True
    jump, end = successor, len(successor) - 1
    while True:
        reached[jump[reached]] = True
        if jump[0] == end:
            return np.flatnonzero(reached)
        jump = jump[jump]


def pieces_of(text: str, limit: int, overlap: int, fill: float, ranks: str) -> list[tuple[int, int, int, int, str]]:
    """``(start, end, tokens, repeated tokens, kind of the end)`` of each piece, or nothing if
    the whole text is within the limit."""
    if len(text) * 4 <= limit or len(text.encode()) <= limit:
        return []
    for by_bytes in (False, True):
        chars, cost, estimated = _units(text, limit, ranks, by_bytes)
        if cost.sum() <= limit or (estimated and len(encoding(ranks).encode_ordinary(text)) <= limit):
            return []
        ends, total = np.append(0, np.cumsum(chars)), np.append(0, np.cumsum(cost))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.append(0, kinds(codes, ends[1:]))
        begin, successor = successors(total, kind, limit, overlap, fill)
        path = cuts(successor)
        froms, tos = path[:-1], path[1:]
        starts, stops, fresh = ends[begin[froms]].tolist(), ends[tos].tolist(), ends[froms].tolist()
        tokens, repeated = (total[tos] - total[begin[froms]]).tolist(), (total[froms] - total[begin[froms]]).tolist()
        if estimated:
            tokens = [len(encoding(ranks).encode_ordinary(text[a:b])) for a, b in zip(starts, stops, strict=True)]
            repeated = [len(encoding(ranks).encode_ordinary(text[a:b])) for a, b in zip(starts, fresh, strict=True)]
        if max(tokens) <= limit:
            break
    return list(zip(starts, stops, tokens, repeated, [KINDS[k] for k in kind[tos]], strict=True))


def split_oversized(docs: DataFrame, doc_id: str, text: str, limit: int = 512, overlap: int = 64, fill: float = 0.5, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, piece_no, n_pieces, start_char, end_char, n_tokens, repeated_tokens, ends_at,
    piece)`` of each text of more than ``limit`` tokens.

    Pieces are parts of the text, in order and from 1; together they cover it. None has more than
    ``limit`` tokens. Each ends at the last paragraph end within the limit, else line end, else
    sentence end, else word end (each only if the piece is then at least ``fill`` of the limit
    long), else between tokens, and begins at the word start that repeats at least ``overlap``
    tokens of the piece before (in text without spaces, where tokens are estimated first, about as many). ``overlap`` must be at most a quarter of the limit. Null texts
    and texts within the limit give no row; repeated rows give repeated pieces; other columns
    are ignored.
    """
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be between 0 and a quarter of the limit")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "repeated_tokens", "ends_at", "piece"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                found = pieces_of(body, limit, overlap, fill, ranks)
                rows += [(doc, i, len(found), a, b, n, r, k, body[a:b]) for i, (a, b, n, r, k) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=names)

    # A token is at least a byte, so shorter texts are within the limit.
    long = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    return long.mapInPandas(split, f"doc_id {kind}, piece_no int, n_pieces int, start_char int, end_char int, n_tokens int, repeated_tokens int, ends_at string, piece string")
