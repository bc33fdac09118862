"""Operator 4, byte-level BPE: pre-tokenisation by transition-function scans, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols, which see at most two characters ahead: letter, number, other, apostrophe of a short or of a long
# contraction, inner white space, the last white space before something else (a space or not), end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, SPACE, BREAK, END = range(9)
# States after a character: nothing open, a run of letters, numbers or others, a space that waits for a run,
# white space, and a contraction with one or two letters to go.
CLOSED, LETTERS, NUMBERS, OTHERS, WAITING, WHITE, ONE, TWO = range(8)
#: White_Space code points, as ranges (fixed values).
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Letters and numbers that Unicode 15.1 and 16.0 added to 15.0, as ranges (fixed values): with them every Python from 3.12 on that
#: has Unicode 15.0 to 16.0 gives the classes of 16.0, which are the library's.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x2EBF0, 0x2EE5D),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Bytes that a worker's cache of pieces takes at most, with what an entry takes beside its piece and tokens; longer pieces are merged each time.
CACHE_BYTES, ENTRY_BYTES, CACHED_PIECE = 24 << 20, 200, 64
#: Characters that are scanned at once.
CHUNK = 1 << 18


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece), each indexed by symbol * 8 + state."""
    to, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        to[symbol] = run
        starts[symbol, [run, WAITING]] = False
    for symbol, left in ((SHORT, ONE), (LONG, TWO)):
        to[symbol] = left
        to[symbol, [OTHERS, WAITING]] = OTHERS
        starts[symbol, [OTHERS, WAITING]] = False
    to[INNER], to[SPACE], to[BREAK], to[END] = WHITE, WAITING, CLOSED, CLOSED
    starts[INNER, WHITE] = False
    to[:END, TWO], to[:END, ONE] = ONE, CLOSED
    starts[:END, [TWO, ONE]] = False
    return to.ravel(), starts.ravel()


TO, STARTS = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER of each code point, by Unicode 16.0."""
    if unicodedata.unidata_version not in ("15.0.0", "15.1.0", "16.0.0"):
        raise RuntimeError(f"code point classes are known for Python with Unicode 15.0 to 16.0, not {unicodedata.unidata_version}")
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER), (WHITE_SPACE, INNER)):
        for lo, hi in ranges:
            out[lo : hi + 1] = kind
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of code points in which each text is followed by one end mark, at ``ends``."""
    out = classes()[points]
    out[ends] = END
    after = np.append(out[1:], END)
    last = (out == INNER) & (after != INNER) & (after != END)
    out[last] = np.where(points[last] == 32, SPACE, BREAK)
    at = np.flatnonzero(points == 39)
    if len(at):
        ahead = np.append(np.where(out == END, 0, points), (0, 0))
        a, b = ahead[at + 1], ahead[at + 2]
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        out[at[(b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))]] = LONG
    return out


def entry_states(sym: np.ndarray, width: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The symbols as rows of ``width``, transposed, and the state in which each row is entered.

    Each row's transition function, state to state, is composed column by column for all rows at once. The
    functions of the rows compose associatively, so the entry states are a prefix scan over them.
    """
    rows = -(-len(sym) // width)
    table = np.full(rows * width, END, np.uint8)
    table[: len(sym)] = sym
    table = np.ascontiguousarray(table.reshape(rows, width).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in table:
        maps = np.take(TO, (column[:, None] << 3) + maps, mode="clip")
    step = 1
    while step < rows:  # inclusive scan: after it, maps[i] takes the first state through rows 0 to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    return table, np.append(np.uint8(CLOSED), maps[:-1, CLOSED])


def piece_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indexes at which a piece, or an end mark, starts."""
    table, state = entry_states(symbols(points, ends))
    out = np.empty(table.shape, bool)
    for column, to in zip(table, out):
        at = (column << 3) + state
        np.take(STARTS, at, out=to, mode="clip")
        state = np.take(TO, at, mode="clip")
    return np.flatnonzero(out.T.ravel()[: len(points)])


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Ranks by bytes, and for decoding the bytes of all tokens in one array with each token's start and length."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    starts = np.cumsum(lengths) - lengths
    ordered = sorted(ranks, key=ranks.__getitem__)
    return ranks, np.frombuffer(b"".join(ordered), np.uint8), starts, lengths


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the pair of lowest rank, leftmost first, is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 128:  # the list operations are fast while they are short
        none = 1 << 32  # above any rank
        at, pairs = list(range(n + 1)), [ranks.get(piece[i : i + 2], none) for i in range(n - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            del at[i + 1], pairs[i]
            if i:
                pairs[i - 1] = ranks.get(piece[at[i - 1] : at[i + 1]], none)
            if i < len(pairs):
                pairs[i] = ranks.get(piece[at[i] : at[i + 2]], none)
        return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:  # one of the two was merged otherwise meanwhile
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; keeps the tokens of the pieces it has seen, a newer and an older half, of CACHE_BYTES together at most."""

    def __init__(self, path: str):
        self.ranks, _, _, self.lengths = vocabulary(path)
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.room = CACHE_BYTES // 2

    def piece(self, piece: bytes) -> bytes:
        out = self.older.get(piece) or pack(f"<{len(ids := merge(piece, self.ranks))}I", *ids)
        if len(piece) <= CACHED_PIECE:
            takes = ENTRY_BYTES + len(piece) + len(out)
            if takes > self.room:
                self.older, self.seen, self.room = self.seen, {}, CACHE_BYTES // 2
            self.room -= takes
            self.seen[piece] = out
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = piece_starts(points, ends)
        size = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.append(0, np.cumsum(size, dtype=np.int64))
        data, cut = joined.encode(), offset[starts].tolist()
        pieces = [data[a:b] for a, b in zip(cut, [*cut[1:], len(data)])]
        marks = np.searchsorted(starts, ends).tolist()  # each end mark is a piece of its own
        tokens, out, lo = list(map(self.seen.get, pieces)), [], 0
        for hi in marks:
            part = tokens[lo:hi]
            if None in part:
                part = [self.seen.get(p) or self.piece(p) for p in pieces[lo:hi]]
            out.append(b"".join(part))
            lo = hi + 1
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)

    def flush(ids, texts):
        tokens = encode(texts)
        lengths = [encode.lengths[np.frombuffer(t, "<u4")] for t in tokens]
        offsets = [(np.cumsum(x) - x).astype("<i4").tobytes() for x in lengths]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array(tokens, pa.binary()), pa.array(offsets, pa.binary())], ["doc_id", "n_tokens", "ids", "offsets"])

    for batch in batches:
        ids, texts, n = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if texts and n + len(text) > CHUNK:
                yield flush(ids, texts)
                ids, texts, n = [], [], 0
            ids.append(i)
            texts.append(text)
            n += len(text)
        if texts:
            yield flush(ids, texts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (unsigned 32-bit little-endian), offsets (signed 32-bit, of each token in the UTF-8 text).

    ``path``: a tiktoken rank file of a byte-level vocabulary, readable on each executor. A null text is empty
    and has no tokens. There are no special tokens: their strings are ordinary text. Only doc_id and text are read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda it: encode_batches(it, path), "doc_id bigint, n_tokens bigint, ids binary, offsets binary")


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    _, blob, starts, lengths = vocabulary(path)
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part, texts = batch.slice(i, 64), []
            for ids, offsets in zip(part.column("ids").to_pylist(), part.column("offsets").to_pylist()):
                ids, offsets = np.frombuffer(ids or b"", "<u4"), np.frombuffer(offsets or b"", "<i4")
                # byte k of the text lies in the token with the last offset up to k
                at = np.repeat(starts[ids] - offsets, lengths[ids])
                at += np.arange(len(at))
                texts.append(blob[at].tobytes())
            columns = [part.column(c) for c in ("doc_id", "n_tokens", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids of ``encoded``, as ``encode`` returns it, and decoded: the bytes of each row's text."""
    rows = encoded.select("doc_id", "n_tokens", "ids", "offsets")
    return rows.mapInArrow(lambda it: decode_batches(it, path), "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, with one Python worker a task: doc_id, n_tokens, ids and decoded."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda it: decode_batches(encode_batches(it, path), path), "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
