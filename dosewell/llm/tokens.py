"""Token counts and token ids by a public byte-level BPE vocabulary.

Texts are cut at places that are always borders between pre-tokens, equal pieces of a batch are
found with Arrow's dictionary encoding, and only the distinct pieces go through `tokenizers`.
Batches are balanced by bytes, not rows, and a long text is encoded in pieces. The borders are those
of one pre-tokenizer; with a vocabulary that has another, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import flat, groups

#: Bytes of text per batch of distinct pieces: the larger, the fewer pieces are encoded twice, and the more memory a task
#: takes (some 30 bytes for each byte of text).
BATCH_BYTES = 6 << 20
#: Distinct pieces whose ids a Python worker remembers between batches.
CACHE_PIECES = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b'.,;:!?)"')] = True


#: Bytes without a cut beyond which rarer borders are looked for.
RARE = 1 << 12
#: The pre-tokenizer whose borders `safe_cuts` knows; texts for others are encoded whole.
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _wide(x: np.ndarray) -> np.ndarray:
    """Whether a character beyond ASCII that is no white space begins at each byte, by its first three bytes.

    White space beyond ASCII lies in U+0080-00BF, U+1680, U+2000-207F and U+3000; those ranges, or more, are left out.
    """
    b1, b2 = np.append(x[1:], 0), np.append(x[2:], (0, 0))[: len(x)]
    out = (x >= 0xC3) & (x < 0xF8)
    out &= ~((x == 0xE1) & (b1 == 0x9A)) & ~((x == 0xE2) & ((b1 == 0x80) | (b1 == 0x81))) & ~((x == 0xE3) & (b1 == 0x80) & (b2 == 0x80))
    return out


def safe_cuts(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted byte positions, row starts among them, at which texts may be cut without changing any token.

    Cuts lie before a lone blank between two characters of any script that aren't white space, around
    a lone line feed of that kind, and between an ASCII letter and one of . , ; : ! ? ) ". Where those are far
    apart, also between an ASCII letter and a digit, and before an ideographic comma or full stop after a
    Chinese character or hiragana. All are borders of the pre-tokenizer's pattern, and none lies
    inside a special token's string. A longer run of one kind of character is one pre-token.
    """
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    mark = np.zeros(n, bool)
    starts = off[:-1][off[:-1] < off[1:]]
    if n > 2:
        solid = _PRINT[x]
        ends = solid.copy()  # the character that ends here is no white space
        wide = _wide(x)
        for back, low, high in ((1, 0xC3, 0xDF), (2, 0xE0, 0xEF), (3, 0xF0, 0xF7)):  # the last byte of 2, 3 or 4
            ends[back:] |= wide[:-back] & (x[:-back] >= low) & (x[:-back] <= high)
        begins = solid | wide
        inner = ends[:-2] & begins[2:]
        blank = inner & (x[1:-1] == 32)
        feed = inner & (x[1:-1] == 10)
        border = np.zeros(n, bool)
        border[starts] = True
        # a row's first or last byte has no neighbour in its row
        free = ~(border[1:-1] | border[2:])
        blank &= free
        feed &= free
        mark[1:-1] = blank | feed
        mark[2:] |= feed
        mark[1:] |= _LETTER[x[:-1]] & _STOP[x[1:]]
    mark[starts] = True
    found = np.flatnonzero(mark)
    gap = np.diff(np.append(found, n))
    for a, size in zip(found[gap > RARE].tolist(), gap[gap > RARE].tolist(), strict=True):
        mark[a : a + size] |= _rare(x[a : a + size])
    return np.flatnonzero(mark) if (gap > RARE).any() else found


def _rare(x: np.ndarray) -> np.ndarray:
    """Borders inside a stretch of a text: letter to digit, digit to letter, and before U+3001 or U+3002 after a letter."""
    out = np.zeros(len(x), bool)
    out[1:] = (_LETTER[x[:-1]] & _DIGIT[x[1:]]) | (_DIGIT[x[:-1]] & _LETTER[x[1:]])
    if len(x) >= 6:
        a, b, c = x[:-5], x[1:-4], x[2:-3]
        letter = ((a >= 0xE5) & (a <= 0xE8)) | ((a == 0xE3) & (((b == 0x81) & (c >= 0x82)) | ((b == 0x82) & (c <= 0x93))))
        out[3:-2] |= letter & (x[3:-2] == 0xE3) & (x[4:-1] == 0x80) & ((x[5:] == 0x81) | (x[5:] == 0x82))
    return out


class Pieces:
    """Encodes batches of texts piece by piece; holds one tokenizer and a bounded memory of pieces."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        parts = json.loads(self.tokenizer.to_str())
        how = parts["pre_tokenizer"] or {}
        self.cuts = parts["normalizer"] is None and all(how.get(k) == v for k, v in KNOWN.items())
        self.known: dict[bytes, list[int]] = {}

    def ids(self, pieces: list[bytes]) -> list[list[int]]:
        out = [self.known.get(p) for p in pieces]
        new = [k for k, v in enumerate(out) if v is None]
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in part], add_special_tokens=False), strict=True):
                out[k] = v = e.ids
                if len(self.known) < CACHE_PIECES:
                    self.known[pieces[k]] = v
        return out

    def batch(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code of each piece, first piece of each row and the end, tokens per code, start of a code in the pool, pool of ids)."""
        cuts = safe_cuts(x, off) if self.cuts else off[:-1][off[:-1] < off[1:]]
        ends = np.append(cuts, len(x)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
        coded = column.dictionary_encode()
        found = self.ids(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        return coded.indices.to_numpy(), np.searchsorted(cuts, off), lengths, np.cumsum(lengths) - lengths, pool

    def slices(self, x: np.ndarray, limit: int = 0) -> Iterator[np.ndarray]:
        """A text in parts of about `limit` bytes, cut where no token is changed; whole where no such place is known.

        A cut follows from the few bytes around it, so those found in a part, away from its end, are the text's.
        """
        at, size = 0, limit or BATCH_BYTES
        while self.cuts and len(x) - at > size:
            found = safe_cuts(x[at : at + size], np.array([0, size]))
            found = found[(found > 0) & (found <= size - 16)]
            if len(found):
                yield x[at : at + int(found[-1])]
                at, size = at + int(found[-1]), limit or BATCH_BYTES
            else:
                size *= 2
        yield x[at:]

    def counts(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) == 2 and len(x) > BATCH_BYTES:
            return np.array([sum(int(self._counts(part, np.array([0, len(part)]))[0]) for part in self.slices(x))])
        return self._counts(x, off)

    def rows(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each row's begin (and the end)."""
        if len(off) == 2 and len(x) > BATCH_BYTES:
            ids = np.concatenate([self._rows(part, np.array([0, len(part)]))[0] for part in self.slices(x)])
            return ids, np.array([0, len(ids)])
        return self._rows(x, off)

    def _counts(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        codes, first, lengths, _, _ = self.batch(x, off)
        total = np.concatenate(([0], np.cumsum(lengths[codes] if len(codes) else np.zeros(0, np.int64))))
        return total[first[1:]] - total[first[:-1]]

    def _rows(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, first, lengths, starts, pool = self.batch(x, off)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        n = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        take = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], n)
        return pool[take], ends[first]


_LOADED: dict[str, Pieces] = {}


def pieces(vocabulary: str) -> Pieces:
    """One encoder for a Python worker: loading the vocabulary costs more than a small batch."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Pieces(vocabulary)
    return _LOADED[vocabulary]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins small batches, so that distinct pieces are looked for in about BATCH_BYTES of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of `tokenizers` without added special tokens; a special token's string inside
    a text counts as that token, the library's default. A null or empty text has 0 bytes and 0
    tokens; a null id stays null; repeated rows give repeated results; an empty table gives no rows.
    Other columns are not read. Only lengths leave the Arrow function.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for b in gathered(batches):
            x, off = flat(b.column(1))
            for i, j in groups(off, BATCH_BYTES):
                part = off[i : j + 1]
                n = encoder.counts(x[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(part)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_pieces(docs: DataFrame, vocabulary: str | None = None, width: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and an end id, cut into pieces of at most `width` tokens.

    Returns doc_id, piece, start, length, ids_crc32. A document of at most `width` ids is one piece;
    of a longer one, all pieces but the first have `width` ids and the first has the rest. A null or
    empty text is the end id alone. Rows are independent, so repeated rows give repeated pieces.
    """
    path = vocabulary or default_vocabulary()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for b in gathered(batches):
            x, off = flat(b.column(1))
            for i, j in groups(off, BATCH_BYTES):
                part = off[i : j + 1]
                ids, at = encoder.rows(x[part[0] : part[-1]], part - part[0])
                rows = j - i
                begin = at + np.arange(rows + 1)  # an end id after each row
                out = np.full(begin[-1], end_id, "<u4")
                body = np.ones(len(out), bool)
                body[begin[1:] - 1] = False
                out[body] = ids
                n = np.diff(begin)
                k = -(-n // width)
                doc = np.repeat(np.arange(rows), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                head = n - (k - 1) * width
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * width)
                length = np.where(piece == 0, head[doc], width)
                raw = memoryview(out.tobytes())
                lo = ((begin[:-1][doc] + start) * 4).tolist()
                hi = ((begin[:-1][doc] + start + length) * 4).tolist()
                crc = np.fromiter((zlib.crc32(raw[a:c]) for a, c in zip(lo, hi, strict=True)), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, rows).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")
