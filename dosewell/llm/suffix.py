"""Repeated passages by suffix arrays over a prefix-free parse.

Every window of `length` bytes has a trigger: the place in it whose rolling hash over `WINDOW` bytes is
least. The windows of one trigger make a phrase, so phrases overlap by length - 1 bytes and each window
lies in one phrase. Equal windows have equal triggers, wherever they stand.

1. Trigger hashes are counted over the corpus; text whose triggers occur once has no repeats.
2. The other phrases are dealt out by trigger hash. Equal phrases become one dictionary entry, with
   its first place in the corpus from the parse; all other places of it are repeats as a whole.
   A trigger that very many documents have (the edge of a common passage, with other text around it
   each time) is hot: its phrases are split by what stands around it. The windows of a phrase are taken
   in classes of `SPLIT` neighbours, a class is dealt out by the bytes that all its windows share, and one whose
   bytes occur once has no repeats. A class that is hot again is dealt out window by window.
3. The suffixes of a part's dictionary are ordered by prefix doubling (8, 16, 32, ... bytes) up to
   `length` bytes, without hashes. Suffixes of equal rank are equal windows; the parse gives the
   first one in corpus order, and the others are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import flat, groups, hash_places, keep, maybe_in, membership, mix64, numbered, partitions

#: Bytes that the rolling hash of a trigger covers.
WINDOW = 32
#: Bytes of text that are hashed in one go.
PART_BYTES = 1 << 20
#: Places of a trigger in the corpus beyond which its phrases are split, and of a class of their windows.
HOT = 1 << 13
#: Neighbouring windows of a hot phrase that make a class.
SPLIT = 8
#: Text of triggers, and of phrases, that meet in one group of a task.
TRIGGER_BYTES, PHRASE_BYTES = 1 << 27, 1 << 24
#: A document's places of one trigger that may count as one.
PLACES = 4
#: Bytes of hot phrases that are cut to windows in one go.
CUT_BYTES = 1 << 17

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BASE = 0xE7037ED1A0B428DB
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _CACHE[size][0][:n], _CACHE[size][1][:n]


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` bytes that start at each place; depends on those bytes alone."""
    up, down = _both_powers(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * up, out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[: len(x) - width + 1])


#: Low bits of a packed value that hold a place; the same everywhere, so that all parts order hashes alike.
_PLACE_BITS = 24


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the least of `span` hashes (their upper 40 bits), ties to the first."""
    bits = np.uint64(_PLACE_BITS)
    out = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= span:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < span:
        more = span - done
        out = np.minimum(out[: len(out) - more], out[more:])
    return (out & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def phrases(x: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, trigger hash, trigger's place) of every phrase of the rows that make up x."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(x) - length + 1
    if n <= 0:
        return empty
    width = min(WINDOW, length)
    h = rolling(x, width)
    trigger = _least(h, length - width + 1)
    # windows that cross into the next row are none
    whole = np.ones(n, bool)
    for end in off[1:-1].tolist():
        whole[max(0, end - length + 1) : min(end, n)] = False
    place = np.flatnonzero(whole)
    if not len(place):
        return empty
    t = trigger[place]
    new = np.ones(len(place), bool)
    new[1:] = (t[1:] != t[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return place[at], place[np.append(at[1:], len(place)) - 1], h[t[at]], t[at]


def _parts(off: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last): rows together, or a piece of a long row."""
    for i, j in groups(off, PART_BYTES):
        if j - i == 1 and off[j] - off[i] > 2 * PART_BYTES:
            for a in range(int(off[i]), int(off[j]), PART_BYTES):  # pieces overlap by a window less a byte
                yield i, j, a, min(a + PART_BYTES + length - 1, int(off[j]))
        else:
            yield i, j, int(off[i]), int(off[j])


def _parsed(x: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first window, last window, trigger hash), windows as places in x, part by part."""
    for i, j, a, b in _parts(off, length):
        own = np.clip(off[i : j + 1], a, b) - a
        lo, hi, h, _ = phrases(x[a:b], own, length)
        yield i + np.searchsorted(own, lo, side="right") - 1, lo + a, hi + a, h


def _in_parts(df: DataFrame, parts: int) -> DataFrame:
    """Rows by `part`, over more tasks than usual where there are very many parts."""
    return (df.repartition(parts, "part") if parts > 16 * partitions(df.sparkSession) else df).groupBy("part")


def repeated_triggers(docs: DataFrame, length: int, text_bytes: int = 0) -> DataFrame:
    """(doc_id, h): trigger hashes of the documents that occur more than once in the corpus.

    A document has a hash once, or as often as it occurs there if that is more than `PLACES` times.
    Hashes are counted inside each task first; what is dealt out is a block of (hash, document)
    for every part of the scrambled hashes, so a task sends few large rows. There are as many parts
    as `text_bytes` of text need.
    """
    parts = max(4 * partitions(docs.sparkSession), text_bytes // TRIGGER_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = flat(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            rows, hashes = [], []
            for row, _, _, h in _parsed(x, off, length):
                rows.append(row)
                hashes.append(h)
            if not rows:
                continue
            row, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            twin = same.copy()
            twin[:-1] |= same[1:]
            # a hash once for each document, with the mark that this batch has it twice
            first = np.ones(len(h), bool)
            first[1:] = ~same[1:] | (row[1:] != row[:-1])
            edge = np.append(np.flatnonzero(first), len(h))
            first |= np.repeat(np.diff(edge) > PLACES, np.diff(edge))
            row, h, twin = row[first], h[first], twin[first]
            part = mix64(h) % np.uint64(parts)  # triggers are least hashes, so not even by themselves
            doc = ids[row].astype(np.int64)
            # one entry of a hash speaks for this batch; others are known to be repeats and go anywhere
            spare = np.zeros(len(h), bool)
            spare[1:] = h[1:] == h[:-1]
            part[spare] = mix64(doc[spare].view(np.uint64)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, h, doc, twin = part[order], h[order], doc[order], twin[order]
            edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edge))
            blocks = [[a[edge[p] : edge[p + 1]].tobytes() for p in some] for a in (h, doc, twin)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(c, pa.binary()) for c in blocks]], names=["part", "h", "doc", "twin"])

    def meet(table: pa.Table) -> pa.Table:
        h, doc, twin = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("h", np.uint64), ("doc", np.int64), ("twin", bool)))
        order = np.argsort(h, kind="stable")
        s = h[order]
        several = twin[order]
        same = s[1:] == s[:-1]
        several[1:] |= same
        several[:-1] |= same
        # a mark of one document holds for all that have the hash
        hit = order[several]
        return pa.table({"doc_id": doc[hit], "h": h[hit].view(np.int64)})

    dealt = docs.mapInArrow(send, "part int, h binary, doc binary, twin binary")
    return _in_parts(dealt, parts).applyInArrow(meet, "doc_id long, h long")


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... count numbers for each."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _ranks(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the `length` bytes from each of the first `windows` places of every phrase.

    Phrase k is data[begin[k] : begin[k] + windows[k] + length - 1]. This is a suffix array by prefix
    doubling that stops at `length` bytes: ranks of 8 bytes are numbers, and each step joins two
    ranks to one of twice the bytes, at those places from which that many bytes are left.
    """
    width = min(8, length)
    key = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | data[k : k + len(key)]
    rank = np.zeros(len(data), np.uint64)
    at = _spread(begin, windows + length - width)
    rank[at] = np.unique(key[at], return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        width += step
        at = _spread(begin, windows + length - width)
        rank[at] = np.unique((rank[at] << np.uint64(32)) | rank[at + step], return_inverse=True)[1]
    return rank[_spread(begin, windows)]


#: Bytes of dictionary whose suffixes are ordered together, or one trigger's if it has more.
SORTED_BYTES = 1 << 20


def _resolve(length: int):
    """Repeats among the phrases of some triggers: (doc_id, start, stop) of windows that occurred earlier."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        settled = table.column("stop").to_numpy() >= 0
        ready = table.filter(pa.array(settled))
        out = [tuple(ready.column(c).to_numpy() for c in ("doc_id", "start", "stop"))]
        table = table.filter(pa.array(~settled))
        h, doc, start = (table.column(c).to_numpy() for c in ("h", "doc_id", "start"))
        text = table.column("phrase").to_pylist()
        n = np.fromiter(map(len, text), np.int64, len(text)) - length + 1  # windows
        # the dictionary: equal phrases are one entry, known by its first place in corpus order
        first, again = first_places(text, doc, start)
        out.append((doc[again], start[again], start[again] + n[again]))
        # entries that share a trigger with another one, trigger by trigger
        _, code, count = np.unique(h[first], return_inverse=True, return_counts=True)
        some = first[count[code] > 1]
        some = some[np.argsort(h[some], kind="stable")]
        edge = np.concatenate(([0], np.cumsum(n[some] + length - 1)))
        fresh = np.flatnonzero(np.concatenate((h[some][1:] != h[some][:-1], [True]))) + 1  # where the next trigger's begin
        a = 0
        while a < len(some):
            b = int(np.searchsorted(edge, edge[a] + SORTED_BYTES, side="right")) - 1
            b = int(fresh[np.searchsorted(fresh, max(a + 1, b))]) if max(a + 1, b) < len(some) else len(some)
            part, windows = some[a:b], n[some[a:b]]
            data = np.frombuffer(b"".join([text[r] for r in part.tolist()]), np.uint8)
            rank = _ranks(data, edge[a:b] - edge[a], windows, length)
            of = np.repeat(np.arange(len(part)), windows)
            d, s = doc[part][of], _spread(start[part], windows)
            order = np.lexsort((s, d, rank))  # equal windows in corpus order
            later = np.zeros(len(order), bool)
            later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
            joined = later[1:] & later[:-1] & (of[1:] == of[:-1])  # runs of repeats inside a phrase
            lo, hi = later.copy(), later.copy()
            lo[1:] &= ~joined
            hi[:-1] &= ~joined
            out.append((d[lo], s[lo], s[hi] + 1))
            a = b
        d, s, e = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "stop": pa.array(e, pa.int64())})

    return run


def first_places(text: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold the first place of each distinct phrase in corpus order, the other rows)."""
    seen: set[bytes] = set()
    first, again = [], []
    for r in np.lexsort((start, doc)).tolist():
        if text[r] in seen:
            again.append(r)
        else:
            seen.add(text[r])
            first.append(r)
    return np.array(first, np.int64), np.array(again, np.int64)


_DEALT = "part int, h long, doc_id long, start long, stop long, phrase binary"


def _rows(part, h, doc, start, stop, phrase) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(doc), pa.array(start), pa.array(stop), phrase], names=["part", "h", "doc_id", "start", "stop", "phrase"])


def _sent(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, text: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """Phrases dealt out by hash. Copies inside the batch are settled and sent without text."""
    first, again = first_places(text, doc, start)
    part = mix64(h[first]) % np.uint64(parts)
    yield _rows(part, h[first], doc[first], start[first], np.full(len(first), -1), pa.array([text[r] for r in first.tolist()], pa.binary()))
    if len(again):
        yield _settled(doc[again], start[again], start[again] + n[again], parts)


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows with those of a document that follow one another made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    fresh = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1]))))
    return doc[fresh], start[fresh], np.maximum.reduceat(stop, fresh)


def _settled(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, parts: int) -> pa.RecordBatch:
    """Ranges of windows that are repeats."""
    doc, start, stop = _joined(doc, start, stop)
    return _rows(mix64(doc.view(np.uint64)) % np.uint64(parts), np.zeros(len(doc), np.uint64), doc, start, stop, pa.nulls(len(doc), pa.binary()))


def _classes(column: pa.Array, place: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Classes of windows of phrases whose trigger is at `place`, some phrases at a time.

    Gives (bytes, phrase, where it begins in the bytes, class's first window in the phrase, its last one,
    hash). Windows that start from 0 to SPLIT - 1 bytes before the trigger are class 0, the next ones
    class 1, and so on; the hash is of the class and of the bytes that all windows of a class share, so equal
    windows of a trigger have equal classes and hashes.
    """
    x, off = flat(column)
    split = min(SPLIT, length - min(WINDOW, length) + 1)
    core = length - split + 1
    for i, j in groups(off, CUT_BYTES):
        own = off[i : j + 1] - off[i]
        n, at = np.diff(own) - length + 1, place[i:j]
        low, high = (at - n + 1) // split, at // split
        row = np.repeat(np.arange(j - i), high - low + 1)
        kind = _spread(low, high - low + 1)
        first, last = np.maximum(0, at[row] - split * kind - split + 1), np.minimum(n[row] - 1, at[row] - split * kind)
        part = x[off[i] : off[j]]
        h = mix64(rolling(part, core)[own[row] + at[row] - split * kind] + kind.astype(np.uint64))
        yield part, i + row, own[row], first, last, h


def _split(hot: DataFrame, length: int, parts: int) -> DataFrame:
    """The windows of hot phrases in classes, or one by one where a class is hot, dealt out by hash; none that surely occur once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, h in _classes(b.column(0), b.column(1).to_numpy(), length):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    several = keep(hot.select("phrase", "place").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    bits = membership(several.select(F.col("h").alias("k")), hashed=False)
    # a class that the filter takes for a hot one goes window by window, too, which is as exact
    again = membership(several.filter(F.col("n") > HOT).select(F.col("h").alias("k")), hashed=False)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start = b.column("doc_id").to_numpy(), b.column("start").to_numpy()
            for x, row, base, first, last, h in _classes(b.column("phrase"), b.column("place").to_numpy(), length):
                some = maybe_in(bits.value, *hash_places(h))
                row, base, first, last, h = (c[some] for c in (row, base, first, last, h))
                if not len(row):
                    continue
                single = maybe_in(again.value, *hash_places(h))
                one = np.flatnonzero(~single)
                windows = last[single] - first[single] + 1
                of = np.concatenate((one, np.repeat(np.flatnonzero(single), windows)))
                begin = np.concatenate((first[one], _spread(first[single], windows)))
                n = np.concatenate((last[one] - first[one] + 1, np.ones(int(windows.sum()), np.int64)))
                key = h[of]
                alone = np.arange(len(of)) >= len(one)
                if alone.any():
                    key[alone] = rolling(x, length)[base[of[alone]] + begin[alone]]
                raw = x.tobytes()
                text = [raw[p : p + k] for p, k in zip((base[of] + begin).tolist(), (n + length - 1).tolist(), strict=True)]
                yield from _sent(key, doc[row[of]], start[row[of]] + begin, n, text, parts)

    return hot.select("doc_id", "start", "place", "phrase").mapInArrow(send, _DEALT)


def dealt_phrases(docs: DataFrame, hits: DataFrame, length: int, parts: int | None = None) -> DataFrame:
    """part, h, doc_id, start, stop, phrase: phrases of repeated triggers, or classes of windows of hot ones, dealt out by hash.

    What is known to be a repeat has its `stop` and no phrase; the others have stop -1.
    """
    parts = parts or _phrase_parts(hits, length)
    # a filter of fixed size says for both ways what is hot; a trigger that it takes for hot in error goes by classes of windows, which is as exact
    many = keep(hits.select(F.explode("hits").alias("h")).groupBy("h").count().filter(F.col("count") > HOT).select("h"))
    some_hot = not many.isEmpty()
    filtered = membership(many, hashed=False)
    hot = lambda h: maybe_in(filtered.value, *hash_places(h))

    def parsed(b: pa.RecordBatch, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]] | None:
        """(trigger hash, doc_id, start, windows, trigger's place in the phrase, phrase) of wanted(hashes, first row, row after the last)."""
        x, off = flat(b.column(1))
        ids = b.column(0).to_numpy()
        found = []
        text: list[bytes] = []
        for i, j, a, z in _parts(off, length):
            own = np.clip(off[i : j + 1], a, z) - a
            lo, hi, h, t = phrases(x[a:z], own, length)
            mine = wanted(h, i, j)
            lo, hi, h, t = lo[mine], hi[mine], h[mine], t[mine]
            row = i + np.searchsorted(own, lo, side="right") - 1
            raw = x[a:z].tobytes()
            text += [raw[p : q + length] for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
            found.append((h, ids[row], lo + a - off[row], hi - lo + 1, t - lo))
        return (*(np.concatenate(c) for c in zip(*found, strict=True)), text) if text else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of repeated triggers that are not hot."""
        for b in batches:
            known = b.column(2)
            value, at = known.flatten().to_numpy().view(np.uint64), known.offsets.to_numpy() - known.offsets[0].as_py()
            if found := parsed(b, lambda h, i, j, value=value, at=at: np.isin(h, value[at[i] : at[j]]) & ~hot(h)):
                h, doc, start, n, _, text = found
                yield from _sent(h, doc, start, n, text, parts)

    def send_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of hot triggers; copies inside a batch are settled."""
        for b in batches:
            if found := parsed(b, lambda h, i, j: hot(h)):
                _, doc, start, n, place, text = found
                first, again = first_places(text, doc, start)
                names = ["doc_id", "start", "stop", "place", "phrase"]
                yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(np.full(len(first), -1)), pa.array(place[first]), pa.array([text[r] for r in first.tolist()], pa.binary())], names=names)
                if len(again):
                    d, s, e = _joined(doc[again], start[again], (start + n)[again])
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e), pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.binary())], names=names)

    dealt = docs.join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(send, _DEALT)
    if not some_hot:
        return dealt
    apart = keep(docs.select("doc_id", "text").mapInArrow(send_hot, "doc_id long, start long, stop long, place long, phrase binary"))
    known = apart.filter("stop >= 0").select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).cast("long").alias("h"), "doc_id", "start", "stop", "phrase")
    return dealt.union(known).union(_split(apart.filter("stop < 0"), length, parts))


def _phrase_parts(hits: DataFrame, length: int) -> int:
    """As many parts as the phrases of so many repeated triggers need."""
    n = hits.agg(F.sum(F.size("hits"))).first()[0] or 0
    return max(8 * partitions(hits.sparkSession), n * 2 * length // PHRASE_BYTES)


def repeated_windows(docs: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """doc_id, start, stop: ranges [start, stop) of windows of `length` bytes that occurred earlier in the corpus.

    `docs` has doc_id and text, `hits` doc_id and the array of its repeated trigger hashes. Corpus
    order is by doc_id, then by place.
    """
    parts = _phrase_parts(hits, length)
    return _in_parts(dealt_phrases(docs, hits, length, parts), parts).applyInArrow(_resolve(length), "doc_id long, start long, stop long")


def remove_repeats(docs: DataFrame, length: int = 100, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each whole text: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, `kept`.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Strings are those of the input, in UTF-8, whatever is
    removed elsewhere. Null is empty; a text under `length` bytes is kept whole; `kept` is
    binary, as a cut may fall inside a character. Rows that repeat an id are documents of their own, in
    the order of their texts' hashes; null ids come last; ids may be any longs. Empty tables give no
    rows; other columns are not read.
    """
    x = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "own")
    keyed = x.select(F.col("own").alias("doc_id"), "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = keep(repeated_triggers(keyed, length, size).groupBy("doc_id").agg(F.array_agg("h").alias("hits")))
    ranges = repeated_windows(keyed, hits, length).groupBy("doc_id").agg(F.array_sort(F.array_agg(F.struct("start", "stop"))).alias("ranges"))
    kind = "own long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = flat(b.column(1))
            ranges_ = b.column(2).to_pylist()
            rows = []
            for k, spans in enumerate(ranges_):
                raw = x[off[k] : off[k + 1]].tobytes()
                gone: list[list[int]] = []
                for r in spans or ():
                    s, e = r["start"], r["stop"] - 1 + length
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
                kept, last = [], 0
                for s, e in gone:
                    kept.append(raw[last:s])
                    last = e
                left = b"".join([*kept, raw[last:]])
                rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if texts else None))
            columns = list(zip(*rows, strict=True))
            arrays = [b.column(0), b.column(3), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())] + [pa.array(columns[4], pa.binary())] * texts
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in kind.split(", ")])

    none = F.lit(None).cast("array<struct<start:long,stop:long>>")
    # texts move only for documents with repeats; what is known of the others is as small as a digest
    whole = x.select("own", "text", none.alias("ranges"), "doc_id").mapInArrow(shorten, kind)
    changed = keyed.join(hits, "doc_id").select("doc_id", "text").join(ranges, "doc_id").select("doc_id", "text", "ranges", F.lit(None).cast("long").alias("_")).mapInArrow(shorten, kind)
    columns = [c.split()[0] for c in kind.split(", ")][2:]
    both = whole.join(changed.select(F.col("own").alias("_own"), *[F.col(c).alias(f"_{c}") for c in columns]), F.col("own") == F.col("_own"), "left")
    return both.select("doc_id", *[F.when(F.col("_own").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
