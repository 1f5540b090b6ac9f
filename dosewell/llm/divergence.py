"""How far sources of a language differ in their terms: iceberg prefix refinement, then exact integer divergences.

Terms are not counted as a whole at first. Of each language, documents are counted by the terms' first bytes; prefixes in too
few documents are discarded, and those that are left are extended, twice as long at each level, until every
one of them is a complete term. A prefix is in at least as many documents as any term that begins with it, so nothing is lost. Rare terms,
most of a large corpus' vocabulary, are met by short prefixes that they share and never travel whole.

Blocks of documents are kept in dictionary form: distinct terms of the block in order of bytes, and for each document
the numbers of its terms. Terms with a common prefix are neighbours there, so a level counts without looking at texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosewell.llm.common import LOWER, cut, flat, groups, hash_places, keep, maybe_in, membership, mix64

#: Bytes of text in a block.
BLOCK_BYTES = 1 << 20
#: Bytes of the first level's prefixes.
FIRST_BYTES = 4

BLOCK = "langs array<string>, doc_lang binary, doc_group binary, group_lang binary, group_source binary, terms binary, doc_terms binary, pair_term binary, pair_count binary"
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.frombuffer(LOWER, np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _tokens(x: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts in bytes, lower-cased, and the row of each."""
    letter = _LETTER[x]
    before = np.concatenate(([False], letter[:-1])) if len(x) else letter
    inner = off[1:-1]
    before[inner[inner < len(x)]] = False  # a text's first byte continues nothing
    starts = np.flatnonzero(letter & ~before)
    data = _LOWER[x[letter]]
    kept = np.cumsum(letter, dtype=np.int32)
    ends = np.append(kept[starts] - 1, np.int32(len(data)))
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return terms, np.searchsorted(off, starts, side="right") - 1


def _narrow(v: np.ndarray) -> bytes:
    """Numbers that are not negative, in 1, 2 or 4 bytes each as the largest one needs."""
    return v.astype(next(t for t in ("<u1", "<u2", "<u4") if v.max(initial=0) <= np.iinfo(t).max)).tobytes()


def _widened(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // n}" if n else "<u1").astype(np.int64)


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (text, lang, source_id) in dictionary form, about BLOCK_BYTES of text in a row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = flat(b.column("text"))
            for i, j in groups(off, BLOCK_BYTES):
                part = off[i : j + 1]
                terms, doc = _tokens(x[part[0] : part[-1]], part - part[0])
                e = terms.dictionary_encode()
                order = pc.sort_indices(e.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                pairs, n = np.unique(doc * max(1, len(order)) + place[e.indices.to_numpy(zero_copy_only=False)], return_counts=True)
                names = b.column("lang").slice(i, j - i).dictionary_encode()
                lang, ids = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), b.column("source_id").slice(i, j - i).to_numpy()
                ids, source = np.unique(ids, return_inverse=True)
                group, at = np.unique(lang * len(ids) + source, return_inverse=True)
                words = e.dictionary.take(pa.array(order)).to_pylist()
                numbers = [lang, at, group // len(ids)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names.dictionary.to_pylist()], pa.list_(pa.string()))]
                    + [pa.array([v.astype("<u4").tobytes()], pa.binary()) for v in numbers]
                    + [pa.array([v], pa.binary()) for v in (ids[group % len(ids)].astype("<i8").tobytes(), b"".join(w + b"\0" for w in words))]
                    + [pa.array([_narrow(v)], pa.binary()) for v in (np.bincount(pairs // max(1, len(order)), minlength=j - i), pairs % max(1, len(order)), n)],
                    names=["langs", "doc_lang", "doc_group", "group_lang", "group_source", "terms", "doc_terms", "pair_term", "pair_count"],
                )

    return docs.select("text", "lang", "source_id").mapInArrow(encode, BLOCK)


class Block:
    """One row of `blocks`: arrays, and for every term its bytes with an end mark and what it shares with the term before."""

    def __init__(self, b: pa.RecordBatch, row: int) -> None:
        numbers = lambda name: np.frombuffer(b.column(name)[row].as_py(), "<u4").astype(np.int64)
        self.langs, self.group_source = b.column("langs")[row].as_py(), np.frombuffer(b.column("group_source")[row].as_py(), "<i8")
        self.doc_lang, self.doc_group, self.group_lang = numbers("doc_lang"), numbers("doc_group"), numbers("group_lang")
        terms = _widened(b.column("doc_terms")[row].as_py(), len(self.doc_lang))
        self.doc = np.repeat(np.arange(len(terms)), terms)
        self.term, self.count = (_widened(b.column(c)[row].as_py(), len(self.doc)) for c in ("pair_term", "pair_count"))
        self.x = np.frombuffer(b.column("terms")[row].as_py(), np.uint8)
        ends = np.flatnonzero(self.x == 0) + 1
        self.off = np.concatenate(([0], ends))
        self.length = np.diff(self.off)
        self.lang_hash = lang_hashes(self.langs)

    def firsts(self, width: int) -> np.ndarray:
        """The number of each term's prefix of `width` bytes; equal prefixes are neighbours."""
        new = np.ones(len(self.length), bool)
        if len(new):
            same = np.minimum(self.length[1:], self.length[:-1]) >= width  # shorter ones have end marks, so they differ within
            for k in range(width):
                if not same.any():
                    break
                at = np.flatnonzero(same)
                same[at] = self.x[self.off[1:-1][at] + k] == self.x[self.off[:-2][at] + k]
            new[1:] = ~same
        return np.cumsum(new) - 1

    def prefixes(self, terms: np.ndarray, width: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the given terms' prefixes of `width` bytes, end marks included; whole terms without a width."""
        n = self.length[terms] if width is None else np.minimum(self.length[terms], width)
        off = np.concatenate(([0], np.cumsum(n)))
        return self.x[np.arange(off[-1]) + np.repeat(self.off[terms] - off[:-1], n)], off

    def hashes(self, terms: np.ndarray, width: int | None) -> np.ndarray:
        """64-bit hashes of prefixes, without their language."""
        out = np.zeros(len(terms), np.uint64)
        for i in range(0, len(terms), 1 << 14):
            out[i : i + (1 << 14)] = byte_hashes(*self.prefixes(terms[i : i + (1 << 14)], width))
        return out

    def allowed(self, few: np.ndarray, place: np.ndarray, head: np.ndarray, width: int | None) -> np.ndarray:
        """Whether each pair's (language, prefix) may be in a filter; `place` numbers the prefixes of terms, of which `head` are the first ones."""
        keys = self.doc_lang[self.doc] * max(1, len(head)) + place[self.term]
        there = np.zeros(len(self.langs) * len(head), bool)
        there[keys] = True
        found = np.flatnonzero(there)
        lang, prefix = found // max(1, len(head)), found % max(1, len(head))
        there[found] = maybe_in(few, *hash_places(mix64(self.hashes(head, width)[prefix] ^ self.lang_hash[lang])))
        return there[keys]


def byte_hashes(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A polynomial of each row's bytes; no row is empty."""
    if len(off) == 1:
        return np.zeros(0, np.uint64)
    at = np.arange(len(x)) - np.repeat(off[:-1], np.diff(off))
    power = np.full(int(np.diff(off).max()), _STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return np.add.reduceat((x.astype(np.uint64) + np.uint64(1)) * power[at], off[:-1])


def lang_hashes(langs: list[str]) -> np.ndarray:
    return mix64(np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in langs], np.uint64))


def prefix_filter(prefixes: DataFrame) -> Broadcast:
    """A membership filter of (lang, prefix) rows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).dictionary_encode()
            h = byte_hashes(*flat(b.column(1))) ^ lang_hashes(names.dictionary.to_pylist())[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(mix64(h).view(np.int64))], names=["h"])

    return membership(prefixes.select("lang", "prefix").mapInArrow(hashed, "h long"), hashed=False)


def _merged(parts: Iterator[pa.RecordBatch], limit: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, prefix) summed within a task, up to `limit` rows at a time."""
    held, rows = [], 0
    for last in (False, True):
        for p in parts if not last else (None,):
            if p is not None:
                held.append(p)
                rows += p.num_rows
            if held and (last or rows > limit):
                t = pa.Table.from_batches(held).group_by(["lang", "prefix"]).aggregate([("n", "sum")]).select(["lang", "prefix", "n_sum"]).rename_columns(["lang", "prefix", "n"])
                held, rows = t.combine_chunks().to_batches(), t.num_rows
                if last or rows > limit // 2:
                    yield from held
                    held, rows = [], 0


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for row in range(b.num_rows):
            yield Block(b, row)


def _counted(keys: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `space` and how often each is there."""
    if space > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=space)
    found = np.flatnonzero(n)
    return found, n[found]


def _strings(x: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def frequent_terms(coded: DataFrame, least: int = 10) -> DataFrame:
    """(lang, term, prefix with its end mark) of the terms in at least `least` documents of a language, by prefix refinement of `blocks`.

    At each level every document counts a prefix once; counts of a block are combined in its task, those of a task before the shuffle. Between levels
    tasks get a filter of fixed size with the surviving prefixes: what it lets through in error is counted exactly
    at the next level and discarded there, so it costs rows but no result depends on it.
    """
    complete, before, width, alive = [], 0, FIRST_BYTES, None
    while True:

        def count(batches: Iterator[pa.RecordBatch], before=before, width=width, alive=alive) -> Iterator[pa.RecordBatch]:
            for k in _each(batches):
                doc, term = k.doc, k.term
                if before:
                    old = k.firsts(before)
                    go = k.allowed(alive.value, old, np.flatnonzero(np.diff(old, prepend=-1)), before) & (k.length > before)[term]
                    doc, term = doc[go], term[go]
                now = k.firsts(width)
                p = now[term]
                new = np.ones(len(p), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (p[1:] != p[:-1])  # once a document
                head = np.flatnonzero(np.diff(now, prepend=-1))
                found, n = _counted(k.doc_lang[doc[new]] * max(1, len(head)) + p[new], len(k.langs) * len(head))
                lang, first = found // max(1, len(head)), head[found % max(1, len(head))] if len(head) else found
                yield pa.RecordBatch.from_arrays([pa.array(k.langs, pa.string()).take(pa.array(lang)), _strings(*k.prefixes(first, width)), pa.array(n)], names=["lang", "prefix", "n"])

        counts = coded.mapInArrow(lambda batches, count=count: _merged(count(batches)), "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
        survivors = keep(counts.filter(F.col("n") >= least).select("lang", "prefix"))
        ended = F.substring("prefix", -1, 1) == F.lit(b"\0")
        complete.append(survivors.filter(ended))
        if survivors.filter(~ended).isEmpty():
            whole = reduce(DataFrame.unionByName, complete)
            return whole.select("lang", F.expr("cast(substring(prefix, 1, length(prefix) - 1) as string)").alias("term"), "prefix")
        alive = prefix_filter(survivors.filter(~ended))
        before, width = width, 2 * width


#: Entries (language, term, source) that a task adds up before it gives them away.
HELD = 1 << 18


class _Held:
    """Counts of some blocks, to be added up by language, term and source."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.terms, self.lang, self.size, self.source, self.count = [], [], [], [], []
        self.entries = 0

    def add(self, k: Block, go: np.ndarray) -> None:
        """The block's pairs for which `go` holds."""
        terms, groups_ = max(1, len(k.length)), max(1, len(k.group_lang))
        group = k.doc_group[k.doc[go]]
        # by language and term, then by group
        found, at = np.unique((k.group_lang[group] * terms + k.term[go]) * groups_ + group, return_inverse=True)
        row = found // groups_
        head = np.flatnonzero(np.diff(row, prepend=-1))
        self.terms.append(_strings(*k.prefixes(row[head] % terms, None)))
        self.lang.append(np.array([self.langs.setdefault(name, len(self.langs)) for name in k.langs], np.int64)[row[head] // terms])
        self.size.append(np.diff(np.append(head, len(found))))
        self.source.append(k.group_source[found % groups_])
        self.count.append(np.bincount(at, weights=k.count[go], minlength=len(found)).astype(np.int64))
        self.entries += len(found)

    def rows(self, kind: type) -> pa.RecordBatch:
        """One row for a language's term, with its sources and their counts side by side."""
        coded = pa.chunked_array(self.terms, pa.binary()).combine_chunks().dictionary_encode()
        ids, source = np.unique(np.concatenate(self.source), return_inverse=True)
        terms, sources = max(1, len(coded.dictionary)), max(1, len(ids))
        row = np.concatenate(self.lang) * terms + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found, at = np.unique(np.repeat(row, np.concatenate(self.size)) * sources + source, return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(self.count), minlength=len(found)).astype(np.int64)
        row = found // sources
        head = np.flatnonzero(np.diff(row, prepend=-1))
        starts = pa.array(np.append(head, len(found)).astype(np.int32))
        words = pc.binary_slice(coded.dictionary.take(pa.array(row[head] % terms)), 0, -1).cast(pa.string())  # without the end mark
        lists = [pa.ListArray.from_arrays(starts, pa.array(v)) for v in (ids[found % sources].astype(kind), count.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(list(self.langs), pa.string()).take(pa.array(row[head] // terms)), words, *lists], names=["lang", "term", "s", "c"])


def term_counts(coded: DataFrame, kept: DataFrame, small_ids: bool = False) -> DataFrame:
    """(lang, term, source_id, c > 0): occurrences of kept terms in each group.

    A task adds up its blocks, and gives one row for a language's term with the sources that have it side by side, so that few rows move.
    `small_ids` says that the sources' ids fit an int.
    """
    few = prefix_filter(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for k in _each(batches):
            terms = len(k.length)
            held.add(k, k.allowed(few.value, np.arange(terms), np.arange(terms), None))
            if held.entries > HELD:
                yield held.rows(np.int32 if small_ids else np.int64)
                held = _Held()
        if held.entries:
            yield held.rows(np.int32 if small_ids else np.int64)

    found = coded.mapInArrow(count, f"lang string, term string, s array<{'int' if small_ids else 'long'}>, c array<int>").repartition("lang", "term")
    each = found.select("lang", "term", F.explode(F.arrays_zip("s", "c")).alias("x")).groupBy("lang", "term", F.col("x.s").cast("long").alias("source_id")).agg(F.sum("x.c").alias("c"))
    return each.join(kept.select("lang", "term"), ["lang", "term"])


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)); counts too large for that in longs are divided as decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    bottom = total + 2 * terms
    large = F.call_function("div", F.lit(1000000000).cast("decimal(10,0)") * (wide(count) + 2), wide(bottom))
    return 1 + F.when(bottom == 0, F.lit(None).cast("long")).when(count < 9_000_000_000, F.call_function("div", 1000000000 * (count + 2), bottom)).otherwise(large)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Divergences of every (lang, source) group: lang, source, part, item, value, rank.

    Part `pair` has every other source of the language and the sum of f over all kept terms, part `term` the `top`
    kept terms that a group has more often than its language. Null texts, languages and sources are ''. Every row is a document, repeated
    ones too; ids are not read, nor are other columns. Texts are read whole. Groups without terms, and languages
    without kept terms (all pair values 0), are there, too; an empty table gives no rows. Ties go to the item first in UTF-8.

    Terms that neither or one of two sources has are not met pair by pair: with p0 the share of a count of 0, f's sum is
    V f(p0, p0) + the excess of each source's own terms against the other's p0, a sum over its distinct counts,
    + a correction for terms that both have. So work follows the counts there are, not pairs x terms.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(word(text_col).alias("text"), word(lang_col).alias("lang"), word(source_col).alias("source"))
    present = keep(rows.select("lang", "source").distinct())
    # sources have ids within the job, of as few bits as tell them apart
    for bits, seed in ((b, n) for n in range(64) for b in (16, 31, 63)):
        source_id = F.xxhash64("source", F.lit(seed)).bitwiseAND((1 << bits) - 1)
        if present.agg(F.count_distinct("source") == F.count_distinct(source_id)).first()[0]:
            break
    else:
        raise ValueError("sources can't be told apart by hashes")
    coded = cut(blocks(rows.withColumn("source_id", source_id)))
    kept = keep(frequent_terms(coded, least))
    counts = cut(term_counts(coded, kept, bits < 32))
    sizes = counts.groupBy("lang", "source_id").agg(F.sum("c").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    group = present.withColumn("source_id", source_id).join(sizes, ["lang", "source_id"], "left").join(terms, "lang", "left")
    group = cut(group.select("lang", "source", "source_id", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v")).withColumn("p0", _p(zero, F.col("total"), F.col("v"))))
    whole = group.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = counts.join(group, ["lang", "source_id"]).withColumn("p", _p(F.col("c"), F.col("total"), F.col("v")))
    shares = cut(shares.select("lang", "source", "term", "c", "v", "p0", "p"))

    # terms that a group has more often than its language
    in_lang = shares.withColumn("lang_c", F.sum("c").over(Window.partitionBy("lang", "term"))).join(whole, "lang").withColumn("q", _p(F.col("lang_c"), F.col("lang_total"), F.col("v")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    more = in_lang.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    top_terms = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(*columns)

    # pairs of sources: what both have, what one has, what neither has
    a = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    pa_, pb, a0, b0 = (F.col(c) for c in ("pa", "pb", "a0", "b0"))
    both = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(_f(pa_, pb) - _f(pa_, b0) - _f(a0, pb) + _f(a0, b0)).alias("both"))
    mirrored = both.union(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    other = group.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    distinct = shares.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0")).agg(F.count("*").alias("n"))
    excess = distinct.join(other, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (_f(pa_, b0) - _f(a0, b0))).alias("excess"))
    pairs = group.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v").join(other, "lang").filter("a <> b")
    back = excess.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("excess").alias("back"))
    summed = pairs.join(mirrored, ["lang", "a", "b"], "left").join(excess, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("v") * _f(a0, b0), zero) + F.coalesce("both", zero) + F.coalesce("excess", zero) + F.coalesce("back", zero)
    against = summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return top_terms.unionByName(against.withColumn("rank", F.row_number().over(best)).select(*columns))


ORACLE = r"""
with docs as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct r) >= 10),
vocabulary as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by lang, source, term),
grouped as (select distinct lang, source from docs),
dense as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, v.v
  from grouped g join kept k on g.lang = k.lang join vocabulary v on v.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
shares as (select lang, source, term, c, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang, source) + 2 * v) as p from dense),
lang_dense as (select lang, term, sum(c) as c, any_value(v) as v from dense group by lang, term),
lang_shares as (select lang, term, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang) + 2 * v) as q from lang_dense),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
all_pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from grouped a join grouped b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (
  select s.lang, s.source, 'term' as part, s.term as item, ((s.p - l.q) * (s.p - l.q)) // (s.p + l.q) as value
  from shares s join lang_shares l on s.lang = l.lang and s.term = l.term where s.c > 0 and s.p > l.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from all_pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10
"""
