"""Language identification by hierarchical discrimination: the family first, then its languages.

Texts are hashed byte trigrams. One-versus-one linear support vector machines separate the families,
and within each family its languages; votes of the machines decide. They are trained in Spark tasks,
one per pair, on a bounded sample of labelled rows, and all whole texts are then scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewell.llm.common import LOWER, flat, groups, keep

#: Trigram features, and the most labelled rows of a language that train the machines.
FEATURES, ROWS_PER_LANGUAGE = 8192, 400
#: The most languages that are learned.
MOST_LANGUAGES = 128
#: Families of common language codes; another code is a family of its own. They keep the machines to hundreds, as pairs
#: are made of families and inside each, not of all languages. Fixed values.
FAMILIES = {
    "austronesian": ("fil", "id", "jv", "mg", "mi", "ms", "su", "tl"),
    "baltic": ("lt", "lv"),
    "bantu": ("rw", "sn", "st", "sw", "xh", "zu"),
    "celtic": ("br", "cy", "ga", "gd"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sd", "si", "ur"),
    "iranian": ("ckb", "fa", "ku", "ps", "tg"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "semitic": ("am", "ar", "he", "mt", "ti"),
    "sinitic": ("yue", "zh"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "tai": ("lo", "th"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(language: str) -> str:
    return _FAMILY.get(language, f"only {language}")


def _features(x: np.ndarray) -> np.ndarray:
    """The feature of the trigram that starts at each byte but the last two."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    k = (x[:-2].astype(np.uint32) << 16) | (x[1:-1].astype(np.uint32) << 8) | x[2:]
    return ((k * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def _counts(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of feature counts for each text."""
    k = _features(x)
    out = np.zeros((len(off) - 1, FEATURES), np.float32)
    for row, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if j - i >= 3:
            out[row] = np.bincount(k[i : j - 2], minlength=FEATURES)
    return out


def _unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length 1, so that long texts don't outweigh short ones."""
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, off = flat(column)
    return np.frombuffer(x.tobytes().translate(LOWER), np.uint8), off


def training_sample(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> DataFrame:
    """At most `per_language` labelled texts of each language, chosen by the hash of their ids, as sparse features.

    An id is one text of a language: of several rows that share one, the text that comes first. Where there are more than `most` codes, the
    commonest are learned (ties to the code that comes first), as pairs of languages grow with the square of their number.
    """
    hashed = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_h", F.xxhash64("doc_id", F.lit("sample")))
    # ids are counted, not rows: an id that most rows of a language have is one; the count need only be near, as four times as many get through
    counts = hashed.groupBy("lang").agg(F.count("*").alias("_rows"), F.approx_count_distinct("doc_id", 0.02).alias("_n")).orderBy(F.desc("_rows"), "lang").limit(most)
    some = hashed.select("lang", "doc_id", "_h").join(F.broadcast(counts), "lang").filter(F.pmod("_h", F.lit(1 << 20)) * F.col("_n") < F.lit(4 * per_language * (1 << 20))).distinct()
    chosen = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).filter(F.col("_k") <= per_language).select("lang", "_h", "doc_id")
    rows = hashed.join(F.broadcast(chosen), ["lang", "_h", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # at most per_language rows for each of `most` languages

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = _lowered(b.column(1))
            for i, j in groups(off, 1 << 20):
                at = off[i : j + 1]
                for lo in range(0, j - i, 256):
                    part = at[lo : lo + 257]
                    rows = _unit(_counts(x[part[0] : part[-1]], part - part[0]))
                    index = [np.flatnonzero(r) for r in rows]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i + lo, len(rows)), pa.array(index, pa.list_(pa.int64())), pa.array([r[k] for r, k in zip(rows, index, strict=True)], pa.list_(pa.float32()))], names=["lang", "index", "value"])

    return rows.select("lang", "text").mapInArrow(sparse, "lang string, index array<long>, value array<float>")


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """A linear support vector machine by dual coordinate descent; the last weight is the bias."""
    a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
    pdf = pdf.sort_values("order")
    y = np.where(pdf["name"] == a, 1.0, -1.0)
    rows = [(np.append(i, FEATURES), np.append(v, 1.0).astype(np.float64)) for i, v in zip(pdf["index"], pdf["value"], strict=True)]
    share = {s: (y == s).mean() for s in (1.0, -1.0)}
    top = np.array([10.0 * 0.5 / share[s] for s in y])  # classes weigh the same
    w, alpha, square = np.zeros(FEATURES + 1), np.zeros(len(y)), [float((v * v).sum()) for _, v in rows]
    order = np.random.default_rng(7)
    for _ in range(200):
        change = 0.0
        for k in order.permutation(len(y)):
            i, v = rows[k]
            old = alpha[k]
            alpha[k] = min(max(old + (1 - y[k] * (w[i] @ v)) / square[k], 0.0), top[k])
            if alpha[k] != old:
                w[i] += (alpha[k] - old) * y[k] * v
                change = max(change, abs(alpha[k] - old))
        if change < 1e-3:
            break
    return pd.DataFrame({"a": [a], "b": [b], "w": [w.astype(np.float32)]})


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """Trains on rows that have doc_id, text and lang; returns the languages by family and the machines.

    A task trains one pair on at most 2 x per_language rows times the languages of a family. What
    comes to the driver is a weight vector of single precision for each pair, whatever the number of documents:
    the 95 languages of the families above make 457 pairs, 15 MB. Codes without a family are one each, so MOST_LANGUAGES
    of these make 8128 pairs at worst, 270 MB; rarer codes than the MOST_LANGUAGES commonest are not learned.
    """
    sample = keep(training_sample(docs, per_language))
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for code in languages:
        families.setdefault(family_of(code), []).append(code)
    jobs = [(a, b, "family") for a, b in combinations(sorted(families), 2)] + [(a, b, "language") for codes in families.values() for a, b in combinations(codes, 2)]
    machines = []
    if jobs:
        spark = docs.sparkSession
        names = [(c, family_of(c), "family") for c in languages] + [(c, c, "language") for c in languages]
        pairs = spark.createDataFrame([(a, b, kind, name) for a, b, kind in jobs for name in (a, b)], "a string, b string, kind string, name string")
        named = spark.createDataFrame(names, "lang string, name string, kind string")
        rows = sample.withColumn("order", F.xxhash64("index", "value")).join(F.broadcast(named), "lang").join(F.broadcast(pairs), ["kind", "name"])
        machines = [(r["a"], r["b"], np.array(r["w"], np.float32)) for r in rows.groupBy("kind", "a", "b").applyInPandas(_train, "a string, b string, w array<float>").collect()]
    return {"families": families, "machines": machines}


def _decide(names: list[str], machines: list, margins: dict, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The name with most votes of its pairs, ties to the larger sum of margins; and the least margin of its wins."""
    votes, sums, least = np.zeros((rows, len(names))), np.zeros((rows, len(names))), np.full((rows, len(names)), np.inf)
    for a, b in machines:
        m, i, j = margins[a, b], names.index(a), names.index(b)
        for k, s in ((i, m), (j, -m)):
            votes[:, k] += s > 0
            sums[:, k] += s
            least[:, k] = np.minimum(least[:, k], s)
    best = (votes + 0.5 * np.tanh(sums / max(1, len(names)))).argmax(axis=1)
    return best, least[np.arange(rows), best]


class Predictor:
    """Scores batches of texts with a trained model; made once for a task."""

    def __init__(self, model: dict):
        self.families = model["families"]
        self.keys = [(a, b) for a, b, _ in model["machines"]]
        weights = np.array([w for _, _, w in model["machines"]]).reshape(len(self.keys), FEATURES + 1)
        self.linear, self.bias = weights[:, :-1].T.astype(np.float32), weights[:, -1].astype(np.float64)
        self.names = sorted(self.families)

    def __call__(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        x, off = _lowered(column)
        langs, scores = [], [np.zeros(0)]
        for i, j in groups(off):
            for lo in range(i, j, 256):
                hi = min(lo + 256, j)
                lang, score = self._some(x[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                langs += lang
                scores.append(score)
        return langs, np.concatenate(scores)

    def _some(self, x: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(at) - 1
        plain = np.concatenate(([0], np.cumsum((x >= 97) & (x <= 122))))
        letters = plain[at[1:]] > plain[at[:-1]]
        for k in np.flatnonzero(~letters & (at[1:] > at[:-1])).tolist():
            letters[k] = any(c.isalpha() for c in x[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
        value = _unit(_counts(x, at)) @ self.linear + self.bias if self.keys else np.zeros((rows, 0))
        margins = {k: value[:, n] for n, k in enumerate(self.keys)}
        lang, least = np.full(rows, "und", object), np.zeros(rows)
        if self.names:
            top, m = _decide(self.names, [k for k in self.keys if k[0] in self.families], margins, rows)
            for f, family in enumerate(self.names):
                codes = self.families[family]
                best, own = _decide(codes, [k for k in self.keys if k[0] in codes], margins, rows)
                mine = letters & (top == f)
                lang[mine] = np.array(codes, object)[best[mine]]
                least[mine] = np.minimum(m, own)[mine]
        known = letters & bool(self.names)
        return lang.tolist(), np.where(known, 1 / (1 + np.exp(-np.clip(2 * least, -50, 50))), 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; only its text is looked at.

    `und` with score 0 where the text is null or has no letter, or where no language was learned;
    otherwise a learned language and a score from the least margin of its wins, 0 to 1 (1 if only one
    language was learned). Empty tables give no rows; repeated rows repeated results; a text under
    three bytes has no trigram and is decided by the machines' biases.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for b in batches:
            lang, value = predictor(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(value)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The rows, with all their columns, whose text gets a language other than `und`; columns go by their places, so names may be any."""
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for b in batches:
            lang, _ = predictor(b.column(at))
            yield b.filter(pa.array([code != "und" for code in lang], pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(choose, plain.schema).toDF(*docs.columns)


def held_out(doc_id):
    """Rows that never train: crc32 of the id's text leaves 2 when divided by 4. A null id trains nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score.

    Labelled rows that share an id are one text of each of their languages; rows that are repeated are predicted each. Null
    ids are held out. Other columns are not read; an empty table gives no rows.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(x.filter(~held_out(F.col("doc_id"))), per_language)
    return predict(x, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
