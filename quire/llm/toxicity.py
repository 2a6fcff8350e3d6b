"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted, release_memory, staged

#: Pronouns of address in the four languages.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner deinen ihr euch euer tú ti tuyo usted ustedes vosotros vuestro".split())
#: Characters that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
PREFIXES = (4, 5, 6, 7)
NEAR = 6  # words between a lexicon word and a pronoun of address that counts as close
_MEMO = 150_000  # tokens that are remembered
_MEMORY = 8 << 20  # and their characters, at most; tokens of texts without spaces are long
_CHUNK = 1 << 20  # characters of text that are looked at at once
_SPACE = re.compile(r"\s")
_EDGES = ".,;:!?\"'()[]{}%&$*#-"
FEATURES = (
    "log_words", "hit_density", "log_hits", "hit_weight", "most_weight", "stem_density", "log_stems", "stem_weight", "most_stem",
    "close_hits", "close_density", "address_density", "capitals", "shouted", "punctuation", "exclaimed", "symbols", "obfuscated", "uncovered",
)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def terms_of(text: Column) -> Column:
    """The distinct terms a lexicon may hold: words, and stems (a ^ and the first letters of longer words)."""
    words = F.array_distinct(words_of(text))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in PREFIXES]
    return F.array_distinct(F.concat(words, *stems))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


class Features:
    """Dense features of texts under a lexicon. A distinct token is looked at once, while the memory of _MEMO tokens, or _MEMORY characters of them, lasts."""

    WORD, STEM, ADDRESS, LETTERS, UPPER, SHOUT, PUNCT, EXCLAIM, SYMBOL, OBSCURE, UNCOVERED, HIT, STEM_HIT, CHARS = range(14)

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.index: dict[str, int] = {}
        self.size = 0  # characters of the tokens
        self.rows = np.zeros((1024, 14), np.float32)

    def _look(self, token: str) -> list[float]:
        lexicon, core = self.lexicon, token.strip(_EDGES)
        plain = core.isalpha()  # most tokens: letters, with punctuation around them at most
        low = core.lower() if plain else token.lower()
        parts = [low] if plain else "".join(c if c.isalpha() else " " for c in low).split()
        word = max((lexicon.get(p, 0.0) for p in parts), default=0.0)
        stem = max((lexicon.get("^" + p[:n], 0.0) for p in parts for n in PREFIXES if len(p) > n), default=0.0)
        letters = len(core) if plain else sum(c.isalpha() for c in token)
        upper = 0 if core.islower() and plain else sum(c.isupper() for c in token if c.isalpha())
        obscure = not plain and letters > 0 and any(not c.isalpha() and c not in "'’-" for c in core)
        joined = "".join(c for c in core.lower().translate(LOOKALIKE) if c.isalpha()) if obscure else ""
        uncovered = lexicon.get(joined, 0.0) if obscure and not word else 0.0
        edges = len(token) - len(core)
        marks = edges if plain else sum(not c.isalnum() for c in token)
        return [
            word, stem, any(p in SECOND_PERSON for p in parts), letters, upper, letters > 2 and upper == letters,
            marks, token.count("!") if marks else 0, sum(map(token.count, "%&$*#@|~^")) if marks else 0, obscure, uncovered, word > 0, stem > 0, len(token),
        ]

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            pass
        if len(index) > _MEMO or self.size > _MEMORY:
            index.clear()
            self.size = 0
        for t in dict.fromkeys(tokens):
            if t not in index:
                self.size += len(t)
                n = index[t] = len(index)
                if n >= len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[n] = self._look(t)
        return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))

    def of(self, text: str) -> list[float]:
        """A long text is taken in stretches; what is kept of it are sums, and the places of hits and pronouns."""
        n, s, most = 0, np.zeros(14), np.zeros(14, np.float32)
        hits, addressed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for tokens in _stretches(text):
            if tokens:
                numbers = self._numbers(tokens)  # this may replace self.rows
                m = self.rows[numbers]
                s += m.sum(axis=0, dtype=np.float64)
                most = np.maximum(most, m.max(axis=0))
                hits.append(np.flatnonzero(m[:, self.HIT]) + n)
                addressed.append(np.flatnonzero(m[:, self.ADDRESS]) + n)
                n += len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        hit, near = np.concatenate(hits), np.concatenate(addressed)
        close = 0
        if len(hit) and len(near):
            at = np.searchsorted(near, hit)
            before, after = near[np.maximum(at - 1, 0)], near[np.minimum(at, len(near) - 1)]
            close = int((np.minimum(abs(hit - before), abs(hit - after)) <= NEAR).sum())
        letters, chars = max(s[self.LETTERS], 1.0), max(s[self.CHARS], 1.0)
        return [
            float(np.log1p(n)), s[self.HIT] / n, float(np.log1p(s[self.HIT])), s[self.WORD] / n, float(most[self.WORD]),
            s[self.STEM_HIT] / n, float(np.log1p(s[self.STEM_HIT])), s[self.STEM] / n, float(most[self.STEM]),
            close, close / n, s[self.ADDRESS] / n, s[self.UPPER] / letters, s[self.SHOUT] / n, s[self.PUNCT] / chars, s[self.EXCLAIM] / n, s[self.SYMBOL] / chars, s[self.OBSCURE] / n, s[self.UNCOVERED],
        ]


def _stretches(text: str) -> Iterator[list[str]]:
    """The tokens of a text between white space, of about _CHUNK characters at a time."""
    at = 0
    while len(text) - at > _CHUNK:
        end = _SPACE.search(text, at + _CHUNK)
        end = end.start() if end else len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def features_of(text: Column, lexicons: list[dict[str, float]], which: Column) -> Column:
    """The features of texts under one of lexicons each, an array of double. Only the text goes to Python and only numbers come back."""
    shared = SparkSession.active().sparkContext.broadcast(lexicons)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        release_memory()
        makers = [Features(x) for x in shared.value]
        for texts, chosen in batches:
            yield pa.array([makers[k].of(t.as_py()) for t, k in zip(texts, chosen.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()(text, which)  # so that no plan evaluates it twice


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of docs: id_col, score (from 0 to 1), predicted (1 from 0.5 on).

        Null texts count as empty, which has features of its own (all 0). Texts are taken whole, long ones in stretches. Rows may repeat,
        ids may be null; other columns are ignored; no rows give no rows.
        """
        rows = docs.select(quoted(id_col).alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
        return self._scored(rows, "_id").select(F.col("_id").alias(id_col), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def _scored(self, rows: DataFrame, keep: str) -> DataFrame:
        """keep, score, of rows (keep, _text)."""
        if self.trees is None:
            scored = rows.select(keep, F.lit(self.base_rate).alias("score"))
        else:
            scored = _margins(self.trees, rows.select(keep, features_of(F.col("_text"), [self.lexicon], F.lit(0)).alias("features")))
            scored = scored.withColumn("score", F.col("margin")) if self.calibration is None else self.calibration.transform(scored)
        return scored.select(keep, F.least(F.greatest(F.coalesce("score", F.lit(self.base_rate)), F.lit(0.0)), F.lit(1.0)).alias("score"))


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """With margin, the trees' own probability, uncalibrated."""
    out = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return out.withColumn("margin", vector_to_array("probability")[1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: tuple[int, ...] = (1, 2, 3, 4),
    most_rows: int = 20_000,
    most_terms: int = 4000,
    trees: int = 30,
    depth: int = 4,
) -> ToxicityModel:
    """Learns a lexicon, trees and a calibration from the labelled rows whose fold (crc32 of the id as text, mod 5) is in folds.

    A bounded sample of at most most_rows labels (those with the smallest hash of the id) is used, which also bounds what is
    broadcast to find their texts; equal texts count once. The lexicon holds at most most_terms words and stems, those with the
    largest log-odds. The trees see features under a lexicon of the other half of the rows, so they learn how far lexicon words can
    be trusted on texts that the lexicon hasn't seen; the last fold calibrates. Null ids, labels and texts are left out. Without
    rows of both labels the model gives every text the rate of label 1 (0 without any).
    """
    chosen = labels.select(quoted(id_col).alias("_label_id"), quoted(label_col).cast("int").alias("label"))
    chosen = chosen.where(F.col("label").isin(0, 1) & fold(F.col("_label_id")).isin(*folds)).groupBy("_label_id").agg(F.max("label").alias("label"))
    chosen = staged(chosen.orderBy(F.xxhash64("_label_id"), "_label_id").limit(most_rows), "labels")
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")).where(F.col("_text").isNotNull())
    rows = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).withColumn("fold", fold(F.col("_id"))).drop("_label_id")
    rows = rows.groupBy(F.sha2("_text", 256)).agg(*[F.min_by(c, "_id").alias(c) for c in ("_text", "label", "fold")])
    half = F.col("fold") % 2
    rows = staged(rows.select("_text", "label", "fold", half.cast("int").alias("half")), "labelled")

    sizes = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    toxic = sum(v for (_, y), v in sizes.items() if y == 1)
    if not toxic or toxic == n:
        return ToxicityModel({}, None, None, toxic / n if n else 0.0)
    terms = rows.select(F.explode(terms_of(F.col("_text"))).alias("term"), "label", "half")
    counts = terms.groupBy("term").agg(*[F.count(F.when((F.col("half") == h) & (F.col("label") == y), 1)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)])
    counts = staged(counts.where("n01 + n11 >= 3"), "terms")

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        all1, all0 = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
        in1, in0 = (sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (1, 0))
        weight = F.log((in1 + 0.5) / (all1 + 1)) - F.log((in0 + 0.5) / (all0 + 1))
        best = counts.where(in1 >= 3).select("term", weight.alias("w"), in1.alias("k")).where("w >= 2").orderBy(F.desc(F.col("w") * F.log1p("k")), "term").limit(most_terms)
        return {r.term: float(r.w) for r in best.collect()}

    lexicons = [lexicon((1,)), lexicon((0,)), lexicon((0, 1))]  # by half: that of the other half; of all
    seen = staged(rows.select("label", "fold", features_of(F.col("_text"), lexicons[:2], F.col("half")).alias("features")), "features")
    fits, checks = seen.where(F.col("fold") != max(folds)), seen.where(F.col("fold") == max(folds))
    if fits.agg(F.count_distinct("label")).first()[0] < 2:
        return ToxicityModel(lexicons[2], None, None, toxic / n)
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=17, cacheNodeIds=False)
    model = learner.fit(fits.withColumn("features", array_to_vector("features")).withColumn("label", F.col("label").cast("double")).coalesce(1))
    if checks.agg(F.count_distinct("label")).first()[0] < 2:
        return ToxicityModel(lexicons[2], model, None, toxic / n)
    margins = _margins(model, checks).select("margin", F.col("label").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margins)
    return ToxicityModel(lexicons[2], model, calibration, toxic / n)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns, whatever their names.

    Where the labels are too few to fit trees, nothing tells texts apart and all rows stay. Null, empty and very long texts, repeated rows
    and no rows are as in ToxicityModel.score. One pass over the texts after the fit, without a shuffle.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, **how)
    if model.trees is None:
        return docs
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    kept = model._scored(rows, "_row").where("score < 0.5")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
