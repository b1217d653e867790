"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: how many of its words are in a lexicon (as they are, or only after leet
letters and separators are undone), how often a second-person word stands near such a word, and
the rates of capitals, punctuation and obfuscation. The lexicon is a short list of insults and the
terms that a part of the labelled texts shows to be far likelier in toxic ones: whole words and
stems of four to eight letters, so that it also holds what no list foresaw. The labelled rows
are dealt in three by a hash of their key: one part finds the lexicon, one fits the trees, one
calibrates.

At most ``labelled_rows`` labelled rows are used, those with the smallest hash of their key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..session import release, stage_table

LABELLED_ROWS = 24_000
LEXICON_TERMS = 2_000
LEXICON_LOG_ODDS = 3.0  # twenty times likelier in toxic texts
LEXICON_SHARE = 0.005  # of the toxic texts, and four of them
STEMS = range(4, 9)  # letters
THRESHOLD = 0.3
NEAR_WORDS = 5
PARTS = (0.5, 0.8)  # hash below the first: lexicon, below the second: trees, else calibration

INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown clowns pig fool coward".split()
SECOND_PERSON = set("you your yours youre yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())

_WORD = re.compile(r"\S+")
_EDGES = ".,;:!?\"'()[]{}<>|*_~`-…«»“”„’‘¡¿"
_CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_SHOUT = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")
_MARKS = re.compile(r"[!?]")
_RUN_OF_MARKS = re.compile(r"[!?]{2,}")
_PUNCTUATION = re.compile(r"[^\w\s]")
_INSIDE = re.compile(r"[a-z][0-9@$*#!|+._-]+(?=[a-z])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
#: Leet letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", "#": "", ".": "", "_": "", "-": ""})

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_kinds", "insult_density", "hidden_density", "near_second_person", "second_person_density",
    "capitals", "shouted", "marks", "runs_of_marks", "punctuation", "inside_words", "stretched", "log_words",
)


def words_of(text: str) -> list[str]:
    return [w for w in (found.strip(_EDGES) for found in _WORD.findall(text.lower())) if w]


def heads_of(terms: frozenset[str]) -> frozenset[str]:
    """The first letters of all stems, a quick test that most words fail."""
    return frozenset(t[: STEMS[0]] for t in terms if t.endswith("*"))


def features(text: str | None, terms: frozenset[str], heads: frozenset[str], insults: frozenset[str] = frozenset(INSULTS)) -> list[float]:
    """One number per name in ``FEATURES``. ``terms``: words, and stems written with a trailing star; ``heads``: of them."""
    text = text or ""
    words = words_of(text)
    n, chars = len(words) or 1, len(text) or 1
    hits, kinds, insulting, hidden = [], set(), 0, 0
    for at, word in enumerate(words):
        if word in terms or word[: STEMS[0]] in heads and any(word[:size] + "*" in terms for size in STEMS if size <= len(word)):
            hits.append(at)
            kinds.add(word)
            insulting += word in insults
        elif not word.isalpha():
            plain = word.translate(_LEET)
            if plain != word and (plain in insults or plain in terms):
                hits.append(at)
                hidden += 1
    second = [at for at, word in enumerate(words) if word in SECOND_PERSON]
    near = 0
    if hits and second:
        places = np.array(second)
        left = np.searchsorted(places, np.array(hits) - NEAR_WORDS)
        near = int((np.searchsorted(places, np.array(hits) + NEAR_WORDS, side="right") > left).sum())
    marks = len(_MARKS.findall(text))
    return [
        len(hits) / n, float(len(hits)), float(len(kinds)), insulting / n, hidden / n, near / max(1, len(hits)), len(second) / n,
        len(_CAPITAL.findall(text)) / chars, len(_SHOUT.findall(text)) / n, marks / chars, len(_RUN_OF_MARKS.findall(text)) / n,
        len(_PUNCTUATION.findall(text)) / chars, len(_INSIDE.findall(text.lower())) / n, len(_STRETCHED.findall(text)) / n, float(np.log1p(len(words))),
    ]


@pandas_udf(T.ArrayType(T.StringType()))
def _terms(texts: pd.Series) -> pd.Series:
    def terms(text):
        words = {w for w in words_of(text or "") if w.isalpha()}
        return sorted(words | {w[:size] + "*" for size in STEMS for w in words if len(w) > size})

    return pd.Series([terms(t) for t in texts], dtype=object)


def _vector(text: Column, terms: frozenset[str]) -> Column:
    heads = heads_of(terms)

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, terms, heads) for t in texts], dtype=object)

    return array_to_vector(dense(text))


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def find_terms(labelled: DataFrame) -> frozenset[str]:
    """Terms far likelier in toxic texts, of (text, label) rows; equal texts count once."""
    sizes = dict(labelled.select("text", "label").distinct().groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return frozenset(INSULTS)
    seen = labelled.select("text", "label").distinct().select("label", F.explode(_terms("text")).alias("term")).groupBy("term")
    counted = seen.agg(F.sum("label").alias("in_toxic"), F.sum(1 - F.col("label")).alias("in_clean"))
    odds = F.log((F.col("in_toxic") + 0.5) / toxic) - F.log((F.col("in_clean") + 0.5) / clean)
    likely = counted.filter(F.col("in_toxic") >= max(4, LEXICON_SHARE * toxic)).withColumn("odds", odds).filter(F.col("odds") >= LEXICON_LOG_ODDS)
    # 2 000 short terms at most.
    return frozenset(INSULTS) | {r["term"] for r in likely.orderBy(F.desc("odds"), "term").limit(LEXICON_TERMS).collect()}


@dataclass(frozen=True)
class Model:
    """``trees`` is None where there were not two classes to learn; then every score is ``share``."""

    terms: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` in place of the text: 0 to 1, NULL texts as empty ones.

        A thousandth of the score is the uncalibrated one, so that texts on one step of the
        calibration keep their order.
        """
        if self.trees is None:
            return docs.drop(text).withColumn("score", F.lit(self.share))
        kept = [c for c in docs.columns if c != text]
        made = docs.select(*kept, _vector(F.col(text), self.terms).alias("_features"))
        raw = self.trees.transform(made).withColumn("_raw", vector_to_array("probability")[1])
        out = self.calibration.transform(raw)
        return out.select(*kept, (0.999 * F.col("_calibrated") + 0.001 * F.col("_raw")).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", labelled_rows: int = LABELLED_ROWS, seed: int = 42) -> Model:
    """Learn from the labelled rows that are not held out. Rows without a label or key are left out; a
    document labelled twice counts as toxic if one label says so."""
    named = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    named = named.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.lit("toxicity"), F.col("_key")))
    chosen = named.withColumn("_draw", draw).orderBy("_draw", "_key").limit(labelled_rows)
    # Other digits than those by which the rows were chosen.
    place = F.conv(F.substring("_draw", 17, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    part = F.when(place < PARTS[0], "lexicon").when(place < PARTS[1], "trees").otherwise("calibration")
    chosen = stage_table(chosen.select("_key", "label", part.alias("part")))
    # The chosen keys are bounded by ``labelled_rows``.
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labelled = stage_table(texts.join(F.broadcast(chosen), "_key").repartition(8, F.xxhash64("_key")).select("text", "label", "part"))
    counts = {(r["part"], r["label"]): r["count"] for r in labelled.groupBy("part", "label").count().collect()}
    if any(not counts.get((p, y)) for p in ("trees", "calibration") for y in (0, 1)):
        toxic = sum(n for (_, y), n in counts.items() if y)
        return Model(frozenset(INSULTS), None, None, toxic / max(1, sum(counts.values())))
    terms = find_terms(labelled.filter("part = 'lexicon'"))
    vectors = labelled.filter("part <> 'lexicon'").select("part", F.col("label").cast("double"), _vector(F.col("text"), terms).alias("_features"))
    vectors = stage_table(vectors.repartition(4))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=seed
    ).fit(vectors.filter("part = 'trees'"))
    raw = trees.transform(vectors.filter("part = 'calibration'")).select("label", vector_to_array("probability")[1].alias("_raw"))
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(raw)
    release(chosen, labelled, vectors)
    return Model(terms, trees, calibration, 0.0)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``docs``: the key, held_out, score, predicted (1 if the score reaches the threshold).

    Other columns of either table are not looked at; without labels of both classes all scores
    are the share of toxic labels. Repeated rows get equal scores.
    """
    model = fit(docs, labels, text, key, **options)
    scored = model.score(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    return scored.select(
        F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below the threshold."""
    model = fit(docs, labels, text, key, **options)
    marked = model.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text")), "_text")
    return marked.filter(F.col("score") < threshold).select("_row.*")
