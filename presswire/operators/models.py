"""Trainable classifier and model-scoring hooks (pyspark.ml).

* ``train_forest``   – cls_rf_train: TF-IDF over 1- and 2-grams (English stop
  words removed, vocabulary of ``vocab`` terms, 10 000 as in the original when not given) + random forest (100 trees,
  seed 42), as one ``Pipeline``
* ``forest_predict`` – cls_rf_predict: label per row; rows are classified by
  the keyword rule when no model is given (the original's fallback)
* ``forest_proba``   – cls_rf_proba: class -> probability map
* ``save_model`` / ``load_model`` – cls_rf_save / load (missing -> None)
* ``with_model_scores`` – sent_model / cls_model: a user model applied with
  ``predict_batch_udf`` (loaded once per Python worker, Arrow batches);
  the engine supplies truncation, softmax, label order and argmax.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (IDF, CountVectorizer, IndexToString, NGram, RegexTokenizer, SQLTransformer,
                                StopWordsRemover, StringIndexer)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from presswire import constants as C
from presswire.functions import scores as S
from presswire.functions.text import is_blank
from presswire.operators.enrich import classify_blank_default, with_category
from presswire.sources.files import path_exists


#: Private input column, so that a caller's ``text`` stays as it is.
TEXT = "_forest_text"
#: Bins of a feature, as Spark has them when not given, and the most whose square Spark can hold.
BINS, MOST_BINS = 32, 46_340


def forest_pipeline(text_col: str = TEXT, label_col: str = "label", trees: int = C.FOREST_TREES,
                    seed: int = C.FOREST_SEED, vocab: int = C.FOREST_FEATURES, depth: int = 5,
                    weight_col: str | None = None, bins: int = BINS) -> Pipeline:
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True)
    stop = StopWordsRemover(inputCol="_tok", outputCol="_uni")
    bi = NGram(n=2, inputCol="_uni", outputCol="_bi")
    both = SQLTransformer(statement="SELECT *, concat(_uni, _bi) AS _grams FROM __THIS__")
    cv = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=vocab)
    idf = IDF(inputCol="_tf", outputCol="features")
    idx = StringIndexer(inputCol=label_col, outputCol="_label_idx", handleInvalid="skip")
    rf = RandomForestClassifier(featuresCol="features", labelCol="_label_idx", numTrees=trees, seed=seed, maxDepth=depth,
                                maxBins=bins, predictionCol="_pred_idx", probabilityCol="probability")
    if weight_col:
        rf.setWeightCol(weight_col)
    return Pipeline(stages=[idx, tok, stop, bi, both, cv, idf, rf])


#: Rows are first counted by so many leading bits of their hash.
HASH_BITS = 16
#: Rows of one part of the data that a forest is fitted on.
FIT_ROWS = 5000
#: Most copies of one row that are dealt to a part together.
LOT = 100


def lowest_by_hash(data: DataFrame, columns: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` rows lowest by a hash of ``columns`` (all the columns there are), in many partitions.

    Rows are counted by the hash's leading bits, then by the hash within the block where the n-th lies, so that
    no task gets more than its share of the rows; copies beyond the n-th row go.  The second frame is kept for the
    first: unpersist it afterwards.
    """
    hashed = data.withColumn("_hash", F.xxhash64(*columns)).withColumn("_block", F.shiftright("_hash", 64 - HASH_BITS))
    blocks = sorted(hashed.groupBy("_block").count().collect())     # at most 2^HASH_BITS small rows
    edge, left = _nth(blocks, n)
    near = (hashed if edge is None else hashed.where(F.col("_block") <= edge)).persist()
    if edge is None:
        return near.select(*columns), near
    last, copies = _nth(sorted(near.where(F.col("_block") == edge).groupBy("_hash").count().collect()), left)
    below = near.where(F.col("_hash") < last)
    # copies are counted, so that however many there are one row of each stands for them
    same = near.where(F.col("_hash") == last).groupBy("_hash", *columns).count().withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("count", F.lit(copies)))))
    return below.select("_hash", *columns).unionByName(same.select("_hash", *columns)).select(*columns), near


def _nth(counted: list, n: int) -> tuple:
    """The value at which the running sum of (value, count) reaches ``n``, and what is left of ``n`` there; None beyond the sum."""
    for value, count in counted:
        if n <= count:
            return value, n
        n -= count
    return None, 0


def dealt(data: DataFrame, parts: int) -> DataFrame:
    """All rows of ``data`` in ``parts`` partitions, sorted by a hash of text and label.

    Places come from the rows alone, whatever the partitions before.  A row that comes often is counted and its
    copies are dealt out in lots, so that they don't meet in one task.
    """
    lots = data.groupBy(*data.columns).count().withColumn("_lot", F.explode(F.expr(f"sequence(0L, (count - 1) div {LOT})")))
    copies = lots.repartition(parts, F.xxhash64(TEXT, "label"), "_lot").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(LOT), F.col("count") - F.col("_lot") * LOT))))
    return copies.select(*data.columns).sortWithinPartitions(F.xxhash64(TEXT, "label"))


def train_forest(df: DataFrame, text_col: str = "text", label_col: str = "label", balanced: bool = False,
                 max_rows: int | None = None, **kw) -> PipelineModel:
    """cls_rf_train on (text, label) rows (texts and labels taken as strings).

    Vocabulary, IDF, split thresholds and trees come from all the rows.  ``balanced``: every class weighs the same,
    however rare.  ``max_rows``: a bound on the labelled rows that a caller may set, drawn by a hash of text and label
    (no registered query sets it).  ``trees``, ``seed``, ``vocab``, ``depth`` and ``bins`` go to the pipeline.
    """
    data = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(TEXT),
                     F.col(label_col).cast("string").alias("label"))
    near = None
    if max_rows is not None:
        data, near = lowest_by_hash(data, [TEXT, "label"], max_rows)
    if balanced:
        sizes = data.groupBy("label").agg((1.0 / F.count(F.lit(1))).alias("_weight"))  # one row per class
        data = data.join(F.broadcast(sizes), "label")
        kw["weight_col"] = "_weight"
    rows = (data if near is None else near).count()     # of all rows: without their texts
    parts = max(1, -(-rows // FIT_ROWS))
    # Spark takes thresholds from a sample of 10 000 rows, or of the square of the bins if that is more
    if rows > 10_000:
        kw.setdefault("bins", min(MOST_BINS, max(BINS, math.isqrt(rows - 1) + 1)))
    # a tree's draw depends on places and partitions: both come from the rows alone, whatever the session's settings
    data = dealt(data, parts) if near is None else data.repartitionByRange(
        parts, F.xxhash64(TEXT, "label")).sortWithinPartitions(F.xxhash64(TEXT, "label"))
    # fitting makes several passes (indexer, vocabulary, IDF, tree levels):
    # keep the prepared input cached instead of recomputing it every pass
    data = data.persist()
    try:
        model = forest_pipeline(TEXT, "label", **kw).fit(data)
    finally:
        data.unpersist()
        if near is not None:
            near.unpersist()
    # the training summary of two classes holds the session, which a session that has taken an
    # Observation can't serialise with the model; a loaded model has no summary either
    model.stages[-1]._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return model


def _labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def _scorer(model: PipelineModel) -> PipelineModel:
    """The fitted stages without the label indexer (prediction needs no label)."""
    return PipelineModel(stages=model.stages[1:])


def forest_predict(df: DataFrame, text_col: str, model: PipelineModel | None,
                   out_col: str = "category") -> DataFrame:
    """cls_rf_predict: model label, or the small keyword map when there is no model;
    blank text -> the default category either way."""
    text = F.col(text_col)
    if model is None:
        staged = with_category(df, text_col, "_kw", C.KEYWORD_MAP_SMALL)
        return staged.withColumn(out_col, classify_blank_default(text, F.col("_kw"))).drop("_kw")
    scored = _scorer(model).transform(df.withColumn(TEXT, F.coalesce(text.cast("string"), F.lit(""))))
    to_label = IndexToString(inputCol="_pred_idx", outputCol="_pred_label", labels=_labels(model))
    out = to_label.transform(scored)
    keep = df.columns + [out_col]
    return (out.withColumn(out_col, classify_blank_default(text, F.col("_pred_label")))
            .select(*keep))


def forest_proba(df: DataFrame, text_col: str, model: PipelineModel | None) -> DataFrame:
    """cls_rf_proba: map label -> probability; an error without a trained model."""
    if model is None:
        raise RuntimeError("No trained forest model loaded for probability prediction.")
    scored = _scorer(model).transform(df.withColumn(TEXT, F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    labels = F.array(*[F.lit(x) for x in _labels(model)])
    return scored.select(*df.columns, F.map_from_arrays(labels, vector_to_array("probability")).alias("proba"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """Load a saved model; a missing path gives None (keyword fallback), any other fault is raised."""
    return PipelineModel.load(path) if path_exists(SparkSession.active(), path) else None


# ---------------------------------------------------------------------------
# model hooks
# ---------------------------------------------------------------------------

def with_model_scores(df: DataFrame, text_col: str,
                      make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
                      out_col: str = "probs", max_chars: int | None = None, batch_size: int = 64,
                      apply_softmax: bool = True) -> DataFrame:
    """Apply a user model to text: returns array<double> of class probabilities.

    ``make_predict_fn`` is called once per Python worker and returns a
    function from a batch of strings (numpy array) to a (batch, n_outputs)
    array of logits (or probabilities with ``apply_softmax=False``).  Text
    goes to the model whole, or cut to ``max_chars`` if that is given; blank text gives NULL.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    text = F.col(text_col)
    given = F.coalesce(text, F.lit(""))
    # the model output is its own column: Python UDFs cannot run inside the
    # softmax lambdas, and the separate projection keeps one call per row
    staged = df.withColumn("_raw", udf(given if max_chars is None else F.substring(given, 1, max_chars)))
    probs = S.softmax(F.col("_raw")) if apply_softmax else F.col("_raw")
    return staged.withColumn(out_col, F.when(is_blank(text), F.lit(None).cast("array<double>"))
                             .otherwise(probs)).drop("_raw")


def sentiment_from_model(probs: Column, model_order: list[str] | None = None) -> Column:
    """sent_model post-processing: (positive, negative, neutral); blank -> zeros."""
    return S.reorder_scores(probs, model_order)


def category_from_model(probs: Column, text: Column, labels: list[str] | None = None) -> Column:
    """cls_model post-processing: argmax label; blank text -> default category."""
    return classify_blank_default(text, S.argmax_label(probs, labels or C.MODEL_CATEGORIES))


def hashing_logits_model(n_outputs: int, dim: int = 1 << 12, seed: int = 7):
    """A small stand-in model factory for tests and examples: hashed bag of
    words times a fixed random matrix.  Real deployments pass their own."""
    def make():
        rng = np.random.default_rng(seed)
        w = rng.normal(size=(dim, n_outputs))

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), n_outputs))
            for i, t in enumerate(texts):
                toks = str(t).lower().split()
                if toks:
                    idx = np.fromiter((zlib.crc32(x.encode()) % dim for x in toks), dtype=np.int64,
                                      count=len(toks))
                    out[i] = w[idx].mean(axis=0)
            return out
        return predict
    return make
