"""Score arithmetic as Column expressions (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions.text import is_blank


def round_half_up(c: Column, digits: int) -> Column:
    """Half away from zero, as the warehouse's ROUND: sign(x) * floor(|x| * 10^d + 0.5) / 10^d as DOUBLE.

    The binary value is rounded (Spark's ``round`` goes by the decimal text), so other engines'
    ``round`` gives the same double.
    """
    scale = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp01(c: Column) -> Column:
    """fn_abs_clamp: clamp to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sent_map(polarity: Column, text: Column | None = None) -> Column:
    """sent_map: polarity in [-1, 1] -> struct(positive, negative, neutral, label).

    p > 0.1:  pos = .4 + .5p, neg = .05, neu = rest      -> positive
    p < -0.1: neg = .4 + .5|p|, pos = .05, neu = rest    -> negative
    else:     neu = .6 + .3(1 - 10|p|), pos = neg = (1 - neu)/2 -> neutral
    then clamp to [0, 1], renormalise to sum 1 and round to 4 places.
    A blank or NULL ``text`` gives (0, 0, 1, neutral).
    """
    p = polarity.cast("double")
    a = F.abs(p)
    pos_b = p > F.lit(C.POSITIVE_THRESHOLD)
    neg_b = p < F.lit(C.NEGATIVE_THRESHOLD)
    neu_mid = F.lit(0.6) + (F.lit(1.0) - a * F.lit(10.0)) * F.lit(0.3)
    side = (F.lit(1.0) - neu_mid) / F.lit(2.0)
    pos0 = F.when(pos_b, F.lit(0.4) + p * F.lit(0.5)).when(neg_b, F.lit(0.05)).otherwise(side)
    neg0 = F.when(pos_b, F.lit(0.05)).when(neg_b, F.lit(0.4) + a * F.lit(0.5)).otherwise(side)
    neu0 = F.when(pos_b | neg_b, F.lit(1.0) - pos0 - neg0).otherwise(neu_mid)
    pos1, neg1, neu1 = clamp01(pos0), clamp01(neg0), clamp01(neu0)
    total = pos1 + neg1 + neu1
    norm = lambda x: F.when(total > F.lit(0.0), x / total).otherwise(x)
    label = F.when(pos_b, F.lit("positive")).when(neg_b, F.lit("negative")).otherwise(F.lit("neutral"))
    out = F.struct(
        round_half_up(norm(pos1), 4).alias("positive_score"),
        round_half_up(norm(neg1), 4).alias("negative_score"),
        round_half_up(norm(neu1), 4).alias("neutral_score"),
        label.alias("sentiment_label"),
    )
    if text is None:
        return out
    # blank = NULL or only whitespace: a trim from both ends, not a regex pass over the text
    blank = is_blank(text)
    neutral = F.struct(F.lit(0.0).alias("positive_score"), F.lit(0.0).alias("negative_score"),
                       F.lit(1.0).alias("neutral_score"), F.lit("neutral").alias("sentiment_label"))
    return F.when(blank, neutral).otherwise(out)


def with_sent_map(df, polarity: Column, text: Column | None = None, out: str = "_s"):
    """sent_map as a DataFrame step: adds the struct column ``out``.

    The same arithmetic in the same order as ``sent_map``, but every
    intermediate (polarity, raw scores, clamped scores, total) is its own
    column of a staged projection.  As one Column the raw scores are repeated
    in the clamps, the total and the normalisation, and the tree the analyzer,
    optimizer and code generator walk grows to dozens of copies (measured: over
    a second of planning per query); staged, each value is computed once per
    row and the optimizer keeps the stages (it does not collapse non-trivial
    expressions referenced more than once).
    """
    names = ["_sm_p", "_sm_pos0", "_sm_neg0", "_sm_mid", "_sm_neu0", "_sm_pos1", "_sm_neg1", "_sm_neu1",
             "_sm_total"]
    p = F.col("_sm_p")
    a = F.abs(p)
    pos_b = p > F.lit(C.POSITIVE_THRESHOLD)
    neg_b = p < F.lit(C.NEGATIVE_THRESHOLD)
    d = df.withColumn("_sm_p", polarity.cast("double"))
    neu_mid = F.lit(0.6) + (F.lit(1.0) - a * F.lit(10.0)) * F.lit(0.3)
    d = d.withColumn("_sm_mid", neu_mid)
    side = (F.lit(1.0) - F.col("_sm_mid")) / F.lit(2.0)
    d = d.withColumns({
        "_sm_pos0": F.when(pos_b, F.lit(0.4) + p * F.lit(0.5)).when(neg_b, F.lit(0.05)).otherwise(side),
        "_sm_neg0": F.when(pos_b, F.lit(0.05)).when(neg_b, F.lit(0.4) + a * F.lit(0.5)).otherwise(side)})
    d = d.withColumn("_sm_neu0", F.when(pos_b | neg_b, F.lit(1.0) - F.col("_sm_pos0") - F.col("_sm_neg0"))
                     .otherwise(F.col("_sm_mid")))
    d = d.withColumns({f"_sm_{k}1": clamp01(F.col(f"_sm_{k}0")) for k in ("pos", "neg", "neu")})
    d = d.withColumn("_sm_total", F.col("_sm_pos1") + F.col("_sm_neg1") + F.col("_sm_neu1"))
    total = F.col("_sm_total")
    norm = lambda x: F.when(total > F.lit(0.0), x / total).otherwise(x)
    label = F.when(pos_b, F.lit("positive")).when(neg_b, F.lit("negative")).otherwise(F.lit("neutral"))
    struct = F.struct(
        round_half_up(norm(F.col("_sm_pos1")), 4).alias("positive_score"),
        round_half_up(norm(F.col("_sm_neg1")), 4).alias("negative_score"),
        round_half_up(norm(F.col("_sm_neu1")), 4).alias("neutral_score"),
        label.alias("sentiment_label"),
    )
    if text is not None:
        neutral = F.struct(F.lit(0.0).alias("positive_score"), F.lit(0.0).alias("negative_score"),
                           F.lit(1.0).alias("neutral_score"), F.lit("neutral").alias("sentiment_label"))
        struct = F.when(is_blank(text), neutral).otherwise(struct)
    return d.withColumn(out, struct).drop(*names)


def sent_alert(negative_score: Column) -> Column:
    """sent_alert: negative_score >= 0.5."""
    return negative_score >= F.lit(C.ALERT_THRESHOLD)


def pct(c: Column, digits: int = 1) -> Column:
    """prj_pct: score x 100 rounded to one decimal."""
    return round_half_up(c * F.lit(100.0), digits)


def softmax(logits: Column) -> Column:
    """fn_softmax over an array<double>: exp(x - max) / sum."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def argmax_label(probs: Column, labels: list[str]) -> Column:
    """fn_argmax_label: label at the position of the largest probability (first on ties)."""
    pos = F.array_position(probs, F.array_max(probs))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), pos.cast("int"))


def reorder_scores(probs: Column, model_order: list[str] | None = None) -> Column:
    """fn_reorder_scores: model order (negative, neutral, positive) -> (pos, neg, neu).

    ``probs`` is NULL for blank input -> (0, 0, 0).
    """
    order = model_order or C.SENTIMENT_LABELS
    idx = {lab: i + 1 for i, lab in enumerate(order)}
    get = lambda lab: F.coalesce(F.try_element_at(probs, F.lit(idx[lab])), F.lit(0.0))
    return F.struct(get("positive").alias("positive"), get("negative").alias("negative"),
                    get("neutral").alias("neutral"))


def sentiment_band(avg_positive: Column) -> Column:
    """prj_band: >= 0.6 green, >= 0.4 amber, else red."""
    return (F.when(avg_positive >= F.lit(C.BAND_GREEN), F.lit("green"))
            .when(avg_positive >= F.lit(C.BAND_AMBER), F.lit("amber"))
            .otherwise(F.lit("red")))


def label_default(label: Column) -> Column:
    """prj_label_default: missing or unknown label -> 'neutral', lower-cased."""
    low = F.lower(label)
    return F.when(low.isin("positive", "negative", "neutral"), low).otherwise(F.lit("neutral"))


def exact_mean(c: Column, count: Column | None = None) -> Column:
    """Order-independent mean of 4-decimal scores: DECIMAL sum / count as DOUBLE."""
    n = count if count is not None else F.count(c)
    return F.sum(c.cast("decimal(18,4)")).cast("double") / n.cast("double")
