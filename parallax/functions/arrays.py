"""Array functions over model inputs and outputs.

Built from Spark's higher-order functions (transform, aggregate, zip_with,
slice, array_repeat); they run inside whole-stage codegen, no Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parallax import constants as K

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(c: ColumnOrName) -> Column:
    return F.aggregate(_col(c), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def int_array_sum(c: ColumnOrName) -> Column:
    return F.aggregate(_col(c), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


# V3 ------------------------------------------------------------------------

def generation_example(prompt_ids: ColumnOrName, target_ids: ColumnOrName, eos_id: int,
                       max_input: int = K.GEN_MAX_INPUT_LEN,
                       max_target: int = K.GEN_MAX_TARGET_LEN) -> Column:
    """struct(input_ids, labels): last ``max_input`` prompt ids + first
    ``max_target`` of (target ids + eos); labels mask the prompt with -100."""
    p = _col(prompt_ids)
    keep = F.least(F.size(p), F.lit(max_input))
    prompt = F.when(keep > 0, F.slice(p, -keep, keep)).otherwise(F.array().cast("array<int>"))
    target = F.slice(F.concat(_col(target_ids), F.array(F.lit(eos_id))), 1, max_target)
    labels = F.concat(F.array_repeat(F.lit(K.IGNORE_INDEX), F.size(prompt)), target)
    return F.struct(F.concat(prompt, target).alias("input_ids"), labels.alias("labels"))


# V4 helpers ----------------------------------------------------------------

def left_pad(ids: ColumnOrName, length: ColumnOrName, pad: int) -> Column:
    c = _col(ids)
    n = _col(length) - F.size(c)
    return F.concat(F.array_repeat(F.lit(pad), n), c)


def left_pad_mask(ids: ColumnOrName, length: ColumnOrName) -> Column:
    c = _col(ids)
    return F.concat(F.array_repeat(F.lit(0), _col(length) - F.size(c)),
                    F.array_repeat(F.lit(1), F.size(c)))


# V5 ------------------------------------------------------------------------

def fixed_length(ids: ColumnOrName, length: int = K.DET_MAX_SEQ_LEN, pad: int = 0) -> Column:
    """struct(input_ids, attention_mask): truncate to the first ``length``
    ids, right-pad with ``pad``; mask 1 on real ids."""
    t = F.slice(_col(ids), 1, length)
    n_pad = F.lit(length) - F.size(t)
    return F.struct(F.concat(t, F.array_repeat(F.lit(pad), n_pad)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), F.size(t)),
                             F.array_repeat(F.lit(0), n_pad)).alias("attention_mask"))


# V6 ------------------------------------------------------------------------

def last_real_index(mask: ColumnOrName) -> Column:
    """0-based index of the last real position: sum(mask) - 1 (right padding)."""
    return int_array_sum(mask) - 1


def last_real_vector(hidden: ColumnOrName, mask: ColumnOrName) -> Column:
    return F.element_at(_col(hidden), (last_real_index(mask) + 1).cast("int"))


def reshape(flat: ColumnOrName, rows: int, width: int) -> Column:
    """Flat array -> array of ``rows`` arrays of ``width`` (row-major)."""
    f = _col(flat)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda t: F.slice(f, t * width + 1, width))


# V7 ------------------------------------------------------------------------

def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return array_sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def linear_head(h: ColumnOrName, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """W h + b with literal weights: one logit per output row of W."""
    return F.array(*[dot(F.array(*[F.lit(float(w)) for w in row]), h) + F.lit(float(b))
                     for row, b in zip(weights, bias)])


# V8 ------------------------------------------------------------------------

def softmax(z: ColumnOrName) -> Column:
    c = _col(z)
    m = F.array_max(c)
    e = F.transform(c, lambda x: F.exp(x - m))
    s = array_sum(e)
    return F.transform(e, lambda x: x / s)


# V9 ------------------------------------------------------------------------

def argmax(z: ColumnOrName) -> Column:
    """0-based index of the first maximum."""
    c = _col(z)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


# V10 -----------------------------------------------------------------------

def detection_result(z: ColumnOrName) -> Column:
    """struct(label, confidence): class 1 -> 'correct'; confidence = round(max prob, 4)."""
    label = F.when(argmax(z) == 1, F.lit(K.LABEL_CORRECT)).otherwise(F.lit(K.LABEL_INCORRECT))
    return F.struct(label.alias("label"), F.round(F.array_max(softmax(z)), 4).alias("confidence"))


# V11 -----------------------------------------------------------------------

def yes_no_decision(z: ColumnOrName, yes_index: int = 1, no_index: int = 0) -> Column:
    """1 if logit[yes] > logit[no] (a tie is 0)."""
    c = _col(z)
    return (F.element_at(c, yes_index + 1) > F.element_at(c, no_index + 1)).cast("int")


# V12 -----------------------------------------------------------------------

def logsumexp(z: ColumnOrName) -> Column:
    c = _col(z)
    m = F.array_max(c)
    return m + F.log(array_sum(F.transform(c, lambda x: F.exp(x - m))))


def cross_entropy(z: ColumnOrName, y: ColumnOrName) -> Column:
    """logsumexp(z) - z[y] with a 0-based class index y."""
    return logsumexp(z) - F.element_at(_col(z), (_col(y) + 1).cast("int"))
