"""Numbers, digests and keys on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(v: Column) -> Column:
    return v.cast("string").try_cast("double")


def norm_confidence(v: Column) -> Column:
    """Percent and ten-point scales to 0..1; what is no number is 0."""
    f = to_double(v)
    f = F.when(f > 10, f / 100).when(f > 1, f / 10).otherwise(f)
    return F.when(f.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f)))


def clamp_score(v: Column) -> Column:
    """Rounded half to even, 1..10; what is no number is 5."""
    n = F.bround(to_double(v)).cast("int")
    return F.when(n.isNull(), F.lit(5)).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), n)))


def logistic(z: Column) -> Column:
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def learned_confidence(pro: Column, anti: Column, competing: Column, conflict: Column, raw: Column, weights: dict) -> Column:
    """M03; the raw confidence may go by its older name pred_confidence."""
    c = weights.get("coefficients", {})
    z = F.lit(float(weights.get("intercept", 0.0)))
    for name, v in (("pro_match", pro), ("anti_match", anti), ("competing", competing), ("rule_conflict", conflict.cast("int"))):
        z = z + F.lit(float(c.get(name, 0.0))) * v
    return logistic(z + F.lit(float(c.get("confidence", c.get("pred_confidence", 0.0)))) * raw)


def cache_key(model: Column, image: Column, prompt: Column) -> Column:
    """Digest of model, digest of the image and prompt, zero bytes between."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(model.cast("binary"), zero, F.unhex(F.sha2(image, 256)), zero, prompt.cast("binary")), 256)


def extract_key(content: Column, *settings: Column) -> Column:
    """Digest of the settings, a zero byte after each, and of the content's digest."""
    zero = F.unhex(F.lit("00"))
    parts = [x for s in settings for x in (s.cast("string").cast("binary"), zero)]
    return F.sha2(F.concat(*parts, F.unhex(F.sha2(content, 256))), 256)


def iso(at: Column) -> Column:
    """A moment as ISO 8601 in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def image_id(image: Column) -> Column:
    """M07."""
    return F.substring(F.sha2(image, 256), 1, 16)


def page_label(n: Column, digits: int) -> Column:
    """M15."""
    return F.lpad(n.cast("string"), max(digits, 2), "0")


def learning_rate(step: Column, total: int, warm: int, top: float) -> Column:
    """Linear rise, then linear fall."""
    return F.when(step < warm, F.lit(top) * (step + 1) / max(warm, 1)).otherwise(F.lit(top) * F.greatest(F.lit(0.0), (F.lit(total) - step) / max(total - warm, 1)))


def positive_int(v: Column, default: int) -> Column:
    """P09."""
    n = v.cast("string").try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))
