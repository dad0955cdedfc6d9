"""Vector functions as Spark columns. Vectors are arrays of numbers; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column | str
TINY = 1e-12
ZERO_NORM = 1e-9
ALIGN = 64
HEADER = 64


def col(v: Vec) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, body) -> Column:
    """body(value), with value worked out once although body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Vec) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def total(v: Vec) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Vec, b: Vec) -> Column:
    """Inner product; null positions of the longer vector count as nothing."""
    products = F.zip_with(col(a), col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Vec) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Vec, b: Vec) -> Column:
    """Cosine similarity; 0 for vectors of different sizes or with a squared norm of 1e-9 or less."""
    na, nb = squared_norm(a), squared_norm(b)
    fit = (F.size(col(a)) == F.size(col(b))) & (na > ZERO_NORM) & (nb > ZERO_NORM)
    return F.when(fit, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def normalised(v: Vec) -> Column:
    """Divided by its Euclidean norm."""
    return let(F.sqrt(squared_norm(v)) + TINY, lambda norm: F.transform(col(v), lambda x: x.cast("double") / norm))


def softmax(v: Vec) -> Column:
    """Shifted by the maximum, so that no exponential overflows."""
    raised = let(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    return let(raised, lambda r: let(total(r) + TINY, lambda whole: F.transform(r, lambda x: x / whole)))


def kl_divergence(p: Vec, q: Vec) -> Column:
    """In nats; both smoothed by 1e-12."""
    terms = F.zip_with(col(p), col(q), lambda x, y: x * F.log((x + TINY) / (y + TINY)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def js_divergence(p: Vec, q: Vec) -> Column:
    """Jensen-Shannon divergence of two distributions; at most ln 2."""
    mid = F.zip_with(col(p), col(q), lambda x, y: (x + y) * 0.5)
    return let(mid, lambda m: 0.5 * kl_divergence(p, m) + 0.5 * kl_divergence(q, m))


def quant_scale(v: Vec) -> Column:
    """max |v| / 127; 1 for a vector of (nearly) zeros."""
    return let(F.array_max(F.transform(doubles(v), F.abs)), lambda top: F.when(top < 1e-10, F.lit(1.0)).otherwise(top / 127.0))


def quantize(v: Vec) -> Column:
    """struct(q array<tinyint>, scale): symmetric, rounded half away from zero, held within +-127."""

    def coded(scale: Column) -> Column:
        q = F.transform(doubles(v), lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.round(x / scale))).cast("tinyint"))
        return F.struct(q.alias("q"), scale.alias("scale"))

    return let(quant_scale(v), coded)


def int_dot(a: Vec, b: Vec) -> Column:
    """Inner product of quantized vectors, in whole numbers."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("int") * y.cast("int"))
    return F.aggregate(products, F.lit(0), lambda s, x: s + x)


def dequantized_dot(a: Vec, scale_a: Vec, b: Vec, scale_b: Vec) -> Column:
    return int_dot(a, b) * col(scale_a) * col(scale_b)


def dequantize(q: Vec, scale: Vec) -> Column:
    return F.transform(col(q), lambda x: x.cast("double") * col(scale))


def padded(v: Vec, size: int) -> Column:
    """With zeros behind, up to size; longer vectors are cut."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), size)), 1, size)


def preview(v: Vec, n: int = 3) -> Column:
    return F.slice(doubles(v), 1, n)


def node_stride(dim: Column | int, metadata_bytes: Column | int, bytes_each: int) -> Column:
    """Bytes of a stored node: header, vector and metadata, aligned to 64."""
    dim, metadata_bytes = (F.lit(x) if isinstance(x, int) else x for x in (dim, metadata_bytes))
    raw = HEADER + dim * bytes_each + metadata_bytes
    return (F.floor((raw + (ALIGN - 1)) / ALIGN) * ALIGN).cast("long")


def byte_prefix(text: Vec, n: int) -> Column:
    """The longest prefix of whole characters within n bytes of UTF-8."""
    text = col(text)
    ends = F.filter(F.sequence(F.lit(0), F.least(F.char_length(text), F.lit(n))), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= n)
    return F.substring(text, F.lit(1), F.array_max(ends))
