import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.functions import vectors as V


def one(spark, **columns):
    make = spark.range(1)
    for name, value in columns.items():
        make = make.withColumn(name, F.array(*[F.lit(float(x)) for x in value]) if isinstance(value, list) else F.lit(value))
    return make


def value(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_cosine_and_its_guards(spark):
    df = one(spark, a=[1, 2, 3], b=[2, 4, 6], c=[3, 0, -1], z=[0, 0, 0], s=[1, 2])
    assert value(df, V.cosine("a", "b")) == pytest.approx(1.0)
    assert value(df, V.cosine("a", "c")) == pytest.approx(0.0)
    assert value(df, V.cosine("a", "z")) == 0.0
    assert value(df, V.cosine("a", "s")) == 0.0
    assert value(df, V.cosine("b", "c")) == value(df, V.cosine("c", "b"))


def test_quantize(spark):
    df = one(spark, v=[12.7, -12.7, 0], z=[0, 0, 0], w=[1000, -1000])
    got = value(df, V.quantize("v"))
    assert got["scale"] == pytest.approx(0.1)
    assert list(got["q"]) == [127, -127, 0]
    zero = value(df, V.quantize("z"))
    assert zero["scale"] == 1.0 and list(zero["q"]) == [0, 0, 0]
    assert list(value(df, V.quantize("w"))["q"]) == [127, -127]


def test_quantized_dot_is_near_the_true_one(spark):
    rng = np.random.default_rng(42)
    a, b = rng.uniform(-1, 1, 384).tolist(), rng.uniform(-1, 1, 384).tolist()
    df = one(spark, a=a, b=b).select("a", "b", V.quantize("a").alias("qa"), V.quantize("b").alias("qb"))
    got = value(df, V.dequantized_dot("qa.q", "qa.scale", "qb.q", "qb.scale"))
    assert got == pytest.approx(float(np.dot(a, b)), abs=0.05 * math.sqrt(np.dot(a, a) * np.dot(b, b)))


@pytest.mark.parametrize(("dim", "each", "stride"), [(768, 4, 3392), (768, 1, 1088), (384, 4, 1856), (384, 1, 704)])
def test_stride(spark, dim, each, stride):
    assert value(spark.range(1), V.node_stride(dim, 256, each)) == stride


def test_divergences(spark):
    df = one(spark, p=[0.5, 0.5], q=[1.0, 0.0], r=[0.0, 1.0])
    assert value(df, V.js_divergence("p", "p")) == pytest.approx(0.0, abs=1e-9)
    assert value(df, V.js_divergence("q", "r")) == pytest.approx(math.log(2), abs=1e-6)
    big = one(spark, v=[1000.0, 1000.0])
    assert value(big, V.softmax("v")) == pytest.approx([0.5, 0.5])


def test_padding_and_preview(spark):
    df = one(spark, v=[1, 2])
    assert value(df, V.padded("v", 4)) == [1.0, 2.0, 0.0, 0.0]
    assert value(df, V.preview("v")) == [1.0, 2.0]


@pytest.mark.parametrize("text", ["", "short", "A" * 200, "é" * 60, "a" + "é" * 60, "日本" * 40])
def test_byte_prefix(spark, text):
    got = value(one(spark, t=text), V.byte_prefix("t", 63))
    assert len(got.encode()) <= 63 and text.startswith(got)
    assert got == text or len(text[: len(got) + 1].encode()) > 63
