"""Guards of the column functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from idmatch.functions import rules, signal, text
from idmatch.functions import vectors as V


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in inputs.items())
    return spark.createDataFrame([tuple(v for _, v in inputs.values())], schema).select(column.alias("r")).first()["r"]


VEC = "array<double>"


def test_vector_guards(spark):
    a, b = F.col("a"), F.col("b")
    zero = dict(a=(VEC, [0.0, 0.0]), b=(VEC, [1.0, 2.0]))
    assert value(spark, V.cosine(a, a), a=zero["a"]) == -1.0
    assert value(spark, V.l2_normalize(a), a=zero["a"]) == [0.0, 0.0]
    assert value(spark, V.sum_normalize(a), a=zero["a"]) == [0.0, 0.0]
    assert value(spark, V.l2_norm(a), a=zero["a"]) == pytest.approx(1e-6)
    assert value(spark, V.dot(a, b), a=(VEC, [1.0, 2.0, 9.0]), b=zero["b"]) == 5.0
    assert value(spark, V.euclidean(a, b), a=(VEC, [1.0, 5.0, 9.0]), b=zero["b"]) == 3.0
    assert value(spark, V.zscore_apply(a, b, b), a=(VEC, [1.0]), b=zero["b"]) is None
    assert value(spark, V.poly_expand(b), **zero) == [1.0, 2.0, 1.0, 4.0]
    assert value(spark, V.sanitize(a), a=(VEC, [math.nan, math.inf, -math.inf, 2.0])) == [0.0, 0.0, 0.0, 2.0]
    blocks = value(spark, V.root_l2_blocks(a, 2), a=(VEC, [1.0, 3.0, 0.0, 0.0]))
    assert blocks == pytest.approx([0.5, math.sqrt(0.75), math.sqrt(0.5), math.sqrt(0.5)], abs=1e-6)


def test_class_weight_is_clamped(spark):
    ratio = lambda n, p, **k: value(spark, V.class_weight(F.lit(float(n)), F.lit(float(p)), **k), x=("int", 1))
    assert ratio(4, 1) == 3.0
    assert ratio(1, 100) == 1.0
    assert ratio(10_000, 1) == 15.0
    assert ratio(1, 1, logarithmic=True) == pytest.approx(1.5 * math.log(2))


def test_soft_clip_and_tones(spark):
    x = F.col("x")
    clip = lambda v: value(spark, signal.soft_clip(x), x=("double", v))
    assert clip(0.5) == 0.5 and clip(1.0) == 1.0
    assert clip(2.0) == pytest.approx(1 - 0.1 * (1 - math.tanh(2))) and clip(-2.0) == -clip(2.0)
    tone = lambda c, v, n=None: value(spark, signal.tone_map(x, c, n), x=("double", v))
    assert tone("bright_p20", 250.0) == 255.0 and tone("bright_m20", 5.0) == 0.0
    assert tone("contrast_1p1", 138.0) == 139.0
    with pytest.raises(ValueError):
        signal.tone_map(x, "noise_p10")
    with pytest.raises(ValueError):
        signal.tone_map(x, "sepia")


def test_rules(spark):
    s1, s2 = F.col("s1"), F.col("s2")
    three = lambda a, b: value(spark, rules.accept_three_way(s1, s2), s1=("double", a), s2=("double", b))
    assert three(0.9, 0.9) and three(0.5, 0.2) and three(0.12, 0.05)
    assert not three(0.05, -1.0) and not three(0.5, 0.45)
    conf = lambda a, m, ok: value(spark, rules.confidence(s1, F.col("m"), F.lit(ok)), s1=("double", a), m=("double", m))
    assert conf(0.9, 0.1, True) == pytest.approx(0.952)
    assert conf(0.45, 0.1, True) == pytest.approx(0.825)
    assert conf(0.45, 3.0, True) == pytest.approx(0.825 * 1.05)
    assert conf(0.9, 0.1, False) == pytest.approx(0.4) and conf(-3.0, 0.0, False) == 0.0
    claim = lambda p, c, own: value(
        spark, rules.verify_claim(F.col("p"), F.col("c"), F.col("o"), F.lit(0.9), F.lit(0.5)), p=("long", p), c=("long", c), o=("double", own))
    assert claim(1, 1, 0.6) and not claim(1, 2, 0.6) and not claim(1, 1, 0.4) and not claim(-1, -1, 0.9)
    resolve = lambda r, e, s: value(spark, rules.resolve_threshold(F.col("r"), F.col("e"), F.col("s")), r=("double", r), e=("double", e), s=("double", s))
    assert [resolve(99.0, 1.0, 2.0), resolve(-1.0, 1.0, 2.0), resolve(None, 1.0, 2.0), resolve(None, None, 2.0), resolve(None, None, None)] == [10.0, 0.0, 1.0, 2.0, 0.5]
    assert value(spark, rules.collapse_flag(F.lit(98.0), F.lit(29.9)), x=("int", 1))


def test_text(spark):
    norm = lambda t: value(spark, text.normalize_text(F.col("t")), t=("string", t))
    assert norm("  Hóla,\t MUNDO  42! ") == "hla mundo 42"
    sim = lambda a, b: value(spark, text.text_similarity(F.col("a"), F.col("b")), a=("string", a), b=("string", b))
    assert sim("kitten", "sitting") == pytest.approx(1 - 3 / 7) and sim("", "") is None and sim("", "ab") == 0.0
    near = lambda a, b, l: value(spark, text.similar_at_least(F.col("a"), F.col("b"), l), a=("string", a), b=("string", b))
    assert near("abcd", "abcx", 0.75) and not near("abcd", "abcx", 0.76) and not near("a", "abcdef", 0.7)
    check = lambda f, t: value(spark, f(F.col("t")), t=("string", t))
    assert [check(text.is_int, t) for t in ("12", "-3", "+4", "1.5", "", "-", None)] == [True, True, True, False, False, False, False]
    assert [check(text.is_number, t) for t in ("12", "-3.5", ".5", "1.2.3", "x", "")] == [True, True, True, False, False, False]
    assert check(text.id_from_name, "042_a.jpg") == 42 and check(text.id_from_name, "x42") is None
    assert check(text.first_number, "spk 7 b8") == 7 and check(text.first_number, "none") == -1


def test_bounded_similarity_is_that_of_the_full_distance(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab c", k=draw.randrange(0, 14))) for _ in range(60)] + ["", "x" * 500, "x" * 499 + "y", "y" + "x" * 400]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts[::3]], "a string, b string")
    for level in (0.0, 0.2, text.LOGIN_SIMILARITY, text.STRICT_SIMILARITY, 1.0):
        full = text.text_similarity(F.col("a"), F.col("b")) >= level
        assert pairs.filter(~text.similar_at_least(F.col("a"), F.col("b"), level).eqNullSafe(full)).count() == 0
