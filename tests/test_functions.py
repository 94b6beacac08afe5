import math
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import stats, text, vectors, worldtime
from lorekeep.plans import queryplan, regexplan


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_fold_keys_of_case_pairs(spark):
    pairs = [("İstanbul", "istanbul"), ("ISPARTA", "ısparta"), ("Kelvin 5K", "5k"), ("Café", "CAFÉ")]
    for a, b in pairs:
        found = one(spark, text.icontains(F.lit(a), b))[0]
        assert found == bool(re.search(re.escape(text.fold(b)), text.fold(a))), (a, b)
    assert one(spark, text.icontains(F.lit(None).cast("string"), "x"))[0] is False


def test_fold_key_agrees_with_ignorecase():
    for c in [*range(0x250), *range(0x370, 0x400), 0x1E9E, 0x212A, 0x17F, 0x130, 0x131]:
        a, b = chr(c), chr(c).lower()[:1]
        assert (text.fold(a) == text.fold(b)) == bool(re.fullmatch(re.escape(a), b, re.IGNORECASE)) or a != text.unicodedata.normalize("NFC", a)


def test_pieces_of_text(spark):
    assert one(spark, text.cjk_pairs(F.lit("物理学 ab")), text.grams(F.lit("ab")), text.grams(F.lit("abcd"))) == (["物理", "理学"], [], ["abc", "bcd"])
    assert one(spark, text.slug(F.lit(" A b--C!")), text.pointer(F.lit("a/b~c")), text.canonical_json(F.lit('{"b": 1, "a": "é"}'))) == ("a-b-c", "a~1b~0c", '{"a":"é","b":1}')
    assert one(spark, text.regexp(F.lit("Strá"), "á$"), text.hidden(F.lit("zh-tw"), F.lit("zh")), text.valid_scoped(F.lit("m49/-1"))) == (True, True, False)


def test_known_statistics(spark):
    low, high = one(spark, *stats.wilson(F.lit(0.5), F.lit(100)))
    assert low == pytest.approx(0.4038, abs=1e-4) and high == pytest.approx(0.5962, abs=1e-4)
    assert one(spark, *stats.wilson(F.lit(0.0), F.lit(10)))[1] == pytest.approx(0.2775, abs=1e-4)
    assert one(spark, *stats.wilson(F.lit(0.5), F.lit(0))) == (0.0, 1.0)
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,)], "v double")
    assert stats.gini(df, "v").first()[0] == pytest.approx(0.75)
    pair = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "p double, q double")
    assert pair.agg(stats.jsd(F.col("p"), F.col("q")), stats.jsd(F.col("p"), F.col("p"))).first()[:] == (1.0, 0.0)
    assert pair.agg(stats.entropy(F.col("p"))).first()[0] == 0
    assert vectors and math.isclose(one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))[0], 0.5**0.5)


def test_days(spark):
    g, j = worldtime.jdn_gregorian, worldtime.jdn_julian
    n = lambda *v: [F.lit(x) for x in v]
    assert one(spark, g(*n(2000, 1, 1)), g(*n(1582, 10, 15)), j(*n(1582, 10, 5)), j(*n(-4712, 1, 1))) == (2451545, 2299161, 2299161, 0)

    def bounds(time, precision, julian):
        y, m, d = worldtime.time_parts(F.lit(time))
        return one(spark, *worldtime.day_bounds(y, m, d, F.lit(precision), F.lit(julian)))

    assert bounds("+1500-00-00T00:00:00Z", 9, True) == (2268933, 2269298)
    assert bounds("+1500-00-00T00:00:00Z", 9, False) == (2268924, 2269288)
    assert bounds("-13798000000-00-00T00:00:00Z", 3, False) == (None, None)
    spans = one(spark, *worldtime.year_span(F.lit(1850), F.lit(7)), *worldtime.year_span(F.lit(-43), F.lit(7)), *worldtime.year_span(F.lit(1855), F.lit(8)))
    assert spans == (1801, 1900, -99, 0, 1850, 1859)


def test_regex_conditions():
    assert regexplan.needs("abc?d") == ("any", ("abcd", "abd"))
    assert regexplan.needs("a.*b") is None and regexplan.needs("ab") is None and regexplan.needs("(unclosed") is None
    assert regexplan.needs("(?i)HELLO") == "hello"


def test_regex_conditions_lose_nothing():
    import random

    rng = random.Random(20)
    texts = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(0, 60))) for _ in range(300)]

    def holds(n, key):
        return n is None or (n in key if isinstance(n, str) else (all if n[0] == "all" else any)(holds(x, key) for x in n[1]))

    for _ in range(300):
        a, b, c = ("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(3))
        pattern = rng.choice([f"{a}{b}?{c}", f"({a}|{b}){c}", f"{a}.{{0,5}}{b}", f"(?:{a})+{b}", f"{a}[bcd]{c}*", f"(?i){a.upper()}\\w*{b}", f"({a}{b}|{c}.)x?"])
        need = regexplan.needs(pattern)
        assert all(holds(need, text.fold(t)) for t in texts if re.search(pattern, t)), pattern


def test_queries_parse():
    node, note = queryplan.parse('alpha "beta gamma" OR del* NOT NEAR(x y, 3)')
    assert note is None and node.kind == "or"
    node, note = queryplan.parse("what's (this")
    assert note and node.kind == "and"
    with pytest.raises(ValueError):
        queryplan.parse("***")
