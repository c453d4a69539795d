import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chalkline.functions import reply, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given_, want",
    [
        ("The Ocean warms", ["ocean", "warms"]),
        ("well-known sea_level", ["well-known", "sea_level"]),
        ("2nd x 3d a b", ["nd"]),
        ("x²y CO₂ ½cup", ["x²y", "co₂", "½cup"]),
        ("naïve Ströme", ["naïve", "ströme"]),
        ("", []),
        (None, []),
        ("ice ice ice", ["ice", "ice", "ice"]),
    ],
)
def test_tokens(spark, given_, want):
    assert one(spark, given_, text.tokens) == want


def test_stop_words_are_318_sorted_and_distinct():
    assert len(set(text.STOP_WORDS)) == len(text.STOP_WORDS) == 318 and list(text.STOP_WORDS) == sorted(text.STOP_WORDS)


def test_words_split_at_unicode_blanks(spark):
    assert one(spark, " a\u00a0b\u2028c\x1cd  ", text.words) == ["a", "b", "c", "d"]
    assert one(spark, " \t\n", text.words) == [] and one(spark, None, text.words) == []


@pytest.mark.parametrize(
    "given_, want",
    [
        ("as shown < cit. > , here", "as shown, here"),
        ("see <g r a p h i c s> below", "see below"),
        ("a § . § . § b", "a b"),
        ("x ====== y == z", "x y == z"),
        ("CO_2 stays ; yes", "CO_2 stays; yes"),
        ("", ""),
        (None, None),
    ],
)
def test_scrub(spark, given_, want):
    assert one(spark, given_, text.scrub) == want


PROSE = "We find that the flux of heat from the sea to the air is not what it was in the past, and that this can be seen in all of the records."
LIST = "Smith et al. 2001) Jones et al. 1999) Klein et al. 2003) Berg et al. 2004) Vol 3 Journal Ocean Science"


@pytest.mark.parametrize(
    "given_, want",
    [
        (PROSE, False),
        (PROSE + " doi doi doi doi et al et al et al et al", False),
        (LIST, True),
        ("doi:a doi:b", False),
        ("doi:a doi:b doi:c", True),
        ("Alpha et al Beta et al Gamma et al", False),
        ("12 34 56 word", True),
        ("12 34 word more", False),
        ("", False),
        (None, False),
    ],
)
def test_reference_like(spark, given_, want):
    assert one(spark, given_, text.reference_like) is want


def test_stop_fraction(spark):
    assert one(spark, "the of ocean heat", text.stop_fraction) == 0.5
    assert one(spark, "", text.stop_fraction) == 0.0 and one(spark, "123 !", text.stop_fraction) == 0.0


@pytest.mark.parametrize(
    "given_, want",
    [("Introduction", "intro"), ("Metadata", "methods"), ("RESULTS and Discussion", "results"), ("Main findings", "results"), ("Conclusions", "discussion"), ("Appendix", "other"), (None, "other"), ("Background data", "intro")],
)
def test_section_type(spark, given_, want):
    assert one(spark, given_, text.section_type) == want


def test_overlap(spark):
    df = spark.createDataFrame([("ocean heat heat", "the heat rises"), ("the of", "x"), (None, "ocean"), ("ocean", None)], "q string, c string")
    assert [r[0] for r in df.select(text.overlap(F.col("q"), F.col("c"))).collect()] == [0.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "given_, want",
    [
        ("plain", "plain"),
        (r"a\begin{document}b\end{document}c", "b"),
        (r"a\begin{document}b", "b"),
        (r"\begin{document}b\end{document}x\end{document}y", r"b\end{document}x"),
        (r"\end{document}a\begin{document}b", "b"),
        (None, None),
    ],
)
def test_tex_body(spark, given_, want):
    got = one(spark, given_, text.tex_body)
    assert got == want or (given_ or "").startswith(r"\end") and got == ""


@pytest.mark.parametrize("given_, want", [("0.4", 0.4), ("7", 1.0), ("-1", 0.0), ("x", 0.0), ("NaN", 0.0), (None, 0.0)])
def test_clip(spark, given_, want):
    assert one(spark, given_, text.clip01) == want


@pytest.mark.parametrize("given_, want", [(" Yes ", 1), ("relevant", 1), ("0", 0), ("No", 0), ("maybe", None), (None, None)])
def test_text_flag(spark, given_, want):
    assert one(spark, given_, text.text_flag) == want


def test_cache_key_is_sha1_and_takes_nulls(spark):
    import hashlib

    assert one(spark, "q", lambda c: text.cache_key("m", c)) == hashlib.sha1(b"m|q").hexdigest()
    assert one(spark, None, lambda c: text.cache_key("m", c)) == hashlib.sha1(b"m|").hexdigest()


@pytest.mark.parametrize(
    "given_, want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n[1, 2]\n``` done', [1, 2]),
        ('first {"a": 1} then {"b": 2}', {"b": 2}),
        ('{"a": {"b": [3]}}', {"a": {"b": [3]}}),
        (r'{"a": "x \" } y"}', {"a": 'x " } y'}),
        (r'{"a": "C:\\"} tail', {"a": "C:\\"}),
        ('\\frac{a}{b} {"a": 1', None),
        ("{} []", None),
        ("none", None),
        ("", None),
        (None, None),
        ('{"score": 0.5} and {broken', {"score": 0.5}),
    ],
)
def test_last_json(given_, want):
    assert reply.last_json(given_) == want


@given(st.recursive(st.integers() | st.text() | st.booleans(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)).filter(lambda v: isinstance(v, (list, dict)) and v))
def test_last_json_finds_any_value_in_prose(value):
    import json

    assert reply.last_json("It is } so: " + json.dumps(value) + " [ end") == value


@pytest.mark.parametrize(
    "given_, want",
    [(True, 1), (0, 0), (0.5, 1), ("YES", 1), ("irrelevant", 0), ("?", None), ({"verdict": {"score": 0}}, 0), ({"x": 1}, None), ([1], None), (None, None)],
)
def test_flag_of(given_, want):
    assert reply.flag_of(given_) == want


def test_flags_of():
    assert reply.flags_of({"relevant": [1, "no", "?"]}) == [1, 0]
    assert reply.flags_of({"a": "b", "c": [True]}) == [1]
    assert reply.flags_of([]) is None and reply.flags_of({}) is None and reply.flags_of("x") is None and reply.flags_of(["?"]) is None


def test_ranking_of():
    assert reply.ranking_of('[{"index": 2, "score": 1}, {"index": 9, "score": 1}, {"index": 2, "score": 0}, {"index": 0}, 5]', 4) == [(2, 1.0), (0, 0.0), (1, 0.0), (3, 0.0)]
    assert reply.ranking_of("nonsense", 3) == [(0, 0.0), (1, 0.0), (2, 0.0)] and reply.ranking_of(None, 0) == []


def test_blank_class_matches_python():
    pattern = re.compile(r"[\t-\r\x1c-\x1f\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    assert all(bool(pattern.match(chr(i))) == chr(i).isspace() for i in range(0x11000) if not 0xD800 <= i < 0xE000)
