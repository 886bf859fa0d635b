import pytest
from pyspark.sql import functions as F

from waymill.functions.tags import StringMatcher, read_expressions, string_matcher, tag_filter, tag_matcher


@pytest.mark.parametrize(
    ("text", "kind", "words"),
    [
        ("road", "equal", ("road",)),
        ("", "equal", ("",)),
        ("   ", "equal", ("",)),
        (" road ", "equal", ("road",)),
        ("ro*ad", "equal", ("ro*ad",)),
        ("*", "any", ()),
        (" * ", "any", ()),
        ("road*", "prefix", ("road",)),
        ("*road", "substring", ("road",)),
        ("*road*", "substring", ("road",)),
        ("*a,b", "substring", ("a,b",)),
        ("a, b ,c*,d", "list", ("a", "b", "c*", "d")),
        ("\troad", "equal", ("\troad",)),
    ],
)
def test_string_matcher(text, kind, words):
    assert string_matcher(text) == StringMatcher(kind, words)


@pytest.mark.parametrize(
    ("expression", "key", "value", "expected"),
    [
        ("road", "road", "x", True),
        ("road=x", "road", "x", True),
        ("road=x", "road", "y", False),
        ("road!=x", "road", "y", True),
        ("road!=x", "road", "x", False),
        ("road!=x", "path", "y", False),
        ("road=a,b", "road", "b", True),
        ("a,b", "b", "anything", True),
        ("addr:*", "addr:city", "x", True),
        ("addr:*", "addr", "x", False),
        ("*=*in*", "k", "pining", True),
        ("k=", "k", "", True),
        ("k==", "k", "=", True),
    ],
)
def test_tag_matcher(spark, expression, key, value, expected):
    tag = F.struct(F.lit(key).alias("k"), F.lit(value).alias("v"))
    assert spark.range(1).select(tag_matcher(expression).matches(tag)).first()[0] is expected


def test_tag_filter_types():
    assert tag_filter("road").types == frozenset("nwr")
    assert tag_filter("/road").types == frozenset("nwr")
    assert tag_filter("wa/road").types == frozenset("wa")
    assert tag_filter("n/a/b").matcher == tag_matcher("a/b")
    with pytest.raises(ValueError):
        tag_filter("x/road")


def test_expression_lines():
    assert read_expressions(["w/road\r\n", "# remark\n", "\n", "n/place # remark\n"]) == ["w/road", "n/place "]
