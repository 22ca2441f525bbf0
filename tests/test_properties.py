"""Property tests: Spark line splitting equals Python's, and literal prefilters are sound."""

import re

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from strata.functions.regex_literal import ascii_lower, required_literals
from strata.functions.text import split_lines

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
text_st = st.lists(st.one_of(st.sampled_from(BREAKS), st.text(alphabet="ab é", max_size=4)), max_size=12).map("".join)


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(text_st, min_size=40, max_size=40))
def test_split_lines_equals_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(split_lines("t")).collect()]
    assert got == [t.splitlines() for t in texts]


ATOMS = ["a", "b", "ab", r"\.", "[ab]", r"\d", ".", "(a|b)", "(ab)?", "x", "(?:ab|ba|aa)", "(?i:aB)", r"\b", "(?=a)", "(?!b)", "(?>ab)", "(ab|b.|)", "k"]
QUANTS = ["", "", "", "?", "*", "+", "{2}", "{0,1}", "{1,3}"]
pattern_st = st.lists(st.tuples(st.sampled_from(ATOMS), st.sampled_from(QUANTS)), min_size=1, max_size=5).map(
    lambda parts: "".join(a + q for a, q in parts))


@settings(max_examples=1500, deadline=None)
@given(pattern_st, st.text(alphabet="abABx.1 kK\u212a", max_size=20), st.sampled_from([0, re.ASCII, re.IGNORECASE, re.IGNORECASE | re.ASCII]))
def test_required_literals_are_sound(pattern, text, flags):
    try:
        found = re.search(pattern, text, flags)
    except re.error:  # a repeated anchor
        return
    literals = required_literals(pattern, flags)
    if literals is not None and found:
        assert any(x in ascii_lower(found.group(0)) or x in ascii_lower(text) for x in literals)
