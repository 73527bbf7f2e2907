import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.operators.packed import explode_packed, profile_lists, split_array


def split(values, style="list"):
    parent, no, items = split_array(pa.array(values, pa.string()), style)
    out = [[] for _ in values]
    for p, n, i in zip(parent, no, items.to_pylist()):
        out[p].append(i)
        assert len(out[p]) == n
    return out


@pytest.mark.parametrize(
    "text,items",
    [
        ("a; b;;c", ["a", "b", "c"]),
        ('"x, y", "z"', ["x, y", "z"]),
        ('["A/B testing", "say \\"hi\\"", "w\\u00e9"]', ["A/B testing", 'say "hi"', "wé"]),
        ("• a\n• b\n", ["a", "b"]),
        ('1. p\n2. "law, maritime"\n10. q', ["p", "law, maritime", "q"]),
        ("a | | b |", ["a", "b"]),
        ("a / / b /", ["a", "b"]),
        ("PL/SQL, UI/UX", ["PL/SQL", "UI/UX"]),
        ('"models ""from scratch""";y', ['models "from scratch"', "y"]),
        ("a · b · · c", ["a", "b", "c"]),
        ('5" pipe, x', ['5" pipe', "x"]),
        ("Müller; Ørsted · Ł", ["Müller", "Ørsted", "Ł"]),
        (None, []),
        ("", []),
        (" \n ", []),
    ],
)
def test_lists(text, items):
    assert split([text]) == [items]


@pytest.mark.parametrize(
    "text,items",
    [
        ('"A, B (1-2)","C @ D"', ["A, B (1-2)", "C @ D"]),
        ("A, B, Ltd., 1994|Senior @ C", ["A, B, Ltd., 1994", "Senior @ C"]),
        ("a, b // // c, d //", ["a, b", "c, d"]),
        ("2001-2003 X • Y, Z", ["2001-2003 X", "Y, Z"]),
        ("1) 2004-2009 S, T\n2) U", ["2004-2009 S, T", "U"]),
        ("C/D / E", ["C/D / E"]),
    ],
)
def test_entries(text, items):
    assert split([text], "entries") == [items]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab é1-", min_size=1, max_size=6).map(str.strip).filter(lambda s: s and not re.match(r"(\d+[.)]|[-*])\s", s) and not s.startswith("-")), max_size=5), min_size=1, max_size=6), st.sampled_from(["; ", " | ", "\n", ", ", " · ", " / "]))
def test_round_trip(rows, sep):
    assert split([sep.join(r) for r in rows]) == [[re.sub(r"^$", "", x) for x in r] for r in rows]


def test_long_text_and_neighbours():
    big = ";".join(f"v{i}" for i in range(20_000))
    got = split([None, big, "z"])
    assert got[0] == [] and len(got[1]) == 20_000 and got[2] == ["z"]


def test_frames(spark):
    df = spark.createDataFrame([("p", 1, "a;b", "x"), ("q", 2, None, "y")], "person_id string, item_no int, v string, item string")
    rows = explode_packed(df, ["person_id"], "v").orderBy("person_id", "item_no").collect()
    assert [tuple(r) for r in rows] == [("p", 1, "a"), ("p", 2, "b")]
    assert explode_packed(df.limit(0), ["person_id"], "v").count() == 0


def test_repeated_people_count_once(spark):
    rows = [("p", "a;b", None, ""), ("p", "a;b", None, ""), (None, "z", None, None)]
    df = spark.createDataFrame(rows, "person_id string, skills string, experience_history string, education_history string")
    assert [tuple(r) for r in profile_lists(df).orderBy("item_no").collect()] == [("p", "skills", 1, "a"), ("p", "skills", 2, "b")]
