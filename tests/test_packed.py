from pyspark.sql import functions as F

import pytest

from pepspark.operators import packed as P

CASES = {
    "2+ and 3+": [2, 3],
    "1+, 2+, and 3+": [1, 2, 3],
    "-1 | -2": [-1, -2],
    "1-:2-": [-1, -2],
    "2⁺/3⁻": [2, -3],
    "1− ; 2−": [-1, -2],
    "z=2;z=-3": [2, -3],
    "1.0 and 2.0": [1, 2],
    '"1+"; ""2+""': [1, 2],
    "”1+”/”2+”": [1, 2],
    "[1+，2+]": [1, 2],
    "1+||2+,": [1, 2],
    ", 2+, ,3+": [2, 3],
    "+1\n+1\t12": [1, 1, 12],
    "CHARGE=2+ and 3+": [2, 3],
    "3+ 1+ 10+": [3, 1, 10],
    "2+": [2],
    "0": [],
    "none": [],
    "-": [],
    "": [],
    "  ": [],
}


@pytest.mark.parametrize("broadcast", [None, True, False])
def test_unpack(spark, broadcast):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] + [(0, "2+ and 3+", "clash"), (99, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, charge string, skel string")
    got = {}
    for r in P.unpack_numbers(df, ["id"], "charge", broadcast=broadcast).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, (t, want) in enumerate(CASES.items()):
        assert got.get(i, []) == list(enumerate(want, 1)), t
    assert 99 not in got
    many = {r.id for r in P.unpack_numbers(df, ["id"], "charge", at_least=2).collect()}
    assert many == {i for i, w in enumerate(CASES.values()) if len(w) > 1}


def test_empty_long_and_huge(spark):
    df = spark.createDataFrame([(1, ", ".join(["2+"] * 5000)), (2, "9" * 30 + ", 3")], "id int, charge string")
    out = P.unpack_numbers(df, ["id"], "charge", at_least=2)
    assert out.filter("id = 1").count() == 5000
    assert [(r.pos, r.value) for r in out.filter("id = 2").orderBy("pos").collect()] == [(1, None), (2, 3)]
    assert P.unpack_numbers(df.limit(0), ["id"], "charge").count() == 0


def test_skeletons_are_few(spark):
    """Texts that differ in digits, letters, kinds of quotes and separators only share a skeleton."""
    texts = ["2+, 3+", "'14+' ; '3+'", "2⁺/ 5+", "“9+”|“8+”", "2+ and 3+", "2+ und 3+"]
    got = {r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.skeleton(F.col("t"))).collect()}
    assert got == {"9+,9+"}


def test_texts_with_quotes(spark):
    rows = {
        1: "a, b ;c|d", 2: '"x, y"; z', 3: "'it, is', \"so\"", 4: "", 5: None, 6: "  ", 7: ",,a,,", 8: "a", 9: 'say "hi", b', 10: '"open, b', 11: "a, a", 12: '"q""r", s', 13: "é b\tü", 14: '""; k',
    }
    df = spark.createDataFrame([(k, t, 0) for k, t in [*rows.items(), (1, rows[1])]], "id int, t string, pos int")
    want = {1: ["a", "b", "c", "d"], 2: ["x, y", "z"], 3: ["it, is", "so"], 7: ["a"], 8: ["a"], 9: ['say "hi"', "b"], 10: ['"open', "b"], 11: ["a", "a"], 12: ['q""r', "s"], 13: ["é b", "ü"], 14: ["k"]}
    for how in (True, False, None):
        got = P.unpack_texts(df, ["id"], "t", broadcast=how).collect()
        assert sorted((r.id, r.pos, r.value) for r in got) == sorted((k, i, v) for k, vs in want.items() for i, v in enumerate(vs, 1))
    assert {r.id for r in P.unpack_texts(df, ["id"], "t", at_least=2).collect()} == {1, 2, 3, 9, 10, 11, 12, 13}
    assert P.unpack_texts(df.limit(0), ["id"], "t").count() == 0
