from datetime import datetime as D

import pepspark.operators.orphans as O

PARENT = "id bigint, recorded_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
CHILD = "id bigint, mod_id bigint, pos_id bigint, recorded_at timestamp_ntz, extra string"
P = [(1, D(2020, 1, 1), None, "x"), (1, D(2020, 1, 1), None, "x"), (2, D(2020, 1, 1), D(2020, 6, 1), "x"), (2, D(2021, 1, 1), None, "y"), (3, D(2022, 1, 1), None, "z"), (4, None, None, "n")]


def brute(parents, children, fields):
    out = set()
    for c in children:
        row = dict(zip(("id", "mod_id", "pos_id", "at"), c))
        for f, t in fields.items():
            k = row[f]
            if k is None:
                continue
            lives = [p for p in parents[t] if p[0] == k]
            at = row["at"]
            if not lives:
                kind = "missing"
            elif at is None or any(p[1] is not None and p[1] <= at and (p[2] is None or p[2] > at) for p in lives):
                continue
            else:
                kind = "late" if all(p[1] is not None and p[1] > at for p in lives) else "deleted"
            out.add(("child", row["id"], f, at.strftime("%Y-%m") if at else None, kind))
    return out


CHILDREN = [(10, 1, 7, D(2020, 5, 1), "e"), (10, 1, 7, D(2020, 5, 1), "e"), (11, 2, None, D(2020, 6, 1), "e"), (12, 2, 1, D(2021, 1, 1), "e"), (13, 3, 1, D(2021, 12, 31), "e"), (14, 9, 1, D(2019, 1, 1), "e"), (15, None, None, D(2020, 1, 1), "e"), (16, 1, 1, None, "e"), (17, 8, 1, None, "e"), (18, 4, 1, D(2020, 1, 1), "e"), (19, 1, 1, D(2019, 12, 31), "e")]
FIELDS = {"mod_id": "mod", "pos_id": "pos"}


def run(spark, children=CHILDREN, parents=P):
    pos = spark.createDataFrame([(1, D(2000, 1, 1), None, "")], PARENT)
    refs = [O.Reference("child", spark.createDataFrame(children, CHILD), FIELDS)]
    return O.orphan_references([O.Target("mod", spark.createDataFrame(parents, PARENT)), O.Target("pos", pos)], refs)


def test_against_brute_force(spark):
    got = [tuple(r) for r in run(spark).collect()]
    want = brute({"mod": P, "pos": [(1, D(2000, 1, 1), None)]}, [c[:4] for c in CHILDREN], FIELDS)
    assert len(got) == len(set(got)) and set(got) == want


def test_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_KEY", 50)
    children = [(i, 99, 1, D(2020, 1, 1), "") for i in range(400)] + CHILDREN
    got = {tuple(r) for r in run(spark, children).collect()}
    assert got == brute({"mod": P, "pos": [(1, D(2000, 1, 1), None)]}, [c[:4] for c in children], FIELDS)


def test_empty_tables(spark):
    assert run(spark, []).count() == 0
    assert {r.orphan_kind for r in run(spark, CHILDREN, []).filter("ref_field = 'mod_id'").collect()} == {"missing"}


def test_report(spark):
    r = O.orphan_report(run(spark))
    assert sum(x.n_orphans for x in r.collect()) == run(spark).count()


def test_keys_that_are_texts(spark, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(O, "HOT_KEY", 1)
    parents = spark.createDataFrame([("a1", D(2020, 1, 1), None)], "id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame([(1, "a1", D(2020, 2, 1)), (2, "b?", D(2020, 2, 1)), (3, "b?", D(2020, 3, 1)), (4, None, D(2020, 3, 1)), (5, "a1", D(2019, 1, 1))], "id bigint, ref string, recorded_at timestamp_ntz")
    got = {tuple(r) for r in O.orphan_references([O.Target("t", parents)], [O.Reference("r", refs, {"ref": "t"})]).collect()}
    assert got == {("r", 2, "ref", "2020-02", "missing"), ("r", 3, "ref", "2020-03", "missing"), ("r", 5, "ref", "2019-01", "late")}
