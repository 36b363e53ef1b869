import json
import random

import numpy as np
import pyarrow as pa

from pepspark.operators import nested as N

SCHEMA = """query_id bigint, note string, `table` string, search_hit array<struct<hit_rank:int,peptide:string,modified_peptide:string,calc_neutral_pep_mass:double,massdiff:double,num_tot_proteins:int,num_missed_cleavages:int,is_rejected:boolean,search_score:map<string,double>,
modification_info:struct<mod_nterm_mass:double,mod_cterm_mass:double,mod_aminoacid_mass:array<struct<mod_position:int,mass:double>>>,proteins:array<struct<protein:string,protein_descr:string,num_tol_term:int,peptide_prev_aa:string,peptide_next_aa:string>>>>"""


def hit(peptide, proteins=None, scores=None, mods=None):
    return (1, peptide, peptide, 1.5, None, 1, 0, False, scores, mods, proteins)


def protein(name):
    return (name, 'odd "descr" \\ [x] {y}, z: é', 2, "K", "-")


ROWS = [
    (1, "a", "t", [hit("PEPK", [protein("sp|A"), None, protein("sp|A")], {"x,corr": 1.0, "e:v": None}, (42.5, None, [(2, -17.9), None, (1, 57.02)])), None, hit(None, [], {}, (None, 0.98, []))]),
    (1, "a", "t", [hit("PEPK", [protein("sp|A"), None, protein("sp|A")], {"x,corr": 1.0, "e:v": None}, (42.5, None, [(2, -17.9), None, (1, 57.02)])), None, hit(None, [], {}, (None, 0.98, []))]),
    (2, None, None, None),
    (3, None, None, []),
    (4, None, None, [None]),
    (5, None, None, [hit("A", None, None, (None, 30.0, None))]),
]


def brute(rows):
    out = set()
    for q, _, _, hits in rows:
        for i, h in enumerate(hits or [], 1):
            if h is None:
                continue
            out.add((q, "hit", i, 0, h[1]))
            for k, p in enumerate(h[10] or [], 1):
                if p:
                    out.add((q, "protein", i, k, p[0]))
            for key in h[8] or {}:
                out.add((q, "score", i, 0, key))
            m = h[9]
            if m:
                if m[0] is not None:
                    out.add((q, "modification", i, 0, str(int(m[0]))))
                if m[1] is not None:
                    out.add((q, "modification", i, len(h[1]) + 1 if h[1] is not None else None, str(int(m[1]))))
                for x in m[2] or []:
                    if x:
                        out.add((q, "modification", i, x[0], str(int(x[1]))))
    return out


def test_children_against_brute_force(spark):
    got = N.search_hit_children(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(ROWS)))


def test_masses_that_are_no_numbers(spark):
    rows = [(1, None, None, [hit("AK", None, None, (float("nan"), float("inf"), [(1, 1e30)]))])]
    got = {tuple(r) for r in N.search_hit_children(spark.createDataFrame(rows, SCHEMA)).filter("child = 'modification'").collect()}
    assert got == {(1, "modification", 1, 0, None), (1, "modification", 1, 3, None), (1, "modification", 1, 1, None)}


def test_empty_table(spark):
    assert N.search_hit_children(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_link_to_parents(spark):
    t = N.search_hit_tables(spark.createDataFrame(ROWS, SCHEMA))
    hits = {(r.query_id, r.hit_no) for r in t["hit"].collect()}
    assert hits == {(1, 1), (1, 3), (5, 1)}
    p = t["protein"].collect()
    assert {(r.query_id, r.hit_no) for r in p} <= hits
    assert {r.protein_no for r in p} == {1, 3} and p[0].protein_descr == 'odd "descr" \\ [x] {y}, z: é'
    assert {(r.score_name, r.score) for r in t["score"].collect()} == {("x,corr", 1.0), ("e:v", None)}


def test_json_text_malformed_and_spaced(spark):
    texts = [(1, ' [ {"a" : [1, 2 ,{"b":"x"}], "c\\"d": null} ] '), (2, '[{"a":[1}]'), (3, '{"a":"unclosed}'), (4, "null"), (5, None), (6, ""), (7, '[{"a":[{"b":"y,[}"}]}]'), (8, "3"), (9, '"a,b"')]
    df = spark.createDataFrame(texts, "id int, j string")
    out = N.shred(df, ["id"], "j", [N.FlatTable("b", ("[]", "a", "[]"), (("b",),)), N.FlatTable("c", ("[]", "*"), (("$key",), ()), containers=False)]).collect()
    assert sorted((r.id, r.ord1, r.ord2, r.v1) for r in out if r.table == "b") == [(1, 1, 3, "x"), (7, 1, 1, "y,[}")]
    assert sorted((r.id, r.v1, r.v2) for r in out if r.table == "c") == sorted([(1, "a", None), (1, 'c"d', None), (7, "a", None)], key=str)


def test_index_against_json_module():
    rng = random.Random(3)

    def value(depth):
        k = rng.random()
        if depth > 4 or k < 0.3:
            return rng.choice([None, 1, -2.5, True, "", "a\"b\\", "[{]}:,", "é \n"])
        if k < 0.65:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["a", "b", "c,", "d\"", "e\\"]) + str(i): value(depth + 1) for i in range(rng.randint(0, 4))}

    records = [[value(0) for _ in range(rng.randint(0, 4))] for _ in range(300)]
    raws = [json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode() for r in records]
    buf = np.frombuffer(b"".join(raws), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    ix = N.StructuralIndex(buf, bounds)
    cur = ix.mark(ix.roots)
    slots = ix.step(cur, "[]")
    got = list(zip(ix.root_row[cur[ix.parent[slots]]].tolist(), ix.ordinal[slots].tolist(), ix.scalars(slots).to_pylist(), (ix.child[slots] >= 0).tolist()))
    want = []
    for i, r in enumerate(records):
        for k, v in enumerate(r, 1):
            box = isinstance(v, (list, dict))
            want.append((i, k, None if box or v is None else v if isinstance(v, str) else json.dumps(v), box))
    assert sorted(got, key=str) == sorted(want, key=str)
    members = ix.step(ix.mark(ix.child[slots]), "*")
    assert sorted(ix.key.take(pa.array(members)).to_pylist()) == sorted(k for r in records for v in r if isinstance(v, dict) for k in v)


def test_malformed_records_are_reported(spark):
    bad = {
        '[{"a":"C:\\x"}]': "escape", '[{"a":"\\u12g4"}]': "escape", '[{"a":"x\\u12"}]': "escape", '[{"a" 1}]': "syntax", '[{"a":1 2}]': "syntax", '[1 2]': "syntax", '[{"a":}]': "syntax",
        '[{a:1}]': "syntax", '[{"a":tru}]': "syntax", '[{"a":"x""y"}]': "syntax", '[1,]': "syntax", '[,1]': "syntax", '[{"a":1,}]': "syntax", '[{"a":1}}': "syntax", '["a":1]': "syntax", '[[1] 2]': "syntax",
        '[01]': "syntax", '[{"a":[1}]': "brackets", '{"a":"unclosed}': "quotes", "3": "no container", '"a"': "no container",
    }
    good = ['[{"a":"ok"}]', '[{"a":"tab\there \\" \\\\ \\u00e9 \\ud83d\\ude00 \\ud800 z"}]', "[]", "{}", ' [ ] ', '[{}]', '[{"a":-1.5e+3},{"a":null},[],[[]]]', "null", None, ""]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*bad, *good])], "id int, j string, v1 int")
    out = N.shred(df, ["id"], "j", [N.FlatTable("a", ("[]",), (("a",),))]).collect()
    assert {r.id: r.v1 for r in out if r.table == "malformed"} == {i: why for i, why in enumerate(bad.values())}
    n = len(bad)
    assert {(r.id - n, r.ord1, r.v1) for r in out if r.table == "a"} == {(0, 1, "ok"), (1, 1, 'tab\there " \\ é 😀 \ufffd z'), (5, 1, None), (6, 1, "-1.5e+3"), (6, 2, None), (6, 3, None), (6, 4, None)}
    assert N.shred(df, ["id"], "j", [N.FlatTable("a", ("[]",), (("a",),))], malformed=None).filter("table <> 'a'").count() == 0


def test_escapes_against_json_module():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "é", "€", "😀", "\\", '"', "/", "\n", "\t", "\b", "\u2028", "ÿ"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    raws = [json.dumps([t], ensure_ascii=rng.random() < 0.6).encode() for t in texts]
    buf, bounds = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    ix = N.StructuralIndex(buf, bounds)
    assert not ix.reason.any()
    assert ix.scalars(ix.step(ix.mark(ix.roots), "[]")).to_pylist() == texts


def test_analysis_and_reports(spark):
    t = N.search_hit_tables(spark.createDataFrame(ROWS, SCHEMA), ("hit",))
    assert set(t) == {"hit", "malformed"} and t["malformed"].count() == 0 and t["hit"].select("query_id", "hit_no").distinct().count() == 3
