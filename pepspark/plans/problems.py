"""Queries p1 and p3 to p5 on the domain tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.operators import nested, orphans, packed, units
from pepspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.search_hit_children(table(spark, d, "psms"))


def p1_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = nested.search_hit_tables(table(spark, d, "psms"), ("hit",))["hit"].distinct()
    return hits.select("query_id", "hit_no", "hit_rank", "peptide", "modified_peptide", "num_tot_proteins", "num_missed_cleavages", "is_rejected", *[F.round(c, 6).alias(c) for c in ("calc_neutral_pep_mass", "massdiff", "mod_nterm_mass", "mod_cterm_mass")])


def p1_proteins(spark: SparkSession, d: str) -> DataFrame:
    return nested.search_hit_tables(table(spark, d, "psms"), ("protein",))["protein"].distinct()


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return nested.search_hit_tables(table(spark, d, "psms"), ("score",))["score"].distinct()


def p1_modifications(spark: SparkSession, d: str) -> DataFrame:
    return nested.search_hit_tables(table(spark, d, "psms"), ("modification",))["modification"].distinct()


def p1_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Analyses with the probabilities of their list below them (ntt_no 0: the analysis itself)."""
    t = nested.search_hit_tables(table(spark, d, "psms"), ("analysis", "ntt"))
    own = t["analysis"].select("query_id", "hit_no", "analysis_no", F.lit(0).alias("ntt_no"), "analysis", "probability")
    return own.unionByName(t["ntt"].withColumn("analysis", F.lit(None).cast("string"))).distinct()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    targets = [orphans.Target(n, table(spark, d, n)) for n in ("unimod_modification", "unimod_position", "unimod_classification")]
    references = [
        orphans.Reference("unimod_specificity", table(spark, d, "unimod_specificity"), {"modification_id": "unimod_modification", "position_id": "unimod_position", "classification_id": "unimod_classification"}),
        orphans.Reference("unimod_alt_name", table(spark, d, "unimod_alt_name"), {"modification_id": "unimod_modification"}),
    ]
    return orphans.orphan_references(targets, references)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_monthly(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = packed.unpack_numbers(table(spark, d, "spectra"), ["spectrum_id"], "charge", at_least=2)
    return out.select("spectrum_id", F.col("pos").cast("int").alias("pos"), F.col("value").try_cast("int").alias("charge"))


def p4_charges(spark: SparkSession, d: str) -> DataFrame:
    """All charges, those of fields with a single one too."""
    out = packed.unpack_numbers(table(spark, d, "spectra"), ["spectrum_id"], "charge")
    return out.select("spectrum_id", F.col("pos").cast("int").alias("pos"), F.col("value").try_cast("int").alias("charge"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.converted_values(table(spark, d, "cv_params"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the quantities with its value in the common unit and where the unit came from."""
    return units.harmonize_units(table(spark, d, "cv_params")).select("param_id", "quantity", "unit", "unit_origin", F.round("value_milli", 3).alias("value_milli"))


_HITS = """
hits as (select query_id, generate_subscripts(search_hit, 1) as hit_no, unnest(search_hit) as h from psms),
live as (select query_id, hit_no, h from hits where h is not null),
prot as (select query_id, hit_no, generate_subscripts(h.proteins, 1) as protein_no, unnest(h.proteins) as p from live),
mods as (select query_id, hit_no, unnest(h.modification_info.mod_aminoacid_mass) as m from live)"""

_P1 = f"""with {_HITS}
select distinct * from (
 select query_id, 'hit' as child, hit_no::int as hit_no, 0::int as child_no, h.peptide as child_label from live
 union all select query_id, 'protein', hit_no::int, protein_no::int, p.protein from prot where p is not null
 union all select query_id, 'score', hit_no::int, 0::int, unnest(map_keys(h.search_score)) from live
 union all select query_id, 'modification', hit_no::int, m.mod_position::int, trunc(m.mass)::bigint::varchar from mods where m is not null
 union all select query_id, 'modification', hit_no::int, 0::int, trunc(h.modification_info.mod_nterm_mass)::bigint::varchar from live where h.modification_info.mod_nterm_mass is not null
 union all select query_id, 'modification', hit_no::int, (length(h.peptide) + 1)::int, trunc(h.modification_info.mod_cterm_mass)::bigint::varchar from live where h.modification_info.mod_cterm_mass is not null)"""

_P1_HITS = f"""with {_HITS}
select distinct query_id, hit_no::int as hit_no, h.hit_rank as hit_rank, h.peptide as peptide, h.modified_peptide as modified_peptide, h.num_tot_proteins as num_tot_proteins, h.num_missed_cleavages as num_missed_cleavages, h.is_rejected as is_rejected,
 round(h.calc_neutral_pep_mass, 6) as calc_neutral_pep_mass, round(h.massdiff, 6) as massdiff, round(h.modification_info.mod_nterm_mass, 6) as mod_nterm_mass, round(h.modification_info.mod_cterm_mass, 6) as mod_cterm_mass from live"""

_P1_PROTEINS = f"""with {_HITS}
select distinct query_id, hit_no::int as hit_no, protein_no::int as protein_no, p.protein as protein, p.protein_descr as protein_descr, p.num_tol_term as num_tol_term, p.peptide_prev_aa as peptide_prev_aa, p.peptide_next_aa as peptide_next_aa from prot where p is not null"""

_P1_SCORES = f"""with {_HITS}, s as (select query_id, hit_no, unnest(map_entries(h.search_score)) as e from live) select distinct query_id, hit_no::int as hit_no, e.key as score_name, e.value as score from s"""
_P1_MODIFICATIONS = f"""with {_HITS}, n as (select query_id, hit_no, generate_subscripts(h.modification_info.mod_aminoacid_mass, 1) as k, unnest(h.modification_info.mod_aminoacid_mass) as m from live)
select distinct query_id, hit_no::int as hit_no, k::int as modification_no, m.mod_position as mod_position, m.mass as mass from n where m is not null"""
_P1_ANALYSIS = f"""with {_HITS}, a as (select query_id, hit_no, generate_subscripts(h.analysis_result, 1) as k, unnest(h.analysis_result) as a from live), b as (select * from a where a is not null)
select query_id, hit_no::int as hit_no, k::int as analysis_no, 0::int as ntt_no, a.analysis as analysis, a.probability as probability from b
union select query_id, hit_no::int, k::int, generate_subscripts(a.all_ntt_prob, 1)::int, null, unnest(a.all_ntt_prob) from b"""


def _p3(select: str) -> str:
    refs = " union all ".join(
        f"select '{t}' as src_table, id as row_id, '{f}' as ref_field, {f} as key, recorded_at as ts, '{p}' as target from {t} where {f} is not null"
        for t, f, p in (
            ("unimod_specificity", "modification_id", "unimod_modification"),
            ("unimod_specificity", "position_id", "unimod_position"),
            ("unimod_specificity", "classification_id", "unimod_classification"),
            ("unimod_alt_name", "modification_id", "unimod_modification"),
        )
    )
    lives = " union all ".join(f"select '{p}' as target, id as key, recorded_at as born, deleted_at as died from {p}" for p in ("unimod_modification", "unimod_position", "unimod_classification"))
    return f"""with r as ({refs}), l as ({lives}),
s as (select r.src_table, r.row_id, r.ref_field, r.ts, count(l.key) as n, coalesce(bool_or(l.born <= r.ts and (l.died is null or l.died > r.ts)), false) as alive, coalesce(bool_and(coalesce(l.born > r.ts, false)), false) as late
 from r left join l on r.target = l.target and r.key = l.key group by r.src_table, r.row_id, r.ref_field, r.ts, r.key),
f as (select distinct src_table, row_id, ref_field, strftime(ts, '%Y-%m') as ref_month, case when n = 0 then 'missing' when late then 'late' else 'deleted' end as orphan_kind from s where not alive and (n = 0 or ts is not null))
{select}"""


def _p4(at_least: int) -> str:
    # an optional letter prefix, a sign before or after, a decimal part; then the pieces that hold a number other than zero
    return f"""with s as (select distinct spectrum_id, charge from spectra where charge is not null),
p as (select spectrum_id, charge, regexp_extract_all(translate(charge, '−⁻⁺', '--+'), '[-+]?[0-9]+(?:\\.[0-9]+)?[-+]?') as pieces from s),
v as (select spectrum_id, charge, list_filter(pieces, lambda x: regexp_extract(x, '[0-9]+')::bigint > 0) as pieces from p),
u as (select spectrum_id, generate_subscripts(pieces, 1) as pos, unnest(pieces) as x from v where len(pieces) >= {at_least})
select spectrum_id, pos::int as pos, (regexp_extract(x, '[0-9]+')::int * case when x[1] = '-' or (x[1] <> '+' and x[-1] = '-') then -1 else 1 end)::int as charge from u"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{float(x)!r}::double" for x in r) + ")" for r in rows)


def _p5(select: str) -> str:
    by = {u: (d, float(n), float(m)) for u, d, _, n, m, _ in units.UNITS}
    aliases = _values([(a, u, d, s, n, m) for u, d, s, n, m, names in units.UNITS for a in names])
    quantities = _values([(a, q, u, *by[u]) for a, q, u in units.QUANTITIES])
    lit = lambda p: "'" + p.replace("'", "''") + "'"
    cased = ", ".join(f"'{x}'" for x in units._CASED)
    num = lambda p, k: f"try_cast(replace(regexp_extract(v, {lit(p)}, {k}), ',', '.') as double)"
    compound = " ".join(f"when regexp_matches(v, {lit(p)}) then coalesce({num(p, 1)}, 0) * 3600 + coalesce({num(p, 2)}, 0) * 60 + coalesce({num(p, 3)}, 0)" for p in (units.DURATION, "(?i)" + units.COMPOSITE, units.CLOCK))
    return f"""with a(alias, unit, dimension, shift, num, den) as (values {aliases}),
q(acc, quantity, common_unit, q_dimension, q_num, q_den) as (values {quantities}),
r as (select *, translate(param_value, '−–', '--') as v from cv_params join q on upper(trim(accession)) = q.acc),
x as (select *, case when q_dimension <> 'time' or not regexp_matches(v, '[0-9].*[0-9]') or not regexp_matches(v, '[A-Za-z:'']') then null {compound} end as compound,
 case when lower(trim(v)) in ('nan', 'inf', '-inf') then null else try_cast(replace(regexp_extract(v, {lit("(" + units.NUMBER + ")")}, 1), ',', '.') as double) end as plain,
 coalesce(nullif(trim(unit_accession), ''), nullif(trim(unit_name), '')) as f,
 coalesce(nullif(regexp_extract(v, {lit(units.UNIT_IN_VALUE)}, 1), ''), nullif(regexp_extract(param_name, {lit(units.UNIT_IN_NAME)}, 1), '')) as t from r),
y as (select *, regexp_replace(regexp_replace(trim(replace(f, 'μ', 'µ')), '[.\\s]+$', ''), '\\s+', ' ', 'g') as fu, regexp_replace(regexp_replace(trim(replace(t, 'μ', 'µ')), '[.\\s]+$', ''), '\\s+', ' ', 'g') as tu from x),
z as (select *, case when fu in ({cased}) then fu else nullif(lower(fu), '') end as f_unit, case when tu in ({cased}) then tu else nullif(lower(tu), '') end as t_unit from y),
o as (select *, case when compound is not null then 's' else coalesce(f_unit, t_unit) end as own from z),
n as (select source, quantity, own, count(*) as n from o where own is not null and compound is null group by all),
m as (select source, quantity, own as usual from n qualify row_number() over (partition by source, quantity order by n desc, own) = 1),
w as (select o.*, usual, case when own is null then case when usual is not null then 'default' end when compound is null and f_unit is not null then 'field' else 'text' end as unit_origin
 from o left join m on o.source is not distinct from m.source and o.quantity = m.quantity)
{select}"""


_MILLI = "case when a.dimension = w.q_dimension then (coalesce(w.compound, w.plain) + a.shift) * (a.num * w.q_den * 1000) / (a.den * w.q_num) end"
_P5_FOUND = _p5(
    f"select distinct param_id, round(round({_MILLI}, 5))::bigint as value_milli from w join a on w.own = a.alias where {_MILLI} is not null and (w.compound is not null or a.unit <> w.common_unit)"
)
_P5_VALUES = _p5(f"select param_id, quantity, a.unit as unit, unit_origin, round({_MILLI}, 3) as value_milli from w left join a on coalesce(w.own, w.usual) = a.alias")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_hits, p1_proteins, p1_scores, p1_modifications, p1_analysis, p3_found, p3_monthly, p4_found, p4_charges, p5_found, p5_values)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_hits": _P1_HITS,
        "p1_proteins": _P1_PROTEINS,
        "p1_scores": _P1_SCORES,
        "p1_modifications": _P1_MODIFICATIONS,
        "p1_analysis": _P1_ANALYSIS,
        "p3_found": _p3("select * from f"),
        "p3_monthly": _p3("select src_table, ref_field, ref_month, orphan_kind, count(*) as n_orphans from f group by all"),
        "p4_found": _p4(2),
        "p4_charges": _p4(1),
        "p5_found": _P5_FOUND,
        "p5_values": _P5_VALUES,
    }
