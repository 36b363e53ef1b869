"""Queries of the library's own operators over the domain tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark import constants as K
from pepspark.functions import arrays as A
from pepspark.functions import chem as C
from pepspark.functions import mass as M
from pepspark.functions import proforma as P
from pepspark.functions import seq as S
from pepspark.functions import text as X
from pepspark.operators import access, forms, joins, regress, tda
from pepspark.session import table
from pepspark.sources import text as TXT

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


# --- adapters: the same rows in Spark and in SQL


def peptides(spark: SparkSession, d: str) -> DataFrame:
    """Distinct peptides of the search hits."""
    h = table(spark, d, "psms").select(F.explode("search_hit").alias("h")).select(F.col("h.peptide").alias("peptide"))
    return h.filter("peptide is not null and peptide <> ''").distinct()


def proteins(spark: SparkSession, d: str) -> DataFrame:
    """Documents as long one-letter sequences: doc_id, seq."""
    t = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(t, "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("seq")).filter("seq <> ''")


def psm_table(spark: SparkSession, d: str) -> DataFrame:
    """Scored hits: query_id, source, hit_no, peptide, score (expectation), is_decoy, pep, rt, charge; each delivered hit once."""
    h = table(spark, d, "psms").select("query_id", "source", "assumed_charge", F.posexplode("search_hit").alias("n", "h"))
    decoy = F.coalesce(F.startswith(F.get("h.proteins", F.lit(0))["protein"], F.lit("DECOY_")), F.lit(False))
    prob = F.get("h.analysis_result", F.lit(0))["probability"]
    return h.select("query_id", "source", (F.col("n") + 1).alias("hit_no"), F.col("h.peptide").alias("peptide"), F.element_at("h.search_score", "expect").alias("score"), decoy.alias("is_decoy"), (1 - prob).alias("pep"), F.col("assumed_charge").alias("charge")).filter("score is not null").distinct()


def spectra(spark: SparkSession, d: str) -> DataFrame:
    """Spectra without repeated rows, and the scalar columns only."""
    return table(spark, d, "spectra").select("spectrum_id", "source", "title", "scans", "ms_level", "charge", F.col("pepmass.mz").alias("precursor_mz"), "rtinseconds").distinct()


_PEP = "pep as (select distinct h.peptide as peptide from (select unnest(search_hit) as h from psms) where h.peptide is not null and h.peptide <> '')"
_PROT = "prot as (select doc_id, seq from (select doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as seq from documents) where seq <> '')"
_PSM = """hit as (select query_id, source, assumed_charge, generate_subscripts(search_hit, 1) as hit_no, unnest(search_hit) as h from psms),
psm as (select distinct query_id, source, hit_no::int as hit_no, h.peptide as peptide, map_extract_value(h.search_score, 'expect') as score, coalesce(starts_with(h.proteins[1].protein, 'DECOY_'), false) as is_decoy, 1 - h.analysis_result[1].probability as pep, assumed_charge as charge from hit where map_extract_value(h.search_score, 'expect') is not null)"""
_SPEC = "spec as (select distinct spectrum_id, source, title, scans, ms_level, charge, pepmass.mz as precursor_mz, rtinseconds from spectra)"


def _n(s: str, aa: str) -> str:
    return f"(length({s}) - length(replace({s}, '{aa}', '')))"


def _lit(x: float) -> str:
    return f"cast({x!r} as double)"


def _sum(s: str, values: dict[str, float]) -> str:
    return "(0::double + " + " + ".join(f"{_n(s, a)} * {_lit(v)}" for a, v in sorted(values.items())) + ")"


_MASS = f"({_sum('peptide', K.AA_MASS)} + {_lit(K.WATER)})"
# trypsin without look-around: mark every cut, take back those before P but for WKP and MRP, drop a cut at the end
_TRYPSIN = r"string_split(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({s}, '([KR])', '\1|', 'g'), 'WK|P', 'WK~P'), 'MR|P', 'MR~P'), '|P', 'P'), '~', '|'), '||', '|'), '\|$', ''), '|')"


def _cuts(s: str) -> str:
    return f"list_filter({_TRYPSIN.format(s=s)}, lambda x: x <> '')"


# --- flagship


@query(
    f"""with {_PROT}, p as (select unnest({_cuts('seq')}) as peptide from prot),
c as (select peptide, count(*) as n from p where length(peptide) between 6 and 30 group by peptide)
select peptide, n, round({_MASS}, 5) as mass, round(({_MASS} + 2 * {_lit(K.PROTON)}) / 2, 5) as mz2, round({_sum('peptide', K.HYDROPATHICITY_KD)} / length(peptide), 6) as gravy from c order by n desc, peptide limit 100"""
)
def q00_peptide_profile(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent tryptic peptides with mass, m/z and hydropathicity."""
    pieces = proteins(spark, d).select(F.explode(S.fragments_of("seq", "trypsin")).alias("peptide")).filter(F.length("peptide").between(6, 30))
    c = pieces.groupBy("peptide").agg(F.count("*").alias("n"))
    top = c.orderBy(F.col("n").desc(), "peptide").limit(100)
    return top.select("peptide", "n", F.round(M.fast_mass("peptide"), 5).alias("mass"), F.round(M.fast_mass("peptide", charge=2), 5).alias("mz2"), F.round(C.gravy("peptide"), 6).alias("gravy"))


# --- digestion


@query(f"with {_PROT}, p as (select doc_id, unnest({_cuts('seq')}) as peptide from prot) select doc_id, count(*) as n_peptides, count(distinct peptide) as n_distinct, max(length(peptide)) as longest from p group by doc_id")
def q01_digest_trypsin(spark: SparkSession, d: str) -> DataFrame:
    p = proteins(spark, d).select("doc_id", S.fragments_of("seq", "trypsin").alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("n_peptides"), F.size(F.array_distinct("p")).cast("bigint").alias("n_distinct"), F.array_max(F.transform("p", lambda x: F.length(x))).cast("bigint").alias("longest"))


@query(
    f"""with {_PROT}, c as (select doc_id, {_cuts('seq')} as p from prot),
j as (select doc_id, unnest(list_concat(p, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]))) as peptide from c)
select doc_id, count(*) as n_peptides, sum(length(peptide))::bigint as residues from j where length(peptide) between 6 and 30 group by doc_id"""
)
def q02_digest_missed1(spark: SparkSession, d: str) -> DataFrame:
    p = proteins(spark, d).select("doc_id", F.explode(S.xcleave("seq", "trypsin", 1, 6, 30)).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_peptides"), F.sum(F.length("p")).alias("residues"))


@query(f"with {_PROT}, p as (select distinct unnest({_cuts('seq')}) as peptide from prot) select peptide, length(peptide)::int as n from p where length(peptide) between 7 and 25")
def q03_digest_distinct(spark: SparkSession, d: str) -> DataFrame:
    p = proteins(spark, d).select(F.explode(S.cleave("seq", "trypsin", 0, 7, 25)).alias("peptide")).distinct()
    return p.select("peptide", F.length("peptide").alias("n"))


@query(f"with {_PROT} select doc_id, (len({_cuts('seq')}) - 1)::int as n_sites from prot")
def q04_num_sites(spark: SparkSession, d: str) -> DataFrame:
    return proteins(spark, d).select("doc_id", S.num_sites("seq", "trypsin").alias("n_sites"))


@query(
    f"""with {_PEP}, c as (select peptide, unnest({_cuts('peptide')}) as p from pep),
s as (select peptide, unnest(list_distinct(list_concat([p], list_concat(list_transform(range(3, length(p)), lambda k: p[1:k]), list_transform(range(3, length(p)), lambda k: p[length(p) - k + 1:]))))) as piece from c)
select piece, count(*) as n from s where length(piece) >= 3 group by piece"""
)
def q05_semi_digest(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d).select("peptide", F.explode(S.fragments_of("peptide", "trypsin")).alias("p"))
    semi = p.select("peptide", F.explode(F.array_distinct(F.transform(S.digest("p", "(?!)", 0, 3, None, True), lambda x: x["peptide"]))).alias("piece"))
    return semi.groupBy("piece").agg(F.count("*").alias("n"))


@query(
    f"""with {_PROT}, c as (select doc_id, len(list_filter(string_split(regexp_replace(seq, '(K)', '\\1|', 'g'), '|'), lambda x: x <> '')) as lysc, len(list_filter(string_split(regexp_replace(seq, '(M)', '\\1|', 'g'), '|'), lambda x: x <> '')) as cnbr,
len(list_filter(string_split(replace(seq, 'D', '|D'), '|'), lambda x: x <> '')) as asp_n, len(list_filter(string_split(regexp_replace(seq, '(D)', '\\1|', 'g'), '|'), lambda x: x <> '')) as formic_acid from prot)
select doc_id, lysc::int as lysc, cnbr::int as cnbr, asp_n::int as asp_n, formic_acid::int as formic_acid from c"""
)
def q06_enzymes(spark: SparkSession, d: str) -> DataFrame:
    return proteins(spark, d).select("doc_id", *[F.size(S.fragments_of("seq", r)).alias(n) for n, r in (("lysc", "lysc"), ("cnbr", "cnbr"), ("asp_n", "asp-n"), ("formic_acid", "formic acid"))])


# --- composition, masses


@query(f"with {_PROT}, r as (select unnest(string_split(seq, '')) as aa from prot) select aa, count(*) as n from r group by aa")
def q07_aa_composition(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every residue, by counting letters per sequence and adding up: no row per residue."""
    sums = proteins(spark, d).agg(*[F.sum(S.count_of("seq", a).cast("bigint")).alias(a) for a in S.AMINO_ACIDS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("aa"), F.col(a).alias("n")) for a in S.AMINO_ACIDS])).alias("r")).select("r.*").filter("n > 0")


@query(
    f"""with {_PEP}, r as (select unnest(list_transform(string_split(peptide, ''), lambda x, i: case when i = 1 then 'nterm' || x when i = length(peptide) then 'cterm' || x else x end)) as aa from pep)
select aa, count(*) as n from r group by aa"""
)
def q08_term_composition(spark: SparkSession, d: str) -> DataFrame:
    m = peptides(spark, d).select(F.explode(S.aa_composition("peptide", term_aa=True)).alias("aa", "n"))
    return m.groupBy("aa").agg(F.sum("n").alias("n"))


@query(f"with {_PEP} select peptide, 'Ac-' || replace(peptide, 'M', 'oxM') || '-NH2' as modx, length(peptide)::int as n, peptide as bare, {_n('peptide', 'M')}::int as n_ox from pep")
def q09_modx(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d).withColumn("modx", F.concat(F.lit("Ac-"), F.replace("peptide", F.lit("M"), F.lit("oxM")), F.lit("-NH2")))
    return p.select("peptide", "modx", S.length("modx").alias("n"), S.strip("modx").alias("bare"), F.size(F.filter(S.parse_modx("modx"), lambda g: g == "oxM")).alias("n_ox"))


@query("select doc_id, regexp_matches(text, '^[A-Z]*$') as letters, regexp_matches(text, '^([^-]+-)?(([^A-Z-]*[A-Z])+)(-[^-]+)?$') as modx from documents where text is not null")
def q10_valid(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", S.fast_valid("text", "A-Z").alias("letters"), S.valid("text").alias("modx"))


@query(f"with {_PEP} select peptide, round({_MASS}, 6) as mass from pep")
def q11_fast_mass(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", F.round(M.fast_mass("peptide"), 6).alias("mass"))


@query(f"with {_PSM} select query_id, hit_no, round(({_MASS} + charge * {_lit(K.PROTON)}) / charge, 6) as mz from psm where charge > 0")
def q12_mz_by_charge(spark: SparkSession, d: str) -> DataFrame:
    return psm_table(spark, d).filter("charge > 0").select("query_id", "hit_no", F.round(M.mz(M.fast_mass("peptide"), F.col("charge")), 6).alias("mz"))


def _elements(s: str) -> dict[str, str]:
    base = {"H": 2, "O": 1}
    return {e: f"({base.get(e, 0)} + " + " + ".join(f"{_n(s, a)} * {c[e]}" for a, c in sorted(K.AA_COMPOSITION.items()) if e in c) + ")" for e in ("C", "H", "N", "O", "S")}


@query(f"with {_PEP} select peptide, " + ", ".join(f"{v}::int as n_{e.lower()}" for e, v in _elements("peptide").items()) + " from pep")
def q13_elements(spark: SparkSession, d: str) -> DataFrame:
    comp = peptides(spark, d).select("peptide", M.sequence_composition("peptide").alias("c"))
    return comp.select("peptide", *[F.coalesce(F.element_at("c", e), F.lit(0)).alias(f"n_{e.lower()}") for e in ("C", "H", "N", "O", "S")])


@query(f"with {_PEP} select peptide, round(" + " + ".join(f"{v} * {_lit(K.element_mass(e, True))}" for e, v in _elements("peptide").items()) + ", 5) as mass from pep")
def q14_average_mass(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", F.round(M.average_mass("peptide"), 5).alias("mass"))


@query(
    """with f as (select distinct composition from unimod_modification where regexp_matches(composition, '^[A-Za-z0-9() -]+$')),
r as (select composition, unnest(regexp_extract_all(composition, '[A-Z][a-z]?\\(?-?[0-9]*\\)?')) as x from f)
select composition, regexp_extract(x, '^([A-Z][a-z]?)', 1) as element, sum(coalesce(try_cast(regexp_extract(x, '(-?[0-9]+)', 1) as int), 1))::bigint as n from r group by all having n <> 0"""
)
def q15_formula_parse(spark: SparkSession, d: str) -> DataFrame:
    """Compositions like 'H(2) C(2) O' as element counts."""
    f = table(spark, d, "unimod_modification").select("composition").filter(F.col("composition").rlike("^[A-Za-z0-9() -]+$")).distinct()
    parsed = f.select("composition", M.formula_composition(F.regexp_replace("composition", "[() ]", "")).alias("c"))
    return parsed.select("composition", F.explode("c").alias("element", "n")).select("composition", "element", F.col("n").cast("bigint").alias("n"))


@query(f"with {_SPEC} select spectrum_id, z::int as charge, round(precursor_mz * z - z * {_lit(K.PROTON)}, 6) as mass, round(precursor_mz, 6) as mz from spec, (select unnest([1, 2, 3]) as z) where precursor_mz is not null")
def q16_neutral_mass(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).filter("precursor_mz is not null").select("spectrum_id", "precursor_mz", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("charge"))
    mass = M.neutral_mass("precursor_mz", F.col("charge"))
    return s.select("spectrum_id", "charge", F.round(mass, 6).alias("mass"), F.round(M.mz(mass, F.col("charge")), 6).alias("mz"))


_STEP = f"list_transform(string_split({{s}}, ''), lambda x: map_extract_value(map {{{{{', '.join(f'{a!r}: {_lit(v)}' for a, v in K.AA_MASS.items())}}}}}, x))"


@query(
    f"""with {_PEP}, m as (select peptide, {_STEP.format(s='peptide')} as f, {_STEP.format(s='reverse(peptide)')} as r from pep),
i as (select peptide, f, r, unnest(range(1, length(peptide))) as i from m),
o as (select peptide, 'b' as ion, i::int as index, list_sum(f[1:i]) + {_lit(K.WATER + K.ION_DELTA['b'] + K.PROTON)} as mz from i union all select peptide, 'y', i::int, list_sum(r[1:i]) + {_lit(K.WATER + K.ION_DELTA['y'] + K.PROTON)} from i)
select peptide, ion || index || '+' as name, round(mz, 5) as mz from o"""
)
def q17_fragment_series(spark: SparkSession, d: str) -> DataFrame:
    f = peptides(spark, d).select("peptide", F.explode(M.fragment_series("peptide")).alias("f"))
    return f.select("peptide", "f.name", F.round("f.mz", 5).alias("mz"))


@query(f"with {_PEP} select peptide, round({_sum('peptide', K.HYDROPATHICITY_KD)} / length(peptide), 6) as gravy from pep")
def q18_gravy(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", F.round(C.gravy("peptide"), 6).alias("gravy"))


def _charge_sql(s: str, ph: str, pk: C.PkSet) -> str:
    one = lambda v, sign: f"{sign} / (1 + pow(10.0::double, {sign} * ({ph} - {_lit(v)})))"
    return "(0::double + " + " + ".join(one(v, sign) if g in ("H-", "-OH") else f"{_n(s, g)} * ({one(v, sign)})" for g, (v, sign) in sorted(pk.items())) + ")"


@query(f"with {_PEP} select peptide, ph, round({_charge_sql('peptide', 'ph', K.PK_LEHNINGER)}, 6) as charge from pep, (select unnest([2.0, 5.0, 7.0, 9.0])::double as ph)")
def q19_charge_at_ph(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d).select("peptide", F.explode(F.array(*[F.lit(x) for x in (2.0, 5.0, 7.0, 9.0)])).alias("ph"))
    return p.select("peptide", "ph", F.round(C.charge("peptide", F.col("ph")), 6).alias("charge"))


@query(
    f"""with recursive {_PEP}, b as (select peptide, 0 as k, 0.0::double as lo, 14.0::double as hi from pep
union all select peptide, k + 1, case when {_charge_sql('peptide', '((lo + hi) / 2)', K.PK_LEHNINGER)} > 0 then (lo + hi) / 2 else lo end, case when {_charge_sql('peptide', '((lo + hi) / 2)', K.PK_LEHNINGER)} > 0 then hi else (lo + hi) / 2 end from b where k < 11)
select peptide, round((lo + hi) / 2, 6) as pi from b where k = 11"""
)
def q20_pi(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", F.round(C.isoelectric_point("peptide"), 6).alias("pi"))


def _rt_sql(s: str, rc: dict) -> str:
    return f"({_sum(s, {k: v for k, v in rc['aa'].items() if len(k) == 1})} * (1 + {_lit(rc['lcp'])} * ln(length({s}))) + {_lit(rc['const'])})"


@query(f"with {_PEP} select peptide, round({_rt_sql('peptide', K.RC_GUO_PH2_0)}, 6) as guo, round({_rt_sql('peptide', K.RC_MEEK_PH2_1)}, 6) as meek from pep")
def q21_rt_predict(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", F.round(C.plain_retention_time("peptide", K.RC_GUO_PH2_0), 6).alias("guo"), F.round(C.retention_time("peptide", K.RC_MEEK_PH2_1), 6).alias("meek"))


def _rt_rows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "psms").filter("retention_time_sec is not null").select("query_id", F.get("search_hit", F.lit(0))["peptide"].alias("peptide"), (F.col("retention_time_sec") / 60).alias("rt"))
    return h.filter("peptide is not null").distinct()


@query()
def q22_fit_rc(spark: SparkSession, d: str) -> DataFrame:
    fit = regress.fit_retention(_rt_rows(spark, d), "peptide", "rt", lcp=0.0)
    vary = regress.fit_retention_vary_lcp(_rt_rows(spark, d), "peptide", "rt")
    rows = [("fixed", k, v) for k, v in {**fit["aa"], "const": fit["const"], "lcp": fit["lcp"]}.items()] + [("vary", k, v) for k, v in {**vary["aa"], "const": vary["const"], "lcp": vary["lcp"]}.items()]
    return spark.createDataFrame(rows, "model string, term string, value double")


# --- decoys and headers


@query(f"with {_PEP} select peptide, reverse(peptide) as reversed, peptide[1:1] || reverse(peptide[2:length(peptide) - 1]) || peptide[length(peptide):] as kept_ends from pep")
def q23_decoy_reverse(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", X.reverse_decoy("peptide").alias("reversed"), X.reverse_decoy("peptide", True, True).alias("kept_ends"))


@query(f"with {_PEP} select peptide, reverse(peptide) || 'R' || peptide as fused from pep")
def q24_decoy_fused(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", X.fused_decoy("peptide").alias("fused"))


@query(f"with {_PROT}, e as (select 'doc' || doc_id as description, seq as sequence from prot) select description, sequence from e union all select 'DECOY_' || description, reverse(sequence) from e")
def q25_decoy_db(spark: SparkSession, d: str) -> DataFrame:
    e = proteins(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("description"), F.col("seq").alias("sequence"))
    return TXT.decoy_db(e)


@query(f"with {_PEP} select peptide, length(peptide)::int as n, peptide[1:1] as first, array_to_string(list_sort(string_split(peptide, '')), '') as letters from pep")
def q26_decoy_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """What a seeded shuffle must keep: length, first residue, letters."""
    s = peptides(spark, d).withColumn("s", X.shuffle_decoy("peptide", keep_nterm=True, seed=11))
    return s.select("peptide", F.length("s").alias("n"), F.substring("s", 1, 1).alias("first"), F.array_join(F.array_sort(F.filter(F.split("s", ""), lambda c: c != "")), "").alias("letters"))


_HEADER = """hd as (select distinct 'sp|' || split_part(p.protein, '|', 2) || '|' || split_part(p.protein, '|', 3) || '_HUMAN ' || p.protein_descr || ' OX=9606 GN=' || split_part(p.protein, '|', 3) || ' PE=1 SV=2' as header,
 split_part(p.protein, '|', 2) as id, split_part(p.protein_descr, ' OS=', 1) as name, split_part(p.protein_descr, ' OS=', 2) as os, split_part(p.protein, '|', 3) as gene
 from (select unnest(h.proteins) as p from (select unnest(search_hit) as h from psms)) where regexp_matches(p.protein, '^[A-Za-z_]+[|][A-Z0-9]+[|][A-Z0-9]+$') and regexp_matches(p.protein_descr, '^[a-z]+ OS=[A-Z][a-z]+ [a-z]+$'))"""


@query(f"with {_HEADER} select header, 'uniprot' as flavor, id, gene, 'HUMAN' as taxon, os as organism, 9606 as ox, name from hd")
def q27_header_uniprot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "psms").select(F.explode("search_hit").alias("h")).select(F.explode("h.proteins").alias("p")).select("p.*")
    p = p.filter(F.col("protein").rlike("^[A-Za-z_]+[|][A-Z0-9]+[|][A-Z0-9]+$") & F.col("protein_descr").rlike("^[a-z]+ OS=[A-Z][a-z]+ [a-z]+$"))
    part = lambda k: F.split_part("protein", F.lit("|"), F.lit(k))
    header = F.concat(F.lit("sp|"), part(2), F.lit("|"), part(3), F.lit("_HUMAN "), F.col("protein_descr"), F.lit(" OX=9606 GN="), part(3), F.lit(" PE=1 SV=2"))
    m = p.select(header.alias("header")).distinct().withColumn("m", X.parse_header("header"))
    return m.select("header", *[F.element_at("m", k).alias(a) for k, a in (("flavor", "flavor"), ("id", "id"), ("GN", "gene"), ("taxon", "taxon"), ("OS", "organism"))], F.element_at("m", "OX").cast("int").alias("ox"), F.element_at("m", "name").alias("name"))


_HEADERS = """hx as (select distinct p.protein as protein from (select unnest(h.proteins) as p from (select unnest(search_hit) as h from psms)) where regexp_matches(p.protein, '^[A-Za-z_]+[|][A-Z0-9]+[|][A-Z0-9]+$')),
hp as (select split_part(protein, '|', 2) as acc, split_part(protein, '|', 3) as gene from hx)"""
# flavour -> header and expected fields, all made of an accession (acc) and a gene
_FLAVOURS = {
    "uniprot": ("'tr|' || acc || '|' || gene || '_WHEAT Beta=' || lower(gene) || '-gliadin (Fragment) OS=Triticum aestivum (cv. A / B) OX=4565 GN=' || gene || '-3 PE=1 SV=2'", {"id": "acc", "description": "'Beta=' || lower(gene) || '-gliadin (Fragment)'", "taxon": "'WHEAT'", "gene_id": "gene", "extra": "gene || '-3'"}),
    "uniref": ("'UniRef100_' || acc || ' Factor ' || gene || ' n=12 Tax=Pichia guilliermondii RepID=' || gene || '_PICGU'", {"id": "'UniRef100_' || acc", "description": "'Factor ' || gene", "taxon": "'Pichia guilliermondii'", "extra": "gene || '_PICGU'"}),
    "uniparc": ("'UPI' || acc || ' status=inactive'", {"id": "'UPI' || acc", "extra": "'inactive'"}),
    "unimes": ("'MES' || acc || ' Protein ' || gene || ' (Fragment) OS=marine metagenome Pep=J_' || gene || ' SV=1'", {"id": "'MES' || acc", "description": "'Protein ' || gene || ' (Fragment)'", "taxon": "'marine metagenome'", "extra": "'J_' || gene"}),
    "spd": ("acc || '|' || gene || '_HUMAN| ' || lower(gene) || ' (Marker 1).'", {"id": "acc", "description": "lower(gene) || ' (Marker 1).'", "taxon": "'HUMAN'", "gene_id": "gene"}),
    "ncbi": ("'NP_' || acc || '.1 factor ' || gene || ' [isoform 2] [Homo sapiens]'", {"id": "'NP_' || acc || '.1'", "description": "'factor ' || gene || ' [isoform 2]'", "taxon": "'Homo sapiens'"}),
    "refseq": ("'ref|NP_' || acc || '.1|factor' || gene || ' [Mus musculus]'", {"id": "'NP_' || acc || '.1'", "description": "'factor' || gene", "taxon": "'Mus musculus'"}),
}
_HEADER_FIELDS = ("id", "description", "taxon", "gene_id", "extra")


@query(f"with {_HEADERS} " + " union all ".join(f"select {h} as header, '{f}' as flavor, " + ", ".join(f"{e.get(k, 'null::varchar')} as {k}" for k in _HEADER_FIELDS) + " from hp" for f, (h, e) in _FLAVOURS.items()))
def q28_header_auto(spark: SparkSession, d: str) -> DataFrame:
    """Headers of all seven flavours, told apart and parsed; those of RefSeq by name, as their bars also fit an earlier flavour."""
    p = table(spark, d, "psms").select(F.explode("search_hit").alias("h")).select(F.explode("h.proteins").alias("p")).select("p.protein")
    p = p.filter(F.col("protein").rlike("^[A-Za-z_]+[|][A-Z0-9]+[|][A-Z0-9]+$")).distinct()
    p = p.select(F.split_part("protein", F.lit("|"), F.lit(2)).alias("acc"), F.split_part("protein", F.lit("|"), F.lit(3)).alias("gene"))
    known = p.select(F.explode(F.array(*[F.expr(h) for f, (h, _) in _FLAVOURS.items() if f != "refseq"])).alias("header")).withColumn("m", X.parse_header("header"))
    m = known.unionByName(p.select(F.expr(_FLAVOURS["refseq"][0]).alias("header")).withColumn("m", X.parse_header("header", "refseq")))
    any_of = lambda *keys: F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in keys])
    taxon = F.when(any_of("flavor") == "unimes", any_of("OS")).otherwise(any_of("taxon", "Tax"))
    extra = any_of("GN", "RepID", "status", "Pep")
    return m.select("header", any_of("flavor").alias("flavor"), any_of("id").alias("id"), any_of("description", "cluster", "name").alias("description"), taxon.alias("taxon"), any_of("gene_id").alias("gene_id"), extra.alias("extra"))


# --- target-decoy statistics


@query(
    f"""with {_PSM}, c as (select count(*) as n, sum(is_decoy::int) as d from psm)
select 'fdr1' as metric, round(d / (n - d), 9) as value from c union all select 'fdr2', round((d + d) / n, 9) from c union all select 'fdr_plus_one', round((d + 1) / (n - d), 9) from c
union all select 'sigma_t', round(sqrt((d + 1) * 2), 9) from c union all select 'sigma_fdr', round(sqrt((d + 1) * 2) / (n - d), 9) from c union all select 'n_decoys', d::double from c"""
)
def q29_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = psm_table(spark, d)
    named = lambda df, column, name: df.select(F.lit(name).alias("metric"), F.round(F.col(column).cast("double"), 9).alias("value"))
    one = tda.fdr(p, "is_decoy", formula=1)
    rows = [named(one, "fdr", "fdr1"), named(one, "n_decoys", "n_decoys"), named(tda.fdr(p, "is_decoy", formula=2), "fdr", "fdr2"), named(tda.fdr(p, "is_decoy", correction=1), "fdr", "fdr_plus_one")]
    return access.chain(*rows, named(tda.sigma_t(p, "is_decoy"), "sigma_t", "sigma_t"), named(tda.sigma_fdr(p, "is_decoy"), "sigma_fdr", "sigma_fdr"))


def _q_sql(raw: str, by: str = "", d: str = "is_decoy::int") -> str:
    part, key, on = (f"partition by {by} ", f"{by}, ", f" and psm.{by} = r.{by}") if by else ("", "", "")
    return f"""{_PSM}, g as (select {key}score, count(*) as n, sum({d})::double as d from psm {'where pep is not null ' if d == 'pep' else ''}group by {key}score),
c as (select {key}score, sum(n) over ({part}order by score)::double as i, sum(d) over ({part}order by score) as d from g),
r as (select {key}score, min({raw}) over ({part}order by score rows between current row and unbounded following) as q from c),
o as (select psm.*, r.q from psm join r on psm.score = r.score{on})"""


_F1, _F2 = "case when i > d then d / (i - d) else 'inf'::double end", "(d + d) / i"


@query(f"with {_q_sql(_F1)} select query_id, hit_no, round(q, 9) as q from o where not is_decoy")
def q31_qvalues_f1(spark: SparkSession, d: str) -> DataFrame:
    q = tda.qvalues(psm_table(spark, d), "score", "is_decoy", remove_decoy=True)
    return q.select("query_id", "hit_no", F.round("q", 9).alias("q"))


@query(f"with {_q_sql(_F2)} select query_id, hit_no, is_decoy, round(q, 9) as q from o")
def q32_qvalues_f2(spark: SparkSession, d: str) -> DataFrame:
    q = tda.qvalues(psm_table(spark, d), "score", "is_decoy")
    return q.select("query_id", "hit_no", "is_decoy", F.round("q", 9).alias("q"))


@query(f"with {_q_sql('d / i', d='pep')} select query_id, hit_no, round(q, 7) as q from o where pep is not null")
def q33_qvalues_pep(spark: SparkSession, d: str) -> DataFrame:
    q = tda.qvalues(psm_table(spark, d).filter("pep is not null"), "score", pep="pep")
    return q.select("query_id", "hit_no", F.round("q", 7).alias("q"))


@query(f"with {_q_sql(_F1)} select query_id, hit_no, peptide from o where not is_decoy and q <= 0.3")
def q34_filter(spark: SparkSession, d: str) -> DataFrame:
    return tda.filter_psms(psm_table(spark, d), 0.3, "score", "is_decoy").select("query_id", "hit_no", "peptide")


@query(f"with {_q_sql(_F1, by='source')} select source, count(*) as n, round(max(q), 9) as worst_q from o where not is_decoy and q <= 0.3 group by source")
def q35_filter_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Each run is filtered by itself."""
    f = tda.filter_psms(psm_table(spark, d), 0.3, "score", "is_decoy", by=["source"])
    return f.groupBy("source").agg(F.count("*").alias("n"), F.round(F.max("q"), 9).alias("worst_q"))


@query(f"with {_q_sql('case when i > d then (d + 1) / (i - d) else ' + chr(39) + 'inf' + chr(39) + '::double end')} select query_id, hit_no, round(q, 9) as q from o where not is_decoy")
def q36_qvalues_plus_one(spark: SparkSession, d: str) -> DataFrame:
    q = tda.qvalues(psm_table(spark, d), "score", "is_decoy", remove_decoy=True, correction=1)
    return q.select("query_id", "hit_no", F.round("q", 9).alias("q"))


_EXPECTED = "list_transform(range(0, (i - d)::bigint + 1), lambda m: exp(m * ln(0.5) + lgamma(m + d + 1) - lgamma(m + 1) - lgamma(d + 1) + (d + 1) * ln(0.5)))"


@query(
    f"""with {_PSM}, g as (select source, score, count(*) as n, sum(is_decoy::int)::double as d from psm group by source, score),
c as (select source, score, sum(n) over (partition by source order by score)::double as i, sum(d) over (partition by source order by score) as d from g), e as (select *, {_EXPECTED} as pi from c),
f as (select source, score, i, d, list_sum(list_transform(pi, lambda x, k: x * (k - 1))) / list_sum(pi) as expected from e),
r as (select source, score, min(case when i > d then expected / (i - d) else 'inf'::double end) over (partition by source order by score rows between current row and unbounded following) as q from f)
select query_id, hit_no, round(q, 6) as q from psm join r on psm.score = r.score and psm.source = r.source where not is_decoy"""
)
def q37_qvalues_expectation(spark: SparkSession, d: str) -> DataFrame:
    q = tda.qvalues(psm_table(spark, d), "score", "is_decoy", remove_decoy=True, correction=2, by=["source"])
    return q.select("query_id", "hit_no", F.round("q", 6).alias("q"))


# --- regressions


_XY = f"{_PSM}, xy as (select source, length(peptide)::double as x, score as y from psm where isfinite(score))"
_REG = "regr_slope(y, x) as a, regr_intercept(y, x) as b, corr(y, x) as r, var_pop(y) as syy, var_pop(x) as sxx, covar_pop(y, x) as sxy, avg(x) as mx, avg(y) as my"


def _xy(spark: SparkSession, d: str) -> DataFrame:
    p = psm_table(spark, d).filter(~F.isnan("score"))
    return p.select("source", F.length("peptide").cast("double").alias("x"), F.col("score").alias("y"))


@query(f"with {_XY}, s as (select {_REG} from xy) select round(a, 6) as a, round(b, 5) as b, round(r, 6) as r, round(sqrt(syy - 2 * a * sxy + a * a * sxx), 5) as stderr from s")
def q38_linear_regression(spark: SparkSession, d: str) -> DataFrame:
    return regress.linear_regression(_xy(spark, d), "x", "y").select(F.round("a", 6).alias("a"), F.round("b", 5).alias("b"), F.round("r", 6).alias("r"), F.round("stderr", 5).alias("stderr"))


@query(f"with {_XY}, s as (select {_REG} from xy), t as (select *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) as k from s) select round(k, 4) as a, round(my - k * mx, 3) as b, round(sqrt((syy - 2 * k * sxy + k * k * sxx) / (k * k + 1)), 4) as stderr from t")
def q39_total_least_squares(spark: SparkSession, d: str) -> DataFrame:
    return regress.linear_regression_perpendicular(_xy(spark, d), "x", "y").select(F.round("a", 4).alias("a"), F.round("b", 3).alias("b"), F.round("stderr", 4).alias("stderr"))


# --- joins


@query(
    f"""with {_PEP}, {_SPEC}, m as (select peptide, ({_MASS} + 2 * {_lit(K.PROTON)}) / 2 as mz2 from pep), o as (select spectrum_id, precursor_mz from spec where precursor_mz > 0)
select peptide, spectrum_id, round((mz2 - precursor_mz) / precursor_mz * 1e6, 4) as ppm from m join o on abs(mz2 - precursor_mz) / precursor_mz < 1e-5"""
)
def q40_precursor_match_ppm(spark: SparkSession, d: str) -> DataFrame:
    """Peptides whose doubly charged m/z lies within 10 ppm of a precursor."""
    p = peptides(spark, d).withColumn("mz2", M.fast_mass("peptide", charge=2))
    s = spectra(spark, d).select("spectrum_id", "precursor_mz")
    j = joins.tolerance_join(p, s, "mz2", "precursor_mz", rtol=1e-5)
    return j.select("peptide", "spectrum_id", F.round((F.col("mz2") - F.col("precursor_mz")) / F.col("precursor_mz") * 1e6, 4).alias("ppm"))


@query(
    f"""with hits as (select distinct q.query_id, q.spectrum_id, q.search_hit[1].peptide as peptide from psms q where q.search_hit[1].peptide is not null and q.spectrum_id is not null),
pk as (select distinct spectrum_id, unnest(mz) as obs from spectra), n as (select *, unnest(range(1, length(peptide))) as i from hits),
th as (select query_id, spectrum_id, 'b' || i as ion, {_sum("peptide[1:i]", K.AA_MASS)} + {_lit(K.WATER + K.ION_DELTA['b'] + K.PROTON)} as calc from n
 union all select query_id, spectrum_id, 'y' || i, {_sum("peptide[length(peptide) - i + 1:]", K.AA_MASS)} + {_lit(K.WATER + K.ION_DELTA['y'] + K.PROTON)} from n)
select query_id, ion, round(obs, 4) as obs, round(calc, 4) as calc from th join pk on th.spectrum_id = pk.spectrum_id and abs(calc - obs) < 0.02"""
)
def q41_annotate_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of each spectrum within 0.02 of a b or y ion of its first hit's peptide."""
    h = table(spark, d, "psms").select("query_id", "spectrum_id", F.get("search_hit", F.lit(0))["peptide"].alias("peptide")).filter("peptide is not null and spectrum_id is not null").distinct()
    th = h.select("query_id", "spectrum_id", F.explode(M.fragment_series("peptide")).alias("f")).select("query_id", "spectrum_id", F.concat("f.ion", F.col("f.index").cast("string")).alias("ion"), F.col("f.mz").alias("calc"))
    peaks = table(spark, d, "spectra").select("spectrum_id", F.explode(F.array_distinct("mz")).alias("obs")).distinct()
    return joins.tolerance_join(th, peaks, "calc", "obs", atol=0.02, on=["spectrum_id"]).select("query_id", "ion", F.round("obs", 4).alias("obs"), F.round("calc", 4).alias("calc"))


_LINE = f"{_SPEC}, line as (select spectrum_id, rtinseconds as t from spec where rtinseconds is not null), pr as (select distinct query_id, retention_time_sec as probe from psms where retention_time_sec is not null)"


@query(f"with {_LINE} select query_id, round(probe, 3) as probe, round(arg_min(t, struct_pack(e := abs(t - probe), t := t)), 3) as nearest from pr, line group by query_id, probe")
def q42_nearest_rt(spark: SparkSession, d: str) -> DataFrame:
    line = spectra(spark, d).filter("rtinseconds is not null").select(F.col("rtinseconds").alias("t"))
    probes = table(spark, d, "psms").filter("retention_time_sec is not null").select("query_id", F.col("retention_time_sec").alias("probe")).distinct()
    n = joins.nearest_join(probes, line, "probe", "t")
    return n.select("query_id", F.round("probe", 3).alias("probe"), F.round("t", 3).alias("nearest"))


@query(f"with {_LINE}, e as (select arg_min(t, struct_pack(e := abs(t - 600), t := t)) as lo, arg_min(t, struct_pack(e := abs(t - 1200), t := t)) as hi from line) select spectrum_id, round(t, 3) as t from line, e where t >= lo and t <= hi")
def q43_rt_slice(spark: SparkSession, d: str) -> DataFrame:
    line = spectra(spark, d).filter("rtinseconds is not null").select("spectrum_id", F.col("rtinseconds").alias("t"))
    return joins.time_slice(line, "t", 600.0, 1200.0).select("spectrum_id", F.round("t", 3).alias("t"))


@query(f"with {_SPEC} select spectrum_id, title from spec where spectrum_id between 100 and 400 and (spectrum_id - 100) % 7 = 0")
def q44_slices(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).select("spectrum_id", "title")
    by_key = access.by_key_range(s.withColumn("id", F.col("spectrum_id")), "id", "spectrum_id", 400, 100)
    return access.by_position(by_key, "spectrum_id", 100, None, 7).select("spectrum_id", "title")


@query(f"with {_SPEC} select spectrum_id, title from spec where spectrum_id is not null")
def q81_whole_slice(spark: SparkSession, d: str) -> DataFrame:
    """Open-ended slices from the smallest to the largest key: the whole table."""
    s = spectra(spark, d).select("spectrum_id", "title")
    lo, hi = s.agg(F.min("spectrum_id"), F.max("spectrum_id")).first()
    by_key = access.by_key_range(s.withColumn("id", F.col("spectrum_id")), "id", "spectrum_id", hi, lo)
    return access.by_position(by_key, "spectrum_id").select("spectrum_id", "title")




@query(
    f"""with {_PROT}, k as (select distinct unnest({_cuts('seq')}) as peptide from prot), pep as (select peptide, peptide[1:7] as seed from k where length(peptide) >= 7), g as (select doc_id, seq, unnest(range(0, length(seq) - 6)) as i from prot),
h as (select doc_id, i, max(length(peptide)) as n from g join pep on seq[i + 1:i + 7] = pep.seed and seq[i + 1:i + length(peptide)] = peptide group by doc_id, i),
m as (select distinct doc_id, unnest(range(i, i + n)) as position from h), c as (select doc_id, count(*) as n from m group by doc_id)
select prot.doc_id, coalesce(c.n, 0)::bigint as n_covered, round(coalesce(c.n, 0) / length(seq), 9) as coverage from prot left join c on prot.doc_id = c.doc_id"""
)
def q46_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the sequences by the distinct tryptic peptides of seven residues or more of all of them (shorter ones say little of where they come from)."""
    p = proteins(spark, d)
    pep = p.select(F.explode(S.fragments_of("seq", "trypsin")).alias("peptide")).filter(F.length("peptide") >= 7)
    c = joins.coverage(p, pep, "doc_id", "seq", "peptide")
    return c.select("doc_id", F.col("n_covered").cast("bigint").alias("n_covered"), F.round("coverage", 9).alias("coverage"))


@query(
    f"""with {_PROT}, k as (select distinct unnest({_cuts('seq')}) as peptide from prot), pep as (select peptide, peptide[1:6] as seed from k where length(peptide) >= 9), g as (select doc_id, seq, unnest(range(0, length(seq) - 8)) as i from prot),
h as (select doc_id, i, length(peptide) as n from g join pep on seq[i + 1:i + 6] = pep.seed and seq[i + 1:i + length(peptide)] = peptide),
m as (select doc_id, unnest(range(i, i + n))::int as position from h) select doc_id, position, count(*) as n_peptides from m group by doc_id, position"""
)
def q45_coverage_mask(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct tryptic peptides of nine residues or more over each residue."""
    p = proteins(spark, d)
    pep = p.select(F.explode(S.fragments_of("seq", "trypsin")).alias("peptide")).filter(F.length("peptide") >= 9)
    return joins.coverage_mask(p, pep, "doc_id", "seq", "peptide")


@query(
    """with s as (select distinct spectrum_id, mz, intensity from spectra), p as (select spectrum_id, unnest(list_zip(mz, intensity)) as p from s),
c as (select spectrum_id, p[1] as mz, p[2] as i from p where p[2] is not null and not isnan(p[2]) and not isinf(p[2])), r as (select *, row_number() over (partition by spectrum_id order by i desc, mz) as rank from c)
select spectrum_id, mz, i as intensity, rank::int as rank from r where rank <= 3"""
)
def q47_base_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The three highest finite peaks of each spectrum, found inside the row."""
    s = table(spark, d, "spectra").select("spectrum_id", "mz", "intensity").distinct()
    peaks = F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["intensity"].isNotNull() & ~F.isnan(p["intensity"]) & (F.abs(p["intensity"]) != float("inf")))
    top = F.slice(F.array_sort(F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("k"), p["mz"].alias("mz"), p["intensity"].alias("intensity")))), 1, 3)
    return s.select("spectrum_id", F.posexplode(top).alias("n", "p")).select("spectrum_id", "p.mz", "p.intensity", (F.col("n") + 1).alias("rank"))


@query("with s as (select distinct spectrum_id, charge_array from spectra where charge_array is not null) select spectrum_id, len(charge_array)::int as n, len(list_filter(charge_array, lambda x: x is null or x = 0))::int as n_masked, list_sum(charge_array)::bigint as total from s")
def q48_masked_charge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spectra").filter("charge_array is not null").select("spectrum_id", "charge_array").distinct().withColumn("m", A.mask_zero("charge_array"))
    total = F.when(F.exists("m", lambda x: x.isNotNull()) | (F.size("m") > 0), F.aggregate(F.coalesce("charge_array", F.array()), F.lit(None).cast("bigint"), lambda a, x: F.coalesce(a + x, a, x.cast("bigint"))))
    return s.select("spectrum_id", F.size("m").alias("n"), F.size(F.filter("m", lambda x: x.isNull())).alias("n_masked"), total.alias("total"))


@query(
    f"""with {_PSM}, b as (select peptide, arg_min(query_id, struct_pack(s := score, q := query_id, h := hit_no)) as query_id, min(score) as score from psm where not isnan(score) group by peptide),
t as (select peptide, count(*) as n from psm where is_decoy group by peptide) select b.peptide, b.query_id, b.score, t.n as n_decoy_hits from b join t on b.peptide = t.peptide"""
)
def q49_best_psm_join(spark: SparkSession, d: str) -> DataFrame:
    p = psm_table(spark, d).filter(~F.isnan("score"))
    best = access.first_per_group(p.select("peptide", "query_id", "score", "hit_no"), ["peptide"], [F.col("score"), F.col("query_id"), F.col("hit_no")])
    decoys = psm_table(spark, d).filter("is_decoy").groupBy("peptide").agg(F.count("*").alias("n_decoy_hits"))
    return best.join(decoys, "peptide").select("peptide", "query_id", "score", "n_decoy_hits")


@query("select o_orderkey, c_name as o_custkey_c_name, n_name as nation_n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def q50_resolve_references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = joins.resolve_references(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": (c, "c_custkey")})
    o = joins.resolve_references(o.withColumnRenamed("o_custkey_c_nationkey", "nation"), {"nation": (n, "n_nationkey")})
    return o.select("o_orderkey", "o_custkey_c_name", "nation_n_name")


@query(
    """with p as (select distinct spectrum_id, param_id, upper(accession) as accession, param_name as name, param_value as value from cv_params where spectrum_id is not null)
select spectrum_id, arg_min(case when coalesce(value, '') = '' then name else value end, param_id) as value from p where accession = 'MS:1000511' group by spectrum_id"""
)
def q51_cv_query(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "cv_params").filter("spectrum_id is not null").select("spectrum_id", "param_id", F.upper("accession").alias("accession"), F.col("param_name").alias("name"), F.col("param_value").alias("value")).distinct()
    wanted = p.filter("accession = 'MS:1000511'")
    lists = wanted.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("param_id", "accession", "name", "value"))).alias("cv"))
    return lists.select("spectrum_id", X.cv_value("cv", "MS:1000511").alias("value"))


@query(f"with {_SPEC}, u as (select spectrum_id, 'mzspec:PXD1:' || source || ':scan:' || spectrum_id || ':PEPTIDE/2' as usi, source from spec) select usi, 'PXD1' as dataset, source as datafile, 'scan' as kind, spectrum_id::varchar as identifier, 'PEPTIDE/2' as interpretation from u")
def q52_usi_parse(spark: SparkSession, d: str) -> DataFrame:
    u = spectra(spark, d).select(F.concat(F.lit("mzspec:PXD1:"), "source", F.lit(":scan:"), F.col("spectrum_id").cast("string"), F.lit(":PEPTIDE/2")).alias("usi")).withColumn("p", X.parse_usi("usi"))
    return u.select("usi", "p.dataset", "p.datafile", F.col("p.scan_identifier_type").alias("kind"), F.col("p.scan_identifier").alias("identifier"), "p.interpretation")


@query(
    """with c as (select distinct charge from spectra where regexp_matches(charge, '^[0-9]+[+-]?( *(,|and) *[0-9]+[+-]?)*$')), p as (select charge, regexp_split_to_array(charge, '(?:, *)|(?: *and *)') as p from c),
e as (select charge, generate_subscripts(p, 1)::int as pos, unnest(p) as x from p) select charge, pos, (case when x like '%-' then -1 else 1 end * regexp_extract(x, '[0-9]+')::int)::int as value from e where regexp_matches(x, '^[0-9]+[+-]?$')"""
)
def q53_charge_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "spectra").select("charge").filter(F.col("charge").rlike("^[0-9]+[+-]?( *(,|and) *[0-9]+[+-]?)*$")).distinct()
    e = c.select("charge", F.posexplode(X.parse_charge_list("charge")).alias("n", "value"))
    return e.filter("value is not null").select("charge", (F.col("n") + 1).alias("pos"), "value")


@query(f"with {_PEP}, l as (select distinct 'y' || length(peptide) || '-H2O+' || (1 + length(peptide) % 3) as label, length(peptide) as n from pep) select label, 'y' || n || '-H2O' as ion_type, '-H2O' as neutral_loss, (1 + n % 3)::int as charge from l")
def q54_ion_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("peptide")
    labels = peptides(spark, d).select(F.concat(F.lit("y"), n.cast("string"), F.lit("-H2O+"), (1 + n % 3).cast("string")).alias("label")).distinct()
    return labels.withColumn("i", X.parse_ion("label")).select("label", "i.*")


@query(f"with {_SPEC} select spectrum_id, 'PT' || floor(rtinseconds / 60)::int || 'M' || (floor(rtinseconds)::int % 60) || 'S' as duration, round(floor(rtinseconds / 60)::int + (floor(rtinseconds)::int % 60) / 60.0::double, 9) as minutes from spec where rtinseconds is not null")
def q55_duration(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).filter("rtinseconds is not null")
    t = F.concat(F.lit("PT"), F.floor(F.col("rtinseconds") / 60).cast("string"), F.lit("M"), (F.floor("rtinseconds") % 60).cast("string"), F.lit("S"))
    return s.select("spectrum_id", t.alias("duration"), F.round(X.duration_minutes(t), 9).alias("minutes"))


# --- generators and ProForma


@query(f"with {_PEP}, s as (select peptide, {_n('peptide', 'M')} as m, {_n('peptide', 'S')} + {_n('peptide', 'T')} as st from pep) select peptide, (1 + m + st + (m + st) * (m + st - 1) / 2)::bigint as n_forms from s")
def q56_peptidoforms(spark: SparkSession, d: str) -> DataFrame:
    """Number of forms with at most two of oxidised M, phosphorylated S and T."""
    f = forms.peptidoforms_modx(peptides(spark, d), "peptide", {"ox": ["M"], "p": ["S", "T"]}, max_mods=2)
    return f.groupBy("peptide").agg(F.count("*").alias("n_forms"))


@query(f"with {_PEP} select peptide, replace(peptide, 'M', 'M[+15.9949]') as proforma, round({_MASS} + {_n('peptide', 'M')} * {_lit(15.9949)}, 5) as mass from pep")
def q57_proforma_mass(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d).withColumn("proforma", F.replace("peptide", F.lit("M"), F.lit("M[+15.9949]")))
    return p.select("peptide", "proforma", F.round(P.proforma_mass("proforma"), 5).alias("mass"))


@query(
    f"""with {_PEP}, i as (select peptide, unnest(range(1, length(peptide))) as i from pep)
select peptide, i::int as index, round({_sum("peptide[1:i]", K.AA_MASS)} + {_n("peptide[1:i]", 'C')} * {_lit(57.02146)} + {_lit(K.WATER + K.ION_DELTA['b'] + K.PROTON)}, 5) as mz from i"""
)
def q58_proforma_fragments(spark: SparkSession, d: str) -> DataFrame:
    """b ions with a fixed modification on every C."""
    p = peptides(spark, d).withColumn("proforma", F.concat(F.lit("<[+57.02146]@C>"), "peptide"))
    f = p.select("peptide", F.posexplode(P.proforma_fragments("proforma", "b")).alias("n", "mz"))
    return f.select("peptide", (F.col("n") + 1).alias("index"), F.round("mz", 5).alias("mz"))


@query(f"with {_PEP} select peptide, 'Ac-' || replace(replace(peptide, 'M', 'oxM'), 'S', 'pS') as modx, round({_MASS} + {_n('peptide', 'M')} * {_lit(15.9949)} + {_n('peptide', 'S')} * {_lit(79.9663)} + {_lit(42.0106)}, 5) as mass from pep")
def q68_modx_mass(spark: SparkSession, d: str) -> DataFrame:
    """Acetylated modX peptides with every M oxidised and every S phosphorylated."""
    p = peptides(spark, d).withColumn("modx", F.concat(F.lit("Ac-"), F.replace(F.replace("peptide", F.lit("M"), F.lit("oxM")), F.lit("S"), F.lit("pS"))))
    acetyl = 42.0106 + K.composition_mass(K.TERMINI["H-"])
    return p.select("peptide", "modx", F.round(M.modx_mass("modx", {"ox": 15.9949, "p": 79.9663, "Ac-": acetyl}), 5).alias("mass"))


@query(f"with {_PEP}, c as (select peptide, 'C' || {_elements('peptide')['C']} || 'H' || {_elements('peptide')['H']} || 'N' || {_elements('peptide')['N']} || 'O' || {_elements('peptide')['O']} as formula, {_elements('peptide')['C']} * {_lit(K.element_mass('C'))} + {_elements('peptide')['H']} * {_lit(K.element_mass('H'))} + {_elements('peptide')['N']} * {_lit(K.element_mass('N'))} + {_elements('peptide')['O']} * {_lit(K.element_mass('O'))} as mass from pep) select peptide, formula, round(mass, 5) as mass from c")
def q69_formula_mass(spark: SparkSession, d: str) -> DataFrame:
    """Formulas written from compositions, parsed again and weighed (sulphur left out)."""
    c = peptides(spark, d).select("peptide", M.sequence_composition("peptide").alias("c"))
    f = c.select("peptide", F.concat(*[x for e in ("C", "H", "N", "O") for x in (F.lit(e), F.coalesce(F.element_at("c", e), F.lit(0)).cast("string"))]).alias("formula"))
    return f.select("peptide", "formula", F.round(M.composition_mass(M.formula_composition("formula")), 5).alias("mass"))


@query()
def q59_isotopologues(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d).select("peptide", M.sequence_composition("peptide").alias("composition"))
    i = forms.isotopologues(p, "composition")
    return i.groupBy("peptide").agg(F.count("*").alias("n_states"), F.round(F.sum("abundance"), 6).alias("abundance"), F.round(1 - F.sum("abundance"), 6).alias("uncovered"), F.round(F.max_by("isotope_mass", "abundance"), 5).alias("top_mass"))


def _two_isotopes(e: str) -> tuple[str, str]:
    """SQL of the count of the second isotope of an element, and of the log-probability of the split."""
    (p1, _), (p2, _) = sorted(((a, i) for i, (_, a) in K.NIST_MASS[e].items() if i), reverse=True)[:2]
    n = _elements("peptide")[e]
    first = f"least({n}, round_even({n} * {_lit(p1)}, 0))"
    return f"({n} - {first})", f"(lgamma({n} + 1) - lgamma({first} + 1) - lgamma({n} - {first} + 1) + {first} * ln({_lit(p1)}) + ({n} - {first}) * ln({_lit(p2)}))"


@query(f"with {_PEP} select peptide, nullif({_two_isotopes('C')[0]}::int, 0) as n_c13, round(exp({' + '.join(_two_isotopes(e)[1] for e in 'CHNOS')}), 9) as abundance from pep")
def q60_most_probable_isotopes(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d).select("peptide", M.most_probable_isotopes(M.sequence_composition("peptide")).alias("isotopes"))
    return p.select("peptide", F.element_at("isotopes", "C[13]").alias("n_c13"), F.round(M.isotopic_abundance("isotopes"), 9).alias("abundance"))


@query(
    f"""with s as (select distinct spectrum_id, title, pepmass, mz, intensity from spectra where title is not null and pepmass.mz is not null and len(mz) > 0 and len(intensity) = len(mz) and len(list_filter(intensity, lambda x: x is null or isnan(x) or isinf(x))) = 0)
select spectrum_id, len(mz)::int as n_peaks, round(pepmass.mz, 4) as precursor_mz, round(mz[1], 4) as first_mz from s"""
)
def q61_mgf_text(spark: SparkSession, d: str) -> DataFrame:
    """Spectra written as MGF text and read back from it by the reader's own expressions."""
    s = table(spark, d, "spectra").select("spectrum_id", "title", "pepmass", "mz", "intensity").filter("title is not null and pepmass.mz is not null and size(mz) > 0 and size(intensity) = size(mz)")
    s = s.filter(~F.exists("intensity", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).distinct()
    params = F.create_map(F.lit("title"), F.col("title"), F.lit("pepmass"), F.format_string("%.5f", "pepmass.mz"))
    t = s.select("spectrum_id", TXT.mgf_text(params, F.col("mz"), F.col("intensity")).alias("text"))
    lines = t.select("spectrum_id", F.filter(F.split("text", "\n"), lambda x: x.rlike("^[0-9]")).alias("p"), F.regexp_extract("text", "PEPMASS=([0-9.]+)", 1).cast("double").alias("precursor_mz"))
    return lines.select("spectrum_id", F.size("p").alias("n_peaks"), F.round("precursor_mz", 4).alias("precursor_mz"), F.round(F.split(F.get("p", F.lit(0)), " ")[0].cast("double"), 4).alias("first_mz"))


@query(f"with {_PROT} select doc_id, length(seq)::int as n, (1 + ceil(length(seq) / 70.0))::int as n_lines from prot")
def q62_fasta_text(spark: SparkSession, d: str) -> DataFrame:
    t = proteins(spark, d).select("doc_id", "seq", TXT.fasta_lines(F.col("doc_id").cast("string"), F.col("seq")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return t.select("doc_id", F.length(F.array_join(F.filter(lines, lambda x: ~F.startswith(x, F.lit(">"))), "")).alias("n"), F.size(lines).alias("n_lines"))


@query("with s as (select distinct spectrum_id, mz from spectra where mz is not null and len(list_filter(mz, lambda x: x is null)) = 0) select spectrum_id, len(mz)::int as n, list_max(mz) as highest, mz[1] as first from s where len(mz) > 0")
def q63_binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Arrays encoded to base64 with zlib and decoded again."""
    s = table(spark, d, "spectra").select("spectrum_id", "mz").filter("size(mz) > 0").filter(~F.exists("mz", lambda x: x.isNull())).distinct()
    back = s.select("spectrum_id", A.decode_binary(A.encode_binary("mz", compress=True), F.lit("zlib")).alias("mz"))
    return back.select("spectrum_id", F.size("mz").alias("n"), F.array_max("mz").alias("highest"), F.get("mz", F.lit(0)).alias("first"))


# --- Unimod look-ups, set operations, histogram


@query(
    """with m as (select distinct id, full_name, code_name, ex_code_name from unimod_modification), a as (select distinct modification_id, alt_name from unimod_alt_name)
select 'strict' as mode, id from m where full_name = 'Acetylation' or code_name = 'Acetyl' or ex_code_name = 'Acetyl' union select 'like', id from m where full_name like '%phos%' or code_name like '%phos%' or ex_code_name like '%phos%' union select 'alt', m.id from m join a on m.id = a.modification_id where contains(alt_name, 'a1')"""
)
def q64_unimod_lookup(spark: SparkSession, d: str) -> DataFrame:
    from pepspark.sources import unimod

    db = unimod.Unimod({n: table(spark, d, f"unimod_{n}") for n in ("modification", "alt_name", "specificity")})
    strict = db.by_code("Acetyl").unionByName(db.by_name("Acetylation")).select(F.lit("strict").alias("mode"), "id")
    like = db.search("phos").select(F.lit("like").alias("mode"), "id")
    alt = db.by_alternative_name("a1", strict=False).select(F.lit("alt").alias("mode"), "id")
    return strict.unionByName(like).unionByName(alt).distinct()


@query("select amino_acid, count(distinct s.id) as n from unimod_specificity s join (select distinct id from unimod_modification where approved) m on s.modification_id = m.id where amino_acid is not null group by amino_acid")
def q65_unimod_sql(spark: SparkSession, d: str) -> DataFrame:
    """Raw SQL over the registered tables."""
    from pepspark.sources import unimod

    db = unimod.Unimod({n: table(spark, d, f"unimod_{n}") for n in ("modification", "specificity")})
    return db.sql("select amino_acid, count(distinct s.id) as n from {specificity} s join (select distinct id from {modification} where approved) m on s.modification_id = m.id where amino_acid is not null group by amino_acid")


@query(f"with {_PSM}, t as (select distinct peptide from psm where not is_decoy), x as (select distinct peptide from psm where is_decoy) select peptide, 'both' as side from t where peptide in (select peptide from x) union all select peptide, 'target' from t where peptide not in (select peptide from x)")
def q66_set_operations(spark: SparkSession, d: str) -> DataFrame:
    p = psm_table(spark, d)
    t, x = p.filter("not is_decoy").select("peptide"), p.filter("is_decoy").select("peptide")
    return t.intersect(x).withColumn("side", F.lit("both")).unionByName(t.distinct().join(x, "peptide", "left_anti").withColumn("side", F.lit("target")))


@query(f"with {_PEP}, m as (select {_MASS} as mass from pep) select (case when mass < 600 then 0 when mass >= 3000 then 25 else floor((mass - 600) / 100) + 1 end)::bigint as bin, count(*) as n from m group by 1")
def q67_mass_histogram(spark: SparkSession, d: str) -> DataFrame:
    return regress.histogram(peptides(spark, d), M.fast_mass("peptide"), 600.0, 3000.0, 24).select(F.col("bin").cast("bigint").alias("bin"), "n")


@query(
    """with p as (select distinct spectrum_id, param_id, upper(accession) as accession, param_name as name, param_value as value from cv_params where spectrum_id is not null and accession is not null)
select spectrum_id, accession, arg_max(case when coalesce(value, '') = '' then name else value end, param_id) as value from p group by spectrum_id, accession"""
)
def q70_cv_index(spark: SparkSession, d: str) -> DataFrame:
    """The parameters of each spectrum as a map by accession; of repeated ones the last counts."""
    p = table(spark, d, "cv_params").filter("spectrum_id is not null and accession is not null").select("spectrum_id", "param_id", F.upper("accession").alias("accession"), F.col("param_name").alias("name"), F.col("param_value").alias("value")).distinct()
    lists = p.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("param_id", "accession", "name", "value"))).alias("cv"))
    return lists.select("spectrum_id", F.explode(X.cv_index("cv")).alias("accession", "value"))


@query(f"with {_PEP} select peptide, '[Acetyl]-' || replace(replace(peptide, 'M', 'M[Oxidation]'), 'S', 'S[Phospho]') || '-[Amidated]' as proforma from pep")
def q71_modx_to_proforma(spark: SparkSession, d: str) -> DataFrame:
    p = peptides(spark, d)
    modx = F.concat(F.lit("Ac-"), F.replace(F.replace("peptide", F.lit("M"), F.lit("oxM")), F.lit("S"), F.lit("pS")), F.lit("-NH2"))
    return p.select("peptide", P.modx_to_proforma(modx, {"ox": "Oxidation", "p": "Phospho", "Ac": "Acetyl", "NH2": "Amidated"}).alias("proforma"))


@query("with s as (select distinct spectrum_id, pepmass from spectra where pepmass.mz is not null) select spectrum_id, round(pepmass.mz, 4) as mz, round(pepmass.intensity, 1) as intensity, 2::int as charge from s")
def q72_pepmass_parse(spark: SparkSession, d: str) -> DataFrame:
    """PEPMASS lines of three fields, written and parsed."""
    s = table(spark, d, "spectra").filter("pepmass.mz is not null").select("spectrum_id", "pepmass").distinct()
    text = F.concat_ws(" ", F.format_string("%.6f", "pepmass.mz"), F.coalesce(F.format_string("%.3f", F.col("pepmass.intensity")), F.lit("x")), F.lit("2+"))
    parsed = s.select("spectrum_id", X.parse_pepmass(F.when(F.col("pepmass.intensity").isNull(), F.concat(F.format_string("%.6f", "pepmass.mz"), F.lit(" - 2+"))).otherwise(text)).alias("p"))
    return parsed.select("spectrum_id", F.round("p.mz", 4).alias("mz"), F.round("p.intensity", 1).alias("intensity"), "p.charge")


@query(f"with {_PSM}, r as (select source, query_id, hit_no, score, row_number() over (partition by source order by score, query_id * 1000 + hit_no)::int as rank from psm where not isnan(score)) select source, query_id, hit_no, score, rank from r where rank <= 3")
def q73_top_psms(spark: SparkSession, d: str) -> DataFrame:
    """The three best scored hits of each run."""
    p = psm_table(spark, d).filter(~F.isnan("score")).withColumn("tie", F.col("query_id") * 1000 + F.col("hit_no"))
    return access.top_k(p, ["source"], "score", 3, "tie", descending=False).select("source", "query_id", "hit_no", "score", "rank")


@query(
    """select 'modification' as origin, id, full_name as name, null::bigint as modification_id from unimod_modification union all select 'alt_name', id, alt_name, modification_id from unimod_alt_name"""
)
def q74_chain(spark: SparkSession, d: str) -> DataFrame:
    """Tables with different columns one after the other."""
    a = table(spark, d, "unimod_modification").select(F.lit("modification").alias("origin"), "id", F.col("full_name").alias("name"))
    b = table(spark, d, "unimod_alt_name").select(F.lit("alt_name").alias("origin"), "id", F.col("alt_name").alias("name"), "modification_id")
    return access.chain(a, b)


@query(
    """with h as (select distinct query_id, source, search_hit[1] as h from psms where search_hit[1] is not null)
select query_id, h.peptide as peptide, coalesce(array_to_string(list_transform(list_filter(h.proteins, lambda p: p is not null and p.protein is not null), lambda p: p.protein), ';'), '') as protein,
list_transform(list_filter(h.modification_info.mod_aminoacid_mass, lambda m: m is not null and m.mass is not null), lambda m: m.mod_position) as mod_positions from h"""
)
def q75_flatten_psms(spark: SparkSession, d: str) -> DataFrame:
    """One row per query: its first hit, proteins joined, places of the modifications out of 'mass@position'."""
    from pepspark.sources.xml import flatten_pepxml

    def as_read(h):
        known = F.filter(h["proteins"], lambda p: p.isNotNull() & p["protein"].isNotNull())
        mods = F.filter(h["modification_info"]["mod_aminoacid_mass"], lambda m: m.isNotNull() & m["mass"].isNotNull())
        plain = [h[c].alias(c) for c in ("hit_rank", "peptide", "modified_peptide", "calc_neutral_pep_mass", "massdiff", "num_tot_proteins", "num_missed_cleavages", "is_rejected", "search_score")]
        return F.when(h.isNotNull(), F.struct(*plain, known.alias("proteins"), F.transform(mods, lambda m: F.struct(m["mod_position"].alias("position"), m["mass"].alias("mass"))).alias("modifications"), h["analysis_result"].alias("analysis_result")))

    q = table(spark, d, "psms").select("query_id", "source", F.transform("search_hit", as_read).alias("search_hit"))
    flat = flatten_pepxml(q, sep=";").select("query_id", "source", "peptide", "protein", "modifications").distinct()
    return flat.select("query_id", "peptide", "protein", F.transform("modifications", lambda m: F.split(m, "@")[1].cast("int")).alias("mod_positions"))


@query(
    """with h as (select distinct query_id, generate_subscripts(search_hit, 1) as hit_no, unnest(search_hit).proteins as p from psms)
select query_id, hit_no::int as hit_no, len(list_filter(p, lambda x: not coalesce(starts_with(x.protein, 'DECOY_'), false))) = 0 as is_decoy from h where p is not null"""
)
def q76_all_decoy(spark: SparkSession, d: str) -> DataFrame:
    """A hit is a decoy if all its proteins are; a protein without name counts as target."""
    h = table(spark, d, "psms").select("query_id", F.posexplode("search_hit").alias("n", "h")).filter("h.proteins is not null")
    names = F.transform("h.proteins", lambda p: F.coalesce(p["protein"], F.lit("")))
    return h.select("query_id", (F.col("n") + 1).alias("hit_no"), tda.all_decoy(names).alias("is_decoy")).distinct()


@query(f"with {_XY}, s as (select source, {_REG}, count(*) as n from xy group by source having count(*) > 2 and var_pop(x) > 0) select source, round(a, 5) as a, round(b, 4) as b, round(r, 5) as r from s")
def q77_regression_by_source(spark: SparkSession, d: str) -> DataFrame:
    xy = _xy(spark, d)
    many = xy.groupBy("source").agg(F.count("*").alias("n"), F.var_pop("x").alias("v")).filter("n > 2 and v > 0").select("source")
    r = regress.linear_regression(xy.join(many, "source", "left_semi"), "x", "y", by=["source"])
    return r.select("source", F.round("a", 5).alias("a"), F.round("b", 4).alias("b"), F.round("r", 5).alias("r"))


@query(
    """with s as (select distinct spectrum_id, mz from spectra where len(mz) > 2 and len(list_filter(mz, lambda x: x is null)) = 0)
select spectrum_id, round(mz[2] + list_sum(list_transform(mz[3:], lambda x: x - mz[1])), 4) as delta_last, round(mz[1] + (len(mz) - 1) * (mz[2] - mz[1]) + list_sum(list_transform(mz[3:], lambda x, k: (x - mz[2]) * (len(mz) - 1 - k))), 4) as linear_last from s"""
)
def q78_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Last values after undoing delta and linear prediction (of arrays taken as if they were predicted)."""
    s = table(spark, d, "spectra").select("spectrum_id", "mz").filter("size(mz) > 2").filter(~F.exists("mz", lambda x: x.isNull())).distinct()
    last = lambda c: F.element_at(c, -1)
    return s.select("spectrum_id", F.round(last(A.delta_predict("mz")), 4).alias("delta_last"), F.round(last(A.linear_predict("mz")), 4).alias("linear_last"))


@query("select date_trunc('day', loaded_at)::timestamp as start, source, count(*) as n from psms where loaded_at is not null group by all")
def q79_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by day and run: the streaming operator on a finished table."""
    from pepspark import streaming

    p = table(spark, d, "psms").select("source", "loaded_at")
    w = streaming.windowed_counts(p, "loaded_at", ["source"], "1 day")
    return w.select("start", "source", "n")


@query(
    """with e as (select source, loaded_at as t, lag(loaded_at) over (partition by source order by loaded_at) as p from psms where loaded_at is not null and source is not null),
g as (select source, t, sum(case when p is null or t >= p + interval 6 hour then 1 else 0 end) over (partition by source order by t rows unbounded preceding) as k from e)
select source, min(t)::timestamp as start, count(*) as n from g group by source, k"""
)
def q80_delivery_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of deliveries of each run, closed by six hours without one."""
    from pepspark import streaming

    p = table(spark, d, "psms").filter("source is not null and loaded_at is not null").select("source", "loaded_at")
    s = streaming.sessions(p, "loaded_at", "source", "6 hours")
    return s.select("source", "start", "n")


# --- every set of constants, and further notations


_RC_SETS = {k.removeprefix("RC_").lower(): v for k, v in sorted(vars(K).items()) if k.startswith("RC_")}


@query(f"with {_PEP} select peptide, " + ", ".join(f"round({_rt_sql('peptide', v)}, 6) as {k}" for k, v in _RC_SETS.items()) + " from pep")
def q97_all_retention_sets(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", *[F.round(C.plain_retention_time("peptide", v), 6).alias(k) for k, v in _RC_SETS.items()])


_PK_SETS = {"lehninger": K.PK_LEHNINGER, "sillero": K.PK_SILLERO, "dawson": K.PK_DAWSON, "rodwell": K.PK_RODWELL, "bjellqvist": K.PK_BJELLQVIST}


@query(f"with {_PEP} select peptide, " + ", ".join(f"round({_charge_sql('peptide', '6.5::double', v)}, 6) as {k}" for k, v in _PK_SETS.items()) + " from pep")
def q98_all_pk_sets(spark: SparkSession, d: str) -> DataFrame:
    return peptides(spark, d).select("peptide", *[F.round(C.charge("peptide", F.lit(6.5), v), 6).alias(k) for k, v in _PK_SETS.items()])


@query(
    f"with m as (select id, min(monoisotopic_mass) as mass from unimod_modification where monoisotopic_mass is not null group by id) select id, 'M[U:' || id || ']K/2' as proforma, round({_lit(K.AA_MASS['M'] + K.AA_MASS['K'] + K.WATER)} + mass, 5) as mass, round(({_lit(K.AA_MASS['M'] + K.AA_MASS['K'] + K.WATER)} + mass) / 2 + {_lit(K.PROTON)}, 5) as mz from m"
)
def q99_proforma_unimod(spark: SparkSession, d: str) -> DataFrame:
    """Every modification of the Unimod table, by its number, in a charged ProForma string."""
    m = table(spark, d, "unimod_modification")
    words = P.Vocabulary.of_table(m)
    t = m.filter("monoisotopic_mass is not null and id is not null").select("id").distinct().withColumn("proforma", F.concat(F.lit("M[U:"), F.col("id").cast("string"), F.lit("]K/2")))
    return t.select("id", "proforma", F.round(P.proforma_mass("proforma", words), 5).alias("mass"), F.round(P.proforma_mz("proforma", vocabulary=words), 5).alias("mz"))


@query(f"with {_PEP} select peptide, " + ", ".join(f"({v} + {extra})::int as n_{e.lower()}" for (e, v), extra in zip(_elements("peptide").items(), (2, 2, 0, 1, 0))) + f", round({_MASS} + {_lit(K.composition_mass(dict(C=2, H=2, O=1)))}, 5) as mass from pep")
def q100_proforma_composition(spark: SparkSession, d: str) -> DataFrame:
    """Composition and mass of acetylated peptides, by formula tag and by name."""
    p = peptides(spark, d).withColumn("c", P.proforma_composition(F.concat(F.lit("[Formula:C2H2O]-"), "peptide")))
    n = [F.coalesce(F.element_at("c", e), F.lit(0)).alias(f"n_{e.lower()}") for e in ("C", "H", "N", "O", "S")]
    return p.select("peptide", *n, F.round(P.proforma_mass(F.concat(F.lit("[Acetyl]-"), "peptide")), 5).alias("mass"))


@query(f"with {_PEP} select peptide, 'Ac-' || replace(peptide, 'M', 'oxM') || '-NH2' as modx, true as n_group, true as c_group, length(peptide)::int as n_residues, 'oxM' as label, peptide[1:1] as first from pep where contains(peptide, 'M')")
def q101_modx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """modX strings taken apart and put together again; their labels and terminal groups told apart."""
    p = peptides(spark, d).filter(F.contains("peptide", F.lit("M"))).withColumn("modx", F.concat(F.lit("Ac-"), F.replace("peptide", F.lit("M"), F.lit("oxM")), F.lit("-NH2")))
    g = p.withColumn("g", S.parse_modx("modx")).withColumn("s", S.split_groups("modx"))
    inner = F.filter("g", lambda x: S.is_modx_label(x))
    label = F.get(F.filter("g", lambda x: F.startswith(x, F.lit("ox"))), F.lit(0))
    return g.select("peptide", S.to_string("g").alias("modx"), S.is_term_group(F.get("g", F.lit(0))).alias("n_group"), S.is_term_group(F.element_at("g", -1)).alias("c_group"), F.size(inner).alias("n_residues"), label.alias("label"), F.get("s", F.lit(0))["aa"].alias("first"))


@query("with s as (select distinct spectrum_id, mz from spectra where len(mz) > 0 and len(list_filter(mz, lambda x: x is null)) = 0) select spectrum_id, unnest(['none-f64', 'zlib-f64', 'none-i32']) as kind, len(mz)::int as n, unnest([list_sum(list_transform(mz, lambda x: round(x * 10000)::bigint)), list_sum(list_transform(mz, lambda x: round(x * 10000)::bigint)), list_sum(list_transform(mz, lambda x: floor(x)::bigint * 10000))])::bigint as total from s")
def q102_binary_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Arrays in three encodings, decoded again; every value counts."""
    s = table(spark, d, "spectra").select("spectrum_id", "mz").filter("size(mz) > 0").filter(~F.exists("mz", lambda x: x.isNull())).distinct()
    kinds = {"none-f64": A.decode_binary(A.encode_binary("mz"), F.lit("none"), F.lit("f64")), "zlib-f64": A.decode_binary(A.encode_binary("mz", compress=True), F.lit("zlib"), F.lit("f64")), "none-i32": A.decode_binary(A.encode_binary(F.transform("mz", lambda x: F.floor(x).cast("double")), dtype="i32"), F.lit("none"), F.lit("i32"))}
    rows = s.select("spectrum_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()])).alias("r")).select("spectrum_id", "r.*")
    total = F.aggregate(F.transform("v", lambda x: F.round(x * 10000).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("spectrum_id", "kind", F.size("v").alias("n"), total.alias("total"))


@query(f"with {_PEP}, c as (select peptide, unnest([1, 2, 3]) as z from pep) select peptide, z::int as charge, z || '+' as text, -z::int as negative, '1+, ' || z || '- and 3+' as list_text from c")
def q103_charge_text(spark: SparkSession, d: str) -> DataFrame:
    """Charges and lists of them as text and back."""
    c = peptides(spark, d).select("peptide", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("charge"))
    text = X.format_charge("charge")
    lists = X.format_charge_list(F.array(F.lit(1), -F.col("charge"), F.lit(3)))
    return c.select("peptide", X.parse_charge(text).alias("charge"), text.alias("text"), F.get(X.parse_charge_list(lists), F.lit(1)).alias("negative"), lists.alias("list_text"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
