"""The Unimod database as tables: loading its XML, look-ups, SQL, compositions of bricks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.functions.text import parse_bool
from pepspark.sources.xml import read_xml

#: Tables of the relational XML: table -> (row tag, columns: name -> (attribute, type)).
TABLES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "modification": ("modifications_row", {"id": ("record_id", "bigint"), "full_name": ("full_name", "string"), "code_name": ("code_name", "string"), "ex_code_name": ("ex_code_name", "string"), "monoisotopic_mass": ("mono_mass", "double"), "average_mass": ("avge_mass", "double"), "composition": ("composition", "string"), "approved": ("approved", "boolean")}),
    "alt_name": ("alt_names_row", {"id": ("record_id", "bigint"), "alt_name": ("alt_name", "string"), "modification_id": ("mod_key", "bigint")}),
    "amino_acid": ("amino_acids_row", {"id": ("record_id", "bigint"), "full_name": ("full_name", "string"), "one_letter": ("one_letter", "string"), "three_letter": ("three_letter", "string"), "num_h": ("num_H", "int"), "num_o": ("num_O", "int"), "num_c": ("num_C", "int"), "num_n": ("num_N", "int"), "num_s": ("num_S", "int")}),
    "classification": ("classifications_row", {"id": ("record_id", "bigint"), "classification": ("classification", "string")}),
    "position": ("positions_row", {"id": ("record_id", "bigint"), "position": ("position", "string")}),
    "element": ("elements_row", {"id": ("record_id", "bigint"), "element": ("element", "string"), "full_name": ("full_name", "string"), "monoisotopic_mass": ("mono_mass", "double"), "average_mass": ("avge_mass", "double")}),
    "brick": ("bricks_row", {"id": ("record_id", "bigint"), "brick": ("brick", "string"), "full_name": ("full_name", "string")}),
    "brick2element": ("brick2element_row", {"id": ("record_id", "bigint"), "brick_id": ("brick_key", "bigint"), "element": ("element", "string"), "count": ("num_element", "int")}),
    "mod2brick": ("mod2brick_row", {"id": ("record_id", "bigint"), "modification_id": ("mod_key", "bigint"), "brick": ("brick", "string"), "count": ("num_brick", "int")}),
    "fragment": ("fragments_row", {"id": ("record_id", "bigint"), "modification_id": ("mod_key", "bigint")}),
    "fragment_comp": ("fragment_comp_row", {"id": ("record_id", "bigint"), "fragment_id": ("fragments_key", "bigint"), "brick": ("brick", "string"), "count": ("num_brick", "int")}),
    "specificity": ("specificity_row", {"id": ("record_id", "bigint"), "modification_id": ("mod_key", "bigint"), "position_id": ("position_key", "bigint"), "classification_id": ("classifications_key", "bigint"), "amino_acid": ("one_letter", "string"), "spec_group": ("spec_group", "int"), "hidden": ("hidden", "boolean")}),
    "neutral_loss": ("neutral_losses_row", {"id": ("record_id", "bigint"), "brick": ("brick", "string"), "count": ("num_brick", "int"), "spec_nl_id": ("spec_nl_key", "bigint")}),
    "spec2nl": ("spec2nl_row", {"id": ("record_id", "bigint"), "specificity_id": ("spec_key", "bigint"), "monoisotopic_mass": ("nl_mono_mass", "double"), "average_mass": ("nl_avge_mass", "double"), "composition": ("nl_composition", "string"), "is_req_peptide_neutral_loss": ("is_req_pep_nl", "boolean"), "is_slave": ("is_slave_nl", "boolean"), "is_peptide_neutral_loss": ("is_pep_nl", "boolean")}),
    "xref": ("xrefs_row", {"id": ("record_id", "bigint"), "source_id": ("xref_source_key", "bigint"), "text": ("xref_text", "string"), "url": ("xref_url", "string"), "modification_id": ("mod_key", "bigint")}),
    "xref_source": ("xref_sources_row", {"id": ("record_id", "bigint"), "source": ("xref_source", "string")}),
    "notes": ("mod_notes_row", {"id": ("record_id", "bigint"), "modification_id": ("mod_key", "bigint"), "text": ("misc_notes", "string")}),
}


def read_unimod_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The 17 tables of a Unimod relational XML file; rows without an id are left out."""
    out = {}
    for name, (tag, columns) in TABLES.items():
        raw = read_xml(spark, path, tag, ", ".join(f"`_{a}` string" for a, _ in columns.values()))
        cast = lambda a, t: parse_bool(f"_{a}") if t == "boolean" else F.col(f"_{a}").try_cast(t)
        out[name] = raw.select(*[cast(a, t).alias(c) for c, (a, t) in columns.items()]).filter("id is not null")
    return out


class Unimod:
    """Look-ups over the tables (a dict of name -> DataFrame). Results are DataFrames, possibly empty; repeated rows come once."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @property
    def modifications(self) -> DataFrame:
        return self.tables["modification"]

    def by_id(self, number: int) -> DataFrame:
        return self.modifications.filter(F.col("id") == number).distinct()

    def by_name(self, name: str, strict: bool = True) -> DataFrame:
        c = F.col("full_name")
        return self.modifications.filter(c == name if strict else F.contains(c, F.lit(name))).distinct()

    def by_code(self, code: str, strict: bool = True) -> DataFrame:
        cond = F.lit(False)
        for c in ("code_name", "ex_code_name"):
            cond = cond | F.coalesce(F.col(c) == code if strict else F.contains(F.col(c), F.lit(code)), F.lit(False))
        return self.modifications.filter(cond).distinct()

    def by_alternative_name(self, name: str, strict: bool = True) -> DataFrame:
        c = F.col("alt_name")
        hits = self.tables["alt_name"].filter(c == name if strict else F.contains(c, F.lit(name))).select(F.col("modification_id").alias("id"))
        return self.modifications.join(hits, "id", "left_semi").distinct()

    def search(self, part: str) -> DataFrame:
        """Modifications with the text in any of their three names."""
        cond = F.lit(False)
        for c in ("full_name", "code_name", "ex_code_name"):
            cond = cond | F.coalesce(F.contains(F.col(c), F.lit(part)), F.lit(False))
        return self.modifications.filter(cond).distinct()

    def get(self, identifier: int | str, strict: bool = True) -> DataFrame:
        """By id, else by the names, else by an alternative name (the first of these that finds something)."""
        if isinstance(identifier, int):
            return self.by_id(identifier)
        found = self.search(identifier) if not strict else self.by_name(identifier).unionByName(self.by_code(identifier)).distinct()
        return found if not found.isEmpty() else self.by_alternative_name(identifier, strict)

    def brick_compositions(self) -> DataFrame:
        """brick, composition (element -> count) of every brick."""
        rows = self.tables["brick"].select(F.col("id").alias("brick_id"), "brick").join(self.tables["brick2element"].select("brick_id", "element", "count"), "brick_id")
        sums = rows.groupBy("brick", "element").agg(F.sum("count").cast("int").alias("n"))
        return sums.groupBy("brick").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "n")))).alias("composition"))

    def _composed(self, rows: DataFrame, key: str) -> DataFrame:
        bricks = self.brick_compositions().select("brick", F.explode("composition").alias("element", "n"))
        sums = rows.select(key, "brick", "count").join(bricks, "brick").groupBy(key, "element").agg(F.sum(F.col("count") * F.col("n")).cast("int").alias("n"))
        return sums.filter("n <> 0").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "n")))).alias("composition"))

    def fragment_compositions(self) -> DataFrame:
        """fragment_id, composition of each fragment of a modification."""
        return self._composed(self.tables["fragment_comp"], "fragment_id")

    def modification_compositions(self) -> DataFrame:
        """modification_id, composition: the bricks of each modification taken apart into elements."""
        return self._composed(self.tables["mod2brick"], "modification_id")

    def sql(self, statement: str) -> DataFrame:
        """SQL in which {name} stands for a table."""
        spark = next(iter(self.tables.values())).sparkSession
        used = {n: t for n, t in self.tables.items() if "{" + n + "}" in statement}
        return spark.sql(statement, **used)
