"""Per-record metrics of extraction records against gold records, or on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.stage import staged
from strataform.functions.text import canonical_chemical, canonical_concentration, canonical_isotope, canonical_text, item_key, nfkc_all, nonempty, without_molarity
from strataform.operators.match import exact_counts, jaccard, match_counts, prf
from strataform.operators.nested import SECTION_FIELDS

SECTIONS = ("target_materials", "acids_and_solvents", "resins_or_columns", "elution_conditions", "final_products")
#: Sections in which an equal isotope is a match.
ISOTOPE_SECTIONS = ("target_materials", "final_products")
# Success needs at least these completeness and F1, and at most this hallucination rate.
THRESHOLDS = {"completeness": 0.8, "f1": 0.65, "hallucination": 0.25}
# Fields that must be filled (a tuple: any of them), that identify an item, that state a condition.
REQUIRED = {
    "target_materials": [("name", "chemical_formula", "isotope"), ("source_section",)],
    "acids_and_solvents": [("name",), ("type",), ("role",), ("source_section",)],
    "resins_or_columns": [("name",), ("role",), ("source_section",)],
    "elution_conditions": [("eluent",), ("source_section",)],
    "final_products": [("name", "isotope"), ("source_section",)],
}
IDENTITY = {"target_materials": ("name", "isotope", "chemical_formula"), "acids_and_solvents": ("name",), "resins_or_columns": ("name",), "elution_conditions": ("eluent",), "final_products": ("name", "isotope")}
CONDITION = {"target_materials": ("physical_form",), "acids_and_solvents": ("concentration", "role", "type"), "resins_or_columns": ("role", "material", "column_dimensions"), "elution_conditions": ("concentration", "volume", "pH", "flow_rate"), "final_products": ("chemical_form",)}


#: Every field that any section has.
FIELDS = sorted({f for names in SECTION_FIELDS.values() for f in names})


def item_fields(flat: DataFrame) -> DataFrame:
    """flat items (record_key, section, item) -> record_key, section, raw and canon: the texts of FIELDS as written and in
    canonical form. One normal form per item, whatever the number of fields."""
    raw = staged(flat, {"raw": F.array(*[F.col("item")[f] for f in FIELDS])}).select("record_key", "section", "raw")
    both = staged(raw, {"norm": nfkc_all(F.col("raw"))})
    return staged(both, {"canon": F.transform("norm", lambda x: canonical_text(x, False))}).drop("norm")


def item_scores(flat: DataFrame) -> DataFrame:
    """Flat items -> record_key, section, key, checked, filled, score (identity and condition), flagged (without
    provenance or identity)."""
    df = item_fields(flat)
    at = {f: i for i, f in enumerate(FIELDS)}
    canon = {f: F.col("canon")[i] for f, i in at.items()}

    def by_section(f) -> Column:  # noqa: ANN001
        out = F.lit(None)
        for s in SECTIONS:
            out = F.when(F.col("section") == s, f(s)).otherwise(out)
        return out

    some = lambda array, names: F.exists(F.array(*[F.col(array)[at[n]] for n in names]), nonempty)
    # the costly canonical forms, once each: the section says which field they are of
    df = staged(df, {"chem": F.when(F.col("section") == "elution_conditions", without_molarity(canon["eluent"])).when(F.col("section") == "acids_and_solvents", canon["name"])})
    df = staged(df, {"chem": canonical_chemical(F.col("chem"), True)})
    df = staged(df, {"conc": canonical_concentration(canon["concentration"], True)})
    df = staged(df, {"iso": canonical_isotope(canon["isotope"], True)})
    df = staged(df, {"iso_name": F.when(F.col("section") == "final_products", canonical_isotope(canon["name"], True))})
    df = staged(df, {
        "key": by_section(lambda s: item_key(s, canon, F.col("chem"), F.col("conc"), F.col("iso"), F.col("iso_name"))),
        "identity": by_section(lambda s: some("canon", IDENTITY[s])),
        "condition": by_section(lambda s: some("canon", CONDITION[s])),
        "filled": by_section(lambda s: sum((some("raw", names).cast("int") for names in REQUIRED[s]), F.lit(0))),
        "sourced": nonempty(F.col("raw")[at["source_section"]]),
    })
    return df.select(
        "record_key", "section", "key", by_section(lambda s: F.lit(len(REQUIRED[s]))).alias("checked"), "filled", F.when(~F.col("identity"), 0.0).when(F.col("condition"), 1.0).otherwise(0.6).alias("score"),
        (~F.col("sourced") | ~F.col("identity")).alias("flagged"),
    )


def section_stats(scored: DataFrame) -> DataFrame:
    """Per record and section: items, distinct keys, duplicates, filled and checked fields, score, flagged; a row with null
    section, and no items, per record if the flat items have one. Counts combine on the map side; a record's items
    never meet in one task before that."""
    g = scored.groupBy("record_key", "section").agg(
        F.count("section").alias("items"), F.array_sort(F.collect_set(F.nullif("key", F.lit("")))).alias("keys"), F.sum("filled").alias("filled"), F.sum("checked").alias("checked"),
        F.sum(F.when(F.col("section").isNotNull(), F.col("score")).otherwise(0.0)).alias("score"), F.sum((F.col("flagged") & F.col("section").isNotNull()).cast("int")).alias("flagged"),
    )
    return g.withColumn("duplicates", F.col("items") - F.size("keys"))


def record_stats(sections: DataFrame) -> DataFrame:
    """Per record: completeness over the five sections, duplicate rate, schema validity, accuracy and
    hallucination by heuristics (0 for a record without items), keys tagged by section."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0))
    return sections.groupBy("record_key").agg(
        (F.sum((F.col("items") > 0).cast("int")) / len(SECTIONS)).alias("completeness"), F.sum("items").alias("items_total"), F.sum("duplicates").alias("duplicates"),
        rate("duplicates", "items").alias("duplicate_rate"), rate("filled", "checked").alias("schema_validity"), rate("score", "items").alias("heuristic_accuracy"), rate("flagged", "items").alias("heuristic_hallucination"),
        F.count_if(F.col("items") > 0).alias("sections"), F.map_from_entries(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("section", "keys")))).alias("keys"),
    )


def gold_report(pairs: DataFrame, pred: str = "pred", gold: str = "gold", exact: bool = False) -> DataFrame:
    """pairs holds pred and gold as map<section, keys>. Adds per section counts, micro (keys tagged by their
    section, no isotope shortcut), macro, Jaccard, hallucination."""
    def counts(p: Column, g: Column, iso: bool) -> Column:
        return exact_counts(p, g) if exact else match_counts(p, g, iso)

    per = {f"c_{s}": counts(F.col(pred)[s], F.col(gold)[s], s in ISOTOPE_SECTIONS) for s in SECTIONS}

    def tagged(c: str) -> Column:
        return F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda k: F.concat(e["key"], F.lit(":"), k))))

    df = staged(pairs, per | {"c_micro": counts(tagged(pred), tagged(gold), False)})
    cols = {}
    sums = {x: sum((F.col(f"c_{s}")[x] for s in SECTIONS[1:]), F.col(f"c_{SECTIONS[0]}")[x]) for x in ("tp", "fp", "fn")}
    for name, c in prf(F.col("c_micro")).items():
        cols[f"micro_{name}"] = c
    for name in ("precision", "recall", "f1"):
        cols[f"macro_{name}"] = sum((prf(F.col(f"c_{s}"))[name] for s in SECTIONS[1:]), prf(F.col(f"c_{SECTIONS[0]}"))[name]) / len(SECTIONS)
    cols["jaccard_micro"] = jaccard(F.col("c_micro"))
    cols["fabricated"], cols["matched"], cols["missed"] = sums["fp"], sums["tp"], sums["fn"]
    cols["hallucination_rate"] = sums["fp"].cast("double") / F.greatest(sums["tp"] + sums["fp"], F.lit(1))
    return df.withColumns(cols)


def task_success(completeness: Column, f1: Column, hallucination: Column, sections: Column) -> Column:
    """All thresholds met and no required section empty."""
    t = THRESHOLDS
    return (completeness >= t["completeness"]) & (f1 >= t["f1"]) & (hallucination <= t["hallucination"]) & (sections >= len(SECTIONS))


def score_records(flat: DataFrame) -> DataFrame:
    """record_stats of flat items of all sections."""
    return record_stats(section_stats(item_scores(flat)))
