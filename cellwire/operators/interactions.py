"""Ligand-receptor tables: component resolution, coverage and order.

Tables: ``lr(lr_index, interaction_name, ligand, receptor, annotation, agonist, antagonist,
co_A_receptor, co_I_receptor)``, ``complexes(name, member)`` and ``cofactors(name, member)``.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwire.operators.ranking import running
from cellwire.operators.session import materialize

# Order of the interaction classes; other classes come last.
ANNOTATION_ORDER = [
    "Secreted Signaling",
    "ECM-Receptor",
    "Non-protein Signaling",
    "Cell-Cell Contact",
]
CONTACT = "Cell-Cell Contact"
COFACTOR_ROLES = ["co_A_receptor", "co_I_receptor", "agonist", "antagonist"]


class Interactions(NamedTuple):
    """Complete interactions and their genes (lr_index, role, gene, required, direct)."""

    lr: DataFrame
    members: DataFrame


def order_interactions(lr: DataFrame) -> DataFrame:
    """Renumber ``lr_index`` by interaction class, keeping the given order inside a class."""
    rank = F.lit(len(ANNOTATION_ORDER) + 1)
    for i, name in enumerate(ANNOTATION_ORDER):
        rank = F.when(F.col("annotation") == name, F.lit(i + 1)).otherwise(rank)
    ranked = lr.withColumn("_class", rank)
    placed = running(ranked, [], [F.col("lr_index")], F.lit(1), "_place", "_class")
    return placed.withColumn("input_index", F.col("lr_index")).withColumn(
        "lr_index", F.col("_place").cast("int")
    ).drop("_class", "_place")


def _named(column: str):
    return F.col(column).isNotNull() & (F.length(column) > 0)


def component_members(
    lr: DataFrame, genes: DataFrame, complexes: DataFrame, cofactors: DataFrame
) -> DataFrame:
    """One row per (interaction, role, member gene) with flags ``measured`` and ``direct``.

    A measured ligand or receptor name is the gene itself even if a complex has the same name;
    otherwise a complex stands for its non-blank members, and any other name for itself.
    """
    roles = ["ligand", "receptor", *[c for c in COFACTOR_ROLES if c in lr.columns]]
    named = lr.select("lr_index", F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).cast("string").alias("component")) for r in roles
    ])).alias("_p")).select("lr_index", "_p.*").where(_named("component"))
    known = genes.select("gene").distinct()
    kind = F.when(F.col("role").isin("ligand", "receptor"), "complex").otherwise("cofactor")
    marked = named.withColumn("_kind", kind).join(
        known.select(F.col("gene").alias("component"), F.lit(True).alias("_gene")), "component", "left"
    ).withColumn("direct", F.col("_gene").isNotNull() & (F.col("_kind") == "complex"))
    # Definitions only match names that are not taken directly.
    definitions = complexes.select(F.lit("complex").alias("_kind"), F.col("name").alias("component"), "member").unionByName(
        cofactors.select(F.lit("cofactor").alias("_kind"), F.col("name").alias("component"), "member")
    ).withColumns({"direct": F.lit(False), "_defined": F.lit(True)})
    members = marked.join(definitions, ["_kind", "component", "direct"], "left").withColumn(
        "member", F.when(F.col("_defined"), F.col("member")).otherwise(F.col("component"))
    ).where(_named("member"))
    measured = known.select(F.col("gene").alias("member"), F.lit(True).alias("_measured"))
    return members.join(measured, "member", "left").select(
        "lr_index", "role", "component", "member", "direct",
        F.col("_measured").isNotNull().alias("measured"),
    )


def coverage_audit(
    lr: DataFrame, genes: DataFrame, complexes: DataFrame, cofactors: DataFrame
) -> DataFrame:
    """Per interaction: resolved genes, missing genes, validity and the reasons."""
    return audit_members(lr, component_members(lr, genes, complexes, cofactors))


def audit_members(lr: DataFrame, members: DataFrame) -> DataFrame:
    joined = lambda cond: F.concat_ws(";", F.sort_array(F.collect_list(F.when(cond, F.col("member")))))
    lig, rec = F.col("role") == "ligand", F.col("role") == "receptor"
    # An interaction has a bounded number of member genes, so the lists stay short.
    sums = members.where(lig | rec).groupBy("lr_index").agg(
        F.count(F.when(lig, 1)).alias("_nl"), F.count(F.when(rec, 1)).alias("_nr"),
        joined(lig).alias("ligand_genes"), joined(rec).alias("receptor_genes"),
        joined(lig & ~F.col("measured")).alias("missing_ligand_genes"),
        joined(rec & ~F.col("measured")).alias("missing_receptor_genes"),
    )
    out = lr.join(sums, "lr_index", "left").fillna(
        {"_nl": 0, "_nr": 0, "ligand_genes": "", "receptor_genes": "",
         "missing_ligand_genes": "", "missing_receptor_genes": ""})
    reason = F.concat_ws(
        ";",
        F.when(F.col("_nl") == 0, "unresolved_ligand_definition"),
        F.when(F.col("_nr") == 0, "unresolved_receptor_definition"),
        F.when(F.col("missing_ligand_genes") != "", "missing_ligand_genes"),
        F.when(F.col("missing_receptor_genes") != "", "missing_receptor_genes"),
    )
    return out.withColumn("valid", reason == "").withColumn(
        "reason", F.when(reason == "", "complete").otherwise(reason)
    ).select("lr_index", "interaction_name", "ligand", "receptor", "ligand_genes", "receptor_genes",
             "missing_ligand_genes", "missing_receptor_genes", "valid", "reason")


def missing_genes(
    lr: DataFrame, genes: DataFrame, complexes: DataFrame, cofactors: DataFrame
) -> DataFrame:
    """One row per absent gene and role; absent cofactor genes are not required."""
    members = component_members(lr, genes, complexes, cofactors).join(
        lr.select("lr_index", "interaction_name"), "lr_index")
    return members.where("NOT measured").select(
        "lr_index", "interaction_name", "role", "component", F.col("member").alias("gene"),
        F.col("role").isin("ligand", "receptor").alias("required"),
    )


def prepare_interactions(
    lr: DataFrame,
    genes: DataFrame,
    complexes: DataFrame,
    cofactors: DataFrame,
    missing: str = "error",
) -> Interactions:
    """Resolve all roles. Incomplete interactions are an error or are left out (``filter``).

    The two results are dictionaries of the size of the interaction table. They are stored once,
    because every later step joins them; the planner then knows their size.
    """
    resolved = materialize(component_members(lr, genes, complexes, cofactors))
    audit = audit_members(lr, resolved)
    if missing == "error":
        first = audit.where("NOT valid").select("interaction_name", "reason").first()
        if first is not None:
            raise ValueError(f"incomplete interaction {first[0]}: {first[1]}")
    mine = F.col("role")
    counts = resolved.where("measured").groupBy("lr_index").agg(
        ((F.count(F.when(mine == "ligand", 1)) == 1) & (F.count(F.when(mine == "receptor", 1)) == 1)
         & (F.count(F.when(~mine.isin("ligand", "receptor"), 1)) == 0)).alias("_single"))
    has = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0) if c in lr.columns else F.lit(False)
    full = (
        lr.join(audit.where("valid").select("lr_index"), "lr_index", "left_semi").join(counts, "lr_index")
        .withColumns({"has_agonist": has("agonist"), "has_antagonist": has("antagonist")})
        .withColumn("simple", F.col("_single") & ~F.col("has_agonist") & ~F.col("has_antagonist"))
        .drop("_single")
    )
    full = materialize(full)
    whole = W.partitionBy("lr_index", "role")
    members = resolved.where("measured").join(full.select("lr_index"), "lr_index", "left_semi").select(
        "lr_index", "role", F.col("member").alias("gene"), F.count(F.lit(1)).over(whole).alias("required"), "direct")
    return Interactions(full, materialize(members))


def mark_contact(lr: DataFrame, contact_dependent: bool = True, forced: bool = False) -> DataFrame:
    """Add ``contact``: the interactions that only act within the contact range."""
    if forced:
        flag = F.lit(True)
    elif contact_dependent and "annotation" in lr.columns:
        flag = F.coalesce(F.col("annotation") == CONTACT, F.lit(False))
    else:
        flag = F.lit(False)
    return lr.withColumn("contact", flag)
