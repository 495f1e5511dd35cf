"""Spatial tables derived from the given tables, as DataFrames and as SQL common table expressions.

``embeddings`` gives cells and expression, ``lineitem`` and ``part`` give binned counts with
positions and mixture weights, ``orders`` and ``customer`` give a patient cohort. The interaction
table is a small dictionary, like the curated tables users bring.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwire.operators.interactions import Interactions, prepare_interactions

# Interaction dictionary over the derived gene names g02..g63.
LR_VALUES = """
 (1, 'g02_g03', 'g02', 'g03', 'Secreted Signaling', '', '', '', '', 'P1'),
 (2, 'g04_g05', 'g04', 'g05', 'ECM-Receptor', '', '', '', '', 'P1'),
 (3, 'LC1_g08', 'LC1', 'g08', 'Secreted Signaling', '', '', '', '', 'P2'),
 (4, 'g09_RC1', 'g09', 'RC1', 'Cell-Cell Contact', '', '', '', '', 'P2'),
 (5, 'LC2_g13', 'LC2', 'g13', 'Secreted Signaling', '', '', '', '', 'P3'),
 (6, 'g14_g15', 'g14', 'g15', 'Secreted Signaling', 'AG1', 'AN1', 'CA1', 'CI1', 'P3'),
 (7, 'g21_g22', 'g21', 'g22', 'Non-protein Signaling', 'AG1', '', '', '', 'P4'),
 (8, 'g23_g26', 'g23', 'g26', 'Secreted Signaling', '', '', '', '', 'P4'),
 (9, 'g27_gZZ', 'g27', 'gZZ', 'Secreted Signaling', '', '', '', '', 'P5'),
 (10, 'RC2_g29', 'RC2', 'g29', 'ECM-Receptor', '', '', '', '', 'P5'),
 (11, 'g30_g31', 'g30', 'g31', 'Cell-Cell Contact', '', '', '', '', 'P6'),
 (12, 'LC1_RC1', 'LC1', 'RC1', 'Secreted Signaling', '', 'g33', 'g32', '', 'P6'),
 (13, 'g34_EC1', 'g34', 'EC1', 'Other', '', '', '', '', 'P7'),
 (14, 'g35_g36', 'g35', 'g36', 'Other', '', '', '', '', 'P7')
"""
LR_COLUMNS = ("lr_index, interaction_name, ligand, receptor, annotation, agonist, antagonist, "
              "co_A_receptor, co_I_receptor, pathway_name")
COMPLEX_VALUES = """
 ('LC1', 'g06'), ('LC1', 'g07'), ('RC1', 'g10'), ('RC1', 'g11'), ('LC2', 'g12'),
 ('g23', 'g24'), ('g23', 'g25'), ('RC2', 'g28'), ('RC2', 'gYY'), ('EC1', '')
"""
COFACTOR_VALUES = """
 ('AG1', 'g16'), ('AG1', 'g17'), ('AN1', 'g18'), ('CA1', 'g19'), ('CA1', 'gXX'), ('CI1', 'g20')
"""
# The members of the complete interactions, resolved by hand for the checks.
MEMBER_VALUES = """
 (1,'ligand','g02',1,true),(1,'receptor','g03',1,true),(2,'ligand','g04',1,true),(2,'receptor','g05',1,true),
 (3,'ligand','g06',2,false),(3,'ligand','g07',2,false),(3,'receptor','g08',1,true),
 (4,'ligand','g09',1,true),(4,'receptor','g10',2,false),(4,'receptor','g11',2,false),
 (5,'ligand','g12',1,false),(5,'receptor','g13',1,true),
 (6,'ligand','g14',1,true),(6,'receptor','g15',1,true),(6,'agonist','g16',2,false),(6,'agonist','g17',2,false),
 (6,'antagonist','g18',1,false),(6,'co_A_receptor','g19',1,false),(6,'co_I_receptor','g20',1,false),
 (7,'ligand','g21',1,true),(7,'receptor','g22',1,true),(7,'agonist','g16',2,false),(7,'agonist','g17',2,false),
 (8,'ligand','g23',1,true),(8,'receptor','g26',1,true),
 (11,'ligand','g30',1,true),(11,'receptor','g31',1,true),
 (12,'ligand','g06',2,false),(12,'ligand','g07',2,false),(12,'receptor','g10',2,false),(12,'receptor','g11',2,false),
 (12,'antagonist','g33',1,false),(12,'co_A_receptor','g32',1,false),
 (14,'ligand','g35',1,true),(14,'receptor','g36',1,true)
"""
LR = f"lr AS (SELECT * FROM (VALUES {LR_VALUES}) AS t({LR_COLUMNS}))"
COMPLEXES = f"complexes AS (SELECT * FROM (VALUES {COMPLEX_VALUES}) AS t(name, member))"
COFACTORS = f"cofactors AS (SELECT * FROM (VALUES {COFACTOR_VALUES}) AS t(name, member))"
MEMBERS = f"mem AS (SELECT * FROM (VALUES {MEMBER_VALUES}) AS t(lr_index, role, gene, required, direct))"
CELLS = """cells AS (SELECT 'S' || CAST(vec_id % 4 AS VARCHAR) AS sample_id, 'c' || CAST(vec_id AS VARCHAR) AS cell_id,
  100 * CAST(embedding[1] AS DOUBLE) AS x, 100 * CAST(embedding[2] AS DOUBLE) AS y, 'G' || CAST(label AS VARCHAR) AS "group",
  'K' || CAST(vec_id % 2 AS VARCHAR) AS compartment, vec_id FROM embeddings)"""
EXPR = """expr AS (SELECT 'S' || CAST(vec_id % 4 AS VARCHAR) AS sample_id, 'c' || CAST(vec_id AS VARCHAR) AS cell_id,
  'g' || lpad(CAST(i AS VARCHAR), 2, '0') AS gene, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM embeddings, range(2, 64) AS t(i) WHERE embedding[i + 1] > 0)"""
GENES = "genes AS (SELECT DISTINCT gene FROM expr)"
COUNTS = """counts AS (SELECT l_partkey AS barcode, l_suppkey AS feature_id, 'f' || CAST(l_suppkey % 60 AS VARCHAR) AS gene,
  CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3)"""
POSITIONS = """positions AS (SELECT p_partkey AS barcode, CAST(p_partkey // 64 AS BIGINT) AS array_row,
  CAST(p_partkey % 64 AS BIGINT) AS array_col, CASE WHEN p_size > 10 THEN 1 ELSE 0 END AS in_tissue FROM part)"""
WEIGHTS = """raw_weights AS (SELECT l_partkey AS barcode, 'T' || CAST(l_suppkey % 6 AS VARCHAR) AS cell_type,
  CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
weights AS (SELECT barcode, cell_type, w / sum(w) OVER (PARTITION BY barcode) AS w FROM raw_weights)"""
COHORT = """sections AS (SELECT o.o_custkey AS patient_id, o.o_custkey || '-' || CAST(quarter(o.o_orderdate) % 2 AS VARCHAR) AS section_id,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Disease' ELSE 'Control' END AS condition,
  'run' || CAST(c.c_nationkey % 3 AS VARCHAR) AS run,
  o.o_orderpriority || '/' || o.o_orderstatus AS feature_id, o.o_totalprice AS price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
units AS (SELECT DISTINCT section_id, patient_id, condition, run FROM sections),
scores AS (SELECT section_id, patient_id, condition, feature_id, sum(price) / 1e6 AS score FROM sections GROUP BY 1, 2, 3, 4),
features AS (SELECT DISTINCT feature_id FROM scores),
patients AS (SELECT DISTINCT patient_id, condition, run FROM units)"""
# Every (section, feature) with zeros, and the patient means of log1p(score).
DENSE = """dense AS (SELECT u.section_id, u.patient_id, u.condition, u.run, f.feature_id, coalesce(s.score, 0) AS score
  FROM units u CROSS JOIN features f LEFT JOIN scores s ON s.section_id = u.section_id AND s.feature_id = f.feature_id),
py AS (SELECT patient_id, condition, run, feature_id, avg(ln(1 + score)) AS y, avg(score) AS m, max(score) AS top
  FROM dense GROUP BY 1, 2, 3, 4)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(spark: SparkSession, cte: str, name: str) -> DataFrame:
    return spark.sql(f"WITH {cte} SELECT * FROM {name}")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return e.select(
        text("S", F.col("vec_id") % 4).alias("sample_id"), text("c", F.col("vec_id")).alias("cell_id"),
        (F.lit(100.0) * F.element_at("embedding", 1).cast("double")).alias("x"),
        (F.lit(100.0) * F.element_at("embedding", 2).cast("double")).alias("y"),
        text("G", F.col("label")).alias("group"), text("K", F.col("vec_id") % 2).alias("compartment"),
    )


def expression(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.where("i >= 2 AND v > 0").select(
        F.concat(F.lit("S"), (F.col("vec_id") % 4).cast("string")).alias("sample_id"),
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("cell_id"),
        F.concat(F.lit("g"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("gene"),
        F.col("v").cast("double").alias("value"),
    )


def genes(spark: SparkSession, folder: str) -> DataFrame:
    return expression(spark, folder).select("gene").distinct()


def lr(spark: SparkSession) -> DataFrame:
    return values(spark, LR, "lr")


def dictionaries(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return lr(spark), values(spark, COMPLEXES, "complexes"), values(spark, COFACTORS, "cofactors")


_PREPARED: dict = {}


def interactions(spark: SparkSession, folder: str) -> Interactions:
    """Resolved interactions, prepared once per application and folder and then shared."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PREPARED:
        table_, complexes, cofactors = dictionaries(spark)
        _PREPARED[key] = prepare_interactions(table_, genes(spark, folder), complexes, cofactors, "filter")
    return _PREPARED[key]


def counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").alias("barcode"), F.col("l_suppkey").alias("feature_id"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 60).cast("string")).alias("gene"),
    ).agg(F.sum("l_quantity").cast("long").alias("n"))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, folder, "part").select(
        p.alias("barcode"), F.floor(p / 64).alias("array_row"), (p % 64).alias("array_col"),
        F.when(F.col("p_size") > 10, 1).otherwise(0).alias("in_tissue"),
    )


def raw_weights(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").alias("barcode"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 6).cast("string")).alias("cell_type"),
    ).agg(F.sum("l_quantity").alias("w"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("patient_id"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), (F.quarter("o_orderdate") % 2).cast("string")).alias("section_id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Disease").otherwise("Control").alias("condition"),
        F.concat(F.lit("run"), (F.col("c_nationkey") % 3).cast("string")).alias("run"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("feature_id"),
        F.col("o_totalprice").alias("price"),
    )


def cohort(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(scores, units): nonzero section scores and one row per section."""
    s = sections(spark, folder)
    scores = s.groupBy("section_id", "feature_id").agg((F.sum("price") / 1e6).alias("score"))
    return scores, s.select("section_id", "patient_id", "condition", "run").distinct()
