"""The seed graph of the factor jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import make_events
from ..operators.graph import KINDS

# Nodes by layer, as (id, label).
NODES = [
    [("RAW_SILICA_SAND", "Silica Sand"), ("RAW_FLUORSPAR", "Fluorspar"), ("RAW_IRON_ORE", "Iron Ore"), ("RAW_COKING_COAL", "Coking Coal"), ("RAW_CRUDE", "Crude Oil"), ("RAW_SODA_ASH", "Soda Ash")],
    [
        ("INT_POLYSILICON", "Polysilicon"),
        ("INT_AHF", "Anhydrous Hydrogen Fluoride"),
        ("INT_CRGO_STEEL", "CRGO Steel"),
        ("INT_INDUSTRIAL_SULFURIC_ACID", "Industrial Sulfuric Acid"),
        ("INT_HIGH_PURITY_SILICA", "High-Purity Silica"),
        ("INT_DENSE_SODA_ASH", "Dense Soda Ash"),
        ("INT_CALCINED_CARBON", "Calcined Carbon Feed"),
    ],
    [
        ("COMP_TRANSFORMER_CORES", "Transformer Cores"),
        ("COMP_SOLAR_GLASS", "Solar Glass"),
        ("COMP_REFRACTORY_BRICKS", "Refractory Bricks"),
        ("COMP_PV_CELLS", "PV Cells"),
        ("COMP_FLUOROCHEMICAL_FEED", "Fluorochemical Feedstock"),
        ("COMP_CHEMICAL_PROCESS_INPUTS", "Chemical Process Inputs"),
    ],
    [
        ("SUB_POWER_TRANSFORMERS", "Power Transformers"),
        ("SUB_PV_MODULES", "PV Modules"),
        ("SUB_BULK_APIS", "Bulk APIs"),
        ("SUB_SOLAR_GLASS_MANUFACTURING", "Solar Glass Manufacturing"),
        ("SUB_FLUOROCHEMICAL_OPERATIONS", "Fluorochemical Operations"),
        ("SUB_SPECIALTY_CHEMICAL_OPERATIONS", "Specialty Chemical Operations"),
        ("SUB_HIGH_TEMP_PROCESS_SYSTEMS", "High-Temperature Process Systems"),
    ],
    [("TRIL.NS", "TRIL.NS"), ("VOLTAMP.NS", "VOLTAMP.NS"), ("BORORENEW.NS", "BORORENEW.NS"), ("SRF.NS", "SRF.NS"), ("NAVINFLUOR.NS", "NAVINFLUOR.NS"), ("AARTIIND.NS", "AARTIIND.NS")],
]
# Edges, as (source, target, substitutability, cost share, lead time in months).
EDGES = [
    ("RAW_SILICA_SAND", "INT_HIGH_PURITY_SILICA", 0.20, 0.70, 3.0),
    ("RAW_SILICA_SAND", "INT_POLYSILICON", 0.35, 0.40, 8.0),
    ("RAW_FLUORSPAR", "INT_AHF", 0.20, 0.75, 6.0),
    ("RAW_IRON_ORE", "INT_CRGO_STEEL", 0.30, 0.22, 4.0),
    ("RAW_COKING_COAL", "INT_CRGO_STEEL", 0.25, 0.18, 5.0),
    ("RAW_COKING_COAL", "INT_CALCINED_CARBON", 0.20, 0.55, 4.0),
    ("RAW_CRUDE", "INT_INDUSTRIAL_SULFURIC_ACID", 0.65, 0.08, 2.0),
    ("RAW_SODA_ASH", "INT_DENSE_SODA_ASH", 0.10, 0.90, 3.0),
    ("INT_CRGO_STEEL", "COMP_TRANSFORMER_CORES", 0.08, 0.62, 7.0),
    ("INT_HIGH_PURITY_SILICA", "COMP_SOLAR_GLASS", 0.15, 0.45, 5.0),
    ("INT_DENSE_SODA_ASH", "COMP_SOLAR_GLASS", 0.25, 0.18, 4.0),
    ("INT_POLYSILICON", "COMP_PV_CELLS", 0.12, 0.55, 6.0),
    ("INT_AHF", "COMP_FLUOROCHEMICAL_FEED", 0.10, 0.80, 5.0),
    ("INT_INDUSTRIAL_SULFURIC_ACID", "COMP_CHEMICAL_PROCESS_INPUTS", 0.30, 0.25, 2.0),
    ("INT_CALCINED_CARBON", "COMP_REFRACTORY_BRICKS", 0.25, 0.35, 5.0),
    ("COMP_TRANSFORMER_CORES", "SUB_POWER_TRANSFORMERS", 0.06, 0.34, 9.0),
    ("COMP_SOLAR_GLASS", "SUB_PV_MODULES", 0.25, 0.10, 3.0),
    ("COMP_PV_CELLS", "SUB_PV_MODULES", 0.15, 0.55, 5.0),
    ("COMP_SOLAR_GLASS", "SUB_SOLAR_GLASS_MANUFACTURING", 0.05, 0.82, 4.0),
    ("COMP_FLUOROCHEMICAL_FEED", "SUB_FLUOROCHEMICAL_OPERATIONS", 0.25, 0.60, 8.0),
    ("COMP_CHEMICAL_PROCESS_INPUTS", "SUB_BULK_APIS", 0.40, 0.28, 3.0),
    ("COMP_CHEMICAL_PROCESS_INPUTS", "SUB_SPECIALTY_CHEMICAL_OPERATIONS", 0.35, 0.30, 4.0),
    ("COMP_REFRACTORY_BRICKS", "SUB_HIGH_TEMP_PROCESS_SYSTEMS", 0.30, 0.12, 5.0),
    ("SUB_POWER_TRANSFORMERS", "TRIL.NS", 0.10, 0.72, 9.0),
    ("SUB_POWER_TRANSFORMERS", "VOLTAMP.NS", 0.12, 0.68, 8.0),
    ("SUB_SOLAR_GLASS_MANUFACTURING", "BORORENEW.NS", 0.05, 0.85, 6.0),
    ("SUB_FLUOROCHEMICAL_OPERATIONS", "SRF.NS", 0.10, 0.50, 6.0),
    ("SUB_FLUOROCHEMICAL_OPERATIONS", "NAVINFLUOR.NS", 0.05, 0.55, 7.0),
    ("SUB_SPECIALTY_CHEMICAL_OPERATIONS", "AARTIIND.NS", 0.15, 0.62, 5.0),
]


def nodes(spark: SparkSession) -> DataFrame:
    rows = [(i, label, layer, KINDS[layer], i if layer == 4 else None) for layer, part in enumerate(NODES) for i, label in part]
    return spark.createDataFrame(rows, "node_id string, label string, layer int, kind string, ticker string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "source string, target string, substitutability double, cost_share double, lead_time_months double")


# The events of the mock source, as (event type, title, url, text, node).
MOCK_EVENTS = [
    ("qco", "Quality requirements for CRGO transformer cores", "mock://transformer", "Qualified CRGO transformer core inputs face long qualification lead times.", "COMP_TRANSFORMER_CORES"),
    ("trade_remedy", "Trade remedy concerning textured tempered solar glass", "mock://solar", "Imported solar glass faces domestic trade protection.", "COMP_SOLAR_GLASS"),
    ("trade_policy", "Supply constraints in fluorochemical feedstock", "mock://fluor", "Fluorochemical feedstock has concentrated supply and switching constraints.", "COMP_FLUOROCHEMICAL_FEED"),
]


def mock_events(spark: SparkSession, as_of: date) -> DataFrame:
    """Three events of one day for dry runs, each with the node that it is about."""
    rows = spark.createDataFrame([(*e, as_of) for e in MOCK_EVENTS], "type string, title string, url string, text string, node string, day date")
    col = F.col
    return make_events(rows, source=F.lit("MOCK"), event_type=col("type"), published_date=col("day"), title=col("title"), url=col("url"), text=col("text"), metadata=F.create_map(F.lit("candidate_node"), col("node")), fetched_at=col("day").cast("timestamp"))
