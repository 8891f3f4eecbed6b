"""Events to graph nodes, and the documents of the nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import running
from ..functions.strings import strip
from .events import searchable

# The routing patterns and the nodes they name. The fifth has no closing word bound, so longer words match too.
RULES = [
    (r"\b(solar glass|textured tempered glass|photovoltaic glass)\b", "COMP_SOLAR_GLASS"),
    (r"\b(polysilicon|pv cells?|photovoltaic cells?)\b", "COMP_PV_CELLS"),
    (r"\b(crgo|grain oriented electrical steel|transformer cores?)\b", "COMP_TRANSFORMER_CORES"),
    (r"\b(power transformers?|distribution transformers?)\b", "SUB_POWER_TRANSFORMERS"),
    (r"\b(fluorspar|fluorochemicals?|hydrogen fluoride|anhydrous hydrogen fluoride|\bahf\b)", "COMP_FLUOROCHEMICAL_FEED"),
    (r"\b(bulk api|bulk apis|active pharmaceutical ingredient)\b", "SUB_BULK_APIS"),
    (r"\b(sulfuric acid|sulphuric acid|specialty chemicals?)\b", "COMP_CHEMICAL_PROCESS_INPUTS"),
    (r"\b(refractory bricks?|refractories)\b", "COMP_REFRACTORY_BRICKS"),
]
BREAK = "\n\n---\n\n"


def routed_nodes(text: Column, rules: list[tuple[str, str]], explicit: Column | None = None) -> Column:
    """The distinct nodes whose pattern the text has, with the explicit one if it is given: one pass, no join."""
    hits = F.array(*[F.when(text.rlike("(?iU)" + p), F.lit(node)) for p, node in rules])
    if explicit is not None:
        hits = F.concat(hits, F.array(F.nullif(explicit, F.lit(""))))
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def route(events: DataFrame, nodes: DataFrame, rules: list[tuple[str, str]] | None = None, *, terminal: int = 4, text: Column | None = None) -> DataFrame:
    """Events with ``node_id``, one row for each known, non-terminal node that an event goes to; equal ids keep one row a node."""
    rules = RULES if rules is None else rules
    found = routed_nodes(searchable() if text is None else text, rules, F.element_at("metadata", "candidate_node"))
    known = nodes.where(F.col("layer") < terminal).select("node_id").distinct()
    return events.withColumn("node_id", F.explode(found)).join(known, "node_id", "left_semi").dropDuplicates(["node_id", "event_id"])


def aliases(routed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., node_id, candidate_id): ``Candidate_001``... by sorted node; all routed nodes count, whatever is thresholded later."""
    by = by or []
    nodes = routed.select(*by, "node_id").distinct()
    placed = running(nodes, by, ["node_id"], {"_n": F.lit(1)}, "aliases")
    return placed.select(*by, "node_id", F.format_string("Candidate_%03d", F.col("_n") + 1).alias("candidate_id"))


def chunk() -> Column:
    day = F.date_format("published_date", "yyyy-MM-dd")
    return F.concat(F.lit("Source: "), "source", F.lit("\nDate: "), day, F.lit("\nTitle: "), "title", F.lit("\nText: "), "text")


def documents(routed: DataFrame, *, by: list[str] | None = None, max_chars: int = 24_000) -> DataFrame:
    """(by..., node_id, n_events, source_text, company_aliases): chunks by (date, id), joined, then cut to ``max_chars``.

    A chunk's place and start come from running sums in two levels, so that a node which a third of all events go to lies in many
    tasks. Chunks whose break starts behind the cut are dropped before they are gathered, so a node's list is bounded by the cut.
    Issuers are numbered by the place of their event among all of the node's; a later event of a company overwrites its number.
    """
    by = [*(by or []), "node_id"]
    rows = routed.withColumn("_chunk", chunk()).select(*by, "published_date", "event_id", "_chunk", strip(F.element_at("metadata", "company_name")).alias("_company"))
    df = running(rows, by, ["published_date", "event_id"], {"_before": F.lit(1), "_start": F.length("_chunk") + len(BREAK)}, "node-events")
    df = df.withColumn("_n", F.col("_before") + 1)
    kept = F.when(F.col("_start") - len(BREAK) < max_chars, F.struct("_n", "_chunk"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["_chunk"]), BREAK)
    docs = df.groupBy(*by).agg(F.count("*").alias("n_events"), F.substring(text, 1, max_chars).alias("source_text"))
    named = df.where(F.col("_company") != "").groupBy(*by, "_company").agg(F.max("_n").alias("_n"))
    issuers = named.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_company", F.format_string("Issuer_%03d", F.col("_n")))))).alias("company_aliases"))
    return docs.join(issuers, by, "left").withColumn("company_aliases", F.coalesce("company_aliases", F.create_map().cast("map<string,string>")))
