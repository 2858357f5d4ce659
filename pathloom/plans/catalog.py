"""Every query over the driver's tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import resolve, score, text
from pathloom.model import ATTRS, EDGES, TIERS, GenerationConfig, TierResult, ValidationConfig
from pathloom.operators import dataset, dedup, graph, prompt, render, sample, synth, walk
from pathloom.operators.scratch import shared_folder, written
from pathloom.plans import generate, oracles
from pathloom.sources import graphml, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: How many draws the sampling queries take: with replacement, from all nodes.
DRAWS = 1000


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# question-answer pairs


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, id, question, answer: dialogue turns, and pairs made of other tables that reach every branch of the score."""
    t = lambda name: _table(spark, sf_dir, name)
    turns = Window.partitionBy("conv_id").orderBy("turn")
    ahead = t("conversations").withColumn("next_role", F.lead("role").over(turns)).withColumn("answer", F.lead("text").over(turns))
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    col = lambda c: F.col(c).cast("string")
    parts = [
        ahead.filter("role = 'user' and next_role = 'assistant'").select(F.lit("talk").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), "answer"),
        t("documents").select(F.lit("document"), "doc_id", say("Is document ", col("doc_id"), " in ", col("lang")), "text"),
        t("documents").select(F.lit("source"), "doc_id", F.col("source"), "text"),
        t("benchmark").select(F.lit("item"), "item_id", say("What does item ", col("item_id"), " say?"), "text"),
        t("part").select(F.lit("part"), "p_partkey", say("How would you describe part ", col("p_partkey"), "?"), say("A ", col("p_name"), ".")),
        t("part").select(F.lit("brand"), "p_partkey", say("Explain part ", col("p_partkey")), say("It is a ", col("p_name"), " of type ", col("p_type"), " made by ", col("p_brand"), " in size ", col("p_size"))),
        t("events").select(F.lit("event"), "event_id", say("Did event ", col("event_id"), " come up?"), F.when(F.col("event_type") == "click", " Yes. ").when(F.col("event_type") == "error", "Maybe!?").when(F.col("event_type") == "view", "I don't know...").otherwise(F.col("event_type"))),
        t("nation").select(F.lit("nation"), F.col("n_nationkey").cast("long"), say("Explain the nation ", col("n_name")), F.lit(" \n ")),
    ]
    return reduce(lambda a, b: a.union(b), parts).toDF("src", "id", "question", "answer")


def _scored(spark: SparkSession, sf_dir: str, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    return score.with_scores(qa_pairs(spark, sf_dir), F.col("question"), F.col("answer"), config)


@query(oracles.QA_SCORE)
def qa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("question", "answer")


@query(oracles.QA_ACCEPT)
def qa_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("is_valid").select("src", "id", "quality_score")


@query(oracles.QA_REASONS)
def qa_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("src", F.coalesce("reject_reason", F.lit("accepted")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(oracles.QA_REPORT)
def qa_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataset.quality_report(_scored(spark, sf_dir).filter("is_valid"))
    return found.withColumn("avg_quality", F.round("avg_quality", 6))


@query(oracles.QA_ACCEPTANCE)
def qa_acceptance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.acceptance(_scored(spark, sf_dir))


@query(oracles.QA_SWEEP)
def qa_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = score.measured(qa_pairs(spark, sf_dir), F.col("question"), F.col("answer"))
    marks = [F.when(score.judged(ValidationConfig(t.quality_threshold, t.min_length))["is_valid"], t.number) for t in TIERS]
    return pairs.select(F.explode(F.array(*marks)).alias("tier")).filter("tier is not null").groupBy("tier").agg(F.count(F.lit(1)).alias("accepted"))


@query(oracles.MESSAGES)
def messages_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).filter("is_valid").withColumn("messages", dataset.messages(F.col("question"), F.col("answer")))
    return rows.select("src", "id", F.col("messages")[0]["role"].alias("first_role"), F.col("messages")[0]["content"].alias("first_content"), F.col("messages")[1]["role"].alias("second_role"), F.md5(F.col("messages")[1]["content"].cast("binary")).alias("second_md5"), "quality_score")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with a draw_id: their id and, as its last digit, where they come from."""
    order = F.array(*map(F.lit, ("talk", "document", "source", "item", "part", "brand", "event", "nation")))
    return qa_pairs(spark, sf_dir).withColumn("draw_id", F.col("id") * 10 + F.array_position(order, F.col("src")))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_id and raw: all pairs as JSON replies, of which some are fenced."""
    pairs = _numbered(spark, sf_dir)
    body = F.to_json(F.struct("question", "answer", F.lit("easy").alias("difficulty")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("id") % 3 == 1, F.concat(F.lit("  ```\n"), body, F.lit("```  \n"))).otherwise(body)
    return pairs.select("draw_id", raw.alias("raw"), "question", "answer")


@query(oracles.CLEAN)
def clean_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replies(spark, sf_dir).withColumn("clean", text.unfenced(F.col("raw")))
    return found.select("draw_id", "question", F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


@query(oracles.PARSED)
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataset.score_responses(_replies(spark, sf_dir))
    return found.select("draw_id", "question", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "difficulty", "quality_score", "is_valid", "reject_reason")


@query(oracles.REPAIRED)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose strings hold raw line breaks and tabs."""
    pairs = _numbered(spark, sf_dir)
    raw = F.concat(F.lit('{"question": "'), F.regexp_replace("question", '["\\\\]', ""), F.lit('",\n\t"answer": "'), F.regexp_replace("answer", '["\\\\]', ""), F.lit('"}'))
    found = text.with_parsed(pairs.select("draw_id", raw.alias("raw")), text.unfenced(F.col("raw")), "qa")
    return found.select("draw_id", F.col("qa.question").alias("question"), F.md5(F.col("qa.answer").cast("binary")).alias("answer_md5"))


@query(oracles.COST)
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all pairs, at a token for every four characters begun."""
    pairs = qa_pairs(spark, sf_dir)
    tokens = lambda c: F.ceil(F.length(c) / 4).cast("long")
    return synth.cost_report(pairs.select(tokens("question").alias("prompt_tokens"), tokens("answer").alias("completion_tokens"), F.lit("ok").alias("status")))


# the graph


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.trade_nodes(spark, sf_dir), tables.trade_edges(spark, sf_dir)


@query(oracles.NODE_LABEL)
def node_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_nodes(tables.trade_nodes(spark, sf_dir)).select("ord", "id", "label")


@query(oracles.NODE_DESCRIPTION)
def node_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_nodes(tables.trade_nodes(spark, sf_dir)).select("id", "description")


@query(oracles.EDGE_RELATIONSHIP)
def edge_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_edges(tables.trade_edges(spark, sf_dir)).select("src", "dst", "relationship", "reasoning")


@query(oracles.EDGE_LAST)
def edge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.collapse_edges(tables.supply_lines(spark, sf_dir))
    return found.select("ord", "src", "dst", F.col("attrs")[0]["value"].alias("weight"), F.col("attrs")[1]["value"].alias("predicate"))


@query(oracles.EDGE_ORDER)
def edge_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with its place among its source's edges."""
    nodes, edges = trade_graph(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("src_ord").orderBy("ord", "dst"))
    return graph.adjacency_order(nodes, edges).select("src_ord", place.cast("long").alias("place"), "src", "dst")


@query(oracles.NODE_DEGREE)
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*trade_graph(spark, sf_dir)).select("id", "degree", "out_degree", "in_degree")


@query(oracles.GRAPH_STATS)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(*trade_graph(spark, sf_dir))


@query(oracles.KHOP)
def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    return graph.neighbors(edges, nodes, 3)


@query(oracles.SUCCESSORS)
def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    return graph.successors(edges, nodes)


@query(oracles.VIZ_NODES)
def viz_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_export(*trade_graph(spark, sf_dir)).select("id", "label", F.round("size", 6).alias("size"), "tooltip", "colour")


@query(oracles.VIZ_EDGES)
def viz_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_export(tables.trade_edges(spark, sf_dir))


@query(oracles.PREVIEW)
def preview20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.preview(*trade_graph(spark, sf_dir))


# sampling, walks and paths


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_weighted(spark, written(graph.degrees(*trade_graph(spark, sf_dir)), "degrees"), DRAWS)


@query(oracles.SAMPLE_WEIGHTED)
def sample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir)


@query(oracles.SAMPLE_UNIFORM)
def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_uniform(spark, written(tables.trade_nodes(spark, sf_dir).select("ord", "id"), "nodes"), DRAWS)


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(walk.random_walks(_weighted(spark, sf_dir), tables.trade_edges(spark, sf_dir), leaving=tables.trade_edges_leaving(spark, sf_dir)), "walked")


@query(oracles.RANDOM_WALK)
def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir).select("draw_id", "start", F.array_join("nodes", ">").alias("path"), "length")


@query(oracles.WALK_LOSSES)
def walk_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk_losses(_walks(spark, sf_dir))


@query(oracles.CAPPED_WALK)
def random_walk_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = walk.random_walks(_weighted(spark, sf_dir), tables.trade_edges(spark, sf_dir), max_hops=2, leaving=tables.trade_edges_leaving(spark, sf_dir))
    return found.select("draw_id", "start", F.array_join("nodes", ">").alias("path"), "length")


@query(oracles.MAXIMAL_PATHS)
def maximal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    return walk.maximal_paths(edges, nodes).select("start", F.array_join("nodes", ">").alias("path"), "length")


@query(oracles.PATH_HISTOGRAM)
def path_len_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    return walk.path_lengths(edges, nodes)


@query(oracles.JACCARD)
def path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = walk.usable(_walks(spark, sf_dir))
    sets = long.groupBy(F.array_sort(F.array_distinct("nodes")).alias("items")).agg(F.min("draw_id").alias("draw_id"))
    return dedup.similar_pairs(written(sets, "sets"), 0.5).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(oracles.DEDUP_EXACT)
def path_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_dedup(walk.usable(_walks(spark, sf_dir)), 0.95).select("draw_id", F.array_join("nodes", ">").alias("path"))


@query(oracles.DEDUP_GREEDY)
def path_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_dedup(walk.usable(_walks(spark, sf_dir)), 0.5).select("draw_id", F.array_join("nodes", ">").alias("path"))


@query(oracles.DEDUP_STATS)
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = walk.usable(_walks(spark, sf_dir))
    return dedup.dedup_stats(long, dedup.greedy_dedup(long, 0.5))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_paths(walk.usable(_walks(spark, sf_dir)), *trade_graph(spark, sf_dir), tables.trade_edges_leaving(spark, sf_dir))


@query(oracles.PATH_STR)
def path_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("draw_id", "path_str", "length")


@query(oracles.RICH_CONTEXT)
def rich_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("draw_id", "rich_context")


def _prompt_query(domain: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rendered(spark, sf_dir).select("draw_id", prompt.prompt(F.col("path_str"), domain, F.col("rich_context")).alias("prompt"))

    f.__name__ = f"prompt_{domain}"
    query(oracles.prompt_sql(prompt.TEMPLATES[domain].head(), prompt.CONTEXT, prompt.TEMPLATES[domain].tail()))(f)


for _domain in prompt.TEMPLATES:
    _prompt_query(_domain)


# whole runs


@query(oracles.chat_sql(200, prompt.TEMPLATES["generic"].head(), prompt.CONTEXT, prompt.TEMPLATES["generic"].tail()))
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: graph, draws, walks, dedup, prompts, offline replies, scores, chat messages."""
    run = generate.generate(spark, *trade_graph(spark, sf_dir), GenerationConfig(count=200), stored=True, leaving=tables.trade_edges_leaving(spark, sf_dir))
    said = lambda i: F.col("messages")[i]["content"]
    return run.examples.select("draw_id", said(0).alias("question"), said(1).alias("answer"), "quality_score")


@query(oracles.rejects_sql(200, prompt.TEMPLATES["generic"].head(), prompt.CONTEXT, prompt.TEMPLATES["generic"].tail()))
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = generate.generate(spark, *trade_graph(spark, sf_dir), GenerationConfig(count=200), stored=True, leaving=tables.trade_edges_leaving(spark, sf_dir))
    return run.scored.groupBy("difficulty", F.coalesce("reject_reason", F.lit("accepted")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(oracles.metadata_sql(200, prompt.TEMPLATES["generic"].head(), prompt.CONTEXT, prompt.TEMPLATES["generic"].tail()))
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    gen = GenerationConfig(count=200)
    found = generate.metadata(generate.generate(spark, nodes, edges, gen, stored=True, leaving=tables.trade_edges_leaving(spark, sf_dir)), nodes, edges, gen)
    g, c = "generation_config", "cost"
    rounded = [F.round(f"{k}.{n}", d).alias(n) for k, n, d in ((g, "acceptance_rate", 9), (c, "total_cost", 9), (c, "avg_cost_per_example", 9), ("quality", "avg_quality", 6))]
    return found.select(f"{g}.count_requested", f"{g}.count_generated", f"{g}.count_rejected", f"{c}.input_tokens", f"{c}.output_tokens", f"{c}.api_calls", "graph.*", *rounded)


@query()
def autotune_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.autotune(spark, *trade_graph(spark, sf_dir), 200, stored=True, leaving=tables.trade_edges_leaving(spark, sf_dir)).breakdown(spark)


@query(oracles.TIER_WARNINGS)
def autotune_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct warnings of all tiers with the first tier that gives each."""
    rows = [(t.number, w) for t in TIERS for w in t.warnings()]
    return spark.createDataFrame(rows, "tier int, warning string").groupBy("warning").agg(F.min("tier").alias("first_tier"))


@query(oracles.RECOMMENDATIONS)
def autotune_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality level, and how many recommendations an average of 0.5 gets, by the last tier that gave examples."""
    rows = []
    for top in range(-1, len(TIERS)):
        tuned = generate.Tuned(None, [TierResult(t, int(t.number <= top)) for t in TIERS], None)
        rows.append((top, tuned.level, len(tuned.recommendations(0.5))))
    return spark.createDataFrame(rows, "top_tier int, level string, recommendations int")


# single rules


@query(oracles.TRUTHY)
def truthy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that count as absent: empty ones, zeros of numeric type, false."""
    s, d = "string", "double"
    bags = [
        [("name", "", s), ("label", "b", s)], [("name", None, s), ("title", "t", s)], [("name", "0", "int")], [("name", "0.5", d)], [("name", "true", "boolean")],
        [("name", "False", "boolean"), ("value", "0e5", d)], [("name", "first", s), ("name", "last", s)], [("name", "0", s)],
    ]
    rows = spark.createDataFrame(list(enumerate(bags)), f"case_id int, attrs {ATTRS}")
    return rows.select("case_id", resolve.node_label(F.col("attrs"), F.lit("n")).alias("label"))


@query(oracles.SAMPLE_UNIFORM)
def sample_without_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By degree, where no node has an edge: all alike."""
    nodes = tables.trade_nodes(spark, sf_dir)
    degrees = written(graph.degrees(nodes, spark.createDataFrame([], EDGES)), "degrees")
    return sample.sample_starts(spark, degrees, "frequency_weighted", DRAWS)


@query(oracles.SAMPLE_UNIFORM)
def sample_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = written(graph.degrees(*trade_graph(spark, sf_dir)), "degrees")
    return sample.sample_starts(spark, degrees, "random", DRAWS)


@query(oracles.prompt_sql(prompt.TEMPLATES["generic"].head(), prompt.CONTEXT, prompt.TEMPLATES["generic"].tail()))
def prompt_of_unknown_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("draw_id", prompt.prompt(F.col("path_str"), "gardening", F.col("rich_context")).alias("prompt"))


@query(oracles.NO_CONTEXT(prompt.TEMPLATES["beauty_product"].head(), prompt.TEMPLATES["beauty_product"].tail()))
def prompt_without_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("draw_id", prompt.prompt(F.col("path_str"), "beauty_product", F.lit("")).alias("prompt"))


@query(oracles.DEDUP_EXTREMES)
def path_dedup_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a threshold of 0 one path stays, above 1 all do."""
    long = walk.usable(_walks(spark, sf_dir))
    return reduce(lambda a, b: a.unionByName(b), (dedup.greedy_dedup(long, t).select(F.lit(str(t)).alias("threshold"), "draw_id") for t in (0, 1.1)))


@query(oracles.JSONL)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written as JSON lines and read again."""
    path = f"{shared_folder(spark)}/examples-{uuid.uuid4().hex}"
    dataset.write_jsonl_parts(dataset.examples(_scored(spark, sf_dir).withColumnRenamed("id", "draw_id")), path)
    said = lambda i: F.md5(F.col("messages")[i]["content"].cast("binary"))
    return spark.read.schema("messages array<struct<role:string,content:string>>").json(path).select(said(0).alias("question_md5"), said(1).alias("answer_md5"))


# graph files

FIXTURE = """<?xml version="1.0" encoding="utf-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="label" attr.type="string"/>
<key id="d1" for="node" attr.name="size" attr.type="double"><default>1.5</default></key>
<key id="d2" for="edge" attr.name="label" attr.type="string"/>
<key id="d3" for="all" attr.name="note" attr.type="string"/>
<graph edgedefault="directed">
<node id="a"><data key="d0">Alpha &amp; Co</data></node>
<node id="b"><data key="d0"></data><data key="d3">second</data><data key="d1">0</data></node>
<!-- a node listed twice -->
<node id="a"><data key="d0">Alpha</data></node>
<node id="c"/>
<edge source="a" target="b"><data key="d2">first</data></edge>
<edge id="e9" source="b" target="c"><data key="undeclared">loose</data></edge>
<edge source="a" target="b"><data key="d2">last</data><data key="d3">why</data></edge>
</graph>
</graphml>
"""


def _fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    path = f"{shared_folder(spark)}/fixture-{uuid.uuid4().hex}"
    spark.createDataFrame([(FIXTURE,)], "value string").coalesce(1).write.text(path)
    return graphml.read_graphml(spark, path)


@query(oracles.GRAPHML_NODES)
def graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_nodes(_fixture(spark)[0])


@query(oracles.GRAPHML_EDGES)
def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_edges(_fixture(spark)[1])


