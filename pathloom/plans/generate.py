"""From a graph to chat examples: one run, and the tuning loop over tiers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pathloom.model import RESPONSES, TIERS, BackendConfig, ExtractionConfig, GenerationConfig, Tier, TierResult, ValidationConfig
from pathloom.operators import dataset, dedup, graph, render, sample, synth, walk
from pathloom.operators.prompt import TEMPLATES, legend_of, prompt
from pathloom.operators.scratch import written
from pathloom.streaming.responses import resume


@dataclass
class Run:
    """What one run made; all are DataFrames over written tables."""

    paths: DataFrame
    responses: DataFrame
    scored: DataFrame
    examples: DataFrame
    losses: DataFrame


def extract_paths(spark: SparkSession, nodes: DataFrame, edges: DataFrame, config: ExtractionConfig, degrees: DataFrame | None = None, leaving: walk.Leaving | None = None) -> tuple[DataFrame, DataFrame]:
    """(rendered paths, one row of walks, dropped_short, duplicates_skipped and kept)."""
    if degrees is None:
        degrees = written(graph.degrees(nodes, edges), "degrees")
    starts = sample.sample_starts(spark, degrees, config.sampling, config.max_paths, config.seed)
    walks = written(walk.random_walks(starts, edges, config.max_hop_depth, config.seed, leaving=leaving), "walked")
    long = walk.usable(walks)
    kept = written(dedup.greedy_dedup(long, config.dedup_threshold), "kept")
    losses = walk.walk_losses(walks).withColumn("_k", F.lit(1)).join(dedup.dedup_stats(long, kept).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return render.render_paths(kept, nodes, edges, leaving), losses


def generate(spark: SparkSession, nodes: DataFrame, edges: DataFrame, gen: GenerationConfig = GenerationConfig(), extraction: ExtractionConfig | None = None, validation: ValidationConfig = ValidationConfig(), backend: synth.SynthBackend | None = None, backend_config: BackendConfig = BackendConfig(), log: str | None = None, stored: bool = False, degrees: DataFrame | None = None, leaving: walk.Leaving | None = None) -> Run:
    """One run over a graph. Responses are written before anything reads them, so each prompt is sent once.

    With a log, a folder of responses, an interrupted run goes on where it stopped: prompts that it answers are not sent.
    The graph is written first, unless it is `stored` already: written, or made of stored tables by what filters go through,
    so that the few nodes and edges of its walks are read and not all of them copied. `degrees` are those of the graph, if known; `leaving`
    finds its edges by the nodes that they leave, as in random_walks()."""
    if not stored:
        nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    extraction = replace(extraction or ExtractionConfig(), max_paths=gen.count)
    paths, losses = extract_paths(spark, nodes, edges, extraction, degrees, leaving)
    legend = legend_of(graph.resolved_edges(edges)) if gen.domain in TEMPLATES and TEMPLATES[gen.domain].legend else ""
    paths = written(paths.withColumn("prompt", prompt(F.col("path_str"), gen.domain, F.col("rich_context"), legend)), "paths")
    responses = resume(paths, log, backend, gen, backend_config) if log else written(synth.synthesize(paths, backend, gen, backend_config), "responses")
    scored = dataset.score_responses(responses, validation)
    return Run(paths, responses, scored, dataset.examples(scored), losses)


@dataclass
class Tuned:
    examples: DataFrame
    tiers: list[TierResult]
    responses: DataFrame | None

    @property
    def level(self) -> str:
        top = max((t.tier.number for t in self.tiers if t.generated), default=-1)
        return "HIGH" if top <= 0 else "MODERATE" if top <= 2 else "REDUCED"

    def warnings(self, all_tiers: bool = False) -> list[str]:
        """Distinct warnings in the order in which they first came up, of the tiers that gave examples or of all."""
        return list(dict.fromkeys(w for t in self.tiers if all_tiers or t.generated for w in t.warnings))

    def recommendations(self, avg_quality: float) -> list[str]:
        top = max((t.tier.number for t in self.tiers if t.generated), default=-1)
        if top <= 0:
            return ["ready for fine-tuning"]
        more = ["filter low scores by hand", "enrich the graph with more nodes and edges"] if top >= 3 else []
        return ["review examples for accuracy", *more, *(["review strongly advised: average quality is below 0.6"] if avg_quality < 0.6 else [])]

    def breakdown(self, spark: SparkSession) -> DataFrame:
        rows = [(t.tier.number, t.tier.quality_threshold, t.tier.dedup_threshold, t.tier.temperature, t.tier.sampling, t.generated, t.rejected, t.avg_quality, t.warnings) for t in self.tiers]
        return spark.createDataFrame(rows, "iteration int, quality_threshold double, dedup_threshold double, temperature double, sampling_strategy string, generated_count long, rejected_count long, avg_quality double, quality_warnings array<string>")


def autotune(spark: SparkSession, nodes: DataFrame, edges: DataFrame, target: int, domain: str = "generic", max_hop_depth: int = 999, seed: int = 42, backend: synth.SynthBackend | None = None, backend_config: BackendConfig = BackendConfig(), overshoot: bool = False, dedup_across_tiers: bool = False, tiers: tuple[Tier, ...] = TIERS, log: str | None = None, stored: bool = False, leaving: walk.Leaving | None = None) -> Tuned:
    """Run tier after tier for what is still missing until `target` examples are there or the tiers are used up.

    Examples are merged in order, up to the target. As a rule tiers don't know each other's paths; dedup_across_tiers drops
    examples whose messages an earlier tier has. overshoot asks each tier for half as many again and ten more.
    The graph is written first unless it is `stored`, and `leaving` finds its edges, as in generate(); its degrees are counted once for all tiers."""
    if not stored:
        nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    degrees = written(graph.degrees(nodes, edges), "degrees")
    merged, spent, results, have = None, None, [], 0
    for tier in tiers:
        missing = target - have
        if missing <= 0:
            break
        asked = int(1.5 * missing) + 10 if overshoot else missing
        run = generate(
            spark, nodes, edges, GenerationConfig(asked, domain, tier.temperature), ExtractionConfig(asked, max_hop_depth, tier.dedup_threshold, tier.sampling, seed + tier.number),
            ValidationConfig(tier.quality_threshold, tier.min_length, 500), backend, backend_config, f"{log}/tier-{tier.number}" if log else None, stored=True, degrees=degrees, leaving=leaving,
        )
        found = run.examples.select(F.lit(tier.number).alias("tier"), "draw_id", "messages", "quality_score")
        if dedup_across_tiers and merged is not None:
            found = found.join(merged.select("messages"), "messages", "left_anti").select("tier", "draw_id", "messages", "quality_score")
        found = written(found.orderBy("draw_id").limit(missing), "tier")
        rate = dataset.acceptance(run.scored).first()
        quality = dataset.quality_report(found).first()
        results.append(TierResult(tier, quality.total_examples, rate.rejected, quality.avg_quality, tier.warnings()))
        merged = found if merged is None else merged.unionByName(found)
        spent = run.responses if spent is None else spent.unionByName(run.responses)
        have += quality.total_examples
    if merged is None:
        merged = spark.createDataFrame([], "tier int, draw_id long, messages array<struct<role:string,content:string>>, quality_score double")
    return Tuned(merged, results, spent)


def metadata(run: Run, nodes: DataFrame, edges: DataFrame, gen: GenerationConfig) -> DataFrame:
    """One row: counts, cost, quality and graph of a manual run; `avg_cost_per_example` divides by accepted examples."""
    key = F.lit(1).alias("_k")
    cost = synth.cost_report(run.responses).select("*", key)
    report = dataset.quality_report(run.examples).select("*", key)
    rate = dataset.acceptance(run.scored).select("*", key)
    stats = graph.graph_stats(nodes, edges).select("*", key)
    kept = run.paths.agg(F.count(F.lit(1)).alias("paths")).select("*", key)
    row = cost.join(report, "_k").join(rate, "_k").join(stats, "_k").join(kept, "_k")
    per_example = F.when(F.col("total_examples") == 0, 0.0).otherwise(F.col("total_cost") / F.col("total_examples"))
    return row.select(
        F.struct(F.lit("manual").alias("mode"), F.lit(gen.count).alias("count_requested"), F.col("accepted").alias("count_generated"), F.col("rejected").alias("count_rejected"), "acceptance_rate").alias("generation_config"),
        F.struct("input_tokens", "output_tokens", "total_tokens", "input_cost", "output_cost", "total_cost", "api_calls", "avg_cost_per_call", per_example.alias("avg_cost_per_example")).alias("cost"),
        F.struct("total_examples", "avg_quality", "min_quality", "max_quality").alias("quality"),
        F.struct(F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), F.col("paths").alias("paths_extracted"), F.col("capacity").alias("estimated_capacity")).alias("graph"),
    )


def auto_metadata(spark: SparkSession, tuned: Tuned, nodes: DataFrame, edges: DataFrame, target: int) -> DataFrame:
    """One row as of metadata(), for a tuned run: the rate is that of merged examples, costs are those of all tiers, and
    `avg_cost_per_example` divides them by merged examples."""
    key = F.lit(1).alias("_k")
    spent = tuned.responses if tuned.responses is not None else spark.createDataFrame([], RESPONSES)
    cost, report, stats = synth.cost_report(spent).select("*", key), dataset.quality_report(tuned.examples).select("*", key), graph.graph_stats(nodes, edges).select("*", key)
    row = cost.join(report, "_k").join(stats, "_k").withColumn("rejected", F.lit(sum(t.rejected for t in tuned.tiers)).cast("long"))
    asked = F.col("total_examples") + F.col("rejected")
    per_example = F.when(F.col("total_examples") == 0, 0.0).otherwise(F.col("total_cost") / F.col("total_examples"))
    return row.select(
        F.struct(F.lit("auto").alias("mode"), F.lit(target).alias("count_requested"), F.col("total_examples").alias("count_generated"), F.col("rejected").alias("count_rejected"), F.when(asked == 0, 0.0).otherwise(F.col("total_examples") / asked).alias("acceptance_rate"), F.lit(len(tuned.tiers)).alias("tuning_iterations")).alias("generation_config"),
        F.struct("input_tokens", "output_tokens", "total_tokens", "input_cost", "output_cost", "total_cost", "api_calls", per_example.alias("avg_cost_per_example")).alias("cost"),
        F.struct("total_examples", "avg_quality", "min_quality", "max_quality").alias("quality"),
        F.struct(F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), F.col("capacity").alias("estimated_capacity")).alias("graph"),
    )


def report_lines(row: Row) -> list[str]:
    """What a run made, as lines to print; figures are rounded here only."""
    config, cost, quality, whole = row.generation_config, row.cost, row.quality, row.graph
    show = lambda x, n: "-" if x is None else f"{x:.{n}f}"
    return [
        f"mode: {config.mode}",
        f"graph: {whole.nodes} nodes, {whole.edges} edges, room for about {whole.estimated_capacity} examples",
        f"examples: {config.count_generated} of {config.count_requested} asked for, {config.count_rejected} rejected ({100 * config.acceptance_rate:.1f} % accepted)",
        f"quality: {show(quality.avg_quality, 3)} on average, {show(quality.min_quality, 3)} to {show(quality.max_quality, 3)}",
        f"tokens: {cost.input_tokens} in, {cost.output_tokens} out, {cost.api_calls} calls",
        f"cost: ${cost.input_cost:.4f} + ${cost.output_cost:.4f} = ${cost.total_cost:.4f}, ${cost.avg_cost_per_example:.6f} an example",
    ]
