import json
import pickle

import pytest
from pyspark.sql import functions as F

from pathloom import cli
from pathloom.model import EDGES, NODES, TIERS, BackendConfig, ExtractionConfig, GenerationConfig, ValidationConfig
from pathloom.operators import dataset, prompt, synth
from pathloom.operators.graph import edge_export, node_export, preview, resolved_edges
from pathloom.plans import generate
from pathloom.sources import samples
from pathloom.sources.graphml import write_graphml
from pathloom.streaming import responses

S = "string"


@pytest.fixture(scope="module")
def graph(spark):
    names = ["Python", "Django", "Web sites", "Guido", "Flask", "Speed", "Alone"]
    nodes = spark.createDataFrame([(i, f"n{i}", [("name", n, S), ("description", f"about {n}", S)]) for i, n in enumerate(names)], NODES)
    pairs = [(3, 0), (0, 1), (1, 2), (0, 4), (4, 2), (2, 5), (5, 0)]
    edges = spark.createDataFrame([(i, f"n{a}", f"n{b}", [("relationship", "LEADS_TO", S), ("reasoning", "so it is said", S)]) for i, (a, b) in enumerate(pairs)], EDGES)
    return nodes, edges


def test_a_run_from_graph_to_messages(spark, graph):
    nodes, edges = graph
    gen = GenerationConfig(count=40)
    run = generate.generate(spark, nodes, edges, gen, ExtractionConfig(dedup_threshold=0.99))
    losses = run.losses.first()
    assert losses.walks == 40 and losses.kept + losses.duplicates_skipped + losses.dropped_short == 40
    assert run.paths.count() == run.responses.count() == losses.kept
    first, second = run.examples.collect(), run.examples.collect()
    assert first == second and first
    for r in first:
        assert [m.role for m in r.messages] == ["user", "assistant"] and 0.7 <= r.quality_score <= 1
    row = generate.metadata(run, nodes, edges, gen).first()
    assert row.generation_config.count_generated == len(first) and row.graph.paths_extracted == losses.kept
    assert row.cost.api_calls == losses.kept and row.quality.total_examples == len(first)


def test_tuning_stops_at_the_target_or_after_all_tiers(spark, graph):
    done = generate.autotune(spark, *graph, target=3)
    assert done.examples.count() == 3 and len(done.tiers) >= 1
    short = generate.autotune(spark, *graph, target=60, tiers=TIERS[:2])
    assert [t.tier.number for t in short.tiers] == [0, 1] and short.examples.count() < 60
    assert short.level in ("HIGH", "MODERATE") and short.breakdown(spark).count() == 2
    apart = generate.autotune(spark, *graph, target=60, tiers=TIERS[:2], dedup_across_tiers=True)
    texts = [json.dumps([m.asDict() for m in r.messages]) for r in apart.examples.filter("tier = 1").collect()]
    assert not {json.dumps([m.asDict() for m in r.messages]) for r in apart.examples.filter("tier = 0").collect()} & set(texts)
    nothing = generate.autotune(spark, *graph, target=0)
    assert nothing.examples.count() == 0 and nothing.level == "HIGH"


def test_levels_and_warnings():
    def tuned(*generated):
        from pathloom.model import TierResult

        return generate.Tuned(None, [TierResult(t, n, 0, 0.8, t.warnings()) for t, n in zip(TIERS, generated, strict=False)], None)

    assert [tuned(*g).level for g in ((0,), (5,), (5, 1), (1, 0, 1), (1, 0, 0, 1), (0, 0, 0, 0, 0, 1))] == ["HIGH", "HIGH", "MODERATE", "MODERATE", "REDUCED", "REDUCED"]
    assert tuned(1, 0, 1).warnings() == TIERS[2].warnings() and len(tuned(1, 0, 1).warnings(all_tiers=True)) == 2
    assert tuned(1).recommendations(0.9) == ["ready for fine-tuning"]
    assert len(tuned(1, 0, 0, 1).recommendations(0.5)) == 4


class Flaky:
    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def complete(self, system, text, temperature, max_tokens):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return synth.Reply("{}", 1, 1)


def test_retries():
    slept = []
    run = lambda b: synth.with_retries(b, "p", GenerationConfig(), BackendConfig(), slept.append)[1]
    assert run(Flaky(synth.RateLimited(), synth.RateLimited())) == "ok" and slept == [1.0, 2.0]
    slept.clear()
    assert run(Flaky(*[synth.RateLimited()] * 3)) == "rate_limited" and slept == [1.0, 2.0]
    slept.clear()
    assert run(Flaky(*[synth.BackendError()] * 3)) == "api_error" and slept == [1.0, 1.0]
    slept.clear()
    broken = Flaky(ValueError())
    assert run(broken) == "error" and slept == [] and broken.calls == 1
    with pytest.raises(ValueError, match="api_key, endpoint, deployment"):
        synth.RemoteBackend(BackendConfig())


def test_connection_errors_are_tried_again(monkeypatch):
    import urllib.error
    import urllib.request

    def unreachable(*_, **__):
        raise urllib.error.URLError("no route")

    monkeypatch.setattr(urllib.request, "urlopen", unreachable)
    backend, slept = synth.RemoteBackend(BackendConfig("k", "https://example.org", "d")), []
    assert synth.with_retries(backend, "p", GenerationConfig(), backend.config, slept.append)[1] == "api_error" and slept == [1.0, 1.0]


def test_settings_of_a_file_and_keys_that_stay_out_of_tasks(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# settings\nexport PATHLOOM_API_KEY='secret'\nPATHLOOM_ENDPOINT=https://example.org\n")
    monkeypatch.setenv("PATHLOOM_DEPLOYMENT", "d")
    config = BackendConfig.from_env(env_file=str(tmp_path / "env"))
    assert (config.api_key, config.endpoint, config.deployment) == ("secret", "https://example.org", "d")
    monkeypatch.setenv("PATHLOOM_API_KEY", "secret")
    assert b"secret" not in pickle.dumps(synth.RemoteBackend(config))
    assert BackendConfig.from_env(env_file=str(tmp_path / "none")).endpoint == ""
    for bad in (lambda: GenerationConfig(temperature=-1), lambda: GenerationConfig(count=-1), lambda: ValidationConfig(1.5)):
        with pytest.raises(ValueError, match="must lie between"):
            bad()


def test_a_run_goes_on_from_its_log(spark, graph, tmp_path):
    log = f"file://{tmp_path}/log"
    first = generate.generate(spark, *graph, GenerationConfig(count=20), log=log)
    sent = responses.logged(spark, log).count()
    again = generate.generate(spark, *graph, GenerationConfig(count=20), log=log)
    assert sent == first.paths.count() == responses.logged(spark, log).count()
    assert first.examples.orderBy("draw_id").collect() == again.examples.orderBy("draw_id").collect()


def test_metadata_of_a_tuned_run(spark, graph):
    tuned = generate.autotune(spark, *graph, target=60, tiers=TIERS[:2])
    row = generate.auto_metadata(spark, tuned, *graph, 60).first()
    config, n = row.generation_config, tuned.examples.count()
    rejected = sum(t.rejected for t in tuned.tiers)
    assert (config.mode, config.tuning_iterations, config.count_generated, config.count_rejected) == ("auto", 2, n, rejected)
    assert config.acceptance_rate == n / (n + rejected) and row.cost.avg_cost_per_example == row.cost.total_cost / n
    assert any("mode: auto" in line for line in generate.report_lines(row))
    empty = generate.auto_metadata(spark, generate.autotune(spark, *graph, target=0), *graph, 0).first()
    assert empty.quality.avg_quality == 0 and generate.report_lines(empty)


def test_samples_and_legend(spark):
    for name in samples.SAMPLES:
        nodes, edges = samples.sample_graph(spark, name)
        assert edges.count() == len(samples.SAMPLES[name]) and resolved_edges(edges).filter("relationship = 'RELATED_TO'").count() == 0
    assert "graph: looks_best_with, applied_by" in prompt.legend_of(resolved_edges(edges))
    run = generate.generate(spark, nodes, edges, GenerationConfig(count=5, domain="beauty_makeup"))
    assert "Relationships of this graph" in run.paths.first().prompt


def test_a_log_of_responses_resumes(spark, tmp_path):
    prompts = spark.range(30).select(F.col("id").alias("draw_id"), F.concat(F.lit("Path: A -[x]-> B"), F.col("id").cast("string")).alias("prompt"))
    path = f"file://{tmp_path}/log"
    first = responses.resume(prompts.filter("draw_id < 12"), path, batches=2)
    assert first.count() == 12
    again = responses.resume(prompts, path, batches=3)
    assert again.count() == 30 and responses.logged(spark, path).count() == 30
    assert {r.status for r in again.collect()} == {"ok"}


def test_prompts(spark):
    row = spark.createDataFrame([("A -[x]-> B", "  [A]\n  [B]")], "p string, c string")
    text = lambda domain, c: row.select(prompt.prompt(F.col("p"), domain, c)).first()[0]
    assert text("no such domain", F.col("c")) == text("generic", F.col("c"))
    assert "Context" not in text("generic", F.lit("")) and "Context" not in text("beauty_product", None)
    assert text("beauty_makeup", F.lit("")).count("A -[x]-> B") == 2 and "avoid" in text("beauty_makeup", None)
    assert prompt.domain_description("unknown") == "unknown"


def test_exports_and_preview(spark, graph):
    nodes = {r.id: r for r in node_export(*graph).collect()}
    assert nodes["n0"].size == 35 and nodes["n6"].size == 15 and "Connections: 4" in nodes["n0"].tooltip and "description: about Python" in nodes["n0"].tooltip
    assert all("reasoning: so it is said" in r.tooltip for r in edge_export(graph[1]).collect())
    assert preview(*graph).filter("kind = 'edge' and ord = 0").first().line == "Guido → [LEADS_TO] → Python"


def test_command_line(spark, graph, tmp_path, capsys):
    write_graphml(*graph, str(tmp_path / "g.graphml"))
    out = str(tmp_path / "out")
    assert cli.main(["--graph", str(tmp_path / "g.graphml"), "--count", "12", "--output", out, "--dedup-threshold", "1.1"]) == 0
    found = json.load(open(out + ".json"))
    lines = spark.read.json(out + ".jsonl")
    assert len(found) == lines.count() > 0 and "quality_score" not in lines.columns
    said = capsys.readouterr().out
    assert "dropped_short" in said and "mode: manual" in said and json.load(open(out + ".metadata.json"))["quality"]["total_examples"] == len(found)
    assert all(json.loads(line)["messages"] for line in open(out + ".jsonl"))
    with pytest.raises(SystemExit):
        cli.main(["--sample", "orchard", "--count", "0"])
    with pytest.raises(Exception):
        cli.main(["--graph", str(tmp_path / "missing.graphml")])


def test_sinks_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "draw_id long, messages array<struct<role:string,content:string>>, quality_score double")
    dataset.write_json(none, str(tmp_path / "x.json"))
    assert json.load(open(tmp_path / "x.json")) == []
