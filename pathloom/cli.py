"""Command line: a GraphML file in, chat examples out."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pathloom.model import BackendConfig, ExtractionConfig, GenerationConfig, ValidationConfig
from pathloom.operators import dataset, graph, synth
from pathloom.operators.prompt import TEMPLATES, domain_description
from pathloom.plans import generate
from pathloom.session import session
from pathloom.sources import samples
from pathloom.sources.graphml import read_graphml


def _between(kind: type, least: float, most: float) -> Callable[[str], float]:
    def value(text: str) -> float:
        found = kind(text)
        if not least <= found <= most:
            raise argparse.ArgumentTypeError(f"must lie between {least} and {most}")
        return found

    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--graph", help="GraphML file")
    source.add_argument("--sample", choices=sorted(samples.SAMPLES), help="a small graph that comes along")
    p.add_argument("--output", default="output_training", help="prefix of the output files")
    p.add_argument("--count", type=_between(int, 1, 10**9), default=10)
    p.add_argument("--domain", default="generic", choices=sorted(TEMPLATES))
    p.add_argument("--temperature", type=_between(float, 0, 1), default=0.7)
    p.add_argument("--quality-threshold", type=_between(float, 0, 1), default=0.7)
    p.add_argument("--max-depth", type=_between(int, 1, 999), default=999)
    p.add_argument("--dedup-threshold", type=float, default=0.95, help="paths at least this alike are duplicates: a lower value drops more")
    p.add_argument("--sampling", default="frequency_weighted", choices=["frequency_weighted", "random"])
    p.add_argument("--auto", action="store_true", help="relax parameters tier by tier until the count is met")
    p.add_argument("--backend", default="offline", choices=["offline", "remote"])
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--log", help="folder of responses: a run that was interrupted goes on from there")
    p.add_argument("--env-file", default=".env", help="settings of the remote backend that the environment lacks")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = BackendConfig.from_env(env_file=args.env_file)
    backend = synth.RemoteBackend(config) if args.backend == "remote" else synth.OfflineBackend()
    spark = session()
    nodes, edges = read_graphml(spark, args.graph) if args.graph else samples.sample_graph(spark, args.sample)
    stats = graph.graph_stats(nodes, edges).first()
    print(f"{stats.n_nodes} nodes, {stats.n_edges} edges; domain: {domain_description(args.domain)}")
    if args.auto:
        if args.count > stats.capacity:
            print(f"note: {args.count} is over the capacity estimate of {stats.capacity}", file=sys.stderr)
        tuned = generate.autotune(spark, nodes, edges, args.count, args.domain, args.max_depth, args.seed, backend, config, log=args.log)
        found, row = tuned.examples, generate.auto_metadata(spark, tuned, nodes, edges, args.count).first()
        tuned.breakdown(spark).show(truncate=False)
        print(f"quality level: {tuned.level}")
        for line in [*tuned.warnings(), *tuned.recommendations(row.quality.avg_quality)]:
            print(f"- {line}")
    else:
        gen = GenerationConfig(args.count, args.domain, args.temperature)
        run = generate.generate(spark, nodes, edges, gen, ExtractionConfig(args.count, args.max_depth, args.dedup_threshold, args.sampling, args.seed), ValidationConfig(args.quality_threshold), backend, config, args.log)
        found, row = run.examples, generate.metadata(run, nodes, edges, gen).first()
        print(json.dumps(run.losses.first().asDict()))
    print("\n".join(generate.report_lines(row)))
    for example in dataset.first_examples(found):
        print(json.dumps(example, ensure_ascii=False))
    dataset.write_jsonl(found, f"{args.output}.jsonl")
    dataset.write_json(found, f"{args.output}.json")
    with open(f"{args.output}.metadata.json", "w", encoding="utf-8") as out:
        json.dump(row.asDict(recursive=True), out, indent=2)
    return 0


if __name__ == "__main__":
    sys.exit(main())
