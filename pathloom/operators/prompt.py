"""Prompts for the text generator, by domain. Templates are a registry: add one to support another domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What the parser and the score ask of every reply.
FORM = (
    "The question has at least ten characters and ends with a question mark.",
    "The answer has 20 to 500 words, in sentences that end with a full stop.",
    "A bare yes, no or maybe is no answer.",
    "A line break within a string is written as \\n.",
)


@dataclass(frozen=True)
class Template:
    description: str
    role: str
    #: What holds in this domain, beside FORM.
    rules: tuple[str, ...]
    #: Whether the context section is always there, with the path where there is no context.
    always_context: bool = False
    #: Whether a run lists the graph's relationships in the prompt.
    legend: bool = False

    def head(self) -> str:
        return f"{self.role}\n\nTurn the path below into one question and one answer.\n\nPath: "

    def tail(self) -> str:
        rules = "".join(f"\n- {r}" for r in (*self.rules, *FORM))
        return f'\n\nWhat counts:{rules}\n\nReply with one JSON object only: {{"question": "...", "answer": "...", "difficulty": "easy|medium|hard"}}'


CONTEXT = "\n\nContext of nodes and edges:\n"

TEMPLATES = {
    "generic": Template(
        "any knowledge graph",
        "You prepare training pairs from the facts of a knowledge graph.",
        ("Whoever reads the pair has seen neither path nor graph, so things go by their names.", "A claim that neither path nor context makes is an error."),
    ),
    "beauty_product": Template(
        "beauty brands, products and ingredients",
        "You reply at the help desk of a cosmetics shop.",
        ("Names of brands, products and ingredients stay as the path spells them.", "An effect is mentioned only where an edge states it."),
    ),
    "beauty_makeup": Template(
        "makeup consultation",
        "You give advice at a makeup counter.",
        ("An edge is read from left to right: its label tells what the left end means for the right one.", "Where a label says avoid, the answer is a warning and never a recommendation.", "Reasons that the context notes are part of the answer."),
        always_context=True,
        legend=True,
    ),
}
DEFAULT = "generic"


def domain_description(domain: str) -> str:
    return TEMPLATES[domain].description if domain in TEMPLATES else domain


def legend_of(edges: DataFrame, most: int = 30) -> str:
    """One line that lists the relationships of resolved edges, the most frequent first (their number is the feature)."""
    found = edges.groupBy("relationship").count().orderBy(F.desc("count"), "relationship").limit(most).collect()
    return "\n\nRelationships of this graph: " + ", ".join(r.relationship for r in found) if found else ""


def prompt(path_str: Column, domain: str = DEFAULT, rich_context: Column | None = None, legend: str = "") -> Column:
    """The prompt of one path; an unknown domain gets the generic template. The legend stands before the rules."""
    t = TEMPLATES.get(domain, TEMPLATES[DEFAULT])
    context = F.coalesce(rich_context, F.lit("")) if rich_context is not None else F.lit("")
    section = F.when(context != "", F.concat(F.lit(CONTEXT), context)).otherwise(F.concat(F.lit(CONTEXT), path_str) if t.always_context else F.lit(""))
    return F.concat(F.lit(t.head()), path_str, section, F.lit(legend + t.tail()))
