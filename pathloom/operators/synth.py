"""The boundary to a text generator: backends, retries, accounting."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.model import RESPONSES, BackendConfig, GenerationConfig

SYSTEM = "You write training data and reply with valid JSON only."


class RateLimited(Exception):
    """The backend asks to slow down."""


class BackendError(Exception):
    """The backend failed in a way that another attempt may mend."""


@dataclass(frozen=True)
class Reply:
    text: str | None
    prompt_tokens: int
    completion_tokens: int


class SynthBackend(Protocol):
    def complete(self, system: str, prompt: str, temperature: float, max_tokens: int) -> Reply: ...


class OfflineBackend:
    """Replies made from the prompt's path alone: the same prompt always gives the same reply, without any network.

    Some replies come fenced, or with raw line breaks, as generators' do."""

    def complete(self, system: str, prompt: str, temperature: float, max_tokens: int) -> Reply:
        path = re.search(r"^Path: (.*)$", prompt, re.MULTILINE)
        hops = re.split(r" -\[(.*?)\]-> ", path[1] if path else "nothing")
        said = [f"{a} is tied to {b} by {r.replace('_', ' ').lower()}" for a, r, b in zip(hops[::2], hops[1::2], hops[2::2], strict=False)]
        kind = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % 4
        question = f"How does {hops[0]} relate to {hops[-1]}" + ("?" if kind else "")
        answer = "In short, " + ", and then ".join(said or ["nothing is known"]) + ("." if kind != 1 else "") + (" Each of these links was stated, step by step, on the way from the first to the last." if len(said) > 1 else "")
        text = json.dumps({"question": question, "answer": answer, "difficulty": ("easy", "medium", "hard")[min(len(said), 3) - 1 if said else 0]}, ensure_ascii=False)
        if kind == 2:
            text = f"```json\n{text}\n```"
        if kind == 3:
            text = text.replace(", and then ", ",\nand then ")
        return Reply(text, (len(prompt) + 3) // 4, (len(text) + 3) // 4)


class RemoteBackend:
    """A chat-completion service reached by HTTPS; needs the settings that config.missing() names."""

    def __init__(self, config: BackendConfig):
        if config.missing():
            raise ValueError(f"missing settings: {', '.join(config.missing())}")
        self.config = config

    def __getstate__(self) -> dict:
        """A key out of the environment stays out of tasks: the executor reads its own."""
        c = self.config
        return {"config": replace(c, api_key="") if c.api_key == BackendConfig.from_env().api_key else c}

    def complete(self, system: str, prompt: str, temperature: float, max_tokens: int) -> Reply:
        import http.client
        import urllib.error
        import urllib.request

        c = self.config if self.config.api_key else replace(self.config, api_key=BackendConfig.from_env().api_key)
        body = {"messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        url = f"{c.endpoint.rstrip('/')}/openai/deployments/{c.deployment}/chat/completions?api-version={c.api_version}"
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "api-key": c.api_key})
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            raise (RateLimited if e.code == 429 else BackendError)(str(e)) from e
        except (OSError, http.client.HTTPException) as e:
            # no connection, a broken one or a time-out
            raise BackendError(str(e)) from e
        usage = found.get("usage") or {}
        return Reply(found["choices"][0]["message"].get("content"), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))


def with_retries(backend: SynthBackend, prompt: str, gen: GenerationConfig, config: BackendConfig, sleep: Callable[[float], None] = time.sleep) -> tuple[Reply, str]:
    """The reply and a status: ok, empty, rate_limited, api_error or error. Failures are values; they never fail a task."""
    for attempt in range(config.max_retries):
        last = attempt == config.max_retries - 1
        try:
            reply = backend.complete(SYSTEM, prompt, gen.temperature, gen.max_tokens)
            return reply, "ok" if reply.text else "empty"
        except RateLimited:
            if last:
                return Reply(None, 0, 0), "rate_limited"
            sleep(config.retry_delay * 2**attempt)
        except BackendError:
            if last:
                return Reply(None, 0, 0), "api_error"
            sleep(config.retry_delay)
        except Exception:
            return Reply(None, 0, 0), "error"
    return Reply(None, 0, 0), "error"


def synthesize(prompts: DataFrame, backend: SynthBackend | None = None, gen: GenerationConfig = GenerationConfig(), config: BackendConfig = BackendConfig()) -> DataFrame:
    """One row per prompt (draw_id, prompt) with the raw reply, tokens and status. Write it before it is used twice.

    Each task has config.concurrency prompts under way at a time; config.partitions, if set, is the number of tasks."""
    backend = backend or OfflineBackend()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, config.concurrency)) as pool:
            for b in batches:
                replies = pool.map(lambda text: with_retries(backend, text, gen, config), b["prompt"])
                rows = [(draw_id, text, r.text, r.prompt_tokens, r.completion_tokens, status) for draw_id, text, (r, status) in zip(b["draw_id"], b["prompt"], replies, strict=True)]
                yield pd.DataFrame(rows, columns=["draw_id", "prompt", "raw", "prompt_tokens", "completion_tokens", "status"])

    asked = prompts.select("draw_id", "prompt")
    return (asked.repartition(config.partitions, "draw_id") if config.partitions else asked).mapInPandas(run, RESPONSES)


def cost_report(responses: DataFrame, input_price: float = BackendConfig.input_price, output_price: float = BackendConfig.output_price) -> DataFrame:
    """One row of tokens, dollars and calls; calls are the rows that got a reply, even an empty one."""
    called = F.col("status").isin("ok", "empty")
    sums = responses.agg(F.coalesce(F.sum(F.when(called, F.col("prompt_tokens"))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.when(called, F.col("completion_tokens"))), F.lit(0)).alias("output_tokens"), F.count_if(called).alias("api_calls"))
    a, b = F.col("input_tokens") / 1000 * F.lit(input_price), F.col("output_tokens") / 1000 * F.lit(output_price)
    return sums.select("input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), a.alias("input_cost"), b.alias("output_cost"), (a + b).alias("total_cost"), "api_calls", F.when(F.col("api_calls") == 0, 0.0).otherwise((a + b) / F.col("api_calls")).alias("avg_cost_per_call"))
