"""Completions of a chat model as a source of drafts: prompts in, drafts out, with fallbacks for endpoints that can less.

The transport is a function, so that a cluster's own client, a gateway or a test's table can stand for it.
Requests run on the executors, one prompt at a time in a task; how many tasks run is the request budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import markup as M
from palimpsest.functions import text as T


class Refused(Exception):
    """The endpoint's refusal: its status and message."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Endpoint:
    model: str
    provider: str = "openai"
    temperature: float = 0.2
    timeout_ms: int = 300_000
    budget: int = 4


#: (endpoint, payload) to the parts of the answer: deltas of a stream, or one whole message.
Transport = Callable[[Endpoint, dict], Iterator[dict]]


def delta_text(part: dict, field: str) -> str:
    """The text of a streamed delta or a whole message: a string, or a list of parts with texts."""
    choices = part.get("choices") or [{}]
    content = (choices[0].get(field) or {}).get("content")
    if isinstance(content, list):
        return "".join(c.get("text") or "" for c in content)
    return content or ""


def complete(endpoint: Endpoint, transport: Transport, system: str, user: str) -> str:
    """The answer's text. Asks for a stream of JSON; without either if the endpoint refuses it; an empty answer is an error."""
    stream = as_json = True
    while True:
        told = system if as_json else f"{system}\n\nReturn valid JSON only."
        payload = {"model": endpoint.model, "temperature": endpoint.temperature, "stream": stream, "messages": [{"role": "system", "content": told}, {"role": "user", "content": user}]}
        if as_json:
            payload["response_format"] = {"type": "json_object"}
        try:
            text = "".join(delta_text(p, "delta" if stream else "message") for p in transport(endpoint, payload))
        except Refused as refusal:
            said = str(refusal).lower()
            if stream and "stream" in said:
                stream = False
                continue
            if as_json and any(w in said for w in ("response_format", "json_object", "json mode")):
                as_json = False
                continue
            raise
        if not text.strip():
            raise Refused("The model returned an empty response.")
        return text


def probe(endpoint: Endpoint, transport: Transport) -> tuple[bool, str]:
    """Whether the endpoint answers a test with the JSON asked for, and what to tell the user."""
    try:
        answer = complete(endpoint, transport, 'Answer with this JSON only: {"status":"ok"}.', "Answer now.")
    except Refused as refusal:
        return False, str(refusal)
    if '"status"' not in answer:
        return False, "The model answered, but not with the JSON asked for."
    return True, f"Connected to {endpoint.provider}/{endpoint.model}"


SYSTEM = (
    "You translate the items of a task. Answer with one JSON object, without fences, of this shape: "
    '{"schemaVersion":2,"taskId":"...","translations":[{"id":"1","translatedText":"..."}]}. '
    "Keep all ids in their order, and leave out or add nothing. Copy placeholders, markup, list markers, entities and code in backticks exactly; "
    "code may move where the language wants it, once each. Use the glossary's terms."
)


def protected(text: Column) -> Column:
    """Struct of what an item must keep: its placeholders and its code."""
    return F.struct(T.placeholders(text).alias("placeholders"), F.coalesce(T.code_spans(text)["spans"], F.array().cast("array<string>")).alias("code"))


def prompts(tasks: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """(task_id, chunk_index, prompt) from (task_id, chunk_index, chunk_count, heading, target_locale, content).

    Sections: the task, its place among the chunks if there are several, what has to be kept, and for a
    try that follows another (``retries``: task_id, chunk_index, previous, issues) the answer to mend and what was wrong.
    """
    rows = tasks.join(retries, ["task_id", "chunk_index"], "left") if retries is not None else tasks.withColumns({"previous": F.lit(None).cast("string"), "issues": F.lit(None).cast("array<string>")})
    kept = F.filter(F.transform("content", lambda i: F.struct(i["id"].alias("id"), protected(i["text"]).alias("keep"))), lambda i: (F.size(i["keep"]["placeholders"]) > 0) | (F.size(i["keep"]["code"]) > 0))
    part = lambda title, body: F.concat(F.lit(f"{title}\n"), body)
    sections = F.array_compact(F.array(
        F.concat(F.lit("Translate this task to "), "target_locale", F.lit(". Check placeholders and code before you answer.")),
        part("Task:", F.to_json(F.struct("task_id", "content"))),
        F.when(F.col("chunk_count") > 1, part("This is one part of a page:", F.to_json(F.struct("chunk_index", "chunk_count", "heading")))),
        F.when(F.size(kept) > 0, part("To be kept:", F.to_json(kept))),
        F.when(F.col("previous").isNotNull(), part("Your last answer, to be mended; leave what is right as it is:", F.col("previous"))),
        F.when(F.size("issues") > 0, part("What was wrong:", F.to_json("issues"))),
    ))
    return rows.select("task_id", "chunk_index", F.array_join(sections, "\n\n").alias("prompt"))


def drafts(prompts_: DataFrame, endpoint: Endpoint, transport: Transport) -> DataFrame:
    """(task_id, chunk_index, raw, json, error) for each prompt; a failed request is a row, not an error."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    raw, error = complete(endpoint, transport, SYSTEM, r.prompt), None
                except Exception as problem:  # noqa: BLE001 - any failure of one request is that row's result
                    raw, error = None, str(problem) or type(problem).__name__
                yield pd.DataFrame([(r.task_id, r.chunk_index, raw, error)], columns=["task_id", "chunk_index", "raw", "error"])

    answered = prompts_.repartition(endpoint.budget, "task_id", "chunk_index").mapInPandas(ask, "task_id string, chunk_index int, raw string, error string")
    return answered.select("task_id", "chunk_index", "raw", M.json_object(F.col("raw")).alias("json"), "error")


DRAFT = "taskId string, translations array<struct<id:string,translatedText:string>>"


def draft_items(drafts_: DataFrame) -> DataFrame:
    """(task_id, chunk_index, named_id, k, id, translated_text) of the drafts that parse."""
    parsed = drafts_.select("task_id", "chunk_index", F.from_json("json", DRAFT).alias("d")).where("d.translations IS NOT NULL")
    return parsed.select("task_id", "chunk_index", F.col("d.taskId").alias("named_id"), F.posexplode("d.translations").alias("k", "t")).select("task_id", "chunk_index", "named_id", "k", F.col("t.id").alias("id"), F.col("t.translatedText").alias("translated_text"))


def http_transport(base_url: str, token: str) -> Transport:
    """A chat endpoint over HTTP: the parts of a stream as they come, or the one whole answer."""

    def send(endpoint: Endpoint, payload: dict) -> Iterator[dict]:
        import json
        import urllib.error
        import urllib.request

        request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(payload).encode(), {"content-type": "application/json", "authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request, timeout=endpoint.timeout_ms / 1000) as got:
                if not payload["stream"]:
                    yield json.loads(got.read())
                    return
                for line in got:
                    text = line.decode("utf-8").strip()
                    if text.startswith("data:") and text != "data: [DONE]":
                        yield json.loads(text[5:])
        except urllib.error.HTTPError as refused:
            raise Refused(refused.read().decode("utf-8", "replace") or str(refused), refused.code) from refused
        except (urllib.error.URLError, TimeoutError) as lost:
            raise Refused(str(lost)) from lost

    return send
