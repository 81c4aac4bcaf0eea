"""Models as an extension point: completions, typed answers, prompts, embeddings and chunkers of one's own.

Nothing here calls a network. A provider is a function of a ``Request``; requests are rows, and a
batch of them is answered in Arrow batches on the executors, each with retries and a row of usage.
``RecordedProvider`` answers from recorded texts, for tests and reruns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenar.functions import evidence
from lumenar.functions import values as V
from lumenar.plans.runtime import RECORDS, Extractor
from lumenar.storage import written


@dataclass(frozen=True)
class Request:
    prompt: str
    system: str = ""
    model: str = ""
    stage: str = ""
    query_id: str = ""


@dataclass(frozen=True)
class Completion:
    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


Provider = Callable[[Request], Completion]


@dataclass(frozen=True)
class RecordedProvider:
    """Answers by the request's prompt, as recorded; unknown prompts have the default answer, or fail without one."""

    answers: dict[str, str] = field(default_factory=dict)
    default: str | None = None

    def __call__(self, request: Request) -> Completion:
        text = self.answers.get(request.prompt, self.default)
        if text is None:
            raise LookupError(f"no recorded answer for {request.prompt[:60]!r}")
        return Completion(text, len(request.prompt.split()), len(text.split()))


def complete_text(provider: Provider, request: Request, tries: int = 3) -> Completion:
    """The provider's answer, asked again after a failure; the last failure is raised."""
    for attempt in range(tries):
        try:
            return provider(request)
        except Exception:  # noqa: BLE001 - any failure of a provider is worth another try
            if attempt == tries - 1:
                raise
    raise ValueError("tries is at least 1")


def completions(requests: DataFrame, provider: Provider, model: str = "", stage: str = "", query_id: str = "", tries: int = 3) -> DataFrame:
    """requests (key, prompt) with text, error, prompt_tokens and completion_tokens; a request that fails has an error and no text."""
    columns = requests.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes) + ", text string, error string, prompt_tokens long, completion_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                try:
                    done = complete_text(provider, Request(prompt or "", model=model, stage=stage, query_id=query_id), tries)
                    rows.append((done.text, None, done.prompt_tokens, done.completion_tokens))
                except Exception as error:  # noqa: BLE001 - kept with its row, the others go on
                    rows.append((None, str(error), None, None))
            told = pd.DataFrame(rows, columns=["text", "error", "prompt_tokens", "completion_tokens"], index=batch.index).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            yield pd.concat([batch[columns], told], axis=1)

    return requests.mapInPandas(run, schema)


def usage_rows(done: DataFrame, provider: str, model: str, stage: str, query_id: str | None = None) -> DataFrame:
    """What a usage log holds of completions, a row for each call; ``sinks.append_usage`` writes it."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return done.select(
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        F.struct("prompt_tokens", "completion_tokens", total.alias("total_tokens")).alias("usage"),
        F.struct(F.lit(stage).alias("stage"), F.lit(query_id).cast("string").alias("query_id")).alias("context"),
    )


# --- typed answers ---------------------------------------------------------------------

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def json_block(text: str | None) -> Any:
    """The first JSON object in a model's text: the whole text, a fenced block, or the first balanced braces that parse; None without one."""
    for candidate in _candidates(text or ""):
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return value
    return None


def _candidates(text: str) -> Iterator[str]:
    yield text.strip()
    yield from (m.strip() for m in _FENCE.findall(text))
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted, escaped = 0, False, False
        for end in range(start, len(text)):
            c = text[end]
            if quoted:
                quoted, escaped = (escaped or c != '"'), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    yield text[start : end + 1]
                    break


def json_block_column(text: Column) -> Column:
    """``json_block`` as JSON text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (value := json_block(t)) is None else json.dumps(value, sort_keys=True, ensure_ascii=False))

    return run(text)


def typed(done: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """done with ``value``, the answer's JSON as a struct of ``schema`` (DDL), and ``valid``: an object was found and no field of it is null."""
    told = done.withColumn("_json", json_block_column(F.col(text))).withColumn("value", F.from_json("_json", schema))
    fields = told.schema["value"].dataType.fieldNames()
    whole = F.lit(True)
    for name in fields:
        whole &= F.col("value")[name].isNotNull()
    return told.withColumn("valid", F.coalesce(F.col("_json").isNotNull() & whole, F.lit(False))).drop("_json")


def complete_typed(requests: DataFrame, provider: Provider, schema: str, key: str = "key", repairs: int = 1, **options: Any) -> DataFrame:
    """Typed completions; invalid answers are asked for again, told what was wrong, up to ``repairs`` times.

    Each round is written before the next: every answer is asked for once, and rounds don't run inside one another.
    """
    rounds, asked = [], requests.select(key, "prompt")
    for left in reversed(range(repairs + 1)):
        done = written(typed(completions(asked, provider, **options), schema), "typed")
        rounds.append(done.where("valid") if left else done)
        asked = done.where("not valid").select(key, F.concat("prompt", F.lit("\n\nAnswer with one JSON object of: " + schema)).alias("prompt"))
    return reduce(DataFrame.unionByName, rounds)


# --- prompts ---------------------------------------------------------------------------

PROMPTS = {
    "table_assignment": "Which of these tables does the document describe: {tables}? Answer with a JSON object {{\"table\": name}}, null if none.\n\n{document}",
    "attribute_extraction": "Extract from the document the attributes {attributes} of the table {table}. Answer with a JSON object from attribute to text, null where the document does not tell.\n\n{document}",
    "compare_values": "Do these two values of {attribute} mean the same? {left} / {right}. Answer with a JSON object {{\"Result\": true or false, \"Reasoning\": text}}.",
    "text_to_sql": "Write one SQL query over the tables {schema} for the question: {question}",
}


def register_prompt(name: str, template: str) -> None:
    PROMPTS[name] = template


def create_prompt(name: str, **fields: str) -> str:
    """The named template with its fields; unknown names and missing fields raise ValueError."""
    if name not in PROMPTS:
        raise ValueError(f"unknown prompt {name!r}; known: {', '.join(sorted(PROMPTS))}")
    try:
        return PROMPTS[name].format(**fields)
    except KeyError as missing:
        raise ValueError(f"prompt {name!r} needs {missing}") from None


def prompt_column(name: str, document: Column, **fields: str) -> Column:
    """A prompt for each document."""
    before, after = create_prompt(name, document="\0", **fields).split("\0")
    return F.concat(F.lit(before), F.coalesce(document, F.lit("")), F.lit(after))


# --- extractors and judges from models -------------------------------------------------


def model_extractor(provider: Provider, text: str = "doc_text", tries: int = 3) -> Extractor:
    """An extractor that asks a model for the attributes of each document, table by table; answers without an object give no record."""

    def run(docs: DataFrame, schema: list[dict]) -> DataFrame:
        out = docs.sparkSession.createDataFrame([], RECORDS)
        for table in schema:
            names = [a["Attribute Name"] for a in table["Attributes"]]
            prompt = prompt_column("attribute_extraction", F.col(text), attributes=", ".join(names), table=table["Schema Name"])
            done = completions(docs.select("doc_id", prompt.alias("prompt")), provider, stage="extraction", tries=tries)
            cells = F.from_json(json_block_column(F.col("text")), "map<string,string>")
            known = F.map_filter(cells, lambda k, v: k.isin(*names) & ~V.is_none_value(v)) if names else cells
            rows = done.withColumn("data", known).where("data is not null")
            out = out.unionByName(rows.select("doc_id", F.lit(table["Schema Name"]).alias("table_id"), F.lit("0").alias("record_id"), "data"))
        return out

    return run


def model_assigner(provider: Provider, tables: list[str], text: str = "doc_text") -> Callable[[DataFrame], DataFrame]:
    """documents -> (doc_id, table_id) by a model's answer; others than the listed tables are none."""

    def run(docs: DataFrame) -> DataFrame:
        prompt = prompt_column("table_assignment", F.col(text), tables=", ".join(tables))
        done = typed(completions(docs.select("doc_id", prompt.alias("prompt")), provider, stage="table_assignment"), "table string")
        return done.where(F.col("value.table").isin(tables)).select("doc_id", F.col("value.table").alias("table_id"))

    return run


def judged(pairs: DataFrame, judges: list[Provider], attribute: str = "attribute") -> DataFrame:
    """pairs (key, left, right) with ``votes_for``, ``votes_against`` and ``agreed``: at least as many judges for as against, and one at all.

    A judge that fails, or whose answer has no ``Result``, has no vote.
    """
    asked = pairs.select("key", F.concat(*_compare(attribute)).alias("prompt"))
    ballots = None
    for judge in judges:
        votes = typed(completions(asked, judge, stage="semantic_evaluation"), "Result boolean").select("key", F.col("value.Result").alias("vote"))
        ballots = votes if ballots is None else ballots.unionByName(votes)
    if ballots is None:
        return pairs.withColumns({"votes_for": F.lit(0).cast("long"), "votes_against": F.lit(0).cast("long"), "agreed": F.lit(False)})
    return pairs.join(committee(ballots), "key", "left")


def _compare(attribute: str) -> list[Column]:
    first, rest = create_prompt("compare_values", attribute=attribute, left="\0", right="\1").split("\0")
    middle, last = rest.split("\1")
    return [F.lit(first), F.coalesce("left", F.lit("")), F.lit(middle), F.coalesce("right", F.lit("")), F.lit(last)]


def committee(ballots: DataFrame) -> DataFrame:
    """(key, votes_for, votes_against, agreed) of ballots (key, vote); null votes don't count, a tie agrees, no votes don't."""
    counts = ballots.groupBy("key").agg(F.count_if(F.col("vote")).alias("votes_for"), F.count_if(~F.col("vote")).alias("votes_against"))
    return counts.withColumn("agreed", (F.col("votes_for") + F.col("votes_against") > 0) & (F.col("votes_for") >= F.col("votes_against")))


# --- embeddings and chunkers -----------------------------------------------------------

EMBEDDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {"local": lambda model, dimensions=256: lambda text: evidence.hash_embedding(text, dimensions)}


def register_embedder(prefix: str, make: Callable[..., Callable[[Column], Column]]) -> None:
    EMBEDDERS[prefix] = make


def embedder(model: str, **options: Any) -> Callable[[Column], Column]:
    """The embedding of a text column, by the model's prefix (``local/hash``); unknown prefixes raise ValueError."""
    prefix = model.split("/", 1)[0]
    if prefix not in EMBEDDERS:
        raise ValueError(f"no embeddings for {model!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[prefix](model=model, **options)


CHUNKERS: dict[str, Callable[[Column, int, int], Column]] = {"fixed_size": V.char_chunks, "token": V.token_chunks}


def register_chunker(name: str, chunks: Callable[[Column, int, int], Column]) -> None:
    """A chunker of one's own: (text, size, overlap) -> array of texts."""
    CHUNKERS[name] = chunks


def create_chunker(name: str, size: int, overlap: int = 0) -> Callable[[Column], Column]:
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; known: {', '.join(sorted(CHUNKERS))}")
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the size is positive and the overlap smaller than it")
    return lambda text: CHUNKERS[name](text, size, overlap)
