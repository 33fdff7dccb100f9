"""Briefs and texts from a model, as plug-ins, and the choice of an adapter.

The engine holds no weights. A provider is called with a list of prompts and gives
as many answers; it is made once in each worker by a factory, which is given the
parameters of generation. Without one, the first sentence of a scene is its brief.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

Provider = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class GenerationConfig:
    max_new_tokens: int = 1500
    temperature: float = 0.85
    top_p: float = 0.9
    repetition_penalty: float = 1.15
    seed: int | None = None


@dataclass(frozen=True)
class BriefConfig:
    max_new_tokens: int = 50
    temperature: float = 0.3
    top_p: float = 0.9
    repetition_penalty: float = 1.0
    seed: int | None = None
    context_chars: int = 1500


Factory = Callable[[GenerationConfig | BriefConfig], Provider]


def generated(rows: DataFrame, factory: Factory, config: GenerationConfig | BriefConfig = GenerationConfig(), prompt: str = "prompt", into: str = "generated") -> DataFrame:
    """rows with what the provider makes of the prompts; the part after the instruction, stripped."""

    def run(batches):
        provider = None
        for b in batches:
            provider = provider or factory(config)
            answers = provider(b.column(b.schema.get_field_index(prompt)).to_pylist())
            yield b.append_column(into, pa.array(answers, pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{into}` string").withColumn(into, T.response(F.col(into)))


def echo(config: GenerationConfig | BriefConfig) -> Provider:
    """A provider without a model, to try a pipeline with: the prompt, then its seed and its words turned round, up to the length asked for."""
    return lambda prompts: [f"{p} {config.seed} {' '.join(p.split()[::-1][: config.max_new_tokens])}" for p in prompts]


def first_sentence(text: Column) -> Column:
    """The offline brief of a scene."""
    return T.clean_brief(F.element_at(T.pieces_by_sentence(T.unwrapped(T.stripped(text)), 2), 1))


def extractive_briefs(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunks that get a brief, without their text."""
    return chunks.withColumn("brief", first_sentence(F.col(text))).where(F.col("brief") != "").drop(text)


def synthesized_briefs(chunks: DataFrame, factory: Factory, config: BriefConfig = BriefConfig(), text: str = "text") -> DataFrame:
    """Briefs by a model, cleaned; empty ones are dropped."""
    asked = chunks.withColumn("prompt", T.brief_request(F.col(text), config.context_chars)).drop(text)
    out = generated(asked, factory, config, "prompt", "brief").drop("prompt")
    return out.withColumn("brief", T.clean_brief(F.col("brief"))).where(F.col("brief") != "")


def chosen_adapter(paths: DataFrame) -> DataFrame:
    """(register, path): the folder named final, else the checkpoint with the largest number, from (register, path)."""
    name = F.element_at(F.split(T.forward_slashes(F.col("path")), "/"), -1)
    number = F.nullif(F.regexp_extract(name, r"^checkpoint-(\d+)$", 1), F.lit("")).cast("long")
    rank = F.when(name == "final", F.lit(2**62)).otherwise(number)
    return paths.withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("register").agg(F.max_by("path", "__rank").alias("path"))
