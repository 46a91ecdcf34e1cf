"""Model calls as data flow: a provider interface, embeddings, summaries and section extraction.

Providers are made once per Python worker. Only the deterministic ones are used in registered queries.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions.stage import staged
from strataform.operators.nested import SECTION_FIELDS, complete_object, keep_last_keys


class Provider(Protocol):
    def complete(self, system: str, user: str) -> str: ...


@dataclass
class FirstWords:
    """A deterministic stand-in: the first characters of the message."""

    n: int = 80

    def complete(self, system: str, user: str) -> str:
        return user[: self.n]


@dataclass
class Echo:
    """A deterministic stand-in that replies with the message."""

    def complete(self, system: str, user: str) -> str:
        return user


@dataclass(frozen=True)
class ModelConfig:
    provider: str
    model: str
    params: dict[str, Any] = field(default_factory=dict)

    def cache_key(self) -> str:
        return f"{self.provider}::{self.model}::{json.dumps(self.params, sort_keys=True, default=str)}"


def normal_params(params: dict[str, Any], local: bool = False) -> dict[str, Any]:
    """Greedy decoding for a temperature of 0 or less, with neutral sampling values; local models get a device map
    and a half precision type by default."""
    p = dict(params)
    if p.get("temperature") is not None and float(p["temperature"]) <= 0:
        p |= {"do_sample": False, "temperature": 1.0, "top_p": 1.0, "top_k": 50}
    if local:
        p.setdefault("device_map", "auto")
        p.setdefault("torch_dtype", "bfloat16")
    return p


def config_from(d: dict[str, Any]) -> ModelConfig:
    for k in ("provider", "model"):
        if not isinstance(d.get(k), str) or not d[k].strip():
            raise ValueError(f"config needs a text `{k}`")
    if not isinstance(d.get("params") or {}, dict):
        raise ValueError("`params` must be a mapping")
    return ModelConfig(d["provider"], d["model"], normal_params(d.get("params") or {}, d["provider"] != "openai"))


_registry: dict[str, Provider] = {}


def provider_for(config: ModelConfig, make: Callable[[ModelConfig], Provider]) -> Provider:
    """One client per process and configuration."""
    key = config.cache_key()
    if key not in _registry:
        _registry[key] = make(config)
    return _registry[key]


def release() -> None:
    _registry.clear()


def with_retries(call: Callable[[], str], hint: Callable[[str], float | None] = lambda m: None, tries: int = 12, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str:
    """Up to `tries` calls. A rate limit waits for its hint, or 1.5 s doubled each time up to 90; a lost connection
    2 s doubled up to 60; both with a little chance added."""
    r = rng or random.Random()
    for n in range(tries):
        try:
            return call()
        except ConnectionError:
            if n == tries - 1:
                raise
            sleep(min(60.0, 2.0 * 2**n) + r.uniform(0, 0.5))
        except Exception as e:
            if "rate limit" not in str(e).lower() or n == tries - 1:
                raise
            sleep((hint(str(e)) or min(90.0, 1.5 * 2**n)) + r.uniform(0, 0.35))
    raise AssertionError


def hash_embedding(text: str, size: int = 16) -> list[float]:
    """A deterministic embedding for tests: hashed words, unit length."""
    v = [0.0] * size
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    norm = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / norm for x in v]


def embed(df: DataFrame, text: str, out: str = "embedding", function: Callable[[str], list[float]] = hash_embedding) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: function(t or ""))

    return df.withColumn(out, run(text))


def complete(df: DataFrame, keep: list[str], user: str, system: str, make: Callable[[], Provider]) -> DataFrame:
    """keep, reply: one call per row; a call that fails gives null, not a failed job."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()

        def one(u: str) -> str | None:
            try:
                return with_retries(lambda: p.complete(system, u or ""))
            except Exception:
                return None

        for pdf in it:
            yield pdf.assign(reply=pdf["__u"].map(one))[[*keep, "reply"]]

    src = df.select(*keep, F.col(user).alias("__u"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", reply string"
    return src.mapInPandas(run, schema)


def summarise_whole(chunks: DataFrame, make: Callable[[], Provider], system: str = "Summarise.") -> DataFrame:
    """doc, reply: one call per document over its chunks in order."""
    whole = chunks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "page_content"))), lambda x: x["page_content"]), "\n\n").alias("text"))
    return complete(whole, ["doc"], "text", system, make)


def summarise_parts(chunks: DataFrame, make: Callable[[], Provider], system: str = "Summarise.") -> DataFrame:
    """doc, reply: one call per chunk, the replies joined in order."""
    each = complete(chunks, ["doc", "chunk_id"], "page_content", system, make)
    return each.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("reply", F.lit("")).alias("r")))), lambda x: x["r"]), "\n\n").alias("reply"))


def extract_sections(texts: DataFrame, make: Callable[[], Provider], prompts: dict[str, str]) -> DataFrame:
    """doc and one JSON text per section; a failed or unreadable reply is an empty section."""
    out = texts.select("doc")
    for s in SECTION_FIELDS:
        r = complete(texts, ["doc"], "text", prompts.get(s, s), make)
        ok = F.coalesce(F.expr("try_variant_get(try_parse_json(reply), '$.items', 'array<variant>') IS NOT NULL"), F.lit(False))
        out = out.join(r.select("doc", F.when(ok, F.col("reply")).otherwise(F.lit('{"items":[]}')).alias(s)), "doc", "left")
    return out


def extract_all(texts: DataFrame, make: Callable[[], Provider], prompt: str = "Extract.") -> DataFrame:
    """doc and one JSON text per section, by one call a document whose reply holds all sections; what of a reply cannot
    be read is an empty section."""
    keep_last_keys(texts.sparkSession)
    r = staged(complete(texts, ["doc"], "text", prompt, make), {"v": complete_object("reply")})
    section = lambda s: F.expr(f"CASE WHEN try_variant_get(v, '$.{s}.items', 'array<variant>') IS NOT NULL THEN to_json(try_variant_get(v, '$.{s}', 'variant')) END")
    return r.select("doc", *[F.coalesce(section(s), F.lit('{"items":[]}')).alias(s) for s in SECTION_FIELDS])


def first_document(docs: DataFrame, *order: str) -> DataFrame:
    """The first document in the order given: the mode that runs one paper only."""
    return docs.orderBy(*order).limit(1)


def with_metadata(records: DataFrame, meta: DataFrame) -> DataFrame:
    """The scanned title and DOI replace what a model made of them; documents without a record get an empty one."""
    return meta.join(records, "doc", "left").select("doc", F.to_json(F.struct("title", "doi")).alias("paper_metadata"), *[F.coalesce(s, F.lit('{"items":[]}')).alias(s) for s in SECTION_FIELDS])
