"""Corpus mixes: which sources, with which text field, weight and minimum score."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


@dataclass(frozen=True)
class Source:
    """One entry of a mix. ``members`` are the values of the source column it covers."""

    name: str
    weight: float
    members: tuple[str, ...] = ()
    path: str | None = None
    text_field: str = "text"
    min_score: float | None = None
    id_field: str = "doc_id"


@dataclass(frozen=True)
class Mix:
    sources: tuple[Source, ...]
    shard_tokens: int
    val_tokens: int
    name: str = field(default="train")

    @property
    def shares(self) -> dict[str, float]:
        """Target share per source; the total is summed in list order."""
        total = sum(s.weight for s in self.sources)
        return {s.name: s.weight / total for s in self.sources}

    @property
    def order(self) -> dict[str, int]:
        return {s.name: i for i, s in enumerate(self.sources)}


def choose_mix(mixes: Mapping[str, Mix], name: str) -> Mix:
    if name not in mixes:
        raise ValueError(f"unknown mix {name!r}, expected one of {sorted(mixes)}")
    return mixes[name]


def _block(first: int) -> tuple[str, ...]:
    return tuple(f"src{i}" for i in range(first, first + 5))


def table_mixes(shard_tokens: int = 100_000, val_tokens: int = 10_000) -> dict[str, Mix]:
    """The two mixes over the ``documents`` table."""
    # The weights of the two mixes.
    train = (
        Source("edu", 0.60, _block(0), min_score=1),
        Source("web", 0.25, _block(5)),
        Source("code", 0.08, _block(10)),
        Source("math", 0.07, _block(15)),
    )
    anneal = (
        Source("edu_hq", 0.50, _block(0), min_score=1),
        Source("math", 0.20, _block(15)),
        Source("synthetic", 0.20, _block(5)),
        Source("code", 0.10, _block(10)),
    )
    return {
        "train": Mix(train, shard_tokens, val_tokens, "train"),
        "anneal": Mix(anneal, shard_tokens, 0, "anneal"),
    }


def parse_spec(text: str) -> dict[str, Mix]:
    """Mixes from a JSON (or YAML, where its parser is installed) text.

    ``shard_tokens``, ``val_tokens`` and ``mixes``: per mix a list of sources with
    ``name``, ``weight`` and optionally ``path``, ``members``, ``text_field``, ``id_field``, ``min_score``.
    Only the mix "train" has a validation part, unless a mix says otherwise.
    """
    try:
        spec = json.loads(text)
    except ValueError:
        import yaml

        spec = yaml.safe_load(text)
    out = {}
    for name, body in spec["mixes"].items():
        sources = body["sources"] if isinstance(body, dict) else body
        own = body if isinstance(body, dict) else {}
        unknown = {k for s in sources for k in s} - {"name", "weight", "path", "members", "text_field", "min_score", "id_field"}
        if unknown:
            raise ValueError(f"mix {name!r} has unknown entries {sorted(unknown)}")
        out[name] = Mix(
            tuple(Source(**{**s, "weight": float(s["weight"]), "members": tuple(s.get("members", ()))}) for s in sources),
            int(own.get("shard_tokens", spec["shard_tokens"])),
            int(own.get("val_tokens", spec.get("val_tokens", 0) if name == "train" else 0)), name)
    return out


def spec_text(mixes: Mapping[str, Mix]) -> str:
    """The JSON text of mixes, as ``parse_spec`` reads it."""
    return json.dumps({"shard_tokens": next(iter(mixes.values())).shard_tokens, "mixes": {
        name: {"shard_tokens": m.shard_tokens, "val_tokens": m.val_tokens, "sources": [
            {k: v for k, v in vars(s).items() if v is not None} for s in m.sources]}
        for name, m in mixes.items()}})


def read_spec(spark: SparkSession, path: str) -> dict[str, Mix]:
    """Mixes from a specification file, read from wherever Spark reads."""
    return parse_spec(spark.read.text(path, wholetext=True).first()[0])


def write_spec(spark: SparkSession, mixes: Mapping[str, Mix], path: str) -> None:
    spark.createDataFrame([(spec_text(mixes),)], "value string").coalesce(1).write.text(path)


def spec_frame(spark: SparkSession, mix: Mix) -> DataFrame:
    """The mix as a table, one row per source."""
    shares = mix.shares
    return spark.createDataFrame(
        [(i, s.name, float(s.weight), shares[s.name], None if s.min_score is None else float(s.min_score)) for i, s in enumerate(mix.sources)],
        "ord int, source string, weight double, share double, min_score double",
    )


def _by_name(mix: Mix, key: Column, value) -> Column:
    out = None
    for s in mix.sources:
        v = value(s)
        out = F.when(key == s.name, v) if out is None else out.when(key == s.name, v)
    return out


def member_source(mix: Mix, member: Column) -> Column:
    """Name of the mix entry a row belongs to, null if none."""
    out = None
    for s in mix.sources:
        hit = member.isin(*s.members)
        out = F.when(hit, s.name) if out is None else out.when(hit, s.name)
    return out


def with_mix_source(docs: DataFrame, mix: Mix, member: str = "source") -> DataFrame:
    """Rename the raw source of each row to its mix entry and add its minimum score."""
    named = docs.withColumn(member, member_source(mix, F.col(member))).where(F.col(member).isNotNull())
    return named.withColumn(
        "min_score", _by_name(mix, F.col(member), lambda s: F.lit(s.min_score).cast("double"))
    )


def read_sources(spark: SparkSession, mix: Mix, id_name: str = "doc_id",
                 scores: Sequence[str] = ("int_score", "score")) -> DataFrame:
    """Union of one projected parquet scan per source path: ``source, <id>, text, score, min_score``.

    Schemas are looked at path by path. Text and id fields may lie inside structs (``a.b``) and are
    renamed; of the score columns the first counts that a source has, whatever its values (a null is no
    score), and a source without any has no score. Ids of unlike types become strings, whole numbers of unlike
    widths the wider ones.
    """
    parts = []
    for s in mix.sources:
        raw = spark.read.parquet(s.path)
        present = [c for c in scores if c in raw.columns]
        score = (F.col(present[0]) if present else F.lit(None)).cast("double")
        try:
            parts.append(raw.select(
                F.lit(s.name).alias("source"), F.col(s.id_field).alias(id_name), F.col(s.text_field).cast("string").alias("text"),
                score.alias("score"), F.lit(s.min_score).cast("double").alias("min_score")))
        except AnalysisException as missing:
            raise ValueError(f"source {s.name!r} at {s.path!r} lacks {s.text_field!r} or {s.id_field!r}") from missing
    kinds = {p.schema[id_name].dataType for p in parts}
    if len(kinds) > 1:
        kind = "long" if all(isinstance(k, IntegralType) for k in kinds) else "string"
        parts = [p.withColumn(id_name, F.col(id_name).cast(kind)) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def tokenizer_mix(code_frac: float = 0.1) -> Mix:
    """Text and code fractions for vocabulary training; no code source at fraction 0."""
    sources = [Source("text", 1 - code_frac)]
    if code_frac > 0:
        sources.append(Source("code", code_frac))
    return Mix(tuple(sources), 0, 0, "tokenizer")
