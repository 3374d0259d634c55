"""Linkage configurations: the parameter grid, its files, and the derived sizes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import FAMILIES

# Encodings, the grid of the published sweep, and the keys of the configuration file.
ABF, CLK, RLB = "ABF", "CLK", "RLB"
ENCODINGS = (ABF, CLK, RLB)
GRID_SIZES = (100, 200, 400)
GRID_SHARES = (0.02, 0.05, 0.1)
GRID_ROUNDS = 2
GRID_HASH = "TripleHash"
GRID_RLB_SHARE = 0.4
GROUP_KEYS = ("base", "erro1", "erro2", "erro3", "erro4", "erro5")
SUPPRESS_KEYS = ("sup_nome", "sup_nomeResp", "sup_data", "sup_mun")
WORD_KEYS = ("ret_nome", "ret_nomeResp", "abr_nome", "abr_nomeResp", "abr_nomeM", "abr_nomeRespM")
SUPPRESS_WEIGHT = 0.25
WORD_WEIGHT = 0.15

WEIGHTS_TYPE = T.StructType([T.StructField(k, T.DoubleType()) for k in GROUP_KEYS + SUPPRESS_KEYS + WORD_KEYS])
CONFIG_TYPE = T.StructType(
    [
        T.StructField("tamanho_BF", T.IntegerType()),
        T.StructField("quant_hash", T.IntegerType()),
        T.StructField("tipo_hash", T.StringType()),
        T.StructField(
            "tipo_bloom",
            T.StructType([T.StructField(k, T.StringType()) for k in ("nome", "A", "B")]),
        ),
        T.StructField("peso_erro", WEIGHTS_TYPE),
        T.StructField("porcent_rlb", T.DoubleType()),
    ]
)
FILE_TYPE = T.MapType(T.StringType(), CONFIG_TYPE)


@dataclass(frozen=True)
class ErrorWeights:
    """Shares of the six error groups and of the two sub-splits; normalised where they are used."""

    groups: tuple[float, ...] = (0.75, 0.05, 0.05, 0.05, 0.05, 0.05)
    suppress: tuple[float, ...] = (SUPPRESS_WEIGHT,) * len(SUPPRESS_KEYS)
    words: tuple[float, ...] = (WORD_WEIGHT,) * len(WORD_KEYS)

    @classmethod
    def evenly(cls, share: float) -> ErrorWeights:
        """The same share for every error type, the rest without error."""
        return cls(groups=(1 - 5 * share,) + (share,) * 5)

    @property
    def error_share(self) -> float:
        return round(1 - self.groups[0], 2)


@dataclass(frozen=True)
class LinkConfig:
    """One linkage run: ``m`` bits per attribute, ``k`` hash rounds, a hash family and an encoding."""

    config_id: int = 1
    m: int = 100
    k: int = 2
    hash: str = "TripleHash"
    encoding: str = CLK
    n_attrs: int = 4
    rlb_share: float | None = None
    weights: ErrorWeights = field(default_factory=ErrorWeights)
    seed: int = 1991

    def __post_init__(self):
        if self.hash not in FAMILIES:
            raise ValueError(f"unknown hash family {self.hash!r}")
        if self.encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {self.encoding!r}")
        if self.encoding == RLB and self.rlb_share is None:
            raise ValueError("RLB needs rlb_share")

    @property
    def size(self) -> int:
        """Filter length."""
        return self.m * self.n_attrs

    @property
    def rlb_slots(self) -> int:
        """Source bits picked per attribute."""
        return int(self.rlb_share * self.m) if self.rlb_share is not None else 0

    @property
    def modulus(self) -> int:
        return self.size if self.encoding == CLK else self.m

    def with_attrs(self, n_attrs: int) -> LinkConfig:
        return replace(self, n_attrs=n_attrs)


def widest(configs: Iterable[LinkConfig]) -> int:
    return max(c.size for c in configs)


def config_rows(configs: Iterable[LinkConfig]) -> Column:
    """The configurations as an array literal of structs, to be exploded onto data: no join needed."""
    structs = [
        f"named_struct('config_id', {c.config_id}, 'm', {c.m}, 'k', {c.k}, 'hash', '{c.hash}', "
        f"'encoding', '{c.encoding}', 'size', {c.size}, 'modulus', {c.modulus}, 'rlb_slots', {c.rlb_slots})"
        for c in configs
    ]
    return F.expr(f"array({', '.join(structs)})")


def grid(spark: SparkSession) -> DataFrame:
    """Sizes x encodings x error shares in row-major order, in the shape of the configuration file.

    The product is three explodes of literal arrays on one row.
    """

    def axis(values: tuple) -> Column:
        return F.posexplode(F.array(*[F.lit(v) for v in values]))

    cells = (
        spark.range(1)
        .select(axis(GRID_SIZES).alias("i", "tamanho_BF"))
        .select("*", axis(ENCODINGS).alias("j", "nome"))
        .select("*", axis(GRID_SHARES).alias("l", "share"))
    )
    number = (F.col("i") * len(ENCODINGS) + F.col("j")) * len(GRID_SHARES) + F.col("l") + 1
    weights = [(F.lit(1.0) - F.lit(5.0) * F.col("share")).alias(GROUP_KEYS[0])]
    weights += [F.col("share").alias(k) for k in GROUP_KEYS[1:]]
    weights += [F.lit(SUPPRESS_WEIGHT).alias(k) for k in SUPPRESS_KEYS]
    weights += [F.lit(WORD_WEIGHT).alias(k) for k in WORD_KEYS]
    body = F.struct(
        F.col("tamanho_BF"),
        F.lit(GRID_ROUNDS).alias("quant_hash"),
        F.lit(GRID_HASH).alias("tipo_hash"),
        F.struct(F.col("nome"), F.lit(None).cast("string").alias("A"), F.lit(None).cast("string").alias("B")).alias(
            "tipo_bloom"
        ),
        F.struct(*weights).alias("peso_erro"),
        F.when(F.col("nome") == RLB, F.lit(GRID_RLB_SHARE)).alias("porcent_rlb"),
    )
    return cells.select(F.concat(F.lit("config"), number.cast("string")).alias("config"), body.alias("body"))


def append_configs(configs: DataFrame, path: str) -> None:
    """Append configurations as JSON, one object per line."""
    line = F.to_json(F.create_map(F.col("config"), F.col("body")))
    configs.select(line.alias("value")).write.mode("append").text(path)


def read_configs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Configurations of a file: one JSON object of objects, or one such object per line."""
    text = spark.read.text(path, wholetext=not lines)
    parsed = text.select(F.from_json("value", FILE_TYPE).alias("entries"))
    return parsed.select(F.explode("entries").alias("config", "body"))


def sizes(configs: DataFrame, n_attrs: int) -> DataFrame:
    """Derived figures: number, filter length a = m * n, RLB share int(f*m)/m (0 if not set), error share."""
    m = F.col("body.tamanho_BF")
    slots = F.floor(F.coalesce(F.col("body.porcent_rlb"), F.lit(0.0)) * m)
    return configs.select(
        F.regexp_extract("config", "([0-9]+)$", 1).cast("int").alias("config_id"),
        m.alias("m"),
        (m * n_attrs).alias("size"),
        F.col("body.quant_hash").alias("k"),
        F.col("body.tipo_hash").alias("hash"),
        F.col("body.tipo_bloom.nome").alias("encoding"),
        (slots / m).alias("rlb_share"),
        F.round(F.lit(1.0) - F.col("body.peso_erro.base"), 2).alias("error_share"),
    )


def to_configs(configs: DataFrame, n_attrs: int = 4, seed: int = 1991) -> list[LinkConfig]:
    """Validated configurations on the driver; a sweep file holds parameters, not data."""
    found = []
    for row in configs.collect():
        body, weights = row.body, row.body.peso_erro
        found.append(
            LinkConfig(
                config_id=int(row.config.removeprefix("config")),
                m=body.tamanho_BF,
                k=body.quant_hash,
                hash=body.tipo_hash,
                encoding=body.tipo_bloom.nome,
                n_attrs=n_attrs,
                rlb_share=body.porcent_rlb,
                weights=ErrorWeights(
                    groups=tuple(weights[k] for k in GROUP_KEYS),
                    suppress=tuple(weights[k] for k in SUPPRESS_KEYS),
                    words=tuple(weights[k] for k in WORD_KEYS),
                )
                if weights is not None
                else ErrorWeights(),
                seed=seed,
            )
        )
    return sorted(found, key=lambda c: c.config_id)
