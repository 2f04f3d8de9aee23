"""Sources by name: a reader makes a raw frame, an importer maps it to the target schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfuse.functions.text import cleaned_name
from regfuse.plans.predicates import compile_query
from regfuse.schema import COLUMNS, MAIN_QUERY, conform


@dataclass
class Source:
    """How a register becomes the common schema.

    ``rename`` maps raw to target columns; ``assign`` holds expressions over the raw ones; ``maps`` replaces values
    (null where a value has no entry) and ``replace`` too (the value stays where it has none); ``status`` keeps rows
    whose column has one of the values; ``query`` is applied at the end."""

    name: str
    rename: dict[str, str] = field(default_factory=dict)
    assign: dict[str, Column | str] = field(default_factory=dict)
    maps: dict[str, dict[str, str]] = field(default_factory=dict)
    replace: dict[str, dict[str, str]] = field(default_factory=dict)
    status: tuple[str, list[str]] | None = None
    drop_null: list[str] = field(default_factory=list)
    query: str | None = None
    prepare: Callable[..., DataFrame] | None = None
    clean_names: bool = True
    reliability: float = 1.0

    def load(self, *raw: DataFrame, countries: list[str] | None = None, fuels: list[str] | None = None, main_query: str | None = MAIN_QUERY) -> DataFrame:
        """The raw frames in the target schema, cleaned and filtered."""
        df = self.prepare(*raw) if self.prepare else raw[0]
        if self.status:
            df = df.filter(F.col(self.status[0]).isin(self.status[1]))
        df = df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in self.assign.items()}) if self.assign else df
        df = df.withColumnsRenamed({k: v for k, v in self.rename.items() if k in df.columns})
        for c, m in self.maps.items():
            df = df.withColumn(c, value_map(m, F.col(c)))
        for c, m in self.replace.items():
            df = df.withColumn(c, F.coalesce(value_map(m, F.col(c)), F.col(c)))
        df = conform(df)
        if self.drop_null:
            df = df.dropna(subset=self.drop_null)
        if self.clean_names:
            df = df.withColumn("Name", cleaned_name())
        return config_filter(df, countries, fuels, main_query).filter(compile_query(self.query))


def value_map(m: dict[str, str], c: Column) -> Column:
    """The entry of a value, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)


def config_filter(df: DataFrame, countries: list[str] | None = None, fuels: list[str] | None = None, main_query: str | None = MAIN_QUERY) -> DataFrame:
    """Rows of the wanted countries and fuels that fulfil the main query."""
    cond = compile_query(main_query)
    if countries:
        cond = cond & F.coalesce(F.col("Country").isin(countries), F.lit(False))
    if fuels:
        cond = cond & F.coalesce(F.col("Fueltype").isin(fuels), F.lit(False))
    return df.filter(cond)


_SOURCES: dict[str, Source] = {}


def register_source(source: Source) -> Source:
    """Makes a source known by its name; a later one of the same name replaces it."""
    _SOURCES[source.name.upper()] = source
    return source


def source(name: str) -> Source:
    from regfuse.sources import importers  # noqa: F401  registers the declared ones

    try:
        return _SOURCES[name.upper()]
    except KeyError:
        raise KeyError(f"no source {name!r}; known: {sorted(_SOURCES)}") from None


def sources() -> list[str]:
    return sorted(_SOURCES)


def external(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file already in the target schema."""
    return conform(spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {t}" for c, t in COLUMNS.items()), enforceSchema=False))
