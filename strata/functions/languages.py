"""Language detection, scannable filter and binary sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.paths import file_name, last_suffix


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def language_map_df(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    mapping = S.DEFAULT_LANGUAGE_MAP if mapping is None else mapping
    return spark.createDataFrame(sorted(mapping.items()), "ext string, map_language string")


def read_language_map(spark: SparkSession, path: str) -> DataFrame:
    """A suffix catalogue from CSV with a header (suffix, language); suffixes are lower-cased, the first row
    of a suffix in language order counts."""
    rows = spark.read.options(header=True, escape='"').csv(path)
    ext, language = rows.columns[:2]
    return rows.groupBy(F.lower(F.trim(ext)).alias("ext")).agg(F.min(F.trim(language)).alias("map_language"))


def detect_language(files: DataFrame, path_col: str = "path", out_col: str = "language",
                    language_map: DataFrame | None = None) -> DataFrame:
    """Dockerfile names, else lower-cased last suffix looked up in the map, else ``plaintext``.

    The default map is a literal table of some hundred rows, which the planner
    broadcasts by its size; a caller's map is joined as its own size suggests.
    """
    spark = files.sparkSession
    lm = language_map if language_map is not None else language_map_df(spark)
    lm = lm.select(F.col(lm.columns[0]).alias("_ext"), F.col(lm.columns[1]).alias("_lang"))
    name = F.lower(file_name(path_col))
    keyed = files.withColumn("_ext", last_suffix(file_name(path_col)))
    joined = keyed.join(lm, "_ext", "left")
    lang = (F.when(name.isin(*S.DOCKERFILE_NAMES), F.lit("dockerfile"))
            .otherwise(F.coalesce(F.col("_lang"), F.lit("plaintext"))))
    cols = [c for c in files.columns if c != out_col]
    return joined.select(*cols, lang.alias(out_col))


def is_scannable(language) -> Column:
    return _c(language).isin(*S.SCANNABLE_LANGUAGES)


def scannable_filter(files: DataFrame, extra_languages=()) -> DataFrame:
    langs = list(S.SCANNABLE_LANGUAGES) + list(extra_languages)
    return files.filter(F.col("language").isin(*langs))


def is_binary(content) -> Column:
    """NUL byte within the first 512 bytes (of the text's UTF-8)."""
    # position in bytes of the first NUL: what stands before it, encoded
    before = F.substring_index(_c(content), "\u0000", 1)
    return _c(content).contains("\u0000") & (F.octet_length(before) < 512)
