"""Rule files from any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.kernels.beider_morse import RuleSet
from hearsay.kernels.daitch_mokotoff import DaitchMokotoff, built_in


def read_texts(spark: SparkSession, directory: str) -> dict[str, str]:
    """Texts of a directory's .txt files by name without ending. Rule files are small and few."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(directory)
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    # the reader leaves empty files out
    out = {n.removesuffix(".txt"): "" for n in (f.getPath().getName() for f in listed) if n.endswith(".txt")}
    return out | {r.path.rpartition("/")[2].removesuffix(".txt"): bytes(r.content).decode("utf-8") for r in files.select("path", "content").collect()}


def read_beider_morse(spark: SparkSession, directory: str, detect: bool = True) -> RuleSet:
    return RuleSet.parse(read_texts(spark, directory), detect)


def read_daitch_mokotoff(spark: SparkSession, path: str, ascii_folding: bool = True) -> DaitchMokotoff:
    file = spark.read.format("binaryFile").load(path).select("content").first()
    return DaitchMokotoff.parse(bytes(file.content).decode("utf-8"), ascii_folding, path)


def daitch_mokotoff_rules(spark: SparkSession, rules: DaitchMokotoff | None = None) -> DataFrame:
    """(pattern, at_start, before_vowel, default)."""
    rows = [(r.pattern, *map(list, r.codes)) for bucket in (rules or built_in()).rules.values() for r in bucket]
    return spark.createDataFrame(rows, "pattern string, at_start array<string>, before_vowel array<string>, default array<string>")


def daitch_mokotoff_folding(spark: SparkSession, rules: DaitchMokotoff | None = None) -> DataFrame:
    return spark.createDataFrame([(chr(a), b) for a, b in (rules or built_in()).folding.items()], "from string, to string")


def beider_morse_rules(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """(name_type, rule_type, language, ord, pattern, left_ctx, right_ctx, phonemes)."""
    rows = []
    for (name_type, rule_type, language), buckets in rules.rules.items():
        for k, r in enumerate(r for bucket in buckets.values() for r in bucket):
            said = [(text, None if spoken is None else sorted(spoken)) for text, spoken in r.phonemes]
            rows.append((name_type, rule_type, language, k, r.pattern, r.left.text, r.right.text, said))
    return spark.createDataFrame(rows, "name_type string, rule_type string, language string, ord int, pattern string, left_ctx string, right_ctx string, phonemes array<struct<text: string, languages: array<string>>>")
