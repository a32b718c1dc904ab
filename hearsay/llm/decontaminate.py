"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed, GRAM consecutive word hashes are hashed to a gram, and each window of WINDOW
consecutive words (that is WINDOW - GRAM + 1 grams) is represented by its least gram hash. Where that
minimum stays the same from one window to the next, only the first keeps it as a fingerprint, renewed
after so many windows as a single gram can be the minimum of. So every shared span of WINDOW words has a
fingerprint in both texts. Documents' fingerprints are joined with those of the benchmark; each hit is
extended over the windows it stands for, which are compared as text.

Items of fewer than WINDOW words are one window; their seed is the hash of their first word.

Defined cases: a null text has no words; a null item_id still makes its words hits and counts as no item;
repeated item rows count once; repeated document rows each come out; an empty benchmark hits nothing; the
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.common import table, written

WINDOW = 10
GRAM = 7
#: What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null: none."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.filter(F.split(plain, SEPARATORS), lambda w: w != ""), F.array().cast("array<string>"))


def fingerprints(texts: DataFrame, keys: list[str], context: bool) -> DataFrame:
    """texts: keys, words, hashes of the words. Rows (keys, print, at) and, with ``context``, the words of the windows that the fingerprint stands for."""
    span = WINDOW - GRAM + 1

    def gram(k: int) -> Column:
        return F.xxhash64(*(F.get("hashes", F.col("at") + (k + j)) for j in range(GRAM)))

    least = F.least(*(gram(k) for k in range(span)))
    before = F.least(*(gram(k) for k in range(-1, span - 1)))
    # outer: else Spark would work the array out once more to leave out empty ones
    rows = texts.select(*keys, "words", "hashes", F.posexplode_outer("hashes").alias("at", "_")).where(f"at <= size(hashes) - {WINDOW}")
    kept = rows.where((F.col("at") % span == 0) | (least != before))
    more = [F.slice("words", F.col("at") + 1, WINDOW + span - 1).alias("near")] if context else []
    return kept.select(*keys, least.alias("print"), "at", *more)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _text(words: Column | str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text): a row for every document row.

    (doc_id, n_words, n_hit, items: sorted array of the item_ids as strings).
    """
    item_words = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    size, width = F.size("words"), F.least(F.size("words"), F.lit(WINDOW))
    windows = (
        item_words.select("item_id", "words", size.alias("size"), width.alias("width"))
        .select("item_id", "words", "width", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("start"))
        .select("item_id", "width", _text("words", F.col("start"), F.col("width")).alias("window"))
        .distinct()
    )
    distinct_windows = windows.select("window", "width").distinct()
    item_hashes = item_words.where(size >= WINDOW).select("words", _hashed(F.col("words")).alias("hashes"))
    seeds = fingerprints(item_hashes, [], context=False).select("print").distinct()
    short = windows.where(F.col("width") < WINDOW).select(F.xxhash64(F.element_at(F.split("window", " "), 1)).alias("print"), "width").distinct()

    keys = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    hashed = texts.select(*keys, "words", _hashed(F.col("words")).alias("hashes"))
    span = WINDOW - GRAM + 1
    near = fingerprints(hashed, keys, context=True).join(seeds, "print")
    found = near.select(*keys, "at", "near", F.explode(F.sequence(F.lit(0), F.size("near") - WINDOW)).alias("shift")).select(
        *keys, (F.col("at") + F.col("shift")).alias("start"), F.lit(WINDOW).alias("width"), _text("near", F.col("shift") + 1, F.lit(WINDOW)).alias("window")
    )
    if not short.isEmpty():  # only then is every word a seed; a benchmark too large to broadcast would have all words shuffled for nothing
        every = hashed.select(*keys, "words", F.posexplode_outer("hashes").alias("start", "print")).where("print is not null")
        few = every.select(*keys, "start", "print", F.slice("words", F.col("start") + 1, WINDOW - 1).alias("near")).join(short, "print").where(F.size("near") >= F.col("width"))
        found = found.union(few.select(*keys, "start", "width", _text("near", F.lit(1), F.col("width")).alias("window")))
    # written, as the words hit and the items hit are both counted from it
    hits, _ = written(found.join(distinct_windows, ["window", "width"], "left_semi").distinct(), "hits")

    # words covered by the union of a text's hit windows: each adds what reaches beyond those before it
    reach = F.max(F.expr("start + width")).over(Window.partitionBy(*keys).orderBy("start", "width").rowsBetween(Window.unboundedPreceding, -1))
    added = F.expr("start + width") - F.greatest(F.col("start"), F.least(F.coalesce(reach, F.lit(0)), F.expr("start + width")))
    covered = hits.withColumn("added", added).groupBy(*keys).agg(F.sum("added").alias("n_hit"))
    named = hits.select(*keys, "window", "width").distinct().join(windows, ["window", "width"]).where("item_id is not null").select(*keys, F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
    k = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    result = covered.alias("a").join(listed.alias("b"), k, "left").select("a.*", "b.items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return (
        counted.alias("a")
        .join(result.alias("b"), k, "left")
        .select("a.doc_id", "a.n_words", F.coalesce("b.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("b.items", F.array().cast("array<string>")).alias("items"))
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item. A document is known by its doc_id; rows without one stay."""
    hit = contamination(docs, items).where("n_hit > 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: words of benchmark items in every document."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS width, array_to_string(words[s:s + least(len(words), 10) - 1], ' ') AS win
       FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - least(len(words), 10) + 1)) AS s FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, s, width, array_to_string(words[s:s + width - 1], ' ') AS win
       FROM (SELECT doc_id, words, width, unnest(generate_series(1, len(words) - width + 1)) AS s FROM w, (SELECT DISTINCT width FROM bw) WHERE len(words) >= width)),
hit AS (SELECT DISTINCT doc_id, s, bw.width, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + width - 1)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
