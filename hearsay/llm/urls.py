"""Verdicts on URLs: rules first, then naive Bayes on segmented hosts.

A rule names a host and the start of a path; it fits that host and its subdomains, and the longest rule that
fits decides. Where none does, the host's names are split into words by the most probable unigram segmentation
(Viterbi), and a multinomial naive Bayes model scores the words of host and path.

The unigram counts are those of all words in all pages' text, exact, in a table that grows with the words. Each
distinct host's substrings of lengths that words have are looked up in it by a join, and the host is split with
what they found. The model learns from ``labels`` (url, blocked) if they are given, else from the URLs that rules decide, with the host and
the path's start that the rule names taken away, so that it can't learn the rule itself. Examples of a fifth of the hosts, by
hash, are never learnt from; ``held_out_accuracy`` measures on them. Each word has its own counts, in a table
that is joined to the words of the URLs.

Defined cases: a URL that is null or has no "://" has an empty host and path, no rule, and the verdict of
the class priors alone, as have all without examples of either class; a null html adds no words; a null page_id and repeated rows each
come out; labels without a URL or a class, and rows of words of no example, count nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import table, written

#: (rule, verdict): host, then the path's start.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Added to the count of each word that there is, in either class.
SMOOTHING = 0.5
#: Log odds of block above which the method blocks: nine to one, as a wrongly blocked page is lost.
BLOCK_AT = log(9)
#: One host in so many is held out.
FOLDS = 5
#: Words, or substrings, that a task holds before it hands them on.
HELD = 1 << 16

_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"<(script|style)\b")
_TAG = re.compile(r"<[^<>]*>")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), empty), F.coalesce(path, empty)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column, Column, Column]:
    """The longest rule that fits, its verdict, null if none does; and host and path without what the rule names, the host without its last name if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    rest_host, rest_path = F.regexp_replace(host, r"\.[^.]*\z", ""), path
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
        rest_host = F.when(fits, F.substring(host, F.lit(1), F.greatest(F.lit(0), F.length(host) - len(name) - 1))).otherwise(rest_host)
        rest_path = F.when(fits, F.substring(path, len(slash + start) + 1, 2**30)).otherwise(rest_path)
    return rule, verdict, rest_host, rest_path


@dataclass(frozen=True)
class WordCounts:
    """Exact counts of at least those words that the names to be split hold, and of all words together."""

    counts: dict[str, int]
    total: int

    def cost(self, word: str) -> float:
        """Minus the log probability; an unknown word's falls by a factor of 10 for each letter, and is below that of any known one."""
        n = self.counts.get(word, 0)
        return -log(n / (self.total + 1)) if n else log(self.total + 2) + 2.3 * len(word)

    def segment(self, name: str) -> list[str]:
        """The most probable split of a name of letters; of equally probable ones that with the longest last word.

        Known words are looked up by the lengths there are. An unknown word's cost grows evenly with its letters, so
        the best one that ends at a letter begins where the one before it did, or at that letter.
        """
        sizes, best, run = sorted({len(w) for w in self.counts}, reverse=True), [(0.0, 0)], 0
        unknown = log(self.total + 2)
        for end in range(1, len(name) + 1):
            run = min((run, end - 1), key=lambda k: best[k][0] + unknown + 2.3 * (end - k))
            found = [(best[run][0] + unknown + 2.3 * (end - run), run)]
            found += [(best[end - n][0] + self.cost(w), end - n) for n in sizes if n <= end and (w := name[end - n : end]) in self.counts]
            best.append(min(found))
        words, end = [], len(name)
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        return words[::-1]


def host_words(host: str, unigrams: WordCounts) -> list[str]:
    """Words of a host's names; numbers are all alike."""
    return [w for t in _TOKEN.findall(host) for w in (unigrams.segment(t) if t[0].isalpha() else ["#"])]


def path_words(path: str) -> list[str]:
    """Words of a path; numbers are all alike."""
    return ["/" + (t if t[0].isalpha() else "#") for t in _TOKEN.findall(path.lower())]


def visible(html: str) -> str:
    """Lower-cased text of html without scripts, styles and tags, in one pass."""
    html, out, at = html.lower(), [], 0
    while at < len(html) and (m := _HIDDEN.search(html, at)):
        out.append(html[at : m.start()])
        end = html.find(f"</{m[1]}", m.end())
        at = end if end >= 0 else len(html)
    return _TAG.sub(" ", " ".join([*out, html[at:]]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for x in batch.column(0):
            seen.update(_WORD.findall(visible(x.as_py() or "")))
            if len(seen) >= HELD:
                yield out()
                seen.clear()
    yield out()


def unigrams_of(pages: DataFrame) -> DataFrame:
    """(word, n): counts of the words of ASCII letters in the text of every page's html."""
    found = pages.select("html").mapInArrow(_texts, "word string, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")), "unigrams")[0]


def _substrings(sizes: list[int]):
    """(id, host) to (id, word): what may be a word of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        words: list[str] = []
        for batch in batches:
            for k, host in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = [t for t in _TOKEN.findall(host.as_py()) if t[0].isalpha()]
                own = {t[a : a + n] for t in names for n in sizes if n <= len(t) for a in range(len(t) - n + 1)}
                words += own
                ids += [k] * len(own)
                if len(ids) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])
                    ids, words = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])

    return run


def split_hosts(hosts: DataFrame, unigrams: DataFrame) -> DataFrame:
    """hosts (rest_host), unigrams (word, n): (rest_host, host_words) of every distinct host."""
    # the lengths of words are few; words themselves stay where they are
    sizes = unigrams.groupBy(F.length("word").alias("size")).agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in sizes)
    own, _ = written(hosts.select("rest_host").distinct().select(F.monotonically_increasing_id().alias("id"), "rest_host"), "hosts")
    parts = own.mapInArrow(_substrings(sorted(r.size for r in sizes)), "id long, word string")
    known = parts.join(unigrams, "word").groupBy("id").agg(F.collect_list("word").alias("word"), F.collect_list("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            words = [host_words(h, WordCounts(dict(zip(w or (), n or ())), total)) for h, w, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["rest_host", "host_words"])

    split = own.join(known, "id", "left").select("rest_host", "word", "n").mapInArrow(run, "rest_host string, host_words array<string>")
    return written(split, "host_words")[0]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("rest_path")
        words = pa.array([path_words(p.as_py()) for p in batch.column(at)], pa.list_(pa.string()))
        yield batch.set_column(at, "path_words", words)


URL = "page_id long, host string, path string, rule string, said string, rest_host string, {} {}, blocked boolean, held_out boolean, is_page boolean"


def _urls(rows: DataFrame, rules, blocked: Column | None) -> DataFrame:
    """rows (page_id, url): what rules say of each URL, and its class as an example; blocked: of given examples."""
    host, path = host_and_path(F.col("url"))
    split = rows.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), "*" if blocked is not None else F.lit(0).alias("_"))
    rule, said, rest_host, rest_path = rule_of(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0
    return split.select(split["page_id"] if blocked is None else F.lit(None).cast("long").alias("page_id"), "host", "path", rule.alias("rule"), said.alias("said"), rest_host.alias("rest_host"), rest_path.alias("rest_path"), (said == "block" if blocked is None else blocked).alias("blocked"), held.alias("held_out"), F.lit(blocked is None).alias("is_page"))


def url_words(urls: DataFrame, unigrams: DataFrame) -> DataFrame:
    """urls of ``URL`` with rest_path: a row for each, numbered, with the words of its host and path."""
    paths = urls.mapInArrow(_paths, URL.format("path_words", "array<string>"))
    words = paths.join(split_hosts(urls, unigrams), "rest_host").withColumn("words", F.concat("host_words", "path_words")).drop("rest_host", "host_words", "path_words")
    return written(words.select(F.monotonically_increasing_id().alias("row"), "*"), "url_words")[0]


def train(urls: DataFrame) -> tuple[DataFrame, float]:
    """urls (words, blocked, held_out): (word, weight), the log odds of block for each word of an example, and the log odds of the classes."""
    examples = urls.where("blocked is not null and not held_out")
    found = examples.select(F.explode("words").alias("word"), "blocked").groupBy("word").agg(F.count_if(~F.col("blocked")).alias("allow"), F.count_if("blocked").alias("block"))
    counts, _ = written(found, "word_classes")
    known, allow, block = counts.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    urls_allow, urls_block = examples.agg(F.count_if(~F.col("blocked")), F.count_if("blocked")).first()
    more = SMOOTHING * known
    weight = F.log((F.col("block") + SMOOTHING) / (block + more + 1e-9)) - F.log((F.col("allow") + SMOOTHING) / (allow + more + 1e-9))
    # without examples of both classes nothing speaks for either
    return counts.where(F.lit(bool(urls_allow and urls_block))).select("word", weight.alias("weight")), log((urls_block + 1) / (urls_allow + 1)) if urls_allow and urls_block else 0.0


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html), labels (url, blocked): (page_id, host, path, rule, verdict, words, score, blocked, held_out), a row for each page.

    blocked is the page's class as an example, null if it is none.
    """
    urls = _urls(pages.select("page_id", "url"), rules, None)
    if labels is not None:
        given = labels.where("url is not null and blocked is not null").select(F.lit(None).cast("long").alias("page_id"), "url", F.col("blocked").cast("boolean"))
        urls = urls.withColumn("blocked", F.lit(None).cast("boolean")).union(_urls(given, (), F.col("blocked")))
    rows = url_words(urls, unigrams_of(pages))
    weights, prior = train(rows)
    # sorted, so that the sum doesn't depend on the order of rows
    total = F.aggregate(F.sort_array(F.collect_list("weight")), F.lit(0.0), lambda x, y: x + y)
    own = rows.where("is_page")
    sums = own.select("row", F.explode("words").alias("word")).join(weights, "word").groupBy("row").agg(total.alias("sum"))
    scored = own.join(sums, "row", "left").withColumn("score", F.lit(prior) + F.coalesce("sum", F.lit(0.0)))
    verdict = F.coalesce("said", F.when(F.col("score") > BLOCK_AT, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "score", "blocked", "held_out")


def held_out_accuracy(found: DataFrame) -> tuple[float, int]:
    """Share of the held-out examples in what ``judged`` returned whose score is on their class's side, and their number."""
    n, right = found.where("held_out and blocked is not null").agg(F.count("*"), F.count_if((F.col("score") > 0) == F.col("blocked"))).first()
    return (right / n if n else 0.0), n


def query(spark, sf_dir: str) -> DataFrame:
    """op10: verdict on every page's URL."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("blocked")
