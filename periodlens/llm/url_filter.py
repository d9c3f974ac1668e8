"""URL filters: a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits its host, all subdomains, and the paths that
start with its path. Of the rules that fit, the one with most host labels wins,
then the one with the longest path, then ``allow`` over ``block``.

Defined cases: null urls and urls without ``://`` have empty host and path; a
url that no rule fits gets ``default``; repeated rules count once; an empty
table gives an empty result; other columns pass through unless asked for.

Scale: rules are given by the caller as a list, and their size is known from it: a trie
estimated at ``max_bytes`` or less goes to every task, and urls are not shuffled. Larger
lists take the keyed way, with the same result: a url's host suffixes are joined with the
rules' hosts and the same order picks the winner."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import schema_of

Rule = tuple[str, str, str]  # host, path, verdict
MAX_BYTES = 64 << 20  # of a trie that is broadcast
NODE_BYTES = 240  # of a dict with its key, about


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nodes are dicts: label or segment to child; key None holds the host's path
    trie, and a path node's key 0 maps the rest of a rule's path (its unfinished
    last segment) to (rule text, verdict)."""
    trie: dict = {}
    for host, path, verdict in sorted(rules, key=lambda r: r[2], reverse=True):  # allow last
        node = trie
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        node.setdefault(0, {})[last] = (host + path, verdict)
    return trie


def trie_bytes(rules: Iterable[Rule]) -> int:
    """An upper estimate: a node for every label and segment of every rule, and its text."""
    return sum(NODE_BYTES * (host.count(".") + path.count("/") + 3)
               + 2 * len((host + path).encode()) for host, path, _ in rules)


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The winning rule of the deepest host node at which any path rule fits."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = _longest_path(node[None], path) or best if None in node else best
    return best


def _longest_path(node: dict, path: str) -> tuple[str, str] | None:
    best, segments = None, path.split("/")
    for k, segment in enumerate(segments):
        ends = node.get(0)
        if ends:
            for size in range(len(segment), -1, -1):
                if segment[:size] in ends:
                    best = ends[segment[:size]]
                    break
        # A finished segment needs the slash after it.
        node = node.get(segment) if k < len(segments) - 1 else None
        if node is None:
            break
    return best


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow",
               url: str = "url", keep: tuple[str, ...] = ("page_id",),
               max_bytes: int = MAX_BYTES) -> DataFrame:
    """``keep`` columns, host, path, rule (null: none fits) and verdict of every row."""
    rules = sorted(set(rules))
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"))
    if trie_bytes(rules) > max_bytes:
        return _judge_by_join(parts, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    schema = schema_of(parts, "rule string, verdict string")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [longest_match(trie.value, h, p) for h, p in
                    zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([h and h[0] for h in hits], pa.string()),
                 pa.array([h[1] if h else default for h in hits], pa.string())],
                names=[*b.schema.names, "rule", "verdict"])

    return parts.mapInArrow(match, schema)


def _judge_by_join(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts for rule lists of any length: an equality join on host
    suffixes. Rules come in slices from the driver's list, as it was given."""
    spark = parts.sparkSession
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    table = table.withColumn("rule_host", F.lower("rule_host"))
    table = table.withColumn("rule", F.concat("rule_host", "rule_path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    urls = parts.select("host", "path").distinct()
    won = (urls.withColumn("rule_host", F.explode(suffixes))
           .join(table, "rule_host")
           .where(F.expr("startswith(path, rule_path)"))
           .groupBy("host", "path")
           .agg(F.max(F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"),
                               (F.col("verdict") == "allow").alias("a"), "rule", "verdict"))
                .alias("w")))
    return (parts.join(won, ["host", "path"], "left")
            .select(*[c for c in parts.columns],
                    F.col("w.rule").alias("rule"),
                    F.coalesce("w.verdict", F.lit(default)).alias("verdict")))
