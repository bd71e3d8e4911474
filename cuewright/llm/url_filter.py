"""URL allow and block lists: a trie over reversed host labels, then over path segments.

A rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's path.
Of all rules that fit, the longest host wins, then the longest path; what the winner says is the
verdict.  The trie is sent to the tasks in blocks of rules that take about ``block_bytes`` in a task.
A usual list is one block, and one pass without a shuffle; each further block is one more pass, which
replaces a URL's rule by a longer one, so a list of any length gives the same verdicts.  A common host
costs no more than any other.

Defined results: a null URL or one without ``://`` has an empty host and path and gets ``default``,
as does a URL that no rule fits; of equal rules the later replaces the earlier; repeated rows are
each judged; a null id is carried through; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: About what the rules of a block take in a task, and what the nodes of one rule take at most besides its text.
BLOCK_BYTES, NODE_BYTES = 128 << 20, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


class RuleTrie:
    """Host labels from the last to the first; each host's node holds a trie of path segments.

    The last segment of a rule may be the beginning of a URL's segment, so it is kept as a tail at
    the node of the segments before it.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self.hosts: dict = {}
        for rule in rules:
            node = self.hosts
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the path trie of this host
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[tail] = rule

    def match(self, host: str, path: str) -> Rule | None:
        segments = path.split("/")
        best = None
        node = self.hosts
        if None in node:
            best = self._path(node[None], segments)
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            if tails := node.get(None):
                fits = [t for t in tails if segment.startswith(t)]
                best = tails[max(fits, key=len)] if fits else best
            node = node.get(segment)
            if node is None:
                break
        return best


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_blocks(rules: list[Rule], block_bytes: int) -> Iterator[list[Rule]]:
    """Runs of rules of about ``block_bytes``; the later of equal rules alone counts."""
    block: list[Rule] = []
    size = 0
    for rule in {(r.host, r.path): r for r in rules}.values():
        own = NODE_BYTES + len(rule.host) + len(rule.path)
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append(rule)
        size += own
    yield block


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    nothing = F.lit(None).cast("string")
    found = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), nothing.alias("rule_host"), nothing.alias("rule_path"), nothing.alias("action"))
    names, schema = found.columns, f"id {found.schema['id'].dataType.simpleString()}, host string, path string, rule_host string, rule_path string, action string"

    def longest(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie: RuleTrie = shared.value
            for batch in batches:
                _, host, path, *before = (c.to_pylist() for c in batch.columns)
                best: list[tuple[str | None, str | None, str | None]] = []
                for h, p, *held in zip(host, path, *before, strict=True):
                    own = trie.match(h, p)
                    longer = own and (held[0] is None or (len(own.host), len(own.path)) > (len(held[0]), len(held[1])))
                    best.append((own.host, own.path, own.action) if longer else tuple(held))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([b[k] for b in best], pa.string()) for k in range(3))], names)

        return run

    for number, block in enumerate(rule_blocks(rules, block_bytes)):
        if number:  # one block at a time in the tasks
            found = stored(found, "urls")
        found = found.mapInArrow(longest(spark.sparkContext.broadcast(RuleTrie(block))), schema)
    return found.select(F.col("id").alias(id_col), "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("action", F.lit(default)).alias("verdict"))
