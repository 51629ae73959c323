"""Allow and block lists over URLs: a trie over reversed host labels, then path segments."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


@dataclass
class Node:
    """A place in the trie: a host label on the upper levels, a path segment below them."""

    labels: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    segments: dict[str, Node] = field(default_factory=dict)
    partial: dict[str, tuple] = field(default_factory=dict)  # rules that end within a segment
    rule: tuple | None = None


def segments(path: str) -> list[str]:
    """The path cut after each slash."""
    return [s for s in path.replace("/", "/\n").split("\n") if s]


def build_trie(rules: list[tuple[str, str, str]]) -> Node:
    """Rules are (action, host, path).  Of equal rules with both actions, block holds."""
    root = Node()
    for action, host, path in sorted(rules):  # allow comes before block
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        node.paths = at = node.paths or Node()
        rule = (len(host) + len(path), len(host), action, host + path)
        for segment in segments(path):
            if not segment.endswith("/"):
                at.partial[segment] = rule
                break
            at = at.segments.setdefault(segment, Node())
        else:
            at.rule = rule
    return root


def _longest_path(node: Node, path: str) -> tuple | None:
    best, rest = node.rule, path
    while True:
        found = [node.partial[rest[:n]] for n in {len(p) for p in node.partial} if rest[:n] in node.partial]
        best = max([best, *found], key=lambda r: r or (-1,))
        cut = rest.find("/") + 1
        node = node.segments.get(rest[:cut]) if cut else None
        if node is None:
            return best
        best, rest = max(best, node.rule, key=lambda r: r or (-1,)), rest[cut:]


def longest_rule(root: Node, host: str, path: str) -> tuple | None:
    """The longest rule (host and path together; then the longer host) that fits, or None."""
    node, best = root, None
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.paths is not None:
            best = max(best, _longest_path(node.paths, path), key=lambda r: r or (-1,))
    return best


def _by_trie(parts: DataFrame, rules: DataFrame) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(build_trie([tuple(r) for r in rules.collect()]))

    @F.pandas_udf("rule string, action string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [longest_rule(trie.value, h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [r and r[3] for r in found], "action": [r and r[2] for r in found]}, dtype=object)

    return parts.withColumn("found", judge("host", "path")).select("id", "host", "path", "found.rule", "found.action")


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same answer for rule tables of any size: each URL looks up its host suffixes and path
    prefixes of the lengths that occur among rules (read by the driver: at most one number per
    character of the longest path)."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    numbered = parts.withColumn("row", F.monotonically_increasing_id())
    looked = (
        numbered.withColumn("rule_host", F.explode(suffixes))
        .withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where(F.col("n") <= F.length("path"))
        .withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
        .select("row", "rule_host", "rule_path")
    )
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    longest = F.struct(
        F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), "action",
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = looked.join(named, ["rule_host", "rule_path"]).groupBy("row").agg(F.max(longest).alias("best"))
    return numbered.join(best, "row", "left").select("id", "host", "path", "best.rule", "best.action")


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``.  A rule fits its host and
    all subdomains where the URL's path begins with the rule's; the longest rule decides,
    ``default`` where none fits.  A null URL or one without ``://`` has an empty host and path.
    Rules with a null or empty host are passed over.  The trie is broadcast if the rules'
    texts are at most ``max_broadcast_bytes`` long; larger rule tables are joined.
    """
    clean = (
        rules.where("host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("action").alias("action")).select("action", "host", "path")
    )
    parts = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    weight = clean.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    judged = _by_trie(parts, clean) if weight <= max_broadcast_bytes else _by_join(parts, clean)
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
