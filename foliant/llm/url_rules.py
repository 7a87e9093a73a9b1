"""URL filters: one broadcast trie over reversed host labels and path segments.

A rule names a host and the beginning of a path. It fits the host itself and all its subdomains,
if the URL's path starts with the rule's path. Of all rules that fit, the one with the most host
labels wins, then the one with the longest path, then blocking.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import Sent

# Rules are stated by people or come as a list of this many at most; the broadcast is bounded.
MOST_RULES = 1_000_000


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(raw, capital, small), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _path_node() -> dict:
    return {"next": {}, "ends": {}, "sizes": set()}


class Trie:
    """Rules by host label from the right, then by path segment from the left.

    A host node is a dict of labels; under the key ``None`` stands its path node. A path node has
    ``next`` for whole segments and ``ends`` for rules: the last, perhaps unfinished, segment of
    a rule with its verdict; ``sizes`` are the lengths these have.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not: {verdict}")
            if n == MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, _path_node())
            *whole, last = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, _path_node())
            if node["ends"].get(last, ("", ""))[1] != "block":
                node["ends"][last] = (host + path, verdict)
                node["sizes"].add(len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, starts = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                starts.append(node[None])
        segments = path.split("/")
        for start in reversed(starts):
            best, node = None, start
            for segment in segments:
                # The longest beginning of this segment that ends a rule.
                for n in sorted(node["sizes"], reverse=True):
                    if n <= len(segment) and segment[:n] in node["ends"]:
                        best = node["ends"][segment[:n]]
                        break
                node = node["next"].get(segment)
                if node is None:
                    break
            if best:
                return best
        return None


def judge(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", url: str = "url"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` are (allow or block, host, path). ``rule`` is the winner's host and path, or NULL;
    ``verdict`` is the winner's, or ``default`` where no rule fits. A NULL url, and one without
    ``://``, has an empty host and path, and so no rule. Columns of these four names are
    replaced, all others stay. Rows are judged one by one: no shuffle, repeated rows repeat.
    """
    added = ("host", "path", "rule", "verdict")
    trie = Sent(pages.sparkSession, Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in parts:
            found = [find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    kept = [c for c in pages.columns if c.lower() not in added]
    judged = pages.select(
        *kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("_judged", match("host", "path"))
    return judged.select(*kept, "host", "path", "_judged.rule", "_judged.verdict")
