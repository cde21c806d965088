"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks that judge the urls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, unpacked

# What a rule list may hold: the trie is broadcast, about 300 bytes a rule.
MAX_RULES = 1_000_000
VERDICTS = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a '://'."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:stop]


class UrlTrie:
    """Rules by reversed host labels, below each host by whole path segments, and at the last segment by its beginning: of the
    beginnings of a segment only those are looked up whose length some rule of the place has."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(("paths",), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            # Of two entries for one place the block entry holds.
            ends = node.setdefault(("ends",), {})
            if ends.get(last, ("allow",))[0] != "block":
                ends[last] = (verdict, host + path)
        self._measure(self.root)

    @staticmethod
    def _measure(root: dict) -> None:
        """The lengths of the beginnings at each place, longest first."""
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if ("ends",) in node:
                node[("lengths",)] = sorted({len(e) for e in node[("ends",)]}, reverse=True)
            waiting += [v for k, v in node.items() if k == ("paths",) or isinstance(k, str)]

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The entry with the most host labels, then the longest path, that fits; None if none does."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if ("paths",) in node:
                found = self._path(node[("paths",)], path) or found
        return found

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        found = None
        for segment in path.split("/"):
            ends = node.get(("ends",))
            if ends:
                best = next((segment[:n] for n in node[("lengths",)] if n <= len(segment) and segment[:n] in ends), None)
                found = ends[best] if best is not None else found
            node = node.get(segment)
            if node is None:
                break
        return found


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Every row with host, path, rule and verdict. `rules` are (allow or block, host, path): a rule fits its host and all
    subdomains where the url's path starts with the rule's; the longest fitting rule wins, block before allow if both
    name the same place. Urls that no rule fits get `default` and a null rule.

    A null url or one without '://' has an empty host and path; urls of any length are judged whole; repeated rows are judged
    each; an empty table gives an empty result; columns named as a result's are replaced. More than MAX_RULES rules are refused, as the trie is broadcast.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(VERDICTS)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                verdict, rule = trie.value.longest(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    names = pages.columns
    rows = pages.select(F.struct(*[quoted(c).alias(c) for c in names]).alias("_row"), judged(quoted(url)).alias("_judged"))
    return unpacked(rows, names, {c: F.col("_judged").getField(c) for c in ("host", "path", "rule", "verdict")})
