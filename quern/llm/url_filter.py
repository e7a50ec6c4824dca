"""URL filters: one trie over reversed host labels and path segments, sent to every task.

The rules are the filter's parameters; their size is checked before they are broadcast.  The longest
rule that fits decides, allow or block alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import on_arrow

# Rules are held by every task; more bytes than this are refused.
MAX_RULE_BYTES = 64 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))).decode("latin-1")


@dataclass(frozen=True)
class Rule:
    """A host, which stands for its subdomains too, and how the path of a url starts."""

    action: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError(f"action of a rule: {self.action}")

    @property
    def text(self) -> str:
        return self.host + self.path


PRODUCTION_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty for null or a url without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


class RuleTrie:
    """Nodes are dicts: host labels from the right, then path segments from the left.

    A rule's last segment may be part of a segment, so it lies beside the node as a prefix.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            # Of an allow and a block entry for the same place, the block holds.
            here = node.setdefault("prefixes", {})
            if last not in here or rule.action == "block":
                here[last] = rule
            node["longest"] = max(node.get("longest", 0), len(last))

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, counted in characters; of equally long ones the deeper host's."""
        node, best = self.root, self._path(self.root, path)
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            found = self._path(node, path)
            if found and (best is None or len(found.text) >= len(best.text)):
                best = found
        return best

    @staticmethod
    def _path(node: dict, path: str) -> Rule | None:
        best, at = None, 0
        while node is not None:
            prefixes = node.get("prefixes", {})
            if prefixes:
                for n in range(min(node["longest"], len(path) - at), -1, -1):
                    if (found := prefixes.get(path[at : at + n])) is not None:
                        best = found
                        break
            end = path.find("/", at)
            if end < 0:
                break
            node, at = node.get("segments", {}).get(path[at:end]), end + 1
        return best


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule] = PRODUCTION_RULES, id_column: str = "page_id", url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (the rule's, else ``default``) of every row.

    Null urls and urls without ``://`` have an empty host and path, which only a rule without host and path
    fits.  Repeated rows and null identifiers stay; an empty table gives no rows.
    """
    rules = tuple(rules)
    if sum(len(r.text) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"rules of over {MAX_RULE_BYTES} bytes are not broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RuleTrie(shared.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [trie.find(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r.text if r else None for r in found], pa.string()),
                    pa.array([r.action if r else default for r in found], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    source = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"))
    return on_arrow(source, run, "page_id long, host string, path string, rule string, verdict string")


def _oracle() -> str:
    rows = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in PRODUCTION_RULES)
    return rf"""
with rules(action, rhost, rpath) as (values {rows}),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
parts as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
hosts as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path
  from parts),
fits as (select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
    arg_max(action, length(rhost || rpath)) as action
  from hosts left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by all)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fits
"""


ORACLE = _oracle()
