"""Merkle manifest of a dataset: a content-addressed store of digests and their children, and proofs by descent from the root.

Rows become leaves, ranked within their tree (one tree a language); every eight consecutive nodes have one parent, whose
digest covers theirs.  The store keeps digest -> children, a part per height.  A request for a leaf goes down
from the root by the base-8 digits of the leaf's rank, a join on the digest per level: the chosen child goes on, the others are a segment of
the proof.  Requests below one node go down together, so a level has at most as many rows as nodes.  The segments are read in reverse,
from the leaf up, to hash or to fold them.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.operators.ordering import row_rank
from quern.operators.skew import checked_broadcast

FANOUT = 8
# Fixed value: the fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<digit:int,siblings:array<string>>>"


def digest_of(*values: Column) -> Column:
    """SHA-256 in lower-case hex of the values, each ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    parts = []
    for value in values:
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest_of_run(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree; a single leaf is its own root."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FANOUT), height + 1
    return height


def _height(leaves: Column, most: int) -> Column:
    """``height_of`` for trees of at most ``most`` leaves."""
    found = F.lit(0)
    for height in range(height_of(most)):
        found = found + F.when(leaves > FANOUT**height, 1).otherwise(0)
    return found


@dataclass(frozen=True)
class Forest:
    """Trees of one kind: ``store[h]`` holds (digest, children) of the nodes of height h + 1, ``roots`` (tree, digest, height)."""

    store: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame, most: int) -> Forest:
    """The forest over leaves (tree, rank from 0, n leaves of the tree, digest); ``most`` is the largest n.

    Each level is written before the next, an eighth as large, so nothing is worked out twice.
    """
    total, store = F.col("n").alias("leaves"), []
    nodes = leaves.select("tree", "rank", "n", "digest", total)
    roots = nodes.where("n = 1").select("tree", "digest", "leaves")
    for height in range(height_of(most)):
        run = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        level = written(
            nodes.where("n > 1")
            .groupBy("tree", F.expr(f"rank div {FANOUT}").alias("node"))
            .agg(F.max("n").alias("below"), F.max("leaves").alias("leaves"), run.alias("children"))
            .withColumn("digest", _digest_of_run(F.col("children"))),
            f"merkle-{height + 1}",
        )
        # Equal subtrees have one address and one record.
        store.append(level.groupBy("digest").agg(F.first("children").alias("children")))
        count = F.ceil(F.col("below") / FANOUT).cast("long")
        nodes = level.select("tree", F.col("node").alias("rank"), count.alias("n"), "digest", "leaves")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest", "leaves"))
    return Forest(store, roots.select("tree", "digest", _height(F.col("leaves"), most).alias("height")))


def _segment(place: Column) -> Column:
    """The part of a way at one node: the digit taken and the children left aside."""
    siblings = F.concat(F.slice("children", F.lit(1), place), F.slice("children", place + 2, F.lit(FANOUT)))
    return F.array(F.struct(place.alias("digit"), siblings.alias("siblings")))


def _down(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The children of nodes, each with the way to it."""
    met = nodes.join(records, "digest").drop("digest")
    place = F.col("place")
    return met.select("*", F.posexplode("children").alias("place", "digest")).select(
        "tree", (F.col("node") * FANOUT + place).alias("node"), "digest", F.concat("path", _segment(place)).alias("path"), "subroot"
    )


def descend(forest: Forest, starts: DataFrame, requests: DataFrame, every: bool = False) -> DataFrame:
    """Requests (tree, rank, ..) of leaves with digest, path and subroot.

    ``starts`` are the roots with the path that leads to each.  Requests below one node go down as one; the last step meets them, so a
    way is shuffled once for eight leaves.  Going down, only nodes with a requested leaf below them are kept; ``every`` says that each has one.
    """
    asked, wanted = [], requests.select("tree", F.expr(f"rank div {FANOUT}").alias("node"))
    for _ in range(0 if every else len(forest.store) - 1):
        wanted = wanted.distinct()
        asked.append(wanted)
        wanted = wanted.select("tree", F.expr(f"node div {FANOUT}").alias("node"))
    at = starts.where(F.col("height") == len(forest.store)).drop("height")
    for height in range(len(forest.store) - 1, 0, -1):
        at = _down(at, forest.store[height])
        if not every:
            at = at.join(asked[height - 1], ["tree", "node"], "left_semi")
        at = at.unionByName(starts.where(F.col("height") == height).drop("height"))
    # A tree of one leaf ends at its root, which has no way on.
    ends = starts.where("height = 0").select("tree", "node", "path", "subroot", F.array("digest").alias("children"), F.lit(True).alias("ends"))
    if forest.store:
        last = at.join(forest.store[0], "digest").select("tree", "node", "path", "subroot", "children", F.lit(False).alias("ends"))
        ends = ends.unionByName(last)
    place = F.expr(f"cast(rank % {FANOUT} as int)")
    return (
        requests.withColumn("node", F.expr(f"rank div {FANOUT}"))
        .join(ends, ["tree", "node"])
        .withColumn("digest", F.get("children", place))
        .withColumn("path", F.when(F.col("ends"), F.col("path")).otherwise(F.concat("path", _segment(place))))
        .drop("node", "children", "ends")
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(F.reverse(path), lambda s: s["siblings"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(
        F.reverse(path),
        leaf,
        lambda found, s: F.sha2(
            F.concat(
                F.array_join(F.slice(s["siblings"], F.lit(1), s["digit"]), ""),
                found,
                F.array_join(F.slice(s["siblings"], s["digit"] + 1, F.lit(FANOUT)), ""),
            ),
            256,
        ),
    )


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, rank, n, doc_id, digest, seen); trees of languages below one tree of their roots, ranked in ``names``; ``root`` None if empty."""

    leaves: DataFrame
    trees: Forest
    top: Forest | None
    names: DataFrame | None
    root: str | None

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """Requests (tree, rank, ..), or all leaves, with digest, path and subroot; ``path`` leads from the root down."""
        every, asked = requests is None, self.names
        if every:
            requests = self.leaves.drop("digest")
        if self.root is None:
            return requests.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("path", _PATH), ("subroot", "string"))])
        if not every:
            asked = asked.join(requests.select(F.col("tree").alias("name")).distinct(), "name", "left_semi")
        ways = descend(self.top, _starts(self.top.roots, F.array().cast(_PATH)), asked, every).select(F.col("name").alias("tree"), "path")
        return descend(self.trees, _starts(self.trees.roots.join(ways, "tree"), F.col("path")), requests, every)


def _starts(roots: DataFrame, path: Column) -> DataFrame:
    node = F.lit(0).cast("long").alias("node")
    return roots.select("tree", node, "digest", path.alias("path"), F.col("digest").alias("subroot"), "height")


def tree_name(lang: Column) -> Column:
    """The tree of a language; names are ordered as languages are, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _ranked(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Leaves with rank and n, and the largest n."""
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    placed = row_rank(leaves, "rank", ["tree"], order).join(checked_broadcast(sizes), "tree")
    return placed.withColumn("rank", F.col("rank") - 1), most


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (lang, doc_id, digest, seen): rows of a language in order of doc_id, nulls first, then of the digest.

    ``seen`` is a digest as someone presents it, carried along.  Leaves are written once, with a number that tells equal rows apart.
    """
    numbered = leaves.select(
        tree_name(F.col("lang")).alias("tree"), "doc_id", "digest", "seen", F.monotonically_increasing_id().alias("row")
    )
    ranked, most = _ranked(written(numbered, "merkle-leaves"), ["doc_id", "digest", "row"])
    ranked = written(ranked.select("tree", "rank", "n", "doc_id", "digest", "seen"), "merkle-ranked")
    trees = build(ranked, most)
    trees = Forest(trees.store, written(trees.roots, "merkle-roots"))
    if not most:
        return Manifest(ranked, trees, None, None, None)
    names, langs = _ranked(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    names = written(names, "merkle-names")
    top = build(names, langs)
    return Manifest(ranked, trees, top, names.select("tree", "rank", "name"), top.roots.first()["digest"])


def document_leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, digest, seen) of ``documents`` rows.

    ``seen`` is the digest of the row as tampered with: where 3 divides the CRC-32 of the decimal doc_id, the text's A-Z are in lower case.
    """
    types = {"doc_id": "long", "n_chars": "long"}
    typed = docs.select(*[F.col(f).cast(types.get(f, "string")).alias(f) for f in FIELDS])
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    own = digest_of(*[F.col(f) for f in FIELDS])
    other = digest_of(*[F.col(f) for f in FIELDS[:-1]], lowered)
    return typed.select("lang", "doc_id", own.alias("digest"), F.when(marked, other).alias("seen")).withColumn(
        "seen", F.coalesce("seen", "digest")
    )


def verify_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every row is a leaf, rows that repeat another too; rows of one doc_id are in order of their digests.  A null doc_id comes before
    all others and is never tampered with; a null language is a tree of its own.  Other columns than the five of a leaf are not
    read.  An empty table gives no rows.
    """
    made = manifest(document_leaves(docs))
    return (
        made.proofs()
        .select(
            "doc_id",
            F.col("digest").alias("leaf"),
            "subroot",
            F.lit(made.root).cast("string").alias("root"),
            proof_digest(F.col("path")).alias("proof_sha256"),
            fold(F.col("seen"), F.col("path")).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


# Levels that the SQL has; 8^10 leaves are more than a table it is run on.
_SQL_LEVELS = 10


def _sql_tree(name: str, leaves: str, levels: int) -> str:
    """Steps ``{name}_0`` .. of nodes (tree, rank, n, digest), then ``{name}_root`` and ``{name}_path`` of each leaf.

    A leaf's path has the siblings, those before and those after it, as texts per level.
    """
    steps = [f"{name}_0 as (select tree, rank, count(*) over (partition by tree) as n, digest from {leaves})"]
    for i in range(levels):
        steps.append(
            f"{name}_{i + 1} as (select tree, rank // 8 as rank, (any_value(n) + 7) // 8 as n, sha256(string_agg(digest, '' order by rank)) as digest "
            f"from {name}_{i} where n > 1 group by tree, rank // 8)"
        )
    roots = " union all ".join(f"select tree, digest from {name}_{i} where n = 1" for i in range(levels + 1))
    steps.append(f"{name}_root as ({roots})")
    for i in range(levels):
        steps.append(
            f"{name}_s{i} as (select a.tree, a.rank, coalesce(string_agg(b.digest, '' order by b.rank) filter (b.rank < a.rank), '') as before, "
            f"coalesce(string_agg(b.digest, '' order by b.rank) filter (b.rank > a.rank), '') as after "
            f"from {name}_{i} a join {name}_{i} b on a.tree = b.tree and a.rank // 8 = b.rank // 8 where a.n > 1 group by 1, 2)"
        )
    return ", ".join(steps)


def _sql_path(name: str, levels: int, tree: str, rank: str) -> tuple[str, str]:
    """Joins that bring a leaf's siblings, as ``{name}p{i}``, and the text of all of them."""
    joins = " ".join(
        f"left join {name}_s{i} {name}p{i} on {name}p{i}.tree = {tree} and {name}p{i}.rank = {rank} // {8**i}" for i in range(levels)
    )
    text = " || ".join(f"coalesce({name}p{i}.before || {name}p{i}.after, '')" for i in range(levels))
    return joins, text


def _oracle() -> str:
    fields = " || ".join(
        f"coalesce(cast(strlen(cast({f} as varchar)) as varchar) || ':' || cast({f} as varchar), '-')" for f in FIELDS
    )
    lowered = fields.replace("cast(text as varchar)", f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
    crc = (
        "xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''), "
        "lambda c: [ascii(c)::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint]))), "
        "lambda c, b: xor(xor(c, b) >> 1, (case when xor(c, b) % 2 = 1 then 3988292384 else 0 end)::ubigint)), 4294967295::ubigint)"
    )
    tops = 4
    low_joins, low_text = _sql_path("t", _SQL_LEVELS, "l.tree", "l.rank")
    top_joins, top_text = _sql_path("u", tops, "''", "m.rank")
    parts = [f"tp{i}" for i in range(_SQL_LEVELS)] + [f"up{i}" for i in range(tops)]
    steps = [
        f"""l as (select doc_id, coalesce('=' || lang, '') as tree, sha256({fields}) as digest,
            case when {crc} % 3 = 0 then sha256({lowered}) else sha256({fields}) end as seen,
            row_number() over (partition by coalesce('=' || lang, '') order by doc_id nulls first, sha256({fields})) - 1 as rank
            from documents)""",
        _sql_tree("t", "l", _SQL_LEVELS),
        "m as (select tree as lang, '' as tree, row_number() over (order by tree) - 1 as rank, digest from t_root)",
        _sql_tree("u", "m", tops),
        f"""found as (select l.doc_id, l.digest as leaf, m.digest as subroot, (select digest from u_root) as root,
            sha256({low_text} || {top_text}) as proof_sha256, l.seen as f0,
            {', '.join(f'{p}.before as b{i}, {p}.after as a{i}' for i, p in enumerate(parts))}
            from l join m on m.lang = l.tree {low_joins} {top_joins})""",
    ]
    for i in range(_SQL_LEVELS + tops):
        source = "found" if not i else f"fold{i}"
        steps.append(
            f"fold{i + 1} as (select * replace (case when b{i} is null then f0 else sha256(b{i} || f0 || a{i}) end as f0) from {source})"
        )
    return (
        f"with {', '.join(steps)} select doc_id, leaf, subroot, root, proof_sha256, f0 as folded_root, f0 = root as verified "
        f"from fold{_SQL_LEVELS + tops}"
    )


ORACLE = _oracle()
