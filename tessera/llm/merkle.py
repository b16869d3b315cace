"""Operator 13: a Merkle manifest of a dataset, by a nested-struct rollup.

A row's leaf is the SHA-256 of its fields. Per source, the leaves in order of
their id form a tree of 16-ary nodes whose top is the source's subroot; the
subroots in order of the source form the tree of the root.

A leaf's rank, written in base 16, is its way through the tree. Runs of
16**DIGITS ranks are blocks. Inside a block the digit columns are grouped away
from the last to the first, each step nesting the nodes of the step before as
child structs, so a block ends as one row that holds its whole subtree. A
transform over that row and an explode give every leaf its proof without a
join. The blocks' hashes are the leaves of the next tier, rolled up the same
way until one is left; a tier's proofs reach the tier below on its block rows
(one for 4,096 leaves).

A level is made while more than one node remains, so a node on a level that
its source doesn't need passes its only child's hash on.

Defined cases: null fields are written as ``-``; a null source is a source
of its own and the first; null ids come first; rows that repeat an id are
ordered by their leaf, equal rows are leaves of their own; a null id is never
tampered with; an empty table gives an empty result; other columns
are never read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import order_key, ranked
from .util import materialize, remainder

FANOUT = 16
DIGITS = 3                          # digits of a rank inside a block: 4,096 leaves
BLOCK = FANOUT ** DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def encoded(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(fields: list[Column]) -> Column:
    return sha(F.concat(*[encoded(c) for c in fields]))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def rollup(entries: DataFrame, payload: list[str]) -> DataFrame:
    """(_g, _n, _block, hash, kids) per block of the entries (_g, _rank, _n, hash, payload)."""
    digits = [f"_d{i}" for i in range(DIGITS)]
    nodes = entries.select("_g", "_n", F.floor(F.col("_rank") / BLOCK).cast("long").alias("_block"), "hash", *payload,
                           *[F.floor(F.col("_rank") / FANOUT ** i % FANOUT).cast("int").alias(d) for i, d in enumerate(digits)])
    nodes = nodes.repartition("_g", "_block")           # all groupings below keep to this partitioning
    held = payload
    for i, digit in enumerate(digits):
        nodes = (nodes.groupBy("_g", "_n", "_block", *digits[i + 1:])
                      .agg(F.sort_array(F.collect_list(F.struct(digit, "hash", *held))).alias("kids")))
        made = F.col("_n") > FANOUT ** i                # else the only child passes through
        nodes = nodes.withColumn("hash", F.when(made, sha(_joined(F.col("kids.hash")))).otherwise(F.col("kids")[0]["hash"]))
        held = ["kids"]
    return nodes


def _around(kids: Column, at: Column) -> Column:
    """The siblings of the child at place ``at``: (left, right), each concatenated."""
    hashes = kids["hash"]
    return F.struct(_joined(F.slice(hashes, F.lit(1), at)).alias("left"), _joined(F.slice(hashes, at + 2, F.lit(FANOUT))).alias("right"))


def proofs(blocks: DataFrame, payload: list[str], above: list[str]) -> DataFrame:
    """One row per entry of the blocks: _g, _block, digits, hash, payload, ``above`` and its
    ``path`` inside the block, an array of (left, right) from the lowest made level up."""
    def descend(kids: Column, level: int, outer: list[Column]) -> Column:
        def child(node: Column, at: Column) -> Column:
            here = F.when(F.col("_n") > FANOUT ** level, F.array(_around(kids, at))).otherwise(F.array())
            way = [here, *outer]
            if level:
                return descend(node["kids"], level - 1, way)
            return F.array(F.struct(*[node[c].alias(c) for c in payload], node["hash"].alias("hash"),
                                    node["_d0"].alias("_d0"), F.concat(*way).alias("path")))
        return F.flatten(F.transform(kids, child))

    return blocks.select("_g", "_block", *above, F.explode(descend(F.col("kids"), DIGITS - 1, [])).alias("_e")) \
                 .select("_g", "_block", *above, "_e.*")


def climb(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (_g, _rank, path) of the entries (_g, _rank, _n, hash) up to the top of their group, and the tops (_g, hash)."""
    # the path of a single entry is empty; the tier above exists only while a group has several entries
    most = entries.agg(F.max("_n")).first()[0] or 0
    if most <= 1:
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        return entries.select("_g", "_rank", nothing.alias("path")), entries.select("_g", "hash")
    own = entries.withColumn("_own", F.col("_rank"))
    blocks = materialize(rollup(own, ["_own"]))
    upper, tops = climb(_tops(blocks))
    met = blocks.join(upper.select("_g", F.col("_rank").alias("_block"), F.col("path").alias("_up")), ["_g", "_block"])
    paths = proofs(met, ["_own"], ["_up"]).select("_g", F.col("_own").alias("_rank"), F.concat("path", "_up").alias("path"))
    return materialize(paths), tops


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("_g", F.col("_block").alias("_rank"), F.ceil(F.col("_n") / BLOCK).cast("long").alias("_n"), "hash")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, p: sha(F.concat(p["left"], node, p["right"])))


def proof_digest(path: Column) -> Column:
    return sha(_joined(F.transform(path, lambda p: F.concat(p["left"], p["right"]))))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS,
             id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """Per row: ``id_col``, leaf, subroot, root and path (its siblings from the lowest level
    to the root), and ``checked``, the leaf as read again: of the row with ``tampered``
    in place of its last field (unchanged without it)."""
    cols = [F.col(f"`{c}`") for c in fields]
    again = leaf_hash([*cols[:-1], cols[-1] if tampered is None else tampered])
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), order_key(f"`{group_col}`").alias("_g"), leaf_hash(cols).alias("hash"),
                       (F.lit(None).cast("string") if tampered is None else again).alias("checked"))
    leaves = ranked(rows, "_g", ["_id", "hash"])
    blocks = materialize(rollup(leaves, ["_id", "checked"]))
    inside, subroots = climb(_tops(blocks))
    sources = ranked(subroots.withColumn("_all", F.lit("")), "_all", ["_g"])
    across, root = climb(sources.select(F.col("_all").alias("_g"), "_rank", "_n", "hash"))
    ends = sources.join(across.select("_rank", F.col("path").alias("_far")), "_rank") \
        .select("_g", F.col("hash").alias("subroot"), "_far", F.col("_all"))
    ends = ends.join(root.select(F.col("_g").alias("_all"), F.col("hash").alias("root")), "_all").drop("_all")
    above = inside.join(ends, "_g").select("_g", F.col("_rank").alias("_block"), "subroot", "root", F.concat("path", "_far").alias("_up"))
    leaves = proofs(blocks.join(above, ["_g", "_block"]), ["_id", "checked"], ["subroot", "root", "_up"])
    return leaves.select(F.col("_id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root",
                         F.concat("path", "_up").alias("path"), F.coalesce("checked", "hash").alias("checked"))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` tested against tampering: where 5 divides the id's crc32,
    the text's A-Z are lower-cased before its leaf is folded with the original siblings."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    text = F.when(remainder("doc_id", 5) == 0, lowered).otherwise(F.col("text"))
    rows = manifest(docs, tampered=text)
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       fold(F.col("checked"), F.col("path")).alias("folded_root")) \
               .withColumn("verified", F.col("folded_root") == F.col("root"))
