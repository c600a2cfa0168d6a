"""Merkle manifest of a dataset: leaf digests, subtree roots a group, one root, and a witness for every leaf.

Method: nodes of a group are appended in order to blocks of 2^K aligned positions. Within a block the open subtrees
form a stack; each carries the leaves below it with their partial witnesses, and when a subtree gets its right sibling
the digests of both are added to the witnesses on the other side. Roots of completed blocks are in their turn nodes
appended one level up, so a block is the most that one task holds; ``finish`` closes the blocks that are still open.
``append`` adds later rows to a manifest and reads again only its open blocks, 2^K - 1 nodes of a group and level at
most.

A digest is the lowercase hex sha256 of the digests below it, one or two, as text. A witness is packed binary: for each
level a byte (0 no sibling, 1 sibling on the left, 2 on the right) and its 32 bytes.

Edge cases: null values count as ``-``; null groups and null ids come first; rows that tie in group and id are ordered
by their digest, so repeated rows are leaves of their own; very long texts are hashed whole; an empty table gives no
rows; only the columns named are read, whatever the others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BIN, INT, STR, Scratch, hot_join, schema

#: Logarithm of the nodes of a block.
K = 10
STEP = 33


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and its text; null as a dash."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def grow(digests: list[str], height: int = 0) -> tuple[list[bytearray], str]:
    """Partial witnesses of consecutive nodes of one block, and its root, lifted to the height at least."""
    wits = [bytearray() for _ in digests]
    stack: list[tuple[int, str, list[int]]] = []  # open subtrees: height, root, nodes below

    def join() -> None:
        h, right, rights = stack.pop()
        _, left, lefts = stack.pop()
        on_right, on_left = b"\2" + bytes.fromhex(right), b"\1" + bytes.fromhex(left)
        for i in lefts:
            wits[i] += on_right
        for i in rights:
            wits[i] += on_left
        stack.append((h + 1, H(left, right), lefts + rights))

    def lift() -> None:
        h, root, below = stack.pop()
        for i in below:
            wits[i] += bytes(STEP)
        stack.append((h + 1, H(root), below))

    for i, d in enumerate(digests):
        stack.append((0, d, [i]))
        while len(stack) > 1 and stack[-2][0] == stack[-1][0]:
            join()
    while len(stack) > 1:
        while stack[-1][0] < stack[-2][0]:
            lift()
        join()
    while stack and stack[0][0] < height:
        lift()
    return wits, stack[0][1]


def fold(leaf: str, wit: bytes) -> str:
    """The root that a leaf and its witness give."""
    for at in range(0, len(wit), STEP):
        side, other = wit[at], wit[at + 1 : at + STEP].hex()
        leaf = H(other, leaf) if side == 1 else H(leaf, other) if side == 2 else H(leaf)
    return leaf


def proof(wit: bytes) -> str:
    """Digest of the siblings, level by level."""
    return H(*(wit[at + 1 : at + STEP].hex() for at in range(0, len(wit), STEP) if wit[at]))


def _block(t: pa.Table) -> pa.Table:
    """One block of nodes with partial witnesses."""
    t = t.sort_by("pos")
    wits, root = grow(t["digest"].to_pylist(), t["height"][0].as_py())
    n = len(wits)
    t = t.drop_columns(["height", "block"])
    for name, values in (("size", pa.array([n] * n, pa.int32())), ("wit", pa.array([bytes(w) for w in wits], pa.binary())), ("root", pa.array([root] * n))):
        t = t.append_column(name, values)
    return t


def witnessed(nodes: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """nodes (grp, pos, digest, height, ..) with the size of their block, their partial witness and the block's root."""
    out = T.StructType([*nodes.drop("height").schema.fields, *schema(size=INT, wit=BIN, root=STR).fields])
    return scratch.keep(nodes.withColumn("block", F.shiftright("pos", k)).groupBy("grp", "block").applyInArrow(_block, out))


def parents(blocks: DataFrame, k: int) -> DataFrame:
    """The nodes one level up, one a block."""
    return blocks.filter(F.col("pos") % 2**k == 0).select("grp", F.shiftright("pos", k).alias("pos"), F.col("root").alias("digest"))


@dataclass
class Level:
    """Nodes of one level: those of completed blocks with their witnesses, the groups that have such, and the others."""

    done: DataFrame | None = None
    groups: DataFrame | None = None
    open: DataFrame | None = None


@dataclass
class Manifest:
    """Subtrees of any number of groups under append; lowest level first."""

    scratch: Scratch
    k: int = K
    levels: list[Level] = field(default_factory=list)

    def append(self, nodes: DataFrame) -> None:
        """Append nodes (grp, pos, digest, any others): positions of a group go on from those it has, without gaps."""
        at = 0
        while nodes is not None:
            if at == len(self.levels):
                self.levels.append(Level())
            level = self.levels[at]
            x = nodes if level.open is None else nodes.unionByName(level.open)
            got = witnessed(x.withColumn("height", F.lit(0)), self.scratch, self.k)
            full = got.filter(F.col("size") == 2**self.k)
            level.open = got.filter(F.col("size") < 2**self.k).drop("size", "wit", "root")
            nodes = None
            if not full.isEmpty():
                level.done = full if level.done is None else level.done.unionByName(full)
                nodes = self.scratch.keep(parents(full, self.k))
                groups = nodes.select("grp") if level.groups is None else nodes.select("grp").union(level.groups)
                level.groups = self.scratch.keep(groups.distinct())
            at += 1

    def finish(self) -> DataFrame:
        """Nodes of the lowest level with wit, the whole witness, and root, that of their group.

        Open blocks are closed from below: each adds one node a level up. The manifest stays as it is for more appends."""
        rows, extra = [], None
        for level in self.levels:
            late = level.open if extra is None else level.open.unionByName(extra)
            if level.groups is None:  # every group ends here with the one block it has
                last = witnessed(late.withColumn("height", F.lit(0)), self.scratch, self.k)
            else:
                more = level.groups.withColumn("height", F.lit(self.k))
                last = witnessed(late.join(more, "grp", "left").fillna(0, "height"), self.scratch, self.k)
                extra = parents(last.join(level.groups, "grp", "left_semi"), self.k)
            rows.append(last if level.done is None else last.unionByName(level.done))
        out = rows.pop()
        while rows:
            up = out.select("grp", F.col("pos").alias("block"), F.col("wit").alias("more"), F.col("root").alias("top"))
            x = rows.pop().withColumn("block", F.shiftright("pos", self.k)).join(up, ["grp", "block"], "left")
            out = x.withColumns({"wit": F.concat("wit", F.coalesce("more", F.lit(b""))), "root": F.coalesce("top", "root")}).drop("block", "more", "top")
        return out.drop("size")


def positions(rows: DataFrame, order: list[str], scratch: Scratch, counts: DataFrame | None = None) -> DataFrame:
    """rows (grp, ..) with pos, their place in their group by order; after counts (grp, n) of earlier rows, if given.

    Rows are dealt to ranges of (grp, order); a place is the place in the range plus the rows of the group in ranges
    before. Rows that tie in everything are told apart by where they were read, so that they spread over ranges."""
    keys = ["grp", *order, "read_at"]
    x = rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    x = scratch.keep(x.drop("read_at").withColumn("at", F.monotonically_increasing_id()))
    x = x.withColumn("part", F.shiftright("at", 33))
    runs = x.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumn("start", F.sum("n").over(W.partitionBy("grp").orderBy("part")) - F.col("n"))
    if counts is not None:
        runs = runs.join(counts.select("grp", F.col("n").alias("had")), "grp", "left").withColumn("start", F.col("start") + F.coalesce("had", F.lit(0))).drop("had")
    x = hot_join(x, scratch.keep(runs), ["grp", "part"], "n")
    return x.withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("at", "part", "first", "start", "n")


def group_key(c: Column) -> Column:
    """A text that orders as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        wits = b.column("wit").to_pylist()
        b = b.append_column("proof", pa.array([proof(w) for w in wits], pa.string()))
        yield b.append_column("folded", pa.array([fold(d, w) for d, w in zip(b.column("shown").to_pylist(), wits, strict=True)], pa.string()))


def check(rows: DataFrame) -> DataFrame:
    """rows (.., shown, wit) with proof, the digest of the witness's siblings, and folded, the root that shown leads to."""
    return rows.mapInArrow(_check, T.StructType([*rows.schema.fields, *schema(proof=STR, folded=STR).fields]))


def manifest(trees: Manifest) -> DataFrame:
    """The leaves of all appends with subroot, root and the whole wit up to root, over the groups in order."""
    scratch = trees.scratch
    x = scratch.keep(trees.finish().withColumnRenamed("root", "subroot"))
    subroots = scratch.keep(x.groupBy("grp").agg(F.min("subroot").alias("digest"), F.count("*").alias("leaves")))
    top = Manifest(scratch, trees.k)
    top.append(positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest", "leaves"), ["of"], scratch))
    of = scratch.keep(top.finish().select(F.col("of").alias("grp"), F.col("wit").alias("upper"), "root", "leaves"))
    return hot_join(x, of, ["grp"], "leaves").withColumn("wit", F.concat("wit", "upper")).drop("upper", "leaves")


#: The contract's query in DuckDB's SQL; the unsigned CRC-32 is computed from its polynomial.
SQL = """
WITH RECURSIVE d AS (SELECT *, coalesce('='||lang,'') AS g FROM documents),
e AS (SELECT *, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR),''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a,b), [0::BIGINT,0,0,0,0,0,0,0]), lambda c, z: xor(c >> 1, 3988292384*(c & 1)))), 4294967295) % 7 = 0 END AS tampered FROM d),
f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR))||':'||doc_id,'-')||coalesce(strlen(source)||':'||source,'-')||coalesce(strlen(lang)||':'||lang,'-') AS a,
  coalesce(strlen(text)||':'||text,'-') AS z, CAST(n_chars AS VARCHAR) AS n, CAST(n_chars+1 AS VARCHAR) AS n1 FROM e),
h AS (SELECT doc_id, g, sha256(a||coalesce(strlen(n)||':'||n,'-')||z) AS leaf, CASE WHEN tampered THEN sha256(a||coalesce(strlen(n1)||':'||n1,'-')||z) END AS altered FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
nodes AS (SELECT g, 0 AS lvl, pos AS idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM l
 UNION ALL SELECT g, lvl+1, idx//2, sha256(string_agg(digest,'' ORDER BY idx)), (n+1)//2 FROM nodes WHERE n > 1 GROUP BY g, lvl, idx//2, n),
sub AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos AS idx, digest, n FROM sub
 UNION ALL SELECT lvl+1, idx//2, sha256(string_agg(digest,'' ORDER BY idx)), (n+1)//2 FROM tops WHERE n > 1 GROUP BY lvl, idx//2, n),
steps AS (SELECT l.g, l.pos, v.lvl, s.digest, l.pos >> v.lvl & 1 AS odd FROM l JOIN (SELECT DISTINCT g, lvl FROM nodes WHERE n > 1) v ON v.g = l.g
  LEFT JOIN nodes s ON s.g = l.g AND s.lvl = v.lvl AND s.idx = xor(l.pos >> v.lvl, 1)
 UNION ALL SELECT l.g, l.pos, 100+v.lvl, s.digest, b.pos >> v.lvl & 1 FROM l JOIN sub b ON b.g = l.g CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) v
  LEFT JOIN tops s ON s.lvl = v.lvl AND s.idx = xor(b.pos >> v.lvl, 1)),
w AS (SELECT g, pos, list(CASE WHEN digest IS NULL THEN 'n' WHEN odd = 1 THEN 'l'||digest ELSE 'r'||digest END ORDER BY lvl) AS wit, string_agg(coalesce(digest,''),'' ORDER BY lvl) AS sibs FROM steps GROUP BY g, pos),
x AS (SELECT l.doc_id, l.leaf, b.digest AS subroot, t.digest AS root, sha256(coalesce(w.sibs,'')) AS proof_sha256,
 list_reduce(list_prepend(coalesce(l.altered,l.leaf), coalesce(w.wit,[])), lambda a, s: sha256(CASE s[1] WHEN 'l' THEN s[2:]||a WHEN 'r' THEN a||s[2:] ELSE a END)) AS folded_root
 FROM l JOIN sub b ON b.g = l.g CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t LEFT JOIN w ON w.g = l.g AND w.pos = l.pos)
SELECT *, folded_root = root AS verified FROM x
"""
