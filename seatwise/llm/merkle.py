"""Merkle manifest of a dataset: a tree of copied SHA-256 states.

The leaves of each group are its rows' digests in order; every run of ``arity`` consecutive nodes becomes
their parent, until one is left, the group's subroot; the subroots become the root in the same way. While
a parent is made it keeps a copy of its hash state from before each child. To check a changed row, each of
its ancestors resumes the copy that belongs to its slot, with the new digest and the siblings to its
right; nothing to its left is hashed again.

The tree is made in blocks of ``arity ** LEVELS`` consecutive nodes, one row and at most LEVELS levels
each; a block's root is a node of the tier above. Going down again, each block gets the siblings of its
ancestors, makes their states once, and copies them for each of its leaves. So a table of n rows takes
log(n) / LEVELS rounds, and no row's text leaves the task that reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import row_ids, stage

ARITY = 2
LEVELS = 12

#: The columns of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

State = "hashlib._Hash"


# --- one block -----------------------------------------------------------------------------------------

def parents(nodes: list[bytes], arity: int) -> tuple[list[bytes], list[list[State]]]:
    """The parents of a level, and of each the hash states before each of its children."""
    out, states = [], []
    for at in range(0, len(nodes), arity):
        state, kept = hashlib.sha256(), []
        for child in nodes[at:at + arity]:
            kept.append(state.copy())
            state.update(child)
        out.append(state.hexdigest().encode())
        states.append(kept)
    return out, states


class Block:
    """The tree over a block's nodes; ``height`` levels, even where one node is left earlier."""

    def __init__(self, nodes: list[bytes], height: int, arity: int):
        self.arity, self.levels, self.states = arity, [nodes], []
        for _ in range(height):
            above, states = parents(self.levels[-1], arity)
            self.levels.append(above)
            self.states.append(states)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[State, list[bytes], list[bytes]]]:
        """From node ``at`` up: the state before it, the siblings to its left and those to its right."""
        out = []
        for level, states in zip(self.levels, self.states):
            up, slot = divmod(at, self.arity)
            run = level[up * self.arity:(up + 1) * self.arity]
            out.append((states[up][slot], run[:slot], run[slot + 1:]))
            at = up
        return out


def resumed(siblings: list[tuple[list[bytes], list[bytes]]]) -> list[tuple[State, list[bytes], list[bytes]]]:
    """The path of a block in the tiers above, its states made from the left siblings once."""
    return [(hashlib.sha256(b"".join(left)), left, right) for left, right in siblings]


def fold(digest: bytes, path: list[tuple[State, list[bytes], list[bytes]]]) -> bytes:
    """The root that ``digest`` leads to."""
    for state, _, right in path:
        state = state.copy()
        state.update(digest)
        for sibling in right:
            state.update(sibling)
        digest = state.hexdigest().encode()
    return digest


def height_of(nodes: int, arity: int) -> int:
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // arity), out + 1
    return out


# --- tiers ---------------------------------------------------------------------------------------------

def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``at``, the row's number from 0 within its group by ``order`` (nulls first), and ``size``, the group's rows.

    Rows are ranged over partitions, so a group that holds most rows is spread; only the number of rows
    of each group in each partition is summed up in a window. ``order`` must tell all rows apart.
    """
    by = [F.col(c).asc_nulls_first() for c in group + order]
    placed = (rows.repartitionByRange(*by).sortWithinPartitions(*by)
              .withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    placed = stage(placed, "ordered")
    counts = placed.groupBy(*group, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*group)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("size"))
    on = F.col("_part") == F.col("_p")
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(counts, on).select(*rows.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias("at"), "size")


def _blocks(nodes: DataFrame, group: list[str], arity: int, levels: int) -> DataFrame:
    """One row per block of consecutive nodes: ``*group, block, size, nodes``; nodes are structs of ``at, digest, ...``."""
    block = F.floor(F.col("at") / (arity ** levels))
    rest = [c for c in nodes.columns if c not in (*group, "at", "size")]
    gathered = nodes.groupBy(*group, block.alias("block"), "size").agg(
        F.array_sort(F.collect_list(F.struct("at", *rest))).alias("nodes"))  # arity ** levels nodes at most
    return stage(gathered, "blocks")


def _roots(blocks: DataFrame, group: list[str], arity: int, levels: int) -> DataFrame:
    """The nodes of the next tier: ``*group, at, size, digest``."""
    own = blocks.select(*group, "block", "size", F.col("nodes.digest").alias("digests"))
    n = len(group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*group).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [Block([d.encode() for d in digests], min(levels, height_of(size, arity)), arity).root.decode()
                     for size, digests in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist())]
            size = [-(-s // arity ** levels) for s in batch.column(n + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n), pa.array(size, pa.int64()), pa.array(roots, pa.string())],
                                             [*group, "at", "size", "digest"])

    return own.mapInArrow(run, f"{schema + ', ' if schema else ''}at long, size long, digest string")


def _tiers(nodes: DataFrame, group: list[str], arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier, from below, and each group's last node (``*group, digest``)."""
    tiers = [_blocks(nodes, group, arity, levels)]
    while True:
        roots = stage(_roots(tiers[-1], group, arity, levels), "roots")
        if roots.filter("size > 1").isEmpty():
            return tiers, roots.select(*group, "digest")
        # groups that are down to one node go along: a block of one node has no level
        tiers.append(_blocks(roots, group, arity, levels))


PATH = "array<struct<left: array<string>, right: array<string>>>"


def _down(blocks: DataFrame, group: list[str], ends: DataFrame, arity: int, levels: int, keep: list[str],
          replaced: str | None = None) -> DataFrame:
    """One row per node of the blocks: ``*group, at, *keep``, and the node's path to the root.

    ``ends`` has the path (``*group, block, path, ...``) of each block's root; its other columns are kept.
    With ``replaced``, a column of the nodes, the paths aren't returned but used: ``proof_sha256`` is the
    digest of all siblings on the path, ``folded_root`` the root from the replaced digest (null: the own).
    """
    more = [c for c in ends.columns if c not in (*group, "block", "path")]
    on = F.lit(True)
    for c in (*group, "block"):
        on &= F.col(f"b.`{c}`").eqNullSafe(F.col(f"e.`{c}`"))
    inner = blocks.schema["nodes"].dataType.elementType
    own = blocks.alias("b").join(ends.alias("e"), on).select(
        *[F.col(f"b.`{c}`") for c in group], "size", "nodes", "path", *[F.col(f"e.`{c}`") for c in more])
    n, kept = len(group), [c for c in inner.names if c in keep]
    fields = [*own.select(*group).schema, *[inner[c] for c in kept], *own.select(*more).schema]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    schema += "proof_sha256 string, folded_root string" if replaced else f"at long, path {PATH}"
    last = [pa.string(), pa.string()] if replaced else [pa.int64(), pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                nodes = batch.column(n + 1)[k].values
                digests = [d.encode() for d in nodes.field("digest").to_pylist()]
                tree = Block(digests, min(levels, height_of(batch.column(n)[k].as_py(), arity)), arity)
                above = resumed([([x.encode() for x in p["left"]], [x.encode() for x in p["right"]]) for p in batch.column(n + 2)[k].as_py()])
                if replaced:
                    fresh = nodes.field(replaced).to_pylist()
                    made = [(_proof(path), fold(f.encode() if f else d, path).decode())
                            for path, d, f in ((tree.path(i) + above, d, f) for i, (d, f) in enumerate(zip(digests, fresh)))]
                    two = [pa.array(x, t) for x, t in zip(zip(*made), last)]
                else:
                    paths = [[{"left": [x.decode() for x in left], "right": [x.decode() for x in right]}
                              for _, left, right in tree.path(i) + above] for i in range(len(digests))]
                    two = [nodes.field("at"), pa.array(paths, last[1])]
                same = lambda c: pa.array([batch.column(c)[k].as_py()] * len(digests), batch.column(c).type)
                yield pa.RecordBatch.from_arrays(
                    [*[same(c) for c in range(n)], *[nodes.field(c) for c in kept], *[same(names.index(c)) for c in more], *two],
                    [f.name for f in fields] + (["proof_sha256", "folded_root"] if replaced else ["at", "path"]))

    return own.mapInArrow(run, schema)


def _proof(path: list[tuple[State, list[bytes], list[bytes]]]) -> str:
    return hashlib.sha256(b"".join(x for _, left, right in path for x in left + right)).hexdigest()


def _ends(tiers: list[DataFrame], group: list[str], tops: DataFrame, arity: int, levels: int) -> DataFrame:
    """The path of every block of the lowest tier; ``tops`` has that of each group's last node."""
    ends = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers[1:]):
        keep = [c for c in tops.columns if c not in (*group, "path")]
        ends = stage(_down(blocks, group, ends, arity, levels, []).withColumnRenamed("at", "block")
                     .select(*group, "block", "path", *keep), "paths")
    return ends


# --- the manifest --------------------------------------------------------------------------------------

def leaf(**changed: Column) -> Column:
    """The digest of a document's fields: each a dash if null, else its length in bytes, a colon and its value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def manifest(leaves: DataFrame, group_col: str, order: list[str], arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per leaf: its columns, ``subroot, root, proof_sha256, folded_root, verified``.

    ``leaves`` has ``digest`` and ``replaced`` (a changed row's digest, else null), hexadecimal. Groups
    stand in the order of their values, null first; leaves by ``order``, which need not tell rows
    apart: equal ones stand by digest, and those of equal digest are alike in every result. Null ids come
    first. ``verified`` tells whether the root that the replaced digest leads to is the true one. An
    empty table gives an empty result.
    """
    group = [group_col]
    rows = stage(row_ids(leaves, "_tie"), "leaves")
    keep = [c for c in rows.columns if c not in (group_col, "_tie")]
    tiers, subroots = _tiers(numbered(rows, group, [*order, "digest", "_tie"]).drop("_tie"), group, arity, levels)
    over = numbered(subroots, [], [group_col])
    upper, root = _tiers(over, [], arity, levels)
    tops = root.select(F.col("digest").alias("root"), F.lit([]).cast(PATH).alias("path"))
    tops = _ends(upper, [], tops, arity, levels)
    tops = stage(_down(upper[0], [], tops, arity, levels, [group_col, "digest"])
                 .select(group_col, F.col("digest").alias("subroot"), "root", "path"), "tops")
    ends = _ends(tiers, group, tops, arity, levels)
    out = _down(tiers[0], group, ends, arity, levels, [c for c in keep], replaced="replaced")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame, tampered: str | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents by language; where ``tampered`` is true, the folded leaf has ``n_chars`` + 1.

    Per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. Null fields are
    dashes in the leaf, a null ``n_chars`` cannot be tampered with; extra columns play no part.
    """
    changed = leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    replaced = F.when(F.expr(tampered) & F.col("n_chars").isNotNull(), changed) if tampered else F.lit(None).cast("string")
    rows = docs.select("doc_id", "lang", leaf().alias("digest"), replaced.alias("replaced"))
    return manifest(rows, "lang", ["doc_id"], arity, levels).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

ORACLE_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, sha256({" || ".join(map(_FIELD, FIELDS))}) AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN sha256({" || ".join(_FIELD("CAST(n_chars AS HUGEINT) + 1" if c == "n_chars" else c) for c in FIELDS)})
              ELSE sha256({" || ".join(map(_FIELD, FIELDS))}) END AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size
  FROM documents),
tree AS (
  SELECT lang, 0 AS level, pos, size, leaf AS h FROM l
  UNION ALL
  SELECT lang, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE size > 1
  GROUP BY lang, level, pos // 2, size),
g AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM tree WHERE size = 1),
top AS (
  SELECT 0 AS level, pos, size, subroot AS h FROM g
  UNION ALL
  SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY level, pos // 2, size),
walk AS (
  SELECT doc_id, leaf, lang, 0 AS level, pos, size, changed AS h, '' AS proof FROM l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.level + 1, w.pos // 2, (w.size + 1) // 2,
         sha256(CASE WHEN t.h IS NULL THEN w.h WHEN w.pos % 2 = 0 THEN w.h || t.h ELSE t.h || w.h END), w.proof || coalesce(t.h, '')
  FROM walk w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.size > 1),
climb AS (
  SELECT doc_id, leaf, subroot, 0 AS level, g.pos, g.size, h, proof
  FROM walk w JOIN g ON g.lang IS NOT DISTINCT FROM w.lang WHERE w.size = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.pos // 2, (w.size + 1) // 2,
         sha256(CASE WHEN t.h IS NULL THEN w.h WHEN w.pos % 2 = 0 THEN w.h || t.h ELSE t.h || w.h END), w.proof || coalesce(t.h, '')
  FROM climb w LEFT JOIN top t ON t.level = w.level AND t.pos = xor(w.pos, 1)
  WHERE w.size > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE size = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
       h = (SELECT h FROM top WHERE size = 1) AS verified
FROM climb WHERE size = 1
"""
