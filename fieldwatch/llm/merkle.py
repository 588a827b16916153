"""Merkle manifest of a dataset: a hash tree for each group of rows, and one tree over their roots.

A chunk holds `fanout ** LOCAL_LEVELS` consecutive leaves of a group, aligned, so that its
leaves are whole subtrees.  Chunks hash their lower levels by themselves.  Above them they
run a butterfly: in round r, the chunks whose numbers agree but for digit r (in base
`fanout`) swap the nodes they have reached, and each of them hashes the common parent.  So
every chunk climbs to the root of its group with the siblings it needs on the way, and
nothing has to come down again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.llm.common import stored

#: Levels of a tree that lie inside one chunk.
LOCAL_LEVELS = 3
HEX = 64
PATH = "array<struct<run:string,at:int>>"


def digest(columns: list[Column]) -> Column:
    """Hash of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def field(c):
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add `position` (from 0) of each row in its tree and `total`, the rows of the tree.

    A range sort deals the rows out, equal ones by their row number, so no key is too
    large for a task; counts per (tree, partition) give the positions.
    """
    rows = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "row")]
    by_range = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    by_range = stored(by_range.drop("row").withColumn("part", F.shiftright("at", 33)), "merkle-sorted")
    counts = by_range.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("rows").over(tree).alias("total"))
    placed = by_range.join(bases, ["tree", "part"])
    return placed.withColumn("position", F.col("at") + F.col("base")).drop("at", "base", "part")


def _runs(nodes: Column, fanout: int) -> Column:
    """The nodes of each run of siblings, joined."""
    last = F.floor((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(nodes, k * fanout + 1, fanout), ""))


def _with_runs(chunks: DataFrame, fanout: int) -> DataFrame:
    """Add runs0, runs1, ... of a chunk's own levels, and `node`, the chunk's root.

    A tree that ends inside its only chunk has fewer levels; its root is the first node of
    the level that has one node only.
    """
    out = chunks.withColumn("nodes", F.transform("leaves", lambda x: x["digest"]))
    node = F.when(F.col("total") == 1, F.element_at("leaves", 1)["digest"])
    for level in range(LOCAL_LEVELS):
        out = out.withColumn(f"runs{level}", _runs(F.col("nodes"), fanout))
        out = out.withColumn("nodes", F.transform(f"runs{level}", lambda r: F.sha2(r, 256)))
        here = F.element_at(F.transform(F.slice(f"runs{level}", 1, 1), lambda r: F.sha2(r, 256)), 1)
        ends = F.lit(True) if level == LOCAL_LEVELS - 1 else F.col("total") <= fanout ** (level + 1)
        node = node.when(ends, here)
    return out.drop("nodes").withColumn("node", node)


def _round(state: DataFrame, width: int, fanout: int) -> DataFrame:
    """One exchange among chunks that have reached nodes of `width` chunks.

    Chunk i sends its node to the chunks at the same place under each sibling node.  Only
    the last node of a level may be short; then its chunks share the receivers that are
    left over.  A chunk receives one node for each sibling: at most `fanout` small rows.
    """
    mine, n = F.expr(f"chunk div {width}"), F.col("chunks")
    state = state.withColumn("mine", mine).withColumn("held", F.least((F.col("mine") + 1) * width, n) - F.col("mine") * width)
    first = F.expr(f"mine div {fanout}") * fanout
    last = F.least(first + fanout - 1, F.expr(f"(chunks - 1) div {width}"))
    to = state.withColumn("under", F.explode(F.sequence(first, last)))
    place = F.col("under") * width + F.expr(f"chunk % {width}")
    end = F.least((F.col("under") + 1) * width, n) - 1
    sent = to.withColumn("receiver", F.explode(F.when(place <= end, F.sequence(place, end, F.col("held")))))
    own = F.col("receiver") == F.col("chunk")
    got = sent.groupBy("tree", "receiver").agg(
        F.max("chunks").alias("chunks"),
        F.max("total").alias("total"),
        F.first(F.when(own, F.col("path")), ignorenulls=True).alias("path"),
        F.sort_array(F.collect_list(F.struct(F.col("mine").alias("under"), "node"))).alias("siblings"),
    )
    run = F.array_join(F.transform("siblings", lambda s: s["node"]), "")
    at = F.expr(f"receiver div {width} % {fanout}").cast("int")
    return (
        got.withColumn("run", run)
        .withColumn("path", F.concat("path", F.array(F.struct(F.col("run").alias("run"), at.alias("at")))))
        .select("tree", F.col("receiver").alias("chunk"), "chunks", "total", F.sha2("run", 256).alias("node"), "path")
    )


def grow(leaves: DataFrame, order: list[str], fanout: int) -> tuple[DataFrame, DataFrame]:
    """Trees over (tree, digest, ...) rows, ordered by `order` in each tree.

    Returns the chunks (tree, chunk, total, leaves) and, for each chunk, `node`, the root of
    its tree, and `path`, the runs of siblings from the chunk's root upwards.
    """
    size = fanout**LOCAL_LEVELS
    placed = _positions(leaves, order).withColumn("chunk", F.expr(f"position div {size}"))
    payload = [c for c in leaves.columns if c != "tree"]
    chunks = placed.groupBy("tree", "chunk").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("position", *payload))).alias("leaves")
    )
    chunks = stored(chunks, "merkle-chunks")
    count = F.expr(f"(total + {size - 1}) div {size}")
    state = _with_runs(chunks, fanout).select("tree", "chunk", count.alias("chunks"), "total", "node", F.array().cast(PATH).alias("path"))
    state = stored(state, "merkle-nodes")
    most, width = state.agg(F.max("chunks")).first()[0] or 1, 1
    while width < most:
        done = F.col("chunks") <= width
        state = stored(_round(state.where(~done), width, fanout).unionByName(state.where(done)), "merkle-nodes")
        width *= fanout
    return chunks, state.select("tree", "chunk", "node", "path")


def leaf_paths(chunks: DataFrame, upper: DataFrame, fanout: int) -> DataFrame:
    """One row for each leaf: its columns, those of `upper`, and the whole `path` of siblings.

    Each element of the path is a run of sibling digests, joined, and the leaf's place in it.
    """
    rows = _with_runs(chunks, fanout).drop("node").join(upper, ["tree", "chunk"])

    def part(k):
        """The leaves of run k and the runs above them, in this chunk."""
        runs = [F.element_at(f"runs{j}", F.floor(k / fanout**j).cast("int") + 1) for j in range(LOCAL_LEVELS)]
        return F.struct(F.slice("leaves", k * fanout + 1, fanout).alias("members"), F.array(*runs).alias("runs"), k.alias("k"))

    kept = [c for c in upper.columns if c not in ("tree", "chunk", "path")]
    parts = rows.select("total", F.col("path").alias("upper"), *kept, F.explode(F.transform(F.sequence(F.lit(0), F.size("runs0") - 1), part)).alias("part"))
    single = parts.select("total", "upper", *kept, F.col("part.runs").alias("runs"), F.col("part.k").alias("k"), F.posexplode("part.members").alias("at", "leaf"))
    own = [
        F.when(
            F.col("total") > fanout**j,
            F.struct(F.element_at("runs", j + 1).alias("run"), (F.col("at") if j == 0 else F.expr(f"k div {fanout ** (j - 1)} % {fanout}")).cast("int").alias("at")),
        )
        for j in range(LOCAL_LEVELS)
    ]
    path = F.concat(F.array_compact(F.array(*own)).cast(PATH), "upper")
    return single.select("leaf.*", *kept, path.alias("path"))


def siblings(path: Column) -> Column:
    """The digests a proof needs: level by level upwards, from left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.substring(p["run"], F.lit(1), HEX * p["at"]), F.substr(p["run"], HEX * p["at"] + HEX + 1))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""

    def up(node, p):
        left, right = F.substring(p["run"], F.lit(1), HEX * p["at"]), F.substr(p["run"], HEX * p["at"] + HEX + 1)
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(path, leaf, up)


def merkle_manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    fanout: int = 16,
    received: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (its siblings' digests), folded_root, verified.

    columns: the fields that a leaf covers, in this order.  received: what came in place of
    some of them, as columns of `docs`; the row's leaf is made anew from these and folded
    with the siblings of the original tree, so `verified` tells whether the row is intact.
    Groups are ordered by their bytes, null first; rows of a group by id, null first, rows
    of one id by their leaf.

    Nulls and corner cases: a null field is hashed as such and differs from an empty one; a
    group of one row has its leaf as subroot, and a single group's subroot is the root;
    equal rows are leaves of their own; an empty table gives no rows; columns that are not
    listed are ignored, whatever their names.  Texts of any length are hashed whole where
    they are read; only digests are shuffled.
    """
    leaf = digest([F.col(c) for c in columns])
    came = digest([(received or {}).get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("digest"), came.alias("came"))
    chunks, upper = grow(leaves, ["doc_id", "digest"], fanout)
    subroots = upper.where("chunk = 0").select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("node").alias("digest"))
    above = leaf_paths(*grow(subroots, ["group"], fanout), fanout)
    above = stored(above.select(F.col("group").alias("tree"), F.col("node").alias("root"), F.col("path").alias("above")), "merkle-above")
    upper = upper.join(above, "tree").select("tree", "chunk", F.col("node").alias("subroot"), "root", F.concat("path", "above").alias("path"))
    out = leaf_paths(chunks, upper, fanout)
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings(F.col("path")).alias("proof"), fold(F.col("came"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, n: int) -> str:
    """CTEs of a tree's levels over {name}0(tree, total, pos, node), up to 16 ** n leaves."""
    parts = []
    for k in range(n):
        parts.append(f"""{name}run{k} AS (SELECT tree, total, pos // 16 AS pos, string_agg(node, '' ORDER BY pos) AS run FROM {name}{k} GROUP BY tree, total, pos // 16),
{name}{k + 1} AS (SELECT tree, total, pos, CASE WHEN total > {16**k} THEN sha256(run) ELSE run END AS node FROM {name}run{k})""")
    return ",\n".join(parts)


def _climb(name: str, n: int, total: str, pos: str, start: str) -> tuple[str, str, str]:
    """Joins, sibling text and folded node of a path through the levels of `name`."""
    joins, others, node = "", [], start
    for k in range(n):
        run, at = f"{name}r{k}.run", f"64 * ({pos} // {16**k} % 16)"
        joins += f"\nJOIN {name}run{k} {name}r{k} ON {name}r{k}.tree = {'l.tree' if name == 'd' else "''"} AND {name}r{k}.pos = {pos} // {16 ** (k + 1)}"
        others.append(f"CASE WHEN {total} > {16**k} THEN substr({run}, 1, {at}) || substr({run}, {at} + 65) ELSE '' END")
        node = f"CASE WHEN {total} > {16**k} THEN sha256(substr({run}, 1, {at}) || {node} || substr({run}, {at} + 65)) ELSE {node} END"
    return joins, " || ".join(others), node


def manifest_sql(levels: int = 3) -> str:
    """The manifest of `documents` on DuckDB, for up to 16 ** levels rows a source and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    climb_d = _climb("d", levels, "l.total", "l.pos", "l.came")
    climb_s = _climb("s", levels, "b.total", "b.pos", "f.folded")
    return rf"""WITH RECURSIVE crc(doc_id, i, c) AS (
  SELECT doc_id, 0, CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, i + 1, {_crc_byte("xor(c, ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)))")} FROM crc WHERE i < length(CAST(doc_id AS VARCHAR))),
hit AS (SELECT DISTINCT doc_id FROM crc WHERE i = length(CAST(doc_id AS VARCHAR)) AND xor(c, 4294967295) % 5 = 0),
rows AS (SELECT d.*, h.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN hit h USING (doc_id)),
leaves AS (
  SELECT coalesce('+' || source, '') AS tree, doc_id, {leaf("text")} AS leaf,
    CASE WHEN hit THEN {leaf(low)} ELSE {leaf("text")} END AS came
  FROM rows),
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total
  FROM leaves),
d0 AS (SELECT tree, total, pos, leaf AS node FROM l),
{_levels("d", levels)},
b AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM d{levels}),
s0 AS (SELECT '' AS tree, total, pos, subroot AS node FROM b),
{_levels("s", levels)},
f AS (
  SELECT l.tree, l.doc_id, l.leaf, {climb_d[1]} AS proof, {climb_d[2]} AS folded
  FROM l{climb_d[0]}),
g AS (
  SELECT f.doc_id, f.leaf, b.subroot, t.node AS root, f.proof || {climb_s[1]} AS proof, {climb_s[2]} AS folded_root
  FROM f JOIN b ON b.source = f.tree CROSS JOIN s{levels} t{climb_s[0]})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM g"""


def _crc_byte(first: str) -> str:
    """One byte of CRC-32 as SQL, `first` being the value with the byte mixed in.

    A byte's eight steps only depend on the low eight bits, each of which adds its own
    constant, found by the same steps here.
    """
    terms = []
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        terms.append(value)
    out = f"(({first}) >> 8)"
    for bit, value in enumerate(terms):
        out = f"xor({out}, ((({first}) >> {bit}) & 1) * {value})"
    return out
