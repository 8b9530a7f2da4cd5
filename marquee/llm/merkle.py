"""Merkle manifest of a dataset: a persistent tree over its rows, in aligned blocks.

Leaves are ordered inside their group; every RUN consecutive nodes become one, and so on up to the group's root; the roots of the groups form
one more tree in the same way. A tree is stored as layers of blocks of RUN^LEVELS nodes: a block is one row and holds its
lowest nodes, so that its inner nodes can be made again by the task that reads it, and its root is a node of the layer above.

Persistent: nothing is rewritten when a leaf changes. A changed leaf makes a version that shares every node but its ancestors. versions()
copies these inside the leaf's block and goes on through the layers above with the siblings of the block's root, which reach
the block by a join: one row a block, whatever the number of its versions. A version is then the array of its copied nodes, bottom-up, the last
one its root; all other nodes are those of the tree.

No group is gathered in one task: leaves take their places by a range sort, blocks hold at most RUN^LEVELS rows, and a layer is
RUN^LEVELS times smaller than the one below.

Defined results: every row is a leaf, repeated rows too; rows with equal or null ids (null first) stand in the order of their leaves; a null
group is the first group; a null value is `-`, an empty one `0:`; rows whose condition for a change is null are not changed; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import materialise
from marquee.operators.ranking import placed

#: Nodes that become one, and levels of a block.
RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
#: Siblings of a node on its way up, level by level: the digests left and right of it in its run.
PATH = "array<struct<l:string,r:string>>"


def digest(nodes: str) -> str:
    return sha256(nodes.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: list[str], id_col: str, group_col: str, where: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """row_no, id, g (the group as text that sorts null first), leaf and tampered (the leaf with `changed` values where `where` holds, else null); written to the shared folder."""
    leaf = lambda values: F.sha2(F.concat(*[field(values.get(c, docs[c])) for c in fields]), 256)
    tampered = F.when(where, leaf(changed or {})) if where is not None else F.lit(None).cast("string")
    group = docs[group_col].cast("string")
    return materialise(
        docs.select(F.monotonically_increasing_id().alias("row_no"), docs[id_col].alias("id"), F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("g"), leaf({}).alias("leaf"), tampered.alias("tampered")), "leaves"
    )


def levels_of(n: int) -> int | None:
    """Levels of a block in a layer of n nodes; None: until one node is left."""
    return 0 if n == 1 else LEVELS if n > BLOCK else None


def folded(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The levels of a block from its nodes to its root."""
    out = [nodes]
    while levels > len(out) - 1 if levels is not None else len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + RUN])) for i in range(0, len(out[-1]), RUN)])
    return out


def way(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Left and right siblings of node `at` of a block, up to the block's root."""
    out = []
    for nodes in levels[:-1]:
        start = at - at % RUN
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + RUN])))
        at //= RUN
    return out


def copied(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors of a node that has changed, bottom-up: the only nodes that its version does not share."""
    out = []
    for left, right in path:
        node = digest(left + node + right)
        out.append(node)
    return out


def blocks(nodes: DataFrame) -> DataFrame:
    """One row a block (g, n, block, nodes in order) of nodes with g, place from 0, n (nodes of the group) and node (a struct with hash)."""
    grouped = nodes.groupBy("g", "n", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("nodes"))
    return materialise(grouped.withColumn("nodes", F.transform("nodes", lambda x: x["node"])), "blocks")


def block_roots(layer: DataFrame) -> DataFrame:
    """The blocks of a layer as the nodes of the next."""

    def fold(batches):
        import pyarrow as pa

        for batch in batches:
            g, n, block, nodes = batch.columns
            roots = [folded(x, levels_of(m))[-1][0] for x, m in zip(nodes.to_pylist(), n.to_pylist())]
            yield pa.RecordBatch.from_arrays([g, pa.array([-(-m // BLOCK) for m in n.to_pylist()], pa.int64()), block, pa.array(roots, pa.string())], names=["g", "n", "place", "hash"])

    made = layer.select("g", "n", "block", F.transform("nodes", lambda x: x["hash"]).alias("hashes")).mapInArrow(fold, "g string, n long, place long, hash string")
    return made.select("g", "n", "place", F.struct("hash").alias("node"))


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The layers of the tree of each group, lowest first, and g and root of each group."""
    layers = [blocks(nodes)]
    while (layers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        layers.append(blocks(block_roots(layers[-1])))
    return layers, layers[-1].select("g", F.get("nodes", F.lit(0))["hash"].alias("root"))


def lowered(layer: DataFrame, above: DataFrame) -> DataFrame:
    """g, place, path and what else `above` says, for every node of a layer. above: g, place, path of the layer's blocks."""
    carried = [c for c in above.columns if c not in ("g", "place", "path")]

    def spread(batches):
        import pyarrow as pa

        schema = pa.schema([("g", pa.string()), ("place", pa.int64()), ("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))] + [(c, pa.string()) for c in carried])
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            levels, here = folded(row["hashes"], levels_of(row["n"])), range(len(row["hashes"]))
            paths = [[{"l": a, "r": b} for a, b in way(levels, at)] + row["path"] for at in here]
            yield pa.RecordBatch.from_pydict({"g": [row["g"]] * len(here), "place": [row["block"] * BLOCK + at for at in here], "path": paths} | {c: [row[c]] * len(here) for c in carried}, schema=schema)

    joined = layer.select("g", "n", "block", F.transform("nodes", lambda x: x["hash"]).alias("hashes")).join(above.withColumnRenamed("place", "block"), ["g", "block"])
    return joined.mapInArrow(spread, f"g string, place long, path {PATH}" + "".join(f", {c} string" for c in carried))


def manifest(found: DataFrame) -> tuple[list[DataFrame], DataFrame, str | None]:
    """Of leaves(): the layers of the groups' trees, the way from each group's root to the root of all (g, place 0, subroot, path), and that root."""
    places = placed(found, ["g"], [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row_no")], first=0)
    sizes = found.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    nodes = with_sizes(places, sizes, found.count()).select("g", "n", "place", F.struct(F.col("leaf").alias("hash"), "id", "tampered").alias("node"))
    layers, subroots = grown(nodes)
    subroots = materialise(subroots, "subroots")
    ordered = placed(subroots, [], [F.col("g")], first=0)
    top, roots = grown(ordered.select(F.lit("").alias("g"), F.lit(subroots.count()).cast("long").alias("n"), "place", F.struct(F.col("root").alias("hash")).alias("node")))
    root = roots.first()
    way_up = roots.select("g", F.lit(0).cast("long").alias("place"), F.array().cast(PATH).alias("path"))
    for layer in reversed(top):
        way_up = lowered(layer, way_up)
    paths = ordered.select(F.col("g").alias("group"), "place", F.col("root").alias("subroot")).join(way_up.select("place", "path"), "place")
    return layers, paths.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("place"), "subroot", "path"), root.root if root else None


def with_sizes(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """rows with n of their group; the sizes of groups over a thousandth of all rows are sent to all tasks, so that such rows stay where they are."""
    from marquee.llm.common import join_counted

    return join_counted(rows, sizes.withColumn("_n", F.col("n")), ["g"], "_n", total)


def versions(layers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """id, leaf, subroot, proof (digest of all siblings), tampered and copied (the version's own nodes above the leaf, its root last) of every leaf.

    A leaf that has not changed gives the version that equals the tree: its ancestors are computed from it all the same.
    """
    above = paths
    for layer in reversed(layers[1:]):
        above = lowered(layer, above)

    def copy(batches):
        import pyarrow as pa

        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            block = row.column("nodes").flatten()
            hashes, tampered = block.field("hash").to_pylist(), block.field("tampered").to_pylist()
            levels = folded(hashes, levels_of(row.column("n")[0].as_py()))
            rest = [(x["l"], x["r"]) for x in row.column("path")[0].as_py()]
            ways = [way(levels, at) for at in range(len(hashes))]
            proofs = [digest("".join(a + b for a, b in near + rest)) for near in ways]
            own = [copied(t or h, near + rest) for t, h, near in zip(tampered, hashes, ways)]
            subroot = pa.array(row.column("subroot").to_pylist() * len(hashes), pa.string())
            yield pa.RecordBatch.from_arrays([block.field("id"), block.field("hash"), subroot, pa.array(proofs, pa.string()), block.field("tampered"), pa.array(own, pa.list_(pa.string()))], names=["id", "leaf", "subroot", "proof", "tampered", "copied"])

    kind = layers[0].schema["nodes"].dataType.elementType["id"].dataType.simpleString()
    joined = layers[0].join(above.withColumnRenamed("place", "block"), ["g", "block"])
    return joined.select("n", "nodes", "path", "subroot").mapInArrow(copy, f"id {kind}, leaf string, subroot string, proof string, tampered string, copied array<string>")
