"""Merkle manifest of a dataset, by nested-interval labels.

A node of level l covers an interval of leaf ranks: [j x 3^l, (j + 1) x 3^l), cut off at the number of leaves. Nodes are worked on in units of
DEPTH levels: a unit is the nodes of a level whose intervals lie in one bucket of 3^DEPTH intervals (81 at most), grouped by
(tree, bucket), so that no unit grows with a tree and a hot tree is spread over all tasks. Inside a unit the levels above are arrays of
(lo, hi, digest); a node's siblings at a level are what its parent's interval holds beside its own ancestor's. Units of
a level and the nodes of the level DEPTH above meet by a join on (tree, bucket) and containment, from the top down, which hands each node the
siblings of all its ancestors. Ranks come from range partitions: a local number, and the counts of the
ranges before. Every leaf is shuffled once to be ranked and once to be grouped; texts are hashed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import discard, stored

FAN, DEPTH = 3, 4
BUCKET = FAN**DEPTH
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value's UTF-8 byte count, a colon and the value; `-` for a null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """rows (a stored table) with rank, 0 and on inside each tree, and n, the tree's number of rows. A stored table without ties: `order` must end all of them, or the rows be equal.

    Rows are sorted over range partitions; row numbers come from each range's first row of a tree and the counts of the ranges before.
    """
    keys = [F.col(c).asc_nulls_first() for c in tree + order]
    ranges = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, F.col("at")).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(*tree, "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    inside = Window.partitionBy(*tree)
    before = inside.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in tree], F.col("range").alias("_range"), "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(inside).alias("n"))
    same = F.col("range") == F.col("_range")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = placed.join(starts, same).withColumn("rank", F.col("start") + F.col("at") - F.col("first"))
    return out.select(*[c for c in rows.columns], "rank", "n")


def _runs(level: Column) -> Column:
    """The level above: every FAN consecutive nodes become one."""

    def one(j: Column) -> Column:
        run = F.slice(level, j * FAN + 1, FAN)
        return F.struct(
            F.element_at(run, 1)["lo"].alias("lo"),
            F.element_at(run, -1)["hi"].alias("hi"),
            F.sha2(F.concat_ws("", F.transform(run, lambda x: x["digest"])), 256).alias("digest"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), one)


def _units(nodes: DataFrame, level: int, payload: list[str]) -> DataFrame:
    """(tree, bucket, n, l0 ... lDEPTH, items) of nodes (tree, lo, hi, digest, n, payload) of a level; lT is null above the tree's root."""
    item = F.struct(F.col("lo"), F.col("hi"), "digest", *payload)
    units = nodes.withColumn("bucket", F.floor(F.col("lo") / FAN ** (level + DEPTH))).groupBy("tree", "bucket").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    units = units.withColumn("l0", F.transform("items", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))))
    for t in range(DEPTH):
        units = units.withColumn(f"l{t + 1}", F.when(F.col("n") > FAN ** (level + t), _runs(F.col(f"l{t}"))))
    return units


def _tops(units: DataFrame) -> DataFrame:
    """(tree, lo, hi, digest, n) of each unit's topmost node."""
    top = F.element_at(F.coalesce(*[F.col(f"l{t}") for t in range(DEPTH, -1, -1)]), 1)
    return units.select("tree", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), "n")


def _paths(units: DataFrame, level: int) -> DataFrame:
    """units' items one by one, with `own`: the siblings left and right of the item and of each of its ancestors in the unit, upwards."""

    def step(t: int, item: Column) -> Column:
        below, above = F.col(f"l{t}"), F.col(f"l{t + 1}")
        width = FAN ** (level + t)
        first = F.col("bucket") * F.lit(BUCKET // FAN**t)  # number of the first node of this level in the bucket
        place = F.floor(item["lo"] / width) - first
        parent = F.element_at(above, (F.floor(place / FAN) + 1).cast("int"))
        mine = F.element_at(below, (place + 1).cast("int"))
        inside = F.slice(below, (F.floor(place / FAN) * FAN + 1).cast("int"), F.lit(FAN))

        def digests(side) -> Column:
            kept = F.filter(inside, lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"]) & side(x))
            return F.concat_ws("", F.transform(kept, lambda x: x["digest"]))

        left, right = digests(lambda x: x["hi"] <= mine["lo"]), digests(lambda x: x["lo"] >= mine["hi"])
        return F.when(F.col("n") > width, F.struct(left.alias("left"), right.alias("right")))

    one = units.select("tree", "bucket", "n", *[f"l{t}" for t in range(DEPTH + 1)], *[c for c in units.columns if c in ("path", "root", "subroot")], F.explode("items").alias("item"))
    own = F.filter(F.array(*[step(t, F.col("item")) for t in range(DEPTH)]), lambda s: s.isNotNull())
    return one.withColumn("own", own)


def trees(leaves: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Stored units of every DEPTH-th level from the leaves (tree, lo, hi, digest, n, payload) up, and (tree, subroot) of all trees, stored."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, level, roots = [], leaves, 0, None
    while True:
        units = stored(_units(nodes, level, payload if level == 0 else []), "units")
        levels.append(units)
        tops = _tops(units)
        done = tops.where(F.col("n") <= FAN ** (level + DEPTH)).select("tree", F.col("digest").alias("subroot"))
        roots = done if roots is None else roots.unionByName(done)
        nodes, level = tops.where(F.col("n") > FAN ** (level + DEPTH)), level + DEPTH
        if most <= FAN**level:
            return levels, stored(roots, "subroots")


def attach(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves (item, own) with path, the siblings above their unit, and what tops (tree, subroot, root, path) says of their tree.

    From the top down: a tree's topmost unit takes tops' row, any other unit the node of the next levels that contains its interval, by bucket.
    """
    tops = tops.select(F.col("tree").alias("_tree"), "subroot", "root", "path")
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level, units = k * DEPTH, levels[k]
        whole = FAN ** (level + DEPTH)
        placed = units.where(F.col("n") <= whole).join(tops, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if above is not None:
            nodes = above.select(F.col("tree").alias("_tree"), F.floor(F.col("item.lo") / whole).alias("_bucket"), F.col("item.lo").alias("_lo"), F.col("item.hi").alias("_hi"), "subroot", "root", F.concat("own", "path").alias("path"))
            lo, hi = F.element_at("l0", 1)["lo"], F.element_at("l0", -1)["hi"]
            within = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("bucket") == F.col("_bucket")) & (F.col("_lo") <= lo) & (hi <= F.col("_hi"))
            placed = placed.unionByName(units.where(F.col("n") > whole).join(nodes, within).drop("_tree", "_bucket", "_lo", "_hi"))
        above = _paths(placed, level)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "source", tampered: list[Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; the root of all is that of the groups' roots, ordered by group.

    A leaf is the digest of the columns, one after the other. `tampered` gives the columns as they are found later (as they are, by default): verified tells
    whether the root folded from them is the manifest's. Null groups are one group, and the first. Rows of a group go by key (nulls first), then by leaf, so repeated rows stay,
    each a leaf. Texts of any length are hashed whole, null and empty ones apart. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    found = leaf_digest(*(tampered or [F.col(c) for c in columns]))
    leaf = leaf_digest(*[F.col(c) for c in columns])
    slim = docs.select(F.col(group).alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), found.alias("found"))
    slim = stored(slim.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found"))), "leaves")
    leaves = ranked(slim, ["tree"], ["key", "digest"])
    leaves = leaves.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "n", "key", "found")
    levels, subroots = trees(leaves, ["key", "found"])
    discard(slim)
    # the groups' roots are the leaves of one more tree
    heads = ranked(subroots, [], ["tree"]).select(F.lit(None).cast("string").alias("tree"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("subroot").alias("digest"), "n", F.col("tree").alias("group"))
    upper, roots = trees(heads, ["group"])
    top = attach(upper, roots.select("tree", "subroot", F.col("subroot").alias("root"), F.array().cast(f"array<{STEP}>").alias("path")))
    top = stored(top.select(F.col("item.group").alias("tree"), F.col("item.digest").alias("subroot"), "root", F.concat("own", "path").alias("path")), "tops")
    discard(*upper, subroots, roots)
    path = F.concat("own", "path")
    rows = attach(levels, top).select("item", "subroot", "root", path.alias("path"))
    folded = fold(F.coalesce("item.found", "item.digest"), F.col("path"))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256)
    out = rows.select(F.col("item.key").alias(key), F.col("item.digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; documents whose crc32(doc_id) is even are tampered with: their text loses its line feeds.

    A null doc_id or text isn't tampered with. For nulls, repeated rows, ties, empty tables and further columns see manifest().
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, COLUMNS, tampered=[*map(F.col, COLUMNS[:-1]), cut])


def _sql(levels: int = 13, groups: int = 8) -> str:
    """The same by one CTE a level: trees of up to 3^levels documents and 3^groups sources; crc32 by its polynomial."""

    def field_sql(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(field_sql(c) for c in [*COLUMNS[:-1], text]) + ")"

    bits = "list_reduce(range(0, 8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {start})"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda acc, x: {bits.format(start='xor(acc, x)')}, 4294967295::BIGINT), 4294967295)"

    def climb(name: str, base: str, tree: str, height: int) -> list[str]:
        out = [f"{name}0 AS MATERIALIZED ({base})"]
        for t in range(height):
            run = f"SELECT {tree}, j // 3 AS j, max(n) AS n, sha256(string_agg(d, '' ORDER BY j)) AS d FROM {name}{t} WHERE n > {3**t} GROUP BY {tree}, j // 3"
            out.append(f"{name}{t + 1} AS MATERIALIZED ({run})")
        return out

    def walk(name: str, start: str, tree: str, height: int) -> tuple[list[str], str]:
        """Joins of every leaf with its siblings, level by level."""
        ctes, at = [], start
        for t in range(height):
            side = f"(SELECT string_agg(s.d, '' ORDER BY s.j) FROM {name}{t} s WHERE s.{tree} IS NOT DISTINCT FROM w.{tree} AND s.j // 3 = w.k // {3 ** (t + 1)} AND s.j {{op}} w.k // {3**t})"
            sides = f"SELECT w.*, coalesce({side.format(op='<')}, '') AS l, coalesce({side.format(op='>')}, '') AS r FROM {at} w"
            new = f"{name}w{t + 1}"
            ctes.append(f"{new} AS MATERIALIZED (SELECT * EXCLUDE (l, r, proof, acc), CASE WHEN n > {3**t} THEN proof || l || r ELSE proof END AS proof, CASE WHEN n > {3**t} THEN sha256(l || acc || r) ELSE acc END AS acc FROM ({sides}))")
            at = new
        return ctes, at

    up = climb("a", "SELECT tree, k AS j, n, leaf AS d FROM ranked", "tree", levels)
    walk_a, at = walk("a", "started", "tree", levels)
    tops = " UNION ALL ".join(f"SELECT tree, d FROM a{t} WHERE n <= {3**t} AND {'true' if t == 0 else f'n > {3 ** (t - 1)}'}" for t in range(levels + 1))
    up_b = climb("b", "SELECT one, k AS j, n, subroot AS d FROM heads", "one", groups)
    root = " UNION ALL ".join(f"SELECT d FROM b{t} WHERE n <= {3**t} AND {'true' if t == 0 else f'n > {3 ** (t - 1)}'}" for t in range(groups + 1))
    walk_b, end = walk("b", "lifted", "one", groups)
    return f"""
WITH hashed AS (SELECT doc_id, source AS tree, {leaf_sql('text')} AS leaf,
  CASE WHEN ({crc}) % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql('text')} END AS found FROM documents),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{", ".join(up)},
started AS (SELECT *, '' AS proof, found AS acc FROM ranked),
{", ".join(walk_a)},
subroots AS MATERIALIZED ({tops}),
heads AS MATERIALIZED (SELECT 1 AS one, tree, d AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM subroots),
{", ".join(up_b)},
root AS ({root}),
lifted AS (SELECT w.doc_id, w.leaf, w.proof, w.acc, h.one, h.k, h.n, h.subroot FROM {at} w JOIN heads h ON h.tree IS NOT DISTINCT FROM w.tree),
{", ".join(walk_b)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = d AS verified FROM {end}, root"""


OP13_SQL = _sql()
