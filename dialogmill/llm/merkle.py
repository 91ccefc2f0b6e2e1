"""A Merkle manifest of a dataset: a digest for each row, each group and the whole, and a proof for each row.

Rows are leaves. The leaves of a group, in order of their ids, are the lowest nodes of its tree; every `fanout` nodes in
a row make a parent, until one node is left, the group's root. The roots of the groups, in order of their names, are the
leaves of one more tree, and its root stands for the dataset. A row's proof is the digests of its siblings on each level
up to that root; with them anybody can fold a row up to the root without the other rows.

* Leaves are hashed where they are read; texts are never shuffled. Ids are put in order by ranges, each row's place is
  its place in its range and the number of rows in the ranges before, so no group is sorted in one task.
* Every level is an equijoin of the nodes with themselves: each node computes the indices of its siblings (index XOR 1
  in binary trees, the other slots of its run otherwise) and meets the nodes that have these. A node has a key of its
  own, its tree and index, so a group with a third of all rows is dealt out like any other.
* Nodes of slot zero, which have met all their siblings, emit the parents. Each level is written before the next.
* Proofs go from the root down: a parent's path joins its own children, fanout rows at most, never all rows below it.

Rows: a null field is `-`, an empty text `0:`. A group may be null and comes first; null ids come first in their group.
Rows that share an id are ordered by their digests; equal rows have a leaf each. An empty table has no rows, no groups and no
root. Further columns are neither read nor hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmill.llm.common import table, written

FANOUT = 8
#: The fields that a document's digest covers, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256, in hex, of the fields: each `-` if null, else its number of bytes, a colon and its value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def siblings(index: Column, fanout: int) -> Column:
    """Indices of the other nodes of a node's run; the last run may have fewer."""
    if fanout == 2:
        return F.array(index.bitwiseXOR(F.lit(1).cast("bigint")))
    slot = F.pmod(index, F.lit(fanout))
    return F.transform(F.filter(F.array(*(F.lit(s).cast("bigint") for s in range(fanout))), lambda s: s != slot), lambda s: index - slot + s)


def placed(rows: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """rows with index, their place in order from 0, and n, the number of rows; within their group if one is named, which gets a number (tree) then.

    Rows lie in ranges of (group, order); a row's place is its place in the range and the rows of the ranges before.
    Groups are numbered by their names, null first, in the same way, as there may be many.
    """
    first = [F.col(group).asc_nulls_first()] if group else []
    by = [*first, *order, F.col("tie__")]
    ranged = rows.withColumn("tie__", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie__")
    ranged = written(ranged.withColumn("at__", F.monotonically_increasing_id()), "merkle-order").withColumn("part__", F.shiftright("at__", 33))
    ranged = ranged.withColumn("group__", F.col(group) if group else F.lit(0))
    # a row for each range and group, so at most as many as there are ranges and groups together
    parts = ranged.groupBy("part__", "group__").agg(F.count("*").alias("rows__"), F.min("at__").alias("first__"))
    whole = W.partitionBy("group__")  # the ranges that a group is in
    before = F.sum("rows__").over(whole.orderBy("part__").rowsBetween(W.unboundedPreceding, -1))
    parts = written(parts.withColumns({"before__": F.coalesce(before, F.lit(0)), "n__": F.sum("rows__").over(whole)}), "merkle-ranges")
    if group:
        names = placed(parts.select(F.col("group__").alias("name__")).distinct(), [F.col("name__").asc_nulls_first()])
        parts = parts.join(names.select("name__", F.col("index").alias("tree")), F.col("group__").eqNullSafe(F.col("name__"))).drop("name__")
    parts = parts.withColumnsRenamed({"part__": "of__", "group__": "in__"}).drop("rows__")
    met = ranged.join(parts, (F.col("part__") == F.col("of__")) & F.col("group__").eqNullSafe(F.col("in__")))
    return met.select(*rows.columns, *(["tree"] if group else []), (F.col("at__") - F.col("first__") + F.col("before__")).alias("index"), F.col("n__").alias("n"))


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels (tree, index, left, right) from the lowest up, with the digests of the siblings on both sides; and roots (tree, level, digest).

    nodes: (tree, index, n, digest). A tree's last node is its root; it has no siblings, and a tree of one leaf no levels.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    at = lambda df, k: df.where("n = 1").select("tree", F.lit(k).alias("level"), "digest")
    roots = at(nodes, 0)
    while most > 1:
        live = nodes.where("n > 1")
        asked = live.withColumn("other", F.explode(siblings(F.col("index"), fanout)))
        found = live.select("tree", F.col("index").alias("other"), F.col("digest").alias("sibling"))
        met = asked.join(found, ["tree", "other"], "left").groupBy("tree", "index", "n", "digest")
        run = met.agg(F.array_sort(F.collect_list(F.when(F.col("sibling").isNotNull(), F.struct("other", "sibling")))).alias("run"))
        side = lambda keep: F.array_join(F.transform(F.filter("run", lambda x: keep(x["other"])), lambda x: x["sibling"]), "")
        level = run.select("tree", "index", "n", "digest", side(lambda o: o < F.col("index")).alias("left"), side(lambda o: o > F.col("index")).alias("right"))
        level = written(level, "merkle-level")
        levels.append(level.select("tree", "index", "left", "right"))
        first = level.where(F.pmod("index", F.lit(fanout)) == 0)
        nodes = first.select("tree", F.expr(f"index div {fanout}").alias("index"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(F.concat("left", "digest", "right"), 256).alias("digest"))
        roots = roots.unionByName(at(nodes, len(levels)))
        most = -(-most // fanout)
    return levels, written(roots, "merkle-roots")


def descend(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """leaves (tree, index, ...) with path, an array of (left, right) from the leaf's level up, and all columns of roots (tree, level, path, ...).

    The path of a root goes on to all nodes below it, level by level.
    """
    at = lambda k: roots.where(F.col("level") == k).drop("level").withColumn("parent", F.lit(0).cast("bigint"))
    own = F.array(F.struct("left", "right"))
    above = at(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        nodes = levels[k].withColumn("parent", F.expr(f"index div {fanout}")).join(above, ["tree", "parent"]).drop("parent").withColumnRenamed("index", "parent")
        above = nodes.withColumn("path", F.concat(own, "path")).drop("left", "right").unionByName(at(k))
    if levels:
        above = above.unionByName(at(0))
        leaves = leaves.join(levels[0], ["tree", "index"], "left")
    else:
        leaves = leaves.withColumns({"left": F.lit(None).cast("string"), "right": F.lit(None).cast("string")})
    met = leaves.withColumn("parent", F.expr(f"index div {fanout}")).join(above, ["tree", "parent"])
    return met.withColumn("path", F.when(F.col("left").isNotNull(), F.concat(own, "path")).otherwise(F.col("path"))).drop("left", "right", "parent")


def manifest(leaves: DataFrame, group: str, *order: str, fanout: int = FANOUT) -> DataFrame:
    """leaves with subroot, root and path: the siblings (left, right) of each level, of the row's group and then of the groups.

    leaves has the row's digest in the column leaf; order are the columns that order a group's rows.
    """
    rows = written(placed(written(leaves, "merkle-leaves"), [*(F.col(c).asc_nulls_first() for c in order), F.col("leaf")], group), "merkle-rows")
    levels, subroots = climb(rows.select("tree", "index", "n", F.col("leaf").alias("digest")), fanout)
    # the groups' roots are the leaves of one more tree
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.lit(subroots.count()).alias("n"), "digest", "level")
    upper, root = climb(tops.drop("level"), fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = root.select("tree", "level", F.col("digest").alias("root"), none.alias("path"))
    tops = descend(tops.withColumnsRenamed({"digest": "subroot", "level": "own__"}), upper, root, fanout)
    tops = written(tops.select(F.col("index").alias("tree"), F.col("own__").alias("level"), "subroot", "root", "path"), "merkle-tops")
    return descend(rows, levels, tops, fanout).drop("tree", "index", "n")


def proof_text(path: Column) -> Column:
    """The digests of a path in order of levels, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def document_leaves(docs: DataFrame, fields: list[str] = FIELDS, **changed: Column) -> Column:
    return leaf_digest({c: changed.get(c, docs[c]) for c in fields})


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", capital, small)).otherwise(F.col("text"))
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", document_leaves(docs).alias("leaf"), document_leaves(docs, text=text).alias("found"))
    rows = manifest(leaves, "lang", "doc_id").withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8, tops: int = 4) -> str:
    """DuckDB's way: a common table for each level, for groups of up to 8**levels rows and 8**tops groups."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(part(text if c == "text" else c) for c in FIELDS) + "))"
    crc = (
        "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),"
        " lambda r, b: list_reduce(list_concat([xor(r, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    )
    lowered = leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    tables = [
        f"docs AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {lowered} ELSE {leaf('text')} END AS found FROM documents)",
        "f0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, found AS cur, '' AS proof FROM docs)",
        "v0 AS (SELECT lang AS tree, place AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS d FROM f0)",
    ]

    def climbed(k: int) -> list[str]:
        run = "string_agg(d, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN {})"
        return [
            f"s{k} AS (SELECT tree, i, coalesce({run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l, coalesce({run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM v{k} WHERE n > 1)",
            f"v{k + 1} AS (SELECT tree, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM v{k} WHERE n > 1 GROUP BY tree, i // 8, (n + 7) // 8 UNION ALL SELECT * FROM v{k} WHERE n = 1)",
            f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.l IS NULL THEN cur ELSE sha256(concat(s.l, cur, s.r)) END AS cur, concat(proof, s.l, s.r) AS proof, place // 8 AS place) FROM f{k} f LEFT JOIN s{k} s ON f.lang IS NOT DISTINCT FROM s.tree AND f.place = s.i)",
        ]

    for k in range(levels):
        tables += climbed(k)
    up = levels + 1
    tables += [
        f"subs AS (SELECT tree AS name, d AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM v{levels})",
        f"v{up} AS (SELECT 'all' AS tree, i, n, subroot AS d FROM subs)",
        f"f{up} AS (SELECT f.* REPLACE ('all' AS lang, s.i AS place), s.subroot FROM f{levels} f JOIN subs s ON f.lang IS NOT DISTINCT FROM s.name)",
    ]
    for k in range(up, up + tops):
        tables += climbed(k)
    end = up + tops
    return "WITH " + ",\n".join(tables) + f"\nSELECT doc_id, leaf, subroot, v.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = v.d AS verified FROM f{end} f, v{end} v"


OP13_SQL = _sql()
