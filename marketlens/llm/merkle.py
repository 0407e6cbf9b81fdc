"""Merkle manifest of a table of documents: a tree of hashes per source and one over the sources.

H is SHA-256 as lowercase hexadecimal text. A leaf is H of the columns doc_id, source, lang,
n_chars and text, each `-` if null and otherwise its number of UTF-8 bytes, a colon and its value.
Within a source leaves ascend by doc_id; every ARITY nodes in a row become their H until one is
left. The roots of the sources, ordered by source, form one more tree.

The built levels are stored as parent-linked rows. A row holds up to ARITY ** STEP nodes in a row
of one level, the levels above them in between, and the place of the node that they become. A
recursive query of Spark ascends from every leaf along these links: a round of it appends the
siblings of STEP levels and folds the leaf's hash with them. Nothing but one root goes through the
driver, and no task sees a whole source.
"""

from functools import reduce

from marketlens.llm.ranks import ranked
from marketlens.llm.runtime import stored
from pyspark.sql import functions as F

ARITY = 3
#: Levels that a stored row spans and a round of the recursive query ascends.
STEP = 3
#: The tree over the sources.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf_hash(*columns):
    """H of columns, as in a leaf."""
    parts = []
    for c in columns:
        value = c.cast("string")
        known = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(known, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined_hash(digests):
    return F.sha2(F.array_join(digests, ""), 256)


def _level_above(nodes):
    firsts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(firsts, lambda i: _joined_hash(F.slice(nodes, i * ARITY + 1, ARITY)))


def _rows_above(nodes, level):
    """From nodes (tree, place, digest, n) of a level, n being the tree's there, the stored rows.

    `levels` holds the node lists to ascend, the lowest one first; `digest` is what they become.
    A row that holds all nodes of its tree stops at the first level with a single node.
    """
    width = ARITY**STEP
    rows = (
        nodes.groupBy("tree", F.floor(F.col("place") / width).alias("run"), "n")
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"].alias("_0"))
        .withColumn("is_top", F.col("n") <= width)
    )
    for i in range(STEP):
        rows = rows.withColumn(f"_{i + 1}", _level_above(F.col(f"_{i}")))
    built = F.array(*[F.col(f"_{i}") for i in range(STEP + 1)])
    high = F.filter(built, lambda nodes: F.size(nodes) > 1)
    alone = F.filter(built, lambda nodes: F.size(nodes) == 1)
    return rows.select(
        "tree",
        F.lit(level).alias("level"),
        "run",
        "n",
        "is_top",
        F.when(F.col("is_top"), high).otherwise(F.slice(built, 1, STEP)).alias("levels"),
        F.when(F.col("is_top"), F.get(F.get(alone, F.lit(0)), F.lit(0)))
        .otherwise(F.get(F.col(f"_{STEP}"), F.lit(0)))
        .alias("digest"),
    )


def build_trees(nodes, name):
    """All rows of the trees over leaves (tree, place, digest, n); `n` counts those of the tree.

    One stored table per STEP levels; the number of these follows from the largest tree.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    tables, level = [], 0
    while level == 0 or largest > 1:
        tables.append(stored(_rows_above(nodes, level), f"{name}-{level}"))
        width = ARITY**STEP
        nodes = (
            tables[-1]
            .filter("NOT is_top")
            .select("tree", F.col("run").alias("place"), "digest", F.ceil(F.col("n") / width).alias("n"))
        )
        largest, level = (largest + width - 1) // width if largest > width else 1, level + 1
    return reduce(lambda a, b: a.unionByName(b), tables)


def _linked(rows, parent_of_top):
    """Rows with the place of the node that each becomes; null above the last."""
    tree, level, place = parent_of_top
    top = F.col("is_top")
    return rows.select(
        "tree",
        "level",
        "run",
        "levels",
        F.when(top, tree).otherwise(F.col("tree")).alias("parent_tree"),
        F.when(top, level).otherwise(F.col("level") + 1).alias("parent_level"),
        F.when(top, place).otherwise(F.col("run")).alias("parent_place"),
    )


# `place` is that of the node in its level, p that in the list of nodes at hand. A run of ARITY
# nodes begins at p - p % ARITY; what lies before and after p in it are the siblings.
_CLIMB = """
WITH RECURSIVE climb (row_no, round, tree, level, place, siblings, folded) AS (
    SELECT row_no, 0, tree, 0, place, unhex(''), start FROM {leaves}
    UNION ALL
    SELECT row_no, round + 1, parent_tree, parent_level, parent_place, unhex(way.s), way.f FROM (
        SELECT c.row_no, c.round, r.parent_tree, r.parent_level, r.parent_place,
               aggregate(
                   r.levels,
                   named_struct('p', CAST(c.place % {width} AS INT), 'f', c.folded, 's', ''),
                   (a, nodes) -> named_struct(
                       'p', CAST(a.p div {arity} AS INT),
                       'f', sha2(concat(
                           array_join(slice(nodes, a.p - a.p % {arity} + 1, a.p % {arity}), ''),
                           a.f,
                           array_join(slice(nodes, a.p + 2, {arity} - 1 - a.p % {arity}), '')), 256),
                       's', concat(a.s,
                           array_join(slice(nodes, a.p - a.p % {arity} + 1, a.p % {arity}), ''),
                           array_join(slice(nodes, a.p + 2, {arity} - 1 - a.p % {arity}), '')))
               ) AS way
        FROM climb c JOIN {rows} r
        ON r.tree = c.tree AND r.level = c.level AND r.run = c.place div {width}
    )
)
SELECT * FROM climb
"""


def _climbed(leaves, rows):
    """Per row_no of `leaves` (row_no, tree, place, start): its siblings' hash and the folded root."""
    spark = leaves.sparkSession
    text = _CLIMB.format(leaves="{leaves}", rows="{rows}", width=ARITY**STEP, arity=ARITY)
    before = spark.conf.get(_ROW_LIMIT, None)
    # The limit guards against endless recursion; this one ends with the parents.
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        rounds = spark.sql(text, leaves=leaves, rows=rows)
        siblings = F.array_sort(F.collect_list(F.struct("round", "siblings")))
        whole = F.aggregate(
            siblings, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["siblings"])
        )
        return stored(
            rounds.groupBy("row_no").agg(
                F.sha2(F.lower(F.hex(whole)).cast("binary"), 256).alias("proof_sha256"),
                F.max_by("folded", "round").alias("folded_root"),
            ),
            "merkle-climb",
        )
    finally:
        if before is None:
            spark.conf.unset(_ROW_LIMIT)
        else:
            spark.conf.set(_ROW_LIMIT, before)


def manifest(docs, tampered, names=COLUMNS):
    """Per row: its leaf, its source's root, the root, its proof and what a tampered text leads to.

    `tampered` is a function of the id and the text column that gives the text to verify; `names`
    are the columns of a leaf, the first one the id, the second one the source, the last one the
    text. Returned are doc_id, leaf, subroot, root and proof_sha256 (H of the siblings from the
    leaf to the root, in order) of the texts as they are, folded_root (the tampered leaf folded
    with these siblings) and verified (whether it is the root).

    A null source is a source of its own and comes first; rows without id come first in their
    source, rows that share an id are ordered by their leaves. Repeated rows are leaves of their
    own. An empty text is hashed as such. Other columns are ignored; an empty table gives no rows.
    """
    doc_id, source, *others, text = [F.col(f"`{name}`") for name in names]
    leaves = docs.select(
        doc_id.alias("doc_id"),
        source.alias("source"),
        leaf_hash(doc_id, source, *others, text).alias("leaf"),
        leaf_hash(doc_id, source, *others, tampered(doc_id, text)).alias("start"),
    )
    placed = ranked(leaves, ["source"], ["doc_id", "leaf"], "merkle-leaves")
    sources = ranked(
        placed.groupBy("source").agg(F.count(F.lit(1)).alias("n")), [], ["source"], "merkle-sources"
    ).select(F.col("source").alias("_source"), F.col("place").alias("tree"), "group_rows")
    placed = stored(
        placed.join(sources.drop("group_rows"), F.col("source").eqNullSafe(F.col("_source"))).select(
            "row_no", "doc_id", "leaf", "start", "tree", "place", F.col("group_rows").alias("n")
        ),
        "merkle-placed",
    )
    trees = build_trees(placed.select("tree", "place", F.col("leaf").alias("digest"), "n"), "merkle")
    subroots = trees.filter("is_top").select("tree", F.col("digest").alias("subroot"))
    over = sources.join(subroots, "tree").select(
        F.lit(TOP).cast("long").alias("tree"),
        F.col("tree").alias("place"),
        F.col("subroot").alias("digest"),
        F.col("group_rows").alias("n"),
    )
    top = build_trees(over, "merkle-top")
    root = top.filter("is_top").select("digest").first()
    missing = F.lit(None)
    linked = _linked(trees, (F.lit(TOP), F.lit(0), F.col("tree"))).unionByName(
        _linked(top, (missing.cast("long"), missing.cast("int"), missing.cast("long")))
    )
    ends = _climbed(placed.select("row_no", "tree", "place", "start"), stored(linked, "merkle-rows"))
    return (
        placed.join(ends, "row_no")
        .join(subroots, "tree")
        .withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


def without_line_breaks(doc_id, text):
    """The text with its line breaks deleted if 2 divides crc32 of the id as text; else as it is."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
