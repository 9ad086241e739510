"""Operator 12, a Merkle manifest of a dataset, with DataFrame functions only.

Every row is a leaf, the SHA-256 of its fields. The leaves of a group ascend by
id; runs of FANOUT nodes become the hash of what they hold, the last run being
as short as it is, until one node, the subroot, remains; the subroots in order
of their groups give the root in the same way.

A block is BLOCK = FANOUT squared ordered nodes in an array; sequence, transform,
slice and aggregate collapse its two levels in place, and its root is a node of
the next round, so a round takes the tree two levels up and the rounds are
log(n) / log(BLOCK). Going down again, each block gets the siblings of its root,
and so each leaf its path. A block is what one task holds at a time, however
large a group is.

Places of rows in their group come from a range partitioning by group, id and
leaf: within a partition rows are numbered as they stand, and a small table of
partitions and groups, joined by both, says how many came before. So a group
that holds most rows is dealt over as many partitions as it needs.

Fields that are null are told apart from empty ones. Rows without a group are a
group, the first. Equal ids are ordered by their leaves, null ids come first;
rows that are alike throughout are leaves of their own. Empty texts are fields
of no bytes; a table without rows gives one without rows. Further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, CRC32_TABLE, checkpointed, table
from .cutting import bound

FANOUT = 16
BLOCK = FANOUT * FANOUT
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings of a node in its run: what stands before it and after it.
_PATH = "array<struct<before:string,after:string>>"


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A field so that no two rows of different fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return hashed(F.concat(*map(field, fields)))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place, their number in their group from 0 on in the order given, written to the shared folder.

    Rows may be alike in all of these columns; which of them comes first follows from where they stand.
    """
    told = rows.withColumn("_stand", F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_stand")]
    numbered = checkpointed(told.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_stand").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = numbered.groupBy(F.col(group).alias("_group"), part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # As many rows as there are partitions and groups.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = checkpointed(counts.select("_group", "_part", (before - F.col("_first")).alias("_offset")))
    both = numbered.withColumn("_part", part).alias("r").join(offsets.alias("o"), F.col(f"r.{group}").eqNullSafe(F.col("o._group")) & (F.col("r._part") == F.col("o._part")))
    return both.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("r._at") + F.col("o._offset")).alias("place"))


def blocks(nodes: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """Blocks (group, block, nodes, up, root) of nodes (group, place, node, payload).

    up is how many levels the block is to be collapsed: two, and fewer where it is all that its group has.
    """
    entry = F.struct("place", "node", *payload)
    held = nodes.groupBy(group, F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("nodes"))
    alone = (F.col("block") == 0) & (F.size("nodes") < BLOCK)
    up = F.when(alone & (F.size("nodes") == 1), 0).when(alone & (F.size("nodes") <= FANOUT), 1).otherwise(2)
    held = held.withColumn("up", up)
    return held.withColumn("root", F.get(F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.transform("nodes", lambda x: x["node"]), lambda level, k: F.when(k <= F.col("up"), collapsed(level)).otherwise(level)), F.lit(0)))


def runs(level: Column) -> Column:
    """An array of nodes as an array of runs."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda k: F.slice(level, k * FANOUT + 1, F.lit(FANOUT)))


def _together(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def collapsed(level: Column) -> Column:
    """The level above an array of nodes."""
    return F.transform(runs(level), lambda run: hashed(_together(run)))


def siblings(level: Column) -> Column:
    """For each node of an array what stands before it and after it in its run."""
    own = lambda run: F.transform(run, lambda _, j: F.struct(_together(F.slice(run, F.lit(1), j)).alias("before"), _together(F.slice(run, j + 2, F.lit(FANOUT))).alias("after")))
    return F.flatten(F.transform(runs(level), own))


def walked(held: DataFrame, finish: Callable[[Column, Column], Column]) -> DataFrame:
    """The entries of blocks() that have above, the path of each block's own root, as told by finish(entry, path); other columns stay.

    Each block is one row until its entries are finished, so that only what finish() gives is multiplied.
    """
    nodes = F.transform("nodes", lambda x: x["node"])

    def told(first: Column, second: Column) -> Column:
        def path(k: Column) -> Column:
            own = F.array(F.get(first, k), F.get(second, F.floor(k / FANOUT).cast("int")))
            return F.concat(F.slice(own, F.lit(1), F.col("up")), F.col("above"))

        return F.transform("nodes", lambda x, k: finish(x, path(k)))

    # bound() holds the siblings of a block: as columns they would be put into the loop over its entries by the optimizer.
    none = F.lit(None).cast(_PATH)
    entries = bound(F.when(F.col("up") > 0, siblings(nodes)).otherwise(none), lambda first: bound(F.when(F.col("up") > 1, siblings(collapsed(nodes))).otherwise(none), lambda second: told(first, second)))
    out = held.withColumn("_out", entries).drop("nodes", "above", "up", "block")
    return out.select("*", F.explode("_out").alias("entry")).drop("_out")


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda own, s: hashed(F.concat(s["before"], own, s["after"])))


def tree(nodes: DataFrame, group: str, payload: list[str]) -> list[DataFrame]:
    """The blocks of nodes (group, place, node) and of each round above, written; the last has one for each group."""
    rounds = [checkpointed(blocks(nodes, group, payload))]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        above = rounds[-1].select(group, F.col("block").alias("place"), F.col("root").alias("node"))
        rounds.append(checkpointed(blocks(above, group, [])))
    return rounds


def descended(rounds: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """The lowest blocks of a tree with above, the path of each; above has that of each group's subroot, and columns that go with it."""
    more = [c for c in above.columns if c not in (group, "above")]
    known = above.withColumn("block", F.lit(0).cast("long"))
    for held in reversed(rounds):
        same = F.col(f"h.{group}").eqNullSafe(F.col(f"k.{group}")) & (F.col("h.block") == F.col("k.block"))
        own = held.drop("root").alias("h").join(known.alias("k"), same).select("h.*", "k.above", *(f"k.{c}" for c in more))
        if held is rounds[0]:
            return own
        known = walked(own, lambda x, path: F.struct(x["place"].alias("block"), path.alias("above"))).select(group, *more, "entry.block", "entry.above")
    raise ValueError("a tree has a round")


def manifest(rows: DataFrame, group: str, payload: list[str], finish: Callable[[Column, Column], Column]) -> DataFrame:
    """finish(entry, path) of every leaf of rows (group, place, node, payload), as the column entry, with subroot and root."""
    rounds = tree(rows, group, payload)
    subroots = rounds[-1].select(group, F.col("root").alias("node"))
    tops = placed(subroots.withColumn("_all", F.lit(0)), "_all", [group])
    over = tree(tops, "_all", [group])
    root = over[-1].select("_all", "root", F.array().cast(_PATH).alias("above"))
    paths = walked(descended(over, "_all", root), lambda x, path: F.struct(x[group].alias(group), x["node"].alias("subroot"), path.alias("above")))
    return walked(descended(rounds, group, paths.select(f"entry.{group}", "entry.subroot", "root", "entry.above")), finish)


def verified(docs: DataFrame, group: str = "source", id_column: str = "doc_id", fields: tuple[str, ...] = FIELDS, text_column: str = "text", tampered: Column | None = None) -> DataFrame:
    """A row for each row of docs: its id, leaf, subroot, root, the hash of its proof, and the root that its tampered leaf folds to.

    tampered says which rows are tampered with (none by default): their text is lower-cased.
    """
    told = docs.select(*(F.col(c) for c in dict.fromkeys([id_column, group, *fields, text_column])))
    lowered = F.translate(text_column, _UPPER, _LOWER)
    changed = leaf([lowered if c == text_column else F.col(c) for c in fields])
    node = leaf([F.col(c) for c in fields])
    rows = checkpointed(told.select(
        F.col(id_column).alias("id"), F.col(group).alias("grp"), node.alias("node"), F.when(F.lit(False) if tampered is None else tampered, changed).alias("now"),
    ))

    def finish(x: Column, path: Column) -> Column:
        proof = _together(F.transform(path, lambda s: F.concat(s["before"], s["after"])))
        return F.struct(x["id"].alias(id_column), x["node"].alias("leaf"), hashed(proof).alias("proof_sha256"), folded(F.coalesce(x["now"], x["node"]), path).alias("folded_root"))

    out = manifest(placed(rows, "grp", ["id", "node"]), "grp", ["id", "now"], finish)
    return out.select(f"entry.{id_column}", "entry.leaf", "subroot", "root", "entry.proof_sha256", "entry.folded_root", (F.col("entry.folded_root") == F.col("root")).alias("verified"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


#: Levels that the SQL unrolls, enough for 16 million rows of a source; the operator has no such bound.
_LEVELS = 6


def _climb(start: str, group: str) -> list[str]:
    """Levels of DuckDB's SQL above the table {start}0 (group, p, node, n)."""
    out = []
    for k in range(_LEVELS):
        out.append(f"""{start}s{k} AS (SELECT {group}, p, n, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f FROM {start}{k} WINDOW run AS (PARTITION BY {group}, p // {FANOUT} ORDER BY p))""")
        out.append(f"{start}{k + 1} AS (SELECT {group}, p // {FANOUT} AS p, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY p)) END AS node, count(*) OVER (PARTITION BY {group}) AS n FROM {start}{k} GROUP BY {group}, p // {FANOUT})")
    return out


def _oracle() -> str:
    told = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    fields = [told(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")]
    node = "sha256(" + " || ".join(fields) + ")"
    joins = [f"JOIN as{k} ON as{k}.source IS NOT DISTINCT FROM l.source AND as{k}.p = l.p // {FANOUT**k}" for k in range(_LEVELS)]
    joins += ["JOIN tops t ON t.source IS NOT DISTINCT FROM l.source", *(f"JOIN bs{k} ON bs{k}.p = t.p // {FANOUT**k}" for k in range(_LEVELS))]
    levels = [f"{x}s{k}" for x in "ab" for k in range(_LEVELS)]
    fold = "now"
    steps = []
    for k, x in enumerate(levels):
        steps.append(f"f{k} AS (SELECT * EXCLUDE (now), CASE WHEN n{k} = 1 THEN {fold} ELSE sha256(b{k} || {fold} || a{k}) END AS now FROM {'paths' if k == 0 else f'f{k - 1}'})")
    paths = ", ".join(f"{x}.n AS n{k}, {x}.b AS b{k}, {x}.f AS a{k}" for k, x in enumerate(levels))
    return f"""WITH crc AS ({CRC32_TABLE}),
d AS (SELECT doc_id, source, {node.format(text='text')} AS leaf, {node.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")} AS changed, coalesce({CRC32_SQL.format('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) AS tampered
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
a0 AS (SELECT source, p, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM l),
{', '.join(_climb('a', 'source'))},
tops AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM a{_LEVELS}),
b0 AS (SELECT 0 AS one, p, node, count(*) OVER () AS n FROM tops),
{', '.join(_climb('b', 'one'))},
paths AS (SELECT l.doc_id, l.leaf, t.node AS subroot, b{_LEVELS}.node AS root, CASE WHEN tampered THEN changed ELSE leaf END AS now, {paths} FROM l {' '.join(joins)} CROSS JOIN b{_LEVELS}),
{', '.join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f'b{k} || a{k}' for k in range(len(levels)))}) AS proof_sha256, now AS folded_root, now = root AS verified FROM f{len(levels) - 1}"""


ORACLE = _oracle()
