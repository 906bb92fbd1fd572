"""A Merkle manifest of a table: lag and lead windows, level by level.

Rows hash to leaves. The leaves of a group (a source) stand in the order of
their ids; runs of 16 consecutive nodes become one node, until one is left,
the group's subroot; subroots, in the order of their groups, do so likewise up to the root.

No group is ever gathered: leaves are numbered by one range sort of the whole
table, so a group that holds a third of it is spread over many tasks. At every
level, lag and lead columns of fixed offsets 1 to 15, masked by a node's slot in its
run and by the run's length, supply its siblings; the row in slot 0 has its
whole run beside it and hashes the parent. Windows are dealt by run, 16 rows at
most. Levels are written to the shared folder, each a sixteenth of the one below.
The way up from a run is written once for the run and joined to its 16 leaves.

Defined results: a null field hashes as ``-``; a null group is a group of its
own, before all others; rows of one id stand in order of their leaf, null ids
first; repeated rows are leaves each; an empty table gives no rows; columns that
are not asked for are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioquery.llm.common import read
from folioquery.llm.periods import crc32_sql
from folioquery.operators.joins import join_small, with_positions
from folioquery.session import materialize

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """Hex sha256 of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in as_text]), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves(row, key, pos, n, h)``, ``ways(key, pos, path, subroot, root)`` of the leaves' runs, and how many leaves."""

    leaves: DataFrame
    ways: DataFrame
    n_leaves: int


def _placed(nodes: DataFrame) -> DataFrame:
    """Adds run, slot and the length of the run; ``nodes`` has key, pos and n."""
    run = F.expr(f"pos div {FANOUT}")
    return nodes.withColumns({"run": run, "slot": F.col("pos") % FANOUT, "size": F.least(F.lit(FANOUT), F.col("n") - FANOUT * run)})


def _row():
    return Window.partitionBy("key", "run").orderBy("pos")


def _left() -> Column:
    """Hashes before a node in its run."""
    return F.concat_ws("", *[F.when(F.col("slot") >= k, F.lag("h", k).over(_row())) for k in range(FANOUT - 1, 0, -1)])


def _right() -> Column:
    """Hashes behind a node in its run."""
    return F.concat_ws("", *[F.when(F.col("slot") + k < F.col("size"), F.lead("h", k).over(_row())) for k in range(1, FANOUT)])


def siblings(nodes: DataFrame) -> DataFrame:
    """Adds run and the hashes to the left and right in a node's run; ``nodes`` has key, pos, n and h."""
    return _placed(nodes).withColumn("left", _left()).withColumn("right", _right()).drop("slot", "size")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of all groups that still have several nodes: first children hash their runs."""
    beside = _placed(nodes.where("n > 1").select("key", "pos", "n", "h")).withColumn("right", _right())
    return beside.where("slot = 0").select(
        "key", F.col("run").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.sha2(F.concat("h", "right"), 256).alias("h"))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and the levels above; ``most`` nodes are in the largest group."""
    levels = [nodes]
    while most > 1:
        levels.append(materialize(parents(levels[-1]), "merkle-level"))
        most = -(-most // FANOUT)
    return levels


def _ways(levels: list[DataFrame], ends: DataFrame) -> list[DataFrame]:
    """(key, pos, path, subroot, root) of the nodes of each level, from the lowest up.

    ``ends(key, path, subroot, root)`` has what follows above the last node of a group. The
    lowest level's ways are not written: the caller joins their runs' ways itself.
    """
    ways: list[DataFrame] = []
    for nodes in reversed(levels):
        at_end = nodes.where("n = 1").select("key", "pos").join(ends, "key")
        if ways:
            up = ways[0].withColumnRenamed("pos", "run")
            own = siblings(nodes.where("n > 1").select("key", "pos", "n", "h")).select("key", "pos", "run", "left", "right")
            at_end = at_end.unionByName(own.join(up, ["key", "run"]).select(
                "key", "pos", F.concat(F.array(F.struct("left", "right")), "path").alias("path"), "subroot", "root"))
        ways.insert(0, materialize(at_end, "merkle-ways"))
    return ways


def build(rows: DataFrame, group: str, order: str, leaf: str) -> Manifest:
    """The manifest of ``rows``: one leaf a row, the column ``leaf`` holding its hash; all columns are carried in the struct ``row``."""
    spark = rows.sparkSession
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(group).alias("_g"),
                         F.col(order).alias("_o"), F.col(leaf).alias("h"), F.monotonically_increasing_id().alias("_at"))
    # Rows alike in group, order and leaf are exchangeable; their place in the scan keeps them from one task.
    placed = with_positions(packed, ["_g", "_o", "h", "_at"], "_global")
    named = placed.select("row", "h", "_global", F.coalesce(F.concat(F.lit("="), F.col("_g").cast("string")), F.lit("-")).alias("_group"))
    groups = materialize(named.groupBy("_group").agg(F.min("_global").alias("key"), F.count("*").alias("n")), "merkle-groups")
    most, n_groups, n_leaves = groups.agg(F.max("n"), F.count("*"), F.sum("n")).first()
    heavy = groups.withColumn("_heavy", F.col("n") * 1000 > (n_leaves or 0))
    leaves = (join_small(named, heavy, "_group", hot="_heavy", spread="_global")
              .select("row", "h", "key", "n", (F.col("_global") - F.col("key")).alias("pos")))
    if not n_leaves:
        none = spark.createDataFrame([], f"key long, pos long, path {PATH}, subroot string, root string")
        return Manifest(leaves, none, 0)
    levels = _levels(leaves, most)
    subroots = levels[0].where("n = 1").select("key", "h")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("key", "h"))
    # A group's key is the place of its first leaf, so keys stand in the order of the groups.
    tops = materialize(with_positions(subroots, ["key"], "pos").select(
        F.lit(0).cast("long").alias("key"), (F.col("pos") - 1).alias("pos"), F.lit(n_groups).cast("long").alias("n"), "h", F.col("key").alias("_group")),
        "merkle-subroots")
    above = _levels(tops, n_groups)
    last = above[-1].select("key", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.lit(None).cast("string").alias("subroot"),
                            F.col("h").alias("root"))
    ends = (_ways(above, last)[0].drop("subroot", "key")
            .join(tops.select("pos", F.col("_group").alias("key"), F.col("h").alias("subroot")), "pos").select("key", "path", "subroot", "root"))
    if len(levels) == 1:
        return Manifest(leaves, leaves.select("key", "pos").join(ends, "key"), n_leaves)
    lone = leaves.where("n = 1").select("key", "pos").join(ends, "key")
    return Manifest(leaves, _ways(levels[1:], ends)[0].unionByName(lone), n_leaves)


def with_proofs(made: Manifest) -> DataFrame:
    """row, leaf, path (siblings left and right of each node on the way up), subroot and root of every leaf."""
    ways = made.ways.withColumnRenamed("pos", "run")
    own = F.when(F.col("n") > 1, F.concat(F.array(F.struct("left", "right")), "path")).otherwise(F.col("path"))
    return siblings(made.leaves).join(ways, ["key", "run"]).select("row", F.col("h").alias("leaf"), own.alias("path"), "subroot", "root")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with null ids are never tampered with."""
    values = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = [F.translate(F.col("text"), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", "source", leaf_hash(values).alias("leaf"), F.when(tampered, leaf_hash(lowered)).alias("_other"))
    proofs = with_proofs(build(rows, "source", "doc_id", "leaf"))
    siblings_of = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    checked = proofs.withColumn("folded_root", folded(F.coalesce("row._other", "leaf")))
    return checked.select("row.doc_id", "leaf", "subroot", "root", F.sha2(siblings_of, 256).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 6) -> str:
    """Up to 16 ** levels rows a source, and as many sources."""
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    up = lambda a, b: f"""{b} AS MATERIALIZED (SELECT key, pos // {FANOUT} AS pos, any_value((n + {FANOUT - 1}) // {FANOUT}) AS n,
    sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {a} WHERE n > 1 GROUP BY key, pos // {FANOUT})"""  # noqa: E731
    beside = lambda a, b: f"""{b} AS MATERIALIZED (SELECT a.key, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {a} a JOIN {a} b ON a.key = b.key AND a.pos // {FANOUT} = b.pos // {FANOUT} WHERE a.n > 1 GROUP BY a.key, a.pos)"""  # noqa: E731
    climb = lambda a, b, s, key: f"""{b} AS MATERIALIZED (SELECT k, grp, CASE WHEN l IS NULL THEN p ELSE p // {FANOUT} END AS p,
    CASE WHEN l IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur, proof || coalesce(l || r, '') AS proof
    FROM {a} LEFT JOIN {s} ON {s}.key = {key} AND {s}.pos = p)"""  # noqa: E731
    parts = [f"""d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {leaf('text')} AS leaf,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, count(*) OVER (PARTITION BY source) AS n FROM documents)""",
             "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
             "s0 AS (SELECT grp AS key, pos, n, leaf AS h FROM e)"]
    parts += [up(f"s{i}", f"s{i + 1}") for i in range(levels)] + [beside(f"s{i}", f"sb{i}") for i in range(levels)]
    ends = " UNION ALL ".join(f"SELECT key, h FROM s{i} WHERE n = 1" for i in range(levels + 1))
    parts += [f"sub AS MATERIALIZED ({ends})", "t0 AS (SELECT 0 AS key, key AS pos, (SELECT count(*) FROM sub) AS n, h FROM sub)"]
    parts += [up(f"t{i}", f"t{i + 1}") for i in range(levels)] + [beside(f"t{i}", f"tb{i}") for i in range(levels)]
    tops = " UNION ALL ".join(f"SELECT h FROM t{i} WHERE n = 1" for i in range(levels + 1))
    parts += ["c0 AS (SELECT k, grp, pos AS p, coalesce(other, leaf) AS cur, '' AS proof FROM e)"]
    parts += [climb(f"c{i}", f"c{i + 1}", f"sb{i}", "grp") for i in range(levels)]
    parts += [f"f0 AS (SELECT k, grp, grp AS p, cur, proof FROM c{levels})"]
    parts += [climb(f"f{i}", f"f{i + 1}", f"tb{i}", "0") for i in range(levels)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = top.h AS verified
FROM e JOIN f{levels} USING (k) JOIN sub ON sub.key = e.grp, ({tops}) top"""


SQL = _sql()
