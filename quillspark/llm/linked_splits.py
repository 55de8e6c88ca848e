"""Problem 3: splits that keep all records of one linked entity together.

Accounts are nodes, aliases are edges. Components come from hooking to the least neighbour with pointer
jumping; each round contracts the edge table, which is written to the shared folder, so a lost executor
re-reads files.

The state is persisted at a path of the caller's, in two tables of changes: ``nodes`` (node, component) and
``components`` (component, split, status, n, into), one folder a version. ``advance`` takes a batch of records
and links: it looks up only the batch's nodes, contracts them to the components they have, merges among
these, and writes the rows that change as the next version; a batch that fails is written again under
the same number. An existing component keeps its split, new ones fill what the splits lack, and a
component that joins existing ones of different splits is quarantined. ``load`` reads the latest rows.

Large new components (at least ``LARGE`` of all rows, so at most 1/LARGE of them) are placed one by one,
largest first, each into the split that lacks most; all others by a hash of their id in proportion to
what is then lacking. No window over the whole table, nothing unbounded on the driver.

Defined cases: a record without a usable address is an entity of its own; repeated rows count once; a
null partition, or one of unknown name, counts in no split; an empty table gives no rows; a batch without
rows changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
LARGE = 1 / 1000
QUARANTINE = "quarantine"
NODES = "node string, component string, version int"
COMPONENTS = "component string, split string, status string, n long, into string, version int"


def account(url: Column) -> Column:
    """The account an address names: ``n:<number>`` or ``i:<name>``, else null. Scheme, host, letter
    case, percent codes, white space, and whatever follows the account do not matter."""
    path = F.regexp_replace(F.trim(url), "^[A-Za-z]+://[^/]*/+", "")
    kind = F.lower(F.regexp_extract(path, "^([A-Za-z]+)/+", 1))
    raw = F.regexp_extract(path, "^[A-Za-z]+/+([^/?#\\s]+)", 1)
    name = F.lower(F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(raw, "\\+", "%2B")), raw)))
    return F.when((kind == "profiles") & (name != ""), F.concat(F.lit("n:"), name)).when(
        (kind == "id") & (name != ""), F.concat(F.lit("i:"), name)
    )


def partition_name(p: Column) -> Column:
    """training, test or extra, whatever the spelling; else null."""
    p = F.lower(F.trim(p))
    return F.when(p.isin("training", "train"), "training").when(p.isin("test", "extra"), p)


def alias_edges(aliases: DataFrame) -> DataFrame:
    return aliases.select(
        F.concat(F.lit("n:"), F.lower(F.trim("account_number"))).alias("a"),
        F.concat(F.lit("i:"), F.lower(F.trim("account_name"))).alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b) to another; the component is its least node."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("p"))
        parent = cut(hook)
        for _ in range(2):  # pointer jumping: p becomes the parent's parent
            up = parent.select(F.col("v").alias("w"), F.col("p").alias("pp"))
            parent = parent.join(up, parent["p"] == up["w"], "left").select("v", F.coalesce("pp", "p").alias("p"))
        parent = cut(parent)
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("v").alias("w"), F.col("p").alias("pp"))
            labels = cut(labels.join(up, labels["p"] == up["w"], "left").select("v", F.coalesce("pp", "p").alias("p")))
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("x")), parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        edges = cut(
            edges.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if edges.isEmpty():
            return labels.select(F.col("v").alias("node"), F.col("p").alias("component"))


def with_component(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """``nodes`` with ``component``; a node without edges is its own."""
    c = comps.withColumnRenamed("node", "_n")
    return nodes.join(c, nodes["node"] == c["_n"], "left").withColumn("component", F.coalesce("component", "node")).drop("_n")


def _versions(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One of the tables of changes; empty if it has not been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _latest(spark: SparkSession, path: str, below: int) -> tuple[DataFrame, DataFrame]:
    nodes = _versions(spark, path, "nodes", NODES).where(F.col("version") < below)
    comps = _versions(spark, path, "components", COMPONENTS).where(F.col("version") < below)
    nodes = nodes.groupBy("node").agg(F.max_by("component", "version").alias("component"))
    comps = comps.groupBy("component").agg(F.max_by(F.struct("split", "status", "n", "into"), "version").alias("x")).select("component", "x.*")
    return nodes, comps


def load(spark: SparkSession, path: str, below: int = 1 << 30) -> DataFrame:
    """(node, component, split, status) after the versions below ``below``."""
    nodes, comps = _latest(spark, path, below)
    top = comps.where("into is null").select(F.col("component").alias("top"), "split", "status")
    where = comps.select("component", F.coalesce("into", "component").alias("top"))
    return nodes.join(where, "component").select("node", "top").join(top, "top").select("node", F.col("top").alias("component"), "split", "status")


def advance(records: DataFrame, edges: DataFrame, path: str, proportions: dict[str, float] | None = None, seed: str = "s") -> int:
    """Take a batch into the state at ``path``: ``records(node, n)``, the new records of each node, and
    ``edges(a, b)``, the new links. Returns the number of the version written."""
    spark = records.sparkSession
    last = _versions(spark, path, "components", COMPONENTS).agg(F.max("version")).first()[0] or 0
    version = last + 1
    nodes, comps = _latest(spark, path, version)
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    batch = records.where("node is not null").select("node", F.col("n").cast("long").alias("n"))
    batch = batch.union(edges.select("a", F.lit(0).cast("long"))).union(edges.select("b", F.lit(0).cast("long"))).groupBy("node").agg(F.sum("n").alias("n"))
    into = comps.select("component", F.coalesce("into", "component").alias("old"))
    known = nodes.join(batch.select("node"), "node", "left_semi").join(into, "component").select("node", "old")
    touched = cut(batch.join(known, "node", "left").select("node", "n", "old", F.coalesce("old", "node").alias("rep")))
    rep = lambda side: touched.select(F.col("node").alias(side), F.col("rep").alias(f"r{side}"))
    links = edges.join(rep("a"), "a").join(rep("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = components(links).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    reps = touched.groupBy("rep").agg(F.sum("n").alias("added"), F.max(F.col("old").isNotNull()).alias("is_old"))
    reps = reps.join(merged, "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))
    had = comps.select(F.col("component").alias("rep"), F.col("split").alias("was"), F.col("n").alias("had"))
    reps = cut(reps.join(had, "rep", "left"))
    per = reps.groupBy("grp").agg(
        F.coalesce(F.min(F.when(F.col("is_old"), F.col("rep"))), F.min("rep")).alias("component"),
        (F.sum("added") + F.coalesce(F.sum("had"), F.lit(0))).alias("n"),
        F.min("was").alias("lo"),
        F.max("was").alias("hi"),
    )
    per = cut(per.select("grp", "component", "n", F.when(F.col("lo") != F.col("hi"), F.lit(QUARANTINE)).otherwise(F.col("lo")).alias("split")))
    names = reps.join(per.select("grp", "component"), "grp").select("rep", "component")
    gone = cut(names.where("rep <> component").select(F.col("rep").alias("old"), F.col("component").alias("into")))
    rest = comps.where("into is null").join(reps.select(F.col("rep").alias("component")), "component", "left_anti")
    placed = _placed(per.select("component", "n", "split"), rest.select("n", "split"), proportions or PROPORTIONS, seed)
    status = F.when(F.col("split") == QUARANTINE, "conflict").otherwise("ok")
    rows = placed.select("component", "split", status.alias("status"), "n", F.lit(None).cast("string").alias("into"))
    lost = lambda c, d: d.select(F.col(c).alias("component"), F.lit(None).cast("string"), F.lit("merged"), F.lit(0).cast("long"), "into")
    # what had merged before into a component that merges now is pointed at the new one
    again = comps.where("into is not null").select("component", F.col("into").alias("old")).join(gone, "old").select("component", "into")
    was = touched.where("old is not null").select(F.col("old").alias("rep")).distinct()
    rows = rows.union(lost("old", gone.join(was.select(F.col("rep").alias("old")), "old", "left_semi"))).union(lost("component", again))
    fresh = touched.where("old is null").select("node", "rep").join(names, "rep").select("node", "component")
    fresh.write.mode("overwrite").parquet(f"{path}/nodes/version={version}")
    rows.write.mode("overwrite").parquet(f"{path}/components/version={version}")
    return version


def _placed(per: DataFrame, rest: DataFrame, proportions: dict[str, float], seed: str) -> DataFrame:
    """``per(component, n, split)`` with the null splits filled by what the splits lack; ``rest(n, split)``
    are all other components."""
    spark = per.sparkSession
    every = per.select("n", "split").union(rest.select("n", "split"))
    held = {r["split"]: r["n"] for r in every.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    total = sum(v for k, v in held.items() if k != QUARANTINE)
    lack = {s: share * total - held.get(s, 0) for s, share in proportions.items()}
    large = per.where(F.col("split").isNull() & (F.col("n") >= max(2, total * LARGE))).orderBy(F.desc("n"), "component").collect()
    fixed = []
    for r in large:
        s = max(sorted(lack), key=lack.get)
        lack[s] -= r["n"]
        fixed.append((r["component"], s))
    left = sum(max(0.0, v) for v in lack.values())
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("component"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    pick, edge = F.lit(max(sorted(proportions), key=proportions.get)), 0.0
    bounds = []
    for s in proportions:
        edge += max(0.0, lack[s]) / left if left else proportions[s]
        bounds.append((edge, s))
    for edge, s in reversed(bounds):
        pick = F.when(u < edge, s).otherwise(pick)
    some = spark.createDataFrame(fixed, "component string, fixed string")
    return per.join(F.broadcast(some), "component", "left").select("component", "n", F.coalesce("split", "fixed", pick).alias("split"))


def in_several_partitions(records: DataFrame, comps: DataFrame) -> DataFrame:
    """Ids of ``records(id, node, part)`` whose component has records in two or more partitions. The
    partitions are bits that are joined before the shuffle, so a hot author costs one row a task."""
    r = records.where(F.col("node").isNotNull() & F.col("part").isNotNull())
    bit = F.when(F.col("part") == "training", 1).when(F.col("part") == "test", 2).otherwise(4)
    per_node = r.groupBy("node").agg(F.bit_or(bit).alias("bits"))
    nodes = with_component(per_node, comps)
    several = nodes.groupBy("component").agg(F.bit_or("bits").alias("bits")).where(F.bit_count("bits") >= 2)
    hot = nodes.join(several.select("component"), "component", "left_semi").select("node")
    return r.join(hot, "node", "left_semi").select("id").distinct()
