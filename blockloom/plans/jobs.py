"""Multi-step jobs: block sync and entity clustering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockloom import schemas
from blockloom.functions.columns import AsOf, moment
from blockloom.operators import entities, graph, ledger, patterns
from blockloom.session import cut_lineage, stored
from blockloom.sources import readers, tables


@dataclass
class AddressGraph:
    """The compact graph of a set of transactions with its node features."""

    members: DataFrame
    twins: DataFrame
    edges: DataFrame

    @staticmethod
    def build(inputs: DataFrame, outputs: DataFrame) -> "AddressGraph":
        return AddressGraph.of(graph.memberships(inputs, outputs))

    @staticmethod
    def once(inputs: DataFrame, outputs: DataFrame) -> "AddressGraph":
        """The stored graph of both sides, from one action."""
        return AddressGraph.of(graph.memberships(inputs, outputs), keep=False).stored()

    @staticmethod
    def of(members: DataFrame, keep: bool = True) -> "AddressGraph":
        """``keep`` materialises the signed memberships once; a graph that one action reads shares their deal within its plan and needs no copy."""
        nodes, twins = graph.twin_members(members, keep)
        return AddressGraph(members, twins, graph.twin_edges(nodes))

    def stored(self) -> "AddressGraph":
        """Same graph with edges and twins materialised once, for consumers that read them several times. One action writes both, so they share their deals."""
        ends = {"edges": self.edges, "twins": self.twins}
        tagged = [rows.withColumn("part", F.lit(name)) for name, rows in ends.items()]
        kept = stored(tagged[0].unionByName(tagged[1], allowMissingColumns=True), "graph")
        edges, twins = (kept.where(F.col("part") == name).select(*rows.columns) for name, rows in ends.items())
        return AddressGraph(self.members, twins, edges)

    def features(self, inputs: DataFrame, outputs: DataFrame, as_of: Column) -> DataFrame:
        return self.with_activity(graph.activity(inputs, outputs, as_of))

    def with_activity(self, activity: DataFrame) -> DataFrame:
        return graph.address_features(graph.node_features(self.edges), self.twins, activity)


@dataclass
class Clustering:
    members: DataFrame
    mapping: DataFrame
    metadata: DataFrame


def run_clustering(inputs: DataFrame, outputs: DataFrame, as_of: Column, eps: float | None = None, size: int = 2) -> Clustering:
    """Graph, features, density clusters, overlap merge, size filter, ids and labels in one pass over the tables."""
    features = AddressGraph.once(inputs, outputs).features(inputs, outputs, as_of)
    scaled = patterns.standardize(stored(features, "features"), graph.FEATURES)
    clusters = stored(graph.density_clusters(scaled, eps), "clusters")
    final = entities.min_size(entities.merge_overlaps(clusters), size)
    mapping = stored(entities.address_clusters(final), "mapping")
    labels = entities.classify_entities(mapping, inputs, outputs, as_of)
    metadata = labels.select("cluster_id", "entity_type", "cluster_size", as_of.alias("first_seen"), as_of.alias("last_active"))
    return Clustering(final, mapping, metadata)


def run_update(inputs: DataFrame, outputs: DataFrame, new_txids: DataFrame, mapping: DataFrame, as_of: Column,
               eps: float | None = None, size: int = 2) -> DataFrame:
    """Clusters (component, address) after the transactions ``new_txids`` (column txid) have come in.

    Addresses of these transactions without a cluster are new. All transactions that hold a new address are related, and
    only these are read again. ``size`` new addresses or more are clustered among themselves by density over the related
    graph; fewer are attached to the clusters that they touch. Old and new clusters are merged where they overlap, and
    clusters below ``size`` drop out.
    """
    sides = inputs.select("txid", "address").unionByName(outputs.select("txid", "address"))
    arrived = sides.join(new_txids.select("txid").distinct(), "txid", "left_semi").select("address").distinct()
    fresh = cut_lineage(arrived.join(mapping.select("address"), "address", "left_anti"))
    related = cut_lineage(sides.join(fresh, "address", "left_semi").select("txid").distinct())
    ins, outs = (rows.join(related, "txid", "left_semi") for rows in (inputs, outputs))
    if fresh.count() >= size:
        features = AddressGraph.once(ins, outs).features(ins, outs, as_of).join(fresh, "address", "left_semi")
        found = graph.density_clusters(patterns.standardize(stored(features, "features"), graph.FEATURES), eps)
        old = mapping.select(F.concat(F.lit("old:"), "cluster_id").alias("component"), "address")
        clusters = old.unionByName(found.select(F.concat(F.lit("new:"), "component").alias("component"), "address"))
    else:
        clusters = entities.update_clusters(graph.memberships(ins, outs), mapping)
    return entities.min_size(entities.merge_overlaps(stored(clusters, "clusters")), size)


ADDRESSES = "address string, balance bigint, first_seen bigint, last_seen bigint, date_first_seen timestamp, date_last_seen timestamp"
MAPPING = "address string, cluster_id string, last_updated timestamp"
METADATA = "cluster_id string, entity_type string, cluster_size bigint, first_seen timestamp, last_active timestamp, version int"
HISTORY = "cluster_id string, parent_id string, address string, version int, timestamp timestamp"


class Ledger:
    """Stored ledger: transactions, outputs and spends per synced range, and received totals per address.

    A range is committed by its row in ``synced``, written last; until then its folders are ignored, and the
    next sync of the same start overwrites them. A row in ``cancelled`` takes back the heights from one on of all ranges committed
    before it. Both rows carry a step number, which is also the version of the address table that belongs to them.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base = spark, base.rstrip("/")
        self.addresses = tables.BucketTable(spark, f"{self.base}/addresses", ADDRESSES, ["address"], buckets)

    def synced(self) -> DataFrame:
        """Committed ranges with the last of their heights that still counts: (first, last, step)."""
        ranges = readers.read_table(self.spark, f"{self.base}/synced", "first int, last int, step bigint")
        cancelled = readers.read_table(self.spark, f"{self.base}/cancelled", "height int, step bigint")
        cuts = cancelled.select("height", F.col("step").alias("cut_step"))
        cut = ranges.join(cuts, F.col("step") < F.col("cut_step"), "left").groupBy("first", "last", "step").agg(F.min("height").alias("cut"))
        return cut.select("first", F.least("last", F.col("cut") - 1).alias("last"), "step").where("last >= first")

    def step(self) -> int:
        """Number of the newest committed step, 0 when nothing is stored."""
        logs = [readers.read_table(self.spark, f"{self.base}/{name}", "step bigint").select("step") for name in ("synced", "cancelled")]
        return logs[0].unionByName(logs[1]).agg(F.coalesce(F.max("step"), F.lit(0))).first()[0]

    def latest(self) -> int:
        """Last committed height, -1 when nothing is stored."""
        return self.synced().agg(F.coalesce(F.max("last"), F.lit(-1))).first()[0]

    def table(self, name: str) -> DataFrame:
        """Committed rows of a ledger table."""
        committed = self.synced().select("first", F.col("last").alias("__last"))
        rows = self.spark.read.parquet(f"{self.base}/{name}").join(committed, "first")
        return rows.where(F.col("block_height") <= F.col("__last")).drop("first", "__last")

    def outputs(self) -> DataFrame:
        """Outputs with their spent state applied."""
        return ledger.mark_spent(self.table("outputs"), self.table("spends").drop("block_height"))

    def received(self) -> DataFrame:
        """Received totals per address as of the newest committed step."""
        return self.addresses.read(before=self.step() + 1)

    def sync(self, blocks: DataFrame, end: int | None = None, prices: DataFrame | None = None, redo: int = 0) -> tuple[int, int] | None:
        """Load the unbroken run of heights after the last stored one; returns it, or None when there is none.

        ``redo`` heights at the end are taken back first, if the documents hold the first of them, so that a replaced end of the chain is loaded anew.
        Documents are parsed once into a staging table. The run of heights and the three ledger tables then
        read just the nested columns they need. Pass only documents that may be new (``read_blocks`` can
        select files by time), not the whole archive.
        """
        latest = self.latest()
        if redo and latest >= 0:
            start = max(0, latest - redo + 1)
            if not blocks.where(F.col("height") == start).isEmpty():
                self.retract(start)
                latest = self.latest()
        step = self.step() + 1
        tables.write_keyed(blocks.where(F.col("height") > latest), f"{self.base}/staging", "step", step)
        offered = self.spark.read.schema(schemas.BLOCK).parquet(f"{self.base}/staging/step={step}")
        first, last = ledger.contiguous_heights(offered, latest, end).agg(F.min("height"), F.max("height")).first()
        if first is None:
            return None
        staged = offered.where(F.col("height").between(first, last))
        outputs = ledger.extract_outputs(staged, prices)
        parts = {"transactions": ledger.extract_transactions(staged, prices), "outputs": outputs}
        for name, rows in parts.items():
            tables.write_keyed(tables.by_height(rows), f"{self.base}/{name}", "first", first, "height_bucket")
        tables.write_keyed(ledger.extract_spends(staged, with_height=True), f"{self.base}/spends", "first", first)
        deltas = cut_lineage(ledger.received_delta(outputs))
        self.addresses.merge(deltas, ledger.upsert_addresses, step)
        done = self.spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(step).cast("bigint").alias("step"))
        done.write.mode("overwrite").parquet(f"{self.base}/synced/at={first}")
        return first, last

    def retract(self, height: int) -> int:
        """Take back all committed heights from ``height`` on; returns how many there were.

        Transactions, outputs and spends of these heights no longer count, so outputs that they spent are unspent again. Addresses that
        received in them get totals and times from what is left; those with nothing left go. Only their buckets are written.
        """
        latest = self.latest()
        if latest < height:
            return 0
        step = self.step() + 1
        outputs = self.table("outputs")
        gone = cut_lineage(outputs.where(F.col("block_height") >= height).select("address").distinct())
        asked = gone.select(F.col("address").alias("__gone"))
        same = F.col("address").eqNullSafe(F.col("__gone"))  # outputs without an address have a total, too
        left = outputs.where(F.col("block_height") < height).join(asked, same, "left_semi")
        again = ledger.upsert_addresses(self.spark.createDataFrame([], ADDRESSES), ledger.received_delta(left))
        self.addresses.merge(gone, lambda stored, _: stored.join(asked, same, "left_anti").unionByName(again), step)
        mark = self.spark.range(1).select(F.lit(height).alias("height"), F.lit(step).cast("bigint").alias("step"))
        tables.write_keyed(mark, f"{self.base}/cancelled", "at", step)
        return latest - height + 1


class ClusterStore:
    """Versioned address map, cluster metadata and history; a version writes only the buckets with rows that changed."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base = spark, base.rstrip("/")
        self.mapping = tables.BucketTable(spark, f"{self.base}/address_clusters", MAPPING, ["address"], buckets)
        self.metadata = tables.BucketTable(spark, f"{self.base}/cluster_metadata", METADATA, ["cluster_id"], buckets)

    def history(self) -> DataFrame:
        return readers.read_table(self.spark, f"{self.base}/cluster_history", HISTORY)

    def store(self, mapping: DataFrame, metadata: DataFrame, as_of: AsOf) -> int:
        """Store a clustering as the next version. Known clusters keep their metadata; map rows of clusters
        without metadata are refused. A row of the map that stays as it was keeps its time. The version counts only once the map, written last, is committed."""
        version = (self.mapping.version() or 0) + 1
        old_map, old_meta = self.mapping.read(), self.metadata.read(before=version)
        offered = metadata.withColumn("version", F.lit(version)).select(*[c.split(" ")[0] for c in METADATA.split(", ")])
        fresh = cut_lineage(offered.join(old_meta.select("cluster_id"), "cluster_id", "left_anti"))
        rows = cut_lineage(mapping.select("address", "cluster_id", moment(as_of).alias("last_updated")))
        known = old_meta.select("cluster_id").unionByName(fresh.select("cluster_id"))
        if not rows.join(known, "cluster_id", "left_anti").isEmpty():
            raise ValueError("a cluster of the address map has no metadata")
        self.metadata.merge(fresh, lambda stored, new: stored.unionByName(new), version)
        trail = entities.cluster_history(old_map, rows, version, as_of)
        tables.write_keyed(trail.drop("version"), f"{self.base}/cluster_history", "version", version)
        both = rows.select("address", F.col("cluster_id").alias("new")).join(old_map.select("address", F.col("cluster_id").alias("old")), "address", "full")
        changed = cut_lineage(both.where(~F.col("new").eqNullSafe(F.col("old"))).select("address"))

        def replaced(stored: DataFrame, asked: DataFrame) -> DataFrame:
            return stored.join(asked, "address", "left_anti").unionByName(rows.join(asked, "address", "left_semi"))

        return self.mapping.merge(changed, replaced, version)
