"""Queries over the address graph and its entities."""

from pyspark.sql import DataFrame, functions as F

from blockloom.functions.columns import newest
from blockloom.operators import entities, graph
from blockloom.operators.tables import insert_ignore
from blockloom.plans import jobs
from blockloom.plans.registry import query
from blockloom.session import stored
from blockloom.sources.fixtures import Fixtures

EDGE = ["src", "dst", "pairs", "weight"]
SAMPLE = 500


def planned(fx: Fixtures) -> jobs.AddressGraph:
    """The same graph for a query of one action: nothing is stored on the way."""
    return jobs.AddressGraph.of(graph.counted_sides(fx.side_rows), keep=False)


def kept(fx: Fixtures) -> jobs.AddressGraph:
    """The same graph, stored, over lines that are stored for other readers, too."""
    return jobs.AddressGraph.of(graph.counted_sides(fx.kept_side_rows), keep=False).stored()


def features(fx: Fixtures) -> DataFrame:
    return kept(fx).with_activity(graph.moments_activity(fx.kept_moments, now(fx)))


def now(fx: Fixtures):
    """Time of the newest pool transaction."""
    return newest(fx.transactions.select((F.timestamp_seconds(F.col("timestamp") + F.col("ok") % 86400)).alias("t")), "t")


def owners(fx: Fixtures, merge: int = 1) -> DataFrame:
    """Stand-in clusters: addresses by (merged) customer number."""
    return fx.owners.select(F.floor(F.col("owner") / merge).cast("string").alias("component"), "address")


def mapping(fx: Fixtures, merge: int = 1) -> DataFrame:
    return entities.address_clusters(owners(fx, merge))


@query("edges_common_input")
def _(fx: Fixtures) -> DataFrame:
    return graph.weighted(planned(fx).edges, F.col("common")).select(*EDGE)


@query("edges_change")
def _(fx: Fixtures) -> DataFrame:
    return graph.weighted(planned(fx).edges, F.col("change")).select(*EDGE)


@query("address_graph")
def _(fx: Fixtures) -> DataFrame:
    return graph.address_graph(planned(fx).edges).select(*EDGE, "types")


@query("graph_degree")
def _(fx: Fixtures) -> DataFrame:
    g = planned(fx)
    return graph.per_address(graph.node_degree(g.edges), g.twins).select("address", "degree")


@query("clustering_coefficient")
def _(fx: Fixtures) -> DataFrame:
    g = planned(fx).stored()
    return graph.per_address(graph.node_features(g.edges), g.twins).select("address", "clustering_coefficient")


@query("avg_neighbor_degree")
def _(fx: Fixtures) -> DataFrame:
    g = planned(fx)
    return graph.per_address(graph.node_neighbor_degree(g.edges, graph.node_degree(g.edges)), g.twins).select(
        "address", "avg_neighbor_degree")


@query("neighbour_degrees")
def _(fx: Fixtures) -> DataFrame:
    """Degrees and mean degrees of neighbours from sets, without the pairs of wide transactions; here those of more than four addresses are wide."""
    return graph.neighbour_degrees(graph.memberships(*fx.kept_sides), 4)


@query("address_activity")
def _(fx: Fixtures) -> DataFrame:
    return graph.activity(fx.tx_inputs, fx.tx_outputs, now(fx))


@query("address_features")
def _(fx: Fixtures) -> DataFrame:
    return features(fx)


@query("density_clusters")
def _(fx: Fixtures) -> DataFrame:
    from blockloom.operators.patterns import standardize

    return graph.density_clusters(standardize(stored(features(fx), "features"), graph.FEATURES))


@query("entity_components")
def _(fx: Fixtures) -> DataFrame:
    return graph.connected_components(graph.input_stars(fx.tx_inputs))


@query("merge_overlaps")
def _(fx: Fixtures) -> DataFrame:
    """Clusters of two rules that overlap, by lowest and by highest customer of an address, merged."""
    ends = fx.customers.groupBy("address").agg(F.min("custkey").alias("low"), F.max("custkey").alias("high"))
    both = ends.select(F.concat(F.lit("low"), "low").alias("component"), "address").unionByName(
        ends.select(F.concat(F.lit("high"), "high").alias("component"), "address"))
    return entities.merge_overlaps(stored(both, "both"))


@query("cluster_id")
def _(fx: Fixtures) -> DataFrame:
    return entities.member_hashes(owners(fx)).select("component", "cluster_id", "cluster_size")


@query("min_size_filter")
def _(fx: Fixtures) -> DataFrame:
    return entities.min_size(owners(fx), 2)


@query("entity_type")
def _(fx: Fixtures) -> DataFrame:
    members = owners(fx).withColumnRenamed("component", "cluster_id")
    return entities.classify_entities(members, fx.tx_inputs, fx.tx_outputs, now(fx))


@query("current_clusters")
def _(fx: Fixtures) -> DataFrame:
    return entities.current_clusters(owners(fx).withColumnRenamed("component", "cluster_id"))


@query("incremental_clusters")
def _(fx: Fixtures) -> DataFrame:
    """Stored clusters cover the addresses of filled orders; all other transactions are new."""
    filled = fx.transactions.where("status = 'F'").select("txid")
    held = fx.kept_sides[1].join(filled, "txid", "left_semi").select("address").distinct()
    known = fx.owners.join(held, "address", "left_semi").select("address", F.col("owner").cast("string").alias("cluster_id"))
    return jobs.run_update(*fx.kept_sides, fx.transactions.where("status <> 'F'").select("txid"), known, now(fx))


@query("cluster_history")
def _(fx: Fixtures) -> DataFrame:
    return entities.cluster_history(mapping(fx), mapping(fx, 2), 2, now(fx))


def degrees(g: jobs.AddressGraph) -> DataFrame:
    return graph.per_address(graph.node_degree(g.edges), g.twins).select("address", "degree")


@query("graph_sample")
def _(fx: Fixtures) -> DataFrame:
    return entities.graph_sample(degrees(planned(fx)), owners(fx).withColumnRenamed("component", "cluster_id"), SAMPLE)


@query("graph_sample_links")
def _(fx: Fixtures) -> DataFrame:
    g = planned(fx)
    top = degrees(g).orderBy(F.desc("degree"), "address").limit(SAMPLE).select("address")
    return graph.expand(graph.address_graph(g.edges), g.twins, top)


@query("clustering_job")
def _(fx: Fixtures) -> DataFrame:
    done = jobs.run_clustering(*fx.kept_sides, now(fx))
    return done.metadata


@query("store_clusters")
def _(fx: Fixtures) -> DataFrame:
    """Metadata rows of a new clustering whose cluster is not stored yet."""
    def metadata(merge: int) -> DataFrame:
        return entities.cluster_ids(owners(fx, merge)).select("cluster_id", "cluster_size")

    return insert_ignore(metadata(1), metadata(2), ["cluster_id"])
