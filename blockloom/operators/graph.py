"""Address graph: compact edges, degree features, connected components and density clusters.

The graph links every pair of input addresses of a transaction, and every input address with every output
that is not the largest. Written out, those pairs grow with the square of a transaction. Three things keep
that away from the cluster:

* ``memberships`` reduces a transaction to one row per address with its row counts. The weight of a pair in a
  transaction is a product of those counts, so repeated rows never multiply.
* ``twin_members`` folds addresses with identical memberships into one node with a size. Twins have the same
  neighbours and weights, so nothing is lost, and the thousands of one-time addresses of a bulk transaction
  become a single node.
* ``twin_edges`` spreads a transaction that still has many nodes over blocks of node pairs.

Entities need only connectivity; ``input_stars`` gives that with a linear number of edges.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockloom.operators.nearest import nearest_gaps
from blockloom.session import cut_lineage, stored

# Edge weights in tenths.
COMMON_TENTHS = 10
CHANGE_TENTHS = 7
BLOCK_NODES = 1024
NODE = ["node", "size", "ins", "changes", "held", "mask"]
# Points of a box up to which the pairs of two boxes are compared one by one.
LEAF_POINTS = 64


# ---- edges ------------------------------------------------------------------


def memberships(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per (transaction, address): input rows and change rows. Transactions that cannot give an edge
    (no input, or a single address) drop out.

    Change rows are the outputs other than the largest (the first one on a tie) of transactions with more than
    one output.
    """
    rows = outputs.select("txid", "address", F.lit(0).alias("i"), "sats", "vout").unionByName(
        inputs.select("txid", "address", F.lit(1).alias("i")), allowMissingColumns=True)
    return counted_sides(rows)


def counted_sides(rows: DataFrame) -> DataFrame:
    """``memberships`` from the rows of both sides: (txid, address, i, sats, vout), with i = 1 and neither amount nor position for an input.

    Amount and position form one number, so the largest output of a transaction is a plain maximum. Rows are dealt by transaction once; the counts of
    addresses and the facts of the transaction need no other shuffle.
    """
    place = (F.col("sats").cast("decimal(18,0)") * F.lit(10**10).cast("decimal(11,0)") - F.col("vout")).cast("decimal(32,0)")
    per = rows.where("txid IS NOT NULL").repartition("txid").withColumn("o", place).groupBy("txid", "address").agg(
        F.sum("i").alias("ins"), F.count("o").alias("outs"), F.max("o").alias("best"))
    of_tx = Window.partitionBy("txid")
    single = F.when((F.col("ins") == 0) & (F.col("outs") == 1), F.col("best"))
    facts = per.select(
        "*", F.sum("ins").over(of_tx).alias("all_ins"), F.sum("outs").over(of_tx).alias("all_outs"), F.count("*").over(of_tx).alias("all_addresses"),
        F.count(F.when(F.col("ins") > 0, 1)).over(of_tx).alias("senders"), F.max("best").over(of_tx).alias("top"),
        F.max(single).over(of_tx).alias("top_single"))
    only_top = F.when(F.col("top") == F.col("top_single"), 1).otherwise(0)
    members = F.when(F.col("all_outs") > 1, F.col("all_addresses") - only_top).otherwise(F.col("senders"))
    largest = F.when(F.col("best") == F.col("top"), 1).otherwise(0)
    changes = F.when(F.col("all_outs") > 1, F.col("outs") - largest).otherwise(0)
    return facts.where("all_ins > 0").where(members > 1).withColumn("changes", changes).where("ins + changes > 0").select("txid", "address", "ins", "changes")


def signed_members(members: DataFrame) -> DataFrame:
    """Memberships with what is known of their address: the number of its memberships (``held``), whether this is the one of its smallest
    transaction (``first``), and, if there are several, an order-free 128-bit fingerprint (``s1``, ``s2``) and a 64-bit ``mask`` with a bit for each transaction."""
    of_address = Window.partitionBy("address")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(txid), 64) AS int))")
    facts = members.where("address IS NOT NULL").repartition("address").select(
        "*", F.count("*").over(of_address).alias("held"), (F.col("txid") == F.min("txid").over(of_address)).alias("first"),
        F.bit_xor(F.xxhash64("txid", "ins", "changes")).over(of_address).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "changes", "ins", "txid")).over(of_address).alias("s2"), F.bit_or(bit).over(of_address).alias("mask"))
    several = F.col("held") > 1
    return facts.withColumns({name: F.when(several, F.col(name)) for name in ("s1", "s2", "mask")})


def twin_members(members: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fold twins: ``(nodes, twins)`` with nodes = (txid, node, size, ins, changes, held, mask) and twins = (address, node).

    A node is named by its smallest address. Twins share all their transactions, so the name and size are
    already complete inside any one of them: those of a single transaction are told by it alone, others by their fingerprint. Signed rows are
    dealt by transaction once, for nodes, twins and edges. ``keep`` materialises them, for nodes and twins that are read by several actions.
    """
    signed = signed_members(members)
    dealt = (stored(signed, "signed") if keep else signed).repartition("txid")
    same = ["txid", "held", "s1", "s2", "mask", "ins", "changes"]
    # ``first`` is the same for twins; as a key it keeps the deal equal for nodes and twins, which then share it.
    nodes = dealt.groupBy(*same, "first").agg(F.min("address").alias("node"), F.count("*").alias("size"))
    twins = dealt.withColumn("node", F.min("address").over(Window.partitionBy(*same))).where("first").select("address", "node")
    return nodes.select("txid", *NODE), twins


def _node_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of nodes of a transaction, a node of several addresses with itself included."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in NODE])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in NODE])
    met = a.join(b, keys).where("a_node < b_node OR (a_node = b_node AND a_size > 1)")
    # A shared bit that stands for one transaction of either node: they meet in no other.
    apart = F.expr("a_held = 1 OR b_held = 1 OR (bit_count(a_mask & b_mask) = 1 AND (bit_count(a_mask) = a_held OR bit_count(b_mask) = b_held))")
    return met.select(
        F.col("a_node").alias("src"), F.col("b_node").alias("dst"), F.col("a_size").alias("src_size"), F.col("b_size").alias("dst_size"),
        (COMMON_TENTHS * F.col("a_ins") * F.col("b_ins")).alias("common"),
        (CHANGE_TENTHS * (F.col("a_ins") * F.col("b_changes") + F.col("b_ins") * F.col("a_changes"))).alias("change"), apart.alias("once"))


def twin_edges(nodes: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Edges between nodes with summed weights: (src, dst, src_size, dst_size, common, change).

    ``common`` and ``change`` are the weights in tenths of one address pair; an edge stands for
    ``src_size * dst_size`` pairs, a node with ``src = dst`` for the pairs inside it. A transaction with more
    than ``block_nodes`` nodes is cut into blocks, and each pair of blocks joins on its own key. Pairs that surely meet in one transaction only
    are edges as they are; the others are summed.
    """
    parts = F.ceil(F.count("*").over(Window.partitionBy("txid")) / block_nodes).cast("int")
    counted = nodes.withColumn("parts", parts)
    narrow = counted.where("parts = 1")
    placed = counted.where("parts > 1").withColumn("own", F.pmod(F.hash("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = _node_pairs(placed.select("txid", F.col("own").alias("p"), other.alias("q"), *NODE),
                         placed.select("txid", other.alias("p"), F.col("own").alias("q"), *NODE), ["txid", "p", "q"])
    pairs = _node_pairs(narrow, narrow, ["txid"]).unionByName(blocks).where("common + change > 0")
    summed = pairs.where("NOT once").groupBy("src", "dst").agg(
        F.max("src_size").alias("src_size"), F.max("dst_size").alias("dst_size"),
        F.sum("common").alias("common"), F.sum("change").alias("change"))
    return pairs.where("once").drop("once").unionByName(summed)


def weighted(edges: DataFrame, tenths: Column) -> DataFrame:
    """Edges with a positive weight, the weight as an exact decimal and the number of address pairs."""
    pairs = F.when(F.col("src") == F.col("dst"), F.col("src_size") * (F.col("src_size") - 1) / 2).otherwise(
        F.col("src_size") * F.col("dst_size"))
    return edges.withColumn("weight", (tenths / 10).cast("decimal(20,1)")).where("weight > 0").withColumn(
        "pairs", pairs.cast("bigint"))


def address_graph(edges: DataFrame) -> DataFrame:
    """The undirected graph: summed weight per address pair and its edge types."""
    types = F.filter(F.array(F.when(F.col("change") > 0, "change_detection"), F.when(F.col("common") > 0, "common_input")),
                     lambda t: t.isNotNull())
    return weighted(edges, F.col("common") + F.col("change")).withColumn("types", types).drop("common", "change")


def expand(graph: DataFrame, twins: DataFrame, asked: DataFrame) -> DataFrame:
    """Address-level links among the asked addresses only (a bounded sample, such as the nodes of a chart)."""
    chosen = twins.join(asked.select("address"), "address", "left_semi")
    a = chosen.select(F.col("address").alias("source"), F.col("node").alias("src"))
    b = chosen.select(F.col("address").alias("target"), F.col("node").alias("dst"))
    across = graph.join(a, "src").join(b, "dst")
    return across.where((F.col("src") != F.col("dst")) | (F.col("source") < F.col("target"))).select(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")


# ---- node features ----------------------------------------------------------


def _both_ways(edges: DataFrame) -> DataFrame:
    """(node, peer, node_size, peer_size) in both directions, inner pairs of a node once, in one pass."""
    def way(node: str, peer: str) -> Column:
        return F.struct(F.col(node).alias("node"), F.col(peer).alias("peer"),
                        F.col(f"{node}_size").alias("node_size"), F.col(f"{peer}_size").alias("peer_size"))

    forward, back = way("src", "dst"), way("dst", "src")
    return edges.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(forward)).otherwise(F.array(forward, back))))


def _reach() -> Column:
    """Neighbours one address of ``node`` gains from an edge to ``peer`` (itself excluded)."""
    return F.when(F.col("node") == F.col("peer"), F.col("peer_size") - 1).otherwise(F.col("peer_size"))


def node_degree(edges: DataFrame) -> DataFrame:
    return _both_ways(edges).groupBy("node").agg(
        F.max("node_size").alias("size"), F.sum(_reach()).alias("degree"),
        F.max(F.when(F.col("node") == F.col("peer"), 1).otherwise(0)).alias("closed"))


def node_neighbor_degree(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Mean degree of the neighbours."""
    peers = degrees.select(F.col("node").alias("peer"), F.col("degree").alias("peer_degree"))
    return _both_ways(edges).join(peers, "peer").groupBy("node").agg(
        (F.sum(_reach() * F.col("peer_degree")) / F.sum(_reach())).alias("avg_neighbor_degree"))


WIDE_MEMBERS = 64
BITMAP_BITS = 32_768


def neighbour_degrees(members: DataFrame, wide: int = WIDE_MEMBERS) -> DataFrame:
    """(address, degree, avg_neighbor_degree) of the graph without writing out the pairs of wide transactions.

    An input of a transaction has its inputs and changes as neighbours, a change its inputs. For transactions of more than ``wide`` addresses these sets
    stay sets: addresses that have the same sets form one signature, and the size of a signature's union is counted on bitmaps over dense numbers of the
    addresses. Only narrow transactions give pairs, at most ``wide`` for each of their rows, and pairs that a wide one holds as well are left out. So a transaction of
    any width costs rows in proportion to its addresses.
    """
    counted = members.groupBy("txid").agg((F.count("*") > wide).alias("wide"))
    placed = cut_lineage(members.join(counted, "txid").select("txid", "address", (F.col("ins") > 0).alias("sends"), (F.col("changes") > 0).alias("change"), "wide"))
    large, small = placed.where("wide"), placed.where("NOT wide")
    inputs, changes = F.struct("txid", F.lit("i").alias("side")), F.struct("txid", F.lit("c").alias("side"))
    held = cut_lineage(large.select("address", F.explode(F.array_compact(F.array(F.when(F.col("sends"), inputs), F.when(F.col("change"), changes)))).alias("set")))
    seen = cut_lineage(large.select("address", "sends", F.explode(F.when(F.col("sends"), F.array(inputs, changes)).otherwise(F.array(inputs))).alias("set")))
    signed = cut_lineage(seen.groupBy("address").agg(
        F.bit_xor(F.xxhash64("set")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("second"), "set")).alias("s2"), F.count("*").alias("s3"),
        F.max(F.col("sends").cast("int")).alias("own")))
    sign = ["s1", "s2", "s3"]
    first = signed.groupBy(*sign).agg(F.min("address").alias("address"))
    sets = cut_lineage(seen.select("address", "set").join(first, "address").select(*sign, "set"))
    ids = dictionary(held, "address")
    bits = held.join(ids, "address").groupBy("set", F.expr(f"id div {BITMAP_BITS}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("id") % BITMAP_BITS).alias("bits"))
    sizes = sets.join(bits, "set").groupBy(*sign, "chunk").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy(*sign).agg(F.sum("n").alias("joint"))

    a = small.select("txid", "address", "sends")
    b = small.select("txid", F.col("address").alias("peer"), F.col("sends").alias("peer_sends"))
    pairs = a.join(b, "txid").where("address <> peer AND (sends OR peer_sends)").select("address", "peer").distinct()
    known = pairs.join(held.select(F.col("address").alias("peer"), "set"), "peer").join(seen.select("address", "set"), ["address", "set"]).select("address", "peer").distinct()
    pairs = cut_lineage(pairs.join(known, ["address", "peer"], "left_anti"))
    parts = signed.join(sizes, sign).select("address", (F.col("joint") - F.col("own")).alias("n")).unionByName(
        pairs.groupBy("address").agg(F.count("*").alias("n")))
    degrees = cut_lineage(parts.groupBy("address").agg(F.sum("n").alias("degree")).where("degree > 0"))

    of_peer = degrees.select(F.col("address").alias("peer"), F.col("degree").alias("peer_degree"))
    joint = sets.join(held.select(F.col("address").alias("peer"), "set"), "set").select(*sign, "peer").distinct()  # signatures by the size of their unions
    joint = joint.join(of_peer, "peer").groupBy(*sign).agg(F.sum("peer_degree").alias("total"))
    own = F.when(F.col("own") > 0, F.col("degree")).otherwise(0)
    sums = signed.join(joint, sign).join(degrees, "address").select("address", (F.col("total") - own).alias("total")).unionByName(
        pairs.join(of_peer, "peer").groupBy("address").agg(F.sum("peer_degree").alias("total")))
    return degrees.join(sums.groupBy("address").agg(F.sum("total").alias("total")), "address").select(
        "address", "degree", (F.col("total") / F.col("degree")).alias("avg_neighbor_degree"))


def _closed(packed: str) -> Column:
    return F.col(packed).bitwiseAND(F.lit(1).cast("long"))


def _ranked(edges: DataFrame, info: DataFrame) -> DataFrame:
    """Edges with what is known of both ends. ``info`` has one number for each node, so that all readers of this plan take the same columns and share its deals."""
    a = info.select(F.col("node").alias("src"), F.col("known").alias("src_known"))
    b = info.select(F.col("node").alias("dst"), F.col("known").alias("dst_known"))
    return edges.select("src", "dst", "src_size", "dst_size").join(a, "src").join(b, "dst")


def _around_nodes(ranked: DataFrame) -> DataFrame:
    """Per node, what is known of it and, over its edges: neighbours of one address (``reach``), the sum of their degrees (``degrees``), linked pairs inside the peers (``inside``), and pairs
    of a twin and a neighbour (``twins``), which are linked if the node's own addresses are. The side by which edges are dealt is summed where it is."""
    def side(node: str, peer: str) -> list[Column]:
        inner = F.col("src") == F.col("dst")
        size = F.col(f"{peer}_size")
        reach = F.when(inner, size - 1).otherwise(size)
        terms = {"reach": reach, "degrees": reach * F.shiftright(f"{peer}_known", 1), "inside": F.when(_closed(f"{peer}_known") == 1, reach * (reach - 1) / 2).otherwise(0),
                 "twins": F.when(inner, 0).otherwise((F.col(f"{node}_size") - 1) * size)}
        if node == "src":  # an edge inside of a node counts once
            terms = {name: F.when(inner, 0).otherwise(term) for name, term in terms.items()}
        return [F.max(f"{node}_known").alias("known"), *[F.sum(term).alias(name) for name, term in terms.items()]]

    names = ["reach", "degrees", "inside", "twins"]
    ends = ranked.groupBy(F.col("dst").alias("node")).agg(*side("dst", "src")).unionByName(ranked.groupBy(F.col("src").alias("node")).agg(*side("src", "dst")))
    return ends.groupBy("node").agg(F.max("known").alias("known"), *[F.sum(name).alias(name) for name in names])


def _across(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Linked neighbour pairs around one address of each node whose three nodes are distinct: (node, across).

    They are found by orienting every edge from the lower to the higher degree, which bounds the out-degree, hubs included, by the square root of the edge
    count. Sizes travel with the edges.
    """
    upward = F.struct("src_known", "src") < F.struct("dst_known", "dst")

    def arc(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(f"{x}_size").alias("x_size"), F.col(y).alias("y"), F.col(f"{y}_size").alias("y_size"))

    # The outer form keeps the test from the scan, where it would give this reader deals of its own.
    arcs = ranked.select(F.inline_outer(F.when(F.col("src") != F.col("dst"), F.array(F.when(upward, arc("src", "dst")).otherwise(arc("dst", "src")))))).where("x IS NOT NULL")
    wedges = arcs.alias("p").join(arcs.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(
        F.col("p.x").alias("x"), F.col("p.x_size").alias("x_size"), F.col("p.y").alias("src"), F.col("p.y_size").alias("src_size"),
        F.col("q.y").alias("dst"), F.col("q.y_size").alias("dst_size"))
    proper = edges.where("src <> dst").select("src", "dst")
    corners = [("x", "src", "dst"), ("src", "x", "dst"), ("dst", "x", "src")]
    opposite = F.array(*[F.struct(F.col(n).alias("node"), (F.col(f"{a}_size") * F.col(f"{b}_size")).alias("n")) for n, a, b in corners])
    return wedges.join(proper, ["src", "dst"]).select(F.inline(opposite)).groupBy("node").agg(F.sum("n").alias("across"))


def node_features(edges: DataFrame) -> DataFrame:
    """Degree, clustering coefficient and mean neighbour degree of every node.

    Degrees are stored, as they are read many times. Edges meet them once at each end; from that follow the sums over neighbours and the triangles. Pairs that involve
    two addresses of one node follow from sizes alone.
    """
    known = (F.shiftleft(F.col("degree").cast("long"), 1) + F.col("closed")).alias("known")
    info = stored(node_degree(edges).select("node", known), "degrees")
    ranked = _ranked(edges, info)
    sums = _around_nodes(ranked).join(_across(ranked, edges), "node", "left")
    degree = F.shiftright("known", 1)
    triangles = (F.coalesce("across", F.lit(0)) + F.col("inside") + F.when(_closed("known") == 1, F.col("twins")).otherwise(0)).cast("bigint")
    return sums.select(
        "node", degree.alias("degree"),
        F.when(degree < 2, 0.0).otherwise(2 * triangles / (degree * (degree - 1))).alias("clustering_coefficient"),
        (F.col("degrees") / F.col("reach")).alias("avg_neighbor_degree"))


def per_address(features: DataFrame, twins: DataFrame) -> DataFrame:
    """Rows of nodes for each of their addresses; a node's own address takes its row as it is."""
    features = features.where("node IS NOT NULL")  # as the join says, so that both parts read one deal
    own = features.withColumnRenamed("node", "address")
    return own.unionByName(twins.where("address <> node").join(features, "node").drop("node"))


def activity(inputs: DataFrame, outputs: DataFrame, as_of: Column) -> DataFrame:
    """Row count, lifetime, recency, active span and mean dwell of every address, in seconds."""
    return moments_activity(inputs.select("address", "tx_timestamp").unionByName(outputs.select("address", "tx_timestamp")), as_of)


def moments_activity(rows: DataFrame, as_of: Column) -> DataFrame:
    """``activity`` of the rows (address, tx_timestamp) of both sides."""
    micros = F.unix_micros("tx_timestamp")
    stats = rows.where("tx_timestamp IS NOT NULL").groupBy("address").agg(
        F.count("*").alias("tx_count"), F.min(micros).alias("a"), F.max(micros).alias("b"))
    now, active = F.unix_micros(as_of), (F.col("b") - F.col("a")) / 1e6
    return stats.select(
        "address", "tx_count", ((now - F.col("a")) / 1e6).alias("lifetime_sec"), ((now - F.col("b")) / 1e6).alias("recency_sec"),
        active.alias("active_duration_sec"),
        F.when(F.col("tx_count") > 1, active / (F.col("tx_count") - 1)).otherwise(0.0).alias("avg_dwell_sec"))


FEATURES = ["degree", "clustering_coefficient", "avg_neighbor_degree", "tx_count", "lifetime_sec", "recency_sec",
            "active_duration_sec", "avg_dwell_sec"]


def address_features(node_rows: DataFrame, twins: DataFrame, act: DataFrame) -> DataFrame:
    """The eight-column matrix of every graph address, missing values as 0."""
    return per_address(node_rows, twins).join(act, "address", "left").select(
        "address", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


# ---- components -------------------------------------------------------------


def input_stars(inputs: DataFrame) -> DataFrame:
    """Edges that connect the input addresses of each transaction: smallest address to every other one."""
    members = inputs.select("txid", "address").distinct()
    hub = members.groupBy("txid").agg(F.min("address").alias("hub"))
    return members.join(hub, "txid").where("hub <> address").select(F.col("hub").alias("src"), F.col("address").alias("dst")).distinct()


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(column, id): the distinct values numbered from 0 in their order.

    Values are ranged and sorted within their ranges; a value's number is the size of the ranges before (a row for each range) and its place. Numbers
    are dense and keep the order, so the smallest number of a group is its smallest value.
    """
    ordered = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    mark, places = F.monotonically_increasing_id(), 1 << 33  # the library's layout: number of the range, then place in it
    marked = cut_lineage(ordered.select(column, F.shiftright(mark, 33).alias("range"), (mark % places).alias("place")))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return marked.join(before, "range").select(column, (F.col("before") + F.col("place")).alias("id"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table; the component is its smallest node.

    Nodes with names go through the rounds under their numbers in a dictionary that keeps the order, eight bytes each, and get their
    names back at the end.
    """
    if edges.schema["src"].dataType.simpleString() != "string":
        return _rounds(edges, max_rounds)
    kept = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    names = cut_lineage(dictionary(kept.select(F.col("src").alias("name")).unionByName(kept.select(F.col("dst").alias("name"))), "name"))
    coded = kept.join(names.select(F.col("name").alias("src"), F.col("id").alias("u")), "src").join(
        names.select(F.col("name").alias("dst"), F.col("id").alias("v")), "dst").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    found = _rounds(coded, max_rounds)
    return (found.join(names.select(F.col("id").alias("node"), F.col("name").alias("own")), "node")
            .join(names.select(F.col("id").alias("component"), F.col("name").alias("least")), "component")
            .select(F.col("own").alias("node"), F.col("least").alias("component")))


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Large-star / small-star (Kiveris et al. 2014). Each round is two minimum aggregates and two joins; the
    result of a round is checkpointed, so the plan stays flat and a lost executor costs one round at most.
    """
    pairs = cut_lineage(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = _fingerprint(pairs)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        after = _fingerprint(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


# ---- density clusters -------------------------------------------------------


def _squared(a: str, b: str, columns: list[str]) -> Column:
    """Squared distance of two points, column by column in order."""
    steps = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in columns]
    return reduce(lambda x, y: x + y, [step * step for step in steps])


def neighbour_distances(points: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    """(columns, gap): squared distance from every distinct point to its k-th nearest other distinct point, exact.

    Points lie in the leaves of a tree of cuts over all columns; each looks into the leaves that the best distance of its own leaf reaches
    (``nearest_gaps``). Fewer than k other points settle nothing and leave no row.
    """
    table, found = _gaps(points, columns, k)
    return table.join(found, "id").select(*columns, "gap")


def _gaps(points: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct points (id, columns) and their distances (id, gap)."""
    table = stored(points.select(*[F.col(c).cast("double").alias(c) for c in columns]).distinct().withColumn("id", F.xxhash64(*columns)), "points")
    n = table.count()
    if n <= k:
        return table, table.select("id", F.lit(None).cast("double").alias("gap")).limit(0)
    return table, stored(nearest_gaps(table, columns, n, k), "gaps")


def reach(features: DataFrame, columns: list[str] | None = None, k: int = 1) -> float:
    """Squared reach of density clusters: the median (the lower one of two) of the squared distances to the k-th nearest distinct point; 0 without such points.

    It is widened by a billionth, so that pairs as far apart as the median pair are all inside, however their coordinates round.
    """
    gaps = _gaps(features, columns or FEATURES, k)[1].groupBy("gap").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.log2(F.greatest("gap", F.lit(1e-300))) * 8))
    bands = gaps.groupBy("band").agg(F.sum("n").alias("n"))
    before = bands.withColumn("upto", F.sum("n").over(Window.orderBy("band")))  # eight rows for each power of two
    total = bands.agg(F.sum("n")).first()[0]
    if not total:
        return 0.0
    middle = (total + 1) // 2
    band = before.where(F.col("upto") >= middle).orderBy("band").first()
    inside = gaps.where(F.col("band") == band["band"]).withColumn("upto", F.sum("n").over(Window.partitionBy("band").orderBy("gap")) + (band["upto"] - band["n"]))
    return float(inside.where(F.col("upto") >= middle).agg(F.min("gap")).first()[0]) * (1 + 1e-9)


def closest_links(pairs: DataFrame, points: DataFrame, columns: list[str], limit: float, leaf: int = LEAF_POINTS, compared: list[int] | None = None) -> DataFrame:
    """The pairs (src, dst) of bins that have two points within the limit (a squared distance); ``points`` are (bin, columns), distinct.

    Not all pairs of points are written out. Each side is the box around its points. Boxes whose nearest sides are beyond the limit are dropped; boxes whose
    farthest corners are within it settle their bins; of the rest, boxes with more than ``leaf`` points are halved along their longest side, and the points
    of two small ones are compared. A settled pair of bins is not looked at again. ``compared`` takes the number of comparisons of each round.
    """
    placed = points.select("bin", F.col("bin").cast("string").alias("box"), *columns)
    state = cut_lineage(pairs.select("src", "dst", F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")))
    found = None
    while not state.isEmpty():
        ends = state.select(F.col("a").alias("box")).unionByName(state.select(F.col("b").alias("box"))).distinct()
        placed = cut_lineage(placed.join(ends, "box", "left_semi"))
        boxes = cut_lineage(placed.groupBy("box").agg(
            F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]))

        def side(name: str) -> DataFrame:
            return boxes.select(F.col("box").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in boxes.columns if c != "box"])

        def gap(near: bool) -> Column:
            steps = []
            for c in columns:
                one, two = F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")
                steps.append(F.greatest(one, two, F.lit(0.0)) if near else F.greatest(-one, -two))
            return reduce(lambda x, y: x + y, [step * step for step in steps])

        met = cut_lineage(state.join(side("a"), "a").join(side("b"), "b").where(gap(True) <= limit).withColumn("sure", gap(False) <= limit)
                          .select("src", "dst", "a", "b", "sure", "a_n", "b_n"))
        sure = met.where("sure").select("src", "dst").distinct()
        rest = met.where("NOT sure").join(sure, ["src", "dst"], "left_anti")
        small = rest.where((F.col("a_n") <= leaf) & (F.col("b_n") <= leaf))
        one = placed.select(F.col("box").alias("a"), *[F.col(c).alias(f"x_{c}") for c in columns])
        two = placed.select(F.col("box").alias("b"), *[F.col(c).alias(f"y_{c}") for c in columns])
        near = small.join(one, "a").join(two, "b").where(_squared("x_", "y_", columns) <= limit).select("src", "dst").distinct()
        hits = cut_lineage(sure.unionByName(near).distinct())
        found = hits if found is None else found.unionByName(hits)
        if compared is not None:
            compared.append(state.count() + (small.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0))
        open_ones = rest.where((F.col("a_n") > leaf) | (F.col("b_n") > leaf)).join(hits, ["src", "dst"], "left_anti")
        spans = F.array(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in columns])
        longest = F.array_position(spans, F.array_max(spans)) - 1
        cuts = boxes.where(F.col("n") > leaf).select("box", longest.cast("int").alias("along"), F.get(F.array(*[
            F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2 for c in columns]), longest.cast("int")).alias("cut"))
        halved = placed.join(cuts, "box", "left")
        right = F.get(F.array(*columns), F.col("along")) > F.col("cut")
        placed = cut_lineage(halved.select("bin", F.col("box").alias("whole"), F.when(F.col("along").isNull(), F.col("box")).otherwise(
            F.concat("box", F.when(right, "+").otherwise("-"))).alias("box"), *columns))
        halves = placed.select("whole", "box").distinct()
        state = cut_lineage(open_ones.join(halves.select(F.col("whole").alias("a"), F.col("box").alias("a_new")), "a")
                            .join(halves.select(F.col("whole").alias("b"), F.col("box").alias("b_new")), "b")
                            .select("src", "dst", F.col("a_new").alias("a"), F.col("b_new").alias("b")))
        placed = placed.drop("whole")
    return found if found is not None else pairs.select("src", "dst").limit(0)


def density_clusters(features: DataFrame, eps: float | None = None, key: str = "address", columns: list[str] | None = None) -> DataFrame:
    """(key, component) of density clusters over scaled features with at least two members; lone points drop out.

    With two as the minimum, density clusters are the connected components of the "within eps" graph of the points. Without a given
    ``eps`` it is the median distance of the distinct points to their nearest other one (``reach``).
    Features are first binned to ``eps / (2 * sqrt(d))``; all points of a bin are closer than eps to each other, so
    a bin is one node whatever its size. Two bins whose farthest corners are within eps are linked, two whose nearest
    sides are farther apart are not, and the points decide the rest (``closest_links``), as far as the two bins are not already in one
    component. Bins meet by equi-join on cells of about eps width over the three columns with the most different
    values; the distance stands in the join condition, so only near pairs leave the join, and a crowded cell is
    split by the adaptive skew join. A reach of zero clusters equal points only.
    """
    columns = columns or FEATURES
    squared = eps * eps if eps is not None else reach(features, columns)
    if not squared:
        named = features.groupBy(*columns).agg(F.min(key).alias("component"), F.count("*").alias("n")).where("n > 1").drop("n")
        return features.join(named, columns).select(key, "component")
    eps = squared ** 0.5
    limit = 4 * len(columns)  # eps squared in bin widths
    width = eps / limit ** 0.5
    side = int(limit ** 0.5) + 1
    names = [f"g{i}" for i in range(len(columns))]
    binned = cut_lineage(features.select(key, *columns, *[F.floor(F.col(c) / width).cast("bigint").alias(n) for c, n in zip(columns, names)]))
    named = binned.groupBy(*names).agg(F.min(key).alias("bin"), F.count("*").alias("members"))
    bins = cut_lineage(named)
    spread = bins.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    wide = sorted(names, key=lambda n: (-spread[n], n))[:3]
    cell = [F.floor(F.col(n) / side).cast("bigint") for n in wide]
    # A pair needs to meet once, so a bin visits its own cell and one of each two opposite neighbours. Cells go by a hash: where two share it, distances tell.
    steps = [step for step in itertools.product((-1, 0, 1), repeat=len(wide)) if step >= (0,) * len(wide)]
    visited = F.array(*[F.struct(F.xxhash64(*[c + change for c, change in zip(cell, step)]).alias("cell"), F.lit(any(step)).alias("other")) for step in steps])
    home = bins.select("bin", *names, F.xxhash64(*cell).alias("cell"))
    copies = bins.select(F.col("bin").alias("peer"), *[F.col(n).alias(f"p_{n}") for n in names], F.inline(visited))

    def apart(change: int) -> Column:
        """Squared distance of the nearest sides (-1) or the farthest corners (1) of two bins, in bin widths."""
        steps = [F.greatest(F.abs(F.col(n) - F.col(f"p_{n}")) + change, F.lit(0)) for n in names]
        return reduce(lambda x, y: x + y, [step * step for step in steps])

    met = home.join(copies, "cell").where((F.col("other") & (F.col("bin") != F.col("peer")) | (F.col("bin") < F.col("peer"))) & (apart(-1) <= limit))
    met = cut_lineage(met.select(F.least("bin", "peer").alias("src"), F.greatest("bin", "peer").alias("dst"), (apart(1) < limit).alias("sure")))
    sure = met.where("sure").select("src", "dst")
    first = connected_components(sure)
    sides = met.where("NOT sure").select("src", "dst")
    for end in ("src", "dst"):
        known = first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        sides = sides.join(known, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    pairs = cut_lineage(sides.where("src_in <> dst_in").select("src", "dst"))
    wanted = pairs.select(F.col("src").alias("bin")).unionByName(pairs.select(F.col("dst").alias("bin"))).distinct()
    points = binned.join(bins.select("bin", *names).join(wanted, "bin", "left_semi"), names).select("bin", *columns).distinct()
    decided = closest_links(pairs, points, columns, squared)
    linked = connected_components(sure.unionByName(decided))
    labels = bins.join(linked, bins["bin"] == linked["node"], "left").select(
        *names, "members", F.coalesce("component", "bin").alias("component"))
    sizes = labels.groupBy("component").agg(F.sum("members").alias("total")).where("total > 1").select("component")
    return binned.join(labels.drop("members"), names).join(sizes, "component", "left_semi").select(key, "component")
