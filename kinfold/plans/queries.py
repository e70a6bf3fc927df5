"""The registered queries over the driver's tables, each with SQL that an independent engine answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import encoders, infer, labels, metrics
from kinfold.functions.labels import LabelTransform
from kinfold.operators import graph, inference, keys, recipes, splits
from kinfold.operators.inference import InferenceFilter
from kinfold.schema import Database, LogicalType, Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r4(c: Column) -> Column:
    """Rounded off ties, where engines that add in another order would differ."""
    return F.round(c + 1e-7, 4)


# --- graph -----------------------------------------------------------------------------------------------------------


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fk_edges(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer"), "c_custkey", "o_orderkey", "c_custkey")


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("price"))


@query("SELECT o_orderkey AS src, c_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def edge_list_fk(spark, d):
    return _order_edges(spark, d)


@query("SELECT c_custkey AS src, o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def edge_list_reverse(spark, d):
    return graph.reversed_edges(_order_edges(spark, d))


@query("SELECT o_orderkey AS src, k AS dst FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 50 END AS f FROM orders) JOIN (SELECT CASE WHEN c_custkey % 60 = 13 THEN -1 ELSE c_custkey % 60 END AS f, max(c_custkey) AS k FROM customer GROUP BY 1) USING (f)")
def edge_list_dirty_keys(spark, d):
    """Null and dangling foreign keys, and a repeated primary key whose last row counts."""
    src = read(spark, d, "orders").withColumn("f", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 50))
    dst = read(spark, d, "customer").withColumn("k", F.expr("if(c_custkey % 60 = 13, -1, c_custkey % 60)"))
    return graph.fk_edges(src, "f", dst, "k", "o_orderkey", "c_custkey")


_WIDE = 1 << 60


@query(f"SELECT l_orderkey * 8 + l_linenumber AS src, o_orderkey AS dst FROM lineitem JOIN orders ON l_orderkey + {_WIDE} = o_orderkey + {_WIDE}")
def edge_list_wide_keys(spark, d):
    """Keys beyond what doubles tell apart: integers on one side, decimals on the other, through from_dataframe and the graph."""
    from kinfold.schema import ForeignKey
    from kinfold.sources.tables import from_dataframe

    orders = read(spark, d, "orders").select((F.col("o_orderkey") + _WIDE).alias("id"), "o_totalprice")
    lines = read(spark, d, "lineitem").select((F.col("l_orderkey") + _WIDE).cast("decimal(30,0)").alias("orderId"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    db = Database()
    for t in (from_dataframe("orders", orders, pk="id", detect=False), from_dataframe("lines", lines, pk="line", fks=(ForeignKey("orderId", "orders"),), detect=False)):
        node = (F.col("id") - _WIDE) if t.name == "orders" else F.col("line")
        db.add_table(Table(t.name, t.df.withColumn(graph.NODE, node), t.types, t.pk, t.time_col, t.fks))
    edges = graph.build_graph(db).edges
    return edges[graph.EdgeType("lines", "orderId", "orders")]


def _small_db(spark: SparkSession, d: str) -> Database:
    n, c, t = LogicalType.NUMERICAL, LogicalType.CATEGORICAL, LogicalType.TEXT
    from kinfold.schema import ForeignKey

    db = Database()
    db.add_table(Table("region", read(spark, d, "region").withColumn("_nid", F.col("r_regionkey").cast("long")), {"r_regionkey": n, "r_name": t}, "r_regionkey"))
    db.add_table(Table("nation", read(spark, d, "nation").withColumn("_nid", F.col("n_nationkey").cast("long")), {"n_nationkey": n, "n_name": t, "n_regionkey": n}, "n_nationkey", None, (ForeignKey("n_regionkey", "region"),)))
    db.add_table(Table("customer", read(spark, d, "customer").withColumn("_nid", F.col("c_custkey")), {"c_custkey": n, "c_name": t, "c_nationkey": n, "c_acctbal": n, "c_mktsegment": c}, "c_custkey", None, (ForeignKey("c_nationkey", "nation"), ForeignKey("c_mktsegment", "nation"))))
    db.add_table(Table("orders", read(spark, d, "orders").withColumn("_nid", F.col("o_orderkey")), {"o_orderkey": n, "o_custkey": n, "o_orderstatus": c, "o_totalprice": n, "o_orderdate": LogicalType.TIMESTAMP, "o_orderpriority": c}, "o_orderkey", "o_orderdate", (ForeignKey("o_custkey", "customer"), ForeignKey("o_orderkey", "missing"))))
    return db


@query("""
WITH e AS (
  SELECT 'orders__o_custkey__customer' AS f, 'customer__rev_o_custkey__orders' AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'customer__c_nationkey__nation', 'nation__rev_c_nationkey__customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation__n_regionkey__region', 'region__rev_n_regionkey__nation', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'node' AS kind, 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'nation', count(*) FROM nation
UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'orders', count(*) FROM orders
UNION ALL SELECT 'edge', f, n FROM e UNION ALL SELECT 'edge', b, n FROM e UNION ALL SELECT 'total', 'edges', CAST(2 * sum(n) AS BIGINT) FROM e""")
def graph_summary(spark, d):
    return graph.build_graph(_small_db(spark, d)).summary()


@query("SELECT c_custkey AS node, round(avg(o_totalprice) + 1e-7, 4) AS mean_price, count(*) AS degree FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def neighbor_mean(spark, d):
    """One step of message passing: the mean price of each customer's orders."""
    edges = _order_edges(spark, d)
    means = graph.neighbor_mean(edges, _prices(spark, d), ["price"])
    return means.join(graph.degrees(edges).withColumnRenamed("dst", "node"), "node").select("node", r4(F.col("price")).alias("mean_price"), "degree")


@query("SELECT c_custkey AS node, round(coalesce(avg(o_totalprice), 0) + 1e-7, 4) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def neighbor_mean_isolated(spark, d):
    """Nodes without neighbours get zeros."""
    edges = _order_edges(spark, d)
    nodes = read(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    out = graph.with_zeros(nodes, graph.neighbor_mean(edges, _prices(spark, d), ["price"]), ["price"])
    return out.select("node", r4(F.col("price")).alias("price"))


@query("SELECT n_nationkey AS node, round(avg(m) + 1e-7, 4) AS price FROM (SELECT c_custkey, c_nationkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def neighbor_mean_2hop(spark, d):
    first = graph.neighbor_mean(_order_edges(spark, d), _prices(spark, d), ["price"])
    up = graph.fk_edges(read(spark, d, "customer"), "c_nationkey", read(spark, d, "nation"), "n_nationkey", "c_custkey", "n_nationkey")
    return graph.neighbor_mean(up, first, ["price"]).select(F.col("node").cast("int").alias("node"), r4(F.col("price")).alias("price"))


@query("SELECT o_orderkey AS node, round(c_acctbal / deg + 1e-7, 4) AS g FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT o_custkey AS k, count(*) AS deg FROM orders GROUP BY 1) ON k = c_custkey")
def neighbor_mean_backward(spark, d):
    grads = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("g"))
    return graph.neighbor_mean_backward(_order_edges(spark, d), grads, ["g"]).select("node", r4(F.col("g")).alias("g"))


@query("""
WITH m AS (SELECT o_custkey AS k, avg(o_totalprice / 1e5) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS b FROM orders GROUP BY 1)
SELECT c_custkey AS node,
  round(greatest(0.5 * (c_acctbal / 1e4) + 0.1 + 0.3 * coalesce(a, 0) - 0.2 * coalesce(b, 0) + 0.05 - 0.01, 0) + 1e-7, 4) AS h0,
  round(greatest(-0.4 * (c_acctbal / 1e4) - 0.1 + 0.25 * coalesce(a, 0) + 0.6 * coalesce(b, 0) - 0.05 + 0.02, 0) + 1e-7, 4) AS h1
FROM customer LEFT JOIN m ON k = c_custkey""")
def sage_forward_fixed_weights(spark, d):
    """A layer with given weights as expressions: own part, neighbours' mean, the mean's bias even without neighbours, ReLU."""
    feats = read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 1e5).alias("a"), recipes.flag(F.col("o_orderstatus") == "F").alias("b"))
    means = graph.neighbor_mean(_order_edges(spark, d), feats, ["a", "b"])
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") / 1e4).alias("x"))
    rows = own.join(graph.with_zeros(own, means, ["a", "b"]), "node")
    w_self, b_self, w_neigh, b_neigh, bias = (0.5, -0.4), (0.1, -0.1), ((0.3, -0.2), (0.25, 0.6)), (0.05, -0.05), (-0.01, 0.02)
    unit = lambda i: F.greatest(w_self[i] * F.col("x") + b_self[i] + w_neigh[i][0] * F.col("a") + w_neigh[i][1] * F.col("b") + b_neigh[i] + bias[i], F.lit(0.0))
    return rows.select("node", r4(unit(0)).alias("h0"), r4(unit(1)).alias("h1"))


@query("""
WITH m AS (SELECT o_custkey AS k, avg(o_totalprice / 1e5) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS b FROM orders GROUP BY 1)
SELECT c_custkey AS node,
  round(greatest(0.5 * (c_acctbal / 1e4) + 0.1 + 0.3 * coalesce(a, 0) - 0.2 * coalesce(b, 0) + 0.05 - 0.01, 0) + 3.3e-8, 4) AS h0,
  round(greatest(-0.4 * (c_acctbal / 1e4) - 0.1 + 0.25 * coalesce(a, 0) + 0.6 * coalesce(b, 0) - 0.05 + 0.02, 0) + 3.3e-8, 4) AS h1
FROM customer LEFT JOIN m ON k = c_custkey""")
def model_layer_fixed_weights(spark, d):
    """The same layer by the model's own passes, from stored features and means."""
    model, _ = _fixed_model(spark, d, "customer", layers=2)
    found = model.vectors(model.inputs(top={"customer"}), {"customer"}, layers=1)
    off_ties = lambda i: F.round(F.col("v")[i] + 3.3e-8, 4)
    return found["customer"].select(F.col("_nid").alias("node"), off_ties(0).alias("h0"), off_ties(1).alias("h1"))


def _fixed_model(spark: SparkSession, d: str, target: str, layers: int):
    """A model over orders and customers whose weights are given, those of a second layer being those of the first; nodes are keys, features are not fitted, and no table is at the driver."""
    import numpy as np

    from kinfold.plans.model import Config, Encoder, Model
    from kinfold.plans.task import TaskSpec
    from kinfold.schema import ForeignKey

    n = LogicalType.NUMERICAL
    orders = read(spark, d, "orders").withColumn("_nid", F.col("o_orderkey").cast("long"))
    customers = read(spark, d, "customer").withColumn("_nid", F.col("c_custkey").cast("long"))
    db = Database()
    db.add_table(Table("orders", orders, {"o_orderkey": n, "o_custkey": n}, "o_orderkey", None, (ForeignKey("o_custkey", "customer"),)))
    db.add_table(Table("customer", customers, {"c_custkey": n}, "c_custkey"))
    raw = {"orders": orders.select("_nid", F.array(F.col("o_totalprice") / 1e5, recipes.flag(F.col("o_orderstatus") == "F")).alias("x")), "customer": customers.select("_nid", F.array((F.col("c_acctbal") / 1e4).cast("double")).alias("x"))}
    kind = lambda k: [(str(i), "num", (0.0, 1.0)) for i in range(k)]
    params = {"enc.orders.W": np.eye(2), "enc.orders.b": np.zeros(2), "enc.customer.W": np.array([[1.0], [0.0]]), "enc.customer.b": np.zeros(2)}
    edge, back = graph.EdgeType("orders", "o_custkey", "customer"), graph.EdgeType("orders", "o_custkey", "customer").reverse
    for t, e in (("customer", edge), ("orders", back)):
        params |= {f"l0.self.{t}.W": np.array([[0.5, 0.0], [-0.4, 0.0]]), f"l0.self.{t}.b": np.array([0.1, -0.1]), f"l0.bias.{t}": np.array([-0.01, 0.02])}
        params |= {f"l0.neigh.{e.name}.W": np.array([[0.3, -0.2], [0.25, 0.6]]), f"l0.neigh.{e.name}.b": np.array([0.05, -0.05])}
    if layers > 1:
        params |= {k.replace("l0.", "l1.", 1): v for k, v in params.items() if k.startswith("l0.")}
    params |= {"head.1.W": np.array([[1.0, -0.5], [0.2, 0.7]]), "head.1.b": np.array([0.0, 0.1]), "head.2.W": np.array([[0.8, -1.1]]), "head.2.b": np.array([0.05])}
    edges = graph.fk_edges(orders, "o_custkey", customers, "c_custkey")
    return Model(db, graph.Graph({}, {edge: edges, back: graph.reversed_edges(edges)}), TaskSpec(target, "x"), Config(channels=2, layers=layers, hidden=2, dropout=0.0, local_bytes=0), {"orders": Encoder(kind(2)), "customer": Encoder(kind(1))}, params, raw), target


@query("""
WITH x AS (SELECT o_orderkey, 0.5 * (o_totalprice / 1e5) + 0.1 + 0.3 * coalesce(c_acctbal / 1e4, 0) + 0.05 - 0.01 AS a, -0.4 * (o_totalprice / 1e5) - 0.1 + 0.25 * coalesce(c_acctbal / 1e4, 0) - 0.05 + 0.02 AS b
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, round(1 / (1 + exp(-(0.8 * greatest(a - 0.5 * b, 0) - 1.1 * greatest(0.2 * a + 0.7 * b + 0.1, 0) + 0.05))) + 1e-7, 4) AS prediction FROM x""")
def predict_fixed_weights(spark, d):
    """Probabilities of all orders from one layer and the head, with given weights."""
    model, _ = _fixed_model(spark, d, "orders", layers=1)
    return model.predict().select("o_orderkey", r4(F.col("prediction")).alias("prediction"))


_HEAD = "round(1 / (1 + exp(-(0.8 * greatest(a - 0.5 * b, 0) - 1.1 * greatest(0.2 * a + 0.7 * b + 0.1, 0) + 0.05))) + 1e-7, 4) AS prediction"
_MEANS = "m AS (SELECT o_custkey AS k, avg(o_totalprice / 1e5) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS b FROM orders GROUP BY 1)"


@query(f"""
WITH {_MEANS},
c AS (SELECT c_custkey, c_acctbal / 1e4 AS x, greatest(0.5 * (c_acctbal / 1e4) + 0.1 + 0.3 * coalesce(a, 0) - 0.2 * coalesce(b, 0) + 0.05 - 0.01, 0) AS u,
  greatest(-0.4 * (c_acctbal / 1e4) - 0.1 + 0.25 * coalesce(a, 0) + 0.6 * coalesce(b, 0) - 0.05 + 0.02, 0) AS v FROM customer LEFT JOIN m ON k = c_custkey),
o AS (SELECT o_orderkey, greatest(0.5 * (o_totalprice / 1e5) + 0.1 + 0.3 * coalesce(x, 0) + 0.05 - 0.01, 0) AS h, coalesce(u, 0) AS u, coalesce(v, 0) AS v FROM orders LEFT JOIN c ON o_custkey = c_custkey),
x AS (SELECT o_orderkey, 0.5 * h + 0.1 + 0.3 * u - 0.2 * v + 0.05 - 0.01 AS a, -0.4 * h - 0.1 + 0.25 * u + 0.6 * v - 0.05 + 0.02 AS b FROM o)
SELECT o_orderkey, {_HEAD} FROM x""")
def predict_two_layers(spark, d):
    """Probabilities of all orders from two layers and the head, with given weights: customers' vectors are sent to the blocks of their orders."""
    model, _ = _fixed_model(spark, d, "orders", layers=2)
    return model.predict().select("o_orderkey", r4(F.col("prediction")).alias("prediction"))


@query(f"""
WITH {_MEANS}, x AS (SELECT c_custkey, 0.5 * (c_acctbal / 1e4) + 0.1 + 0.3 * coalesce(m.a, 0) - 0.2 * coalesce(m.b, 0) + 0.05 - 0.01 AS a,
  -0.4 * (c_acctbal / 1e4) - 0.1 + 0.25 * coalesce(m.a, 0) + 0.6 * coalesce(m.b, 0) - 0.05 + 0.02 AS b FROM customer LEFT JOIN m ON k = c_custkey)
SELECT c_custkey, {_HEAD} FROM x""")
def entity_scores(spark, d):
    """The head on the vector of each customer, as a prediction for an entity without a row of its own."""
    model, _ = _fixed_model(spark, d, "orders", layers=1)
    out = model.entity_scores("customer", read(spark, d, "customer").select("c_custkey"))
    return out.select("c_custkey", r4(F.col("prediction")).alias("prediction"))


@query(f"""
WITH x AS (SELECT o_custkey, 0.5 * (o_totalprice / 1e5) + 0.1 + 0.3 * coalesce(c_acctbal / 1e4, 0) + 0.05 - 0.01 AS a, -0.4 * (o_totalprice / 1e5) - 0.1 + 0.25 * coalesce(c_acctbal / 1e4, 0) - 0.05 + 0.02 AS b
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
p AS (SELECT o_custkey, avg(1 / (1 + exp(-(0.8 * greatest(a - 0.5 * b, 0) - 1.1 * greatest(0.2 * a + 0.7 * b + 0.1, 0) + 0.05)))) AS p FROM x GROUP BY 1),
{_MEANS}, e AS (SELECT c_custkey, 0.5 * (c_acctbal / 1e4) + 0.1 + 0.3 * coalesce(m.a, 0) - 0.2 * coalesce(m.b, 0) + 0.05 - 0.01 AS a,
  -0.4 * (c_acctbal / 1e4) - 0.1 + 0.25 * coalesce(m.a, 0) + 0.6 * coalesce(m.b, 0) - 0.05 + 0.02 AS b FROM customer LEFT JOIN m ON k = c_custkey),
h AS (SELECT c_custkey, 1 / (1 + exp(-(0.8 * greatest(a - 0.5 * b, 0) - 1.1 * greatest(0.2 * a + 0.7 * b + 0.1, 0) + 0.05))) AS h FROM e)
SELECT user_id AS o_custkey, round(coalesce(p, h) + 1e-7, 4) AS prediction, CASE WHEN p IS NOT NULL THEN 'row' WHEN h IS NOT NULL THEN 'entities' ELSE 'none' END AS source
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN p ON o_custkey = user_id LEFT JOIN h ON c_custkey = user_id""")
def pair_scores(spark, d):
    """The mean prediction of each user's orders, or else of the customer that the user is, or none."""
    model, _ = _fixed_model(spark, d, "orders", layers=1)
    asked = read(spark, d, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    return model.pair_scores(asked, ["o_custkey"]).select("o_custkey", r4(F.col("prediction")).alias("prediction"), "source")


_LABELLED = """x AS (SELECT o_orderkey, coalesce(c_acctbal / 1e4, 0) AS c, CASE WHEN o_totalprice >= 150000 THEN 1.0 ELSE 0.0 END AS y,
  0.5 * (o_totalprice / 1e5) + 0.1 + 0.3 * coalesce(c_acctbal / 1e4, 0) + 0.05 - 0.01 AS a, -0.4 * (o_totalprice / 1e5) - 0.1 + 0.25 * coalesce(c_acctbal / 1e4, 0) - 0.05 + 0.02 AS b
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
z AS (SELECT *, greatest(a - 0.5 * b, 0) AS z0, greatest(0.2 * a + 0.7 * b + 0.1, 0) AS z1 FROM x), l AS (SELECT *, 0.8 * z0 - 1.1 * z1 + 0.05 AS logit FROM z)"""


def _labelled_orders(spark: SparkSession, d: str) -> DataFrame:
    label = LabelTransform("threshold", 150000.0).apply(F.col("o_totalprice"))
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("_nid"), label.alias("label"), F.lit("train").alias("split"))


@query(f"""
WITH {_LABELLED}, g AS (SELECT *, 1 / (1 + exp(-logit)) - y AS g FROM l),
h AS (SELECT *, g * 0.8 * CAST(z0 > 0 AS INT) AS u, g * -1.1 * CAST(z1 > 0 AS INT) AS v FROM g), k AS (SELECT *, u + 0.2 * v AS p, -0.5 * u + 0.7 * v AS q FROM h),
s AS (SELECT avg(-y * logit + ln(1 + exp(-abs(logit))) + greatest(logit, 0)) AS loss, avg(g) AS b2, avg(g * z0) AS w20, avg(g * z1) AS w21, avg(u) AS b10, avg(v) AS b11, avg(u * a) AS w1, avg(p) AS bias0, avg(q) AS bias1,
  avg(p * c) AS near0, avg(q * c) AS near1, avg((0.3 * p + 0.25 * q) * c) AS enc FROM k)
SELECT n AS name, round(v + 5e-8, 6) AS value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME n VALUE v)""")
def gradients_fixed_weights(spark, d):
    """The loss of all orders under given weights and its gradients, from the head down to the encoder of their customers."""
    model, _ = _fixed_model(spark, d, "orders", layers=1)
    rows = _labelled_orders(spark, d)
    loss, g = model.gradients(model.params, rows, rows.count(), 0)
    near, encoder = "l0.neigh.customer__rev_o_custkey__orders.W", "enc.customer.W"
    found = {"loss": loss, "b2": g["head.2.b"][0], "w20": g["head.2.W"][0, 0], "w21": g["head.2.W"][0, 1], "b10": g["head.1.b"][0], "b11": g["head.1.b"][1], "w1": g["head.1.W"][0, 0], "bias0": g["l0.bias.orders"][0], "bias1": g["l0.bias.orders"][1], "near0": g[near][0, 0], "near1": g[near][1, 0], "enc": g[encoder][0, 0]}
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double").select("name", F.round(F.col("value") + 5e-8, 6).alias("value"))


@query(f"""
WITH {_LABELLED}, c AS (SELECT count(*) FILTER (logit >= 0 AND y = 1) AS tp, count(*) FILTER (logit >= 0 AND y = 0) AS fp, count(*) FILTER (logit < 0 AND y = 1) AS fn, count(*) AS n, count(*) FILTER (logit < 0 AND y = 0) AS tn FROM l),
r AS (SELECT y, row_number() OVER (ORDER BY 1 / (1 + exp(-logit)) DESC, o_orderkey) AS i FROM l), t AS (SELECT *, sum(y) OVER (ORDER BY i) AS up FROM r)
SELECT round((tp + tn) / n + 1e-7, 4) AS accuracy, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + 1e-7, 4) AS f1,
  (SELECT round(sum(CASE WHEN y = 0 THEN up END) / (sum(y) * sum(1 - y)) + 1e-7, 4) FROM t) AS auc, (SELECT round(sum(CASE WHEN y = 1 THEN up / i END) / sum(y) + 1e-7, 4) FROM t) AS average_precision FROM c""")
def evaluate_fixed_weights(spark, d):
    """The metrics of all orders' probabilities under given weights."""
    model, _ = _fixed_model(spark, d, "orders", layers=1)
    found = model.evaluate(_labelled_orders(spark, d).select("_nid", "label"))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found)).select(*(r4(F.col(k)).alias(k) for k in found))


@query("""
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, avg(year(o_orderdate)) AS ym, stddev_pop(year(o_orderdate)) AS ys FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / s + 1e-7, 4) AS price, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o,
  CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, round(sin(month(o_orderdate) * 2 * pi() / 12) + 1e-7, 4) AS month_sin, round(coalesce((year(o_orderdate) - ym) / ys, 0) + 1e-7, 4) AS year
FROM orders, s""")
def encoded_rows(spark, d):
    """The feature vector that a fitted encoder makes of a table: its key is left out, the others follow their types."""
    from kinfold.plans.model import Config, fit_encoder

    n, c, t = LogicalType.NUMERICAL, LogicalType.CATEGORICAL, LogicalType.TIMESTAMP
    table = Table("orders", read(spark, d, "orders"), {"o_orderkey": n, "o_totalprice": n, "o_orderstatus": c, "o_orderdate": t}, "o_orderkey")
    rows = table.df.select("o_orderkey", fit_encoder(table, Config()).column().alias("x"))
    at = {"price": 0, "f": 1, "o": 2, "p": 3, "month_sin": 4, "year": 8}
    return rows.select("o_orderkey", *((r4(F.col("x")[i]) if k in ("price", "month_sin", "year") else F.col("x")[i]).alias(k) for k, i in at.items()))


@query("SELECT c_custkey AS src, dst FROM customer JOIN (SELECT c_mktsegment AS s, max(c_custkey) AS dst FROM customer GROUP BY 1) ON lower(c_mktsegment) = lower(s)")
def edge_list_string_key(spark, d):
    """Foreign keys that are strings; the last row of a repeated key counts."""
    c = read(spark, d, "customer")
    return graph.fk_edges(c, "c_mktsegment", c, "c_mktsegment", "c_custkey", "c_custkey")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, label, CASE WHEN i < n * 70 // 100 THEN 'train' WHEN i < n * 85 // 100 THEN 'val' ELSE 'test' END AS split FROM r""")
def split_threshold(spark, d):
    """A threshold label, and shares of 70, 15 and 15 per cent in the order of time; all columns are kept on the way."""
    rows = splits.temporal(read(spark, d, "orders"), "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", LabelTransform("threshold", 150000.0).apply(F.col("o_totalprice")).alias("label"), "split")


# --- keys and types --------------------------------------------------------------------------------------------------


@query("SELECT CAST(count(k) AS BIGINT) AS n_values, CAST(count(c_custkey) AS BIGINT) AS n_found, count(c_custkey) / CAST(count(k) AS DOUBLE) AS coverage FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey")
def fk_coverage(spark, d):
    src = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("k"))
    return keys.fk_coverage(src, "k", read(spark, d, "customer"), "c_custkey")


@query("""
WITH c AS (
  SELECT 'orders' AS "table", 'custkey' AS "column", 'customers' AS target, count(*) AS n_values, count(c_custkey) AS n_found FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'customers', 'nationkey', 'nations', count(*), count(n_nationkey) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nations', 'regionkey', 'regions', count(*), count(r_regionkey) FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'lines', 'partId', 'parts', count(*), count(p_partkey) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT "table", "column", target, n_values, n_found, n_found / CAST(n_values AS DOUBLE) AS coverage FROM c WHERE n_found >= 0.99 * n_values""")
def fk_detect(spark, d):
    """By names, types and coverage."""
    n, t = LogicalType.NUMERICAL, LogicalType.TEXT
    db = Database()
    add = lambda name, df, types, pk: db.add_table(Table(name, df.select(*types), types, pk))
    add("regions", read(spark, d, "region").withColumnsRenamed({"r_regionkey": "regionkey"}), {"regionkey": n, "r_name": t}, "regionkey")
    add("nations", read(spark, d, "nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"}), {"nationkey": n, "n_name": t, "regionkey": n}, "nationkey")
    add("customers", read(spark, d, "customer").withColumnsRenamed({"c_custkey": "custkey", "c_nationkey": "nationkey"}), {"custkey": n, "c_name": t, "nationkey": n}, "custkey")
    add("orders", read(spark, d, "orders").withColumnsRenamed({"o_orderkey": "orderkey", "o_custkey": "custkey"}), {"orderkey": n, "custkey": n}, "orderkey")
    add("parts", read(spark, d, "part").withColumnsRenamed({"p_partkey": "id"}), {"id": n}, "id")
    add("lines", read(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "partId"}), {"partId": n}, None)
    return keys.detect_fks(db)


_PK_COLUMNS = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id", "user_id"], "documents": ["doc_id", "text"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) = count(DISTINCT {c}) AS is_unique FROM {t}" for t, cs in _PK_COLUMNS.items() for c in cs))
def pk_uniqueness(spark, d):
    out = None
    for t, cs in _PK_COLUMNS.items():
        part = keys.uniqueness(read(spark, d, t), cs).select(F.lit(t).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_CSV = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_totalprice": "CAST(round(o_totalprice * 100) AS BIGINT) || 'e-2'", "o_orderstatus": "o_orderstatus", "o_orderpriority": "CASE WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE o_orderpriority END",
    "day": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END", "mixed": "CASE WHEN o_orderkey % 5 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END",
    "plus": "CASE WHEN o_orderkey % 2 = 0 THEN '+5' ELSE '5.' END", "nothing": "CASE WHEN o_orderkey % 2 = 0 THEN 'NULL' ELSE '\\N' END",
}


def _strings(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    text = k.cast("string")
    return o.select(
        text.alias("o_orderkey"), F.concat(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit("e-2")).alias("o_totalprice"), "o_orderstatus", F.when(k % 3 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 4 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(k % 5 == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("mixed"),
        F.when(k % 2 == 0, "+5").otherwise("5.").alias("plus"), F.when(k % 2 == 0, "NULL").otherwise("\\N").alias("nothing"),
    )


@query("WITH s AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CSV.items()) + r""" FROM orders),
u AS (UNPIVOT s ON COLUMNS(*) INTO NAME "column" VALUE v),
c AS (SELECT "column", CASE WHEN v NOT IN ('', '\N', 'NA', 'nan', 'None', 'NULL') THEN v END AS v FROM u),
a AS (SELECT "column", count(v) AS n_valid, count(*) FILTER (regexp_matches(v, '^-?\d+$') OR regexp_matches(v, '^-?\d*\.?\d+([eE][+-]?\d+)?$')) AS n_numeric,
  count(*) FILTER (regexp_matches(v, '^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$')) AS n_date, count(DISTINCT v) AS n_distinct FROM c GROUP BY 1)
SELECT *, CASE WHEN n_valid = 0 THEN 'TEXT' WHEN n_numeric = n_valid THEN 'NUMERICAL' WHEN n_date = n_valid THEN 'TIMESTAMP' WHEN least(n_distinct, 1001) / CAST(n_valid AS DOUBLE) <= 0.05 THEN 'CATEGORICAL' ELSE 'TEXT' END AS type FROM a""")
def type_infer_csv(spark, d):
    return infer.classified(infer.column_stats(_strings(spark, d)))


@query(ORACLES["type_infer_csv"].replace("SELECT *, CASE", 'SELECT "column", CASE WHEN n_valid > 0 AND n_numeric < n_valid AND n_date < n_valid THEN least(n_distinct, 1001) END AS n_distinct, CASE'))
def type_infer_bounded(spark, d):
    """The same types, from shapes counted in one aggregation and at most 1,001 different values of the columns that need them."""
    found = infer.bounded_types(_strings(spark, d))
    return spark.createDataFrame([(c, n, t.value) for c, (t, n) in found.items()], "column string, n_distinct long, type string")


@query(r"SELECT v AS token, count(*) FILTER (v NOT IN ('', '\N', 'NA', 'nan', 'None', 'NULL')) AS n_kept, count(*) AS n FROM (SELECT ['', '\N', 'NA', 'nan', 'None', 'NULL', 'NaN', 'null'][1 + CAST(o_orderkey % 8 AS INT)] AS v FROM orders) GROUP BY 1")
def null_tokens(spark, d):
    tokens = [*infer.NULL_TOKENS, "NaN", "null"]
    v = F.element_at(F.array(*map(F.lit, tokens)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = read(spark, d, "orders").select(v.alias("token"))
    return rows.groupBy("token").agg(F.count(infer.cell(F.col("token"))).alias("n_kept"), F.count("*").alias("n"))


_VARCHARS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "nation": ["n_name"], "documents": ["lang", "source", "text"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) <= 0.05 AS categorical FROM {t}" for t, cs in _VARCHARS.items() for c in cs))
def varchar_class(spark, d):
    out = None
    for t, cs in _VARCHARS.items():
        one = read(spark, d, t).agg(*(infer.is_categorical(F.col(c)).alias(c) for c in cs))
        part = one.select(F.lit(t).alias("table"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("categorical")) for c in cs))).alias("x")).select("table", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


_CELLS = {
    "CAST(o_orderdate AS DATE) || ' 03:04:05'": lambda: F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 03:04:05")), "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)": lambda: F.date_format("o_orderdate", "yyyy-MM-dd"),
    "CAST(o_orderdate AS DATE) || 'T03:04:05Z'": lambda: F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T03:04:05Z")), "'2023-13-' || (10 + o_orderkey % 90)": lambda: F.concat(F.lit("2023-13-"), (F.col("o_orderkey") % 90 + 10).cast("string")),
    "o_custkey || 'abc'": lambda: F.concat(F.col("o_custkey").cast("string"), F.lit("abc")), "'-' || o_custkey || '.5e3x'": lambda: F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit(".5e3x")),
    "'.' || o_custkey": lambda: F.concat(F.lit("."), F.col("o_custkey").cast("string")), "o_orderstatus": lambda: F.col("o_orderstatus"), "''": lambda: F.lit(""),
}
_CELL_SQL = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_CELLS)) + " END"


@query(rf"SELECT o_orderkey, t AS text, CASE WHEN t LIKE '____-__-__ __:__:__' THEN epoch(try_strptime(t, '%Y-%m-%d %H:%M:%S'))::BIGINT ELSE epoch(try_strptime(substr(t, 1, 10), '%Y-%m-%d'))::BIGINT END AS seconds, try_cast(regexp_extract(t, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AS DOUBLE) AS number FROM (SELECT o_orderkey, {_CELL_SQL} AS t FROM orders)")
def cell_parsing(spark, d):
    """Times and numbers in cells made of orders: whole ones, dates alone, other shapes, no dates, numbers with something behind them, nothing."""
    text = F.coalesce(*(F.when(F.col("o_orderkey") % len(_CELLS) == i, make()) for i, make in enumerate(_CELLS.values())))
    t = read(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return t.select("o_orderkey", "text", F.unix_timestamp(infer.parse_timestamp(F.col("text"))).alias("seconds"), infer.parse_number(F.col("text")).alias("number"))


@query(f"SELECT o_orderkey + {_WIDE} AS id, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))::BIGINT AS seconds, o_custkey || ', \"' || o_orderkey || '\"' AS note FROM orders")
def csv_round_trip(spark, d):
    """A table written as CSV and read again: types by its values, keys that need 61 bits, null tokens, quotes and commas."""
    from kinfold.sources.tables import read_csv_database, write_csv

    k = F.col("o_orderkey")
    note = F.concat(F.col("o_custkey").cast("string"), F.lit(', "'), k.cast("string"), F.lit('"'))
    rows = read(spark, d, "orders").select((k + _WIDE).alias("id"), F.col("o_totalprice").alias("price"), F.when(k % 7 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), note.alias("note"))
    db, folder = Database(), _folder(spark, "csv")
    db.add_table(Table("orders.csv", rows, {}))
    write_csv(db, folder)
    t = read_csv_database(spark, folder).get_table("orders")
    return t.df.select("id", "price", "status", F.unix_timestamp("day").alias("seconds"), "note")


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from kinfold.sources.shared import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS number, o_custkey || ' kg' AS number_raw, lpad(CAST(o_custkey % 7 AS VARCHAR), 3, '0') AS code FROM orders")
def csv_given_types(spark, d):
    """Types that are given win: codes of digits stay text, numbers with a unit behind them are parsed, and their cells are kept beside them."""
    from kinfold.sources.tables import read_csv, write_csv

    k, db, folder = F.col("o_custkey"), Database(), _folder(spark, "csv")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(k.cast("string"), F.lit(" kg")).alias("number"), F.lpad((k % 7).cast("string"), 3, "0").alias("code"))
    db.add_table(Table("orders", rows, {}))
    write_csv(db, folder)
    t = read_csv(spark, f"{folder}/orders", "orders", {"number": LogicalType.NUMERICAL, "code": LogicalType.CATEGORICAL}, raw_columns=["number"])
    return t.df.select("id", F.col("number").cast("double").alias("number"), "number_raw", "code")


@query("SELECT o_orderkey AS game, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS shots, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS fouls, 0.0::DOUBLE AS saves FROM orders")
def side_file_defaults(spark, d):
    """A side file with blanks around names and numbers, cells that are none, and without a column that is asked for."""
    from kinfold.sources.tables import side_file

    k, path = F.col("o_orderkey"), _folder(spark, "side")
    shots = F.when(k % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")))
    fouls = F.when(k % 5 != 0, (k % 100).cast("string"))
    read(spark, d, "orders").select(k.alias("game"), shots.alias(" shots"), fouls.alias("fouls ")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    assert side_file(spark, f"{path}-missing", {"game": "game"}) is None
    out = side_file(spark, path, {"game": "game", "shots": "shots", "fouls": "fouls", "saves": "saves"})
    return out.select(F.col("game").cast("long").alias("game"), "shots", "fouls", "saves")


def _class_sql(table: str, column: str) -> str:
    return f"CASE WHEN (SELECT count(DISTINCT {column}) / CAST(count({column}) AS DOUBLE) <= 0.05 FROM {table}) THEN 'CATEGORICAL' ELSE 'TEXT' END"


_ROLES = [
    ("users", 0, "userId", "'NUMERICAL'", "CASE WHEN (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) THEN 'pk' ELSE 'feature' END"), ("users", 1, "balance", "'NUMERICAL'", "'feature'"),
    ("users", 2, "segment", _class_sql("customer", "c_mktsegment"), "'feature'"),
    ("sales", 0, "id", "'NUMERICAL'", "CASE WHEN (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) THEN 'pk' ELSE 'feature' END"),
    ("sales", 1, "userId", "'NUMERICAL'", "CASE WHEN (SELECT count(c_custkey) / CAST(count(*) AS DOUBLE) >= 0.99 FROM orders LEFT JOIN customer ON c_custkey = o_custkey) THEN 'fk:users' ELSE 'feature' END"),
    ("sales", 2, "created_at", "'TIMESTAMP'", "'time'"), ("sales", 3, "status", _class_sql("orders", "o_orderstatus"), "'feature'"),
]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", {i} AS position, '{c}' AS \"column\", {kind} AS type, {role} AS role" for t, i, c, kind, role in _ROLES))
def catalog_roles(spark, d):
    """The session's views as a database: types, and keys, times and foreign keys that names and values tell."""
    from kinfold.sources.tables import catalog

    read(spark, d, "customer").select(F.col("c_custkey").alias("userId"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).createOrReplaceTempView("users")
    read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("userId"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status")).createOrReplaceTempView("sales")
    try:
        return keys.with_detected_fks(catalog(spark, ["users", "sales"])).describe(spark)
    finally:
        spark.catalog.dropTempView("users")
        spark.catalog.dropTempView("sales")


# --- encoders and labels ---------------------------------------------------------------------------------------------


@query("SELECT 'acctbal' AS \"column\", round(avg(v) + 1e-7, 4) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END + 1e-7, 4) AS std FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v FROM customer) UNION ALL SELECT 'constant', 3.0 + 0, 1.0")
def numeric_stats(spark, d):
    c = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"), F.lit(3.0).alias("k"))
    one = c.agg(*encoders.numeric_stats(F.col("v"), "v"), *encoders.numeric_stats(F.col("k"), "k"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), r4(F.col(f"{x}mean")).alias("mean"), r4(F.col(f"{x}std")).alias("std")) for n, x in (("acctbal", "v"), ("constant", "k"))))).alias("r")).select("r.*")


@query("WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v FROM customer), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM v) SELECT c_custkey, round((coalesce(v, m) - m) / s + 1e-7, 4) AS z FROM v, s")
def zscore_encode(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))
    stats = c.agg(*encoders.numeric_stats(F.col("v"), "_"))
    return c.crossJoin(F.broadcast(stats)).select("c_custkey", r4(encoders.zscore(F.col("v"), F.col("_mean"), F.col("_std"))).alias("z"))


@query("SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS index FROM (SELECT DISTINCT p_brand FROM part)")
def vocab_index(spark, d):
    return encoders.vocabulary(read(spark, d, "part"), "p_brand")


@query("SELECT c_custkey, v AS value, CASE WHEN v = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'new' ELSE c_mktsegment END AS s FROM customer), (SELECT DISTINCT c_mktsegment AS v FROM customer)")
def onehot_encode(spark, d):
    c = read(spark, d, "customer")
    vocab = [r["value"] for r in encoders.vocabulary(c, "c_mktsegment").orderBy("index").collect()]
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, None).when(k % 11 == 0, "new").otherwise(F.col("c_mktsegment"))
    hot = F.arrays_zip(F.array(*map(F.lit, vocab)).alias("value"), encoders.one_hot(s, vocab).alias("hot"))
    return c.select("c_custkey", F.explode(hot).alias("x")).select("c_custkey", F.col("x.value").alias("value"), F.col("x.hot").alias("hot"))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS t FROM orders), s AS (SELECT avg(year(t)) AS m, stddev_pop(year(t)) AS s FROM t)
SELECT o_orderkey, round(coalesce(sin(2 * pi() * month(t) / 12), 0) + 1e-7, 4) AS sin_month, round(coalesce(cos(2 * pi() * month(t) / 12), 0) + 1e-7, 4) AS cos_month, round(coalesce(sin(2 * pi() * day(t) / 31), 0) + 1e-7, 4) AS sin_day,
  round(coalesce(cos(2 * pi() * day(t) / 31), 0) + 1e-7, 4) AS cos_day, round(coalesce((year(t) - m) / s, 0) + 1e-7, 4) AS year_z FROM t, s""")
def timestamp_encode(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("t"))
    stats = t.agg(*encoders.year_stats(F.col("t"), "_"))
    parts = encoders.time_parts(F.col("t"), F.col("_mean"), F.col("_std"))
    rows = t.crossJoin(F.broadcast(stats)).select("o_orderkey", parts.alias("x"))
    return rows.select("o_orderkey", *(r4(F.col("x")[i]).alias(n) for i, n in enumerate(("sin_month", "cos_month", "sin_day", "cos_day", "year_z"))))


@query("SELECT p_partkey, CAST(list_contains(string_split(p_name, ' '), 'red') AS DOUBLE) AS red, CAST(list_contains(string_split(p_name, ' '), 'blue') AS DOUBLE) AS blue FROM part")
def multi_hot_encode(spark, d):
    hot = encoders.multi_hot(F.col("p_name"), ["red", "blue"], " ")
    return read(spark, d, "part").select("p_partkey", hot.alias("x")).select("p_partkey", F.col("x")[0].alias("red"), F.col("x")[1].alias("blue"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS at_least, CASE WHEN floor(o_totalprice / 1000) > 150 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS above FROM orders")
def label_threshold(spark, d):
    a, b = LabelTransform("threshold", 150000.0), LabelTransform("threshold", 150.0, inclusive=False)
    return read(spark, d, "orders").select("o_orderkey", a.apply(F.col("o_totalprice")).alias("at_least"), b.apply(F.floor(F.col("o_totalprice") / 1000)).alias("above"))


@query("SELECT o_orderkey, CASE WHEN v < 50 THEN 0.0::DOUBLE WHEN v < 100 THEN 1.0::DOUBLE WHEN v < 200 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS label FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS v FROM orders)")
def label_buckets(spark, d):
    t = LabelTransform("buckets", bounds=(50.0, 100.0, 200.0))
    return read(spark, d, "orders").select("o_orderkey", t.apply(F.floor(F.col("o_totalprice") / 1000)).alias("label"))


_TEMPORAL = "o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), s AS (SELECT *, CASE WHEN i < n * 70 // 100 THEN 'train' WHEN i < n * 85 // 100 THEN 'val' ELSE 'test' END AS split FROM o)"


def _temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal(read(spark, d, "orders"), "o_orderdate", "o_orderkey")


@query(f"WITH {_TEMPORAL}, t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM s WHERE split = 'train') SELECT o_orderkey, round((o_totalprice - m) / d + 1e-7, 4) AS label FROM s, t")
def label_normalize(spark, d):
    rows = _temporal(spark, d)
    t = LabelTransform("normalize").fitted(rows.where("split = 'train'"), "o_totalprice")
    return rows.select("o_orderkey", r4(t.apply(F.col("o_totalprice"))).alias("label"))


@query(f"WITH {_TEMPORAL} SELECT o_orderkey, split FROM s")
def split_temporal(spark, d):
    return _temporal(spark, d).select("o_orderkey", "split")


@query("WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS y, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS t FROM orders), o AS (SELECT *, row_number() OVER (ORDER BY t, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM r WHERE y IS NOT NULL AND t IS NOT NULL), s AS (SELECT *, CASE WHEN i < n * 70 // 100 THEN 'train' WHEN i < n * 85 // 100 THEN 'val' ELSE 'test' END AS split FROM o), t AS (SELECT avg(y) AS m, stddev_pop(y) AS d FROM s WHERE split = 'train') SELECT o_orderkey, round((y - m) / d + 1e-7, 4) AS label, split FROM s, t")
def split_without_labels(spark, d):
    """A task's rows: those without a label or a time are in no split, and the label's mean and deviation are those of the training rows."""
    from kinfold.plans.task import TaskSpec, build_split

    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select("o_orderkey", F.when(k % 9 != 0, F.col("o_totalprice")).alias("y"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("t"))
    table = Table("orders", rows, {"o_orderkey": LogicalType.NUMERICAL, "y": LogicalType.NUMERICAL, "t": LogicalType.TIMESTAMP}, "o_orderkey", "t")
    out, _ = build_split(table, TaskSpec("orders", "y", "regression", LabelTransform("normalize"), "temporal"), "o_orderkey")
    return out.select("o_orderkey", r4(F.col("label")).alias("label"), "split")


@query(f"WITH {_TEMPORAL} SELECT o_orderkey AS node, CASE WHEN o_totalprice >= 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, split FROM s")
def task_file(spark, d):
    """Labels and splits saved as a task's CSV, by keys that need 61 bits, and loaded again."""
    from kinfold.sources.tables import load_task, save_task

    table = read(spark, d, "orders").select(F.col("o_orderkey").alias(graph.NODE), (F.col("o_orderkey") + _WIDE).alias("id"))
    samples = _temporal(spark, d).select(F.col("o_orderkey").alias(graph.NODE), LabelTransform("threshold", 150000.0).apply(F.col("o_totalprice")).alias("label"), "split")
    path = _folder(spark, "task")
    save_task(samples, table, "id", path)
    return load_task(spark, path, table, "id").withColumnRenamed(graph.NODE, "node")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i < n * 70 // 100 THEN 'train' WHEN i < n * 85 // 100 THEN 'val' ELSE 'test' END AS split FROM o")
def split_random_md5(spark, d):
    return splits.by_hash(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@query(f"WITH {_TEMPORAL} SELECT split, count(*) AS n, count(*) FILTER (o_totalprice >= 150000) AS n_pos, count(*) FILTER (o_totalprice < 150000) AS n_neg, count(*) FILTER (o_totalprice >= 150000) / CAST(count(*) AS DOUBLE) AS pos_rate, min(o_orderdate) AS first, max(o_orderdate) AS last FROM s GROUP BY 1")
def split_stats(spark, d):
    rows = _temporal(spark, d).withColumn("label", LabelTransform("threshold", 150000.0).apply(F.col("o_totalprice")))
    return splits.stats(rows, time_col="o_orderdate")


@query("SELECT CAST(sum(toxic) AS BIGINT) AS n_pos, CAST(sum(1 - toxic) AS BIGINT) AS n_neg, CAST(sum(1 - toxic) AS DOUBLE) / sum(toxic) AS pos_weight FROM labels")
def class_balance(spark, d):
    return labels.class_balance(read(spark, d, "labels"), "toxic")


@query("WITH l AS (SELECT quality * 2 + toxic AS c FROM labels), n AS (SELECT k AS class, count(c) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k) LEFT JOIN l ON c = k GROUP BY 1) SELECT CAST(class AS INT) AS class, n, CASE WHEN n > 0 THEN round(((SELECT count(*) FROM l) / 5.0) / n + 1e-7, 4) ELSE 1.0 END AS weight FROM n")
def class_weights(spark, d):
    rows = read(spark, d, "labels").select((F.col("quality") * 2 + F.col("toxic")).alias("label"))
    out = labels.class_weights(rows, 5)
    return out.select("class", "n", F.when(F.col("n") > 0, r4(F.col("weight"))).otherwise(1.0).alias("weight"))


@query("WITH n AS (SELECT quality * 2 + toxic AS class, 1 / sqrt(count(*)) AS w FROM labels GROUP BY 1) SELECT class, round(w / (SELECT avg(w) FROM n) + 1e-7, 4) AS weight FROM n")
def class_weights_sqrt(spark, d):
    rows = read(spark, d, "labels").select((F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return labels.sqrt_inverse_weights(rows).select("class", r4(F.col("weight")).alias("weight"))


# --- inference -------------------------------------------------------------------------------------------------------

_FILTERS = [InferenceFilter("o_orderstatus", "=", "F"), InferenceFilter("o_totalprice", ">=", "50000"), InferenceFilter("o_orderdate", "<", "1999-01-01"), InferenceFilter("nothing", "=", "1"), InferenceFilter("o_orderpriority", ">", "zzz")]
_PASS = "FROM (SELECT *, (o_orderkey * 37 % 101) / 101.0::DOUBLE AS prediction FROM orders) WHERE o_orderstatus = 'F' AND o_totalprice >= 50000 AND o_orderdate < TIMESTAMP '1999-01-01'"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").withColumn("prediction", (F.col("o_orderkey") * 37 % 101) / 101.0)


@query(f"SELECT o_orderkey, prediction {_PASS}")
def infer_filter_rows(spark, d):
    return inference.apply_inference(_scored(spark, d), _FILTERS).select("o_orderkey", "prediction")


@query(f"SELECT round(avg(prediction) + 1e-7, 4) AS value, count(*) AS n_rows {_PASS}")
def infer_filter_mean(spark, d):
    return inference.apply_inference(_scored(spark, d), _FILTERS, "mean").select(r4(F.col("value")).alias("value"), "n_rows")


@query(f"SELECT round(avg(CAST(prediction >= 0.5 AS DOUBLE)) + 1e-7, 4) AS value, count(*) AS n_rows {_PASS}")
def infer_filter_fraction(spark, d):
    return inference.apply_inference(_scored(spark, d), _FILTERS, "fraction").select(r4(F.col("value")).alias("value"), "n_rows")


@query(f"SELECT sum(CAST(prediction >= 0.5 AS DOUBLE)) AS value, count(*) AS n_rows {_PASS}")
def infer_filter_count(spark, d):
    return inference.apply_inference(_scored(spark, d), _FILTERS, "count")


@query("SELECT CAST(NULL AS DOUBLE) AS value, CAST(0 AS BIGINT) AS n_rows")
def infer_filter_empty(spark, d):
    return inference.apply_inference(_scored(spark, d), [InferenceFilter("o_totalprice", "<", "-1")], "mean")


@query("SELECT CAST(o_orderkey % 7 % 3 AS INT) AS class, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders) + 1e-7, 4) AS percent FROM orders GROUP BY 1")
def prediction_distribution(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_orderkey") % 7 % 3).alias("prediction"))
    return inference.prediction_distribution(rows).select("class", "n", r4(F.col("percent")).alias("percent"))


@query("SELECT round((a.acctbal + b.retail) / 2 + 1e-7, 4) AS x, CAST(2 AS BIGINT) AS n_found FROM (SELECT c_acctbal AS acctbal FROM customer WHERE c_custkey = 7) a, (SELECT p_retailprice AS retail FROM part WHERE p_partkey = 11) b")
def entity_pool(spark, d):
    a = inference.entity_row(read(spark, d, "customer"), "c_custkey", 7, "c_custkey").select(F.col("c_acctbal").alias("x"))
    b = inference.entity_row(read(spark, d, "part"), "p_partkey", 11, "p_partkey").select(F.col("p_retailprice").alias("x"))
    return inference.mean_pool([a, b], ["x"]).select(r4(F.col("x")).alias("x"), "n_found")


# --- metrics and losses ----------------------------------------------------------------------------------------------

_SCORES = "(SELECT o_orderkey AS k, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS s, CASE WHEN (o_orderkey * 31 + o_custkey) % 10 < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM orders)"


def _pseudo(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("k"), (k * 7919 % 10007 / 10007.0).alias("s"), recipes.flag((k * 31 + F.col("o_custkey")) % 10 < 3).alias("y"))


@query(f"""
WITH c AS (SELECT count(*) FILTER (s >= 0.5 AND y > 0.5)::DOUBLE AS tp, count(*) FILTER (s >= 0.5 AND y <= 0.5)::DOUBLE AS fp, count(*) FILTER (s < 0.5 AND y > 0.5)::DOUBLE AS fn, count(*) FILTER (s < 0.5 AND y <= 0.5)::DOUBLE AS tn FROM {_SCORES})
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn) + 1e-7, 4) AS accuracy, round(2 * tp / (2 * tp + fp + fn) + 1e-7, 4) AS f1 FROM c""")
def metrics_binary(spark, d):
    return metrics.binary(_pseudo(spark, d), "s", "y").withColumns({"accuracy": r4(F.col("accuracy")), "f1": r4(F.col("f1"))})


@query(f"""
WITH r AS (SELECT y, sum(y) OVER (ORDER BY s DESC, k) AS tp, row_number() OVER (ORDER BY s DESC, k) AS i FROM {_SCORES}),
t AS (SELECT s, count(*) AS n, sum(y) AS p FROM {_SCORES} GROUP BY 1), u AS (SELECT n, p, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM t)
SELECT round(sum(CASE WHEN y = 0 THEN tp END) / (sum(y) * sum(1 - y)) + 1e-7, 4) AS auc, round((SELECT sum((n - p) * (p0 + p / 2)) / (sum(p) * sum(n - p)) FROM u) + 1e-7, 4) AS auc_ties, round(sum(CASE WHEN y = 1 THEN tp / i END) / sum(y) + 1e-7, 4) AS average_precision FROM r""")
def metrics_auc_ap(spark, d):
    out = metrics.ranking(_pseudo(spark, d), "s", "y", "k", ties=True)
    return out.select(*(r4(F.col(c)).alias(c) for c in out.columns))


@query("SELECT round(sqrt(avg((p - y) ** 2)) + 1e-7, 4) AS rmse, round(avg(abs(p - y)) + 1e-7, 4) AS mae, round(1 - sum((p - y) ** 2) / (sum(y * y) - count(*) * avg(y) * avg(y)) + 1e-7, 4) AS r2 FROM (SELECT o_totalprice / 1e5 AS y, o_totalprice / 1e5 + (o_orderkey % 13 - 6) / 20.0 AS p FROM orders)")
def metrics_regression(spark, d):
    y = F.col("o_totalprice") / 1e5
    out = metrics.regression(read(spark, d, "orders").select(y.alias("y"), (y + (F.col("o_orderkey") % 13 - 6) / 20.0).alias("p")), "p", "y")
    return out.select(*(r4(F.col(c)).alias(c) for c in out.columns))


@query("""
WITH r AS (SELECT o_orderkey % 3 AS y, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey + 1) % 3 ELSE o_orderkey % 3 END AS p FROM orders),
c AS (SELECT k, count(*) FILTER (p = k AND y = k)::DOUBLE AS tp, count(*) FILTER (p = k AND y <> k)::DOUBLE AS fp, count(*) FILTER (p <> k AND y = k)::DOUBLE AS fn FROM r, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1)
SELECT round(sum(tp) / (SELECT count(*) FROM r) + 1e-7, 4) AS accuracy, round(sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) / 4 + 1e-7, 4) AS macro_f1 FROM c""")
def metrics_multiclass(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select((k % 3).alias("y"), F.when(k % 5 == 0, (k + 1) % 3).otherwise(k % 3).alias("p"))
    out = metrics.multiclass(rows, "p", "y", 4)
    return out.select(*(r4(F.col(c)).alias(c) for c in out.columns))


@query(f"SELECT round(avg((CASE WHEN y > 0.5 THEN 2.5 ELSE 1 END) * (-y * x + ln(1 + exp(-abs(x))) + greatest(x, 0))) + 1e-7, 4) AS loss FROM (SELECT (s - 0.5) * 8 AS x, y FROM {_SCORES})")
def loss_bce(spark, d):
    return _pseudo(spark, d).agg(r4(F.avg(metrics.bce((F.col("s") - 0.5) * 8, F.col("y"), 2.5))).alias("loss"))


@query(f"SELECT round(avg((s - y) ** 2) + 1e-7, 4) AS loss FROM {_SCORES}")
def loss_mse(spark, d):
    return _pseudo(spark, d).agg(r4(F.avg(metrics.mse(F.col("s"), F.col("y")))).alias("loss"))


@query(f"SELECT round(avg((CASE WHEN y = 1 THEN 3.0 ELSE 0.5 END) * (ln(exp(s) + exp(1 - s) + exp(s * s)) - CASE WHEN y = 1 THEN 1 - s ELSE s END)) + 1e-7, 4) AS loss FROM {_SCORES}")
def loss_ce(spark, d):
    s = F.col("s")
    row = metrics.cross_entropy(F.array(s, 1 - s, s * s), F.col("y"), F.array(F.lit(0.5), F.lit(3.0), F.lit(1.0)))
    return _pseudo(spark, d).agg(r4(F.avg(row)).alias("loss"))


# --- recipes ---------------------------------------------------------------------------------------------------------


@query("WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT c_custkey, last, CASE WHEN last IS NULL OR last < (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS will_churn FROM customer LEFT JOIN l ON o_custkey = c_custkey")
def churn_label(spark, d):
    return recipes.churn(read(spark, d, "customer"), "c_custkey", read(spark, d, "orders"), "o_custkey", "o_orderdate", 180)


@query("WITH c AS (SELECT max(ts) - INTERVAL 4 DAY AS c FROM events), p AS (SELECT user_id, event_type, bool_or(ts < c) AS b, bool_or(ts >= c) AS a FROM events, c GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM p WHERE b")
def pair_candidates(spark, d):
    return recipes.pair_candidates(read(spark, d, "events"), "user_id", "event_type", "ts", 4)


@query("WITH c AS (SELECT max(l_shipdate) - INTERVAL 365 DAY AS c FROM lineitem), p AS (SELECT l_suppkey, l_partkey % 50 AS part, bool_or(l_shipdate < c) AS b, bool_or(l_shipdate >= c) AS a FROM lineitem, c GROUP BY 1, 2) SELECT l_suppkey, part, CASE WHEN a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM p WHERE b")
def pair_candidates_parts(spark, d):
    rows = read(spark, d, "lineitem").withColumn("part", F.col("l_partkey") % 50)
    return recipes.pair_candidates(rows, "l_suppkey", "part", "l_shipdate", 365)


_GAMES = """g AS (SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS season, o_custkey % 20 AS home, (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5 AS INT) END AS home_goals, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 3 % 4 AS INT) END AS away_goals FROM orders)"""
_SIDES = "t AS (SELECT game, day, season, home AS team, true AS is_home, home_goals::DOUBLE AS gf, away_goals::DOUBLE AS ga FROM g UNION ALL SELECT game, day, season, away, false, away_goals::DOUBLE, home_goals::DOUBLE FROM g)"


def _games(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").select(
        k.alias("game"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), (c % 20).alias("home"), ((c % 20 + 1 + k % 19) % 20).alias("away"),
        F.when(k % 11 != 0, (k % 5).cast("int")).alias("home_goals"), F.when(k % 11 != 0, (k * 3 % 4).cast("int")).alias("away_goals"),
    )


@query(f"""
WITH {_GAMES}, {_SIDES}, p AS (SELECT *, count(gf) OVER (PARTITION BY team ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i,
  max(CASE WHEN gf IS NOT NULL THEN day END) OVER (PARTITION BY team ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t)
SELECT game, team, is_home, round(coalesce(sum(CAST(gf > ga AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS wins, round(coalesce(sum(CAST(gf = ga AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS draws, round(coalesce(sum(CAST(gf < ga AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS losses,
  round(coalesce(sum(gf) OVER w, 0) / 25.0 + 1e-7, 4) AS goals_scored, round(coalesce(sum(ga) OVER w, 0) / 25.0 + 1e-7, 4) AS goals_conceded, round(coalesce(sum(CAST(ga = 0 AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS clean_sheets,
  round(coalesce(sum(CAST(gf > ga AND is_home AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS home_wins, round(coalesce(sum(CAST(gf > ga AND NOT is_home AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS away_wins
FROM p WINDOW w AS (PARTITION BY team ORDER BY i RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def rolling_last5(spark, d):
    form = recipes.rolling_form(_games(spark, d)).drop("days_rest")
    return form.select("game", "team", "is_home", *(r4(F.col(c)).alias(c) for c in form.columns[3:]))


@query(f"WITH {_GAMES}, {_SIDES}, p AS (SELECT *, max(CASE WHEN gf IS NOT NULL THEN day END) OVER (PARTITION BY team ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t) SELECT game, team, round(CASE WHEN last IS NULL THEN 14.0 ELSE least(day - last, 14) / 14.0 END + 1e-7, 4) AS days_rest FROM p")
def days_rest(spark, d):
    return recipes.rolling_form(_games(spark, d)).select("game", "team", r4(F.col("days_rest")).alias("days_rest"))


_SEASON = """p AS (SELECT *, coalesce(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) OVER w, 0) AS pts, coalesce(sum(gf - ga) OVER w, 0) AS gd, count(gf) OVER w AS n FROM t WINDOW w AS (PARTITION BY team, season ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_GAMES}, {_SIDES}, {_SEASON} SELECT game, team, is_home, round(pts / 99.0 + 1e-7, 4) AS points, round(least(greatest(gd / 50.0, -1), 1) * 0.5 + 0.5 + 1e-7, 4) AS gd, round(CASE WHEN n > 0 THEN least(pts / (3.0 * n), 1) ELSE 0 END + 1e-7, 4) AS ppg FROM p")
def season_to_date(spark, d):
    return recipes.season_table(_games(spark, d)).select("game", "team", "is_home", *(r4(F.col(c)).alias(c) for c in ("points", "gd", "ppg")))


@query(f"WITH {_GAMES}, {_SIDES}, {_SEASON} SELECT a.game, round((a.pts - b.pts + 99) / 198.0 + 1e-7, 4) AS points_diff FROM p a JOIN p b ON a.game = b.game AND a.is_home AND NOT b.is_home")
def season_points_diff(spark, d):
    return recipes.season_features(_games(spark, d)).select("game", r4(F.col("points_diff")).alias("points_diff"))


_H2H = """p AS (SELECT *, count(home_goals) OVER (PARTITION BY {k} ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i FROM g)
SELECT game, round(coalesce(sum(CAST(home_goals > away_goals AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS h2h_home_wins, round(coalesce(sum(CAST(home_goals = away_goals AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS h2h_draws,
  round(coalesce(sum(CAST(home_goals < away_goals AS INT)) OVER w, 0) / 5.0 + 1e-7, 4) AS h2h_away_wins FROM p WINDOW w AS (PARTITION BY {k} ORDER BY i RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


def _h2h(games: DataFrame, ordered: bool) -> DataFrame:
    out = recipes.head_to_head(games, ordered)
    return out.select("game", *(r4(F.col(c)).alias(c) for c in out.columns[1:]))


@query(f"WITH {_GAMES}, " + _H2H.format(k="home, away"))
def head_to_head(spark, d):
    return _h2h(_games(spark, d), True)


@query(f"WITH {_GAMES}, " + _H2H.format(k="least(home, away), greatest(home, away)"))
def head_to_head_unordered(spark, d):
    return _h2h(_games(spark, d), False)


@query(f"WITH {_GAMES} SELECT game, CASE WHEN home_goals IS NULL THEN NULL WHEN home_goals > away_goals THEN 0.0::DOUBLE WHEN home_goals = away_goals THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS outcome FROM g")
def outcome_label(spark, d):
    return _games(spark, d).select("game", recipes.outcome(F.col("home_goals"), F.col("away_goals")).alias("outcome"))


@query("SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS VARCHAR) END AS DOUBLE) AS label FROM events")
def text_label(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", recipes.numeric_label(F.when(e % 4 == 0, "n/a").otherwise((e % 1000).cast("string"))).alias("label"))


@query("SELECT event_id, user_id, round(least(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) / 100, 1) + 1e-7, 4) AS roll_value FROM events")
def rolling_stats(spark, d):
    rows = recipes.rolling_stats(read(spark, d, "events"), "user_id", ["ts", "event_id"], {"value": 100.0})
    return rows.select("event_id", "user_id", r4(F.col("roll_value")).alias("roll_value"))


@query("SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def topk_per_user(spark, d):
    return recipes.top_k(read(spark, d, "events"), "user_id", "value", "event_id").select("user_id", "event_id", "value", "rank")


@query("SELECT l_partkey, round(m + 1e-7, 4) AS mean_value FROM (SELECT l_partkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1 ORDER BY m DESC, l_partkey LIMIT 10)")
def top10_mean(spark, d):
    return recipes.top_means(read(spark, d, "lineitem"), "l_partkey", "l_quantity").select("l_partkey", r4(F.col("mean_value")).alias("mean_value"))


@query("WITH e AS (SELECT *, year(ts) AS y, week(ts) AS w, CASE WHEN event_id % 3 <> 0 THEN value END AS label FROM events), k AS (SELECT * FROM e WHERE label IS NOT NULL) SELECT event_id, label FROM k WHERE (y, w) = (SELECT (y, w) FROM k ORDER BY y DESC, w DESC LIMIT 1)")
def latest_period(spark, d):
    rows = read(spark, d, "events").select("event_id", F.year("ts").alias("y"), F.weekofyear("ts").alias("w"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("label"))
    return recipes.latest_period(rows, "y", "w", "label").select("event_id", "label")


@query("""
WITH q AS (SELECT c_custkey AS user_id, t.event_type FROM customer, (SELECT DISTINCT event_type FROM events) t),
p AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2), u AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1)
SELECT q.user_id, q.event_type, coalesce(p.v, u.v) AS value, CASE WHEN p.v IS NOT NULL THEN 'pair' WHEN u.v IS NOT NULL THEN 'first' ELSE 'none' END AS source
FROM q LEFT JOIN p ON q.user_id = p.user_id AND q.event_type = p.event_type LEFT JOIN u ON q.user_id = u.user_id""")
def asof_pair_lookup(spark, d):
    e = read(spark, d, "events")
    types = e.select("event_type").distinct()
    asked = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).crossJoin(F.broadcast(types))
    return recipes.pair_lookup(asked, e, "user_id", "event_type", ["ts", "event_id"], "value").select("user_id", "event_type", "value", "source")


@query("SELECT s_suppkey, s_name, coalesce(n_name, '?') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dim_lookup_default(spark, d):
    dim = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return recipes.with_defaults(read(spark, d, "supplier"), dim, ["s_nationkey"], ["n_name"], "?").select("s_suppkey", "s_name", "n_name")


@query("SELECT o_orderkey, coalesce(v, 0.0) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity)) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def stats_lookup_last(spark, d):
    """Of repeated keys the last row counts; orders without any get 0."""
    last = recipes.last_of(read(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"))
    return recipes.with_defaults(read(spark, d, "orders"), last, ["o_orderkey"], ["quantity"]).select("o_orderkey", "quantity")


@query("SELECT event_type, round(avg(coalesce(CASE WHEN event_id % 4 <> 0 THEN value END, 0)) + 1e-7, 4) AS with_zeros, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END) + 1e-7, 4) AS without FROM events GROUP BY 1")
def group_means(spark, d):
    """Means in which blanks count as zero, and in which they don't."""
    v = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return read(spark, d, "events").groupBy("event_type").agg(r4(F.avg(F.coalesce(v, F.lit(0.0)))).alias("with_zeros"), r4(F.avg(v)).alias("without"))


@query("SELECT o_orderkey, round(o_totalprice + 1e-7, 4) AS price, round(c_acctbal + 1e-7, 4) AS acctbal, n_name, CAST(o_orderstatus = 'F' AS INT) AS is_f, CAST(c_mktsegment = 'BUILDING' AS INT) AS is_building FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def flat_join_features(spark, d):
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    flat = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return flat.select("o_orderkey", r4(F.col("o_totalprice")).alias("price"), r4(F.col("c_acctbal")).alias("acctbal"), "n_name", (F.col("o_orderstatus") == "F").cast("int").alias("is_f"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("is_building"))


@query("SELECT n_nationkey, n_name, CAST(1 AS INT) AS match FROM nation WHERE contains('region nation_1 of x', lower(n_name)) OR contains(lower(n_name), 'region nation_1 of x')")
def fuzzy_name_match(spark, d):
    return recipes.fuzzy_match(read(spark, d, "nation"), "n_name", "Region NATION_1 of X").select("n_nationkey", "n_name", "match")


@query("SELECT event_id, d AS day, CASE d WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2 WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5 ELSE 6 END AS day_rank, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS INT) AS days FROM (SELECT event_id, ts, dayname(ts) AS d FROM events)")
def slot_order(spark, d):
    day = F.date_format("ts", "EEEE")
    return read(spark, d, "events").select("event_id", day.alias("day"), recipes.slot_order(day).alias("day_rank"), F.datediff("ts", F.lit("2000-01-01")).alias("days"))


@query(f"""WITH {_GAMES}, {_SIDES}, {_SEASON}, q AS (SELECT *, count(gf) OVER (PARTITION BY team ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i FROM t),
f AS (SELECT game, is_home, coalesce(sum(CAST(gf > ga AS INT)) OVER w, 0) / 5.0 AS wins, coalesce(sum(gf) OVER w, 0) / 25.0 AS goals FROM q WINDOW w AS (PARTITION BY team ORDER BY i RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT a.game, round(a.wins - b.wins + 1e-7, 4) AS diff_wins, round(a.goals - b.goals + 1e-7, 4) AS diff_goals_scored, round((x.pts - y.pts) / 99.0 + 1e-7, 4) AS diff_season_points
FROM f a JOIN f b ON a.game = b.game AND a.is_home AND NOT b.is_home JOIN p x ON x.game = a.game AND x.is_home JOIN p y ON y.game = a.game AND NOT y.is_home""")
def fixture_differences(spark, d):
    out = recipes.fixture_features(_games(spark, d))
    return out.select("game", *(r4(F.col(c)).alias(c) for c in ("diff_wins", "diff_goals_scored", "diff_season_points")))


@query(f"WITH {_GAMES}, t AS (SELECT s_suppkey AS team, CASE WHEN s_suppkey % 3 <> 0 THEN 1000.0 * s_suppkey END AS capacity FROM supplier) SELECT game, round(CASE WHEN team IS NULL THEN 0.5 ELSE coalesce(capacity, 40000) / 90000 END + 1e-7, 4) AS venue FROM g LEFT JOIN t ON team = home")
def venue_features(spark, d):
    """The capacity of the home team's ground; a default where it isn't known, another for teams that aren't there."""
    k = F.col("s_suppkey")
    teams = read(spark, d, "supplier").select(k.alias("team"), F.when(k % 3 != 0, k * 1000.0).alias("venue_capacity"))
    return recipes.venue_features(_games(spark, d), teams).select("game", r4(F.col("venue")).alias("venue"))


@query("SELECT p_brand, p_size, round(avg(CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END) + 1e-7, 4) AS price FROM part GROUP BY 1, 2")
def squad_means(spark, d):
    rows = read(spark, d, "part").withColumn("price", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")))
    return recipes.squad_means(rows, "p_brand", "p_size", ["price"]).withColumn("price", r4(F.col("price")))


@query("SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1998-08-01') AS n_before, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-08-01') AS n_after FROM orders")
def holdout_by_date(spark, d):
    a, b = recipes.before_date(read(spark, d, "orders"), "o_orderdate", "1998-08-01")
    return a.agg(F.count("*").alias("n_before")).crossJoin(b.agg(F.count("*").alias("n_after")))


_TEAM_STATS = {"shots_on": "o_orderkey % 9", "shots_tot": "o_orderkey % 21", "possession": "o_custkey % 101", "corners": "o_orderkey % 13", "fouls": "o_custkey % 17", "yellows": "o_orderkey % 6", "saves": "o_orderkey % 8", "pass_acc": "o_orderkey % 97"}
_PLAYER_STATS = {"rating": "l_quantity / 5", "goals_pp": "l_linenumber % 2", "assists_pp": "l_linenumber % 3", "tackles_pp": "l_quantity", "dribbles_pp": "l_discount"}
_ROLLED = [*_TEAM_STATS, *_PLAYER_STATS]
_ROLLING_SQL = f"""
WITH {_GAMES},
h AS (SELECT game, day, t AS team, t = home AS is_home FROM (SELECT *, unnest([home, away]) AS t FROM g) WHERE day < DATE '1997-01-01'),
s AS (SELECT o_orderkey AS game, o_custkey % 20 AS team, {", ".join(f"CAST({e} AS DOUBLE){' / 100' if c in recipes.PER_CENT else ''} AS {c}" for c, e in _TEAM_STATS.items())} FROM orders),
p AS (SELECT l_orderkey AS game, l_suppkey % 20 AS team, {", ".join(f"avg(CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE CAST({e} AS DOUBLE) END) AS {c}" for c, e in _PLAYER_STATS.items())} FROM lineitem GROUP BY 1, 2),
j AS (SELECT h.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _ROLLED)} FROM h LEFT JOIN s USING (game, team) LEFT JOIN p USING (game, team)),
r AS (SELECT game, is_home, {", ".join(f"least(coalesce(avg({c}) OVER w, 0) / {v}, 1) AS {c}" for c, v in (recipes.GAME_CAPS | recipes.PLAYER_CAPS).items())} FROM j WINDOW w AS (PARTITION BY team ORDER BY day, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT g.game, {", ".join(f"round(coalesce({x}.{c}, 0) + 1e-7, 4) AS {x}_roll_{c}" for x in "ha" for c in _ROLLED)}
FROM g LEFT JOIN (SELECT * FROM r WHERE is_home) h ON h.game = g.game LEFT JOIN (SELECT * FROM r WHERE NOT is_home) a ON a.game = g.game"""


@query(_ROLLING_SQL)
def rolling_features(spark, d):
    """Thirteen statistics of either team over its last five games before a cutoff: side tables with blanks, and games that they lack."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    teams = o.select(F.col("o_orderkey").alias("game"), (F.col("o_custkey") % 20).alias("team"), *(F.expr(e).alias(c) for c, e in _TEAM_STATS.items()))
    players = li.select(F.col("l_orderkey").alias("game"), (F.col("l_suppkey") % 20).alias("team"), *(F.when(F.col("l_linenumber") % 4 != 0, F.expr(e)).alias(c) for c, e in _PLAYER_STATS.items()))
    out = recipes.rolling_features(_games(spark, d), "1997-01-01", teams, players)
    return out.select("game", *(r4(F.col(f"{x}_roll_{c}")).alias(f"{x}_roll_{c}") for x in "ha" for c in _ROLLED))


def order_task(spark: SparkSession, d: str):
    """(a database of orders and customers, the task of telling orders whose customer has a balance of 4,500 or more, in the order of time).

    Orders have no such column among their features: only what their customers send them tells.
    """
    from kinfold.plans.task import TaskSpec
    from kinfold.schema import ForeignKey

    n, c = LogicalType.NUMERICAL, LogicalType.CATEGORICAL
    db, customers = Database(), read(spark, d, "customer")
    orders = read(spark, d, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_limit")), "o_custkey", "left")
    db.add_table(Table("customer", customers, {"c_custkey": n, "c_acctbal": n, "c_mktsegment": c}, "c_custkey"))
    db.add_table(Table("orders", orders, {"o_orderkey": n, "o_custkey": n, "o_orderstatus": c, "o_totalprice": n, "o_orderdate": LogicalType.TIMESTAMP, "o_limit": n}, "o_orderkey", "o_orderdate", (ForeignKey("o_custkey", "customer"),)))
    return db, TaskSpec("orders", "o_limit", label_transform=LabelTransform("threshold", 4500.0), split_strategy="temporal")


@query()
def train_predict_rows(spark, d):
    """Train a small model for two epochs and score every order; its weights come from a fixed seed."""
    from kinfold.plans.model import Config, train

    db, spec = order_task(spark, d)
    model = train(spark, spec, db, Config(channels=8, hidden=8, layers=1, epochs=2, lr=0.01, evaluate_every=2, exclude_fk=True))
    return model.predict().select("o_orderkey", "prediction")
