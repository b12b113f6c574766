"""Knowledge graph queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.operators import fusion, graph
from tandemlens.operators.ordered import running_totals
from tandemlens.plans.catalog import query, rnd
from tandemlens.plans.inputs import (
    LABELS_SQL,
    TRIPLES_SQL,
    documents,
    entity_labels,
    token_rows,
    token_rows_sql,
    triples,
)
from tandemlens.session import durable
from tandemlens.sources.tables import table


@query(f"SELECT pos, head, relation, tail, split FROM {TRIPLES_SQL}")
def kg_triples(spark, root):
    return triples(spark, root)


def vocab_sql(name: str) -> str:
    if name == "relation":
        places = f"SELECT relation AS name, pos AS place FROM {TRIPLES_SQL}"
    else:
        places = (
            f"SELECT head AS name, pos * 2 AS place FROM {TRIPLES_SQL} "
            f"UNION ALL SELECT tail, pos * 2 + 1 FROM {TRIPLES_SQL}"
        )
    return f"""(SELECT name AS {name}, row_number() OVER (ORDER BY place, name) AS id
    FROM (SELECT name, min(place) AS place FROM ({places}) GROUP BY name))"""


@query(f"SELECT entity, id FROM {vocab_sql('entity')}")
def kg_vocab(spark, root):
    return graph.vocabularies(triples(spark, root))[0]


@query(f"SELECT relation, id FROM {vocab_sql('relation')}")
def kg_relation_vocab(spark, root):
    return graph.vocabularies(triples(spark, root))[1]


ENCODED_SQL = f"""(
  SELECT t.pos, h.id AS src, r.id AS rel, e.id AS dst FROM {TRIPLES_SQL} t
  JOIN {vocab_sql("entity")} h ON h.entity = t.head
  JOIN {vocab_sql("relation")} r ON r.relation = t.relation
  JOIN {vocab_sql("entity")} e ON e.entity = t.tail WHERE t.split = 'train')"""


def _encoded(spark, root):
    """Training triples encoded with the vocabulary of all splits."""
    facts = triples(spark, root)
    train = facts.where(F.col("split") == "train")
    return graph.encode(train, *graph.vocabularies(facts))


@query(f"SELECT pos, src, rel, dst FROM {ENCODED_SQL}")
def kg_encode(spark, root):
    return _encoded(spark, root)


@query(
    f"""
SELECT t.pos, t.head, t.relation, t.tail, t.split, coalesce(h.entity_name, t.head) AS head_label,
  CASE t.relation WHEN 'in_region' THEN 'lies in region' WHEN 'in_nation' THEN 'based in nation'
    ELSE t.relation END AS relation_label, coalesce(e.entity_name, t.tail) AS tail_label
FROM {TRIPLES_SQL} t LEFT JOIN {LABELS_SQL} h ON h.entity_id = t.head
  LEFT JOIN {LABELS_SQL} e ON e.entity_id = t.tail"""
)
def kg_labels_default(spark, root):
    known = [("in_region", "lies in region"), ("in_nation", "based in nation")]
    relations = spark.createDataFrame(known, "relation_id STRING, relation_name STRING")
    return graph.with_labels(triples(spark, root), entity_labels(spark, root), relations)


EDGES_SQL = f"""(SELECT src, dst, rel FROM {ENCODED_SQL}
  UNION ALL SELECT dst, src, rel FROM {ENCODED_SQL})"""


@query(f"SELECT src, dst, rel FROM {EDGES_SQL}")
def kg_undirected(spark, root):
    return graph.undirected(_encoded(spark, root))


@query(f"SELECT dst AS node, count(*) AS degree FROM {EDGES_SQL} GROUP BY dst")
def node_degree(spark, root):
    return graph.degrees(graph.undirected(_encoded(spark, root)))


WORD_IDS_SQL = f"""(SELECT word, row_number() OVER (ORDER BY place, word) AS id FROM (
  SELECT word, min(item_id * 1000000 + pos) AS place FROM {token_rows_sql("benchmark", "item_id")}
  GROUP BY word))"""


@query(
    f"""
WITH l AS (SELECT t.doc_id, v.id, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS r
  FROM {token_rows_sql("documents", "doc_id")} t JOIN {WORD_IDS_SQL} v USING (word))
SELECT d.doc_id, count(l.id) AS n_links, coalesce(max(l.id) FILTER (r = 1), 0) AS first_id,
  coalesce(max(l.id) FILTER (r = 10), 0) AS last_id,
  cast(coalesce(sum(l.id), 0) AS bigint) AS id_sum
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id AND l.r <= 10 GROUP BY d.doc_id"""
)
def entity_linking(spark, root):
    """Words of the benchmark items are the entities that document words link to."""
    items = token_rows(table(spark, root, "benchmark"), "item_id", "text")
    place = (F.col("item_id") * 1_000_000 + F.col("pos")).alias("place")
    first = items.select("word", place).groupBy("word").agg(F.min("place").alias("place"))
    vocab = running_totals(first, [], [F.col("place"), F.col("word")], rank="id")
    vocab = durable(vocab.select("word", "id"), "word-ids")
    tokens = token_rows(documents(spark, root, "doc_id", "text"), "doc_id", "text")
    texts = table(spark, root, "documents")
    linked = graph.link_entities(texts, tokens, vocab, "doc_id")
    total = F.aggregate("entity_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return linked.select(
        "doc_id",
        "n_links",
        F.col("entity_ids")[0].alias("first_id"),
        F.col("entity_ids")[9].alias("last_id"),
        total.alias("id_sum"),
    )


SIZE = 8  # features per node in the message-passing queries

NODES_SQL = f"""(SELECT id AS node,
  list_transform(range({SIZE}), lambda i: ((id * (i + 3)) % 17 - 8) / 8e0) AS x
  FROM {vocab_sql("entity")})"""


def _nodes_and_edges(spark, root):
    """Undirected training edges, and a deterministic feature vector per entity."""
    facts = triples(spark, root)
    entities, relations = graph.vocabularies(facts)
    train = facts.where(F.col("split") == "train")
    edges = durable(graph.undirected(graph.encode(train, entities, relations)), "edges")
    values = [((F.col("id") * (i + 3)) % 17 - 8) / 8.0 for i in range(SIZE)]
    return entities.select(F.col("id").alias("node"), F.array(*values).alias("x")), edges


def _flat(df, vector="h"):
    """One rounded row per node and dimension."""
    tall = df.select("node", F.posexplode(vector).alias("dim", "value"))
    return tall.select("node", F.col("dim").cast("long").alias("dim"), rnd(F.col("value")).alias("value"))


@query(
    f"""
WITH e AS (SELECT src, dst FROM {EDGES_SQL}
    UNION ALL SELECT node, node FROM {NODES_SQL}),
d AS (SELECT dst AS node, count(*) AS d FROM e GROUP BY dst)
SELECT e.dst AS node, i AS dim, round(sum(n.x[i + 1] / sqrt(a.d * b.d)), 6) AS value
FROM e JOIN {NODES_SQL} n ON n.node = e.src JOIN d a ON a.node = e.src JOIN d b ON b.node = e.dst,
  (SELECT unnest(range({SIZE})) AS i) GROUP BY e.dst, i"""
)
def gcn_message_pass(spark, root):
    nodes, edges = _nodes_and_edges(spark, root)
    return _flat(graph.gcn_messages(edges, nodes, SIZE))


_LAYER_W = "((i * 37 + j * 17) % 101 - 50) / 250e0"
_LAYER_SUM = (
    f"list_transform(range({SIZE}), lambda i: greatest(((i * 13) % 11 - 5) / 50e0 + "
    f"list_inner_product(list_transform(range({SIZE}), lambda j: {_LAYER_W}), h), 0e0) + x[i + 1])"
)


@query(
    f"""
WITH e AS (SELECT src, dst FROM {EDGES_SQL}
    UNION ALL SELECT node, node FROM {NODES_SQL}),
d AS (SELECT dst AS node, count(*) AS d FROM e GROUP BY dst),
m AS (SELECT e.dst AS node, i, sum(n.x[i + 1] / sqrt(a.d * b.d)) AS v
  FROM e JOIN {NODES_SQL} n ON n.node = e.src JOIN d a ON a.node = e.src
    JOIN d b ON b.node = e.dst, (SELECT unnest(range({SIZE})) AS i) GROUP BY e.dst, i),
h AS (SELECT node, list(v ORDER BY i) AS h FROM m GROUP BY node),
s AS (SELECT node, {_LAYER_SUM} AS s FROM h JOIN {NODES_SQL} USING (node)),
c AS (SELECT node, list_transform(s, lambda v: v - list_avg(s)) AS c FROM s)
SELECT node, i AS dim, round(c[i + 1] / sqrt(list_inner_product(c, c) / {SIZE} + 1e-5), 6) AS value
FROM c, (SELECT unnest(range({SIZE})) AS i)"""
)
def gcn_layer(spark, root):
    """One whole graph layer: messages, linear map, ReLU, residual and layer norm."""
    nodes, edges = _nodes_and_edges(spark, root)
    messages = graph.gcn_messages(edges, nodes, SIZE)
    layer = fusion.graph_layer(fusion.pattern_weights("graph_layer", SIZE)["linear"])
    return _flat(messages.join(nodes, "node").select("node", layer("h", "x").alias("h")))


@query(
    f"""
SELECT n.node, i AS dim, round(coalesce(avg(s.x[i + 1]), 0), 6) AS value
FROM {NODES_SQL} n LEFT JOIN {EDGES_SQL} e ON e.dst = n.node
  LEFT JOIN {NODES_SQL} s ON s.node = e.src, (SELECT unnest(range({SIZE})) AS i)
GROUP BY n.node, i"""
)
def sage_mean(spark, root):
    nodes, edges = _nodes_and_edges(spark, root)
    return _flat(graph.sage_messages(edges, nodes, SIZE))


HEADS = 4  # two features per head at size 8


@query(
    f"""
WITH n AS (SELECT node, x,
    list_transform(range({HEADS}), lambda h: x[2 * h + 1] * 0.5e0 - x[2 * h + 2] * 0.25e0) AS a,
    list_transform(range({HEADS}), lambda h: x[2 * h + 1] * 0.125e0 + x[2 * h + 2]) AS b
  FROM {NODES_SQL}),
e AS (SELECT src, dst FROM {EDGES_SQL} UNION ALL SELECT node, node FROM n),
w AS (SELECT e.dst, s.x, h, s.a[h + 1] + t.b[h + 1] AS z
  FROM e JOIN n s ON s.node = e.src JOIN n t ON t.node = e.dst,
    (SELECT unnest(range({HEADS})) AS h)),
p AS (SELECT dst, x, h, exp(CASE WHEN z > 0 THEN z ELSE z * 0.2e0 END) AS w FROM w)
SELECT dst AS node, 2 * h + j AS dim, round(sum(w * x[2 * h + j + 1]) / sum(w), 6) AS value
FROM p, (SELECT unnest([0, 1]) AS j) GROUP BY dst, h, j"""
)
def gat_attention(spark, root):
    nodes, edges = _nodes_and_edges(spark, root)
    x = F.col("x")
    src = F.array(*[x[2 * h] * 0.5 - x[2 * h + 1] * 0.25 for h in range(HEADS)])
    dst = F.array(*[x[2 * h] * 0.125 + x[2 * h + 1] for h in range(HEADS)])
    return _flat(graph.gat_messages(edges, nodes, SIZE, HEADS, src, dst))


@query(
    """
SELECT v.vec_id AS node, i AS dim, round(c.m, 6) AS value
FROM embeddings v JOIN (SELECT label, i, avg(embedding[i + 1]::double) AS m
  FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY label, i) c ON c.label = v.label"""
)
def embedding_lookup(spark, root):
    """Every vector's label is its entity; the entity embedding is the mean of its vectors."""
    vectors = table(spark, root, "embeddings")
    centres = graph.mean_vectors(vectors, "label", "embedding", 64)
    ids = vectors.select(F.col("vec_id").alias("node"), "label")
    return _flat(graph.attach_embeddings(ids, centres, "label"), "x")


@query(
    f"""
WITH s AS (SELECT count(*) AS n_edges, cast(sum(src * 31 + dst) AS bigint) AS checksum
  FROM {EDGES_SQL})
SELECT c_custkey // 16 AS batch, count(*) AS size, max(n_edges) AS n_edges,
  max(checksum) AS checksum FROM customer, s GROUP BY 1"""
)
def batch_graph_attach(spark, root):
    """Batches of 16 examples that all refer to the same graph."""
    edges = graph.undirected(_encoded(spark, root))
    summary = durable(
        edges.agg(
            F.count("*").alias("n_edges"),
            F.sum(F.col("src") * 31 + F.col("dst")).alias("checksum"),
        ),
        "graph-summary",
    )
    batches = table(spark, root, "customer").groupBy(
        F.floor(F.col("c_custkey") / 16).alias("batch")
    ).agg(F.count("*").alias("size"))
    return batches.select(
        "batch",
        "size",
        summary.select("n_edges").scalar().alias("n_edges"),
        summary.select("checksum").scalar().alias("checksum"),
    )


@query(
    f"""
WITH c AS (SELECT (SELECT count(*) FROM {vocab_sql("entity")}) AS e,
  (SELECT count(*) FROM {vocab_sql("relation")}) AS r),
p AS (SELECT (e + r) * 384 + 2 * (384 * 384 + 384) + 768 + 385 + 769 AS total FROM c)
SELECT total AS total_parameters, total AS trainable_parameters,
  round(total * 4 / 1048576e0, 6) AS model_size_mb, round(total / 1e6, 6) AS millions FROM p"""
)
def model_size(spark, root):
    """Parameters of the graph encoder for the entities and relations found in the data."""
    facts = triples(spark, root)
    tall = facts.select(F.explode(F.array("head", "tail")).alias("name"))
    counts = tall.agg(F.count_distinct("name").alias("e"))
    n_relations = facts.agg(F.count_distinct("relation").alias("r")).scalar()
    total = graph.graph_parameters(F.col("e"), n_relations, 384, 2)
    return counts.select(total.alias("total_parameters")).select(
        "total_parameters",
        F.col("total_parameters").alias("trainable_parameters"),
        rnd(F.col("total_parameters") * 4 / 1048576.0).alias("model_size_mb"),
        rnd(F.col("total_parameters") / 1e6).alias("millions"),
    )
