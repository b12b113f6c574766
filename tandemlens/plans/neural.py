"""Vector queries: fusion operators, heads, contrastive loss and a trained classifier.

The dense vector is the given embedding; the graph vector is the mean embedding
of the row's label, its entity.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tandemlens.functions.encoders import hashed_mean
from tandemlens.functions.vectors import as_double, cosine, sigmoid
from tandemlens.operators import binary, fusion, graph, training
from tandemlens.plans.catalog import query, rnd, rounded
from tandemlens.plans.inputs import documents, token_rows_sql
from tandemlens.session import durable
from tandemlens.sources.tables import table

HIDDEN = 64
BATCH = 16  # fixed value: examples per contrastive batch

PAIRS_SQL = """(
  SELECT v.vec_id, v.label, list_transform(v.embedding, lambda x: x::double) AS dense, c.kg
  FROM embeddings v JOIN (SELECT label, list(m ORDER BY i) AS kg FROM (
      SELECT label, i, avg(embedding[i + 1]::double) AS m
      FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY label, i) GROUP BY label) c
    ON c.label = v.label)"""


def _pairs(spark, root):
    vectors = table(spark, root, "embeddings")
    centres = graph.mean_vectors(vectors, "label", "embedding", HIDDEN)
    dense = vectors.select("vec_id", "label", as_double(F.col("embedding")).alias("dense"))
    return graph.attach_embeddings(dense, centres.withColumnRenamed("x", "kg"), "label")


class _Sql:
    """SQL of the same layers: every step adds columns to a subquery."""

    def __init__(self, kind: str):
        self.shapes = fusion.shapes(kind, HIDDEN)
        self.text = PAIRS_SQL

    def step(self, **columns: str) -> "_Sql":
        added = ", ".join(f"{e} AS {n}" for n, e in columns.items())
        self.text = f"(SELECT *, {added} FROM {self.text})"
        return self

    def linear(self, x: str, layer: str) -> str:
        seed = list(self.shapes).index(layer)
        out, size = self.shapes[layer]
        w = f"((i * 37 + j * 17 + {seed * 11}) % 101 - 50) / 250e0"
        b = f"((i * 13 + {seed * 7}) % 11 - 5) / 50e0"
        row = f"list_transform(range({size}), lambda j: {w})"
        return f"list_transform(range({out}), lambda i: list_inner_product({row}, {x}) + {b})"

    @staticmethod
    def relu(x: str) -> str:
        return f"list_transform({x}, lambda v: greatest(v, 0e0))"

    @staticmethod
    def add(a: str, b: str) -> str:
        return f"list_transform(range(len({a})), lambda i: {a}[i + 1] + {b}[i + 1])"

    @staticmethod
    def scale(x: str, w: str) -> str:
        return f"list_transform({x}, lambda v: v * {w})"

    def norm(self, name: str, x: str) -> "_Sql":
        self.step(**{f"{name}_m": f"list_avg({x})"})
        self.step(**{f"{name}_v": f"list_avg(list_transform({x}, lambda v: pow(v - {name}_m, 2)))"})
        value = f"(v - {name}_m) / sqrt({name}_v + 1e-5)"
        return self.step(**{name: f"list_transform({x}, lambda v: {value})"})

    def mlp(self, name: str, x: str, first: str, second: str) -> "_Sql":
        self.step(**{f"{name}_h": self.linear(x, first)})
        self.step(**{f"{name}_r": self.relu(f"{name}_h")})
        return self.step(**{name: self.linear(f"{name}_r", second)})

    def rows(self, vector: str = "fused") -> str:
        return (
            f"SELECT vec_id, i AS dim, round({vector}[i + 1], 6) AS value "
            f"FROM {self.text}, (SELECT unnest(range({HIDDEN})) AS i)"
        )


def _cross_attention_sql() -> str:
    s = _Sql("cross_attention")
    for side, own, other in (("kg", "kg", "dense"), ("dense", "dense", "kg")):
        s.step(**{f"{side}_val": s.linear(other, f"{side}_value")})
        s.step(**{f"{side}_att": s.linear(f"{side}_val", f"{side}_out")})
        s.step(**{f"{side}_sum": s.add(f"{side}_att", own)}).norm(f"{side}_x", f"{side}_sum")
        s.mlp(f"{side}_f", f"{side}_x", f"{side}_ffn1", f"{side}_ffn2")
        s.step(**{f"{side}_s2": s.add(f"{side}_x", f"{side}_f")}).norm(f"{side}_y", f"{side}_s2")
    s.step(total=s.add("kg_y", "dense_y"))
    return s.step(fused=s.scale("total", "0.5e0")).rows()


def _gating_sql() -> str:
    s = _Sql("hierarchical_gating").step(pair="list_concat(kg, dense)")
    s.mlp("ga", "pair", "kg_gate1", "kg_gate2").mlp("gb", "pair", "dense_gate1", "dense_gate2")
    s.step(a="1e0 / (1e0 + exp(-ga[1]))", b="1e0 / (1e0 + exp(-gb[1]))")
    s.step(wa="a / (a + b + 1e-8)", wb="b / (a + b + 1e-8)")
    s.step(gated=f"list_concat({s.scale('kg', 'wa')}, {s.scale('dense', 'wb')})")
    return s.mlp("fused", "gated", "fuse1", "fuse2").rows()


def _bilinear_sql() -> str:
    s = _Sql("tensor_bilinear")
    outer = (
        f"list_transform(range({HIDDEN * HIDDEN}), "
        f"lambda i: kg[i // {HIDDEN} + 1] * dense[i % {HIDDEN} + 1])"
    )
    s.step(outer_=outer)
    s.step(
        bi=s.linear("outer_", "bilinear"),
        kp=s.linear("kg", "kg_proj"),
        dp=s.linear("dense", "dense_proj"),
    )
    s.step(parts="list_concat(list_concat(bi, kp), dp)")
    return s.mlp("raw", "parts", "fuse1", "fuse2").norm("fused", "raw").rows()


def _projected_sql(s: _Sql) -> _Sql:
    for side in ("kg", "dense"):
        s.mlp(f"{side}_p", side, f"{side}_proj1", f"{side}_proj2")
        length = f"greatest(sqrt(list_inner_product({side}_p, {side}_p)), 1e-12)"
        s.step(**{f"{side}_u": s.scale(f"{side}_p", f"(1e0 / {length})")})
    return s


def _contrastive_sql() -> str:
    s = _projected_sql(_Sql("contrastive"))
    s.step(w="1e0 / (1e0 + exp(-list_inner_product(kg_u, dense_u)))")
    s.step(mix=f"list_concat({s.scale('kg', 'w')}, {s.scale('dense', '(1e0 - w)')})")
    s.step(al=s.linear("mix", "align")).step(ar=s.relu("al"))
    return s.mlp("raw", "ar", "fuse1", "fuse2").norm("fused", "raw").rows()


def _fused_rows(spark, root, kind):
    combine = fusion.fused(kind, fusion.pattern_weights(kind, HIDDEN))
    rows = _pairs(spark, root).select("vec_id", combine("kg", "dense").alias("fused"))
    tall = rows.select("vec_id", F.posexplode("fused").alias("dim", "value"))
    return tall.select("vec_id", F.col("dim").cast("long").alias("dim"), rnd(F.col("value")).alias("value"))


@query(_cross_attention_sql())
def cross_attention_fusion(spark, root):
    return _fused_rows(spark, root, "cross_attention")


@query(_gating_sql())
def gating_fusion(spark, root):
    return _fused_rows(spark, root, "hierarchical_gating")


@query(_bilinear_sql())
def bilinear_fusion(spark, root):
    return _fused_rows(spark, root, "tensor_bilinear")


@query(_contrastive_sql())
def contrastive_fusion(spark, root):
    return _fused_rows(spark, root, "contrastive")


@query(
    f"""
SELECT vec_id, round(c, 6) AS cosine, round(1e0 / (1e0 + exp(-c)), 6) AS weight FROM (
  SELECT vec_id, list_inner_product(kg, dense) / (greatest(sqrt(list_inner_product(kg, kg)), 1e-12)
    * greatest(sqrt(list_inner_product(dense, dense)), 1e-12)) AS c FROM {PAIRS_SQL})"""
)
def cosine_gate(spark, root):
    """Alignment weight of the two vectors, in Spark's own expressions."""
    c = _pairs(spark, root).select("vec_id", cosine(F.col("kg"), F.col("dense")).alias("cosine"))
    return rounded(c.withColumn("weight", sigmoid(F.col("cosine"))))


def _info_nce_sql() -> str:
    s = _projected_sql(_Sql("contrastive"))
    return f"""
WITH p AS (SELECT vec_id, vec_id // {BATCH} AS batch, kg_u, dense_u FROM {s.text}),
m AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j,
    list_inner_product(a.kg_u, b.dense_u) / 0.1e0 AS sim
  FROM p a JOIN p b ON a.batch = b.batch),
r AS (SELECT batch, i AS k, ln(sum(exp(sim))) AS l FROM m GROUP BY batch, i
  UNION ALL SELECT batch, j, ln(sum(exp(sim))) FROM m GROUP BY batch, j),
d AS (SELECT batch, avg(sim) AS own FROM m WHERE i = j GROUP BY batch)
SELECT r.batch, round(avg(l) - max(own), 6) AS loss FROM r JOIN d ON d.batch = r.batch
GROUP BY r.batch"""


@query(_info_nce_sql())
def infonce(spark, root):
    batch = F.floor(F.col("vec_id") / BATCH).alias("batch")
    batches = _pairs(spark, root).select(batch, "kg", "dense")
    return rounded(fusion.info_nce(batches, fusion.pattern_weights("contrastive", HIDDEN)))


def _heads_sql() -> str:
    parts = []
    for task, x in (("qa", "dense"), ("ir", "list_concat(dense, dense)")):
        s = _Sql(f"{task}_head").step(x=x)
        text = s.mlp("logit", "x", "head1", "head2").text
        parts.append(
            f"SELECT '{task}' AS task, vec_id, round(logit[1], 6) AS logit, "
            f"logit[1] > 0 AS positive FROM {text}"
        )
    return " UNION ALL ".join(parts)


@query(_heads_sql())
def task_heads(spark, root):
    vectors = table(spark, root, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("x"))

    def head(task):
        logit = fusion.task_head(task, fusion.pattern_weights(f"{task}_head", HIDDEN))
        return vectors.select(F.lit(task).alias("task"), "vec_id", logit("x").alias("logit"))

    both = head("qa").unionByName(head("ir"))
    return both.select(
        "task",
        "vec_id",
        rnd(F.col("logit")).alias("logit"),
        (sigmoid(F.col("logit")) > 0.5).alias("positive"),
    )


@query(
    f"""
WITH t AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 7))::bigint % 32 AS dim
  FROM {token_rows_sql("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS total FROM t GROUP BY doc_id)
SELECT t.doc_id, dim, round(count(*) / max(total), 6) AS value FROM t JOIN n USING (doc_id)
GROUP BY t.doc_id, dim"""
)
def text_encoder(spark, root):
    return rounded(hashed_mean(documents(spark, root, "doc_id", "text"), "doc_id", "text", 32))


@query()
def trained_classifier(spark, root):
    """Logistic regression on the vectors (even against odd labels), trained on four fifths and judged on the rest."""
    rows = table(spark, root, "embeddings").select(
        "vec_id",
        array_to_vector(as_double(F.col("embedding"))).alias("features"),
        (F.col("label") % 2).cast("double").alias("label"),
    )
    model = LogisticRegression(maxIter=20, regParam=1e-5, tol=1e-6).fit(rows.filter("vec_id % 5 <> 0"))
    scored = model.transform(rows.filter("vec_id % 5 = 0")).select(
        vector_to_array("probability")[1].alias("score"), F.col("label").cast("int").alias("label")
    )
    metrics = binary.binary_metrics(scored, "score", "label")
    return rounded(metrics.withColumn("auc", binary.roc_auc(scored, "score", "label").scalar()), 3)


def _training_rows(spark, root):
    features = training.fusion_features(F.col("kg"), F.col("dense"))
    return _pairs(spark, root).select("vec_id", features.alias("features"), (F.col("label") % 2).alias("label"))


@query(
    f"""
WITH x AS (SELECT vec_id, label % 2 AS y, list_concat(kg, dense,
    list_transform(range({HIDDEN}), lambda i: kg[i + 1] * dense[i + 1]), [1e0]) AS x FROM {PAIRS_SQL}),
g AS (SELECT pos, avg((0.5 - y) * v) AS g FROM (SELECT y, unnest(range({3 * HIDDEN + 1})) AS pos, unnest(x) AS v FROM x) GROUP BY pos),
c AS (SELECT pos, g, g * least(1, 1 / (sqrt(sum(g * g) OVER ()) + 1e-6)) AS cut FROM g)
SELECT pos, round(g, 6) AS gradient, round(-0.05 * cut / (abs(cut) + 1e-8), 6) AS weight FROM c"""
)
def fusion_training_step(spark, root):
    """Gradient of all rows at zero weights, and the weights after one step."""
    rows = _training_rows(spark, root)
    state = training.State.zero(3 * HIDDEN + 1)
    mean, _, _ = training.gradient(rows.withColumn("label", F.col("label").cast("double")), state.weights)
    after = training.adamw(state, mean, 0.05)
    made = [(i, float(g), float(w)) for i, (g, w) in enumerate(zip(mean, after.weights))]
    return rounded(spark.createDataFrame(made, "pos bigint, gradient double, weight double"))


@query()
def trained_fusion(spark, root):
    """The fusion head after three epochs on four fifths of the rows, judged on the rest."""
    rows = durable(_training_rows(spark, root), "fusion-rows")
    state, _ = training.train(rows.filter("vec_id % 5 <> 0"), "vec_id", epochs=3, batches=4, rate=0.02)
    judged = rows.filter("vec_id % 5 = 0").select(training.scored(F.col("features"), state).alias("score"), "label")
    metrics = binary.binary_metrics(judged, "score", "label")
    return rounded(metrics.withColumn("auc", binary.roc_auc(judged, "score", "label").scalar()), 3)
