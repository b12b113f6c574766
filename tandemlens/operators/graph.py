"""Knowledge graph: vocabularies, id encoding, edges, entity links and message passing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlens.functions.arrays import pad_or_cut
from tandemlens.operators.ordered import lookup, running_totals, top_per_group
from tandemlens.session import durable

MAX_ENTITIES = 10  # fixed value: linked entities per text


def vocabularies(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, id) and (relation, id) with ids 1, 2, ... by first appearance.

    Heads come before tails within a triple, triples go by `pos`; empty names get no
    id. One pass over the triples fills a table that holds both.
    """

    def mention(kind: str, name: str, place: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), place.alias("place"))

    mentions = triples.select(
        F.inline(
            F.array(
                mention("entity", "head", F.col("pos") * 2),
                mention("entity", "tail", F.col("pos") * 2 + 1),
                mention("relation", "relation", F.col("pos")),
            )
        )
    )
    named = mentions.where(F.col("name").isNotNull() & (F.col("name") != ""))
    first = named.groupBy("kind", "name").agg(F.min("place").alias("place"))
    first = durable(first, "first-places")
    # Ties cannot occur: a place belongs to one mention. The name makes that explicit.
    ranked = running_totals(first, ["kind"], [F.col("place"), F.col("name")], rank="id")
    ids = durable(ranked.select("kind", "name", "id"), "vocabularies")

    def of(kind: str) -> DataFrame:
        return ids.where(F.col("kind") == kind).select(F.col("name").alias(kind), "id")

    return of("entity"), of("relation")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(pos, src, rel, dst) of the triples whose three parts are all in the vocabularies."""
    heads = entities.select(F.col("entity").alias("head"), F.col("id").alias("src"))
    tails = entities.select(F.col("entity").alias("tail"), F.col("id").alias("dst"))
    rels = relations.select("relation", F.col("id").alias("rel"))
    known = lookup(triples.select("pos", "head", "relation", "tail"), rels, "relation")
    known = lookup(known, heads, "head", keys_of=triples)
    known = lookup(known, tails, "tail", keys_of=triples)
    return known.select("pos", "src", "rel", "dst")


def with_labels(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Add head_label, relation_label and tail_label; an unknown id is its own label."""
    heads = entities.select(F.col("entity_id").alias("head"), F.col("entity_name").alias("_h"))
    tails = entities.select(F.col("entity_id").alias("tail"), F.col("entity_name").alias("_t"))
    rels = relations.select(
        F.col("relation_id").alias("relation"), F.col("relation_name").alias("_r")
    )
    found = lookup(triples, rels, "relation", "left")
    found = lookup(found, heads, "head", "left", keys_of=triples)
    found = lookup(found, tails, "tail", "left", keys_of=triples)
    return found.select(
        *triples.columns,
        F.coalesce("_h", "head").alias("head_label"),
        F.coalesce("_r", "relation").alias("relation_label"),
        F.coalesce("_t", "tail").alias("tail_label"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions with the same relation; duplicates stay."""
    both = F.array(
        F.struct(F.col("src"), F.col("dst"), F.col("rel")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rel")),
    )
    return edges.select(F.inline(both))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): incoming edges per node."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))


def link_entities(texts: DataFrame, tokens: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Ids of the first ten known words of every text, padded with 0.

    `texts` holds every key, `tokens` (key, pos, word), `vocab` (word, id). Only the
    first ten links of a text are shuffled, so a long text does not become a long list.
    """
    hits = lookup(tokens, vocab, "word")
    first = top_per_group(hits, [key], [F.col("pos")], MAX_ENTITIES, "_place")
    linked = first.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_place", "id"))).alias("_found")
    )
    nothing = F.array().cast(linked.schema["_found"].dataType)
    ids = F.transform(F.coalesce("_found", nothing), lambda x: x["id"])
    return texts.select(key).join(linked, key, "left").select(
        key,
        F.size(ids).alias("n_links"),
        pad_or_cut(ids, MAX_ENTITIES, F.lit(0).cast("long")).alias("entity_ids"),
    )


def _sums(vector: str, size: int) -> list[Column]:
    return [F.sum(F.col(vector)[i]).alias(f"_{i}") for i in range(size)]


def gcn_messages(edges: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(node, h): sum over neighbours and the node itself of x / sqrt(d_i * d_j).

    d counts incoming edges plus the self loop. The per-node scaling is applied to
    the features before and after the sum, so the edge table is joined only once; the
    self loop brings the second scaling along.
    """
    scale = F.pow(F.coalesce("degree", F.lit(0)) + 1.0, F.lit(-0.5))
    degree = features.join(degrees(edges), "node", "left").withColumn("scale", scale)
    products = [(F.col("x")[i] * F.col("scale")).alias(f"x{i}") for i in range(size)]
    scaled = durable(degree.select("node", "scale", *products), "scaled-features")
    values = [f"x{i}" for i in range(size)]
    sources = scaled.select(F.col("node").alias("src"), *values)
    messages = lookup(edges.select("src", "dst"), sources, "src")
    loops = scaled.select(F.col("node").alias("dst"), "scale", *values)
    rows = messages.select("dst", F.lit(None).cast("double").alias("scale"), *values)
    sums = rows.unionByName(loops).groupBy("dst").agg(
        F.max("scale").alias("scale"), *[F.sum(f"x{i}").alias(f"_{i}") for i in range(size)]
    )
    return sums.select(
        F.col("dst").alias("node"),
        F.array(*[F.col(f"_{i}") * F.col("scale") for i in range(size)]).alias("h"),
    )


def sage_messages(edges: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(node, h): mean of the neighbours' features, zeros without neighbours."""
    sources = features.select(F.col("node").alias("src"), "x")
    sums = (
        lookup(edges.select("src", "dst"), sources, "src")
        .groupBy(F.col("dst").alias("node"))
        .agg(F.count("*").alias("_n"), *_sums("x", size))
    )
    means = [F.coalesce(F.col(f"_{i}") / F.col("_n"), F.lit(0.0)) for i in range(size)]
    return features.select("node").join(sums, "node", "left").select(
        "node", F.array(*means).alias("h")
    )


def gat_messages(
    edges: DataFrame, features: DataFrame, size: int, heads: int, att_src: Column, att_dst: Column
) -> DataFrame:
    """(node, h): per head, neighbours and the node itself weighted by a softmax over in-edges.

    `features` holds (node, x) with x already projected; the first size/heads
    values belong to the first head. `att_src` and `att_dst` give one score per
    head and node. The softmax is a ratio of two sums. Every logit is taken less the largest one of
    its target, so the largest weight of each target is 1 and no sum can vanish.
    """
    width = size // heads
    scored = features.select("node", "x", att_src.alias("a"), att_dst.alias("b"))
    sources = scored.select(F.col("node").alias("src"), "x", "a")
    targets = scored.select(F.col("node").alias("dst"), "b")
    loops = scored.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    every = edges.select("src", "dst").unionByName(loops)
    top = [F.max(F.col("a")[h]).alias(f"m{h}") for h in range(heads)]
    largest = lookup(every, sources.drop("x"), "src").groupBy("dst").agg(*top)
    bounds = durable(
        targets.join(largest, "dst").select("dst", "b", F.array(*[F.col(f"m{h}") for h in range(heads)]).alias("m")),
        "attention-bounds",
    )
    pairs = lookup(lookup(every, sources, "src"), bounds, "dst")

    def leaky(z: Column) -> Column:
        return F.when(z > 0, z).otherwise(z * 0.2)

    weights = [
        F.exp(leaky(F.col("a")[h] + F.col("b")[h]) - leaky(F.col("m")[h] + F.col("b")[h])).alias(
            f"w{h}"
        )
        for h in range(heads)
    ]
    weighted = pairs.select("dst", "x", *weights)
    sums = weighted.groupBy(F.col("dst").alias("node")).agg(
        *[F.sum(f"w{h}").alias(f"_w{h}") for h in range(heads)],
        *[F.sum(F.col("x")[i] * F.col(f"w{i // width}")).alias(f"_{i}") for i in range(size)],
    )
    values = [F.col(f"_{i}") / F.col(f"_w{i // width}") for i in range(size)]
    return sums.select("node", F.array(*values).alias("h"))


def attach_embeddings(ids: DataFrame, embeddings: DataFrame, on: str) -> DataFrame:
    """Embedding lookup: one vector per id."""
    return lookup(ids, embeddings, on)


def mean_vectors(df: DataFrame, by: str, vector: str, size: int) -> DataFrame:
    """(by, x): element-wise mean of the vectors of a group."""
    means = [F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)]
    grouped = df.groupBy(by).agg(*means)
    return grouped.select(by, F.array(*[F.col(f"_{i}") for i in range(size)]).alias("x"))


def graph_parameters(n_entities: Column, n_relations: Column, hidden: int, layers: int) -> Column:
    """Trainable values of a graph encoder with one linear map per layer and a linear head."""
    embeddings = (n_entities + n_relations) * hidden
    per_layer = hidden * hidden + hidden
    norm = 2 * hidden
    heads = (hidden + 1) + (2 * hidden + 1)
    return reduce(lambda a, b: a + b, [embeddings, F.lit(layers * per_layer + norm + heads)])
