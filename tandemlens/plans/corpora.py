"""Queries that shape questions, answers, spans and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlens.functions.arrays import (
    any_answer,
    attention_mask,
    capped,
    list_as_text,
    non_empty,
    pad_or_cut,
    selected_texts,
    struct_of_lists_to_list,
)
from tandemlens.functions.frames import evaluated_once
from tandemlens.functions import variants
from tandemlens.functions.text import text_or_empty, words
from tandemlens.operators import qa
from tandemlens.operators.ordered import running_totals
from tandemlens.plans.catalog import query
from tandemlens.plans.inputs import QA_SQL, documents, qa_examples, qa_turns
from tandemlens.session import durable
from tandemlens.sources.tables import table

TOKENS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query(f"SELECT example_id, split, question, coalesce(answer, '') AS answer FROM {QA_SQL}")
def qa_pairs(spark, root):
    pairs = qa_turns(spark, root)
    return pairs.select("example_id", "split", "question", text_or_empty("answer").alias("answer"))


@query(
    f"""SELECT example_id, CASE WHEN trim(coalesce(answer, '')) <> '' THEN 1e0 ELSE 0e0 END
    AS label FROM {QA_SQL}"""
)
def qa_label(spark, root):
    return qa_examples(spark, root).select("example_id", qa.label(F.col("answers")).alias("label"))


@query(
    f"""
SELECT example_id, split, answer IS NOT NULL AS has_answer FROM {QA_SQL}
WHERE NOT (split = 'train' AND answer IS NULL)"""
)
def qa_filter_train_only(spark, root):
    flagged = qa_examples(spark, root).withColumn("has_answer", F.size("answers") > 0)
    return qa.train_needs_answer(flagged).select("example_id", "split", "has_answer")


LINES_SQL = "regexp_split_to_array(text, '\\n')"


@query(
    f"""
SELECT doc_id, len(list_filter(a, lambda x: x <> '')) AS kept,
  len(a) - len(list_filter(a, lambda x: x <> '')) AS dropped,
  list_filter(a, lambda x: x <> '')[1] AS first_answer
FROM (SELECT doc_id, {LINES_SQL} AS a FROM documents)
WHERE len(list_filter(a, lambda x: x <> '')) > 0"""
)
def answer_clean(spark, root):
    """The lines of a document as its answers: empty ones go, and so do records left without."""
    answers = F.split("text", "\n", -1)
    records = documents(spark, root, "doc_id", "text").select("doc_id", answers.alias("answers"))
    kept = qa.marco_record(records.withColumn("raw", F.size("answers")))
    return kept.select(
        "doc_id",
        F.size("answers").alias("kept"),
        (F.col("raw") - F.size("answers")).alias("dropped"),
        F.get("answers", F.lit(0)).alias("first_answer"),
    )


SPANS_SQL = f"""(
  SELECT doc_id, t, len(t) AS n, n_chars % 7 AS s1, n_chars % 7 + doc_id % 4 AS e1,
         n_chars % 50 - 2 AS s2, n_chars % 50 + 120 AS e2
  FROM (SELECT doc_id, n_chars, {TOKENS_SQL} AS t FROM documents))"""


def _spans(spark, root):
    """Documents as token lists with one short and one long answer span, some of them invalid."""
    n, d = F.col("n_chars"), F.col("doc_id")

    def span(start, end):
        return F.array(
            F.struct(start.cast("int").alias("start_token"), end.cast("int").alias("end_token"))
        )

    docs = documents(spark, root, "doc_id", "text", "source", "n_chars")
    return docs.select(
        F.col("doc_id").alias("example_id"),
        F.concat(F.lit("question "), "doc_id").alias("question"),
        F.transform(words(F.col("text")), lambda t: F.struct(t.alias("token"))).alias("tokens"),
        span(n % 7, n % 7 + d % 4).alias("short_spans"),
        span(n % 50 - 2, n % 50 + 120).alias("long_spans"),
        F.col("source").alias("document_title"),
        F.lit(None).cast("string").alias("document_url"),
    )


@query(
    f"""
SELECT cast(doc_id AS varchar) AS example_id, coalesce(sa, '') AS short_answer,
  coalesce(substr(la, 1, 500), '') AS long_answer, sa IS NOT NULL AS has_short_answer,
  la IS NOT NULL AS has_long_answer
FROM (SELECT doc_id,
    CASE WHEN e1 > s1 AND e1 <= n THEN array_to_string(t[s1 + 1 : e1], ' ') END AS sa,
    CASE WHEN s2 >= 0 AND e2 <= n THEN array_to_string(t[s2 + 1 : e2], ' ') END AS la
  FROM {SPANS_SQL})
WHERE sa IS NOT NULL OR la IS NOT NULL"""
)
def span_detokenise(spark, root):
    records = qa.nq_record(_spans(spark, root))
    return records.select(
        "example_id",
        text_or_empty(F.get("short_answers", F.lit(0))).alias("short_answer"),
        text_or_empty(F.get("long_answers", F.lit(0))).alias("long_answer"),
        "has_short_answer",
        "has_long_answer",
    )


@query(
    f"""
SELECT doc_id AS example_id, array_to_string(
    CASE WHEN s1 >= e1 THEN [] ELSE t[s1 + 1 : e1] END, ' ') AS short_answer
FROM {SPANS_SQL} WHERE s1 < n AND e1 <= n"""
)
def span_detokenise_loose(spark, root):
    """The looser guard keeps empty spans as empty strings."""
    tokens = F.transform("tokens", lambda t: t["token"])
    spans = _spans(spark, root).withColumn("tokens", tokens)
    texts = qa.span_answers(F.col("tokens"), F.col("short_spans"), loose=True)
    found = evaluated_once(spans, found=texts)
    return found.where(F.size("found") > 0).select(
        "example_id", F.get("found", F.lit(0)).alias("short_answer")
    )


@query(
    f"""
SELECT doc_id, len(t[1:100]) AS kept, t[1:100][-1] AS last_token
FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)"""
)
def token_cap(spark, root):
    """The first 100 tokens are the feature here, not the whole text."""
    capped = documents(spark, root, "doc_id", "text").select(
        "doc_id", F.slice(words(F.col("text")), 1, 100).alias("tokens")
    )
    return capped.select(
        "doc_id",
        F.size("tokens").alias("kept"),
        F.try_element_at("tokens", F.lit(-1)).alias("last_token"),
    )


@query(
    f"""SELECT example_id, question || ' [SEP] ' || coalesce(answer, '') AS combined
FROM {QA_SQL}"""
)
def qp_concat(spark, root):
    pairs = qa_turns(spark, root)
    combined = F.concat_ws(" [SEP] ", text_or_empty("question"), text_or_empty("answer"))
    return pairs.select("example_id", combined.alias("combined"))


PAIRS_SQL = """(
  SELECT DISTINCT l_orderkey AS query_id, l_partkey AS passage_id, o_orderpriority AS dataset,
    o_orderpriority || ' ' || o_orderstatus AS query, p_name AS passage, l_returnflag
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def _judged(spark, root):
    """Orders are the queries, line items the judgements and parts the corpus."""
    queries = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"),
    )
    qrels = (
        table(spark, root, "lineitem")
        .groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"))
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("relevance"))
    )
    corpus = table(spark, root, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")
    )
    return queries, qrels, corpus


def _pairs(spark, root):
    queries, qrels, corpus = _judged(spark, root)
    return qa.retrieval_pairs(queries, durable(qrels, "qrels"), corpus)  # read three times


@query(
    f"""
SELECT query, query_id, passage, passage_id, max((l_returnflag = 'R')::bigint) AS relevance
FROM {PAIRS_SQL} GROUP BY ALL"""
)
def ir_pairs(spark, root):
    return _pairs(spark, root).select("query", "query_id", "passage", "passage_id", "relevance")


@query(
    f"""
WITH p AS (SELECT dataset, query_id, passage_id, max((l_returnflag = 'R')::bigint) AS relevance
  FROM {PAIRS_SQL} GROUP BY ALL)
SELECT dataset, query_id, passage_id, relevance FROM p
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY query_id, passage_id) <= 10000"""
)
def ir_pairs_capped(spark, root):
    """At most 10,000 pairs per dataset; the order priority names the dataset."""
    queries, qrels, corpus = _judged(spark, root)
    dataset = F.regexp_replace("text", " [A-Z]$", "")
    pairs = qa.first_retrieval_pairs(queries.withColumn("dataset", dataset), qrels, corpus, "dataset")
    return pairs.select("dataset", "query_id", "passage_id", "relevance")


@query(
    f"""
SELECT doc_id, len(a) AS n_passages, len(list_filter(a, lambda x: x <> '')) AS n_selected,
  coalesce(list_filter(a, lambda x: x <> '')[1], '') AS first_passage
FROM (SELECT doc_id, {LINES_SQL} AS a FROM documents)"""
)
def passages_shape(spark, root):
    """Parallel passage lists to a list of structs, and the texts of the selected ones."""
    passages = struct_of_lists_to_list(F.split("text", "\n", -1))
    rows = documents(spark, root, "doc_id", "text").select("doc_id", passages.alias("passages"))
    chosen = selected_texts(F.col("passages"))
    return rows.select(
        "doc_id",
        F.size("passages").alias("n_passages"),
        F.size(chosen).alias("n_selected"),
        text_or_empty(F.get(chosen, F.lit(0))).alias("first_passage"),
    )


@query(
    """
SELECT conv_id, count(*) AS n_passages, count(*) FILTER (role = 'assistant') AS n_selected,
  0::bigint AS part, md5(string_agg(text, '|' ORDER BY turn)) AS digest
FROM conversations GROUP BY conv_id"""
)
def nested_passages(spark, root):
    """Every conversation with the ordered list of its turns."""
    turns = table(spark, root, "conversations")
    parents = turns.select("conv_id").distinct()
    children = turns.select(
        "conv_id",
        "turn",
        F.col("text").alias("passage_text"),
        (F.col("role") == "assistant").cast("int").alias("is_selected"),
    )
    nested = qa.attach_children(parents, children, "conv_id", "turn", "passages")
    texts = F.transform("passages", lambda p: p["passage_text"])
    return nested.select(
        "conv_id",
        "part",
        F.size("passages").alias("n_passages"),
        F.size(F.filter("passages", lambda p: p["is_selected"] == 1)).alias("n_selected"),
        F.md5(F.array_join(texts, "|")).alias("digest"),
    )


@query(
    """
SELECT lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS example_id,
  doc_id FROM documents"""
)
def positional_ids(spark, root):
    """Ids made of the split and the position within it."""
    placed = running_totals(
        table(spark, root, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")]
    )
    name = F.concat_ws("_", "lang", (F.col("rank") - 1).cast("string"))
    return placed.select(name.alias("example_id"), "doc_id")


@query(
    """
SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'untitled')
    AS title,
  url, length(html) > 0 AS has_document FROM pages"""
)
def nested_projection(spark, root):
    """Fields of a nested document struct, with defaults for what is missing."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    nested = table(spark, root, "pages").select(
        "page_id",
        F.struct(F.when(title != "", title).alias("title"), "url", "html").alias("document"),
    )
    return nested.select(
        "page_id",
        F.coalesce("document.title", F.lit("untitled")).alias("title"),
        text_or_empty("document.url").alias("url"),
        (F.length(text_or_empty("document.html")) > 0).alias("has_document"),
    )


@query(
    """
SELECT event_id, cast(props->>'$.k' AS bigint) AS k, coalesce(props->>'$.missing', '') AS missing,
  (props->>'$.k') IS NOT NULL AS has_k FROM events"""
)
def event_props_json(spark, root):
    parsed = F.from_json("props", "k BIGINT, missing STRING").alias("p")
    return table(spark, root, "events").select("event_id", parsed).select(
        "event_id",
        F.col("p.k").alias("k"),
        text_or_empty("p.missing").alias("missing"),
        F.col("p.k").isNotNull().alias("has_k"),
    )


@query(
    f"""
SELECT doc_id, 'annotated ' || lang AS short_answer, '' AS long_answer, 2::bigint AS n_short
FROM documents WHERE lang <> 'en'
UNION ALL SELECT doc_id, 'annotated en', coalesce({TOKENS_SQL}[1], ''), 1 FROM documents
WHERE lang = 'en'"""
)
def flatten_annotations(spark, root):
    """Short answers of all annotations, and the long answer of the first one."""
    english = F.col("lang") == "en"
    answer = F.struct(F.concat_ws(" ", F.lit("annotated"), "lang").alias("text"))
    first_word = F.get(words(F.col("text")), F.lit(0))

    def annotation(candidate):
        return F.struct(
            F.array(answer).alias("short_answers"),
            F.struct(candidate.alias("candidate_text")).alias("long_answer"),
        )

    nothing = F.lit(None).cast("string")
    annotations = F.when(english, F.array(annotation(first_word))).otherwise(
        F.array(annotation(nothing), annotation(nothing))
    )
    rows = table(spark, root, "documents").select("doc_id", annotations.alias("annotations"))
    short = qa.flatten_answers(F.col("annotations"))
    return rows.select(
        "doc_id",
        F.get(short, F.lit(0)).alias("short_answer"),
        qa.first_long_answer(F.col("annotations")).alias("long_answer"),
        F.size(short).alias("n_short"),
    )


@query(
    f"""
SELECT doc_id, array_to_string(a[1:10], ' ') AS title, least(len(a), 10) AS kept,
  len(a) > 10 AS cut FROM (SELECT doc_id, {LINES_SQL} AS a FROM documents)"""
)
def json_safe(spark, root):
    """Lists where text was expected become text, and long lists are cut before to_json."""
    lines = F.split("text", "\n", -1)
    rows = evaluated_once(documents(spark, root, "doc_id", "text"), lines=lines)
    nested = rows.select(
        "doc_id", "lines", F.struct(F.struct(F.col("lines").alias("items")).alias("body")).alias("d")
    )
    safe = F.to_json(capped(F.col("d"), nested.schema["d"].dataType))
    back = F.from_json(safe, "body STRUCT<items: ARRAY<STRING>>")
    return nested.select(
        "doc_id",
        list_as_text(F.col("lines")).alias("title"),
        F.size(back["body"]["items"]).alias("kept"),
        (F.size("lines") > 10).alias("cut"),
    )


VOCAB_SIZE = 30_522  # fixed value: size of the uncased subword vocabulary
MAX_LENGTH = 256  # fixed value: tokens per encoded example


@query(
    f"""
SELECT example_id, label, least(len(w), 256) AS n_tokens,
  cast(list_sum(list_transform(w[1:256],
    lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 30522 + 1)) AS bigint) AS id_sum, 256::bigint AS width
FROM (SELECT example_id, CASE WHEN trim(coalesce(answer, '')) <> '' THEN 1e0 ELSE 0e0 END AS label,
    list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '') AS w
  FROM {QA_SQL}) WHERE len(w) > 0"""
)
def qa_features(spark, root):
    """Hashed word ids cut and padded to 256, with the attention mask and the label."""
    ids = F.transform(
        words(F.lower(F.col("question"))),
        lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % VOCAB_SIZE + 1,
    )
    encoded = qa_examples(spark, root).select(
        "example_id", qa.label(F.col("answers")).alias("label"), ids.alias("ids")
    )
    features = encoded.select(
        "example_id",
        "label",
        pad_or_cut(F.col("ids"), MAX_LENGTH, F.lit(0).cast("long")).alias("input_ids"),
        attention_mask(F.col("ids"), MAX_LENGTH).alias("attention_mask"),
    )
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return features.select(
        "example_id",
        "label",
        F.size(F.filter("attention_mask", lambda m: m == 1)).alias("n_tokens"),
        total.alias("id_sum"),
        F.size("input_ids").alias("width"),
    )


@query(
    f"""
SELECT split, count(*) FILTER (trim(coalesce(answer, '')) <> '') AS valid,
  count(*) FILTER (trim(coalesce(answer, '')) = '') AS invalid FROM {QA_SQL} GROUP BY split"""
)
def valid_answers(spark, root):
    examples = qa_examples(spark, root).withColumn("answers", non_empty(F.col("answers")))
    ok = qa.has_valid_answer(examples)
    return examples.groupBy("split").agg(
        F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")
    )


@query(
    f"""SELECT example_id, question FROM {QA_SQL}
WHERE trim(question) <> '' AND trim(coalesce(answer, '')) <> ''"""
)
def complete_pairs(spark, root):
    """Question and answer both present."""
    examples = qa_examples(spark, root)
    keep = (F.trim(text_or_empty("question")) != "") & any_answer(F.col("answers"))
    return examples.where(keep).select("example_id", "question")


def _shaped(spark, root):
    """JSON of a shape that depends on the row: nested object, list, texts within texts, scalar, null, nothing."""
    name, n = F.concat(F.lit('"'), "source", F.lit('"')), F.col("doc_id").cast("string")
    many = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (i + F.col("doc_id")).cast("string")), ","), F.lit("]"))
    levels = ["a", "b", "c", "d", "e", "f"]
    deep = F.concat(*[F.lit(f'{{"{k}":') for k in levels], F.lit("["), n, F.lit(","), name, F.lit("]"), F.lit("}" * len(levels)))
    kind = F.col("doc_id") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"deep":'), deep, F.lit(',"many":'), many, F.lit("}")))
        .when(kind == 1, many)
        .when(kind == 2, F.concat(F.lit('{"id":'), n, F.lit(',"text":{"text":['), name, F.lit(',"b"]}}')))
        .when(kind == 3, name)
        .when(kind == 4, n)
        .when(kind == 5, "null")
        .otherwise("{broken")
    )
    rows = table(spark, root, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.try_parse_json("raw").alias("v"))


_MANY_SQL = "list_transform(range(1, {n}), lambda i: (i + doc_id)::VARCHAR)"
_DEEP = ("a", "b", "c", "d", "e", "f")


def _cut_sql(depth: int) -> str:
    """What is left of the nested object when only `depth` levels are looked into."""
    tail = "'[' || doc_id || ',\"' || source || '\"]'"
    kept = min(depth, len(_DEEP))  # the levels a, b, ... that stay objects
    rest = "".join(f'{{"{k}":' for k in _DEEP[kept:])
    inner = f"'{rest}' || {tail} || '{'}' * len(_DEEP[kept:])}'"
    if depth < len(_DEEP) + 1:  # the first level that does not fit is a string
        inner = f"'\"' || replace({inner}, '\"', '\\\"') || '\"'"
    head = "".join(f'{{"{k}":' for k in _DEEP[:kept])
    many = f"'[' || array_to_string({_MANY_SQL.format(n=11)}, ',') || ']'"
    whole = f"'{{\"deep\":{head}' || {inner} || '{'}' * kept},\"many\":' || {many} || '}}'"
    return f"""CASE doc_id % 7 WHEN 0 THEN {whole} WHEN 1 THEN {many}
    WHEN 2 THEN '{{"id":' || doc_id || ',"text":{{"text":["' || source || '","b"]}}}}' WHEN 3 THEN '"' || source || '"'
    WHEN 4 THEN doc_id::VARCHAR ELSE 'null' END"""


@query(f"SELECT doc_id, " + ", ".join(f"{_cut_sql(d)} AS depth_{d}" for d in (2, 3, 5, 10)) + " FROM documents")
def json_depths(spark, root):
    """Values of every shape, cut at four depths, with lists of ten."""
    v = F.col("v")
    return _shaped(spark, root).select("doc_id", *[variants.capped_json(v, 10, d).alias(f"depth_{d}") for d in (2, 3, 5, 10)])


@query(
    f"""
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN '{{"deep":{"".join(f'{{"{k}":' for k in _DEEP)}[' || doc_id || ',"' || source || '"]{"}" * len(_DEEP)},"many":['
    || array_to_string({_MANY_SQL.format(n=13)}, ',') || ']}}'
  WHEN 1 THEN array_to_string({_MANY_SQL.format(n=11)}, ' ') WHEN 2 THEN source || ' b' WHEN 3 THEN source
  WHEN 4 THEN doc_id::VARCHAR ELSE '' END AS text FROM documents"""
)
def json_texts(spark, root):
    """One text for a value of every shape."""
    return _shaped(spark, root).select("doc_id", variants.text_of(F.col("v")).alias("text"))
