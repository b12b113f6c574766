"""Explicit schemas of the records that are read from and written to files."""

IR_CORPUS = "_id STRING, title STRING, text STRING"
IR_QUERY = "_id STRING, text STRING"
QREL = "query_id STRING, doc_id STRING, relevance INT"
PASSAGE = "doc_id STRING, text STRING"
IR_PAIR = (
    "query STRING, query_id STRING, passage STRING, passage_id STRING, relevance INT, "
    "dataset STRING"
)
PASSAGE_ITEM = "STRUCT<passage_text: STRING, is_selected: INT, url: STRING>"
QA_NESTED = (
    "query_id STRING, query STRING, query_type STRING, answers ARRAY<STRING>, "
    f"passages ARRAY<{PASSAGE_ITEM}>"
)
# One file holds maps keyed by the query id.
QA_KEYED = (
    "query MAP<STRING, STRUCT<query: STRING, query_type: STRING, answers: ARRAY<STRING>>>, "
    f"passages MAP<STRING, ARRAY<{PASSAGE_ITEM}>>"
)
QA_FLAT = (
    "question STRING, answers ARRAY<STRING>, query_id STRING, query_type STRING, "
    "wellFormedAnswers ARRAY<STRING>"
)
QA_FLAGGED = (
    "question_id STRING, question STRING, answers ARRAY<STRING>, passages ARRAY<STRING>, "
    "has_answer BOOLEAN, query_type STRING"
)
SPAN = "STRUCT<start_token: INT, end_token: INT>"
NQ_RAW = (
    "id STRING, question STRUCT<text: STRING>, "
    "document STRUCT<title: STRING, url: STRING, tokens: STRUCT<token: ARRAY<STRING>>>, "
    "annotations STRING"
)
NQ_OUT = (
    "question STRING, short_answers ARRAY<STRING>, long_answers ARRAY<STRING>, "
    "example_id STRING, document_title STRING, document_url STRING, "
    "has_short_answer BOOLEAN, has_long_answer BOOLEAN"
)
KG_ENTITY = "entity_id STRING, entity_name STRING"
KG_RELATION = "relation_id STRING, relation_name STRING"
KG_TRIPLE = "head STRING, relation STRING, tail STRING"
KG_LABELLED = f"{KG_TRIPLE}, head_label STRING, relation_label STRING, tail_label STRING"
METRIC_LOG = "experiment STRING, metric STRING, step BIGINT, value DOUBLE, elapsed_s DOUBLE"
DATASET_STATUS = "name STRING, status STRING, size_mb DOUBLE, examples BIGINT"
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING"
)
