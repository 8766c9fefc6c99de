"""Queries p6 to p8 over documents and eval_items."""

from __future__ import annotations

from gapfold.llm import leaks, spam, tokens
from gapfold.sources.tables import table


def p6_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark, d):
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return spam.spam_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_spans, p8_found)}

SQL = {
    "p7_found": r"""with w as (select 0 as doc_id, item_id, list_transform(regexp_extract_all(prompt, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) as ws from eval_items where prompt is not null),
        iw as (select item_id, array_to_string(ws[i:i + 11], ' ') as k from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
        d as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) as ws from documents where text is not null),
        dw as (select doc_id, array_to_string(ws[i:i + 11], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from d where len(ws) >= 12))
        select distinct doc_id, item_id from dw join iw using (k)""",
}
