"""The pN_ queries of the problems tagged llm, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import caps, leaks, markup, packing, pairs, pii, residue, subjects, truncation
from tidemark.sources.tables import table


def _totals(df, name, text, key):
    return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count(text).alias("n_texts"), F.countDistinct(key).alias("n_ids"))


def p1_redacted_totals(s, d):
    """Redaction keeps every row, text and id of both tables."""
    items, chunks = pii.redacted(table(s, d, "items"), "body"), pii.redacted(table(s, d, "chunks"), "text")
    return _totals(items, "items", "body", "item_id").unionByName(_totals(chunks, "chunks", "text", "chunk_id"))


def p4_clean_totals(s, d):
    """The clean history and the items with residue are the whole history, row by row."""
    items = table(s, d, "items")
    gone = items.join(residue.found(items), "item_id", "left_semi").select("item_id")
    return _totals(residue.clean(items).select("item_id").unionByName(gone), "items", "item_id", "item_id")


def p6_converted_totals(s, d):
    """Conversion keeps every row, text and id."""
    return _totals(markup.converted(table(s, d, "items"), "body"), "items", "body", "item_id")


def p8_totals(s, d, capacity=4096):
    """Every document is assigned once, no container is overfull, and only documents above the capacity are split."""
    rows = packing.assignment(table(s, d, "documents"), capacity)
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count("container_id").alias("placed"), F.countDistinct("piece").alias("numbers"))
    full = rows.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > capacity).alias("n_overfull"))
    counts = docs.agg(F.count("*").alias("n_docs"), F.count_if(F.col("placed") == 0).alias("n_empty"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity) | (F.col("pieces") != F.col("numbers"))).alias("n_split_for_nothing"))
    return counts.withColumn("__one", F.lit(1)).join(full.withColumn("__one", F.lit(1)), "__one").drop("__one")


QUERIES = {
    "p1_redacted_totals": p1_redacted_totals,
    "p4_clean_totals": p4_clean_totals,
    "p6_converted_totals": p6_converted_totals,
    "p8_totals": p8_totals,
    "p1_found": lambda s, d: pii.found(table(s, d, "items"), table(s, d, "chunks")),
    "p1_redacted_items": lambda s, d: pii.redacted(table(s, d, "items"), "body"),
    "p1_redacted_chunks": lambda s, d: pii.redacted(table(s, d, "chunks"), "text"),
    "p2_found": lambda s, d: caps.found(table(s, d, "items")),
    "p2_capped": lambda s, d: caps.capped(table(s, d, "items")),
    "p3_found": lambda s, d: truncation.found(table(s, d, "chunks"), table(s, d, "items"), table(s, d, "calls")),
    "p3_rates": lambda s, d: truncation.rates(table(s, d, "chunks"), table(s, d, "items"), table(s, d, "calls")),
    "p4_found": lambda s, d: residue.found(table(s, d, "items")),
    "p4_clean": lambda s, d: residue.clean(table(s, d, "items")),
    "p6_found": lambda s, d: markup.found(table(s, d, "items")),
    "p6_converted": lambda s, d: markup.converted(table(s, d, "items"), "body"),
    "p7_found": lambda s, d: pairs.found(table(s, d, "calls")),
    "p8_assignment": lambda s, d: packing.assignment(table(s, d, "documents")),
    "p8_containers": lambda s, d: packing.containers(packing.assignment(table(s, d, "documents"))),
    "p9_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_passages")),
    "p9_copies": lambda s, d: leaks.copies(table(s, d, "documents"), table(s, d, "eval_passages")),
    "p9_leaked_passages": lambda s, d: leaks.report(table(s, d, "documents"), table(s, d, "eval_passages")),
    "p10_found": lambda s, d: subjects.found(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects")),
    "p10_makeup": lambda s, d: subjects.makeup(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects")),
}

ORACLES = {
    "p1_redacted_totals": """select 'items' as table_name, count(*) as n_rows, count(body) as n_texts, count(distinct item_id) as n_ids from items
union all select 'chunks', count(*), count(text), count(distinct chunk_id) from chunks""",
    "p4_clean_totals": "select 'items' as table_name, count(*) as n_rows, count(item_id) as n_texts, count(distinct item_id) as n_ids from items",
    "p6_converted_totals": "select 'items' as table_name, count(*) as n_rows, count(body) as n_texts, count(distinct item_id) as n_ids from items",
    "p8_totals": "select count(*) as n_docs, count(*) filter (coalesce(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '') = '') as n_empty, 0 as n_split_for_nothing, 0 as n_overfull from documents where doc_id is not null",
    "p2_found": caps.FOUND_SQL,
    "p2_capped": caps.CAPPED_SQL,
    "p9_found": leaks.FOUND_SQL,
    "p9_leaked_passages": leaks.REPORT_SQL,
}
