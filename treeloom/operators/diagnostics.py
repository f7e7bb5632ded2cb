"""Diagnostic tables: order, text and JSON output, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(diagnostics: DataFrame) -> DataFrame:
    """By document and place; equal places stay in the order of discovery."""
    return diagnostics.orderBy("doc_id", "doc_key", "line", "col", "diag_id")


def as_text(diagnostics: DataFrame, path: Column) -> DataFrame:
    """doc_id, doc_key, diag_id, text: ``path:line:col: severity[code]: message`` with note and help lines; columns from 1."""
    head = F.format_string("%s:%d:%d: %s[%s]: %s", path, "line", F.col("col") + 1, "severity", "code", "message")
    note = F.when(F.col("related").isNotNull(), F.format_string("\n  note: %s:%d:%d: %s", path, "related.line", F.col("related.col") + 1, "related.message")).otherwise("")
    hint = F.when(F.coalesce("fix", F.lit("")) != "", F.concat(F.lit("\n  help: "), "fix")).otherwise("")
    return diagnostics.select("doc_id", "doc_key", "diag_id", F.concat(head, note, hint).alias("text"))


def as_json(diagnostics: DataFrame) -> DataFrame:
    """doc_id, doc_key and a JSON array of a document's diagnostics in order; columns from 0, fix and related only where present."""
    one = F.struct("line", "col", "diag_id", F.struct("severity", "code", "message", "line", "col", F.col("end_col").alias("endCol"), F.when(F.col("fix") != "", F.col("fix")).alias("fix"), "related").alias("d"))
    rows = diagnostics.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select("doc_id", "doc_key", F.to_json(F.transform("all", lambda x: x["d"])).alias("json"))


def first_error(diagnostics: DataFrame) -> DataFrame:
    """doc_id, doc_key, code, message, line, col of the first error that was met in each document that has one."""
    errors = diagnostics.filter("severity = 'error'").groupBy("doc_id", "doc_key").agg(F.min_by(F.struct("code", "message", "line", "col"), "diag_id").alias("first"))
    return errors.select("doc_id", "doc_key", "first.*")


def exit_codes(checked: DataFrame) -> DataFrame:
    """doc_id and 1 for a document with an error, else 0, of a table of verdicts (doc_id, sound)."""
    return checked.select("doc_id", F.when(F.col("sound"), 0).otherwise(1).alias("exit_code"))


def positions(content: Column, byte: Column) -> tuple[Column, Column]:
    """Line and column, both from 1, of a byte offset in ASCII text with ``\\n`` line ends."""
    before = F.substring(content, F.lit(1), byte)
    return F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.octet_length(F.substring_index(before, "\n", -1)) + 1
