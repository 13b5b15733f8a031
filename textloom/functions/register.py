"""The text functions under names, for SQL: register(spark) once in a session.

Kernels become vectorized UDFs, parsers become table functions, and .docx folders
a data source: spark.read.format("docx").load(folder).
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from ..operators import compare, diff, mapping, parts, structure, symbols
from ..sources import decode, docx, package
from . import similarity, text
from .vectorized import vectorized

#: Name -> column function made by vectorized().
FUNCTIONS = {
    "match_key": text.match_key_col, "visible_key": text.visible_key_col, "lineage_key": text.lineage_key_col, "text_tokens": text.tokens_col, "text_sentences": text.sentences_col,
    "roman_value": vectorized(text.roman_value, "int"), "section_number": vectorized(text.section_number, "double"), "label_ordinal": text.label_ordinal_col, "stable_edge": text.stable_edge_col, "stable_sentence": text.stable_sentence_col,
    "byte_to_utf16": text.byte_to_utf16_col, "utf16_to_byte": text.utf16_to_byte_col, "split_punctuation": vectorized(text.split_punctuation, "array<string>"), "hangul_prefix": text.hangul_prefix_col,
    "indel_ratio": similarity.indel_ratio_col, "sequence_ratio": similarity.sequence_ratio_col, "token_similarity": similarity.token_similarity_col, "hangul_word_cost": similarity.hangul_word_cost_col,
    "line_hunks": diff.line_hunks_col, "review_events": diff.review_events_col, "whitespace_events": diff.whitespace_events_col, "project_offset": diff.project_col, "text_segments": diff.segments_col,
    "document_units": structure.units_col, "list_parts": structure.parts_col, "list_levels": structure.hierarchy_col, "match_parts": parts.match_parts_col,
    "declarations": symbols.declarations_col, "boundary_tokens": mapping.boundary_tokens_col, "block_units": compare.block_units_col, "text_units": compare.text_units_col,
    "decode_text": decode.decode_col, "docx_blocks": docx.blocks_col, "docx_text": docx.flat_text_col, "docx_styles": docx.styles_col,
    "docx_parts": package.ancillary_col, "docx_special": package.special_content_col, "docx_tables": package.table_geometry_col, "tracks_changes": package.tracks_changes_col,
}


class LineHunks:
    """Hunks of two texts as rows."""

    def eval(self, before: str, after: str):
        for n, h in enumerate(diff.limited_hunks(before or "", after or ""), 1):
            yield (n, *h)


class DocumentUnits:
    """Units of a text as rows."""

    def eval(self, text: str):
        for n, u in enumerate(structure.units(text or "")):
            yield (n, *u)


TABLES = {
    "line_hunk_rows": (LineHunks, "ord int, kind string, before_start int, before_end int, after_start int, after_end int, limited boolean"),
    "document_unit_rows": (DocumentUnits, "unit_ix int, kind string, number string, title string, header string, body string, section string"),
}


class Documents(DataSource):
    """Blocks of the .docx files of a folder, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "path string, block_ix int, text string, table int, row int, col int"

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options["path"])


class DocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".docx") and not n.startswith("."))
        return [InputPartition(p) for p in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with io.open(partition.value, "rb") as f:
                for n, b in enumerate(docx.blocks(f.read())):
                    yield (partition.value, n, *b[:4])


def register(spark: SparkSession) -> list[str]:
    """Register all functions, table functions and the data source; their names."""
    for name, column in FUNCTIONS.items():
        spark.udf.register(name, column.udf())
    for name, (table, schema) in TABLES.items():
        spark.udtf.register(name, udtf(table, returnType=schema))
    spark.dataSource.register(Documents)
    return [*FUNCTIONS, *TABLES, Documents.name()]
