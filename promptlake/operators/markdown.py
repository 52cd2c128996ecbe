"""Markdown texts as trees: nodes in the order of the text, each with the interval of its descendants.

Node 0 is the document; a node's descendants are the nodes behind it up to ``last``. A heading of level 1 is a child of
the document, one of level 2 of the section before it, deeper ones and all else of the last heading of level 1 or 2. What the
tree is asked for (leaves, empty sections, sections to leave out) is then interval arithmetic on rows.

Defined cases: a null or blank text is a document without children; lines in a paragraph are its own whatever they look like, as a
blank line ends it; a fence that is not closed runs to the end; a table ends with its last row, also at the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import lexicon

NODE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("path", T.ArrayType(T.IntegerType())),
])
SECTIONS = ("document", "section", "subsection")

_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
_RULE = re.compile(r"[-*_]{3,}\s*$")
_QUOTE = re.compile(r">\s*(.+)$")
_ROW = re.compile(r"\|.+\|$")
_BULLET = re.compile(r"(\s*)[-*+]\s+(.+)$")
_NUMBER = re.compile(r"(\s*)\d+[.)]\s+(.+)$")


def _fence(line: str) -> bool:
    return line.strip().startswith(("```", "~~~"))


def _item(line: str, indent: int | None) -> str | None:
    """The text of a list item; with an indent only of one that stands there."""
    m = _BULLET.match(line) or _NUMBER.match(line)
    return m[2] if m and indent in (None, len(m[1])) else None


def blocks(text: str):
    """kind, level, content and items of each block in turn."""
    lines, i = text.split("\n"), 0

    def run(start: int, belongs) -> int:
        while start < len(lines) and belongs(lines[start]):
            start += 1
        return start

    while i < len(lines):
        line, items, level = lines[i], [], 0
        if _fence(line):
            end = min(len(lines), run(i + 1, lambda x: not _fence(x)) + 1)
            kind, content = "code", "\n".join(lines[i:end])
        elif m := _HEADING.match(line):
            end, level, content = i + 1, len(m[1]), m[2].strip()
            kind = "section" if level <= 2 else "subsection"
        elif _RULE.match(line):
            end, kind, content = i + 1, "rule", line.strip()
        elif _QUOTE.match(line):
            end = run(i, _QUOTE.match)
            kind, content = "quote", "\n".join(_QUOTE.match(x)[1] for x in lines[i:end])
        elif _ROW.match(line):
            end = run(i, _ROW.match)
            kind, content = "table", "\n".join(lines[i:end])
        elif _item(line, None) is not None:
            m = _BULLET.match(line)  # items under a bullet stand where it does
            indent = len(m[1]) if m else None
            end = run(i, lambda x: _item(x, indent) is not None)
            items = [_item(x, None) for x in lines[i:end]]
            kind, content = "list", "\n".join(items)
        elif not line.strip():
            i += 1
            continue
        else:
            end = run(i, str.strip)
            kind, content = "paragraph", "\n".join(lines[i:end])
        yield kind, level, content, items
        i = end


def nodes_of(text: str | None) -> list[dict]:
    found = [{"id": 0, "parent": None, "kind": "document", "level": 0, "content": "", "path": []}]
    children: dict[int, int] = {}

    def add(parent: int, kind: str, level: int, content: str) -> int:
        children[parent] = children.get(parent, 0) + 1
        found.append({"id": len(found), "parent": parent, "kind": kind, "level": level, "content": content, "path": [*found[parent]["path"], children[parent]]})
        return len(found) - 1

    section, subsection = 0, None
    for kind, level, content, items in blocks(text or ""):
        under = section if subsection is None else subsection
        if level == 1:
            section, subsection = add(0, kind, level, content), None
        elif level == 2:
            subsection = add(section, kind, level, content)
        else:
            node = add(under, kind, level, content)
            for item in items:
                add(node, "item", 0, item)
    for node in found:
        node["last"] = node["id"]
    for node in reversed(found[1:]):
        up = found[node["parent"]]
        up["last"] = max(up["last"], node["last"])
    return found


#: Nodes that a task holds at a time, unless one text has more.
HELD = 5_000


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id and the nodes of each document's text (doc_id, t): id, parent, last, kind, level, content, path (numbers among siblings)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *NODE.fields])
    arrow = to_arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def told(at: list[int], held: list[dict]) -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([x[f.name] for x in held], f.type) for f in arrow)]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            at, held = [], []
            for i in range(batch.num_rows):
                found = nodes_of(batch.column(1)[i].as_py())
                if held and len(held) + len(found) > HELD:
                    yield told(at, held)
                    at, held = [], []
                at += [i] * len(found)
                held += found
            if held:
                yield told(at, held)

    return docs.select("doc_id", "t").mapInArrow(run, schema)


def flat_texts(tree: DataFrame) -> DataFrame:
    """doc_id and the contents of all nodes without children in order, joined by line ends; a heading with something below is not one."""
    leaves = tree.filter("last = id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("leaves"))
    return leaves.select("doc_id", F.array_join("leaves.content", "\n").alias("text"), F.size("leaves").cast("long").alias("leaves"))


def without_empty_sections(tree: DataFrame) -> DataFrame:
    """tree without sections, at any depth, below which is nothing but sections, and without blank leaves. What is below is a difference
    of two running counts."""
    content = (~F.col("kind").isin(*SECTIONS) & ((F.trim("content") != "") | (F.col("last") > F.col("id")))).cast("int")
    upto = tree.withColumn("upto", F.sum(content).over(Window.partitionBy("doc_id").orderBy("id")))
    ends = upto.select("doc_id", F.col("id").alias("last"), F.col("upto").alias("through"))
    counted = upto.join(ends, ["doc_id", "last"])
    stays = (F.col("kind") == "document") | F.when(F.col("kind").isin(*SECTIONS), F.col("through") > F.col("upto")).otherwise((F.trim("content") != "") | (F.col("last") > F.col("id")))
    return counted.filter(stays).select(tree.columns)


def without_noise_sections(tree: DataFrame) -> DataFrame:
    """tree without headings of contents, references and the like (any level) and what follows up to the next heading."""
    heading = F.col("kind").isin("section", "subsection")
    before = F.last(F.when(heading, F.lower(F.trim("content"))), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("id"))
    return tree.withColumn("heading", before).filter(F.col("heading").isNull() | ~F.col("heading").isin(*lexicon.NOISE_HEADINGS)).select(tree.columns)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and t of whole text and Markdown files; bytes that are not UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
