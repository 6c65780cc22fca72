"""Chat formatting: heterogeneous layouts to canonical turns, and turns to one training text per conversation.

A layout is recognised by the hash of its nested field paths. The registry maps fingerprints to declarative mappings: SQL
expressions that turn a record into ``array<struct<role, text>>``. A table's layout is its schema; a column of JSON records may mix
layouts, so each record gets its own fingerprint, from Spark's schema of the parsed variant.

The template writes ``<turn>role<turn/>text</turn>`` per turn. Wherever a role or text holds ``<``, any backslashes and then ``turn``
or ``/turn``, one backslash is added after ``<``; reading back removes one. So a text can say anything, markers stay
unambiguous, and other characters are never touched.

Defined cases: a null role or text is empty; turns are ordered by ``turn`` (null first), then role, then text, and repeated rows
are repeated turns; rows without ``conv_id`` are one conversation; a conversation without assistant has an empty loss mask; records
of unknown layout have null turns and are returned, not dropped; empty tables give empty results; other columns are ignored.
The rows of a conversation are one training text, so they meet in one row: its size is that of the conversation, and aggregates
are partial on the map side, but no conversation can be split over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

TURNS = "array<struct<role:string,text:string>>"
OPEN, MIDDLE, CLOSE = "<turn>", "<turn/>", "</turn>"
TRAINED_ROLE = "assistant"


def field_paths(kind: DataType, path: str = "") -> list[str]:
    """Sorted nested paths of a type's fields; ``[]`` stands for the elements of an array, ``{}`` for the values of a map."""
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, path + "[]")
    if isinstance(kind, MapType):
        return field_paths(kind.valueType, path + "{}")
    if isinstance(kind, StructType):
        return sorted(p for f in kind for p in field_paths(f.dataType, f"{path}.{f.name}" if path else f.name))
    return [path]


def _fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)


def record_paths(schema: Column) -> Column:
    """The nested paths of a record from the text of its variant schema, such as ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``.

    Types of leaves are dropped, so a null or numeric content does not make another layout; names keep their nesting.
    """
    bare = F.regexp_replace(schema, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?", "")
    bare = F.regexp_replace(bare, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?>", "[]")
    return F.array(F.regexp_replace(F.regexp_replace(bare, "ARRAY<", "[<"), "OBJECT<", "<"))


def record_fingerprint(json: Column) -> Column:
    """Fingerprint of the layout of one JSON record; null for text that is no JSON."""
    return _fingerprint(record_paths(F.schema_of_variant(F.try_parse_json(json))))


def fingerprint_of_example(spark, example: str) -> str:
    """The fingerprint that records laid out like ``example`` have, for the registry."""
    return spark.range(1).select(record_fingerprint(F.lit(example)).alias("f")).first().f


#: Example record of a layout -> mapping to turns, over the columns ``json`` (text) and ``v`` (its variant).
RECORD_MAPPINGS: Mapping[str, str] = {
    '{"messages": [{"role": "r", "content": "c"}]}': (
        "transform(cast(variant_get(v, '$.messages', 'array<struct<role:string,content:string>>') as"
        " array<struct<role:string,content:string>>), m -> struct(m.role as role, m.content as text))"
    ),
    '{"conversations": [{"from": "f", "value": "v"}]}': (
        "transform(variant_get(v, '$.conversations', 'array<struct<from:string,value:string>>'), m -> struct("
        "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"
    ),
    '{"prompt": "p", "response": "r"}': (
        "array(struct('user' as role, variant_get(v, '$.prompt', 'string') as text),"
        " struct('assistant' as role, variant_get(v, '$.response', 'string') as text))"
    ),
    '{"instruction": "i", "input": "n", "output": "o"}': (
        "array(struct('user' as role, concat_ws('\\n\\n', variant_get(v, '$.instruction', 'string'),"
        " nullif(variant_get(v, '$.input', 'string'), '')) as text),"
        " struct('assistant' as role, variant_get(v, '$.output', 'string') as text))"
    ),
    '{"instruction": "i", "output": "o"}': (
        "array(struct('user' as role, variant_get(v, '$.instruction', 'string') as text),"
        " struct('assistant' as role, variant_get(v, '$.output', 'string') as text))"
    ),
}


def record_turns(records: DataFrame, id_column: str, json_column: str, mappings: Mapping[str, str] = RECORD_MAPPINGS) -> DataFrame:
    """``conv_id, turns, layout`` of a column of JSON records; each record's fingerprint selects its mapping."""
    spark = records.sparkSession
    source = records.select(F.col(id_column).alias("conv_id"), F.col(json_column).alias("json")).withColumn(
        "v", F.try_parse_json("json")
    )
    source = source.withColumn("layout", record_fingerprint(F.col("json")))
    turns = F.lit(None).cast(TURNS)
    for example, mapping in mappings.items():
        known = F.lit(fingerprint_of_example(spark, example))
        turns = F.when(F.col("layout") == known, F.expr(mapping).cast(TURNS)).otherwise(turns)
    return source.select("conv_id", turns.alias("turns"), "layout")


def table_fingerprint(schema: StructType, columns: tuple[str, ...]) -> str:
    """Fingerprint of the field paths of a table, of ``columns`` only: other columns do not matter."""
    import hashlib

    paths = field_paths(StructType([f for f in schema if f.name in columns]))
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def _rows_by_turn(rows: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("sorted"))
    return grouped.select("conv_id", F.transform("sorted", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def _messages(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.transform("messages", lambda m: F.struct(m.role.alias("role"), m.content.alias("text"))).alias("turns"))


def _prompt_response(rows: DataFrame) -> DataFrame:
    def said(role: str, column: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(column).alias("text"))

    return rows.select("conv_id", F.array(said("user", "prompt"), said("assistant", "response")).alias("turns"))


#: Field paths of a table's layout -> mapping of the table.
TABLE_MAPPINGS = {
    ("conv_id", "turn", "role", "text"): _rows_by_turn,
    ("conv_id", "messages[].role", "messages[].content"): _messages,
    ("conv_id", "prompt", "response"): _prompt_response,
}


def table_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` of a table; the fingerprint of its field paths selects the mapping."""
    import hashlib

    for paths, mapping in TABLE_MAPPINGS.items():
        columns = tuple({p.split(".")[0].split("[")[0] for p in paths})
        wanted = hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()
        if table_fingerprint(rows.schema, columns) == wanted:
            return mapping(rows)
    raise ValueError(f"no mapping for the layout {field_paths(rows.schema)}")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def formatted(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id, formatted, loss_mask``: the text, and the start and length in code points of every trained text in it."""
    pieces = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(
            F.coalesce(t.role.eqNullSafe(F.lit(trained_role)), F.lit(False)).alias("trained"),
            F.concat(F.lit(OPEN), escaped(t.role), F.lit(MIDDLE)).alias("head"),
            escaped(t.text).alias("body"),
        ),
    )
    parts = conversations.select("conv_id", pieces.alias("pieces"))
    length = len(CLOSE)
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state.at + F.length(p.head)
        span = F.array(F.struct(start.cast("long").alias("start"), F.length(p.body).cast("long").alias("length")))
        spans = F.when(p.trained, F.concat(state.spans, span)).otherwise(state.spans)
        return F.struct((start + F.length(p.body) + length).cast("long").alias("at"), spans.alias("spans"))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", empty, step).spans.alias("loss_mask"),
    )


def read_turns(text: Column) -> Column:
    """The canonical turns in a formatted text."""
    whole = F.filter(F.split(text, CLOSE, -1), lambda part: part.startswith(OPEN))
    return F.transform(
        whole,
        lambda part: F.struct(
            unescaped(F.substring_index(F.substring(part, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"),
            unescaped(F.substring_index(part, MIDDLE, -1)).alias("text"),
        ),
    )


def read_loss_texts(text: Column, mask: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(mask, lambda s: unescaped(text.substr((s.start + 1).cast("int"), s.length.cast("int"))))


def digests(out: DataFrame) -> DataFrame:
    """What a formatted text holds, read back from it."""
    turns, loss = read_turns(F.col("formatted")), F.array_join(read_loss_texts(F.col("formatted"), F.col("loss_mask")), "")
    read = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("n"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
