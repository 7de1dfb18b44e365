"""Chat formatting: records of many layouts become canonical turns by the fingerprint of their fields, then one marked text a conversation.

DataFrame functions only. A record's fingerprint is the hash of the nested
paths of its fields that are not null; it selects the declared layout whose
mapping takes the record to turns. Records lie in one table with the fields of
all layouts, as spark.read.json makes it from mixed files.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass(frozen=True)
class Layout:
    """How records with certain fields are read.

    Paths name nested fields by dots, and elements of lists by []. A record
    has this layout if, of all paths that any layout names, it holds all in
    required and none but these and optional. each: the list whose elements
    are turns ("" where the record itself is one), whose role and text are the
    paths in it; text of several parts is joined. turns: else the roles of
    fixed turns with the paths of their texts, which a blank line joins; a
    turn without any is left out. order: the record's place in its
    conversation. roles: canonical names of others.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def field_sets(self) -> Iterable[tuple[str, ...]]:
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                yield tuple(sorted({*self.required, *more}))


#: Field names and roles of widespread layouts.
LAYOUTS = (
    Layout("rows", (), ("turn", "role", "text"), each="", role="role", text="text", order="turn"),
    Layout("messages", ("messages",), ("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Layout("message parts", ("messages", "messages[].parts"), ("messages[].role", "messages[].parts[].text"), each="messages", role="role", text="parts[].text"),
    Layout("from and value", ("conversations",), ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction",), ("input", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and response", ("prompt",), ("response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
)

#: Marks of the template: what goes before a turn's role, between role and text, and behind the text.
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"


def _read(kind: DataType, at: Column, path: str) -> tuple[DataType, Column] | None:
    """Type and value of a path without [], None where the type has no such field."""
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        kind, at = kind[name].dataType, at.getField(name)
    return kind, at


def _present(kind: DataType, at: Column, path: str, lists: set[str], upper: str = "") -> Column:
    """Whether a path's field is there; a field that layouts read as a list must be one."""
    head, _, rest = path.partition("[].")
    found = _read(kind, at, head)
    if found is None or (upper + head in lists and not isinstance(found[0], ArrayType)):
        return F.lit(False)
    if not rest:
        return found[1].isNotNull()
    inner = found[0].elementType
    return F.coalesce(F.exists(found[1], lambda x: _present(inner, x, rest, lists, f"{upper}{head}[].")), F.lit(False))


def _text(kind: DataType, at: Column, path: str) -> Column:
    head, _, rest = path.partition("[].")
    found = _read(kind, at, head)
    if found is None:
        return F.lit(None).cast("string")
    if not rest:
        return found[1].cast("string")
    inner = found[0].elementType
    return F.array_join(F.transform(found[1], lambda x: F.coalesce(_text(inner, x, rest), F.lit(""))), "")


def _fingerprint(paths: Column) -> Column:
    return F.md5(F.concat_ws("\n", paths))


def _named(role: Column, roles: dict[str, str]) -> Column:
    for name, canonical in roles.items():
        role = F.when(role == name, canonical).otherwise(role)
    return role


def _turns(layout: Layout, kind: StructType, record: Column) -> Column:
    """array<struct<place, role, text>> by the layout's mapping."""
    one = lambda place, role, text: F.struct(place.cast("int").alias("place"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    if layout.each == "":
        return F.array(one(F.lit(0), _named(_text(kind, record, layout.role), layout.roles), _text(kind, record, layout.text)))
    if layout.each:
        found = _read(kind, record, layout.each)
        inner = found[0].elementType
        return F.transform(found[1], lambda x, i: one(i, _named(_text(inner, x, layout.role), layout.roles), _text(inner, x, layout.text)))
    made = [F.when(F.coalesce(*(texts := [_text(kind, record, p) for p in paths])).isNotNull(), one(F.lit(i), F.lit(role), F.concat_ws("\n\n", *texts))) for i, (role, paths) in enumerate(layout.turns)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, layout, turn, role, text: one row per turn, turn counting from 0 in each conversation.

    Records with one id are one conversation, by their order, null first;
    those without one follow each other by content. Turns of one place are
    ordered by role and text; all stay. Null roles and texts are empty. A
    record whose fields no layout has, and one without any turn, gives one row
    with null turn (and null layout in the first case). Null ids are one
    conversation. Fields that no layout names are ignored, whatever their
    names. An empty table gives an empty result.
    """
    known = sorted({p for x in layouts for p in (*x.required, *x.optional)})
    lists = {p[: i] for p in known for i in range(len(p)) if p.startswith("[]", i)} | {x.each for x in layouts if x.each}
    rows: dict[tuple[str, ...], str] = {}
    for x in layouts:
        for fields in x.field_sets():
            if rows.setdefault(fields, x.name) != x.name:
                raise ValueError(f"records with the fields {fields} have two layouts: {rows[fields]} and {x.name}")
    spark, kind = records.sparkSession, records.schema
    table = spark.createDataFrame([(list(k), v) for k, v in rows.items()], "fields array<string>, layout string").select(_fingerprint(F.col("fields")).alias("found"), "layout")

    record = F.col("record")
    packed = records.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"))
    paths = F.filter(F.array(*[F.when(_present(kind, record, p, lists), F.lit(p)) for p in known]), lambda p: p.isNotNull())
    # The table of layouts is as large as their declarations.
    read = packed.withColumn("fingerprint", _fingerprint(paths)).join(F.broadcast(table), F.col("fingerprint") == F.col("found"), "left")
    turns, order = F.lit(None), F.lit(None).cast("long")
    for x in layouts:
        if x.each and not isinstance((_read(kind, record, x.each) or (None,))[0], ArrayType):
            continue
        turns = F.when(F.col("layout") == x.name, _turns(x, kind, record)).otherwise(turns)
        if x.order and (found := _read(kind, record, x.order)):
            order = F.when(F.col("layout") == x.name, found[1].cast("string").try_cast("long")).otherwise(order)
    shaped = read.select("conv_id", "layout", order.alias("order"), turns.cast("array<struct<place:int,role:string,text:string>>").alias("turns"))
    shaped = shaped.withColumn("content", F.when(F.col("order").isNull(), F.xxhash64("turns")).otherwise(F.lit(0)))
    each = shaped.select("conv_id", "layout", "order", "content", F.explode_outer("turns").alias("t"))
    by = Window.partitionBy("conv_id").orderBy(F.col("t").isNull(), F.asc_nulls_first("order"), "content", "t.place", "t.role", "t.text")
    number = F.when(F.col("t").isNotNull(), F.row_number().over(by).cast("long") - 1)
    empty = lambda c: F.when(F.col("t").isNotNull(), F.coalesce(F.col(f"t.{c}"), F.lit("")))
    return each.select("conv_id", "layout", number.alias("turn"), empty("role").alias("role"), empty("text").alias("text"))


def escape(text: Column, role: bool = False) -> Column:
    """The text without any mark: backslashes are doubled, and one goes behind the first character of each mark."""
    marks = r"#(?=##)|<(?=/turn>)" + (r"|:(?=\n)" if role else "")
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), marks, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one text per conversation of canonical_turns().

    loss_spans: array of (start, length) in bytes of UTF-8, the texts of the
    role learn, in order. A conversation is one row, so at most 2 GB; one
    without turns is an empty text.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(MIDDLE))
    pieces = turns.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.when(F.col("turn").isNotNull(), F.concat("head", "body", F.lit(CLOSE))).otherwise(""))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn")).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)))
    span = F.struct("turn", (F.col("start") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"))
    # A conversation is one output row.
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.array_sort(F.collect_list(F.when(F.col("role") == learn, span))).alias("spans"))
    return joined.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>, as they were before formatting."""
    parts = F.split(formatted, CLOSE)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, MIDDLE, 1)
        text = F.substring(part, F.length(head) + len(MIDDLE) + 1, F.length(part))
        return F.struct(unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head))).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, without escapes: one element a span."""
    data = formatted.cast("binary")
    cut = lambda s: F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")
    return F.transform(spans, lambda s: unescape(cut(s)))
