"""Chat formatting: many record layouts to canonical turns, turns to one text with a loss mask. All native.

A record is fingerprinted by its nested field paths: ``schema_of_variant`` names every path of the record
(keys sorted, array elements merged), scalar types are struck out, and the rest is hashed. The hash selects
a declarative :class:`Layout`, so a record is never probed field by field. Records whose fingerprint
belongs to no layout come back with the layout ``unmapped`` and no turns.

Template: each turn is ``<|im_start|>role LF text<|im_end|> LF``. Control strings begin with ``<`` or ``[``
followed by one of ``| / s I``; inside texts a backslash is put between the two (one more, if there
are backslashes already), which is undone by taking one away. Roles are percent-encoded. The loss mask is a
list of code point spans, one per assistant turn, over the formatted text.

Defined results: a null text is empty, a null role is the empty role, null conversation ids form one
conversation, null turns come first, ties in ``turn`` go by role and text, repeated rows are
repeated turns, an empty table gives an empty table. Extra columns are ignored. A conversation is
one output row, so its turns meet in one task: that is the one group that must fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, path) in order for flat records. ``items``: path of an array of turns with the
    fields ``role`` and ``text``. ``row``: the record is one turn itself. Paths in ``optional`` may be missing."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    row: bool = False
    optional: frozenset[str] = field(default_factory=frozenset)

    def paths(self) -> list[str]:
        if self.row:
            return [self.role, self.text]
        own = [p for _, p in self.turns]
        return own + ([f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"] if self.items else [])

    def variants(self) -> list[list[str]]:
        must = [p for p in self.paths() if p not in self.optional]
        extra = sorted(self.optional)
        return [must + list(c) for n in range(len(extra) + 1) for c in combinations(extra, n)]


LAYOUTS = (
    Layout("turn_row", row=True, text="text"),
    Layout("messages", items="messages", turns=(("system", "system"),), optional=frozenset({"system"})),
    Layout("from_value", items="conversations", role="from", text="value",
           turns=(("system", "system"),), optional=frozenset({"system"})),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"),
                                 ("assistant", "output")), optional=frozenset({"system", "input"})),
    Layout("prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
           optional=frozenset({"system"})),
    Layout("completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question", turns=(("user", "question"), ("assistant", "answer"))),
)


def skeleton_of(paths: list[str]) -> str:
    """The text ``skeleton`` gives for a record with these paths."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        if not node:
            return ""
        return "OBJECT<" + ", ".join(
            f"{k.removesuffix('[]')}: " + (f"ARRAY<{show(v)}>" if k.endswith("[]") else show(v))
            for k, v in sorted(node.items(), key=lambda kv: kv[0].removesuffix("[]"))) + ">"

    return show(tree)


SCALARS = r"(?<=: |ARRAY<)(VOID|BOOLEAN|BIGINT|STRING|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY)(?=[,>])"


def skeleton(record: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(record), SCALARS, "")


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the layout whose fingerprint the record has, or ``unmapped``."""
    print_, out = F.xxhash64(skeleton(record)), F.lit("unmapped")
    for layout in layouts:
        known = [F.xxhash64(F.lit(skeleton_of(v))) for v in layout.variants()]
        out = F.when(print_.isin(*known), layout.name).otherwise(out)
    return out


def role_of(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(names[F.lower(role)], role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_of_records(df: DataFrame, record: str, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """JSON records (one conversation each) as ``key, layout, turn, role, text`` rows. A flat field that is
    missing or null makes no turn. Invalid JSON and unmapped records keep one row with a null turn."""
    rows = df.select(F.col(key).alias("_key"), F.try_parse_json(F.col(record).cast("string")).alias("_v"))
    rows = rows.withColumn("_layout", F.coalesce(layout_of(F.col("_v"), layouts), F.lit("unmapped")))
    get = lambda path: F.try_variant_get("_v", f"$.{path}", "string")
    found = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in (x for x in layouts if not x.row):
        parts = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), get(p).alias("text"))
                                   for r, p in layout.turns]), lambda t: t["text"].isNotNull())
        if layout.items:
            kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
            items = F.try_variant_get("_v", f"$.{layout.items}", kind)
            parts = F.concat(parts, F.transform(items, lambda m: _turn(role_of(m[layout.role]), m[layout.text])))
        found = F.when(F.col("_layout") == layout.name, parts).otherwise(found)
    return rows.select("_key", "_layout", F.posexplode_outer(found).alias("turn", "_t")).select(
        F.col("_key").alias(key), F.col("_layout").alias("layout"), "turn", F.col("_t.role").alias("role"),
        F.col("_t.text").alias("text"))


def unmapped(df: DataFrame, record: str, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no layout fits, ``key`` and ``record`` as they came: invalid JSON and unknown sets of fields."""
    value = F.try_parse_json(F.col(record).cast("string"))
    return df.filter(F.coalesce(layout_of(value, layouts), F.lit("unmapped")) == "unmapped").select(key, record)


def turns_of_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows that are one turn each as ``key, layout, turn, role, text``; the row's own fingerprint over the
    named fields must be that of a ``row`` layout, else its layout is ``unmapped``."""
    record = F.to_variant_object(F.struct(F.col(role), F.col(text)))
    return df.select(
        F.col(key), layout_of(record, layouts).alias("layout"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)([|/sI])", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)([|/sI])", r"$1$2$3")


def format_turns(turns: DataFrame, key: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_mask``, spans of code points (start, length). Records that no layout
    fits have no turns to format; ``unmapped`` gives them back."""
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    rows = turns.filter(F.col("layout") != "unmapped").select(
        key, "turn", "role", "text", head.alias("_head"), body.alias("_body"))
    size = F.length("_head") + F.length("_body") + F.lit(len(CLOSE) + 1)
    order = Window.partitionBy(key).orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.select(
        key, F.row_number().over(order).alias("_n"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("_head")).alias("_start"),
        F.length("_body").alias("_size"), (F.col("role") == loss_role).alias("_loss"),
        F.concat("_head", "_body", F.lit(CLOSE + "\n")).alias("_part"))
    parts = F.array_sort(F.collect_list(F.struct("_n", "_part")))
    spans = F.array_sort(F.collect_list(F.when(F.col("_loss"), F.struct(
        F.col("_start").cast("long").alias("start"), F.col("_size").cast("long").alias("length")))))
    return placed.groupBy(key).agg(parts.alias("_parts"), spans.alias("loss_mask")).select(
        key, F.concat_ws("", F.transform("_parts", lambda p: p["_part"])).alias("formatted"), "loss_mask")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, roles and texts as they were."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(
        F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(p, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", "")).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(mask, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: both sides say control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted output reads back as, per conversation."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    out = format_turns(turns_of_rows(rows.unionByName(probe(conversations.sparkSession))))
    read = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("_turns"),
                      loss_text(F.col("formatted"), F.col("loss_mask")).alias("_loss"))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))
    AS loss_sha256,
  CAST(sum(24 + length(role)
    + length(regexp_replace(text, '([<\[])(\\*)([|/sI])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""
