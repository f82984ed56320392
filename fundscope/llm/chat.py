"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, neighbours of one role are merged into
one block, and the blocks are joined into one training text with spans for the loss:

    <s>[INST]text[TURN]text[/INST][OUT]text</s>...

``[TURN]`` stands between the merged turns of a block, so the turns can be read back one by one.
Roles other than system, user and assistant are written as ``[ROLE]name[/ROLE]text[END]``.

Control strings inside texts and role names are escaped: a backslash is put behind the first
character of everything that is a control string or one with backslashes there already
(``[INST]`` to ``[\\INST]``, ``[\\INST]`` to ``[\\\\INST]``); reading back takes one away. No proper
end of a control string is the start of another, so no text can form one across a border.

One conversation is one value, in Spark at most 2 GB; conversations never meet in one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, ROLE, ROLE_END = "<s>", "[TURN]", "[ROLE]", "[/ROLE]"
#: role -> the strings before and after a block
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER_END = "[END]"
CHUNK = 128  # elements handled together in lists that may be long
CONTROL = [START, TURN, ROLE, ROLE_END, OTHER_END, *(m for pair in MARKS.values() for m in pair)]

_RESTS = {c: "|".join(re.escape(x[1:]) for x in CONTROL if x[0] == c) for c in "<["}
_HIT = "|".join(f"(?<={re.escape(c)})(?=\\\\*(?:{rest}))" for c, rest in _RESTS.items())
_UNDO = "|".join(f"(?<={re.escape(c)})\\\\(?=\\\\*(?:{rest}))" for c, rest in _RESTS.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _HIT, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNDO, "")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escape(role), F.lit(ROLE_END))
    for name, (a, _) in MARKS.items():
        out = F.when(role == name, F.lit(a)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER_END)
    for name, (_, b) in MARKS.items():
        out = F.when(role == name, F.lit(b)).otherwise(out)
    return out


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(size: Column) -> Column:
    """0, 1, ... for each ``CHUNK`` elements of an array of ``size``."""
    return F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _before(numbers: Column) -> Column:
    """For each number the sum of those before it. A fold copies its list at every step, so it runs inside
    chunks, and once more over the sums of the chunks."""
    none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("list"))

    def fold(values: Column, number) -> Column:
        return F.aggregate(values, none, lambda acc, x: F.struct((acc["sum"] + number(x)).alias("sum"), F.array_append(acc["list"], acc["sum"]).alias("list")))

    def spread(parts: Column) -> Column:
        zipped = F.arrays_zip(parts.alias("part"), fold(parts, lambda x: x["sum"])["list"].alias("at"))
        return F.flatten(F.transform(zipped, lambda z: F.transform(z["part"]["list"], lambda v: v + z["at"])))

    return _let(numbers, lambda n: _let(F.transform(_chunks(F.size(n)), lambda k: fold(F.slice(n, k * CHUNK + 1, F.lit(CHUNK)), lambda x: x)), spread))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted`` (string) and ``loss_spans``
    (array<struct<start:int,length:int>>, code points in ``formatted``, one span per assistant turn).

    Other columns are left out. Null texts and roles read as empty strings. A null turn comes
    first; rows of one turn number are ordered by role, then text; repeated rows are kept. A null
    conversation id is a conversation like any other. An empty table gives no rows.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = turns.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(one)).alias("t"))
    # where a block starts: the first turn, and each whose role differs from the one before
    starts = F.filter(F.sequence(F.lit(1), F.size("t")),
                      lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    got = got.withColumn("s", starts)

    def block(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("s", k + 1), F.size("t") + 1)
        return F.struct(F.element_at("t", i)["role"].alias("role"),
                        F.transform(F.slice("t", i, end - i), lambda x: escape(x["text"])).alias("texts"))

    got = got.withColumn("b", F.transform("s", block))
    piece = lambda b: F.concat(_opening(b["role"]), F.array_join(b["texts"], TURN), _closing(b["role"]))
    got = got.withColumn("p", F.transform("b", piece))
    formatted = F.concat(F.lit(START), F.array_join("p", ""))

    def block_spans(x: Column) -> Column:
        first = x["at"] + (len(START) + len(MARKS["assistant"][0]))
        sizes = F.transform(x["b"]["texts"], lambda text: F.char_length(text) + len(TURN))
        return _let(sizes, lambda n: F.transform(F.arrays_zip(n.alias("n"), _before(n).alias("at")), lambda y: F.struct(
            (first + y["at"]).alias("start"), (y["n"] - len(TURN)).alias("length"))))

    at = _before(F.transform("p", F.char_length))
    said = F.filter(F.arrays_zip(F.col("b"), at.alias("at")), lambda x: x["b"]["role"] == "assistant")
    spans = F.flatten(F.transform(said, block_spans))
    return got.select(conv_col, formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: array<struct<role, text>>."""
    opens = "|".join([*(re.escape(a) for a, _ in MARKS.values()), f"{re.escape(ROLE)}.*?{re.escape(ROLE_END)}"])
    ends = "|".join([*(re.escape(b) for _, b in MARKS.values()), re.escape(OTHER_END)])
    pattern = f"(?s)({opens})(.*?)(?:{ends})"
    heads = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))

    def turns(x: Column) -> Column:
        role = unescape(F.regexp_replace(F.substring(x["h"], len(ROLE) + 1, 1 << 30), f"{re.escape(ROLE_END)}$", ""))
        for name, (a, _) in MARKS.items():
            role = F.when(x["h"] == a, F.lit(name)).otherwise(role)
        return F.transform(F.split(x["b"], re.escape(TURN), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    def texts(k: Column) -> Column:
        # a substring is found by counting from the front: the spans of a chunk are cut from a cut of the text
        some = F.slice(spans, k * CHUNK + 1, F.lit(CHUNK))
        return _let(some, lambda s: _let(_cut(formatted, s), lambda part: F.array_join(F.transform(
            s, lambda x: unescape(F.substring(part, x["start"] - s[0]["start"] + 1, x["length"]))), "")))

    return F.array_join(F.transform(_chunks(F.size(spans)), texts), "")


def _cut(formatted: Column, spans: Column) -> Column:
    """The text from the first to the last of some spans."""
    last = F.element_at(spans, -1)
    return F.substring(formatted, spans[0]["start"] + 1, last["start"] + last["length"] - spans[0]["start"])
