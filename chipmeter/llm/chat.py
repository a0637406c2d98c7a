"""Operator 5, chat formatting: a finite-state machine over roles and a declarative template with loss flags.

A conversation's rows are taken by turn (ties by role, then text; nulls first). The template gives each role its marks
and says whether its text is trained on. Control strings inside texts are escaped, so that a formatted
conversation reads back to exactly its turns. Rows of one conversation are gathered in one task: a conversation is one
training example, so its size is bounded by what a model can read. The rows of different conversations spread evenly.

Null texts are empty. A row with a null conversation id is a conversation of its own, as nothing says what it belongs to. Repeated
rows are turns like any other. An empty table gives an empty result. A null role is the empty role; roles that the template does not know are written with the
``other`` marks and their name. A conversation whose turns break the order is formatted all the same and marked invalid.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role; ``other`` opens, then follow the role's name, ``other_named``, the text and ``other``'s end."""

    begin: str = "<s>"
    end: str = "</s>"
    roles: dict = field(default_factory=lambda: {
        "system": Marks("[SYS]", "[/SYS]"), "user": Marks("[INST]", "[/INST]"), "assistant": Marks("[REPLY]", "[/REPLY]", True),
    })
    other: Marks = Marks("[ROLE]", "[/ROLE]")
    other_named: str = "[SAYS]"

    def controls(self) -> list[str]:
        out = [self.begin, self.end, self.other.open, self.other.close, self.other_named]
        for m in self.roles.values():
            out += [m.open, m.close]
        return out


@dataclass(frozen=True)
class Order:
    """Finite-state machine: a state is the last role ("" at the start); ``final`` are states a conversation may end in."""

    moves: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple = ("assistant",)

    def check(self, roles: list[str]) -> tuple[bool, int | None]:
        """Whether the roles are in order, and the number of the first turn that is not (the length, if the end is missing)."""
        state = ""
        for k, role in enumerate(roles):
            if role not in self.moves.get(state, ()):
                return False, k
            state = role
        return (True, None) if state in self.final else (False, len(roles))


class Formatter:
    def __init__(self, template: Template = Template()):
        self.template = template
        heads = {c: (re.escape(c[0]), re.escape(c[1:])) for c in template.controls()}
        #: A control string with any number of backslashes behind its first character.
        self._any = re.compile("|".join(f"{a}\\\\*{b}" for a, b in heads.values()))
        self._plain = re.compile("|".join(sorted(map(re.escape, heads), key=len, reverse=True)))

    def escape(self, text: str) -> str:
        """One backslash more behind the first character of each control string, so none is left as it was."""
        return self._any.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._any.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """Pieces of output with their loss flags; their concatenation is the formatted conversation."""
        t = self.template
        out = [(t.begin, False)]
        for role, text in turns:
            marks = t.roles.get(role)
            if marks is None:
                out += [(t.other.open + self.escape(role) + t.other_named, False), (self.escape(text), False), (t.other.close, False)]
            else:
                out += [(marks.open, False), (self.escape(text), marks.loss), (marks.close, False)]
        return [*out, (t.end, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        t = self.template
        opens = {m.open: r for r, m in t.roles.items()}
        found = [(m.start(), m.end(), m[0]) for m in self._plain.finditer(formatted)]
        out, k = [], 1
        while k < len(found) - 1:
            if found[k][2] in opens:
                out.append((opens[found[k][2]], self.unescape(formatted[found[k][1] : found[k + 1][0]])))
                k += 2
            else:
                role, text = (self.unescape(formatted[found[k + i][1] : found[k + i + 1][0]]) for i in (0, 1))
                out.append((role, text))
                k += 3
        return out


OUT = "conv_id {id}, formatted string, segments array<struct<start:int,end:int,loss:boolean>>, valid boolean, bad_turn int"


def format_chats(conversations: DataFrame, template: Template = Template(), order: Order = Order(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: formatted text, its segments in code points with loss flags, and the order's verdict."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("row"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    chats = rows.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    chats = chats.select("conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))

    def run(batches):
        make = Formatter(template)
        for b in batches:
            texts, segs, valid, bad = [], [], [], []
            for rs, ts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = make.segments(list(zip(rs, ts)))
                at, seg = 0, []
                for s, loss in parts:
                    seg.append({"start": at, "end": at + len(s), "loss": loss})
                    at += len(s)
                texts.append("".join(s for s, _ in parts))
                segs.append(seg)
                ok, where = order.check(rs)
                valid.append(ok)
                bad.append(where)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(segs, kind), pa.array(valid, pa.bool_()), pa.array(bad, pa.int32())], ["conv_id", "formatted", "segments", "valid", "bad_turn"])

    return chats.mapInArrow(run, OUT.format(id=chats.schema["conv_id"].dataType.simpleString()))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted text and its loss mask hold."""

    def run(batches):
        make = Formatter(template)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "bad_turn"]
        for b in batches:
            rows = []
            for text, segs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = make.read(text)
                loss = "".join(make.unescape(text[s["start"] : s["end"]]) for s in segs if s["loss"])
                all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)], b.column(3), b.column(4)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn int")


#: The conversation that the contract adds.
PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_chats(chats.unionByName(probe)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE 1 END AS odd,
 regexp_replace(text, '(<)(\\*(?:/?s>))|(\[)(\\*(?:/?(?:SYS|INST|REPLY|ROLE)\]|SAYS\]))', '\1\3\\\2\4', 'g') AS esc,
 lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM c),
v AS (SELECT *, CASE WHEN (prev = '' AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user') THEN NULL ELSE k END AS wrong,
 length(esc) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 15 ELSE 19 + length(role) END AS chars FROM e),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) + 7 AS formatted_chars, min(wrong) AS wrong, last(role ORDER BY turn) AS final FROM v GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
 wrong IS NULL AND final = 'assistant' AS valid, CAST(coalesce(wrong, CASE WHEN final <> 'assistant' THEN n_turns END) AS INT) AS bad_turn FROM a
"""
