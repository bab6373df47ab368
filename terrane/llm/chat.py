"""Chat formatting by schema fingerprints.

Records of many layouts sit in one DataFrame whose columns are the union of their fields. The paths
of the fields that a record fills are hashed to a fingerprint, which selects a declarative mapping
to canonical turns. Turns are then written with a template whose control strings cannot occur in a text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, BODY, CLOSE = "[INST]", "[/INST]", "</s>"
#: Bracketed control strings with any number of guards after the bracket; escaping adds a guard, unescaping takes one.
_CONTROL = r"(?:/?INST|/?SYS|/?s)"
_TO_GUARD = rf"([\[<])(\\*{_CONTROL}[\]>])"
_GUARDED = rf"([\[<])\\(\\*{_CONTROL}[\]>])"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Fields:
    """A layout with one column per turn: (role, field path) pairs in order; optional paths may be unfilled."""

    name: str
    turns: Sequence[tuple[str, str]]
    optional: Sequence[str] = ()

    def shapes(self) -> list[tuple[str, ...]]:
        needed = [p for _, p in self.turns if p not in self.optional]
        return [tuple(sorted([*needed, *more])) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]

    def canonical(self) -> Column:
        made = [
            F.when(F.col(p).isNotNull() | F.lit(p not in self.optional), F.struct(F.lit(r).alias("role"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("text")))
            for r, p in self.turns
        ]
        return F.filter(F.array(*made), lambda t: t.isNotNull())


@dataclass(frozen=True)
class Messages:
    """A layout with an array of messages; ``roles`` renames roles, others stay as they are."""

    name: str
    column: str
    role: str = "role"
    text: str = "content"
    roles: Mapping[str, str] = field(default_factory=dict)

    def shapes(self) -> list[tuple[str, ...]]:
        base = f"{self.column}[]"
        return [tuple(sorted([base, *more])) for more in ([f"{base}.{self.role}", f"{base}.{self.text}"], [f"{base}.{self.role}"], [f"{base}.{self.text}"], [])]

    def canonical(self) -> Column:
        def turn(m: Column) -> Column:
            role = F.coalesce(m[self.role], F.lit(""))
            for theirs, ours in self.roles.items():
                role = F.when(m[self.role] == theirs, F.lit(ours)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))

        return F.transform(F.col(self.column), turn)


LAYOUTS = (
    Messages("messages", "messages"),
    Messages("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Fields("prompt", [("system", "system"), ("user", "prompt"), ("assistant", "response")], ["system"]),
    Fields("instruction", [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")], ["system", "input"]),
)


def _has(name: str) -> Callable[[Column], Column]:
    return lambda m: m[name].isNotNull()


def _filled(kind: T.DataType, value: Column, path: str) -> list[Column]:
    """For each field path below ``value``: the path where the record fills it, else null."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _filled(f.dataType, value[f.name], f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        own = [F.when(value.isNotNull(), F.lit(f"{path}[]"))]
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            own += [F.when(F.exists(value, _has(f.name)), F.lit(f"{path}[].{f.name}")) for f in inner.fields]
        return own
    return [F.when(value.isNotNull(), F.lit(path))]


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """Hash of the sorted paths of the fields that a record fills."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    paths = [x for c in columns if c in kinds for x in _filled(kinds[c], F.col(f"`{c}`"), c)]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*paths))), ","))


def _columns_of(layout: Fields | Messages) -> list[str]:
    return [layout.column] if isinstance(layout, Messages) else [p.split(".")[0] for _, p in layout.turns]


def canonical_turns(df: DataFrame, layouts: Sequence[Fields | Messages] = LAYOUTS) -> DataFrame:
    """Add ``layout`` (its name, null if the fingerprint is of none) and ``turns`` (array of role and text).

    Null texts and roles become empty. A record of unknown layout, or with nothing filled, gets no turns.
    Columns that no layout names take no part, whatever they hold; columns of these two names are replaced.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("layout", "turns")])
    usable = [x for x in layouts if all(c in df.columns for c in _columns_of(x) if not (isinstance(x, Fields) and c in x.optional))]
    for c in {c for x in usable for c in _columns_of(x)} - set(df.columns):
        df = df.withColumn(c, F.lit(None).cast("string"))
    known = sorted({c for x in usable for c in _columns_of(x)})
    df = df.withColumn("__shape", fingerprint(df, known) if known else F.lit(None).cast("long"))
    layout, turns = F.lit(None).cast("string"), F.array().cast(f"array<{TURN}>")
    for x in reversed(usable):
        is_it = F.col("__shape").isin([]) if not x.shapes() else F.lit(False)
        for shape in x.shapes():
            is_it = is_it | (F.col("__shape") == F.xxhash64(F.lit(",".join(shape))))
        layout = F.when(is_it, F.lit(x.name)).otherwise(layout)
        turns = F.when(is_it, x.canonical().cast(f"array<{TURN}>")).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns}).drop("__shape")


def escaped(text: Column) -> Column:
    """A text in which no control string is left; ``unescaped`` gives it back exactly."""
    return F.regexp_replace(text, _TO_GUARD, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _GUARDED, "$1$2")


def format_turns(df: DataFrame, turns: str = "turns", trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``segments``: the same text cut into (text, loss) pieces, loss on texts of trained roles.

    A turn is ``[INST]role[/INST]text</s>``. No turns (or null) give an empty text without segments. The
    segments in order are the formatted text, so the loss mask holds for its code points one by one.
    """

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(BODY)), F.lit(False)),
            piece(escaped(t["text"]), F.coalesce(t["role"].isin(*trained), F.lit(False))),
            piece(F.lit(CLOSE), F.lit(False)),
        )

    rows = F.coalesce(F.col(turns), F.array().cast(f"array<{TURN}>"))
    made = df.withColumn("segments", F.flatten(F.transform(rows, pieces)))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The canonical turns of a formatted text."""
    cut = F.split(formatted, "</s>")
    whole = F.slice(cut, 1, F.size(cut) - 1)

    def turn(t: Column) -> Column:
        body = F.locate(BODY, t)
        role = F.substring(t, len(OPEN) + 1, body - len(OPEN) - 1)
        return F.struct(
            unescaped(role).alias("role"), unescaped(F.substring(t, body + len(BODY), F.length(t))).alias("text")
        )

    return F.transform(whole, turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
