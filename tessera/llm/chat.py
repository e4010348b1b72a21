"""Chat formatting: layouts are told by schema fingerprints, turns are marked and escaped reversibly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import prepare

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """How a record of some layout becomes turns.

    Either ``turns`` is the path of an array whose items have a ``role`` and a ``text`` field, or ``pairs``
    lists ``(role, path)`` with fixed roles, or ``role`` and ``text`` are paths of the record itself.
    ``optional`` paths may be null or missing.
    """

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.turns:
            return [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [p for _, p in self.pairs] or [self.role, self.text]

    def fingerprints(self) -> list[str]:
        need = [p for p in self.paths() if p not in self.optional]
        some = [p for p in self.paths() if p in self.optional]
        subsets = chain.from_iterable(combinations(some, n) for n in range(len(some) + 1))
        return [fingerprint([*need, *more]) for more in subsets]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_SPEAKERS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
LAYOUTS = (
    Layout("turn", role="role", text="text", optional=("role", "text")),
    Layout("messages", turns="messages", role="role", text="content", optional=("messages[].content",), roles=_SPEAKERS),
    Layout("conversations", turns="conversations", role="from", text="value", optional=("conversations[].value",), roles=_SPEAKERS),
    Layout("instruction", pairs=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt", pairs=(("user", "prompt"), ("assistant", "completion")), optional=("completion",)),
    Layout("prompt_response", pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", pairs=(("user", "question"), ("assistant", "answer"))),
)


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of a schema's leaves, ``[]`` marking an array of structs."""
    out = []
    for f in schema.fields:
        kind, at = f.dataType, prefix + f.name
        if isinstance(kind, T.StructType):
            out += _leaves(kind, at + ".")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [f"{at}[].{g.name}" for g in kind.elementType.fields]
        else:
            out.append(at)
    return out


def _quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _present(path: str) -> Column:
    if "[]." in path:
        array, item = path.split("[].")
        return F.coalesce(F.exists(_quoted(array), lambda x: x.getField(item).isNotNull()), F.lit(False))
    return _quoted(path).isNotNull()


def schema_fingerprint(paths: list[str]) -> Column:
    """The hash of those of these field paths that hold a value in a row, in order."""
    return F.sha2(F.concat_ws("\n", *[F.when(_present(p), F.lit(p)) for p in sorted(paths)]), 256)


def canonical_turns(records: DataFrame, id_col: str, order_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS, fields: list[str] | None = None) -> DataFrame:
    """``(conv_id, turn, part, role, text, layout)``: records of mixed layouts as turns.

    A record's fingerprint, of the field paths that hold a value, picks the first layout that declares it. Only
    paths that some layout names count, so further columns and fields of any name change nothing; ``fields``
    limits the columns that are looked at (all but the id and the order by default). A record without a value in
    any such path is of the table's only layout, if all its paths are optional. ``turn`` is the order column,
    ``part`` the place within a record. Null texts become empty, except those of optional fields, which make
    no turn. A record of no known layout gives one row with a null layout, role and text, so that none is lost unseen.
    """
    names = fields or [c for c in records.columns if c not in (id_col, order_col)]
    schema = T.StructType([records.schema[c] for c in names])
    declared = {p for layout in layouts for p in layout.paths()}
    have = set(_leaves(schema)) & declared
    turn = "array<struct<role:string,text:string>>"
    print_ = schema_fingerprint(sorted(have))
    choice, name = F.lit(None).cast(turn), F.lit(None).cast("string")
    usable = [a for a in layouts if all(p in have or p in a.optional for p in a.paths()) and any(p in have for p in a.paths())]
    for layout in reversed(usable):
        here = print_.isin([x for x in layout.fingerprints() if len(usable) == 1 or x != fingerprint([])])
        turns = F.coalesce(_turns(layout, have), F.array().cast(turn))
        choice, name = F.when(here, turns).otherwise(choice), F.when(here, layout.name).otherwise(name)
    out = records.select(F.col(f"`{id_col}`").alias("conv_id"), (F.col(f"`{order_col}`") if order_col else F.lit(0)).alias("turn"), name.alias("layout"), F.posexplode_outer(choice).alias("part", "t"))
    return out.where("layout is null or t is not null").select("conv_id", "turn", "part", "t.role", "t.text", "layout")


def _role(layout: Layout, role: Column) -> Column:
    for old, new in layout.roles.items():
        role = F.when(role == old, new).otherwise(role)
    return F.coalesce(role, F.lit("")).alias("role")


def _turns(layout: Layout, have: set[str]) -> Column:
    """An array of ``(role, text)``."""
    empty = F.lit("")
    if layout.turns:
        role = lambda x: x.getField(layout.role)
        text = (lambda x: x.getField(layout.text).cast("string")) if f"{layout.turns}[].{layout.text}" in have else (lambda x: empty)
        return F.transform(_quoted(layout.turns), lambda x: F.struct(_role(layout, role(x)), F.coalesce(text(x), empty).alias("text")))
    if layout.pairs:
        found = [F.when(_quoted(p).isNotNull(), F.struct(F.lit(r).alias("role"), _quoted(p).cast("string").alias("text"))) for r, p in layout.pairs if p in have]
        return F.filter(F.array(*found), lambda x: x.isNotNull())
    of = lambda p: _quoted(p).cast("string") if p in have else F.lit(None).cast("string")
    return F.array(F.struct(_role(layout, of(layout.role)), F.coalesce(of(layout.text), empty).alias("text")))


def escape(text: Column) -> Column:
    """Puts a backslash into every ``<|`` and one more into every ``<\\|``, so that no text holds a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted``, a turn under the template, and ``loss_start`` and ``loss_length`` within it.

    A conversation's text is its turns' texts in a row. The loss covers the texts of the assistant's turns,
    without the marks around them; it is null for others. Turns are formatted where they are; nothing is shuffled.
    """
    role, text = _escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    said = F.col("role") == "assistant"
    out = turns.withColumn("formatted", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n")))
    start = F.length(role) + len(START) + 1
    return out.withColumns({"loss_start": F.when(said, start), "loss_length": F.when(said, F.length("formatted") - start - len(END) - 1)})


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted turns.

    Sorts turns within partitions by conversation, order, place, role and text, and parses them one after
    the other with running digests: a conversation of any length needs the memory of one turn. Null ids
    are one conversation; repeated turns count each. An empty table gives no row.
    """
    prepare(formatted.sparkSession)
    kind, id_type = formatted.schema["conv_id"].dataType.simpleString(), to_arrow_type(formatted.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, piece, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _TURN.findall(piece):
                    now[1] += 1
                    now[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                if start is not None:
                    said = unescape(piece[start : start + length])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(piece)
            if len(done) >= 1000:
                yield _rows(done)
                done = []
        done += [now] if now else []
        if done:
            yield _rows(done)

    def _rows(found: list) -> pa.RecordBatch:
        cols = list(zip(*[(c, n, t.hexdigest(), k, s.hexdigest(), f) for c, n, t, k, s, f in found], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "part", "role", "text")]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "loss_start", "loss_length")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """``(conv_id, text)``: each conversation's turns in a row."""
    items = F.array_sort(F.collect_list(F.struct("turn", "part", "role", "text", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(items, lambda x: x.formatted), "").alias("text"))
