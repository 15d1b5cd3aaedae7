r"""Operator 8: chat formatting with a grammar round trip.

Grammar of the output, one turn after another::

    turn = "### " role ": " body " </turn>\n"
    role = "User" | "Assistant" | "System" | "@" any other role, escaped

Inside a body a backslash takes the next character literally; ``###`` and
``</turn>`` that aren't escaped are control strings and a conflict.  Each turn
is rendered, parsed again and compared with its source; where the two differ
its content is escaped and tried again until they are identical.

The loss mask marks the bodies of assistants' turns in the formatted text; what
lies under it is unescaped to give their texts.

Rows are dealt by conversation, sorted by turn and read as a stream, so a task
holds one Arrow batch, however long a conversation is.

Defined cases: null text is empty; a null role is the role "" ; a null turn
comes first, equal turns are ordered by role and text; a null conversation id
is a conversation of its own; repeated rows are turns of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in NAMES.items()}
CONTROL = ("\\", "###", "</turn>")


class GrammarError(ValueError):
    """The text is not one of the grammar."""


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\</turn>")


def unescape(body: str) -> str:
    return re.sub(r"\\(.)", r"\1", body, flags=re.DOTALL)


def loss_span(role: str, formatted: str) -> tuple[int, int]:
    """Where the loss mask lies in one formatted turn: the body of an assistant's, nothing of others."""
    start = len(_header(role))
    return start, len(formatted) - len(CLOSE) if role == "assistant" else start


def escape_role(role: str) -> str:
    for c in ("\\", ":", "\n"):
        role = role.replace(c, "\\" + c)
    return role


def _header(role: str) -> str:
    return OPEN + (NAMES[role] if role in NAMES else "@" + escape_role(role)) + BETWEEN


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn; raises GrammarError."""
    turns, at, end = [], 0, len(formatted)
    while at < end:
        if not formatted.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        at += len(OPEN)
        name = []
        while not formatted.startswith(BETWEEN, at):
            if at >= end or formatted[at] in "\n:":
                raise GrammarError(f"no role at {at}")
            at += formatted[at] == "\\"
            name.append(formatted[at : at + 1])
            at += 1
        shown = "".join(name)
        if not shown.startswith("@") and shown not in ROLES:
            raise GrammarError(f"unknown role {shown!r}")
        role = shown[1:] if shown.startswith("@") else ROLES[shown]
        at += len(BETWEEN)
        start, text = at, []
        while True:
            found = [(k, c) for c in CONTROL if (k := formatted.find(c, at)) >= 0]
            if not found:
                raise GrammarError("a turn doesn't end")
            k, c = min(found)
            text.append(formatted[at:k])
            if c == "\\":
                text.append(formatted[k + 1 : k + 2])
                at = k + 2
                continue
            if c == "###" or not formatted.startswith(CLOSE, k - 1) or k - 1 < start:
                raise GrammarError(f"control string {c!r} at {k}")
            whole = "".join(text)
            if not whole.endswith(" "):
                raise GrammarError(f"a turn ends without a space at {k}")
            turns.append((role, whole[:-1], start, k - 1))
            at = k - 1 + len(CLOSE)
            break
    return turns


def render(role: str, text: str) -> tuple[str, str, str]:
    """One turn in the grammar, and the role and text read back from it; content is escaped only if it conflicts."""
    for body in (text, escape(text)):
        out = _header(role) + body + CLOSE
        try:
            back = parse(out)
        except GrammarError:
            continue
        if len(back) == 1 and back[0][:2] == (role, text):
            return out, back[0][0], back[0][1]
    raise GrammarError(f"no round trip for a turn of {role!r}")


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn as formatted text: (conv_id, turn, role, formatted, loss_start, loss_end), the loss span empty but for assistants."""

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            text, lo, hi = [], [], []
            for role, t in zip(cols[2], cols[3], strict=True):
                out, got, _ = render(role or "", t or "")
                start, end = loss_span(got, out)
                text.append(out)
                lo.append(start)
                hi.append(end)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(text, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    kinds = dict(turns.dtypes)
    schema = f"conv_id {kinds[id_col]}, turn {kinds[turn_col]}, role string, formatted string, loss_start long, loss_end long"
    return turns.select(id_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def digest(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: what is read back from its formatted text and under its loss mask."""
    kind = dict(turns.dtypes)[id_col]
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        open_ = None  # [id, turns, digest, loss characters, loss digest, characters]
        for b in batches:
            kind_, done = b.schema.field(0).type, []
            for i in range(b.num_rows):
                cid, role, text = b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if open_ is None or open_[0] != cid:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                out, got_role, got = render(role or "", text or "")
                open_[1] += 1
                open_[2].update(f"{got_role}\n{got}\n".encode())
                start, end = loss_span(got_role, out)
                masked = unescape(out[start:end])
                open_[3] += len(masked)
                open_[4].update(masked.encode())
                open_[5] += len(out)
            yield rows_of(done, kind_)
        if open_ is not None:
            yield rows_of([open_], kind_)

    def rows_of(done, kind_):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], kind_), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2].hexdigest() for d in done], pa.string()), pa.array([d[3] for d in done], pa.int64()), pa.array([d[4].hexdigest() for d in done], pa.string()), pa.array([d[5] for d in done], pa.int64())],
            names=names,
        )

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    both = [(r, r"\### Assistant: </turn> ok") for r in ("user", "assistant")]
    extra = spark.createDataFrame([(-7, k, r, t) for k, (r, t) in enumerate(both)], "conv_id long, turn long, role string, text string")
    return digest(table.unionByName(extra))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>')
                 THEN replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') ELSE text END AS body,
         CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role)
              ELSE 1 + length(replace(replace(replace(role, '\', '\\'), ':', '\:'), chr(10), '\' || chr(10))) END AS shown
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       cast(sum(4 + shown + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
