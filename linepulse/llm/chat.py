r"""Operator 6: chat formatting by a finite-state machine over roles.

``TEMPLATE`` declares the marks before and after a turn of each role, the roles whose text is trained on, and which
role may follow which.  Rows of a conversation are walked in order of (turn, role, text), nulls first.  Each turn
becomes segments (text, loss): its opening mark, its text and its closing mark; only the text of a trained role
carries the loss flag.  A turn that the machine does not allow is flagged (``allowed`` false) and formatted all the
same; the machine goes on from that turn's role.  A conversation is ``valid`` if all turns are allowed and it ends
in a final role.

Escaping: a control string inside a text gets one backslash more behind its first character ("</s>" becomes "<\/s>",
"<\/s>" becomes "<\\/s>"), so no text holds a mark and unescaping takes one backslash away.

The rows are dealt by conversation and sorted by Spark, which spills; a task then walks them as a stream and keeps one
turn and one running digest, so a conversation of any length needs no more memory.  (Its digest is sequential: a
conversation is read by one task.)

Rows: null text and null role are empty; repeated rows are turns of their own; a null conv_id is one conversation; an empty table
gives no rows; a role without marks of its own is marked with its percent-encoded name; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.llm.common import in_pandas, written

TEMPLATE = {
    "begin": "<s>",                                    # before the first turn
    "turns": {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": (" ", " </s>"),
    },
    "other": ("<<TURN {role}>>", "<</TURN>>"),         # any other role, by its percent-encoded name
    "loss": ("assistant",),
    "next": {                                          # the machine: state (last role; None: start) -> roles allowed
        None: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    "final": ("assistant",),
}
# control strings: first character, rest
CONTROL = r"([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|<TURN|</TURN>>)"
_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))

FORMATTED = "conv_id long, pos long, allowed boolean, last boolean, valid boolean, segments array<struct<text:string,loss:boolean>>"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "valid boolean, n_bad_turns long")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def turn_segments(template: dict, role: str, text: str, first: bool) -> list[dict]:
    """Segments of one turn."""
    opening, closing = template["turns"].get(role) or (template["other"][0].format(role=quote(role, safe="")), template["other"][1])
    return [{"text": (template["begin"] if first else "") + opening, "loss": False},
            {"text": escape(text), "loss": role in template["loss"]},
            {"text": closing, "loss": False}]


def read_turn(template: dict, segments, first: bool) -> tuple[str, str, str]:
    """role, text and the text under the loss mask, from the segments of one turn."""
    formatted = "".join([s["text"] for s in segments])
    masked = unescape("".join([s["text"] for s in segments if s["loss"]]))
    if first:
        if not formatted.startswith(template["begin"]):
            raise ValueError("a conversation begins without its mark")
        formatted = formatted[len(template["begin"]):]
    lead, tail = template["other"]
    head, mark = lead.split("{role}")
    if formatted.startswith(head) and formatted.endswith(tail):
        role, text = formatted[len(head):-len(tail)].split(mark, 1)
        return unquote(role), unescape(text), masked
    for role, (opening, closing) in sorted(template["turns"].items(), key=lambda x: -len(x[1][0])):
        if formatted.startswith(opening) and formatted.endswith(closing) and len(formatted) >= len(opening) + len(closing):
            return role, unescape(formatted[len(opening):len(formatted) - len(closing)]), masked
    raise ValueError("a turn without marks")


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])


def format_conversations(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per turn: conv_id, pos (0, 1, ...), allowed, last, valid (of the turns up to it), segments."""
    def run(batches):
        import pandas as pd
        state, conv, pos, good, held = None, object(), 0, True, None

        def as_frame(rows):
            return pd.DataFrame(rows, columns=["conv_id", "pos", "allowed", "last", "valid", "segments"]).astype({"conv_id": "Int64"})

        for pdf in batches:
            rows = []
            for c, role, text in zip(pdf["conv_id"].astype(object), pdf["role"], pdf["text"]):
                c = None if pd.isna(c) else int(c)
                if held is not None:
                    rows.append((*held[:3], c != conv, held[4] and state in template["final"], held[5]))
                if c != conv:
                    state, conv, pos, good = None, c, 0, True
                allowed = role in template["next"].get(state, ())
                good = good and allowed
                held = (c, pos, allowed, False, good, turn_segments(template, role, text, pos == 0))
                state, pos = role, pos + 1
            if rows:
                yield as_frame(rows)
        if held is not None:
            yield as_frame([(*held[:3], True, held[4] and state in template["final"], held[5])])

    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                               F.coalesce("text", F.lit("")).alias("text"))
    return in_pandas(_dealt(src, "turn", "role", "text").select("conv_id", "role", "text"), run, FORMATTED)


def read_formatted(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The contract's columns per conversation, read back from formatted turns."""
    def run(batches):
        import pandas as pd
        conv, started, n = None, False, None

        def begin():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0, "bad": 0, "valid": False}

        def row():
            return (conv, n["n"], n["turns"].hexdigest(), n["loss_n"], n["loss"].hexdigest(), n["chars"], n["valid"], n["bad"])

        def as_frame(rows):
            return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

        for pdf in batches:
            rows = []
            for c, pos, allowed, valid, segments in zip(pdf["conv_id"].astype(object), pdf["pos"], pdf["allowed"], pdf["valid"], pdf["segments"]):
                c = None if pd.isna(c) else int(c)
                if not started or c != conv:
                    if started:
                        rows.append(row())
                    conv, started, n = c, True, begin()
                role, text, masked = read_turn(template, segments, pos == 0)
                n["n"] += 1
                n["turns"].update(f"{role}\n{text}\n".encode())
                n["loss"].update(masked.encode())
                n["loss_n"] += len(masked)
                n["chars"] += sum(len(s["text"]) for s in segments)
                n["bad"] += not allowed
                n["valid"] = bool(valid)
            if rows:
                yield as_frame(rows)
        if started:
            yield as_frame([row()])

    return in_pandas(_dealt(formatted, "pos"), run, DIGESTS)


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write, read back."""
    return read_formatted(written(format_conversations(conversations), "chat"))


# the same in DuckDB's SQL
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, lag(role) OVER o AS prev, row_number() OVER o AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
         regexp_replace(text, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|<TURN|</TURN>>)', '\1\2\\\3', 'g') AS escaped
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), m AS (
  SELECT *, CASE WHEN rn = 1 THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant'
                 WHEN prev = 'assistant' THEN role = 'user' ELSE false END AS allowed,
         CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 18 + length(url_encode(role)) END AS marks
  FROM w
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(marks + length(escaped)))::BIGINT AS formatted_chars,
       bool_and(allowed) AND bool_or(rn = n AND role = 'assistant') AS valid,
       (count(*) FILTER (NOT allowed))::BIGINT AS n_bad_turns
FROM m GROUP BY conv_id
"""
