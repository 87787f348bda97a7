"""Chat formatting at token level: segments encoded apart, reserved ids between them, masks by prefix sums."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: A byte-level vocabulary, so that decoding gives back the very text. A parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Control strings, in the order of their reserved ids, which follow the vocabulary's: a turn, its text, its end.
TURN, BODY, CLOSE = "### ", ": ", "\n</turn>\n"
#: What is escaped inside texts and roles: the marks by which a reader of plain text knows the control strings.
MARKS = r"###|</turn>"
_ESCAPE = re.compile(rf"(\\*)({MARKS})")
_UNESCAPE = re.compile(rf"\\(\\*)({MARKS})")
LEARNED = "assistant"


def escape(text: str) -> str:
    """One more backslash before each mark, and before any backslashes that stand there."""
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """As escape, and without a colon, so that the string that starts a text can't stand in a role."""
    return escape(role.replace("\\", r"\\").replace(":", r"\c"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: ":" if m[1] == "c" else m[1], unescape(role), flags=re.S)


class Codec:
    """A tokenizer with three reserved ids after its own."""

    _known: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.first = self.own.get_vocab_size(with_added_tokens=True)
        self.shown = dict(zip(range(self.first, self.first + 3), (TURN, BODY, CLOSE)))

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids, skip_special_tokens=False) if ids else ""

    def render(self, ids: list[int]) -> str:
        """The formatted text: control strings for reserved ids, what is between them decoded."""
        out, held = [], []
        for i in ids:
            if i >= self.first:
                out += [self.decode(held), self.shown[i]]
                held = []
            else:
                held.append(i)
        return "".join([*out, self.decode(held)])


def assemble(codec: Codec, turns: list[tuple[str, str]]) -> list[tuple[list[int], list[int]]]:
    """(ids, loss mask) of each turn: reserved turn id, role, reserved body id, text, reserved end id.

    The mask is the prefix sum of +1 where a segment to be learned starts and -1 where it ends.
    """
    roles, texts = codec.encode([escape_role(r) for r, _ in turns]), codec.encode([escape(t) for _, t in turns])
    out = []
    for (role, _), r, t in zip(turns, roles, texts):
        ids = [codec.first, *r, codec.first + 1, *t, codec.first + 2]
        edge = np.zeros(len(ids) + 1, np.int8)
        if role == LEARNED:
            edge[len(r) + 2] += 1
            edge[len(r) + 2 + len(t)] -= 1
        out.append((ids, np.cumsum(edge, dtype=np.int8)[:-1].tolist()))
    return out


def read_turn(codec: Codec, ids: list[int], mask: list[int]) -> tuple[str, str, str | None]:
    """(role, text, text under the mask) of an assembled turn; None if the mask is empty."""
    body, end = ids.index(codec.first + 1), len(ids) - 1
    role, text = unescape_role(codec.decode(ids[1:body])), unescape(codec.decode(ids[body + 1 : end]))
    learned = [i for i, m in zip(ids, mask) if m]
    return role, text, unescape(codec.decode(learned)) if learned else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted plain text; texts can't hold a bare mark nor roles a colon, so this is exact."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(BODY)
        turns.append((unescape_role(role), unescape(text)))
    return turns


def format_turns(rows: DataFrame, tokenizer: str = TOKENIZER, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv_id, turn, ids, mask for each row of rows (conv_id, turn, role, text). A conversation is its rows in order of turn.

    Null roles and texts are empty; a role other than `assistant` isn't learned. Texts are encoded whole. Repeated
    rows are turns of their own; other columns aren't read; no rows in, no rows out.
    """
    short_batches(rows.sparkSession)
    kinds = [rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]

    def run(batches):
        codec = Codec.of(tokenizer)
        for b in batches:
            turns = [(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            made = assemble(codec, turns) if turns else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int8()))], ["conv", "turn", "ids", "mask"])

    got = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "role", "text").mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, ids array<int>, mask array<tinyint>")
    return got.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation, read from ids and masks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come in order of turn (null first), equal ones in order of their ids. Digests are fed turn by turn, so a
    task holds a batch of turns, not a conversation, however long it is. A null conversation id is
    a conversation.
    """
    short_batches(formatted.sparkSession)
    kind = formatted.schema[conv_col].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        codec = Codec.of(tokenizer)
        now = None  # [conversation, turns, digest, loss chars, loss digest, formatted chars]

        def done(rows, conv):
            columns = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows])) or [()] * 6
            types = (conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        conv = None
        for b in batches:
            conv, ended = b.schema.field(0).type, []
            for c, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if now is None or now[0] != c:
                    if now:
                        ended.append(now)
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned = read_turn(codec, ids, mask)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if learned is not None:
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(codec.render(ids))
            yield done(ended, conv)
        if now:
            yield done([now], conv)

    ordered = formatted.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, "ids").select(F.col(conv_col).alias("conv"), "ids", "mask")
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


#: What the query over `conversations` and the contract's own conversation must give; lengths of the control strings are 4, 2 and 9.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') AS escaped, regexp_replace(replace(replace(role, '\', '\\'), ':', '\c'), '(\\*)(###|</turn>)', '\\\1\2', 'g') AS shown FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(shown) + 2 + length(escaped) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
