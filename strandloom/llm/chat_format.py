"""Chat formatting in budgeted, turn-aligned windows.

Prefix sums of turn tokens split conversations into chunks, so that none, however
long, has to be in one task, and inside a chunk they decide where a window ends. A window repeats the conversation's first system
turn and up to `history_turns` turns before it; only text of assistant turns that are
new in a window is under its loss mask, so each is learned once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running
from .common import settle

#: What opens and closes a turn of each role; other roles carry their name.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAME_END, OTHER_END = "[TURN]", "[/NAME]", "[/TURN]"
_CONTROL = r"(?:/?s>|<SYS>>|</SYS>>|/?INST\]|/?TURN\]|/?NAME\])"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})"), re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[TURN\](?P<name>.*?)\[/NAME\](?P<other>.*?)\[/TURN\]", re.S)

WINDOW_SCHEMA = "conv_id long, chunk long, window int, n_repeated int, n_new int, tokens long, over_budget boolean, formatted string, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    """A backslash after the first character of whatever reads as a control string."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text stands in it."""
    start, end = MARKS.get(role) or (f"{OTHER}{escape(role)}{NAME_END}", OTHER_END)
    body = escape(text)
    return f"{start}{body}{end}", len(start), len(start) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted window at {at}")
        role = m.lastgroup
        out.append((unescape(m["name"]), unescape(m["other"])) if role == "other" else (role, unescape(m[role])))
        at = m.end()
    return out


def count_tokens(text: Column) -> Column:
    """Words and single symbols; the default measure of a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int


class _Chunk:
    """Windows of one chunk, one turn at a time; holds a window and the history alone."""

    def __init__(self, key, budget: int, history_turns: int, history_tokens: int):
        self.key, self.budget, self.history_tokens = key, budget, history_tokens
        self.recent: deque[_Turn] = deque(maxlen=history_turns)
        self.system: _Turn | None = None
        self.first_system: _Turn | None = None  # of this chunk, repeated from the next window on
        self.new: list[_Turn] = []
        self.repeated: list[_Turn] = []
        self.total = self.n = 0

    def _open(self, turn: _Turn) -> None:
        fixed = self.system.tokens if self.system else 0
        kept: list[_Turn] = []
        used = 0
        for t in reversed(self.recent):
            used += t.tokens
            if used > self.history_tokens or fixed + used + turn.tokens > self.budget:
                break
            if t is not self.system:
                kept.insert(0, t)
        self.repeated = ([self.system] if self.system else []) + kept
        self.total = sum(t.tokens for t in self.repeated)

    def add(self, turn: _Turn) -> list[tuple]:
        done = self.close() if self.new and self.total + turn.tokens > self.budget else []
        if not self.new:
            self._open(turn)
        self.new.append(turn)
        self.total += turn.tokens
        if turn.role == "system" and self.first_system is None:
            self.first_system = turn
        return done

    def close(self) -> list[tuple]:
        if not self.new:
            return []
        text, starts, ends, size = [], [], [], 0
        for i, t in enumerate([*self.repeated, *self.new]):
            s, a, b = render(t.role, t.text)
            if t.role == "assistant" and i >= len(self.repeated):
                starts.append(size + a)
                ends.append(size + b)
            text.append(s)
            size += len(s)
        row = (*self.key, self.n, len(self.repeated), len(self.new), self.total, self.total > self.budget, "".join(text), starts, ends)
        self.recent.extend(self.new)
        self.system = self.system or self.first_system
        self.new, self.n = [], self.n + 1
        return [row]


def _chunks(rows: DataFrame, chunk_tokens: int, history_turns: int) -> DataFrame:
    """(conv_id, turn, chunk, next_chunk): the chunk of each turn number, by the tokens before it in its conversation; the chunk after it, if that repeats it."""
    numbers = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    run = settle(running(numbers, [F.col("conv_id"), F.col("turn")], {"turns_": F.col("n"), "tokens_": F.col("t")}))
    start = run.groupBy("conv_id").agg(F.min(F.col("turns_") - F.col("n")).alias("turns0"), F.min(F.col("tokens_") - F.col("t")).alias("tokens0"))
    placed = run.join(start.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "turn", F.floor((F.col("tokens_") - F.col("t") - F.col("tokens0")) / chunk_tokens).alias("chunk"), (F.col("turns_") - F.col("n") - F.col("turns0")).alias("before"), "n"
    )
    firsts = placed.groupBy("conv_id", "chunk").agg(F.min("before").alias("first"))
    own = Window.partitionBy("conv_id").orderBy("chunk")  # a row for chunk_tokens of a conversation's tokens
    after = firsts.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.lead("chunk").over(own).alias("next"), F.lead("first").over(own).alias("next_first"))
    both = placed.join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    return settle(both.select("conv_id", "turn", "chunk", F.when(F.col("before") + F.col("n") > F.col("next_first") - history_turns, F.col("next")).alias("next_chunk")))


def format_windows(
    turns: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 128, chunk_tokens: int = 1 << 15, tokens=count_tokens
) -> DataFrame:
    """Windows of WINDOW_SCHEMA from rows (conv_id, turn, role, text); loss spans count code points.

    Null role or text counts as empty, a null turn as turn 0; turns of equal number
    go by role, then text, and repeated rows are turns of their own. A null conv_id
    is a conversation. A turn above the budget is a window alone (`over_budget`, as
    when the system turn leaves no room). The system turn repeats in all windows
    after its own. Prefix sums of tokens deal a conversation into chunks of `chunk_tokens`, at
    whose borders windows end; history crosses them. Turns of equal number are one chunk's.
    An empty table gives an empty one; other columns are not read.
    """
    at = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    flat = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), at.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", tokens(F.col("text")))
    chunks = _chunks(flat, chunk_tokens, history_turns)
    of = chunks.select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), "chunk", "next_chunk")
    placed = flat.join(of, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("at")))
    places = F.array(F.struct("chunk", F.lit(2).alias("part")), F.struct(F.col("next_chunk").alias("chunk"), F.lit(1).alias("part")))
    own = placed.withColumn("place", F.explode(F.filter(places, lambda p: p["chunk"].isNotNull()))).select("conv_id", "place.*", "turn", "role", "text", "tokens")
    order = F.struct("chunk", "turn", "role", "text", "tokens")
    system = placed.filter("role = 'system'").groupBy("conv_id").agg(F.min(order).alias("s"))
    later = chunks.select("conv_id", "chunk").distinct().alias("c").join(system.alias("y"), F.col("c.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("c.chunk") > F.col("s.chunk")))
    again = later.select("c.conv_id", "c.chunk", F.lit(0).alias("part"), "s.turn", "s.role", "s.text", "s.tokens")
    dealt = own.unionByName(again).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "part", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        now, key = None, ()
        for b in batches:
            out: list[tuple] = []
            for conv, chunk, part, role, text, n in zip(b["conv_id"].astype("Int64"), b["chunk"], b["part"], b["role"], b["text"], b["tokens"]):
                if now is None or key != (k := (None if conv is pd.NA else conv, chunk)):
                    out += now.close() if now else []
                    key = (None if conv is pd.NA else conv, chunk)
                    now = _Chunk(key, budget, history_turns, history_tokens)
                turn = _Turn(role, text, int(n))
                if part == 0:
                    now.system = now.first_system = turn
                elif part == 1:
                    now.recent.append(turn)
                else:
                    out += now.add(turn)
            if out:
                yield frame(out)
        if now and (out := now.close()):
            yield frame(out)

    return dealt.mapInPandas(run, WINDOW_SCHEMA)


def digest_windows(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from formatted text and mask, one row for each conversation.

    The windows of a conversation stream in order through one hash, whose state is
    all that is held; a digest of a whole conversation can't be had in parts.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"conv_id": "Int64"})
        now = None  # key, turns, hash, loss chars, hash, chars, windows
        finish = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])
        for b in batches:
            out = []
            for conv, n_repeated, formatted, starts, ends in zip(b["conv_id"].astype("Int64"), b["n_repeated"], b["formatted"], b["loss_starts"], b["loss_ends"]):
                conv = None if conv is pd.NA else conv
                if now is None or now[0] != conv:
                    if now:
                        out.append(finish(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                new = parse(formatted)[n_repeated:]
                now[1] += len(new)
                now[2].update("".join(f"{role}\n{text}\n" for role, text in new).encode())
                loss = "".join(unescape(formatted[a:z]) for a, z in zip(starts, ends))
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(formatted)
                now[6] += 1
            if out:
                yield frame(out)
        if now:
            yield frame([finish(now)])

    return ordered.mapInPandas(run, schema)
