import hashlib
import random

import pytest

from strandloom.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string, chunk int"


def expected(rows):
    """Digest columns by their definition."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((0 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = ["<", "/", "s>", ">", "[", "INST]", "/INST]", "\\", "<SYS>>", "</SYS>>", "TURN]", "a", " ", "/NAME]", "[/INST]", "</s>", "\n"]
    for _ in range(20000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        assert c.unescape(c.escape(t)) == t
        role = rng.choice(["user", "system", "assistant", "", t])
        assert c.parse(c.render(role, t)[0] + c.render("user", "x")[0]) == [(role, t), ("user", "x")]
    with pytest.raises(ValueError):
        c.parse("loose text")


def test_conversations_read_back(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in turns.collect()]
    rng = random.Random(2)
    long_ = [(-1, t, "system" if t == 3 else ("user", "assistant")[t % 2], " ".join(["w[/INST]"] * rng.randint(0, 60))) for t in range(600)]
    odd = [(-2, 0, None, None), (-2, 0, "user", ""), (-2, 1, "assistant", None), (None, None, "tool", "a</s>"), (-3, 5, "assistant", "x " * 3000), (-3, 5, "assistant", "x " * 3000), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += long_ + odd
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    windows = c.format_windows(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.digest_windows(windows).collect()}
    assert got == expected(rows)
    for w in windows.filter("conv_id = -1").collect():
        turns_of = c.parse(w.formatted)
        assert len(turns_of) == w.n_repeated + w.n_new and (w.tokens <= 512 or (w.over_budget and w.n_new == 1))
        if w.chunk > 0 or w.window > 0 and w.n_repeated:
            assert w.chunk == 0 or turns_of[0][0] == "system"  # retained
    first = windows.filter("conv_id = -1 and chunk = 1 and window = 0").first()
    assert first.n_repeated >= 1  # history or system from the chunk before
    assert c.digest_windows(c.format_windows(df.limit(0))).count() == 0


def test_windows_fill_the_budget_whatever_the_numbers_are(spark):
    rng = random.Random(4)
    text = lambda: " ".join(["word"] * rng.randint(3, 8))
    sparse = [(1, 10 * t, ("user", "assistant")[t % 2], text()) for t in range(300)]
    equal = [(2, t // 3, "user", f"{t} {text()}") for t in range(300)]
    one = [(3, 0, "assistant", f"{t} {text()}") for t in range(50)] + [(3, 1, "assistant", "very " * 40000)]
    df = spark.createDataFrame([(*r, 1) for r in sparse + equal + one], SCHEMA)
    windows = [r.asDict() for r in c.format_windows(df, budget=256, chunk_tokens=700).orderBy("conv_id", "chunk", "window").collect()]
    for conv, rows in ((1, sparse), (2, equal), (3, one)):
        own = [w for w in windows if w["conv_id"] == conv]
        total = sum(len(r[3].split()) for r in rows[:-1])
        assert sum(w["n_new"] for w in own) == len(rows)
        assert len(own) <= total / 150 + 2 + total / 350  # new tokens fill the windows, but the last of a chunk
        assert all(w["tokens"] <= 256 or w["over_budget"] and w["n_new"] == 1 for w in own)
        borders = [w for w in own if w["window"] == 0][1:]
        assert all(w["n_repeated"] == 2 for w in borders if not w["over_budget"])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.digest_windows(c.format_windows(df, budget=256, chunk_tokens=700)).collect()}
    assert got == expected(sparse + equal + one)
