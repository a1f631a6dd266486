import hashlib

import numpy as np

from specton.llm import chat
from specton.llm.registry import tokenizer_path


def made(spark, rows, part=3):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    members = chat.members(turns).cache()
    return members, chat.tree(members, tokenizer_path(), part=part).cache()


ROWS = [
    (1, 0, "user", "hi there", "x"), (1, 1, "assistant", "one\\n <|im_end|>\n", "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "", "x"),
    (2, 1, "assistant", "two", "x"), (2, 0, "user", "hi there", "x"),
    (3, 0, "user", "hi there", "x"), (3, 1, "assistant", "one\\n <|im_end|>\n", "x"), (3, 2, "user", "<|im_end|><|im_start|>assistant ok", "x"),
    (4, 0, None, None, "x"), (5, 0, "us\ner", "a\\<|b", "x"), (6, 0, "user", "hi there", "x"), (6, 0, "user", "hi there", "x"), (None, 0, "assistant", "z<", "x"),
]


def expected(rows):
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    members, tree = made(spark, ROWS)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.conversations(members, tree)).collect()}
    assert got == expected(ROWS)


def test_stream_positions_and_ancestors(spark):
    members, tree = made(spark, ROWS)
    nodes = sorted(tree.collect(), key=lambda r: r.start)
    assert len(nodes) == len({bytes(r.name) for r in members.collect()})
    assert nodes[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(nodes, nodes[1:]))  # emitted once, gapless
    assert all(len(r.tokens) == r.length for r in nodes)
    by = {bytes(r.name): r for r in nodes}
    for r in nodes:
        path, up = [], r.parent
        while up is not None:
            path.insert(0, by[bytes(up)])
            up = by[bytes(up)].parent
        attended = {k for a in r.ancestors for k in range(a.start, a.end)}
        assert attended == {k for x in path for k in range(x.start, x.start + x.length)} and len(attended) == sum(a.end - a.start for a in r.ancestors)
        assert r.position == len(attended) and len(r.name) == chat.STEP and r.depth == len(path)
        below = [x for x in nodes if r is x or bytes(x.path).startswith(bytes(r.path)) and x.depth > r.depth]
        assert sum(x.length for x in below) == max(x.start + x.length for x in below) - r.start  # subtrees are contiguous
    shared = [r for r in nodes if r.conversations >= 4]
    assert shared and shared[0].chunk == "<|im_start|>user\nhi there<|im_end|>\n"


def test_long_conversation_is_one_segment(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k}", "x") for k in range(3000)] + [(2, 0, "assistant", "turn 0", "x"), (2, 1, "user", "other", "x")]
    members, tree = made(spark, rows, part=500)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.conversations(members, tree)).collect()}
    assert got == expected(rows)
    assert tree.selectExpr("max(size(ancestors)) AS a", "max(length(path)) AS p", "count(*) AS n").first() == (2, 2 * chat.STEP, 3001)


def test_tokens_are_those_of_the_chunks(spark):
    from tokenizers import Tokenizer

    _, tree = made(spark, ROWS)
    t = Tokenizer.from_file(tokenizer_path())
    for r in tree.collect():
        assert list(r.tokens) == t.encode(r.chunk, add_special_tokens=False).ids


def test_empty(spark):
    members, tree = made(spark, [])
    assert tree.count() == 0 and chat.digests(chat.conversations(members, tree)).count() == 0
    assert np.array_equal([chat.unescape(chat.escape(x)) for x in ("\\", "<|", "\\<|\\|", "a\nb")], ["\\", "<|", "\\<|\\|", "a\nb"])
