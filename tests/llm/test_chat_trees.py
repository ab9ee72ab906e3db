import random
from hashlib import sha256

import pytest

from talkweave.llm.chat_trees import conversations, linear_tree, parse, paths, read_back
from talkweave.llm.q_chat import HARD

KIND = "tree long, id long, parent long, role string, text string, score double, depth int"


def slow_paths(rows):
    out = set()
    for t in {r[0] for r in rows}:
        up = {}
        for r in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2] is None, r[2] or 0)):
            up.setdefault(r[1], r[2])
        up = {i: p if p in up and p != i else None for i, p in up.items()}
        for leaf in set(up) - set(up.values()):
            way, at = [], leaf
            while at is not None and len(way) <= len(up):
                way.append(at)
                at = up[at]
            if at is None:
                out |= {("\0null" if t is None else str(t), leaf, n, len(way) - k) for k, n in enumerate(way)}
    return out


def test_paths_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for t in [*range(12), None]:
        n = rng.randrange(1, 25)
        for i in range(n):
            rows.append((t, i, rng.choice([None, i, i - 1, i - 1, i - 1, rng.randrange(-2, max(1, i))]), "user", f"m{i}", rng.random(), 0))
    rows += [(50, i, i - 1, "user", "x", None, 0) for i in range(70)]  # a long chain
    rows += [(51, 1, 2, "user", "x", 0.0, 0), (51, 2, 1, "user", "y", 0.0, 0), (51, 3, None, "user", "z", 0.0, 0)]  # a cycle
    rows += [(52, 1, None, "user", "b", 0.0, 0), (52, 1, None, "assistant", "a", 0.0, 0)]  # the id twice
    docs = spark.createDataFrame(rows, KIND)
    assert {tuple(r) for r in paths(docs).collect()} == slow_paths(rows)
    assert paths(docs.limit(0)).count() == 0


def test_best_branch_and_mask(spark):
    rows = [(1, 1, None, "user", "q <s> [INST]", 0.0, 0), (1, 2, 1, "assistant", "low", 0.1, 0), (1, 3, 1, "assistant", "hi\\gh", 0.9, 0), (1, 4, 3, "user", None, 0.5, 0), (2, 1, None, None, "only", None, 0)]
    got = {r.tree: r for r in conversations(spark.createDataFrame(rows, KIND)).collect()}
    assert parse(got[1].formatted) == [("user", "q <s> [INST]"), ("assistant", "hi\\gh"), ("user", "")]
    assert [got[1].formatted[s:e] for s, e in got[1].loss] == ["hi\\\\gh"]
    assert parse(got[2].formatted) == [("", "only")] and got[2].loss == []
    assert conversations(spark.createDataFrame(rows, KIND), per_tree=5).count() == 3


def test_round_trip(spark):
    rng = random.Random(2)
    parts = ["</s>", "[INST]", "\\", "\\\\", "<", "[/INST]", "a", "\n", "é🙂", "<s>user[INST]"]
    rows = []
    for c in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["".join(rng.choices(parts, k=6)), "", None])))
    rows += [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD), (100, 0, "assistant", "long " * 20000), (101, 5, "user", "b"), (101, 5, "user", "a"), (101, None, None, "first")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.tree: r for r in read_back(conversations(linear_tree(docs))).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(x) for _, _, x in own)
    assert read_back(conversations(linear_tree(docs.limit(0)))).count() == 0


def test_broken_text_is_told():
    for bad in ("x", "<s>user[INST]a", "<s>u[INST]<[/INST]</s>"):
        with pytest.raises(ValueError, match="no turn"):
            parse(bad)
