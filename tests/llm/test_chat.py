import itertools
import random
import zlib

import numpy as np
import pytest
from fixtures import plain

from weirlog.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk string, enter string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def some_model(n=2, seed=1):
    rng = np.random.default_rng(seed)
    roles = ["assistant", "system", "user"][-n:]
    sizes = {"length": chat._LENGTHS, "question": 2, "rows": chat._LINES}
    features = {name: rng.integers(0, 30, (2 * n, size)).astype(float) for name, size in sizes.items()}
    return chat.RoleModel(roles, rng.integers(1, 9, n).astype(float), rng.integers(1, 9, (n, n)).astype(float), features)


def score(model, codes, path):
    total, before = 0.0, model.states - 1
    for code, state in zip(codes, path):
        total += model.step(code)[before, state]
        before = state
    return total


def some_codes(rng):
    texts = [rng.choice(["Hi?\nwell", "user: a\nAssistant: b", "x" * rng.randint(0, 300), "one\ntwo", ""]) for _ in range(rng.randint(1, 3))]
    return [c for t in texts for c in chat.line_codes(t)]


def test_the_path_is_the_best_of_all():
    rng, model = random.Random(5), some_model()
    for _ in range(25):
        codes = some_codes(rng)[:6]
        ((enter, leave),) = model.borders([model.chunk_matrix(codes)])
        path = model.decode(codes, enter, leave)
        best = max(score(model, codes, p) for p in itertools.product(range(model.states), repeat=len(codes)))
        assert score(model, codes, path) == pytest.approx(best)


def test_chunks_give_the_same_score_as_the_whole():
    rng, model = random.Random(6), some_model(3)
    for _ in range(20):
        rows = [chat.line_codes(rng.choice(["a?", "b" * 90, "System: x", "u\nv"])) for _ in range(12)]
        codes = [c for r in rows for c in r]
        ((enter, leave),) = model.borders([model.chunk_matrix(codes)])
        whole = score(model, codes, model.decode(codes, enter, leave))
        chunks = [[c for r in rows[i : i + 5] for c in r] for i in range(0, 12, 5)]
        path = []
        for part, (enter, leave) in zip(chunks, model.borders(model.chunk_matrix(part) for part in chunks)):
            path += model.decode(part, enter, leave)
        assert score(model, codes, path) == pytest.approx(whole)


def test_markers():
    kinds = {"User: hello": 1, "### Assistant": 2, "**Bot:** x": 2, "<|im_start|>system": 3, "[AI]: y": 2, "Q: why": 1}
    assert {line: chat.marker(line)[0] for line in kinds} == kinds
    assert [chat.marker(x)[0] for x in ("username: x", "a thing", "assistants are", "")] == [0, 0, 0, 0]


def test_markers_split_a_row_into_turns(spark):
    features = {"length": np.zeros((6, chat._LENGTHS)), "question": np.zeros((6, 2)), "rows": np.zeros((6, chat._LINES))}
    model = chat.RoleModel(["assistant", "system", "user"], np.zeros(3), np.zeros((3, 3)), features)
    text = "User: what is it?\nAssistant: a thing\nthat is long\nUser: thanks"
    found = chat.format_turns(make(spark, [(1, 0, None, text)]), model)
    assert plain(found, "part", "role", "text") == [
        (0, "user", "what is it?"),
        (1, "assistant", "a thing\nthat is long"),
        (2, "user", "thanks"),
    ]
    assert found.where("part = 2").first().rendered == "<|user|>\nthanks\n<|end|>"


def test_held_out_roles(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    given = {(r.conv_id, r.turn): r.role for r in table.collect()}
    found = chat.format_turns(table, chat.learn(table)).collect()
    assert {(r.conv_id, r.turn) for r in found} == set(given)
    held_out = [r for r in found if zlib.crc32(str(r.conv_id).encode()) % 4 == 2]
    assert sum(given[r.conv_id, r.turn] == r.role for r in held_out) / len(held_out) > 0.95


def test_long_conversations_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 10)
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "short?" if i % 2 == 0 else "a long answer " * 30) for i in range(95)]
    odd = [(2, None, "user", "x"), (2, 0, None, None), (None, 3, "user", "alone"), (None, 3, "user", "also alone"), (3, 1, "user", ""), (3, 1, "user", "")]
    table = make(spark, turns + odd)
    found = chat.format_turns(table.repartition(5), chat.learn(table))
    roles = {r.turn: r.role for r in found.where("conv_id = 1").collect()}
    assert roles == {i: role for _, i, role, _ in turns}
    assert plain(found.where("conv_id IS NULL OR conv_id > 1"), "conv_id", "turn", "text") == sorted(
        [(2, None, "x"), (2, 0, ""), (None, 3, "alone"), (None, 3, "also alone"), (3, 1, "")], key=repr
    )
    nothing = make(spark, [])
    assert chat.format_turns(nothing, chat.learn(nothing)).count() == 0


def test_rendering_breaks_up_control_marks():
    assert chat.rendered("user", " a <|end|> b ") == "<|user|>\na < |end|> b\n<|end|>"


def test_all_roles_are_learned(spark):
    """Eleven roles that follow each other in a circle, each with its own length of lines."""
    roles = [f"role{i:02d}" for i in range(11)]
    rows = [(c, t, roles[(c + t) % 11], "w" * (1 << (c + t) % 11)) for c in range(40) for t in range(22)]
    conversations = make(spark, rows)
    model = chat.learn(conversations)
    assert model.roles == roles
    found = {(r.conv_id, r.turn): r.role for r in chat.format_turns(conversations, model).collect()}
    assert all(found[c, t] == role for c, t, role, _ in rows)
