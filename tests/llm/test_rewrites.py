"""Templates that rewrite history at single prefixes far into a conversation, and declared ones that lie."""

import time

from flowlens.llm import chat

TURNS = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(120)]


def joined(turns):
    return "".join(f"{t}\n" for _, t in turns)


def test_rewrites_at_inner_prefixes():
    at = lambda *sizes: lambda ts: joined(ts[1:] if len(ts) in sizes else ts)
    for sizes in ((41,), (65, 66), (100,)):
        found = chat.render(TURNS, at(*sizes))
        assert found == chat.by_prefixes(TURNS, at(*sizes)) and found[2] == [sizes[0] - 1, sizes[-1]] and not found[1]
    drops = lambda ts: joined(ts[10:] if 45 <= len(ts) < 60 else ts)
    assert chat.render(TURNS[:80], drops)[2] == [44, 59]
    assert chat.render(TURNS, joined)[2] == [] and len(chat.render(TURNS, joined)[1]) == 120


def test_declared_templates():
    assert chat.marked_turns.appends_only
    began = time.time()
    turns = [("user", "x" * 30)] * 10_000
    assert len(chat.render(turns)[1]) == 10_000 and time.time() - began < 60

    @chat.appends_only
    def lies(ts):
        return joined(ts if len(ts) < 70 else ts[1:])

    assert chat.render(TURNS, lies) == chat.by_prefixes(TURNS, lies)  # seen in the whole conversation
