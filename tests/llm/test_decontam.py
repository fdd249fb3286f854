import numpy as np
import pytest

from factorspark.llm import decontam


def arrays(texts):
    raw = [t.encode() for t in texts]
    return decontam.characters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def words(rng, n):
    return " ".join("".join(chr(97 + v) for v in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def test_groups_of_hits_change_no_decision(monkeypatch):
    """Rulers, passages with edits over the borders of groups, several items and texts: small groups find what one group finds."""
    rng = np.random.default_rng(5)
    items = [(k, words(rng, 40)) for k in range(4)] + [(4, words(rng, 6) + " " + "-" * 60 + " " + words(rng, 6)), (5, "=" * 90)]
    index = decontam.Index.build(items)
    texts = []
    for k in range(24):
        t = items[k % 6][1]
        t = list(t[k % 9:k % 9 + 110])
        for at in rng.integers(0, len(t), k % 8):
            t[at] = "#"
        texts.append(words(rng, 30) + " " + "-" * int(rng.integers(0, 200)) + " " + "".join(t) + words(rng, 10))
    c, offs = arrays(texts)
    want = {m[:2] for m in decontam.matches(index, c, offs)}
    assert 10 < len(want) < 40
    for hits in (6000, 25000):
        monkeypatch.setattr(decontam, "HITS", hits)
        assert {m[:2] for m in decontam.matches(index, c, offs)} == want


@pytest.mark.parametrize("item,held", [("a ruler " + "-" * 300 + " ends here", True), ("what stands above " + "-" * 60 + " stands below it, as all know", False)])
def test_one_repeated_character_in_a_long_text(monkeypatch, item, held):
    """40,000 times the same character against an item that repeats it, above and below the length of a window."""
    c, offs = arrays(["-" * 40_000])
    index = decontam.Index.build([(1, item)])
    held_at_once = []
    whole = decontam._group_stretches
    monkeypatch.setattr(decontam, "_group_stretches", lambda index, pos, doc, key, count, skip: held_at_once.append(count.sum()) or whole(index, pos, doc, key, count, skip))
    got = list(decontam.matches(index, c, offs))
    assert max(held_at_once) < 1.1 * decontam.HITS and len(held_at_once) > 1
    assert bool(got) == held
