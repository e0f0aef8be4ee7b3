"""Near pairs against plain sets: borders of blocks, characters of every kind, nulls and short texts."""

import random

import pytest

from marlstone.operators import dedup


def plain(rows):
    buckets = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        buckets.setdefault(len(t) // dedup.BUCKET, []).append((i, " ".join(t.lower().split())))
    sets = lambda t: {t[j : j + 5] for j in range(len(t) - 4)} if len(t) >= 5 else {t}
    out = {}
    for same in buckets.values():
        same = [(i, sets(t)) for i, t in same]
        for k, (i, x) in enumerate(same):
            for j, y in same[k + 1 : k + 1 + dedup.NEIGHBOURS]:
                if len(x & y) / len(x | y) >= dedup.SIMILAR:
                    out[i, j] = len(x & y) / len(x | y)
    return out


@pytest.mark.parametrize("block", [1, 8_000_000])
def test_near_pairs_are_those_of_plain_sets(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    r = random.Random(3)
    letters = ["abc de", "αβγ δé", "".join(chr(0x4E00 + 7 * i) for i in range(600)), "x\U0001F600y\U0001F680z "]
    rows = []
    for i in range(400):
        kind = r.choice(letters)
        t = "".join(r.choice(kind) for _ in range(r.choice([3, 60, 190, 199, 260, 390])))
        if rows and r.random() < 0.6:
            t = r.choice(rows[-25:])[1] or ""
            if len(t) > 20 and r.random() < 0.7:
                at = r.randrange(len(t) - 3)
                t = t[:at] + r.choice("QWé\u4e00 ") * r.randint(1, 3) + t[at + r.randint(0, 3) :]
        rows.append((i * 3, t if r.random() < 0.97 else None))
    rows += [(2000 + i, t) for i, t in enumerate(["", "", " ", "ab", "AB", None, None])]
    got = dedup.near_pairs(spark.createDataFrame(r.sample(rows, len(rows)), "id long, text string").repartition(5)).collect()
    want = plain(rows)
    assert len(want) > 100 and {(x.a, x.b): x.jaccard for x in got} == want and len(got) == len(want)


def test_near_dups_are_greedy_in_key_order(spark):
    base = "the quick brown fox jumps over the lazy dog and then it rests for a while in the warm shade of a tree " * 2
    rows = [(f"k{i}", base if i % 2 else base + "?") for i in range(60)] + [("z", None)]
    assert {x.id for x in dedup.near_dups(spark.createDataFrame(rows, "id string, text string")).collect()} == {f"k{i}" for i in range(60)} - kept_of(rows)


def kept_of(rows):
    gone, pairs = set(), plain(rows)
    for a, b in sorted(pairs):
        if a not in gone:
            gone.add(b)
    return {i for i, t in rows if t is not None} - gone
