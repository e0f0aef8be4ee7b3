import random
import re
from collections import defaultdict

from marlstone.llm import minhash
from marlstone.llm.common import LOWER


def brute(texts, k, threshold):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER).decode())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
        for j, n in common.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def variants(seed, n, words=140, most=14):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        v = list(base if r.random() < 0.7 else out[r.randrange(len(out))].split())
        for _ in range(r.randrange(most)):
            v[r.randrange(len(v))] = f"x{r.randrange(10_000)}"
        out.append(" ".join(v))
    return out


def test_group_of_near_copies_equals_brute_force(docs):
    texts = variants(1, 300) + variants(2, 60, 30, 3) + ["", None, "  \n", "one", "One", "two words", "a b c", "A B C", "É b c", "é b c"] + variants(3, 30, 700, 60)
    random.Random(4).shuffle(texts)
    n, component = brute(texts, 3, 85)
    got = {r.doc_id: r for r in minhash.near_dups(docs(list(enumerate(texts))), 3, 85, 20).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == component
    assert sum(r.first for r in got.values()) == len(set(component))


def test_links_between_classes_that_are_not_near_the_centre(docs, monkeypatch):
    monkeypatch.setattr(minhash, "NEAR", 0.95)  # nearly all pairs go the other way
    texts = variants(5, 120)
    got = {r.doc_id: r.component_id for r in minhash.near_dups(docs(list(enumerate(texts))), 3, 85, 20).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 85)[1]


def test_pipeline_parameters(docs):
    texts = variants(6, 150, 200, 6)
    got = {r.doc_id: r.component_id for r in minhash.near_dups(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5, 80)[1]


def test_edge_cases(spark, docs):
    assert minhash.near_dups(docs([])).count() == 0
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, None), (4, None), (5, "x" * 300_000)]
    got = minhash.near_dups(docs(rows)).collect()
    assert len(got) == 6
    assert {r.component_id for r in got if r.n_shingles == 3} == {3}
    assert {r.component_id for r in got if r.n_shingles == 0} == {None, 4}
    for names in ({"n_chars": "node", "lang": "label", "source": "key"}, {"n_chars": "hash", "lang": "hash__", "source": "d"}, {"n_chars": "first", "lang": "h", "source": "bits"}):
        clash = docs([*rows, (6, None), (6, None)]).withColumnsRenamed(names)
        kept = minhash.dedup(clash)
        assert kept.columns == clash.columns
        # Of twins one stays; texts without words are linked with nothing.
        assert sorted(r.text for r in kept.where("text is not null").collect()) == ["a b c d e f g", "x" * 300_000]
        assert sorted(r.doc_id or 0 for r in kept.where("text is null").collect()) == [0, 4, 6, 6]
