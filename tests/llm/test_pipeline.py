import random
import re

from test_minhash import brute, variants
from test_operators import brute_hits

import corpus_pipeline
from marlstone.llm.common import stored


def plain(docs, items):
    """The ids that each stage but the last leaves, in plain Python."""
    left = {i: t for i, t in docs if t and re.search(r"[^\W\d_]", t)}
    yield set(left)
    best = {}
    for i, t in left.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (-len(t), i)), (-len(t), i))
    left = {i: left[i] for _, i in best.values()}
    yield set(left)
    ids = sorted(left)
    component = brute([left[i] for i in ids], 5, 80)[1]
    left = {i: left[i] for n, i in enumerate(ids) if component[n] == n}
    yield set(left)
    ids = sorted(left)
    left = {i: left[i] for i, found in zip(ids, brute_hits([left[i] for i in ids], items)) if not found[1]}
    yield set(left)


def test_stages_and_run_equal_plain_python(spark, docs, tmp_path):
    r = random.Random(8)
    words = lambda n, k: " ".join(f"{k}{r.randrange(500)}" for _ in range(n))
    items = [(n, words(14, "q")) for n in range(4)] + [(4, "Short Item here")]
    near = variants(9, 25, 160, 20)
    alone = [words(60, "z") for _ in range(20)]
    held = [f"{words(20, 'a')} {' '.join(items[n][1].split()[n : n + 10])} {words(20, 'b')}" for n in range(4)] + [words(9, "c") + " short, ITEM here", words(20, "d") + " " + " ".join(items[0][1].split()[:9])]
    texts = near + [t.replace(" ", "  ", n) for n, t in enumerate(near[:6] + alone[:6])] + alone + held + [None, "", " \n", "1234 567", "?!", "é", "x", "X"]
    r.shuffle(texts)
    rows = [(i, t, ("en", "fr")[i % 2]) for i, t in enumerate(texts)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = list(plain([(i, t) for i, t, _ in rows], items))
    assert len(texts) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3])
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = left.columns
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        left = stored(stage(spark, left, str(tmp_path)))
        got = left.collect()
        assert left.columns == columns and len(got) == len(ids), name
        assert {(x.doc_id, x.text, x.lang) for x in got} == {rows[i] for i in ids}, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == sorted(want[-1])
    assert all(x.lossless and x.n_pieces == len(x.ids) for x in out)
