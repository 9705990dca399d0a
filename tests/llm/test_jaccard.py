import math
import random
import time
from collections import Counter, defaultdict

import pytest

from tessera.llm import jaccard_join as j

from .helpers import awkward, clashing, empty, words


def _sets(pairs):
    out = {}
    for i, t in pairs:
        w = words(t)
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    for i, s in sets.items():
        for k in {k for x in s for k in held[x] if k < i}:
            common = len(s & sets[k])
            if 100 * common >= 75 * (len(s) + len(sets[k]) - common):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def _check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = _sets(enumerate(texts))
    want = _components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.classes(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_copies_chains_and_shared_passages(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(text(draw.randint(1, 60))) for _ in range(40)]
    base = text(80)
    for _ in range(25):  # copies of copies: a chain whose ends need not link
        base = list(base)
        base[draw.randrange(len(base))] = draw.choice(vocabulary)
        texts.append(" ".join(base))
    passage = text(40)
    texts += [" ".join(text(draw.randint(5, 40)) + passage + text(draw.randint(5, 40))) for _ in range(25)]
    one = text(30)
    for _ in range(30):  # edits of one text, around the threshold
        own = list(one)
        for _ in range(draw.randint(0, 2)):
            own[draw.randrange(30)] = draw.choice(vocabulary)
        texts.append(" ".join(own[: draw.randint(24, 30)]))
    texts += texts[:5]
    _check(spark, texts)


def test_five_thousand_near_copies(spark):
    import numpy as np

    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(5000):
        own = list(base)
        for _ in range(draw.choice((0, 1, 1, 2, 2, 3, 4, 5, 6, 7))):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        texts.append(" ".join(own))
    sets = _sets(enumerate(texts))
    seen = Counter(x for s in sets.values() for x in s)
    column = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1)}
    held = np.zeros((len(texts), len(column)), dtype=np.float32)
    for i, s in sets.items():
        held[i, [column[x] for x in s if x in column]] = 1
    size = np.array([len(sets[i]) for i in range(len(texts))])
    common = np.rint(held @ held.T)
    link = 100 * common >= 75 * (size[:, None] + size - common)
    least = np.arange(len(texts))
    while (new := np.where(link, least, len(texts)).min(axis=1).clip(max=least)).tolist() != least.tolist():
        least = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in j.classes(docs).collect()}
    assert 5 < len(set(least.tolist())) < 4000
    assert got == dict(enumerate(least.tolist()))


def test_query_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = _sets((r.doc_id, r.text) for r in docs.collect())
    want = _components(sets)
    assert {r.doc_id: r.component_id for r in j.classes(docs).collect()} == want


def test_awkward_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in j.classes(clashing(awkward(spark))).collect()]
    assert len(got) == 11
    by = {d: (n, c) for d, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[5] == (6, 5) and by[6] == (6, 5)
    assert by[7] == (1, 7) and by[8] == (3, 8) and by[None][1] is None
    assert j.classes(empty(spark)).count() == 0
    kept = j.one_of_each(clashing(awkward(spark)))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert kept.columns == clashing(awkward(spark)).columns


def test_one_id_with_different_texts(spark):
    texts = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, "a b c d e f g")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.component_id for r in j.classes(docs).collect()} == {1}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(i, i + 1) for i in range(60)]])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.v: r.c for r in j.components(links).collect()}
    assert got == {r.v: r.c for r in j.components(links, one_task=-1).collect()}
    want = _components({v: frozenset() for e in edges for v in e})
    for a, b in edges * len(edges):
        low = min(want[a], want[b])
        want[a] = want[b] = low
    assert got == want


def test_sketches_bound_the_intersection():
    draw = random.Random(2)
    import numpy as np

    for _ in range(50):
        a = np.unique(np.array([draw.getrandbits(64) for _ in range(draw.randint(1, 900))], dtype=np.uint64))
        b = np.unique(np.concatenate([a[: draw.randint(0, len(a))], np.array([draw.getrandbits(64) for _ in range(draw.randint(1, 300))], dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert common <= j.most_common(j.sketch(a), len(a), j.sketch(b), len(b)) <= min(len(a), len(b))


def test_hash_agrees_for_equal_words():
    assert j.word_hashes(b"Hello, hello, HELLO,").tolist()[0] == j.word_hashes(b"x hello,").tolist()[1]
    assert len(j.word_hashes(b"a\x0bb\x0cc\xc2\xa0d")) == 3


def test_frequent_shingles_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(j, "SAMPLE_DOCS", 10, raising=False)
    texts = [f"five words that all share {i} own{i} words{i} here{i} too{i}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shared = j.shingle_set(b"five words that all share")[0]
    rank = lambda n: math.floor(math.log2(n) * j.RANKS_A_DOUBLING)
    shingles, ranks = j.frequent_shingles(docs)
    assert dict(zip(shingles.tolist(), ranks.tolist(), strict=True)) == {int(shared): rank(600)}
    # With few counters a task loses at most its part's shingles divided by them.
    monkeypatch.setattr(j, "TASK_SHINGLES", 50)
    shingles, ranks = j.frequent_shingles(docs)
    assert rank(600 - 600 * 6 / 50) <= dict(zip(shingles.tolist(), ranks.tolist(), strict=True))[int(shared)] <= rank(600)
    assert len(j.frequent_shingles(empty(spark))[0]) == 0


def test_many_small_tasks_return_few_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(j, "TASK_SHINGLES", 200)
    texts = [f"five words that all share {i} own{i} words{i} here{i} too{i}" for i in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60).write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert docs.rdd.getNumPartitions() == 60
        counts = j.shingle_counts(docs).collect()
        shared = int(j.shingle_set(b"five words that all share")[0].view("int64"))
        # Each of a few tasks lowers its counts, and all rows but the shared shingle's come once.
        assert len(counts) <= spark.sparkContext.defaultParallelism
        assert 3000 - 3000 * 6 / 200 <= sum(r.n for r in counts if r.s == shared) <= 3000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_folded_sketches_bound_the_intersection(spark):
    import numpy as np

    draw = random.Random(3)
    rows = []
    for k in range(40):
        s = np.unique(np.array([draw.getrandbits(64) for _ in range(draw.randint(1, 90))], dtype=np.uint64))
        rows.append((k, s, j.sketch(s).tolist()))
    df = spark.createDataFrame([(k, *w) for k, _, w in rows], f"point long, {', '.join(f'{w} long' for w in j.SKETCH)}").withColumns(j.folded())
    bits = {r.point: np.array([r[f] for f in j.FOLDED]).view(np.uint64) for r in df.collect()}
    for k, s, _ in rows:
        size = 64 * len(j.FOLDED)
        want = np.bincount((s & np.uint64(size - 1)).astype(int), minlength=size) & 1
        assert np.array_equal(bits[k], np.packbits(want.astype(bool)).view("<u8"))


def test_boundaries_shuffle_folded_sketches_only(spark, monkeypatch):
    """Of the points that meet in regions, whole sketches are joined for pairs only."""
    seen, pairs = [], j._pairs
    monkeypatch.setattr(j, "_pairs", lambda left, right, on, where: seen.append((on, [*left.columns, *right.columns])) or pairs(left, right, on, where))
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[draw.choice(vocabulary) for _ in range(30)] for _ in range(6)]
    texts = []
    for _ in range(150):
        own = [*draw.choice(passages), *draw.choice(passages)]
        own[draw.randrange(60)] = draw.choice(vocabulary)
        texts.append(" ".join(own))
    _check(spark, texts)
    met = [columns for on, columns in seen if on == "region"]
    assert met and not any(w in columns for columns in met for w in j.SKETCH)


def test_first_shingles_go_when_regions_are_written(spark, monkeypatch):
    import os

    made, there, table, rounds = [], [], j.table, j.cell_rounds

    def noted(df, *a):
        out = table(df, *a)
        made.append((df.columns, out.written_to))
        return out

    monkeypatch.setattr(j, "table", noted)
    monkeypatch.setattr(j, "cell_rounds", lambda *a: there.extend(c for c, path in made if os.path.exists(path)) or rounds(*a))
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(40)], "doc_id long, text string")
    assert j.classes(docs).count() == 40
    assert any("first" in c for c, _ in made) and there and not any("first" in c for c in there)


def test_the_driver_forgets_what_is_done(spark, monkeypatch):
    """What only the driver's garbage holds goes when it is relieved, as every round of the join does."""
    from tessera.llm.common import relieve

    jvm = spark.sparkContext._jvm
    done = jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    relieve(spark, 1.1)  # a heap never passes its most
    for _ in range(20):  # Python lets go of it by and by
        relieve(spark)
        if gone := bool(done.refersTo(None)):
            break
        time.sleep(0.2)
    assert gone
    times, joined = [], []
    monkeypatch.setattr(j, "relieve", lambda s: times.append(s))
    rounds = j._joined
    monkeypatch.setattr(j, "_joined", lambda *a: joined.append(a) or rounds(*a))
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(40)], "doc_id long, text string")
    assert j.classes(docs).count() == 40
    assert joined and len(times) >= len(joined) + 3


def test_what_postings_share_is_shuffled_first(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(8)], "doc_id long, text string")
    found = j.postings(j.document_sets(docs, j.frequent_shingles(docs)))
    assert found.columns == ["salt", "s", "point", "n"]
    held = j.regions(found, 3).collect()
    assert held and {r.n for r in held} == {5}
