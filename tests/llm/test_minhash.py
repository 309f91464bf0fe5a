import numpy as np
import pytest

from llm_cases import ODD, SF, documents as frame
from tidemark.llm import prob_minhash as M


def plain_index(a, b):
    """Probability Jaccard index by its definition."""
    keys = sorted(set(a) | set(b))
    total = 0.0
    for x in set(a) & set(b):
        total += 1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in keys)
    return total, len(set(a) & set(b)) / len(keys)


def as_set(d):
    k = sorted(d)
    return np.array(k, dtype=np.uint64), np.array([float(d[x]) for x in k])


def test_similarity_by_definition():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = {int(k): int(w) for k, w in zip(rng.choice(30, 12, replace=False), rng.integers(1, 4, 12))}
        b = {int(k): int(w) for k, w in zip(rng.choice(30, 15, replace=False), rng.integers(1, 4, 15))}
        assert M.similarity(as_set(a), as_set(b)) == pytest.approx(plain_index(a, b))
    assert M.similarity(as_set({1: 1}), as_set({2: 1})) == (0.0, 0.0)


def test_registers_estimate_the_index():
    rng = np.random.default_rng(6)
    a = {int(k): int(w) for k, w in zip(rng.choice(400, 200, replace=False), rng.integers(1, 5, 200))}
    b = {k: w if k % 3 else w + 1 for k, w in a.items() if k % 7} | {int(k): 2 for k in range(1000, 1020)}
    (ka, wa), (kb, wb) = as_set(a), as_set(b)
    m = 4000
    sig = M.signatures(np.repeat([0, 1], [len(ka), len(kb)]), M.mix(np.concatenate([ka, kb])), np.concatenate([wa, wb]), 2, m)
    assert (sig[0] == sig[1]).mean() == pytest.approx(plain_index(a, b)[0], abs=0.03)


def brute_classes(docs):
    texts = [t for _, t in docs]
    t, s, w, keys = M.shingles(texts)
    ends = np.searchsorted(t, np.arange(len(texts) + 1))
    sets = [(s[i:j], w[i:j]) for i, j in zip(ends[:-1], ends[1:])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] == keys[j] or (len(sets[i][0]) and max(M.similarity(sets[i], sets[j])) >= 0.8):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(docs)}


def test_classes_on_all_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in M.classes(df).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in df.collect()])


def test_chains_copies_and_a_shared_passage(spark):
    rng = np.random.default_rng(7)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    base, passage, rows = text(300), text(150), []
    for i in range(60):  # a large group of near copies: each has a few words of its own
        w = list(base)
        for p in rng.integers(0, 300, 3):
            w[p] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    rows += [(200 + i, " ".join(passage + text(150))) for i in range(60)]  # half of each text is shared
    link = text(200)
    for i in range(8):  # a chain: neighbours are similar, ends are not
        link = link[12:] + text(12)
        rows.append((300 + i, " ".join(link)))
    got = {r.doc_id: r.class_id for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert len({got[i] for i in range(60)}) == 1 and all(got[200 + i] == 200 + i for i in range(60))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 150), (150, 120), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 120: 100, 150: 100, 300: 300, 301: 300}


def test_odd_rows(spark):
    docs = frame(spark, ODD, extra=True)
    rows = M.classes(docs).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[10] == {4} and by[1] == by[2] == {1} and 4 in by[4] and by[6] == {6} and by[7] == {7}
    kept = M.keep_first(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sum(r.text == "one two three four five six seven" for r in left) == 1
    assert sum((r.text or "") == "" for r in left) == 1 and sum(r.doc_id == 4 for r in left) == 2


def test_empty_table(spark):
    assert M.classes(frame(spark, [])).count() == 0 and M.keep_first(frame(spark, [])).count() == 0


def plain_classes(docs, threshold=0.8):
    """Classes by the plain index of all pairs, for texts without repeated shingles."""
    t, s, w, _ = M.shingles([x for _, x in docs])
    assert (w == 1).all()
    column = np.unique(s, return_inverse=True)[1]
    held = np.zeros((len(docs), column.max() + 1), dtype=np.float32)
    held[t, column] = 1
    size = held.sum(axis=1)
    common = held @ held.T
    near = common / (size[:, None] + size - common) >= threshold - 1e-6
    label = np.arange(len(docs))
    while True:
        new = np.where(near, label, len(docs)).min(axis=1)
        if (new == label).all():
            return {d: docs[x][0] for (d, _), x in zip(docs, label)}
        label = new


def test_cut_copies_of_copies_in_large_groups(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(5):
        base = [f"w{x}" for x in rng.choice(10**6, 200, replace=False)]
        group = [(10_000 * g, " ".join(base))]
        for i in range(1, 2000):  # edited copies lead most buckets
            w = list(base)
            for p in rng.integers(0, 200, rng.integers(1, 5)):
                w[p] = f"new{g}x{i}"
            group.append((10_000 * g + i, " ".join(w)))
        for i in range(4):  # a copy with a part cut away, and one of that copy with more cut away
            group.append((10_000 * g + 5000 + i, " ".join(base[:50 * i] + base[50 * i + 28:])))
            group.append((10_000 * g + 6000 + i, " ".join(base[:50 * i] + base[50 * i + 50:])))
        rows += group
        want |= plain_classes(group)
    got = {r.doc_id: r.class_id for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_small_tables_stay_in_few_partitions(spark, monkeypatch):
    """However many partitions a shuffle has, small tables are not staged in as many files and tasks."""
    files = {}

    def counted(df, name, stage=M.stage):
        out = stage(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(M, "stage", counted)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[40 * i:40 * i + 40] + [f"copy{c}"]) for i in range(80) for c in range(3)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        kept = sorted(r["doc_id"] for r in M.keep_first(frame(spark, [(i, t, "a", "en") for i, t in enumerate(texts)])).select("doc_id").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept == [3 * i for i in range(80)]
    small = ("cc-edges", "cc-large", "cc-small", "minhash-buckets", "minhash-wanted", "minhash-pairs", "minhash-verified", "minhash-texts", "minhash-named", "minhash-classes")
    assert {n: files[n] for n in small if files[n] > spark.sparkContext.defaultParallelism} == {}
