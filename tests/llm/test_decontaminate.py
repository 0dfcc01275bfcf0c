import random

from palaver.llm import decontaminate as dc, text as tx


def split(t):
    return tx.SEPARATOR.sub(" ", (t or "").lower()).split()


def distance(item, words):
    """Least edit distance between item and any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def fixture(seed=4, docs=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 6))) for _ in range(600)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in (3, 5, 6, 8, 12, 15, 20, 30, 45, 59, 130)]
    texts = []
    for _ in range(docs):
        w = some(r.choice((0, 2, 30, 200)))
        if r.random() < 0.7:
            item = list(r.choice(items))
            for _ in range(r.randint(0, int(0.25 * len(item)))):
                p, k = r.randrange(len(item)), r.random()
                if k < 0.5:
                    item[p] = r.choice(vocabulary)
                elif k < 0.75 and len(item) > 1:
                    del item[p]
                else:
                    item.insert(p, r.choice(vocabulary))
            at = r.randint(0, len(w))
            w[at:at] = item
        texts.append(" ".join(w).title() if r.random() < 0.5 else "--".join(w))
    return items, texts + [None, ""]


def test_against_brute_force(spark):
    items, texts = fixture()
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if len(item) >= dc.LEAST_WORDS:
                cost = distance(item, split(t))
                if cost <= int(0.2 * len(item) + 1e-9):
                    want[d, i] = cost
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, " ".join(items[3]), 2)], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, "a b c d e f"), (99, None)], "item_id long, text string")
    rows = dc.contaminated(docs, bench).where("doc_id is not null").collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert len(rows) == len(got) and all(want.get(k) == v for k, v in got.items())
    assert len(got) >= 0.97 * len(want) and {k for k, v in want.items() if v == 0} <= set(got)
    for r in rows:
        stretch = split(texts[r.doc_id])[r.first_word : r.first_word + r.words]
        assert distance(items[r.item_id], stretch) == r.edits
    left = {r.doc_id for r in dc.decontaminate(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


def test_blocks_and_empty_tables(spark, monkeypatch):
    items, texts = fixture(docs=20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    monkeypatch.setattr(dc.blocks, "__defaults__", (40,))
    assert len(list(dc.blocks(bench))) > 3 and sorted(map(tuple, dc.contaminated(docs, bench).collect())) == whole
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 == dc.contaminated(docs.limit(0), bench).count()
    assert dc.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_all_allowed_edits_at_every_length(spark):
    r = random.Random(8)
    some = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    items, texts = [], []
    for n in (5, 9, 38, 100, 300):
        for kind in ("substitute", "delete", "mixed"):
            for _ in range(10):
                items.append(some(n))
                v = list(items[-1])
                for p in sorted(r.sample(range(n), int(0.2 * n)), reverse=True):
                    v[p : p + 1] = [] if kind == "delete" or kind == "mixed" and p % 3 == 0 else [f"x{p}"] if kind == "substitute" or p % 3 == 1 else [v[p], f"x{p}"]
                texts.append(" ".join(some(50) + v + some(50)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(m.doc_id, m.item_id) for m in dc.contaminated(docs, bench).collect()}
    assert got >= {(i, i) for i in range(len(items))}


def test_short_items_match_exactly(spark):
    docs = spark.createDataFrame([(0, "say Yes now"), (1, "who wrote it"), (2, "so, who wrote Hamlet? he"), (3, "who wrote the Hamlet"), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "yes"), (1, "Who wrote Hamlet?"), (2, "?!"), (3, "it now")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.first_word, r.words, r.edits) for r in dc.contaminated(docs, bench).collect()} == {(0, 0, 1, 1, 0), (2, 1, 1, 3, 0)}
    assert {r.doc_id for r in dc.decontaminate(docs, bench).collect()} == {1, 3, 4}


def test_items_without_id_count(spark):
    docs = spark.createDataFrame([(0, "x one two three four five six y"), (1, "something else")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three four five six"), (1, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in dc.contaminated(docs, bench).collect()] == [(0, None, 0)]
    assert [r.doc_id for r in dc.decontaminate(docs, bench).collect()] == [1]
