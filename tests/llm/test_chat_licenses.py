import itertools
import random

import numpy as np
import pyarrow.parquet as pq

from palaver.llm import chat, licenses

DATA = "/root/testdata/sf0.01"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    rows = np.array([0, 1, 4])
    e = rng.normal(size=(4, 6)) * 3
    got = chat.viterbi(e, rows)
    for a, b in ((0, 1), (1, 4)):
        def score(p):
            return chat.START[p[0]] + sum(e[a + i, s] for i, s in enumerate(p)) + sum(chat.STEP[s, t] for s, t in zip(p, p[1:]))
        best = max(itertools.product(range(6), repeat=b - a), key=score)
        assert tuple(got[a:b]) == best


def test_markers():
    t = "System: Be brief.\n\n**User:** What is it?\nMore: words here\nASSISTANT: An answer.\n\nSecond paragraph.\n\nHuman: Thanks"
    assert chat.parse([t])[0] == [("system", "Be brief."), ("user", "What is it?\nMore: words here"), ("assistant", "An answer.\n\nSecond paragraph."), ("user", "Thanks")]
    assert [r for r, _ in chat.parse(["Ann: Hi, who are you?\nBob: I am Bob.\nAnn: Good?\nBob: Yes."])[0]] == ["user", "assistant", "user", "assistant"]
    assert [r for r, _ in chat.parse(["<|user|>\nhi?\n<|end|>\n<|assistant|>\nyes, it is so.\n<|end|>"])[0]] == ["user", "assistant"]
    assert chat.parse([None, "", "\n \n"]) == [[], [], []] and chat.render([]) == ""
    assert chat.render([("user", "x")]) == "<|user|>\nx\n<|end|>\n"
    alone = chat.parse(["a?\nb: c"])
    assert chat.parse(["q: 1\na: 2", "a?\nb: c", None])[1:] == [alone[0], []]


def test_roles_of_the_table(spark):
    want = {}
    for r in sorted(pq.read_table(f"{DATA}/conversations.parquet").to_pylist(), key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append(r["role"])
    rows = chat.op4_chat_format(spark, DATA).collect()
    assert len(rows) == len(want) and all(r.roles.split(",") == want[r.conv_id] for r in rows)


def test_odd_conversations(spark):
    rows = [(1, 0, None, "Could you help?", 0), (1, 1, "assistant", None, 0), (1, 300, "user", "later", 0), (None, 0, "user", "x", 0), (None, 0, "user", "x", 0), (2, None, "bot", "y", 0), (1, 0, None, "Could you help?", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = sorted((str(r.conv_id), str(r.segment), r.n_turns) for r in chat.format_chats(chat.transcripts(df)).collect())
    assert len(got) == 4 and ("1", "1", 1) in got and ("2", "None", 1) in got
    assert chat.format_chats(chat.transcripts(df.limit(0))).count() == 0


def test_segments_are_parts_of_one_rendering(spark):
    r, rows = random.Random(5), []
    lines = ["Ann: Hi, who are you?", "Bob: I am Bob.", "Could you help?", "  some more words that look like prose and do not ask anything", "", "Cleo: well", "\n", "Yes.", "user:", "assistant: "]
    for c in range(30):
        rows += [(c, t, r.choice((None, None, "user", "assistant", "")) if c % 3 else None, "\n".join(r.choice(lines) for _ in range(r.randint(1, 3)))) for t in range(r.choice((3, 9, 40)))]
    rows += [(99, t, "system" if not t else None, ("Bob: I am." if t % 2 == 0 else "Ann: Who?") if t else "Be brief.") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for segment, some in ((4, df.where("conv_id < 99")), (256, df.where("conv_id = 99"))):
        whole = {x.conv_id: x.transcript for x in chat.transcripts(some, 10**6).collect()}
        turns = dict(zip(whole, chat.parse(list(whole.values()))))
        got = {}
        for x in sorted(chat.format_conversations(some, segment).collect(), key=lambda x: (x.conv_id, x.segment)):
            g = got.setdefault(x.conv_id, [0, [], ""])
            g[0], g[1], g[2] = g[0] + x.n_turns, g[1] + [y for y in x.roles.split(",") if y], g[2] + x.rendered
        assert got == {c: [len(t), [y for y, _ in t], chat.render(t)] for c, t in turns.items()}


def test_license_scan(spark):
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][0]
    body = "Some words about nothing. " * 20
    rows = [
        ("r/LICENSE", mit), ("r/a.txt", body), ("r/x/y/b.txt", body), ("r/x/COPYING", body + "\n" + apache), ("r/x/c.txt", body + mit + " " + body),
        ("s/d.txt", body), ("top.txt", body), (None, apache), ("r/x/e", None), ("r2/z", body), ("r/x/y/b.txt", body), ("q/f", "A licence to thrill and more words that no template has at all."),
    ]
    df = spark.createDataFrame([(p, t, "old", 7) for p, t in rows], "path string, text string, license string, share int").repartition(3)
    got = sorted((str(r.path), r.license, r.origin) for r in licenses.scan(df).collect())
    by = dict((g[0], g[1:]) for g in got)
    assert by["r/x/y/b.txt"] == ("Apache-2.0", "inherited") and by["r/x/c.txt"] == ("MIT", "header") and by["q/f"] == (None, None) and by["r/a.txt"] == ("MIT", "inherited") and len(got) == len(rows)
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_lines_of_the_table(spark):
    names = {"All rights reserved.": "Proprietary", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    want = {d["doc_id"]: n for d in docs for line, n in names.items() if line in d["text"]}
    got = {r.doc_id: r.license for r in licenses.op7_license_scan(spark, DATA).where("origin = 'header'").collect()}
    assert got == want and want


def test_document_frequencies(spark):
    texts = ["MIT license", "mit MIT", None, "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    count, total = licenses.document_frequencies(df)
    assert total == 4 and count["mit"] == 2 and count["license"] == 1 and count["apache"] == 0


def test_cosines_against_brute_force(spark):
    """TF-IDF vectors as plain dictionaries, every sentence and pair of sentences with every template."""
    import math
    import re
    from collections import Counter

    r = random.Random(6)
    words = [w for t in licenses.FILES.values() for w in licenses.words_of(t)] + [f"x{k}" for k in range(60)]
    some = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.FILES.values())
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 5)):
            t = r.choice(some).split() if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 12))]
            parts.append(" ".join(w for w in t if r.random() < 0.85))
        texts.append(r.choice(("\n", ". ", " ")).join(parts) + r.choice(("", " 日本語。", " “x”")))
    texts += ["", "Apache License\nVersion 2.0, January 2004", licenses.FILES["ISC"], licenses.FILES["MIT"].replace(" ", "\n")]
    cut = lambda t: tuple(licenses.words_of(t))
    n = len(texts) + 1
    frequency = Counter(w for t in texts for w in set(cut(t)))
    known = set(licenses.vocabulary())

    def vector(t):
        v = {w: (1 + math.log(k)) * (math.log(n / (frequency[w] + 1)) + 1 if w in known else math.log(n) + 1) for w, k in Counter(cut(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def closest(t, templates):
        v = vector(t)
        return max((round(sum(x * u.get(w, 0) for w, x in v.items()), 9) if len(v.keys() & u.keys()) >= 2 else 0.0, name) for name, u in templates)

    heads = [(name, vector(t)) for name, ts in licenses.TEMPLATES.items() for t in ts]
    whole = [(name, vector(t)) for name, t in licenses.FILES.items()]
    want = []
    for t in texts:
        parts = [p for p in re.split(r"\n+|(?<=[.!?])\s+", t) if cut(p)]
        found = [closest(p, heads) for p in parts + [f"{a} {b}" for a, b in zip(parts, parts[1:])]]
        file = [x for x in ([closest(t, whole)] if cut(t) else []) if x[0] >= licenses.FILE_COSINE]
        best = max([x for x in found if x[0] >= licenses.COSINE] + file, default=(0.0, None))
        want.append((best[1], round(best[0], 6), "file" if file else "header" if best[1] else None))
    df = spark.createDataFrame([(i, f"f{i}/t", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)
    got = [(x.license, round(x.cosine or 0.0, 6), x.origin) for x in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == want and {"file", "header", None} == {x[2] for x in got}


def test_nearest_ancestor_against_brute_force(spark):
    r = random.Random(7)
    names = ["MIT", "Apache-2.0", "GPL-3.0"]
    paths = []
    for k in range(200):
        folder = [r.choice("abc") for _ in range(r.randint(0, 4))]
        paths.append("/".join([*folder, r.choice(("LICENSE", "copying.txt", f"f{k}", f"f{k}", f"f{k}"))]))
    rows = [(i, p, licenses.TEMPLATES[r.choice(names)][0] if p.lower().rsplit("/", 1)[-1][0] in "lc" else "nothing here") for i, p in enumerate(paths)]
    found = {x.doc_id: x for x in licenses.scan_headers(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    got = {x.doc_id: (x.license, x.origin) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, p, _ in rows:
        if found[i]._own:
            assert got[i] == (found[i]._own, "header")
            continue
        folder, want = p.split("/")[:-1], None
        while want is None:
            here = [(found[j]._score, found[j]._own) for j, q, _ in rows if q.split("/")[:-1] == folder and found[j]._own]
            want = max(here)[1] if here else None
            if not folder:
                break
            folder = folder[:-1]
        assert got[i] == (want, "inherited" if want else None)


def test_one_document_licenses_no_source(spark):
    got = licenses.op7_license_scan(spark, DATA)
    assert {r.origin for r in got.select("origin").distinct().collect()} <= {"header", None}
