"""Conversation trie, spelling variants and license scan against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import licenses, prefixtrie, spelling

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


# --- prefix trie ------------------------------------------------------------------------------------------------


def brute_nodes(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [z[1:] for z in sorted(v, key=lambda z: z[0])] for c, v in turns.items()}
    built = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9:] for c in own}
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_turns(seed, convs=45):
    rnd = random.Random(seed)
    rows = [(c, t, "u" if rnd.random() < 0.9 else rnd.choice([None, "a"]), "same" if rnd.random() < 0.85 else rnd.choice(["x", "é", None]))
            for c in range(convs) for t in range(rnd.choice([1, 2, 5, 9, 14, 25]))]
    copy = [(200 + i, t, "u", f"w{t}") for i in range(5) for t in range(30)]  # one long text, five times
    return rows + copy + [(100, None, "u", "z"), (100, None, "u", "z"), (100, 3, None, None), (None, 1, "u", "z"), (107, 1, "u", "alone")]


@pytest.mark.parametrize("band,shard", [(1024, 131_072), (3, 5), (4, 1)])
def test_trie_equals_brute_force(spark, band, shard):
    rows = random_turns(band)
    df = spark.createDataFrame(rows, TURNS).withColumn("k1", F.lit("clash")).withColumn("pos", F.lit(0)).repartition(5)
    got = sorted((tuple(r) for r in prefixtrie.prefix_nodes(df, band=band, shard=shard).collect()), key=str)
    assert got == brute_nodes(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefixtrie.prefix_nodes(spark.createDataFrame([], TURNS)).count() == 0
    c = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "u", "gone")]  # its only turn is dropped and its base is absent
    assert [tuple(r) for r in prefixtrie.prefix_nodes(spark.createDataFrame(rows, TURNS)).collect()] == brute_nodes(rows)


def test_findclose_equals_a_stack():
    rnd = random.Random(1)
    for n in (1, 5, 63, 64, 65, 700, 5000):
        opens, depth = [], 0
        for i in range(2 * n):
            left = 2 * n - i
            up = depth == 0 or (depth < left and rnd.random() < 0.55)
            opens.append(up)
            depth += 1 if up else -1
        stack, want = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        p = np.flatnonzero(opens)
        assert prefixtrie.Parentheses(np.array(opens)).findclose(p).tolist() == [want[i] for i in p.tolist()]


def test_digest_of_a_hot_end_node(spark):
    """Many conversations that end at one node, over several batches and tasks."""
    rows = [(5 * i, 0, "u", "hello") for i in range(12_000)]
    got = [tuple(r) for r in prefixtrie.prefix_nodes(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=str) == brute_nodes(rows)


# --- spelling variants ----------------------------------------------------------------------------------------------


def brute_words(docs, damage=97, shortest=5, least=3):
    seen = collections.Counter()
    for i, t in docs:
        for w in re.findall("[a-zÀ-ÿ]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    n = {w: k for w, k in seen.items() if len(w) >= shortest and k >= least}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgàéÿ×") for _ in range(rnd.randint(4, 9))) for _ in range(40)]
    words += [w[:k] + rnd.choice("abzÀé") + w[k + rnd.randint(0, 1):] for w in words for k in range(0, 6)]
    docs = [(i if i % 17 else None, rnd.choice(" .,-_1\nŁ").join(rnd.choice(words).upper() if rnd.random() < 0.1 else rnd.choice(words) for _ in range(60))) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "same " * 4000), (902, "same " * 4000), (903, "Größe GRÖßE größe Straße straße strasse")]
    df = spark.createDataFrame(docs, DOCS).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("r", F.lit(3))
    got = sorted((tuple(r) for r in spelling.spelling_variants(df).collect()), key=str)
    assert got == brute_words(docs) and any(r[1] and r[2] != r[1] for r in got)


def test_spelling_of_one_dense_bucket(spark):
    """Words whose letters share their symbols all reduce to one word."""
    letters = [x for x in spelling.LETTERS if ord(x) % len(spelling.SYMBOLS) == 1][:4]
    words = [a + b + c + "hhh" for a in letters for b in letters for c in letters]
    docs = [(i, " ".join(w for w in words for _ in range(3 + (i + len(w)) % 2)) + " " + words[0]) for i in range(3)]
    assert len({tuple(ord(x) % len(spelling.SYMBOLS) for x in w) for w in words}) == 1
    got = sorted((tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(docs, DOCS)).collect()), key=str)
    assert got == brute_words(docs)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0


# --- license scan -------------------------------------------------------------------------------------------------


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    at, found = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                found.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


def test_license_base_equals_brute_force(spark):
    rnd = random.Random(4)
    bag = "gnu general public license apache mit cc by LICENSE Licensé K the of 3".split()
    docs = [(i if i % 13 else None, rnd.choice([" ", "-", "\n", "\x00"]).join(rnd.choice(bag) for _ in range(rnd.choice([0, 1, 2, 50, 400])))) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "MIT License " * 3000), (503, "mit-license"), (503, "mit-license"), (503, "apache license")]
    df = spark.createDataFrame(docs, DOCS).withColumn("k", F.lit(1)).withColumn("h", F.lit(1)).withColumn("template", F.lit("x"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_report(df).collect())
    assert got == collections.Counter((i, *brute_base(t)) for i, t in docs)


def test_license_notices(spark):
    label, notice = next(n for n in licenses.NOTICES if n[0] == "bsd")
    words = notice.split()
    changed = words[:5] + ["oddly"] + words[5:12] + words[13:]
    docs = [(1, "x " * 40 + notice.upper() + " y" * 40), (2, "x " + " ".join(changed)), (3, " ".join(words[:7])), (4, " z z ".join(words)), (5, "nothing here"), (6, (notice + " ") * 50)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == (label, 1.0) and got[2][0] == label and 0.75 <= got[2][1] < 1
    assert got[3][0] == "" and 0 < got[3][1] < 0.75
    assert got[4] == ("", 0.0) and got[5] == ("", 0.0) and got[6] == (label, 1.0)


def test_license_report_of_nothing(spark):
    assert licenses.license_report(spark.createDataFrame([], DOCS)).count() == 0


# --- payloads that look like records ----------------------------------------------------------------------------------


def test_lengths_in_payloads_are_no_records(spark, tmp_path):
    from estatelens.llm import warc
    heads = ["WARC/1.1\r\nContent-Length: %s\r\n\r\n" % n for n in ("²", "9" * 5000, "-3", "12", "0x10", " 7 ", "", "9" * 18)]
    rows = [(i, f"http://a/{i}", h * 3 + "x" * 200) for i, h in enumerate(heads)]
    folder = str(tmp_path / "w")
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    for block in (1 << 10, 1 << 22):
        got = warc.read_records(archives, folder, block).select("page_id", "url", F.decode("payload", "utf-8")).collect()
        assert sorted(map(tuple, got)) == rows


# --- language identification ---------------------------------------------------------------------------------------------


def test_language_scores_equal_kernels_of_sets():
    """Kernel, Nyström map and ridge solution written down with Python sets and dense algebra."""
    from estatelens.llm.langid import KernelModel
    rnd = random.Random(6)
    bags = {"aa": "die und der ein nicht über".split(), "bb": "les une être où déjà que".split(), "cc": "the and of with from that".split()}
    make = lambda lang: " ".join(rnd.choice(bags[lang]) for _ in range(rnd.randint(1, 25)))
    labels = [lang for lang in bags for _ in range(20)]
    texts = [make(lang) for lang in labels]
    model = KernelModel(texts, labels, landmarks=4, ridge=0.1)

    def grams(t):
        b = t.lower().encode()
        return {b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    marks = [t for lang in bags for t in [x for x, y in zip(texts, labels) if y == lang][:4]]
    known = set().union(*map(grams, marks))
    sets = lambda ts: [grams(t) & known for t in ts]
    k = lambda a, b: np.array([[len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])
    m = sets(marks)
    asked = [make(rnd.choice(list(bags))) for _ in range(40)] + ["", "xyz", "日本"]
    assert np.allclose(model.kernel(asked), k(sets(asked), m), atol=1e-5)
    w, v = np.linalg.eigh(k(m, m))
    ok = w > 1e-6 * w.max()
    nystroem = lambda ts: np.hstack([k(sets(ts), m) @ v[:, ok] / np.sqrt(w[ok]), np.ones((len(ts), 1))])
    phi, y = nystroem(texts), np.array([[1.0 if lang == c else -1.0 for c in sorted(bags)] for lang in labels])
    f = nystroem(asked) @ np.linalg.solve(phi.T @ phi + 0.1 * np.eye(phi.shape[1]), phi.T @ y)
    best, score = model.predict(asked)
    clear = np.sort(f, axis=1)[:, -1] - np.sort(f, axis=1)[:, -2]
    assert (best == f.argmax(axis=1))[clear > 1e-3].all() and np.allclose(score, 1 / (1 + np.exp(-3 * np.minimum(clear, 10))), atol=1e-3)
