import random
import re
import zlib
from collections import Counter, defaultdict

from lumenframe.llm import quality, sharding
from util import SF, WORD, empty_documents, odd_documents, plain_clean


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(2)
    made = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    made = spark.createDataFrame(made, "doc_id long, text string")
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), empty_documents(spark), made):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [tuple(r) for r in quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
        want = []
        for d, t in rows:
            b = brute_base(t)
            want.append((d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_windows_survive_hash_clashes(spark, monkeypatch):
    """With all bits given to positions, every hash is equal and the words themselves decide."""
    monkeypatch.setattr(quality, "POS_BITS", 63)
    docs = spark.createDataFrame([(1, "a b c x a b c y z q a b"), (2, "p q r s t")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.judged(docs).collect()} == {1: 6, 2: 0}


SCRIPTS = {
    "Hindi": "यह पहला वाक्य है। यह दूसरा वाक्य है और यहाँ समाप्त होता है।", "Chinese": "这是第一个句子，说明一件事情。这是第二个句子！", "Japanese": "これは最初の文です。二番目の文は「引用」",
    "Arabic": "هذه هي الجملة الأولى. هل هذه هي الثانية؟", "Urdu": "یہ پہلا جملہ ہے۔", "Thai": "นี่คือประโยคแรกของข้อความนี้ และนี่คือประโยคที่สอง", "Lao": "ນີ້ແມ່ນປະໂຫຍກທໍາອິດ", "Amharic": "ይህ የመጀመሪያው ዓረፍተ ነገር ነው።", "Khmer": "នេះជាប្រយោគដំបូង។",
}


def test_scripts_keep_their_lines(spark):
    rows = [(i, f"{t}\n{t}  ") for i, t in enumerate(SCRIPTS.values())] + [(100, "Ein Satz ohne Ende"), (101, "没有结尾的一行"), (102, "बिना अंत की पंक्ति")]
    got = {r.doc_id: (r.n_lines_removed, r.loss) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x for i, x in got.items() if i < 100} == {i: (0, 0.0) for i in range(len(SCRIPTS))}
    assert all(got[i] == (1, 1.0) for i in (100, 101, 102))


def test_verdicts_match_a_plain_version(spark):
    made = spark.createDataFrame([(i, f"{t}\nHome\n{PROSE}{t}") for i, t in enumerate(SCRIPTS.values())], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents(spark), made):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, "\n".join(r.good) if r.kept else None) for r in quality.judged(docs).collect()]
        assert sorted(got, key=str) == sorted(((i, plain_clean(t)) for i, t in rows), key=str)


PROSE = "Here stands a sentence of some length, and it ends as sentences do. " * 4


def test_lines_decide(spark):
    words = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [
        (1, f"{words}\n{words.upper()}"), (2, f"{words}\nHome\nMenu\nAll rights reserved."), (3, "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i} | f{i}" for i in range(20))),
        (4, " ".join(f"w{i}$$$ v{i}&&&" for i in range(60))), (5, " ".join(f"LOUD{i}!!" for i in range(60))), (6, words), (7, f"{words} Then it breaks off"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_lines_removed) for r in quality.judged(docs).collect()}
    assert got[2] == (True, 3) and got[6] == (True, 0) and got[7] == (True, 0)
    assert not any(got[i][0] for i in (3, 4, 5))
    cleaned = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    assert cleaned[2] == words and cleaned[6] == words and 3 not in cleaned


def test_quality_is_native(spark):
    plan = quality.op3_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def brute_minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                n, held = n + 1, 0
            held += s
        low, high = (mid + 1, high) if n > shards else (low, mid)
    return low


def check_shards(docs, shards):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    slots, group, mass = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        group[r.text_crc32, r["size"]].add(r.shard)
        mass[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in group.values()) and set(slots) <= set(range(shards))
    if rows:
        keyed = [(r.key, r["size"]) for r in sharding.with_keys(docs).collect()]
        sizes = Counter()
        for k, s in keyed:
            sizes[k] += s
        best = brute_minimax([sizes[k] for k in sorted(sizes)], shards)
        assert max(mass.values()) == best == got[0].capacity


def test_sharding_is_minimax(spark):
    rng = random.Random(1)
    made = [(i, "x" * int(rng.paretovariate(0.8) * 10) + str(i)) for i in range(3000)] + [(5, "hot " * 500)] * 60
    for docs, shards in ((spark.read.parquet(f"{SF}/documents.parquet"), 8), (odd_documents(spark), 8), (empty_documents(spark), 8), (odd_documents(spark), 1)):
        check_shards(docs, shards)
    check_shards(spark.createDataFrame(made, "doc_id long, text string"), 8)
    check_shards(spark.createDataFrame(made, "doc_id long, text string"), 5)
