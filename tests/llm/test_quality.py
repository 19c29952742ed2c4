import random
import zlib

from tests.llm.brute import WORD
from tmengine.llm import quality_classifier, quality_rules

DOCS = "doc_id long, text string, source string, kept int, n_words string"


def expected(rows, share=0.08, least=5, min_left=0.5):
    key = lambda line: " ".join(WORD.findall(line)).lower()
    hosts, lines = {}, {}
    for _, text, source, *_ in rows:
        if text is None:
            hosts.setdefault(source or "", set()).add(None)
            continue
        hosts.setdefault(source or "", set()).add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                lines.setdefault((source or "", key(line)), set()).add(text)
    common = {k for k, v in lines.items() if len(v) > least and len(v) > share * len(hosts[k[0]])}
    out = []
    for doc, text, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = {}
        for i in range(len(words) - 2):
            windows.setdefault(tuple(words[i : i + 3]), []).append(i)
        marked = {p for v in windows.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
        full = [x for x in text.split("\n") if WORD.search(x)]
        removed = sum(len(WORD.findall(x)) for x in full if (source or "", key(x)) in common)
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        kept = not failed and len(words) - removed >= len(words) * min_left
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append(str((doc, len(words), sum(map(len, words)), symbols, len(full) - len(set(full)), len(marked), failed, removed, kept)))
    return sorted(out)


def sample():
    rng = random.Random(6)
    words = [("w%d" % i) * rng.randint(1, 2) for i in range(400)] + ["É#", "|", "<x>"]
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), "All  Rights\treserved " + "x " * 30)
        if rng.random() < 0.2:
            lines += lines
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None]), 9, "clash"))
    rows += [(500 + i, rows[0][1], "a", 9, None) for i in range(40)]
    rows += [(600, None, "a", 9, None), (601, "", None, 9, None), (None, "x y z " * 60, "b", 9, None), (3, "dup id " * 50, "a", 9, None), (602, "long " * 60_000, "c", 9, None), (603, "\n \n", "c", 9, None)]
    return rows


def test_rules_match_brute_force(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    for bound in (quality_rules.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", bound)
        got = quality_rules.quality_rules(df)
        cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
        assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == expected(rows)
    cut = [r for r in got.where("removed_words > 0").collect()]
    assert cut and all("reserved" not in r.clean_text for r in cut)


def test_rules_on_an_empty_table(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def documents(n=400):
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 200))]
        if not good:
            words = [rng.choice([w.upper() + "!!", w + "###", "|", w]) for w in words]
        out.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return out, labels


def test_classifier_is_accurate_on_held_out_rows(spark):
    docs, labels = documents()
    extra = [(None, "null id words"), (1000, None), (1001, ""), (1002, "x " * 100_000), (5, docs[5][1])]
    got = quality_classifier.quality_scores(
        spark.createDataFrame([(*d, 1) for d in docs + extra], "doc_id long, text string, score int"),
        spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5), (5, 0)], "doc_id long, quality int"),
    ).collect()
    assert len(got) == len(docs) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    twins = [r.score for r in got if r.doc_id == 5]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_classifier_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_classifier.quality_scores(docs, none).collect()] == [0.5]
    assert quality_classifier.quality_scores(docs.where("false"), none).count() == 0
