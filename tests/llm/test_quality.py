import re

from conftest import values_stay
from pyspark.sql import functions as F

from lorekeep.llm import quality, queries


def brute(t):
    t = t or ""
    w, at = re.findall(r"[^\x20\x09-\x0D]+", t), {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_whole_table_and_labels(spark, sf, texts):
    rows = queries.op3_quality_rules(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {i: brute(r.text) for i, r in texts.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        if r.doc_id in labels and not r.base_failed:
            assert r.kept == bool(labels[r.doc_id])


def test_odd_rows(odd, odd_rows, empty):
    rows = quality.judge(odd).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=key) == sorted(((r[0], *brute(r[1])) for r in odd_rows), key=key)
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0
    assert quality.clean(odd).columns == odd.columns


def test_lines(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(8)) + "." for i in range(12)]
    bad = ["Home | About | Contact | Help | More", "No end here at all", "A$$$ b### c%%% d&&& e.", "WE SHOUT ALL OF THIS NOW.", "Please read our cookie policy."]
    row = quality.judge(spark.createDataFrame([(1, "\n".join(good[:6] + bad + good[6:]))], "doc_id long, text string")).first()
    assert row.kept and row.clean_text.split("\n") == good
    row = quality.judge(spark.createDataFrame([(1, "\n".join(good[:6] + [" ".join(f"u{i}y{j}" for j in range(6)) for i in range(20)]))], "doc_id long, text string")).first()
    assert not row.base_failed and not row.kept


def test_clean_keeps_other_columns(spark, clashing):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(12)) + "\nHome | About | Contact | Help"
    docs = clashing.unionByName(clashing.limit(1).withColumn("text", F.lit(text)).withColumn("doc_id", F.lit(77).cast("long")))
    out = quality.clean(docs)
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(map(values_stay, rows))
    assert [r.text for r in rows if r.doc_id == 77] == [text.rsplit("\n", 1)[0]]
    judged = quality.judge(docs).collect()
    assert len(rows) == sum(r.kept for r in judged) and len(judged) == docs.count()


def test_short_lines_end_with_a_sentence(spark):
    lines = ["Mr. Home About Contact", "He said no.", "This line goes on. And then it is broken in the", "One two three four five six seven eight"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(quality.line_passes(F.col("x"))).collect()]
    assert got == [False, True, True, False]


def test_very_long_text(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(20_000))
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines, row.kept, row.clean_text == text) == (180_000, 0, 0, True, True)


def brute_lines(text):
    """The line rules, line by line."""
    good = []
    for x in text.split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        if w:
            end = r"[.!?;:…。！？][\"'’”»)\]]*"
            ok = re.search(end + (r"\s*$" if len(w) < 8 else r"(\s|$)"), x)
            ok = ok and len(re.findall(r"[#*$%&|<>]", x)) <= 0.05 * len(x)
            ok = ok and len(re.findall(r"\s(\||»|›|·|>|/)\s", x)) <= 0.2 * len(w)
            ok = ok and not re.search(quality.BOILERPLATE, x)
            ok = ok and (len(w) < 5 or len(re.findall("[A-Z]", x)) <= 3 * len(re.findall("[a-z]", x)))
            if not ok:
                continue
        good.append(x)
    return "\n".join(good)


def test_verdicts_match_brute_force(spark, sf, texts):
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in rows:
        clean = brute_lines(texts[r.doc_id].text or "")
        assert (r.clean_text or "") == clean
        assert r.kept == (not r.base_failed and words(clean) >= 0.5 * r.n_words)
